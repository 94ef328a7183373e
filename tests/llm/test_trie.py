import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gaugeworks.llm import prefix_trie
from gaugeworks.llm.queries import op11_prefix_trie

DDL = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, rebuild=True):
    """The rows of the contract by plain Python."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole[c] = convs.get(c - c % 100, [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(members) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def random_rows(rng, convs, turns, texts="abc", step=1):
    rows = []
    for c in range(convs):
        rows += [(c * step, t, rng.choice("ua"), rng.choice(texts) * rng.randrange(1, 3)) for t in range(rng.choice(turns))]
    return rows


@pytest.mark.parametrize("section,shards,run", [(128, 50_000, 2 << 20), (2, 5, 1), (3, 3, 300), (1, 40, 1)])
def test_equals_brute_force(spark, monkeypatch, section, shards, run):
    monkeypatch.setattr(prefix_trie, "SECTION", section)
    monkeypatch.setattr(prefix_trie, "SHARD_SECTIONS", shards)
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", run)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(section)
        rows = random_rows(rng, 40, [1, 2, 3, 7, 9], step=13) + [(500, t, "u", "a") for t in range(20)] + [(520, t, "u", "a") for t in range(20)] + [(533, t, "u", "a") for t in range(11)]
        assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, DDL), rebuild=True)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_of_any_size_make_one_tree():
    """The points of sorted sections, cut into runs anywhere and added up, are those of one run."""
    rng = random.Random(2)
    for _ in range(60):
        keys = {bytes(prefix_trie._HEAD) + b"".join(hashlib.sha256(f"{i}{rng.choice('ab')}".encode()).digest()[: prefix_trie._TURN] for i in range(rng.randrange(6))) for _ in range(25)}
        rows = [(k, [1 + i for i in range((len(k) - prefix_trie._HEAD) // prefix_trie._TURN)], rng.randrange(1, 4), rng.randrange(99), False, 0, 0) for k in sorted(keys)]

        def added(cuts, rows=rows):
            out = {}
            for a, b in zip(cuts, cuts[1:], strict=False):
                for p in prefix_trie.points_of(rows[a:b], rows[a - 1][0] if a else None, rows[b][0] if b < len(rows) else None, 128):
                    n, member, leaves, below, suffix = out.get(p[:3], (0, p[7], 0, 0, p[10]))
                    assert suffix == p[10]
                    out[p[:3]] = n + p[6], min(member, p[7]), leaves + p[8], below + p[9], suffix
            return out

        whole = added([0, len(rows)])
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(1, 8)))) if len(rows) > 1 else []
        parts = added([0, *cuts, len(rows)])
        assert all(parts[k] == v for k, v in whole.items() if k in parts and len(parts[k][4]) == len(v[4]))
        assert set(whole) <= set(parts) and all(parts[k][:4] == v[:4] for k, v in whole.items())


def test_odd_rows(spark):
    rows = [(7, None, None, None), (7, 2, "u", "x"), (7, 2, "u", "x"), (7, 2, "a", "y"), (7, None, "u", ""), (None, 1, "u", "lost"), (100, 1, "u", "b" * 5000), (107, 5, "a", "😀é"), (108, 1, "u", "z"),
            (-5, 1, "u", "n"), (-205, 1, "u", "n"), (3, 1, "u", "")]
    df = spark.createDataFrame([(*r, "q", 4) for r in rows], DDL + ", CONV string, n int")
    assert found(prefix_trie.conversation_trie(df)) == brute(rows, False)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], DDL), rebuild=True).count() == 0
    # a base that has no rows, and conversations that lose all their turns
    lonely = [(c, 0, "u", "only") for c in range(201, 260)]
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(lonely, DDL), rebuild=True)) == brute(lonely)


def test_one_conversation_holds_most_rows(spark):
    rows = [(300, t // 2, "u", str(t % 97)) for t in range(300)] + [(c, t, "a", str(t)) for c in range(301, 330) for t in range(4)]
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, DDL).repartition(5), rebuild=True)) == brute(rows)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op11_prefix_trie(spark, "/root/testdata/sf0.01")
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found(got) == brute(rows)
