"""Queries and operators that once did a part of their job."""

import random
from itertools import combinations, permutations

import pytest

from gaugeworks.functions import text
from gaugeworks.operators import compare
from gaugeworks.plans.queries import QUERIES


def backtrace(ref, hyp):
    """Edits cell by cell: match or substitution, then deletion, then insertion."""
    cost = [[max(i, j) if not i or not j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i, r in enumerate(ref, 1):
        for j, h in enumerate(hyp, 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (r != h), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], len(ref), len(hyp)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append(("match" if ref[i] == hyp[j] else "sub", ref[i], hyp[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(("del", ref[i], None))
        else:
            j -= 1
            out.append(("ins", None, hyp[j]))
    return out[::-1]


def test_long_turns_are_aligned_whole(spark, tmp_path):
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(12)}" for _ in range(n)]
    turns = [words(n) for n in (60, 75, 3, 120, 41, 40)]
    turns.append(turns[-1] + ["late"])
    rows = [(1, k, "user", " ".join(t)) for k, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {k: backtrace(a, b) for k, (a, b) in enumerate(zip(turns, turns[1:], strict=False))}
    of = lambda x, op: sum(o == op for o, _, _ in x)
    got = {r.turn: r for r in QUERIES["word_alignment"](spark, str(tmp_path)).collect()}
    assert {k: (r.n_ref, r.n_match, r.n_sub, r.n_del, r.n_ins) for k, r in got.items()} == {k: (len(turns[k]), *(of(x, o) for o in ("match", "sub", "del", "ins"))) for k, x in want.items()}
    foreign = {r.turn: (r.n_words, r.n_foreign) for r in QUERIES["foreign_words"](spark, str(tmp_path)).collect()}
    assert foreign == {k: (len(b), sum(w not in a for w in b)) for k, (a, b) in enumerate(zip(turns, turns[1:], strict=False))}
    lost = {r.word: (r.n_destroyed, r.n_chances) for r in QUERIES["word_inventory"](spark, str(tmp_path)).collect()}
    edits = [e for x in want.values() for e in x]
    assert lost == {w: (sum(o in ("sub", "del") and r == w for o, r, _ in edits), sum(t.count(w) for t in turns[:-1])) for w in {r for o, r, _ in edits if o in ("sub", "del")}}
    total = [r for r in QUERIES["insertion_origins"](spark, str(tmp_path)).collect() if r.conv_id is None]
    assert [(r.n_ins, r.n_foreign) for r in total] == [(sum(of(x, "ins") for x in want.values()), sum(o == "ins" and h not in turns[k] for k, x in want.items() for o, _, h in x))]


def test_backtrace_equals_cell_by_cell():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        assert text._backtrace(a, b) == backtrace(a, b)


def test_assignment_of_unequal_sizes_is_least(spark):
    rng = random.Random(4)
    groups = {f"g{k}": [[rng.randrange(40) / 4 for _ in range(n)] for n in sizes] for k, sizes in enumerate([(3, 6), (6, 3), (1, 5), (4, 4), (0, 2), (2, 0), (5, 6)])}
    rows = [[(g, i, v) for g, sides in groups.items() for i, v in enumerate(sides[s])] for s in (0, 1)]
    rows[0] += [("g0", 77, None), (None, 78, 1.0)]
    rows[1] += [(None, 79, 1.0)]
    a, b = (spark.createDataFrame(x, "g string, id long, v double") for x in rows)
    got = compare.nearest_assignment(a, b, ["g"], "v", "id", 0.5).collect()
    assert sorted((r.g or "", r.a) for r in got if r.a is not None) == sorted((g or "", i) for g, i, _ in rows[0])
    assert sorted((r.g or "", r.b) for r in got if r.b is not None) == sorted((g or "", i) for g, i, _ in rows[1])
    for g, (x, y) in groups.items():
        few, many = sorted((x, y), key=len)
        pairs = [r for r in got if r.g == g and r.a is not None and r.b is not None]
        assert len(pairs) == len(few)
        assert all(r.delta == abs(x[r.a] - y[r.b]) and r.status == ("paired" if r.delta <= 0.5 else "too_far") for r in pairs)
        assert sum(r.delta for r in pairs) == pytest.approx(min(sum(abs(p - q) for p, q in zip(few, take, strict=True)) for some in combinations(many, len(few)) for take in permutations(some)))
    assert {r.status for r in got if r.g is None or 77 == r.a} == {"unmatched"}


def test_many_assets_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(compare, "RANGE_ROWS", 700, raising=False)
    rng = random.Random(6)
    # two far clusters of assets, with repeated values; wanted values lie between, on and outside them
    assets = [(k, rng.randrange(4000) / 8 + rng.choice([0, 100_000])) for k in range(10_500)]
    wanted = [(k, float(v)) for k, v in enumerate([-5, 0, 250, 250, 50_000, 100_499.9, 200_000] + [rng.uniform(-100, 100_600) for _ in range(1500)] + [rng.randrange(4000) / 16 for _ in range(300)])]
    got = compare.closest(spark.createDataFrame([*wanted, wanted[0]], "id long, v double"), spark.createDataFrame(assets, "k long, v double"), "v", "k").collect()
    want = {i: min((abs(v - h), k) for k, h in assets) for i, v in wanted}
    assert len(got) == len(wanted)
    assert {r.id: (r.distance, r.asset) for r in got} == want


def test_queries_run_with_the_operators_defaults(spark, monkeypatch):
    from gaugeworks.operators import active, resampling

    asked = {}
    monkeypatch.setattr(resampling, "bootstrap_mean", lambda rows, *a, **k: asked.setdefault("replicates", a[2:] or k))
    QUERIES["bootstrap_wer"](spark, "/root/testdata/sf0.001")
    real = active.curves
    monkeypatch.setattr(active, "curves", lambda *a, **k: asked.setdefault("curves", k) and None or real(*a, **k))
    got = QUERIES["active_curves"](spark, "/root/testdata/sf0.001").collect()
    assert asked == {"replicates": {}, "curves": {}} and max(r.n_evals for r in got) == 30
