import gzip
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import warc
from gaugeworks.llm.queries import op12_warc

DDL = "page_id bigint, url string, html string"


def wanted(rows):
    """Rows of the contract by plain Python; null ids are greater than any."""
    groups, out = {}, []
    for page, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page is None, page or 0, url is None, url or ""))
    for data, keys in groups.items():
        keys.sort()
        first = None if keys[0][0] else keys[0][1]
        for k, key in enumerate(keys):
            revisit = len(data) >= 100 and k > 0
            out.append((None if key[0] else key[1], len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


LONG = "<p>wörd</p>" * 40
ROWS = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (3, "http://a/3", LONG), (9, None, LONG), (None, "http://n", LONG), (1, "http://a/1", None), (2, "", ""), (2, "", ""),
    (4, "http://a/x y\r\nX-Page-ID: 7", "short"), (6, "http://ü/é", "short"), (7, "u", "x" * 100), (8, "u", "x" * 100), (10, "u", "x" * 99), (11, "u", "x" * 99),
    (-12, "u", "y" * 300), (12, "u", "y" * 300), (None, None, "only null " * 30), (None, None, "only null " * 30), (13, "v", "tie" * 90), (13, "u", "tie" * 90), (14, "big", "z\r\n\r\n" * 300_000),
]


@pytest.mark.parametrize("roll", [1, 2000, 1 << 20])
def test_round_trip(spark, tmp_path, roll):
    pages = spark.createDataFrame([(*r, 1, "p") for r in ROWS], DDL + ", size int, PAYLOAD string")
    path = warc.write_archives(pages, f"file://{tmp_path}/w", roll_bytes=roll)
    out = warc.read_archives(spark, path, payloads=True)
    assert found(out) == wanted(ROWS)
    texts = {(r.page_id, r.payload_digest): bytes(r.payload).decode() for r in out.collect() if r.record_type == "response"}
    assert all(texts[k] == h for k, h in {(p, hashlib.sha256((h or "").encode()).hexdigest()): h or "" for p, _, h in ROWS}.items() if k in texts)
    names = sorted(os.listdir(tmp_path / "w/archive"))
    assert not os.path.exists(tmp_path / "w/temporary") and all(n.endswith(".warc.gz") for n in names)
    assert len(names) == len(ROWS) if roll == 1 else len(names) < 8


def test_files_are_plain_warc(spark, tmp_path):
    path = warc.write_archives(spark.createDataFrame(ROWS, DDL), f"{tmp_path}/w", shards=1)
    (name,) = os.listdir(f"{path}/archive")
    with gzip.open(f"{path}/archive/{name}") as f:
        data = f.read()
    kinds, at = [], 0
    while at < len(data):  # by lengths, as any reader does
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode()
        assert head.startswith("WARC/1.1\r\n")
        kinds.append(re.search(r"WARC-Type: (\w+)", head)[1])
        at = end + 4 + int(re.search(r"\r\nContent-Length: (\d+)", head)[1])
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
    assert kinds[0] == "warcinfo" and len(kinds) == len(ROWS) + 1
    ids = re.findall(rb"WARC-Record-ID: (\S+)", data)
    assert len(ids) == len(set(ids)) and set(re.findall(rb"WARC-Refers-To: (\S+)", data)) <= set(ids)


def test_equal_rows_make_equal_files(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sums = []
    for k, order in enumerate([F.col("page_id"), F.rand(7)]):
        other = pages.repartition(3 + k).sortWithinPartitions(order)
        other.write.parquet(f"{tmp_path}/in{k}")
        path = warc.write_archives(spark.read.parquet(f"{tmp_path}/in{k}"), f"{tmp_path}/w{k}", roll_bytes=40_000, shards=10)
        listed = spark.read.parquet(f"{path}/manifest").collect()
        assert len({r.shard for r in listed}) > 3 and max(r.bytes for r in listed) < 60_000
        sums.append({r.name: r.sha256 for r in listed})
        ids = [r.page_id for r in sorted(warc.read_archives(spark, path).collect(), key=lambda r: (r.file, r.offset))]
        assert ids == sorted(ids)
    assert sums[0] == sums[1]


def test_commit_again_and_damage(spark, tmp_path):
    path = warc.write_archives(spark.createDataFrame(ROWS, DDL), f"{tmp_path}/w", shards=1)
    os.makedirs(f"{path}/temporary")
    (name,) = os.listdir(f"{path}/archive")
    with open(f"{path}/temporary/left-over", "wb") as f:
        f.write(b"torn")
    warc.commit(spark, path)
    assert not os.path.exists(f"{path}/temporary") and found(warc.read_archives(spark, path)) == wanted(ROWS)
    with open(f"{path}/archive/{name}", "rb") as f:
        data = f.read()
    with open(f"{path}/archive/{name}", "wb") as f:
        f.write(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut off|not the file"):
        warc.read_archives(spark, path).collect()
    os.remove(f"{path}/archive/{name}")
    with pytest.raises(Exception, match="No such file|Failed to open"):
        warc.read_archives(spark, path).collect()


def test_many_copies_and_nothing(spark, tmp_path):
    rows = [(k // 3, f"u{k % 2}", "same page " * 20) for k in range(3000)] + [(9, "u", "again " * 30)] * 500
    assert found(warc.round_trip(spark.createDataFrame(rows, DDL))) == wanted(rows)
    assert warc.round_trip(spark.createDataFrame([], DDL)).count() == 0


def test_query_runs_on_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert found(op12_warc(spark, "/root/testdata/sf0.001")) == wanted([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
