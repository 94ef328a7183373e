"""Web archives: a deterministic sharded WARC writer, and a reader of what it committed.

1. Rows are counted by (id, URL, payload digest); of equal payloads of at least 100 bytes the
   smallest row is the ``response`` and the others are ``revisit`` records.  Only digests and
   ids are shuffled for that.
2. Records are put in order of id, payload digest, URL and copy.  Where shards begin is read
   off a sample chosen by a hash of the record, weighted by size: the same rows make the same
   shards, whatever partitions they come in.  One shuffle brings the payloads to their shards;
   a map task sends the smallest row it has seen of a payload only, so copies don't travel.
3. A shard's task writes gzip members, one a record, and rolls to the next file when the
   compressed size is reached.  Headers, lengths, ids and digests are made anew from the
   payload.  Files get temporary names that no two attempts share.
4. The names come back as rows of a manifest, which Spark commits task by task, so the files of
   lost or repeated attempts are in no manifest.  Then the files are renamed; that can be
   done again at any time (``commit``).  Readers open what the manifest lists and check it.

A shard's memory is one record and the buffers of a file; revisits of a hot payload lie
wherever their ids put them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import persist, scan_bytes, shared_path, tune

#: Payloads from so many bytes on are told once.
LEAST_REVISIT = 100
#: Compressed bytes after which a file is closed, input bytes of a shard, most shards, sampled records a shard.
ROLL_BYTES, SHARD_BYTES, MOST_SHARDS, SAMPLED = 8 << 20, 8 << 20, 8192, 16
#: Payloads of which a map task remembers the smallest row that it has sent.
REMEMBERED = 200_000
#: Every record's date, so that equal rows make equal files.
DATE = "1970-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, temporary string, name string, bytes bigint, records bigint, sha256 string"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, target_uri string, file string, offset bigint"


def target_uri(url: str | None, page_id: int | None) -> str:
    """The URL as a header can hold it; a name made of the id where there is none."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else f"urn:page:{'none' if page_id is None else page_id}"


def record_id(page_id: int | None, digest: str, url: str | None, copy: int) -> str:
    """A record's name, from what tells it from others."""
    name = f"{page_id}\n{digest}\n{copy}\n{url}".encode()
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name).digest()[:16], version=5)}>"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record; fields without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def page_record(row: dict, payload: bytes | None) -> bytes:
    """A response (with its payload) or a revisit (without) of one page."""
    digest, revisit = row["digest"].hex(), row["record_type"] == "revisit"
    if not revisit and sha256(payload) != digest:
        raise ValueError(f"page {row['page_id']}: its payload is not that of its digest")
    block = http_head(row["size"]) + (b"" if revisit else payload)
    fields: list[tuple[str, object]] = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"], digest, row["url"], row["copy"])), ("WARC-Date", DATE),
        ("WARC-Target-URI", target_uri(row["url"], row["page_id"])), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{sha256(block)}"),
    ]
    if revisit:
        to, url = row["refers_to"], row["refers_url"]
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(to, digest, url, 0)), ("WARC-Refers-To-Target-URI", target_uri(url, to)), ("X-Refers-To-Page-ID", to)]
    return record([*fields, ("X-Page-ID", row["page_id"]), ("Content-Type", "application/http; msgtype=response")], block)


def info_record(name: str) -> bytes:
    block = f"format: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, "", name, 0)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def member(data: bytes) -> bytes:
    """One gzip member, without a time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def store_of(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    return files.FileSystem.from_uri(path)


@dataclass
class ShardWriter:
    """Writes the records of one shard to files of about ``roll`` compressed bytes, under
    temporary names; ``closed`` holds their manifest rows."""

    path: str
    shard: int
    attempt: str
    roll: int
    seq: int = 0
    closed: list[tuple] = field(default_factory=list)
    stream: object = None

    def write(self, data: bytes) -> None:
        if self.stream is None:
            self.name = f"part-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.name}.{self.attempt}"
            store, at = store_of(self.path)
            store.create_dir(f"{at}/temporary")
            self.stream, self.size, self.records, self.hash = store.open_output_stream(f"{at}/temporary/{self.temporary}", compression=None), 0, 0, hashlib.sha256()
            self._put(member(info_record(self.name)))
        self._put(member(data))
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.closed.append((self.shard, self.seq, self.temporary, self.name, self.size, self.records, self.hash.hexdigest()))
            self.stream, self.seq = None, self.seq + 1


def _place(page_id: int | None, digest: bytes, url_hash: int, copy: int) -> tuple:
    """A record's place in the order; ids that are null come last."""
    return page_id is None, page_id or 0, digest, url_hash, copy


def _records(keys: DataFrame) -> DataFrame:
    """Every record without its payload, from counted rows (small payloads have theirs)."""
    large = F.col("size") >= LEAST_REVISIT
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    # a digest stands for a payload: where it occurs in one row only, that row is its response
    first = keys.where(large).groupBy(F.col("digest").alias("_d")).agg(F.min(order).alias("first"))
    out = keys.join(first, large & (F.col("digest") == F.col("_d")), "left").withColumn("mine", F.coalesce(order == F.col("first"), F.lit(False)))
    # copy 0 of a large payload is its response; small ones are all responses
    low = F.when(~large | F.col("mine"), F.lit(0)).otherwise(F.lit(1)).cast("long")
    out = out.withColumn("copy", F.explode(F.sequence(low, low + F.col("n") - 1)))
    response = ~large | (F.col("mine") & (F.col("copy") == 0))
    return out.select(
        "page_id", "url", "digest", F.xxhash64("url").alias("url_hash"), "copy", "size", F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("first.page_id")).alias("refers_to"), F.when(~response, F.col("first.url")).alias("refers_url"), F.lit(0).alias("kind"), F.col("tiny").alias("payload"),
    )


def shard_bounds(records: DataFrame, n_records: int, shards: int) -> list[tuple]:
    """The places where shards but the first begin, at most ``shards`` - 1 of them: equal
    shares of the size of a sample of about SAMPLED records a shard, chosen by hash.  The
    sample is bounded by SAMPLED x MOST_SHARDS rows of some 60 bytes."""
    if shards < 2:
        return []
    step = max(1, n_records // (SAMPLED * shards))
    chosen = records.where(F.pmod(F.xxhash64("page_id", "digest", "url_hash", "copy"), F.lit(step)) == 0)
    weight = F.lit(400) + F.when((F.col("record_type") == "response"), F.col("size")).otherwise(0)
    rows = sorted((_place(r.page_id, bytes(r.digest), r.url_hash, r.copy), r.w) for r in chosen.select("page_id", "digest", "url_hash", "copy", weight.alias("w")).collect())
    total, passed, out = sum(w for _, w in rows), 0, []
    for place, w in rows:
        if passed * shards >= total * (len(out) + 1):
            out.append(place)
        passed += w
    return out


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> str:
    """Write one record per row below ``path`` and commit; returns ``path``.  ``shards``: how
    many; left out, as many as the input's bytes ask for.

    Of records with equal payloads of at least 100 bytes that of the smallest id (then URL)
    is the response and the others are revisits of it; smaller payloads are all responses.
    Null html is an empty payload; a null or empty URL is replaced by a name made of the id;
    null ids come last and count as greater than any.  Equal rows are a record each.  An
    empty table commits no file.  Other columns are ignored.
    """
    spark = pages.sparkSession
    tune(spark)
    body = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    tiny = F.when(F.col("size") < LEAST_REVISIT, F.col("payload"))
    keys = persist(rows.groupBy("page_id", "url", "digest", "size").agg(F.count("*").alias("n"), F.first(tiny).alias("tiny")), "warc-keys")
    n_records = keys.agg(F.sum("n")).first()[0] or 0
    records = _records(keys)
    shards = min(MOST_SHARDS, shards or max(1, -(-scan_bytes(rows) // SHARD_BYTES)))
    bounds = shard_bounds(records, n_records, shards)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Payload rows: a task sends a payload's row unless it has sent a smaller one."""
        sent: OrderedDict = OrderedDict()
        for batch in batches:
            ids, urls, digests = (batch.column(k).to_pylist() for k in range(3))
            keep = []
            for k, (page, url, digest) in enumerate(zip(ids, urls, digests, strict=True)):
                mine = (page is None, page or 0, url is None, url or "")
                known = sent.get(digest)
                if known is None or mine < known:
                    sent[digest] = mine
                    keep.append(k)
                    if len(sent) > REMEMBERED:
                        sent.popitem(last=False)
            if keep:
                yield dealt(batch.take(pa.array(keep)))

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, digests, hashes, copies = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "digest", "url_hash", "copy"))
        shard = [bisect_right(bounds, _place(*r)) for r in zip(ids, digests, hashes, copies, strict=True)]
        return batch.append_column("shard", pa.array(shard, pa.int32()))

    nothing = F.lit(None)
    payloads = rows.where(F.col("size") >= LEAST_REVISIT).select(
        "page_id", "url", "digest", F.xxhash64("url").alias("url_hash"), F.lit(0).cast("long").alias("copy"), "size",
        nothing.cast("string").alias("record_type"), nothing.cast("long").alias("refers_to"), nothing.cast("string").alias("refers_url"), F.lit(1).alias("kind"), "payload",
    )
    ddl = "page_id bigint, url string, digest binary, url_hash bigint, copy bigint, size bigint, record_type string, refers_to bigint, refers_url string, kind int, payload binary, shard int"
    both = payloads.mapInArrow(placed, ddl).unionAll(records.mapInArrow(lambda batches: map(dealt, batches), ddl))
    order = [F.col("page_id").asc_nulls_last(), "digest", "url_hash", "url", "copy", "kind"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        attempt, out, waiting = f"{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}", None, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is not None and out.shard != row["shard"]:
                    out.close()
                    yield rows_of(out)
                    out = None
                out = out or ShardWriter(path, row["shard"], attempt, roll_bytes)
                key = row["page_id"], row["digest"], row["url"]
                if row["kind"] == 1:
                    if waiting and waiting[0] == key:
                        out.write(page_record(waiting[1], row["payload"]))
                        waiting = None
                    continue
                if waiting:
                    raise ValueError(f"page {waiting[0][0]}: its payload did not come")
                if row["record_type"] == "response" and row["size"] >= LEAST_REVISIT:
                    waiting = key, row
                else:
                    out.write(page_record(row, row["payload"]))
        if waiting:
            raise ValueError(f"page {waiting[0][0]}: its payload did not come")
        if out is not None:
            out.close()
            yield rows_of(out)

    def rows_of(out: ShardWriter) -> pa.RecordBatch:
        names, kinds = ["shard", "seq", "temporary", "name", "bytes", "records", "sha256"], [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out.closed, strict=True), kinds, strict=True)], names) if out.closed else pa.RecordBatch.from_pylist([], pa.schema(list(zip(names, kinds, strict=True))))

    both.repartitionById(shards, "shard").sortWithinPartitions("shard", *order).mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    written = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").agg(F.sum("records")).first()[0] or 0
    if written != n_records:
        raise ValueError(f"{written} records were written of {n_records} rows")
    commit(spark, path)
    return path


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, dealt out so that a task gets few files."""
    listed = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return listed.repartition(min(MOST_SHARDS, max(1, listed.count())))


def commit(spark: SparkSession, path: str) -> None:
    """Give the files of the manifest their names, those that don't have them yet, and drop
    what other attempts have left.  Doing it again does no harm."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(path)
        store.create_dir(f"{at}/archive")
        for batch in batches:
            for row in batch.to_pylist():
                old, new = f"{at}/temporary/{row['temporary']}", f"{at}/archive/{row['name']}"
                if store.get_file_info(new).type == files.FileType.NotFound:
                    try:
                        store.move(old, new)
                    except OSError:  # another attempt of this task may have moved it
                        if store.get_file_info(new).type == files.FileType.NotFound:
                            raise
            yield batch.select(["name"])

    manifest_of(spark, path).mapInArrow(rename, "name string").write.format("noop").mode("overwrite").save()
    left = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/temporary")
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)


def members(stream, block: int = 1 << 20) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, content, compressed bytes) of each gzip member of a stream, one at a time."""
    data, at = b"", 0
    while True:
        if not data:
            data = stream.read(block)
            if not data:
                return
        z, parts, raw = zlib.decompressobj(31), [], []
        while not z.eof:
            if not data:
                data = stream.read(block)
                if not data:
                    raise ValueError("a gzip member is cut off")
            parts.append(z.decompress(data))
            used = len(data) - len(z.unused_data)
            raw.append(data[:used])
            data = z.unused_data
        whole = b"".join(raw)
        yield at, b"".join(parts), whole
        at += len(whole)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-case name, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if not first.startswith("WARC/1.") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def page_of(fields: dict[str, str], block: bytes) -> tuple[dict, bytes | None]:
    """A page's row and payload (None for a revisit), the digests checked."""
    if fields["warc-block-digest"] != f"sha256:{sha256(block)}":
        raise ValueError(f"{fields['warc-record-id']}: the block is not that of its digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.lower() == b"content-length")
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or sha256(payload) != digest):
        raise ValueError(f"{fields['warc-record-id']}: the payload is not that of its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    row = {"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id"), "record_id": fields["warc-record-id"], "target_uri": fields["warc-target-uri"]}
    return row, payload if kind == "response" else None


def read_archives(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """What the committed archives hold, one row per record of a page: ``page_id`` (null as
    written), ``payload_bytes``, ``payload_digest`` (hex), ``record_type``, ``refers_to``,
    ``record_id``, ``target_uri``, ``file``, ``offset`` and, if asked for, ``payload`` (null for
    revisits).  Sizes and digests of files, blocks and payloads are checked; a file of the
    manifest that is missing or differs raises.  Only one record is held at a time."""
    ddl = RECORD + ", payload binary" * payloads
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    shape = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(path)
        for batch in batches:
            for listed in batch.to_pylist():
                whole, size, rows, held = hashlib.sha256(), 0, [], 0
                with store.open_input_stream(f"{at}/archive/{listed['name']}", compression=None) as stream:
                    for offset, data, raw in members(stream):
                        whole.update(raw)
                        size += len(raw)
                        fields, block = parse_record(data)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        row, payload = page_of(fields, block)
                        rows.append(row | {"file": listed["name"], "offset": offset} | ({"payload": payload} if payloads else {}))
                        held += len(payload or b"") if payloads else 0
                        if len(rows) >= 2000 or held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, shape)
                            rows, held = [], 0
                if (size, whole.hexdigest()) != (listed["bytes"], listed["sha256"]):
                    raise ValueError(f"{listed['name']} is not the file of the manifest")
                yield pa.RecordBatch.from_pylist(rows, shape)

    return manifest_of(spark, path).mapInArrow(read, ddl)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    return read_archives(pages.sparkSession, write_archives(pages, shared_path(pages.sparkSession, "warc")))
