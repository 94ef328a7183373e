"""Append-only logs of JSON lines whose order is the order of their lines, not a number that
a writer has to give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks import schema as S

#: Where a line stands: its file's time and name, the start of the part of the file that a task
#: reads, and the line's number in that task.  A file's parts are in order of their starts and a
#: task reads a part from its front, so the order is exact within a file of any size.
PLACE = ("written", "file", "part_start", "line")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(written, file, part_start, line, text) of each line that isn't blank, from any store
    that Spark reads; large files are read in parts.  Files of one time go by name."""
    m = F.col("_metadata")
    raw = spark.read.text(path).select(m["file_modification_time"].alias("written"), m["file_path"].alias("file"), m["file_block_start"].alias("part_start"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    return raw.where("trim(text) <> ''")


def read_ordered_log(spark: SparkSession, path: str, ddl: str, keys: tuple[str, ...] = S.CELL) -> tuple[DataFrame, DataFrame]:
    """(latest rows, census) of a log: the last line of a cell wins.

    A torn line (no JSON of the schema, or a cell with a missing key) is counted and left out.
    The latest row is kept by an aggregate that combines before it shuffles, so a cell written a
    million times is no hot group.  Census: lines, rows read, torn and superseded ones.  No
    lines give no rows and zeros.
    """
    wanted = [f.name for f in spark.createDataFrame([], ddl).schema]
    lines = placed_lines(spark, path)
    # FAILFAST would stop at the crash that a log survives: torn lines come back in their own column
    parsed = lines.withColumn("r", F.from_json("text", f"{ddl}, _torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}))
    sound = F.col("r._torn").isNull() & F.col("r").isNotNull()
    for k in keys:
        sound = sound & F.col(f"r.`{k}`").isNotNull()
    rows = parsed.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = rows.where("sound").select(F.struct(*[F.col(f"r.`{c}`").alias(c) for c in wanted]).alias("r"), F.struct(*PLACE).alias("at"))
    latest = good.groupBy(*[F.col(f"r.`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)]).agg(F.max_by("r", "at").alias("r"))
    counts = rows.agg(F.count("*").alias("n_lines"), F.count_if("sound").alias("n_read"))  # a row each
    census = counts.join(latest.agg(F.count("*").alias("n_cells")))
    return latest.select("r.*"), census.select("n_lines", "n_read", (F.col("n_lines") - F.col("n_read")).alias("n_torn"), (F.col("n_read") - F.col("n_cells")).alias("n_superseded"))
