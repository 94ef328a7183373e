"""Reading and publishing the measurement table, its log, its dimensions and reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from gaugeworks import schema as S
from gaugeworks.functions.numeric import with_cost
from gaugeworks.operators import guards


def load_measurements(spark: SparkSession, path: str) -> DataFrame:
    """The table from CSV (JSON in its nested columns) or from Parquet, in the frozen
    schema.  CSV is read with quoted line breaks and a broken line raises."""
    if path.rstrip("/").endswith(".csv"):
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
        return S.coerce(raw)
    return S.ordered(spark.read.parquet(path))


def to_csv_form(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON, edits as arrays of arrays, for a CSV mirror."""
    pairs = F.transform("edits", lambda e: F.array(e["op"], e["ref"], e["hyp"]))
    return S.ordered(rows).withColumn("word_confidences", F.to_json("word_confidences")).withColumn("edits", F.to_json(pairs, {"ignoreNullFields": "false"}))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, say_this, ground_truth); repeated ids raise."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("id string, say_this string, ground_truth string").csv(path)
    rows = rows.withColumn("id", F.trim("id")).where("id <> ''")
    return guards.require_unique_cells(rows, ("id",))


def load_task_specs(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, slots, critical) from one JSON object of clips; an empty table where the
    file is missing, so that what needs it can say so."""
    ddl = "map<string, struct<slots: map<string,string>, critical: array<string>>>"
    try:
        raw = spark.read.text(path, wholetext=True)
        raw.head(1)
    except Exception as e:  # noqa: BLE001 - only a missing file is taken as absence
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        return spark.createDataFrame([], "clip_id string, slots map<string,string>, critical array<string>")
    specs = raw.select(F.explode(F.from_json("value", ddl)).alias("clip_id", "s"))
    return specs.select("clip_id", "s.slots", "s.critical")


def append_log(rows: DataFrame, path: str, sequence: int) -> None:
    """Append rows to the cache as JSON lines with the number of the write, which decides
    what is latest: files have no order on a cluster."""
    rows.withColumn("sequence", F.lit(sequence).cast("long")).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, ddl: str, keys: tuple[str, ...] = S.CELL) -> tuple[DataFrame, DataFrame]:
    """(latest rows, census of read, torn and superseded lines) of an append-only log.
    Torn lines are counted and left out."""
    rows = spark.read.schema(f"{ddl}, sequence long, _torn string").option("columnNameOfCorruptRecord", "_torn").json(path)
    good = rows.where("_torn is null").drop("_torn")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sequence")))
    latest = good.withColumn("_place", place).where("_place = 1").drop("_place")
    torn = spark.read.text(path).agg(F.count("*").alias("n_lines"))
    census = torn.join(good.agg(F.count("*").alias("n_read"), F.count_distinct(*keys).alias("n_cells")))
    return latest, census.select("n_lines", "n_read", (F.col("n_lines") - F.col("n_read")).alias("n_torn"), (F.col("n_read") - F.col("n_cells")).alias("n_superseded"))


def plan_calls(clips: DataFrame, conditions: DataFrame, models: DataFrame, cache: DataFrame, retry: str = "auto") -> DataFrame:
    """The cells to run: all combinations of three small dimensions that the cache doesn't
    answer.  ``cache`` has the cell, ``failed`` and ``error``."""
    from gaugeworks.functions.text import is_cache_hit

    wanted = clips.select("clip_id").crossJoin(conditions.select("condition_name")).crossJoin(models.select("model"))
    return wanted.join(cache.where(is_cache_hit(F.col("failed"), F.col("error"), retry)), list(S.CELL), "left_anti")


def compose(plan: DataFrame, cache: DataFrame, prior_cells: DataFrame | None = None) -> DataFrame:
    """Rows of the plan, and of the prior table's cells outside it as the cache has them."""
    if prior_cells is None:
        return plan
    carried = cache.join(prior_cells.join(plan, list(S.CELL), "left_anti"), list(S.CELL), "left_semi")
    return plan.unionByName(carried.select(*plan.columns))


def publish(rows: DataFrame, path: str, *, allow_shrink: bool = False) -> str:
    """Write the table, partitioned by model, to a new version below ``path`` and return
    it.  Repeated cells raise, and so does a table that lost cells of the latest version.
    A pointer is written last, so readers never see half a table.  Of two publishers at a time
    that follow the same version, the one whose version's name is smaller wins, for all readers
    alike, and the other raises.  Rows are dealt by model and a large model is split, as one
    may hold most of them."""
    spark = rows.sparkSession
    rows = guards.require_unique_cells(S.ordered(rows))
    try:
        prior = latest_version(spark, path)
        seen = _versions(spark, path).agg(F.max("n")).first()[0]
    except S.MissingAssetError:
        prior, seen = None, -1
    if prior and not allow_shrink:
        guards.require_no_shrink(spark.read.parquet(prior), rows)
    version = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    rows.hint("rebalance", "model").write.partitionBy("model").parquet(version)
    n = seen + 1
    spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(version).alias("path")).coalesce(1).write.mode("append").json(f"{path}/versions")
    rival = _versions(spark, path).where((F.col("n") == n) & (F.col("path") < version)).first()
    if rival:
        raise S.MeasurementError(f"{rival.path} was published at the same time and stands; {version} doesn't")
    return version


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n long, path string").json(f"{path}/versions")


def latest_version(spark: SparkSession, path: str) -> str:
    try:
        found = _versions(spark, path).orderBy(F.desc("n"), "path").first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    if not found:
        raise S.MissingAssetError(f"no version below {path}")
    return found.path


def write_dead_zones(ranked: DataFrame, path: str) -> None:
    """The ranked table as CSV, columns fixed."""
    columns = ["model", "rank", "condition_name", "rt60", "snr_db", "noise_type", "codec", "mic_rolloff", "n_clips", "n_spoke", "wer_spoke", "mean_conf", "conf_pct", "gap"]
    ranked.select(*columns).repartition(1).sortWithinPartitions("model", "rank").write.mode("overwrite").option("header", True).csv(path)


def _finite(column: Column, kind: DataType) -> Column:
    """The column with NaN and infinities as null, also inside arrays, structs and maps."""
    if kind.typeName() in ("double", "float"):
        return S.clean_double(column)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(column, lambda _, v: _finite(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(column.isNotNull(), F.struct(*[_finite(column[f.name], f.dataType).alias(f.name) for f in kind]))
    return column


def strict_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row; NaN and infinities become null, at any depth."""
    return rows.select(F.to_json(F.struct(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema]), {"ignoreNullFields": "false"}).alias("value"))


def report_payload(**tables: DataFrame) -> str:
    """Small result tables (at most a few thousand rows each) as one JSON document with
    stable keys."""
    out = {}
    for name, df in sorted(tables.items()):
        rows = strict_json(df).limit(10_001).collect()
        if len(rows) > 10_000:
            raise S.MeasurementError(f"{name} is too large for a report")
        out[name] = [json.loads(r.value) for r in rows]
    return json.dumps(out, sort_keys=True, allow_nan=False)


def asset_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def synthetic(spark: SparkSession, clips: int, models: list[str], *, failed_one_in: int = 0) -> DataFrame:
    """A table with planted truth, in the frozen schema: deletions follow reverberation
    only, insertions babble only, confidence the signal-to-noise ratio only; so loud but
    reverberant conditions are the planted dead zones."""
    level = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    x = spark.range(clips).select(F.format_string("c%03d", "id").alias("clip_id"), F.col("id"))
    for name, values in (("rt60", [0.2, 0.4, 0.6, 0.8, 1.0]), ("snr_db", [0.0, 5.0, 10.0, 15.0, 20.0]), ("noise_type", ["babble", "engine", "road"]), ("model", models)):
        x = x.select("*", level(name, values))
    x = x.withColumn("codec", F.lit("none")).withColumn("mic_rolloff", F.lit(0.0)).withColumn("n_ref", F.lit(40))
    x = x.withColumn("n_del", F.floor((F.col("rt60") - 0.2) * 25).cast("int")).withColumn("n_ins", F.when(F.col("noise_type") == "babble", 4).otherwise(0)).withColumn("n_sub", F.when(F.col("noise_type") == "road", 2).otherwise(1))
    x = x.withColumn("n_match", F.col("n_ref") - F.col("n_del") - F.col("n_sub")).withColumn("mean_conf", 0.5 + F.col("snr_db") / 50)
    from gaugeworks.functions.numeric import condition_name

    bad = (F.pmod(F.xxhash64("clip_id", "rt60", "snr_db", "noise_type", "model"), F.lit(max(failed_one_in, 1))) == 0) & F.lit(failed_one_in > 0)
    x = x.withColumn("condition_name", condition_name()).withColumn("failed", bad)
    value = {"transcript": F.lit("words"), "wer": (F.col("n_sub") + F.col("n_del") + F.col("n_ins")) / F.col("n_ref"), "utterance_conf": F.col("mean_conf"), "word_confidences": F.array(*[F.col("mean_conf")] * 3), "error": F.lit(None)}
    fields = spark.createDataFrame([], S.MEASUREMENT_DDL).schema
    out = []
    for f in fields:
        c = value.get(f.name, F.col(f.name) if f.name in x.columns else F.lit(None))
        if f.name in ("transcript", "wer", "n_ref", "n_sub", "n_del", "n_ins", "n_match", "mean_conf", "utterance_conf", "word_confidences"):
            c = F.when(~F.col("failed"), c)
        if f.name == "error":
            c = F.when(F.col("failed"), "timeout")
        out.append(c.cast(f.dataType).alias(f.name))
    return x.select(*out)


def fixed_width(rows: DataFrame, most: int = 10_000) -> str:
    """A small table as text, columns padded to their widest value; more than ``most`` rows
    raise.  NULL is a dash."""
    got = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in rows.columns]).limit(most + 1).collect()
    if len(got) > most:
        raise S.MeasurementError("the table is too large for a report")
    lines = [rows.columns, *[list(r) for r in got]]
    width = [max(len(x[k]) for x in lines) for k in range(len(rows.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(x, width, strict=True)).rstrip() for x in lines) + "\n"


def write_artifact(spark: SparkSession, path: str, **tables: DataFrame) -> None:
    """The tables as siblings ``path``.json (one document with stable keys) and ``path``.txt
    (fixed width), one part file each, on any file system that Spark writes to."""
    text = "\n".join(f"{name}\n{fixed_width(df)}" for name, df in sorted(tables.items()))
    for suffix, body in (("json", report_payload(**tables)), ("txt", text)):
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.{suffix}")


def provenance(calls: DataFrame, rates: DataFrame, assets: DataFrame, commit: str) -> dict[str, DataFrame]:
    """Where a result came from: ``calls`` (label, model, minutes, failed) counted and priced
    by label and model, and the ``asset_hashes`` of its inputs, both with the commit."""
    by = calls.groupBy("label", "model").agg(F.count("*").alias("n_calls"), F.count_if("failed").alias("n_failed"), F.sum("minutes").alias("minutes"))
    stamp = F.lit(commit).alias("commit")
    return {"calls": with_cost(by, rates).select("*", stamp), "assets": assets.select("*", stamp)}


def indices_json(indices: DataFrame) -> str:
    """A small table of indices as JSON that ``indices_from_json`` reads back."""
    return json.dumps({"ddl": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in indices.schema), "rows": json.loads(report_payload(rows=indices))["rows"]}, sort_keys=True)


def indices_from_json(spark: SparkSession, body: str) -> DataFrame:
    got = json.loads(body)
    rows = spark.createDataFrame([(json.dumps(r),) for r in got["rows"]], "value string")
    return rows.select(F.from_json("value", got["ddl"]).alias("r")).select("r.*")
