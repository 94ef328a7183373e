import json

import pytest
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.operators import estimands, taxonomy
from gaugeworks.sources import adapters, tables


def test_csv_round_trip_and_drift(spark, tmp_path):
    rows = tables.synthetic(spark, 2, ["m"], failed_one_in=7)
    path = str(tmp_path / "t.csv")
    tables.to_csv_form(rows).write.option("header", True).option("escape", '"').csv(path)
    back = tables.load_measurements(spark, path)
    assert back.columns == S.COLUMNS and back.schema.simpleString() == rows.schema.simpleString()
    assert back.where("failed").count() == rows.where("failed").count() > 0
    key = lambda df: sorted((r.clip_id, r.condition_name, r.wer, r.mean_conf, r.word_confidences) for r in df.where("not failed").collect())
    assert key(back) == key(rows)
    with pytest.raises(S.SchemaDriftError):
        S.coerce(rows.drop("wer"))
    with pytest.raises(S.SchemaDriftError):
        S.ordered(rows.withColumn("x", F.lit(1)))


def test_tolerant_casts(spark):
    df = spark.createDataFrame([(x,) for x in ("1.5", "", "nan", "None", "inf", " 2 ", "x", None)], "t string")
    got = df.select(S.as_double(F.col("t")).alias("d"), S.as_int(F.col("t")).alias("i"), S.as_bool(F.col("t")).alias("b")).collect()
    assert [r.d for r in got] == [1.5, None, None, None, None, 2.0, None, None] and [r.i for r in got] == [1, 0, 0, 0, 0, 2, 0, 0]
    yes = spark.createDataFrame([(x,) for x in ("True", "t", "YES", "1", "no", None)], "t string").select(S.as_bool(F.col("t")).alias("b")).collect()
    assert [r.b for r in yes] == [True, True, True, True, False, False]


def test_log_is_latest_wins_and_counts_torn_lines(spark, tmp_path):
    path, ddl = str(tmp_path / "log"), "clip_id string, condition_name string, model string, wer double"
    tables.append_log(spark.createDataFrame([("a", "c", "m", 0.5), ("b", "c", "m", 0.1)], ddl), path, 1)
    tables.append_log(spark.createDataFrame([("a", "c", "m", 0.25)], ddl), path, 2)
    (tmp_path / "log" / "part-torn.json").write_text('{"clip_id": "a", "wer": 0.\n')
    rows, census = tables.read_log(spark, path, ddl)
    assert sorted((r.clip_id, r.wer) for r in rows.collect()) == [("a", 0.25), ("b", 0.1)]
    assert tuple(census.first()) == (4, 3, 1, 1)


def test_plan_compose_and_publish(spark, tmp_path):
    one = lambda n, *v: spark.createDataFrame([(x,) for x in v], f"{n} string")
    cache = spark.createDataFrame([("a", "c", "m", False, None), ("b", "c", "m", True, "timeout")], "clip_id string, condition_name string, model string, failed boolean, error string")
    plan = tables.plan_calls(one("clip_id", "a", "b"), one("condition_name", "c", "d"), one("model", "m"), cache)
    assert sorted(tuple(r) for r in plan.collect()) == [("a", "d", "m"), ("b", "c", "m"), ("b", "d", "m")]
    merged = tables.compose(cache.where("clip_id = 'a'"), cache, cache.select(*S.CELL))
    assert merged.count() == 2
    rows, path = tables.synthetic(spark, 2, ["m", "n"]), str(tmp_path / "pub")
    first = tables.publish(rows, path)
    assert tables.latest_version(spark, path) == first and tables.load_measurements(spark, first).count() == rows.count()
    with pytest.raises(S.MeasurementError):
        tables.publish(rows.where("clip_id = 'c000'"), path)
    with pytest.raises(S.DuplicateCellError):
        tables.publish(rows.unionAll(rows.limit(1)), path)
    second = tables.publish(rows.where("clip_id = 'c000'"), path, allow_shrink=True)
    assert tables.latest_version(spark, path) == second
    with pytest.raises(S.MissingAssetError):
        tables.latest_version(spark, str(tmp_path / "none"))


def test_of_two_publishers_one_stands(spark, tmp_path, monkeypatch):
    rows, path = tables.synthetic(spark, 1, ["m"]), str(tmp_path / "pub")
    first = tables.publish(rows, path)
    claim = lambda name: spark.createDataFrame([(1, f"{path}/{name}")], "n long, path string").coalesce(1).write.mode("append").json(f"{path}/versions")
    require = tables.guards.require_no_shrink

    def meanwhile(prior, new):  # another publisher's pointer lands after the prior version was read
        claim(rival)
        return require(prior, new)

    monkeypatch.setattr(tables.guards, "require_no_shrink", meanwhile)
    rival = "v-0"
    with pytest.raises(S.MeasurementError, match="same time"):
        tables.publish(rows, path)
    assert tables.latest_version(spark, path) == f"{path}/v-0" != first
    path = str(tmp_path / "other")
    tables.publish(rows, path)
    rival = "v-z"
    stands = tables.publish(rows, path)
    assert tables.latest_version(spark, path) == stands


def test_dimensions_hashes_and_reports(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,say_this,ground_truth\nu1,"Hi, you",hi you\n')
    assert tables.load_manifest(spark, str(tmp_path / "m.csv")).collect() == [("u1", "Hi, you", "hi you")]
    (tmp_path / "m.csv").write_text("id,say_this,ground_truth\nu1,a,a\nu1,b,b\n")
    with pytest.raises(S.DuplicateCellError):
        tables.load_manifest(spark, str(tmp_path / "m.csv"))
    (tmp_path / "s.json").write_text(json.dumps({"u1": {"slots": {"a": "x"}, "critical": ["a"]}}))
    assert tables.load_task_specs(spark, str(tmp_path / "s.json")).collect() == [("u1", {"a": "x"}, ["a"])]
    assert tables.load_task_specs(spark, str(tmp_path / "none.json")).collect() == []
    assert tables.asset_hashes(spark, str(tmp_path)).where("length(sha256) = 64").count() == 2
    df = spark.createDataFrame([(float("nan"), 1)], "x double, y int")
    assert json.loads(tables.report_payload(t=df)) == {"t": [{"x": None, "y": 1}]}
    ranked = taxonomy.dead_zones(estimands.condition_table(tables.synthetic(spark, 2, ["m"])))
    tables.write_dead_zones(ranked, str(tmp_path / "dz"))
    assert spark.read.option("header", True).csv(str(tmp_path / "dz")).count() == ranked.count()


def parsed(spark, form, *wires):
    return adapters.parse(spark.createDataFrame([(json.dumps(w),) for w in wires], "wire string"), form).drop("wire").collect()


def test_adapters_share_one_contract(spark):
    a = parsed(spark, "channel_alternatives", {"results": {"channels": [{"alternatives": [{"transcript": "a b", "confidence": 0.9, "words": [{"confidence": 0.5}, {"confidence": 0.7}]}]}]}})[0]
    assert tuple(a) == ("a b", [0.5, 0.7], pytest.approx(0.6), 0.9)
    b = parsed(spark, "decoder_segments", {"text": " x ", "segments": [{"avg_logprob": 0.0, "words": [{"probability": 0.5}]}]}, {"text": "y", "segments": [{"avg_logprob": -1.0}]}, {"text": ""})
    assert tuple(b[0]) == ("x", [0.5], 0.5, 1.0) and b[1].word_confidences == [] and b[1].mean_conf == pytest.approx(0.3679, abs=1e-4) and b[2].mean_conf is None
    c = parsed(spark, "word_results", {"text": "q", "result": [{"conf": 1.0}]}, {"text": ""})
    assert tuple(c[0]) == ("q", [1.0], 1.0, 1.0) and c[1].mean_conf is None and c[1].word_confidences == []
    d = parsed(spark, "typed_tokens", {"text": "a b", "words": [{"type": "word", "logprob": -0.1}, {"type": "spacing", "logprob": -9}, {"type": "word", "logprob": None}]})[0]
    assert d.word_confidences == pytest.approx([0.904837], abs=1e-5)
    for bad in ({"type": "noise", "logprob": -1}, {"type": "word", "logprob": 0.2}):
        with pytest.raises(Exception, match="type|log probability"):
            parsed(spark, "typed_tokens", {"text": "a", "words": [bad]})
    with pytest.raises(KeyError):
        parsed(spark, "unknown", {})


def test_failed_calls_become_rows(spark):
    def recognize(path):
        if path == "bad":
            raise OSError("socket")
        return '{"text": "x"}'

    got = {r.path: (r.failed, r.error) for r in adapters.transcribe(spark.createDataFrame([("a",), ("bad",)], "path string"), recognize).collect()}
    assert got == {"a": (False, None), "bad": (True, "OSError: socket")}


def test_strict_json_at_any_depth(spark):
    bad = float("nan")
    df = spark.createDataFrame([(1.0, [1.5, bad, None], (bad, [(float("inf"), "x")]), {"k": bad}), (bad, None, None, None)], "a double, b array<double>, c struct<d:double,e:array<struct<f:float,g:string>>>, m map<string,double>")
    first, second = [json.loads(r.value) for r in tables.strict_json(df).collect()]
    assert first == {"a": 1.0, "b": [1.5, None, None], "c": {"d": None, "e": [{"f": None, "g": "x"}]}, "m": {"k": None}}
    assert second == {"a": None, "b": None, "c": None, "m": None}
