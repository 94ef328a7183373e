"""Registered queries over the driver's tables, with their DuckDB SQL side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.functions import numeric, signal, text
from gaugeworks.operators import calibration, compare, edits, estimands, gate, profiles, ranking, resampling, rooms, seeds, sensitivity, sweeps, taxonomy, turns
from gaugeworks.plans import views
from gaugeworks.plans.views import C_SQL, G_SQL, LOG_SQL, M_SQL, SPACE, measured_log, measurements, read
from gaugeworks.session import persist

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r9(*columns: str) -> list:
    """Sums in another order differ in the last digits: nine decimals are compared."""
    return [F.round(c, 9).alias(c) for c in columns]


def conditions(spark: SparkSession, d: str) -> DataFrame:
    """The condition table, written once: what is made of it passes over it several times."""
    return persist(estimands.condition_table(measurements(spark, d)), "conditions")


def kept(rows: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the measurements, written once for several passes."""
    return persist(rows.select(*columns), "rows")


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return estimands.add_gap_metrics(conditions(spark, d))


# ------------------------------------------------------------ measurements and guards


@query(f"WITH {M_SQL} SELECT clip_id, condition_name, model, failed, transcript, round(wer, 9) AS wer, round(mean_conf, 9) AS mean_conf FROM m")
def dedup_latest(spark, d):
    """The last row of each cell of an append-only log."""
    return measurements(spark, d).select("clip_id", "condition_name", "model", "failed", "transcript", *r9("wer", "mean_conf"))


@query(f"WITH {LOG_SQL} SELECT clip_id, condition_name, model, count(*) AS n FROM log GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_cells(spark, d):
    """Cells that the log holds more than once."""
    from gaugeworks.operators.guards import duplicate_cells

    return duplicate_cells(measured_log(spark, d))


@query(f"WITH {LOG_SQL}, n AS (SELECT clip_id, condition_name, model, count(*) AS n FROM log GROUP BY 1, 2, 3) SELECT model, sum(n)::BIGINT AS n_rows, count(*) AS n_cells, sum(n - 1)::BIGINT AS n_superseded FROM n GROUP BY 1")
def log_census(spark, d):
    """Rows, cells and superseded rows of the log by model."""
    n = measured_log(spark, d).groupBy(*S.CELL).agg(F.count("*").alias("n"))
    return n.groupBy("model").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_cells"), F.sum(F.col("n") - 1).alias("n_superseded"))


@query(f"""WITH {M_SQL}, b AS (SELECT model, condition_name, count(*) AS n, count(*) FILTER (failed) AS bad FROM m GROUP BY 1, 2)
SELECT model, sum(n)::BIGINT AS n_rows, sum(bad)::BIGINT AS n_failed, count(*) FILTER (bad > 0) AS n_conditions_hit, count(*) FILTER (bad = n) AS n_fully_failed, round(sum(bad)::DOUBLE / sum(n), 9) AS failed_frac FROM b GROUP BY 1""")
def failure_summary(spark, d):
    return estimands.failure_summary(measurements(spark, d)).select("model", "n_rows", "n_failed", "n_conditions_hit", "n_fully_failed", *r9("failed_frac"))


@query(f"""WITH {M_SQL}, b AS (SELECT model, condition_name, count(*) AS n, count(*) FILTER (n_ref - n_del + n_ins <= 0) AS silent, count(mean_conf) AS spoke FROM m WHERE NOT failed GROUP BY 1, 2)
SELECT model, sum(n)::BIGINT AS n_rows, sum(silent)::BIGINT AS n_silent, count(*) FILTER (silent > 0) AS n_conditions_hit, count(*) FILTER (silent = n) AS n_fully_silent, count(*) FILTER (spoke = 0) AS n_mute, round(sum(silent)::DOUBLE / sum(n), 9) AS silent_frac FROM b GROUP BY 1""")
def silence_summary(spark, d):
    return estimands.silence_summary(measurements(spark, d)).select("model", "n_rows", "n_silent", "n_conditions_hit", "n_fully_silent", "n_mute", *r9("silent_frac"))


_C = ["model", "condition_name", "n_clips", "n_failed_excluded", "n_ref_total", "n_silent", "n_conf_without_words", "n_spoke", "codec"]
_CR = ["wer", "wer_micro", "mean_conf", "wer_spoke", "wer_micro_spoke", "silent_frac", "rt60", "snr_db", "mic_rolloff"]


@query(f"WITH {C_SQL} SELECT {', '.join(_C)}, {', '.join(f'round({x}, 9) AS {x}' for x in _CR)} FROM c")
def condition_table(spark, d):
    return conditions(spark, d).select(*_C, *r9(*_CR))


_G = ["conf_pct", "acc_pct", "acc_pct_all_clips", "gap", "gap_all_clips"]


@query(f"WITH {G_SQL} SELECT model, condition_name, {', '.join(f'round({x}, 9) AS {x}' for x in _G)}, round(gap_all_clips - gap, 9) AS gap_inflation, round(CASE WHEN mean_conf IS NOT NULL THEN conf_pct - acc_pct END, 9) AS gap_pct FROM g")
def gap_metrics(spark, d):
    return gaps(spark, d).select("model", "condition_name", *r9(*_G, "gap_inflation", "gap_pct"))


@query(f"""WITH {G_SQL} SELECT model, count(gap) AS n, round(avg(gap), 9) AS mean, round(coalesce(stddev_samp(gap), 0), 9) AS sd, round(min(gap), 9) AS low, round(quantile_cont(gap, 0.25), 9) AS p25, round(quantile_cont(gap, 0.5), 9) AS median,
round(quantile_cont(gap, 0.9), 9) AS p90, round(max(gap), 9) AS high, round(avg((gap > 0)::INT), 9) AS frac_positive FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def gap_summary(spark, d):
    q = {"low": 0.0, "p25": 0.25, "median": 0.5, "p90": 0.9, "high": 1.0}
    return estimands.distribution(gaps(spark, d), ["model"], "gap", q).select("model", "n", *r9("mean", "sd", *q, "frac_positive"))


_R_SQL = G_SQL + """,
r0 AS (
  SELECT t.*, 'rt60' AS factor, least(floor((rt60 - 0.2) / 0.2 + 1e-12), 3)::INT::VARCHAR AS region FROM t
  UNION ALL SELECT t.*, 'snr_db', least(floor(snr_db / 5.0 + 1e-12), 3)::INT::VARCHAR FROM t
  UNION ALL SELECT t.*, 'codec', codec FROM t
  UNION ALL SELECT t.*, 'mic_rolloff', least(floor(mic_rolloff / 0.25 + 1e-12), 3)::INT::VARCHAR FROM t),
r AS (SELECT * FROM r0 WHERE factor IN (SELECT factor FROM r0 GROUP BY 1 HAVING count(DISTINCT region) > 1))"""


@query(f"""WITH {_R_SQL} SELECT model, factor, region, count(*) AS n_conditions, sum(n_clips)::BIGINT AS n_clips, round(avg(gap), 9) AS mean_gap, round(avg(wer), 9) AS mean_wer, round(avg(wer_spoke), 9) AS mean_wer_spoke,
round(avg(silent_frac), 9) AS mean_silent_frac, round(avg(mean_conf), 9) AS mean_conf, round(avg((category = 'dead_zone')::INT), 9) AS dead_zone_rate, count(*) FILTER (category = 'mute_zone') AS n_mute FROM r GROUP BY 1, 2, 3""")
def gap_by_region(spark, d):
    """Gap, error and dead-zone rate by factor region; flags are computed on the whole arm."""
    x = estimands.with_region(taxonomy.classify(gaps(spark, d)), SPACE)
    return x.groupBy("model", "factor", "region").agg(
        F.count("*").alias("n_conditions"), F.sum("n_clips").alias("n_clips"), *[F.round(F.avg(c), 9).alias(n) for c, n in (("gap", "mean_gap"), ("wer", "mean_wer"), ("wer_spoke", "mean_wer_spoke"), ("silent_frac", "mean_silent_frac"), ("mean_conf", "mean_conf"))],
        F.round(F.avg((F.col("category") == "dead_zone").cast("int")), 9).alias("dead_zone_rate"), F.count_if(F.col("category") == "mute_zone").alias("n_mute"),
    )


# ------------------------------------------------------------------------- taxonomy


@query(f"WITH {G_SQL} SELECT model, condition_name, category FROM t")
def taxonomy_categories(spark, d):
    return taxonomy.classify(gaps(spark, d)).select("model", "condition_name", "category")


@query(f"WITH {G_SQL} SELECT model, condition_name, row_number() OVER (PARTITION BY model ORDER BY gap DESC NULLS LAST, condition_name) AS rank, round(gap, 9) AS gap, round(wer_spoke, 9) AS wer_spoke, round(mean_conf, 9) AS mean_conf, round(conf_pct, 9) AS conf_pct FROM t WHERE category = 'dead_zone'")
def dead_zones(spark, d):
    """The headline: confidently wrong conditions, ranked."""
    return taxonomy.dead_zones(gaps(spark, d)).select("model", "condition_name", F.col("rank").cast("long"), *r9("gap", "wer_spoke", "mean_conf", "conf_pct"))


@query(f"WITH {G_SQL} SELECT model, round(min(mean_conf) FILTER (conf_pct >= 0.6), 9) AS raw_conf FROM g GROUP BY 1")
def raw_conf_threshold(spark, d):
    return taxonomy.raw_conf_threshold(gaps(spark, d)).select("model", *r9("raw_conf"))


_S_SQL = G_SQL + """,
s AS (SELECT model, condition_name, w / 100.0::DOUBLE AS wer_hi, p / 100.0::DOUBLE AS conf_pct_hi, coalesce(mean_conf IS NOT NULL AND wer_spoke >= w / 100.0::DOUBLE AND conf_pct >= p / 100.0::DOUBLE, false) AS flagged
  FROM g, range(10, 51, 5) AS a(w), range(30, 91, 10) AS b(p))"""


@query(f"WITH {_S_SQL} SELECT model, wer_hi, conf_pct_hi, count(*) FILTER (flagged) AS n_dead_zones FROM s GROUP BY 1, 2, 3")
def threshold_sweep(spark, d):
    return taxonomy.grid_counts(gaps(spark, d))


@query(f"WITH {_S_SQL} SELECT model, condition_name, round(avg(flagged::INT), 9) AS persistence, count(*) FILTER (flagged) AS n_points FROM s GROUP BY 1, 2 HAVING count(*) FILTER (flagged) > 0")
def threshold_persistence(spark, d):
    return taxonomy.grid_persistence(gaps(spark, d)).select("model", "condition_name", *r9("persistence"), "n_points")


@query(f"""WITH {_S_SQL}, n AS (SELECT model, wer_hi, conf_pct_hi, count(*) FILTER (flagged) AS n FROM s GROUP BY 1, 2, 3), x AS (SELECT model, min(n) AS low, max(n) AS high, (max(n) + 1) / (min(n) + 1)::DOUBLE AS fold FROM n GROUP BY 1)
SELECT model, low, high, round(fold, 9) AS fold, CASE WHEN fold <= 2 THEN 'stable' WHEN fold >= 4 THEN 'fragile' ELSE 'moderate' END AS verdict FROM x""")
def sweep_verdict(spark, d):
    return taxonomy.sweep_verdict(taxonomy.grid_counts(gaps(spark, d))).select("model", "low", "high", *r9("fold"), "verdict")


# --------------------------------------------------------------------- correlations

_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0"


def _rho(source: str, keys: str, x: str, y: str) -> str:
    return f"(SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 9) END AS rho FROM (SELECT {keys}, {_RANK.format(k=keys, x=x)} AS a, {_RANK.format(k=keys, x=y)} AS b FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys})"


@query(f"""WITH {G_SQL}, s AS {_rho("g", "model", "conf_pct", "wer_spoke").replace("conf_pct IS NOT NULL", "mean_conf IS NOT NULL")}
SELECT model, n, rho, CASE WHEN rho <= -0.3 THEN 'tracks' WHEN rho >= 0.2 THEN 'inverted' WHEN rho >= -0.05 THEN 'blind' ELSE 'weak' END AS verdict FROM s""")
def overall_correlation(spark, d):
    """Spearman between confidence and error of the clips that spoke, with a verdict."""
    out = ranking.spearman(gaps(spark, d).where("mean_conf is not null"), ["model"], "conf_pct", "wer_spoke")
    verdict = F.when(F.col("rho") <= -0.3, "tracks").when(F.col("rho") >= 0.2, "inverted").when(F.col("rho") >= -0.05, "blind").otherwise("weak")
    return out.select("model", "n", *r9("rho"), verdict.alias("verdict"))


@query(f"WITH {_R_SQL}, v AS (SELECT * FROM r WHERE mean_conf IS NOT NULL) SELECT * FROM {_rho('v', 'model, factor, region', 'conf_pct', 'wer_spoke')}")
def region_tracking(spark, d):
    """Where in the factor space confidence follows error."""
    x = estimands.with_region(taxonomy.classify(gaps(spark, d)), SPACE).where("mean_conf is not null")
    return ranking.spearman(x, ["model", "factor", "region"], "conf_pct", "wer_spoke").select("model", "factor", "region", "n", *r9("rho"))


@query(f"""WITH {C_SQL}, p AS (SELECT a.condition_name AS k, a.wer AS x, b.wer AS y FROM c a JOIN c b USING (condition_name) WHERE a.model = 'arm_a' AND b.model = 'arm_n'),
q AS (SELECT sign(a.x - b.x) AS u, sign(a.y - b.y) AS v FROM p a JOIN p b ON a.k < b.k) SELECT round(sum(u * v) / sqrt(sum(abs(u)) * sum(abs(v))), 9) AS tau FROM q""")
def kendall_tau(spark, d):
    """Rank agreement of two arms over conditions."""
    c = conditions(spark, d).select("model", "condition_name", "wer")
    p = c.where("model = 'arm_a'").select("condition_name", F.col("wer").alias("x")).join(c.where("model = 'arm_n'").select("condition_name", F.col("wer").alias("y")), "condition_name")
    return ranking.kendall(p, "x", "y", "condition_name").select(*r9("tau"))


# ------------------------------------------------------------------ comparing models

_I_SQL = M_SQL + """,
cell AS (SELECT clip_id, condition_name, count(DISTINCT model) AS k FROM m WHERE NOT failed GROUP BY 1, 2),
i AS (SELECT m.* FROM m JOIN cell USING (clip_id, condition_name) WHERE k = 3 AND NOT failed)"""


@query(f"WITH {_I_SQL} SELECT k AS n_models, count(*) AS n_cells, count(DISTINCT clip_id) AS n_clips FROM cell GROUP BY 1")
def intersection_census(spark, d):
    return compare.intersection_census(measurements(spark, d))


@query(f"WITH {_I_SQL} SELECT model, count(*) AS n_cells, count(DISTINCT clip_id) AS n_clips, round(avg(wer), 9) AS wer, round(avg(mean_conf), 9) AS mean_conf, round(stddev_pop(wer), 9) AS wer_sd FROM i GROUP BY 1")
def matched_arms(spark, d):
    """Models on the cells that all of them ran."""
    m = kept(S.usable(measurements(spark, d)), "clip_id", "condition_name", "model", "failed", "transcript", "wer", "mean_conf")
    return compare.arm_intersection(m).groupBy("model").agg(F.count("*").alias("n_cells"), F.count_distinct("clip_id").alias("n_clips"), F.round(F.avg("wer"), 9).alias("wer"), F.round(F.avg("mean_conf"), 9).alias("mean_conf"), F.round(F.stddev_pop("wer"), 9).alias("wer_sd"))


@query(f"""WITH {_R_SQL}, a AS (SELECT factor, region, model, avg(wer) AS wer FROM r GROUP BY 1, 2, 3)
SELECT factor, region, count(*) AS n_models, arg_max(model, row(wer, model)) AS worst, arg_min(model, row(wer, model)) AS best, round(max(wer) - min(wer), 9) AS wer_gap FROM a GROUP BY 1, 2""")
def divergence_regions(spark, d):
    """Where in the factor space the models differ most."""
    x = estimands.with_region(conditions(spark, d), SPACE).groupBy("factor", "region", "model").agg(F.avg("wer").alias("wer"), F.lit(1).alias("n"))
    return compare.divergence(x).select("factor", "region", "n_models", "worst", "best", *r9("wer_gap"))


@query(f"""WITH {G_SQL}, f AS (SELECT model, condition_name FROM t WHERE gap > 0), n AS (SELECT model, count(*) AS n FROM f GROUP BY 1), b AS (SELECT x.model AS a, y.model AS b, count(*) AS k FROM f x JOIN f y USING (condition_name) WHERE x.model < y.model GROUP BY 1, 2)
SELECT p.model AS a, q.model AS b, p.n AS n_a, q.n AS n_b, coalesce(k, 0) AS n_both, p.n + q.n - coalesce(k, 0) AS n_either, round(coalesce(k, 0) / (p.n + q.n - coalesce(k, 0))::DOUBLE, 9) AS jaccard FROM n p JOIN n q ON p.model < q.model LEFT JOIN b ON b.a = p.model AND b.b = q.model""")
def overconfident_overlap(spark, d):
    """Overlap of the models' overconfident conditions."""
    return compare.set_overlap(gaps(spark, d).where("gap > 0"), "model", "condition_name").select("a", "b", "n_a", "n_b", "n_both", "n_either", *r9("jaccard"))


@query(f"""WITH {G_SQL}, f AS (SELECT DISTINCT model, condition_name FROM t WHERE gap > 0), k AS (SELECT condition_name, count(*) AS k FROM f GROUP BY 1),
n AS (SELECT model, count(*) AS n, count(*) FILTER (k = 1) AS n_only, count(*) FILTER (k > 1) AS n_shared FROM f JOIN k USING (condition_name) GROUP BY 1)
SELECT n.*, a.n_all, a.n_any, round(a.n_all / a.n_any::DOUBLE, 9) AS jaccard FROM n, (SELECT count(*) FILTER (k = (SELECT count(DISTINCT model) FROM f)) AS n_all, count(*) AS n_any FROM k) a""")
def arm_overlap(spark, d):
    """The overconfident conditions of all models together: shared by all, by some, by none."""
    return compare.arm_overlap(gaps(spark, d).where("gap > 0"), "model", "condition_name").select("model", "n", "n_only", "n_shared", "n_all", "n_any", *r9("jaccard"))


@query(f"WITH {G_SQL}, f AS (SELECT DISTINCT model, condition_name FROM t WHERE gap > 0) SELECT min(model) AS model, condition_name FROM f GROUP BY condition_name HAVING count(*) = 1")
def only_in_one_arm(spark, d):
    """Conditions that one model alone is overconfident in."""
    return compare.only_in(gaps(spark, d).where("gap > 0"), "model", "condition_name")


@query(f"""WITH {G_SQL}, p AS (SELECT a.gap > 0 AS p, b.gap > 0 AS q FROM t a JOIN t b USING (condition_name) WHERE a.model = 'arm_a' AND b.model = 'arm_n' AND a.gap IS NOT NULL AND b.gap IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (p AND q) AS "both", count(*) FILTER (p) AS n_predicted, count(*) FILTER (q) AS n_actual, round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (p), 0)::DOUBLE, 9) AS "precision", round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (q), 0)::DOUBLE, 9) AS recall, round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (p OR q), 0)::DOUBLE, 9) AS jaccard FROM p""")
def run_agreement(spark, d):
    """Precision and recall of one run's flags against another's."""
    g = gaps(spark, d).where("gap is not null").select("model", "condition_name", (F.col("gap") > 0).alias("f"))
    p = g.where("model = 'arm_a'").select("condition_name", F.col("f").alias("p")).join(g.where("model = 'arm_n'").select("condition_name", F.col("f").alias("q")), "condition_name")
    return compare.agreement(p, "p", "q").select("n", "both", "n_predicted", "n_actual", *r9("precision", "recall", "jaccard"))


@query()
def nearest_assignment(spark, d):
    """One-to-one pairing of least total distance within a group."""
    a = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    b = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return compare.nearest_assignment(a, b, ["nation"], "v", "id", 500.0).select("nation", "a", "b", *r9("delta"), "status")


@query("""WITH w AS (SELECT DISTINCT p_size * 100.0::DOUBLE AS v FROM part), a AS (SELECT s_suppkey AS k, s_acctbal AS h FROM supplier) SELECT v, arg_min(k, row(abs(v - h), k)) AS asset, round(min(abs(v - h)), 9) AS distance FROM w, a GROUP BY 1""")
def closest_asset(spark, d):
    """For each wanted value the asset that comes nearest."""
    wanted = read(spark, d, "part").select((F.col("p_size") * F.lit(100.0)).alias("v")).distinct()
    assets = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return compare.closest(wanted, assets, "v", "k").select("v", "asset", *r9("distance"))


_PAIR = ("rt60-0.2_snr-20_babble_none_mic-0", "rt60-0.2_snr-0_babble_none_mic-0")


@query(f"WITH {M_SQL} SELECT a.model, clip_id, round(a.wer - b.wer, 9) AS difference FROM m a JOIN m b USING (model, clip_id) WHERE a.condition_name = '{_PAIR[0]}' AND b.condition_name = '{_PAIR[1]}' AND NOT a.failed AND NOT b.failed")
def paired_conditions(spark, d):
    return compare.paired_difference(measurements(spark, d), *_PAIR).select("model", "clip_id", *r9("difference"))


@query("""WITH k AS (SELECT DISTINCT l_suppkey % 3 AS a, l_linenumber % 3 AS b FROM lineitem), pl AS (SELECT n_nationkey AS clip, a, b FROM nation, k), done AS (SELECT DISTINCT s_nationkey AS clip, l_suppkey % 3 AS a, l_linenumber % 3 AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT pl.clip, count(*) AS n_cells, count(*) FILTER (done.clip IS NULL) AS n_missing FROM pl LEFT JOIN done ON pl.clip = done.clip AND pl.a = done.a AND pl.b = done.b GROUP BY 1""")
def call_plan(spark, d):
    """Clips crossed with conditions (two small dimensions), less what is already cached."""
    lines = read(spark, d, "lineitem", "l_suppkey", "l_linenumber").withColumn("a", F.col("l_suppkey") % 3).withColumn("b", F.col("l_linenumber") % 3)
    plan = read(spark, d, "nation").select(F.col("n_nationkey").alias("clip")).crossJoin(lines.select("a", "b").distinct())
    done = lines.join(read(spark, d, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("clip"), "a", "b", F.lit(True).alias("done")).distinct()
    return plan.join(done, ["clip", "a", "b"], "left").groupBy("clip").agg(F.count("*").alias("n_cells"), F.count_if(F.col("done").isNull()).alias("n_missing"))


# ------------------------------------------------------------------------ edit profile


@query(f"""WITH {M_SQL}, e AS (SELECT model, condition_name, count(*) AS n_clips, sum(n_ref)::BIGINT AS n_ref_total, sum(n_sub)::BIGINT AS s, sum(n_del)::BIGINT AS x, sum(n_ins)::BIGINT AS i FROM m WHERE NOT failed GROUP BY 1, 2)
SELECT model, condition_name, n_clips, n_ref_total, round(s::DOUBLE / n_ref_total, 9) AS rate_sub, round(x::DOUBLE / n_ref_total, 9) AS rate_del, round(i::DOUBLE / n_ref_total, 9) AS rate_ins, round(s::DOUBLE / nullif(s + x + i, 0), 9) AS share_sub, round(x::DOUBLE / nullif(s + x + i, 0), 9) AS share_del, round(i::DOUBLE / nullif(s + x + i, 0), 9) AS share_ins,
CASE WHEN s + x + i = 0 THEN NULL WHEN s = greatest(s, x, i) THEN 'sub' WHEN x = greatest(s, x, i) THEN 'del' ELSE 'ins' END AS dominant FROM e""")
def edit_composition(spark, d):
    out = edits.composition(measurements(spark, d), "model", "condition_name")
    return out.select("model", "condition_name", "n_clips", "n_ref_total", *r9(*[f"{k}_{e}" for k in ("rate", "share") for e in edits.EDITS]), "dominant")


_SIG = """SELECT '{c}' AS contrast, model, e.edit, count(*) FILTER (h) AS n_hard, count(*) FILTER (NOT h) AS n_mild, avg(r) FILTER (h) - avg(r) FILTER (NOT h) AS delta,
(avg(r) FILTER (h) - avg(r) FILTER (NOT h)) / nullif(sqrt(((count(*) FILTER (h) - 1) * var_samp(r) FILTER (h) + (count(*) FILTER (NOT h) - 1) * var_samp(r) FILTER (NOT h)) / (count(*) - 2)), 0) AS cohens_d
FROM (SELECT model, {h} AS h, 'sub' AS edit, n_sub / n_ref::DOUBLE AS r FROM m WHERE NOT failed AND ({h} OR {w}) UNION ALL SELECT model, {h}, 'del', n_del / n_ref::DOUBLE FROM m WHERE NOT failed AND ({h} OR {w}) UNION ALL SELECT model, {h}, 'ins', n_ins / n_ref::DOUBLE FROM m WHERE NOT failed AND ({h} OR {w})) e GROUP BY 1, 2, 3"""


@query(f"WITH {M_SQL}, x AS ({_SIG.format(c='rt60', h='rt60 = 0.7', w='rt60 = 0.2')} UNION ALL {_SIG.format(c='codec=g726', h=chr(39).join(('codec = ', 'g726', '')), w=chr(39).join(('codec = ', 'none', '')))}) SELECT contrast, model, edit, n_hard, n_mild, round(delta, 9) AS delta, round(cohens_d, 9) AS cohens_d FROM x")
def factor_signatures(spark, d):
    """What each factor does to each type of edit, with Cohen's d."""
    m = kept(S.usable(measurements(spark, d)), "model", "rt60", "codec", "failed", "transcript", "n_ref", "n_sub", "n_del", "n_ins")
    a = edits.contrasts(m, ["model"], F.col("rt60") == 0.7, F.col("rt60") == 0.2, "rt60")
    b = edits.contrasts(m, ["model"], F.col("codec") == "g726", F.col("codec") == "none", "codec=g726")
    return a.unionAll(b).select("contrast", "model", "edit", "n_hard", "n_mild", *r9("delta", "cohens_d"))


@query(f"WITH {M_SQL} SELECT model, count(*) AS n, round(avg(n_ins / n_ref::DOUBLE), 9) AS mean_ratio, round(max(n_ins / n_ref::DOUBLE), 9) AS most FROM m WHERE NOT failed AND n_ins >= 5 AND n_ins >= 1.5 * n_ref GROUP BY 1")
def hallucinations(spark, d):
    return edits.hallucinations(measurements(spark, d)).groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("ins_over_ref"), 9).alias("mean_ratio"), F.round(F.max("ins_over_ref"), 9).alias("most"))


@query(f"WITH {M_SQL} SELECT model, sum(n_ref)::BIGINT AS n_ref, sum(n_sub)::BIGINT AS n_sub, sum(n_del)::BIGINT AS n_del, sum(n_ins)::BIGINT AS n_ins, round(sum(n_del)::DOUBLE / sum(n_sub + n_del + n_ins), 9) AS blind_share, round(sum(n_sub + n_ins)::DOUBLE / sum(n_sub + n_del + n_ins), 9) AS visible_ceiling FROM m WHERE NOT failed GROUP BY 1")
def deletion_blindness(spark, d):
    return edits.deletion_blindness(measurements(spark, d), "model").select("model", "n_ref", "n_sub", "n_del", "n_ins", *r9("blind_share", "visible_ceiling"))


@query(f"""WITH {M_SQL}, a AS (SELECT model, condition_name, avg(wer) AS w FROM m WHERE NOT failed GROUP BY 1, 2) SELECT model, condition_name, arg_min(clip_id, row(round(abs(wer - w), 9), clip_id)) AS clip_id FROM m JOIN a USING (model, condition_name) WHERE NOT failed GROUP BY 1, 2""")
def exemplars(spark, d):
    """The clip of each condition whose error is nearest the condition's mean."""
    m = S.usable(measurements(spark, d))
    mean = m.groupBy("model", "condition_name").agg(F.avg("wer").alias("w"))
    return m.join(mean, ["model", "condition_name"]).groupBy("model", "condition_name").agg(F.min_by("clip_id", F.struct(F.round(F.abs(F.col("wer") - F.col("w")), 9), "clip_id")).alias("clip_id"))


@query(f"WITH {M_SQL} SELECT model, round(avg(wer) FILTER (codec = 'none'), 9) AS none, round(avg(wer) FILTER (codec = 'g726'), 9) AS g726 FROM m WHERE NOT failed GROUP BY 1")
def wer_pivot(spark, d):
    """Mean error by model and codec, as a table."""
    p = S.usable(measurements(spark, d)).groupBy("model").pivot("codec", ["none", "g726"]).agg(F.avg("wer"))
    return p.select("model", *r9("none", "g726"))


# ----------------------------------------------------------------------- calibration


@query(f"WITH {M_SQL} SELECT model, count(mean_conf) AS n, round(avg(mean_conf), 9) AS mean, round(stddev_samp(mean_conf), 9) AS sd, round(quantile_cont(mean_conf, 0.05), 9) AS p05, round(quantile_cont(mean_conf, 0.5), 9) AS median, round(quantile_cont(mean_conf, 0.95), 9) AS p95, round(avg((mean_conf > 0)::INT), 9) AS frac_positive FROM m WHERE mean_conf IS NOT NULL GROUP BY 1")
def confidence_distribution(spark, d):
    q = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    return estimands.distribution(measurements(spark, d), ["model"], "mean_conf", q).select("model", "n", *r9("mean", "sd", *q, "frac_positive"))


@query(f"WITH {M_SQL}, h AS (SELECT least(floor(mean_conf * 20), 19)::INT AS bin, count(*) AS n FROM m WHERE mean_conf IS NOT NULL GROUP BY 1) SELECT b::INT AS bin, coalesce(n, 0) AS n FROM range(20) r(b) LEFT JOIN h ON h.bin = b")
def confidence_histogram(spark, d):
    """Fixed bins over 0..1, empty ones kept."""
    h = measurements(spark, d).where("mean_conf is not null").groupBy(calibration.bin_of(F.col("mean_conf"), 20).alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(20).select(F.col("id").cast("int").alias("bin")).join(h, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {M_SQL} SELECT model, count(mean_conf) AS n, round(avg((mean_conf = 1)::INT), 9) AS share_one, round(avg((mean_conf = 0)::INT), 9) AS share_zero, round(avg((mean_conf >= 1 - 0.001::DOUBLE)::INT), 9) AS share_near_one, round(avg((mean_conf <= 0.001::DOUBLE)::INT), 9) AS share_near_zero, count(DISTINCT mean_conf) AS n_distinct FROM m WHERE mean_conf IS NOT NULL GROUP BY 1")
def confidence_saturation(spark, d):
    """How much of each model's confidence lies at its ends."""
    out = calibration.saturation(measurements(spark, d), "mean_conf", keys=("model",))
    return out.select("model", "n", *r9("share_one", "share_zero", "share_near_one", "share_near_zero"), "n_distinct")


@query(f"WITH {C_SQL}, s AS (SELECT model, count(mean_conf) AS n, min(mean_conf) AS low, median(mean_conf) AS median, max(mean_conf) AS high FROM c GROUP BY 1) SELECT model, n, round(low, 9) AS low, round(median, 9) AS median, round(high, 9) AS high, (SELECT max(low) <= min(high) FROM s) AS overlaps FROM s")
def confidence_scales(spark, d):
    """Spans of the models' raw confidence: why raw scales don't compare."""
    return calibration.scale_overlap(conditions(spark, d)).select("model", "n", *r9("low", "median", "high"), "overlaps")


@query(f"WITH {C_SQL} SELECT model, arg_max(condition_name, row(mean_conf, condition_name)) AS highest, arg_min(condition_name, row(mean_conf, condition_name)) AS lowest, round(max(mean_conf) - min(mean_conf), 9) AS span FROM c WHERE mean_conf IS NOT NULL GROUP BY 1")
def dynamic_range(spark, d):
    c = conditions(spark, d).where("mean_conf is not null")
    at = F.struct("mean_conf", "condition_name")
    return c.groupBy("model").agg(F.max_by("condition_name", at).alias("highest"), F.min_by("condition_name", at).alias("lowest"), F.round(F.max("mean_conf") - F.min("mean_conf"), 9).alias("span"))


_REL = f"WITH {M_SQL}, b AS (SELECT model, least(floor(mean_conf * 15), 14)::INT AS bin, count(*) AS n, avg(mean_conf) AS c, avg((wer < 0.3)::INT) AS a FROM m WHERE mean_conf IS NOT NULL GROUP BY 1, 2)"


@query(f"{_REL} SELECT model, bin, n, round(c, 9) AS mean_conf, round(a, 9) AS accuracy FROM b")
def reliability_curve(spark, d):
    m = measurements(spark, d).withColumn("good", F.col("wer") < S.WER_HI)
    return calibration.reliability(m.withColumn("good", F.col("good").cast("int")), ["model"], "mean_conf", "good").select("model", "bin", "n", *r9("mean_conf", "accuracy"))


@query(f"{_REL} SELECT model, sum(n)::BIGINT AS n, round(sum(n * abs(a - c)) / sum(n), 9) AS ece FROM b GROUP BY 1")
def calibration_error(spark, d):
    m = measurements(spark, d).withColumn("good", (F.col("wer") < S.WER_HI).cast("int"))
    return calibration.expected_calibration_error(calibration.reliability(m, ["model"], "mean_conf", "good"), ["model"]).select("model", "n", *r9("ece"))


_LAB = "x AS (SELECT d.doc_id, n_chars::DOUBLE AS s, quality, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def labelled(spark, d):
    return read(spark, d, "documents", "doc_id", "n_chars", "lang").join(read(spark, d, "labels", "doc_id", "quality"), "doc_id").withColumn("s", F.col("n_chars").cast("double"))


@query(f"""WITH {_LAB}, k AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS r FROM x)
SELECT lang, sum(quality)::BIGINT AS n_good, sum(1 - quality)::BIGINT AS n_bad, round((sum(r * quality) - sum(quality) * (sum(quality) + 1) / 2.0) / nullif(sum(quality) * sum(1 - quality), 0), 9) AS auroc FROM k GROUP BY 1""")
def auroc(spark, d):
    """Separation of good and bad documents by length, with average ranks."""
    return ranking.auroc(labelled(spark, d), ["lang"], "s", F.col("quality") == 1).select("lang", "n_good", "n_bad", *r9("auroc"))


@query(f"""WITH {_LAB}, t AS (SELECT unnest([0.1, 0.25, 0.5]::DOUBLE[]) AS flag_rate, unnest(quantile_cont(s, [0.1, 0.25, 0.5])) AS threshold FROM x)
SELECT flag_rate, round(threshold, 9) AS threshold, count(*) FILTER (s <= threshold) AS n_flagged, count(*) FILTER (s <= threshold AND quality = 0) AS n_caught, count(*) FILTER (quality = 0) AS n_bad,
round(count(*) FILTER (s <= threshold AND quality = 0) / count(*) FILTER (s <= threshold)::DOUBLE, 9) AS "precision", round(count(*) FILTER (s <= threshold AND quality = 0) / count(*) FILTER (quality = 0)::DOUBLE, 9) AS recall FROM x, t GROUP BY 1, 2, t.threshold""")
def operating_points(spark, d):
    out = calibration.operating_points(labelled(spark, d), "s", F.col("quality") == 0, [0.1, 0.25, 0.5])
    return out.select("flag_rate", *r9("threshold"), "n_flagged", "n_caught", "n_bad", *r9("precision", "recall"))


@query()
def temperature(spark, d):
    """The temperature that calibrates each model's confidence best."""
    m = measurements(spark, d).withColumn("good", (F.col("wer") < S.WER_HI).cast("int"))
    return calibration.temperatures(calibration.confidence_counts(m, ["model"], "mean_conf", "good"), ["model"], "mean_conf").select("model", F.round("temperature", 6).alias("temperature"))


@query()
def calibration_seeds(spark, d):
    """Held-out calibration errors of all models under several splits by clips, as bands."""
    m = measurements(spark, d).where("not failed and mean_conf is not null").withColumn("good", (F.col("wer") < S.WER_HI).cast("int"))
    m = kept(m, "clip_id", "model", "mean_conf", "good", "rt60", "snr_db", "mic_rolloff")
    found = seeds.calibration_seeds(m, "mean_conf", "good", ["rt60", "snr_db", "mic_rolloff"], discount_at={"rt60": 0.7, "mic_rolloff": 0.5})
    bands = seeds.seed_bands(found, ["ece_raw", "ece_temperature", "ece_feature", "temperature", "discount_rt60", "discount_mic_rolloff"])
    return bands.select("model", "statistic", "n_seeds", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")])


@query()
def feature_calibration(spark, d):
    """Each model's confidence recalibrated with condition features, on its held-out conditions."""
    m = measurements(spark, d).where("mean_conf is not null").withColumn("good", (F.col("wer") < S.WER_HI).cast("int"))
    m = kept(m, "condition_name", "model", "mean_conf", "good", "rt60", "snr_db", "mic_rolloff")
    found = seeds.calibration_seeds(m, "mean_conf", "good", ["rt60", "snr_db", "mic_rolloff"], group="condition_name", seeds=(1,), share=0.7, by_temperature=False)
    return found.select("model", F.col("ece_raw").alias("ece_before"), F.col("ece_feature").alias("ece_after"))


@query()
def bootstrap_wer(spark, d):
    """Mean error with a percentile interval over resampled clips."""
    return resampling.bootstrap_mean(S.usable(measurements(spark, d)), "clip_id", "wer")


# ----------------------------------------------------------------------- sensitivity

_FACTORS = ["rt60", "snr_db", "codec", "mic_rolloff"]
#: Whether more of a factor is harsher; codecs in the order of their names.
_HARSHER = {"rt60": True, "snr_db": False, "codec": False, "mic_rolloff": True}


def cells(spark, d):
    return sensitivity.cell_means(S.usable(measurements(spark, d)).where("model = 'arm_a'"), _FACTORS, "wer")


def _anova_sql() -> str:
    """Terms by inclusion and exclusion over the variances of marginal means."""
    from itertools import combinations

    parts = []
    name = lambda s: "v_" + "_".join(s)
    subsets = [s for n in range(1, 5) for s in combinations(_FACTORS, n)]
    ctes = [f"{name(s)} AS (SELECT var_pop(y) AS v FROM (SELECT avg(y) AS y FROM k GROUP BY {', '.join(s)}))" for s in subsets]
    for s in subsets:
        inner = [t for n in range(1, len(s) + 1) for t in combinations(s, n)]
        value = " + ".join(f"{(-1) ** (len(s) - len(t))} * (SELECT v FROM {name(t)})" for t in inner)
        parts.append(f"SELECT '{':'.join(s)}' AS term, {len(s)} AS \"order\", {value} AS v")
    return f"WITH {M_SQL}, k AS (SELECT rt60, snr_db, codec, mic_rolloff, avg(wer) AS y FROM m WHERE NOT failed AND model = 'arm_a' GROUP BY 1, 2, 3, 4), {', '.join(ctes)}, terms AS ({' UNION ALL '.join(parts)})"


@query(_anova_sql() + ' SELECT term, "order", round(v, 9) AS variance FROM terms')
def anova_terms(spark, d):
    """Exact decomposition of the variance over all subsets of factors."""
    return sensitivity.anova_terms(cells(spark, d), _FACTORS).select("term", "order", *r9("variance"))


@query(_anova_sql() + ", f AS (SELECT unnest(['rt60', 'snr_db', 'codec', 'mic_rolloff']) AS factor) SELECT factor, round(sum(v) FILTER (term = factor) / sum(v), 9) AS s1, round(sum(v) FILTER (list_contains(string_split(term, ':'), factor)) / sum(v), 9) AS st, round((sum(v) FILTER (list_contains(string_split(term, ':'), factor)) - sum(v) FILTER (term = factor)) / sum(v), 9) AS gap FROM terms, f GROUP BY 1")
def sobol_indices(spark, d):
    return sensitivity.sobol(sensitivity.anova_terms(cells(spark, d), _FACTORS), _FACTORS).select("factor", *r9("s1", "st", "gap"))


@query(_anova_sql() + ' SELECT "order", round(sum(v) / (SELECT sum(v) FROM terms), 9) AS share FROM terms GROUP BY 1')
def share_by_order(spark, d):
    return sensitivity.share_by_order(sensitivity.anova_terms(cells(spark, d), _FACTORS)).select("order", *r9("share"))


_K = f"WITH {M_SQL}, k AS (SELECT rt60, snr_db, codec, mic_rolloff, avg(wer) AS y FROM m WHERE NOT failed AND model = 'arm_a' GROUP BY 1, 2, 3, 4)"


@query(f"""{_K}, e AS (SELECT 'rt60' AS factor, (SELECT avg(y) FROM k WHERE rt60 = 0.7) - (SELECT avg(y) FROM k WHERE rt60 = 0.2) AS effect UNION ALL SELECT 'snr_db', (SELECT avg(y) FROM k WHERE snr_db = 0) - (SELECT avg(y) FROM k WHERE snr_db = 20) UNION ALL SELECT 'mic_rolloff', (SELECT avg(y) FROM k WHERE mic_rolloff = 0.5) - (SELECT avg(y) FROM k WHERE mic_rolloff = 0))
SELECT factor, round(effect, 9) AS effect, row_number() OVER (ORDER BY abs(effect) DESC, factor) AS rank FROM e""")
def main_effects(spark, d):
    return sensitivity.main_effects(cells(spark, d), {"rt60": True, "snr_db": False, "mic_rolloff": True}).select("factor", *r9("effect"), F.col("rank").cast("long"))


@query(f"{_K}, w AS (SELECT *, lag(y) OVER p AS a, lead(y) OVER p AS b FROM k WINDOW p AS (PARTITION BY snr_db, codec, mic_rolloff ORDER BY rt60)) SELECT rt60, snr_db, codec, mic_rolloff, 'rt60' AS axis, round(least(a, b) - y, 9) AS depth FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND least(a, b) - y > 0")
def interior_dips(spark, d):
    """Levels at which more reverberation gave less error."""
    return sensitivity.dips(cells(spark, d), _FACTORS, "rt60").select(*_FACTORS, "axis", *r9("depth"))


@query(f"""{_K}, e AS (SELECT mic_rolloff AS q, avg(y) FILTER (rt60 = 0.7) - avg(y) FILTER (rt60 = 0.2) AS e FROM k GROUP BY 1), x AS (SELECT arg_min(e, q) AS a, arg_max(e, q) AS b FROM e)
SELECT 'rt60' AS factor, 'mic_rolloff' AS moderator, round(a, 9) AS effect_first, round(b, 9) AS effect_last, a * b < 0 AND abs(a) > 0.02 AND abs(b) > 0.02 AS reverses FROM x""")
def effect_reversal(spark, d):
    return sensitivity.reversals(cells(spark, d), "rt60", "mic_rolloff").select("factor", "moderator", *r9("effect_first", "effect_last"), "reverses")


@query(f"""{_K}, c AS (SELECT codec, rt60 AS l, avg(y) AS y FROM k GROUP BY 1, 2), n AS (SELECT codec, l, coalesce((y - min(y) OVER p) / nullif(max(y) OVER p - min(y) OVER p, 0), 0) AS y FROM c WINDOW p AS (PARTITION BY codec)),
g AS (SELECT codec, l, y, lag(y) OVER q AS py, lag(l) OVER q AS pl FROM n WINDOW q AS (PARTITION BY codec ORDER BY l)), f AS (SELECT codec, min(l) AS l FROM g WHERE py IS NOT NULL AND y >= 0.5 GROUP BY 1)
SELECT m.codec, round(coalesce((SELECT CASE WHEN g.y = g.py THEN g.l ELSE g.pl + (0.5 - g.py) * (g.l - g.pl) / (g.y - g.py) END FROM g JOIN f ON g.codec = f.codec AND g.l = f.l WHERE g.codec = m.codec), m.l), 9) AS half_level FROM (SELECT codec, max(l) AS l FROM g GROUP BY 1) m""")
def half_levels(spark, d):
    """Where the error curve of each codec first passes one half of its range."""
    curve = cells(spark, d).groupBy("codec", "rt60").agg(F.avg("y").alias("y"))
    return sensitivity.half_level(curve, ["codec"], "rt60", "y").select("codec", *r9("half_level"))


@query(f"""WITH {C_SQL}, u AS (SELECT DISTINCT condition_name, rt60, snr_db, codec, mic_rolloff FROM c) SELECT condition_name, (dense_rank() OVER (ORDER BY rt60) + dense_rank() OVER (ORDER BY snr_db DESC) + dense_rank() OVER (ORDER BY mic_rolloff) - 3 + (codec <> 'none')::INT)::INT AS severity FROM u""")
def severity(spark, d):
    """Steps of each condition from the mildest corner."""
    u = conditions(spark, d).select("condition_name", "rt60", "snr_db", "codec", "mic_rolloff").distinct()
    return sensitivity.severity(u, {"rt60": True, "snr_db": False, "mic_rolloff": True}).select("condition_name", F.col("severity").cast("int"))


@query(_anova_sql() + """, p AS (SELECT string_split(term, ':') AS p, v / (SELECT sum(v) FROM terms) AS s2 FROM terms WHERE "order" = 2) SELECT p[1] AS a, p[2] AS b, round(s2, 9) AS s2, row_number() OVER (ORDER BY s2 DESC, p[1] || ':' || p[2]) AS rank FROM p""")
def second_order(spark, d):
    """Shares of the variance of pairs of factors."""
    return sensitivity.second_order(sensitivity.anova_terms(cells(spark, d), _FACTORS)).select("a", "b", *r9("s2"), F.col("rank").cast("long"))


def intervals(spark, d):
    return sensitivity.sobol_intervals(S.usable(measurements(spark, d)), _FACTORS, "clip_id", "wer", keys=("model",))


@query()
def sobol_intervals(spark, d):
    """Indices of every factor and pair with intervals over resampled clips."""
    return intervals(spark, d).select("model", "term", "kind", *r9("estimate", "low", "high"))


@query()
def effect_intervals(spark, d):
    """Main effects of every model with intervals over resampled clips, and which survive."""
    out = sensitivity.effect_intervals(S.usable(measurements(spark, d)), _HARSHER, "clip_id", "wer", keys=("model",))
    return out.select("model", "factor", *r9("effect", "low", "high"), "significant", "rank", "survives")


@query()
def preregistered_verdict(spark, d):
    """The sealed rule on the intervals of the gaps and the rank of the pair."""
    return sensitivity.preregistered(intervals(spark, d), ("rt60", "snr_db"), keys=("model",)).select("model", *r9("least_gap"), "gap_criterion", "pair_criterion", "power_limited", "verdict")


# ------------------------------------------------------------------------------ turns


def dialog_events(spark, d):
    """The event stream as dialogs: one session a user, hours as seconds."""
    e = read(spark, d, "events", "user_id", "event_type", "ts", "event_id")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    names = ["user_speech_start", "user_speech_end", "agent_endpoint", "agent_speech_start", "agent_speech_end"]
    kind = F.element_at(F.create_map(*[F.lit(x) for k, n in zip(kinds, names, strict=False) for x in (k, n)]), F.col("event_type"))
    return e.select(F.col("user_id").alias("session"), (F.unix_seconds(F.col("ts").cast("timestamp")) / 3600.0).alias("t"), kind.alias("type"))


@query()
def turn_findings(spark, d):
    """Faults in turn-taking, by kind."""
    return turns.finding_counts(turns.findings(dialog_events(spark, d)))


@query()
def turn_segments(spark, d):
    """Segments of speech paired from starts and ends."""
    s = turns.segments(dialog_events(spark, d), turns.USER)
    return s.groupBy("session").agg(F.count("*").alias("n"), F.round(F.sum(F.col("e") - F.col("s")), 6).alias("length"))


# ------------------------------------------------------------------------------- text

_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[''’ʼʻ`]', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH n AS (SELECT doc_id, {_NORM.format(x='text')} AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::INT AS n_tokens, md5(t) AS digest FROM n")
def normalized_tokens(spark, d):
    """Scoring tokens of every document."""
    t = read(spark, d, "documents", "doc_id", "text").select("doc_id", text.normalize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


_FOURS = "SELECT {k} t[j:j+3] AS p FROM (SELECT {k} t, unnest(range(1, len(t) - 2)) AS j FROM (SELECT {k} string_split({n}, ' ') AS t FROM {f}))"


@query(f"""WITH i AS (SELECT DISTINCT * FROM ({_FOURS.format(k="", n=_NORM.format(x="text"), f="benchmark")})), n AS (SELECT DISTINCT * FROM ({_FOURS.format(k="doc_id,", n=_NORM.format(x="text"), f="documents")})) SELECT doc_id, count(*) AS n_phrases FROM n JOIN i USING (p) GROUP BY 1""")
def phrase_hits(spark, d):
    """Documents that hold phrases of four words of the benchmark, and how many different ones."""
    t = text.normalize(F.col("text")).alias("t")
    docs = read(spark, d, "documents", "doc_id", "text").select("doc_id", t).select("doc_id", F.explode(text.phrases(F.col("t"), 4)).alias("p"))
    items = read(spark, d, "benchmark", "text").select(t).select(F.explode(text.phrases(F.col("t"), 4)).alias("p")).distinct()
    return docs.join(items, "p").groupBy("doc_id").agg(F.count_distinct("p").alias("n_phrases"))


def exchanges(spark, d):
    """Each turn with the one that answers it, all tokens of both."""
    c = read(spark, d, "conversations").select("conv_id", "turn", text.normalize(F.col("text")).alias("t"))
    c = c.withColumn("hyp", F.lead("t").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where("hyp is not null").select("conv_id", "turn", F.col("t").alias("ref"), "hyp")


@query()
def wer_by_normalization(spark, d):
    """Word errors between each turn and its answer, by the answer's role, under the strict
    rule and under the one that compares models."""
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text")
    over = Window.partitionBy("conv_id").orderBy("turn")
    x = c.select("text", F.lead("text").over(over).alias("answer"), F.lead("role").over(over).alias("role")).where("answer is not null")
    out = profiles.normalization_shift(x, "text", "answer", ["role"])
    return out.select("role", "n", *r9("wer_strict", "wer_normalized", "shift"), "n_cleared", "n_raised")


@query()
def word_alignment(spark, d):
    """Typed edits between each turn and its answer."""
    n = lambda op: F.size(F.filter("edits", lambda e: e["op"] == op))
    x = text.edit_lists(exchanges(spark, d), "ref", "hyp").withColumn("e", F.struct(n("match").alias("n_match"), n("sub").alias("n_sub"), n("del").alias("n_del"), n("ins").alias("n_ins")))
    return x.select("conv_id", "turn", F.size("ref").alias("n_ref"), "e.n_match", "e.n_sub", "e.n_del", "e.n_ins", F.round(text.wer(F.col("e"), F.size("ref")), 9).alias("wer"))


@query(r"""WITH w AS (SELECT unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[''’ʼʻ`]', '', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g')), ' ')) AS w FROM documents WHERE lang = 'en')
SELECT CASE WHEN length(w) = 1 AND regexp_full_match(w, '\p{L}') THEN CASE WHEN w IN ('a', 'i') THEN 'function_word' ELSE 'spelled_letter' END WHEN w IN ({D}) THEN 'digit_word' WHEN w IN ({F}) THEN 'function_word' ELSE 'content_word' END AS class, count(*) AS n FROM w WHERE w <> '' GROUP BY 1""".replace("{D}", ", ".join(f"'{w}'" for w in text.DIGIT_WORDS)).replace("{F}", ", ".join(f"'{w}'" for w in text.FUNCTION_WORDS)))
def word_classes(spark, d):
    """Classes of the words of English documents."""
    w = read(spark, d, "documents", "text", "lang").where("lang = 'en'").select(F.explode(text.normalize(F.col("text"))).alias("w"))
    return w.groupBy(text.word_class(F.col("w")).alias("class")).agg(F.count("*").alias("n"))


@query(r"SELECT page_id, len(regexp_extract_all(url, '(?i)example[._-]+(com|net)')) AS n_hits, length(regexp_replace(html, '(?i)example[\s_-]+com', '[redacted]', 'g'))::INT AS n_chars FROM pages")
def page_redaction(spark, d):
    """Banned terms in pages: hits in the address, length after redaction."""
    p = read(spark, d, "pages", "page_id", "url", "html")
    return p.select("page_id", F.size(F.regexp_extract_all("url", F.lit(r"(?i)example[._-]+(?:com|net)"), 0)).cast("long").alias("n_hits"), F.length(F.regexp_replace("html", r"(?i)example[\s_-]+com", "[redacted]")).alias("n_chars"))


@query("""SELECT CASE WHEN trim(lower(coalesce(p_name, ''))) = '' THEN 'unknown' ELSE 'other' END AS category, count(*) AS n FROM part GROUP BY 1""")
def failure_categories(spark, d):
    """Failures by the text of their errors, the first category that fits."""
    return read(spark, d, "part", "p_name").groupBy(text.failure_category(F.col("p_name")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, (('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 15))::BIGINT % 7)::INT AS choice FROM orders")
def stable_choices(spark, d):
    """A choice by hash that every engine repeats."""
    return read(spark, d, "orders", "o_orderkey").select("o_orderkey", numeric.stable_choice(F.col("o_orderkey").cast("string"), 7).alias("choice"))


@query(f"WITH {C_SQL} SELECT DISTINCT condition_name, rt60, snr_db, codec, mic_rolloff FROM c")
def parsed_conditions(spark, d):
    """Factors read back from the conditions' names."""
    c = conditions(spark, d).select("condition_name").distinct()
    return c.select("condition_name", numeric.parse_condition(F.col("condition_name")).alias("p")).select("condition_name", "p.rt60", "p.snr_db", "p.codec", "p.mic_rolloff")


@query("WITH c AS (SELECT o_orderpriority AS model, count(*) * 0.1::DOUBLE AS minutes FROM orders GROUP BY 1) SELECT model, round(minutes, 9) AS minutes, round(CASE WHEN model LIKE '1%' THEN minutes * 0.5 WHEN model LIKE '2%' THEN 0 END, 9)::DOUBLE AS cost_usd, CASE WHEN model LIKE '1%' THEN 'billed' WHEN model LIKE '2%' THEN 'local' ELSE 'unknown' END AS pricing_class FROM c")
def priced_calls(spark, d):
    """Cost by model; a model without a rate is unknown, not free."""
    calls = read(spark, d, "orders", "o_orderpriority").groupBy(F.col("o_orderpriority").alias("model")).agg((F.count("*") * F.lit(0.1)).alias("minutes"))
    rates = calls.select("model", F.when(F.col("model").startswith("1"), 0.5).when(F.col("model").startswith("2"), 0.0).alias("usd_per_minute")).where("usd_per_minute is not null")
    return numeric.with_cost(calls, rates).select("model", *r9("minutes", "cost_usd"), "pricing_class")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 64), 9) AS rms, round(len(list_filter(range(1, 64), lambda i: sign(embedding[i]) <> sign(embedding[i + 1]))) / 63.0, 9) AS zcr FROM embeddings")
def signal_levels(spark, d):
    """Level and zero crossings of short arrays, inside the JVM."""
    e = read(spark, d, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.round(signal.rms(F.col("embedding")), 9).alias("rms"), F.round(signal.zero_crossings(F.col("embedding")), 9).alias("zcr"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS e FROM embeddings), p AS (SELECT vec_id, e, list_position(e, list_max(e)) AS a FROM e), c AS (SELECT vec_id, e, a, a + 16 AS z FROM p)
SELECT vec_id, round(10 * log10((coalesce(list_sum(e[a : z - 1]), 0) + 1e-20::DOUBLE) / (coalesce(list_sum(e[z :]), 0) + 1e-20::DOUBLE)), 6) AS early_late_db FROM c""")
def early_late_energy(spark, d):
    """Energy of the first 25 ms after the largest sample against what follows, in dB."""
    e = read(spark, d, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.round(signal.energy_ratio_db(F.col("embedding"), 640, 25.0), 6).alias("early_late_db"))


@query()
def degraded_levels(spark, d):
    """Arrays with noise and through a microphone: level, active share, reverberation time."""
    e = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    bad = e.select("vec_id", "x", signal.degraded(F.col("x"), F.reverse("x"), F.lit(10.0), F.lit(0.5), 640).alias("y"))
    return bad.select("vec_id", *[F.round(c, 6).alias(n) for n, c in (("rms", signal.rms(F.col("y"))), ("zcr", signal.zero_crossings(F.col("y"))), ("active", signal.active_share(F.col("x"), 640)), ("rt60", signal.rt60_of(F.col("x"), 640)))])


@query()
def signal_frames(spark, d):
    """Spectral features of frames, by clip."""
    e = read(spark, d, "embeddings", "vec_id", "embedding")
    return signal.summaries(signal.frames_of(e, "vec_id", "embedding", 640), "vec_id")


# ------------------------------------------------------- words, windows, checks, sources


@query(f"WITH n AS (SELECT lang, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS a, {_NORM.format(x='text')} AS t FROM documents) SELECT lang, count(*) AS n, round(avg(a - CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END), 9) AS shift FROM n GROUP BY 1")
def normalization_shift(spark, d):
    """What normalization does to the number of tokens, by language."""
    t = read(spark, d, "documents", "lang", "text")
    raw = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(raw - F.size(text.normalize(F.col("text")))), 9).alias("shift"))


_X = rf"""x0 AS (SELECT conv_id, turn, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS t FROM (SELECT conv_id, turn, {_NORM.format(x='text')} AS t FROM conversations)),
x AS (SELECT * FROM (SELECT conv_id, turn, t AS ref, lead(t) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM x0) WHERE hyp IS NOT NULL)"""


@query(f"WITH {_X} SELECT conv_id, turn, len(hyp) AS n_words, len(list_filter(hyp, lambda w: NOT list_contains(ref, w))) AS n_foreign FROM x")
def foreign_words(spark, d):
    """Words of each answer that its turn lacks; repeats count."""
    x = exchanges(spark, d)
    return x.select("conv_id", "turn", F.size("hyp").cast("long").alias("n_words"), F.size(F.filter("hyp", lambda w: ~F.array_contains(F.col("ref"), w))).cast("long").alias("n_foreign"))


def exchange_edits(spark, d):
    x = text.edit_lists(exchanges(spark, d).withColumn("clip_id", F.concat_ws("-", "conv_id", "turn")), "ref", "hyp")
    return x


@query()
def word_inventory(spark, d):
    """Destroyed words, their chances and their commonest confusions."""
    x = exchange_edits(spark, d)
    chances = x.select(F.explode("ref").alias("word")).groupBy("word").agg(F.count("*").alias("n_chances"))
    return edits.word_inventory(x.select(F.explode("edits").alias("e")).select("e.*"), chances)


@query()
def insertion_origins(spark, d):
    """Inserted words by conversation and in all, foreign or from the turn itself."""
    x = exchange_edits(spark, d)
    own = x.select("clip_id", F.explode("ref").alias("word"))
    return edits.insertions(x.select("clip_id", "conv_id", F.explode("edits").alias("e")).select("clip_id", "conv_id", "e.op", "e.hyp"), own, ["conv_id"])


@query("SELECT vec_id, round(list_aggregate(embedding::DOUBLE[], 'avg'), 6) AS mean, round(list_aggregate(embedding::DOUBLE[], 'quantile_cont', 0.5), 9) AS median, round(list_aggregate(embedding::DOUBLE[], 'quantile_cont', 0.1), 9) AS p10, list_aggregate(embedding::DOUBLE[], 'min') AS min, list_aggregate(embedding::DOUBLE[], 'max') AS max FROM embeddings")
def array_aggregates(spark, d):
    """Aggregates of an array column, quantiles by linear interpolation."""
    e = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    x = calibration.row_aggregates("a")
    return e.select("vec_id", F.round(x["mean"], 6).alias("mean"), F.round(x["median"], 9).alias("median"), F.round(x["p10"], 9).alias("p10"), x["min"].alias("min"), x["max"].alias("max"))


@query("WITH m AS (SELECT lang, median(n_chars) AS med FROM documents GROUP BY 1) SELECT doc_id, round(n_chars / med, 9) AS ratio FROM documents JOIN m USING (lang) WHERE n_chars > 4 * med OR n_chars < med / 4")
def corpus_gate(spark, d):
    """Documents whose length is far from their language's median."""
    x = read(spark, d, "documents", "doc_id", "lang", "n_chars")
    med = x.groupBy("lang").agg(F.median("n_chars").alias("med"))
    return x.join(med, "lang").where((F.col("n_chars") > 4 * F.col("med")) | (F.col("n_chars") < F.col("med") / 4)).select("doc_id", F.round(F.col("n_chars") / F.col("med"), 9).alias("ratio"))


@query(f"WITH {C_SQL}, q AS (SELECT quantile_cont(snr_db, 1 / 3.0::DOUBLE) AS a, quantile_cont(snr_db, 2 / 3.0::DOUBLE) AS b FROM c) SELECT model, round(avg(wer) FILTER (snr_db <= a), 9) AS low, round(avg(wer) FILTER (snr_db >= b), 9) AS high, count(*) FILTER (snr_db <= a OR snr_db >= b) AS n FROM c, q GROUP BY 1")
def tercile_contrast(spark, d):
    """Mean error in the lower and the upper third of a continuous factor."""
    c = conditions(spark, d)
    low, high = edits.terciles(c, "snr_db")
    return c.groupBy("model").agg(F.round(F.avg(F.when(low, F.col("wer"))), 9).alias("low"), F.round(F.avg(F.when(high, F.col("wer"))), 9).alias("high"), F.count_if(low | high).alias("n"))


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_best(spark, d):
    """The least value so far, by user."""
    return read(spark, d, "events", "event_id", "user_id", "ts", "value").select("event_id", F.min("value").over(by_user().rowsBetween(Window.unboundedPreceding, 0)).alias("best"))


@query("WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id, min(k) FILTER (value <= 5) AS n_to_target FROM n GROUP BY 1")
def first_reaching(spark, d):
    """How many events it takes each user to reach a target; NULL if never."""
    n = read(spark, d, "events", "event_id", "user_id", "ts", "value").withColumn("k", F.row_number().over(by_user()).cast("long"))
    return n.groupBy("user_id").agg(F.min(F.when(F.col("value") <= 5, F.col("k"))).alias("n_to_target"))


@query("WITH s AS (SELECT user_id, ts, event_id, sign(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS s FROM events), f AS (SELECT user_id, s <> lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM s WHERE s <> 0) SELECT user_id, count(*) FILTER (f) AS n_sign_flips FROM f GROUP BY 1")
def direction_changes(spark, d):
    """How often each user's values change direction."""
    e = read(spark, d, "events", "event_id", "user_id", "ts", "value").withColumn("at", F.struct("ts", "event_id"))
    return sensitivity.monotonicity(e, ["user_id"], "at", "value")


@query("SELECT p_partkey FROM part ANTI JOIN lineitem ON p_partkey = l_partkey")
def missing_references(spark, d):
    """Dimension rows that no fact refers to."""
    return read(spark, d, "part", "p_partkey").join(read(spark, d, "lineitem", "l_partkey").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "left_anti")


@query("SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_linenumber % 2 = 1 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 0")
def lost_cells(spark, d):
    """Cells of a prior table that a new one lacks: what the shrink guard refuses."""
    x = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_linenumber").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), (F.col("l_linenumber") % 2).alias("k"))
    return x.where("k = 1").select("p", "s").distinct().join(x.where("k = 0").select("p", "s"), ["p", "s"], "left_anti")


@query(f"WITH {M_SQL} SELECT model, count(*) FILTER (NOT failed AND mean_conf IS NOT NULL) AS n_spoke, count(*) FILTER (NOT failed AND n_ref - n_del + n_ins <= 0) AS n_silent, count(*) FILTER (NOT failed AND (mean_conf IS NULL) <> (n_ref - n_del + n_ins <= 0)) AS n_disagree FROM m GROUP BY 1")
def spoke_census(spark, d):
    """Rows that spoke and rows that were silent, and where the two notions differ."""
    m = S.usable(measurements(spark, d))
    return m.groupBy("model").agg(F.count_if(S.spoke()).alias("n_spoke"), F.count_if(S.is_silent()).alias("n_silent"), F.count_if(S.spoke() == S.is_silent()).alias("n_disagree"))


@query(f"""WITH {M_SQL}, v AS (SELECT model, CASE k WHEN 0 THEN 'mean_conf' ELSE 'n_words' END AS score_name, CASE k WHEN 0 THEN mean_conf ELSE (n_ref - n_del + n_ins)::DOUBLE END AS s, (wer < 0.3)::INT AS good FROM m, range(2) r(k) WHERE NOT failed AND mean_conf IS NOT NULL),
a AS (SELECT model, score_name, good, rank() OVER (PARTITION BY model, score_name ORDER BY s) + (count(*) OVER (PARTITION BY model, score_name, s) - 1) / 2.0 AS r FROM v)
SELECT model, score_name, sum(good)::BIGINT AS n_good, sum(1 - good)::BIGINT AS n_bad, round((sum(r * good) - sum(good) * (sum(good) + 1) / 2.0) / nullif(sum(good) * sum(1 - good), 0), 9) AS auroc FROM a GROUP BY 1, 2""")
def separation(spark, d):
    """How well each aggregate of confidence tells good rows from bad, and a control."""
    m = S.usable(measurements(spark, d)).where("mean_conf is not null").withColumn("n_words", S.n_hyp().cast("double"))
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("score_name"), F.col(n).alias("s")) for n in ("mean_conf", "n_words")]))
    x = m.select("model", "wer", parts.alias("p")).select("model", "wer", "p.*")
    return ranking.auroc(x, ["model", "score_name"], "s", F.col("wer") < S.WER_HI).select("model", "score_name", "n_good", "n_bad", *r9("auroc"))


@query()
def separation_intervals(spark, d):
    """Areas of the confidence and of its control with intervals over resampled clips, and
    whether their paired difference leaves out zero."""
    m = S.usable(measurements(spark, d)).where("mean_conf is not null").withColumn("n_words", S.n_hyp().cast("double"))
    out = resampling.separation_intervals(m, ["model"], ["mean_conf", "n_words"], F.col("wer") < S.WER_HI, "clip_id", "mean_conf")
    return out.select("model", "score_name", "n_good", "n_bad", *r9("auroc", "low", "high", "delta", "delta_low", "delta_high"), "beats", "loses", "rank")


@query(f"WITH {G_SQL} SELECT model, count(*) FILTER (mean_conf IS NOT NULL AND wer_spoke >= 0.3 AND conf_pct >= 0.6) AS n_macro, count(*) FILTER (mean_conf IS NOT NULL AND wer_micro_spoke >= 0.3 AND conf_pct >= 0.6) AS n_micro FROM g GROUP BY 1")
def estimand_probe(spark, d):
    """Dead zones under two estimands of the same error."""
    g = gaps(spark, d)
    return g.groupBy("model").agg(F.count_if(taxonomy.flag("wer_spoke")).alias("n_macro"), F.count_if(taxonomy.flag("wer_micro_spoke")).alias("n_micro"))


@query(r"""WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}_]+', ' ', 'g')) AS t, trim(regexp_replace(lower(p_brand), '[^\p{L}\p{N}_]+', ' ', 'g')) AS b, string_split(trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}_]+', ' ', 'g')), ' ')[1] AS w FROM part)
SELECT p_partkey, 2 AS n_slots, (1 + contains(' ' || t || ' ', ' ' || b || ' ')::INT)::INT AS n_hit, NOT contains(' ' || t || ' ', ' ' || b || ' ') AS critical_failure FROM p""")
def task_results(spark, d):
    """Entities that must survive in a transcript, by slot."""
    p = read(spark, d, "part", "p_partkey", "p_name", "p_brand")
    slots = F.create_map(F.lit("name"), text.normalize(F.col("p_name"))[0], F.lit("brand"), F.col("p_brand"))
    x = p.select("p_partkey", text.task_result(F.col("p_name"), slots, F.array(F.lit("brand"))).alias("r"))
    return x.select("p_partkey", "r.n_slots", "r.n_hit", "r.critical_failure")


@query("SELECT l_linenumber, round(avg(ln(p / (1 - p))), 9) AS mean_logit, count(*) AS n FROM (SELECT l_linenumber, least(greatest(l_discount * 10, 0.000001), 0.999999) AS p FROM lineitem) GROUP BY 1")
def mean_logits(spark, d):
    """Clipped logits, averaged."""
    x = read(spark, d, "lineitem", "l_linenumber", "l_discount")
    return x.groupBy("l_linenumber").agg(F.round(F.avg(numeric.logit(F.col("l_discount") * 10)), 9).alias("mean_logit"), F.count("*").alias("n"))


@query("SELECT s_suppkey, ['none', 'g726', 'opus-lowrate'][least(greatest(floor(s_acctbal / 3000), 0), 2)::INT + 1] AS level FROM supplier")
def decoded_levels(spark, d):
    """Levels of sampled numbers, held within the list."""
    return read(spark, d, "supplier", "s_suppkey", "s_acctbal").select("s_suppkey", numeric.decode_level(F.col("s_acctbal") / 3000, ["none", "g726", "opus-lowrate"]).alias("level"))


@query("SELECT o_orderkey, o_orderstatus AS transcript, round((o_orderkey % 10 / 10.0 + 0.5) / 2, 9) AS mean_conf FROM orders")
def parsed_answers(spark, d):
    """Recognizer answers in JSON read to the common contract."""
    from gaugeworks.sources import adapters

    o = read(spark, d, "orders", "o_orderkey", "o_orderstatus")
    wire = F.format_string('{"text": "%s", "result": [{"word": "a", "conf": %.1f}, {"word": "b", "conf": 0.5}]}', "o_orderstatus", (F.col("o_orderkey") % 10) / 10)
    return adapters.parse(o.withColumn("wire", wire), "word_results").select("o_orderkey", "transcript", *r9("mean_conf"))


@query()
def active_curves(spark, d):
    """Learning curves of a planted failure contour: median best error by arm."""
    from gaugeworks.operators import active

    oracle = lambda p: float(1 / (1 + 2.718281828 ** (-8 * (p[0] + 0.5 * p[1] - 0.7))))
    c = active.curves(spark, oracle, 2, [1, 2, 3])
    return active.seed_band(active.best_so_far(c)).select("arm", "n_evals", *r9("median", "low", "high"), "n_seeds")


# ------------------------------------------------------- rooms, grids, predictions

_ROOMED = M_SQL + """,
w AS (SELECT *, 'rooms/' || CASE WHEN n_ref % 3 = 0 THEN 'sim_' ELSE 'room_' END || rt60 || '.wav' AS rir_key, rt60 + 0.01::DOUBLE AS rir_rt60_measured FROM m)"""


def roomed(spark, d):
    """Measurements with the room that delivered each; failed ones have none."""
    kind = F.when(F.col("n_ref") % 3 == 0, "sim_").otherwise("room_")
    m = measurements(spark, d).withColumn("rir_key", F.when(F.col("n_ref").isNotNull(), F.concat(F.lit("rooms/"), kind, F.col("rt60").cast("string"), F.lit(".wav"))))
    return m.withColumn("rir_rt60_measured", F.col("rt60") + 0.01)


@query(f"WITH {_ROOMED} SELECT model, rir_key, round(max(rir_rt60_measured), 9) AS rt60_measured, round(min(rt60), 9) AS rt60_requested, round(avg(wer), 9) AS marginal_wer, count(wer) AS n_rows FROM w WHERE n_ref IS NOT NULL GROUP BY 1, 2")
def delivered_rooms(spark, d):
    """Mean error by the room that was delivered."""
    r = rooms.delivered_rooms(roomed(spark, d))
    return r.select("model", "rir_key", *r9("rt60_measured"), F.round(F.element_at("rt60_requested", 1), 9).alias("rt60_requested"), *r9("marginal_wer"), "n_rows")


@query(f"WITH {_ROOMED} SELECT model, rir_key LIKE '%/sim_%' AS simulated, count(*) AS n, round(avg(wer), 9) AS wer FROM w WHERE n_ref IS NOT NULL GROUP BY 1, 2")
def simulated_rows(spark, d):
    """Measured and simulated rows, told apart by the room's key."""
    m = kept(roomed(spark, d).where("rir_key is not null"), "condition_name", "rir_key", "model", "wer")
    real, sim = rooms.split_simulated(m)
    x = real.withColumn("simulated", F.lit(False)).unionByName(sim.withColumn("simulated", F.lit(True)))
    return x.groupBy("model", "simulated").agg(F.count("*").alias("n"), F.round(F.avg("wer"), 9).alias("wer"))


@query(f"WITH {_ROOMED} SELECT model, round(rt60 * 10 + (rir_key LIKE '%/sim_%')::INT, 9) AS c50_db, count(*) AS n, round(avg(wer), 9) AS wer FROM w WHERE n_ref IS NOT NULL GROUP BY 1, 2")
def remapped_rows(spark, d):
    """Error along another coordinate of the delivered rooms."""
    m = kept(roomed(spark, d).where("rir_key is not null"), "condition_name", "rir_key", "rt60", "model", "wer")
    c = m.select("rir_key", F.round(F.col("rt60") * 10 + rooms.is_simulated().cast("int"), 9).alias("value")).distinct()
    c = persist(c, "coordinates")  # a row a room, which is then known to be few
    return rooms.remap(m, c, "c50_db").groupBy("model", "c50_db").agg(F.count("*").alias("n"), F.round(F.avg("wer"), 9).alias("wer"))


_LEVELS = "(SELECT unnest([{}]) AS {})"
_BLOCK = " SELECT {c} FROM " + ", ".join(_LEVELS.format("{" + f + "}", f) for f in S.FACTORS)
_GRID_SQL = " UNION ".join(_BLOCK.format(c=", ".join(S.FACTORS), **{f: ", ".join(repr(v) if isinstance(v, str) else f"{v}::DOUBLE" for v in b[f]) for f in S.FACTORS}) for b in rooms.INTERACTION_GRID)


@query(f"SELECT 'rt60-' || rtrim(rtrim(rt60::VARCHAR, '0'), '.') || '_snr-' || snr_db::INT || '_' || noise_type || '_' || codec || '_mic-' || CASE WHEN mic_rolloff = 0.5 THEN '0.5' ELSE mic_rolloff::INT::VARCHAR END AS condition_name, {', '.join(S.FACTORS)} FROM ({_GRID_SQL})")
def interaction_grid(spark, d):
    """The conditions of the grid that is run, block by block, each once."""
    return rooms.grid(spark, rooms.INTERACTION_GRID)


@query("SELECT p_partkey::VARCHAR AS id, p_name FROM part WHERE p_partkey IN (2, 5, 36)")
def selected_clips(spark, d):
    """Rows of a manifest by a list of ids."""
    return rooms.select_clips(read(spark, d, "part", "p_partkey", "p_name").select(F.col("p_partkey").cast("string").alias("id"), "p_name"), "2, 5,36")


@query("""WITH k AS (SELECT o_custkey, arg_max(row(CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' END, o_orderkey % 2 = 0), o_orderkey) AS c FROM orders GROUP BY 1), x AS (SELECT c_custkey % 7 = 0 AS named, c[1] AS arm, coalesce(c[2], false) AS clear FROM customer LEFT JOIN k ON c_custkey = o_custkey)
SELECT count(*) AS n_pairs, count(arm) AS n_scored, count(*) FILTER (arm = 'B') AS n_direction_hit, count(*) FILTER (named) AS n_named, count(*) FILTER (named AND NOT (coalesce(arm = 'B', false) AND clear)) AS n_strict_failures, count(arm) > 0 AND count(arm) = count(*) FILTER (arm = 'B') AS held FROM x""")
def prediction_scorecard(spark, d):
    """A sealed prediction against the latest call of each pair."""
    pairs = read(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("clip_id"), (F.col("c_custkey") % 7 == 0).alias("named"))
    arm = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B")
    calls = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").select(F.col("o_custkey").alias("clip_id"), F.col("o_orderkey").alias("session"), arm.alias("harder_arm"), (F.col("o_orderkey") % 2 == 0).alias("non_marginal"))
    return rooms.scorecard(pairs, calls, "B")


@query("""WITH i AS (SELECT c_nationkey AS factor, avg(c_acctbal) / 10000 AS s1, stddev_samp(c_acctbal) / 50000 AS s1_half, max(c_acctbal) / 10000 AS st, stddev_pop(c_acctbal) / 40000 AS st_half FROM customer GROUP BY 1)
SELECT factor, round(st - s1, 9) AS gap, round(sqrt(s1_half * s1_half + st_half * st_half), 9) AS gap_half, round(st - s1 - sqrt(s1_half * s1_half + st_half * st_half), 9) AS low, round(st - s1 + sqrt(s1_half * s1_half + st_half * st_half), 9) AS high, coalesce(st - s1 - sqrt(s1_half * s1_half + st_half * st_half) > 0.4, false) AS significant FROM i""")
def gap_intervals(spark, d):
    """Gaps of indices with intervals in quadrature."""
    c = read(spark, d, "customer", "c_nationkey", "c_acctbal")
    i = c.groupBy(F.col("c_nationkey").alias("factor")).agg((F.avg("c_acctbal") / 10000).alias("s1"), (F.stddev_samp("c_acctbal") / 50000).alias("s1_half"), (F.max("c_acctbal") / 10000).alias("st"), (F.stddev_pop("c_acctbal") / 40000).alias("st_half"))
    return sensitivity.gap_intervals(i, 0.4).select("factor", *r9("gap", "gap_half", "low", "high"), "significant")


@query(f"WITH {C_SQL}, a AS (SELECT model, rt60, avg(mean_conf) AS f FROM c GROUP BY 1, 2) SELECT a.model, a.rt60, round(abs(a.f - b.f), 9) AS drift FROM a LEFT JOIN a b ON a.model = b.model AND b.rt60 = 0.2")
def feature_drift(spark, d):
    """How far confidence moves from its value in the driest room."""
    c = conditions(spark, d).groupBy("model", "rt60").agg(F.avg("mean_conf").alias("f"))
    return edits.drift(c, ["model"], "rt60", 0.2, "f").select("model", "rt60", *r9("drift"))


@query(f"""WITH {C_SQL}, a AS (SELECT condition_name, wer AS x, mean_conf AS y FROM c WHERE model = 'arm_a' AND mean_conf IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS u, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS v FROM a),
s AS (SELECT count(*) AS n, corr(u, v) AS rho FROM r), t AS (SELECT sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))) AS tau FROM a p JOIN a q ON p.condition_name < q.condition_name),
h AS (SELECT n, rho, tau, n - 2 AS df, (n - 2) / (n - 2 + rho * rho * (n - 2) / (1 - rho * rho)) AS c2, 3 * abs(tau) * sqrt(n * (n - 1)) / sqrt(2.0::DOUBLE * (2 * n + 5)) AS z FROM s, t),
e AS (SELECT df, c2, 1 + coalesce((SELECT sum(w) FROM (SELECT exp(sum(ln(CASE WHEN df % 2 = 0 THEN (2 * k - 1.0::DOUBLE) / (2 * k) ELSE 2 * k / (2 * k + 1.0::DOUBLE) END * c2)) OVER (ORDER BY k)) AS w FROM (SELECT unnest(range(1, (df - 2 - df % 2) // 2 + 1)) AS k, df, c2 FROM h))), 0) AS sums FROM h),
g AS (SELECT 1 + sum(w) AS ones FROM (SELECT exp(sum(ln(z * z / (2 * k + 1.0::DOUBLE))) OVER (ORDER BY k)) AS w FROM (SELECT unnest(range(1, 201)) AS k, z FROM h)))
SELECT n, round(rho, 9) AS spearman, round(1 - CASE WHEN h.df % 2 = 0 THEN sqrt(1 - h.c2) * sums ELSE (atan(sqrt((1 - h.c2) / h.c2)) + sqrt((1 - h.c2) * h.c2) * sums) * 2 / pi() END, 9) AS spearman_p, round(tau, 9) AS kendall, round(1 - z * exp(-z * z / 2) * sqrt(2 / pi()) * ones, 9) AS kendall_p FROM h, e, g""")
def rank_agreement(spark, d):
    """Whether error and confidence put one model's conditions in the same order."""
    c = conditions(spark, d).where("model = 'arm_a' and mean_conf is not null")
    return ranking.rank_agreement(c, "wer", "mean_conf", "condition_name").select("n", *r9("spearman", "spearman_p", "kendall", "kendall_p"))


# ------------------------------------------------------------------- report summaries


@query(f"WITH {M_SQL} SELECT model, condition_name, count(*) AS n, count(DISTINCT clip_id) AS n_clips, round(avg(wer), 9) AS wer, round(stddev_pop(wer), 9) AS wer_sd, round(avg(wer) FILTER (mean_conf IS NOT NULL), 9) AS wer_spoke, count(mean_conf) AS n_spoke, count(mean_conf) = 0 AS mute FROM m WHERE NOT failed GROUP BY 1, 2")
def condition_spread(spark, d):
    """Error of each condition with its deviation over clips."""
    return profiles.spread(measurements(spark, d)).select("model", "condition_name", "n", "n_clips", *r9("wer", "wer_sd", "wer_spoke"), "n_spoke", "mute")


@query(f"WITH {M_SQL}, b AS (SELECT model, condition_name, count(*) AS n_rows, count(*) FILTER (failed) AS n_failed, count(*) FILTER (NOT failed AND n_ref - n_del + n_ins <= 0) AS n_silent FROM m GROUP BY 1, 2) SELECT * FROM b WHERE n_failed = n_rows OR (n_failed < n_rows AND n_silent = n_rows - n_failed)")
def lost_conditions(spark, d):
    """Conditions that failed or were silent altogether."""
    return profiles.lost_conditions(measurements(spark, d)).drop("errors")


@query(f"WITH {M_SQL}, a AS (SELECT model, codec, count(*) AS n, avg(wer) AS mean, 1.96::DOUBLE * stddev_samp(wer) / sqrt(count(*)) AS h FROM m WHERE NOT failed GROUP BY 1, 2) SELECT model, codec, n, round(mean, 9) AS mean, round(mean - h, 9) AS low, round(mean + h, 9) AS high FROM a")
def mean_by_codec(spark, d):
    """Mean error by codec with an interval."""
    return profiles.mean_by(measurements(spark, d), "model", "codec").select("model", "codec", "n", *r9("mean", "low", "high"))


@query(f"WITH {C_SQL}, w AS (SELECT model, condition_name, round(wer, 9) AS wer FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY wer DESC NULLS LAST, condition_name) AS place FROM w) SELECT * FROM k WHERE place <= 10")
def worst_conditions(spark, d):
    """Each model's ten worst conditions; equal to nine decimals is a tie."""
    return profiles.worst(conditions(spark, d).select("model", "condition_name", *r9("wer"))).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {M_SQL}, u AS (SELECT DISTINCT condition_name, rt60, snr_db, codec, mic_rolloff FROM m), v AS (SELECT condition_name FROM (SELECT condition_name, dense_rank() OVER (ORDER BY rt60) + dense_rank() OVER (ORDER BY snr_db DESC) + dense_rank() OVER (ORDER BY mic_rolloff) - 3 + (codec <> 'none')::INT AS s FROM u) WHERE s <= 1)
SELECT model, condition_name, count(*) AS n, round(avg(mean_conf), 9) AS mean_conf FROM m SEMI JOIN v USING (condition_name) GROUP BY 1, 2""")
def benign_corner(spark, d):
    """Confidence within one step of the mildest settings."""
    m = kept(measurements(spark, d), "model", "condition_name", "rt60", "snr_db", "codec", "mic_rolloff", "mean_conf")
    near = profiles.benign(m, {"rt60": True, "snr_db": False, "mic_rolloff": True}, 1)
    return near.groupBy("model", "condition_name").agg(F.count("*").alias("n"), F.avg("mean_conf").alias("mean_conf")).select("model", "condition_name", "n", *r9("mean_conf"))


@query(f"""WITH {_S_SQL}, b AS (SELECT model, condition_name, avg(flagged::INT) AS p, bool_or(flagged AND wer_hi = 0.3 AND conf_pct_hi = 0.6) AS d, bool_and(flagged) AS a FROM s GROUP BY 1, 2),
x AS (SELECT model, count(*) FILTER (p > 0) AS n_ever, count(*) FILTER (a) AS n_core, count(*) FILTER (d) AS n_default, avg(p) FILTER (d) AS dp FROM b GROUP BY 1),
n AS (SELECT model, wer_hi, conf_pct_hi, count(*) FILTER (flagged) AS n FROM s GROUP BY 1, 2, 3), y AS (SELECT model, min(n) FILTER (wer_hi BETWEEN 0.24 AND 0.36 AND conf_pct_hi BETWEEN 0.49 AND 0.71) AS near_low, max(n) FILTER (wer_hi BETWEEN 0.24 AND 0.36 AND conf_pct_hi BETWEEN 0.49 AND 0.71) AS near_high, (max(n) + 1) / (min(n) + 1)::DOUBLE AS fold FROM n GROUP BY 1)
SELECT model, n_ever, n_core, n_default, round(dp, 9) AS default_persistence, near_low, near_high, round(fold, 9) AS fold, CASE WHEN fold <= 2 AND coalesce(dp >= 0.75, true) THEN 'stable' WHEN fold >= 4 OR coalesce(dp < 0.4, false) THEN 'fragile' ELSE 'moderate' END AS verdict FROM x JOIN y USING (model)""")
def sweep_sets(spark, d):
    """Members of the sweep around the published thresholds."""
    return profiles.grid_sets(gaps(spark, d)).select("model", "n_ever", "n_core", "n_default", *r9("default_persistence"), "near_low", "near_high", *r9("fold"), "verdict")


@query(f"WITH {_S_SQL}, n AS (SELECT model, wer_hi, conf_pct_hi, count(*) FILTER (flagged) AS n FROM s GROUP BY 1, 2, 3) SELECT x.model AS a, y.model AS b, count(*) AS n_points, count(*) FILTER (x.n < y.n) AS n_below, min(x.n) AS least, max(x.n) AS most FROM n x JOIN n y ON x.wer_hi = y.wer_hi AND x.conf_pct_hi = y.conf_pct_hi AND x.model <> y.model GROUP BY 1, 2")
def order_of_arms(spark, d):
    """Whether the models' order holds over the grid of thresholds."""
    return profiles.order_of_arms(taxonomy.grid_counts(gaps(spark, d)))


_LADDER = "SELECT l_suppkey AS k, l_linenumber AS l, sum(round(l_quantity)::BIGINT)::BIGINT AS y, sum(round(l_tax * 100)::BIGINT)::BIGINT AS z FROM lineitem GROUP BY 1, 2"


def ladders(spark, d):
    x = read(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_quantity", "l_tax")
    return x.groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("l")).agg(F.sum(F.round("l_quantity").cast("long")).alias("y"), F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("z"))


@query(f"""WITH c AS ({_LADDER}), r AS {_rho("c", "k", "l", "y")}, s AS (SELECT k, l, sign(y - lag(y) OVER (PARTITION BY k ORDER BY l)) AS s FROM c), f AS (SELECT k, s <> lag(s) OVER (PARTITION BY k ORDER BY l) AS f FROM s WHERE s <> 0), g AS (SELECT k, count(*) FILTER (f) AS g FROM f GROUP BY 1)
SELECT k, n, CASE WHEN rho = 0 THEN 0.0 ELSE rho END AS spearman, coalesce(g, 0) AS n_sign_flips, n >= 3 AND coalesce(g, 0) = 0 AS monotone FROM r LEFT JOIN g USING (k)""")
def ladder_trends(spark, d):
    """Whether curves are ladders."""
    return profiles.trend(ladders(spark, d), ["k"], "l", "y").select("k", "n", *r9("spearman"), "n_sign_flips", "monotone")


_HALF = """n{c} AS (SELECT k, l, coalesce(({c} - min({c}) OVER p) / nullif(max({c}) OVER p - min({c}) OVER p, 0)::DOUBLE, 0) AS v FROM c WINDOW p AS (PARTITION BY k)),
g{c} AS (SELECT k, l, v, lag(v) OVER q AS pv, lag(l) OVER q AS pl FROM n{c} WINDOW q AS (PARTITION BY k ORDER BY l)),
h{c} AS (SELECT k, coalesce(arg_min(coalesce(pl + (0.5 - pv) * (l - pl) / nullif(v - pv, 0), l), l) FILTER (pv IS NOT NULL AND v >= 0.5), max(l)) AS h FROM g{c} GROUP BY 1)"""


@query(f"""WITH c AS ({_LADDER}), {_HALF.format(c="y")}, {_HALF.format(c="z")}, r AS {_rho("c", "k", "y", "z")}, a AS (SELECT k, max(abs(ny.v - nz.v)) AS max_gap FROM ny JOIN nz USING (k, l) GROUP BY 1)
SELECT k, n, CASE WHEN rho = 0 THEN 0.0 ELSE rho END AS spearman, round(max_gap, 9) AS max_gap, round(hy.h, 9) AS feature_half, round(hz.h, 9) AS lexical_half, max_gap <= 0.2 AS coupled, CASE WHEN round(hy.h, 9) < round(hz.h, 9) THEN 'feature' WHEN round(hz.h, 9) < round(hy.h, 9) THEN 'lexical' ELSE 'together' END AS leads FROM r JOIN a USING (k) JOIN hy USING (k) JOIN hz USING (k)""")
def degradation_rates(spark, d):
    """Whether two curves over the same levels fall together."""
    return profiles.degradation_rates(ladders(spark, d), ["k"], "l", "y", "z").select("k", "n", *r9("spearman", "max_gap", "feature_half", "lexical_half"), "coupled", "leads")


@query(f"""WITH {C_SQL}, p AS (SELECT b.wer - a.wer AS g FROM c a JOIN c b USING (condition_name) WHERE a.model = 'arm_a' AND b.model = 'arm_n')
SELECT count(*) AS n, round(avg(g), 9) AS mean_gap, round(avg(abs(g)), 9) AS mean_abs_gap, round(median(g), 9) AS median_gap, CASE WHEN avg(g) > 0 THEN 'overestimates' WHEN avg(g) < 0 THEN 'underestimates' ELSE 'matches' END AS direction FROM p""")
def level_gap(spark, d):
    """How far one run's errors lie above another's."""
    c = conditions(spark, d).select("model", "condition_name", "wer")
    p = c.where("model = 'arm_a'").select("condition_name", F.col("wer").alias("x")).join(c.where("model = 'arm_n'").select("condition_name", F.col("wer").alias("y")), "condition_name")
    return profiles.level_gap(p.withColumn("gap", F.col("y") - F.col("x")), "condition_name", "gap").select("n", *r9("mean_gap", "mean_abs_gap", "median_gap"), "direction")


@query(r"""WITH p AS (SELECT p_partkey, p_size, p_type, trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}_]+', ' ', 'g')) AS t, trim(regexp_replace(lower(p_brand), '[^\p{L}\p{N}_]+', ' ', 'g')) AS b FROM part), r AS (SELECT p_type AS kind, p_size / 50.0::DOUBLE AS wer, p_partkey % 5 <> 0 AS scored, (NOT contains(' ' || t || ' ', ' ' || b || ' '))::INT AS miss FROM p)
SELECT kind, count(*) FILTER (scored) AS n_rows, count(*) FILTER (NOT scored) AS n_unscored, round(avg(miss / 2.0::DOUBLE) FILTER (scored), 9) AS entity_error_rate, round(avg(wer) FILTER (scored), 9) AS wer, round(avg(miss) FILTER (scored), 9) AS critical_failure_rate, round(avg(miss / 2.0::DOUBLE) FILTER (scored) - avg(wer) FILTER (scored), 9) AS entity_minus_wer FROM r GROUP BY 1""")
def entity_errors(spark, d):
    """Entity error beside word error by kind; clips without a spec are counted."""
    p = read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").withColumn("clip_id", F.col("p_partkey"))
    specs = p.where("p_partkey % 5 <> 0").select("clip_id", F.create_map(F.lit("name"), text.normalize(F.col("p_name"))[0], F.lit("brand"), F.col("p_brand")).alias("slots"), F.array(F.lit("brand")).alias("critical"))
    rows = p.select("clip_id", F.col("p_name").alias("transcript"), (F.col("p_size") / 50).alias("wer"), F.col("p_type").alias("kind"))
    return profiles.entity_errors(rows, specs, ["kind"]).select("kind", "n_rows", "n_unscored", *r9("entity_error_rate", "wer", "critical_failure_rate", "entity_minus_wer"))


@query(f"""WITH {_X}, r AS (SELECT turn, len(hyp) / len(ref)::DOUBLE AS r, len(list_filter(hyp, lambda w: NOT list_contains(ref, w))) / greatest(len(hyp), 1)::DOUBLE AS f FROM x WHERE len(ref) > 0)
SELECT turn, count(*) AS n, round(quantile_cont(r, 0.5), 9) AS median_ratio, round(quantile_cont(r, 0.95), 9) AS p95_ratio, round(avg((r > 2)::INT), 9) AS share_over_2, round(avg(f), 9) AS mean_foreign FROM r GROUP BY 1""")
def answer_lengths(spark, d):
    """How long and how foreign answers are, by turn."""
    return profiles.lengths(exchanges(spark, d), ["turn"]).select("turn", "n", *r9("median_ratio", "p95_ratio", "share_over_2", "mean_foreign"))


@query()
def top_inserted(spark, d):
    """The commonest words that answers insert, by turn."""
    x = exchange_edits(spark, d)
    return profiles.top_inserted(x.select("clip_id", "turn", F.explode("edits").alias("e")).select("clip_id", "turn", "e.op", "e.hyp"), x.select("clip_id", F.explode("ref").alias("word")), "turn")


@query("""WITH x AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'codec=g726' WHEN 1 THEN 'rt60' ELSE 'codec=opus' END AS contrast, CASE s_suppkey % 2 WHEN 0 THEN 'del' ELSE 'ins' END AS edit, s_acctbal AS delta FROM supplier)
SELECT s_suppkey, CASE WHEN NOT delta > 0 THEN 'none' WHEN contrast = 'codec=g726' AND edit = 'del' THEN 'f1' WHEN contrast LIKE 'codec%' AND edit = 'del' THEN 'f2' WHEN contrast LIKE 'codec%' AND edit = 'ins' THEN 'f3' WHEN edit = 'del' THEN 'g' END AS fix FROM x""")
def implied_fixes(spark, d):
    """What would mend a signature: by contrast, by factor, by edit."""
    k = F.col("s_suppkey")
    x = read(spark, d, "supplier", "s_suppkey", "s_acctbal").select("s_suppkey", F.when(k % 3 == 0, "codec=g726").when(k % 3 == 1, "rt60").otherwise("codec=opus").alias("contrast"), F.when(k % 2 == 0, "del").otherwise("ins").alias("edit"), F.col("s_acctbal").alias("delta"))
    return profiles.with_fix(x, {("codec=g726", "del"): "f1", ("codec", "del"): "f2", ("codec", "ins"): "f3"}, {"del": "g"}).select("s_suppkey", "fix")


@query("""WITH x AS (SELECT CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 100000 END AS v FROM supplier) SELECT count(v) AS n, count(*) FILTER (v IS NULL) AS n_incomparable, round(min(v), 9) AS least, round(median(v), 9) AS median, round(max(v), 9) AS most, count(*) FILTER (v < 0) AS n_favouring, count(*) FILTER (abs(v) > 0.01) AS n_moved FROM x""")
def coordinate_spread(spark, d):
    """How far the choice of coordinate moves a difference; NaN is incomparable."""
    x = read(spark, d, "supplier", "s_suppkey", "s_acctbal").select(F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") / 100000).otherwise(F.lit(float("nan"))).alias("v"))
    return profiles.coordinate_spread(x, "v").select("n", "n_incomparable", *r9("least", "median", "most"), "n_favouring", "n_moved")


@query(f"WITH b AS (SELECT item_id, text, {_NORM.format(x='text')} AS t FROM benchmark) SELECT item_id, count(*) AS n_rows, count(*) FILTER (t <> coalesce(text, '')) AS n_unstable FROM b GROUP BY 1 HAVING count(*) > 1 OR count(*) FILTER (t <> coalesce(text, '')) > 0")
def manifest_faults(spark, d):
    """Items whose text normalizing would change."""
    return gate.manifest_faults(read(spark, d, "benchmark", "item_id", "text"), "item_id", "text")


_CLIPS = "SELECT p_partkey AS clip_id, CASE WHEN p_size % 7 = 0 THEN 8000 ELSE 16000 END AS fs, 1 + (p_size % 11 = 0)::INT AS channels, CASE WHEN p_size % 13 = 0 THEN 'MP3' ELSE 'PCM_16' END AS subtype, p_size / 4.0::DOUBLE AS duration_s, (p_partkey % 100) / 100.0::DOUBLE AS peak, p_size % 20 AS n_near_clip, p_size / 100.0::DOUBLE AS lead_s, (50 - p_size) / 100.0::DOUBLE AS tail_s, p_size::DOUBLE AS snr_db FROM part"


def clips(spark, d):
    p, size = read(spark, d, "part", "p_partkey", "p_size"), F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("clip_id"), F.when(size % 7 == 0, 8000).otherwise(16000).alias("fs"), (1 + (size % 11 == 0).cast("int")).alias("channels"), F.when(size % 13 == 0, "MP3").otherwise("PCM_16").alias("subtype"), (size / 4).alias("duration_s"),
        (F.col("p_partkey") % 100 / 100).alias("peak"), (size % 20).alias("n_near_clip"), (size / 100).alias("lead_s"), ((50 - size) / 100).alias("tail_s"), size.cast("double").alias("snr_db"),
    )


@query(f"""WITH c AS ({_CLIPS}), f AS (SELECT clip_id, 20 * log10(peak + 1e-12) AS db, list_filter([CASE WHEN channels <> 1 THEN 'channels' END, CASE WHEN fs NOT IN (16000, 48000) THEN 'sample_rate' END, CASE WHEN subtype = 'MP3' THEN 'subtype' END, CASE WHEN peak >= 0.99 THEN 'clipped' END, CASE WHEN peak < 0.99 AND n_near_clip > 10 THEN 'near_clipping' END,
CASE WHEN lead_s < 0.25 THEN 'lead' END, CASE WHEN tail_s < 0.25 THEN 'tail' END, CASE WHEN duration_s < 1.5 OR duration_s > 12 THEN 'duration' END], lambda x: x IS NOT NULL) AS e, snr_db FROM c) SELECT clip_id, array_to_string(e, ',') AS errors, concat_ws(',', CASE WHEN db < -14 OR db > -4 THEN 'peak' END, CASE WHEN snr_db < 20 THEN 'snr' END) AS warnings FROM f""")
def clip_faults(spark, d):
    """Recordings against the rules of the gate."""
    return gate.clip_faults(clips(spark, d)).select("clip_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH c AS ({_CLIPS}), f AS (SELECT clip_id, concat_ws(',', CASE WHEN abs(20 * log10(peak + 1e-12) - (SELECT median(20 * log10(peak + 1e-12)) FROM c)) > 6 THEN 'level_drift' END, CASE WHEN duration_s > 2 * (SELECT median(duration_s) FROM c) THEN 'long' END) AS warnings FROM c) SELECT * FROM f WHERE warnings <> ''""")
def corpus_faults(spark, d):
    """Recordings that stand apart from the whole set."""
    return gate.corpus_faults(clips(spark, d)).select("clip_id", F.array_join("warnings", ",").alias("warnings"))


# ---------------------------------------------------------------------------- sweeps

#: A rising sweep, one whose error stays low, and a falling one; clips are months.
_SWEEP = """SELECT CASE l_returnflag WHEN 'A' THEN 'rt60' WHEN 'N' THEN 'gain' ELSE 'snr_db' END AS factor, 'm' || month(l_shipdate) AS clip_id, l_linenumber AS l, count(*)::DOUBLE AS n,
count(*) FILTER (CASE l_returnflag WHEN 'A' THEN l_quantity <= 7 * l_linenumber WHEN 'N' THEN l_quantity <= 4 ELSE l_quantity <= l_linenumber * l_linenumber END) AS w,
count(*) FILTER (2 * round(l_discount * 100) <= 3 * l_linenumber) AS pitch, count(*) FILTER (round(l_tax * 100) * l_linenumber >= 28) AS tilt, count(*) FILTER (round(l_discount * 100)::INT % 2 = 0) AS hiss FROM lineitem GROUP BY 1, 2, 3"""


def sweep_points(spark, d):
    x = read(spark, d, "lineitem", "l_returnflag", "l_shipdate", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    flag, k, q = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_quantity")
    wrong = F.when(flag == "A", q <= 7 * k).when(flag == "N", q <= 4).otherwise(q <= k * k)
    factor = F.when(flag == "A", "rt60").when(flag == "N", "gain").otherwise("snr_db")
    cells = x.groupBy(factor.alias("factor"), F.concat(F.lit("m"), F.month("l_shipdate").cast("string")).alias("clip_id"), k.alias("l")).agg(
        F.count("*").cast("double").alias("n"), F.count_if(wrong).alias("w"), F.count_if(2 * F.round(F.col("l_discount") * 100) <= 3 * k).alias("pitch"),
        F.count_if(F.round(F.col("l_tax") * 100) * k >= 28).alias("tilt"), F.count_if(F.round(F.col("l_discount") * 100).cast("int") % 2 == 0).alias("hiss"),
    )
    level = F.when(F.col("factor") == "snr_db", 35 - 5 * F.col("l")).otherwise(F.col("l")).cast("double")
    long = cells.unpivot(["factor", "clip_id", "l", "n", "w"], ["pitch", "tilt", "hiss"], "feature", "count")
    return long.select("factor", "feature", "clip_id", level.alias("level"), (F.col("w") / F.col("n")).alias("wer"), (F.col("count") / F.col("n")).alias("drift"))


def _curve_sql(name: str, source: str, k: str) -> str:
    """CTEs up to ``name``: facts of the curves of ``source`` by the keys ``k``."""
    norm = lambda c: f"coalesce(({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0), 0)"
    rank = lambda c: f"rank() OVER (w ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0"
    half = lambda c: f"coalesce(arg_min(coalesce(pl + (0.5 - p{c}) * (level - pl) / nullif({c} - p{c}, 0), level), s) FILTER (p{c} IS NOT NULL AND {c} >= 0.5), arg_max(level, s))"
    seen = lambda v, c: f"CASE WHEN max({v}) <= min({v}) THEN 'none' WHEN arg_min({c}, s) >= 0.5 THEN 'left' ELSE 'inside' END"
    rho = lambda a, b: f"CASE WHEN count(*) >= 3 AND stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END"
    return f"""{name}0 AS (SELECT *, {norm("drift")} AS f, {norm("wer")} AS x, {rank("drift")} AS rf, {rank("wer")} AS rx FROM (SELECT *, CASE WHEN factor = 'snr_db' THEN -level ELSE level END AS s FROM {source}) WINDOW w AS (PARTITION BY {k})),
{name}1 AS (SELECT *, row_number() OVER q AS place, lag(f) OVER q AS pf, lag(x) OVER q AS px, lag(level) OVER q AS pl, CASE WHEN abs(drift - lag(drift) OVER q) > 1e-12 THEN sign(drift - lag(drift) OVER q) END AS d FROM {name}0 WINDOW q AS (PARTITION BY {k} ORDER BY s)),
{name}2 AS (SELECT *, d <> last_value(d IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn FROM {name}1),
{name}3 AS (SELECT {k}, count(*) AS n_levels, {rho("rf", "rx")} AS spearman, {rho("place", "rf")} AS trend, max(abs(f - x)) AS max_gap, count(*) FILTER (turn) AS n_sign_flips, max(wer) - min(wer) AS lexical_range, {half("f")} AS feature_half, {half("x")} AS lexical_half, {seen("drift", "f")} AS feature_censored, {seen("wer", "x")} AS lexical_censored FROM {name}2 GROUP BY {k}),
{name} AS (SELECT *, max_gap <= 0.2 AS coupled, CASE WHEN abs(feature_half - lexical_half) <= 1e-9 THEN 'together' WHEN (feature_half < lexical_half) = (factor <> 'snr_db') THEN 'feature' ELSE 'lexical' END AS leads FROM {name}3)"""


_VERDICTS = f"""WITH cells AS ({_SWEEP}), p AS (SELECT factor, u.feature, clip_id, (CASE WHEN factor = 'snr_db' THEN 35 - 5 * l ELSE l END)::DOUBLE AS level, w / n AS wer, u.v / n AS drift FROM cells, (VALUES ('pitch'), ('tilt'), ('hiss')) AS names(feature), LATERAL (SELECT names.feature AS feature, CASE names.feature WHEN 'pitch' THEN pitch WHEN 'tilt' THEN tilt ELSE hiss END AS v) u),
mean AS (SELECT factor, feature, level, round(avg(wer), 12) AS wer, round(avg(drift), 12) AS drift FROM p GROUP BY 1, 2, 3), {_curve_sql("m", "mean", "factor, feature")}, {_curve_sql("c", "p", "factor, feature, clip_id")},
said AS (SELECT factor, feature, leads, count(*) AS k FROM c WHERE lexical_range >= 0.1 GROUP BY 1, 2, 3), won AS (SELECT factor, feature, arg_min(leads, (-k, leads)) AS top_lead, max(k) / sum(k)::DOUBLE AS agreement FROM said GROUP BY 1, 2),
clips AS (SELECT factor, feature, count(*) AS n_clips, count(*) FILTER (lexical_range < 0.1) AS n_flat, stddev_samp(feature_half) AS feature_half_sd FROM c GROUP BY 1, 2),
v0 AS (SELECT *, lexical_range < 0.1 AS lexical_floor, coalesce(trend >= 0.7, false) AS reliable FROM m JOIN clips USING (factor, feature) LEFT JOIN won USING (factor, feature)),
v AS (SELECT * REPLACE (coalesce(agreement, 0.0) AS agreement), reliable AND NOT lexical_floor AND feature_censored = 'inside' AND lexical_censored = 'inside' AS quotable, coalesce(agreement >= 0.8 AND top_lead = leads, false) AND reliable AND NOT lexical_floor AS stable FROM v0)"""


@query(f"""{_VERDICTS} SELECT factor, feature, n_levels, n_clips, n_flat, round(spearman, 9) AS spearman, round(max_gap, 9) AS max_gap, round(trend, 9) AS trend, n_sign_flips, round(feature_half, 9) AS feature_half, round(feature_half_sd, 9) AS feature_half_sd, round(lexical_half, 9) AS lexical_half, feature_censored, lexical_censored, coupled, leads, top_lead, round(agreement, 9) AS agreement, lexical_floor, reliable, quotable, stable FROM v""")
def sweep_features(spark, d):
    """What each feature of a sweep shows, and whether the clips agree."""
    return sweeps.feature_verdicts(sweep_points(spark, d)).select(
        "factor", "feature", "n_levels", "n_clips", "n_flat", *r9("spearman", "max_gap", "trend"), "n_sign_flips", *r9("feature_half", "feature_half_sd", "lexical_half"), "feature_censored", "lexical_censored",
        "coupled", "leads", "top_lead", *r9("agreement"), "lexical_floor", "reliable", "quotable", "stable",
    )


@query(f"""{_VERDICTS}, t AS (SELECT *, quotable::INT + reliable::INT AS tier, bool_or(stable) OVER w AS s, max(quotable::INT + reliable::INT) OVER w AS best, bool_or(reliable) OVER w AS any_reliable FROM v WINDOW w AS (PARTITION BY factor)),
pool AS (SELECT factor, leads, count(*) AS k FROM t WHERE NOT lexical_floor AND CASE WHEN s THEN stable ELSE tier = best AND best > 0 END GROUP BY 1, 2), win AS (SELECT factor, arg_min(leads, (-k, leads)) AS lead FROM pool GROUP BY 1),
o AS (SELECT t.*, lead, row_number() OVER (PARTITION BY factor ORDER BY CASE WHEN lexical_floor THEN reliable::INT WHEN s THEN (stable AND leads = lead)::INT ELSE tier END DESC, CASE WHEN s AND NOT lexical_floor THEN abs(feature_half - lexical_half) ELSE coalesce(trend, -2) END DESC, feature) AS place FROM t LEFT JOIN win USING (factor)),
a AS (SELECT factor, count(*) AS n_features, count(*) FILTER (NOT coupled) AS n_decoupled, count(*) FILTER (reliable) AS n_reliable, count(*) FILTER (CASE WHEN lexical_floor THEN reliable ELSE stable END) AS n_stable FROM o GROUP BY 1)
SELECT factor, feature AS primary_feature, CASE WHEN lexical_floor THEN CASE WHEN any_reliable THEN 'feature' ELSE 'neither' END ELSE coalesce(lead, 'undetermined') END AS factor_leads, n_features, n_decoupled, n_reliable, n_stable, CASE WHEN lexical_floor THEN 'lexical_floor' WHEN NOT quotable THEN 'no_threshold' WHEN coupled THEN 'coupled' ELSE 'decoupled' END AS verdict FROM o JOIN a USING (factor) WHERE place = 1""")
def sweep_verdicts(spark, d):
    """The verdict of each sweep, its lead and the feature to quote."""
    found = sweeps.sweep_verdicts(sweeps.feature_verdicts(sweep_points(spark, d)))
    return found.select("factor", "primary_feature", "factor_leads", "n_features", "n_decoupled", "n_reliable", "n_stable", "verdict")
