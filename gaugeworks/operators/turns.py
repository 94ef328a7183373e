"""Turn-taking faults in dialogs: segments and faults by windows over a session in order.

Events are (session, t, type); those without a time are left out.  Pairing is a queue: the k-th
start is closed by the k-th end that finds a start waiting, and which ends do is told by a running
minimum of starts less ends.  Whether some segment covers a moment, or some answer follows it, is
a running maximum or the next row that has one.  So events are moved once, by session, every
window grows by one row at a time, and neither Python nor pairs of a session's events are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USER = ("user_speech_start", "user_speech_end")
AGENT = ("agent_speech_start", "agent_speech_end")
ENDPOINT = "agent_endpoint"
KINDS = ("false_endpoint", "missed_turn", "barge_in_error")


def _spans(events: DataFrame, parties: dict[str, tuple[str, str]], points: dict[str, str]) -> DataFrame:
    """(session, party, s, e): segments of the parties, each start with the first unused end at
    or after it; events of the types of ``points`` as segments of no length."""
    kept = events.select("session", F.col("t").cast("double").alias("t"), "type").where(F.col("t").isNotNull() & ~F.isnan("t"))
    one = lambda test: F.when(test, 1).otherwise(0)
    kind, party, start, k = F.col("type"), F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("long")
    # of one moment starts come before ends, so that a segment may be empty
    order = Window.partitionBy("session").orderBy("t", one(kind.isin([b for _, b in parties.values()]))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = kept.where(kind.isin([*(x for pair in parties.values() for x in pair), *points.values()]))
    for i, (a, b) in enumerate(parties.values()):
        kept = kept.withColumn(f"_a{i}", F.sum(one(kind == a)).over(order)).withColumn(f"_b{i}", F.sum(one(kind == b)).over(order))
    for i, (name, (a, b)) in enumerate(parties.items()):
        # ends that found no start waiting have the number of the end used before them, and aren't its least
        unused = F.greatest(F.max(F.col(f"_b{i}") - F.col(f"_a{i}")).over(order), F.lit(0))
        party, start = F.when(kind.isin(a, b), name).otherwise(party), (kind == a) | start
        k = F.when(kind == a, F.col(f"_a{i}")).when(kind == b, F.col(f"_b{i}") - unused).otherwise(k)
    for i, (name, a) in enumerate(points.items()):
        kept = kept.withColumn(f"_p{i}", F.sum(one(kind == a)).over(order))
        party, k = F.when(kind == a, name).otherwise(party), F.when(kind == a, F.col(f"_p{i}")).otherwise(k)
    point = kind.isin(list(points.values()))
    kept = kept.select("session", party.alias("party"), k.alias("_k"), F.when(start | point, F.col("t")).alias("s"), F.when(~start | point, F.col("t")).alias("e"))
    return kept.groupBy("session", "party", "_k").agg(F.min("s").alias("s"), F.min("e").alias("e")).where("s is not null and e is not null").drop("_k")


def segments(events: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """(session, s, e): each start with the first unused end at or after it."""
    return _spans(events, {"any": kinds}, {}).drop("party")


def findings(events: DataFrame, timeout: float = 2.0, tolerance: float = 0.3, margin: float = 0.05) -> DataFrame:
    """(session, kind, t): false endpoints inside a user's segment, turns without an
    answer in time, and barge-ins that the agent talks over."""
    spans = _spans(events, {"user": USER, "agent": AGENT}, {"endpoint": ENDPOINT})

    def moment(place: int, t: str, user: str | None = None, agent: str | None = None, answer: str | None = None) -> Column:
        ends = [(F.col(x) if x else F.lit(None).cast("double")).alias(n) for n, x in (("_user", user), ("_agent", agent), ("_answer", answer))]
        return F.struct(F.lit(place).alias("place"), F.col(t).alias("t"), *ends)

    # of one moment: users' starts, agents' starts, users' ends, then answers and endpoints
    moments = F.when(F.col("party") == "user", F.array(moment(0, "s", user="e"), moment(2, "e")))
    moments = moments.when(F.col("party") == "agent", F.array(moment(1, "s", agent="e"), moment(3, "s", answer="s")))
    moments = moments.otherwise(F.array(moment(4, "s", answer="s")))
    x = spans.select("session", F.explode(moments).alias("m")).select("session", "m.*")
    order = Window.partitionBy("session").orderBy("t", "place")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.select("session", "place", "t", F.max("_user").over(so_far).alias("_user"), F.max("_agent").over(so_far).alias("_agent"), F.expr("lead(_answer) IGNORE NULLS OVER (PARTITION BY session ORDER BY t, place)").alias("_answer"))
    t, agent = F.col("t"), F.coalesce("_agent", F.lit(float("-inf")))
    false = (F.col("place") == 4) & (t < F.col("_user") - margin)
    missed = (F.col("place") == 2) & (agent < t) & (F.col("_answer").isNull() | (F.col("_answer") > t + timeout))
    barge = (F.col("place") == 0) & (t < agent) & (agent - t > tolerance)
    kind = F.when(false, KINDS[0]).when(missed, KINDS[1]).when(barge, KINDS[2])
    return x.select("session", kind.alias("kind"), "t").where("kind is not null")


def finding_counts(found: DataFrame) -> DataFrame:
    """Findings of each kind, zeros kept."""
    kinds = found.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return kinds.join(found.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
