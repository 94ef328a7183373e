"""Checks that raise before a wrong number is made.  Each is one aggregate job whose
result is a row or a few; ``violations`` forms are plain DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import schema as S


def duplicate_cells(rows: DataFrame, keys: tuple[str, ...] = S.CELL) -> DataFrame:
    """Cells with more than one row, and how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique_cells(rows: DataFrame, keys: tuple[str, ...] = S.CELL) -> DataFrame:
    worst = duplicate_cells(rows, keys).orderBy(F.desc("n"), *keys).limit(3).collect()
    if worst:
        raise S.DuplicateCellError("cells with several rows: " + "; ".join(f"{tuple(r[:-1])} x{r.n}" for r in worst))
    return rows


def require_finite(rows: DataFrame, *columns: str) -> DataFrame:
    bad = rows.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in columns]).first()
    if any(bad):
        raise S.NonFiniteError("; ".join(f"{c}: {bad[c]} values aren't finite" for c in columns if bad[c]))
    return rows


def require_one_model(rows: DataFrame) -> DataFrame:
    if (n := rows.agg(F.count_distinct("model")).first()[0]) != 1:
        raise S.ArmPoolingError(f"confidence compares within one model, not {n}")
    return rows


def require_two_classes(rows: DataFrame, label: Column) -> DataFrame:
    low, high = rows.agg(F.min(label.cast("int")), F.max(label.cast("int"))).first()
    if low is None or low == high:
        raise S.DegenerateLabelError("labels of one class only")
    return rows


def require_comparable(rows: DataFrame, incomparable: list[str]) -> DataFrame:
    """Rows of the models whose error rates may be ranked together."""
    out = rows.where(~F.col("model").isin(incomparable)) if incomparable else rows
    if (n := out.agg(F.count_distinct("model")).first()[0]) < 2:
        raise S.WerIncomparableArmError(f"only {n} models can be compared")
    return out


def require_complete(rows: DataFrame, *factors: str) -> DataFrame:
    """One row for each combination of the levels that occur."""
    levels = rows.agg(F.count("*").alias("n"), F.count_distinct(*factors).alias("cells"), *[F.count_distinct(f).alias(f"_{f}") for f in factors]).first()
    wanted = 1
    for f in factors:
        wanted *= levels[f"_{f}"]
    if levels.n != wanted or levels.cells != wanted:
        raise S.IncompleteDesignError(f"{levels.n} rows in {levels.cells} cells where {wanted} make the design")
    return rows


def require_no_shrink(prior: DataFrame, new: DataFrame, keys: tuple[str, ...] = S.CELL) -> DataFrame:
    """Every cell of the prior table is still there."""
    lost = prior.select(*keys).distinct().join(new.select(*keys), list(keys), "left_anti").limit(4).collect()
    if lost:
        raise S.MeasurementError("cells would be lost: " + "; ".join(str(tuple(r)) for r in lost))
    return new


def require_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    """No group on both sides of a split."""
    if both := left.select(key).intersect(right.select(key)).limit(1).collect():
        raise S.MeasurementError(f"{both[0][0]} is on both sides of the split")


def require_equal_lengths(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Arrays that are zipped must be of one length; arrays_zip would pad with NULL."""
    if n := rows.agg(F.count_if(F.size(a) != F.size(b))).first()[0]:
        raise S.ConfidenceAlignmentError(f"{n} rows have {a} and {b} of different lengths")
    return rows
