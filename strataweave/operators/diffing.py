"""Record diffs, migration reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.status import has_value

KEYS = ["record_id", "field_id", "entity"]


def diff_records(before: DataFrame, after: DataFrame, keys: list[str] | None = None, provenance: bool = False) -> DataFrame:
    """One row a slot with its kind. Both sides: keys, status, value and, where they have them, path, evidence (its spans, compared as they are), origin (keys unique a side). A slot moves only between two paths."""
    keys = keys or KEYS
    names = [c for c in ("status", "value", "path", "evidence", "origin") if c in before.columns and c in after.columns]
    a, b = (df.select(*keys, F.lit(True).alias(f"{s}_there"), *(F.col(c).alias(f"{s}_{c}") for c in names)) for df, s in ((before, "old"), (after, "new")))
    both = a.join(b, keys, "full_outer")
    same = lambda c: F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    kind = F.when(F.col("old_there").isNull(), "added").when(F.col("new_there").isNull(), "removed").when(~same("status"), "status_changed").when(~same("value"), "value_changed")
    if "path" in names:
        kind = kind.when((F.col("old_path") != "") & (F.col("new_path") != "") & ~same("path"), "moved")
    if "evidence" in names:
        spans = lambda s: F.when(F.size(f"{s}_evidence") > 0, F.col(f"{s}_evidence"))  # noqa: E731  none is like no column
        kind = kind.when(~spans("old").eqNullSafe(spans("new")), "evidence_changed")
    if provenance and "origin" in names:
        kind = kind.when(~same("origin"), "provenance_changed")
    return both.withColumn("kind", kind.otherwise("unchanged")).drop("old_there", "new_there")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(F.count("*").alias("n"))


def change_rate(diff: DataFrame) -> DataFrame:
    """One row: deltas, changed (unchanged and moved don't count), rate."""
    changed = F.count_if(~F.col("kind").isin("unchanged", "moved"))
    return diff.agg(F.count("*").alias("n"), changed.alias("changed")).withColumn("rate", F.coalesce(F.try_divide(F.col("changed").cast("double"), F.col("n").cast("double")), F.lit(0.0)))


def changes_by_field(diff: DataFrame, top: int = 10) -> DataFrame:
    """The fields with the most changes, ties by name."""
    return diff.where(~F.col("kind").isin("unchanged", "moved")).groupBy("field_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field_id").limit(top)


def coverage(cells: DataFrame, by: str = "field_id") -> DataFrame:
    n, present = F.count("*"), F.count_if(F.col("status") == "present")
    return cells.groupBy(by).agg(n.alias("n"), present.alias("present")).withColumn("coverage", F.round(F.col("present") / F.col("n"), 6))


def status_histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy("status").agg(F.count("*").alias("n"))


def rates(steps: DataFrame) -> DataFrame:
    """Validation failures and reviews over all steps (over one where there are none)."""
    total = F.greatest(F.lit(1), F.count("*"))
    return steps.agg((F.count_if(F.col("outcome") == "fail") / total).alias("validation_failure_rate"), (F.count_if(F.col("state") == "review_needed") / total).alias("review_rate"))


def present(cells: DataFrame) -> DataFrame:
    return cells.where(has_value(F.col("status")))


def ends(log: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """First and last value of each key in an ordered log, one pass."""
    at = F.struct(*order)
    return log.groupBy(*keys).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.count("*").alias("n"))
