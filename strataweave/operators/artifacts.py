"""Versioned rows: latest, history, deduplicated append, upsert, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.status import has_value


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order of each key; partial aggregation before the shuffle, so a long history costs one row a task and key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest)).select(*df.columns)


def last_versions(df: DataFrame, keys: list[str], order: list[str], n: int = 2) -> DataFrame:
    """The n newest rows of each key with their rank (1 is the newest)."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def history(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """All rows of each key, oldest first, numbered, with whether the value changed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    n = F.row_number().over(w)
    return df.withColumns({"n": n, "changed": (n == 1) | ~before.eqNullSafe(F.col(value))})


def append_new(existing: DataFrame | None, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows of new whose key is neither stored nor repeated (of repeated keys the least order, else any of the equal rows)."""
    rest = [c for c in new.columns if c not in key]
    if order:
        one = new.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_one")).select(*key, *(F.col(f"_one.{c}").alias(c) for c in rest)).select(*new.columns)
    else:
        one = new.dropDuplicates(key)
    return one if existing is None else one.join(existing.select(*key), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """existing with the rows of new in place of those of equal key; the greatest sequence wins."""
    return latest_per_key(existing.unionByName(new), keys, [sequence])


def merge_prefer(stored: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Both, by key; produced wins."""
    return produced.unionByName(stored.join(produced.select(*keys), keys, "left_anti"))


def newest_parse(parses: DataFrame, keys: list[str]) -> DataFrame:
    """The parse with the greatest version text."""
    return latest_per_key(parses, keys, ["parse_version"])


def parse_versions(parses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, versions): the parse versions of each, in order."""
    return parses.groupBy(*keys).agg(F.array_sort(F.collect_set("parse_version")).alias("versions"))


def filled_fields(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fields): the distinct fields that have a value, in order."""
    return cells.where(has_value(F.col("status"))).groupBy(*keys).agg(F.array_sort(F.collect_set("field_id")).alias("fields"))


def index_page(index: DataFrame, where: Column | None = None, failed_in: DataFrame | None = None, limit: int | None = None, offset: int = 0, by: str = "record_id") -> DataFrame:
    """Filtered, ordered, paged index rows; failed_in: only records with a failed step there."""
    out = index if where is None else index.where(where)
    if failed_in is not None:
        out = out.join(failed_in.select("record_id").distinct(), "record_id", "left_semi")
    out = out.orderBy(by)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def attempt_numbers(attempts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return attempts.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def not_among(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys others (keys) doesn't have, as by an anti join, but in one sort of both: where they are dealt by one of the keys they stay where they are, and no set of keys is held."""
    both = rows.withColumn("_own", F.lit(True)).unionByName(others.select(*keys), allowMissingColumns=True)
    return both.withColumn("_met", F.bool_or(F.col("_own").isNull()).over(Window.partitionBy(*keys))).where("_own AND NOT _met").drop("_own", "_met")


def resume_remaining(steps: DataFrame, done: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """Steps that haven't succeeded yet. within: a column that keys decide on and by which both are dealt, so that neither is shuffled."""
    done = done.where("state = 'succeeded'")
    return steps.join(done.select(*keys), keys, "left_anti") if within is None else not_among(steps, done, [within, *keys])


def batches(df: DataFrame, size: int):
    """Rows in lists of size, streamed partition by partition."""
    held = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
