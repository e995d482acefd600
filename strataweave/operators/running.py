"""Rules of a run as relations: publication, status, budget admission, attempts, lineage, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.ids import text_hash_col
from strataweave.functions.status import blocks_publication


def publish_or_hold(steps: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """(record_id, decision, version_state): a record with a blocking step or a structural failure is held; it waits for review if a step asked for that and its values are sound."""
    blocks = F.bool_or(blocks_publication(F.col("state")))
    asked = F.bool_or(F.col("state") == "review_needed")
    per = steps.groupBy("record_id").agg(blocks.alias("blocks"), asked.alias("asked"))
    bad = F.lit(False)
    if invalid is not None:
        per = per.join(invalid.select("record_id").distinct().withColumn("invalid", F.lit(True)), "record_id", "left")
        bad = F.coalesce("invalid", F.lit(False))
    held = F.col("blocks") | bad
    state = F.when(~held, "published").when(F.col("asked") & ~bad, "review_needed").otherwise("failed")
    return per.select("record_id", F.when(held, "hold").otherwise("publish").alias("decision"), state.alias("version_state"))


def run_status(decisions: DataFrame, cancelled: bool = False) -> DataFrame:
    """One row: succeeded, partial, failed or cancelled. Held and blocked records and those for review are partial success; a run fails where a record broke (decision `error`) and none was published."""
    n, done = F.count("*"), F.count_if(F.col("decision") == "publish")
    broken = F.count_if(F.col("decision") == "error")
    status = F.when(F.lit(cancelled), "cancelled").when(n == done, "succeeded").when((done > 0) | (broken == 0), "partial").otherwise("failed")
    return decisions.agg(n.alias("records"), done.alias("published"), status.alias("status"))


def admit(calls: DataFrame, cap: float, cost: str = "usd", order: str = "step_key", block: str = "block", blocks: int = 64) -> DataFrame:
    """calls with admitted: in order of step_key until the running cost passes the cap.

    The running sum is taken in two levels, first over ranges of step_key and then within each, so no task sees all calls."""
    ordered = calls.repartitionByRange(blocks, order).withColumn(block, F.spark_partition_id())
    per = ordered.groupBy(block).agg(F.sum(cost).alias("_sum"))
    before = per.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_sum")
    own = F.sum(cost).over(Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = ordered.withColumn("_own", own).join(F.broadcast(before), block)
    return out.withColumn("running", F.round(F.col("_own") + F.col("_before"), 6)).withColumn("admitted", F.col("running") <= cap).drop(block, "_own", "_before")


def retries(attempts: DataFrame, keys: list[str]) -> DataFrame:
    return attempts.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "error").alias("errors"))


def lineage_hash(cells: DataFrame, key: list[str]) -> DataFrame:
    """Hash of field:value_hash of all inputs, in order of field."""
    parts = F.array_sort(F.collect_list(F.concat("field_id", F.lit(":"), "value_hash")))
    return cells.groupBy(*key).agg(text_hash_col(F.array_join(parts, ",")).alias("lineage"))


def executions(log: DataFrame, most: int | None = None) -> DataFrame:
    """Executions (execution_id, created_at, ...), the newest first."""
    out = log.orderBy(F.desc("created_at"), F.desc("execution_id"))
    return out if most is None else out.limit(most)


def state_histogram(steps: DataFrame) -> DataFrame:
    return steps.groupBy("state").agg(F.count("*").alias("n"))


def metrics(steps: DataFrame) -> DataFrame:
    """Sums over result rows; cached answers over all answers."""
    calls, hits = F.count_if(F.col("disposition") == "semantic"), F.count_if(F.col("disposition") == "cached")
    return steps.agg(F.count("*").alias("steps"), calls.alias("calls"), hits.alias("cache_hits"), F.round(F.coalesce(F.try_divide(hits.cast("double"), (hits + calls).cast("double")), F.lit(0.0)), 6).alias("cache_hit_rate"))
