"""The review queue: items, decisions, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.ids import content_hash_col

STATE_OF = {"accept": "accepted", "edit": "edited", "reject": "rejected", "defer": "deferred", "request_expanded_context": "context_requested"}


def open_items(steps: DataFrame) -> DataFrame:
    """Review items of steps that ask for one; an item's id hangs on what is asked, so asking again opens nothing new."""
    item = content_hash_col(record=F.col("record_id"), field=F.col("field_id"), entity=F.col("entity"), reason=F.col("reason"))
    return steps.select(item.alias("item_id"), "record_id", "field_id", "entity", "reason", "old_value", "proposed_value", F.lit("open").alias("state"), "created_at").dropDuplicates(["item_id"])


def reopen(stored: DataFrame, raised: DataFrame) -> DataFrame:
    """Stored items with the raised ones: a decided item stays decided unless another value is proposed."""
    both = stored.alias("s").join(raised.alias("r"), "item_id", "full_outer")
    keep = F.col("s.state").isNotNull() & (F.col("r.state").isNull() | F.col("s.proposed_value").eqNullSafe(F.col("r.proposed_value")))
    return both.select("item_id", *(F.when(keep, F.col(f"s.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in stored.columns if c != "item_id"))


def decide(items: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with their new state, human cells). decisions: item_id, decision, rationale, edited_value; unknown decisions and edits without a value are left out."""
    state = F.create_map(*(F.lit(x) for kv in STATE_OF.items() for x in kv))
    valid = decisions.where(F.col("decision").isin(*STATE_OF) & ((F.col("decision") != "edit") | F.col("edited_value").isNotNull()))
    both = items.join(valid, "item_id", "left")
    out = both.withColumn("state", F.coalesce(state[F.col("decision")], F.col("state"))).select(*items.columns)
    value = F.when(F.col("decision") == "edit", F.col("edited_value")).otherwise(F.coalesce("proposed_value", "old_value"))
    cells = both.where(F.col("decision").isin("accept", "edit")).select("record_id", "field_id", "entity", F.lit("present").alias("status"), value.alias("value"), F.lit("human").alias("actor"), F.lit(True).alias("accepted"), "item_id", "rationale")
    return out, cells


def accept_as_is(cells: DataFrame, schema_ref: str) -> DataFrame:
    """Latest cells accepted under a schema version without another run."""
    return cells.withColumn("accepted", F.lit(True)).withColumn("accepted_under", F.lit(schema_ref)).withColumn("status", F.when(F.col("status") == "review_required", "present").otherwise(F.col("status")))


def by_state(items: DataFrame) -> DataFrame:
    return items.groupBy("state").agg(F.count("*").alias("n"))


def by_reason(items: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent reasons (text before ;, 80 signs)."""
    return items.groupBy(F.substring(F.substring_index("reason", ";", 1), 1, 80).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(top)
