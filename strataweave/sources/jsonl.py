"""JSON lines in and out: records with their sources, gold samples, reviews, exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.errors import EngineError
from strataweave.functions.ids import text_hash_col
from strataweave.operators.review import STATE_OF

UNIT = "struct<unit_id:string,kind:string,section:string,text:string,ordinal:int,labels:array<string>,metadata:struct<labels:array<string>>>"
ENVELOPE = f"record_id string, record string, schema_ref string, source struct<source_id:string,source_version:string,content_hash:string,uri:string,media_type:string,labels:array<string>,metadata:string>, parsed struct<source_id:string,source_version:string,parse_version:string,units:array<{UNIT}>>"


def parse_lines(lines: DataFrame, schema_ref: str | None = None, id_field: str = "record_id", column: str = "value") -> DataFrame:
    """ENVELOPE columns of JSON lines. A line is {record, source, parsed, schema_ref, record_id} or the bare record; blank lines are skipped; a record without an id is named by its hash.

    A line that isn't JSON gives a row with a null record (kept, so that the caller can count and refuse it)."""
    line = F.col(column)
    doc = F.try_parse_json(line)
    rows = lines.where(F.trim(line) != "").select(line.alias("line"), doc.alias("doc"))
    wrapped = F.try_variant_get("doc", "$.record", "variant").isNotNull()
    record = F.when(wrapped, F.to_json(F.try_variant_get("doc", "$.record", "variant"))).otherwise(F.when(F.col("doc").isNotNull(), F.col("line")))
    own = F.coalesce(F.try_variant_get("doc", "$.record_id", "string"), F.try_variant_get("doc", f"$.record.{id_field}", "string"), F.try_variant_get("doc", f"$.{id_field}", "string"))
    part = lambda name: F.from_json(F.to_json(F.when(wrapped, F.try_variant_get("doc", f"$.{name}", "variant"))), _field(lines.sparkSession, name))
    return rows.select(
        F.coalesce(own, text_hash_col(F.col("line"))).alias("record_id"),
        record.alias("record"),
        F.coalesce(F.when(wrapped, F.try_variant_get("doc", "$.schema_ref", "string")), F.lit(schema_ref)).alias("schema_ref"),
        part("source").alias("source"),
        part("parsed").alias("parsed"),
    )


def _field(spark: SparkSession, name: str) -> str:
    return ENVELOPE.split(f"{name} ", 1)[1].split(", parsed struct", 1)[0] if name == "source" else ENVELOPE.split(", parsed ", 1)[1]


def read_records(spark: SparkSession, path: str, schema_ref: str | None = None, id_field: str = "record_id") -> DataFrame:
    return parse_lines(spark.read.text(path), schema_ref, id_field)


def sources_of(envelopes: DataFrame) -> DataFrame:
    return envelopes.where("source IS NOT NULL").select("source.*")


def units_of(envelopes: DataFrame) -> DataFrame:
    """Units of the parses, with their offsets in the document: the lengths of those before, one sign more for each."""
    each = envelopes.where("parsed IS NOT NULL").select("parsed.source_id", "parsed.source_version", "parsed.parse_version", F.posexplode("parsed.units").alias("at", "u"), "parsed.units")
    before = F.aggregate(F.slice("units", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda n, u: n + F.length(F.coalesce(u["text"], F.lit(""))) + 1)
    labels = F.coalesce("u.labels", "u.metadata.labels", F.array().cast("array<string>"))
    return each.select("source_id", "source_version", "parse_version", "u.unit_id", F.coalesce("u.kind", F.lit("paragraph")).alias("kind"), F.coalesce("u.section", F.lit("")).alias("section"), F.coalesce("u.text", F.lit("")).alias("text"), F.coalesce("u.ordinal", F.col("at")).cast("int").alias("ordinal"), before.alias("doc_start"), labels.alias("labels"))


def export_lines(records: DataFrame, cells: DataFrame) -> DataFrame:
    """One line a record: its JSON, and the provenance of every cell in order of field and entity."""
    names = ["field_id", "entity", "status", "artifact_id", "actor", "schema_ref", "migration_id", "step_id", "recipe_ref", "reason", "evidence", "created_at"]
    sidecar = cells.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(*(n for n in names if n in cells.columns)))).alias("provenance"))
    line = F.concat(F.lit('{"record_id":'), F.to_json(F.array("record_id")).substr(F.lit(2), F.length(F.to_json(F.array("record_id"))) - 2), F.lit(',"record":'), F.col("record"), F.lit(',"provenance":'), F.coalesce(F.to_json("provenance"), F.lit("[]")), F.lit("}"))
    return records.join(sidecar, "record_id", "left").select("record_id", line.alias("value"))


def write_lines(df: DataFrame, path: str, column: Column | str = "value") -> None:
    df.select(F.col(column) if isinstance(column, str) else column).write.mode("overwrite").text(path)


# gold ------------------------------------------------------------------------------------------------------------------------------

GOLD = "record_id string, field_id string, entity string, status string, value string, also_acceptable array<string>, note string"


def load_gold(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, gold rows): the header is the line that has a name and no record_id. Values are JSON text. An empty sample is refused."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.parse_json("value").alias("doc"))
    is_row = F.try_variant_get("doc", "$.record_id", "string").isNotNull()
    head = lines.where(~is_row).select("value").limit(1).collect()
    get = lambda k, t="string": F.try_variant_get("doc", f"$.{k}", t)
    also = F.transform(F.coalesce(get("also_acceptable", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.to_json(v))
    rows = lines.where(is_row).select(get("record_id").alias("record_id"), get("field_id").alias("field_id"), F.coalesce(get("entity"), F.lit("")).alias("entity"), F.coalesce(get("status"), F.lit("present")).alias("status"), F.to_json(get("value", "variant")).alias("value"), also.alias("also"), F.coalesce(get("note"), F.lit("")).alias("note"))
    if rows.isEmpty():
        raise EngineError("gold_empty", path)
    return (json.loads(head[0]["value"]) if head else {}), rows


def gold_lines(gold: DataFrame) -> DataFrame:
    row = F.struct("record_id", "field_id", "entity", "status", F.parse_json("value").alias("value"), F.transform("also", lambda v: F.parse_json(v)).alias("also_acceptable"), "note")
    return gold.select(F.to_json(row).alias("value"))


# reviews ---------------------------------------------------------------------------------------------------------------------------


def review_lines(items: DataFrame) -> DataFrame:
    """Items as lines with blank decision, rationale and edited_value to fill in."""
    blank = [F.lit("").alias(n) for n in ("decision", "rationale", "edited_value")]
    return items.select(F.to_json(F.struct(*items.columns, *blank)).alias("value"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """item_id, decision, rationale, edited_value of the lines with a decision; a line that isn't JSON, or a decision that isn't one, is an error that names it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    doc = F.try_parse_json("value")
    get = lambda k: F.try_variant_get(doc, f"$.{k}", "string")
    rows = lines.select("value", doc.isNull().alias("bad"), get("item_id").alias("item_id"), F.nullif(get("decision"), F.lit("")).alias("decision"), get("rationale").alias("rationale"), F.nullif(get("edited_value"), F.lit("")).alias("edited_value"))
    wrong = rows.where(F.col("bad") | (F.col("decision").isNotNull() & ~F.col("decision").isin(*STATE_OF)) | ((F.col("decision") == "edit") & F.col("edited_value").isNull())).select("value").limit(1).collect()
    if wrong:
        raise EngineError("review_invalid", wrong[0]["value"][:200])
    return rows.where("decision IS NOT NULL").select("item_id", "decision", "rationale", "edited_value")
