"""Structural and semantic validation of cells. Cells: record_id, field_id, entity, status, value_json; schema rows: Schema.frame()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.ids import in_scope_col
from strataweave.functions.status import has_value

RANK = {"pass": 0, "review": 1, "fail": 2}


_NUMBERS = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$"


def _type_ok(kind: Column) -> Column:
    whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    return (
        F.when(F.col("base_type") == "string", kind == "STRING")
        .when(F.col("base_type") == "integer", whole)
        .when(F.col("base_type") == "number", whole | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"))
        .when(F.col("base_type") == "boolean", kind == "BOOLEAN")
        .when(F.col("base_type") == "object", kind.startswith("OBJECT"))
        .otherwise(True)
    )


def _item_faults(item: Column, kind: Column | None = None) -> Column:
    """Faults of one value (codes); a wrong type hides the others, null items are skipped. The value's kind is told once, its text and number only where they are asked for."""

    def told(x: Column) -> Column:
        value, kind = x["value"], x["kind"]
        text, number = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")), F.when(kind.rlike(_NUMBERS), F.try_variant_get(value, "$", "double"))
        bounded, sized = F.expr("minimum IS NOT NULL OR maximum IS NOT NULL"), F.expr("size(enum) > 0 OR min_length IS NOT NULL OR max_length IS NOT NULL OR pattern IS NOT NULL")
        none = F.array().cast("array<string>")
        of_number = lambda n: F.array_compact(F.array(F.when(n < F.col("minimum"), "minimum"), F.when(n > F.col("maximum"), "maximum")))
        of_text = lambda t: F.array_compact(
            F.array(
                F.when((F.size("enum") > 0) & ~F.col("open") & ~F.array_contains("enum", t), "enum"),
                F.when(F.length(t) < F.col("min_length"), "min_length"),
                F.when(F.length(t) > F.col("max_length"), "max_length"),
                F.when(F.expr("pattern IS NOT NULL") & ~F.regexp(t, F.coalesce("pattern", F.lit(""))), "pattern"),
            )
        )
        checks = F.when(bounded & number.isNotNull(), _bind(number, of_number)).when(sized & text.isNotNull(), _bind(text, of_text)).otherwise(none)
        return F.when(kind.isNull() | (kind == "VOID"), none).when(~_type_ok(kind), F.array(F.lit("type"))).otherwise(checks)

    return _bind(F.struct(item.alias("value"), (F.schema_of_variant(item) if kind is None else kind).alias("kind")), told)


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def faults(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """One row a fault: record_id, field_id, entity, code, outcome. fields is small (one row a field) and joined by Spark's own size check."""
    joined = cells.join(fields.drop("schema_ref"), "field_id", "left")
    # a value is parsed once, and only where a rule can ask for it
    joined = joined.withColumn("_value", F.when(F.col("base_type").isNotNull() & has_value(F.col("status")), F.try_parse_json("value_json")))
    joined = joined.withColumn("_kind", F.schema_of_variant("_value"))
    value = F.col("_value")
    items = F.try_variant_get(value, "$", "array<variant>")
    is_list = F.col("_kind").startswith("ARRAY")
    shape = F.when(F.col("multivalued") & ~is_list, F.array(F.lit("not_a_list"))).when(~F.col("multivalued") & is_list & (F.col("base_type") != "any"), F.array(F.lit("unexpected_list")))
    counted = F.array_compact(F.array(F.when(F.size(items) < F.col("min_items"), "min_items"), F.when(F.size(items) > F.col("max_items"), "max_items")))
    each = F.concat(counted, F.array_distinct(F.flatten(F.transform(items, lambda x: _item_faults(x)))))
    codes = (
        F.when(F.col("base_type").isNull(), F.array(F.lit("undefined_field")))
        .when(~has_value(F.col("status")), F.when(F.col("required") & F.col("status").isin("not_extracted", "extraction_failed"), F.array(F.lit("required"))).otherwise(F.array().cast("array<string>")))
        .when(shape.isNotNull(), shape)
        .when(F.col("multivalued"), each)
        .otherwise(_item_faults(value, F.col("_kind")))
    )
    return joined.select("record_id", "field_id", "entity", F.explode(codes).alias("code"), F.lit("fail").alias("outcome"))


def missing_required(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """Required fields that have no cell at all, in every entity in scope that has some cell, and at the root of every record."""
    entities = cells.select("record_id", "entity").union(cells.select("record_id", F.lit(""))).distinct()
    due = entities.join(F.broadcast(fields.where("required").select("field_id", "collection")), in_scope_col(F.col("entity"), F.col("collection")))
    return due.join(cells, ["record_id", "field_id", "entity"], "left_anti").select("record_id", "field_id", "entity", F.lit("required_missing").alias("code"), F.lit("fail").alias("outcome"))


def validate(cells: DataFrame, fields: DataFrame) -> DataFrame:
    return faults(cells, fields).unionByName(missing_required(cells, fields))


def worst(results: DataFrame, keys: list[str]) -> DataFrame:
    """The worst outcome of each key: fail, review, pass."""
    rank = F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))
    names = F.array(*(F.lit(k) for k in RANK))
    return results.groupBy(*keys).agg(F.get(names, F.max(rank[F.col("outcome")])).alias("outcome"))


# semantic validators: Column predicates that give an outcome

Validator = Callable[[], Column]


def require_evidence() -> Column:
    """A value without a span is for review. Column n_spans."""
    return F.when(has_value(F.col("status")) & (F.coalesce("n_spans", F.lit(0)) == 0), "review").otherwise("pass")


def supports_value() -> Column:
    """A value that its evidence texts (column texts) don't contain, case aside, is for review."""
    found = F.exists("texts", lambda t: F.contains(F.lower(t), F.lower(F.col("value"))))
    return F.when(has_value(F.col("status")) & ~F.coalesce(found, F.lit(False)), "review").otherwise("pass")


def in_vocabulary(values: list[str]) -> Column:
    return F.when(has_value(F.col("status")) & ~F.col("value").isin(*values), "fail").otherwise("pass")


def honest_abstention() -> Column:
    """Unreported with a value, or without a reason, is for review."""
    return F.when(~has_value(F.col("status")) & (F.col("value").isNotNull() | ((F.col("status") == "not_reported") & F.col("reason").isNull())), "review").otherwise("pass")


def run_validators(cells: DataFrame, validators: dict[str, Column]) -> DataFrame:
    """One row a cell and validator: its outcome (a boolean or null counts as pass or fail, pass)."""
    rows = F.array(*(F.struct(F.lit(n).alias("validator"), F.coalesce(c.cast("string"), F.lit("pass")).alias("outcome")) for n, c in validators.items()))
    out = cells.withColumn("v", F.explode(rows)).select("record_id", "field_id", "entity", "v.validator", "v.outcome")
    return out.withColumn("outcome", F.when(F.col("outcome") == "true", "pass").when(F.col("outcome") == "false", "fail").otherwise(F.col("outcome")))
