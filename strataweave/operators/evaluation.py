"""Scores against a gold sample, gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.errors import EngineError
from strataweave.functions.status import gold_matches, has_value

COUNTS = ("n", "true_positive", "wrong_value", "missed", "spurious", "true_negative", "supported", "with_value", "schema_valid", "changed", "compared")


def compare(gold: DataFrame, produced: DataFrame, baseline: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """gold (keys, status, value, also) with what was produced (keys, status, value, n_spans, valid): one row a gold value with its verdict."""
    keys = keys or ["record_id", "field_id", "entity"]
    p = produced.select(*keys, F.col("status").alias("p_status"), F.col("value").alias("p_value"), *(F.col(c) for c in ("n_spans", "valid") if c in produced.columns))
    out = gold.join(p, keys, "left").withColumn("p_status", F.coalesce("p_status", F.lit("not_extracted")))
    out = out.withColumns({c: F.lit(None).cast(t) for c, t in (("n_spans", "int"), ("valid", "boolean"), ("also", "array<string>")) if c not in out.columns})
    match = F.coalesce(gold_matches(F.col("status"), F.col("value"), F.col("p_status"), F.col("p_value"), F.col("also")), F.lit(False))
    wants, has = has_value(F.col("status")), has_value(F.col("p_status"))
    verdict = F.when(wants & ~has, "missed").when(wants & match, "true_positive").when(wants, "wrong_value").when(has, "spurious").otherwise("true_negative")
    if baseline is not None:
        b = baseline.select(*keys, F.struct(F.col("status").alias("s"), F.col("value").alias("v")).alias("before"))
        out = out.join(b, keys, "left").withColumn("changed", F.when(F.col("before").isNotNull(), ~(F.col("before.s").eqNullSafe(F.col("p_status")) & F.col("before.v").eqNullSafe(F.col("p_value")))))
    else:
        out = out.withColumn("changed", F.lit(None).cast("boolean"))
    return out.withColumn("verdict", verdict)


def scores(compared: DataFrame, by: str = "field_id") -> DataFrame:
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    has = has_value(F.col("p_status"))
    out = compared.groupBy(by).agg(
        F.count("*").alias("n"), *(is_(v).alias(v) for v in ("true_positive", "wrong_value", "missed", "spurious", "true_negative")),
        F.count_if(has & (F.coalesce("n_spans", F.lit(0)) > 0)).alias("supported"), F.count_if(has).alias("with_value"), F.count_if(F.coalesce("valid", F.lit(True))).alias("schema_valid"),
        F.count_if(F.coalesce("changed", F.lit(False))).alias("changed"), F.count_if(F.col("changed").isNotNull()).alias("compared"),
    )
    return ratios(out)


def ratios(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and the rest, at four places; null where the denominator is zero (abstention and validity: 0), f1 also without a true positive."""
    tp, wrong, missed, spurious = (F.col(c) for c in ("true_positive", "wrong_value", "missed", "spurious"))
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 4)
    f1 = F.round(F.try_divide(2.0 * tp, 2.0 * tp + 2.0 * wrong + spurious + missed), 4)
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + wrong + spurious), "recall": ratio(tp, tp + wrong + missed), "f1": F.when(tp > 0, f1),
            "abstention_rate": F.coalesce(ratio(F.col("missed") + F.col("true_negative"), F.col("n")), F.lit(0.0)), "evidence_support": ratio(F.col("supported"), F.col("with_value")),
            "schema_validity": F.coalesce(ratio(F.col("schema_valid"), F.col("n")), F.lit(0.0)), "change_rate": ratio(F.col("changed"), F.col("compared")),
        }
    )


_GATE = re.compile(r"^(\w+)(?::([^<>=]+))?(?:>=([-\d.eE]+))?(?:<=([-\d.eE]+))?$")


def parse_gate(text: str) -> dict:
    """metric[:field][>=least][<=most]"""
    m = _GATE.match(text.replace(" ", ""))
    if not m or m[3] is None and m[4] is None:
        raise EngineError("config_invalid", f"{text!r} is no gate")
    return {"gate": text, "metric": m[1], "field": m[2], "least": None if m[3] is None else float(m[3]), "most": None if m[4] is None else float(m[4])}


def gate_results(scored: DataFrame, gates: list[str], corpus: dict[str, float] | None = None, by: str = "field_id") -> DataFrame:
    """(gate, value, passed): a lower bound is held against the least field, an upper bound against the greatest. An unmeasured metric passes."""
    parts = []
    for g in map(parse_gate, gates):
        if corpus and g["metric"] in corpus:
            value: Column = F.lit(float(corpus[g["metric"]]))
            row = scored.sparkSession.range(1).select(F.lit(g["gate"]).alias("gate"), value.alias("low"), value.alias("high"))
        elif g["metric"] not in scored.columns:
            row = scored.sparkSession.range(1).select(F.lit(g["gate"]).alias("gate"), *(F.lit(None).cast("double").alias(c) for c in ("low", "high")))
        else:
            rows = scored if g["field"] is None else scored.where(F.col(by) == g["field"])
            row = rows.agg(F.min(g["metric"]).cast("double").alias("low"), F.max(g["metric"]).cast("double").alias("high")).withColumn("gate", F.lit(g["gate"]))
        ok_low = F.lit(True) if g["least"] is None else F.coalesce(F.col("low") >= g["least"], F.lit(True))
        ok_high = F.lit(True) if g["most"] is None else F.coalesce(F.col("high") <= g["most"], F.lit(True))
        parts.append(row.select("gate", (F.col("low") if g["least"] is not None else F.col("high")).alias("value"), (ok_low & ok_high).alias("passed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gold_from_cells(cells: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Reviewed cells as gold rows."""
    out = cells.where("status <> 'not_extracted'")
    out = out if fields is None else out.where(F.col("field_id").isin(*fields))
    return out.select("record_id", "field_id", "entity", "status", "value", F.array().cast("array<string>").alias("also"), F.lit("").alias("note"))
