"""Documents as units: splitting, offsets, span placement, re-anchoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.text import count_occurrences, find_first, sentences, slice_expanded


def units_of_sections(docs: DataFrame, sections: Column, split_sentences: bool = False) -> DataFrame:
    """docs (source_id, ...) with an array of (section, text) as units: unit_id section:ordinal, kind, section, text, ordinal."""
    each = docs.select("source_id", F.posexplode(sections).alias("part", "s")).select("source_id", "part", "s.section", "s.text")
    if split_sentences:
        each = each.select("source_id", "part", "section", F.posexplode(sentences(F.col("text"))).alias("n", "text"))
    else:
        each = each.withColumn("n", F.lit(0))
    ordinal = F.row_number().over(Window.partitionBy("source_id").orderBy("part", "n")) - 1
    each = each.withColumn("ordinal", ordinal)
    return each.select("source_id", F.concat_ws(":", "section", F.col("ordinal").cast("string")).alias("unit_id"), F.lit("sentence" if split_sentences else "section").alias("kind"), "section", "text", "ordinal")


def with_offsets(units: DataFrame, doc: str = "source_id") -> DataFrame:
    """doc_start: the lengths of the units before, one sign more for each."""
    w = Window.partitionBy(doc).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("doc_start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long"))


def resolve_spans(spans: DataFrame, units: DataFrame, keys: list[str], expand: int = 0) -> DataFrame:
    """spans (keys, unit_id, start, end) with the text they slice from their unit, widened and clamped."""
    return spans.join(units.select(*keys, "unit_id", F.col("text").alias("unit_text")), [*keys, "unit_id"]).withColumn("slice", slice_expanded(F.col("unit_text"), F.col("start"), F.col("end"), expand)).drop("unit_text")


def place_quotes(quotes: DataFrame, units: DataFrame, doc: str) -> DataFrame:
    """quotes (doc, quote_id, quote) with the first unit that contains each, start and end; nulls where none does."""
    hits = quotes.join(units.select(doc, "unit_id", "ordinal", "text"), doc).where((F.length("quote") > 0) & F.contains("text", "quote"))
    first = hits.groupBy(doc, "quote_id").agg(F.min_by(F.struct("unit_id", find_first(F.col("text"), F.col("quote")).alias("start")), "ordinal").alias("at"))
    return quotes.join(first, [doc, "quote_id"], "left").select(doc, "quote_id", "quote", F.col("at.unit_id").alias("unit_id"), F.col("at.start").alias("start"), (F.col("at.start") + F.length("quote")).alias("end"))


def reanchor(spans: DataFrame, units: DataFrame, doc: str = "source_id") -> DataFrame:
    """spans (doc, span_id, unit_id, start, end, text) against the units of a newer parse.

    No text: unverifiable. The same place still holds it: unchanged. Else by the number of places in the whole document that do (overlaps count):
    one, reanchored there; more, ambiguous; none, lost. Only spans of the same document meet a unit; each unit gives one row with its count."""
    own = units.select(doc, "unit_id", "ordinal", F.col("text").alias("unit_text"))
    same = spans.join(own.drop("ordinal"), [doc, "unit_id"], "left").withColumn("still", F.coalesce(F.substring("unit_text", F.col("start") + 1, F.length("text")) == F.col("text"), F.lit(False)) & (F.length("text") > 0)).drop("unit_text")
    open_ = same.where(~F.col("still") & (F.length("text") > 0)).select(doc, "span_id", "text")
    hits = open_.join(own.withColumnRenamed("unit_id", "new_unit"), doc).where(F.contains("unit_text", "text"))
    hits = hits.select(doc, "span_id", "new_unit", "ordinal", count_occurrences(F.col("unit_text"), F.col("text")).alias("k"), find_first(F.col("unit_text"), F.col("text")).alias("at"))
    found = hits.groupBy(doc, "span_id").agg(F.sum("k").alias("hits"), F.min_by(F.struct("new_unit", "at"), "ordinal").alias("first"))
    both = same.join(found, [doc, "span_id"], "left")
    n = F.coalesce("hits", F.lit(0))
    outcome = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "unverifiable").when(F.col("still"), "unchanged").when(n == 1, "reanchored").when(n > 1, "ambiguous").otherwise("lost")
    moved = outcome == "reanchored"
    return both.select(
        doc, "span_id", outcome.alias("outcome"), F.when(moved, F.col("first.new_unit")).otherwise(F.col("unit_id")).alias("unit_id"), F.when(moved, F.col("first.at")).otherwise(F.col("start")).alias("start"), "text"
    )


def outcome_totals(reanchored: DataFrame) -> DataFrame:
    return reanchored.groupBy("outcome").agg(F.count("*").alias("n"))


def evidence_after(reanchored: DataFrame, doc: str = "source_id") -> DataFrame:
    """Per reference: spans kept, and how many quotes are without a place now (lost ones)."""
    return reanchored.groupBy(doc, "reference_id").agg(F.count_if(F.col("outcome") != "lost").alias("n_spans"), F.count_if(F.col("outcome") == "lost").alias("unlocated"), F.bool_or(~F.col("outcome").isin("unchanged", "unverifiable")).alias("changed"))
