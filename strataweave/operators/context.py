"""Context selection: nine selectors, budgets, ordered fallback, privacy, ranking.

Units: (source_id, unit_id, kind, section, text, ordinal, labels array<string>). Every selector gives requests' units with the
order of its source (seq), so that the first satisfying source is a minimum and no request waits for another."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.errors import EngineError
from strataweave.functions.ids import text_hash_col
from strataweave.functions.text import bm25_part, slice_expanded, tokens
from strataweave.model.recipe import ContextPolicy, Source

UNIT_KINDS = ("title", "heading", "paragraph", "sentence", "section", "table", "figure", "caption", "list", "footnote", "reference", "other")
COLUMNS = ["request_id", "unit_id", "kind", "section", "text", "ordinal", "origin"]
Selector = Callable[[DataFrame, DataFrame, dict, dict], DataFrame]


def in_sections(units: DataFrame, names: list[str]) -> DataFrame:
    return units.where(F.lower("section").isin(*(n.lower() for n in names)))


def of_kinds(units: DataFrame, kinds: list[str]) -> DataFrame:
    if bad := set(kinds) - set(UNIT_KINDS):
        raise EngineError("config_invalid", f"no unit kinds {sorted(bad)}")
    return units.where(F.col("kind").isin(*kinds))


def drop_labelled(units: DataFrame, forbidden: list[str]) -> DataFrame:
    """Without the units that carry a forbidden label."""
    return units.where(~F.coalesce(F.arrays_overlap("labels", F.array(*(F.lit(x) for x in forbidden))), F.lit(False))) if forbidden else units


def bm25(units: DataFrame, queries: DataFrame, doc: str = "source_id", top_k: int = 5, digits: int = 9) -> DataFrame:
    """The top_k units of each document for its query (queries: doc, query): doc, unit_id, ordinal, score, rank.

    Frequencies and average length are of the document's own units; a term asked twice counts twice; only scores above zero; ties in order of the document. Scores are
    rounded before ranking, so that the order doesn't hang on the last bits of a sum."""
    terms = queries.groupBy(doc).agg(F.array_distinct(F.flatten(F.collect_list(tokens(F.col("query"))))).alias("terms"))
    own = units.join(terms, doc).select(doc, "unit_id", "ordinal", tokens(F.col("text")).alias("words"), "terms")
    pool = own.groupBy(doc).agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("average"))
    asked = queries.select(doc, F.explode(tokens(F.col("query"))).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("asked"))
    tf = own.select(doc, "unit_id", "ordinal", F.size("words").alias("length"), F.explode(F.filter("words", lambda w: F.array_contains("terms", w))).alias("term")).groupBy(doc, "unit_id", "ordinal", "length", "term").agg(F.count("*").alias("tf"))
    hit = tf.join(asked, [doc, "term"])  # only words that are asked for are counted
    df = hit.groupBy(doc, "term").agg(F.count("*").alias("df"))
    part = F.col("asked") * bm25_part(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("average"))
    score = hit.join(df, [doc, "term"]).join(pool, doc).groupBy(doc, "unit_id", "ordinal").agg(F.round(F.sum(part), digits).alias("score")).where("score > 0")
    w = Window.partitionBy(doc).orderBy(F.desc("score"), "ordinal")
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def budget_prefix(units: DataFrame, key: list[str], order: list[str], policy: ContextPolicy) -> DataFrame:
    """Units in order up to the first that exceeds a limit, with overflow: whether something was cut. Each running figure only grows, so a filter gives the prefix."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fits = F.lit(True)
    if policy.max_units is not None:
        fits = fits & (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) <= policy.max_units)
    if policy.max_chars is not None:
        fits = fits & (F.sum(F.length("text")).over(w) <= policy.max_chars)
    if policy.max_input_tokens is not None:
        fits = fits & (F.floor(F.sum(F.length("text")).over(w) / policy.chars_per_token + 0.999) <= policy.max_input_tokens)
    if policy.max_sections is not None:
        fits = fits & (F.size(F.collect_set(F.coalesce("section", F.lit(""))).over(w)) <= policy.max_sections)
    marked = units.withColumn("fits", fits)
    return marked.withColumn("overflow", F.bool_or(~F.col("fits")).over(Window.partitionBy(*key))).where("fits").drop("fits")


# selectors: (requests, units, params, inputs) -> COLUMNS. inputs: cells (request_id, field_id, entity, status, value_json, scope), spans (request_id, unit_id, start, end)


def _of_document(requests: DataFrame, units: DataFrame, origin: str) -> DataFrame:
    return requests.select("request_id", "source_id").join(units, "source_id").withColumn("origin", F.lit(origin)).select(*COLUMNS)


def _none(requests, units, params, inputs):
    return _of_document(requests.limit(0), units, "none")


def _structured(requests, units, params, inputs):
    """Read cells as text."""
    c = inputs["cells"]
    place = F.concat("field_id", F.lit("@"), F.when(F.col("entity") == "", "root").otherwise(F.col("entity")))
    text = F.concat("field_id", F.lit(": "), F.coalesce("value_json", F.lit("<no value>")), F.when(F.col("status") != "present", F.concat(F.lit("  [status="), "status", F.lit("]"))).otherwise(""))
    ordinal = F.row_number().over(Window.partitionBy("request_id").orderBy("field_id", "entity"))
    return c.select("request_id", F.concat(F.lit("field:"), place).alias("unit_id"), F.lit("other").alias("kind"), F.lit("").alias("section"), text.alias("text"), ordinal.alias("ordinal"), F.lit("structured_fields").alias("origin"))


def _evidence(name: str, default: int) -> Selector:
    def select(requests, units, params, inputs):
        expand = params.get("expand_chars", params.get("chars", default))
        at = requests.select("request_id", "source_id").join(inputs["spans"], "request_id").join(units, ["source_id", "unit_id"])
        lo, hi = F.greatest(F.lit(0), F.col("start") - expand), F.least(F.length("text"), F.col("end") + expand)
        out = at.select("request_id", F.concat("unit_id", F.lit(":"), lo.cast("string"), F.lit("-"), hi.cast("string")).alias("unit_id"), "kind", "section", slice_expanded(F.col("text"), F.col("start"), F.col("end"), expand).alias("text"), "ordinal", F.lit(name).alias("origin"))
        return out.dropDuplicates(["request_id", "unit_id"])

    return select


def _retrieve(requests, units, params, inputs):
    pool = in_sections(units, params["sections"]) if params.get("sections") else units
    asked = requests.select("request_id", "source_id", F.lit(params["query"]).alias("query")) if "query" in params else requests.select("request_id", "source_id", "query")
    own = asked.select("request_id", "source_id").join(pool, "source_id").drop("source_id")
    best = bm25(own, asked, "request_id", params.get("top_k", 5))
    return own.join(best.select("request_id", "unit_id"), ["request_id", "unit_id"], "left_semi").withColumn("origin", F.lit("retrieve")).select(*COLUMNS)


def _raw(requests, units, params, inputs):
    """The document itself: no text, but the hash of the source where requests carry it (source_hash)."""
    name = F.concat(F.lit("raw:"), "source_id")
    if "source_hash" in requests.columns:
        name = F.concat_ws("@", name, "source_hash")
    return requests.select("request_id", name.alias("unit_id"), F.lit("other").alias("kind"), F.lit("").alias("section"), F.lit("").alias("text"), F.lit(0).alias("ordinal"), F.lit("raw_document").alias("origin"))


SELECTORS: dict[str, Selector] = {
    "none": _none,
    "structured_fields": _structured,
    "prior_evidence": _evidence("prior_evidence", 0),
    "evidence_window": _evidence("evidence_window", 500),
    "sections": lambda r, u, p, i: _of_document(r, in_sections(u, p["names"]), "sections"),
    "unit_kinds": lambda r, u, p, i: _of_document(r, of_kinds(u, p["kinds"]), "unit_kinds"),
    "retrieve": _retrieve,
    "full_document": lambda r, u, p, i: _of_document(r, u, "full_document"),
    "raw_document": _raw,
}


def register_selector(name: str, selector: Selector) -> None:
    SELECTORS[name] = selector


def resolve(requests: DataFrame, units: DataFrame, policy: ContextPolicy, inputs: dict | None = None, allow_billable: bool = False, start_at: int = 0) -> tuple[DataFrame, DataFrame]:
    """(chosen units, one row a request: satisfied, used, reason, tokens).

    Sources are tried in order; the first with enough units within the budget is used, or with accumulate all of them together. Overflow is cut, skipped or a
    failure as the policy says."""
    inputs, parts, tried = inputs or {}, [], []
    visible = drop_labelled(units, list(policy.forbidden_labels))
    for seq, source in enumerate(policy.effective_sequence()):
        if source.selector not in SELECTORS:
            raise EngineError("config_invalid", f"no selector {source.selector!r}")
        tried.append(source.selector)
        if seq < start_at or source.billable and not allow_billable or source.selector in ("full_document", "raw_document") and policy.full_document == "forbidden":
            continue
        found = SELECTORS[source.selector](requests, visible, source.params, inputs)
        enough = F.count("*").over(Window.partitionBy("request_id")) >= source.min_units
        parts.append(found.withColumn("enough", enough).where("enough").drop("enough").withColumn("seq", F.lit(seq)))
    zero = [k for k, s in enumerate(policy.effective_sequence()) if s.min_units == 0 or s.selector == "none"]
    asked = requests.select("request_id")
    if not parts:
        state = asked.withColumn("seq", F.lit(zero[0] if zero else None).cast("int")).withColumn("failed", F.lit(False))
        chosen = _none(requests, units, {}, {}).withColumn("seq", F.lit(0))
    else:
        every = reduce(DataFrame.unionByName, parts)
        if policy.accumulate:
            first = F.row_number().over(Window.partitionBy("request_id", "unit_id").orderBy("seq")) == 1
            every = every.withColumn("first", first).where("first").drop("first").withColumn("source_seq", F.col("seq")).withColumn("seq", F.lit(0))
        else:
            every = every.withColumn("source_seq", F.col("seq"))
        kept = budget_prefix(every, ["request_id", "seq"], ["source_seq", "ordinal", "unit_id"], policy)
        if policy.on_budget == "skip":
            kept = kept.where("NOT overflow")
        per = kept.groupBy("request_id").agg(F.min("seq").alias("seq"), F.min_by("overflow", "seq").alias("overflow"))
        state = asked.join(per, "request_id", "left")
        if zero:
            state = state.withColumn("seq", F.least(F.coalesce("seq", F.lit(zero[0])), F.when(F.lit(not policy.accumulate), F.lit(zero[0])).otherwise(F.col("seq"))))
        state = state.withColumn("failed", F.coalesce("overflow", F.lit(False)) & F.lit(policy.on_budget == "fail")).drop("overflow")
        chosen = kept.join(state.where("NOT failed").select("request_id", "seq"), ["request_id", "seq"], "left_semi").withColumn("seq", F.col("source_seq")).drop("source_seq", "overflow")
    proceed = policy.on_missing == "proceed"
    satisfied = ~F.col("failed") & (F.col("seq").isNotNull() | F.lit(proceed))
    reason = F.when(F.col("failed"), "context_budget_exceeded").when(~satisfied, "context_unavailable: " + ", ".join(tried))
    size = chosen.groupBy("request_id").agg(F.ceil(F.sum(F.length("text")) / policy.chars_per_token).alias("tokens"), F.count("*").alias("n_units"))
    out = state.join(size, "request_id", "left").select("request_id", satisfied.alias("satisfied"), F.col("seq").alias("used"), reason.alias("reason"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"))
    return chosen, out


def context_hash(units: DataFrame, key: str = "request_id") -> DataFrame:
    """Hash of the units' descriptors in order; the texts go in by their own hash."""
    descriptor = F.struct(F.length("text").alias("n_chars"), "kind", "ordinal", "origin", "section", text_hash_col(F.col("text")).alias("unit_hash"), "unit_id")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "unit_id", descriptor.alias("d"))))
    return units.groupBy(key).agg(text_hash_col(F.to_json(F.transform(ordered, lambda x: x["d"]), {"ignoreNullFields": "false"})).alias("context_hash"))


def text_size(units: DataFrame, doc: str = "source_id") -> DataFrame:
    return units.groupBy(doc).agg(F.sum(F.length("text")).alias("n_chars"), F.count("*").alias("n_units"))


def sequence_of(*names: str) -> tuple[Source, ...]:
    return tuple(Source(n) for n in names)

