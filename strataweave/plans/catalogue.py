"""Every registered query over the driver's tables, with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.functions import ids, text
from strataweave.model.recipe import ContextPolicy
from strataweave.model.migration import dump_migrations, load_migrations
from strataweave.model.schema import Constraints, FieldDefinition, Schema
from strataweave.operators import artifacts, calling, context, diffing, documents, evaluation, planning, records, review, running, schema_ops, validation
from strataweave.plans import bed, runs
from strataweave.sources import jsonl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str, *views: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = bed.sql(oracle, *views, recursive=recursive) if views else oracle
        return f

    return add


def long(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


_FILE = """
id: m
from_schema: a@1
to_schema: a@2
steps:
- {id: s1, kind: structural, reads: ["field:a", "vocab:V@1"], writes: ["field:b"], transform: t@1, fidelity: potentially_lossy}
- {id: s2, kind: source_semantic, reads: ["field:a", "evidence:a", "source:parsed"], writes: ["field:c"], recipe: r@1, context: {sequence: [prior_evidence, {sections: [methods]}]}}
- {id: s3, kind: evidence_semantic, reads: ["evidence:a"], writes: ["field:d"], recipe: r@1}
- {id: s4, kind: reextraction, writes: ["field:e"], recipe: r@1, fidelity: destructive}
- {id: s5, kind: vocabulary, reads: ["field:a"], writes: ["field:a"], transform: t@1}
- {id: s6, kind: validation}
"""

# flagship: which cells are current, and what is to be done ------------------------------------------------------------------------


def _expected(spark):
    """Meaning of each field in 1.0 (what cells carry) and 1.1 (what is expected)."""
    old = bed.fields(spark, "order@1.0").select("field_id", F.col("semantic_key").alias("had"))
    new = bed.fields(spark, "order@1.1").select("field_id", F.col("semantic_key").alias("wants"), "required")
    return old, new


def _verdicts(spark, d):
    old, new = _expected(spark)
    cells = bed.cell(spark, d).join(F.broadcast(new), "field_id").join(F.broadcast(old), "field_id", "left")
    carried = F.when(F.col("had").isNotNull(), F.create_map(F.concat(F.lit("field_def:"), "field_id"), F.col("had")))
    cells = cells.withColumns({"hashes": carried, "expected": F.create_map(F.concat(F.lit("field_def:"), "field_id"), F.col("wants")), "accepted": F.lit(False)})
    return planning.currency(cells, recipe=None)


_VERDICT = """+ v AS (SELECT c.*, n.required, CASE WHEN c.status IS NULL THEN 'missing' WHEN c.status = 'extraction_failed' THEN 'failed' WHEN c.status = 'review_required' THEN 'review' WHEN o.semantic_key IS NULL THEN 'no_provenance'
  WHEN o.semantic_key <> n.semantic_key THEN 'stale' ELSE 'current' END AS state, CASE WHEN o.semantic_key IS NULL OR o.semantic_key <> n.semantic_key THEN 'field_def:' || c.field_id ELSE '' END AS keys
  FROM b_cell c JOIN b_field n ON n.field_id = c.field_id AND n.schema_ref = 'order@1.1' LEFT JOIN b_field o ON o.field_id = c.field_id AND o.schema_ref = 'order@1.0') """


@query(_VERDICT + "SELECT CASE state WHEN 'current' THEN 'reuse' WHEN 'review' THEN 'review' WHEN 'missing' THEN 'semantic' WHEN 'failed' THEN 'semantic' ELSE CASE WHEN required THEN 'semantic' ELSE 'deterministic' END END AS disposition, count(*) AS cells, count(DISTINCT record_id) AS records FROM v GROUP BY 1", "b_cell", "b_field")
def plan_summary(spark, d):
    v = _verdicts(spark, d)
    disposition = F.when(F.col("state") == "current", "reuse").when(F.col("state") == "review", "review").when(F.col("state").isin("missing", "failed") | F.col("required"), "semantic").otherwise("deterministic")
    # counts by record first: the distinct count then sees a row a record and disposition
    per = v.groupBy(disposition.alias("disposition"), "record_id").agg(F.count("*").alias("n"))
    return per.groupBy("disposition").agg(F.sum("n").alias("cells"), F.count("*").alias("records"))


@query(_VERDICT + "SELECT field_id, state, count(*) AS n FROM v GROUP BY ALL", "b_cell", "b_field")
def currency_verdicts(spark, d):
    return _verdicts(spark, d).groupBy("field_id", "state").agg(F.count("*").alias("n"))


@query(_VERDICT + "SELECT keys AS stale_key, count(*) AS n FROM v WHERE keys <> '' GROUP BY ALL", "b_cell", "b_field")
def changed_dep_keys(spark, d):
    return _verdicts(spark, d).select(F.explode("stale_keys").alias("stale_key")).groupBy("stale_key").agg(F.count("*").alias("n"))


@query(_VERDICT + "SELECT record_id, entity, field_id, state FROM v WHERE state NOT IN ('current', 'accepted') AND NOT (field_id = 'quantity')", "b_cell", "b_field")
def stale_fields(spark, d):
    v = _verdicts(spark, d)
    target = bed.fields(spark, "order@1.1").select("field_id", F.lit(False).alias("deterministic"))
    planned = v.where("field_id = 'quantity'").select("record_id", "entity", F.array("field_id").alias("writes"))
    return planning.stale_fields(v, target, planned).select("record_id", "entity", "field_id", "state")


@query(_VERDICT + "SELECT record_id, entity, 'stale:' || field_id AS step_id, field_id AS writes, 'review' AS disposition FROM v WHERE state NOT IN ('current', 'accepted') AND field_id <> 'quantity'", "b_cell", "b_field")
def stale_review_steps(spark, d):
    v = _verdicts(spark, d).where("state NOT IN ('current', 'accepted') AND field_id <> 'quantity'")
    return planning.stale_reviews(v, "m").select("record_id", "entity", "step_id", F.array_join("writes", ",").alias("writes"), "disposition")


# scans, store ------------------------------------------------------------------------------------------------------------------------


@query("SELECT record_id, schema_ref, state FROM b_record WHERE schema_ref = 'order@1.1' AND state = 'published' ORDER BY record_id LIMIT 100 OFFSET 50", "b_record")
def index_filter_page(spark, d):
    return artifacts.index_page(bed.record(spark, d), (F.col("schema_ref") == "order@1.1") & (F.col("state") == "published"), limit=100, offset=50).select("record_id", "schema_ref", "state")


@query("SELECT DISTINCT record_id FROM b_log WHERE record_id IN (SELECT record_id FROM b_log WHERE field_id = 'error')", "b_log")
def index_failed_semijoin(spark, d):
    log = bed.log(spark, d)
    return artifacts.index_page(log.select("record_id").distinct(), failed_in=log.where("field_id = 'error'"))


@query("SELECT 'sha256:' || substring(sha256(text), 1, 16) AS artifact_id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def artifact_dedupe(spark, d):
    docs = bed.table(spark, d, "documents").select(ids.text_hash_col(F.col("text")).alias("artifact_id"), "doc_id")
    return artifacts.append_new(None, docs, ["artifact_id"], ["doc_id"]).select("artifact_id", "doc_id")


@query("WITH h AS (SELECT sha256(text) AS k, source FROM documents) SELECT CASE WHEN k IN (SELECT k FROM h WHERE source = 'src0') THEN 'hit' ELSE 'miss' END AS outcome, count(*) AS n FROM h WHERE source <> 'src0' GROUP BY 1")
def cache_hits_misses(spark, d):
    h = bed.table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("k"), "source")
    cache = artifacts.append_new(None, h.where("source = 'src0'").select(F.col("k").alias("cache_key")), ["cache_key"])
    asked = h.where("source <> 'src0'").select(F.col("k").alias("cache_key"))
    return planning.probe(asked, cache).groupBy(F.when(F.col("cached"), "hit").otherwise("miss").alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT sha256(text)) AS entries FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def cache_put(spark, d):
    h = bed.table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("k"), "source")
    return artifacts.append_new(h.where("source = 'src0'").select("k"), h.select("k"), ["k"]).agg(F.count("*").alias("entries"))


@query("SELECT record_id, field_id, arg_max(value, artifact_id) AS value FROM b_log GROUP BY ALL", "b_log")
def upsert_index(spark, d):
    log = bed.log(spark, d).select("record_id", "field_id", "value", "artifact_id")
    old, new = log.where("artifact_id % 2 = 0"), log.where("artifact_id % 2 = 1")
    return artifacts.upsert(old, new, ["record_id", "field_id"], "artifact_id").select("record_id", "field_id", "value")


@query("SELECT * FROM (SELECT CAST(event_id AS VARCHAR) AS execution_id, ts AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)")
def list_executions(spark, d):
    log = bed.table(spark, d, "events").select(F.col("event_id").alias("execution_id"), F.col("ts").alias("created_at"))
    return running.executions(log, 20).select(F.col("execution_id").cast("string").alias("execution_id"), "created_at")


# shred and assemble ------------------------------------------------------------------------------------------------------------------


@query("SELECT record_id, field_id, entity, CASE WHEN value IS NULL OR field_id = 'returnflag' AND value = 'N' THEN 'not_reported' ELSE 'present' END AS status, CASE WHEN field_id IN ('status', 'priority') OR field_id = 'returnflag' AND value <> 'N' THEN value END AS text, CASE WHEN field_id IN ('totalprice', 'quantity', 'discount', 'tax') THEN CAST(value AS DOUBLE) END AS number FROM b_cell", "b_cell")
def decompose_cells(spark, d):
    cells = records.decompose(bed.order_json(spark, d), bed.order_schema())[0]
    number = F.col("field_id").isin("totalprice", "quantity", "discount", "tax")
    text_ = F.from_json(F.concat(F.lit("["), "value_json", F.lit("]")), "array<string>")
    return cells.select("record_id", "field_id", "entity", "status", F.when(~number, F.get(text_, F.lit(0))).alias("text"), F.when(number, F.col("value_json").cast("double")).alias("number"))


def _line_entities(spark, d):
    return records.decompose(bed.order_json(spark, d), bed.order_schema())[1].where("collection_path = 'lines[]'")


@query("SELECT record_id, entity, position FROM b_entity", "b_entity")
def entity_rows(spark, d):
    return _line_entities(spark, d).select("record_id", "entity", "position")


@query("SELECT record_id, entity FROM b_entity WHERE position = -1", "b_entity")
def empty_collections(spark, d):
    return _line_entities(spark, d).where("position = -1").select("record_id", "entity")


def _assembled(spark, d):
    schema = bed.order_schema()
    whole = records.assemble(*records.decompose(bed.order_json(spark, d), schema), schema)
    return whole.select("record_id", F.from_json("record", "status string, priority string, lines array<struct<quantity: double, returnflag: string>>").alias("r"))


@query("SELECT record_id, count(*) FILTER (position >= 0) AS n_lines, coalesce(string_agg(nullif(l_returnflag, 'N'), '' ORDER BY position) FILTER (position >= 0), '') AS flags, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM b_entity GROUP BY 1", "b_entity")
def assemble_orders(spark, d):
    per = _assembled(spark, d).select("record_id", "r.lines")
    quantity = F.aggregate("lines", F.lit(0.0), lambda n, x: n + x["quantity"])
    return per.select("record_id", F.size("lines").cast("long").alias("n_lines"), F.array_join(F.transform("lines", lambda x: x["returnflag"]), "").alias("flags"), F.round(quantity, 2).alias("quantity"))


@query("SELECT record_id, max(CASE WHEN field_id = 'status' THEN value END) AS status, max(CASE WHEN field_id = 'priority' THEN value END) AS priority FROM b_cell WHERE entity = '' GROUP BY 1", "b_cell")
def assemble_root(spark, d):
    return _assembled(spark, d).select("record_id", "r.status", "r.priority")


@query("""SELECT CASE WHEN k % 10 = 0 THEN 'not_reported' WHEN k % 10 = 1 THEN 'unknown' WHEN k % 10 = 2 THEN 'extraction_failed' WHEN k % 10 = 3 THEN 'not_applicable' ELSE 'present' END AS status, count(*) AS n,
  sum(CASE WHEN k % 10 > 3 THEN k END)::BIGINT AS total FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL GROUP BY 1""")
def codec_status(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    e = bed.table(spark, d, "events").select(k.alias("k")).where("k IS NOT NULL")
    state = F.when(F.col("k") % 10 == 2, "failed").when(F.col("k") % 10 == 3, "not_applicable").when(F.col("k") % 10 < 2, "not_reported").otherwise("extracted")
    doc = F.to_json(F.struct(state.alias("extraction_status"), F.col("k").alias("value"), F.when(F.col("k") % 10 == 1, "undetermined").alias("unreported_reason")))
    status, value, _ = records.wrapped_decode(F.parse_json(doc))
    return e.select(status.alias("status"), value.alias("value")).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@query("SELECT entity, count(*) AS n FROM b_entity WHERE position >= 0 GROUP BY 1", "b_entity")
def entity_keys(spark, d):
    return _line_entities(spark, d).where("position >= 0").groupBy("entity").agg(F.count("*").alias("n"))


# latest, history ---------------------------------------------------------------------------------------------------------------------


@query("SELECT record_id, field_id, entity, value, artifact_id FROM b_log QUALIFY row_number() OVER (PARTITION BY record_id, field_id, entity ORDER BY created_at DESC, artifact_id DESC) = 1", "b_log")
def latest_cells(spark, d):
    return artifacts.latest_per_key(bed.log(spark, d), ["record_id", "field_id", "entity"], ["created_at", "artifact_id"]).select("record_id", "field_id", "entity", "value", "artifact_id")


@query("SELECT record_id, artifact_id, row_number() OVER (PARTITION BY record_id ORDER BY created_at DESC, artifact_id DESC) AS rank FROM b_log QUALIFY rank <= 2", "b_log")
def last_two_versions(spark, d):
    return artifacts.last_versions(bed.log(spark, d), ["record_id"], ["created_at", "artifact_id"]).select("record_id", "artifact_id", long("rank").alias("rank"))


@query("SELECT user_id, max('parse@' || event_type) AS parse_version FROM events GROUP BY 1")
def newest_parse(spark, d):
    parses = bed.table(spark, d, "events").select("user_id", F.concat(F.lit("parse@"), "event_type").alias("parse_version"))
    return artifacts.newest_parse(parses.withColumn("x", F.lit(1)), ["user_id"]).select("user_id", "parse_version")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS versions FROM events GROUP BY 1")
def parse_versions(spark, d):
    parses = bed.table(spark, d, "events").select("user_id", F.col("event_type").alias("parse_version"))
    return artifacts.parse_versions(parses, ["user_id"]).select("user_id", F.array_join("versions", ",").alias("versions"))


@query("SELECT record_id, field_id, count(*) AS n, sum(CASE WHEN p IS NULL OR p <> value THEN 1 ELSE 0 END)::BIGINT AS changes FROM (SELECT *, lag(value) OVER (PARTITION BY record_id, field_id ORDER BY created_at, artifact_id) AS p FROM b_log) GROUP BY ALL", "b_log")
def provenance_history(spark, d):
    h = artifacts.history(bed.log(spark, d), ["record_id", "field_id"], ["created_at", "artifact_id"], "value")
    return h.groupBy("record_id", "field_id").agg(F.count("*").alias("n"), F.count_if(F.col("changed")).alias("changes"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events")
def attempt_numbers(spark, d):
    return artifacts.attempt_numbers(bed.table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", long("attempt").alias("attempt"))


# record diff and reports ---------------------------------------------------------------------------------------------------------------


def _first_last(spark, d):
    log = bed.log(spark, d)
    before = log.where("created_at < timestamp '2024-01-16'")
    after = log.where("created_at >= timestamp '2024-01-10'")
    keys, order = ["record_id", "field_id", "entity"], ["created_at", "artifact_id"]
    side = lambda df: artifacts.latest_per_key(df, keys, order).select(*keys, F.when(F.col("artifact_id") % 7 == 0, "not_reported").otherwise("present").alias("status"), F.when(F.col("artifact_id") % 7 != 0, F.col("value")).alias("value"))
    return side(before), side(after)


_DIFF = """+ h AS (SELECT * FROM b_log),
 o AS (SELECT record_id, field_id, entity, CASE WHEN artifact_id % 7 = 0 THEN 'not_reported' ELSE 'present' END AS s, CASE WHEN artifact_id % 7 <> 0 THEN value END AS v FROM h WHERE created_at < timestamp '2024-01-16' QUALIFY row_number() OVER (PARTITION BY record_id, field_id ORDER BY created_at DESC, artifact_id DESC) = 1),
 n AS (SELECT record_id, field_id, entity, CASE WHEN artifact_id % 7 = 0 THEN 'not_reported' ELSE 'present' END AS s, CASE WHEN artifact_id % 7 <> 0 THEN value END AS v FROM h WHERE created_at >= timestamp '2024-01-10' QUALIFY row_number() OVER (PARTITION BY record_id, field_id ORDER BY created_at DESC, artifact_id DESC) = 1),
 x AS (SELECT record_id, field_id, entity, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN o.s <> n.s THEN 'status_changed' WHEN o.v IS DISTINCT FROM n.v THEN 'value_changed' ELSE 'unchanged' END AS kind FROM o FULL JOIN n USING (record_id, field_id, entity)) """


@query(_DIFF + "SELECT * FROM x", "b_log")
def record_diff(spark, d):
    return diffing.diff_records(*_first_last(spark, d)).select("record_id", "field_id", "entity", "kind")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'moved' WHEN doc_id % 7 = 1 THEN 'evidence_changed' ELSE 'unchanged' END AS kind FROM documents")
def record_diff_moves(spark, d):
    """Equal values: a slot with two paths moves, one whose path is missing on a side doesn't; spans that are elsewhere are changed evidence, however many they are."""
    span = lambda at: F.array(F.struct(F.lit("u1").alias("unit_id"), at.alias("start")))
    k = F.col("doc_id") % 7
    side = lambda path, at: bed.table(spark, d, "documents").select(F.col("doc_id"), F.lit("present").alias("status"), F.col("lang").alias("value"), path.alias("path"), span(at).alias("evidence"))
    before = side(F.when(k == 2, F.lit(None)).otherwise(F.lit("a")), F.lit(0))
    after = side(F.when(k == 0, "b").when(k == 3, "").otherwise("a"), F.when(k == 1, 5).otherwise(0))
    return diffing.diff_records(before, after, ["doc_id"]).select("doc_id", "kind")


@query(_DIFF + "SELECT kind, count(*) AS n FROM x GROUP BY 1", "b_log")
def diff_counts(spark, d):
    return diffing.diff_counts(diffing.diff_records(*_first_last(spark, d)))


@query(_DIFF + "SELECT count(*) AS n, count(*) FILTER (kind NOT IN ('unchanged', 'moved')) AS changed, round(count(*) FILTER (kind NOT IN ('unchanged', 'moved')) / count(*), 6) AS rate FROM x", "b_log")
def change_rate(spark, d):
    return diffing.change_rate(diffing.diff_records(*_first_last(spark, d))).withColumn("rate", F.round("rate", 6))


@query(_DIFF + "SELECT field_id, count(*) AS n FROM x WHERE kind NOT IN ('unchanged', 'moved') GROUP BY 1 ORDER BY n DESC, field_id LIMIT 10", "b_log")
def changes_by_field(spark, d):
    return diffing.changes_by_field(diffing.diff_records(*_first_last(spark, d)))


@query("SELECT field_id, count(*) AS n, count(*) FILTER (status = 'present') AS present, round(count(*) FILTER (status = 'present') / count(*), 6) AS coverage FROM b_cell GROUP BY 1", "b_cell")
def coverage_by_field(spark, d):
    return diffing.coverage(bed.cell(spark, d))


@query("SELECT status, count(*) AS n FROM b_cell GROUP BY 1", "b_cell")
def status_histogram(spark, d):
    return diffing.status_histogram(bed.cell(spark, d))


# schema ------------------------------------------------------------------------------------------------------------------------------


_SCHEMA = """+ p AS (SELECT field_id, o.path AS op, n.path AS np, o.collection AS oc, n.collection AS nc, o.base_type AS ot, n.base_type AS nt, o.multivalued AS om, n.multivalued AS nm, o.required AS oq, n.required AS nq, o.enum AS oe, n.enum AS ne, o.minimum AS o1, n.minimum AS n1, o.maximum AS o2, n.maximum AS n2
 FROM (SELECT * FROM b_field WHERE schema_ref = 'order@1.0') o FULL JOIN (SELECT * FROM b_field WHERE schema_ref = 'order@1.1') n USING (field_id)),
 k AS (SELECT field_id, unnest([CASE WHEN op IS NULL THEN 'added' END, CASE WHEN np IS NULL THEN 'removed' END, CASE WHEN op <> np THEN CASE WHEN oc <> nc THEN 'nesting_changed' ELSE 'renamed' END END, CASE WHEN ot <> nt THEN 'type_changed' END, CASE WHEN om <> nm THEN 'cardinality_changed' END,
  CASE WHEN oq <> nq THEN 'requiredness_changed' END,
  CASE WHEN op IS NOT NULL AND np IS NOT NULL AND (len(list_filter(oe, lambda v: NOT list_contains(ne, v))) > 0 OR coalesce(n1 > o1 OR (o1 IS NULL AND n1 IS NOT NULL), false) OR coalesce(n2 < o2 OR (o2 IS NULL AND n2 IS NOT NULL), false)) THEN 'constraint_narrowed' END,
  CASE WHEN op IS NOT NULL AND np IS NOT NULL AND ((len(list_filter(oe, lambda v: NOT list_contains(ne, v))) = 0 AND len(list_filter(ne, lambda v: NOT list_contains(oe, v))) > 0) OR coalesce(n1 < o1 OR (n1 IS NULL AND o1 IS NOT NULL), false) OR coalesce(n2 > o2 OR (n2 IS NULL AND o2 IS NOT NULL), false)) THEN 'constraint_widened' END]) AS kind FROM p) """


@query(_SCHEMA + "SELECT field_id, kind FROM k WHERE kind IS NOT NULL", "b_field")
def schema_diff(spark, d):
    return schema_ops.diff_fields(bed.fields(spark, "order@1.0"), bed.fields(spark, "order@1.1")).select("field_id", "kind").distinct()


_EVERY_KIND = [
    ("a", "type_changed", "base_type"), ("b", "description_changed", "description"), ("c", "recipe_changed", "recipe_ref"), ("d", "vocabulary_changed", "vocabulary_ref"), ("e", "constraint_narrowed", "open"), ("f", "constraint_widened", "max_length"),
    ("g", "constraint_narrowed", "pattern"), ("h", "constraint_narrowed", "min_items"), ("i", "nesting_changed", "path"), ("k2", "renamed", "path"), ("l", "removed", ""), ("m", "added", ""), ("n", "cardinality_changed", "multivalued"), ("n", "requiredness_changed", "required"),
    ("o", "constraint_widened", "enum"), ("x[]", "collection_removed", ""), ("y[]", "collection_added", ""), ("y[].z[]", "collection_added", ""),
]


@query(f"SELECT * FROM ({bed._values(_EVERY_KIND)}) t(field_id, kind, detail)")
def schema_diff_kinds(spark, d):
    """Every kind of change, with an explicit rename."""
    old = Schema("s", "1", (
        FieldDefinition("a"), FieldDefinition("b", description="one  two"), FieldDefinition("c", recipe_ref="r@1"), FieldDefinition("d", constraints=Constraints(vocabulary_ref="V@1")), FieldDefinition("e", constraints=Constraints(enum=("p",), open_vocabulary=True)),
        FieldDefinition("f", constraints=Constraints(max_length=3)), FieldDefinition("g"), FieldDefinition("h", constraints=Constraints(min_items=1)), FieldDefinition("x[].i", field_id="i"), FieldDefinition("k"), FieldDefinition("l"), FieldDefinition("n"), FieldDefinition("o", constraints=Constraints(enum=("p",))), FieldDefinition("same", description="one\ntwo"),
    ))
    new = Schema("s", "2", (
        FieldDefinition("a", "integer"), FieldDefinition("b", description="one three"), FieldDefinition("c", recipe_ref="r@2"), FieldDefinition("d", constraints=Constraints(vocabulary_ref="V@2")), FieldDefinition("e", constraints=Constraints(enum=("p",))),
        FieldDefinition("f", constraints=Constraints(max_length=9)), FieldDefinition("g", constraints=Constraints(pattern="x")), FieldDefinition("h", constraints=Constraints(min_items=2)), FieldDefinition("y[].z[].i", field_id="i"), FieldDefinition("kk", field_id="k2"), FieldDefinition("m"), FieldDefinition("n", multivalued=True, required=True), FieldDefinition("o", constraints=Constraints(enum=("p", "q"))), FieldDefinition("same", description="one two"),
    ))
    a, b = old.frame(spark), new.frame(spark)
    return schema_ops.diff_fields(a, b, renames={"k": "k2"}).unionByName(schema_ops.diff_collections(a, b).select(F.col("collection").alias("field_id"), "kind", F.lit("").alias("detail")))


@query(_SCHEMA + """SELECT coalesce(bool_and(kind NOT IN ('added', 'removed', 'renamed', 'nesting_changed', 'type_changed', 'cardinality_changed', 'requiredness_changed')), true) AS shape, coalesce(bool_and(kind NOT IN ('type_changed', 'cardinality_changed', 'constraint_narrowed', 'removed')), true) AS values,
 coalesce(bool_and(kind NOT IN ('description_changed', 'recipe_changed', 'vocabulary_changed', 'added', 'constraint_narrowed', 'constraint_widened')), true) AS semantics FROM k WHERE kind IS NOT NULL""", "b_field")
def compat_verdicts(spark, d):
    return schema_ops.verdicts(schema_ops.diff_fields(bed.fields(spark, "order@1.0"), bed.fields(spark, "order@1.1")))


@query("SELECT field_id, array_to_string(list_sort(list_filter(o.enum, lambda v: NOT list_contains(n.enum, v))), ',') AS removed, array_to_string(list_sort(list_filter(n.enum, lambda v: NOT list_contains(o.enum, v))), ',') AS added FROM (SELECT * FROM b_field WHERE schema_ref = 'order@1.0') o JOIN (SELECT * FROM b_field WHERE schema_ref = 'order@1.1') n USING (field_id) WHERE removed <> '' OR added <> ''", "b_field")
def enum_delta(spark, d):
    out = schema_ops.enum_delta(bed.fields(spark, "order@1.0"), bed.fields(spark, "order@1.1"))
    return out.select("field_id", F.array_join("removed", ",").alias("removed"), F.array_join("added", ",").alias("added"))


_WALK = """+ walk(node, seen, path, hops, worst, semantic, steps) AS (SELECT dst, [src, dst], migration_id, 1, fidelity, semantic, steps FROM b_edge WHERE src = 'order@1.0'
 UNION ALL SELECT e.dst, list_append(w.seen, e.dst), w.path || '>' || e.migration_id, w.hops + 1, greatest(w.worst, e.fidelity), w.semantic + e.semantic, w.steps + e.steps FROM walk w JOIN b_edge e ON e.src = w.node WHERE NOT list_contains(w.seen, e.dst)) """


@query(_WALK + "SELECT path, hops, worst, semantic, steps FROM walk WHERE node = 'order@2.0'", "b_edge", recursive=True)
def migration_paths(spark, d):
    return schema_ops.migration_paths(spark, bed.edges(spark), "order@1.0", "order@2.0")


@query(_WALK + "SELECT * FROM (SELECT 'fidelity' AS preference, path, hops FROM walk WHERE node = 'order@2.0' ORDER BY worst, semantic, hops, path LIMIT 1) UNION ALL SELECT * FROM (SELECT 'cost', path, hops FROM walk WHERE node = 'order@2.0' ORDER BY semantic, worst, hops, path LIMIT 1) UNION ALL SELECT * FROM (SELECT 'latency', path, hops FROM walk WHERE node = 'order@2.0' ORDER BY steps, hops, path LIMIT 1) UNION ALL SELECT * FROM (SELECT 'hops', path, hops FROM walk WHERE node = 'order@2.0' ORDER BY hops, worst, semantic, path LIMIT 1)", "b_edge", recursive=True)
def best_path(spark, d):
    paths = migration_paths(spark, d)
    parts = [schema_ops.best_path(paths, p).select(F.lit(p).alias("preference"), "path", "hops") for p in ("fidelity", "cost", "latency", "hops")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("WITH RECURSIVE e AS (SELECT 'v' || range AS src, 'v' || range + 1 AS dst, 'm' || range AS id, range % 2 AS fidelity FROM range(20) UNION ALL SELECT 'v' || range, 'v' || range + 2, 'skip' || range, 2 FROM range(0, 20, 5)), walk(node, path, hops, worst) AS (SELECT dst, id, 1, fidelity FROM e WHERE src = 'v0' UNION ALL SELECT e.dst, w.path || '>' || e.id, w.hops + 1, greatest(w.worst, e.fidelity) FROM walk w JOIN e ON e.src = w.node) SELECT path, hops, worst::BIGINT AS worst FROM walk WHERE node = 'v20'")
def long_paths(spark, d):
    """Paths of up to twenty hops over a chain with shortcuts."""
    chain = spark.range(20).select(F.col("id").alias("k"), F.lit(1).alias("by"), F.concat(F.lit("m"), "id").alias("migration_id"), (F.col("id") % 2).alias("fidelity"))
    skips = spark.range(0, 20, 5).select(F.col("id").alias("k"), F.lit(2).alias("by"), F.concat(F.lit("skip"), "id").alias("migration_id"), F.lit(2).cast("long").alias("fidelity"))
    edges = chain.unionByName(skips).select(F.concat(F.lit("v"), "k").alias("src"), F.concat(F.lit("v"), F.col("k") + F.col("by")).alias("dst"), "migration_id", "fidelity", F.lit(0).alias("semantic"), F.lit(1).alias("steps"))
    return schema_ops.migration_paths(spark, edges, "v0", "v20").select("path", "hops", "worst")


@query(_WALK + "SELECT node AS version, min(hops) AS hops FROM walk GROUP BY 1", "b_edge", recursive=True)
def reachable(spark, d):
    return schema_ops.reachable(spark, bed.edges(spark), "order@1.0")


# planning ----------------------------------------------------------------------------------------------------------------------------


def _planned(spark, d):
    roots = bed.record(spark, d, bed.tasks(spark, d)).select("record_id", F.lit("").alias("entity"), F.lit("").alias("scope"))
    entities = bed.entity(spark, d).where("position >= 0").select("record_id", "entity", F.lit("lines[]").alias("scope")).unionByName(roots)
    planned = entities.join(F.broadcast(bed.steps(spark)), "scope")
    return planned.withColumn("step_key", F.concat_ws("|", "record_id", "step_id", "entity")).withColumn("required_reads", F.col("reads"))


def _plannable(spark, d):
    """(index, entities, steps): every step of STEPS from both versions; s1 copies, s2 derives, s3 asks, s4 lacks a read that it needs."""
    index = bed.record(spark, d, bed.tasks(spark, d)).select("record_id", "schema_ref")
    entities = bed.entity(spark, d).select("record_id", "entity", F.lit("lines[]").alias("collection_path")).unionByName(index.select("record_id", F.lit("").alias("entity"), F.lit("").alias("collection_path")))
    kinds = {"s1": "copy", "s2": "derive", "s3": "document_semantic", "s4": "derive"}
    rows = [(ref, 0, int(s == "s2"), "m", s, kinds[s], scope, writes, reads, [r for r in reads if r == "missing_field"], {f"field_def:{w}": "h1" for w in writes}, "r@1" if s == "s3" else None, "order@2.0", True, 4.0, 250, True, ["status", "quantity", "returnflag", "priority"], {"s1": 0, "s2": 1, "s3": 0, "s4": 2}[s], "main" if s == "s3" else None, 0 if s == "s3" else None) for ref in ("order@1.0", "order@1.1") for s, scope, reads, writes in bed.STEPS]
    return index, entities, spark.createDataFrame(rows, planning.STEP_ROW)


_PLANNED = """+ pl AS (SELECT record_id, entity, step_id, reads, writes, record_id || '|' || step_id || '|' || entity AS step_key FROM (SELECT record_id, entity, 'lines[]' AS scope FROM b_entity WHERE position >= 0 UNION ALL SELECT record_id, '', '' FROM b_record) JOIN b_step USING (scope)) """


@query(_PLANNED + "SELECT step_id, count(*) AS n, count(DISTINCT record_id) AS records FROM pl GROUP BY 1", "b_record", "b_entity", "b_step")
def step_expansion(spark, d):
    # counts by record first, as in plan_summary
    per = planning.expand(*_plannable(spark, d)).groupBy("step_id", "record_id").agg(F.count("*").alias("n"))
    return per.groupBy("step_id").agg(F.sum("n").alias("n"), F.count("*").alias("records"))


_READS = _PLANNED + """, rd AS (SELECT step_key, step_id, field_id, coalesce(c.status, r.status) AS status, CASE WHEN c.status IS NOT NULL THEN w.entity WHEN r.status IS NOT NULL THEN '' END AS found_at FROM (SELECT *, unnest(reads) AS field_id FROM pl) w
 LEFT JOIN b_cell c USING (record_id, entity, field_id) LEFT JOIN (SELECT record_id, field_id, status FROM b_cell WHERE entity = '') r USING (record_id, field_id)) """


@query(_READS + "SELECT step_id, field_id, CASE WHEN found_at IS NULL THEN 'nowhere' WHEN found_at = '' THEN 'root' ELSE 'entity' END AS place, count(*) AS n FROM rd GROUP BY ALL", "b_record", "b_entity", "b_cell", "b_step")
def reads_with_root_fallback(spark, d):
    planned = _planned(spark, d)
    reads = planning.read_cells(planned, bed.cell(spark, d).withColumn("value_hash", F.col("value"))).withColumn("step_id", F.split_part("step_key", F.lit("|"), F.lit(2)))
    place = F.when(F.col("found_at").isNull(), "nowhere").when(F.col("found_at") == "", "root").otherwise("entity")
    return reads.groupBy("step_id", "field_id", place.alias("place")).agg(F.count("*").alias("n"))


@query(_READS + "SELECT step_key, string_agg(field_id, ',' ORDER BY field_id) AS missing FROM rd WHERE status IS NULL OR status IN ('not_extracted', 'extraction_failed') GROUP BY 1", "b_record", "b_entity", "b_cell", "b_step")
def missing_required_reads(spark, d):
    planned = _planned(spark, d)
    return planning.missing_reads(planned, bed.cell(spark, d).withColumn("value_hash", F.col("value"))).select("step_key", F.array_join("missing", ",").alias("missing"))


@query("SELECT section, count(*) AS calls, sum(CAST(floor(length(text) / 4.0 + 0.999) AS BIGINT))::BIGINT AS tokens_in, round(sum(round((floor(length(text) / 4.0 + 0.999) * 3.0 + 250 * 15.0) / 1e6, 8)), 6) AS usd FROM b_unit GROUP BY 1", "b_unit")
def plan_cost(spark, d):
    tokens = text.tokens_for_budget(F.length("text"))
    each = bed.unit(spark, d).select("section", tokens.alias("t"), F.round(text.price(tokens, F.lit(250), F.lit(3.0), F.lit(15.0)), 8).alias("usd"))
    return each.groupBy("section").agg(F.count("*").alias("calls"), F.sum("t").alias("tokens_in"), F.round(F.sum("usd"), 6).alias("usd"))


@query(_PLANNED + """, k AS (SELECT *, CAST(substring(record_id, 5) AS BIGINT) AS o FROM pl) SELECT CASE WHEN step_id = 's1' AND o % 2 = 0 OR step_id = 's3' AND o % 4 = 0 THEN 'reuse' WHEN step_id = 's4' THEN 'blocked' WHEN step_id = 's3' THEN 'semantic' ELSE 'deterministic' END AS disposition,
 count(*) AS steps, sum(len(writes))::BIGINT AS field_writes, sum(CASE WHEN step_id = 's3' AND o % 4 <> 0 THEN 250 ELSE 0 END)::BIGINT AS tokens_out, count(DISTINCT record_id) AS records FROM k GROUP BY 1""", "b_record", "b_entity", "b_step")
def plan_by_disposition(spark, d):
    """Of s1 every second value is current by its hashes; of s3 every fourth was accepted under the recipe that is asked for, as many under another."""
    o = F.substring("record_id", 5, 20).cast("long")
    flag = F.col("field_id") == "returnflag"
    hashes = F.when(F.col("field_id") == "status", F.create_map(F.lit("field_def:status"), F.when(o % 2 == 0, "h1").otherwise("h0")))
    cells = bed.cell(spark, d).withColumns({"value_hash": F.col("value"), "hashes": hashes, "accepted": flag & (o % 4 < 2), "recipe_ref": F.when(flag, F.when(o % 4 == 0, "r@1").otherwise("r@0"))})
    index, entities, steps = _plannable(spark, d)
    return planning.summary(planning.plan(index, entities, cells, steps)).select("disposition", "steps", "field_writes", "tokens_out", "records")


_TOTALS = _PLANNED + ", k AS (SELECT *, CAST(substring(record_id, 5) AS BIGINT) AS o FROM pl) "


def _plan(spark, d):
    o, flag = F.substring("record_id", 5, 20).cast("long"), F.col("field_id") == "returnflag"
    cells = bed.cell(spark, d).withColumns({"value_hash": F.col("value"), "hashes": F.lit(None).cast("map<string,string>"), "accepted": flag & (o % 4 == 0), "recipe_ref": F.when(flag, "r@1")})
    index, entities, steps = _plannable(spark, d)
    return planning.plan(index, entities, cells, steps, prices=(3.0, 15.0))


@query(_TOTALS + "SELECT count(DISTINCT record_id) AS n_records, count(*) AS n_steps, count(*) FILTER (step_id = 's3' AND o % 4 <> 0) AS calls, 0::BIGINT AS cached, round(count(*) FILTER (step_id = 's3' AND o % 4 <> 0) * 250 * 15.0 / 1e6, 6) AS usd, count(DISTINCT record_id) FILTER (step_id = 's3' AND o % 4 <> 0) AS touching_source, count(DISTINCT record_id) FILTER (step_id = 's4') AS blocked_records, 0::BIGINT AS tokens_in, count(*) FILTER (step_id = 's3' AND o % 4 <> 0) * 250 AS tokens_out, 0::BIGINT AS full_documents, 'destructive' AS worst_fidelity FROM k", "b_record", "b_entity", "b_step")
def plan_totals(spark, d):
    return planning.totals(_plan(spark, d))


@query(_TOTALS + "SELECT 'main' AS model, count(*) AS calls FROM k WHERE step_id = 's3' AND o % 4 <> 0 HAVING count(*) > 0", "b_record", "b_entity", "b_step")
def plan_models(spark, d):
    return planning.models(_plan(spark, d))


@query(_TOTALS + "SELECT 'missing_dependency' AS reason, count(*) AS steps FROM k WHERE step_id = 's4' HAVING count(*) > 0", "b_record", "b_entity", "b_step")
def plan_blocked_reasons(spark, d):
    return planning.blocked_reasons(_plan(spark, d))


@query(_TOTALS + "SELECT record_id, count(*) FILTER (step_id IN ('s1', 's2') OR step_id = 's3' AND o % 4 <> 0) AS n FROM k GROUP BY 1", "b_record", "b_entity", "b_step")
def plan_validation_steps(spark, d):
    """One validation step a record, after all that runs."""
    return planning.validation_steps(_plan(spark, d)).select("record_id", long(F.size("depends_on")).alias("n"))


@query("SELECT * FROM (VALUES ('s1', 'structural', true, false, false, 'potentially_lossy', 'a', 'b', 'V@1', ''), ('s2', 'source_semantic', false, true, true, 'lossless', 'a', 'c', '', 'evidence:a,source:parsed'), ('s3', 'evidence_semantic', false, true, false, 'lossless', '', 'd', '', 'evidence:a'), ('s4', 'reextraction', false, true, true, 'destructive', '', 'e', '', ''), ('s5', 'vocabulary', true, false, false, 'lossless', 'a', 'a', '', ''), ('s6', 'validation', false, false, false, 'lossless', '', '', '', '')) t(step_id, kind, deterministic, semantic, touches_source, fidelity, reads, writes, vocabularies, refs)")
def migration_file_steps(spark, d):
    """A migration file, loaded, written and loaded again."""
    found = load_migrations(dump_migrations(load_migrations(_FILE)))
    rows = [(s.step_id, s.kind, s.deterministic, s.semantic, s.touches_source, s.fidelity, *(",".join(x) for x in (s.reads, s.writes, s.vocabularies, s.refs))) for m in found for s in m.steps]
    return spark.createDataFrame(rows, "step_id string, kind string, deterministic boolean, semantic boolean, touches_source boolean, fidelity string, reads string, writes string, vocabularies string, refs string")


@query("SELECT state, keys, count(*) AS n FROM (SELECT CASE WHEN k IN (0, 1) THEN 'accepted' WHEN k = 2 THEN 'no_provenance' WHEN k IN (3, 4) THEN 'stale' WHEN k = 5 THEN 'current' WHEN k = 6 THEN 'failed' ELSE 'review' END AS state, CASE WHEN k = 2 THEN 'field_def:f' WHEN k = 3 THEN 'field_def:f' WHEN k = 4 THEN 'recipe_ref' WHEN k IN (6, 7) THEN 'field_def:f' WHEN k IN (0, 1) THEN 'field_def:f' ELSE '' END AS keys FROM (SELECT doc_id % 8 AS k FROM documents)) GROUP BY ALL")
def currency_states(spark, d):
    """Every state of a cell but missing: accepted under the recipe or before there was one, accepted under another one and without provenance, stale by key and by recipe."""
    k = F.col("doc_id") % 8
    right, other = (F.create_map(F.lit("field_def:f"), F.lit(h)) for h in ("h1", "h0"))
    hashes = F.when(k.isin(4, 5), right).when(k == 3, other)
    cells = bed.table(spark, d, "documents").select(
        F.when(k == 6, "extraction_failed").when(k == 7, "review_required").otherwise("not_extracted").alias("status"), k.isin(0, 1, 2).alias("accepted"), hashes.alias("hashes"), right.alias("expected"),
        F.when(k.isin(2, 4), "r@0").when(k != 1, "r@1").alias("recipe_ref"), F.lit("r@1").alias("expected_recipe"),
    )
    return planning.currency(cells).groupBy("state", F.array_join("stale_keys", ",").alias("keys")).agg(F.count("*").alias("n"))


# documents and context -----------------------------------------------------------------------------------------------------------------


@query("SELECT source_id, unit_id, length(text) AS n_chars FROM b_unit WHERE lower(section) IN ('abstract', 'methods')", "b_unit")
def sections_select(spark, d):
    return context.in_sections(bed.unit(spark, d), ["Abstract", "METHODS"]).select("source_id", "unit_id", long(F.length("text")).alias("n_chars"))


@query("SELECT kind, section, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM b_unit GROUP BY ALL", "b_unit")
def unit_kind_counts(spark, d):
    return context.of_kinds(bed.unit(spark, d), ["title", "paragraph"]).groupBy("kind", "section").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT source_id, unit_id, coalesce(sum(length(text) + 1) OVER (PARTITION BY source_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS doc_start FROM b_unit", "b_unit")
def unit_offsets(spark, d):
    return documents.with_offsets(bed.unit(spark, d)).select("source_id", "unit_id", "doc_start")


@query("SELECT source_id, unit_id, len(s) AS n, coalesce(s[1], '') AS first FROM (SELECT *, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM b_unit)", "b_unit")
def sentence_split(spark, d):
    s = text.sentences(F.col("text"))
    return bed.unit(spark, d).select("source_id", "unit_id", long(F.size(s)).alias("n"), F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("first"))


_BM25 = """+ w AS (SELECT source_id, unit_id, ordinal, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM b_unit), pool AS (SELECT source_id, count(*) AS n, avg(len(t)) AS a FROM w GROUP BY 1),
 tf AS (SELECT source_id, unit_id, ordinal, len(t) AS l, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM w) WHERE term IN ('the', 'of', 'and') GROUP BY ALL), df AS (SELECT source_id, term, count(*) AS df FROM tf GROUP BY ALL),
 sc AS (SELECT source_id, unit_id, ordinal, round(sum((CASE WHEN term = 'the' THEN 2 ELSE 1 END) * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 9) AS score FROM tf JOIN df USING (source_id, term) JOIN pool USING (source_id) GROUP BY ALL) """


@query(_BM25 + """SELECT source_id, unit_id, round(score, 6) AS score, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, ordinal) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 3""", "b_unit")
def bm25_topk(spark, d):
    units = bed.unit(spark, d)
    asked = units.select("source_id").distinct().withColumn("query", F.lit("The of the and"))
    return context.bm25(units, asked, "source_id", 3).select("source_id", "unit_id", F.round("score", 6).alias("score"), long("rank").alias("rank"))


def _prefix(spark, d, **limits):
    out = context.budget_prefix(bed.unit(spark, d), ["source_id"], ["ordinal"], ContextPolicy(**limits))
    return out.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT source_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM (SELECT *, sum(length(text)) OVER (PARTITION BY source_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS r FROM b_unit) WHERE r <= 600 GROUP BY 1", "b_unit")
def budget_prefix_chars(spark, d):
    return _prefix(spark, d, max_chars=600)


@query("SELECT source_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) AS r FROM b_unit) WHERE r <= 3 GROUP BY 1", "b_unit")
def budget_prefix_units(spark, d):
    return _prefix(spark, d, max_units=3)


@query("SELECT source_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM (SELECT *, count(DISTINCT section) OVER (PARTITION BY source_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS r FROM b_unit) WHERE r <= 2 GROUP BY 1", "b_unit")
def budget_prefix_sections(spark, d):
    return _prefix(spark, d, max_sections=2)


@query("SELECT source_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM (SELECT *, sum(length(text)) OVER (PARTITION BY source_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS r FROM b_unit) WHERE floor(r / 4.0 + 0.999) <= 200 GROUP BY 1", "b_unit")
def budget_prefix_tokens(spark, d):
    return _prefix(spark, d, max_input_tokens=200)


def _requests(spark, d):
    return bed.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("request_id"), F.col("doc_id").alias("source_id"))


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS request_id, CASE WHEN sum(CASE WHEN section = 'results' THEN 1 ELSE 0 END) >= 2 THEN 0 WHEN sum(CASE WHEN section = 'methods' THEN 1 ELSE 0 END) >= 1 THEN 1 WHEN count(unit_id) >= 1 THEN 2 END AS used FROM (SELECT doc_id FROM documents) d LEFT JOIN b_unit ON source_id = doc_id GROUP BY d.doc_id""", "b_unit")
def fallback_chain(spark, d):
    from strataweave.model.recipe import Source

    policy = ContextPolicy(sequence=(Source("sections", {"names": ["results"]}, 2), Source("sections", {"names": ["methods"]})), full_document="allowed")
    return context.resolve(_requests(spark, d), bed.unit(spark, d), policy)[1].select("request_id", "used")


@query("SELECT record_id AS request_id, 'field:' || field_id || '@' || CASE WHEN entity = '' THEN 'root' ELSE entity END AS unit_id, field_id || ': ' || coalesce(value, '<no value>') || CASE WHEN status <> 'present' THEN '  [status=' || status || ']' ELSE '' END AS text, row_number() OVER (PARTITION BY record_id ORDER BY field_id, entity) AS ordinal FROM b_cell", "b_cell")
def select_cells(spark, d):
    cells = bed.cell(spark, d).select(F.col("record_id").alias("request_id"), "field_id", "entity", "status", F.col("value").alias("value_json"))
    return context.SELECTORS["structured_fields"](None, None, {}, {"cells": cells}).select("request_id", "unit_id", "text", long("ordinal").alias("ordinal"))


def _selected(spark, d, name, **params):
    spans = bed.unit(spark, d).select(F.col("source_id").cast("string").alias("request_id"), "unit_id", F.lit(5).alias("start"), F.lit(25).alias("end"))
    asked = _requests(spark, d).join(bed.table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), ids.text_hash_col(F.col("text")).alias("source_hash")), "source_id")
    return context.SELECTORS[name](asked, bed.unit(spark, d), params, {"spans": spans})


@query("SELECT CAST(source_id AS VARCHAR) AS request_id, unit_id || ':5-' || least(length(text), 25) AS unit_id, substring(text, 6, greatest(least(length(text), 25) - 5, 0)) AS text FROM b_unit", "b_unit")
def select_evidence(spark, d):
    return _selected(spark, d, "prior_evidence").select("request_id", "unit_id", "text")


@query("SELECT CAST(source_id AS VARCHAR) AS request_id, unit_id || ':0-' || least(length(text), 35) AS unit_id, substring(text, 1, 35) AS text FROM b_unit", "b_unit")
def select_window(spark, d):
    return _selected(spark, d, "evidence_window", chars=10).select("request_id", "unit_id", "text")


@query(_BM25 + "SELECT CAST(source_id AS VARCHAR) AS request_id, unit_id FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, ordinal) <= 3", "b_unit")
def select_retrieved(spark, d):
    return _selected(spark, d, "retrieve", query="The of the and", top_k=3).select("request_id", "unit_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS request_id, 'raw:' || doc_id || '@sha256:' || substring(sha256(text), 1, 16) AS unit_id, '' AS text FROM documents")
def select_raw(spark, d):
    return _selected(spark, d, "raw_document").select("request_id", "unit_id", "text")


@query("SELECT CAST(source_id AS VARCHAR) AS request_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM b_unit GROUP BY 1", "b_unit")
def select_whole(spark, d):
    both = _selected(spark, d, "full_document").unionByName(_selected(spark, d, "none"))
    return both.groupBy("request_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


_SPAN = """+ sp AS (SELECT source_id, unit_id, CAST(5 AS INTEGER) AS s, CAST(25 AS INTEGER) AS e, text FROM b_unit) """


def _spans(spark, d):
    return bed.unit(spark, d).select("source_id", "unit_id", F.lit(5).alias("start"), F.lit(25).alias("end"))


@query(_SPAN + "SELECT source_id, unit_id, substring(text, 6, 20) AS slice FROM sp", "b_unit")
def evidence_slices(spark, d):
    return documents.resolve_spans(_spans(spark, d), bed.unit(spark, d), ["source_id"]).select("source_id", "unit_id", "slice")


@query(_SPAN + "SELECT source_id, unit_id, substring(text, 1, 25 + 50) AS slice FROM sp", "b_unit")
def evidence_window(spark, d):
    return documents.resolve_spans(_spans(spark, d), bed.unit(spark, d), ["source_id"], expand=50).select("source_id", "unit_id", "slice")


@query("SELECT source_id, count(*) AS n FROM b_unit WHERE NOT list_has_any(labels, ['mail', 'number']) GROUP BY 1", "b_unit")
def privacy_drop(spark, d):
    return context.drop_labelled(bed.unit(spark, d), ["mail", "number"]).groupBy("source_id").agg(F.count("*").alias("n"))


@query("""SELECT source_id, 'sha256:' || substring(sha256('[' || string_agg('{"n_chars":' || length(text) || ',"kind":"' || kind || '","ordinal":' || ordinal || ',"origin":"full","section":"' || section || '","unit_hash":"sha256:' || substring(sha256(text), 1, 16) || '","unit_id":"' || unit_id || '"}', ',' ORDER BY ordinal) || ']'), 1, 16) AS context_hash FROM b_unit GROUP BY 1""", "b_unit")
def context_hash(spark, d):
    return context.context_hash(bed.unit(spark, d).withColumn("origin", F.lit("full")), "source_id")


@query("SELECT source_id, sum(length(text))::BIGINT AS n_chars, count(*) AS n_units FROM b_unit GROUP BY 1", "b_unit")
def text_size(spark, d):
    return context.text_size(bed.unit(spark, d))


# evidence: a stored span is the beginning of a unit, the new parse are sentences ----------------------------------------------------------------

_SENTENCES = """+ se AS (SELECT source_id, 'n:' || row_number() OVER (PARTITION BY source_id ORDER BY ordinal, k) AS unit_id, row_number() OVER (PARTITION BY source_id ORDER BY ordinal, k) AS ordinal, t FROM (
 SELECT source_id, ordinal, unnest(s) AS t, generate_subscripts(s, 1) AS k FROM (SELECT source_id, ordinal, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM b_unit))),
 q AS (SELECT source_id, unit_id AS span_id, substring(text, 1, 30) AS x FROM b_unit),
 hit AS (SELECT source_id, span_id, se.unit_id, ordinal, len(list_filter(range(1, greatest(length(t) - length(x) + 2, 1)), lambda i: substring(t, i, length(x)) = x)) AS k, position(x IN t) - 1 AS pos FROM q JOIN se USING (source_id) WHERE contains(t, x)),
 o AS (SELECT q.source_id, q.span_id, CASE WHEN coalesce(sum(k), 0) = 1 THEN 'reanchored' WHEN sum(k) > 1 THEN 'ambiguous' ELSE 'lost' END AS outcome FROM q LEFT JOIN hit USING (source_id, span_id) GROUP BY ALL) """


def _reanchored(spark, d):
    units = bed.unit(spark, d)
    new = units.select("source_id", "ordinal", F.posexplode(text.sentences(F.col("text"))).alias("k", "text"))
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal", "k"))
    new = new.select("source_id", n.alias("ordinal"), "text").withColumn("unit_id", F.concat(F.lit("n:"), "ordinal"))
    spans = units.select("source_id", F.col("unit_id").alias("span_id"), "unit_id", F.lit(0).alias("start"), F.least(F.lit(30), F.length("text")).alias("end"), F.substring("text", 1, 30).alias("text"))
    return spans, new


@query(_SENTENCES + "SELECT * FROM o", "b_unit")
def reanchor_outcomes(spark, d):
    return documents.reanchor(*_reanchored(spark, d)).select("source_id", "span_id", "outcome")


@query(_SENTENCES + "SELECT source_id, span_id AS reference_id, CAST(outcome <> 'lost' AS BIGINT) AS n_spans, CAST(outcome = 'lost' AS BIGINT) AS unlocated, outcome NOT IN ('unchanged', 'unverifiable') AS changed FROM o", "b_unit")
def evidence_after(spark, d):
    moved = documents.reanchor(*_reanchored(spark, d)).withColumn("reference_id", F.col("span_id"))
    return documents.evidence_after(moved).select("source_id", "reference_id", "n_spans", "unlocated", "changed")


@query(_SENTENCES + "SELECT outcome, count(*) AS n FROM o GROUP BY 1", "b_unit")
def reanchor_totals(spark, d):
    return documents.outcome_totals(documents.reanchor(*_reanchored(spark, d)))


@query(_SENTENCES + "SELECT q.source_id, q.span_id AS quote_id, arg_min(unit_id, ordinal) AS unit_id, CAST(arg_min(pos, ordinal) AS INTEGER) AS start FROM q LEFT JOIN hit USING (source_id, span_id) GROUP BY ALL", "b_unit")
def quote_placement(spark, d):
    spans, new = _reanchored(spark, d)
    return documents.place_quotes(spans.select("source_id", F.col("span_id").alias("quote_id"), F.col("text").alias("quote")), new, "source_id").select("source_id", "quote_id", "unit_id", "start")


# occurrences of a word that can't overlap itself, and of a sign twice, which can: a run of k signs holds k - 1


@query("SELECT doc_id, CASE WHEN length(text) - length(replace(text, 'password', '')) = 8 THEN CAST(position('password' IN text) - 1 AS INTEGER) END AS start FROM documents")
def find_span_unique(spark, d):
    return bed.table(spark, d, "documents").select("doc_id", text.find_unique(F.col("text"), F.lit("password")).alias("start"))


@query("SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(text, 'l+'), lambda x: length(x) - 1)), 0)::BIGINT AS n FROM documents")
def overlapping_occurrences(spark, d):
    return bed.table(spark, d, "documents").select("doc_id", long(text.count_occurrences(F.col("text"), F.lit("ll"))).alias("n"))


@query("SELECT doc_id, array_to_string(list_transform(range(1, len(p)), lambda k: length(array_to_string(p[1:k], 'password'))), ',') AS starts FROM (SELECT doc_id, string_split(text, 'password') AS p FROM documents) WHERE len(p) > 1")
def occurrence_starts(spark, d):
    starts = text.occurrences(F.col("text"), F.lit("password"))
    out = bed.table(spark, d, "documents").where(F.contains("text", F.lit("password"))).select("doc_id", starts.alias("s"))
    return out.select("doc_id", F.array_join(F.transform("s", lambda k: k.cast("string")), ",").alias("starts"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)password|token')) AS with_value, count(*) FILTER (regexp_matches(text, '(?i)password')) AS passwords FROM documents WHERE text IS NOT NULL GROUP BY 1")
def rule_extractor(spark, d):
    """Answers of a rule-based adapter to one request a document."""
    rule = calling.RuleBased(rules={"secret": [("password", "password"), ("token", "token")]})

    def run(frames):
        for frame in frames:
            made = [rule.answer({"writes": ["secret"], "context": text})["secret"] for text in frame["text"]]
            yield pd.DataFrame({"lang": frame["lang"], "value": [x.get("value") for x in made]})

    answers = bed.table(spark, d, "documents").where("text IS NOT NULL").select("lang", "text").mapInPandas(run, "lang string, value string")
    return answers.groupBy("lang").agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.count_if(F.col("value") == "password").alias("passwords"))


# validation --------------------------------------------------------------------------------------------------------------------------


def _typed(spark, d):
    """Cells with JSON values for the validator."""
    number = F.col("field_id").isin("totalprice", "quantity", "discount", "tax")
    return bed.cell(spark, d).withColumn("value_json", F.when(number, F.col("value")).otherwise(F.concat(F.lit('"'), "value", F.lit('"'))))


def _rules(spark):
    extra = ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in (("pattern", "string"), ("min_length", "int"), ("max_length", "int"), ("min_items", "int"), ("max_items", "int")))
    return bed.fields(spark, "order@1.0").selectExpr("*", "false AS open", "false AS deterministic", extra.split(", ")[0], *extra.split(", ")[1:])


@query("""SELECT c.field_id, CASE WHEN CAST(value AS DOUBLE) < minimum THEN 'minimum' ELSE 'maximum' END AS code, count(*) AS n FROM b_cell c JOIN b_field f ON f.field_id = c.field_id AND schema_ref = 'order@1.0' WHERE c.field_id IN ('totalprice', 'quantity') AND c.status IN ('present', 'review_required') AND (CAST(value AS DOUBLE) < minimum OR CAST(value AS DOUBLE) > maximum) GROUP BY ALL""", "b_cell", "b_field")
def validate_bounds(spark, d):
    return validation.faults(_typed(spark, d), _rules(spark)).where("code IN ('minimum', 'maximum')").groupBy("field_id", "code").agg(F.count("*").alias("n"))


@query("SELECT c.record_id, c.field_id FROM b_cell c JOIN b_field f ON f.field_id = c.field_id AND schema_ref = 'order@1.0' WHERE len(enum) > 0 AND c.status IN ('present', 'review_required') AND NOT list_contains(enum, value)", "b_cell", "b_field")
def validate_enum(spark, d):
    return validation.faults(_typed(spark, d), _rules(spark)).where("code = 'enum'").select("record_id", "field_id")


@query("SELECT field_id, count(*) AS n FROM b_cell WHERE field_id = 'tax' GROUP BY 1", "b_cell")
def validate_undefined(spark, d):
    return validation.faults(_typed(spark, d), _rules(spark)).where("code = 'undefined_field'").groupBy("field_id").agg(F.count("*").alias("n"))


@query("SELECT record_id FROM b_record WHERE o_orderkey % 10 = 0", "b_record")
def validate_required(spark, d):
    """Every tenth record loses its status cell, which is required at the root."""
    keep = _typed(spark, d).where("NOT (field_id = 'status' AND cast(substring(record_id, 5) AS bigint) % 10 = 0)")
    root_only = _rules(spark).where("collection = ''")
    return validation.missing_required(keep, root_only).select("record_id")


@query("SELECT doc_id, 'pattern' AS code FROM documents WHERE NOT regexp_matches(text, '^[A-Z]')")
def validate_pattern(spark, d):
    fields = Schema("doc", "1", (FieldDefinition("text", constraints=Constraints(pattern="^[A-Z]")),)).frame(spark)
    as_json = F.to_json(F.array("text"))
    cells = bed.table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("record_id"), F.lit("text").alias("field_id"), F.lit("").alias("entity"), F.lit("present").alias("status"), as_json.substr(F.lit(2), F.length(as_json) - 2).alias("value_json"))
    return validation.faults(cells, fields).select(F.col("record_id").alias("doc_id"), "code")


@query("SELECT record_id, CASE max(CASE WHEN l_quantity > 45 THEN 2 WHEN l_quantity > 30 THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'review' ELSE 'pass' END AS outcome FROM b_entity WHERE position >= 0 GROUP BY 1", "b_entity")
def validate_worst(spark, d):
    e = bed.entity(spark, d).where("position >= 0").select("record_id", F.when(F.col("l_quantity") > 45, "fail").when(F.col("l_quantity") > 30, "review").otherwise("pass").alias("outcome"))
    return validation.worst(e, ["record_id"])


@query("SELECT validator, outcome, count(*) AS n FROM (SELECT unnest(['honest', 'short']) AS validator, unnest([CASE WHEN status NOT IN ('present', 'review_required') AND (value IS NOT NULL OR status = 'not_reported') THEN 'review' ELSE 'pass' END, CASE WHEN length(value) > 5 THEN 'fail' ELSE 'pass' END]) AS outcome FROM b_cell) GROUP BY ALL", "b_cell")
def validators_run(spark, d):
    cells = bed.cell(spark, d).withColumn("reason", F.lit(None).cast("string"))
    ran = validation.run_validators(cells, {"honest": validation.honest_abstention(), "short": F.length("value") <= 5})
    return ran.groupBy("validator", "outcome").agg(F.count("*").alias("n"))


def _evidence_cells(spark, d):
    units = bed.unit(spark, d).groupBy("source_id").agg(F.collect_list("text").alias("texts"))
    return bed.table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit("present").alias("status"), F.concat(F.lit("THE "), F.substring("text", 1, 3)).alias("value"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("n_spans")).join(units, "source_id", "left")


@query("SELECT doc_id AS source_id, CASE WHEN doc_id % 3 = 0 THEN 'review' ELSE 'pass' END AS outcome FROM documents")
def require_evidence(spark, d):
    return _evidence_cells(spark, d).select("source_id", validation.require_evidence().alias("outcome"))


@query("SELECT doc_id AS source_id, CASE WHEN coalesce(list_bool_or(list_transform(texts, lambda t: contains(lower(t), lower('THE ' || substring(text, 1, 3))))), false) THEN 'pass' ELSE 'review' END AS outcome FROM documents LEFT JOIN (SELECT source_id, list(text) AS texts FROM b_unit GROUP BY 1) u ON u.source_id = doc_id", "b_unit")
def value_supported(spark, d):
    return _evidence_cells(spark, d).select("source_id", validation.supports_value().alias("outcome"))


@query("SELECT CASE WHEN lang IN ('en', 'fr') THEN 'pass' ELSE 'fail' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def in_vocabulary(spark, d):
    docs = bed.table(spark, d, "documents").select(F.lit("present").alias("status"), F.col("lang").alias("value"))
    return docs.select(validation.in_vocabulary(["en", "fr"]).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


# runs --------------------------------------------------------------------------------------------------------------------------------


def _step_states(spark, d):
    state = F.when(F.col("l_returnflag") == "A", "succeeded").when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 48), "review_needed").when(F.col("l_quantity") > 49, "failed").otherwise("succeeded")
    return bed.entity(spark, d).where("position >= 0").select("record_id", F.concat_ws("|", "record_id", "entity").alias("step_key"), state.alias("state"), "l_extendedprice")


_STATES = """+ st AS (SELECT record_id, record_id || '|' || entity AS step_key, CASE WHEN l_returnflag = 'A' THEN 'succeeded' WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 48 THEN 'review_needed' WHEN l_quantity > 49 THEN 'failed' ELSE 'succeeded' END AS state, l_extendedprice FROM b_entity WHERE position >= 0),
 dc AS (SELECT record_id, CASE WHEN bool_or(state <> 'succeeded') THEN 'hold' ELSE 'publish' END AS decision, CASE WHEN NOT bool_or(state <> 'succeeded') THEN 'published' WHEN bool_or(state = 'review_needed') THEN 'review_needed' ELSE 'failed' END AS version_state FROM st GROUP BY 1) """


@query(_STATES + "SELECT * FROM dc", "b_entity")
def publish_or_hold(spark, d):
    return running.publish_or_hold(_step_states(spark, d))


@query(_STATES + "SELECT count(*) AS records, count(*) FILTER (decision = 'publish') AS published, CASE WHEN bool_and(decision = 'publish') THEN 'succeeded' ELSE 'partial' END AS status FROM dc", "b_entity")
def run_status(spark, d):
    return running.run_status(running.publish_or_hold(_step_states(spark, d)))


@query(_STATES + "SELECT count(*) AS records, 0::BIGINT AS published, CASE WHEN count(*) = 0 THEN 'succeeded' ELSE 'partial' END AS status FROM dc WHERE decision = 'hold'", "b_entity")
def run_status_held(spark, d):
    """A run of which every record is held."""
    return running.run_status(running.publish_or_hold(_step_states(spark, d)).where("decision = 'hold'"))


@query(_STATES + "SELECT state, count(*) AS n FROM st GROUP BY 1", "b_entity")
def step_state_histogram(spark, d):
    return running.state_histogram(_step_states(spark, d))


@query(_STATES + "SELECT step_key FROM st WHERE state <> 'succeeded'", "b_entity")
def resume_remaining(spark, d):
    s = _step_states(spark, d)
    return artifacts.resume_remaining(s, s, ["step_key"], within="record_id").select("step_key")


@query("SELECT 'c' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS step_key, round(sum(round(abs(value), 2)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) <= 5000 AS admitted FROM events")
def budget_admission(spark, d):
    calls = bed.table(spark, d, "events").select(F.concat(F.lit("c"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("step_key"), F.round(F.abs("value"), 2).alias("usd"))
    out = running.admit(calls, 5000.0, blocks=8)
    return out.select("step_key", (F.round("running", 2) <= 5000).alias("admitted"))


@query("SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def retry_counts(spark, d):
    return running.retries(bed.table(spark, d, "events").withColumnRenamed("event_type", "outcome"), ["user_id"])


@query("SELECT CAST(a AS INTEGER) AS attempt, least(0.5 * pow(2.0, a - 1), 8.0) AS seconds FROM range(1, 9) t(a)")
def backoff_schedule(spark, d):
    return spark.range(1, 9).select(F.col("id").cast("int").alias("attempt"), text.backoff(F.col("id"), 0.5, 2.0, 8.0).alias("seconds"))


@query("SELECT record_id, 'sha256:' || substring(sha256(string_agg(field_id || ':' || value, ',' ORDER BY field_id || ':' || value)), 1, 16) AS lineage FROM b_cell WHERE entity = '' GROUP BY 1", "b_cell")
def lineage_hash(spark, d):
    return running.lineage_hash(bed.cell(spark, d).where("entity = ''").withColumn("value_hash", F.col("value")), ["record_id"])


@query("SELECT count(*) AS steps, count(*) FILTER (event_type = 'purchase') AS calls, count(*) FILTER (event_type = 'view') AS cache_hits, round(count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type IN ('view', 'purchase')), 6) AS cache_hit_rate FROM events")
def run_metrics(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "semantic").when(F.col("event_type") == "view", "cached").otherwise("reuse")
    return running.metrics(bed.table(spark, d, "events").select(kind.alias("disposition")))


# review and evaluation -----------------------------------------------------------------------------------------------------------------


def _items(spark, d):
    o = bed.record(spark, d).where("state = 'review_needed'")
    return o.select(F.col("record_id").alias("item_id"), "record_id", F.lit("status").alias("field_id"), F.lit("").alias("entity"), F.concat("o_orderpriority", F.lit("; order "), "o_orderkey").alias("reason"), F.lit(None).cast("string").alias("old_value"), F.col("o_orderstatus").alias("proposed_value"), F.lit("open").alias("state"), F.col("o_orderdate").alias("created_at"), "o_orderkey")


@query("SELECT o_orderpriority AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def review_by_reason(spark, d):
    return review.by_reason(_items(spark, d))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'accepted' WHEN o_orderkey % 4 = 1 THEN 'rejected' WHEN o_orderkey % 8 = 2 THEN 'edited' ELSE 'open' END AS state, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def review_decisions_applied(spark, d):
    items = _items(spark, d)
    k = F.col("o_orderkey")
    decisions = items.select("item_id", F.when(k % 4 == 0, "accept").when(k % 4 == 1, "reject").when(k % 4 == 2, "edit").alias("decision"), F.lit("because").alias("rationale"), F.when(k % 8 == 2, "X").alias("edited_value")).where("decision IS NOT NULL")
    return review.by_state(review.decide(items, decisions)[0])


def _compared(spark, d):
    g = bed.gold(spark, d)
    wanted = F.when(F.col("field_id") == "quality", F.col("quality").cast("string")).otherwise(F.col("toxic").cast("string"))
    gold = g.select("record_id", "field_id", "entity", F.when(F.col("n_chars") % 11 == 0, "not_reported").otherwise("present").alias("status"), F.when(F.col("n_chars") % 11 != 0, wanted).alias("value"))
    made = F.when(F.col("n_chars").between(200, 10000), "1").otherwise("0")
    produced = g.where("n_chars % 13 <> 0").select("record_id", "field_id", "entity", F.when(F.col("n_chars") % 17 == 0, "not_reported").otherwise("present").alias("status"), F.when(F.col("n_chars") % 17 != 0, made).alias("value"), (F.col("n_chars") % 2).cast("int").alias("n_spans"))
    return evaluation.compare(gold, produced)


_GOLD = """+ c AS (SELECT field_id, CASE WHEN n_chars % 11 = 0 THEN NULL WHEN field_id = 'quality' THEN CAST(quality AS VARCHAR) ELSE CAST(toxic AS VARCHAR) END AS g, CASE WHEN n_chars % 13 = 0 OR n_chars % 17 = 0 THEN NULL WHEN n_chars BETWEEN 200 AND 10000 THEN '1' ELSE '0' END AS p, n_chars % 2 AS sp FROM b_gold),
 s AS (SELECT field_id, count(*) AS n, count(*) FILTER (g IS NOT NULL AND p = g) AS tp, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL AND p <> g) AS wrong, count(*) FILTER (g IS NOT NULL AND p IS NULL) AS missed, count(*) FILTER (g IS NULL AND p IS NOT NULL) AS spurious, count(*) FILTER (g IS NULL AND p IS NULL) AS tn, count(*) FILTER (p IS NOT NULL AND sp > 0) AS supported, count(p) AS with_value FROM c GROUP BY 1) """


@query(_GOLD + "SELECT field_id, n, tp AS true_positive, wrong AS wrong_value, missed, spurious, tn AS true_negative, supported, with_value FROM s", "b_gold")
def gold_scores(spark, d):
    return evaluation.scores(_compared(spark, d)).select("field_id", "n", "true_positive", "wrong_value", "missed", "spurious", "true_negative", "supported", "with_value")


@query(_GOLD + "SELECT field_id, round(tp / (tp + wrong + spurious), 4) AS precision, round(tp / (tp + wrong + missed), 4) AS recall, round(2 * tp / (2 * tp + 2 * wrong + spurious + missed), 4) AS f1, round((missed + tn) / n, 4) AS abstention_rate, round(supported / with_value, 4) AS evidence_support FROM s", "b_gold")
def gold_f1(spark, d):
    return evaluation.scores(_compared(spark, d)).select("field_id", "precision", "recall", "f1", "abstention_rate", "evidence_support")


@query("WITH t AS (SELECT field_id, n_chars % 3 = 0 AS none FROM (SELECT unnest(['quality', 'toxic']) AS field_id, n_chars FROM labels JOIN documents USING (doc_id))) SELECT field_id, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, CAST(NULL AS DOUBLE) AS f1, count(*) FILTER (NOT none) AS wrong_value FROM t GROUP BY 1")
def gold_without_hits(spark, d):
    """No value is right: precision and recall are 0, f1 has none."""
    g = bed.gold(spark, d).select("record_id", "field_id", "entity", F.when(F.col("n_chars") % 3 == 0, "not_reported").otherwise("present").alias("status"), F.when(F.col("n_chars") % 3 != 0, "right").alias("value"))
    produced = g.select("record_id", "field_id", "entity", "status", F.when(F.col("value").isNotNull(), "wrong").alias("value"), F.lit(0).alias("n_spans"))
    return evaluation.scores(evaluation.compare(g, produced)).select("field_id", "precision", "recall", "f1", "wrong_value")


@query("SELECT 'tags' AS field_id, count(*) AS n, count(*) FILTER (doc_id % 3 <> 2) AS true_positive, count(*) FILTER (doc_id % 3 = 2) AS wrong_value FROM documents")
def gold_lists(spark, d):
    """Lists match in any order; every third lacks an item."""
    docs = bed.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.lit("tags").alias("field_id"), F.lit("").alias("entity"), F.lit("present").alias("status"), "lang", "doc_id")
    of = lambda *cols: F.to_json(F.array(*cols))
    a, b = F.col("lang"), F.col("doc_id").cast("string")
    gold = docs.select("record_id", "field_id", "entity", "status", of(a, b).alias("value"))
    made = docs.select("record_id", "field_id", "entity", "status", F.when(F.col("doc_id") % 3 == 0, of(a, b)).when(F.col("doc_id") % 3 == 1, of(b, a)).otherwise(of(a)).alias("value"))
    return evaluation.scores(evaluation.compare(gold, made)).select("field_id", "n", "true_positive", "wrong_value")


@query(_GOLD + ", m AS (SELECT round(tp / (tp + wrong + spurious), 4) AS p, round(tp / (tp + wrong + missed), 4) AS r, field_id FROM s) SELECT 'precision>=0.5' AS gate, min(p) AS value, min(p) >= 0.5 AS passed FROM m UNION ALL SELECT 'recall:quality>=0.2', min(r), min(r) >= 0.2 FROM m WHERE field_id = 'quality' UNION ALL SELECT 'recall<=0.9', max(r), max(r) <= 0.9 FROM m UNION ALL SELECT 'review_rate<=0.1', 0.25, false", "b_gold")
def gate_results(spark, d):
    return evaluation.gate_results(evaluation.scores(_compared(spark, d)), ["precision>=0.5", "recall:quality>=0.2", "recall<=0.9", "review_rate<=0.1"], {"review_rate": 0.25})


@query("SELECT record_id, entity, 'quantity' AS field_id, 'many' AS reason, 'open' AS state, CAST(l_quantity AS VARCHAR) AS old_value FROM b_entity WHERE l_quantity > 48", "b_entity")
def review_items_open(spark, d):
    """Asked twice for the same, and once for the other: one item each."""
    steps = bed.entity(spark, d).where("l_quantity > 48").select("record_id", "entity", F.lit("quantity").alias("field_id"), F.lit("many").alias("reason"), F.col("l_quantity").cast("string").alias("old_value"), F.lit(None).cast("string").alias("proposed_value"), F.lit("t").alias("created_at"))
    return review.open_items(steps.unionByName(steps)).select("record_id", "entity", "field_id", "reason", "state", "old_value")


@query("SELECT record_id, count(*) AS n FROM b_entity WHERE position >= 0 GROUP BY 1", "b_entity")
def step_dependencies(spark, d):
    """s2, of every line, reads what s1 writes at the root."""
    found = planning.depends_on(planning.expand(*_plannable(spark, d)))
    return found.where(F.size("depends_on") == 1).groupBy(F.split_part("step_key", F.lit("|"), F.lit(1)).alias("record_id")).agg(F.count("*").alias("n"))


# export, functions ---------------------------------------------------------------------------------------------------------------------


@query("SELECT record_id, o_orderstatus AS status, len(p) AS n, 'sha256:' || substring(sha256(array_to_string(p, ',')), 1, 16) AS lines FROM (SELECT record_id, list_sort(list(field_id || '@' || entity || '=' || status)) AS p FROM b_cell GROUP BY 1) JOIN b_record USING (record_id)", "b_cell", "b_record")
def export_lines(spark, d):
    """The lines that a store exports, read back."""
    lines = jsonl.export_lines(bed.order_json(spark, d), bed.cell(spark, d))
    back = lines.select(F.from_json("value", "record_id string, record struct<status: string>, provenance array<struct<field_id: string, entity: string, status: string>>").alias("x")).select("x.*")
    parts = F.array_sort(F.transform("provenance", lambda p: F.concat(p["field_id"], F.lit("@"), p["entity"], F.lit("="), p["status"])))
    return back.select("record_id", "record.status", long(F.size("provenance")).alias("n"), ids.text_hash_col(F.array_join(parts, ",")).alias("lines"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, 'sha256:' || substring(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) AS hash FROM documents")
def slugs_and_hashes(spark, d):
    return bed.table(spark, d, "documents").select("doc_id", ids.slug_col(F.col("text")).alias("slug"), ids.text_hash_col(ids.normalise_space_col(F.col("text"))).alias("hash"))


@query("SELECT DISTINCT schema_ref, split_part(schema_ref, '@', 1) AS name, split_part(schema_ref, '@', 2) AS version FROM b_record", "b_record")
def version_refs(spark, d):
    return bed.record(spark, d).select("schema_ref").distinct().select("schema_ref", ids.ref_name_col(F.col("schema_ref")).alias("name"), ids.ref_version_col(F.col("schema_ref")).alias("version"))


@query("SELECT record_id, count(DISTINCT field_id) AS n, list_sort(list(DISTINCT field_id))[1] AS first_field FROM b_cell WHERE status IN ('present', 'review_required') GROUP BY 1", "b_cell")
def distinct_field_sets(spark, d):
    return artifacts.filled_fields(bed.cell(spark, d), ["record_id"]).select("record_id", long(F.size("fields")).alias("n"), F.get("fields", F.lit(0)).alias("first_field"))


# whole runs ----------------------------------------------------------------------------------------------------------------------------

QUERIES |= {"run_end_to_end": runs.run_end_to_end, "escalation_waves": runs.escalation_waves, "shadow_agreement": runs.shadow_agreement}
ORACLE |= {"run_end_to_end": runs.RUN_SQL, "escalation_waves": runs.WAVES_SQL, "shadow_agreement": runs.SHADOW_SQL}
