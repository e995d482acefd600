"""Queries that are whole runs: documents become records with parsed sources, a migration with a model that works by rules is planned, run and published.

The store of such a query is a new folder in the shared one that spark.checkpoint.dir names (a temporary one where that is unset)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.errors import EngineError
from strataweave.functions.registry import register
from strataweave.model.migration import ExecutionPolicy, Migration, Step
from strataweave.model.recipe import ContextPolicy, Escalation, Recipe, Source
from strataweave.model.registry import Registry
from strataweave.model.schema import FieldDefinition, Schema
from strataweave.operators.calling import RuleBased
from strataweave.plans import bed
from strataweave.project import Project
from strataweave.sources.jsonl import UNIT

WHOLE = ContextPolicy((), full_document="required", on_missing="proceed")
WIDER = ContextPolicy((Source("sections", {"names": ["title"]}), Source("sections", {"names": ["abstract"]})), full_document="allowed")


def upper_lang(reads, params):
    return {"lang_name": F.upper(reads["lang"])}


def _registry(context: ContextPolicy, escalation: Escalation) -> Registry:
    register("transform", "upper-lang", "1", upper_lang, "columns")
    f = FieldDefinition
    common = (f("local_id", required=True, deterministic=True), f("lang"))
    r = Registry()
    r.add_schema(Schema("doc", "1", (*common, f("source", field_id="source"))))
    r.add_schema(Schema("doc", "2", (*common, f("origin", field_id="source"), f("lang_name", deterministic=True), f("mentions"))))
    for v in ("1", "2"):
        r.add_recipe(Recipe("mentions", v, "What does this mention? {context}", ("mentions",), "rules" + v, context=context, escalation=escalation))
    steps = (Step("name", "derive", ("lang",), ("lang_name",), transform="upper-lang@1"), Step("mentions", "document_semantic", (), ("mentions",), recipe="mentions@1"))
    r.add_migration(Migration("m", "doc@1", "doc@2", steps))
    return r


def _project(spark: SparkSession, d: str, context: ContextPolicy = WHOLE, escalation: Escalation = Escalation(), **more) -> Project:
    more_wanted = {"mentions": {"status": "needs_more_context"}} if escalation.enabled else {}
    adapters = {"rules1": RuleBased(rules={"mentions": [("password", "secret"), ("token", "secret")]}, otherwise=more_wanted), "rules2": RuleBased(rules={"mentions": [("password", "secret")]}, otherwise=more_wanted)}
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise EngineError("config_invalid", "spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="strataweave-run-")
    p = Project(spark, f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}", _registry(context, escalation), adapters, **more)
    docs = bed.table(spark, d, "documents")
    section = lambda i: F.when(i == 0, "title").when(i == 1, "abstract").otherwise("body")
    unit = lambda t, i: F.struct(F.concat(F.lit("u"), i.cast("string")).alias("unit_id"), F.lit("paragraph").alias("kind"), section(i).alias("section"), t.alias("text"), i.alias("ordinal"), F.array().cast("array<string>").alias("labels"), F.lit(None).cast("struct<labels:array<string>>").alias("metadata"))
    units = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), unit), lambda u: u["text"] != "").cast(f"array<{UNIT}>")
    key = F.col("doc_id").cast("string")
    source = F.struct(key.alias("source_id"), F.lit("1").alias("source_version"), F.lit(None).cast("string").alias("content_hash"), F.lit("").alias("uri"), F.lit("text/plain").alias("media_type"), F.array().cast("array<string>").alias("labels"), F.lit(None).cast("string").alias("metadata"))
    parsed = F.struct(key.alias("source_id"), F.lit("1").alias("source_version"), F.lit("lines").alias("parse_version"), units.alias("units"))
    record = F.to_json(F.struct(key.alias("local_id"), "lang", "source"))
    p.ingest(docs.select(F.concat(F.lit("doc:"), key).alias("record_id"), record.alias("record"), F.lit("doc@1").alias("schema_ref"), source.alias("source"), parsed.alias("parsed")))
    return p


def run_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of every published record after the migration."""
    p = _project(spark, d)
    p.migrate("doc@2", ExecutionPolicy())
    return p.store.version_cells().select("record_id", "field_id", "status", F.get_json_object(F.concat(F.lit('{"v":'), F.coalesce("value_json", F.lit("null")), F.lit("}")), "$.v").alias("value"))


RUN_SQL = """SELECT 'doc:' || doc_id AS record_id, unnest(['local_id', 'lang', 'source', 'lang_name', 'mentions']) AS field_id,
  unnest(['present', 'present', 'present', 'present', CASE WHEN regexp_matches(text, 'password|token', 'i') THEN 'present' ELSE 'not_reported' END]) AS status,
  unnest([CAST(doc_id AS VARCHAR), lang, source, upper(lang), CASE WHEN regexp_matches(text, 'password|token', 'i') THEN 'secret' END]) AS value FROM documents"""


def escalation_waves(spark: SparkSession, d: str) -> DataFrame:
    """Calls by level of a model that asks for more context until it sees what it looks for."""
    p = _project(spark, d, WIDER, Escalation(True, max_escalations=2))
    p.migrate("doc@2", ExecutionPolicy())
    return p.store.read("attempt").where("kind = 'call'").groupBy("level").agg(F.count("*").alias("calls"))


WAVES_SQL = """WITH l AS (SELECT * FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE t <> ''),
  s AS (SELECT doc_id, i AS k, regexp_matches(t, 'password|token', 'i') AS hit FROM l WHERE i < 2 UNION ALL SELECT doc_id, 2, bool_or(regexp_matches(t, 'password|token', 'i')) FROM l GROUP BY 1),
  r AS (SELECT row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS level, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
  SELECT level, count(*) AS calls FROM r WHERE NOT coalesce(before, false) GROUP BY 1"""


def shadow_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often another recipe, asked beside the first, says the same."""
    p = _project(spark, d, shadow={"mentions@1": "mentions@2"})
    p.migrate("doc@2", ExecutionPolicy())
    return p.store.read("attempt").where("kind = 'shadow'").groupBy("outcome").agg(F.count("*").alias("n"))


SHADOW_SQL = "SELECT CASE WHEN regexp_matches(text, 'token', 'i') AND NOT regexp_matches(text, 'password', 'i') THEN 'differ' ELSE 'agree' END AS outcome, count(*) AS n FROM documents GROUP BY 1"
