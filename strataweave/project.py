"""A store, the registry in it, and the operations over both."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.errors import EngineError
from strataweave.functions.ids import content_hash_col, now
from strataweave.model.codec import registry_from_value, registry_to_value
from strataweave.model.migration import ExecutionPolicy
from strataweave.model.registry import Registry
from strataweave.model.schema import SchemaDiff, diff_schemas
from strataweave.operators import artifacts, diffing, documents, evaluation, planning, records, review, running, validation
from strataweave.plans.engine import KEYS, Engine, Plan, RunResult, as_cells, stamped
from strataweave.sources import jsonl
from strataweave.sources.store import SPAN, TABLES, Store

_EVIDENCE = f"array<struct<source_id:string,spans:array<{SPAN.replace('start:', 'start_char:').replace('end:', 'end_char:').replace('source_id:string,', '')}>>>"


class Project:
    def __init__(self, spark: SparkSession, root: str, registry: Registry | None = None, adapters: dict | None = None, wrapped: bool = False, **engine):
        self.spark, self.store, self.wrapped = spark, Store(spark, root), wrapped
        saved = self.store.document("registry")
        self.registry = registry or (registry_from_value(saved) if saved else Registry())
        self.engine = Engine(self.store, self.registry, adapters, **engine)
        if registry is not None:
            self.save()

    def close(self) -> None:
        self.save()
        self.engine.close()

    def save(self) -> None:
        self.store.save_document("registry", registry_to_value(self.registry))

    def register(self, *items) -> None:
        """Schemas, recipes, vocabularies and migrations, by what they are."""
        for x in items:
            getattr(self.registry, f"add_{type(x).__name__.lower()}")(x)
        self.save()

    def schema_diff(self, old: str, new: str, **renames) -> SchemaDiff:
        return diff_schemas(self.registry.schema(old), self.registry.schema(new), **renames)

    # ingest

    def ingest(self, envelopes: DataFrame, publish: bool = True, assert_currency: bool = True) -> dict:
        """Records (ENVELOPE columns) into the store: cells, entities, sources, units, validation, versions, index; one commit.

        Unreadable records are counted and left out; validation is reported and doesn't hold anything back. Of repeated record ids the first line in
        text order stands."""
        ok = envelopes.where("record IS NOT NULL")
        refs = sorted(r[0] for r in ok.select("schema_ref").distinct().collect() if r[0] is not None)
        at, known = now(), ok.groupBy("record_id").agg(F.min_by(F.struct("record", "schema_ref", "source", "parsed"), F.struct("record", "schema_ref")).alias("x")).select("record_id", "x.*")
        known = self.engine._cut(known)
        counts = {"records": 0, "refused": envelopes.where("record IS NULL OR schema_ref IS NULL").count(), "cells": 0, "faults": 0}
        with self.store.transaction() as t:
            for ref in refs:
                schema = self.registry.schema(ref)
                part = known.where(F.col("schema_ref") == ref)
                cells, entities = records.decompose(part, schema, wrapped=self.wrapped)
                if self.wrapped:
                    cells = cells.join(self._evidence(part, schema), KEYS, "left")
                cells = stamped(cells, schema) if assert_currency else cells
                made = t.append_new("field_artifact", self.engine._cut(as_cells(cells, at, schema_ref=ref, actor="import")))
                whole = self.engine._cut(as_cells(cells, at, schema_ref=ref, actor="import").select("record_id", "artifact_id", "field_id", "entity", "status", "value_json"))
                ids = whole.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("artifact_id")), ",").alias("ids"))
                version = content_hash_col(record=F.col("record_id"), schema=F.lit(ref), artifacts=F.col("ids"))
                versions = self.engine._cut(ids.select("record_id", version.alias("version_id"), F.lit(ref).alias("schema_ref"), F.lit("published" if publish else "draft").alias("state"), F.lit(at).alias("created_at")))
                t.append("record_version", versions)
                live = versions.select("record_id", "version_id")
                t.append("version_artifact", whole.select("record_id", "artifact_id").join(live, "record_id"))
                t.append("record_entity", entities.join(live, "record_id"))
                place = part.select("record_id", "schema_ref", F.coalesce("source.source_id", "parsed.source_id").alias("source_id"), F.coalesce("source.source_version", "parsed.source_version").alias("source_version"), "parsed.parse_version")
                t.append("record_index", place.join(versions.select("record_id", "version_id", "state"), "record_id").withColumns({"updated_at": F.lit(at), "seq": F.lit(t.seq)}))
                counts["records"] += versions.count()
                counts["cells"] += made.count()
                counts["faults"] += validation.validate(whole, schema.frame(self.spark)).count()
            t.append_new("source_artifact", jsonl.sources_of(known))
            keys = ["source_id", "source_version", "parse_version"]
            t.append("document_unit", jsonl.units_of(known).join(self.store.raw("document_unit").select(*keys).distinct(), keys, "left_anti"))
        self.engine._clear()
        return counts

    def _evidence(self, part: DataFrame, schema) -> DataFrame:
        """(keys, evidence, unlocated) that wrapped values carry beside them."""
        out = None
        for path in ["", *schema.collections()]:
            structs = []
            for f in schema.fields_in(path):
                wrapper = records.json_get(F.col("doc"), [*schema.relative(f.path, path).split("."), "evidence"])
                sets = F.from_json(F.to_json(F.try_variant_get(wrapper, "$.sets", "variant")), _EVIDENCE)
                spans = F.flatten(F.transform(sets, lambda s: F.transform(s["spans"], lambda x: F.struct(s["source_id"].alias("source_id"), x["unit_id"].alias("unit_id"), x["start_char"].alias("start"), x["end_char"].alias("end"), x["text"].alias("text")))))
                structs.append(F.struct(F.lit(f.field_id).alias("field_id"), spans.alias("evidence"), F.coalesce(F.try_variant_get(wrapper, "$.unlocated_quotes", "int"), F.lit(0)).alias("unlocated")))
            if structs:
                rows = self._level(part, schema, path).select("record_id", "entity", F.explode(F.array(*structs)).alias("x")).where("size(x.evidence) > 0 OR x.unlocated > 0").select("record_id", "entity", "x.*")
                out = rows if out is None else out.unionByName(rows)
        return out

    def _level(self, part: DataFrame, schema, path: str) -> DataFrame:
        """(record_id, entity, doc) of a collection's members."""
        if not path:
            return part.select("record_id", F.lit("").alias("entity"), F.coalesce(F.try_parse_json("record"), F.parse_json(F.lit("{}"))).alias("doc"))
        parent = schema.parent_collection(path)
        up = self._level(part, schema, parent)
        items = records.json_get(F.col("doc"), schema.relative(path, parent).removesuffix("[]").split("."), "array<variant>")
        one = up.select("record_id", F.col("entity").alias("parent"), F.posexplode(items).alias("position", "doc"))
        identity = schema.identity_field(path)
        own = F.coalesce(*(F.try_variant_get("doc", f"$.{identity}{tail}", "string") for tail in (".value", ""))) if identity else F.lit(None).cast("string")
        local = F.coalesce(F.nullif(own, F.lit("")), F.concat(F.lit("#"), F.col("position").cast("string")))
        key = F.concat(F.when(F.col("parent") == "", "").otherwise(F.concat("parent", F.lit("/"))), F.lit(f"{path}="), records._quoted(local))
        return one.select("record_id", key.alias("entity"), "doc")

    def ingest_jsonl(self, path: str, schema_ref: str | None = None, id_field: str = "record_id", **more) -> dict:
        return self.ingest(jsonl.read_records(self.spark, path, schema_ref, id_field), **more)

    # plan and run

    def plan(self, target: str, **more) -> Plan:
        return self.engine.plan(target, **more)

    def run(self, plan: Plan, **more) -> RunResult:
        return self.engine.run(plan, **more)

    def migrate(self, target: str, policy: ExecutionPolicy | None = None, **more) -> tuple[Plan, RunResult]:
        plan = self.plan(target, policy=policy, **more)
        return plan, self.run(plan)

    def resume(self, execution_id: str) -> RunResult:
        """Plan again to the run's target and do what it has left."""
        known = self.store.read("execution").where(F.col("execution_id") == execution_id).first()
        if known is None:
            raise EngineError("execution_unknown", execution_id)
        policy = (self.store.document(f"policy-{execution_id}") or {}) if known else {}
        plan = self.plan(known["target"], policy=ExecutionPolicy(**{k: tuple(v) if isinstance(v, list) else v for k, v in policy.items()}))
        return self.engine.resume(execution_id, plan)

    # read

    def records(self, where: Column | None = None, **more) -> DataFrame:
        return artifacts.index_page(self.store.read("record_index"), where, **more)

    def assembled(self, versions: DataFrame | None = None, include_absent: bool = False) -> DataFrame:
        """(record_id, record) of current versions, each by the schema that it is under."""
        current = self.store.current() if versions is None else versions
        out = None
        for ref in sorted(r[0] for r in current.select("schema_ref").distinct().collect()):
            part = current.where(F.col("schema_ref") == ref).select("record_id", "version_id")
            cells = self.store.version_cells(part)
            if self.wrapped:
                deterministic = [f.field_id for f in self.registry.schema(ref).fields if f.deterministic]
                whole = records.wrapped_encode(F.col("status"), F.col("value_json"), F.col("reason"), F.coalesce(F.size("evidence"), F.lit(0)))
                bare = F.col("field_id").isin(*deterministic)
                cells = cells.where("status <> 'not_extracted'").withColumn("value_json", F.when(bare, F.col("value_json")).otherwise(whole)).withColumn("status", F.when(bare, F.col("status")).otherwise("present"))
            entities = self.store.raw("record_entity").join(part.select("version_id"), "version_id", "left_semi")
            made = records.assemble(cells, entities, self.registry.schema(ref), include_absent)
            out = made if out is None else out.unionByName(made)
        return out if out is not None else self.spark.createDataFrame([], "record_id string, record string")

    def get_record(self, record_id: str) -> dict | None:
        row = self.assembled(self.store.current().where(F.col("record_id") == record_id)).first()
        return json.loads(row["record"]) if row else None

    def export(self, path: str) -> None:
        """A line a record with its provenance; records without a current version are left out."""
        jsonl.write_lines(jsonl.export_lines(self.assembled(), self.store.version_cells()), path)

    def provenance(self, record_id: str, field_id: str, entity: str = "") -> DataFrame:
        """All cells of one slot, oldest first."""
        one = self.store.raw("field_artifact").where((F.col("record_id") == record_id) & (F.col("field_id") == field_id) & (F.col("entity") == entity))
        return one.orderBy("created_at", "artifact_id")

    def currency(self, where: Column | None = None) -> DataFrame:
        """(keys, state, stale_keys) of every field that the record's own schema declares, missing ones too; per entity in scope."""
        index, out = self.records(where), None
        for ref in sorted(r[0] for r in index.select("schema_ref").distinct().collect()):
            fields = self.registry.schema(ref).frame(self.spark)
            part = index.where(F.col("schema_ref") == ref)
            entities = self.engine._entities(part).where("local_id <> '∅'").select("record_id", "entity", F.col("collection_path").alias("collection"))
            due = entities.join(F.broadcast(fields.select("field_id", "collection", F.create_map(F.concat(F.lit("field_def:"), "field_id"), "semantic_key").alias("expected"), F.col("semantic_key"))), "collection")
            cells = self.store.latest_cells(part).select(*KEYS, "status", "hashes", "accepted", "recipe_ref")
            judged = planning.currency(due.join(cells, KEYS, "left"), recipe=None).select(*KEYS, "state", "stale_keys")
            out = judged if out is None else out.unionByName(judged)
        return out if out is not None else self.spark.createDataFrame([], "record_id string, field_id string, entity string, state string, stale_keys array<string>")

    def diff_record(self, record_id: str) -> DataFrame:
        """The two newest versions of a record, slot by slot."""
        versions = self.store.raw("record_version").where((F.col("record_id") == record_id) & F.col("schema_ref").isNotNull())
        pair = artifacts.last_versions(versions, ["record_id"], ["created_at", "version_id"]).collect()
        by_rank = {r["rank"]: r["version_id"] for r in pair}
        side = lambda v: self._side(self.store.raw("version_artifact").where(F.col("version_id") == F.lit(v)).select("version_id").distinct())
        return diffing.diff_records(side(by_rank.get(2)), side(by_rank.get(1)))

    def _side(self, versions: DataFrame) -> DataFrame:
        return self.store.version_cells(versions).select(*KEYS, "status", F.col("value_json").alias("value"), "evidence")

    def report(self, execution_id: str) -> dict:
        """What a run changed: deltas by kind and field, coverage, rates."""
        after = self.store.raw("record_version").where((F.col("execution_id") == execution_id) & (F.col("state") == "published"))
        diff = diffing.diff_records(self._side(after.select(F.col("parent").alias("version_id"))), self._side(after.select("version_id")))
        diff = self.engine._cut(diff)
        cells = self.store.version_cells(after)
        steps = self.store.read("execution_step").where(F.col("execution_id") == execution_id)
        failed = F.when(F.col("code") == "validation_failed", "fail").otherwise("pass")
        out = diffing.change_rate(diff).first().asDict() | {"by_kind": {r["kind"]: r["n"] for r in diffing.diff_counts(diff).collect()}, "by_field": {r["field_id"]: r["n"] for r in diffing.changes_by_field(diff).collect()}}
        out |= {"coverage": {r["field_id"]: r["coverage"] for r in diffing.coverage(cells).collect()}, "status": {r["status"]: r["n"] for r in diffing.status_histogram(cells).collect()}}
        out |= diffing.rates(steps.withColumn("outcome", failed)).first().asDict()
        self.engine._clear()
        return out

    def status(self, execution_id: str) -> dict:
        known = self.store.read("execution").where(F.col("execution_id") == execution_id).first()
        if known is None:
            raise EngineError("execution_unknown", execution_id)
        steps = self.store.read("execution_step").where(F.col("execution_id") == execution_id)
        open_ = self.store.read("review_item").where((F.col("execution_id") == execution_id) & (F.col("state") == "open")).count()
        return {"execution_id": execution_id, "status": known["status"], "target": known["target"], "metrics": json.loads(known["metrics"]), "steps": {r["state"]: r["n"] for r in running.state_histogram(steps).collect()}, "open_reviews": open_}

    # review

    def reviews(self, state: str | None = "open") -> DataFrame:
        items = self.store.read("review_item")
        return (items if state is None else items.where(F.col("state") == state)).orderBy("created_at", "item_id")

    def decide(self, decisions: DataFrame) -> int:
        """Apply decisions (item_id, decision, rationale, edited_value): item states, events and, for accept and edit, human cells that count as accepted."""
        at, items = now(), self.store.read("review_item")
        mine = items.join(decisions.select("item_id"), "item_id", "left_semi")
        if decisions.join(items.select("item_id"), "item_id", "left_anti").limit(1).count():
            raise EngineError("review_unknown", "a decision is about an item that isn't there")
        after, human = review.decide(mine, decisions)
        index = self.store.read("record_index").select("record_id", "schema_ref")
        cells = human.join(index, "record_id", "left").select("record_id", "field_id", "entity", "status", F.col("value").alias("value_json"), "actor", "accepted", "schema_ref", F.col("rationale").alias("notes"))
        old = self.store.latest_cells(mine.select("record_id").distinct()).select(*KEYS, "hashes", "evidence", "recipe_ref")
        event = content_hash_col(item=F.col("item_id"), decision=F.col("decision"), value=F.col("edited_value"), at=F.lit(at))
        with self.store.transaction() as t:
            made = t.append_new("field_artifact", self.engine._cut(as_cells(cells.join(old, KEYS, "left"), at)))
            t.append("review_item", after.withColumn("seq", F.lit(t.seq)))
            t.append_new("review_event", decisions.join(mine.select("item_id", "record_id"), "item_id").withColumns({"event_id": event, "created_at": F.lit(at)}))
        self.engine._clear()
        return made.count()

    def accept_legacy(self, where: Column) -> int:
        """Latest cells that fit `where`, accepted under the schema that their record is under now."""
        index = self.store.read("record_index").select("record_id", F.col("schema_ref").alias("under"))
        cells = self.store.latest_cells().where(where).join(index, "record_id")
        taken = review.accept_as_is(cells.drop("accepted", "actor", "schema_ref"), "").withColumn("schema_ref", F.col("under")).withColumn("actor", F.lit("human"))
        with self.store.transaction() as t:
            made = t.append_new("field_artifact", self.engine._cut(as_cells(taken.drop("under", "accepted_under", "artifact_id", "created_at", "value_hash"), now())))
        self.engine._clear()
        return made.count()

    def review_report(self) -> dict:
        items = self.store.read("review_item")
        return {"by_state": {r["state"]: r["n"] for r in review.by_state(items).collect()}, "by_reason": {r["reason"]: r["n"] for r in review.by_reason(items).collect()}}

    # evidence

    def reanchor(self, parse_version: str, dry_run: bool = True) -> dict:
        """Spans of current cells against the units of a newer parse: outcomes; unless it is a dry run, moved cells are stored and lost spans counted as unlocated."""
        cells = self.store.version_cells().where("size(evidence) > 0")
        spans = cells.select("artifact_id", F.posexplode("evidence").alias("k", "e")).select(F.col("e.source_id").alias("source_id"), F.concat_ws("|", "artifact_id", "k").alias("span_id"), "artifact_id", "k", "e.unit_id", "e.start", "e.end", "e.text")
        units = self.store.raw("document_unit").where(F.col("parse_version") == parse_version)
        moved = self.engine._cut(documents.reanchor(spans, units).join(spans.select("span_id", "artifact_id", "k", F.col("text").alias("t")), "span_id"))
        totals = {r["outcome"]: r["n"] for r in documents.outcome_totals(moved).collect()}
        if not dry_run:
            kept = F.col("outcome") != "lost"
            span = F.struct("source_id", "unit_id", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("t")).cast("int").alias("end"), F.col("t").alias("text"))
            per = moved.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.when(kept, F.struct("k", span.alias("s"))))).alias("new"), F.count_if(~kept).cast("int").alias("lost"), F.bool_or(F.col("outcome").isin("reanchored", "lost")).alias("changed")).where("changed")
            out = cells.join(per, "artifact_id").withColumns({"evidence": F.transform("new", lambda x: x["s"]), "unlocated": F.col("unlocated") + F.col("lost"), "lineage": F.concat(F.lit("reanchored:"), "artifact_id"), "notes": F.lit(f"re-anchored to {parse_version}")})
            with self.store.transaction() as t:
                t.append_new("field_artifact", self.engine._cut(as_cells(out.drop("artifact_id", "created_at", "value_hash"), now())))
        self.engine._clear()
        return totals

    # evaluation

    def evaluate(self, gold: DataFrame, target: str, policy: ExecutionPolicy | None = None, gates: list[str] | None = None) -> dict:
        """Run the migration on the gold records, score what it made, check the gates."""
        ids = gold.select("record_id").distinct()
        index = self.engine.index(record_ids=ids)
        look = lambda: self.store.latest_cells(index).select(*KEYS, "status", F.col("value_json").alias("value"), F.coalesce(F.size("evidence"), F.lit(0)).alias("n_spans"))
        plan = self.plan(target, record_ids=ids, policy=policy)
        baseline = self.store.latest_cells(index).select(*KEYS, "status", F.col("value_json").alias("value"))
        baseline = self.engine._cut(baseline, keep=True)  # as it is before the run
        result = self.run(plan)
        cells = self.store.latest_cells(index)
        faults = validation.faults(cells, self.registry.schema(target).frame(self.spark)).select(*KEYS).distinct().withColumn("bad", F.lit(True))
        produced = look().join(faults, KEYS, "left").withColumn("valid", F.col("bad").isNull()).drop("bad")
        scored = evaluation.scores(evaluation.compare(gold, produced, baseline))
        steps = self.store.read("execution_step").where(F.col("execution_id") == result.execution_id)
        count = {r["state"]: r["n"] for r in running.state_histogram(steps).collect()}
        n = max(1, result.records)
        corpus = {"cost_usd": float(result.metrics["spent"].get("usd") or 0), "review_rate": count.get("review_needed", 0) / n, "blocked_rate": count.get("blocked", 0) / n}
        checked = [r.asDict() for r in evaluation.gate_results(scored, gates, corpus).collect()] if gates else []
        return {"scores": {r["field_id"]: r.asDict() for r in scored.collect()}, "corpus": corpus, "gates": checked, "passed": all(g["passed"] for g in checked), "execution_id": result.execution_id}

    def gold_from(self, fields: list[str] | None = None) -> DataFrame:
        return evaluation.gold_from_cells(self.store.version_cells().withColumn("value", F.col("value_json")), fields)

    def tables(self) -> list[str]:
        return sorted(TABLES)
