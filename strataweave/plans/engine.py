"""Planning and running migrations over a store.

A run is a driver loop over waves: the steps of one hop and topological level of the declarations, for all records at once. A wave is planned on the
cells as they are then, so a resumed run does what is still to be done; its answers are committed before they are read, so no model is asked twice for
one question; its cells, step states and attempts are one commit. Records whose steps all ended well and whose cells are valid are published in one
last commit. A failing step is a row with its error: neither other records nor the run end with it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.errors import EngineError
from strataweave.functions import registry as functions
from strataweave.functions.ids import content_hash, content_hash_col, now, text_hash_col
from strataweave.functions.status import has_value
from strataweave.model.migration import ExecutionPolicy, Step
from strataweave.model.recipe import ContextPolicy, Recipe, policy_from
from strataweave.model.registry import Registry
from strataweave.operators import calling, context, documents, planning, review, running, validation
from strataweave.operators.artifacts import resume_remaining
from strataweave.sources.store import SPAN, TABLES, Store

READ = "struct<status:string,value_json:string,value_hash:string,evidence:array<{SPAN}>>".replace("{SPAN}", SPAN)
MADE = "array<struct<field_id:string,status:string,value_json:string,reason:string>>"
KEYS = ["record_id", "field_id", "entity"]


@dataclass(frozen=True)
class Context:
    """What a transform of style rows gets."""

    record_id: str
    entity: str
    reads: dict
    statuses: dict
    params: dict
    vocabularies: dict


@dataclass(frozen=True)
class Result:
    """What a transform of style rows may give back besides a value or a mapping of them."""

    values: dict = field(default_factory=dict)
    statuses: dict = field(default_factory=dict)
    reason: str | None = None


@dataclass
class Plan:
    plan_id: str
    target: str
    registry_hash: str
    policy: ExecutionPolicy
    steps: DataFrame
    index: DataFrame
    blocked: dict
    stale: DataFrame
    on_stale: str = "report"

    def summary(self) -> list[dict]:
        return [r.asDict() for r in planning.summary(self.steps).collect()]

    def totals(self) -> dict:
        return planning.totals(self.steps).first().asDict()

    def render(self) -> str:
        counts = lambda df: {r[0]: r[1] for r in df.collect()}  # noqa: E731  a row a model or reason
        return planning.render(self.summary(), self.totals(), counts(planning.models(self.steps)), counts(planning.blocked_reasons(self.steps)) | self.blocked_versions(), self.stale.count(), f"plan {self.plan_id} to {self.target}")

    def blocked_versions(self) -> dict[str, int]:
        """Records of versions that can't be planned, by reason."""
        out: dict[str, int] = {}
        for r in self.index.where(F.col("schema_ref").isin(*self.blocked)).groupBy("schema_ref").count().collect() if self.blocked else ():
            out[self.blocked[r[0]]] = out.get(self.blocked[r[0]], 0) + r[1]
        return out


@dataclass(frozen=True)
class RunResult:
    execution_id: str
    status: str
    records: int
    published: int
    metrics: dict


def value_hash_col(status: Column, value_json: Column) -> Column:
    return content_hash_col(status=status, value=value_json)


def as_cells(df: DataFrame, created_at: str, **constants) -> DataFrame:
    """Rows (record_id, field_id, entity, status, value_json, ...) as artifacts: what is missing is null, the id is the hash of what the cell is."""
    kinds = dict(c.split(" ", 1) for c in TABLES["field_artifact"].replace("map<string,string>", "map<string;string>").replace(SPAN, SPAN.replace(",", ";")).split(", "))
    kinds = {k: v.replace(";", ",") for k, v in kinds.items()}
    have, of = set(df.columns) - set(constants), lambda n: F.col(n) if n in have else F.lit(constants.get(n)).cast(kinds[n])
    own = {n: of(n) for n in kinds} | {"unlocated": F.coalesce(of("unlocated"), F.lit(0)), "accepted": F.coalesce(of("accepted"), F.lit(False)), "value_hash": value_hash_col(of("status"), of("value_json")), "created_at": F.lit(created_at)}
    df = df.select(*(c.alias(n) for n, c in own.items()))
    identity = content_hash_col(
        record=F.col("record_id"), field=F.col("field_id"), entity=F.col("entity"), value=F.col("value_hash"), reason=F.col("reason"), evidence=F.to_json("evidence"), unlocated=F.col("unlocated"),
        hashes=F.to_json(F.map_from_entries(F.array_sort(F.map_entries("hashes")))), recipe=F.col("recipe_ref"), accepted=F.col("accepted"), actor=F.col("actor"), schema=F.col("schema_ref"), step=F.concat_ws("/", "migration_id", "step_id"), lineage=F.col("lineage"),
    )
    return df.withColumn("artifact_id", identity).select(*kinds)


class Engine:
    def __init__(self, store: Store, registry: Registry, adapters: dict | None = None, on_event: Callable[[dict], None] | None = None, shadow: dict[str, str] | None = None, rate: float | None = None, partitions: int | None = None):
        self.store, self.registry, self.adapters = store, registry, adapters or {}
        self.on_event, self.shadow, self.rate, self.partitions = on_event or (lambda e: None), shadow or {}, rate, partitions
        self.spark = store.spark
        self._scratch: list[str] = []
        self._kept: list[str] = []
        self._cancelled: set[str] = set()

    # scratch tables: each is written once and read from there

    def _cut(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{self.store.root}/_scratch/{uuid.uuid4().hex}"
        df.write.parquet(path)
        (self._kept if keep else self._scratch).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _clear(self, kept: bool = False) -> None:
        """Remove the scratch tables; those of plans only where asked, since plans are looked at after their run."""
        for path in self._scratch + (self._kept if kept else []):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self._scratch.clear()
        if kept:
            self._kept.clear()

    def close(self) -> None:
        self._clear(kept=True)

    # what is there

    def index(self, where: Column | None = None, record_ids: list[str] | DataFrame | None = None) -> DataFrame:
        out = self.store.read("record_index")
        if record_ids is not None:
            ids = record_ids if isinstance(record_ids, DataFrame) else self.spark.createDataFrame([(r,) for r in record_ids], "record_id string")
            out = out.join(ids, "record_id", "left_semi")
        return out if where is None else out.where(where)

    def _entities(self, index: DataFrame) -> DataFrame:
        own = self.store.raw("record_entity").join(index.select("record_id", "version_id"), ["record_id", "version_id"], "left_semi")
        return own.dropDuplicates(["record_id", "entity"])

    def _units(self, index: DataFrame) -> DataFrame:
        keys = ["source_id", "source_version", "parse_version"]
        return self.store.raw("document_unit").join(index.select(*keys).distinct(), keys, "left_semi").dropDuplicates([*keys, "unit_id"]).drop("source_version", "parse_version")

    # context

    def _policy(self, step: Step, recipe: Recipe) -> ContextPolicy:
        own = policy_from(dict(step.context)) if step.context else recipe.context
        return replace(own, on_missing=step.on_missing_context) if step.on_missing_context else own

    def _contexts(self, planned: DataFrame, cells: DataFrame, units: DataFrame, index: DataFrame, policy: ExecutionPolicy, declared: list[tuple[str, Step]], start_at: int = 0) -> tuple[DataFrame, DataFrame] | None:
        """(units chosen for each step, one row a step with satisfied, used, n_chars, context_hash); None where no step asks a model."""
        chosen, states = [], []
        reads = gather(planned, cells)
        for migration_id, step in declared:
            if not step.semantic or not step.recipe:
                continue
            own = self._policy(step, self.registry.recipe(step.recipe))
            of = (F.col("migration_id") == migration_id) & (F.col("step_id") == step.step_id)
            rows = planned.where(of)
            requests = rows.join(index.select("record_id", "source_id"), "record_id").select(F.col("step_key").alias("request_id"), "source_id", F.lit("").alias("query"))
            from_cells = rows.select("step_key").join(reads, "step_key").select(F.col("step_key").alias("request_id"), F.explode("around").alias("field_id", "r"))
            inputs = {
                "cells": rows.select("step_key", "entity").join(from_cells, F.col("step_key") == F.col("request_id")).select("request_id", "field_id", "entity", "r.status", "r.value_json"),
                "spans": from_cells.select("request_id", F.explode("r.evidence").alias("e")).select("request_id", "e.unit_id", "e.start", "e.end"),
            }
            got, state = context.resolve(requests, units, own, inputs, policy.allow_billable_retrieval, start_at)
            chosen.append(got)
            states.append(state.withColumns({"on_missing": F.lit(own.on_missing), "permitted_context": F.lit(True), "last": F.lit(len(own.effective_sequence()) - 1)}))
        if not chosen:
            return None
        units_of = self._cut(reduce(DataFrame.unionByName, chosen))
        size = context.text_size(units_of, "request_id").select("request_id", "n_chars")
        out = reduce(DataFrame.unionByName, states).join(size, "request_id", "left").join(context.context_hash(units_of), "request_id", "left")
        return units_of, self._cut(out.withColumnRenamed("request_id", "step_key"))

    def _wave(self, index: DataFrame, cells: DataFrame, steps: DataFrame, policy: ExecutionPolicy, declared, entities: DataFrame, prices=None) -> tuple[DataFrame, tuple | None]:
        """(planned steps, contexts) on the cells as they are."""
        units = self._units(index)
        expanded = planning.expand(index, entities, steps)
        contexts = self._contexts(expanded, cells, units, index, policy, declared)
        cache = self.store.read("answer_cache").select("cache_key").distinct()
        planned = planning.plan(index, entities, cells, steps, cache, contexts[1] if contexts else None, prices or (0.0, 0.0))
        refused = [s.recipe for _, s in declared if s.recipe and not self._may(s.recipe, policy)]
        if refused:
            bad = (F.col("disposition") == "semantic") & F.col("recipe").isin(*refused)
            planned = planned.withColumn("reason", F.when(bad, "provider_forbidden").otherwise(F.col("reason"))).withColumn("disposition", F.when(bad, "blocked").otherwise(F.col("disposition")))
        return planned, contexts

    def _may(self, ref: str, policy: ExecutionPolicy) -> bool:
        r = self.registry.recipe(ref)
        known = [a for n, a in self.adapters.items() if n in (r.model, *r.fallbacks)]
        return not known or any(policy.permits_provider(a.provider, a.attributes) for a in known)

    def _prices(self, declared) -> tuple[float, float]:
        for _, s in declared:
            if s.recipe and (a := self.adapters.get(self.registry.recipe(s.recipe).model)):
                return a.usd_in, a.usd_out
        return 0.0, 0.0

    def _declared(self, starts: list[str], target: str, policy: ExecutionPolicy) -> dict[tuple[int, int], list[tuple[str, Step]]]:
        """Declared steps by (hop, level) over all starting versions."""
        out: dict[tuple[int, int], dict] = {}
        for start in starts:
            for hop, m in enumerate(self.registry.path(start, target, policy.preference)):
                for level, steps in enumerate(m.levels()):
                    out.setdefault((hop, level), {}).update({(m.migration_id, s.step_id): s for s in steps})
        return {k: [(m, s) for (m, _), s in v.items()] for k, v in sorted(out.items())}

    # plan

    def plan(self, target: str, where: Column | None = None, record_ids: list[str] | DataFrame | None = None, policy: ExecutionPolicy | None = None, on_stale: str = "report") -> Plan:
        """A dry run: one row a step and entity, with what would be done. Records that can't be planned are in blocked, by version with the reason."""
        policy = policy or ExecutionPolicy()
        self.registry.schema(target)
        index = self._cut(self.index(where, record_ids), keep=True)
        starts = sorted(r[0] for r in index.select("schema_ref").distinct().collect())
        steps, blocked = planning.compile_steps(self.spark, self.registry, starts, target, policy)
        open_ = index.where(~F.col("schema_ref").isin(*blocked)) if blocked else index
        declared = [x for wave in self._declared([s for s in starts if s not in blocked], target, policy).values() for x in wave]
        cells, entities = self._cut(self.store.latest_cells(open_)), self._entities(open_)
        planned, _ = self._wave(open_, cells, steps, policy, declared, entities, self._prices(declared))
        planned = self._cut(planned, keep=True)
        stale = self._cut(self._stale(cells, target, planned), keep=True)
        plan_id = content_hash([target, planning.signature(planned, self.registry.registry_hash), policy.__dict__ | {"providers_allowed": policy.providers_allowed}])
        plan = Plan(plan_id, target, self.registry.registry_hash, policy, planned, index, blocked, stale, on_stale)
        with self.store.transaction() as t:
            row = [(plan_id, target, plan.registry_hash, json.dumps({"by": plan.summary(), "all": plan.totals(), "blocked": blocked}, default=str), now())]
            t.append("plan", self.spark.createDataFrame(row, TABLES["plan"]))
        self._clear()
        return plan

    def _stale(self, cells: DataFrame, target: str, planned: DataFrame) -> DataFrame:
        fields = self.registry.schema(target).frame(self.spark)
        wants = fields.select("field_id", F.create_map(F.concat(F.lit("field_def:"), "field_id"), "semantic_key").alias("expected"), "deterministic")
        judged = planning.currency(cells.join(F.broadcast(wants), "field_id"), recipe=None)
        return planning.stale_fields(judged, wants.select("field_id", "deterministic"), planned).select(*KEYS, "state", "stale_keys", "value_json")

    # run

    def run(self, plan: Plan, execution_id: str | None = None, resume: bool = False) -> RunResult:
        if plan.registry_hash != self.registry.registry_hash:
            raise EngineError("registry_moved", "the registry has changed since the plan was made")
        execution_id = execution_id or f"run-{uuid.uuid4().hex[:12]}"
        known = self.store.read("execution").where(F.col("execution_id") == execution_id).collect()
        if known and not resume:
            raise EngineError("execution_exists", execution_id)
        if resume and not known:
            raise EngineError("execution_unknown", execution_id)
        if known and known[0]["target"] != plan.target:
            raise EngineError("plan_changed", f"{execution_id} went to {known[0]['target']}")
        self._execution(execution_id, plan, "running", {})
        self.store.save_document(f"policy-{execution_id}", dict(plan.policy.__dict__))
        index = plan.index.where(~F.col("schema_ref").isin(*plan.blocked)) if plan.blocked else plan.index
        index = self._cut(index)
        starts = sorted(r[0] for r in index.select("schema_ref").distinct().collect())
        steps, _ = planning.compile_steps(self.spark, self.registry, starts, plan.target, plan.policy)
        waves = self._declared(starts, plan.target, plan.policy)
        entities = self._cut(self._entities(index))
        for (hop, level), declared in waves.items():
            if execution_id in self._cancelled:
                break
            self._run_wave(execution_id, plan, index, entities, steps.where((F.col("hop") == hop) & (F.col("level") == level)), declared)
            self.on_event({"execution_id": execution_id, "event": "wave", "hop": hop, "level": level})
        if plan.on_stale in ("review", "refresh"):
            self._raise_stale(execution_id, plan)
        result = self._finish(execution_id, plan, index, entities)
        self._clear()
        return result

    def resume(self, execution_id: str, plan: Plan) -> RunResult:
        self._cancelled.discard(execution_id)
        return self.run(plan, execution_id, resume=True)

    def cancel(self, execution_id: str) -> None:
        """No further wave begins; those that ended stay."""
        self._cancelled.add(execution_id)

    def _execution(self, execution_id: str, plan: Plan, status: str, metrics: dict) -> None:
        with self.store.transaction() as t:
            row = [(execution_id, plan.plan_id, plan.target, status, json.dumps(metrics, default=str), plan.registry_hash, now(), t.seq)]
            t.append("execution", self.spark.createDataFrame(row, TABLES["execution"]))

    def _run_wave(self, execution_id: str, plan: Plan, index: DataFrame, entities: DataFrame, steps: DataFrame, declared: list[tuple[str, Step]]) -> None:
        cells = self._cut(self.store.latest_cells(index))
        planned, contexts = self._wave(index, cells, steps, plan.policy, declared, entities)
        done = self.store.read("execution_step").where(F.col("execution_id") == execution_id)
        planned = self._cut(resume_remaining(planned, done, ["step_key"]))
        reads = self._cut(gather(planned, cells))
        at = now()
        made, states = [], []
        plain = F.when(F.col("disposition").isin("reuse", "validate"), "succeeded").when(F.col("disposition") == "review", "review_needed").otherwise("blocked")
        rest = planned.where(F.col("disposition").isin("reuse", "validate", "review", "blocked"))
        states.append(rest.select("step_key", plain.alias("state"), F.regexp_extract(F.coalesce("reason", F.lit("")), "^([a-z_]*)", 1).alias("code"), F.col("reason").alias("message")))
        for migration_id, step in declared:
            of = planned.where((F.col("migration_id") == migration_id) & (F.col("step_id") == step.step_id))
            if step.deterministic:
                rows = of.where("disposition = 'deterministic'").join(reads, "step_key", "left")
                out = self._cut(self._transform(rows, step))
                states.append(out.select("step_key", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("state"), "error", "message").toDF("step_key", "state", "code", "message"))
                made.append(self._deterministic_cells(out.where("error IS NULL").select("step_key", F.explode("made").alias("m")), of, reads, step))
            elif step.semantic and step.recipe:
                cells_of, states_of = self._semantic(execution_id, of.where(F.col("disposition").isin("semantic", "cached")), reads, step, contexts, index, cells, plan)
                made.append(cells_of)
                states.append(states_of)
        cells_made = [self._cut(as_cells(m, at, execution_id=execution_id)) for m in made]
        flagged = [m.where("status = 'review_required'").select("record_id", "entity", "migration_id", "step_id") for m in cells_made]
        keys = planned.select("step_key", "record_id", "entity", "migration_id", "step_id", "disposition", "writes")
        state = reduce(DataFrame.unionByName, states).join(keys, "step_key")
        if flagged:
            asks = reduce(DataFrame.unionByName, flagged).distinct().withColumn("asks", F.lit(True))
            state = state.join(asks, ["record_id", "entity", "migration_id", "step_id"], "left").withColumn("state", F.when(F.col("asks") & (F.col("state") == "succeeded"), "review_needed").otherwise(F.col("state")))
        state = self._cut(state)
        proposed = reduce(DataFrame.unionByName, [m.select(*KEYS, "value_json") for m in cells_made]) if cells_made else None
        items = self._items(state.where("state = 'review_needed'"), cells, proposed, at)
        with self.store.transaction() as t:
            for m in cells_made:
                t.append_new("field_artifact", m)
            t.append("execution_step", state.withColumns({"execution_id": F.lit(execution_id), "seq": F.lit(t.seq)}))
            raised = items.withColumns({"execution_id": F.lit(execution_id), "seq": F.lit(t.seq)})
            stored = self.store.read("review_item")
            t.append("review_item", review.reopen(stored.join(raised.select("item_id"), "item_id", "left_semi"), raised.select(*stored.columns)).withColumn("seq", F.lit(t.seq)))

    def _items(self, state: DataFrame, cells: DataFrame, proposed: DataFrame | None, at: str) -> DataFrame:
        slots = state.select("record_id", "entity", F.coalesce("message", F.lit("review")).alias("reason"), F.explode("writes").alias("field_id"))
        out = slots.join(cells.select(*KEYS, F.col("value_json").alias("old_value")), KEYS, "left")
        out = out.join(proposed.withColumnRenamed("value_json", "proposed_value"), KEYS, "left") if proposed is not None else out.withColumn("proposed_value", F.lit(None).cast("string"))
        return review.open_items(out.withColumn("created_at", F.lit(at)))

    def _raise_stale(self, execution_id: str, plan: Plan) -> None:
        rows = plan.stale.select(*KEYS, F.concat(F.lit("stale: "), F.array_join("stale_keys", ", ")).alias("reason"), F.col("value_json").alias("old_value"), F.lit(None).cast("string").alias("proposed_value"), F.lit(now()).alias("created_at"))
        keys = planning.stale_reviews(plan.stale, plan.target)
        with self.store.transaction() as t:
            t.append("review_item", review.open_items(rows).withColumns({"execution_id": F.lit(execution_id), "seq": F.lit(t.seq)}))
            t.append("execution_step", keys.select(F.lit(execution_id).alias("execution_id"), F.concat_ws("|", "record_id", "migration_id", "step_id", "entity").alias("step_key"), "record_id", "migration_id", "step_id", "disposition", F.lit("review_needed").alias("state"), F.lit(t.seq).alias("seq")))

    # deterministic steps

    def _transform(self, rows: DataFrame, step: Step) -> DataFrame:
        """(step_key, made MADE, error, message) of a step's rows."""
        f = functions.find("transform", step.transform) if step.transform else None
        if f is None or f.style == "columns":
            read = lambda r, part: F.try_element_at("seen", F.lit(r))[part]
            values = {r: read(r, "value_json") for r in (*step.reads, *step.optional_reads)}
            if f is not None:
                made = f.call(values, dict(step.params))
            elif step.kind == "drop":
                made = {w: F.lit(None).cast("string") for w in step.writes}
            elif step.kind == "default":
                made = {w: F.lit(json.dumps(step.params.get("value"))) for w in step.writes}
            elif step.kind in ("copy", "rename") and step.reads:
                made = {w: values[step.reads[min(k, len(step.reads) - 1)]] for k, w in enumerate(step.writes)}
            else:
                raise EngineError("config_invalid", f"{step.step_id} names no transform")
            structs = []
            for w, value in made.items():
                status = F.when(value.isNotNull(), "present").otherwise("not_reported")
                if f is None and step.kind in ("copy", "rename"):
                    status = F.coalesce(read(step.reads[min(list(made).index(w), len(step.reads) - 1)], "status"), F.lit("not_extracted"))
                structs.append(F.struct(F.lit(w).alias("field_id"), status.alias("status"), value.alias("value_json"), F.lit(None).cast("string").alias("reason")))
            return rows.select("step_key", F.array(*structs).cast(MADE).alias("made"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("message"))
        call, writes, params = f.call, list(step.writes), dict(step.params)
        vocabularies = {v: self.registry.vocabulary(v) for v in step.vocabularies}

        def run(frames):
            for frame in frames:
                out = []
                for row in frame.to_dict("records"):
                    read = dict(row["seen"]) if row["seen"] is not None else {}
                    values = {k: json.loads(r["value_json"]) if r["value_json"] is not None else None for k, r in read.items()}
                    ctx = Context(row["record_id"], row["entity"], values, {k: r["status"] for k, r in read.items()}, params, vocabularies)
                    try:
                        out.append((row["step_key"], coerce(call(ctx), writes), None, None))
                    except Exception as e:  # noqa: BLE001  one row's failure stays with the row
                        out.append((row["step_key"], None, getattr(e, "code", "transform_failed"), f"{type(e).__name__}: {e}"[:500]))
                yield pd.DataFrame(out, columns=["step_key", "made", "error", "message"])

        return rows.select("step_key", "record_id", "entity", "seen").mapInPandas(run, f"step_key string, made {MADE}, error string, message string")

    def _deterministic_cells(self, made: DataFrame, planned: DataFrame, reads: DataFrame, step: Step) -> DataFrame:
        """Cells of a transform's results; evidence is that of the one field read, lineage the hashes of those that the step doesn't write itself."""
        both = made.join(planned.select("step_key", "record_id", "entity", "migration_id", "step_id", "to_schema", "static", "deps"), "step_key").join(reads.select("step_key", "seen"), "step_key", "left")
        inherited = F.try_element_at("seen", F.lit(step.reads[0]))["evidence"] if len(step.reads) == 1 else F.lit(None).cast(f"array<{SPAN}>")
        sources = [r for r in (*step.reads, *step.optional_reads) if r not in step.writes]
        lineage = F.array_join(F.array(*(F.concat(F.lit(f"{r}:"), F.coalesce(F.try_element_at("seen", F.lit(r))["value_hash"], F.lit("absent"))) for r in sorted(sources))), ",") if sources else F.lit(None).cast("string")
        in_place = ",".join(r for r in step.reads if r in step.writes)
        return both.select(
            "record_id", "m.field_id", "entity", "m.status", "m.value_json", "m.reason", inherited.alias("evidence"), own_hashes("m.field_id").alias("hashes"), lineage.alias("lineage"), F.lit(f"in place: {in_place}" if in_place else None).cast("string").alias("notes"),
            F.col("to_schema").alias("schema_ref"), "migration_id", "step_id", F.lit("migration").alias("actor"),
        )

    # semantic steps

    def _call(self, recipe: Recipe, policy: ExecutionPolicy, step: Step) -> calling.Call:
        builder = functions.find("prompt_builder", recipe.prompt_builder).call if recipe.prompt_builder else None
        after = functions.find("postprocessor", recipe.postprocessor).call if recipe.postprocessor else None
        mine = {n: a for n, a in self.adapters.items() if n in (recipe.model, *recipe.fallbacks)}
        return calling.Call(recipe, mine, calling.permitted_adapters(mine, policy), builder, after, recipe.model_params.get("output_schema"), self.rate)

    def _requests(self, rows: DataFrame, reads: DataFrame, chosen: DataFrame, level: int) -> DataFrame:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ordinal", "unit_id", F.concat(F.lit("["), F.concat_ws(" ", "unit_id", F.nullif("section", F.lit(""))), F.lit("]\n"), "text").alias("t")))), lambda u: u["t"]), "\n\n---\n\n")
        rendered = chosen.groupBy(F.col("request_id").alias("step_key")).agg(text.alias("context"))
        values = F.transform_values("seen", lambda _, r: r["value_json"])
        out = rows.drop("reads").join(rendered, "step_key", "left").join(reads.select("step_key", values.alias("reads")), "step_key", "left")
        return out.select("step_key", "record_id", "entity", "step_id", "writes", "cache_key", F.coalesce("context", F.lit("")).alias("context"), "reads", F.lit(level).alias("level"))

    def _semantic(self, execution_id: str, rows: DataFrame, reads: DataFrame, step: Step, contexts, index: DataFrame, cells: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
        recipe = self.registry.recipe(step.recipe)
        call = self._call(recipe, plan.policy, step)
        chosen, state = contexts
        asking = self._cut(rows)
        answers, overdue = [], []
        units_used = []
        for level in range(recipe.escalation.max_escalations + 1 if recipe.escalation.enabled else 1):
            asked = self._cut(self._requests(asking, reads, chosen, level))
            got = self._ask(execution_id, asked, call, recipe, plan)
            units_used.append(chosen.join(got.select(F.col("step_key").alias("request_id")), "request_id", "left_semi").withColumn("level", F.lit(level)))
            if level == 0 and (other := self.shadow.get(recipe.ref) or recipe.shadow):
                self._compare(execution_id, asked, self.registry.recipe(other), plan, step, got)
            if not recipe.escalation.enabled:
                answers.append(got)
                break
            answers.append(got.where("error IS NOT NULL OR NOT wants_more"))
            again = asking.join(got.where("error IS NULL AND wants_more").select("step_key"), "step_key", "left_semi")
            tired = again.where(F.lit(level >= recipe.escalation.max_escalations) | (F.col("used") >= F.col("last")))
            overdue.append(tired.select("step_key", F.lit("escalation is exhausted").alias("message")))
            again = self._cut(again.join(tired.select("step_key"), "step_key", "left_anti"))
            starts = sorted(r[0] for r in again.select("used").distinct().collect())  # places in the context's sequence: a few
            if not starts:
                break
            wider = [self._contexts(again.where(F.col("used") == k), cells, self._units(index), index, plan.policy, [(m, s) for m, s in [(plan_id_of(rows), step)]], k + 1) for k in starts]
            chosen = reduce(DataFrame.unionByName, (c for c, _ in wider))
            state = reduce(DataFrame.unionByName, (s for _, s in wider))
            ready = state.where("satisfied AND n_units > 0").select("step_key", F.col("used").alias("u"), F.col("context_hash").alias("h"))
            overdue.append(again.join(ready, "step_key", "left_anti").select("step_key", F.lit("no further context").alias("message")))
            key = content_hash_col(first=F.col("cache_key"), context=F.col("h"))
            asking = self._cut(again.join(ready, "step_key").withColumn("cache_key", key).withColumn("used", F.col("u")).drop("u", "h"))
        answered = reduce(DataFrame.unionByName, answers)
        units_used = reduce(DataFrame.unionByName, units_used)
        cells_of = self._answer_cells(rows, answered.where("error IS NULL"), units_used, index, step, recipe)
        state_of = F.when(F.col("error").isNull(), "succeeded").when(F.col("error") == "fingerprint_mismatch", "review_needed").when(F.col("error").isin("budget_exhausted", "provider_forbidden"), "blocked").otherwise("failed")
        states = answered.select("step_key", state_of.alias("state"), F.col("error").alias("code"), "message")
        for o in overdue:
            states = states.unionByName(o.select("step_key", F.lit("review_needed").alias("state"), F.lit("context_unavailable").alias("code"), "message"))
        bad = cells_of.where("outcome = 'fail'").select("step_key").distinct().withColumn("bad", F.lit(True))
        states = states.join(bad, "step_key", "left").select("step_key", F.when(F.col("bad"), "failed").otherwise(F.col("state")).alias("state"), F.when(F.col("bad"), "validation_failed").otherwise(F.col("code")).alias("code"), "message")
        return cells_of.where("outcome <> 'fail'").drop("outcome", "step_key"), states

    def _ask(self, execution_id: str, asked: DataFrame, call: calling.Call, recipe: Recipe, plan: Plan) -> DataFrame:
        """Answers from the cache, and for the rest from the model within the run's budget; new answers are committed to the cache first."""
        cache = self.store.read("answer_cache").dropDuplicates(["cache_key"])
        hit = asked.select("step_key", "cache_key").join(cache, "cache_key").select("step_key", "cache_key", "cells", "wants_more")
        miss = asked.join(cache.select("cache_key"), "cache_key", "left_anti")
        miss, refused = self._admit(execution_id, miss, recipe, plan)
        got = self._cut(calling.ask(miss, call, self.partitions))
        tried = got.select(F.lit(execution_id).alias("execution_id"), "step_key", "level", F.lit("call").alias("kind"), F.explode("tries").alias("t")).select("execution_id", "step_key", "level", "kind", "t.adapter", F.row_number().over(Window.partitionBy("step_key", "level").orderBy(F.lit(1))).cast("int").alias("attempt"), "t.outcome", "t.message")
        with self.store.transaction() as t:
            t.append_new("answer_cache", got.where("error IS NULL").withColumns({"recipe_ref": F.lit(recipe.ref), "created_at": F.lit(now())}))
            t.append("attempt", tried)
            spent = got.groupBy().agg(F.count_if(F.col("output").isNotNull()).alias("calls"), F.count("*").alias("reserved"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("usd").alias("usd")).first().asDict()
            metrics = self.store.document(f"spent-{execution_id}") or {}
            t.document(f"spent-{execution_id}", {k: (metrics.get(k) or 0) + (v or 0) for k, v in spent.items()})
        none = F.lit(None).cast("string")
        from_cache = hit.select("step_key", "cells", none.alias("error"), none.alias("message"), "wants_more")
        return self._cut(from_cache.unionByName(got.select("step_key", "cells", "error", "message", "wants_more")).unionByName(refused))

    def _admit(self, execution_id: str, miss: DataFrame, recipe: Recipe, plan: Plan) -> tuple[DataFrame, DataFrame]:
        """Calls in order of step_key while the caps of the run (calls, USD) and of the recipe (USD) hold; USD are estimated before, counted after."""
        spent = self.store.document(f"spent-{execution_id}") or {}
        adapter = self.adapters.get(recipe.model)
        each = F.lit(0.0) if adapter is None else (F.ceil(F.length("context") / 4.0) * adapter.usd_in + recipe.out_tokens * adapter.usd_out) / 1e6
        usd = min((c for c in (plan.policy.max_usd, recipe.max_usd) if c is not None), default=None)
        ok = miss
        if plan.policy.max_calls is not None:
            ok = running.admit(ok.withColumn("one", F.lit(1.0)), plan.policy.max_calls - spent.get("reserved", 0), "one").where("admitted").drop("one", "running", "admitted")
        if usd is not None:
            ok = running.admit(ok.withColumn("usd", each), usd - spent.get("usd", 0.0)).where("admitted").drop("usd", "running", "admitted")
        if ok is miss:
            return miss, miss.where("false").select("step_key", F.lit(None).cast(calling.CELLS).alias("cells"), F.lit("").alias("error"), F.lit("").alias("message"), F.lit(False).alias("wants_more"))
        ok = self._cut(ok)
        left = miss.join(ok.select("step_key"), "step_key", "left_anti")
        return ok, left.select("step_key", F.lit(None).cast(calling.CELLS).alias("cells"), F.lit("budget_exhausted").alias("error"), F.lit("the run's budget is spent").alias("message"), F.lit(False).alias("wants_more"))

    def _compare(self, execution_id: str, asked: DataFrame, other: Recipe, plan: Plan, step: Step, got: DataFrame) -> None:
        """The same requests to another recipe; what it says is only logged."""
        shadow = self._cut(calling.ask(asked, self._call(other, plan.policy, step), self.partitions))
        said = lambda df, c: df.select("step_key", content_hash_col(x=F.to_json(F.transform("cells", lambda k: F.struct(k["field_id"], k["status"], k["value_json"])))).alias(c), F.col("error").alias(f"{c}_error"))
        both = said(shadow, "b").join(said(got, "a"), "step_key")
        outcome = F.when(F.col("b_error").isNotNull(), "error").when(F.col("a") == F.col("b"), "agree").otherwise("differ")
        with self.store.transaction() as t:
            t.append("attempt", both.select(F.lit(execution_id).alias("execution_id"), "step_key", F.lit(0).alias("level"), F.lit("shadow").alias("kind"), F.lit(other.ref).alias("adapter"), F.lit(1).alias("attempt"), outcome.alias("outcome")))

    def _answer_cells(self, rows: DataFrame, answered: DataFrame, units: DataFrame, index: DataFrame, step: Step, recipe: Recipe) -> DataFrame:
        """Cells of answers: quotes become spans of the first unit that holds them, validators may fail a cell or ask for its review."""
        each = rows.select("step_key", "record_id", "entity", "migration_id", "step_id", "to_schema", "static", "deps").join(answered.select("step_key", F.explode("cells").alias("c")), "step_key").join(index.select("record_id", "source_id"), "record_id", "left")
        each = self._cut(each.select("*", "c.*").drop("c"))
        quotes = each.select("step_key", "field_id", F.posexplode("quotes").alias("k", "quote")).withColumn("quote_id", F.concat_ws("|", "field_id", "k"))
        whole = units.select(F.col("request_id").alias("step_key"), "unit_id", "text", F.struct(-F.col("level"), "seq", "ordinal").alias("ordinal"))
        placed = documents.place_quotes(quotes.select("step_key", "quote_id", "quote"), whole, "step_key").join(quotes.select("step_key", "quote_id", "field_id", "k"), ["step_key", "quote_id"])
        spans = placed.groupBy("step_key", "field_id").agg(F.array_sort(F.collect_list(F.when(F.col("unit_id").isNotNull(), F.struct("k", "unit_id", "start", "end", "quote")))).alias("at"), F.count_if(F.col("unit_id").isNull()).cast("int").alias("unlocated"))
        out = each.join(spans, ["step_key", "field_id"], "left")
        # a slice's id ends in :start-end; spans are stored relative to the whole unit
        slice_start = lambda u: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(u, r":(\d+)-\d+$", 1), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))
        evidence = F.transform(F.coalesce("at", F.array().cast("array<struct<k:int,unit_id:string,start:int,end:int,quote:string>>")), lambda s: F.struct(F.col("source_id"), F.regexp_replace(s["unit_id"], r":\d+-\d+$", "").alias("unit_id"), (s["start"] + slice_start(s["unit_id"])).alias("start"), (s["end"] + slice_start(s["unit_id"])).alias("end"), s["quote"].alias("text")))
        out = out.withColumn("evidence", evidence.cast(f"array<{SPAN}>")).withColumns({"n_spans": F.size("evidence"), "texts": F.transform("evidence", lambda e: e["text"]), "value": F.coalesce(F.try_variant_get(F.try_parse_json("value_json"), "$", "string"), F.col("value_json"))})
        outcome = F.lit("pass")
        for ref in step.validators:
            outcome = worse(outcome, validator_column(ref))
        out = out.withColumn("outcome", outcome)
        status = F.when((F.col("outcome") == "review") & has_value(F.col("status")), "review_required").otherwise(F.col("status"))
        return out.select(
            "step_key", "record_id", "field_id", "entity", status.alias("status"), "value_json", "reason", "evidence", "unlocated", own_hashes("field_id").alias("hashes"), F.lit(recipe.ref).alias("recipe_ref"),
            F.col("to_schema").alias("schema_ref"), "migration_id", "step_id", F.lit("model").alias("actor"), "outcome",
        )

    # end of a run

    def _finish(self, execution_id: str, plan: Plan, index: DataFrame, entities: DataFrame) -> RunResult:
        """Validate, publish or hold, and close; versions, pointers and index rows are one commit."""
        steps = self.store.read("execution_step").where(F.col("execution_id") == execution_id)
        cells = self.store.latest_cells(index)
        schema = self.registry.schema(plan.target)
        fields = schema.frame(self.spark)
        cells = self._cut(cells.join(F.broadcast(fields.select("field_id")), "field_id", "left_semi"))
        faults = self._cut(validation.validate(cells, fields))
        every = index.select("record_id").join(steps.select("record_id", "state"), "record_id", "left").withColumn("state", F.coalesce("state", F.lit("succeeded")))
        cancelled = execution_id in self._cancelled
        decided = self._cut(running.publish_or_hold(every, faults.where("outcome = 'fail'")))
        ids = cells.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("artifact_id")), ",").alias("ids"))
        kept = entities.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("ents"))
        version = content_hash_col(record=F.col("record_id"), schema=F.lit(plan.target), artifacts=F.col("ids"), entities=F.col("ents"), parent=F.col("parent"))
        at = now()
        versions = decided.join(ids, "record_id", "left").join(kept, "record_id", "left").join(index.select("record_id", F.col("version_id").alias("parent")), "record_id")
        versions = self._cut(versions.withColumn("version_id", version).select("version_id", "record_id", F.lit(plan.target).alias("schema_ref"), F.col("version_state").alias("state"), "parent", F.lit(execution_id).alias("execution_id"), F.lit(at).alias("created_at"), "decision"))
        status = running.run_status(decided, cancelled).first()
        if not cancelled:
            with self.store.transaction() as t:
                t.append("record_version", versions)
                superseded = versions.where("decision = 'publish' AND parent IS NOT NULL AND parent <> version_id").select(F.col("parent").alias("version_id"), "record_id", F.lit("superseded").alias("state"), F.lit(execution_id).alias("execution_id"), F.lit(at).alias("created_at"))
                t.append("record_version", superseded)
                live = versions.where("decision = 'publish'")
                t.append("version_artifact", cells.select("record_id", "artifact_id").join(live.select("record_id", "version_id"), "record_id"))
                t.append("record_entity", entities.drop("version_id").join(live.select("record_id", "version_id"), "record_id"))
                moved = index.drop("schema_ref", "state", "version_id", "updated_at", "seq").join(live.select("record_id", "version_id"), "record_id")
                t.append("record_index", moved.withColumns({"schema_ref": F.lit(plan.target), "state": F.lit("published"), "updated_at": F.lit(at), "seq": F.lit(t.seq)}))
                held = index.drop("state", "updated_at", "seq").join(versions.where("decision = 'hold'").select("record_id", "state"), "record_id")
                t.append("record_index", held.withColumns({"updated_at": F.lit(at), "seq": F.lit(t.seq)}))
        spent = self.store.document(f"spent-{execution_id}") or {}
        by_state = {r["state"]: r["n"] for r in running.state_histogram(steps).collect()}
        metrics = {"spent": spent, "steps": by_state} | running.metrics(steps).first().asDict() | {"calls": spent.get("calls", 0)}
        n, done = status["records"], status["published"]
        final = "succeeded" if n == 0 and not cancelled else status["status"]
        self._execution(execution_id, plan, final, metrics)
        self.on_event({"execution_id": execution_id, "event": "finished", "status": final})
        return RunResult(execution_id, final, n, done, metrics)


# pieces --------------------------------------------------------------------------------------------------------------------------------


def plan_id_of(rows: DataFrame) -> str:
    """The migration of a step's rows (all the same)."""
    row = rows.select("migration_id").first()
    return row[0] if row else ""


def own_hashes(field_id: str) -> Column:
    """What a produced cell hangs on: the step's static hashes without those of other fields, and the hashes of what was read."""
    mine = F.map_filter("static", lambda k, _: ~F.startswith(k, F.lit("field_def:")) | (k == F.concat(F.lit("field_def:"), F.col(field_id))))
    return F.map_concat(mine, F.coalesce("deps", F.create_map().cast("map<string,string>")))


def gather(planned: DataFrame, cells: DataFrame) -> DataFrame:
    """(step_key, seen, around): maps from field to what the step's entity, or else the root, has of it; seen of the fields it reads, around also of those it writes."""
    wants = planned.select("step_key", "record_id", "entity", "reads", F.explode(F.array_distinct(F.concat("reads", "writes"))).alias("field_id"))
    value = F.struct("status", "value_json", "value_hash", F.coalesce("evidence", F.array().cast(f"array<{SPAN}>")).alias("evidence"))
    own = cells.select(*KEYS, value.alias("own"))
    root = cells.where("entity = ''").select("record_id", "field_id", value.alias("root"))
    found = wants.join(own, KEYS, "left").join(root, ["record_id", "field_id"], "left").withColumn("r", F.coalesce("own", "root")).where("r IS NOT NULL")
    entry = F.struct("field_id", "r")
    maps = found.groupBy("step_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.array_contains("reads", F.col("field_id")), entry)))).alias("seen"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("around"))
    return maps


def coerce(out, writes: list[str]) -> list[dict]:
    """A transform's result as cells: a Result, a mapping of written fields, or the value of the only one. Fields that are left out are skipped."""
    if not isinstance(out, Result):
        is_map = isinstance(out, dict) and (out.keys() <= set(writes)) and (len(writes) > 1 or out)
        out = Result(out if is_map else {writes[0]: out})
        if len(writes) > 1 and not is_map:
            raise EngineError("transform_failed", "a step of several outputs needs a mapping")
    cells = []
    for w in writes:
        if w in out.values or w in out.statuses:
            v = out.values.get(w)
            status = out.statuses.get(w, "not_reported" if v is None else "present")
            cells.append({"field_id": w, "status": status, "value_json": json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True) if status in ("present", "review_required") else None, "reason": out.reason})
    return cells


def validator_column(ref: str) -> Column:
    """A validator's outcome: built from columns (status, value, value_json, reason, n_spans, texts), or called for each row (value, status) in Arrow batches."""
    built_in = {"require_evidence": validation.require_evidence, "evidence_supports_value": validation.supports_value, "abstention_is_honest": validation.honest_abstention}
    if ref.partition("@")[0] in built_in and not any(k == ("validator", ref) for k in functions._FUNCTIONS):
        return built_in[ref.partition("@")[0]]()
    f = functions.find("validator", ref)
    if f.style == "columns":
        return f.call()
    call = f.call

    @F.pandas_udf("string")
    def each(value: pd.Series, status: pd.Series) -> pd.Series:
        def one(v, s):
            try:
                out = call(json.loads(v) if v is not None else None, s)
            except Exception:  # noqa: BLE001  a validator that fails fails its cell
                return "fail"
            out = out[0] if isinstance(out, tuple) else out
            return "pass" if out is None or out is True else "fail" if out is False else str(out)

        return pd.Series([one(v, s) for v, s in zip(value, status, strict=True)])

    return each(F.col("value_json"), F.col("status"))


def worse(a: Column, b: Column) -> Column:
    rank = lambda c: F.when(c == "fail", 2).when(c == "review", 1).otherwise(0)
    return F.when(rank(b) > rank(a), b).otherwise(a)


def with_policy(plan: Plan, **changes) -> Plan:
    return replace(plan, policy=replace(plan.policy, **changes))


def stamped(cells: DataFrame, schema, text: str = "static") -> DataFrame:
    """Cells of an import with the meaning of their fields now, so that they count as current under this version."""
    fields = schema.frame(cells.sparkSession).select("field_id", F.create_map(F.concat(F.lit("field_def:"), "field_id"), "semantic_key").alias("hashes"))
    return cells.join(F.broadcast(fields), "field_id", "left")


__all__ = ["Context", "Engine", "Plan", "Result", "RunResult", "as_cells", "coerce", "gather", "own_hashes", "stamped", "text_hash_col"]
