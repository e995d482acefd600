"""Command line over a project: python -m strataweave.cli --store DIR GROUP COMMAND ... [--json].

Exit codes: 0 done; 1 an invalid migration or a failed gate; 2 a structured error."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataweave.errors import EngineError
from strataweave.model.migration import ExecutionPolicy, dump_migrations, load_migrations, scaffold
from strataweave.model.recipe import Vocabulary, load_recipes
from strataweave.model.schema import diff_schemas
from strataweave.project import Project
from strataweave.sources import config, declarations, jsonl


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _load_schema(args):
    identity = json.loads(args.identity) if args.identity else None
    if args.format == "linkml":
        return declarations.from_linkml(args.file, args.name, args.version, args.root, identity)
    if args.format == "pydantic":
        module, _, name = args.file.partition(":")
        return declarations.from_pydantic(getattr(importlib.import_module(module), name), args.name, args.version, identity)
    return declarations.from_json_schema(json.loads(_read(args.file)), args.name, args.version, identity)


def _rows(df, limit: int | None = None) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df if limit is None else df.limit(limit)).collect()]


def _policy(args) -> ExecutionPolicy:
    return ExecutionPolicy(allow_lossy=args.allow_lossy, allow_destructive=bool(args.allow_destructive), destructive_named=tuple(args.allow_destructive or ()), preference=args.prefer, max_usd=args.max_usd, max_calls=args.max_calls)


# commands: (project, args) -> what is shown


def schema_register(p, a):
    s = _load_schema(a)
    p.register(s)
    return {"ref": s.ref, "fields": len(s.fields), "hash": s.schema_hash}


def schema_list(p, a):
    return p.registry.listed("schemas")


def schema_diff(p, a):
    d = diff_schemas(p.registry.schema(a.old), p.registry.schema(a.new))
    return {"changes": [c.__dict__ for c in d.changes], "compatible": d.verdicts(), "rename_candidates": list(d.candidates)}


def migration_new(p, a):
    new = p.registry.schema(a.new)
    return dump_migrations([scaffold(diff_schemas(p.registry.schema(a.old), new), new)])


def migration_register(p, a):
    found = load_migrations(_read(a.file))
    p.register(*found)
    return [m.migration_id for m in found]


def migration_validate(p, a):
    out = {m.migration_id: p.registry.check(m) for m in load_migrations(_read(a.file))}
    a.exit_code = int(any(out.values()))
    return out


def migration_list(p, a):
    return [{"id": m.migration_id, "from": m.from_schema, "to": m.to_schema, "approved": m.approved, "steps": len(m.steps)} for _, m in sorted(p.registry.migrations.items())]


def migration_path(p, a):
    return [m.migration_id for m in p.registry.path(a.start, a.goal, a.prefer)]


def recipe_register(p, a):
    found = load_recipes(a.file if ":" in a.file and not a.file.endswith((".yaml", ".yml")) else _read(a.file))
    p.register(*found)
    return [x.ref for x in found]


def recipe_list(p, a):
    return p.registry.listed("recipes")


def vocabulary_register(p, a):
    found = [x for x in load_recipes(_read(a.file)) if isinstance(x, Vocabulary)]
    p.register(*found)
    return [x.ref for x in found]


def ingest(p, a):
    return p.ingest_jsonl(a.file, a.schema, a.id_field, publish=not a.draft)


def plan(p, a):
    made = p.plan(a.target, record_ids=a.record or None, policy=_policy(a), on_stale=a.on_stale)
    return {"plan_id": made.plan_id, "dispositions": made.summary(), "totals": made.totals(), "blocked": made.blocked} if a.json else made.render()


def run(p, a):
    _, result = p.migrate(a.target, _policy(a), record_ids=a.record or None, on_stale=a.on_stale)
    return result.__dict__


def resume(p, a):
    return p.resume(a.execution).__dict__


def status(p, a):
    return p.status(a.execution)


def diff(p, a):
    return _rows(p.diff_record(a.record).where("kind <> 'unchanged'").orderBy("field_id", "entity"))


def record(p, a):
    out = p.get_record(a.record)
    if out is None:
        raise EngineError("record_unknown", a.record)
    return out


def export(p, a):
    p.export(a.file)
    return {"written": a.file}


def evaluate(p, a):
    _, gold = jsonl.load_gold(p.spark, a.gold)
    out = p.evaluate(gold, a.target, _policy(a), a.gate)
    a.exit_code = int(not out["passed"])
    return out


def reanchor(p, a):
    return p.reanchor(a.parse, dry_run=not a.apply)


def report(p, a):
    return p.report(a.execution)


def provenance_show(p, a):
    return _rows(p.provenance(a.record, a.field, a.entity))


def currency(p, a):
    where = F.col("record_id").isin(*a.record) if a.record else None
    return {r["state"]: r["n"] for r in p.currency(where).groupBy("state").agg(F.count("*").alias("n")).collect()}


def review_export(p, a):
    jsonl.write_lines(jsonl.review_lines(p.reviews()), a.file)
    return {"written": a.file}


def review_import(p, a):
    return {"cells": p.decide(jsonl.read_decisions(p.spark, a.file))}


def review_list(p, a):
    return _rows(p.reviews(None if a.all else "open"), a.limit)


_RUN = [("--record", {"action": "append"}), ("--allow-lossy", {"action": "store_true"}), ("--allow-destructive", {"action": "append"}), ("--prefer", {"default": "fidelity", "choices": ["fidelity", "cost", "hops", "latency"]}), ("--max-usd", {"type": float}), ("--max-calls", {"type": int}), ("--on-stale", {"default": "report", "choices": ["report", "review", "refresh"]})]
COMMANDS = {
    "schema register": (schema_register, ["file", "name", "version", ("--format", {"default": "json", "choices": ["json", "linkml", "pydantic"]}), ("--root", {}), ("--identity", {})]),
    "schema list": (schema_list, []),
    "schema diff": (schema_diff, ["old", "new"]),
    "migration new": (migration_new, ["old", "new"]),
    "migration register": (migration_register, ["file"]),
    "migration validate": (migration_validate, ["file"]),
    "migration list": (migration_list, []),
    "migration path": (migration_path, ["start", "goal", ("--prefer", {"default": "fidelity"})]),
    "recipe register": (recipe_register, ["file"]),
    "recipe list": (recipe_list, []),
    "vocabulary register": (vocabulary_register, ["file"]),
    "ingest": (ingest, ["file", ("--schema", {}), ("--id-field", {"default": "record_id"}), ("--draft", {"action": "store_true"})]),
    "plan": (plan, ["target", *_RUN]),
    "run": (run, ["target", *_RUN]),
    "resume": (resume, ["execution"]),
    "status": (status, ["execution"]),
    "diff": (diff, ["record"]),
    "record": (record, ["record"]),
    "export": (export, ["file"]),
    "evaluate": (evaluate, ["gold", "target", ("--gate", {"action": "append"}), *_RUN]),
    "reanchor": (reanchor, ["parse", ("--apply", {"action": "store_true"})]),
    "report": (report, ["execution"]),
    "provenance show": (provenance_show, ["record", "field", ("--entity", {"default": ""})]),
    "currency": (currency, [("--record", {"action": "append"})]),
    "review export": (review_export, ["file"]),
    "review import": (review_import, ["file"]),
    "review list": (review_list, [("--all", {"action": "store_true"}), ("--limit", {"type": int})]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataweave")
    top.add_argument("--store", default=None)
    top.add_argument("--config", default=None)
    top.add_argument("--json", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    groups: dict[str, argparse._SubParsersAction] = {}
    for name, (call, arguments) in COMMANDS.items():
        group, _, sub = name.partition(" ")
        if sub and group not in groups:
            groups[group] = commands.add_parser(group).add_subparsers(dest="sub", required=True)
        own = groups[group].add_parser(sub) if sub else commands.add_parser(group)
        for x in arguments:
            own.add_argument(x) if isinstance(x, str) else own.add_argument(x[0], **x[1])
        own.add_argument("--json", action="store_true", default=argparse.SUPPRESS)
        own.set_defaults(call=call)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **project) -> int:
    args = parser().parse_args(argv)
    args.exit_code = 0
    settings = config.load(_read(args.config)) if args.config else {}
    root = args.store or settings.get("store")
    try:
        if not root:
            raise EngineError("config_invalid", "no store: --store or a configuration with one")
        builder = SparkSession.builder.appName("strataweave")
        for k, v in (settings.get("spark") or {}).items():
            builder = builder.config(k, v)
        if "adapters" in settings and "adapters" not in project:
            project["adapters"] = {n: getattr(importlib.import_module(x["module"]), x["name"])(**x.get("params", {})) for n, x in settings["adapters"].items()}
        p = Project(spark or builder.getOrCreate(), root, **({"wrapped": settings.get("codec") == "wrapped"} | project))
        out = args.call(p, args)
        p.engine.close()
    except EngineError as e:
        print(json.dumps(e.row()) if args.json else f"{e.code}: {e}", file=sys.stderr)
        return 1 if e.code == "migration_invalid" else 2
    if args.json or not isinstance(out, str):
        print(json.dumps(out, default=str, ensure_ascii=False, indent=None if args.json else 2))
    else:
        print(out)
    return args.exit_code


if __name__ == "__main__":
    sys.exit(main())
