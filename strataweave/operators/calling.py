"""Model calls in bulk: requests are rows, adapters run in the Python workers, every answer and failure comes back as a row.

An adapter has provider, model, attributes and generate(request) -> Answer. A call tries the primary adapter and then the fallbacks, each up to
max_attempts times where the error can be cured by trying again. No exception leaves a task: a failed request is a row with its error."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

from strataweave.errors import EngineError
from strataweave.functions.status import STATUSES
from strataweave.functions.text import backoff_s, estimate
from strataweave.model.recipe import Recipe, variable


@dataclass(frozen=True)
class Answer:
    output: object
    tokens_in: int = 0
    tokens_out: int = 0
    fingerprint: str = ""


@dataclass
class Adapter:
    """Base of all adapters; subclasses override answer(request)."""

    provider: str = "local"
    model: str = "model"
    attributes: dict = field(default_factory=dict)
    usd_in: float = 0.0
    usd_out: float = 0.0

    def answer(self, request: dict):
        raise NotImplementedError

    def generate(self, request: dict) -> Answer:
        out = self.answer(request)
        if isinstance(out, Answer):
            return out
        return Answer(out, estimate(len(request["prompt"])), estimate(len(json.dumps(out, ensure_ascii=False))), f"{self.provider}/{self.model}")


@dataclass
class Scripted(Adapter):
    """Answers by step id, or by (record, step) as record|step; a missing one is an error that can't be cured."""

    answers: dict = field(default_factory=dict)

    def answer(self, request):
        for key in (f"{request['record_id']}|{request['step_id']}", request["step_id"]):
            if key in self.answers:
                return self.answers[key]
        raise EngineError("context_unsupported", f"no answer for {request['step_id']}")


@dataclass
class RuleBased(Adapter):
    """For each output the first rule whose pattern is in the context: rules maps an output to [(pattern, value)]. Quotes are what the pattern matched."""

    rules: dict = field(default_factory=dict)
    otherwise: dict = field(default_factory=dict)

    def answer(self, request):
        out = {}
        for name in request["writes"]:
            hit = next(((m, v) for p, v in self.rules.get(name, ()) if (m := re.search(p, request["context"], re.IGNORECASE))), None)
            out[name] = {"status": "present", "value": hit[1], "evidence": [hit[0].group(0)]} if hit else self.otherwise.get(name, {"status": "not_reported"})
        return out


@dataclass
class Seeded(Adapter):
    """Wraps another adapter as a hosted model with its failures: at rates that hang only on the request and the attempt, so that a rerun fails alike.

    rate: failures with `code`; rate_limited and garbled: calls that are turned away, and answers that fit no schema. A request over max_input_tokens, or with raw
    bytes (request key binary) where they aren't taken, can't be cured by trying again."""

    inner: Adapter | None = None
    rate: float = 0.0
    code: str = "transport"
    seed: int = 0
    rate_limited: float = 0.0
    garbled: float = 0.0
    accepts_binary: bool = True
    max_input_tokens: int | None = None

    def _falls(self, request: dict, what: str, rate: float) -> bool:
        h = hashlib.sha256(f"{self.seed}|{what}{request['step_key']}|{request['attempt']}".encode()).digest()
        return int.from_bytes(h[:4], "big") < rate * 2**32

    def generate(self, request):
        if request.get("binary") and not self.accepts_binary:
            raise EngineError("context_unsupported", "binary documents aren't taken")
        if self.max_input_tokens is not None and (n := estimate(len(request.get("prompt", "")))) > self.max_input_tokens:
            raise EngineError("context_unsupported", f"{n} tokens are more than the model's {self.max_input_tokens}")
        if self._falls(request, "limit|", self.rate_limited):
            raise EngineError("rate_limited", "seeded rate limit")
        if self._falls(request, "", self.rate):
            raise EngineError(self.code, "seeded failure")
        out = self.inner.generate(request)
        return replace(out, output={"__garbled__": True}) if self._falls(request, "schema|", self.garbled) else out


@dataclass
class Failing(Adapter):
    code: str = "transport"

    def answer(self, request):
        raise EngineError(self.code, "always fails")


@dataclass
class Recording(Adapter):
    """Appends every request to a file that the caller names (tests)."""

    inner: Adapter | None = None
    path: str = ""

    def generate(self, request):
        with open(self.path, "a") as f:
            f.write(json.dumps({k: request[k] for k in ("step_key", "level", "attempt")}) + "\n")
        return self.inner.generate(request)


class Limiter:
    """At most rate calls a second from this task: every call takes the next free slot."""

    def __init__(self, rate: float | None, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.free, self.clock, self.sleep = (1 / rate if rate else 0.0), 0.0, clock, sleep

    def wait(self) -> None:
        if self.gap:
            now = self.clock()
            at = max(now, self.free)
            self.free = at + self.gap
            if at > now:
                self.sleep(at - now)


def check_output(schema: dict, value, at: str = "$") -> list[str]:
    """Faults of a value against the part of JSON Schema that outputs use: type, enum, required, properties, items, bounds."""
    types = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}
    wants = schema.get("type")
    wants = [wants] if isinstance(wants, str) else wants or []
    if wants and not any(isinstance(value, types[w]) and not (isinstance(value, bool) and w in ("integer", "number")) for w in wants):
        return [f"{at}: not {' or '.join(wants)}"]
    out = [f"{at}: not permitted"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: out of bounds"] * (value < schema.get("minimum", value) or value > schema.get("maximum", value))
    if isinstance(value, dict):
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        out += [x for k, s in schema.get("properties", {}).items() if k in value for x in check_output(s, value[k], f"{at}.{k}")]
    if isinstance(value, list) and "items" in schema:
        out += [x for i, v in enumerate(value) for x in check_output(schema["items"], v, f"{at}[{i}]")]
    return out


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def decode(output, writes: list[str]) -> list[dict]:
    """A model's output as one cell for each written field: field_id, status, value_json, reason, quotes.

    A field is a bare value or {status, value, evidence, reason}; one left out, or null, isn't reported. An output that isn't an object answers a step with one output."""
    marks = {"status", "value", "evidence"}
    if len(writes) == 1 and (not isinstance(output, dict) or (marks & output.keys() and writes[0] not in output)):
        output = {writes[0]: output}
    if not isinstance(output, dict):
        raise EngineError("schema_invalid", "a step of several outputs needs an object")
    cells = []
    for w in writes:
        v = output.get(w, output.get(variable(w)))
        if w not in output and variable(w) not in output:
            cells.append({"field_id": w, "status": "not_reported", "value_json": None, "reason": "the model did not answer", "quotes": []})
        elif isinstance(v, dict) and marks & v.keys():
            status = v.get("status", "present")
            if status not in STATUSES:
                status = "unknown"
            quotes = v.get("evidence") or []
            quotes = [q.get("text", "") if isinstance(q, dict) else str(q) for q in (quotes if isinstance(quotes, list) else [quotes])]
            has = status in ("present", "review_required")
            cells.append({"field_id": w, "status": status, "value_json": _text(v.get("value")) if has else None, "reason": v.get("reason"), "quotes": [q for q in quotes if q]})
        elif v is None:
            cells.append({"field_id": w, "status": "not_reported", "value_json": None, "reason": None, "quotes": []})
        else:
            cells.append({"field_id": w, "status": "present", "value_json": _text(v), "reason": None, "quotes": []})
    return cells


@dataclass(frozen=True)
class Call:
    """What a task needs to answer requests of one recipe."""

    recipe: Recipe
    adapters: dict
    permitted: frozenset
    builder: Callable | None = None
    postprocess: Callable | None = None
    output_schema: dict | None = None
    rate: float | None = None
    backoff: tuple[float, float, float] = (0.0, 2.0, 8.0)

    def prompt(self, row: dict) -> str:
        values = {k: json.loads(v) if v is not None else None for k, v in (row["reads"] or {}).items()}
        if self.builder:
            return self.builder(self.recipe, values | {"context": row["context"]})
        names = {variable(k): v for k, v in values.items()}
        return self.recipe.prompt.format_map(_Blank(names | {"context": row["context"], "entity": row["entity"], "record_id": row["record_id"]}))

    def answer(self, row: dict, limiter: Limiter) -> dict:
        tries: list[dict] = []
        done = {"output": None, "cells": None, "error": None, "message": None, "wants_more": False, "tokens_in": 0, "tokens_out": 0, "usd": 0.0, "fingerprint": None, "provider": None}
        last = EngineError("provider_forbidden", f"no adapter may answer {self.recipe.ref}")
        for name in (self.recipe.model, *self.recipe.fallbacks):
            adapter = self.adapters.get(name)
            if adapter is None or name not in self.permitted:
                continue
            for attempt in range(1, self.recipe.max_attempts + 1):
                request = {k: row[k] for k in ("step_key", "record_id", "entity", "step_id", "level", "context")} | {"writes": list(row["writes"]), "attempt": attempt}
                try:
                    request["prompt"] = self.prompt(row)
                    limiter.wait()
                    got = adapter.generate(request)
                    out = self.postprocess(got.output, row) if self.postprocess else got.output
                    if self.output_schema and (bad := check_output(self.output_schema, out)):
                        raise EngineError("schema_invalid", "; ".join(bad))
                    cells = decode(out, request["writes"])
                    usd = (got.tokens_in * adapter.usd_in + got.tokens_out * adapter.usd_out) / 1e6
                    tries.append({"adapter": name, "attempt": attempt, "outcome": "ok", "message": None})
                    wants = isinstance(out, dict) and self.recipe.escalation.wants_more(out)
                    done |= {"output": _text(out), "cells": cells, "wants_more": wants, "tokens_in": got.tokens_in, "tokens_out": got.tokens_out, "usd": usd, "fingerprint": got.fingerprint, "provider": adapter.provider}
                    if self.recipe.fingerprint and got.fingerprint != self.recipe.fingerprint:
                        done |= {"error": "fingerprint_mismatch", "message": got.fingerprint}
                    return done | {"tries": tries}
                except EngineError as e:
                    last = e
                except Exception as e:  # noqa: BLE001  an adapter's own fault: the next adapter
                    last = EngineError("context_unsupported", f"{type(e).__name__}: {e}")
                tries.append({"adapter": name, "attempt": attempt, "outcome": last.code, "message": str(last)[:500]})
                if not last.retryable or (last.code == "schema_invalid" and not self.recipe.retry_schema_failures):
                    break
                if attempt < self.recipe.max_attempts:
                    limiter.sleep(backoff_s(attempt, *self.backoff))
        return done | {"error": last.code, "message": str(last)[:500], "tries": tries}


class _Blank(dict):
    def __missing__(self, key):
        return ""


CELLS = "array<struct<field_id:string,status:string,value_json:string,reason:string,quotes:array<string>>>"
ANSWER = f"step_key string, level int, cache_key string, output string, cells {CELLS}, error string, message string, wants_more boolean, tokens_in long, tokens_out long, usd double, fingerprint string, provider string, tries array<struct<adapter:string,attempt:int,outcome:string,message:string>>"


def ask(requests: DataFrame, call: Call, partitions: int | None = None) -> DataFrame:
    """One ANSWER row a request (step_key, record_id, entity, step_id, level, cache_key, context, reads map<string,string>, writes).

    The caller writes the result before it reads it: a plan that is computed twice would call twice."""
    share = partitions or 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = Limiter(call.rate / share if call.rate else None)
        names = [c.strip().split(" ")[0] for c in re.split(r", (?=\w+ )", ANSWER)]
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                row["reads"] = dict(row["reads"]) if row["reads"] is not None else {}
                rows.append({k: row[k] for k in ("step_key", "level", "cache_key")} | call.answer(row, limiter))
            yield pd.DataFrame(rows, columns=names)

    dealt = requests.repartition(partitions, "step_key") if partitions else requests
    return dealt.mapInPandas(run, ANSWER)


def permitted_adapters(adapters: dict[str, Adapter], policy) -> frozenset:
    return frozenset(n for n, a in adapters.items() if policy.permits_provider(a.provider, a.attributes))


def describe(adapter: Adapter) -> dict:
    return {k: v for k, v in asdict(adapter).items() if k in ("provider", "model", "attributes")}
