"""User functions by name@version: transforms, validators, postprocessors, prompt builders. What a function is, is the hash of its source."""

from __future__ import annotations

import inspect
import textwrap
from collections.abc import Callable
from dataclasses import dataclass

from strataweave.errors import EngineError
from strataweave.functions.ids import text_hash, version_ref

KINDS = ("transform", "validator", "postprocessor", "prompt_builder")


@dataclass(frozen=True)
class Function:
    """style: 'columns' (builds Columns, stays in the JVM) or 'rows' (called for each row in a Python worker)."""

    kind: str
    ref: str
    call: Callable
    style: str
    code_hash: str


_FUNCTIONS: dict[tuple[str, str], Function] = {}


def code_hash(call: Callable) -> str:
    try:
        return text_hash(textwrap.dedent(inspect.getsource(call)))
    except (OSError, TypeError):
        return text_hash(getattr(call, "__qualname__", repr(type(call))))


def register(kind: str, name: str, version: str, call: Callable, style: str = "rows") -> Function:
    """The same source can be bound again; other source under one reference can't."""
    if kind not in KINDS:
        raise EngineError("config_invalid", f"no function kind {kind!r}")
    f = Function(kind, version_ref(name, version), call, style, code_hash(call))
    old = _FUNCTIONS.get((kind, f.ref))
    if old is not None and old.code_hash != f.code_hash:
        raise EngineError("recipe_conflict", f"{kind} {f.ref} is bound to other code")
    _FUNCTIONS[kind, f.ref] = f
    return f


def _decorator(kind: str):
    def named(name: str, version: str = "1", style: str = "rows"):
        def bind(call: Callable) -> Callable:
            register(kind, name, version, call, style)
            return call

        return bind

    return named


transform, validator, postprocessor, prompt_builder = (_decorator(k) for k in KINDS)


def find(kind: str, ref: str) -> Function:
    """By full reference, or by bare name where one version is bound."""
    if (kind, ref) in _FUNCTIONS:
        return _FUNCTIONS[kind, ref]
    found = [f for (k, r), f in _FUNCTIONS.items() if k == kind and r.rpartition("@")[0] == ref]
    if len(found) != 1:
        raise EngineError("config_invalid", f"{kind} {ref!r} is not bound" if not found else f"{kind} {ref!r} has several versions")
    return found[0]


def identity(kind: str, ref: str) -> str:
    """The code hash where the function is bound here, else only its name."""
    try:
        return find(kind, ref).code_hash
    except EngineError:
        return text_hash(ref)
