"""Registries as JSON values and back."""

from __future__ import annotations

from dataclasses import asdict, fields, is_dataclass
from typing import get_type_hints

from strataweave.model.migration import Migration, Step
from strataweave.model.recipe import ContextPolicy, Escalation, Recipe, Source, Vocabulary
from strataweave.model.registry import Registry
from strataweave.model.schema import Collection, Constraints, FieldDefinition, Schema

#: Members that hold other declarations (one, or a tuple of them).
_INSIDE = {
    (Schema, "fields"): FieldDefinition,
    (Schema, "collection_list"): Collection,
    (FieldDefinition, "constraints"): Constraints,
    (Migration, "steps"): Step,
    (Recipe, "context"): ContextPolicy,
    (Recipe, "escalation"): Escalation,
    (ContextPolicy, "sequence"): Source,
}


def to_value(item) -> dict:
    return asdict(item)


def from_value(kind, value: dict):
    """The declaration; lists become tuples where the class has tuples. Unknown members are an error."""
    assert is_dataclass(kind)
    hints, out = get_type_hints(kind), {}
    known = {f.name for f in fields(kind)}
    if unknown := set(value) - known:
        raise TypeError(f"{kind.__name__} has no {sorted(unknown)}")
    for k, v in value.items():
        inner = _INSIDE.get((kind, k))
        if inner and v is not None:
            v = tuple(from_value(inner, x) for x in v) if isinstance(v, (list, tuple)) else from_value(inner, v)
        elif isinstance(v, list) and "tuple" in str(hints[k]):
            v = tuple(v)
        out[k] = v
    return kind(**out)


def registry_to_value(r: Registry) -> dict:
    return {name: [to_value(x) for _, x in sorted(getattr(r, name).items())] for name in ("schemas", "recipes", "vocabularies", "migrations")}


def registry_from_value(value: dict) -> Registry:
    r = Registry()
    for name, kind, add in (("schemas", Schema, r.add_schema), ("recipes", Recipe, r.add_recipe), ("vocabularies", Vocabulary, r.add_vocabulary)):
        for x in value.get(name, ()):
            add(from_value(kind, x))
    for x in value.get("migrations", ()):
        m = from_value(Migration, x)
        r.migrations[m.migration_id] = m
    return r
