"""Schemas from other declarations: JSON Schema, LinkML, Pydantic models, Spark struct types.

Each source only says what a node's members are (Member: a leaf with its field, or an object or collection with the node inside); one walk turns members
into dotted paths, collections and fields. A definition that contains itself is entered once on the way down; its collection stays, empty."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

import yaml
from pyspark.sql import types as T

from strataweave.errors import EngineError
from strataweave.model.schema import Collection, Constraints, FieldDefinition, Schema

MOST_LEVELS = 12


@dataclass(frozen=True)
class Member:
    name: str
    field: FieldDefinition | None = None
    node: Any = None
    many: bool = False
    identity: str | None = None
    key: str | None = None  # of the definition that the node comes from


def _schema(name: str, version: str, root, members: Callable[[Any], Iterable[Member]], identity: dict[str, str] | None, key: str | None = None) -> Schema:
    fields: list[FieldDefinition] = []
    collections: list[Collection] = []
    todo = [(root, "", frozenset({key} if key else ()), 0)]
    while todo:
        node, prefix, inside, level = todo.pop(0)
        if level > MOST_LEVELS:
            raise EngineError("config_invalid", f"{prefix} is nested deeper than {MOST_LEVELS} levels")
        for m in members(node):
            path = f"{prefix}.{m.name}" if prefix else m.name
            if m.field is not None:
                own = m.field.field_id if m.field.field_id != m.field.path else path
                fields.append(replace(m.field, path=path, field_id=own))
                continue
            if m.many:
                path += "[]"
                collections.append(Collection(path, m.identity))
            if m.key is None or m.key not in inside:
                todo.append((m.node, path, inside | ({m.key} if m.key else set()), level + 1))
    schema = Schema(name, version, tuple(fields), tuple(collections))
    return schema.rekey(identity) if identity else schema


# JSON Schema --------------------------------------------------------------------------------------------------------------------------

_JSON_TYPES = {"string": "string", "integer": "integer", "number": "number", "boolean": "boolean", "object": "object"}


def from_json_schema(document: dict, name: str, version: str, identity: dict[str, str] | None = None, prefix: str = "x-field") -> Schema:
    """prefix: of the extension keywords <prefix>-id, -recipe, -vocabulary, -open-vocabulary, -deterministic, -identity-field, -annotations."""
    definitions = {**document.get("definitions", {}), **document.get("$defs", {})}

    def target(node: dict) -> tuple[dict, str | None]:
        """The node behind a reference; keywords beside the reference come first."""
        key = None
        while "$ref" in node:
            key = node["$ref"].rsplit("/", 1)[-1]
            if key not in definitions:
                raise EngineError("config_invalid", f"{node['$ref']} is not defined")
            node = {**definitions[key], **{k: v for k, v in node.items() if k != "$ref"}}
        return node, key

    def kind(node: dict) -> str | None:
        t = node.get("type")
        return next((x for x in t if x != "null"), None) if isinstance(t, list) else t

    def options(node: dict) -> tuple[list[str], bool]:
        """(permitted values, whether others are too): an enum, or one of several alternatives beside plain text."""
        if "enum" in node:
            return [str(v) for v in node["enum"] if v is not None], bool(node.get(f"{prefix}-open-vocabulary"))
        choices = [target(o)[0] for o in node.get("anyOf") or node.get("oneOf") or ()]
        values = [str(v) for c in choices for v in c.get("enum", ())]
        return values, bool(values) and any(kind(c) == "string" and "enum" not in c for c in choices)

    def leaf(node: dict, required: bool) -> FieldDefinition:
        many = kind(node) == "array"
        value = target(node.get("items") or {})[0] if many else node
        values, is_open = options(value)
        base = _JSON_TYPES.get(kind(value) or "", "string" if values else "any")
        nullable = isinstance(node.get("type"), list) and "null" in node["type"]
        bounds = {"minimum": "minimum", "maximum": "maximum", "min_length": "minLength", "max_length": "maxLength", "pattern": "pattern"}
        items = {"min_items": node.get("minItems"), "max_items": node.get("maxItems")} if many else {}
        vocabulary = value.get(f"{prefix}-vocabulary") or node.get(f"{prefix}-vocabulary")
        constraints = Constraints(tuple(dict.fromkeys(values)), is_open, vocabulary, **{k: value.get(v) for k, v in bounds.items()}, **items)
        notes = dict(node.get(f"{prefix}-annotations") or {}) | ({"nullable": True} if nullable else {})
        return FieldDefinition("?", base, node.get(f"{prefix}-id") or "", node.get("description", ""), many, required, bool(node.get(f"{prefix}-deterministic")), constraints, node.get(f"{prefix}-recipe"), notes)

    def members(node: dict) -> Iterable[Member]:
        required = set(node.get("required") or ())
        for label, raw in (node.get("properties") or {}).items():
            own, key = target(raw)
            if kind(own) == "array":
                item, item_key = target(own.get("items") or {})
                if kind(item) == "object" or "properties" in item:
                    identity_field = own.get(f"{prefix}-identity-field") or item.get(f"{prefix}-identity-field") or ("local_id" if "local_id" in item.get("properties", {}) else None)
                    yield Member(label, node=item, many=True, identity=identity_field, key=item_key)
                    continue
            elif "properties" in own:
                yield Member(label, node=own, key=key)
                continue
            yield Member(label, leaf(own, label in required))

    return _schema(name, version, document, members, identity)


def from_pydantic(model, name: str, version: str, identity: dict[str, str] | None = None, **more) -> Schema:
    """A Pydantic model class, by way of its JSON Schema."""
    return from_json_schema(model.model_json_schema(), name, version, identity, **more)


# LinkML -------------------------------------------------------------------------------------------------------------------------------

#: LinkML's scalar ranges.
_LINKML_TYPES = {"string": "string", "uriorcurie": "string", "uri": "string", "date": "string", "datetime": "string", "integer": "integer", "float": "number", "double": "number", "decimal": "number", "boolean": "boolean", "Any": "any"}


class Bundle:
    """A LinkML schema file with all that it imports."""

    def __init__(self, entry: str):
        self.classes: dict[str, dict] = {}
        self.enums: dict[str, dict] = {}
        self.slots: dict[str, dict] = {}
        self.head: dict = {}
        todo, seen = [os.path.abspath(entry)], set()
        while todo:
            path = todo.pop()
            if path in seen:
                continue
            seen.add(path)
            with open(path) as f:
                doc = yaml.safe_load(f) or {}
            self.head = self.head or doc
            for own, part in ((self.classes, "classes"), (self.enums, "enums"), (self.slots, "slots")):
                for k, v in (doc.get(part) or {}).items():
                    own[k] = {**(v or {}), **own.get(k, {})}
            for other in doc.get("imports") or ():
                near = os.path.join(os.path.dirname(path), f"{other}.yaml")
                if os.path.exists(near):
                    todo.append(near)
                elif ":" not in other:
                    raise EngineError("config_invalid", f"{path} imports {other}, which isn't there")

    def line(self, name: str | None) -> list[str]:
        """A class and those that it descends from."""
        out: list[str] = []
        while name and name not in out:
            out.append(name)
            name = self.classes.get(name, {}).get("is_a")
        return out

    def slots_of(self, name: str) -> dict[str, dict]:
        """Slots of a class, inherited ones first, with what each level says about them."""
        out: dict[str, dict] = {}
        for c in reversed(self.line(name)):
            spec = self.classes.get(c, {})
            said = [(s, self.slots.get(s, {})) for s in spec.get("slots") or ()] + [*(spec.get("attributes") or {}).items()] + [*(spec.get("slot_usage") or {}).items()]
            for slot, more in said:
                out[slot] = {**out.get(slot, {}), **(more or {})}
        return out

    def values(self, enum: str) -> list[str]:
        return list((self.enums[enum].get("permissible_values") or {}).keys())


def from_linkml(entry: str, name: str | None = None, version: str | None = None, root: str | None = None, identity: dict[str, str] | None = None, wrapper: str = "ExtractedValue") -> Schema:
    """wrapper: the class whose descendants wrap a value beside its status and evidence; they count as leaves of the type of their slot `value`."""
    bundle = Bundle(entry)
    if root is None:
        roots = [c for c, spec in bundle.classes.items() if spec.get("tree_root")]
        if len(roots) != 1:
            raise EngineError("config_invalid", f"one class must be tree_root, not {sorted(roots)}")
        root = roots[0]

    def leaf(slot: dict) -> FieldDefinition:
        kind, many, choices, text, wrapped = slot.get("range"), bool(slot.get("multivalued")), slot.get("any_of"), slot.get("description") or "", False
        if wrapper in bundle.line(kind):
            wrapped, inner = True, bundle.slots_of(kind).get("value", {})
            text = text or bundle.classes.get(kind, {}).get("description") or ""
            kind, many, choices = inner.get("range"), many or bool(inner.get("multivalued")), inner.get("any_of")
        ranges = [(c or {}).get("range") for c in choices or ()]
        enums = [r for r in ranges if r in bundle.enums] or [k for k in (kind,) if k in bundle.enums]
        permitted = tuple(dict.fromkeys(v for e in enums for v in bundle.values(e)))
        reference = kind if not enums and kind in bundle.classes else None
        base = "string" if enums or reference else _LINKML_TYPES.get(str(kind), "any")
        notes = {"references": reference} if reference else {}
        subsets = sorted(slot.get("in_subset") or ())
        notes |= ({"in_subset": subsets} if subsets else {}) | {str(k): v for k, v in (slot.get("annotations") or {}).items()}
        recipe = notes.pop("recipe", None)
        items = {"min_items": slot.get("minimum_cardinality"), "max_items": slot.get("maximum_cardinality")} if many else {}
        constraints = Constraints(permitted, bool(enums) and "string" in ranges, enums[-1] if enums else None, slot.get("minimum_value"), slot.get("maximum_value"), pattern=slot.get("pattern"), **items)
        return FieldDefinition("?", base, "", str(text), many, bool(slot.get("required")), "deterministic" in subsets or not wrapped, constraints, recipe, notes)

    def members(owner: str) -> Iterable[Member]:
        for label, slot in bundle.slots_of(owner).items():
            kind = slot.get("range")
            inlined = slot.get("inlined_as_list", slot.get("inlined", True))  # else a reference by identifier
            if kind in bundle.classes and wrapper not in bundle.line(kind) and inlined:
                many = bool(slot.get("multivalued"))
                yield Member(label, node=kind, many=many, identity="local_id" if many and "local_id" in bundle.slots_of(kind) else None, key=kind)
            else:
                yield Member(label, leaf(slot))

    return _schema(name or bundle.head.get("name") or root.lower(), str(version or bundle.head.get("version") or "0"), root, members, identity, root)


# Spark struct types -------------------------------------------------------------------------------------------------------------------

_SPARK_TYPES = ((T.BooleanType, "boolean"), (T.IntegralType, "integer"), (T.NumericType, "number"), (T.StringType, "string"), (T.DatetimeType, "string"), (T.TimestampType, "string"))


def from_struct(struct: T.StructType, name: str, version: str, identity: dict[str, str] | None = None) -> Schema:
    """The fields of a DataFrame's schema; arrays of structs are collections (identity local_id where there is one), maps are objects."""

    def base(kind: T.DataType) -> str:
        return next((b for t, b in _SPARK_TYPES if isinstance(kind, t)), "object" if isinstance(kind, (T.MapType, T.StructType)) else "any")

    def members(node: T.StructType) -> Iterable[Member]:
        for f in node.fields:
            kind = f.dataType
            many = isinstance(kind, T.ArrayType)
            inner = kind.elementType if many else kind
            if isinstance(inner, T.StructType):
                yield Member(f.name, node=inner, many=many, identity="local_id" if many and "local_id" in inner.names else None)
            else:
                yield Member(f.name, FieldDefinition("?", base(inner), description=f.metadata.get("comment", ""), multivalued=many, required=not f.nullable))

    return _schema(name, version, struct, members, identity)
