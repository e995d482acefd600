"""Declared schemas: fields, constraints, collections, keys, and the difference of two versions."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field, replace

from strataweave.functions.ids import content_hash, split_ref, version_ref

BASE_TYPES = ("string", "integer", "number", "boolean", "object", "any")
MEANING = ("enum", "open_vocabulary", "vocabulary_ref")
BOUNDS = ("minimum", "maximum", "min_length", "max_length", "pattern", "min_items", "max_items")


@dataclass(frozen=True)
class Constraints:
    enum: tuple[str, ...] = ()
    open_vocabulary: bool = False
    vocabulary_ref: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    min_items: int | None = None
    max_items: int | None = None

    def part(self, names) -> dict:
        """The constraints that are set; a bound of 0 is set."""
        return {n: list(v) if n == "enum" else v for n in names if (v := getattr(self, n)) is not None and v != () and v is not False}


@dataclass(frozen=True)
class FieldDefinition:
    path: str
    base_type: str = "string"
    field_id: str = ""
    description: str = ""
    multivalued: bool = False
    required: bool = False
    deterministic: bool = False
    constraints: Constraints = field(default_factory=Constraints)
    recipe_ref: str | None = None
    annotations: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.base_type not in BASE_TYPES:
            raise ValueError(f"{self.path}: no type {self.base_type!r}")
        if not self.field_id:
            object.__setattr__(self, "field_id", self.path)

    @property
    def collection(self) -> str:
        """The collection that the path is in; empty for the root."""
        return self.path[: k + 2] if (k := self.path.rfind("[]")) >= 0 else ""

    @property
    def semantic_key(self) -> str:
        """What the value means; the path is left out, so a rename costs nothing."""
        return content_hash(
            {
                "description": re.sub(r"\s+", " ", self.description).strip(),
                "meaning": self.constraints.part(MEANING),
                "type": self.base_type,
                "multivalued": self.multivalued,
                "recipe": self.recipe_ref,
                "annotations": {k: v for k, v in self.annotations.items() if k != "source_path"},
            }
        )

    @property
    def structural_key(self) -> str:
        return content_hash({"path": self.path, "type": self.base_type, "multivalued": self.multivalued, "required": self.required, "constraints": self.constraints.part(MEANING + BOUNDS)})


@dataclass(frozen=True)
class Collection:
    path: str
    identity: str | None = None


@dataclass(frozen=True)
class Schema:
    name: str
    version: str
    fields: tuple[FieldDefinition, ...]
    collection_list: tuple[Collection, ...] = ()

    def __post_init__(self):
        ids = [f.field_id for f in self.fields]
        if len(set(ids)) < len(ids) or len({f.path for f in self.fields}) < len(ids):
            raise ValueError(f"{self.ref}: field ids and paths must be unique")

    @property
    def ref(self) -> str:
        return version_ref(self.name, self.version)

    def by_id(self) -> dict[str, FieldDefinition]:
        return {f.field_id: f for f in self.fields}

    def collections(self) -> list[str]:
        """Paths of all collections, parents included."""
        found = {c.path for c in self.collection_list} | {f.collection for f in self.fields}
        for path in list(found):
            while path := self.parent_collection(path) if path else "":
                found.add(path)
        return sorted(found - {""})

    @staticmethod
    def parent_collection(path: str) -> str:
        k = path.removesuffix("[]").rfind("[]")
        return path[: k + 2] if k >= 0 else ""

    @staticmethod
    def relative(path: str, within: str) -> str:
        return path[len(within) + 1 :] if within else path

    def identity_field(self, path: str) -> str | None:
        return next((c.identity for c in self.collection_list if c.path == path), None)

    def fields_in(self, collection: str) -> list[FieldDefinition]:
        return [f for f in self.fields if f.collection == collection]

    def rekey(self, identity: dict[str, str]) -> Schema:
        """The schema with these paths' fields under these ids."""
        unknown = set(identity) - {f.path for f in self.fields}
        if unknown:
            raise KeyError(f"{self.ref} has no {sorted(unknown)}")
        return replace(self, fields=tuple(replace(f, field_id=identity.get(f.path, f.field_id)) for f in self.fields))

    @property
    def structural_hash(self) -> str:
        return content_hash(sorted([f.field_id, f.structural_key] for f in self.fields))

    @property
    def semantic_hash(self) -> str:
        return content_hash(sorted([f.field_id, f.semantic_key] for f in self.fields))

    @property
    def schema_hash(self) -> str:
        return content_hash({"ref": self.ref, "structure": self.structural_hash, "meaning": self.semantic_hash, "collections": sorted([c.path, c.identity or ""] for c in self.collection_list)})

    def rows(self) -> list[tuple]:
        """(schema_ref, field_id, path, collection, base_type, multivalued, required, deterministic, semantic_key, structural_key, enum, open, min, max, pattern)."""
        return [
            (self.ref, f.field_id, f.path, f.collection, f.base_type, f.multivalued, f.required, f.deterministic, f.semantic_key, f.structural_key, list(f.constraints.enum), f.constraints.open_vocabulary)
            + (None if f.constraints.minimum is None else float(f.constraints.minimum), None if f.constraints.maximum is None else float(f.constraints.maximum), f.constraints.pattern)
            + (f.constraints.min_length, f.constraints.max_length, f.constraints.min_items, f.constraints.max_items, " ".join(f.description.split()), f.recipe_ref, f.constraints.vocabulary_ref)
            for f in self.fields
        ]

    ROW = "schema_ref string, field_id string, path string, collection string, base_type string, multivalued boolean, required boolean, deterministic boolean, semantic_key string, structural_key string, enum array<string>, open boolean, minimum double, maximum double, pattern string, min_length int, max_length int, min_items int, max_items int, description string, recipe_ref string, vocabulary_ref string"

    def frame(self, spark):
        return spark.createDataFrame(self.rows(), self.ROW)


# difference of two versions ---------------------------------------------------------------------------------------------------

KINDS = ("added", "removed", "renamed", "nesting_changed", "type_changed", "cardinality_changed", "requiredness_changed", "description_changed", "recipe_changed", "vocabulary_changed", "constraint_widened", "constraint_narrowed", "collection_added", "collection_removed")
SHAPE = frozenset({"added", "removed", "renamed", "nesting_changed", "type_changed", "cardinality_changed", "requiredness_changed", "collection_added", "collection_removed"})
VALUES = frozenset({"type_changed", "cardinality_changed", "constraint_narrowed", "removed"})
SEMANTICS = frozenset({"added", "description_changed", "recipe_changed", "vocabulary_changed", "constraint_narrowed", "constraint_widened"})


@dataclass(frozen=True)
class Change:
    kind: str
    field_id: str
    old: object = None
    new: object = None
    identity_preserved: bool = False


@dataclass(frozen=True)
class SchemaDiff:
    old_ref: str
    new_ref: str
    changes: tuple[Change, ...]
    candidates: tuple[tuple[str, str, float], ...] = ()

    def of_kind(self, kind: str) -> list[Change]:
        return [c for c in self.changes if c.kind == kind]

    def for_field(self, field_id: str) -> list[Change]:
        return [c for c in self.changes if c.field_id == field_id]

    def verdicts(self) -> dict[str, bool]:
        return {name: not any(c.kind in kinds for c in self.changes) for name, kinds in (("shape", SHAPE), ("values", VALUES), ("semantics", SEMANTICS))}


def _bounds(field_id: str, a: Constraints, b: Constraints) -> list[Change]:
    out = []
    if a.vocabulary_ref != b.vocabulary_ref:
        out.append(Change("vocabulary_changed", field_id, a.vocabulary_ref, b.vocabulary_ref))
    gone, come = [v for v in a.enum if v not in b.enum], [v for v in b.enum if v not in a.enum]
    if gone or come:
        out.append(Change("constraint_narrowed" if gone else "constraint_widened", field_id, list(a.enum), list(b.enum)))
    if a.open_vocabulary != b.open_vocabulary and (a.enum or b.enum):
        out.append(Change("constraint_narrowed" if a.open_vocabulary else "constraint_widened", field_id, a.open_vocabulary, b.open_vocabulary))
    for name in BOUNDS:
        x, y = getattr(a, name), getattr(b, name)
        if x == y:
            continue
        if y is None:
            kind = "constraint_widened"
        elif x is None or name == "pattern":
            kind = "constraint_narrowed"
        else:
            kind = "constraint_narrowed" if (y > x) == name.startswith("min") else "constraint_widened"
        out.append(Change(kind, field_id, {name: x}, {name: y}))
    return out


def _compare(a: FieldDefinition, b: FieldDefinition) -> list[Change]:
    out, same = [], a.field_id == b.field_id
    if a.path != b.path:
        out.append(Change("nesting_changed" if a.collection != b.collection else "renamed", b.field_id, a.path, b.path, same))
    for kind, x, y in (
        ("type_changed", a.base_type, b.base_type),
        ("cardinality_changed", a.multivalued, b.multivalued),
        ("requiredness_changed", a.required, b.required),
        ("description_changed", " ".join(a.description.split()), " ".join(b.description.split())),
        ("recipe_changed", a.recipe_ref, b.recipe_ref),
    ):
        if x != y:
            out.append(Change(kind, b.field_id, x, y))
    return out + _bounds(b.field_id, a.constraints, b.constraints)


def similarity(a: FieldDefinition, b: FieldDefinition) -> float:
    """How alike the last names of both paths are."""
    return difflib.SequenceMatcher(None, a.path.rsplit(".", 1)[-1], b.path.rsplit(".", 1)[-1]).ratio()


def diff_schemas(old: Schema, new: Schema, renames: dict[str, str] | None = None) -> SchemaDiff:
    """Changes from old to new; renames maps old field ids to new ones where the id changed too. Candidates are only advice."""
    renames = renames or {}
    a, b = {renames.get(i, i): f for i, f in old.by_id().items()}, new.by_id()
    changes = []
    for field_id in sorted(a.keys() | b.keys()):
        if field_id not in b:
            changes.append(Change("removed", a[field_id].field_id, a[field_id].path))
        elif field_id not in a:
            changes.append(Change("added", field_id, None, b[field_id].path))
        else:
            changes += _compare(a[field_id], b[field_id])
    had, has = set(old.collections()), set(new.collections())
    changes += [Change("collection_added", c) for c in sorted(has - had)] + [Change("collection_removed", c) for c in sorted(had - has)]
    gone, come = [a[i] for i in a if i not in b], [b[i] for i in b if i not in a]
    near = [(x.path, y.path, s) for x in gone for y in come if x.collection == y.collection and (s := similarity(x, y)) >= 0.6]
    return SchemaDiff(old.ref, new.ref, tuple(changes), tuple(sorted(near, key=lambda c: (-c[2], c[0], c[1]))))


def parse_ref(ref: str) -> tuple[str, str]:
    return split_ref(ref)
