"""The registry: immutable declarations by reference, the migration graph, checks before use."""

from __future__ import annotations

from strataweave.errors import EngineError
from strataweave.functions.ids import content_hash, split_ref
from strataweave.model.migration import FIDELITY, Migration
from strataweave.model.recipe import Recipe, Vocabulary
from strataweave.model.schema import Schema, diff_schemas

_FREE = frozenset({"description_changed", "recipe_changed", "constraint_widened", "collection_added", "collection_removed", "removed"})


class Registry:
    def __init__(self):
        self.schemas: dict[str, Schema] = {}
        self.recipes: dict[str, Recipe] = {}
        self.vocabularies: dict[str, Vocabulary] = {}
        self.migrations: dict[str, Migration] = {}

    def _put(self, table: dict, ref: str, item, digest: str) -> None:
        if ref in table and getattr(table[ref], digest) != getattr(item, digest):
            raise EngineError("schema_conflict" if table is self.schemas else "recipe_conflict" if table is not self.migrations else "migration_invalid", f"{ref} is registered with other content")
        table[ref] = item

    def add_schema(self, schema: Schema) -> None:
        self._put(self.schemas, schema.ref, schema, "schema_hash")

    def add_recipe(self, recipe: Recipe) -> None:
        self._put(self.recipes, recipe.ref, recipe, "recipe_hash")

    def add_vocabulary(self, vocabulary: Vocabulary) -> None:
        self._put(self.vocabularies, vocabulary.ref, vocabulary, "vocabulary_hash")

    def add_migration(self, m: Migration) -> None:
        problems = self.check(m)
        if problems:
            raise EngineError("migration_invalid", "; ".join(problems))
        main = [x for x in self.migrations.values() if (x.from_schema, x.to_schema) == (m.from_schema, m.to_schema) and x.approved and not x.branch and x.migration_id != m.migration_id]
        if m.approved and not m.branch and main:
            raise EngineError("path_ambiguous", f"{m.from_schema} to {m.to_schema} has an approved migration: {main[0].migration_id}")
        self._put(self.migrations, m.migration_id, m, "migration_hash")

    def schema(self, ref: str) -> Schema:
        if ref not in self.schemas:
            raise EngineError("schema_unknown", ref)
        return self.schemas[ref]

    def _one(self, table: dict, ref: str, code: str):
        """By full reference, or by bare name where one version is known."""
        if ref in table:
            return table[ref]
        found = [v for k, v in table.items() if k.rpartition("@")[0] == ref]
        if len(found) != 1:
            raise EngineError(code, ref)
        return found[0]

    def recipe(self, ref: str) -> Recipe:
        return self._one(self.recipes, ref, "recipe_unknown")

    def vocabulary(self, ref: str) -> Vocabulary:
        return self._one(self.vocabularies, ref, "vocabulary_unknown")

    def listed(self, table: str) -> list[str]:
        return sorted(getattr(self, table))

    def check(self, m: Migration) -> list[str]:
        """What is wrong with a migration; empty where nothing is."""
        out = []
        if m.from_schema == m.to_schema:
            out.append("both versions are the same")
        for ref in (m.from_schema, m.to_schema):
            if ref not in self.schemas:
                out.append(f"schema {ref} is unknown")
        if out:
            return out
        old, new = self.schemas[m.from_schema], self.schemas[m.to_schema]
        has, had = set(new.by_id()), set(old.by_id())
        try:
            m.levels()
        except EngineError as e:
            out.append(str(e))
        for s in m.steps:
            out += [f"{s.step_id} writes {w}, which {new.ref} doesn't define" for w in s.writes if w not in has]
            out += [f"{s.step_id} reads {r}, which neither version defines" for r in (*s.reads, *s.optional_reads) if r not in has | had]
            for ref, get in ((s.recipe, self.recipe), *((v, self.vocabulary) for v in s.vocabularies)):
                if ref:
                    try:
                        get(ref)
                    except EngineError as e:
                        out.append(f"{s.step_id}: {e.code} {ref}")
        settled = m.writes() | set(m.acknowledged)
        for c in diff_schemas(old, new, m.renames).changes:
            if c.kind not in _FREE and not (c.kind in ("renamed", "nesting_changed") and c.identity_preserved) and c.field_id not in settled:
                out.append(f"{c.field_id}: {c.kind} has no step and isn't acknowledged")
        return out

    # graph

    def edges(self, approved_only: bool = True, branch: str | None = None) -> list[Migration]:
        return [m for _, m in sorted(self.migrations.items()) if m.direction == "upgrade" and (m.approved or not approved_only) and (m.branch is None or m.branch == branch)]

    def paths(self, start: str, goal: str, approved_only: bool = True, branch: str | None = None, most: int = 32, no_full_document: bool = False) -> list[list[Migration]]:
        """All simple paths of at most `most` migrations."""
        out, edges = [], self.edges(approved_only, branch)
        if no_full_document:
            edges = [m for m in edges if all(s.full_document != "required" for s in m.steps)]

        def walk(at: str, path: list[Migration], seen: set[str]) -> None:
            if at == goal and path:
                out.append(path)
                return
            if len(path) < most:
                for m in edges:
                    if m.from_schema == at and m.to_schema not in seen:
                        walk(m.to_schema, [*path, m], seen | {m.to_schema})

        walk(start, [], {start})
        return out

    def path(self, start: str, goal: str, preference: str = "fidelity", **filters) -> list[Migration]:
        if start == goal:
            return []
        found = self.paths(start, goal, **filters)
        if not found:
            raise EngineError("path_missing", f"{start} to {goal}")

        def key(p: list[Migration]):
            worst, semantic, steps = max(m.worst_fidelity for m in p), sum(m.semantic_steps for m in p), sum(len(m.steps) for m in p)
            by = {"fidelity": (worst, semantic, len(p)), "cost": (semantic, worst, len(p)), "hops": (len(p), worst, semantic), "latency": (steps, len(p))}[preference]
            return (*by, *(m.migration_id for m in p))

        return min(found, key=key)

    def reachable(self, start: str) -> list[str]:
        seen, todo = set(), [start]
        while todo:
            at = todo.pop()
            for m in self.edges():
                if m.from_schema == at and m.to_schema not in seen:
                    seen.add(m.to_schema)
                    todo.append(m.to_schema)
        return sorted(seen - {start})

    def family(self, name: str) -> list[str]:
        return sorted((r for r in self.schemas if split_ref(r)[0] == name), key=lambda r: [int(x) if x.isdigit() else x for x in split_ref(r)[1].split(".")])

    def latest(self, name: str) -> Schema:
        refs = self.family(name)
        if not refs:
            raise EngineError("schema_unknown", name)
        return self.schemas[refs[-1]]

    def downgrades(self, ref: str) -> list[Migration]:
        return [m for m in self.migrations.values() if m.direction == "downgrade" and m.from_schema == ref]

    def edge_rows(self) -> list[tuple]:
        """(src, dst, migration_id, fidelity, semantic, steps) for the graph queries."""
        return [(m.from_schema, m.to_schema, m.migration_id, m.worst_fidelity, m.semantic_steps, len(m.steps)) for m in self.edges()]

    @property
    def registry_hash(self) -> str:
        return content_hash(
            [sorted([k, getattr(v, h)] for k, v in t.items()) for t, h in ((self.schemas, "schema_hash"), (self.recipes, "recipe_hash"), (self.vocabularies, "vocabulary_hash"), (self.migrations, "migration_hash"))]
        )


RANKS = FIDELITY
