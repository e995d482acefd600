"""Migrations, their steps, execution policy, YAML, scaffolds."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import yaml

from strataweave.errors import EngineError
from strataweave.functions.ids import content_hash
from strataweave.model.schema import Schema, SchemaDiff

#: Names of migration files: fidelities from best to worst, kinds of steps by what runs them, kinds of references.
FIDELITY = ("lossless", "potentially_lossy", "destructive")
FILE_DETERMINISTIC = ("structural", "derived", "vocabulary")
FILE_SEMANTIC = ("evidence_semantic", "source_semantic", "reextraction")
OTHER_KINDS = ("manual_review", "validation", "assembly")
REF_KINDS = ("field", "evidence", "source", "vocab", "recipe", "status", "entity")
#: Finer kinds of our own, and the file kind of each; those without a transform of their own are written with one of this version.
FILE_KIND = {"copy": "structural", "rename": "structural", "split": "structural", "merge": "structural", "cast": "structural", "drop": "structural", "default": "structural", "derive": "derived", "remap": "vocabulary", "semantic": "source_semantic", "document_semantic": "source_semantic"}
_BUILT_IN = "@builtin"
DETERMINISTIC = frozenset({*FILE_DETERMINISTIC, *(k for k, v in FILE_KIND.items() if v in FILE_DETERMINISTIC)})
SEMANTIC = frozenset({*FILE_SEMANTIC, "semantic", "document_semantic"})
KINDS = DETERMINISTIC | SEMANTIC | {*OTHER_KINDS}


def parse_ref(text: str) -> tuple[str, str]:
    """(kind, name) of a typed reference kind:name."""
    kind, colon, name = text.strip().partition(":")
    if not colon or kind not in REF_KINDS or not name:
        raise EngineError("migration_invalid", f"{text!r} is no reference; one of {', '.join(REF_KINDS)} and a name are due, with a colon between")
    return kind, name


@dataclass(frozen=True)
class Step:
    step_id: str
    kind: str
    reads: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()
    scope: str = ""
    transform: str | None = None
    recipe: str | None = None
    context: dict | None = None
    vocabularies: tuple[str, ...] = ()
    validators: tuple[str, ...] = ()
    optional_reads: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    fidelity: str = "lossless"
    reusable: bool = True
    params: dict = field(default_factory=dict)
    refs: tuple[str, ...] = ()  # typed references but those to fields and vocabularies
    on_missing_context: str | None = None
    description: str = ""

    def __post_init__(self):
        for name in ("reads", "writes", "vocabularies", "validators", "optional_reads", "after", "refs"):
            object.__setattr__(self, name, tuple(dict.fromkeys(getattr(self, name))))
        if self.fidelity == "lossy":
            object.__setattr__(self, "fidelity", "potentially_lossy")
        for ref in self.refs:
            parse_ref(ref)
        if self.kind not in KINDS:
            raise EngineError("migration_invalid", f"{self.step_id}: no step kind {self.kind!r}")
        if self.fidelity not in FIDELITY:
            raise EngineError("migration_invalid", f"{self.step_id}: no fidelity {self.fidelity!r}")
        if not self.writes and self.kind not in ("validation", "assembly"):
            raise EngineError("migration_invalid", f"{self.step_id} writes nothing")
        if self.kind in FILE_DETERMINISTIC and not self.transform:
            raise EngineError("migration_invalid", f"{self.step_id} names no transform")
        if self.kind in ("source_semantic", "reextraction") and not self.recipe:
            raise EngineError("migration_invalid", f"{self.step_id} names no recipe")
        if self.kind == "evidence_semantic" and self.full_document in ("allowed", "required"):
            raise EngineError("full_document_forbidden", f"{self.step_id} works on evidence and mustn't be given whole documents")

    @property
    def deterministic(self) -> bool:
        return self.kind in DETERMINISTIC

    @property
    def semantic(self) -> bool:
        return self.kind in SEMANTIC

    @property
    def full_document(self) -> str:
        own = self.context or {}
        return own.get("full_document") or own.get("full_document_fallback") or "forbidden"

    @property
    def touches_source(self) -> bool:
        """Whether it may read the source: not where it is kept to stored evidence."""
        return self.semantic and self.kind != "evidence_semantic" or any(parse_ref(r)[0] == "source" for r in self.refs)

    @property
    def step_hash(self) -> str:
        return content_hash(asdict(self))


@dataclass(frozen=True)
class Migration:
    migration_id: str
    from_schema: str
    to_schema: str
    steps: tuple[Step, ...] = ()
    approved: bool = True
    branch: str | None = None
    direction: str = "upgrade"
    renames: dict = field(default_factory=dict)
    acknowledged: tuple[str, ...] = ()
    on_stale: str = "report"
    notes: str = ""
    because: dict = field(default_factory=dict)  # reasons of what is acknowledged
    downgrade: str | None = None  # the migration that leads back
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "steps", tuple(self.steps))
        object.__setattr__(self, "acknowledged", tuple(self.acknowledged))
        ids = [s.step_id for s in self.steps]
        if len(set(ids)) < len(ids):
            raise EngineError("migration_invalid", f"{self.migration_id}: step ids repeat")

    @property
    def worst_fidelity(self) -> int:
        return max((FIDELITY.index(s.fidelity) for s in self.steps), default=0)

    @property
    def semantic_steps(self) -> int:
        return sum(s.semantic for s in self.steps)

    @property
    def migration_hash(self) -> str:
        return content_hash(asdict(self))

    def writes(self) -> set[str]:
        return {w for s in self.steps for w in s.writes}

    def levels(self) -> list[list[Step]]:
        """Steps in topological levels (after, and reads after the write), each in order of id."""
        by_id = {s.step_id: s for s in self.steps}
        producer = {w: s.step_id for s in self.steps for w in s.writes}
        needs = {s.step_id: {a for a in s.after if a in by_id} | {producer[r] for r in (*s.reads, *s.optional_reads) if r in producer and producer[r] != s.step_id and r not in s.writes} for s in self.steps}
        out = []
        while needs:
            ready = sorted(k for k, v in needs.items() if not v)
            if not ready:
                raise EngineError("cycle", f"{self.migration_id}: steps {sorted(needs)} wait for each other")
            out.append([by_id[k] for k in ready])
            needs = {k: v - set(ready) for k, v in needs.items() if k not in ready}
        return out

    def ordered_steps(self) -> list[Step]:
        return [s for level in self.levels() for s in level]


@dataclass(frozen=True)
class ExecutionPolicy:
    allow_lossy: bool = False
    allow_destructive: bool = False
    destructive_named: tuple[str, ...] = ()
    preference: str = "fidelity"
    max_usd: float | None = None
    max_calls: int | None = None
    providers_allowed: tuple[str, ...] | None = None
    providers_denied: tuple[str, ...] = ()
    provider_attributes: dict = field(default_factory=dict)
    allow_billable_retrieval: bool = False

    def permits(self, m: Migration) -> bool:
        """By the migration's worst fidelity: lossless always; lossy where allowed; destructive where allowed and the migration named. Destructive alone doesn't grant lossy."""
        worst = FIDELITY[m.worst_fidelity]
        return worst == "lossless" or (self.allow_lossy if worst == "potentially_lossy" else self.allow_destructive and m.migration_id in self.destructive_named)

    def permits_provider(self, name: str, attributes: dict | None = None) -> bool:
        if name in self.providers_denied or (self.providers_allowed is not None and name not in self.providers_allowed):
            return False
        return all((attributes or {}).get(k) == v for k, v in self.provider_attributes.items())


# YAML ---------------------------------------------------------------------------------------------------------------------------

def _tuples(d: dict) -> dict:
    return {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}


def _name(text: str) -> str:
    """A field's name, with or without field: before it."""
    return text[6:] if text.startswith("field:") else text


def step_from(d: dict) -> Step:
    """A step as files have it (id, entity_scope, typed references in reads) or with our own names."""
    own = {{"id": "step_id", "entity_scope": "scope"}.get(k, k): v for k, v in d.items() if v is not None}
    refs = [parse_ref(r) if r.split(":", 1)[0] in REF_KINDS and ":" in r else ("field", r) for r in own.get("reads") or ()]
    own["reads"] = [n for k, n in refs if k == "field"]
    own["vocabularies"] = [*(own.get("vocabularies") or ()), *(n for k, n in refs if k == "vocab")]
    own["refs"] = [*(own.get("refs") or ()), *(f"{k}:{n}" for k, n in refs if k not in ("field", "vocab"))]
    own["writes"] = [_name(w) for w in own.get("writes") or ()]
    if (own.get("transform") or "").endswith(_BUILT_IN):
        own["kind"] = own.pop("transform").removesuffix(_BUILT_IN)
    return Step(**_tuples(own))


def migration_from(d: dict) -> Migration:
    own = {{"id": "migration_id", "description": "notes"}.get(k, k): v for k, v in d.items() if k != "steps"}
    if isinstance(own.get("acknowledged"), dict):
        own["because"] = {k: v for k, v in own["acknowledged"].items() if v}
        own["acknowledged"] = list(own["acknowledged"])
    if own.pop("is_downgrade", False):
        own["direction"] = "downgrade"
    if own.get("branch") == "main":
        del own["branch"]
    try:
        return Migration(**_tuples(own), steps=tuple(step_from(s) for s in d.get("steps") or ()))
    except (TypeError, KeyError) as e:
        raise EngineError("migration_invalid", str(e)) from e


def load_migrations(text: str) -> list[Migration]:
    """One or more documents; a document is a migration, a list of them, or {migrations: [...]}."""
    out = []
    for doc in yaml.safe_load_all(text):
        if doc:
            out += [migration_from(d) for d in (doc if isinstance(doc, list) else doc.get("migrations", [doc]))]
    return out


def step_to(s: Step, portable: bool = False) -> dict:
    d = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(s).items()}
    out = {"id": d.pop("step_id"), "kind": d.pop("kind")}
    out |= {"description": d.pop("description"), "reads": [*(f"field:{r}" for r in s.reads), *s.refs, *(f"vocab:{v}" for v in s.vocabularies)], "writes": [f"field:{w}" for w in s.writes], "entity_scope": d.pop("scope")}
    out |= {k: v for k, v in d.items() if k not in ("reads", "writes", "refs", "vocabularies")}
    if portable and s.kind in FILE_KIND:
        out["kind"] = FILE_KIND[s.kind]
        if s.deterministic and not s.transform:
            out["transform"] = s.kind + _BUILT_IN
    return {k: v for k, v in out.items() if v not in (None, [], {}, "") and not (k == "reusable" and v) and not (k == "fidelity" and v == "lossless")}


def dump_migrations(migrations: list[Migration], portable: bool = False) -> str:
    """YAML that load_migrations reads back. portable: only with the file kinds, so finer kinds that name a transform or a recipe come back as these."""
    docs = []
    for m in migrations:
        out = {"id": m.migration_id, "from_schema": m.from_schema, "to_schema": m.to_schema, "description": m.notes, "renames": dict(m.renames), "acknowledged": {k: m.because.get(k, "") for k in m.acknowledged}, "branch": m.branch}
        out |= {"approved": None if m.approved else False, "is_downgrade": m.direction == "downgrade" or None, "downgrade": m.downgrade, "on_stale": None if m.on_stale == "report" else m.on_stale, "metadata": dict(m.metadata)}
        docs.append({k: v for k, v in out.items() if v not in (None, "", {})} | {"steps": [step_to(s, portable) for s in m.steps]})
    return yaml.safe_dump_all(docs, sort_keys=False, allow_unicode=True)


# scaffold -----------------------------------------------------------------------------------------------------------------------

_STUBS = {
    "added": ("semantic", "lossless"), "type_changed": ("cast", "potentially_lossy"), "cardinality_changed": ("derive", "potentially_lossy"), "nesting_changed": ("derive", "potentially_lossy"), "renamed": ("rename", "lossless"),
    "vocabulary_changed": ("remap", "potentially_lossy"), "constraint_narrowed": ("remap", "potentially_lossy"), "requiredness_changed": ("derive", "lossless"),
}


def scaffold(diff: SchemaDiff, new: Schema) -> Migration:
    """A stub for every change that needs a decision; not approved, marked TODO."""
    steps, notes, seen = [], [], set()
    for c in diff.changes:
        if c.kind == "renamed" and c.identity_preserved or c.kind not in _STUBS or (c.field_id, c.kind) in seen:
            notes.append(f"{c.kind}: {c.field_id}")
            continue
        seen.add((c.field_id, c.kind))
        kind, fidelity = _STUBS[c.kind]
        f = new.by_id().get(c.field_id)
        more = {"recipe": "TODO@1"} if kind == "semantic" else {"transform": "TODO@1"}
        reads = () if kind == "semantic" else (c.field_id,)
        steps.append(Step(f"{c.kind}-{c.field_id.replace('[]', '').replace('.', '-')}", kind, reads, (c.field_id,), f.collection if f else "", fidelity=fidelity, **more))
    return Migration(f"{diff.old_ref}->{diff.new_ref}", diff.old_ref, diff.new_ref, tuple(steps), approved=False, notes="TODO " + "; ".join(notes))
