"""Recipes, vocabularies, context policies, escalation."""

from __future__ import annotations

import importlib
from dataclasses import asdict, dataclass, field

import yaml

from strataweave.functions.ids import content_hash, version_ref

SELECTORS = ("none", "structured_fields", "prior_evidence", "evidence_window", "sections", "unit_kinds", "retrieve", "full_document", "raw_document")


@dataclass(frozen=True)
class Source:
    """One way to select context."""

    selector: str
    params: dict = field(default_factory=dict)
    min_units: int = 1
    billable: bool = False


@dataclass(frozen=True)
class ContextPolicy:
    sequence: tuple[Source, ...] = (Source("prior_evidence"),)
    accumulate: bool = False
    full_document: str = "forbidden"  # forbidden, allowed, required
    max_units: int | None = None
    max_chars: int | None = None
    max_input_tokens: int | None = None
    max_sections: int | None = None
    chars_per_token: float = 4.0
    on_budget: str = "truncate"  # truncate, skip, fail
    on_missing: str = "review"  # review, block, proceed
    forbidden_labels: tuple[str, ...] = ()

    def effective_sequence(self) -> tuple[Source, ...]:
        whole = Source("full_document")
        if self.full_document == "required":
            return (whole,)
        return (*self.sequence, whole) if self.full_document == "allowed" and all(s.selector != "full_document" for s in self.sequence) else self.sequence

    @property
    def policy_hash(self) -> str:
        return content_hash(asdict(self))


@dataclass(frozen=True)
class Escalation:
    enabled: bool = False
    signal: str = "needs_more_context"
    on_unknown: bool = False
    max_escalations: int = 2

    def wants_more(self, answer: dict) -> bool:
        """Some value of the answer is the signal, or unknown where that counts."""
        states = [v.get("status") if isinstance(v, dict) else v for v in answer.values()]
        return self.enabled and any(s == self.signal or (self.on_unknown and s == "unknown") for s in states)


@dataclass(frozen=True)
class Recipe:
    name: str
    version: str
    prompt: str = ""
    outputs: tuple[str, ...] = ()
    model: str = ""
    fallbacks: tuple[str, ...] = ()
    model_params: dict = field(default_factory=dict)
    context: ContextPolicy = field(default_factory=ContextPolicy)
    escalation: Escalation = field(default_factory=Escalation)
    fingerprint: str | None = None
    max_attempts: int = 3
    max_usd: float | None = None
    out_tokens: int = 250
    prompt_builder: str | None = None
    postprocessor: str | None = None
    shadow: str | None = None
    retry_schema_failures: bool = True

    @property
    def ref(self) -> str:
        return version_ref(self.name, self.version)

    @property
    def prompt_hash(self) -> str:
        return content_hash([self.prompt, self.prompt_builder])

    @property
    def model_hash(self) -> str:
        return content_hash([self.model, self.fallbacks, self.model_params])

    @property
    def recipe_hash(self) -> str:
        return content_hash(asdict(self))

    def render(self, values: dict) -> str:
        """The prompt with {names} filled in; names are field paths without [] and with _ for dots."""
        return self.prompt.format(**{variable(k): v for k, v in values.items()})


def variable(path: str) -> str:
    return path.replace("[]", "").replace(".", "_")


@dataclass(frozen=True)
class Vocabulary:
    name: str
    version: str
    values: tuple[str, ...] = ()
    replaces: dict = field(default_factory=dict)
    reopens: tuple[str, ...] = ()
    descriptions: dict = field(default_factory=dict)

    @property
    def ref(self) -> str:
        return version_ref(self.name, self.version)

    @property
    def vocabulary_hash(self) -> str:
        return content_hash(asdict(self))


#: Names that files give to parts of a context policy, and the list that a selector takes.
_FILE_NAMES = {"full_document_fallback": "full_document", "on_missing_context": "on_missing"}
_LISTS = {"sections": "names", "unit_kinds": "kinds", "structured_fields": "fields"}


def _source(s) -> Source:
    """A selector by name, with our own names, or as {selector: its list or parameters}."""
    if isinstance(s, str):
        return Source(s, min_units=0 if s == "none" else 1)
    if "selector" in s or len(s) != 1:
        return Source(**s)
    ((name, given),) = s.items()
    return Source(name, given if isinstance(given, dict) else {_LISTS.get(name, "values"): list(given)} if isinstance(given, (list, tuple)) else {"value": given})


def policy_from(d: dict) -> ContextPolicy:
    """A context policy from its file form; a budget of its own may hold the limits, privacy the forbidden labels."""
    d = {_FILE_NAMES.get(k, k): v for k, v in ({**(d.get("budget") or {}), **(d.get("privacy") or {}), **d}).items() if k not in ("budget", "privacy", "version")}
    seq = tuple(_source(s) for s in d.get("sequence", ("prior_evidence",)))
    return ContextPolicy(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k != "sequence"}, sequence=seq)


def load_recipes(text_or_ref: str) -> list[Recipe | Vocabulary]:
    """YAML text ({recipes: [...], vocabularies: [...]}), or module:function that returns them."""
    if "\n" not in text_or_ref and ":" in text_or_ref and " " not in text_or_ref:
        module, _, name = text_or_ref.partition(":")
        return list(getattr(importlib.import_module(module), name)())
    out: list[Recipe | Vocabulary] = []
    for doc in yaml.safe_load_all(text_or_ref):
        for r in (doc or {}).get("recipes", ()):
            r = {k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}
            if "context" in r:
                r["context"] = policy_from(r["context"])
            if "escalation" in r:
                r["escalation"] = Escalation(**r["escalation"])
            out.append(Recipe(**r))
        for v in (doc or {}).get("vocabularies", ()):
            out.append(Vocabulary(**{k: tuple(x) if isinstance(x, list) else x for k, x in v.items()}))
    return out
