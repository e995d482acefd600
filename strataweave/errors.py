"""Structured errors: a code, a message, whether trying again can help."""

from __future__ import annotations

RETRYABLE = frozenset({"transport", "rate_limited", "schema_invalid", "semantic_invalid", "timeout"})
CODES = RETRYABLE | frozenset(
    "config_invalid migration_invalid migration_missing path_missing path_ambiguous schema_unknown schema_conflict recipe_unknown vocabulary_unknown recipe_conflict cycle write_undefined read_undefined disposition_missing "
    "fidelity_not_permitted full_document_forbidden provider_forbidden context_unavailable context_budget_exceeded context_unsupported missing_dependency budget_exhausted fingerprint_mismatch transform_failed validation_failed "
    "registry_moved execution_exists execution_unknown plan_changed review_unknown review_invalid gold_empty gate_failed record_unknown store_format json_invalid".split()
)


class EngineError(Exception):
    def __init__(self, code: str, message: str = "", **details):
        if code not in CODES:
            raise ValueError(f"no error code {code!r}")
        super().__init__(message or code)
        self.code, self.details = code, details

    @property
    def retryable(self) -> bool:
        return self.code in RETRYABLE

    def row(self) -> dict:
        return {"code": self.code, "message": str(self), "retryable": self.retryable, **self.details}
