"""The seven value states and the predicates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("present", "not_reported", "not_applicable", "unknown", "not_extracted", "extraction_failed", "review_required")
WITH_VALUE = ("present", "review_required")
ABSENT_FOR_GOOD = ("not_reported", "not_applicable")
RUNNING = ("deterministic", "cached", "semantic")
BILLABLE = ("semantic",)
TERMINAL = ("succeeded", "failed", "blocked", "review_needed", "cancelled", "skipped")
BLOCKS_PUBLICATION = ("failed", "blocked", "review_needed", "cancelled")


def has_value(status: Column) -> Column:
    return status.isin(*WITH_VALUE)


def absent_for_good(status: Column) -> Column:
    return status.isin(*ABSENT_FOR_GOOD)


def runs(disposition: Column) -> Column:
    return disposition.isin(*RUNNING)


def billable(disposition: Column) -> Column:
    return disposition.isin(*BILLABLE)


def terminal(state: Column) -> Column:
    return state.isin(*TERMINAL)


def blocks_publication(state: Column) -> Column:
    return state.isin(*BLOCKS_PUBLICATION)


def gold_matches(gold_status: Column, gold_value: Column, status: Column, value: Column, also: Column | None = None) -> Column:
    """Same status, and for values the same JSON text or any acceptable one; arrays are equal if their items are, as text and in any order."""
    items = lambda v: F.array_sort(F.from_json(F.when(F.startswith(v, F.lit("[")), v), "array<string>"))
    alike = lambda a: a.eqNullSafe(value) | F.coalesce(items(a) == items(value), F.lit(False))
    same = alike(gold_value)
    if also is not None:
        same = same | F.coalesce(F.exists(also, alike), F.lit(False))
    return (gold_status == status) & (~has_value(gold_status) | same)
