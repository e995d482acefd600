"""Text functions: tokens, sentences, occurrences, slices, estimates, rendering."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences with their end mark, trimmed, none empty."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^.!?]*[.!?]|[^.!?]+$"), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def _ahead(needle: Column) -> Column:
    """A look-ahead for the needle as it is: matches nothing, before every occurrence, overlapping ones too."""
    return F.concat(F.lit("(?=\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))


def occurrences(text: Column, needle: Column) -> Column:
    """0-based starts of all occurrences, overlapping ones too; none for an empty needle. The text is cut before each in one pass; starts are the lengths so far."""
    none = F.array().cast("array<int>")
    pieces = F.split(text, _ahead(needle))
    lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p))
    later = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), none.alias("all")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["all"], acc["at"] + n).alias("all")), lambda acc: acc["all"])
    found = F.when(F.startswith(text, needle), F.array_prepend(later, F.lit(0))).otherwise(later)
    return F.when((F.length(needle) == 0) | (F.instr(text, needle) == 0), none).otherwise(found)


def count_occurrences(text: Column, needle: Column) -> Column:
    """Number of occurrences, overlapping ones too; counted by a look-ahead in one pass."""
    return F.when((F.length(needle) == 0) | (F.instr(text, needle) == 0), F.lit(0)).otherwise(F.regexp_count(text, _ahead(needle)))


def find_first(text: Column, needle: Column) -> Column:
    """0-based start of the first occurrence, -1 for none."""
    return F.instr(text, needle) - 1


def find_unique(text: Column, needle: Column) -> Column:
    """0-based start where there is exactly one occurrence, else null."""
    return F.when(count_occurrences(text, needle) == 1, find_first(text, needle))


def slice_expanded(text: Column, start: Column, end: Column, expand: int = 0) -> Column:
    """text[start - expand : end + expand], clamped."""
    lo = F.greatest(F.lit(0), start - expand)
    hi = F.least(F.length(text), end + expand)
    return F.substring(text, lo + 1, F.greatest(hi - lo, F.lit(0)))


def tokens_for_budget(n_chars: Column, chars_per_token: float = 4.0) -> Column:
    return F.floor(n_chars / chars_per_token + 0.999)


def tokens_for_context(n_chars: Column, chars_per_token: float = 4.0) -> Column:
    return F.ceil(n_chars / chars_per_token)


def price(tokens_in: Column, tokens_out: Column, per_million_in: Column, per_million_out: Column) -> Column:
    return (tokens_in * per_million_in + tokens_out * per_million_out) / 1e6


def backoff(attempt: Column, initial: float, factor: float, most: float) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(factor), attempt - 1), F.lit(most))


def backoff_s(attempt: int, initial: float, factor: float, most: float) -> float:
    return min(initial * factor ** (attempt - 1), most)


def clip(text: Column, most: int = 120) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def render_context(units: Column) -> Column:
    """Units (unit_id, section, text) as one prompt text."""
    one = lambda u: F.concat(F.lit("["), F.concat_ws(" ", u["unit_id"], F.nullif(u["section"], F.lit(""))), F.lit("]\n"), u["text"])
    return F.array_join(F.transform(units, one), "\n\n---\n\n")


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def bm25_part(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def estimate(n_chars: int, chars_per_token: float = 4.0) -> int:
    return math.floor(n_chars / chars_per_token + 0.999)
