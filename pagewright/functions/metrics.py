"""Text and page-set metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import PY_SPACE, casefold, collapse_space

# Fixed value: a money-like number, with sign, brackets and thousands commas.
NUMBER = rf"[-+]?\(?\$?[{PY_SPACE}]*([0-9][0-9,]*(?:\.[0-9]+)?)[{PY_SPACE}]*\)?"


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length, of case-folded, space-collapsed texts; 1 for two empty ones."""
    x, y = (collapse_space(casefold(c)) for c in (a, b))
    return 1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def parse_number(text: Column) -> Column:
    """The first money-like number of ``text``, negative with a minus or brackets; null if there is none."""
    whole = F.regexp_extract(text, NUMBER, 0)
    value = F.replace(F.regexp_extract(text, NUMBER, 1), F.lit(","), F.lit("")).try_cast("double")
    negative = F.ltrim(whole).startswith("-") | (F.contains(whole, F.lit("(")) & F.contains(whole, F.lit(")")))
    return F.when(whole != "", F.when(negative, -value).otherwise(value))


def close(a: Column, b: Column, tolerance: Column | float) -> Column:
    """Whether two numbers agree within a relative and absolute tolerance."""
    t = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    return F.abs(a - b) <= F.greatest(t * F.greatest(F.abs(a), F.abs(b)), t)


def numeric_match(reference: Column, prediction: Column, tolerance: Column | float) -> Column:
    """Whether the numbers in two texts agree; false where one has none."""
    return F.coalesce(close(parse_number(reference), parse_number(prediction), tolerance), F.lit(False))


def recall_at_k(relevant: Column, ranking: Column, k: int) -> Column:
    """Share of ``relevant`` in the first k of ``ranking``; 1 if nothing is relevant."""
    gold = F.array_distinct(relevant)
    return F.when(F.size(gold) == 0, 1.0).otherwise(F.size(F.array_intersect(gold, F.slice(ranking, 1, k))) / F.size(gold))


def reciprocal_rank(relevant: Column, ranking: Column) -> Column:
    """1 / position of the first relevant entry, 0 without one."""
    hits = F.filter(F.transform(ranking, lambda p, i: F.when(F.array_contains(relevant, p), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(1.0 / F.get(hits, F.lit(0)), F.lit(0.0))


def page_f1(relevant: Column, predicted: Column) -> Column:
    """F1 of two page sets; 1 if both are empty, 0 if one is."""
    a, b = F.array_distinct(relevant), F.array_distinct(predicted)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def clip(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def page_risk(disagreement: Column, malformed: Column, numeric: Column, repetition: Column) -> Column:
    """Weighted review risk in [0, 1]; fixed weights .40, .25, .25, .10."""
    return clip(0.40 * clip(disagreement) + 0.25 * malformed.cast("double") + 0.25 * clip(numeric) + 0.10 * clip(repetition))
