"""Column expressions shared by the operators. All of them stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tieout import defaults as D

MONEY = "decimal(18,2)"


def money(value: Column) -> Column:
    """Two-decimal DOUBLE for output, taken after the exact decimal sum."""
    return F.round(value.cast("double"), 2)


def amount_of(raw: Column) -> Column:
    """Number in a text or numeric column; what is not a number counts as zero."""
    return F.coalesce(raw.cast("string").try_cast(MONEY), F.lit(0).cast(MONEY))


def time_of(raw: Column, formats: tuple[str, ...] = ()) -> Column:
    """Timestamp in a text or date column; null where no known format fits."""
    text = raw.cast("string")
    tries = [text.try_cast("timestamp")] + [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def quarter_label(when: Column) -> Column:
    return F.concat(F.year(when).cast("string"), F.lit("Q"), F.quarter(when).cast("string"))


def period_key(period: Column) -> Column:
    """``2024-Q1`` and ``2024Q1`` are the same period."""
    return F.replace(period, F.lit("-"), F.lit(""))


def flag(raw: Column) -> Column:
    """Text, number or boolean read as a flag; null and anything unknown are false."""
    text = F.lower(F.trim(raw.cast("string")))
    return F.coalesce(text.isin("true", "t", "yes", "y", "1", "1.0"), F.lit(False))


def contains_text(value: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(value).contains(n.lower()) for n in needles])


def category(raw: Column, rules=None) -> Column:
    """Canonical category: the first rule found in the text, otherwise the text in title case."""
    text = F.lower(F.trim(raw))
    chosen = [F.when(text.contains(needle), F.lit(name)) for needle, name in (rules or D.CATEGORY_RULES)]
    return F.coalesce(*chosen, F.initcap(F.trim(raw)))


def is_headline(group_label: Column) -> Column:
    return F.coalesce(group_label.rlike(D.HEADLINE_PATTERN), F.lit(False))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, null where the whole is zero."""
    part, whole = part.cast("double"), whole.cast("double")
    return F.when(whole != 0, F.round(part / whole * 100, digits))


def gap_status(gap: Column, has_gap: Column, large: float = D.LARGE_GAP) -> Column:
    return F.when(~has_gap, "Match").when(F.abs(gap) > large, "Gap").otherwise("Minor")


def confidence_label(confidence: Column, priors: dict | None = None) -> Column:
    top = max((priors or D.CONFIDENCE).values())
    return F.when(confidence >= top * 0.9, "High").when(confidence >= top * 0.65, "Medium").otherwise("Low")


def token_sorted(text: Column) -> Column:
    """Words of the text in order, joined by one blank."""
    return F.array_join(F.sort_array(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")), " ")
