"""Detectors as columns: `Column -> array<string>` of whole matches in text order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltext import rules
from veiltext.rules import Detector


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def has_hint(text: Column, detector: Detector) -> Column:
    """Cheap test that is true whenever the detector could match."""
    if detector.hint == "@":
        return F.contains(text, F.lit("@"))
    return F.rlike(text, F.lit(detector.hint))


def luhn_ok(card: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(card, r"(?U)[-\s]", ""))


def is_address(hit: Column) -> Column:
    """Whether a match of a `mail` pattern is an address, not a run that it skipped."""
    return F.rlike(hit, F.lit(rules.ADDRESS))


def found(text: Column, detector: Detector) -> Column:
    hits = matches(text, detector.search)
    if detector.luhn:
        hits = F.filter(hits, luhn_ok)
    if detector.mail:
        hits = F.filter(hits, is_address)
    return F.when(has_hint(text, detector), hits).otherwise(
        F.array().cast("array<string>")
    )


def bears_item(text: Column, detectors: Sequence[Detector]) -> Column:
    """Whether any detector finds something; stops at the first match."""
    tests = [
        has_hint(text, d) & (
            F.exists(matches(text, d.search), luhn_ok if d.luhn else is_address)
            if d.luhn or d.mail else F.rlike(text, F.lit(d.search))
        )
        for d in detectors
    ]
    return reduce(lambda a, b: a | b, tests)


def by_name(entity: str) -> Detector:
    known = {d.entity: d for d in rules.VALUE_DETECTORS + rules.SPAN_DETECTORS}
    return known[entity]


def is_structural_label(text: Column) -> Column:
    """A form label or month name, longer than one character once stripped."""
    label = F.upper(F.btrim(text, F.lit(rules.WHITESPACE)))
    return (F.length(label) > 1) & label.isin(*rules.STRUCTURAL_LABELS, *rules.MONTHS)


def is_person_name(text: Column) -> Column:
    """Whether a dictionary or model hit may stand as a person's name."""
    name = F.btrim(text, F.lit(rules.WHITESPACE))
    return (
        (F.length(name) > 1)
        & ~is_structural_label(text)
        & ~F.rlike(name, F.lit(r"^[\p{Nd}\u00b9\u00b2\u00b3]+$"))
        & ~F.upper(name).isin(*rules.NOT_PERSONS)
    )


def detectors_of(table: DataFrame) -> tuple[Detector, ...]:
    """Detectors from rows `name, rank, pattern, enabled`: those enabled, by rank and then name.

    A row without a pattern means the built-in detector of that name; with one, it is the user's own
    and takes the place of any built-in. The table is a short list of rules that shapes the query.
    """
    rows = table.filter(F.col("enabled")).orderBy("rank", "name").collect()
    return tuple(
        Detector(r["name"], r["pattern"], "(?s)^") if r["pattern"] else by_name(r["name"]) for r in rows
    )
