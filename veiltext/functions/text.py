"""Text primitives: stripping, normalising, sentences, previews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veiltext.rules import WHITESPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def normalize_text(text: Column) -> Column:
    """One kind of line end, single blanks, at most one empty line in a row, stripped."""
    # A single blank is left alone: only runs that change are matched. Most characters fail at the first class.
    one_blank = F.regexp_replace(unix_newlines(text), r"[ \t](?:(?<=\t)[ \t]*|[ \t]+)", " ")
    return strip(F.regexp_replace(one_blank, "\n{3,}", "\n\n"))


SENTENCE_END = r"(?U)(?<=[.!?])\s+"


def split_sentences(text: Column) -> Column:
    pieces = F.transform(F.split(text, SENTENCE_END), strip)
    return F.filter(pieces, lambda s: s != "")


def preview(text: Column, limit: int) -> Column:
    """The first `limit` characters, with dots only when something was cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)
