"""Masking as columns: by offset, and by value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions.detect import found, is_structural_label
from veiltext.functions.spans import (
    detect_ranked,
    empty_ranked,
    first_per_range,
    resolve_overlaps,
    scan,
)
from veiltext.functions.text import is_blank, let, normalize_text, strip
from veiltext.rules import Detector

BLOCK = 1024


def tag_of(entity: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in rules.TAGS.items() for x in pair])
    return F.coalesce(
        F.try_element_at(known, entity), F.concat(F.lit("[REDACTED_"), entity, F.lit("]"))
    )


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text given as blocks of `BLOCK` code points.

    `substring` walks from the start of its input, so cutting many pieces from one long text would
    take quadratic time; only the blocks under the piece are joined here.
    """
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * BLOCK + 1, end - start)).otherwise("")


def mask_by_offset(text: Column, spans: Column) -> Column:
    """Replace disjoint, ascending spans by their tags."""

    def build(blocks: Column) -> Column:
        pieces = F.transform(
            spans,
            lambda s, i: F.concat(
                _cut(blocks, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0), s["start"]),
                tag_of(s["entity"]),
            ),
        )
        tail = _cut(blocks, F.element_at(spans, -1)["end"], F.length(text))
        return F.concat(F.array_join(pieces, ""), tail)

    blocks = F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    )
    return F.when(F.size(spans) > 0, let(blocks, build)).otherwise(text)


def mask_spans(text: Column, detectors: Sequence[Detector] = rules.SPAN_DETECTORS,
               extra: Column | None = None) -> Column:
    """Detect, resolve and mask without normalising (one slide shape, one cell).

    `extra` holds further spans of this text, of rank 0 (persons, places).
    """
    found = detect_ranked(text, detectors)
    return let(resolve_overlaps(found if extra is None else F.concat(extra, found)),
               lambda spans: mask_by_offset(text, spans))


def mask_text(text: Column, detectors: Sequence[Detector] = rules.SPAN_DETECTORS) -> Column:
    """Normalise, detect, resolve and mask: the whole of one document's cleansing."""
    return let(normalize_text(text), lambda clean: mask_spans(clean, detectors))


def value_items(text: Column, detectors: Sequence[Detector] = rules.VALUE_DETECTORS) -> Column:
    """Distinct `(text, type)` items in detector order, then text order.

    Replacing a value twice changes nothing, so repeats are dropped. The first type of a value wins
    because the second finds nothing left.
    """
    def of(detector: Detector) -> Column:
        return F.transform(
            F.array_distinct(found(text, detector)),
            lambda hit: F.struct(hit.alias("text"), F.lit(detector.entity).alias("type")),
        )

    return F.concat(*[of(d) for d in detectors])


def value_spans(text: Column, detectors: Sequence[Detector] = rules.VALUE_DETECTORS,
                extra: Column | None = None) -> Column:
    """All items with offsets in detector order, one per (start, end); blank text has none.

    `extra` holds further spans of this text, of rank 0 (persons, places): they come first.
    """
    found = detect_ranked(text, detectors)
    spans = first_per_range(found if extra is None else F.concat(extra, found))
    in_order = F.array_sort(
        spans, lambda a, b: F.when(
            F.struct(a["rank"], a["start"]) < F.struct(b["rank"], b["start"]), -1
        ).otherwise(1)
    )
    return F.when(is_blank(text), empty_ranked()).otherwise(in_order)


def distinct_items(spans: Column) -> Column:
    """Spans as the `(text, type)` items that `replace_values` takes."""
    # Strings are told apart by hash, structs one by one.
    both = F.array_distinct(F.transform(spans, lambda s: F.concat(s["entity"], F.lit("\n"), s["text"])))
    return F.transform(both, lambda x: F.struct(
        F.regexp_replace(x, r"^[^\n]*\n", "").alias("text"), F.substring_index(x, "\n", 1).alias("type")
    ))


def replace_values(text: Column, items: Column) -> Column:
    """Replace every occurrence of each item's text, in item order, by its bracketed type."""
    return F.aggregate(
        items,
        text,
        lambda acc, item: F.replace(
            acc, item["text"], F.concat(F.lit("["), item["type"], F.lit("]"))
        ),
    )


# Up to so many values are replaced one after the other in the whole text.
FEW_VALUES = 32
# A value is looked for by its first characters.
ANCHOR = 8
_VALUE = "struct<rank:int,first:int,text:string,entity:string>"
_PLACED = f"array<struct<start:int,value:{_VALUE}>>"


def _placed_values(located: Column) -> Column:
    """Spans by value, each with its value's place in the order of replacement: detector, then text.

    A value found by several detectors or in several places has the first of them, and its type.
    """
    by_text = F.sort_array(F.transform(located, lambda s: F.struct(s["text"], s["rank"], s["start"], s["entity"])))

    def step(held: Column, s: Column) -> tuple[Column, Column, Column]:
        new = F.struct(
            s["rank"].alias("rank"), s["start"].alias("first"), s["text"].alias("text"), s["entity"].alias("entity")
        )
        value = F.when(held["text"] == s["text"], held).otherwise(new)
        return value, F.struct(s["start"].alias("start"), value.alias("value")), F.lit(True)

    return scan(by_text, F.lit(None).cast(_VALUE), _PLACED, step)


def _unplaced(blocks: Column, length: Column, placed: Column, values: Column) -> Column:
    """The values that may occur where no span of theirs begins.

    That is, those whose first characters are at another place of the text, those that are the start
    of another value or begin with one, those shorter than that, and those that may occur in a tag that
    was put in. `values` is ordered by text.
    """
    def met(starts: Column, mine: Column) -> Column:
        """Values whose first characters occur from a place on that is no span's start."""
        between = F.transform(
            F.concat(F.array(F.lit(-1)), starts),
            lambda s, i: _cut(
                blocks, s + 1, F.least(length, F.coalesce(F.get(starts, i), length) + F.lit(ANCHOR - 1))
            ),
        )
        grams = F.flatten(F.transform(between, lambda t: F.regexp_extract_all(t, F.lit("(?s)(?=(.{%d}))" % ANCHOR), F.lit(1))))
        first = F.array_distinct(F.transform(mine, lambda v: F.substring(v["text"], 1, ANCHOR)))
        return let(
            F.array_intersect(first, grams),
            lambda hits: F.filter(mine, lambda v: F.array_contains(hits, F.substring(v["text"], 1, ANCHOR))),
        )

    def touches_tag(v: Column, tags: Column) -> Column:
        return F.rlike(v["text"], F.lit(r"[\[\]]")) | F.exists(tags, lambda t: F.contains(t, v["text"]))

    def related(root: Column, v: Column) -> tuple[Column, Column, Column]:
        under = F.startswith(v["text"], root)
        return F.when(under, root).otherwise(v["text"]), v, F.coalesce(under, F.lit(False))

    roots = F.filter(values, lambda v, i: F.coalesce(
        F.startswith(F.get(values, i + 1)["text"], v["text"]), F.lit(False)
    ))
    starts = F.sort_array(F.array_distinct(F.transform(placed, lambda p: p["start"])))
    elsewhere = let(starts, lambda s: met(s, F.filter(values, lambda v: F.length(v["text"]) >= ANCHOR)))
    tags = F.array_distinct(F.transform(values, lambda v: v["entity"]))
    odd = let(tags, lambda t: F.filter(values, lambda v: (F.length(v["text"]) < ANCHOR) | touches_tag(v, t)))
    return F.concat(
        elsewhere, odd, roots, scan(values, F.lit(None).cast("string"), f"array<{_VALUE}>", related),
    )


def _windows(text: Column, values: Column) -> Column:
    """The text in pieces that no value reaches across: each ends behind a character in no value.

    A piece has about eight times the square root of the text's length, more where no such character
    comes; without any, the text is one piece.
    """
    letters = lambda t: F.array_distinct(F.split(t, ""))
    used = F.array_distinct(F.flatten(F.transform(values, lambda v: letters(v["text"]))))
    safe = F.filter(F.array_except(letters(text), used), lambda c: c != "")
    kinds = F.array_join(F.transform(safe, lambda c: F.concat(F.lit("\\x{"), F.hex(F.ascii(c)), F.lit("}"))), "")
    size = F.greatest(F.lit(BLOCK), F.ceil(8 * F.sqrt(F.length(text)))).cast("string")
    return let(kinds, lambda k: F.when(k == "", F.array(text)).otherwise(F.regexp_extract_all(
        text, F.concat(F.lit("(?s).{1,"), size, F.lit("}[^"), k, F.lit("]*+["), k, F.lit("]?")), F.lit(0)
    )))


def _replace_many(text: Column, located: Column) -> Column:
    """As `replace_values` of all spans' values, for very many of them.

    Values are replaced in order, but each in those pieces of the text alone in which it can occur: in
    which it has a span, or in all if it may occur elsewhere too. No value reaches across two pieces, so
    the order between values of different pieces makes no difference.
    """
    def pieces(blocks: Column, placed: Column, values: Column) -> Column:
        def bounded(windows: Column) -> Column:
            def step(at: Column, t: Column) -> tuple[Column, Column, Column]:
                end = at + F.length(t)
                return end, F.struct(at.alias("low"), end.alias("high"), t.alias("body")), F.lit(True)

            return scan(windows, F.lit(0), "array<struct<low:int,high:int,body:string>>", step)

        def replaced(elsewhere: Column) -> Column:
            def one(window: Column) -> Column:
                here = F.filter(
                    placed, lambda p: (p["start"] >= window["low"]) & (p["start"] < window["high"])
                )
                items = F.sort_array(F.array_distinct(F.concat(F.transform(here, lambda p: p["value"]), elsewhere)))
                return replace_values(window["body"], F.transform(
                    items, lambda v: F.struct(v["text"].alias("text"), v["entity"].alias("type"))
                ))

            return F.array_join(F.transform(bounded(_windows(text, values)), one), "")

        # The length of a text is counted anew wherever it is named.
        elsewhere = let(F.length(text), lambda n: _unplaced(blocks, n, placed, values))
        return let(elsewhere, replaced)

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    # Equal values stand together, so the first of each is the one that differs from the one before.
    distinct = lambda placed: F.filter(F.transform(placed, lambda p: p["value"]), lambda v, i: (i == 0) | (
        v["text"] != F.get(placed, i - 1)["value"]["text"]
    ))
    return let(blocks, lambda b: let(_placed_values(located), lambda p: let(
        distinct(p), lambda v: pieces(b, p, v)
    )))


def mask_by_value(text: Column, detectors: Sequence[Detector] = rules.VALUE_DETECTORS) -> Column:
    """Replace every occurrence of each value found, in detector order, then text order."""
    return let(value_items(text, detectors), lambda items: F.when(
        F.size(items) <= FEW_VALUES, replace_values(text, items)
    ).otherwise(_replace_many(text, detect_ranked(text, detectors))))


def mask_cell_by_value(cell: Column,
                       detectors: Sequence[Detector] = rules.VALUE_DETECTORS) -> Column:
    """A grid cell: blanks, labels and cells without items stay as they were, not even stripped."""
    value = strip(cell)
    masked = let(
        value_items(value, detectors),
        lambda items: F.when(F.size(items) > 0, replace_values(value, items)).otherwise(cell),
    )
    return F.when(is_blank(cell) | is_structural_label(cell), cell).otherwise(masked)
