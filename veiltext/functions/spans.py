"""Spans: located matches, overlap resolution and exact-span de-duplication, all inside a row.

A document's spans live in one array, so finding and resolving them needs no shuffle. Offsets are
code points, counted from 0 with an open end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions.detect import has_hint, is_address, luhn_ok, matches
from veiltext.functions.text import let
from veiltext.rules import Detector

# Field order is sort order: start, then longest, then detector rank.
RANKED = (
    "array<struct<start:int,shorter:int,rank:int,entity:string,text:string,"
    "end:int,source:string>>"
)
LEAST_BLOCK = 64


def empty_ranked() -> Column:
    return F.array().cast(RANKED)


def ranked_span(start: Column, end: Column, rank: Column | int, entity: Column | str,
                text: Column, source: str) -> Column:
    rank = rank if isinstance(rank, Column) else F.lit(rank)
    entity = entity if isinstance(entity, Column) else F.lit(entity)
    return F.struct(
        start.cast("int").alias("start"),
        (start - end).cast("int").alias("shorter"),
        rank.cast("int").alias("rank"),
        entity.alias("entity"),
        text.alias("text"),
        end.cast("int").alias("end"),
        F.lit(source).alias("source"),
    )


def scan(items: Column, state: Column, out_type: str,
         step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """One pass over an array that carries a state and emits elements.

    `step(state, item)` gives the next state, the element, and whether to emit it. A fold hands on its
    whole state with every item, so a block of items is folded by itself and its elements are appended
    to those of the blocks before. With blocks as long as there are blocks, that is near linear in time.
    """
    none = F.array().cast(out_type)

    def inner(acc: Column, item: Column) -> Column:
        after, element, emit = step(acc["state"], item)
        out = F.when(emit, F.array_append(acc["out"], element)).otherwise(acc["out"])
        return F.struct(after.alias("state"), out.alias("out"))

    def outer(acc: Column, part: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), none.alias("out"))
        return let(F.aggregate(part, begin, inner), lambda r: F.struct(
            r["state"].alias("state"), F.array_append(acc["done"], r["out"]).alias("done")
        ))

    def run(all_items: Column) -> Column:
        def cut(block: Column) -> Column:
            last = F.greatest(F.floor((F.size(all_items) - 1) / block).cast("int"), F.lit(0))
            return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_items, b * block + 1, block))

        parts = let(F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt(F.size(all_items))).cast("int")), cut)
        begin = F.struct(state.alias("state"), F.array().cast(f"array<{out_type}>").alias("done"))
        return F.aggregate(parts, begin, outer, lambda acc: F.flatten(acc["done"]))

    return let(items, run)


def with_gaps(text: Column, hits: Column, pattern: str) -> Column:
    """Each match with the text before it, `array<struct<hit, gap>>`; last, the text after."""
    return F.zip_with(
        hits, F.split(text, pattern, -1), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap"))
    )


# Up to so many of a detector's matches are looked for one by one.
FEW_HITS = 16


def occur_once(text: Column, hits: Column) -> Column:
    """Whether there are few hits and each one's text occurs in one place alone, which is then its place."""
    return (F.size(hits) <= FEW_HITS) & F.forall(
        hits, lambda h: F.position(h, text, F.position(h, text) + 1) == 0
    )


def detect_ranked(text: Column, detectors: Sequence[Detector] = rules.SPAN_DETECTORS,
                  first_rank: int = 1) -> Column:
    """All detectors' spans with offsets, unresolved, in detector order.

    A match whose text occurs once is where that text is found, so the pattern is searched once. For
    others and for many, the text between matches (a split on the same pattern) and the matches
    themselves alternate, so a running sum of their lengths gives code-point offsets, which
    `regexp_instr` does not.
    """

    def of(d: Detector, rank: int) -> Column:
        def span(begin: Column, hit: Column) -> Column:
            return ranked_span(begin, begin + F.length(hit), rank, d.entity, hit, "regex")

        def step(at: Column, pair: Column) -> tuple[Column, Column, Column]:
            begin = at + F.length(pair["gap"])
            emit = pair["hit"].isNotNull()
            return begin + F.length(pair["hit"]), span(begin, pair["hit"]), emit & real(pair["hit"])

        def real(hit: Column) -> Column:
            kept = is_address(hit) if d.mail else F.lit(True)
            return kept & luhn_ok(hit) if d.luhn else kept

        def placed(hits: Column) -> Column:
            each = F.transform(hits, lambda h: span(F.position(h, text) - 1, h))
            return F.when(occur_once(text, hits), each).otherwise(
                scan(with_gaps(text, matches(text, d.search), d.search), F.lit(0), RANKED, step)
            )

        hits = matches(text, d.search)
        return F.when(
            has_hint(text, d), let(F.filter(hits, real) if d.mail or d.luhn else hits, placed)
        ).otherwise(empty_ranked())

    return F.concat(*[of(d, first_rank + i) for i, d in enumerate(detectors)])


def resolve_overlaps(ranked: Column) -> Column:
    """Greedy by start, then length, then rank: keep a span if it meets none kept so far.

    Kept spans are disjoint and ascending, so the end of the last one decides. Where none meets the one
    before, all are kept.
    """

    def step(edge: Column, span: Column) -> tuple[Column, Column, Column]:
        keep = span["start"] >= edge
        return F.when(keep, span["end"]).otherwise(edge), span, keep

    def kept(ordered: Column) -> Column:
        apart = F.size(F.filter(
            ordered, lambda span, i: (i > 0) & (span["start"] < F.get(ordered, i - 1)["end"])
        )) == 0
        return F.when(apart, ordered).otherwise(scan(ordered, F.lit(0), RANKED, step))

    return let(F.sort_array(ranked), kept)


def first_per_range(ranked: Column) -> Column:
    """One span per (start, end): the lowest rank wins; partial overlaps stay."""
    def keep(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda span, i: (i == 0)
            | (F.get(ordered, i - 1)["start"] != span["start"])
            | (F.get(ordered, i - 1)["end"] != span["end"]),
        )

    return let(F.sort_array(ranked), keep)


def public_spans(ranked: Column) -> Column:
    """The spans as `array<struct<entity,text,start,end,source>>`."""
    return F.transform(
        ranked,
        lambda s: F.struct(
            s["entity"].alias("entity"),
            s["text"].alias("text"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["source"].alias("source"),
        ),
    )


def ranked_per_doc(spans: DataFrame) -> DataFrame:
    """Span rows (`doc_id, entity, text, start, end, source`) as one array per document, `_extra`.

    They rank before every detector, so at the same place and length they win.
    """
    span = F.struct(
        F.col("start").cast("int").alias("start"), (F.col("start") - F.col("end")).cast("int").alias("shorter"),
        F.lit(0).alias("rank"), "entity", "text", F.col("end").cast("int").alias("end"), "source",
    )
    return spans.groupBy("doc_id").agg(F.collect_list(span).cast(RANKED).alias("_extra"))


def with_extra(docs: DataFrame, spans: DataFrame | None) -> DataFrame:
    """The rows with `_extra`: their document's further spans, from a name table or a model.

    Without `spans` there are none, and nothing is joined.
    """
    if spans is None:
        return docs.withColumn("_extra", empty_ranked())
    joined = docs.join(ranked_per_doc(spans), "doc_id", "left")
    return joined.withColumn("_extra", F.coalesce("_extra", empty_ranked()))
