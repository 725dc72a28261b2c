"""Masking pages with what was found on them, or anywhere in their document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltext.functions.mask import distinct_items, replace_values, value_spans
from veiltext.functions.spans import RANKED, empty_ranked
from veiltext.operators import bloom
from veiltext.session import stored

# Keys that any occurrence of an entity's text must contain, whatever stands around it: the end of
# an e-mail's local part with the start of its domain, the last eight characters of a number, or two
# characters on either side of the first place inside where a word begins after another character.
# A text without any of these (a word) has its first three characters, or all if there are fewer.
_MAIL_KEY = r"([A-Za-z0-9._%+-]{1,8}@[A-Za-z0-9.-]{2})"
_NUMBER_KEY = r"(.{4}\d{4})"
_WORD_KEY = r"(.\W\w.)"
_FLAGS = "(?sU)"
START = 3
# Bits of a document's filter: at most 8 KiB, and 16 bytes for each key of a document with few.
FILTER_BITS = 65_536


def _entity_key(text: Column) -> Column:
    mail = F.regexp_extract(text, _MAIL_KEY, 1)
    number = F.regexp_extract(text, f"{_FLAGS}{_NUMBER_KEY}$", 1)
    word = F.regexp_extract(text, f"{_FLAGS}{_WORD_KEY}", 1)
    start = F.concat(F.lit("^"), F.substring(text, 1, START))
    return F.when(mail != "", mail).when(number != "", number).when(word != "", word).otherwise(start)


def _start_length(key: Column) -> Column:
    """How many characters of a text its key has if it is the text's start, else 0."""
    return F.when(F.startswith(key, F.lit("^")), F.length(key) - 1).otherwise(0)


def _page_keys(text: Column, starts: Column) -> Column:
    """Every key that an entity on this page could have; starts of the lengths in `starts` alone."""
    def every(pattern: str, possible: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.when(possible, found).otherwise(F.array().cast("array<string>"))

    keys = [
        every(f"(?={_MAIL_KEY})", F.contains(text, F.lit("@"))),
        every(f"{_FLAGS}(?={_NUMBER_KEY})", F.rlike(text, F.lit(r"(?U)\d{4}"))),
        every(f"{_FLAGS}(?={_WORD_KEY})", F.lit(True)),
        *(F.transform(every("(?s)(?=(.{%d}))" % n, F.array_contains(starts, n)), lambda k: F.concat(F.lit("^"), k))
          for n in range(1, START + 1)),
    ]
    return F.array_distinct(F.concat(*keys))


def keyed_entities(entities: DataFrame) -> DataFrame:
    """`doc_id, text, key, start, type`: each text of a document once, where it first occurs."""
    return (
        entities.filter(F.col("text") != "").groupBy("doc_id", "text")
        .agg(F.min(F.struct("start", "entity")).alias("f"))
        .select("doc_id", "text", _entity_key(F.col("text")).alias("key"),
                F.col("f.start").alias("start"), F.col("f.entity").alias("type"))
    )


def document_filters(keyed: DataFrame) -> DataFrame:
    """`doc_id, words, starts`: one row for each document with entities.

    `words` is a Bloom filter of its keys, of a bounded size however many there are; `starts` has the
    lengths of those keys that are the start of a text.
    """
    words = bloom.word_rows(keyed, "key", FILTER_BITS, "doc_id").groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("words")
    )
    starts = keyed.groupBy("doc_id").agg(F.collect_set(_start_length(F.col("key"))).alias("starts"))
    return words.join(starts, "doc_id")


def page_key_rows(pages: DataFrame, filters: DataFrame) -> DataFrame:
    """`doc_id, page_no, key`: the keys on a page that its document's filter lets through.

    A document has one row in `filters`, so pages are not multiplied, and a document with very many
    pages is split by adaptive execution.
    """
    keys = F.filter(
        _page_keys(F.col("text"), F.col("starts")), lambda k: bloom.in_map(k, F.col("words"), FILTER_BITS)
    )
    return pages.join(filters, "doc_id").select("doc_id", "page_no", F.explode_outer(keys).alias("key")).filter(
        F.col("key").isNotNull()
    )


def mask_pages_doc_entities(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """Replace on each page every text found anywhere in the page's document, whatever its type.

    `entities` has `doc_id, entity, text, start`. Handing each page its document's whole list would
    multiply pages by entities. Pages and entities meet on a short key instead: a page's keys are
    tested against a filter of its document's, and only those that pass become rows and are joined,
    so a page gets only texts that may occur on it, in order of first occurrence. The entities are
    stored first, as they are read for the filter and again for the join.
    """
    keyed = stored(keyed_entities(entities))
    found = page_key_rows(pages, document_filters(keyed))
    hits = found.join(keyed, ["doc_id", "key"]).groupBy("doc_id", "page_no").agg(
        F.array_sort(F.collect_set(F.struct("start", "text", "type"))).alias("items")
    )
    items = F.coalesce("items", F.array().cast("array<struct<start:int,text:string,type:string>>"))
    return pages.join(hits, ["doc_id", "page_no"], "left").select(
        "doc_id", "page_no", replace_values(F.col("text"), items).alias("masked")
    )


def mask_pages_own_entities(pages: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Replace on each page what is found on it; `redacted` counts the items.

    `extra` has further spans of the pages, with `page_no` beside `doc_id`.
    """
    items = value_spans(F.col("text"))
    if extra is not None:
        per_page = extra.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct(
            F.col("start").cast("int").alias("start"),
            (F.col("start") - F.col("end")).cast("int").alias("shorter"), F.lit(0).alias("rank"), "entity",
            "text", F.col("end").cast("int").alias("end"), "source",
        )).cast(RANKED).alias("_extra"))
        pages = pages.join(per_page, ["doc_id", "page_no"], "left")
        items = value_spans(F.col("text"), extra=F.coalesce("_extra", empty_ranked()))
    return pages.withColumn("_items", items).select(
        "doc_id", "page_no",
        replace_values(F.col("text"), distinct_items(F.col("_items"))).alias("masked"),
        F.size("_items").alias("redacted"),
    )
