"""Spans from supplied name tables: persons and places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions.detect import is_person_name, matches
from veiltext.functions.mask import mask_by_offset
from veiltext.functions.spans import (
    detect_ranked,
    empty_ranked,
    ranked_per_doc,
    resolve_overlaps,
    scan,
    with_extra,
)
from veiltext.functions.text import let, normalize_text, strip
from veiltext.operators import bloom

WORD = r"[\p{L}\p{N}_]+"
# Bits of the filter of first words for each of them, and at least and at most: 8 KiB and 8 MiB.
BITS_A_WORD, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26
# Up to so many first words, with numbers of words, stand in the plan: looking one up is faster than in the filter.
FEW_WORDS = 1024
# Up to so many first words are looked for in a text before it is cut into words.
FEW_SOUGHT = 32
# Up to so many words that may begin a name have their places summed up one by one.
FEW_FOUND = 8


def name_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(strip(name), r"(?U)\s+", " "))


def name_keys(names: DataFrame) -> DataFrame:
    """`key, first, core, lead, trail, words` of each name with a letter or digit.

    `core` runs from the first word to the last, as it stands in the key; `lead` and `trail` are the
    marks around it.
    """
    key = F.col("key")
    split = F.split(key, WORD, -1)
    keys = names.select(name_key(F.col("name")).alias("key")).filter(F.rlike(key, F.lit(WORD))).distinct()
    return keys.select(
        "key", F.regexp_extract("key", WORD, 0).alias("first"), F.get(split, F.lit(0)).alias("lead"),
        F.element_at(split, -1).alias("trail"), (F.size(split) - 1).alias("words"),
    ).withColumn("core", F.substr(
        "key", F.length("lead") + 1, F.length("key") - F.length("lead") - F.length("trail")
    ))


def first_word_filter(keys: DataFrame) -> tuple[Column, int]:
    """A Bloom filter of the names' first words, and its bits: 16 a word, so it lets about one word in
    seventy through that begins no name, and 8 MiB at most."""
    first = keys.select("first").distinct()
    bits = min(max(LEAST_BITS, 1 << (BITS_A_WORD * first.count() - 1).bit_length()), MOST_BITS)
    return bloom.as_array(first, "first", bits), bits


def few_beginnings(keys: DataFrame) -> list[tuple[str, int]] | None:
    """The names' first words with their numbers of words, if there are few."""
    rows = keys.select("first", "words").distinct().limit(FEW_WORDS + 1).collect()
    return [tuple(row) for row in rows] if len(rows) <= FEW_WORDS else None


def may_begin(text: Column, words: Sequence[str]) -> Column:
    """Whether one of few words, in lower case, may stand in a text: one search, true whenever one does.

    A sigma's lower case depends on what follows, and in the text more follows than in the word, so both
    forms count as one.
    """
    sought = sorted({word.replace("ς", "σ") for word in words})
    pattern = r"(?=[%s])(?<![\p{L}\p{N}_])(?:%s)(?![\p{L}\p{N}_])" % (
        "".join(sorted({word[0] for word in sought})), "|".join(sought)
    )
    return F.rlike(F.replace(F.lower(text), F.lit("ς"), F.lit("σ")), F.lit(pattern))


def words_of(docs: DataFrame, text: str, ahead: int, words: Column | Sequence[str], bits: int = 0) -> DataFrame:
    """One row per word that may begin a name: `doc_id, start, first`, and words and gaps from there on.

    `_words` has this word and up to `ahead` - 1 more, `_gaps` what stands before each of them and
    after the last. `words` is a filter of first words in lower case, or without `bits` those words
    themselves; a word it doesn't let through never becomes a row.
    """
    def begins(low: Column) -> Column:
        if bits:
            return bloom.in_array(low, words, bits)
        return low.isin(*words) if words else F.lit(False)

    hits, gaps, starts = F.col("_hits"), F.col("_all_gaps"), F.col("_starts")
    sizes = F.zip_with(
        hits, gaps, lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"))
    )

    def step(at: Column, size: Column) -> tuple[Column, Column, Column]:
        begin = at + size["gap"]
        return begin + F.coalesce(size["hit"], F.lit(0)), begin, F.lit(True)

    def place(i: Column) -> Column:
        before = F.concat(F.slice(hits, F.lit(1), i), F.slice(gaps, F.lit(1), i + 1))
        return F.length(F.array_join(before, ""))

    few = F.size("_found") <= FEW_FOUND
    found = F.filter(
        F.transform(hits, lambda word, i: let(F.lower(word), lambda low: F.when(
            begins(low), F.struct(i.alias("i"), low.alias("first"))
        ))),
        lambda w: w.isNotNull(),
    )
    cut = matches(F.col(text), WORD)
    if not bits and 0 < len(words) <= FEW_SOUGHT:
        cut = F.when(may_begin(F.col(text), words), cut)
    # A row without such a word gives none, so it needs no filter, which would do the search twice.
    return (
        docs.select("doc_id", text, cut.alias("_hits"))
        .withColumn("_found", found)
        .withColumn("_all_gaps", F.when(F.size("_found") > 0, F.split(F.col(text), WORD, -1)))
        .withColumn("_starts", F.when(~few, scan(sizes, F.lit(0), "array<int>", step)))
        .select("doc_id", F.inline(F.transform("_found", lambda w: F.struct(
            F.when(few, place(w["i"])).otherwise(F.get(starts, w["i"])).alias("start"), w["first"].alias("first"),
            F.slice(hits, w["i"] + 1, F.lit(ahead)).alias("_words"),
            F.slice(gaps, w["i"] + 1, F.lit(ahead + 1)).alias("_gaps"),
        ))))
    )


def dictionary_spans(docs: DataFrame, names: DataFrame, entity: str, source: str,
                     text: str = "text") -> DataFrame:
    """Spans of the table's names, any case: `doc_id, entity, text, start, end, source`.

    A name may have any number of words, with anything between, before and after them; runs of
    white space are the same as one blank. It matches whole words. A name without any letter or
    digit matches nothing.

    Only words that begin a name become rows, for a table of any length: few first words stand in the
    plan; a Bloom filter of more, built by an aggregation, is tested inside the row. Each such word then
    runs as far as the longest name has words (of few, as far as names that begin so have), and runs meet
    the names in an equi-join. Spark broadcasts the names while their size is under
    `spark.sql.autoBroadcastJoinThreshold` and shuffles beyond it. Building the query reads the names, for
    the longest one and for the filter.
    """
    keys = name_keys(names)
    longest = keys.agg(F.max("words")).first()[0] or 1
    few = few_beginnings(keys)
    if few is None:
        words = words_of(docs, text, longest, *first_word_filter(keys))
    else:
        words = words_of(docs, text, longest, sorted({first for first, _ in few}))

    hits, gaps = F.col("_words"), F.col("_gaps")
    inner = F.concat(F.array(F.lit("")), F.slice(gaps, 2, F.greatest(F.size(hits) - 1, F.lit(0))))

    def run(k: Column) -> Column:
        raw = F.array_join(
            F.zip_with(F.slice(inner, F.lit(1), k), F.slice(hits, F.lit(1), k), lambda g, w: F.concat(g, w)), ""
        )
        return F.struct(raw.alias("raw"), F.get(gaps, k).alias("after"))

    lengths = F.sequence(F.lit(1), F.size(hits))
    if few:
        known = [f"{words} {first}" for first, words in few]
        lengths = F.filter(lengths, lambda k: F.concat(k.cast("string"), F.lit(" "), "first").isin(*known))
    runs = words.select(
        "doc_id", "start", F.get(gaps, F.lit(0)).alias("before"), F.inline(F.transform(lengths, run)),
    ).withColumn("core", _plain("raw"))
    before = _marks("before", "lead", r"(?U)((?:\S\s*){%s})$")
    after = _marks("after", "trail", r"(?U)^((?:\s*\S){%s})")
    span = F.concat("_lead", "raw", "_trail")
    start = F.col("start") - F.length("_lead")
    return (
        runs.join(keys, "core").withColumns({"_lead": before, "_trail": after})
        .filter((_plain("_lead") == F.col("lead")) & (_plain("_trail") == F.col("trail")))
        .select(
            "doc_id", F.lit(entity).alias("entity"), span.alias("text"), start.alias("start"),
            (start + F.length(span)).alias("end"), F.lit(source).alias("source"),
        )
    )


def _plain(text: str) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\s+", " "))


def _marks(gap: str, marks: str, pattern: str) -> Column:
    """As many marks of a gap as the name has there, with the white space between them."""
    count = F.length(F.regexp_replace(marks, r"(?U)\s", ""))
    wanted = F.replace(F.lit(pattern), F.lit("%s"), count.cast("string"))
    return F.when(count == 0, "").otherwise(F.call_function("regexp_extract", F.col(gap), wanted, F.lit(1)))


def person_spans(docs: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    return person_filter(dictionary_spans(docs, names, "PERSON", "names", text))


def person_filter(spans: DataFrame) -> DataFrame:
    """Drop PERSON spans that are labels, numbers or known false positives."""
    return spans.filter((F.col("entity") != "PERSON") | is_person_name(F.col("text")))


def location_spans(docs: DataFrame, places: DataFrame, text: str = "text") -> DataFrame:
    return dictionary_spans(docs, places, "LOCATION", "places", text)


def mask_with_names(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Normalise, find persons and patterns, resolve and mask: `doc_id, entities, cleaned_text`."""
    clean = docs.select("doc_id", normalize_text(F.col("text")).alias("text"))
    resolved = resolve_overlaps(F.concat("_extra", detect_ranked(F.col("text"), rules.SPAN_DETECTORS)))
    return (
        with_extra(clean, person_spans(clean, names))
        .withColumn("_spans", resolved)
        .select(
            "doc_id",
            F.size("_spans").alias("entities"),
            mask_by_offset(F.col("text"), F.col("_spans")).alias("cleaned_text"),
        )
    )


def with_person_spans(rows: DataFrame, names: DataFrame | None, text: Column, keys: Sequence[str]) -> DataFrame:
    """The rows (cells, slide units, pages) with `_extra`: the persons of a name table in each one's text.

    `keys` tell the rows apart. Only rows with a name in them are joined to their names; without a
    table there are none, and nothing is joined.
    """
    if names is None:
        return rows.withColumn("_extra", empty_ranked())
    key = F.to_json(F.struct(*keys))
    found = person_spans(rows.select(key.alias("doc_id"), text.alias("text")), names)
    per_row = ranked_per_doc(found).withColumnRenamed("doc_id", "_key")
    joined = rows.withColumn("_key", key).join(per_row, "_key", "left").drop("_key")
    return joined.withColumn("_extra", F.coalesce("_extra", empty_ranked()))
