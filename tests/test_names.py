"""Names of any shape in texts and on pages, against plain searches."""

import random
import re

from pyspark.sql import functions as F

from veiltext.operators import bloom, dictionary, pages as page_rows
from veiltext.operators.dictionary import dictionary_spans
from veiltext.operators.pages import mask_pages_doc_entities

NAMES = [
    "Ada", "Ada Lovelace", "Maria del Carmen Lopez", "Maria  del Carmen Lopez y Vega", "J. R. Smith",
    "'Abd al-Rahman", "Jean-Luc O'Neil, Jr.", "X Æ A-12", " Zoë ", "(Bob)", "***", "",
]
TEXTS = [
    "Ada met ada LOVELACE; Adam and xAda did not.", "Maria del\t\nCarmen  Lopez y Vega",
    "J. R. Smith, j.  r. smith; J.R. Smith", "'Abd al-Rahman and Abd al-Rahman", "Jean-Luc O'Neil, Jr. x",
    "X Æ A-12 zoë Zoës (bob) bob", "", None, "maria del carmen lopez",
]


def plain(text, name):
    body = r"\s+".join(re.escape(w) for w in name.lower().split())
    if not re.search(r"\w", name):
        return []
    word = re.sub(r"^\W+|\W+$", "", name.strip())
    first, last = name.strip().startswith(word[0]), name.strip().endswith(word[-1])
    pattern = r"(?<!\w)" * first + body + r"(?!\w)" * last
    low = (text or "").lower()
    return [(m.start(), m.end()) for m in re.finditer(pattern, low)] if len(low) == len(text or "") else []


def found(spark, texts, names):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    return {(r.doc_id, r.start, r.end, r.text) for r in dictionary_spans(docs, table, "PERSON", "names").collect()}


def want(texts, names):
    return {(i, s, e, t[s:e]) for i, t in enumerate(texts) for n in names for s, e in plain(t, n)}


def test_names_of_any_shape(spark):
    assert found(spark, TEXTS, NAMES) == want(TEXTS, NAMES)


def test_a_filter_that_lets_everything_through(spark, monkeypatch):
    """The names found don't depend on the filter's size."""
    monkeypatch.setattr(dictionary, "MOST_BITS", 64)
    monkeypatch.setattr(dictionary, "LEAST_BITS", 64)
    assert found(spark, TEXTS, NAMES) == want(TEXTS, NAMES)


def test_a_million_names_make_few_rows(spark):
    """Of all words, those that begin no name hardly become rows."""
    names = spark.range(1_000_000).select(F.concat(F.lit("name"), F.col("id"), F.lit(" Smith")).alias("name"))
    keys = dictionary.name_keys(names)
    words, bits = dictionary.first_word_filter(keys)
    docs = spark.range(200).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(
            F.when(i == 50, "name").otherwise("word"), (F.col("id") * 100 + i).cast("string")
        )), F.lit("Smith name7 smith")).alias("text"),
    )
    rows = dictionary.words_of(docs, "text", 2, words, bits)
    assert 400 <= rows.count() < 0.05 * 200 * 103
    spans = dictionary_spans(docs, names, "PERSON", "names")
    assert spans.count() == 200


def test_filter_holds_every_key(spark):
    """Maps and arrays of words let all their keys through, and few others."""
    keys = spark.range(3000).select((F.col("id") % 3).alias("doc"), F.concat(F.lit("k"), F.col("id")).alias("key"))
    whole = bloom.as_array(keys, "key", 1 << 16)
    others = spark.range(3000).select(F.concat(F.lit("other"), F.col("id")).alias("key"))
    assert keys.filter(bloom.in_array(F.col("key"), whole, 1 << 16)).count() == 3000
    assert others.filter(bloom.in_array(F.col("key"), whole, 1 << 16)).count() < 100
    maps = bloom.word_rows(keys, "key", 1 << 16, "doc").groupBy("doc").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("words"))
    met = keys.join(maps, "doc")
    assert met.filter(bloom.in_map(F.col("key"), F.col("words"), 1 << 16)).count() == 3000
    crossed = met.filter(bloom.in_map(F.concat(F.col("key"), F.lit("x")), F.col("words"), 1 << 16))
    assert crossed.count() < 60


def test_random_names(spark):
    rng = random.Random(4)
    bits = ["a", "b", "ab", " ", "  ", ".", "'", "-", ", "]
    names = {"".join(rng.choice(bits) for _ in range(rng.randint(1, 7))).strip() for _ in range(60)}
    texts = ["".join(rng.choice(bits) for _ in range(60)) for _ in range(40)]
    some = {n for n in names if re.search(r"\w", n)}

    def every(text, name):
        """All places, overlapping ones too."""
        low, at, out = text.lower(), 0, []
        body = r"\s+".join(re.escape(w) for w in name.split())
        pattern = re.compile(r"(?<!\w)" * (name[0].isalnum()) + body + r"(?!\w)" * (name[-1].isalnum()))
        while m := pattern.search(low, at):
            out.append((m.start(), m.end()))
            at = m.start() + 1
        return out

    expected = {(i, s, e, t[s:e]) for i, t in enumerate(texts) for n in some for s, e in every(t, n)}
    assert found(spark, texts, some) == expected


def test_pages_mask_every_kind_of_entity(spark):
    pages = spark.createDataFrame(
        [(1, 1, "Ada Lovelace and 10.0.0.1"), (1, 2, "AdaAda a@b.example.org"), (2, 1, "Ada Lovelace"),
         (1, 3, "call 555-123-4567, Zoë; x.y"), (1, 4, "")], "doc_id bigint, page_no bigint, text string")
    entities = spark.createDataFrame(
        [(1, "PERSON", "Ada Lovelace", 0), (1, "PERSON", "Ada", 90), (1, "IP_ADDRESS", "10.0.0.1", 20),
         (1, "EMAIL", "a@b.example.org", 30), (1, "PHONE", "555-123-4567", 50), (1, "PERSON", "Zoë", 60),
         (1, "CODE", ".", 99)],
        "doc_id bigint, entity string, text string, start int")
    rows = {(r.doc_id, r.page_no): r.masked for r in mask_pages_doc_entities(pages, entities).collect()}
    assert rows == {
        (1, 1): "[PERSON] and [IP_ADDRESS]", (1, 2): "[PERSON][PERSON] [EMAIL]", (2, 1): "Ada Lovelace",
        (1, 3): "call [PHONE], [PERSON]; x[CODE]y", (1, 4): "",
    }


def test_random_page_entities(spark):
    """Any text that occurs on a page is masked, whatever it looks like."""
    rng = random.Random(9)
    bits = ["a", "Bc", "1234", "@", ".", " ", "d", "é", "-"]
    text = lambda n: "".join(rng.choice(bits) for _ in range(n))
    pages = [(d, p, text(30)) for d in range(6) for p in range(4)]
    entities = [(d, "E", text(rng.randint(1, 6)), s) for d in range(6) for s in range(12)]
    frame = spark.createDataFrame(pages, "doc_id bigint, page_no bigint, text string")
    given = spark.createDataFrame(entities, "doc_id bigint, entity string, text string, start int")
    rows = {(r.doc_id, r.page_no): r.masked for r in mask_pages_doc_entities(frame, given).collect()}
    for d, p, t in pages:
        first = {}
        for d2, _, e, s in entities:
            if d2 == d:
                first.setdefault(e, s)
        for e in sorted(first, key=lambda e: (first[e], e)):
            t = t.replace(e, "[E]")
        assert rows[d, p] == t


def test_key_rows_are_few(spark, folder):
    """Rows of keys are at most twice the entities that do occur on pages."""
    from veiltext.operators import counts
    from veiltext.plans.tables import Tables

    t = Tables(spark, folder)
    entities = counts.span_table(t.corpus(), resolved=True).select("doc_id", "entity", "text", "start")
    keyed = page_rows.keyed_entities(entities)
    rows = page_rows.page_key_rows(t.note_pages(), page_rows.document_filters(keyed)).count()
    hits = t.note_pages().alias("p").join(keyed.alias("e"), "doc_id").filter(
        F.contains(F.col("p.text"), F.col("e.text"))).count()
    assert 0 < hits and rows <= 2 * hits


def test_names_reach_documents_and_items(spark):
    from veiltext.operators.counts import item_table
    from veiltext.operators.documents import artifacts

    docs = spark.createDataFrame([(1, "a.txt", "Ada wrote to ada@x.org"), (2, "b.txt", None)],
                                 "doc_id bigint, file_name string, text string")
    names = spark.createDataFrame([("Ada",)], "name string")
    spans = dictionary.person_spans(docs, names)
    rows = {r.doc_id: r.cleaned_text for r in artifacts(docs, spans).collect()}
    assert rows[1] == "[REDACTED_NAME] wrote to [REDACTED_EMAIL]"
    assert rows[2] is None
    items = {(r.type, r.start) for r in item_table(docs, extra=spans).collect()}
    assert items == {("PERSON", 0), ("PERSON", 13), ("EMAIL_ADDRESS", 13)}
    assert docs.select(F.col("text")).count() == 2
