"""Results against plain restatements of the rules on random input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions import cleanse, mask, spans
from veiltext.functions.detect import bears_item
from veiltext.operators import assemble, dictionary, ocr, ordering, pages

T = F.col("t")


def python_pattern(pattern):
    flags = re.IGNORECASE if pattern.startswith("(?iU)") else 0
    return re.compile(pattern.replace("(?iU)", "").replace("(?U)", ""), flags)


def random_texts(pieces, n, low, high, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(low, high))) for _ in range(n)]


def greedy(text):
    found = []
    for rank, d in enumerate(rules.SPAN_DETECTORS):
        for m in python_pattern(d.pattern).finditer(text):
            found.append((m.start(), m.start() - m.end(), rank, d.entity, m.end()))
    kept = []
    for s in sorted(found):
        if all(s[4] <= k[0] or s[0] >= k[4] for k in kept):
            kept.append(s)
    return kept


PII = ["a@b.com", "x.y@mail.example.org", "555-123-4567", "(743) 555-3824", "+1", "1234", "5678",
       "9012", "123-45-6789", "12", " ", " ", "-", ".", "\n", "é", "😀", "word", "10.0.0.1", "@",
       "4111 1111 1111 1111", "1/2/2024"]


def test_spans_and_mask_match_a_plain_scan(spark):
    texts = random_texts(PII, 3000, 1, 14, 1)
    texts += ["".join(texts[i:i + 300]) for i in range(0, 900, 300)]  # many spans, several blocks
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", spans.resolve_overlaps(spans.detect_ranked(T)).alias("s"),
                    mask.mask_spans(T).alias("m")).collect()
    for row in out:
        kept = greedy(row.t)
        assert [(s.entity, s.start, s.end) for s in row.s] == [(k[3], k[0], k[4]) for k in kept]
        masked, at = "", 0
        for k in kept:
            masked += row.t[at:k[0]] + rules.TAGS[k[3]]
            at = k[4]
        assert row.m == masked + row.t[at:]


def test_value_masking_matches_replacement_in_order(spark):
    df = spark.createDataFrame([(t,) for t in random_texts(PII, 2000, 1, 12, 2)], "t string")
    for row in df.select("t", mask.mask_by_value(T).alias("m"),
                         bears_item(T, rules.VALUE_DETECTORS).alias("b")).collect():
        items = []
        for d in rules.VALUE_DETECTORS:
            for m in python_pattern(d.pattern).finditer(row.t):
                digits = [int(c) for c in re.sub(r"\D", "", m.group())]
                total = sum(sum(divmod(2 * v, 10)) if i % 2 == 0 else v for i, v in enumerate(digits))
                if not d.luhn or total % 10 == 0:
                    items.append((m.group(), d.entity))
        out = row.t
        for value, kind in items:
            out = out.replace(value, f"[{kind}]")
        assert row.m == out
        assert row.b == bool(items)


def test_linear_address_form_equals_the_plain_patterns(spark):
    full = re.compile(
        r"\d{1,5}\s+[A-Za-z0-9\s]+?,?\s*[A-Za-z\s]+?,?\s*[A-Z]{2}\s+\d{5}(-\d{4})?")
    simple = re.compile(r"\d{1,5}\s+[A-Za-z0-9\s]+?\s+[A-Za-z]{2}\s+\d{5}")
    pieces = ["1", "12", "12345", "123456", " ", " ", "  ", "   ", ",", ", ", " ,", "IL", "Il", "a",
              "Bc ", " IL 62704", " IL 62704", "il 62704", "-1234", ".", "٣", "\n", "é", "62704 ", "X",
              "5 a, b, IL 62704"]
    texts = random_texts(pieces, 20000, 3, 18, 5)
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    rows = df.select("t", cleanse.cleanse_address(T).alias("a")).collect()
    changed = 0
    for row in rows:
        wanted = simple.sub("[ADDRESS]", full.sub("[ADDRESS]", row.t))
        assert row.a == wanted
        changed += row.t != wanted
    assert changed > 1000


def test_long_text_without_punctuation_is_quick(spark):
    words = " ".join(f"word {i % 1000}" for i in range(60_000)) + " IL 62704 " + "x 12 " * 60_000
    df = spark.createDataFrame([(words,)], "t string")
    out = df.select(cleanse.cleanse_address(T)).first()[0]
    assert out.startswith("word [ADDRESS]") and out.endswith("x 12 ")


def test_running_index_equals_a_plain_window(spark):
    rnd = random.Random(3)
    rows = [(k, o) for k in range(4) for o in rnd.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k long, o long")
    got = {(r.k, r.o): r.i for r in ordering.with_running_index(df, "k", "o", "i", size=16).collect()}
    for k in range(4):
        for i, o in enumerate(sorted(o for kk, o in rows if kk == k)):
            assert got[k, o] == i


def words_table(spark, seed, n_images=3, n_words=150):
    rnd = random.Random(seed)
    pool = ["10.0.0.1", "a@b.com", "user", "555-123-4567", "4111", "1111", "on", "1/2/2024", "x"]
    rows = []
    for image in range(n_images):
        top = 0
        for no in range(n_words):
            top += rnd.choice([0, 0, 0, 3, 20])
            rows.append((image, no, rnd.choice(pool + ["", "  "]), rnd.choice([10, 60, 90]),
                         rnd.randint(0, 300), top, rnd.randint(5, 60), rnd.choice([8, 16])))
    schema = "image_id long, word_no long, text string, conf int, left int, top int, width int, height int"
    return rows, spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("chunk", [4, 65_536])
def test_ocr_picks_match_a_plain_greedy_pass(spark, chunk):
    rows, df = words_table(spark, 11)
    words = ocr.confident_words(df, chunk)
    grams = ocr.ngrams(words, chunk)
    got_grams = {tuple(r) for r in grams.collect()}
    got = {tuple(r) for r in ocr.pick_ngrams(grams, chunk=chunk).select(*grams.columns).collect()}
    patterns = [(python_pattern(d.pattern), d.luhn) for d in rules.VALUE_DETECTORS]

    def bears(t):
        for p, luhn in patterns:
            for m in p.finditer(t):
                digits = [int(c) for c in re.sub(r"\D", "", m.group())]
                total = sum(sum(divmod(2 * v, 10)) if i % 2 == 0 else v for i, v in enumerate(digits))
                if not luhn or total % 10 == 0:
                    return True
        return False

    want_grams, want = set(), set()
    for image in range(3):
        ws = [(r[2].strip(), r[4], r[5], r[6], r[7]) for r in rows
              if r[0] == image and r[2].strip() and r[3] > 40]
        local = []
        for i in range(len(ws)):
            for n in (1, 2, 3):
                part = ws[i:i + n]
                if len(part) < n or any(
                    abs(a[2] - b[2]) >= a[4] * 0.5 for a, b in zip(part, part[1:])
                ):
                    continue
                x, y = min(p[1] for p in part), min(p[2] for p in part)
                local.append((image, i, n, " ".join(p[0] for p in part), x, y,
                              max(p[1] + p[3] for p in part) - x, max(p[2] + p[4] for p in part) - y))
        want_grams.update(local)
        used = set()
        for g in sorted(local, key=lambda g: -len(g[3])):
            mine = set(range(g[1], g[1] + g[2]))
            if not used & mine and bears(g[3]):
                used |= mine
                want.add(g)
    assert got_grams == want_grams
    assert got == want and len(want) > 10


def test_assembly_in_small_parts(spark):
    rnd = random.Random(9)
    rows = [(d, n, rnd.choice(["a", "", "text", None])) for d in range(5) for n in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, unit_no long, text string")
    empty = F.coalesce("text", F.lit(""))
    for keep in (True, False):
        for part in (1, 7, 4096):
            out = assemble.ordered_join(df, ["doc_id"], "unit_no", empty, "\n", keep_empty=keep, part=part)
            for r in out.collect():
                texts = [t or "" for d, _, t in rows if d == r.doc_id]
                assert r.text == "\n".join(t for t in texts if keep or t)


def test_pages_get_every_entity_of_their_document(spark):
    rnd = random.Random(4)
    pool = ["a@b.com", "xa@b.com", "ab@b.com.au", "longer.name@mail.org", "x.longer.name@mail.org",
            "555-123-4567", "1555-123-4567", "123-45-6789", "123456789", "1234 5678 9012", "w", " ", "."]
    page_rows = [(d, p, " ".join(rnd.choice(pool) for _ in range(6))) for d in range(30) for p in range(4)]
    ents = []
    for d in range(30):
        for i, value in enumerate(rnd.sample(pool[:10], 3)):
            ents.append((d, "EMAIL" if "@" in value else "PHONE", value, i))
            ents.append((d, "SSN", value, i + 50))
    got = pages.mask_pages_doc_entities(
        spark.createDataFrame(page_rows, "doc_id long, page_no long, text string"),
        spark.createDataFrame(ents, "doc_id long, entity string, text string, start int"),
    ).collect()
    assert len(got) == len(page_rows)
    for r in got:
        out = next(t for d, p, t in page_rows if (d, p) == (r.doc_id, r.page_no))
        for d, kind, value, _ in sorted((e for e in ents if e[0] == r.doc_id), key=lambda e: e[3]):
            out = out.replace(value, f"[{kind}]")
        assert r.masked == out


def test_names_of_several_words(spark):
    docs = spark.createDataFrame(
        [(1, "😀 ada  Lovelace met O'Neil, Jean-Luc Picard; Ada.Lovelace and adam")], "doc_id long, text string")
    names = spark.createDataFrame(
        [("Ada Lovelace",), ("o'neil",), ("Jean-Luc Picard",), ("ADA",)], "name string")
    found = {(r.text, r.start) for r in dictionary.person_spans(docs, names).collect()}
    text = docs.first().text
    assert found == {("ada  Lovelace", 2), ("ada", 2), ("O'Neil", text.index("O'N")),
                     ("Jean-Luc Picard", text.index("Jean")), ("Ada", text.index("Ada."))}
