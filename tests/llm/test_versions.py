"""Fingerprints, periodic runs and fill-in-the-middle against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veiltext.llm import lookup, middle, periodic, queries

FRAMES = ["docs", "odd", "none"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def given_rows(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


# --- fill in the middle -----------------------------------------------------------------------
def plain_middle(key, text, rate=100, spm=50, marks=middle.MARKS):
    text = text or ""
    p, s, m = marks
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = sha(f"7:{'' if key is None else key}")
    h = [int(digits[8 * k:8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(mark in text for mark in marks) or h[2] % 100 >= rate:
        return key, len(units), "plain", None, None, text, text
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form, out = ("spm", s + c + p + a + m + b) if h[3] % 100 < spm else ("psm", p + a + s + c + m + b)
    return key, len(units), form, len(a), len(b), out, text


def made_rows(frame, **settings):
    made = middle.restored(middle.transformed(frame, **settings), **{k: v for k, v in settings.items() if k == "marks"})
    return Counter(map(tuple, made.collect()))


@pytest.mark.parametrize("name", FRAMES)
@pytest.mark.parametrize("asked", [{}, {"rate": 40, "spm": 10}, {"marks": ("<|pre|>", "<|suf|>", "<|mid|>")}])
def test_middle(request, name, asked):
    frame = request.getfixturevalue(name)
    assert made_rows(frame, **asked) == Counter(plain_middle(k, t, **asked) for k, t in given_rows(frame))


def test_middle_marks_in_texts(spark):
    texts = ["<P>\nx\n", "a<S>", "<M", "<P\n>\n<S\nS>", "\n", "\n\n\n", "é\n\U0001f600\n　", "<<P>>", "x\r\ny\r\n"]
    frame = spark.createDataFrame([(7 * i + k, t) for i, t in enumerate(texts) for k in range(7)], "doc_id int, text string")
    assert made_rows(frame) == Counter(plain_middle(k, t) for k, t in given_rows(frame))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\n<PSM>é\U0001f600", max_size=20), max_size=8), st.integers(1, 9), st.randoms())
def test_scatter_and_gather(texts, window, draw):
    """Windows of a few bytes, any cuts: what is scattered gathers to the texts."""
    before, middle.WINDOW = middle.WINDOW, window
    try:
        body, begins = middle.text_bytes(pa.array(texts, pa.string()))
        forms = ["plain" if re.search("<[PSM]>", t) else draw.choice(["psm", "spm"]) for t in texts]
        cuts = np.array([sorted(draw.choices(range(a, b + 1), k=2)) for a, b in zip(begins, begins[1:])], np.int64)
        first, second = cuts.reshape(-1, 2).T
        first, second = (np.where([f == "plain" for f in forms], begins[1:], c) for c in (first, second))
        marks = middle.checked_marks(middle.MARKS)
        out, places = middle.scattered(body, begins, first, second, forms, marks)
        for i, form in enumerate(forms):
            a, b, c, d = (int(x[i]) for x in (begins[:-1], first, second, begins[1:]))
            pre, mid, suf = (body[x:y].tobytes() for x, y in ((a, b), (b, c), (c, d)))
            want = {"plain": pre + mid + suf, "psm": b"<P>" + pre + b"<S>" + suf + b"<M>" + mid,
                    "spm": b"<S>" + suf + b"<P>" + pre + b"<M>" + mid}[form]
            assert out[places[i]:places[i + 1]].tobytes() == want
        back, again = middle.gathered(out, places, forms, marks)
        assert back.tobytes() == body.tobytes() and (again == begins).all()
    finally:
        middle.WINDOW = before


@pytest.mark.parametrize("marks", [("<P>", "<P>x", "<M>"), ("ab", "bc", "<M>"), ("aba", "<S>", "<M>"), ("", "a", "b"), ("<P>", "<S>")])
def test_marks_that_overlap_are_refused(marks):
    with pytest.raises(ValueError):
        middle.checked_marks(marks)


# --- periodic runs ----------------------------------------------------------------------------
def plain_runs(words, least=6, times=4):
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                part = words[i:i + length]
                if all(part[p:] != part[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_kept(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("aab"), max_size=70), st.integers(0, 60), st.integers(1, 12), st.integers(0, 60),
       st.sampled_from([(6, 4), (1, 3), (9, 3), (6, 5), (30, 4)]))
def test_runs(words, at, period, odd, rule):
    for i in range(at + period, len(words)):
        words[i] = words[i - period]
    if odd < len(words):
        words[odd] = "c"
    assert periodic.runs(words, *rule) == plain_runs(words, *rule)
    assert periodic.kept(words, plain_runs(words, *rule)) == plain_kept(words, plain_runs(words, *rule))


def test_runs_with_many_kinds_of_words():
    """More kinds than five can share one 64-bit number: k-grams are numbered by doubling."""
    rng = random.Random(3)
    words = [rng.randrange(20000) for _ in range(30000)]
    words[5000:9000] = words[5000:5400] * 10
    words[20000:20012] = [5] * 12
    assert periodic.runs(words) == [(5000, 4000, 400), (20000, 12, 1)]


@pytest.mark.parametrize("words", [["a"] * 100000, [i % 9973 for i in range(100000)]])
def test_one_run_over_a_long_text(words):
    period = len(set(words))
    assert periodic.runs(words) == [(0, len(words), period)]


def plain_periods(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words) if n < 3000 else periodic.runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (key, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(listed),
            sha(" ".join(plain_kept(words, found))))


@pytest.mark.parametrize("name", FRAMES)
def test_periodic_query(request, spark, monkeypatch, name):
    frame = request.getfixturevalue(name)
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    found = queries.op12_periodic_runs(spark, "")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert found.columns == names
    rows = Counter(map(tuple, found.collect()))
    assert rows == Counter(plain_periods(k, t) for k, t in given_rows(frame))
    assert name != "docs" or sum(r[1] > 0 for r in rows) >= 10


def test_rule_must_repeat():
    with pytest.raises(ValueError):
        periodic.periodic_runs(None, times=2)


# --- fingerprints -----------------------------------------------------------------------------
def plain_paragraphs(text):
    found = []
    for line in text.split("\n"):
        for sentence in re.findall(r"(?:\S*[^\s.!?]\s+|\S*[^\s.!?]$)*(?:\S*[.!?](?:\s+|$))?", line.strip()):
            words = sentence.split()
            found += [" ".join(words[i:i + 8]) for i in range(0, len(words), 8)]
    return found


def plain_likeness(a, b):
    a, b = Counter(plain_paragraphs(a)), Counter(plain_paragraphs(b))
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


@settings(max_examples=200, deadline=None)
@given(st.text("ab .!?\n\t", max_size=80))
def test_paragraphs(text):
    assert lookup.paragraphs(text) == plain_paragraphs(text)
    assert len(lookup.digests(text)) == len(plain_paragraphs(text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400), st.integers(0, 400)), max_size=6), st.sampled_from([1, 8]))
def test_differing(sizes, cells):
    """All differing digests of all pairs, from tables that are far too small at first."""
    rng = random.Random(5)
    pairs = []
    for shared, left, right in sizes:
        keys = np.array(rng.sample(range(1 << 62), shared + left + right), np.uint64)
        pairs.append((np.sort(keys[:shared + left]), np.sort(np.concatenate([keys[:shared], keys[shared + left:]]))))
    found = lookup.differing([a for a, _ in pairs], [b for _, b in pairs], cells)
    for (a, b), (only_a, only_b) in zip(pairs, found):
        assert set(only_a.tolist()) == set(a.tolist()) - set(b.tolist())
        assert set(only_b.tolist()) == set(b.tolist()) - set(a.tolist())


def ordered(frame):
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    return [(r.doc_id, r.text or "") for r in frame.orderBy(*by).select("doc_id", "text").collect()]


def plain_prints(rows):
    found = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 4
        new = text[:len(text) - k] + after[:k]
        found.append((key, len(text), sha(new), round(plain_likeness(text, new), 9), round(plain_likeness(text, after), 9)))
    return Counter(found)


def plain_table(text):
    """The table built digest by digest."""
    keys = lookup.digests(text)
    n = 3 * lookup.CELLS
    count, key, check = [0] * n, [0] * n, [0] * n
    spots = lookup.places(keys, lookup.CELLS).tolist()
    for row in spots:
        for at, k, c in zip(row, keys.tolist(), lookup.checks(keys).tolist()):
            count[at], key[at], check[at] = count[at] + 1, key[at] ^ k, check[at] ^ c
    body = b"".join(k.to_bytes(8, "little") for k in key) + b"".join(c.to_bytes(4, "little") for c in check)
    for c in count:
        while c > 127:
            body += bytes([c % 128 + 128])
            c //= 128
        body += bytes([c])
    return f"{len(keys)}:{base64.b64encode(body).decode()}"


def prints(frame):
    rows = lookup.fingerprints(frame).collect()
    return rows, Counter(
        (r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows
    )


@pytest.mark.parametrize("name", FRAMES)
@pytest.mark.parametrize("parts", [1, 8])
def test_fingerprints(request, name, parts):
    frame = request.getfixturevalue(name).repartition(parts)
    rows, found = prints(frame)
    want = ordered(frame)
    assert found == plain_prints(want)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    texts = {sha(t): t for _, t in want}
    assert {r.fingerprint for r in rows} == {plain_table(t) for t in texts.values()}


@pytest.mark.parametrize("rows", [[(1, "one. two.")], [(None, None)], [(2, "a b"), (1, "c d")]])
def test_few_rows(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert prints(frame)[1] == plain_prints(ordered(frame))


def test_hot_key_is_split(spark):
    """A third of the rows with a null key and one text fill no partition alone."""
    rows = [(None, "same text here")] * 3000 + [(i, f"text {i}. end") for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    assert prints(frame)[1] == plain_prints(ordered(frame))
