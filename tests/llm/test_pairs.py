"""Jaccard groups, components, top-k and archives against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veiltext.llm import jaccard, topk, warc
from veiltext.llm.components import components
from veiltext.llm.jaccard import Rule, divide_skip, jaccard_groups, one_of_each


# --- Jaccard ----------------------------------------------------------------------------------
def shingles(text, k):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_groups(rows, k, num, den):
    sets = [(d, shingles(t, k)) for d, t in rows]
    lists = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            lists[x].append(i)
    shared = Counter((a, b) for found in lists.values() for i, a in enumerate(found) for b in found[i + 1:])
    linked = [(a, b) for (a, b), o in shared.items() if den * o >= num * (len(sets[a][1]) + len(sets[b][1]) - o)]
    root = roots(range(len(sets)), linked)
    lowest = {}
    for i, r in root.items():
        keys = [v for v in (lowest.get(r), sets[i][0]) if v is not None]
        lowest[r] = min(keys, default=None)
    return Counter((str(d), len(s), str(lowest[root[i]])) for i, (d, s) in enumerate(sets))


def found_groups(frame, k, num, den):
    return Counter((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_groups(frame, k, num, den).collect())


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 4, 5)])
@pytest.mark.parametrize("name", ["docs", "odd"])
def test_groups(request, name, k, num, den):
    frame = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    assert found_groups(frame, k, num, den) == plain_groups(rows, k, num, den)


def test_groups_near_the_limit(spark):
    """Chains, stars and template texts with overlaps around the limit, and many short texts."""
    rng = random.Random(3)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(40 if base % 3 else 4000)}" for _ in range(rng.choice([5, 12, 40, 120]))]
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(6)}"
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                words = copy
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, num, den in ((4, 85, 100), (2, 4, 5), (1, 1, 2)):
        assert found_groups(frame, k, num, den) == plain_groups(rows, k, num, den)


def test_one_of_each(docs, odd, none):
    found = {r.doc_id for r in one_of_each(docs).collect()}
    assert found == {r.component_id for r in jaccard_groups(docs).collect()}
    assert one_of_each(odd).columns == odd.columns
    assert jaccard_groups(none).count() == 0 and one_of_each(none).count() == 0


def test_one_of_each_row(spark):
    """Null, shared and hot keys: of each group one row stays, that with the smallest key."""
    texts = [" ".join(f"g{g}w{i}" for i in range(40)) for g in range(4)]
    near = [t + " end" for t in texts]
    rows = [
        *[(None, texts[0], i) for i in range(3)], (None, near[0], 3),
        *[(7, texts[1], i) for i in range(3)], (7, near[1], 3), (None, texts[1], 4), (9, texts[1], 5),
        *[(7, texts[2], i) for i in range(2)], (3, near[2], 2),
        (None, texts[3], 0), (8, texts[3], 1), (None, None, 0), (None, "", 0),
    ]
    found = one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(5)).collect()
    group = lambda r: r.text[:2] if r.text else r.text
    assert Counter((r.doc_id, group(r)) for r in found) == Counter(
        [(None, "g0"), (7, "g1"), (3, "g2"), (8, "g3"), (None, None), (None, "")]
    )
    assert all((r.doc_id, r.text, r.n) in rows for r in found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=2, max_size=12), st.sampled_from([(85, 100), (1, 2), (4, 5)]),
       st.sampled_from([0.001, 0.01, 1.0]))
def test_divide_skip(sets, limit, mu):
    rule = Rule(*limit)
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    want = [
        (i, len(s & sets[0])) for i, s in enumerate(sets[1:])
        if rule.den * len(s & sets[0]) >= rule.num * len(s | sets[0])
    ]
    assert divide_skip(arrays[0], arrays[1:], rule, mu) == want


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(1, 400), st.sampled_from([(85, 100), (1, 2), (4, 5)]))
def test_rule(a, b, limit):
    rule = Rule(*limit)
    o = rule.need(a, b)
    assert rule.den * o >= rule.num * (a + b - o)
    assert rule.den * (o - 1) < rule.num * (a + b - o + 1)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)]
    pairs += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(-5, 7), (7, 7), (500, 500)]
    frame = spark.createDataFrame(pairs + [(None, 3)], "a bigint, b bigint")
    want = roots({n for p in pairs for n in p if p[0] != p[1]}, [p for p in pairs if p[0] != p[1]])
    rows = components(frame).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert components(frame.filter("false")).count() == 0


# --- top-k ------------------------------------------------------------------------------------
def plain_top(rows, queries, k):
    out = set()
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def quantise(v):
    return [int(np.floor(64 * float(x))) for x in v]


def test_top_k_of_the_table(spark, folder):
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, quantise(r.embedding)) for r in frame.collect()]
    vectors = topk.quantised(frame)
    found = topk.top_k(topk.bit_sliced_index(vectors, block_rows=100), vectors.filter("vec_id % 20 = 0"), 20, stripe=7)
    assert {tuple(r) for r in found.collect()} == plain_top(rows, [r for r in rows if r[0] % 20 == 0], 20)


def test_top_k_edges(spark):
    inf, nan = float("inf"), float("nan")
    rng = random.Random(2)
    rows = [(i, [float(rng.choice([-0.5, 0.0, 0.01, 1.5])) for _ in range(3)]) for i in range(150)]
    rows += [(i, [0.25, 0.25, 0.25]) for i in range(200, 280)]
    bad = [(300, None), (301, [1.0, None, 1.0]), (302, [nan, 0.0, 0.0]), (303, [inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>")
    vectors = topk.quantised(frame)
    whole = [(i, quantise(v)) for i, v in rows]
    for k in (1, 20, 400):
        found = topk.top_k(topk.bit_sliced_index(vectors, 64), vectors.filter("vec_id % 20 = 0"), k)
        assert {tuple(r) for r in found.collect()} == plain_top(whole, [r for r in whole if r[0] % 20 == 0], k)
    assert topk.top_k(topk.bit_sliced_index(vectors.filter("false")), vectors.filter("false")).count() == 0


@pytest.mark.parametrize("sizes, bits", [
    ([1.0, 1e9, -1e9, 3e11, -(2.0**40), 1e17, 3e38, -3e38, 0.3, 1e-30], (63, 300)),
    ([1.0, 1e6, 3e6, -7e5, 2e6, 0.3], (53, 63)),
])
def test_top_k_of_large_components(spark, sizes, bits):
    """Every finite vector takes part; ranks are exact where scores leave 53 and 64 bits."""
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.choice(sizes) * rng.choice([1, 0.7]))) for _ in range(4)]) for i in range(90)]
    rows += [(90, [sizes[1], sizes[2]] * 2), (91, [sizes[2], sizes[1]] * 2), (92, [sizes[-3]] * 4), (93, [sizes[3]] * 4)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vectors = topk.quantised(frame.withColumn("score", F.lit(1)))
    assert vectors.count() == len(rows)
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    for block in (16, 200):
        found = topk.top_k(topk.bit_sliced_index(vectors, block), vectors.filter("vec_id % 10 < 3"), 20)
        want = plain_top(whole, [r for r in whole if r[0] % 10 < 3], 20)
        held = {(q, n, i, min(max(s, -2**63), 2**63 - 1)) for q, n, i, s in want}
        assert {tuple(r) for r in found.collect()} == held
    assert any(2**bits[0] < abs(s) < 2**bits[1] for _, _, _, s in want)


def test_order_of_scores_beyond_a_long():
    scores = sorted([0, 2**63 - 1, 2**63, 2**63 + 1, 2**80, 2**200, -2**63, -2**63 - 1, -2**64, -2**64 - 1, -2**80, -2**200])
    held = [(min(max(s, -2**63), 2**63 - 1), topk._beyond(s)) for s in scores]
    assert held == sorted(held) and len(set(held)) == len(held)


# --- archives ---------------------------------------------------------------------------------
def test_archives(spark, tmp_path):
    long = "x" * 120
    rows = [
        (3, "http://a/3", long), (1, "http://a/1", long), (2, "http://a/2\r\nX: y", long), (4, None, "short"),
        (5, "http://a/5", "short"), (6, "http://a/6", None), (7, "http://a/7", ""), (None, None, "y" * 100),
        (8, "http://a/8", "é\r\n\r\nWARC/1.1\r\n" * 20), (9, "http://a/9", "é\r\n\r\nWARC/1.1\r\n" * 20), (10, "u", "y" * 100),
        (11, "u", "z" * 101), (11, "u", "z" * 101),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages.selectExpr("*", "1 as payload_bytes", "2 as again"), path, records_per_file=2)
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    want = Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        again = len(body) >= 100 and page != first[html or ""]
        want[page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None] += 1
    found = warc.read_archives(spark, path)
    assert Counter(tuple(r) for r in warc.resolved_pages(found).collect()) == want
    payload = {r.page_id: r.payload for r in found.collect() if r.record_type == "response"}
    assert all(payload[p] == (h or "") for p, _, h in rows if p in payload)
    target = {r.page_id: r.url for r in found.collect()}
    assert target[2] == "http://a/2%0D%0AX: y" and target[4] is None


def test_archives_of_the_table(spark, folder, tmp_path):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    html = {r.page_id: r.html for r in pages.collect()}
    assert {r.page_id: r.payload for r in warc.read_archives(spark, path).collect()} == html
    warc.write_archives(pages.filter("false"), str(tmp_path / "none"))
    assert warc.resolved_pages(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0


def test_queries_are_not_broadcast_to_the_blocks(spark, folder):
    """Their files are small, but a stripe goes to every block, and the driver would hold all of that."""
    vectors = topk.quantised(spark.read.parquet(f"{folder}/embeddings.parquet"))
    found = topk.top_k(topk.bit_sliced_index(vectors, block_rows=100), vectors.filter("vec_id % 20 = 0"), 20, stripe=7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
