"""Shards and mixes against plain versions."""

import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest

from veiltext.llm import mixing, sharding
from veiltext.llm.mixing import GOLDEN, golden_point, mix, mixed_documents
from veiltext.llm.sharding import byte_shards, write_shards
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_shards_are_contiguous_and_even(request, name):
    frame = request.getfixturevalue(name)
    rows = frame.select("doc_id", "text").collect()
    found = byte_shards(frame).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in rows) == Counter(
        (r.doc_id, r["size"], r.text_crc32) for r in found
    )
    found.sort(key=lambda r: r.start)
    assert [r.start for r in found] == [0, *accumulate(r["size"] for r in found)][:-1]
    assert [r.shard for r in found] == sorted(r.shard for r in found)
    slots = defaultdict(list)
    sizes = Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(s == list(range(len(s))) for s in slots.values())
    total, largest = sum(sizes.values()), max(r["size"] for r in found)
    assert all(abs(sizes[k] - total / 8) <= largest + total / 8 / 32 for k in range(8))


def test_small_groups_of_copies_stay_together(docs):
    found = byte_shards(docs).collect()
    total = sum(r["size"] for r in found)
    groups = defaultdict(list)
    for r in found:
        groups[r.text_crc32, r["size"]].append(r)
    together = [g for g in groups.values() if sum(r["size"] for r in g) * 8 * 32 <= total]
    assert any(len(g) > 1 for g in together)
    assert all(len({r.shard for r in g}) == 1 for g in together)


def test_a_large_group_is_cut(spark):
    frame = spark.range(800).selectExpr("id as doc_id", "'same text' as text")
    assert Counter(r.shard for r in byte_shards(frame).collect()) == {k: 100 for k in range(8)}


def test_no_rows(none):
    assert byte_shards(none).count() == 0
    documents, segments = mix(none)
    assert documents.count() == 0 and segments.count() == 0
    assert mixed_documents(none).count() == 0


def test_written_shards(spark, docs, tmp_path):
    placed = byte_shards(docs)
    write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {
        (r.doc_id, r.shard, r.slot) for r in placed.collect()
    }


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (goal - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_mix_meets_targets(request, name):
    frame = request.getfixturevalue(name)
    documents, segments = mix(frame, block=64)
    rows, parts = documents.collect(), segments.collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken <= 2 * r["size"]
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    # Blocks are full but for each source's last, and every slot is used once.
    words, where = Counter(), defaultdict(set)
    for p in parts:
        words[p.source_no, p.block] += p.words
        where[p.slot].add((p.source_no, p.block))
    assert all(len(v) == 1 for v in where.values()) and len(where) == len(words)
    last = {}
    for s, b in words:
        last[s] = max(last.get(s, 0), b)
    assert all(n == 64 or b == last[s] for (s, b), n in words.items())
    again = mix(frame, block=64)[0].collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_mix_spreads_sources(docs):
    """Any stretch of slots holds each source in its share, but for a few blocks."""
    _, segments = mix(docs, block=64)
    order = [r.source_no for r in segments.select("slot", "source_no").distinct().orderBy("slot").collect()]
    count, half = Counter(order), Counter(order[: len(order) // 2])
    assert all(abs(half[s] - count[s] / 2) <= 6 for s in count)


def test_golden_points(spark):
    ids = [0, 1, 2, 65535, 65536, 2**32 - 1, 2**32 + 5, 2**40 + 3]
    frame = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert [r[0] for r in frame.select(golden_point(F.col("id"))).collect()] == [i * GOLDEN % 2**32 for i in ids]


def test_mixed_documents_keep_columns(odd):
    found = mixed_documents(odd)
    assert found.columns == odd.columns
    assert {r.doc_id for r in found.collect()} <= {r.doc_id for r in odd.collect()}


def test_mixed_documents_are_by_row(spark):
    """Rows with a null or shared key stay each as often as it is taken itself."""
    key = lambda i: None if i % 3 == 0 else 5 if i % 3 == 1 else i
    rows = [(key(i), " ".join([f"w{i}"] * (10 + i % 7)), "ab"[i % 2], i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int").repartition(4)
    settings = {"weights": (3, 1), "share": (1, 4), "block": 16}
    documents = mix(docs, **settings)[0].collect()
    times = [-(-r.taken // r.size) for r in documents]
    assert 0 in times
    found = mixed_documents(docs, **settings).collect()
    assert all(tuple(r) in rows for r in found)
    sizes = Counter()
    for r in found:
        sizes[r.source] += len(r.text.split())
    goals = {r.source: int(r.target + 0.5) for r in documents}
    # Whole documents: a source goes beyond its words by less than one document an end of its stretch.
    assert all(goals[s] <= sizes[s] < goals[s] + 2 * 16 for s in goals)
    assert len(found) == sum(times)
