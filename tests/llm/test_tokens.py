"""Token pieces, sequences and files against the tokenizers library used plainly."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veiltext.llm import packing, planes
from veiltext.llm.packing import Search, fit, pack, packed_documents, pieces, sequences
from veiltext.llm.planes import chunk_index, from_planes, read_ids, to_planes, write_ids
from veiltext.llm.tokens import Encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def both():
    return {p: (plain(p), Encoder(p, blanks=p == BYTES)) for p in (WORDS, BYTES)}


TEXTS = st.text(st.one_of(
    st.sampled_from(list(" \t\n\r\x0b\x0c\x1c\x85\xa0 　ab'sZé.,1½²ǅß́Σ<|>")), st.characters(codec="utf-8"),
), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_remembered_pieces_change_no_ids(both, text):
    for path in (WORDS, BYTES):
        library, encode = both[path]
        assert np.frombuffer(next(iter(encode([text]))), dtype="<u4").tolist() == library(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(
    st.sampled_from(list(" \t\n\r'sZé.,1½ab<|>")), st.characters(codec="utf-8"),
), max_size=8), max_size=40))
def test_runs_of_pieces_change_no_ids(both, texts):
    """Many unknown pieces at once, which are encoded in runs."""
    for path in (WORDS, BYTES):
        library, known = both[path]
        fresh = Encoder(path, blanks=path == BYTES) if path == BYTES else known
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in fresh(texts)]
        assert got == [library(t) for t in texts]


def test_special_strings_and_corpus(both, docs):
    texts = ["<|endoftext|> x", "a<|startoftext|>", "x <|endoftext|> y", "a<|ENDOFTEXT|>b c", "in<|endoftext|>side", *(r.text for r in docs.limit(60).collect())]
    for path in (WORDS, BYTES):
        library, encode = both[path]
        assert [np.frombuffer(b, dtype="<u4").tolist() for b in encode(texts)] == [library(t) for t in texts]


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_packing(request, name):
    frame = request.getfixturevalue(name)
    ids = plain(WORDS)
    want = []
    for r in frame.select("doc_id", "text").collect():
        found = np.array(ids(r.text) + [0], dtype="<u4")
        for no, at in enumerate(range(0, len(found), 2048)):
            part = found[at:at + 2048]
            want.append((str(r.doc_id), no, at, len(part), zlib.crc32(part.tobytes())))
    rows = packed_documents(frame, WORDS).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences_ = defaultdict(list)
    for r in rows:
        sequences_[r.sequence_id].append((r.offset, r.length))
    for parts in sequences_.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    lengths = np.array([w[3] for w in want])
    assert len(sequences_) <= fit(lengths, 2048).max() + 1
    assert len(sequences_) <= -(-lengths.sum() // 2048) * 1.02 + 1


def test_sequences_hold_their_ids(docs):
    few = docs.limit(50)
    packed = pack(pieces(few, WORDS, keep_ids=True), 2048)
    want = defaultdict(dict)
    for r in packed.collect():
        want[r.sequence_id][r.offset] = bytes(r.ids)
    found = {r.sequence_id: (bytes(r.ids), list(r.lengths)) for r in sequences(packed).collect()}
    for key, parts in want.items():
        assert found[key][0] == b"".join(parts[o] for o in sorted(parts))
        assert [4 * n for n in found[key][1]] == [len(parts[o]) for o in sorted(parts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_search_never_loses(lengths):
    lengths = np.array(lengths)
    first = fit(lengths, 100)
    found = Search(lengths, first.copy(), 100).run()
    fill = np.bincount(found, weights=lengths)
    assert fill.max() <= 100 and np.count_nonzero(fill) <= first.max() + 1
    assert (fill**2).sum() >= (np.bincount(first, weights=lengths) ** 2).sum()


def test_search_tries_every_bin():
    """A giver that can give stands behind more than 64 that can't."""
    lengths = np.array([*[70] * 100, 60, 12, 71, 10])
    bins = np.array([*range(100), 100, 100, 101, 101])
    search = Search(lengths, bins, 100)
    asked = []
    step = search._step
    search._step = lambda giver: asked.append(giver) or step(giver)
    search.run()
    assert set(asked) >= set(np.unique(search.bin).tolist())


def test_equal_rows_are_spread(spark):
    """Copies of one row with a null key are dealt like any others."""
    cut = spark.range(3000, numPartitions=5).selectExpr(
        "cast(null as bigint) as doc_id", "0 as piece", "0L as start", "700L as length", "5L as ids_crc32"
    )
    rows = pack(cut, 2048, group_rows=300).collect()
    groups = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 3000 and len(groups) == 10 and max(groups.values()) < 450


def test_search_frees_a_bin():
    # Three bins of 10: [6, 3], [6, 3], [4, 2]; swaps fill two and a half.
    lengths = np.array([6, 6, 4, 3, 3, 2])
    bins = np.array([0, 1, 2, 0, 1, 2])
    found = Search(lengths, bins.copy(), 12).run()
    assert len(np.unique(found)) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["byte", "bit"]))
def test_planes_round_trip(ids, unit):
    ids = np.array(ids, dtype="<u4")
    assert from_planes(to_planes(ids, unit), len(ids), unit).tolist() == ids.tolist()


@pytest.mark.parametrize("unit", ["byte", "bit"])
@pytest.mark.parametrize("block", [64, 1 << 16])
@pytest.mark.parametrize("name", ["docs", "odd"])
def test_files(spark, request, tmp_path, name, block, unit):
    frame = request.getfixturevalue(name)
    if name == "docs":
        frame = frame.limit(60)
    path = str(tmp_path / "ids")
    write_ids(frame, path, BYTES, block=block, unit=unit)
    ids = plain(BYTES)
    rows = sorted(read_ids(spark, path, keep_ids=True).collect(), key=lambda r: r.start)
    want = sorted(frame.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in rows] == [r.doc_id for r in want]
    at, texts = 0, defaultdict(list)
    for r in want:
        texts[r.doc_id].append(np.array(ids(r.text) + [2], dtype="<u4").tobytes())
    for r in rows:
        body = bytes(r.ids)
        texts[r.doc_id].remove(body)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(body) // 4, zlib.crc32(body))
        at += r.n_tokens
    index = sorted((r.start, r.n_ids) for r in chunk_index(spark.read.parquet(path)).collect())
    assert sum(n for _, n in index) == at
    assert all(a + n == b for (a, n), (b, _) in zip(index, index[1:]))


def test_no_rows(spark, none, tmp_path):
    assert packed_documents(none, WORDS).count() == 0
    write_ids(none, str(tmp_path / "ids"), BYTES)
    assert read_ids(spark, str(tmp_path / "ids")).count() == 0
