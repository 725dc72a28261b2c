"""Packing tokenised documents into as few sequences of fixed length as can be."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltext.llm.batches import numbered, small_batches
from veiltext.llm.tokens import ID, encoder
from veiltext.session import stored

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("ids", pa.binary()),
])


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, keep: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, blanks=False)
    tail = np.array([end], dtype=ID).tobytes()
    step = capacity * ID.itemsize
    for batch in batches:
        keys = batch.column(0)
        texts = (value.as_py() for value in batch.column(1))
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)]
            return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

        for i, ids in enumerate(encode(texts)):
            ids += tail
            key = keys[i].as_py()
            for no, at in enumerate(range(0, len(ids), step)):
                part = ids[at:at + step]
                rows.append((key, no, at // 4, len(part) // 4, zlib.crc32(part), part if keep else None))
            if len(rows) >= 4096:
                yield out()
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0,
           keep_ids: bool = False) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32, ids` of `doc_id, text`: each document's ids and an
    end id, cut into pieces of `capacity` only if they are more.

    A null or empty text is the end id alone. Rows with the same or no key are cut each for itself.
    `ids` holds the piece's ids if `keep_ids`, else null. `tokenizer` is the file's path.
    """
    small_batches(docs.sparkSession)
    step = partial(_cut, path=tokenizer, capacity=capacity, end=end, keep=keep_ids)
    return docs.select("doc_id", "text").mapInArrow(step, PIECES)


def fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each length: best fit in decreasing order. Free room is looked up in a bit set."""
    bins = np.empty(len(lengths), dtype=np.int64)
    by_room: dict[int, list[int]] = {}
    rooms, made = 0, 0  # bit r of rooms: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        able = rooms >> size
        if able:
            room = size + (able & -able).bit_length() - 1
            to = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, to = capacity, made
            made += 1
        bins[i] = to
        if left := room - size:
            by_room.setdefault(left, []).append(to)
            rooms |= 1 << left
    return bins


class Search:
    """Local search on a packing: exchanges that make the sum of squared fills larger.

    The emptiest bin gives. Each step puts one or two of its documents into another bin that is at
    least as full, in return for none (a move), one or two smaller ones, so that the other bin gets
    fuller by as much as possible and the giver emptier. Squared fills grow with each step, so the
    search ends. A bin that has given all it had is gone. Each bin is a giver once, from the emptiest
    on, and gives for as long as it can; the search is over before that only when as many bins are
    gone as the free room could spare.
    """

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int) -> None:
        self.size, self.bin, self.capacity = lengths, bins, capacity
        self.fill = np.bincount(bins, weights=lengths).astype(np.int64)
        # Only documents of bins with room take part; full bins are final.
        self.open = np.flatnonzero(self.fill[bins] < capacity)

    def _pairs(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of documents that are next to each other in their bin, by size."""
        order = items[np.lexsort((self.size[items], self.bin[items]))]
        near = self.bin[order[1:]] == self.bin[order[:-1]]
        return order[:-1][near], order[1:][near]

    def _step(self, giver: int) -> bool:
        mine = self.open[self.bin[self.open] == giver]
        others = self.open[self.bin[self.open] != giver]
        if not len(mine) or not len(others):
            return False
        first, second = self._pairs(others)
        gives = [(int(self.size[i]), (i,)) for i in mine]
        gives += [(int(self.size[i] + self.size[j]), (i, j)) for i, j in zip(*self._pairs(mine))]
        own = self.fill[giver]
        targets = np.unique(self.bin[others])
        room = self.capacity - self.fill
        best: tuple[int, tuple, tuple, int] | None = None
        # What comes back: nothing, one document, or two; its size and its bin.
        backs = (
            (0, np.zeros(len(targets), dtype=np.int64), targets, lambda k: ()),
            (1, self.size[others], self.bin[others], lambda k: (others[k],)),
            (2, self.size[first] + self.size[second], self.bin[first], lambda k: (first[k], second[k])),
        )
        for give, docs in gives:
            for count, back, where, named in backs:
                if len(docs) + count > 3:
                    continue
                gain = give - back
                able = (gain > 0) & (gain <= room[where]) & (self.fill[where] + gain > own)
                if able.any():
                    k = int(np.argmax(np.where(able, gain, 0)))
                    if best is None or gain[k] > best[0]:
                        best = (int(gain[k]), docs, named(k), int(where[k]))
        if best is None:
            return False
        gain, docs, back, to = best
        for i in docs:
            self.bin[i] = to
        for i in back:
            self.bin[i] = giver
        self.fill[to] += gain
        self.fill[giver] -= gain
        return True

    def run(self) -> np.ndarray:
        least = -(-int(self.size.sum()) // self.capacity)
        tried: set[int] = set()
        while np.count_nonzero(self.fill) > least:
            able = [b for b in np.unique(self.bin[self.open]).tolist() if b not in tried]
            if not able:
                break
            giver = min(able, key=lambda b: self.fill[b])
            while self.fill[giver] and self._step(giver):
                pass
            tried.add(giver)
        return self.bin


def _pack(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
    lengths = rows["length"].to_numpy()
    bins = Search(lengths, fit(lengths, capacity), capacity).run()
    order = np.lexsort((np.arange(len(bins)), bins))
    size, sorted_bins = lengths[order], bins[order]
    before = np.cumsum(size) - size
    first = np.r_[True, sorted_bins[1:] != sorted_bins[:-1]]
    offset = np.empty(len(bins), dtype=np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    group = int(rows["_group"].iloc[0])
    return rows.drop(columns="_group").assign(sequence_id=(group << 32) + bins, offset=offset)


def pack(cut: DataFrame, capacity: int = 2048, group_rows: int = 16384) -> DataFrame:
    """The pieces with `sequence_id` and `offset`: sequences of at most `capacity` ids, gapless.

    Pieces are dealt by a hash of their row's number into groups of about `group_rows`, as many groups
    as the table needs, so each group sees the same mix of lengths, equal rows are spread like others,
    and a group is packed by one task in bounded memory: best fit first, then the swap-based search.
    What a group can't fill is at most a few sequences among thousands. Numbers of sequences are
    unique; an empty table gives no rows. Every row is packed, repeated ones too. `cut` should be
    stored, as it is read twice; a row's number is its place in the stored files.
    """
    groups = max(1, -(-cut.count() // group_rows))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    rows, number = numbered(cut)
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(number), F.lit(groups))).drop(number)

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        return _pack(rows, capacity)

    return dealt.groupBy("_group").applyInPandas(packed, f"{fields}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32, sequence_id, offset` of all documents."""
    return pack(stored(pieces(docs, tokenizer, capacity, end).drop("ids")), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """`sequence_id, ids, lengths` from packed pieces that kept their ids: the ids of a sequence
    as little-endian unsigned 32-bit integers, and its pieces' lengths in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"),
        F.transform("p", lambda x: x["length"]).alias("lengths"),
    )
