"""Exact top-k by inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veiltext.llm.batches import small_batches
from veiltext.session import stored

INDEX = (
    "block int, n int, ids binary, lowest array<string>, widths binary, slices binary"
)
HITS = "query_id bigint, query_no bigint, vec_id bigint, score bigint, beyond binary"
_HIT = pa.schema([*((name, pa.int64()) for name in ("query_id", "query_no", "vec_id", "score")), ("beyond", pa.binary())])
EXACT = float(1 << 53)  # doubles from here on are whole numbers
LONG = (1 << 63) - 1
WITHIN = b"\x80"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """`vec_id, vector` with each component x as floor(scale * x), x as double.

    The result is a double too, which holds every such whole number exactly, however large. Left out:
    rows without a number or vector, and vectors with null components or ones that aren't finite once
    scaled. Repeated rows stay, an empty table gives no rows, other columns are ignored.
    """
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    able = F.forall(scaled, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))

    def whole(x: Column) -> Column:
        return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)

    return (
        vectors.filter("vec_id is not null and embedding is not null").filter(able)
        .select("vec_id", F.transform(scaled, whole).alias("vector"))
    )


def _whole(values: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: as Python's where 64 bits and a difference don't hold them."""
    if not values.size or np.abs(values).max() < 1 << 61:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], dtype=object).reshape(values.shape)


def _sliced(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of the index: rows by number, each component as bit slices over the rows.

    Components are counted from the block's lowest, so slice j of a component holds bit j of that
    difference for all rows of the block. Shorter vectors are filled up with zeros.
    """
    rows = rows.sort_values("vec_id", kind="stable")
    n, dims = len(rows), max(map(len, rows["vector"]))
    given = np.zeros((n, dims))
    for i, vector in enumerate(rows["vector"]):
        given[i, :len(vector)] = vector
    values = _whole(given)
    lowest = values.min(axis=0) if dims else np.zeros(0, dtype=np.int64)
    values = values - lowest
    widths = np.array([int(v).bit_length() for v in values.max(axis=0)] if dims else [], dtype=np.int64)
    words = -(-n // 64)
    slices = np.zeros((int(widths.sum()), words * 8), dtype=np.uint8)
    at = 0
    for d in range(dims):
        for j in range(widths[d]):
            packed = np.packbits((values[:, d] >> j & 1).astype(np.uint8), bitorder="little")
            slices[at, :len(packed)] = packed
            at += 1
    return pd.DataFrame({
        "block": [int(rows["block"].iloc[0])], "n": [n],
        "ids": [rows["vec_id"].to_numpy(dtype=np.int64).tobytes()], "lowest": [[str(v) for v in lowest]],
        "widths": [widths.tobytes()], "slices": [slices.tobytes()],
    })


def bit_sliced_index(vectors: DataFrame, block_rows: int = 32768) -> DataFrame:
    """Blocks of about `block_rows` vectors, dealt by hash; every vector is in one block.

    Takes `vec_id, vector` as `quantised` gives them; other columns are ignored. An empty table has
    no blocks.
    """
    blocks = max(1, -(-vectors.count() // block_rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(_sliced, INDEX)


class Block:
    def __init__(self, n: int, ids: bytes, lowest: list[str], widths: bytes, slices: bytes) -> None:
        self.n, self.ids = n, np.frombuffer(ids, dtype=np.int64)
        self.lowest, self.widths = [int(v) for v in lowest], np.frombuffer(widths, dtype=np.int64)
        words = -(-n // 64)
        self.slices = np.frombuffer(slices, dtype=np.uint64).reshape(-1, words)
        self.first = np.cumsum(self.widths) - self.widths
        self.every = np.frombuffer(
            np.packbits(np.arange(words * 64) < n, bitorder="little").tobytes(), dtype=np.uint64
        )

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The slices of all rows' inner products with the query, lowest bit first, and a constant
        to add. Each set bit of a query component adds the component's slices, shifted; slices are
        turned over for negative ones. Three slices of one weight become one and a carry until one
        is left of each weight."""
        query = [*query.tolist(), *[0] * (len(self.widths) - len(query))][:len(self.widths)]
        base = sum(q * v for q, v in zip(query, self.lowest))
        plain: dict[int, list[int]] = {}
        turned: dict[int, list[int]] = {}
        for q, width, first in zip(query, self.widths.tolist(), self.first.tolist()):
            if not q or not width:
                continue
            into = plain if q > 0 else turned
            if q < 0:
                base -= -q * ((1 << width) - 1)
            for bit in range(abs(q).bit_length()):
                if abs(q) >> bit & 1:
                    for j in range(width):
                        into.setdefault(bit + j, []).append(first + j)
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        top = max([-1, *plain, *turned])
        level = 0
        while level <= top or carried:
            stack = [self.slices[plain[level]]] if level in plain else []
            if level in turned:
                stack.append(~self.slices[turned[level]])
            rows = np.concatenate([*stack, *carried]) if stack or carried else np.zeros((0, len(self.every)), np.uint64)
            carried = []
            while len(rows) > 1:
                if len(rows) == 2:
                    carried.append((rows[0] & rows[1])[None])
                    rows = (rows[0] ^ rows[1])[None]
                    break
                m = len(rows) // 3
                a, b, c = rows[:m], rows[m:2 * m], rows[2 * m:3 * m]
                ab = a ^ b
                carried.append(a & b | c & ab)
                rows = np.concatenate([ab ^ c, rows[3 * m:]])
            out.append(rows[0] if len(rows) else np.zeros(len(self.every), dtype=np.uint64))
            level += 1
        return out, base

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best rows, ties to the smaller number.

        From the highest slice down, rows that have the bit are kept while they are too many, and
        taken for sure when they are too few. What is left at the end all has the same score: the
        boundary, of which the first rows are taken, as rows stand by number.
        """
        found, base = self.scores(query)
        able = self.every.copy()
        for at in range(*np.searchsorted(self.ids, [own, own + 1])):
            able[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        sure = np.zeros_like(able)
        edge = able
        for one in reversed(found):
            more = sure | edge & one
            count = int(np.bitwise_count(more).sum())
            if count > k:
                edge = edge & one
            elif count < k:
                sure, edge = more, edge & ~one
            else:
                sure, edge = more, np.zeros_like(edge)
                break
        rows = self._positions(sure)
        rows = np.concatenate([rows, self._positions(edge)[:k - len(rows)]])
        # Sums of wide components may leave 64 bits: those are counted in Python's integers.
        kind = np.int64 if len(found) < 62 and abs(base) < 1 << 62 else object
        score = np.full(len(rows), base, dtype=kind)
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        for j, one in enumerate(found):
            score += (one[word] >> bit & np.uint64(1)).astype(np.int64).astype(kind) << j
        return self.ids[rows], score

    @staticmethod
    def _positions(bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def _beyond(score: int) -> bytes:
    """Where a score stands among those that end at the same long: bytes in the scores' order."""
    if -LONG - 1 <= score <= LONG:
        return WITHIN
    size = (abs(score).bit_length() + 7) // 8
    if score > 0:
        return b"\xff" + size.to_bytes(2, "big") + score.to_bytes(size, "big")
    return b"\x00" + (65535 - size).to_bytes(2, "big") + (256 ** size + score).to_bytes(size, "big")


def _columns(scores: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    if scores.dtype != object:
        return scores, [WITHIN] * len(scores)
    held = np.array([min(max(s, -LONG - 1), LONG) for s in scores], dtype=np.int64)
    return held, [_beyond(s) for s in scores]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            n, ids, lowest, widths, slices, queries = (batch.column(c)[row].as_py() for c in range(6))
            block = Block(n, ids, lowest, widths, slices)
            out, beyond = [], []
            for q in queries:
                vec_ids, scores = block.top(_whole(np.array(q["vector"], dtype=float)), q["vec_id"], k)
                m = len(vec_ids)
                scores, ends = _columns(scores)
                out.append((np.full(m, q["vec_id"]), np.full(m, q["query_no"]), vec_ids, scores))
                beyond += ends
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)]
            columns.append(pa.array(beyond, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=_HIT)


def top_k(index: DataFrame, queries: DataFrame, k: int = 20, stripe: int = 128, lanes: int = 16) -> DataFrame:
    """`query_id, rank, vec_id, score`: each query's k best rows of the index but those of its number.

    The query set meets the index in blocks: stripes of `stripe` queries go to every block, and each
    block to `lanes` tasks that share the stripes, so work spreads evenly whatever the vectors are.
    A block gives its own k best for each query, and the best of those are kept. Equal vectors cost
    nothing extra. Repeated query rows count once; fewer than k rows give fewer results, and an empty
    index or query set none. Ranks follow the exact scores; one beyond a long is given as the nearest
    long. Columns of `queries` other than `vec_id, vector` are ignored.
    """
    small_batches(index.sparkSession)
    index = stored(index)
    queries = stored(queries.select("vec_id", "vector").distinct())
    stripes = max(1, -(-queries.count() // stripe))
    lanes = min(lanes, stripes)
    no = F.xxhash64("vec_id", "vector")
    grouped = queries.groupBy(F.pmod(no, F.lit(stripes)).alias("stripe")).agg(
        F.collect_list(F.struct("vec_id", no.alias("query_no"), "vector")).alias("queries")
    )
    blocks = index.agg(F.max("block")).first()[0] or 0
    sent = grouped.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks))).alias("block"),
        (F.col("stripe") % lanes).cast("int").alias("lane"), "queries",
    )
    laid = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    # Each block's copy of the queries is not in the size that Spark guesses, so it would be broadcast.
    met = laid.join(sent.hint("merge"), ["block", "lane"]).select("n", "ids", "lowest", "widths", "slices", "queries")
    hits = met.mapInArrow(partial(_search, k=k), HITS)
    best = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
