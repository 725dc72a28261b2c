"""A file format for token ids: fixed-size blocks, cut into byte or bit planes and compressed.

A file is a table of chunks, stored by Spark's Parquet writer so that only committed tasks leave
any. A chunk holds `block` ids (the last one of a part may hold fewer):

- `part, chunk, first, n_ids`: its place in the index. Parts follow each other in key order, and
  `first` counts the ids of the part before the chunk.
- `open_start`: where the document that runs into the chunk began in the part; -1 if none does.
- `planes`: the ids' planes, each compressed with zstandard. As bytes: plane k has byte k of each
  id, two planes if all ids are below 2**16, else four. As bits: plane k has bit k of each id,
  eight ids a byte, as many planes as the largest id has bits.
- `docs`: key, start in the part and number of ids of each document that starts in the chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veiltext.llm.batches import small_batches
from veiltext.llm.tokens import ID, encoder
from veiltext.session import stored

CHUNKS = (
    "part int, chunk int, first bigint, n_ids int, open_start bigint, unit string, "
    "planes array<binary>, docs array<struct<doc_id:bigint,start:bigint,n:bigint>>"
)
_DOC = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
_CHUNK = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()),
    ("open_start", pa.int64()), ("unit", pa.string()), ("planes", pa.list_(pa.binary())),
    ("docs", pa.list_(_DOC)),
])
PORTIONS = "part int, start bigint, at bigint, doc_id bigint, n_tokens bigint, crc bigint, ids binary"
_PORTION = pa.schema([
    ("part", pa.int32()), ("start", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()),
    ("n_tokens", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()),
])


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The planes of ids, from the lowest byte or bit up."""
    top = int(ids.max()) if len(ids) else 0
    if unit == "byte":
        width = 2 if top < 1 << 16 else 4
        table = ids.astype(ID).view(np.uint8).reshape(-1, 4)[:, :width].T
        return [np.ascontiguousarray(row).tobytes() for row in table]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(max(1, top.bit_length()))]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    ids = np.zeros(n, dtype=ID)
    for k, plane in enumerate(planes):
        if unit == "byte":
            ids |= np.frombuffer(plane, dtype=np.uint8).astype(ID) << np.uint32(8 * k)
        else:
            ids |= np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n).astype(ID) << np.uint32(k)
    return ids


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


@lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, block: int, unit: str) -> Iterator[pa.RecordBatch]:
    """One part, in key order: its chunks. Holds one chunk and one document's ids."""
    encode = encoder(path, blanks=True)
    tail = np.array([end], dtype=ID).tobytes()
    size = block * ID.itemsize
    held = bytearray()
    docs: list[tuple] = []
    part, chunk, first, total, open_start = 0, 0, 0, 0, -1

    def out(body: bytes, listed: list[tuple]) -> pa.RecordBatch:
        ids = np.frombuffer(body, dtype=ID)
        planes = [_compressor().compress(p) for p in to_planes(ids, unit)]
        row = {"part": part, "chunk": chunk, "first": first, "n_ids": len(ids), "open_start": open_start,
               "unit": unit, "planes": planes,
               "docs": [{"doc_id": k, "start": s, "n": n} for k, s, n in listed]}
        return pa.RecordBatch.from_pylist([row], schema=_CHUNK)

    for batch in batches:
        keys, parts = batch.column(0), batch.column(2)
        for i, ids in enumerate(encode(value.as_py() for value in batch.column(1))):
            part = parts[i].as_py()
            ids += tail
            n = len(ids) // ID.itemsize
            docs.append((keys[i].as_py(), total, n))
            total += n
            held += ids
            while len(held) >= size:
                stop = first + block
                yield out(bytes(held[:size]), [d for d in docs if d[1] < stop])
                del held[:size]
                docs = [d for d in docs if d[1] >= stop]
                # The newest document is the only one that can reach beyond the chunk.
                open_start = total - n if total - n < stop < total else -1
                chunk, first = chunk + 1, stop
    if held:
        yield out(bytes(held), docs)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = 2, block: int = 1 << 16,
              unit: str = "byte") -> None:
    """Encode `doc_id, text` and write the ids in ascending key order as chunks under `path`.

    Rows are dealt by ranges of the key and sorted within each, which moves the texts once; each
    range is a part. A null or empty text is the end id alone. Null keys come first; rows with the
    same key follow each other. An empty table gives an empty file.
    """
    small_batches(docs.sparkSession)
    by = F.col("doc_id").asc_nulls_first()
    ranged = (
        docs.select("doc_id", "text").repartitionByRange(by).sortWithinPartitions(by)
        .withColumn("part", F.spark_partition_id())
    )
    step = partial(_encode, path=tokenizer, end=end, block=block, unit=unit)
    # The planes are compressed already.
    ranged.mapInArrow(step, CHUNKS).write.option("compression", "uncompressed").parquet(path)


def chunk_index(chunks: DataFrame) -> DataFrame:
    """`part, chunk, start, n_ids, plane_bytes`: where each chunk's ids stand in the whole file."""
    offsets = part_offsets(chunks)
    return chunks.join(F.broadcast(offsets), "part").select(
        "part", "chunk", (F.col("first") + F.col("before")).alias("start"), "n_ids",
        F.transform("planes", F.octet_length).alias("plane_bytes"),
    )


def part_offsets(chunks: DataFrame) -> DataFrame:
    """`part, before`: the ids of all parts before. One row per part, as many as the writer had
    partitions."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("before")
    )


def _decode(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk; what reaches beyond it, or into it, as a portion with its ids."""
    for batch in batches:
        for row in batch.to_pylist():
            n, first = row["n_ids"], row["first"]
            planes = [_decompressor().decompress(p) for p in row["planes"]]
            ids = from_planes(planes, n, row["unit"])
            rows = []
            begins = [d["start"] for d in row["docs"]]
            if row["open_start"] >= 0:
                stop = begins[0] if begins else first + n
                rows.append((row["part"], row["open_start"], first, None, None, None, ids[:stop - first].tobytes()))
            for d in row["docs"]:
                low = d["start"] - first
                body = ids[low:low + d["n"]].tobytes()
                whole = low + d["n"] <= n
                rows.append((row["part"], d["start"], d["start"], d["doc_id"], d["n"],
                             zlib.crc32(body) if whole else None, body if keep or not whole else None))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _PORTION.types)], schema=_PORTION
                )


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """The documents of a file: `doc_id, start, n_tokens, ids_crc32, ids`.

    Each chunk is decoded by itself. Documents within a chunk are whole; only the portions of those
    that cross a chunk's end are shuffled, by part and start, and joined. `ids` is null without
    `keep_ids`.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)
    found = stored(chunks.mapInArrow(partial(_decode, keep=keep_ids), PORTIONS))
    whole = found.filter("crc is not null")
    portions = F.array_sort(F.collect_list(F.struct("at", "ids")))
    crossing = (
        found.filter("crc is null").groupBy("part", "start")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), portions.alias("p"))
        .withColumn("ids", F.aggregate("p", F.lit(b""), lambda whole, one: F.concat(whole, one["ids"])))
        .withColumn("crc", F.crc32("ids")).drop("p").withColumn("at", F.col("start"))
    )
    # One row per part: bounded by the writer's partitions.
    return whole.unionByName(crossing).join(F.broadcast(part_offsets(chunks)), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens",
        F.col("crc").alias("ids_crc32"), F.when(F.lit(keep_ids), F.col("ids")).alias("ids"),
    )
