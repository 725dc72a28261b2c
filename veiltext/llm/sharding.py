"""Contiguous shards of near equal size in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltext.llm.prefix import running
from veiltext.session import stored


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, and one for its end; a null text has none of its own."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _side(start: str, size: str, shards: int, total: int) -> Column:
    """The shard that holds the middle of a stretch of bytes."""
    return F.expr(f"int(least({shards - 1}, {shards} * (2 * {start} + {size}) div (2L * {total})))")


def byte_shards(docs: DataFrame, shards: int = 8, slack: int = 32, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Every row with its shard: `key, size, text_crc32, law, shard, slot, start`.

    Rows stand in one global order: by key, but copies of a text follow its first row. The running
    sum of sizes is cut at equal targets, so shards are contiguous in that order and their sizes
    differ by little more than one row. Where a cut falls inside a group of equal texts that is no
    larger than 1/`slack` of a shard, the group goes whole to the side that holds its middle; a
    larger group is cut, however many rows it has. `slot` counts a shard's rows from 0 in the same
    order, `start` is the size of all rows before.

    Only keys, sizes and hashes are shuffled. A null text counts as an empty one (size 1, crc 0).
    Rows with a null key come first; repeated rows each get a slot. An empty table gives no rows,
    and fewer rows than shards leave shards empty. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sized = stored(docs.select(
        F.col(key).alias("_key"), text_bytes(F.col(text)).alias("size"),
        F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("hash"),
    ))
    same = ["hash", "crc", "size"]
    first = sized.groupBy(*same).agg(F.min("_key").alias("_first"))
    order = ["_first", *same, "_key"]
    placed = stored(running(sized.join(first, same), order, ["size"]))

    total = placed.agg(F.sum("size")).first()[0] or 1
    placed = placed.withColumn("_cut", _side("size_before", "size", shards, total))
    group = ["_first", *same]
    # A cut lies in one group at most, so this has fewer rows than there are shards.
    whole = (
        placed.groupBy(*group)
        .agg(F.min("_cut").alias("_low"), F.max("_cut").alias("_high"),
             F.sum("size").alias("_bytes"), F.min("size_before").alias("_start"))
        .filter("_low < _high").filter(F.col("_bytes") * shards * slack <= total)
        .select(*group, _side("_start", "_bytes", shards, total).alias("_moved"))
    )
    dealt = placed.join(F.broadcast(whole), group, "left").withColumn(
        "shard", F.coalesce("_moved", "_cut")
    )
    starts = dealt.groupBy("shard").agg(F.min("row_before").alias("_row"))  # one row per shard
    return dealt.join(F.broadcast(starts), "shard").select(
        F.col("_key").alias(key), "size", F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", (F.col("row_before") - F.col("_row")).alias("slot"),
        F.col("size_before").alias("start"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """The rows of `docs` as one folder of Parquet files per shard, each file in order of its slots.

    `placed` comes from `byte_shards`; keys must be unique. Rows are dealt by shard and slot range,
    so a shard is written by several tasks and no task sorts a whole one.
    """
    where = placed.select(F.col(key).alias("_key"), "shard", "slot")
    (
        docs.join(where, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
