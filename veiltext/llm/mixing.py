"""Mixing sources to target weights with a low-discrepancy schedule of equal blocks of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veiltext.llm.batches import numbered
from veiltext.llm.prefix import running
from veiltext.session import stored

WORD = r"[^\x20\x09-\x0D]+"
# The golden ratio's fraction as a 32-bit integer: floor(2**32 * 0.618...), odd, so that each
# stretch of 2**32 slots meets each point once.
GOLDEN = 2654435769
POINTS = 1 << 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def golden_point(slot: Column) -> Column:
    """slot * GOLDEN modulo 2**32, in steps that stay within 63 bits."""
    low = slot % POINTS
    high = F.shiftright(low, 16) * GOLDEN % (1 << 16)
    return ((low % (1 << 16)) * GOLDEN + high * (1 << 16)) % POINTS


def source_targets(sources: DataFrame, weights: Sequence[int], share: tuple[int, int],
                   repeats: int) -> DataFrame:
    """`source, source_size` with `source_no` (order by code point, null last) and `target`.

    The targets are `least(repeats * source_size, level * weight)`, where `level` makes them add up
    to the share of all words. Sources above their limit are taken out and the rest shared again
    until none is above; each turn is a sum over the sources, and only the level comes to the
    driver. Sources without words get a target of 0.
    """
    name = F.col("source")
    ranked = running(
        sources.select(F.col("source").isNull().alias("_last"), name, "source_size"),
        ["_last", "source"], [],
    )
    no = F.col("row_before")
    weight = F.get(F.array(*(F.lit(w) for w in weights)), (no % len(weights)).cast("int"))
    table = stored(ranked.select(
        "source", "source_size", no.alias("source_no"), weight.cast("bigint").alias("weight"),
        (F.col("source_size") * repeats).alias("limit"),
    ))
    limit, at = F.col("limit"), F.col("weight")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    wanted = min(share[0] * total, repeats * total * share[1])  # over share[1]
    full, level = F.lit(False), 0.0
    while True:
        held, left, above = table.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, at)), F.lit(0)),
            F.count(F.when(full, 1)),
        ).first()
        if not left:
            break
        level = (wanted - share[1] * held) / (share[1] * left)
        full = limit <= F.lit(level) * at
        if table.filter(full).count() == above:
            break
    target = F.when(full, limit.cast("double")).otherwise(F.lit(level) * at)
    return table.withColumn("target", F.when(limit > 0, target).otherwise(0.0))


def schedule(spark: SparkSession, quota: DataFrame, slots: int) -> DataFrame:
    """The order of blocks: `slot, source_no, block`, one row per block of every source's quota.

    `quota` has `source_no, blocks, low, high`: the number of blocks a source gives, and its
    stretch of the cumulative weights scaled to 2**32. Slot i goes to the source whose stretch holds
    point i of the golden-ratio sequence; its rank among that source's slots is the block. Ranks
    are counted per run of slots first, so a hot source isn't ranked in one task. Low discrepancy
    leaves a source a few slots short or over: slots beyond a quota fall away, and blocks that
    found no slot follow after the last one.
    """
    sources = quota.count()
    bits = 10
    while (1 << bits) < 4 * sources:
        bits += 1
    # Points meet the sources of one of 2**bits stretches: about one source per stretch.
    cell = F.shiftright(F.col("point"), 32 - bits)
    run = max(4096, slots >> 12)
    points = spark.range(slots).select(
        F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"),
        F.floor(F.col("id") / run).alias("run"),
    ).withColumn("cell", cell)
    stretches = quota.filter("low < high").select(
        "source_no", "blocks", "low", "high",
        F.explode(F.sequence(
            F.shiftright("low", 32 - bits), F.shiftright(F.col("high") - 1, 32 - bits)
        )).alias("cell"),
    )
    hit = stored(
        points.join(stretches, "cell").filter("point >= low and point < high")
        .select("slot", "run", "source_no", "blocks")
    )
    per_run = hit.groupBy("source_no", "run").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = per_run.select("source_no", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_no", "run").orderBy("slot")
    ranked = (
        hit.withColumn("_at", F.row_number().over(inside) - 1)
        .join(before, ["source_no", "run"])
        .select("slot", "source_no", (F.col("before") + F.col("_at")).alias("block"), "blocks")
        .filter("block < blocks").select("slot", "source_no", "block")
    )
    given = hit.groupBy("source_no").agg(F.count(F.lit(1)).alias("given"))
    late = (
        quota.join(given, "source_no", "left")
        .withColumn("given", F.coalesce("given", F.lit(0))).filter("given < blocks")
        .select("source_no", F.explode(F.sequence("given", F.col("blocks") - 1)).alias("block"))
    )
    # Late blocks stand after all slots, those of a source in order.
    return ranked.unionByName(late.select(
        (F.lit(slots) + F.col("block") * max(sources, 1) + F.col("source_no")).alias("slot"),
        "source_no", "block",
    ))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2),
        repeats: int = 2, block: int = 1024, seed: str = "mix", key: str = "doc_id",
        text: str = "text", source: str = "source",
        carried: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The mix as two tables: documents, and the segments that make up its blocks.

    Documents: `row` (a number for each input row), `key, size, source, source_size, target, taken`,
    and the columns `carried`, which also order rows that have the same key and size.
    Segments: `slot, source_no, block, row, at, words`: block number `block` of a source stands at
    place `slot` of the mix and takes `words` words of document `row` from word `at` on.

    Each source's documents stand in a shuffled order (by md5 of seed and key, so reruns agree) as
    one stream of words, repeated `repeats` times. The stream is cut into blocks of `block` words up
    to the source's target, rounded to a word; the last may be shorter. The schedule orders the
    blocks of all sources, and a source's next slot takes its next block. So a source gives exactly
    its rounded target, and no document is taken more than `repeats` times.

    A null text has no words and is taken 0 words; null sources are one source, the last; rows with
    the same key are told apart; sources and documents without words stay in the result. An empty
    table gives empty tables. Other columns are ignored.
    """
    rows = docs.select(
        F.col(key).alias("_key"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"), *carried,
    ).withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col("_key").cast("string"))))
    rows = stored(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sources, weights, share, repeats))
    placed = stored(running(
        rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(
            "source_no", "_order", "_key", "size", "source_size", "target", rows["source"],
            *carried,
        ),
        ["source_no", "_order", "_key", "size"], ["size"], [F.col(name) for name in carried],
    ).withColumnRenamed("row_before", "row"))

    spark = docs.sparkSession
    starts = placed.groupBy("source_no").agg(F.min("size_before").alias("_start"))
    goal = F.floor(F.col("target") + 0.5).cast("bigint")
    quotas = targets.select("source_no", goal.alias("goal"))
    wanted = running(quotas, ["source_no"], ["goal"])
    total = quotas.agg(F.sum("goal")).first()[0] or 0
    scale = lambda words: F.floor(words.cast("decimal(38,0)") * POINTS / F.lit(max(total, 1))).cast("bigint")
    quota = stored(wanted.select(
        "source_no", F.ceil(F.col("goal") / block).cast("bigint").alias("blocks"),
        scale(F.col("goal_before")).alias("low"),
        scale(F.col("goal_before") + F.col("goal")).alias("high"),
    ))
    slots = quota.agg(F.sum("blocks")).first()[0] or 0
    order = schedule(spark, quota, slots)

    goals = quotas.withColumnRenamed("goal", "_goal")
    begin = F.col("size_before") - F.col("_start") + F.col("turn") * F.col("source_size")
    stretch = (
        placed.join(starts, "source_no").join(goals, "source_no").filter("size > 0")
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("begin", begin)
        .withColumn("end", F.least(begin + F.col("size"), F.col("_goal")))
        .filter("begin < end")
        .withColumn("block", F.explode(F.sequence(
            F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)
        )))
    )
    low = F.greatest(F.col("begin"), F.col("block") * block)
    high = F.least(F.col("end"), (F.col("block") + 1) * block)
    blocks = stretch.select(
        "source_no", "block", "row", (low - F.col("begin")).alias("at"), (high - low).alias("words")
    )
    segments = stored(order.join(blocks, ["source_no", "block"]).select(
        "slot", "source_no", "block", "row", "at", "words"
    ))
    taken = segments.groupBy("row").agg(F.sum("words").alias("taken"))
    documents = placed.join(taken, "row", "left").select(
        "row", F.col("_key").alias(key), "size", "source", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), *carried,
    )
    return documents, segments


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with all their columns.

    A block may cut through a document; here a document of which any words are taken stays whole,
    once for each time it is begun, and one that no block reaches goes. Each row stays as often
    as it is taken itself, also if its key is null or shared; rows are known by their numbers.
    """
    rows, row = numbered(docs)
    documents, _ = mix(rows, carried=(row,), **settings)
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    taken = documents.filter("taken > 0").select(F.col(row), F.explode(F.sequence(F.lit(1), times)))
    return rows.join(taken, row).select(*(rows[name] for name in docs.columns))
