"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltext.llm import (
    jaccard, lookup, middle, mixing, packing, periodic, pii, planes, quality, sharding, topk, toxicity, warc,
)
from veiltext.llm.oracle import ORACLE
from veiltext.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, folder, "documents"), shards=8)
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", (toxicity.fold(F.col("doc_id")) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "offending",
    )


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed_documents(table(spark, folder, "documents"), path, capacity=2048, end=0)


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, folder, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    planes.write_ids(table(spark, folder, "documents"), path, tokenizer, end=2)
    return planes.read_ids(spark, path).drop("ids")


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.resolved_pages(warc.read_archives(spark, path, payloads=False))


def op8_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.stored(topk.quantised(table(spark, folder, "embeddings")))
    return topk.top_k(topk.bit_sliced_index(vectors), vectors.filter("vec_id % 20 = 0"), k=20)


def op9_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return jaccard.jaccard_groups(docs, size=4, num=85, den=100).drop("class")


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op11_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.fingerprints(table(spark, folder, "documents"))


def with_periods(docs: DataFrame) -> DataFrame:
    """`doc_id, text`, in which about a tenth of the documents repeat some of their words to the end.

    Which ones, from which word on and with which period follows from the key's CRC; a null key
    changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), chosen.alias("words"))
    n, g = F.size("words"), F.col("g")
    cut = split.select("doc_id", "text", "g", "words", F.when(n > 0, (g % n).cast("int")).alias("a"))
    period = (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")
    cut = cut.select("doc_id", "text", "words", "a", period.alias("p"))
    repeated = F.concat(
        F.slice("words", F.lit(1), F.col("a")),
        F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))),
    )
    text = F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(with_periods(table(spark, folder, "documents")))
    longest = F.reduce(
        "runs", F.get("runs", F.lit(0)),
        lambda best, run: F.when(run["length"] > best["length"], run).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = middle.transformed(table(spark, folder, "documents"), seed=7, rate=100, spm=50)
    return middle.restored(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


_QUERIES: tuple[Query, ...] = (
    op1_sharding, op2_toxicity, op3_packing, op4_mixing, op5_quality, op6_token_planes, op7_warc,
    op8_top_k, op9_jaccard, op10_pii, op11_fingerprints, op12_periodic_runs, op13_fill_middle,
)


def queries() -> dict[str, Query]:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
