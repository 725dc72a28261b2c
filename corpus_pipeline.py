"""From raw documents to packed sequences: five stages, each over all rows that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltext.llm import jaccard, mixing, packing, pii, quality
from veiltext.session import remove, shared_folder, stored_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# No SQL: tokenizers, the anchored parsers and the hashed n-grams have none. The stages are tested
# against plain versions.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, size=5, num=4, den=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; `n_chars` is that of the new text."""
    clean = pii.redacted_documents(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each repeat that it takes any words of.

    The mix cuts its blocks through documents, but packing wants whole ones. So a document of which
    words are taken stays, once or twice, and one that no block reaches goes.
    """
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of at most 2048 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


_scratch: list[str] = []


def _after(stage: Stage) -> Stage:
    """The stage, which first removes the tables that the stage before it stored on its way.

    A stage's result is written before the next one begins, so nothing reads them any more. The last
    stage's tables stay, as its result may not have been read yet.
    """
    @wraps(stage)
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if stage is not quality_rules:
            for path in _scratch:
                remove(spark, path)
        _scratch.clear()
        with stored_paths() as paths:
            found = stage(spark, docs, sf_dir)
        if stage is not best_fit_packing:
            _scratch.extend(paths)
        return found

    return step


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", _after(quality_rules)),
    ("n-gram Jaccard join", _after(near_duplicates)),
    ("PII", _after(personal_data)),
    ("mixing sources to target weights", _after(mixed_sources)),
    ("best-fit packing", _after(best_fit_packing)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again by the next.

    What a stage was given is removed when the next one's has been written; what the last was given
    stays, as its result reads it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
