"""Joining documents with the answers of an offline model run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltext import rules


def join_responses(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """The answer envelope per document.

    `docs` has `doc_id, text, file_type`; `responses` at most one row per document. An empty answer
    is a success without analysis; a document without a row is a failure.
    """
    answers = responses.select("doc_id", "response", F.lit(True).alias("_answered"))
    answered = F.col("_answered").isNotNull()
    return docs.join(answers, "doc_id", "left").select(
        "doc_id",
        answered.alias("success"),
        F.when(answered, F.when(F.coalesce("response", F.lit("")) == "", rules.NO_ANALYSIS)
               .otherwise(F.col("response"))).alias("analysis"),
        F.when(~answered, "No response").alias("error"),
        "file_type",
        F.coalesce(F.length("text"), F.lit(0)).alias("content_length"),
    )


def join_security_responses(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """The security answer's envelope: `doc_id, success, security_analysis, error`.

    As above, but without type and length, and with a message of its own for an empty answer.
    """
    answers = responses.select("doc_id", "response", F.lit(True).alias("_answered"))
    answered = F.col("_answered").isNotNull()
    empty = F.coalesce("response", F.lit("")) == ""
    return docs.join(answers, "doc_id", "left").select(
        "doc_id", answered.alias("success"),
        F.when(answered, F.when(empty, rules.NO_SECURITY_ANALYSIS).otherwise(F.col("response")))
        .alias("security_analysis"),
        F.when(~answered, "No response").alias("error"),
    )
