"""Sinks: cleaned text, reports, masked grids, manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltext.functions.naming import (
    cleansed_name,
    compound_suffix,
    extension,
    is_allowed,
    metadata_name,
    redacted_name,
    route_upload,
    safe_filename,
    stable_id,
)
from veiltext.session import stored


def write_clean_text(artifacts: DataFrame, path: str) -> None:
    """Raw and cleaned text, keyed by document."""
    artifacts.select("doc_id", "file_name", "raw_text", "cleaned_text").write.mode(
        "overwrite"
    ).parquet(path)


def write_report_json(reports: DataFrame, path: str) -> None:
    """One JSON object per document, one per line."""
    reports.write.mode("overwrite").json(path)


def write_report_array(reports: DataFrame, path: str, order: Sequence[str] = ("doc_id",)) -> None:
    """All reports as one JSON array, in the given order, written by many tasks.

    The part files, joined in the order of their names, are the array: a line is a report with the
    bracket or comma before it, the last line has the closing bracket too. Null fields are written.
    Reports are stored once; the first and the last are found with partial minima and maxima. Equal
    reports stay as often as they occur; without any, the one part holds `[]`.
    """
    rows = stored(reports.select(
        F.struct(*order).alias("place"),
        F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"}).alias("report"),
        F.monotonically_increasing_id().alias("copy"),
    ))
    at = F.struct("place", "report", "copy")
    count, first, last = rows.agg(F.count("*"), F.min(at)["copy"], F.max(at)["copy"]).first()
    if not count:
        value = reports.sparkSession.range(1, numPartitions=1).select(F.lit("[]").alias("value"))
    else:
        before = F.when(F.col("copy") == first, "[").otherwise(",")
        after = F.when(F.col("copy") == last, "]").otherwise("")
        value = rows.orderBy("place", "report", "copy").select(F.concat(before, "report", after).alias("value"))
    value.write.mode("overwrite").text(path)


def read_report_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The reports of an array that `write_report_array` wrote, each line by itself."""
    line = F.regexp_replace(F.substring("value", 2, 2**31 - 1), r"\]$", "")
    found = spark.read.text(path).filter("value <> '[]'")
    return found.select(F.from_json(line, schema).alias("r")).select("r.*")


def write_masked_csv(grid: DataFrame, path: str) -> None:
    """A masked grid with its header and no index. Values keep blanks around them; a null cell is
    nothing, an empty one a pair of quotes (which readers, Spark's too, mostly take for a null)."""
    grid.write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def manifest(files: DataFrame) -> DataFrame:
    """One row per accepted file; `files` has `doc_id, file_name, typed_error, error`.

    The typed redactor comes first. If it fails (`typed_error`), which it does for suffixes that it
    doesn't know, the basic chain has its turn, and only its `error` fails the file. A file that
    could not be cleansed is copied as it is, and says so: `status` is `cleansed`, `copied` (no
    handler for the type) or `failed`. Only the basic chain turns a workbook into CSV.
    """
    safe = safe_filename(F.col("file_name"))
    stored = F.concat(stable_id(F.col("doc_id")), F.lit("_"), safe)
    typed, basic = F.col("typed_error").isNull(), F.col("error").isNull()
    status = (
        F.when(route_upload(safe) == "copy", "copied").when(typed | basic, "cleansed").otherwise("failed")
    )
    return files.filter(is_allowed(F.col("file_name"))).select(
        "doc_id",
        safe.alias("original_filename"),
        F.when(status != "cleansed", F.concat(F.lit("cleansed_"), stored))
        .when(typed, redacted_name(stored))
        .otherwise(cleansed_name(safe, F.col("doc_id"))).alias("cleansed_filename"),
        metadata_name(stored).alias("metadata_filename"),
        extension(safe).alias("file_type"),
        F.when(status == "failed", F.col("error")).alias("error"),
        status.alias("status"),
    )


def directory_error(name):
    """The directory flow's error for a name whose suffixes it does not know."""
    return F.when(
        ~compound_suffix(name).isin(
            ".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".pdf", ".xlsx", ".xls", ".pptx", ".txt",
            ".csv",
        ),
        F.concat(F.lit("Unsupported format: "), compound_suffix(name)),
    )
