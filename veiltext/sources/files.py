"""File sources: inventory, whole-text documents, CSV grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions.naming import file_type
from veiltext.functions.text import unix_newlines


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listed(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The files under a directory, listed by a few tasks a core: by itself, Spark makes a task of each
    folder up to 10,000, and starting one takes longer than listing a folder."""
    held = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(held), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format("binaryFile").options(**options).load(path)
    finally:
        spark.conf.set(_LISTING, held)


def file_inventory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Supported files under a directory: `path, ext, length`.

    The content column is not selected, so no file is opened.
    """
    files = _listed(spark, path, recursiveFileLookup=str(recursive).lower())
    ext = file_type(F.col("path"))
    return files.select("path", ext.alias("ext"), "length").filter(
        F.col("ext").isin(*rules.DIRECTORY_TYPES)
    )


# Two characters that are never assigned; they hold the place of a genuine replacement character.
_KEEP = "\ufdd0\ufdd1"
_REPLACEMENT = "\ufffd"


def decode_lossy(content: Column) -> Column:
    """UTF-8 with undecodable bytes dropped and one kind of line end."""
    held = F.replace(content.cast("string"), F.lit(_REPLACEMENT), F.lit(_KEEP))
    valid = F.replace(F.make_valid_utf8(held), F.lit(_REPLACEMENT), F.lit(""))
    return unix_newlines(F.replace(valid, F.lit(_KEEP), F.lit(_REPLACEMENT)))


def read_text_docs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One row per file: `path, text`, and the directory's partition columns.

    Undecodable bytes are dropped; `strict` makes them an error.
    """
    files = _listed(spark, path)
    raw = F.col("content").cast("string")
    text = unix_newlines(F.validate_utf8(raw)) if strict else decode_lossy(F.col("content"))
    keys = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select("path", *keys, text.alias("text"))


def read_csv_docs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV grid with a header, all columns as strings, values as they stand.

    `multi_line` is for files with line ends inside quotes; each such file is read by one task, so
    files should be of a bounded size. Without it, files are split.
    """
    return spark.read.csv(
        path, header=True, inferSchema=False, multiLine=multi_line, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
