"""A stream of files in which one that can't be read fails alone.

A stream over rows ends at the first unreadable file, and each restart meets it again. Here the stream
is over the files' names; each batch reads its files, and if that fails, halves them until the files
that fail are told from those that don't. The good ones are cleansed; the others become rows of a
status table with their error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veiltext.streaming.live import masked_stream

Reader = Callable[[Sequence[str]], DataFrame]
FILES_PER_BATCH = 1000
# Conditions that a file's own content or absence causes; any other error ends the batch.
OF_A_FILE = (
    "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "MALFORMED_RECORD_IN_PARSING", "MALFORMED_CSV_RECORD",
    "INVALID_UTF8_STRING", "PATH_NOT_FOUND", "MALFORMED_CHARACTER_CODING",
)
ERROR_LENGTH = 500
STATUS = "path string, status string, error string"


def file_stream(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """`path, length` of the files of a folder as they arrive. No file is opened.

    Spark passes over files without any bytes: they have no rows and are not listed.
    """
    listed = "path string, modificationTime timestamp, length bigint, content binary"
    return (
        spark.readStream.format("binaryFile").schema(listed)
        .option("maxFilesPerTrigger", files_per_batch).load(path).select("path", "length")
    )


def parquet_documents(spark: SparkSession) -> Reader:
    """Reads Parquet files of `doc_id, file_name, text`."""
    reader = spark.read.schema("doc_id bigint, file_name string, text string")
    return lambda paths: reader.parquet(*paths)


# What a failed job raises; which of the two depends on whether PySpark knows the Java class.
FAILURES = (PySparkException, Py4JJavaError)


def about_a_file(error: Exception) -> bool:
    return any(condition in str(error) for condition in OF_A_FILE)


def message_of(error: Exception) -> str:
    """The error's own words, without the stack."""
    java = getattr(error, "java_exception", None)
    return ((java.getMessage() if java is not None else None) or str(error)).strip()[:ERROR_LENGTH]


def unreadable(paths: Sequence[str], read: Reader) -> dict[str, str]:
    """The files that can't be read, each with its error.

    All rows and columns of a group of files are read; a group that fails is halved. That takes about
    as many jobs as twice the logarithm of the number of files, for each file that fails. An error
    that isn't about a file is raised.
    """
    try:
        read(paths).write.format("noop").mode("overwrite").save()
        return {}
    except FAILURES as error:
        if not about_a_file(error):
            raise
        if len(paths) == 1:
            return {paths[0]: message_of(error)}
    half = len(paths) // 2
    return unreadable(paths[:half], read) | unreadable(paths[half:], read)


def cleanse_files(paths: Sequence[str], read: Reader, out_path: str) -> dict[str, str]:
    """Write the masked rows of all readable files; the others with their errors.

    Files are read once while all of them can be. Without a readable file there is an empty table.
    """
    def write(good: Sequence[str]) -> None:
        masked_stream(read(good)).write.mode("overwrite").parquet(out_path)

    try:
        write(paths)
        return {}
    except FAILURES as error:
        if not about_a_file(error):
            raise
    bad = unreadable(paths, read)
    good = [path for path in paths if path not in bad]
    if good:
        write(good)
    else:
        masked_stream(read(paths).limit(0)).write.mode("overwrite").parquet(out_path)
    return bad


def start_file_cleanse(files: DataFrame, read: Reader, out_path: str, checkpoint: str) -> StreamingQuery:
    """Cleanse all files that have arrived, then stop; a later start goes on from there.

    `out_path/rows/batch=n` has the masked rows of batch n and `out_path/status/batch=n` a row for each
    of its files: `path, status, error`, the status `cleansed` or `failed`. The names of one batch's
    files come to the driver, as many as `file_stream` puts into a batch. A batch that is run again
    after a crash has the same files and replaces its own two folders.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # At most `files_per_batch` names.
        paths = sorted(row.path for row in batch.select("path").collect())
        if not paths:
            return
        bad = cleanse_files(paths, read, f"{out_path}/rows/batch={number}")
        rows = [(path, "failed" if path in bad else "cleansed", bad.get(path)) for path in paths]
        spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("overwrite").parquet(
            f"{out_path}/status/batch={number}"
        )

    return (
        files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def outcome_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """Files per status over all batches."""
    return spark.read.parquet(f"{out_path}/status").groupBy("status").agg(F.count(F.lit(1)).alias("files"))
