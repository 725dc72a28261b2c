"""The same column functions on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veiltext.functions.mask import mask_text
from veiltext.operators.counts import item_table
from veiltext.session import names_in, put_mark, remove


def masked_stream(docs: DataFrame) -> DataFrame:
    """Masked rows for each new row; stateless. A row without text has a status, and stops nothing."""
    text = F.col("text")
    return docs.select(
        "doc_id", "file_name", mask_text(text).alias("cleaned_text"),
        F.when(text.isNull(), "failed").otherwise("cleansed").alias("status"),
    )


def document_stream(spark: SparkSession, path: str, files_per_batch: int | None = None,
                    bytes_per_batch: str | None = None) -> DataFrame:
    """Parquet files of `doc_id, file_name, text` as they arrive, so many or so much a batch."""
    reader = spark.readStream.schema("doc_id bigint, file_name string, text string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


def dealt_out(docs: DataFrame, tasks: int | None) -> DataFrame:
    """Each batch's rows over so many tasks. Files are shared out by their bytes, small ones together, so
    a few tasks may get most of the rows; detection goes by rows and texts. Without `tasks`, as they come."""
    return docs.repartition(tasks) if tasks else docs


def start_cleanse(docs: DataFrame, out_path: str, checkpoint: str, tasks: int | None = None) -> StreamingQuery:
    """Cleanse everything that has arrived, then stop; a later start goes on from there."""
    return (
        masked_stream(dealt_out(docs, tasks)).writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_counts(docs: DataFrame) -> DataFrame:
    """Running totals per type; the state is one number per type."""
    return item_table(docs).groupBy("type").agg(F.count(F.lit(1)).alias("items"))


# Snapshots of the totals that stay behind the newest one, for readers that have begun to read.
KEPT = 8


def write_totals(totals: DataFrame, number: int, out_path: str, keep: int = KEPT) -> None:
    """One snapshot of the totals: the rows, then a mark that says they are whole, then tidying up.

    A snapshot whose mark is there is never written again, so what a reader may be reading stays as it
    is; a batch that is run again after a crash replaces only a snapshot without a mark. Of the marked
    ones the newest and `keep` before it stay. Marks go before their rows do, and whatever a crash
    leaves behind is removed by a later batch.
    """
    spark = totals.sparkSession
    if str(number) in names_in(spark, f"{out_path}/done"):
        return
    totals.coalesce(1).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
    put_mark(spark, f"{out_path}/done/{number}")
    for mark in names_in(spark, f"{out_path}/done"):
        if int(mark) < number - keep:
            remove(spark, f"{out_path}/done/{mark}")
    for name in names_in(spark, out_path):
        if name.startswith("batch=") and int(name.removeprefix("batch=")) < number - keep:
            remove(spark, f"{out_path}/{name}")


def latest_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """The totals of the last finished batch; no rows before there is one.

    The marks name it: one folder with a bounded number of names is listed, and one snapshot is read.
    """
    marks = [int(mark) for mark in names_in(spark, f"{out_path}/done")]
    if not marks:
        return spark.createDataFrame([], "type string, items bigint")
    return spark.read.parquet(f"{out_path}/batch={max(marks)}")


def start_counters(docs: DataFrame, out_path: str, checkpoint: str, keep: int = KEPT,
                   tasks: int | None = None) -> StreamingQuery:
    """Keep the totals of everything that has arrived: a snapshot a batch, of which the last few stay."""
    return (
        running_counts(dealt_out(docs, tasks)).writeStream.outputMode("complete")
        .foreachBatch(lambda batch, number: write_totals(batch, number, out_path, keep))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
