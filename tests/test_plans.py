"""The shape of plans: what reaches the scan, what shuffles, what stays in the JVM."""

import pytest
from pyspark.sql import functions as F

from veiltext.operators.documents import artifacts
from veiltext.plans import catalog
from veiltext.plans.tables import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SINKS = {
    "file_inventory", "read_text_docs", "read_csv_docs", "write_clean_text", "write_report_json",
    "write_report_array",
    "write_masked_csv", "stream_cleanse", "stream_counters", "redactions_observed",
}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SINKS))
def test_no_python_no_forced_broadcast_no_pair_loop(spark, folder, name):
    df = catalog.queries()[name](spark, folder)
    text = plan(df)
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert "hint" not in df._jdf.queryExecution().logical().toString().lower()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_dictionary_joins_without_broadcast(spark, folder):
    """Beyond the threshold names meet runs in a sort-merge join; rows of words are pruned before."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.queries()["detect_person_dict"](spark, folder)
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
        assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_document_flow_has_no_shuffle_of_its_own(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", F.lit("a.txt").alias("file_name"), "text")
    assert "Exchange" not in plan(artifacts(docs))
    assert "Exchange" not in plan(docs.select(catalog.mask_text(F.col("text"))))


def test_only_needed_columns_are_read(spark, folder):
    schema = plan(Tables(spark, folder).notes()).split("ReadSchema: ")[1].split("\n")[0]
    assert schema == "struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" or \
        schema == "struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp>"


def test_work_is_not_repeated(spark, folder):
    """Each step of the document flow is evaluated once."""
    text = plan(artifacts(spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", F.lit("a.txt").alias("file_name"), "text")))
    assert text.count("{3,}") == 1
