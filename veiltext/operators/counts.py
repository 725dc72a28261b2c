"""Counters and summaries. All are partial aggregations: rows shrink before they are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from veiltext import rules
from veiltext.functions.detect import bears_item
from veiltext.functions.insight import keyword_findings, security_info, top_matches
from veiltext.functions.mask import distinct_items, replace_values, value_spans
from veiltext.functions.spans import detect_ranked, public_spans, resolve_overlaps, with_extra


def span_table(docs: DataFrame, text: str = "text", resolved: bool = False) -> DataFrame:
    """`doc_id, entity, text, start, end, source`, every detector's spans or only those kept."""
    ranked = detect_ranked(F.col(text))
    spans = public_spans(resolve_overlaps(ranked) if resolved else ranked)
    return docs.select("doc_id", F.inline(spans))


def item_table(docs: DataFrame, *keep: str, text: str = "text", extra: DataFrame | None = None,
               types: Sequence[str] | None = None) -> DataFrame:
    """One row per item of the value detectors, one per (start, end): `doc_id, ..., type, ...`.

    `extra` has further spans of the same texts; they take the place of equal ranges. With `types`, only
    items of those types are given, and texts in which their detectors find nothing are left at that.
    """
    if extra is None:
        items = value_spans(F.col(text))
    else:
        docs = with_extra(docs, extra)
        items = value_spans(F.col(text), extra=F.col("_extra"))
    if types is not None:
        # Not a filter of the rows, which Spark would put before a table is dealt out.
        wanted = [d for d in rules.VALUE_DETECTORS if d.entity in types]
        sought = F.lit(False)
        if extra is not None:
            sought = F.lit(True)
        elif wanted:
            sought = bears_item(F.col(text), wanted)
        items = F.filter(F.when(sought, items), lambda s: s["entity"].isin(*types))
    return docs.select("doc_id", *keep, F.explode(items).alias("s")).select(
        "doc_id", *keep, F.col("s.entity").alias("type"), F.col("s.text").alias("text"),
        F.col("s.start").alias("start"), F.col("s.end").alias("end"),
    )


def entity_counts_by_doc(spans: DataFrame, entities: Sequence[str]) -> DataFrame:
    """One row per document with spans, one column per entity."""
    return spans.groupBy("doc_id").agg(*[
        F.count_if(F.col("entity") == e).alias(e.lower()) for e in entities
    ])


def redactions_by_type(items: DataFrame) -> DataFrame:
    return items.groupBy(
        F.concat(F.lower("type"), F.lit("_redacted")).alias("counter")
    ).agg(F.count(F.lit(1)).alias("items"))


def mask_and_count(docs: DataFrame, seen: Observation, entities: Sequence[str]) -> DataFrame:
    """`doc_id, masked` of every text, counting the items of each type as they are masked.

    The counts are metrics of the same pass over the rows, so there is no second detection, and nothing
    is shuffled: each task adds up its own and the driver adds those, one number per type. They are in
    `seen` once the rows have been written.
    """
    def of(entity: str) -> Column:
        return F.sum(F.size(F.filter("_items", lambda s: s["entity"] == entity))).alias(entity)

    items = docs.select("doc_id", "text", value_spans(F.col("text")).alias("_items"))
    counted = items.observe(seen, *map(of, entities))
    return counted.select(
        "doc_id", replace_values(F.col("text"), distinct_items(F.col("_items"))).alias("masked")
    )


def observed_counts(spark: SparkSession, seen: Observation) -> DataFrame:
    """What `mask_and_count` has counted, as `redactions_by_type` gives it."""
    rows = [(f"{entity.lower()}_redacted", n) for entity, n in seen.get.items() if n]
    return spark.createDataFrame(rows, "counter string, items bigint")


def files_outcome(outcomes: DataFrame) -> DataFrame:
    """Processed, successful and failed files; `outcomes` has a boolean `success`."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def label_of(type_name: Column) -> Column:
    return F.initcap(F.replace(F.lower(type_name), F.lit("_"), F.lit(" ")))


def summary_report(items: DataFrame) -> DataFrame:
    """Items per type, most first, beside the total. Only one row per type is ever sorted."""
    per_type = items.groupBy(label_of(F.col("type")).alias("label")).agg(
        F.count(F.lit(1)).alias("items")
    )
    total = F.sum("items").over(Window.partitionBy())
    return per_type.withColumn("total", total).orderBy(F.desc("items"), "label")


def cells_changed(masked: DataFrame, by: Sequence[str]) -> DataFrame:
    """Changed cells beside found items; `masked` has `changed` and `items`."""
    return masked.groupBy(*by).agg(
        F.count_if(F.col("changed")).alias("changed_cells"),
        F.sum("items").cast("long").alias("items"),
    )


def redactions_per_unit(units: DataFrame, unit: str) -> DataFrame:
    """Items per slide or page, where there are any. A unit is one row, so this needs no shuffle."""
    return units.select(
        "doc_id", unit, F.size(value_spans(F.col("text"))).cast("long").alias("items")
    ).filter(F.col("items") > 0)


def type_rollup(items: DataFrame, source: str = "source") -> DataFrame:
    """Items per source and type, per source, and in total."""
    return items.rollup(source, "type").agg(F.count(F.lit(1)).alias("items"))


def finding_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents per finding over the whole corpus."""
    return (
        docs.select(F.explode(keyword_findings(F.col(text))).alias("finding"))
        .groupBy("finding").agg(F.count(F.lit(1)).alias("docs"))
    )


def security_long(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every security fact as a row: `doc_id, category, match_no, match`."""
    return docs.select("doc_id", F.inline(security_info(F.col(text)))).select(
        "doc_id", "category", F.posexplode("matches").alias("match_no", "match")
    )


def security_top(docs: DataFrame, text: str = "text", limit: int = 10) -> DataFrame:
    """Each document's first `limit` different facts per category, by text. Done inside the row."""
    return docs.select("doc_id", F.inline(security_info(F.col(text)))).select(
        "doc_id", "category",
        F.posexplode(top_matches(F.col("matches"), limit)).alias("place", "match"),
    )

