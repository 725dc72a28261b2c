"""Running totals over a whole table, in an order, without a single task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veiltext.session import stored


def running(rows: DataFrame, order: Sequence[str], sums: Sequence[str],
            within: Sequence[Column] = ()) -> DataFrame:
    """The rows, stored, with `<name>_before` for each of `sums` and with `row_before`.

    Rows are dealt by ranges of `order`, so partition n holds what comes before partition n + 1.
    Each partition's totals are summed over the partitions before it, and added to the running sums
    inside the partition. `<name>_before` is the sum over all rows that come before, `row_before`
    their number (a gapless position). The table of totals has one row per partition, so it is as
    small as `spark.sql.shuffle.partitions`.

    `order` should tell rows apart. Rows equal in all of it stay in one partition and follow each
    other by `within`, which takes further expressions, or at random if they are equal in those too.
    Nulls come first. A null amount counts as 0; an empty table gives an empty table.
    """
    by = [F.col(name).asc_nulls_first() for name in order]
    dealt = stored(
        rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    )
    amounts = [*(F.coalesce(F.sum(name), F.lit(0)).alias(f"_{name}") for name in sums),
               F.count(F.lit(1)).alias("_row")]
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    kept = [*sums, "row"]
    offsets = dealt.groupBy("_part").agg(*amounts).select(
        "_part",
        *(F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}_off")
          for name in kept),
    )
    inside = (
        Window.partitionBy("_part").orderBy(*by, *within)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = dealt.select(
        *dealt.columns,
        *(F.coalesce(F.sum(name).over(inside), F.lit(0)).alias(f"_{name}_in") for name in sums),
        F.count(F.lit(1)).over(inside).alias("_row_in"),
    )
    # One row per partition: bounded by the number of partitions.
    return placed.join(F.broadcast(offsets), "_part").select(
        *rows.columns,
        *((F.col(f"_{name}_in") + F.col(f"_{name}_off")).alias(f"{name}_before") for name in kept),
    )
