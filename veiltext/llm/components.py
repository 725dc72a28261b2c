"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltext.session import stored


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v") % (1 << 40)
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def components(links: DataFrame) -> DataFrame:
    """`node, component` of every node in `links` (`a, b`, integers); a component is its smallest node.

    Alternating stars: each node hands its larger neighbours, and then its smaller ones, to the
    smallest it knows, until nothing changes; the number of rounds grows with the logarithm of the
    longest chain. Minima are partial sums, so a node with very many links costs no single task, and
    the joins have one side with one row per node. Each round is written out, which cuts the
    lineage. Links to oneself and repeated links do no harm; nulls are left out; no links give no rows.
    """
    edges = stored(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        larger = stored(larger)
        low = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(low, "u").filter("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        edges = stored(smaller.unionByName(low.withColumnRenamed("m", "v")).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    # Every node now points at the smallest one of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
