"""Connected components of a link table as Spark joins: alternating star contraction.

Each round points every node at the smallest of its neighbours, first for the larger neighbours, then for the smaller
ones. Node ids only meet in joins and minima, so a hub with very many links is combined before the shuffle and split by
the adaptive skew join. Rounds end when the table no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.shared import written


def _signature(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")
    ).first()
    return int(row["n"]), int(row["h"] or 0)


def _larger_to_smallest(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).unionAll(pairs.select(F.col("v"), F.col("u")))
    least = both.groupBy("a").agg(F.min("b").alias("b"))
    return (
        pairs.join(least, pairs.v == least.a)
        .select("u", F.least("v", "b").alias("v"))
        .distinct()
    )


def _smaller_to_smallest(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link to another; `links` has columns u and v of one type."""
    pairs = written(
        links.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    before = _signature(pairs)
    while before[0]:
        pairs = written(_smaller_to_smallest(_larger_to_smallest(pairs)), "links")
        after = _signature(pairs)
        if after == before:
            break
        before = after
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionAll(found.select(F.col("component").alias("node"), "component").distinct())
