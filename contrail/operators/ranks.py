"""Exact positions in a global order: quantiles by histogram refinement, and chronological splits.

Neither sorts the table. Quantiles narrow a bracket around the wanted position with fixed-size histograms;
splits count rows per time chunk, find the boundary rows in their chunks and compare all other rows with them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from contrail.operators.running import BEFORE_ALL, prefix_aggregates, row_positions
from contrail.session import materialize

HISTOGRAM_BINS = 4096
BRACKET = 0.001


def nearest_rank(level: float) -> tuple[float, Callable[[Column], Column]]:
    """Zero-based index round(level * (n - 1)), halves to even."""
    return level, lambda n: F.greatest(
        F.lit(0), F.least(n - 1, F.bround(F.lit(float(level)) * (n - 1), 0).cast("bigint"))
    )


LOWER_MIDDLE: tuple[float, Callable[[Column], Column]] = (0.5, lambda n: F.floor((n - 1) / 2).cast("bigint"))
UPPER_MIDDLE: tuple[float, Callable[[Column], Column]] = (0.5, lambda n: F.ceil((n - 1) / 2).cast("bigint"))


def unpivot_fields(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    pairs = [F.struct(F.lit(name).alias("field"), expr.cast("double").alias("v")) for name, expr in fields.items()]
    return df.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*").filter(F.col("v").isNotNull())


def order_statistics(
    values: DataFrame, picks: Mapping[str, tuple[float, Callable[[Column], Column]]], refinements: int = 2
) -> DataFrame:
    """Exact values at given positions of (field, v) rows: one output row per (field, pick).

    An approximate quantile sketch brackets each position, then fixed-size histograms of the whole column count
    what lies below and zoom in; rows outside the bracket keep their own end bins, so the answer never depends on
    the sketch. Only one row per (field, pick) is broadcast, and a histogram has at most ``HISTOGRAM_BINS + 2`` rows.
    """
    names = list(picks)
    probes = []
    for level, _ in picks.values():
        probes += [max(0.0, level - BRACKET), min(1.0, level + BRACKET)]
    summary = values.groupBy("field").agg(
        F.count("v").alias("n"),
        F.min("v").alias("_min"),
        F.max("v").alias("_max"),
        F.percentile_approx("v", F.array(*[F.lit(p) for p in probes]), F.lit(10000)).alias("_q"),
    )
    targets = F.array(
        *[
            F.struct(
                F.lit(name).alias("pick"),
                picks[name][1](F.col("n")).cast("bigint").alias("k"),
                F.col("_q")[2 * i].alias("lo"),
                F.col("_q")[2 * i + 1].alias("hi"),
                F.col("_min").alias("low_end"),
                F.col("_max").alias("high_end"),
            )
            for i, name in enumerate(names)
        ]
    )
    chosen = summary.select("field", "n", F.explode(targets).alias("_t")).select("field", "n", "_t.*")
    order = Window.partitionBy("field", "pick").orderBy("_bin")
    for _ in range(refinements):
        lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
        slot = F.floor(F.try_divide(v - lo, hi - lo) * HISTOGRAM_BINS)
        bucket = (
            F.when(v < lo, F.lit(-1))
            .when(v > hi, F.lit(HISTOGRAM_BINS))
            .otherwise(F.coalesce(F.least(slot, F.lit(HISTOGRAM_BINS - 1)), F.lit(0)))
            .cast("int")
        )
        counted = (
            values.join(F.broadcast(chosen), "field")
            .filter(v.between(F.col("low_end"), F.col("high_end")))
            .withColumn("_bin", bucket)
            .groupBy("field", "pick", "n", "k", "_bin")
            .agg(F.count(F.lit(1)).alias("_c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        chosen = (
            counted.withColumn("_cum", F.sum("_c").over(order))
            .filter((F.col("_cum") > F.col("k")) & (F.col("_cum") - F.col("_c") <= F.col("k")))
            .select(
                "field",
                "n",
                "pick",
                (F.col("k") - (F.col("_cum") - F.col("_c"))).alias("k"),
                "lo",
                "hi",
                F.col("lo").alias("low_end"),
                F.col("hi").alias("high_end"),
            )
        )
    final = (
        values.join(F.broadcast(chosen), "field")
        .filter(F.col("v").between(F.col("lo"), F.col("hi")))
        .groupBy("field", "pick", "n", "k", "v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_cum", F.sum("_c").over(Window.partitionBy("field", "pick").orderBy("v")))
        .filter((F.col("_cum") > F.col("k")) & (F.col("_cum") - F.col("_c") <= F.col("k")))
    )
    return final.select("field", "pick", "n", F.col("v").alias("value"))


def medians(values: DataFrame) -> DataFrame:
    """Exact median per field: the mean of the two middle values."""
    middle = order_statistics(values, {"lower": LOWER_MIDDLE, "upper": UPPER_MIDDLE})
    return middle.groupBy("field").agg(F.avg("value").alias("median"))


def split_counts_simple(
    train_fraction: float, validation_fraction: float, minimum_train: int
) -> Callable[[Column], tuple[Column, Column]]:
    """Split sizes of the demand models: a floor on training rows, and the last two rows kept apart if need be."""

    def sizes(n: Column) -> tuple[Column, Column]:
        train = F.greatest(F.lit(minimum_train), F.floor(n * F.lit(train_fraction)))
        validation = F.greatest(F.lit(1), F.floor(n * F.lit(validation_fraction)))
        crowded = train + validation >= n
        first = F.when(crowded, F.greatest(F.lit(1), n - 2)).otherwise(train)
        return first.cast("bigint"), (first + F.when(crowded, F.lit(1)).otherwise(validation)).cast("bigint")

    return sizes


def split_counts_guarded(
    train_fraction: float,
    validation_fraction: float,
    minimum_train: int,
    minimum_validation: int,
    minimum_test: int,
) -> Callable[[Column], tuple[Column, Column]]:
    """Split sizes of the delay models: floors on every part, the test floor taken from validation."""

    def sizes(n: Column) -> tuple[Column, Column]:
        train = F.greatest(F.lit(minimum_train), F.floor(n * F.lit(train_fraction)))
        until = train + F.greatest(F.lit(minimum_validation), F.floor(n * F.lit(validation_fraction)))
        until = F.when(n - until < minimum_test, n - minimum_test).otherwise(until)
        return train.cast("bigint"), until.cast("bigint")

    return sizes


def _narrow(df: DataFrame, order: Sequence[Column], bins: Sequence[Column]) -> DataFrame:
    """Stored columns _s0, … (chunk numbers) and _o0, … (the order) of all rows."""
    chunk = [F.coalesce(b.cast("bigint"), F.lit(BEFORE_ALL)).alias(f"_s{i}") for i, b in enumerate(bins)]
    return materialize(df.select(*chunk, *[o.alias(f"_o{i}") for i, o in enumerate(order)]), "narrow")


def rows_at(narrow: DataFrame, places: Sequence[int]) -> list[Column]:
    """The order of the rows at the given places (from one) in a total order, as struct literals.

    Chunk counts find the chunk of each place; only the narrow rows of those chunks are numbered, in pieces of bounded size.
    """
    names, keys = ([c for c in narrow.columns if c.startswith(p)] for p in ("_s", "_o"))
    counted = materialize(narrow.groupBy(*names).agg(F.count(F.lit(1)).alias("_c")), "chunks")
    coarse = [F.col(n) for n in names[:-1]]
    running = prefix_aggregates(counted, [], [F.col(n) for n in names], {"_start": ("sum", F.col("_c"))}, coarse)
    found: dict[int, Row] = {}
    for place in set(places):
        chunk = running.where((F.col("_start") < place) & (F.col("_start") + F.col("_c") >= place)).first()
        if chunk is None:
            continue
        own = narrow.where(reduce(and_, [F.col(n) == chunk[n] for n in names]))
        placed = row_positions(own.select(*keys), keys, "_place")
        found[place] = placed.where(F.col("_place") == place - chunk["_start"] - 1).drop("_place").first()
    types = {f.name: f.dataType for f in narrow.schema.fields}
    return [
        F.lit(None) if found.get(place) is None else F.struct(*[F.lit(found[place][k]).cast(types[k]).alias(k) for k in keys])
        for place in places
    ]


def chronological_split(
    df: DataFrame,
    order: Sequence[Column],
    bins: Sequence[Column],
    sizes: Callable[[Column], tuple[Column, Column]],
    name: str = "partition",
) -> DataFrame:
    """Label rows train, validation or test by their position in a total order.

    ``bins`` are whole-number, order-preserving functions of the order, coarse to fine. The rows at the two boundaries are found
    first; every row is then labelled by comparing its order with theirs, without a sort or a shuffle of the table.
    """
    first, second = sizes(F.col("n"))
    narrow = _narrow(df, order, bins)
    ends = narrow.agg(F.count(F.lit(1)).alias("n")).select(first.alias("train"), second.alias("until")).first()
    last_train, last_validation = rows_at(narrow, [int(ends["train"]), int(ends["until"])])
    own = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    return df.withColumn(name, F.when(own <= last_train, "train").when(own <= last_validation, "validation").otherwise("test"))


def split_boundaries(df: DataFrame, when: str, part: str = "partition") -> DataFrame:
    """First and last moment and row count of each part."""
    return df.groupBy(part).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(when).alias("first_value"), F.max(when).alias("last_value")
    )
