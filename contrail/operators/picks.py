"""One row per key: latest, earliest, most frequent, top k, and lookups. Every pick combines before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The first row of each key in a given order, as a map-side combined ``min_by``."""
    return _pick(df, keys, F.min_by, order, columns)


def pick_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The last row of each key in a given order, as a map-side combined ``max_by``."""
    return _pick(df, keys, F.max_by, order, columns)


def _pick(df: DataFrame, keys: Sequence[str], pick: Any, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    picked = pick(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def horizon_pick(
    demand: DataFrame,
    horizon_days: int,
    columns: Sequence[str],
    *,
    key: str = "flight_id",
    days: str = "days_before_departure",
    observed: str = "observation_date",
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """Per flight, the observation closest to (but not after) the booking horizon; ties take the earlier date."""
    eligible = demand.filter(F.col(days) >= horizon_days)
    return pick_first(eligible, [key], [F.col(c) for c in (days, observed, *tie_breakers)], columns)


def latest_observation(
    demand: DataFrame,
    columns: Sequence[str],
    *,
    key: str = "flight_id",
    days: str = "days_before_departure",
    observed: str = "observation_date",
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """Per flight, the booking observation nearest to departure."""
    return pick_first(demand, [key], [F.col(c) for c in (days, observed, *tie_breakers)], columns)


def asof_latest(
    readings: DataFrame,
    points: DataFrame,
    columns: Sequence[str],
    *,
    key: str = "flight_id",
    reading_ts: str = "event_timestamp_utc",
    cutoff: str = "prediction_cutoff_utc",
    tie_breaker: str = "telemetry_id",
) -> DataFrame:
    """Per point, the latest reading of its key at or before the cutoff; equal times take the smallest id.

    The readings are reduced to their key's eligible maximum after an equi join on the key, with a map-side combine.
    """
    limits = points.select(key, F.col(cutoff).alias("_cutoff"))
    eligible = readings.join(limits, key).filter(F.col(reading_ts) <= F.col("_cutoff"))
    return pick_first(eligible, [key], [-F.unix_micros(reading_ts), F.col(tie_breaker)], columns)


def dominant_value(df: DataFrame, keys: Sequence[str], value: str, alias: str | None = None) -> DataFrame:
    """Most frequent value per key, ties to the smallest value; counted per (key, value) first."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(alias or f"dominant_{value}")
    )


def topk_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """At most k rows per key. Spark keeps k rows per map task before the shuffle (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def topk_global(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of a total order, taken per partition and merged."""
    return df.orderBy(*order).limit(k)


def join_lookup(
    df: DataFrame,
    lookup: DataFrame,
    key: str,
    columns: Mapping[str, Any],
    *,
    row_order: Sequence[Column] | None = None,
) -> DataFrame:
    """Left equi lookup with defaults for misses; with ``row_order`` the last lookup row of a key wins."""
    source = lookup.select(key, *columns) if row_order is None else pick_last(lookup, [key], row_order, list(columns))
    joined = df.join(source, key, "left")
    return joined.withColumns(
        {name: F.coalesce(F.col(name), F.lit(default)) for name, default in columns.items() if default is not None}
    )


def join_optional_source(
    df: DataFrame, source: DataFrame | None, key: str, columns: Mapping[str, Any], used_flag: str
) -> DataFrame:
    """Join a source only if it is supplied; otherwise constants, with a flag saying whether a row matched."""
    if source is None:
        return df.withColumns({**{c: F.lit(v) for c, v in columns.items()}, used_flag: F.lit(False)})
    marked = source.select(key, *columns).withColumn(used_flag, F.lit(True))
    return join_lookup(df, marked, key, {**columns, used_flag: False})


def filter_include_exclude(
    df: DataFrame, column: str, include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """Keep listed values (all when the list is empty) and drop excluded ones."""
    kept = df.filter(F.col(column).isin(*include)) if include else df
    return kept.filter(~F.col(column).isin(*exclude)) if exclude else kept


def filter_min_group_size(df: DataFrame, key: str, minimum: int) -> DataFrame:
    """Keep rows whose key has at least ``minimum`` rows; the counts are combined map-side, then joined back."""
    if minimum <= 1:
        return df.filter(F.col(key).isNotNull())
    large = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum).select(key)
    return df.join(large, key, "left_semi")


def exclusions_ledger(df: DataFrame, rules: Sequence[tuple[str, Column]], reason: str = "exclusion_reason") -> DataFrame:
    """Mark each row with the first rule that drops it, null when it is kept."""
    expr: Column | None = None
    for label, condition in rules:
        hit = F.coalesce(condition, F.lit(False))
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return df.withColumn(reason, expr if expr is not None else F.lit(None).cast("string"))


def partition_leak_check(df: DataFrame, entity: str, part: str = "partition") -> DataFrame:
    """Entities that appear in more than one partition; empty when the split is sound."""
    return (
        df.groupBy(entity)
        .agg(F.count_distinct(F.col(part)).alias("partition_count"))
        .filter(F.col("partition_count") > 1)
    )
