"""What was known before each flight: rates, means and counts over earlier rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions.columns import safe_divide
from contrail.operators.running import day_bin, hour_bin, prefix_aggregates

MATERIAL_DELAY_MINUTES = 15


def prior_mean(
    df: DataFrame,
    *,
    key: str = "route_id",
    target: str = "target",
    capacity: str = "seat_capacity",
    day: str = "operating_date",
    tie: str = "flight_id",
    legacy: bool = False,
) -> DataFrame:
    """Mean target, mean load factor and count over earlier rows of the route.

    The first row of a route has no history: its means are null, or its own values with ``legacy`` (which leaks).
    """
    load = F.col(target) / F.col(capacity)
    out = prefix_aggregates(
        df,
        [key],
        [F.col(day), F.col(tie)],
        {
            "_sum": ("sum", F.col(target).cast("double")),
            "_load": ("sum", load),
            "historical_route_observations": ("count", F.col(target)),
        },
        [day_bin(day)],
    )
    n = F.col("historical_route_observations")

    def mean(total: str, own: Column) -> Column:
        rest = own if legacy else F.lit(None).cast("double")
        return F.when(n > 0, F.col(total) / n).otherwise(rest)

    return out.withColumns(
        {
            "historical_route_mean": mean("_sum", F.col(target).cast("double")),
            "historical_route_load_factor": mean("_load", load),
        }
    ).drop("_sum", "_load")


def prior_rate(
    df: DataFrame,
    dimensions: Mapping[str, str],
    *,
    target: str = "target",
    delay: str = "delay_minutes",
    ts: str = "scheduled_departure_utc",
    tie: str = "flight_id",
    bins: Sequence[Column] | None = None,
) -> DataFrame:
    """Delay rate, mean delay and count over earlier rows, per dimension (name to key column).

    Rows without history get rate 0.5, mean 0 and count 0. All dimensions go through one pass over narrow rows
    (dimension, key, time, tie), folded back by the row's time and tie.
    """
    own = F.explode(F.array(*[F.struct(F.lit(d).alias("_d"), F.col(k).cast("string").alias("_key")) for d, k in dimensions.items()]))
    narrow = df.select(F.col(ts).alias("_at"), F.col(tie).alias("_tie"), F.col(target).alias("_y"), F.col(delay).alias("_m"), own.alias("_own"))
    narrow = narrow.select("_at", "_tie", "_y", "_m", "_own._d", "_own._key")
    at = F.col("_at")
    counted = prefix_aggregates(
        narrow,
        ["_d", "_key"],
        [at, F.col("_tie")],
        {"_hits": ("sum", F.col("_y")), "_delay": ("sum", F.col("_m")), "_n": ("count", F.lit(1))},
        bins if bins is not None else [day_bin(at)],
    )
    n, found = F.col("_n"), []
    for name in dimensions:
        mine = F.col("_d") == name
        found += [
            F.max(F.when(mine, n)).alias(f"{name}_count"),
            F.max(F.when(mine, F.when(n > 0, F.col("_hits") / n).otherwise(F.lit(0.5)))).alias(f"{name}_rate"),
            F.max(F.when(mine, F.when(n > 0, F.col("_delay") / n).otherwise(F.lit(0.0)))).alias(f"{name}_mean_delay"),
        ]
    folded = counted.groupBy("_at", "_tie").agg(*found)
    same = F.col(ts).eqNullSafe(F.col("_at")) & F.col(tie).eqNullSafe(F.col("_tie"))
    return df.join(folded, same, "left").drop("_at", "_tie")


def prior_rate_strict(
    df: DataFrame,
    dimensions: Mapping[str, str],
    *,
    target: str = "target",
    delay: str = "delay_minutes",
    known_at: str = "actual_arrival_utc",
    cutoff: str = "prediction_cutoff_utc",
    tie: str = "flight_id",
) -> DataFrame:
    """Like :func:`prior_rate`, but only outcomes already known at the row's cutoff count.

    Outcomes (at the moment they become known) and questions (at their cutoff) are merged into one ordered stream.
    """
    marked = df.withColumns({"_at": F.col(cutoff), "_kind": F.lit(1)})
    keys = list(dict.fromkeys(dimensions.values()))
    outcomes = df.filter(F.col(known_at).isNotNull()).select(
        *keys, F.col(tie), F.col(known_at).alias("_at"), F.lit(0).alias("_kind"), F.col(target), F.col(delay)
    )
    stream = marked.unionByName(outcomes, allowMissingColumns=True)
    is_outcome = F.col("_kind") == 0
    for name, key in dimensions.items():
        stream = prefix_aggregates(
            stream,
            [key],
            [F.col("_at"), F.col("_kind"), F.col(tie)],
            {
                "_hits": ("sum", F.when(is_outcome, F.col(target))),
                "_delay": ("sum", F.when(is_outcome, F.col(delay))),
                f"{name}_count": ("count", F.when(is_outcome, 1)),
            },
            [hour_bin("_at")],
        )
        n = F.col(f"{name}_count")
        stream = stream.withColumns(
            {
                f"{name}_rate": F.when(n > 0, F.col("_hits") / n).otherwise(F.lit(0.5)),
                f"{name}_mean_delay": F.when(n > 0, F.col("_delay") / n).otherwise(F.lit(0.0)),
            }
        ).drop("_hits", "_delay")
    return stream.filter(F.col("_kind") == 1).drop("_at", "_kind")


def prior_pressure(
    df: DataFrame,
    *,
    key: str = "route_id",
    delay: str = "departure_delay_minutes",
    ts: str = "scheduled_departure_utc",
    day: str = "operating_date",
    tie: str = "flight_id",
) -> DataFrame:
    """Share of earlier route rows materially late, and how many of them were on the same date."""
    late = F.when(F.coalesce(F.col(delay), F.lit(0)) >= MATERIAL_DELAY_MINUTES, F.lit(1)).otherwise(F.lit(0))
    order = [F.col(ts), F.col(tie)]
    df = prefix_aggregates(
        df, [key], order, {"_late": ("sum", late), "_n": ("count", F.lit(1))}, [hour_bin(ts)]
    )
    df = df.withColumn("prior_route_delay_pressure", safe_divide(F.col("_late"), F.col("_n"))).drop("_late", "_n")
    df = prefix_aggregates(df, [key, day], order, {"_same_day": ("sum", late)}, [hour_bin(ts)])
    return df.withColumn("same_day_route_disruption_count", F.col("_same_day").cast("double")).drop("_same_day")
