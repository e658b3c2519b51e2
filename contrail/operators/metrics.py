"""Evaluation of forecasts and classifiers, and the choices made from it. Every metric is a grouped aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions.columns import count_when, load_factor_band, safe_divide, time_band
from contrail.operators.running import prefix_aggregates

FORECAST_METRICS = ("mae", "rmse", "wape", "smape", "bias", "underforecast_rate", "overforecast_rate")


def forecast_metric_columns(predicted: str = "forecast_passengers", actual: str = "actual_passengers") -> list[Column]:
    p, a = F.col(predicted), F.col(actual)
    error = p - a
    size = F.abs(a) + F.abs(p)
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        safe_divide(F.sum(F.abs(error)), F.sum(F.abs(a))).alias("wape"),
        F.avg(F.when(size == 0, 0.0).otherwise(2 * F.abs(error) / size)).alias("smape"),
        F.avg(error).alias("bias"),
        F.avg(F.when(error < 0, 1.0).otherwise(0.0)).alias("underforecast_rate"),
        F.avg(F.when(error > 0, 1.0).otherwise(0.0)).alias("overforecast_rate"),
    ]


def forecast_metrics(df: DataFrame, groups: Sequence[str] = (), **names: str) -> DataFrame:
    """mae, rmse, wape, smape, bias and under/over rates, overall or per group."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("sample_size"), *forecast_metric_columns(**names))


def grouped_forecast_metrics(
    df: DataFrame, actual: str = "actual_passengers", capacity: str = "seat_capacity", **names: str
) -> DataFrame:
    """The same metrics by route and by load-factor band."""
    pairs = F.array(
        F.struct(F.lit("route").alias("dimension"), F.col("route_id").alias("value")),
        F.struct(F.lit("load_factor_band").alias("dimension"), load_factor_band(actual, capacity).alias("value")),
    )
    return forecast_metrics(df.select("*", F.inline(pairs)), ("dimension", "value"), actual=actual, **names)


def metric_rows_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric column."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("metric_value")) for m in metrics])
    return df.select(*keys, F.inline(entries))


# ---------------------------------------------------------------- classification


def _rates(df: DataFrame) -> DataFrame:
    """Ratios of the four confusion counts; anything over zero is zero."""
    def ratio(top: str, bottom: str) -> str:
        return f"coalesce(try_divide(cast({top} AS double), cast({bottom} AS double)), 0.0D)"

    base = df.selectExpr(
        "*",
        f"{ratio('tp', 'tp + fp')} AS precision",
        f"{ratio('tp', 'tp + fn')} AS recall",
        f"{ratio('tn', 'tn + fp')} AS specificity",
        f"{ratio('tp + fp', 'tp + fp + tn + fn')} AS predicted_positive_rate",
        f"{ratio('tp + fn', 'tp + fp + tn + fn')} AS actual_positive_rate",
    )
    return base.selectExpr(
        "*", f"{ratio('2 * precision * recall', 'precision + recall')} AS f1", "(recall + specificity) / 2 AS balanced_accuracy"
    )


def confusion_counts(hit: Column, label: str) -> dict[str, Column]:
    positive = F.col(label) == 1
    return {
        "tp": count_when(hit & positive),
        "fp": count_when(hit & ~positive),
        "tn": count_when(~hit & ~positive),
        "fn": count_when(~hit & positive),
    }


def log_loss_column(score: str, label: str, eps: float = 1e-15) -> Column:
    p = F.col(score)

    def bounded(x: Column) -> Column:
        return F.least(F.lit(1 - eps), F.greatest(F.lit(eps), x))

    return -F.avg(F.col(label) * F.ln(bounded(p)) + (1 - F.col(label)) * F.ln(bounded(1 - p)))


def brier_column(score: str, label: str) -> Column:
    gap = F.col(score) - F.col(label)
    return F.avg(gap * gap)


def confusion_metrics(
    df: DataFrame, threshold: float, groups: Sequence[str] = (), score: str = "probability", label: str = "target"
) -> DataFrame:
    """Confusion counts, ratios, log loss and Brier score at a threshold."""
    counts = confusion_counts(F.col(score) >= threshold, label)
    totals = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(label).cast("bigint").alias("positive_count"),
        *[c.alias(n) for n, c in counts.items()],
        log_loss_column(score, label).alias("log_loss"),
        brier_column(score, label).alias("brier_score"),
    )
    return _rates(totals)


def threshold_grid(
    df: DataFrame, thresholds: Sequence[float], score: str = "probability", label: str = "target"
) -> DataFrame:
    """Confusion metrics at several thresholds from one aggregate row."""
    counts: list[Column] = []
    for i, threshold in enumerate(thresholds):
        counts += [
            c.alias(f"{n}_{i}") for n, c in confusion_counts(F.col(score) >= float(threshold), label).items()
        ]
    row = df.agg(*counts)
    entries = ", ".join(
        f"struct({float(t)}D AS threshold, tp_{i} AS tp, fp_{i} AS fp, tn_{i} AS tn, fn_{i} AS fn)"
        for i, t in enumerate(thresholds)
    )
    return _rates(row.selectExpr(f"inline(array({entries}))"))


def _harmonic_gap(start: str, count: str) -> str:
    """Sum of 1/(start+i) for i = 1..count, by the asymptotic series after 16 exact terms."""
    low, high = f"({start} + 16.0D)", f"({start} + {count} + 16.0D)"

    def series(x: str) -> str:
        return f"(1 / (2 * {x}) - 1 / (12 * power({x}, 2)) + 1 / (120 * power({x}, 4)))"

    def exact(x: str) -> str:
        return " + ".join(f"1 / ({x} + {k}.0D)" for k in range(1, 17))

    return (
        f"(log1p({count} / {low}) + {series(high)} - {series(low)} - ({exact(f'({start} + {count})')}) + ({exact(start)}))"
    )


def curve_areas(
    df: DataFrame,
    groups: Sequence[str] = (),
    score: str = "probability",
    label: str = "target",
    pr_ties: str = "positives_first",
    score_bins: int = 1000,
) -> DataFrame:
    """ROC AUC (ties at their average rank) and PR AUC per group.

    Rows are first counted per distinct score, so the ordered part runs over scores, not rows. ``pr_ties`` is
    ``positives_first`` (equal scores rank positives ahead, which flatters constant predictors) or ``grouped``
    (equal scores form one step). Groups with a single class get a ROC AUC of zero.
    """
    keys = list(groups)
    counts = df.groupBy(*keys, score).agg(
        F.sum(label).cast("double").alias("_p"), F.sum(1 - F.col(label)).cast("double").alias("_q")
    )
    below = prefix_aggregates(
        counts,
        keys,
        [F.col(score)],
        {"_pb": ("sum", F.col("_p")), "_qb": ("sum", F.col("_q"))},
        [F.floor(F.col(score) * score_bins)],
    )
    totals = counts.groupBy(*keys).agg(F.sum("_p").alias("_pt"), F.sum("_q").alias("_qt"))
    if keys:
        joined = below.join(totals, keys)
    else:
        total = totals.select(F.struct("_pt", "_qt").alias("_t")).scalar()
        joined = below.withColumn("_t", total).select("*", "_t._pt", "_t._qt")
    ranked = joined.selectExpr("*", "_pt - _pb - _p AS _pa", "_qt - _qb - _q AS _qa")
    if pr_ties == "positives_first":
        step = f"if(_p = 0, 0.0D, if(_qa = 0, _p, _p - _qa * {_harmonic_gap('(_pa + _qa)', '_p')}))"
    elif pr_ties == "grouped":
        step = "_p * (_pa + _p) / (_pa + _qa + _p + _q)"
    else:
        raise ValueError(f"unknown tie rule: {pr_ties}")
    return ranked.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.expr("sum(_p * (_qb + _q / 2))"), F.expr("max(_pt) * max(_qt)")), F.lit(0.0)).alias(
            "roc_auc"
        ),
        F.coalesce(F.try_divide(F.expr(f"sum({step})"), F.expr("max(_pt)")), F.lit(0.0)).alias("pr_auc"),
    )


def roc_auc_ordinal(
    df: DataFrame,
    tie: str,
    tie_bins: Sequence[Column],
    score: str = "probability",
    label: str = "target",
    score_bins: int = 1000,
) -> DataFrame:
    """ROC AUC with equal scores ranked one by one in the order of ``tie``."""
    negative = 1 - F.col(label)
    inside = prefix_aggregates(df, [score], [F.col(tie)], {"_before": ("sum", negative)}, tie_bins)
    per_score = inside.groupBy(score).agg(
        F.sum(label).cast("double").alias("_p"),
        F.sum(negative).cast("double").alias("_q"),
        F.sum(F.when(F.col(label) == 1, F.col("_before")).otherwise(0)).cast("double").alias("_inside"),
    )
    ranked = prefix_aggregates(
        per_score, [], [F.col(score)], {"_qb": ("sum", F.col("_q"))}, [F.floor(F.col(score) * score_bins)]
    )
    return ranked.agg(
        F.coalesce(
            F.try_divide(F.expr("sum(_p * _qb + _inside)"), F.expr("sum(_p) * sum(_q)")), F.lit(0.0)
        ).alias("roc_auc")
    )


def evaluate_classifier(
    df: DataFrame, threshold: float, groups: Sequence[str] = (), pr_ties: str = "positives_first", **names: str
) -> DataFrame:
    """All classification metrics, overall or per group."""
    base = confusion_metrics(df, threshold, groups, **names)
    areas = curve_areas(df, groups, pr_ties=pr_ties, **names)
    if groups:
        return base.join(areas, list(groups))
    return base.withColumn("_a", areas.select(F.struct("roc_auc", "pr_auc")).scalar()).select("*", "_a.*").drop("_a")


def calibration_bins(df: DataFrame, bins: int = 10, score: str = "probability", label: str = "target") -> DataFrame:
    """Row count, mean probability and observed rate per probability bin; empty bins are zeros."""
    index = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int")
    filled = df.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(score).alias("mean_probability"),
        F.avg(label).alias("observed_delay_rate"),
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").na.fill(0, ["row_count"]).na.fill(
        0.0, ["mean_probability", "observed_delay_rate"]
    )


def grouped_delay_metrics(
    df: DataFrame, threshold: float, departure: str = "scheduled_departure_utc", pr_ties: str = "positives_first"
) -> DataFrame:
    """Classification metrics by route, origin, time band and weather exposure."""
    exposed = F.when(F.col("weather_exposure_flag") > 0, "True").otherwise("False")
    pairs = F.array(
        F.struct(F.lit("route").alias("dimension"), F.col("route_id").alias("value")),
        F.struct(F.lit("origin_airport").alias("dimension"), F.col("origin_airport").alias("value")),
        F.struct(F.lit("time_band").alias("dimension"), time_band(F.hour(departure)).alias("value")),
        F.struct(F.lit("weather_exposure").alias("dimension"), exposed.alias("value")),
    )
    long = df.select("probability", "target", F.inline(pairs))
    return evaluate_classifier(long, threshold, ("dimension", "value"), pr_ties)


# ---------------------------------------------------------------- choices


def select_champion(
    metrics: DataFrame,
    metric: str,
    *,
    maximize: bool,
    minimum_improvement: float = 0.0,
    tie_breakers: Sequence[Column] = (),
) -> DataFrame:
    """One row: the model to use. A candidate must beat the best baseline by the margin, else that baseline is used.

    ``metrics`` has one row per model with ``model_id``, ``model_role`` and the metric columns.
    """
    sign = -1 if maximize else 1
    role = F.when(F.col("model_role") == "baseline", 0).otherwise(1)
    order = F.struct((F.col(metric) * sign).alias("m"), *tie_breakers, role.alias("role"), F.col("model_id").alias("id"))
    if maximize:
        order = F.struct((-F.col(metric)).alias("m"), *tie_breakers, (-role).alias("role"))
    entry = F.struct("model_id", "model_role", F.col(metric).alias("score"))
    is_base = F.col("model_role") == "baseline"
    base_order = order if maximize else F.struct(F.col(metric).alias("m"), F.col("model_id").alias("id"))
    best = metrics.agg(
        F.min_by(entry, order).alias("best"),
        F.min_by(F.when(is_base, entry), F.when(is_base, base_order)).alias("base"),
    )
    if maximize:
        weak = F.col("best.score") - F.col("base.score") < minimum_improvement
    else:
        weak = F.col("best.score") > F.col("base.score") * (1 - minimum_improvement)
    fall_back = F.col("base").isNotNull() & (F.col("best.model_role") != "baseline") & weak
    return best.select(
        F.when(fall_back, F.col("base.model_id")).otherwise(F.col("best.model_id")).alias("champion_model_id"),
        F.when(fall_back, F.col("base.score")).otherwise(F.col("best.score")).alias("champion_score"),
        F.col("base.model_id").alias("best_baseline_id"),
        fall_back.alias("fell_back_to_baseline"),
    )


def model_registry(metrics: DataFrame, champion: DataFrame) -> DataFrame:
    """The candidates with their validation scores, and which one is published; as many rows as models."""
    won = champion.select(F.col("champion_model_id").alias("model_id"), F.lit(True).alias("_won"))
    return metrics.join(F.broadcast(won), "model_id", "left").withColumn("published", F.coalesce("_won", F.lit(False))).drop("_won")


def published_rows(candidates: DataFrame, registry: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Of the rows of all candidates those of the published model; the plan is the same whichever won."""
    chosen = registry.where("published").select("model_id", "model_role", *extra)
    return candidates.drop("model_role").join(F.broadcast(chosen), "model_id")


def forecast_tie_breakers() -> list[Column]:
    return [F.abs("bias").alias("t1"), F.col("mae").alias("t2")]


def delay_tie_breakers() -> list[Column]:
    return [(-F.col("f1")).alias("t1"), F.col("brier_score").alias("t2")]


def select_threshold(grid: DataFrame, metric: str = "f1", default: float = 0.5) -> DataFrame:
    """The threshold with the best metric, then recall, precision, closeness to the default, smaller value."""
    return grid.orderBy(
        F.col(metric).desc(),
        F.col("recall").desc(),
        F.col("precision").desc(),
        F.abs(F.col("threshold") - default),
        F.col("threshold"),
    ).limit(1)


LONG_METRICS: Mapping[str, Sequence[str]] = {"forecast": FORECAST_METRICS}
