"""Baselines, linear and logistic models, and the tables made from their predictions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions.columns import band_case, round_half_even, safe_divide
from contrail.operators.ranks import nearest_rank, order_statistics
from contrail.operators.running import row_positions

# The overbooking cap, bounds of probabilities and the delay bands.
OVERBOOKING_CAP = 1.08
PROBABILITY_FLOOR, PROBABILITY_CEILING = 0.000001, 0.999999
DELAY_BANDS = ((0.0, 0.3, "low"), (0.3, 0.6, "medium"), (0.6, 1.0, "high"))


def key_means(train: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Mean of a value per key."""
    return train.groupBy(key).agg(F.avg(value).alias(name))


def with_key_mean(rows: DataFrame, train: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Add the key's training mean, or the overall mean for keys not seen in training."""
    overall = train.agg(F.avg(value).alias("m")).scalar()
    joined = rows.join(key_means(train, key, value, "_mean"), key, "left")
    return joined.withColumn(name, F.coalesce("_mean", overall)).drop("_mean")


def model_historical_mean(rows: DataFrame, train: DataFrame, target: str = "target") -> DataFrame:
    return with_key_mean(rows, train, "route_id", F.col(target), "raw_prediction")


def model_seasonal_naive(
    rows: DataFrame, train: DataFrame, target: str = "target", booked: str = "booked_passengers"
) -> DataFrame:
    """Bookings at the horizon times the route's past conversion."""
    conversion = F.col(target) / F.greatest(F.lit(1), F.col(booked))
    return with_key_mean(rows, train, "route_id", conversion, "_conversion").withColumn(
        "raw_prediction", F.col(booked) * F.col("_conversion")
    ).drop("_conversion")


def model_majority(rows: DataFrame, train: DataFrame, target: str = "target") -> DataFrame:
    rate = train.agg(F.avg(target).alias("m")).scalar()
    return rows.withColumn("probability", clip_probability(rate))


def model_route_rate(rows: DataFrame, train: DataFrame, target: str = "target") -> DataFrame:
    rated = with_key_mean(rows, train, "route_id", F.col(target), "_rate")
    return rated.withColumn("probability", clip_probability(F.col("_rate"))).drop("_rate")


def clip_probability(p: Column) -> Column:
    return F.least(F.lit(PROBABILITY_CEILING), F.greatest(F.lit(PROBABILITY_FLOOR), p))


def estimate_delay_minutes(
    rows: DataFrame, train: DataFrame, delay: str = "delay_minutes", probability: str = "probability"
) -> DataFrame:
    """Route mean delay scaled by (0.5 + probability), never negative."""
    out = with_key_mean(rows, train, "route_id", F.col(delay).cast("double"), "_route_delay")
    estimate = F.greatest(F.lit(0.0), F.col("_route_delay") * (0.5 + F.col(probability)))
    return out.withColumn("estimated_delay_minutes", F.round(estimate + 1e-10, 4)).drop("_route_delay")


# ---------------------------------------------------------------- feature order


def one_hot_table(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Sorted numeric names, then ``name=level`` of the training rows, as a table (position, feature_name)."""
    names = train.sparkSession.createDataFrame([(0, n, "") for n in sorted(numeric)], "kind int, feature string, level string")
    for name in categorical:
        level = F.col(name).cast("string").alias("level")
        names = names.unionAll(train.where(F.col(name).isNotNull()).select(F.lit(1), F.lit(name), level).distinct())
    placed = row_positions(names, ["kind", "feature", "level"], "position")
    named = F.when(F.col("kind") == 0, F.col("feature")).otherwise(F.concat_ws("=", "feature", "level"))
    return placed.select(F.col("position").cast("int").alias("position"), named.alias("feature_name"))


# ---------------------------------------------------------------- logistic model


def fit_logistic(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str = "target", max_iter: int = 100
) -> Any:
    """Distributed logistic regression on one-hot and numeric features (its optimum, not a fixed number of steps)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    categorical = sorted(categorical)
    stages: list[Any] = []
    if categorical:
        stages += [
            StringIndexer(
                inputCols=categorical,
                outputCols=[f"_i_{c}" for c in categorical],
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_v_{c}" for c in categorical]),
        ]
    stages += [
        VectorAssembler(inputCols=[*sorted(numeric), *[f"_v_{c}" for c in categorical]], outputCol="_features"),
        LogisticRegression(
            featuresCol="_features",
            labelCol=target,
            probabilityCol="_probability",
            rawPredictionCol="_raw",
            predictionCol="_label",
            maxIter=max_iter,
            regParam=1e-6,
        ),
    ]
    return Pipeline(stages=stages).fit(train)


def predict_logistic(rows: DataFrame, model: Any) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows)
    kept = rows.columns
    return scored.withColumn("probability", clip_probability(vector_to_array("_probability")[1])).select(
        *kept, "probability"
    )


# ---------------------------------------------------------------- prediction tables


def capacity_clamp(df: DataFrame, allow_overbooking: bool = True) -> DataFrame:
    """Bound a raw forecast to [0, capacity or capacity plus the overbooking cap], round it, and say if that changed it."""
    factor = OVERBOOKING_CAP if allow_overbooking else 1.0
    raw = F.col("raw_prediction")
    floor = F.greatest(F.lit(0.0), raw)
    bounded = F.least(floor, F.col("seat_capacity") * factor)
    return df.withColumns(
        {
            "constraint_applied": (F.abs(floor - raw) > 0.0001) | (F.abs(bounded - floor) > 0.0001),
            "forecast_passengers": round_half_even(bounded),
        }
    )


def residual_quantiles(df: DataFrame, residual: Column, levels: Sequence[float]) -> DataFrame:
    """Nearest-rank quantiles of a residual: (level in percent, width)."""
    values = df.select(F.lit("residual").alias("field"), residual.cast("double").alias("v")).filter("v IS NOT NULL")
    picks = {str(int(level * 100)): nearest_rank(level) for level in levels}
    return order_statistics(values, picks).select(F.col("pick").alias("level"), F.col("value").alias("width"))


def interval_bounds(df: DataFrame, quantiles: DataFrame, levels: Sequence[int] = (80, 95)) -> DataFrame:
    """Lower and upper bounds around the forecast from the quantile widths."""
    widths = quantiles.agg(F.map_from_entries(F.collect_list(F.struct("level", "width"))))
    out = df.withColumn("_w", widths.scalar())
    p = F.col("forecast_passengers")
    for level in levels:
        width = F.coalesce(F.try_element_at("_w", F.lit(str(level))), F.lit(0.0))
        out = out.withColumns(
            {
                f"forecast_lower_{level}": F.greatest(F.lit(0.0), round_half_even(p - width)),
                f"forecast_upper_{level}": F.greatest(round_half_even(p), round_half_even(p + width)),
            }
        )
    return out.drop("_w")


def forecast_table(df: DataFrame, run_id: str) -> DataFrame:
    """The published forecast of the model named in each row: bounds, errors and percentage error."""
    signed = F.col("forecast_passengers") - F.col("target")
    return df.select(
        F.lit(run_id).alias("forecast_run_id"),
        "model_id",
        "model_role",
        "flight_id",
        "route_id",
        "operating_date",
        "observation_date",
        F.col("days_before_departure").alias("prediction_horizon_days"),
        F.col("target").alias("actual_passengers"),
        F.round(F.col("raw_prediction") + 1e-10, 4).alias("raw_forecast_passengers"),
        "forecast_passengers",
        *[c for c in df.columns if c.startswith(("forecast_lower_", "forecast_upper_"))],
        "seat_capacity",
        round_half_even(F.col("seat_capacity") * OVERBOOKING_CAP).alias("allowed_capacity"),
        "constraint_applied",
        F.abs(signed).alias("absolute_error"),
        signed.alias("signed_error"),
        F.try_divide(F.abs(signed), F.nullif(F.col("target").cast("double"), F.lit(0.0))).alias("percentage_error"),
        "partition",
    )


def forecast_adjustments(forecast: DataFrame) -> DataFrame:
    """What the constraints did to each forecast."""
    return forecast.select(
        "forecast_run_id",
        "flight_id",
        "route_id",
        F.col("raw_forecast_passengers").alias("raw_forecast"),
        F.col("forecast_passengers").alias("forecast"),
        "constraint_applied",
    )


def delay_predictions_table(
    df: DataFrame,
    run_id: str,
    bands: Sequence[tuple[float, float, str]] = DELAY_BANDS,
) -> DataFrame:
    """The published delay predictions of the model and threshold named in each row, with flag and risk band."""
    p = F.col("probability")
    extra = ("weather_exposure_flag", "airport_event_exposure_flag", "partition", "prediction_cutoff_utc")
    return df.select(
        F.lit(run_id).alias("delay_run_id"),
        "model_id",
        "flight_id",
        "route_id",
        "origin_airport",
        "destination_airport",
        "operating_date",
        "scheduled_departure_utc",
        F.round(p + 1e-10, 6).alias("delay_probability"),
        F.when(p >= F.col("threshold"), 1).otherwise(0).alias("predicted_delay_flag"),
        band_case(p, bands).alias("risk_band"),
        "estimated_delay_minutes",
        F.col("target").alias("actual_delay_flag"),
        F.col("delay_minutes").alias("actual_delay_minutes"),
        *[c for c in extra if c in df.columns],
    )


def prediction_adjustments(predictions: DataFrame) -> DataFrame:
    """High-band flights are recommended for review."""
    high = F.col("risk_band") == "high"
    return predictions.select(
        "delay_run_id",
        "flight_id",
        high.alias("recommended_review"),
        F.when(high, "review_turnaround_and_crew_buffer").otherwise("monitor").alias("suggested_action"),
    )


def risk_band_summary(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("risk_band").agg(F.count(F.lit(1)).alias("prediction_count"))


def load_factor(passengers: Column, capacity: Column) -> Column:
    return safe_divide(passengers, capacity)
