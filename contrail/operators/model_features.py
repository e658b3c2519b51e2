"""Model rows for demand and delay models, holding only what was known at prediction time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.columns import shift_minutes
from contrail.operators.history import prior_mean, prior_rate, prior_rate_strict
from contrail.operators.intervals import airport_event_exposure, weather_exposure
from contrail.operators.picks import (
    asof_latest,
    exclusions_ledger,
    filter_include_exclude,
    filter_min_group_size,
    horizon_pick,
    pick_last,
)
from contrail.session import materialize

DEMAND_NUMERIC = (
    "booked_passengers",
    "booking_velocity",
    "cancellations_to_date",
    "day_of_week",
    "days_before_departure",
    "fare_discount",
    "fare_flex",
    "fare_standard",
    "group_booking_count",
    "historical_route_load_factor",
    "historical_route_mean",
    "historical_route_observations",
    "month",
    "seat_capacity",
    "weekend_flag",
)
DEMAND_CATEGORICAL = ("demand_segment", "route_id")
DELAY_NUMERIC = (
    "airport_event_count",
    "airport_max_capacity_reduction",
    "airport_max_severity",
    "cabin_crew_gap",
    "captain_available",
    "connection_risk_minutes",
    "cycles_since_maintenance",
    "day_of_week",
    "departure_hour",
    "first_officer_available",
    "flight_hours_since_maintenance",
    "historical_aircraft_delay_rate",
    "historical_destination_delay_rate",
    "historical_origin_delay_rate",
    "historical_route_delay_rate",
    "historical_route_mean_delay",
    "historical_route_observations",
    "maintenance_risk_score",
    "month",
    "reserve_crew_used",
    "scheduled_block_minutes",
    "seat_capacity",
    "weather_event_count",
    "weather_max_impact_score",
    "weather_max_severity",
    "weekend_flag",
)
DELAY_CATEGORICAL = ("aircraft_type", "destination_airport", "origin_airport")
# Columns only known after departure; a feature list must not name them.
OUTCOMES = ("target", "delay_minutes", "departure_delay_minutes", "actual_departure_utc", "actual_arrival_utc")


def fare_mix(demand: DataFrame, column: str = "fare_class_mix") -> DataFrame:
    """Three shares out of the JSON fare mix; absent classes are zero."""
    return demand.withColumns(
        {
            f"fare_{part}": F.coalesce(F.get_json_object(column, f"$.{part}").try_cast("double"), F.lit(0.0))
            for part in ("discount", "standard", "flex")
        }
    )


def demand_features(
    flights: DataFrame,
    demand: DataFrame,
    *,
    horizon_days: int = 14,
    include_routes: Sequence[str] = (),
    exclude_routes: Sequence[str] = (),
    minimum_route_rows: int = 1,
    tie_breakers: Sequence[str] = (),
    legacy_history: bool = False,
) -> DataFrame:
    """One row per flight: the booking observation at the horizon, calendar columns and earlier route history."""
    columns = [
        "observation_date",
        "days_before_departure",
        "route_id",
        "booked_passengers",
        "booking_velocity",
        "cancellations_to_date",
        "group_booking_count",
        "demand_segment",
        "seat_capacity",
        "fare_discount",
        "fare_standard",
        "fare_flex",
        F.col("expected_final_passengers").cast("double").alias("target"),
    ]
    picked = horizon_pick(demand, horizon_days, columns, tie_breakers=tie_breakers)
    rows = flights.select("flight_id", "operating_date").join(picked, "flight_id")
    rows = filter_include_exclude(rows, "route_id", include_routes, exclude_routes)
    rows = prior_mean(rows, legacy=legacy_history)
    rows = rows.withColumns(
        {
            "observation_id": F.concat_ws(":", "flight_id", F.col("observation_date").cast("string")),
            "day_of_week": F.weekday("operating_date"),
            "month": F.month("operating_date"),
            "weekend_flag": F.when(F.weekday("operating_date") >= 5, 1).otherwise(0),
        }
    )
    return filter_min_group_size(rows, "route_id", minimum_route_rows)


def eligible_delays(
    flights: DataFrame,
    delays: DataFrame,
    *,
    threshold_minutes: int = 15,
    cutoff_minutes: int = 120,
    exclude_cancelled: bool = True,
    include_diverted: bool = True,
) -> DataFrame:
    """Flights with their outcome, target and cutoff, and why a flight cannot be modelled (``exclusion_reason``)."""
    outcome = delays.select(
        "flight_id",
        "departure_delay_minutes",
        "actual_departure_utc",
        "actual_arrival_utc",
        "cancelled_flag",
        "diverted_flag",
        F.lit(True).alias("_outcome"),
    )
    joined = flights.join(outcome, "flight_id", "left")
    marked = exclusions_ledger(
        joined,
        [
            ("missing_delay_history", F.col("_outcome").isNull()),
            ("cancelled", F.lit(exclude_cancelled) & F.col("cancelled_flag")),
            ("diverted", F.lit(not include_diverted) & F.col("diverted_flag")),
            ("missing_actual_departure", F.col("actual_departure_utc").isNull()),
        ],
    )
    late = F.greatest(F.lit(0.0), F.col("departure_delay_minutes").cast("double"))
    return marked.withColumns(
        {
            "delay_minutes": late,
            "target": F.when(late >= threshold_minutes, 1).otherwise(0),
            "prediction_cutoff_utc": shift_minutes("scheduled_departure_utc", -cutoff_minutes),
        }
    ).drop("_outcome")


def exclusion_summary(marked: DataFrame) -> DataFrame:
    """Rows dropped per reason and rows kept."""
    reason = F.coalesce("exclusion_reason", F.lit("modelled_rows"))
    return marked.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("row_count"))


def delay_features(
    flights: DataFrame,
    delays: DataFrame,
    crew: DataFrame,
    weather: DataFrame,
    airport_events: DataFrame,
    health: DataFrame,
    *,
    forecast: DataFrame | None = None,
    strict_cutoff: bool = False,
    crew_order: str = "crew_assignment_id",
    **eligibility: int | bool,
) -> DataFrame:
    """One row per eligible flight with exposure, crew, health and earlier delay rates at the cutoff."""
    marked = eligible_delays(flights, delays, **eligibility).filter("exclusion_reason IS NULL")  # type: ignore[arg-type]
    kept = materialize(
        marked.select(
            "flight_id",
            "route_id",
            "origin_airport",
            "destination_airport",
            "aircraft_id",
            "aircraft_type",
            "operating_date",
            "scheduled_departure_utc",
            "prediction_cutoff_utc",
            "actual_arrival_utc",
            "target",
            "delay_minutes",
            "seat_capacity",
            "scheduled_block_minutes",
        ),
        "kept_delays",
    )
    core = kept.select(
        "flight_id",
        "route_id",
        "origin_airport",
        "destination_airport",
        "aircraft_id",
        "scheduled_departure_utc",
        "prediction_cutoff_utc",
        "actual_arrival_utc",
        "target",
        "delay_minutes",
    )
    dimensions = {
        "route": "route_id",
        "origin": "origin_airport",
        "destination": "destination_airport",
        "aircraft": "aircraft_id",
    }
    rated = prior_rate_strict(core, dimensions) if strict_cutoff else prior_rate(core, dimensions)
    history = rated.select(
        "flight_id",
        F.col("route_rate").alias("historical_route_delay_rate"),
        F.col("route_mean_delay").alias("historical_route_mean_delay"),
        F.col("route_count").alias("historical_route_observations"),
        F.col("origin_rate").alias("historical_origin_delay_rate"),
        F.col("destination_rate").alias("historical_destination_delay_rate"),
        F.col("aircraft_rate").alias("historical_aircraft_delay_rate"),
    )
    crew_state = pick_last(
        crew,
        ["flight_id"],
        [F.col(crew_order)],
        [
            F.col("captain_available").cast("int").alias("captain_available"),
            F.col("first_officer_available").cast("int").alias("first_officer_available"),
            (F.col("cabin_crew_required") - F.col("cabin_crew_assigned")).alias("cabin_crew_gap"),
            F.col("reserve_crew_used").cast("int").alias("reserve_crew_used"),
            "connection_risk_minutes",
        ],
    )
    readings = asof_latest(
        health,
        core,
        ["maintenance_risk_score", "cycles_since_maintenance", "flight_hours_since_maintenance", "health_status"],
    ).withColumnRenamed("health_status", "aircraft_health_status")
    at_cutoff = core.select("flight_id", "prediction_cutoff_utc", "origin_airport", "destination_airport")
    storms = weather_exposure(at_cutoff, weather, at="prediction_cutoff_utc").drop(
        "origin_weather_event_count", "destination_weather_event_count"
    )
    disruptions = airport_event_exposure(at_cutoff, airport_events, at="prediction_cutoff_utc").drop(
        "airport_max_estimated_delay"
    )
    df = kept.select(
        "flight_id",
        "route_id",
        "origin_airport",
        "destination_airport",
        "aircraft_id",
        "aircraft_type",
        "operating_date",
        "scheduled_departure_utc",
        "prediction_cutoff_utc",
        "target",
        "delay_minutes",
        "seat_capacity",
        "scheduled_block_minutes",
        F.hour("scheduled_departure_utc").alias("departure_hour"),
        F.weekday("operating_date").alias("day_of_week"),
        F.month("operating_date").alias("month"),
        F.when(F.weekday("operating_date") >= 5, 1).otherwise(0).alias("weekend_flag"),
    )
    for source in (history, crew_state, readings, storms, disruptions):
        df = df.join(source, "flight_id", "left")
    df = df.na.fill(0.0, ["weather_max_severity", "weather_max_impact_score"]).na.fill(
        0.0, ["airport_max_severity", "airport_max_capacity_reduction"]
    )
    df = df.na.fill(0, ["weather_event_count", "airport_event_count"]).withColumns(
        {
            "weather_exposure_flag": F.when(F.col("weather_event_count") > 0, 1).otherwise(0),
            "airport_event_exposure_flag": F.when(F.col("airport_event_count") > 0, 1).otherwise(0),
        }
    )
    if forecast is None:
        return df
    booked = forecast.select(
        "flight_id",
        "forecast_passengers",
        (F.col("forecast_upper_95") - F.col("forecast_lower_95")).alias("forecast_uncertainty_width_95"),
        F.col("constraint_applied").cast("int").alias("forecast_constraint_applied"),
    )
    return df.join(booked, "flight_id", "left").withColumn(
        "forecast_load_factor", F.col("forecast_passengers") / F.greatest(F.lit(1), "seat_capacity")
    )


def assert_no_outcomes(features: Sequence[str]) -> None:
    """Refuse a feature list that names a column only known after departure."""
    leaked = sorted(set(features) & set(OUTCOMES))
    if leaked:
        raise ValueError(f"features leak outcomes: {', '.join(leaked)}")
