"""Disruption features, component scores, severity, alerts and roll-ups."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions.columns import (
    array_rank,
    band_case,
    band_threshold,
    count_when,
    rank_of,
    round6,
    safe_divide,
    sha_id,
)
from contrail.operators.history import prior_pressure
from contrail.operators.intervals import airport_event_exposure, weather_exposure
from contrail.operators.picks import latest_observation, pick_first, pick_last, topk_global

# Component names with their labels and weights, bands, priorities and review texts.
COMPONENT_LABELS = {
    "delay": "delay evidence",
    "weather": "weather impact",
    "airport_events": "airport event impact",
    "crew": "crew readiness",
    "aircraft_health": "aircraft health evidence",
    "passenger_pressure": "passenger pressure",
    "network_reactionary": "network reactionary pressure",
}
WEIGHTS = {
    "delay": 0.25,
    "weather": 0.15,
    "airport_events": 0.15,
    "crew": 0.15,
    "aircraft_health": 0.10,
    "passenger_pressure": 0.10,
    "network_reactionary": 0.10,
}
RISK_BANDS = ((0.0, 0.3, "low"), (0.3, 0.6, "medium"), (0.6, 0.8, "high"), (0.8, 1.0, "severe"))
PRIORITIES = ((0.0, 0.3, "monitor"), (0.3, 0.6, "review"), (0.6, 0.8, "prioritise"), (0.8, 1.0, "urgent_review"))
PRIORITY_ORDER = ("monitor", "review", "prioritise", "urgent_review")
ACTIONS = (
    (0.75, "Prioritise human operational review; do not treat as autonomous recovery instruction."),
    (0.5, "Review operational evidence and passenger-care implications."),
    (0.25, "Assess crew, aircraft, weather, airport, and passenger evidence."),
)
DEFAULT_ACTION = "Monitor synthetic disruption evidence."
NO_DRIVER = "no elevated component"
WARNING = "Synthetic decision-support evidence only; not real disruption-management tooling."


@dataclass(frozen=True)
class DisruptionSettings:
    """Scales of the components. Fixed default values."""

    severe_delay_minutes: float = 60.0
    high_load_factor: float = 0.90
    high_capacity_reduction: float = 40.0
    high_connection_risk_minutes: float = 45.0
    high_reactionary_minutes: float = 30.0
    review_at: float = 0.25
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    risk_bands: tuple[tuple[float, float, str], ...] = RISK_BANDS
    priorities: tuple[tuple[float, float, str], ...] = PRIORITIES
    use_forward: bool = True
    use_retrospective: bool = True
    maximum_alerts: int = 100


DEFAULTS = DisruptionSettings()


def disruption_features(
    flights: DataFrame,
    delays: DataFrame,
    crew: DataFrame,
    weather: DataFrame,
    airport_events: DataFrame,
    demand: DataFrame,
    health: DataFrame,
    *,
    forecast: DataFrame | None = None,
    delay_predictions: DataFrame | None = None,
    maintenance: DataFrame | None = None,
    demand_ties: tuple[str, ...] = (),
    crew_order: str = "crew_assignment_id",
) -> DataFrame:
    """One row per scheduled flight: outcomes, exposure at departure, crew, bookings, health and earlier pressure.

    Of several crew rows for a flight the last by ``crew_order`` counts; equal booking observations are ordered by
    ``demand_ties``.
    """
    base = flights.select(
        "flight_id",
        "flight_number",
        "route_id",
        "operating_date",
        "scheduled_departure_utc",
        "origin_airport",
        "destination_airport",
        "aircraft_id",
        "aircraft_type",
        F.col("seat_capacity").cast("double").alias("seat_capacity"),
        "service_type",
        "schedule_status",
    )
    outcome = delays.select(
        "flight_id",
        "departure_delay_minutes",
        "arrival_delay_minutes",
        "delay_category",
        "cancelled_flag",
        "diverted_flag",
        "reactionary_delay_minutes",
        F.lit(True).alias("_outcome"),
    )
    crew_state = pick_last(
        crew,
        ["flight_id"],
        [F.col(crew_order)],
        [
            "captain_available",
            "first_officer_available",
            "cabin_crew_required",
            "cabin_crew_assigned",
            "reserve_crew_used",
            "connection_risk_minutes",
            "crew_disruption_flag",
        ],
    )
    newest = pick_first(
        health.filter(F.col("flight_id").isNotNull()),
        ["flight_id"],
        [-F.unix_micros("event_timestamp_utc"), F.col("telemetry_id")],
        ["maintenance_risk_score"],
    ).withColumnRenamed("maintenance_risk_score", "_source_risk")
    at_departure = base.select("flight_id", "scheduled_departure_utc", "origin_airport", "destination_airport")
    pressure = prior_pressure(
        base.select("flight_id", "route_id", "operating_date", "scheduled_departure_utc").join(
            outcome.select("flight_id", "departure_delay_minutes"), "flight_id", "left"
        )
    ).select("flight_id", "prior_route_delay_pressure", "same_day_route_disruption_count")
    sources = [
        outcome,
        crew_state,
        latest_observation(demand, ["expected_final_passengers"], tie_breakers=demand_ties),
        newest,
        weather_exposure(at_departure, weather, at="scheduled_departure_utc"),
        airport_event_exposure(at_departure, airport_events, at="scheduled_departure_utc"),
        pressure,
    ]
    derived = dict(FEATURE_SQL)
    for source, columns in (
        (forecast, FORECAST_SQL),
        (delay_predictions, PREDICTION_SQL),
        (maintenance, MAINTENANCE_SQL),
    ):
        if source is None:
            derived.update({name: missing for name, (_, missing) in columns.items()})
        else:
            prefix = columns["_prefix"][0]
            needed = {c for c in source.columns if any(f"{prefix}{c}" in sql for sql, _ in columns.values())}
            sources.append(
                source.select(
                    "flight_id",
                    *[F.col(c).alias(f"{prefix}{c}") for c in sorted(needed - {"flight_id"})],
                    F.lit(True).alias(f"{prefix}used"),
                )
            )
            derived.update({name: present for name, (present, _) in columns.items()})
    derived.pop("_prefix", None)
    df = base
    for source in sources:
        df = df.join(source, "flight_id", "left")
    kept = [c for c in base.columns if c not in derived]
    return df.selectExpr(*kept, *[f"{sql} AS {name}" for name, sql in derived.items()]).selectExpr(
        "*", *[f"{sql} AS {name}" for name, sql in FLAG_SQL.items()]
    )


def _number(name: str, default: str = "0") -> str:
    return f"coalesce(cast({name} AS double), {default}.0D)"


def _flag(name: str, default: str = "false") -> str:
    return f"coalesce({name}, {default})"


FEATURE_SQL = {
    "delay_outcome_available": _flag("_outcome"),
    "departure_delay_minutes": _number("departure_delay_minutes"),
    "arrival_delay_minutes": _number("arrival_delay_minutes"),
    "delay_category": "coalesce(delay_category, '')",
    "cancelled_flag": _flag("cancelled_flag"),
    "diverted_flag": _flag("diverted_flag"),
    "reactionary_delay_minutes": _number("reactionary_delay_minutes"),
    "captain_available": _flag("captain_available", "true"),
    "first_officer_available": _flag("first_officer_available", "true"),
    "cabin_crew_required": _number("cabin_crew_required"),
    "cabin_crew_assigned": _number("cabin_crew_assigned"),
    "reserve_crew_used": _flag("reserve_crew_used"),
    "connection_risk_minutes": _number("connection_risk_minutes"),
    "crew_disruption_flag": _flag("crew_disruption_flag"),
    "crew_shortage_flag": f"{_number('cabin_crew_assigned')} < {_number('cabin_crew_required')}",
    "expected_final_passengers": _number("expected_final_passengers"),
    "latest_booking_load_factor": f"{_number('expected_final_passengers')} / greatest(1.0D, seat_capacity)",
    "source_maintenance_risk_score": f"{_number('_source_risk')} / 100.0D",
    "max_weather_impact_score": f"{_number('weather_max_impact_score')} / 100.0D",
    "origin_weather_event_count": _number("origin_weather_event_count"),
    "destination_weather_event_count": _number("destination_weather_event_count"),
    "severe_weather_flag": f"{_number('weather_max_severity')} >= 4",
    "weather_exposure_flag": f"{_number('weather_event_count')} > 0",
    "airport_event_count": _number("airport_event_count"),
    "maximum_airport_event_severity": _number("airport_max_severity"),
    "maximum_capacity_reduction_percent": _number("airport_max_capacity_reduction"),
    "estimated_airport_event_delay": _number("airport_max_estimated_delay"),
    "airport_event_exposure_flag": f"{_number('airport_event_count')} > 0",
    "prior_route_delay_pressure": "prior_route_delay_pressure",
    "same_day_route_disruption_count": "same_day_route_disruption_count",
}
# Per optional source: output column -> (expression when supplied, constant when not).
FORECAST_SQL = {
    "_prefix": ("_pf_", ""),
    "optional_passenger_forecast_used": (_flag("_pf_used"), "false"),
    "forecast_passengers": (_number("_pf_forecast_passengers"), "0.0D"),
    "forecast_load_factor": (f"{_number('_pf_forecast_passengers')} / greatest(1.0D, seat_capacity)", "0.0D"),
    "demand_uncertainty_width": (
        f"{_number('_pf_forecast_upper_95')} - {_number('_pf_forecast_lower_95')}",
        "0.0D",
    ),
    "forecast_constraint_applied": (_flag("_pf_constraint_applied"), "false"),
}
PREDICTION_SQL = {
    "_prefix": ("_dp_", ""),
    "optional_delay_prediction_used": (_flag("_dp_used"), "false"),
    "predicted_delay_probability": (_number("_dp_delay_probability"), "0.0D"),
    "predicted_delay_minutes": (_number("_dp_estimated_delay_minutes"), "0.0D"),
    "predicted_delay_risk_band": ("coalesce(_dp_risk_band, '')", "''"),
}
MAINTENANCE_SQL = {
    "_prefix": ("_mr_", ""),
    "optional_maintenance_analytics_used": (_flag("_mr_used"), "false"),
    "maintenance_risk_score": (_number("_mr_maintenance_risk_score"), "0.0D"),
    "aircraft_health_score": (_number("_mr_aircraft_health_score", "1"), "1.0D"),
    "maintenance_alert_category": ("coalesce(_mr_alert_category, '')", "''"),
}
FLAG_SQL = {
    "weather_disruption_flag": "weather_exposure_flag",
    "airport_disruption_flag": "airport_event_exposure_flag",
    "aircraft_disruption_flag": "source_maintenance_risk_score > 0.6D OR maintenance_risk_score > 0.6D",
    "passenger_pressure_flag": "latest_booking_load_factor > 0.9D OR forecast_load_factor > 0.9D",
    "network_reactionary_flag": "reactionary_delay_minutes > 0 OR prior_route_delay_pressure > 0.5D",
}


def component_sql(settings: DisruptionSettings = DEFAULTS) -> dict[str, str]:
    """The seven components, each the largest of its scaled signals within [0, 1]."""
    signals = {
        "delay": (
            "predicted_delay_probability",
            f"departure_delay_minutes / {settings.severe_delay_minutes}D",
            "if(cancelled_flag OR diverted_flag, 1.0D, 0.0D)",
        ),
        "weather": ("max_weather_impact_score", "if(severe_weather_flag, 0.7D, 0.0D)"),
        "airport_events": (
            f"maximum_capacity_reduction_percent / {max(1.0, settings.high_capacity_reduction)}D",
            "estimated_airport_event_delay / 60.0D",
            "maximum_airport_event_severity / 5.0D",
        ),
        "crew": (
            "if(NOT captain_available OR NOT first_officer_available, 1.0D, 0.0D)",
            "if(crew_shortage_flag, 0.8D, 0.0D)",
            "if(reserve_crew_used, 0.5D, 0.0D)",
            f"connection_risk_minutes / {max(1.0, settings.high_connection_risk_minutes)}D",
            "if(crew_disruption_flag, 0.7D, 0.0D)",
        ),
        "aircraft_health": (
            "source_maintenance_risk_score",
            "maintenance_risk_score",
            "if(optional_maintenance_analytics_used, 1.0D - aircraft_health_score, 0.0D)",
        ),
        "passenger_pressure": (
            f"latest_booking_load_factor / {max(0.01, settings.high_load_factor)}D",
            f"forecast_load_factor / {max(0.01, settings.high_load_factor)}D",
            "demand_uncertainty_width / greatest(1.0D, seat_capacity)",
        ),
        "network_reactionary": (
            f"reactionary_delay_minutes / {max(1.0, settings.high_reactionary_minutes)}D",
            "prior_route_delay_pressure",
            "same_day_route_disruption_count / 4.0D",
        ),
    }
    return {name: f"least(1.0D, greatest(0.0D, {', '.join(parts)}))" for name, parts in signals.items()}


def disruption_components(features: DataFrame, settings: DisruptionSettings = DEFAULTS) -> DataFrame:
    """Add ``<component>_component_score`` columns."""
    return features.selectExpr(
        "*", *[f"{sql} AS {name}_component_score" for name, sql in component_sql(settings).items()]
    )


def _weighted(parts: Mapping[str, str], weights: Mapping[str, float]) -> str:
    total = " + ".join(f"{parts[name]} * {float(weight)}D" for name, weight in weights.items())
    return f"least(1.0D, greatest(0.0D, {total}))"


def disruption_severity(features: DataFrame, settings: DisruptionSettings = DEFAULTS) -> DataFrame:
    """Add component, forward, retrospective and severity scores, bands, driver and review columns."""
    names = {name: f"{name}_component_score" for name in COMPONENT_LABELS}
    forward = {
        **names,
        "delay": "greatest(predicted_delay_probability, prior_route_delay_pressure)",
        "network_reactionary": "prior_route_delay_pressure",
    }
    scored = disruption_components(features, settings).selectExpr(
        "*", f"{_weighted(forward, settings.weights)} AS _forward", f"{_weighted(names, settings.weights)} AS _retro"
    )
    used = [n for n, on in (("_forward", settings.use_forward), ("_retro", settings.use_retrospective)) if on]
    severity = F.col("_severity")
    return (
        scored.withColumn("_severity", F.expr(f"least(1.0D, greatest(0.0D, 0.0D, {', '.join(used)}))" if used else "0.0D"))
        .withColumn("contributing_factors", array_rank({n: F.col(c) for n, c in names.items()}, COMPONENT_LABELS))
        .withColumns(
            {
                "forward_disruption_risk_score": round6("_forward"),
                "retrospective_disruption_score": round6("_retro"),
                "disruption_severity_score": round6(severity),
                "disruption_risk_band": band_case(severity, settings.risk_bands),
                "recovery_priority": band_case(severity, settings.priorities),
                "primary_disruption_driver": F.coalesce(F.get("contributing_factors", F.lit(0)), F.lit(NO_DRIVER)),
                "recommended_review_action": band_threshold(severity, ACTIONS, DEFAULT_ACTION),
                "human_review_required": severity >= settings.review_at,
            }
        )
        .drop("_forward", "_retro", "_severity")
    )


def disruption_alerts(scores: DataFrame, run_id: str, settings: DisruptionSettings = DEFAULTS) -> DataFrame:
    """The most severe flights for review, at most ``maximum_alerts``."""
    top = topk_global(
        scores.filter("human_review_required"),
        [F.col("disruption_severity_score").desc(), F.col("scheduled_departure_utc"), F.col("flight_id")],
        settings.maximum_alerts,
    )
    return top.select(
        sha_id(
            "DISR-",
            [F.lit(run_id), F.col("flight_id"), F.col("disruption_risk_band"), F.col("recovery_priority")],
            12,
        ).alias("alert_id"),
        "flight_id",
        "route_id",
        "operating_date",
        "origin_airport",
        "destination_airport",
        "disruption_severity_score",
        "disruption_risk_band",
        "recovery_priority",
        "primary_disruption_driver",
        "contributing_factors",
        "recommended_review_action",
        F.lit(True).alias("human_review_required"),
        F.struct(
            "departure_delay_minutes", "max_weather_impact_score", "connection_risk_minutes", "maintenance_risk_score"
        ).alias("evidence_fields"),
        F.lit(WARNING).alias("synthetic_data_warning"),
    )


# ---------------------------------------------------------------- roll-ups


def severe_or_high() -> Column:
    return count_when(F.col("disruption_risk_band").isin("high", "severe"))


def group_rollup(scores: DataFrame, key: str, measures: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Per key: the measures, the dominant driver (ties to the smallest name) and the highest review priority.

    The scores are read once: partial results per (key, driver) are merged to the key, so finding the most frequent
    driver costs no second pass. Kinds: count (of true), sum, max, avg.
    """
    first: list[Column] = [F.count(F.lit(1)).alias("_n")]
    second: list[Column] = []
    for name, (kind, expr) in measures.items():
        if kind == "count":
            first.append(count_when(expr).alias(f"_{name}"))
            second.append(F.sum(f"_{name}").alias(name))
        elif kind == "avg":
            first += [F.sum(expr).alias(f"_s_{name}"), F.count(expr).alias(f"_c_{name}")]
            second.append(F.try_divide(F.sum(f"_s_{name}"), F.sum(f"_c_{name}")).alias(name))
        else:
            merge = F.sum if kind == "sum" else F.max
            first.append(merge(expr).alias(f"_{name}"))
            second.append(merge(f"_{name}").alias(name))
    rank = F.struct(rank_of("recovery_priority", PRIORITY_ORDER).alias("r"), F.col("recovery_priority").alias("l"))
    per_driver = scores.groupBy(key, "primary_disruption_driver").agg(*first, F.max(rank).alias("_p"))
    driver = F.col("primary_disruption_driver")
    return per_driver.groupBy(key).agg(
        F.sum("_n").alias("flight_count"),
        *second,
        F.min_by(driver, F.struct(-F.col("_n"), driver)).alias("dominant_disruption_driver"),
        F.max("_p")["l"].alias("review_priority"),
    )


def _score_stats() -> dict[str, tuple[str, Column]]:
    return {
        "average_disruption_score": ("avg", F.col("disruption_severity_score")),
        "maximum_disruption_score": ("max", F.col("disruption_severity_score")),
    }


def _high() -> dict[str, tuple[str, Column]]:
    return {"severe_or_high_count": ("count", F.col("disruption_risk_band").isin("high", "severe"))}


def _cancellations() -> dict[str, tuple[str, Column]]:
    return {
        "cancellation_count": ("count", F.col("cancelled_flag")),
        "diversion_count": ("count", F.col("diverted_flag")),
    }


def route_summary(scores: DataFrame) -> DataFrame:
    delay = {"average_delay_minutes": ("avg", F.col("departure_delay_minutes"))}
    return group_rollup(scores, "route_id", {**_score_stats(), **_high(), **_cancellations(), **delay})


def both_ends(df: DataFrame) -> DataFrame:
    """Each flight once as a departure and once as an arrival of its airports."""
    ends = F.array(
        F.struct(F.lit("dep").alias("end"), F.col("origin_airport").alias("airport_code")),
        F.struct(F.lit("arr").alias("end"), F.col("destination_airport").alias("airport_code")),
    )
    return df.select("*", F.inline(ends))


def airport_summary(scores: DataFrame) -> DataFrame:
    """Per airport; a flight counts at its origin and at its destination."""
    measures = {
        "departure_flight_count": ("count", F.col("end") == "dep"),
        "arrival_flight_count": ("count", F.col("end") == "arr"),
        **_score_stats(),
        "weather_event_count": (
            "sum",
            F.col("origin_weather_event_count") + F.col("destination_weather_event_count"),
        ),
        "airport_event_count": ("sum", F.col("airport_event_count")),
        **_high(),
    }
    return group_rollup(both_ends(scores), "airport_code", measures).drop("flight_count")


def aircraft_disruption_summary(scores: DataFrame) -> DataFrame:
    measures = {
        **_score_stats(),
        "aircraft_type": ("max", F.col("aircraft_type")),
        "maintenance_related_count": ("count", F.col("aircraft_health_component_score") > 0),
        "reactionary_delay_count": ("count", F.col("network_reactionary_component_score") > 0),
    }
    return group_rollup(scores, "aircraft_id", measures)


def daily_summary(scores: DataFrame) -> DataFrame:
    """Per day; alert_count is the number of flights for review, not of those that fit an alert table."""
    review = {"alert_count": ("count", F.col("human_review_required"))}
    return group_rollup(scores, "operating_date", {**_score_stats(), **_high(), **_cancellations(), **review})


def component_summary(scores: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Average and maximum per component, from one aggregate row turned to long form."""
    row = scores.agg(
        *[F.avg(c).alias(f"a_{n}") for n, c in columns.items()], *[F.max(c).alias(f"m_{n}") for n, c in columns.items()]
    )
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("component"), F.col(f"a_{n}").alias("average"), F.col(f"m_{n}").alias("maximum"))
            for n in sorted(columns)
        ]
    )
    return row.select(F.explode(entries).alias("_e")).select("_e.*")


def label_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("row_count"))


def metric_rows(row: DataFrame, metrics: list[tuple[str, str, Column, Column, Column]]) -> DataFrame:
    """Long metric rows (category, name, value, numerator, denominator) of one aggregate row."""
    entries = F.array(
        *[
            F.struct(
                F.lit(category).alias("metric_category"),
                F.lit(name).alias("metric_name"),
                value.cast("double").alias("metric_value"),
                top.cast("double").alias("numerator"),
                bottom.cast("double").alias("denominator"),
                F.lit("passed").alias("status"),
            )
            for category, name, value, top, bottom in metrics
        ]
    )
    return row.select(F.explode(entries).alias("_m")).select("_m.*")


def disruption_metrics(scores: DataFrame) -> DataFrame:
    row = scores.agg(
        F.count(F.lit(1)).alias("n"),
        severe_or_high().alias("bad"),
        count_when(F.col("human_review_required")).alias("alerts"),
    )
    n, bad, found = F.col("n"), F.col("bad"), F.col("alerts")
    return metric_rows(
        row,
        [
            ("volume", "flight_count", n, n, n),
            ("alerts", "alert_count", found, found, n),
            ("risk", "high_or_severe_rate", safe_divide(bad, n), bad, n),
        ],
    )
