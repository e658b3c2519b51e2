"""Star schema: dimensions, facts, KPI tables, measures, performance summaries, quality gates, dictionary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.functions.columns import count_when, nz, rank_of, round6, safe_divide, surrogate_key, truthy
from contrail.operators.disruption import both_ends
from contrail.operators.findings import union_all
from contrail.operators.monitoring import SEVERITY_ORDER, highest_severity
from contrail.operators.picks import dominant_value, pick_last

# Band ranks, thresholds, required tables and keys.
RISK_BANDS = ("low", "medium", "high", "severe")
REQUIRED_TABLES = (
    "dim_date dim_airport dim_route dim_aircraft dim_service_type dim_risk_band dim_disruption_driver "
    "fact_flight_operations fact_passenger_demand fact_disruption_score fact_monitoring_metric fact_monitoring_alert "
    "kpi_executive_summary kpi_operations_summary kpi_delay_summary kpi_demand_summary kpi_maintenance_summary "
    "kpi_disruption_summary kpi_data_quality_summary kpi_monitoring_summary route_performance_summary "
    "airport_performance_summary aircraft_performance_summary daily_operations_summary"
).split()
DIMENSIONS = tuple(t for t in REQUIRED_TABLES if t.startswith("dim_"))
PRIMARY_KEYS = {
    "dim_date": ("date",),
    "dim_airport": ("airport_code",),
    "dim_route": ("route_id",),
    "dim_aircraft": ("aircraft_id",),
    "dim_service_type": ("service_type",),
    "dim_risk_band": ("risk_band",),
    "dim_disruption_driver": ("primary_disruption_driver",),
    "fact_flight_operations": ("flight_id",),
    "fact_disruption_score": ("flight_id",),
    "fact_maintenance_risk": ("flight_id",),
    "fact_delay_prediction": ("flight_id",),
    "fact_monitoring_metric": ("monitoring_domain", "metric_name"),
    "fact_monitoring_alert": ("monitoring_alert_id",),
    "fact_assistant_response": ("assistant_run_id", "section_order"),
}
# Name, fact, its column, dimension, the dimension's column.
REFERENCES = (
    ("route", "fact_flight_operations", "route_id", "dim_route", "route_id"),
    ("aircraft", "fact_flight_operations", "aircraft_id", "dim_aircraft", "aircraft_id"),
    ("origin", "fact_flight_operations", "origin_airport", "dim_airport", "airport_code"),
    ("destination", "fact_flight_operations", "destination_airport", "dim_airport", "airport_code"),
    ("date", "fact_flight_operations", "operating_date", "dim_date", "date"),
    ("score-route", "fact_disruption_score", "route_id", "dim_route", "route_id"),
    ("score-date", "fact_disruption_score", "operating_date", "dim_date", "date"),
    ("score-band", "fact_disruption_score", "disruption_risk_band", "dim_risk_band", "risk_band"),
    ("score-driver", "fact_disruption_score", "primary_disruption_driver", "dim_disruption_driver", "primary_disruption_driver"),
    ("delay-route", "fact_delay_prediction", "route_id", "dim_route", "route_id"),
    ("delay-date", "fact_delay_prediction", "operating_date", "dim_date", "date"),
    ("forecast-route", "fact_passenger_forecast", "route_id", "dim_route", "route_id"),
    ("forecast-date", "fact_passenger_forecast", "operating_date", "dim_date", "date"),
    ("risk-aircraft", "fact_maintenance_risk", "aircraft_id", "dim_aircraft", "aircraft_id"),
)


@dataclass(frozen=True)
class KpiThresholds:
    """Limits shown with the KPIs. Fixed default values."""

    high_delay_rate: float = 0.25
    severe_disruption_rate: float = 0.20
    high_maintenance_risk_rate: float = 0.20
    invalid_rate: float = 0.01
    alert_rate: float = 0.10


DEFAULTS = KpiThresholds()


# ---------------------------------------------------------------- dimensions


def dim_date(dated: DataFrame, column: str = "operating_date") -> DataFrame:
    """One row per day from the first to the last date in the column, Monday being day one of the week."""
    range_ = dated.agg(F.to_date(F.min(column)).alias("first"), F.to_date(F.max(column)).alias("last"))
    days = range_.select(F.explode(F.sequence("first", "last")).alias("date"))
    return days.select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.day("date").alias("day"),
        (F.weekday("date") + 1).alias("day_of_week"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.quarter("date").alias("quarter"),
        F.lit("semantic_model").alias("source_domain"),
    )


def dim_airport(flights: DataFrame) -> DataFrame:
    codes = flights.select(F.explode(F.array("origin_airport", "destination_airport")).alias("airport_code")).distinct()
    return codes.select(
        surrogate_key("AIRPORT", "airport_code").alias("airport_key"),
        "airport_code",
        F.col("airport_code").alias("airport_name"),
        F.lit("SYN").alias("country_code"),
    )


def dim_route(flights: DataFrame) -> DataFrame:
    """Distinct routes; the ends are the first and last part of a dashed id, blank without a dash."""
    parts = F.split("route_id", "-")
    dashed = F.col("route_id").contains("-")
    return flights.select("route_id").distinct().select(
        surrogate_key("ROUTE", "route_id").alias("route_key"),
        "route_id",
        F.when(dashed, F.element_at(parts, 1)).otherwise("").alias("origin_airport"),
        F.when(dashed, F.element_at(parts, -1)).otherwise("").alias("destination_airport"),
    )


def dim_aircraft(flights: DataFrame, health: DataFrame, order: str = "scheduled_departure_utc") -> DataFrame:
    """Scheduled aircraft (their last row counts), then aircraft known from telemetry only, with no seats."""
    scheduled = pick_last(
        flights, ["aircraft_id"], [F.col(order), F.col("flight_id")], ["aircraft_type", "seat_capacity"]
    )
    others = health.join(scheduled, "aircraft_id", "left_anti").groupBy("aircraft_id").agg(
        F.min("aircraft_type").alias("aircraft_type"), F.lit(0).cast("bigint").alias("seat_capacity")
    )
    both = scheduled.withColumn("seat_capacity", F.col("seat_capacity").cast("bigint")).unionByName(others)
    return both.select(
        surrogate_key("AIRCRAFT", "aircraft_id").alias("aircraft_key"), "aircraft_id", "aircraft_type", "seat_capacity"
    )


def _labels(df: DataFrame, column: str) -> DataFrame:
    label = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("Unknown"))
    return df.select(label.alias(column)).distinct()


def dim_service_type(flights: DataFrame) -> DataFrame:
    return _labels(flights, "service_type").select(
        surrogate_key("SERVICE", "service_type").alias("service_type_key"),
        "service_type",
        F.col("service_type").alias("service_category"),
    )


def dim_risk_band(scores: DataFrame) -> DataFrame:
    """Observed and fixed bands; unknown bands rank zero."""
    fixed = scores.sparkSession.createDataFrame([(b,) for b in RISK_BANDS], "risk_band string")
    seen = scores.select(F.col("disruption_risk_band").alias("risk_band")).filter("coalesce(risk_band, '') <> ''")
    bands = seen.distinct().union(fixed).distinct()
    known = F.col("risk_band").isin(*RISK_BANDS)
    return bands.select(
        surrogate_key("RISK", "risk_band").alias("risk_band_key"),
        "risk_band",
        F.when(known, rank_of("risk_band", RISK_BANDS) + 1).otherwise(0).alias("risk_rank"),
    )


def dim_disruption_driver(scores: DataFrame) -> DataFrame:
    return _labels(scores, "primary_disruption_driver").select(
        surrogate_key("DRIVER", "primary_disruption_driver").alias("disruption_driver_key"),
        "primary_disruption_driver",
        F.col("primary_disruption_driver").alias("driver_category"),
    )


# ---------------------------------------------------------------- facts


def fact_flight_operations(flights: DataFrame, delays: DataFrame) -> DataFrame:
    outcome = delays.select(
        "flight_id",
        "departure_delay_minutes",
        "arrival_delay_minutes",
        "cancelled_flag",
        "diverted_flag",
        "primary_delay_cause",
        "reactionary_delay_minutes",
    )
    return flights.join(outcome, "flight_id", "left").select(
        "flight_id",
        "flight_number",
        "operating_date",
        "scheduled_departure_utc",
        "origin_airport",
        "destination_airport",
        "route_id",
        "aircraft_id",
        "aircraft_type",
        F.coalesce(F.col("seat_capacity").cast("bigint"), F.lit(0)).alias("seat_capacity"),
        round6(nz("departure_delay_minutes")).alias("departure_delay_minutes"),
        round6(nz("arrival_delay_minutes")).alias("arrival_delay_minutes"),
        truthy("cancelled_flag").alias("cancelled_flag"),
        truthy("diverted_flag").alias("diverted_flag"),
        F.coalesce("primary_delay_cause", F.lit("")).alias("primary_delay_cause"),
        round6(nz("reactionary_delay_minutes")).alias("reactionary_delay_minutes"),
    )


def fact_passenger_demand(demand: DataFrame) -> DataFrame:
    """Demand rows; the operating date is read out of the flight id."""
    stamp = F.regexp_extract("flight_id", r"^[^-]*-(\d{8})-", 1)
    dated = F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2))
    return demand.select(
        "flight_id",
        "observation_date",
        F.when(stamp == "", "").otherwise(dated).alias("operating_date"),
        "route_id",
        "days_before_departure",
        "booked_passengers",
        "expected_final_passengers",
        "seat_capacity",
        round6(nz("load_factor")).alias("load_factor"),
        round6(nz("booking_velocity")).alias("booking_velocity"),
    )


def fact_passenger_forecast(forecast: DataFrame) -> DataFrame:
    return forecast.select(
        "flight_id",
        "route_id",
        "operating_date",
        F.col("forecast_passengers").cast("bigint").alias("forecast_passengers"),
        F.col("forecast_lower_80").cast("bigint").alias("forecast_lower_80"),
        F.col("forecast_upper_80").cast("bigint").alias("forecast_upper_80"),
        "actual_passengers",
        round6(safe_divide(F.col("forecast_passengers"), F.col("seat_capacity"))).alias("forecast_load_factor"),
        "absolute_error",
        "partition",
    )


def fact_delay_prediction(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "flight_id",
        "route_id",
        "operating_date",
        "delay_probability",
        truthy("predicted_delay_flag").alias("predicted_delay_flag"),
        "risk_band",
        "estimated_delay_minutes",
        truthy("actual_delay_flag").alias("actual_delay_flag"),
        "actual_delay_minutes",
        "partition",
    )


def fact_maintenance_risk(flight_risk: DataFrame) -> DataFrame:
    return flight_risk.select(
        "flight_id",
        "aircraft_id",
        "aircraft_type",
        "maintenance_risk_score",
        "aircraft_health_score",
        "risk_band",
        "alert_category",
        truthy("human_review_required").alias("human_review_required"),
    )


def fact_disruption_score(scores: DataFrame) -> DataFrame:
    return scores.select(
        "flight_id",
        "route_id",
        "operating_date",
        "disruption_severity_score",
        "forward_disruption_risk_score",
        "retrospective_disruption_score",
        "disruption_risk_band",
        "recovery_priority",
        "primary_disruption_driver",
        *[
            round6(f"{name}_component_score").alias(f"{name}_component_score")
            for name in ("weather", "delay", "crew", "aircraft_health")
        ],
        truthy("human_review_required").alias("human_review_required"),
    )


def fact_monitoring_metric(metrics: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Metric rows; with checks, each metric carries the status and severity of its worst check."""
    base = metrics.select("monitoring_domain", "metric_name", round6("metric_value").alias("metric_value"))
    if checks is None:
        return base.withColumns({"status": F.lit("observed"), "severity": F.lit("info")})
    worst = checks.groupBy("monitoring_domain", "metric_name").agg(
        F.max_by(F.struct("status", "severity"), F.struct(rank_of("severity", SEVERITY_ORDER), F.col("status"))).alias("_w")
    )
    return base.join(worst, ["monitoring_domain", "metric_name"], "left").select(
        *base.columns,
        F.coalesce("_w.status", F.lit("observed")).alias("status"),
        F.coalesce("_w.severity", F.lit("info")).alias("severity"),
    )


def fact_monitoring_alert(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "monitoring_alert_id", "monitoring_domain", "severity", "status", F.col("alert_message").alias("message")
    )


def fact_assistant_response(briefs: DataFrame, guardrails: DataFrame | None = None) -> DataFrame:
    """One row per response section in order, with the response's guardrail status; null when no guardrails ran."""
    rows = briefs.select(
        F.col("request_id").alias("assistant_run_id"), "intent", F.posexplode("sections").alias("section_order", "_s")
    ).select(
        "assistant_run_id",
        "intent",
        (F.col("section_order") + 1).alias("section_order"),
        F.col("_s.heading").alias("section_title"),
        F.col("_s.content").alias("content"),
    )
    if guardrails is None:
        return rows.withColumn("guardrail_status", F.lit(None).cast("string"))
    status = guardrails.groupBy(F.col("response_id").alias("assistant_run_id")).agg(
        F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("passed").alias("guardrail_status")
    )
    return rows.join(status, "assistant_run_id", "left")


# ---------------------------------------------------------------- KPI tables

Kpi = tuple[str, Column, Column | None, Column | None, Column, float | None, str]


def kpi_rows(row: DataFrame, items: Sequence[Kpi]) -> DataFrame:
    """Long KPI rows of one aggregate row. Values are numbers; a label KPI fills ``metric_text`` instead."""
    entries = []
    for name, value, top, bottom, status, threshold, domain in items:
        is_text = name in TEXT_KPIS
        entries.append(
            F.struct(
                F.lit(name).alias("metric_name"),
                (F.lit(None) if is_text else value).cast("double").alias("metric_value"),
                (value if is_text else F.lit(None)).cast("string").alias("metric_text"),
                (F.lit(None) if top is None else top).cast("double").alias("numerator"),
                (F.lit(None) if bottom is None else bottom).cast("double").alias("denominator"),
                status.alias("status"),
                F.lit(threshold).cast("double").alias("threshold"),
                F.lit(domain).alias("source_domain"),
            )
        )
    return row.select(F.inline(F.array(*entries)))


TEXT_KPIS = ("monitoring_highest_severity", "dominant_disruption_driver", "platform_health_status")


def _observed() -> Column:
    return F.lit("observed")


def flight_totals(flights: DataFrame) -> DataFrame:
    return flights.agg(
        F.count(F.lit(1)).alias("n"),
        count_when(F.col("cancelled_flag")).alias("cancelled"),
        count_when(F.col("diverted_flag")).alias("diverted"),
        round6(F.coalesce(F.avg("departure_delay_minutes"), F.lit(0.0))).alias("delay"),
        count_when(F.col("departure_delay_minutes") >= 60).alias("late"),
    )


def disruption_totals(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        count_when(F.col("disruption_risk_band").isin("high", "severe")).alias("severe"),
        round6(F.coalesce(F.avg("disruption_severity_score"), F.lit(0.0))).alias("mean"),
        F.coalesce(F.max("disruption_severity_score"), F.lit(0.0)).alias("top"),
        count_when(F.col("recovery_priority") == "urgent_review").alias("urgent"),
    )


def monitoring_totals(metrics: DataFrame) -> DataFrame:
    """Counts over the monitoring metric fact, and the invalid-record rate out of it."""
    rate = F.max(F.when(F.col("metric_name") == "validation_invalid_record_rate", F.col("metric_value")))
    return metrics.agg(
        F.count(F.lit(1)).alias("n"),
        count_when(F.col("status").isin("failed", "error")).alias("failed"),
        count_when(F.col("status") == "warning").alias("warned"),
        highest_severity(F.max(rank_of("severity", SEVERITY_ORDER))).alias("severity"),
        F.coalesce(rate, F.lit(0.0)).alias("invalid"),
    )


def _nested(row: DataFrame, **others: DataFrame) -> DataFrame:
    """A one-row table with further one-row tables as struct columns."""
    return row.withColumns({name: other.select(F.struct("*")).scalar() for name, other in others.items()})


def kpi_executive_summary(
    flights: DataFrame, scores: DataFrame, metrics: DataFrame, limits: KpiThresholds = DEFAULTS
) -> DataFrame:
    row = _nested(flight_totals(flights), d=disruption_totals(scores), m=monitoring_totals(metrics))
    n, severe, scored = F.col("n"), F.col("d.severe"), F.col("d.n")
    rate, invalid = round6(safe_divide(severe, scored)), F.col("m.invalid")
    return kpi_rows(
        row,
        [
            ("total_flights", n, n, n, F.lit("passed"), None, "validation"),
            ("cancelled_flights", F.col("cancelled"), F.col("cancelled"), n, _observed(), None, "validation"),
            ("diverted_flights", F.col("diverted"), F.col("diverted"), n, _observed(), None, "validation"),
            ("average_departure_delay", F.col("delay"), None, n, _observed(), None, "validation"),
            (
                "severe_disruption_count",
                severe,
                severe,
                scored,
                F.when(rate > limits.severe_disruption_rate, "warning").otherwise("passed"),
                limits.severe_disruption_rate,
                "disruption_scoring",
            ),
            (
                "severe_disruption_rate",
                rate,
                severe,
                scored,
                _observed(),
                limits.severe_disruption_rate,
                "disruption_scoring",
            ),
            ("monitoring_highest_severity", F.col("m.severity"), None, None, _observed(), None, "monitoring"),
            (
                "validation_invalid_record_rate",
                invalid,
                None,
                None,
                F.when(invalid > limits.invalid_rate, "warning").otherwise("passed"),
                limits.invalid_rate,
                "monitoring",
            ),
        ],
    )


def kpi_operations_summary(flights: DataFrame) -> DataFrame:
    n = F.col("n")
    return kpi_rows(
        flight_totals(flights),
        [
            ("total_flights", n, n, n, F.lit("passed"), None, "validation"),
            ("cancelled_flights", F.col("cancelled"), F.col("cancelled"), n, _observed(), None, "validation"),
            ("diverted_flights", F.col("diverted"), F.col("diverted"), n, _observed(), None, "validation"),
        ],
    )


def kpi_delay_summary(flights: DataFrame, predictions: DataFrame, limits: KpiThresholds = DEFAULTS) -> DataFrame:
    predicted = predictions.agg(
        F.count(F.lit(1)).alias("n"),
        count_when(F.col("risk_band").isin("high", "severe")).alias("high"),
        count_when(F.col("predicted_delay_flag") & ~F.col("actual_delay_flag")).alias("false_positive"),
    )
    row = _nested(flight_totals(flights), p=predicted)
    n, late = F.col("n"), F.col("late")
    rate, limit = round6(safe_divide(late, n)), limits.high_delay_rate
    return kpi_rows(
        row,
        [
            ("material_delay_count", late, late, n, _observed(), limit, "validation"),
            (
                "material_delay_rate",
                rate,
                late,
                n,
                F.when(rate > limit, "warning").otherwise("passed"),
                limit,
                "validation",
            ),
            ("average_delay_minutes", F.col("delay"), None, n, _observed(), None, "validation"),
            (
                "delay_prediction_high_risk_count",
                F.col("p.high"),
                None,
                F.col("p.n"),
                _observed(),
                None,
                "delay_prediction",
            ),
            (
                "false_positive_count",
                F.col("p.false_positive"),
                None,
                F.col("p.n"),
                _observed(),
                None,
                "delay_prediction",
            ),
        ],
    )


def kpi_demand_summary(forecast: DataFrame) -> DataFrame:
    row = forecast.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("forecast_passengers"), F.lit(0)).alias("total"),
        round6(F.coalesce(F.avg("forecast_load_factor"), F.lit(0.0))).alias("load"),
        count_when(F.col("forecast_load_factor") > 0.9).alias("tight"),
    )
    n, domain = F.col("n"), "passenger_forecasting"
    return kpi_rows(
        row,
        [
            ("forecast_passenger_count", F.col("total"), None, n, _observed(), None, domain),
            ("average_forecast_load_factor", F.col("load"), None, n, _observed(), None, domain),
            ("capacity_pressure_flight_count", F.col("tight"), None, n, _observed(), None, domain),
        ],
    )


def kpi_maintenance_summary(risk: DataFrame, limits: KpiThresholds = DEFAULTS) -> DataFrame:
    row = risk.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("aircraft_id").alias("aircraft"),
        count_when(F.col("risk_band").isin("high", "critical")).alias("high"),
        F.coalesce(F.max("maintenance_risk_score"), F.lit(0.0)).alias("top"),
        count_when(F.col("human_review_required")).alias("review"),
    )
    n, domain = F.col("n"), "maintenance_analytics"
    return kpi_rows(
        row,
        [
            ("aircraft_count", F.col("aircraft"), None, n, _observed(), None, domain),
            (
                "high_maintenance_risk_count",
                F.col("high"),
                None,
                n,
                _observed(),
                limits.high_maintenance_risk_rate,
                domain,
            ),
            ("max_maintenance_risk_score", F.col("top"), None, n, _observed(), None, domain),
            ("human_review_count", F.col("review"), None, n, _observed(), None, domain),
        ],
    )


def kpi_disruption_summary(scores: DataFrame) -> DataFrame:
    driver = dominant_value(scores.withColumn("_all", F.lit(1)), ["_all"], "primary_disruption_driver", "driver")
    row = disruption_totals(scores).withColumn("driver", driver.select("driver").scalar())
    n, domain = F.col("n"), "disruption_scoring"
    return kpi_rows(
        row,
        [
            ("average_disruption_score", F.col("mean"), None, n, _observed(), None, domain),
            ("max_disruption_score", F.col("top"), None, n, _observed(), None, domain),
            ("urgent_review_count", F.col("urgent"), None, n, _observed(), None, domain),
            (
                "dominant_disruption_driver",
                F.coalesce("driver", F.lit("")),
                None,
                None,
                _observed(),
                None,
                domain,
            ),
        ],
    )


def _failed_status() -> Column:
    return F.when(F.col("failed") == 0, "passed").otherwise("failed")


def kpi_data_quality_summary(metrics: DataFrame, limits: KpiThresholds = DEFAULTS) -> DataFrame:
    failed = F.col("failed")
    return kpi_rows(
        monitoring_totals(metrics),
        [
            (
                "validation_invalid_record_rate",
                F.col("invalid"),
                None,
                None,
                F.lit("passed"),
                limits.invalid_rate,
                "monitoring",
            ),
            ("monitoring_failed_check_count", failed, failed, F.col("n"), _failed_status(), None, "monitoring"),
        ],
    )


def kpi_monitoring_summary(metrics: DataFrame, alerts: DataFrame, limits: KpiThresholds = DEFAULTS) -> DataFrame:
    found = alerts.agg(F.count(F.lit(1)).alias("n"), count_when(F.col("severity") == "critical").alias("critical"))
    row = _nested(monitoring_totals(metrics), a=found)
    n, failed, warned, alerted = F.col("n"), F.col("failed"), F.col("warned"), F.col("a.n")
    domain = "monitoring"
    return kpi_rows(
        row,
        [
            ("check_count", n, n, n, _observed(), None, domain),
            ("failed_check_count", failed, failed, n, _failed_status(), None, domain),
            ("warning_check_count", warned, warned, n, _observed(), None, domain),
            ("alert_count", alerted, alerted, alerted, _observed(), limits.alert_rate, domain),
            ("critical_alert_count", F.col("a.critical"), None, alerted, _observed(), None, domain),
            ("platform_health_status", F.col("severity"), None, None, _observed(), None, domain),
        ],
    )


def kpi_tables(facts: Mapping[str, DataFrame], limits: KpiThresholds = DEFAULTS) -> dict[str, DataFrame]:
    """All eight KPI tables."""
    flights, scores = facts["fact_flight_operations"], facts["fact_disruption_score"]
    metrics, alerts = facts["fact_monitoring_metric"], facts["fact_monitoring_alert"]
    return {
        "kpi_executive_summary": kpi_executive_summary(flights, scores, metrics, limits),
        "kpi_operations_summary": kpi_operations_summary(flights),
        "kpi_delay_summary": kpi_delay_summary(flights, facts["fact_delay_prediction"], limits),
        "kpi_demand_summary": kpi_demand_summary(facts["fact_passenger_forecast"]),
        "kpi_maintenance_summary": kpi_maintenance_summary(facts["fact_maintenance_risk"], limits),
        "kpi_disruption_summary": kpi_disruption_summary(scores),
        "kpi_data_quality_summary": kpi_data_quality_summary(metrics, limits),
        "kpi_monitoring_summary": kpi_monitoring_summary(metrics, alerts, limits),
    }


def measures(facts: Mapping[str, DataFrame]) -> DataFrame:
    """The documented business measures, evaluated: (measure_name, measure_value)."""
    flights = flight_totals(facts["fact_flight_operations"])
    row = _nested(
        flights,
        d=disruption_totals(facts["fact_disruption_score"]),
        a=facts["fact_monitoring_alert"].agg(F.count(F.lit(1)).alias("n")),
        q=monitoring_totals(facts["fact_monitoring_metric"]).select("invalid"),
        m=facts["fact_maintenance_risk"].agg(count_when(F.col("alert_category") != "none").alias("n")),
        f=facts["fact_passenger_forecast"].agg(
            safe_divide(F.sum("absolute_error"), F.sum("actual_passengers")).alias("wape")
        ),
        r=facts["fact_assistant_response"].agg(F.count_distinct("assistant_run_id").alias("n")),
    )
    values = {
        "Total Flights": F.col("n"),
        "Cancelled Flights": F.col("cancelled"),
        "Cancellation Rate": safe_divide(F.col("cancelled"), F.col("n")),
        "Diverted Flights": F.col("diverted"),
        "Average Departure Delay": F.col("delay"),
        "Material Delay Rate": safe_divide(F.col("late"), F.col("n")),
        "Average Disruption Score": F.col("d.mean"),
        "Severe Disruption Rate": safe_divide(F.col("d.severe"), F.col("d.n")),
        "Monitoring Alert Count": F.col("a.n"),
        "Validation Invalid Record Rate": F.col("q.invalid"),
        "Maintenance Alert Count": F.col("m.n"),
        "Forecast WAPE": F.col("f.wape"),
        "Assistant Response Count": F.col("r.n"),
    }
    entries = [
        F.struct(F.lit(k).alias("measure_name"), v.cast("double").alias("measure_value")) for k, v in values.items()
    ]
    return row.select(F.inline(F.array(*entries)))


# ---------------------------------------------------------------- performance summaries


def group_performance_summary(flights: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Per route, aircraft or day: flights, cancellations, delay and disruption."""
    scored = scores.select("flight_id", "disruption_severity_score", "disruption_risk_band")
    return (
        flights.select("flight_id", key, "cancelled_flag", "departure_delay_minutes")
        .join(scored, "flight_id", "left")
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("flight_count"),
            count_when(F.col("cancelled_flag")).alias("cancelled_flight_count"),
            round6(F.coalesce(F.avg("departure_delay_minutes"), F.lit(0.0))).alias("average_departure_delay"),
            round6(F.coalesce(F.avg("disruption_severity_score"), F.lit(0.0))).alias("average_disruption_score"),
            count_when(F.col("disruption_risk_band").isin("high", "severe")).alias("high_disruption_count"),
        )
    )


def airport_performance_summary(flights: DataFrame) -> DataFrame:
    """Per airport: departures, arrivals, and delay and cancellations of departures."""
    leaving = F.col("end") == "dep"
    return (
        both_ends(flights)
        .groupBy("airport_code")
        .agg(
            count_when(leaving).alias("departure_flight_count"),
            count_when(~leaving).alias("arrival_flight_count"),
            round6(F.coalesce(F.avg(F.when(leaving, F.col("departure_delay_minutes"))), F.lit(0.0))).alias(
                "average_departure_delay"
            ),
            count_when(leaving & F.col("cancelled_flag")).alias("cancelled_flight_count"),
        )
    )


# ---------------------------------------------------------------- quality gates and dictionary


def _check(spark: SparkSession, rule_id: str, ok: bool, observed: int) -> DataFrame:
    return spark.range(1).select(
        F.lit(rule_id).alias("rule_id"),
        F.lit("passed" if ok else "failed").alias("status"),
        F.lit(observed).cast("bigint").alias("observed_value"),
    )


def _bad_rows_check(rule_id: str, bad: DataFrame) -> DataFrame:
    n = F.col("observed_value")
    return bad.agg(F.count(F.lit(1)).alias("observed_value")).select(
        F.lit(rule_id).alias("rule_id"), F.when(n == 0, "passed").otherwise("failed").alias("status"), n
    )


def star_quality_checks(tables: Mapping[str, DataFrame], dictionary: DataFrame | None = None) -> DataFrame:
    """One row per gate: required tables, unique keys, references, finite numbers, dictionary coverage."""
    spark = next(iter(tables.values())).sparkSession
    checks = [_check(spark, f"TABLE-{t}", t in tables, int(t in tables)) for t in sorted(REQUIRED_TABLES)]
    for table, keys in PRIMARY_KEYS.items():
        if table in tables:
            repeated = tables[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
            checks.append(_bad_rows_check(f"PK-{table}", repeated))
    for name, fact, column, dim, key in REFERENCES:
        if fact in tables and dim in tables:
            known = tables[dim].select(F.col(key).alias("_known")).distinct()
            rows = tables[fact].select(column).where(F.col(column).isNotNull())
            checks.append(_bad_rows_check(f"FK-{name}", rows.join(known, F.col(column) == F.col("_known"), "left_anti")))
    broken = []
    for table in tables.values():
        numbers = [f.name for f in table.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        if numbers:
            hits = [
                F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(1)).otherwise(F.lit(0)) for c in numbers
            ]
            broken.append(table.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, hits)), F.lit(0)).alias("bad")))
    if broken:
        total = union_all(broken).agg(F.sum("bad").cast("bigint").alias("observed_value"))
        n = F.col("observed_value")
        checks.append(
            total.select(
                F.lit("VALUES-finite").alias("rule_id"), F.when(n == 0, "passed").otherwise("failed").alias("status"), n
            )
        )
    if dictionary is not None:
        pairs = [(t, c) for t, df in tables.items() for c in df.columns]
        declared = spark.createDataFrame(pairs, "table_name string, field_name string")
        missing = declared.join(dictionary, ["table_name", "field_name"], "left_anti")
        checks.append(_bad_rows_check("DICTIONARY-coverage", missing))
    return union_all(checks)


def column_roles(table: str, schema: T.StructType) -> dict[str, str]:
    """What a column is for: a key of its table, a reference to a dimension, a number to sum up, or a description."""
    to_dimensions = {column for _, fact, column, _, _ in REFERENCES if fact == table}
    numbers = (T.DoubleType, T.LongType, T.IntegerType)
    roles = {f.name: "measure" if isinstance(f.dataType, numbers) and table not in DIMENSIONS else "attribute" for f in schema.fields}
    roles |= {c: "reference" for c in schema.names if c in to_dimensions}
    return roles | {c: "key" for c in schema.names if c in PRIMARY_KEYS.get(table, ())}


TYPE_NAMES = {"boolean": "boolean", "bigint": "integer", "int": "integer", "double": "number"}


def data_dictionary(tables: Mapping[str, DataFrame], sources: Mapping[str, str] | None = None) -> DataFrame:
    """One row per table and column: type, role, source, smallest non-blank example, nulls and distinct values.

    ``sources`` names what a table was built from; the caller who builds the tables knows.
    """
    parts, sources = [], sources or {}
    for name, df in sorted(tables.items()):
        scalar = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        roles = column_roles(name, df.schema)
        aggregates = [F.count(F.lit(1)).alias("_rows")]
        for i, f in enumerate(scalar):
            text = F.nullif(F.col(f.name).cast("string"), F.lit(""))
            aggregates += [
                F.min(text).alias(f"_e{i}"),
                count_when(text.isNull()).alias(f"_n{i}"),
                F.approx_count_distinct(F.col(f.name)).alias(f"_d{i}"),
            ]
        entries = [
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(f.name).alias("field_name"),
                F.lit(TYPE_NAMES.get(f.dataType.simpleString(), "string")).alias("data_type"),
                F.lit(sources.get(name, "")).alias("source"),
                F.lit(roles[f.name]).alias("field_role"),
                F.coalesce(F.col(f"_e{i}"), F.lit("")).alias("example_value"),
                F.col(f"_n{i}").alias("blank_count"),
                F.col(f"_d{i}").alias("approximate_distinct"),
                F.col("_rows").alias("row_count"),
            )
            for i, f in enumerate(scalar)
        ]
        parts.append(df.agg(*aggregates).select(F.inline(F.array(*entries))))
    return union_all(parts)
