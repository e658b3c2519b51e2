"""Aircraft health: sensor features and flags, rolling history, anomaly and risk scores, alerts, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions.columns import (
    array_rank,
    band_threshold,
    clamp01,
    count_when,
    dot,
    highest_by_order,
    round6,
    safe_divide,
    sha_id,
)
from contrail.operators.disruption import component_summary, metric_rows
from contrail.operators.picks import filter_min_group_size, pick_first, topk_per_group
from contrail.operators.ranks import medians, unpivot_fields
from contrail.operators.running import day_bin, drop_ghosts, prefix_aggregates, with_lookback
from contrail.session import materialize

# Sensor bounds, weights, labels, thresholds and texts.
BOUNDS: dict[str, dict[str, float]] = {
    "engine_vibration": {"warning_min": 0.0, "warning_max": 6.0, "critical_max": 8.0},
    "engine_temperature": {"warning_min": 200.0, "warning_max": 850.0, "critical_max": 950.0},
    "hydraulic_pressure": {
        "warning_min": 2500.0,
        "warning_max": 3500.0,
        "critical_min": 2000.0,
        "critical_max": 4000.0,
    },
    "oil_pressure": {"warning_min": 35.0, "warning_max": 90.0, "critical_min": 20.0, "critical_max": 110.0},
    "brake_temperature": {"warning_min": 0.0, "warning_max": 350.0, "critical_max": 500.0},
}
FLAGGED = {
    "vibration": ("engine_vibration_max", "engine_vibration"),
    "engine_temperature": ("engine_temperature_max", "engine_temperature"),
    "hydraulic_pressure": ("hydraulic_pressure_psi", "hydraulic_pressure"),
    "oil_pressure": ("oil_pressure_psi", "oil_pressure"),
    "brake_temperature": ("brake_temperature_c", "brake_temperature"),
}
WEIGHTS = {
    "sensor_thresholds": 0.30,
    "telemetry_anomaly": 0.20,
    "degradation_trend": 0.20,
    "fault_code": 0.15,
    "utilisation": 0.10,
    "recent_delay_or_operational_context": 0.05,
}
LABELS = {
    "sensor_thresholds": "sensor threshold breach",
    "telemetry_anomaly": "telemetry anomaly",
    "degradation_trend": "degradation trend",
    "fault_code": "fault-code evidence",
    "utilisation": "utilisation since maintenance",
    "recent_delay_or_operational_context": "retrospective operational context",
}
ANOMALY_FIELDS = (
    "engine_vibration_max",
    "engine_temperature_max",
    "hydraulic_pressure_psi",
    "oil_pressure_psi",
    "brake_temperature_c",
)
CATEGORY_ORDER = ("none", "advisory", "watch", "action_recommended")
REVIEW_PRIORITY = ((0.8, "high"), (0.6, "medium"))
ALERT_ACTIONS = {
    "action_recommended": "Prioritise engineering review in a real system; do not treat as certified maintenance instruction.",
    "watch": "Inspect source telemetry evidence and review synthetic trend.",
}
DEFAULT_ACTION = "Review synthetic telemetry trend."
WARNING = "Synthetic data only; not certified maintenance evidence."
LATE_MINUTES = 15


@dataclass(frozen=True)
class HealthSettings:
    """Thresholds of the health scores. Fixed default values."""

    bounds: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: dict(BOUNDS))
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    risk_high: float = 0.80
    risk_medium: float = 0.60
    alert_action: float = 0.80
    alert_watch: float = 0.60
    alert_advisory: float = 0.45
    rolling_windows: tuple[int, ...] = (3, 7)
    minimum_aircraft_observations: int = 1
    maximum_alerts_per_aircraft: int = 5


DEFAULTS = HealthSettings()


def sensor_features(health: DataFrame) -> DataFrame:
    """Paired engine sensors as maximum and gap, risk as a share, and whether a fault code is present."""
    return health.selectExpr(
        "*",
        "greatest(engine_1_vibration, engine_2_vibration) AS engine_vibration_max",
        "abs(engine_1_vibration - engine_2_vibration) AS engine_vibration_delta",
        "greatest(engine_1_temperature_c, engine_2_temperature_c) AS engine_temperature_max",
        "abs(engine_1_temperature_c - engine_2_temperature_c) AS engine_temperature_delta",
        "coalesce(maintenance_risk_score, 0) / 100.0D AS source_risk_share",
        "coalesce(fault_code, '') <> '' AS fault_code_present",
    )


def breach(value: str, bounds: Mapping[str, float], level: str) -> Column:
    """Whether a value leaves the optional [min, max] of a level."""
    column, hit = F.col(value), F.lit(False)
    if f"{level}_min" in bounds:
        hit = hit | (column < bounds[f"{level}_min"])
    if f"{level}_max" in bounds:
        hit = hit | (column > bounds[f"{level}_max"])
    return F.coalesce(hit, F.lit(False))


def sensor_flags(features: DataFrame, settings: HealthSettings = DEFAULTS) -> DataFrame:
    """Ten flags: five sensors at two levels."""
    return features.withColumns(
        {
            f"{name}_{level}_flag": breach(column, settings.bounds[bound], level)
            for name, (column, bound) in FLAGGED.items()
            for level in ("warning", "critical")
        }
    )


def rolling_telemetry(
    features: DataFrame,
    settings: HealthSettings = DEFAULTS,
    *,
    key: str = "aircraft_id",
    order: Sequence[str] = ("event_timestamp_utc", "telemetry_id"),
    bins: Sequence[Column] | None = None,
) -> DataFrame:
    """History over the previous readings of the aircraft, one column set per window size.

    The first window keeps plain names, further ones end in ``_<size>``. Without history everything is zero.
    """
    carried = (
        "engine_vibration_max",
        "engine_temperature_max",
        "brake_temperature_c",
        "fault_code_present",
        "cycles_since_maintenance",
        "flight_hours_since_maintenance",
        "source_risk_share",
    )
    rows, chunk = with_lookback(
        features,
        [key],
        order,
        carried,
        max(settings.rolling_windows),
        bins if bins is not None else [day_bin(order[0])],
    )
    base = Window.partitionBy(*chunk).orderBy(*order)
    raw: dict[str, Column] = {}
    for size in settings.rolling_windows:
        frame = base.rowsBetween(-size, -1)
        raw[f"_vib_{size}"] = F.avg("engine_vibration_max").over(frame)
        raw[f"_temp_{size}"] = F.max("engine_temperature_max").over(frame)
        raw[f"_brake_{size}"] = F.avg("brake_temperature_c").over(frame)
        raw[f"_fault_{size}"] = F.sum(F.col("fault_code_present").cast("int")).over(frame)
        raw[f"_cycles_{size}"] = F.last("cycles_since_maintenance").over(frame)
        raw[f"_hours_{size}"] = F.last("flight_hours_since_maintenance").over(frame)
        raw[f"_rise_{size}"] = F.last("source_risk_share").over(frame) - F.first("source_risk_share").over(frame)
    windowed = drop_ghosts(rows.withColumns(raw), chunk)
    shown: list[str] = []
    for i, size in enumerate(settings.rolling_windows):
        tail = "" if i == 0 else f"_{size}"
        trend = (
            f"greatest(0.0D, _rise_{size}) + greatest(0.0D, _vib_{size} - 3.0D) / 6.0D + _fault_{size} / {max(1, size)}.0D"
        )
        use = f"(_cycles_{size} / 450.0D + _hours_{size} / 1200.0D) / 2"
        shown += [
            f"coalesce(_vib_{size}, 0.0D) AS rolling_average_vibration{tail}",
            f"coalesce(_temp_{size}, 0.0D) AS rolling_max_temperature{tail}",
            f"coalesce(_brake_{size}, 0.0D) AS rolling_brake_temperature{tail}",
            f"coalesce(cast(_fault_{size} AS double), 0.0D) AS rolling_fault_code_count{tail}",
            f"coalesce(cast(_cycles_{size} AS double), 0.0D) AS recent_cycles_since_maintenance{tail}",
            f"coalesce(_hours_{size}, 0.0D) AS recent_flight_hours_since_maintenance{tail}",
            f"coalesce(least(1.0D, greatest(0.0D, {trend})), 0.0D) AS degradation_trend_score{tail}",
            f"coalesce(least(1.0D, greatest(0.0D, {use})), 0.0D) AS utilisation_intensity{tail}",
        ]
    return windowed.selectExpr(*features.columns, *shown)


def prior_delay_rate(
    features: DataFrame,
    delays: DataFrame,
    *,
    key: str = "aircraft_id",
    order: Sequence[str] = ("event_timestamp_utc", "telemetry_id"),
) -> DataFrame:
    """Share of the aircraft's earlier readings whose linked flight was late."""
    linked = features.join(
        delays.select("flight_id", F.col("departure_delay_minutes").alias("linked_departure_delay_minutes")),
        "flight_id",
        "left",
    )
    late = F.when(F.col("linked_departure_delay_minutes") >= LATE_MINUTES, 1).otherwise(0)
    counted = prefix_aggregates(
        linked,
        [key],
        [F.col(c) for c in order],
        {"_late": ("sum", late), "_seen": ("count", F.lit(1))},
        [day_bin(order[0])],
    )
    return counted.withColumn("recent_aircraft_delay_rate", safe_divide(F.col("_late"), F.col("_seen"))).drop(
        "_late", "_seen"
    )


def health_features(health: DataFrame, delays: DataFrame, settings: HealthSettings = DEFAULTS) -> DataFrame:
    """Sensor, rolling and context features per reading."""
    flagged = sensor_flags(sensor_features(health), settings)
    rolled = rolling_telemetry(flagged, settings)
    rated = prior_delay_rate(rolled, delays)
    return filter_min_group_size(rated, "aircraft_id", settings.minimum_aircraft_observations)


def robust_centres(df: DataFrame, fields: Sequence[str] = ANOMALY_FIELDS) -> DataFrame:
    """Exact median and median absolute deviation per field; a zero deviation reads as one.

    The passes of both medians read the values from a stored narrow table, the second ones one stored median a field.
    """
    values = materialize(unpivot_fields(df, {name: F.coalesce(F.col(name), F.lit(0.0)) for name in fields}), "values")
    centre = materialize(medians(values), "medians")
    gaps = values.join(F.broadcast(centre), "field").select("field", F.abs(F.col("v") - F.col("median")).alias("v"))
    spread = medians(gaps).withColumnRenamed("median", "_mad")
    return centre.join(spread, "field").select(
        "field", "median", F.when(F.col("_mad") == 0, 1.0).otherwise(F.col("_mad")).alias("mad")
    )


def robust_anomaly_score(
    df: DataFrame, fields: Sequence[str] = ANOMALY_FIELDS, name: str = "telemetry_anomaly_score"
) -> DataFrame:
    """Mean over the fields of |x - median| / MAD / 6, each capped at one."""
    centres = robust_centres(df, fields).agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.struct("median", "mad"))))
    )
    marked = df.withColumn("_centres", centres.scalar())
    parts = []
    for f in fields:
        at = F.try_element_at("_centres", F.lit(f))
        gap = F.abs(F.coalesce(F.col(f), F.lit(0.0)) - at["median"]) / at["mad"]
        parts.append(F.least(F.lit(1.0), gap / 6.0))
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return marked.withColumn(name, round6(total / len(fields))).drop("_centres")


def health_components(df: DataFrame) -> dict[str, Column]:
    """The six risk components of a reading."""
    def raised(level: str) -> Column:
        flags = [F.col(f"{name}_{level}_flag").cast("int") for name in FLAGGED]
        total = flags[0]
        for flag in flags[1:]:
            total = total + flag
        return total

    fault = F.when(F.col("fault_code_present"), 0.7).otherwise(0.0) + F.least(
        F.lit(0.3), F.col("rolling_fault_code_count") * 0.1
    )
    return {
        "sensor_thresholds": clamp01(raised("critical") * 0.35 + raised("warning") * 0.15),
        "telemetry_anomaly": F.coalesce("telemetry_anomaly_score", F.lit(0.0)),
        "degradation_trend": clamp01("degradation_trend_score"),
        "fault_code": clamp01(fault),
        "utilisation": clamp01("utilisation_intensity"),
        "recent_delay_or_operational_context": clamp01("recent_aircraft_delay_rate"),
    }


def maintenance_risk(features: DataFrame, settings: HealthSettings = DEFAULTS) -> DataFrame:
    """Component scores, risk, health, bands, alert category and factors per reading."""
    parts = health_components(features)
    scored = features.withColumns({f"{name}_component_score": c for name, c in parts.items()})
    names = {name: F.col(f"{name}_component_score") for name in WEIGHTS}
    scored = scored.withColumns(
        {"maintenance_risk_score": round6(dot(names, settings.weights)), "contributing_factors": array_rank(names, LABELS)}
    )
    risk = F.col("maintenance_risk_score")
    category = band_threshold(
        risk,
        (
            (settings.alert_action, "action_recommended"),
            (settings.alert_watch, "watch"),
            (settings.alert_advisory, "advisory"),
        ),
        "none",
    )
    return scored.withColumns(
        {
            "health_observation_id": F.concat_ws(":", "aircraft_id", "telemetry_id"),
            "aircraft_health_score": round6(1.0 - risk),
            "risk_band": band_threshold(risk, ((settings.risk_high, "high"), (settings.risk_medium, "medium")), "low"),
            "alert_category": category,
            "top_contributing_factor": F.coalesce(
                F.get("contributing_factors", F.lit(0)), F.lit("no elevated component")
            ),
            "human_review_required": category != "none",
        }
    )


def maintenance_alerts(scores: DataFrame, run_id: str, settings: HealthSettings = DEFAULTS) -> DataFrame:
    """At most a few alerts per aircraft, riskiest first."""
    top = topk_per_group(
        scores.filter(F.col("alert_category") != "none"),
        ["aircraft_id"],
        [F.col("maintenance_risk_score").desc(), F.col("event_timestamp_utc"), F.col("telemetry_id")],
        settings.maximum_alerts_per_aircraft,
    )
    action = F.lit(DEFAULT_ACTION)
    for category, text in ALERT_ACTIONS.items():
        action = F.when(F.col("alert_category") == category, text).otherwise(action)
    return top.select(
        sha_id(
            "MAINT-", [F.lit(run_id), F.col("aircraft_id"), F.col("telemetry_id"), F.col("alert_category")], 12
        ).alias("alert_id"),
        "aircraft_id",
        "aircraft_type",
        "telemetry_id",
        "flight_id",
        "event_timestamp_utc",
        "alert_category",
        "risk_band",
        "maintenance_risk_score",
        "aircraft_health_score",
        F.col("top_contributing_factor").alias("primary_reason"),
        "contributing_factors",
        action.alias("recommended_review_action"),
        F.struct(
            "engine_vibration_max",
            "engine_temperature_max",
            "brake_temperature_c",
            F.coalesce("fault_code", F.lit("")).alias("fault_code"),
            "top_contributing_factor",
        ).alias("evidence_fields"),
        F.lit(WARNING).alias("synthetic_data_warning"),
        F.lit(True).alias("human_review_required"),
    )


def aircraft_health_summary(scores: DataFrame) -> DataFrame:
    """Per aircraft: readings, linked flights, latest and extreme scores, alerts and review priority."""
    latest = F.max_by(
        F.struct("event_timestamp_utc", "maintenance_risk_score", "aircraft_health_score", "aircraft_type"),
        F.struct("event_timestamp_utc", "telemetry_id"),
    )
    linked = F.when(F.coalesce("flight_id", F.lit("")) != "", F.col("flight_id"))
    flights = scores.select("aircraft_id", linked.alias("f")).groupBy("aircraft_id").agg(
        F.count_distinct("f").alias("linked_flight_count")
    )
    rest = scores.groupBy("aircraft_id").agg(
        F.count(F.lit(1)).alias("observation_count"),
        latest.alias("_latest"),
        F.avg("maintenance_risk_score").alias("average_maintenance_risk_score"),
        F.max("maintenance_risk_score").alias("maximum_maintenance_risk_score"),
        count_when(F.col("alert_category") != "none").alias("alert_count"),
        highest_by_order("alert_category", CATEGORY_ORDER).alias("highest_alert_category"),
        count_when(F.array_contains("contributing_factors", LABELS["fault_code"])).alias("fault_code_count"),
        count_when(F.col("risk_band") == "high").alias("high_risk_observation_count"),
    )
    return rest.join(flights, "aircraft_id").select(
        "aircraft_id",
        F.col("_latest.aircraft_type").alias("aircraft_type"),
        "observation_count",
        "linked_flight_count",
        F.col("_latest.event_timestamp_utc").alias("latest_event_timestamp_utc"),
        "average_maintenance_risk_score",
        "maximum_maintenance_risk_score",
        F.col("_latest.maintenance_risk_score").alias("latest_maintenance_risk_score"),
        F.col("_latest.aircraft_health_score").alias("latest_aircraft_health_score"),
        "alert_count",
        "highest_alert_category",
        "fault_code_count",
        "high_risk_observation_count",
        band_threshold("maximum_maintenance_risk_score", REVIEW_PRIORITY, "low").alias("review_priority"),
    )


def flight_maintenance_risk(scores: DataFrame, flights: DataFrame | None = None) -> DataFrame:
    """Latest score per flight (equal times: smallest id), number of readings, and the scheduled departure."""
    linked = scores.filter(F.coalesce("flight_id", F.lit("")) != "")
    columns = [
        "aircraft_id",
        "aircraft_type",
        "event_timestamp_utc",
        "maintenance_risk_score",
        "aircraft_health_score",
        "risk_band",
        "alert_category",
        "human_review_required",
    ]
    latest = pick_first(
        linked, ["flight_id"], [-F.unix_micros("event_timestamp_utc"), F.col("telemetry_id")], columns
    ).withColumnRenamed("event_timestamp_utc", "latest_telemetry_utc")
    counts = linked.groupBy("flight_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    out = latest.join(counts, "flight_id")
    if flights is None:
        return out
    return out.join(flights.select("flight_id", "scheduled_departure_utc"), "flight_id", "left")


def health_component_summary(scores: DataFrame) -> DataFrame:
    return component_summary(scores, {name: f"{name}_component_score" for name in WEIGHTS})


def maintenance_metrics(scores: DataFrame) -> DataFrame:
    row = scores.agg(
        F.count(F.lit(1)).alias("n"),
        count_when(F.col("risk_band") == "high").alias("high"),
        count_when(F.col("alert_category") != "none").alias("alerts"),
    )
    n, high, found = F.col("n"), F.col("high"), F.col("alerts")
    return metric_rows(
        row,
        [
            ("volume", "telemetry_observation_count", n, n, n),
            ("volume", "scored_observation_count", n, n, n),
            ("alerts", "alert_count", found, found, n),
            ("risk", "high_risk_rate", safe_divide(high, n), high, n),
        ],
    )
