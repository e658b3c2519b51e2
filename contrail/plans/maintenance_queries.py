"""Named queries over telemetry features, anomaly and maintenance risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions import columns as X
from contrail.functions.columns import round6
from contrail.operators import picks as P
from contrail.operators import telemetry as T
from contrail.plans.airline_views import Tables
from contrail.plans.registry import query, sql_part

RUN_ID = "maintenance-run"
# Thresholds low enough for every category to occur in the given data.
SETTINGS = T.HealthSettings(
    risk_high=0.40, risk_medium=0.25, alert_action=0.40, alert_watch=0.30, alert_advisory=0.20
)


def r6(name: str, column=None):
    return round6(name if column is None else column).alias(name)


sql_part(
    "sensor_rows",
    """SELECT *, greatest(engine_1_vibration, engine_2_vibration) AS vib, abs(engine_1_vibration - engine_2_vibration) AS vib_delta, greatest(engine_1_temperature_c, engine_2_temperature_c) AS temp, abs(engine_1_temperature_c - engine_2_temperature_c) AS temp_delta,
              maintenance_risk_score / 100.0e0 AS share, CASE WHEN fault_code IS NULL THEN 0 ELSE 1 END AS fault FROM aircraft_health""",
)
sql_part(
    "flag_rows",
    """SELECT *, cast(vib < 0 OR vib > 6 AS int) AS w1, cast(vib > 8 AS int) AS c1, cast(temp < 200 OR temp > 850 AS int) AS w2, cast(temp > 950 AS int) AS c2, cast(hydraulic_pressure_psi < 2500 OR hydraulic_pressure_psi > 3500 AS int) AS w3, cast(hydraulic_pressure_psi < 2000 OR hydraulic_pressure_psi > 4000 AS int) AS c3,
              cast(oil_pressure_psi < 35 OR oil_pressure_psi > 90 AS int) AS w4, cast(oil_pressure_psi < 20 OR oil_pressure_psi > 110 AS int) AS c4, cast(brake_temperature_c < 0 OR brake_temperature_c > 350 AS int) AS w5, cast(brake_temperature_c > 500 AS int) AS c5 FROM sensor_rows""",
)
sql_part(
    "rolled_rows",
    """SELECT *, coalesce(avg(vib) OVER w, 0) AS r_vib, coalesce(max(temp) OVER w, 0) AS r_temp, coalesce(avg(brake_temperature_c) OVER w, 0) AS r_brake, coalesce(cast(sum(fault) OVER w AS double), 0) AS r_fault, coalesce(cast(last_value(cycles_since_maintenance) OVER w AS double), 0) AS r_cycles, coalesce(last_value(flight_hours_since_maintenance) OVER w, 0) AS r_hours,
              coalesce(least(1, greatest(0, greatest(0, last_value(share) OVER w - first_value(share) OVER w) + greatest(0, avg(vib) OVER w - 3) / 6 + sum(fault) OVER w / 3)), 0) AS trend, coalesce(least(1, greatest(0, (last_value(cycles_since_maintenance) OVER w / 450 + last_value(flight_hours_since_maintenance) OVER w / 1200) / 2)), 0) AS util,
              coalesce(avg(vib) OVER w7, 0) AS r7_vib, coalesce(cast(sum(fault) OVER w7 AS double), 0) AS r7_fault
       FROM flag_rows WINDOW w AS (PARTITION BY aircraft_id ORDER BY event_timestamp_utc, telemetry_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w7 AS (PARTITION BY aircraft_id ORDER BY event_timestamp_utc, telemetry_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
)
sql_part(
    "context_rows",
    """SELECT r.*, coalesce(avg(CASE WHEN d.departure_delay_minutes >= 15 THEN 1.0e0 ELSE 0.0e0 END) OVER (PARTITION BY r.aircraft_id ORDER BY r.event_timestamp_utc, r.telemetry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late_rate
       FROM rolled_rows r LEFT JOIN delay_history d ON d.flight_id = r.flight_id""",
)
FIELD_SQL = {
    "engine_vibration_max": "vib",
    "engine_temperature_max": "temp",
    "hydraulic_pressure_psi": "hydraulic_pressure_psi",
    "oil_pressure_psi": "oil_pressure_psi",
    "brake_temperature_c": "brake_temperature_c",
}
sql_part(
    "field_medians",
    " UNION ALL ".join(f"SELECT '{n}' AS field, median({c}) AS med FROM sensor_rows" for n, c in FIELD_SQL.items()),
)
sql_part(
    "field_mads",
    " UNION ALL ".join(
        f"SELECT '{n}' AS field, median(abs({c} - (SELECT med FROM field_medians WHERE field = '{n}'))) AS mad FROM sensor_rows"
        for n, c in FIELD_SQL.items()
    ),
)
ANOMALY_SQL = " + ".join(
    f"least(1.0e0, abs({c} - (SELECT med FROM field_medians WHERE field = '{n}')) / (SELECT CASE WHEN mad = 0 THEN 1 ELSE mad END FROM field_mads WHERE field = '{n}') / 6)"
    for n, c in FIELD_SQL.items()
)
sql_part("anomaly_rows", f"SELECT telemetry_id, round(1e-10 + ({ANOMALY_SQL}) / 5, 6) AS anomaly FROM sensor_rows")
sql_part(
    "risk_parts",
    """SELECT c.*, anomaly, least(1.0e0, (c1 + c2 + c3 + c4 + c5) * 0.35e0 + (w1 + w2 + w3 + w4 + w5) * 0.15e0) AS s_sensor, least(1.0e0, fault * 0.7e0 + least(0.3e0, r_fault * 0.1e0)) AS s_fault
       FROM context_rows c JOIN anomaly_rows a ON a.telemetry_id = c.telemetry_id""",
)
sql_part(
    "risk_rows",
    """SELECT *, round(1e-10 + s_sensor * 0.3e0 + anomaly * 0.2e0 + trend * 0.2e0 + s_fault * 0.15e0 + util * 0.1e0 + late_rate * 0.05e0, 6) AS risk FROM risk_parts""",
)
sql_part(
    "risk_labels",
    """SELECT telemetry_id, list(label ORDER BY score DESC, name) AS factors FROM (
         SELECT telemetry_id, 'sensor_thresholds' AS name, 'sensor threshold breach' AS label, s_sensor AS score FROM risk_parts
         UNION ALL SELECT telemetry_id, 'telemetry_anomaly', 'telemetry anomaly', anomaly FROM risk_parts
         UNION ALL SELECT telemetry_id, 'degradation_trend', 'degradation trend', trend FROM risk_parts
         UNION ALL SELECT telemetry_id, 'fault_code', 'fault-code evidence', s_fault FROM risk_parts
         UNION ALL SELECT telemetry_id, 'utilisation', 'utilisation since maintenance', util FROM risk_parts
         UNION ALL SELECT telemetry_id, 'recent_delay_or_operational_context', 'retrospective operational context', late_rate FROM risk_parts) WHERE score > 0 GROUP BY telemetry_id""",
)
sql_part(
    "health_scores",
    """SELECT r.*, round(1e-10 + 1 - risk, 6) AS health, CASE WHEN risk >= 0.4 THEN 'high' WHEN risk >= 0.25 THEN 'medium' ELSE 'low' END AS band, CASE WHEN risk >= 0.4 THEN 'action_recommended' WHEN risk >= 0.3 THEN 'watch' WHEN risk >= 0.2 THEN 'advisory' ELSE 'none' END AS category,
              CASE WHEN risk >= 0.4 THEN 3 WHEN risk >= 0.3 THEN 2 WHEN risk >= 0.2 THEN 1 ELSE 0 END AS category_rank, coalesce(array_to_string(factors, '|'), '') AS factors_text, coalesce(factors[1], 'no elevated component') AS top_factor
       FROM risk_rows r LEFT JOIN risk_labels l ON l.telemetry_id = r.telemetry_id""",
)


def features(t: Tables) -> DataFrame:
    return t.stage("health_features", lambda t: T.health_features(t.aircraft_health, t.delay_history, SETTINGS))


def scores(t: Tables) -> DataFrame:
    return t.stage(
        "health_scores", lambda t: T.maintenance_risk(T.robust_anomaly_score(features(t)), SETTINGS)
    )


def stored_health(t: Tables) -> DataFrame:
    """The health score table as its consumers read it."""
    return t.written_stage("health_scores", scores)


@query(
    "sensor_features",
    "SELECT telemetry_id, round(1e-10 + vib, 6) AS engine_vibration_max, round(1e-10 + vib_delta, 6) AS engine_vibration_delta, round(1e-10 + temp, 6) AS engine_temperature_max, round(1e-10 + temp_delta, 6) AS engine_temperature_delta, round(1e-10 + share, 6) AS source_risk_share, fault FROM sensor_rows",
)
def sensor_features(t: Tables) -> DataFrame:
    names = (
        "engine_vibration_max engine_vibration_delta engine_temperature_max engine_temperature_delta source_risk_share"
    ).split()
    return T.sensor_features(t.aircraft_health).select(
        "telemetry_id", *[r6(n) for n in names], F.col("fault_code_present").cast("int").alias("fault")
    )


@query(
    "sensor_flags",
    "SELECT telemetry_id, w1 + w2 + w3 + w4 + w5 AS warnings, c1 + c2 + c3 + c4 + c5 AS criticals, w1, c1, w4, c4 FROM flag_rows",
)
def sensor_flags(t: Tables) -> DataFrame:
    flagged = T.sensor_flags(T.sensor_features(t.aircraft_health))

    def total(level: str) -> str:
        return " + ".join(f"cast({n}_{level}_flag AS int)" for n in T.FLAGGED)

    return flagged.selectExpr(
        "telemetry_id",
        f"{total('warning')} AS warnings",
        f"{total('critical')} AS criticals",
        "cast(vibration_warning_flag AS int) AS w1",
        "cast(vibration_critical_flag AS int) AS c1",
        "cast(oil_pressure_warning_flag AS int) AS w4",
        "cast(oil_pressure_critical_flag AS int) AS c4",
    )


@query(
    "rolling_telemetry",
    "SELECT telemetry_id, round(1e-10 + r_vib, 6) AS rolling_average_vibration, round(1e-10 + r_temp, 6) AS rolling_max_temperature, round(1e-10 + r_brake, 6) AS rolling_brake_temperature, r_fault AS rolling_fault_code_count, r_cycles AS recent_cycles_since_maintenance, r_hours AS recent_flight_hours_since_maintenance, round(1e-10 + r7_vib, 6) AS rolling_average_vibration_7, r7_fault AS rolling_fault_code_count_7 FROM rolled_rows",
)
def rolling_telemetry(t: Tables) -> DataFrame:
    rolled = T.rolling_telemetry(T.sensor_features(t.aircraft_health), SETTINGS)
    return rolled.select(
        "telemetry_id",
        r6("rolling_average_vibration"),
        r6("rolling_max_temperature"),
        r6("rolling_brake_temperature"),
        "rolling_fault_code_count",
        "recent_cycles_since_maintenance",
        "recent_flight_hours_since_maintenance",
        r6("rolling_average_vibration_7"),
        "rolling_fault_code_count_7",
    )


@query("degradation_trend", "SELECT telemetry_id, round(1e-10 + trend, 6) AS degradation_trend_score FROM rolled_rows")
def degradation_trend(t: Tables) -> DataFrame:
    rolled = T.rolling_telemetry(T.sensor_features(t.aircraft_health), SETTINGS)
    return rolled.select("telemetry_id", r6("degradation_trend_score"))


@query("utilisation_intensity", "SELECT telemetry_id, round(1e-10 + util, 6) AS utilisation_intensity FROM rolled_rows")
def utilisation_intensity(t: Tables) -> DataFrame:
    rolled = T.rolling_telemetry(T.sensor_features(t.aircraft_health), SETTINGS)
    return rolled.select("telemetry_id", r6("utilisation_intensity"))


@query("prior_delay_rate", "SELECT telemetry_id, round(1e-10 + late_rate, 6) AS recent_aircraft_delay_rate FROM context_rows")
def prior_delay_rate(t: Tables) -> DataFrame:
    rated = T.prior_delay_rate(t.aircraft_health, t.delay_history)
    return rated.select("telemetry_id", r6("recent_aircraft_delay_rate"))


@query(
    "robust_centres",
    "SELECT m.field, round(1e-10 + med, 6) AS median, round(1e-10 + CASE WHEN mad = 0 THEN 1 ELSE mad END, 6) AS mad FROM field_medians m JOIN field_mads d ON d.field = m.field",
)
def robust_centres(t: Tables) -> DataFrame:
    return T.robust_centres(T.sensor_features(t.aircraft_health)).select("field", r6("median"), r6("mad"))


@query("robust_anomaly_score", "SELECT telemetry_id, anomaly AS telemetry_anomaly_score FROM anomaly_rows")
def robust_anomaly_score(t: Tables) -> DataFrame:
    scored = T.robust_anomaly_score(T.sensor_features(t.aircraft_health))
    return scored.select("telemetry_id", "telemetry_anomaly_score")


@query(
    "health_components",
    "SELECT telemetry_id, round(1e-10 + s_sensor, 6) AS sensor_thresholds, round(1e-10 + s_fault, 6) AS fault_code, round(1e-10 + util, 6) AS utilisation FROM risk_parts",
)
def health_components(t: Tables) -> DataFrame:
    return stored_health(t).select(
        "telemetry_id",
        *[r6(n, f"{n}_component_score") for n in ("sensor_thresholds", "fault_code", "utilisation")],
    )


@query(
    "maintenance_risk",
    "SELECT telemetry_id, risk AS maintenance_risk_score, health AS aircraft_health_score, band AS risk_band, category AS alert_category, top_factor AS top_contributing_factor, factors_text AS contributing_factors FROM health_scores",
)
def maintenance_risk(t: Tables) -> DataFrame:
    return scores(t).select(
        "telemetry_id",
        "maintenance_risk_score",
        "aircraft_health_score",
        "risk_band",
        "alert_category",
        "top_contributing_factor",
        F.array_join("contributing_factors", "|").alias("contributing_factors"),
    )


@query("band_threshold", "SELECT category AS alert_category, band AS risk_band, count(*) AS readings FROM health_scores GROUP BY ALL")
def band_threshold(t: Tables) -> DataFrame:
    risk = F.col("maintenance_risk_score")
    category = X.band_threshold(risk, ((0.4, "action_recommended"), (0.3, "watch"), (0.2, "advisory")), "none")
    band = X.band_threshold(risk, ((0.4, "high"), (0.25, "medium")), "low")
    return (
        stored_health(t)
        .groupBy(category.alias("alert_category"), band.alias("risk_band"))
        .agg(F.count(F.lit(1)).alias("readings"))
    )


sql_part(
    "health_alerts",
    """SELECT concat('MAINT-', upper(substr(sha256(concat_ws('|', 'maintenance-run', aircraft_id, telemetry_id, category)), 1, 12))) AS alert_id, * FROM (
         SELECT *, row_number() OVER (PARTITION BY aircraft_id ORDER BY risk DESC, event_timestamp_utc, telemetry_id) AS rn FROM health_scores WHERE category <> 'none') WHERE rn <= 5""",
)


def alerts(t: Tables) -> DataFrame:
    return T.maintenance_alerts(stored_health(t), RUN_ID, SETTINGS)


@query(
    "maintenance_alerts",
    "SELECT alert_id, aircraft_id, telemetry_id, category AS alert_category, risk AS maintenance_risk_score, top_factor AS primary_reason, coalesce(fault_code, '') AS fault_code FROM health_alerts",
)
def maintenance_alerts(t: Tables) -> DataFrame:
    return alerts(t).select(
        "alert_id",
        "aircraft_id",
        "telemetry_id",
        "alert_category",
        "maintenance_risk_score",
        "primary_reason",
        "evidence_fields.fault_code",
    )


@query("topk_per_group", "SELECT telemetry_id, aircraft_id FROM (SELECT *, row_number() OVER (PARTITION BY aircraft_id ORDER BY brake_temperature_c DESC, telemetry_id) AS rn FROM aircraft_health) WHERE rn <= 3")
def topk_per_group(t: Tables) -> DataFrame:
    order = [F.col("brake_temperature_c").desc(), F.col("telemetry_id")]
    return P.topk_per_group(t.aircraft_health, ["aircraft_id"], order, 3).select("telemetry_id", "aircraft_id")


@query(
    "aircraft_health_summary",
    """SELECT aircraft_id, count(*) AS observation_count, count(DISTINCT flight_id) AS linked_flight_count, round(1e-10 + avg(risk), 6) AS average_maintenance_risk_score, max(risk) AS maximum_maintenance_risk_score,
              arg_max(risk, struct_pack(a := event_timestamp_utc, b := telemetry_id)) AS latest_maintenance_risk_score, count(*) FILTER (category <> 'none') AS alert_count, CASE max(category_rank) WHEN 3 THEN 'action_recommended' WHEN 2 THEN 'watch' WHEN 1 THEN 'advisory' ELSE 'none' END AS highest_alert_category,
              count(*) FILTER (s_fault > 0) AS fault_code_count, count(*) FILTER (band = 'high') AS high_risk_observation_count, CASE WHEN max(risk) >= 0.8 THEN 'high' WHEN max(risk) >= 0.6 THEN 'medium' ELSE 'low' END AS review_priority
       FROM health_scores GROUP BY aircraft_id""",
)
def aircraft_health_summary(t: Tables) -> DataFrame:
    return T.aircraft_health_summary(stored_health(t)).select(
        "aircraft_id",
        "observation_count",
        "linked_flight_count",
        r6("average_maintenance_risk_score"),
        "maximum_maintenance_risk_score",
        "latest_maintenance_risk_score",
        "alert_count",
        "highest_alert_category",
        "fault_code_count",
        "high_risk_observation_count",
        "review_priority",
    )


sql_part(
    "flight_risk",
    """SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY event_timestamp_utc DESC, telemetry_id) AS rn, count(*) OVER (PARTITION BY flight_id) AS readings FROM health_scores""",
)


def flight_risk(t: Tables) -> DataFrame:
    return T.flight_maintenance_risk(stored_health(t), t.flight_schedule)


@query(
    "flight_maintenance_risk",
    "SELECT r.flight_id, r.aircraft_id, risk AS maintenance_risk_score, band AS risk_band, readings AS evidence_count, epoch_us(f.scheduled_departure_utc) AS departure_us FROM flight_risk r JOIN flight_schedule f ON f.flight_id = r.flight_id WHERE rn = 1",
)
def flight_maintenance_risk(t: Tables) -> DataFrame:
    return flight_risk(t).select(
        "flight_id",
        "aircraft_id",
        "maintenance_risk_score",
        "risk_band",
        "evidence_count",
        F.unix_micros("scheduled_departure_utc").alias("departure_us"),
    )


@query(
    "health_component_summary",
    " UNION ALL ".join(
        f"SELECT '{n}' AS component, round(1e-10 + avg({c}), 6) AS average, round(1e-10 + max({c}), 6) AS maximum FROM risk_parts"
        for n, c in {
            "sensor_thresholds": "s_sensor",
            "telemetry_anomaly": "anomaly",
            "degradation_trend": "trend",
            "fault_code": "s_fault",
            "utilisation": "util",
            "recent_delay_or_operational_context": "late_rate",
        }.items()
    ),
)
def health_component_summary(t: Tables) -> DataFrame:
    return T.health_component_summary(stored_health(t)).select("component", r6("average"), r6("maximum"))


@query(
    "maintenance_metrics",
    """SELECT 'telemetry_observation_count' AS metric_name, cast(count(*) AS double) AS metric_value FROM health_scores UNION ALL SELECT 'scored_observation_count', cast(count(*) AS double) FROM health_scores
       UNION ALL SELECT 'alert_count', cast(count(*) FILTER (category <> 'none') AS double) FROM health_scores UNION ALL SELECT 'high_risk_rate', round(1e-10 + count(*) FILTER (band = 'high') / count(*), 6) FROM health_scores""",
)
def maintenance_metrics(t: Tables) -> DataFrame:
    return T.maintenance_metrics(stored_health(t)).select("metric_name", r6("metric_value"))
