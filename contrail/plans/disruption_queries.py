"""Named queries over exposure, history, disruption scores and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions import columns as X
from contrail.operators import disruption as D
from contrail.operators import history as H
from contrail.operators import picks as P
from contrail.operators.intervals import airport_event_exposure, weather_exposure
from contrail.plans.airline_views import Tables
from contrail.plans.registry import query, sql_part

RUN_ID = "disruption-run"


def r6(column, alias: str | None = None):
    name = alias or column
    return X.round6(column).alias(name)


sql_part(
    "flight_ends",
    """SELECT flight_id, origin_airport, destination_airport, scheduled_departure_utc AS at_ts, origin_airport AS airport FROM flight_schedule
       UNION SELECT flight_id, origin_airport, destination_airport, scheduled_departure_utc, destination_airport FROM flight_schedule""",
)
sql_part(
    "weather_hits",
    """SELECT e.flight_id, count(*) AS weather_event_count, max(severity) AS weather_max_severity, max(operational_impact_score) AS weather_max_impact,
              count(*) FILTER (airport = origin_airport) AS origin_weather_event_count, count(*) FILTER (airport = destination_airport) AS destination_weather_event_count
       FROM flight_ends e JOIN weather_events w ON w.airport_code = e.airport AND w.event_start_utc <= e.at_ts AND w.event_end_utc >= e.at_ts GROUP BY e.flight_id""",
)
sql_part(
    "airport_hits",
    """SELECT e.flight_id, count(*) AS airport_event_count, max(severity) AS max_severity, max(capacity_reduction_percent) AS max_reduction, max(estimated_delay_minutes) AS max_delay
       FROM flight_ends e JOIN airport_events w ON w.airport_code = e.airport AND w.event_start_utc <= e.at_ts AND w.event_end_utc >= e.at_ts GROUP BY e.flight_id""",
)


@query(
    "interval_join",
    """SELECT flight_id, weather_event_count, cast(weather_max_severity AS double) AS weather_max_severity, weather_max_impact AS weather_max_impact_score, origin_weather_event_count, destination_weather_event_count FROM weather_hits""",
)
def interval_join(t: Tables) -> DataFrame:
    return weather_exposure(t.flight_schedule, t.weather_events, at="scheduled_departure_utc")


@query(
    "interval_join_airport_events",
    """SELECT flight_id, airport_event_count, cast(max_severity AS double) AS airport_max_severity, cast(max_reduction AS double) AS airport_max_capacity_reduction, cast(max_delay AS double) AS airport_max_estimated_delay FROM airport_hits""",
)
def interval_join_airport_events(t: Tables) -> DataFrame:
    return airport_event_exposure(t.flight_schedule, t.airport_events, at="scheduled_departure_utc")


sql_part(
    "pressure",
    """SELECT f.flight_id, coalesce(avg(CASE WHEN coalesce(d.departure_delay_minutes, 0) >= 15 THEN 1.0e0 ELSE 0.0e0 END) OVER (PARTITION BY f.route_id ORDER BY f.scheduled_departure_utc, f.flight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_route_delay_pressure,
              coalesce(cast(sum(CASE WHEN coalesce(d.departure_delay_minutes, 0) >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY f.route_id, f.operating_date ORDER BY f.scheduled_departure_utc, f.flight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS double), 0) AS same_day_route_disruption_count
       FROM flight_schedule f LEFT JOIN delay_history d ON d.flight_id = f.flight_id""",
)


def flights_with_delay(t: Tables) -> DataFrame:
    flights = t.flight_schedule.select("flight_id", "route_id", "operating_date", "scheduled_departure_utc")
    return flights.join(t.delay_history.select("flight_id", "departure_delay_minutes"), "flight_id", "left")


@query("prior_pressure", "SELECT flight_id, round(1e-10 + prior_route_delay_pressure, 6) AS prior_route_delay_pressure FROM pressure")
def prior_pressure(t: Tables) -> DataFrame:
    return H.prior_pressure(flights_with_delay(t)).select("flight_id", r6("prior_route_delay_pressure"))


@query("same_day_prior_count", "SELECT flight_id, same_day_route_disruption_count FROM pressure")
def same_day_prior_count(t: Tables) -> DataFrame:
    return H.prior_pressure(flights_with_delay(t)).select("flight_id", "same_day_route_disruption_count")


sql_part(
    "latest_booking",
    """SELECT flight_id, expected_final_passengers, days_before_departure, observation_date, booked_passengers FROM (
         SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY days_before_departure, observation_date, row_key) AS rn FROM passenger_demand) WHERE rn = 1""",
)
sql_part(
    "latest_reading",
    """SELECT flight_id, telemetry_id, maintenance_risk_score FROM (
         SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY event_timestamp_utc DESC, telemetry_id) AS rn FROM aircraft_health) WHERE rn = 1""",
)


@query("latest_observation", "SELECT flight_id, expected_final_passengers, days_before_departure, booked_passengers FROM latest_booking")
def latest_observation(t: Tables) -> DataFrame:
    return P.latest_observation(
        t.passenger_demand,
        ["expected_final_passengers", "days_before_departure", "booked_passengers"],
        tie_breakers=("row_key",),
    )


@query(
    "join_lookup",
    """SELECT f.flight_id, coalesce(c.connection_risk_minutes, 0) AS connection_risk_minutes, coalesce(c.cabin_crew_assigned, 0) AS cabin_crew_assigned
       FROM flight_schedule f LEFT JOIN crew_operations c ON c.flight_id = f.flight_id""",
)
def join_lookup(t: Tables) -> DataFrame:
    return P.join_lookup(
        t.flight_schedule.select("flight_id"),
        t.crew_operations,
        "flight_id",
        {"connection_risk_minutes": 0, "cabin_crew_assigned": 0},
        row_order=[F.col("row_key")],
    )


@query(
    "join_optional_source",
    """SELECT f.flight_id, coalesce(p.probability, 0) AS probability, CASE WHEN p.flight_id IS NULL THEN 'no' ELSE 'yes' END AS predicted, 0.0e0 AS forecast_passengers, 'no' AS forecast_used
       FROM flight_schedule f LEFT JOIN predictions p ON p.flight_id = f.flight_id""",
)
def join_optional_source(t: Tables) -> DataFrame:
    df = P.join_optional_source(
        t.flight_schedule.select("flight_id"), t.predictions, "flight_id", {"probability": 0.0}, "predicted"
    )
    df = P.join_optional_source(df, None, "flight_id", {"forecast_passengers": 0.0}, "forecast_used")

    def yes(c):
        return F.when(F.col(c), "yes").otherwise("no").alias(c)

    return df.select("flight_id", "probability", yes("predicted"), "forecast_passengers", yes("forecast_used"))


sql_part(
    "features",
    """SELECT f.flight_id, f.route_id, f.operating_date, f.scheduled_departure_utc, f.origin_airport, f.destination_airport, f.aircraft_id, f.aircraft_type,
              cast(f.seat_capacity AS double) AS seats, d.flight_id IS NOT NULL AS outcome,
              cast(coalesce(d.departure_delay_minutes, 0) AS double) AS dep_delay, cast(coalesce(d.arrival_delay_minutes, 0) AS double) AS arr_delay,
              coalesce(d.cancelled_flag, false) AS cancelled, coalesce(d.diverted_flag, false) AS diverted,
              cast(coalesce(d.reactionary_delay_minutes, 0) AS double) AS reactionary,
              coalesce(c.captain_available, true) AS captain, coalesce(c.first_officer_available, true) AS officer,
              coalesce(c.cabin_crew_assigned, 0) < coalesce(c.cabin_crew_required, 0) AS shortage, coalesce(c.reserve_crew_used, false) AS reserve,
              cast(coalesce(c.connection_risk_minutes, 0) AS double) AS connection, coalesce(c.crew_disruption_flag, false) AS crew_disrupted,
              coalesce(b.expected_final_passengers, 0) / greatest(1.0e0, f.seat_capacity) AS load,
              coalesce(h.maintenance_risk_score, 0) / 100.0e0 AS source_risk,
              coalesce(w.weather_max_impact, 0) / 100.0e0 AS impact, coalesce(w.weather_max_severity, 0) >= 4 AS severe,
              coalesce(w.weather_event_count, 0) > 0 AS weather_hit,
              cast(coalesce(w.origin_weather_event_count, 0) AS double) AS ow, cast(coalesce(w.destination_weather_event_count, 0) AS double) AS dw,
              cast(coalesce(a.airport_event_count, 0) AS double) AS ae, coalesce(a.max_severity, 0) AS ae_sev, coalesce(a.max_reduction, 0) AS ae_red, coalesce(a.max_delay, 0) AS ae_delay,
              p.prior_route_delay_pressure AS pressure, p.same_day_route_disruption_count AS same_day,
              coalesce(q.probability, 0) AS prob
       FROM flight_schedule f LEFT JOIN delay_history d ON d.flight_id = f.flight_id LEFT JOIN crew_operations c ON c.flight_id = f.flight_id
       LEFT JOIN latest_booking b ON b.flight_id = f.flight_id LEFT JOIN latest_reading h ON h.flight_id = f.flight_id
       LEFT JOIN weather_hits w ON w.flight_id = f.flight_id LEFT JOIN airport_hits a ON a.flight_id = f.flight_id
       LEFT JOIN pressure p ON p.flight_id = f.flight_id LEFT JOIN predictions q ON q.flight_id = f.flight_id""",
)
sql_part(
    "components",
    """SELECT *,
              least(1.0e0, greatest(0.0e0, prob, dep_delay / 60.0e0, CASE WHEN cancelled OR diverted THEN 1.0e0 ELSE 0.0e0 END)) AS c_delay,
              least(1.0e0, greatest(0.0e0, impact, CASE WHEN severe THEN 0.7e0 ELSE 0.0e0 END)) AS c_weather,
              least(1.0e0, greatest(0.0e0, ae_red / 40.0e0, ae_delay / 60.0e0, ae_sev / 5.0e0)) AS c_airport,
              least(1.0e0, greatest(0.0e0, CASE WHEN NOT captain OR NOT officer THEN 1.0e0 ELSE 0.0e0 END, CASE WHEN shortage THEN 0.8e0 ELSE 0.0e0 END, CASE WHEN reserve THEN 0.5e0 ELSE 0.0e0 END, connection / 45.0e0, CASE WHEN crew_disrupted THEN 0.7e0 ELSE 0.0e0 END)) AS c_crew,
              least(1.0e0, greatest(0.0e0, source_risk)) AS c_health,
              least(1.0e0, greatest(0.0e0, load / 0.9e0)) AS c_load,
              least(1.0e0, greatest(0.0e0, reactionary / 30.0e0, pressure, same_day / 4.0e0)) AS c_network
       FROM features""",
)
sql_part(
    "severities",
    """SELECT *,
              least(1.0e0, greatest(0.0e0, greatest(prob, pressure) * 0.25e0 + c_weather * 0.15e0 + c_airport * 0.15e0 + c_crew * 0.15e0 + c_health * 0.1e0 + c_load * 0.1e0 + pressure * 0.1e0)) AS fwd,
              least(1.0e0, greatest(0.0e0, c_delay * 0.25e0 + c_weather * 0.15e0 + c_airport * 0.15e0 + c_crew * 0.15e0 + c_health * 0.1e0 + c_load * 0.1e0 + c_network * 0.1e0)) AS retro
       FROM components""",
)
sql_part(
    "drivers",
    """SELECT flight_id, list(label ORDER BY score DESC, name) AS factors FROM (
         SELECT flight_id, 'delay' AS name, 'delay evidence' AS label, c_delay AS score FROM components
         UNION ALL SELECT flight_id, 'weather', 'weather impact', c_weather FROM components
         UNION ALL SELECT flight_id, 'airport_events', 'airport event impact', c_airport FROM components
         UNION ALL SELECT flight_id, 'crew', 'crew readiness', c_crew FROM components
         UNION ALL SELECT flight_id, 'aircraft_health', 'aircraft health evidence', c_health FROM components
         UNION ALL SELECT flight_id, 'passenger_pressure', 'passenger pressure', c_load FROM components
         UNION ALL SELECT flight_id, 'network_reactionary', 'network reactionary pressure', c_network FROM components)
       WHERE score > 0 GROUP BY flight_id""",
)
sql_part(
    "scores",
    """SELECT s.*, greatest(fwd, retro) AS sev, round(1e-10 + greatest(fwd, retro), 6) AS score,
              CASE WHEN greatest(fwd, retro) <= 0.3 THEN 'low' WHEN greatest(fwd, retro) <= 0.6 THEN 'medium' WHEN greatest(fwd, retro) <= 0.8 THEN 'high' ELSE 'severe' END AS band,
              CASE WHEN greatest(fwd, retro) <= 0.3 THEN 'monitor' WHEN greatest(fwd, retro) <= 0.6 THEN 'review' WHEN greatest(fwd, retro) <= 0.8 THEN 'prioritise' ELSE 'urgent_review' END AS priority,
              CASE WHEN greatest(fwd, retro) <= 0.3 THEN 0 WHEN greatest(fwd, retro) <= 0.6 THEN 1 WHEN greatest(fwd, retro) <= 0.8 THEN 2 ELSE 3 END AS priority_rank,
              coalesce(factors[1], 'no elevated component') AS driver, coalesce(array_to_string(factors, '|'), '') AS factors_text
       FROM severities s LEFT JOIN drivers d ON d.flight_id = s.flight_id""",
)


def predictions(t: Tables) -> DataFrame:
    return t.predictions.select(
        "flight_id",
        F.col("probability").alias("delay_probability"),
        F.lit(0.0).alias("estimated_delay_minutes"),
        F.lit("").alias("risk_band"),
    )


def features(t: Tables) -> DataFrame:
    return t.stage("disruption_features", build_features)


def build_features(t: Tables) -> DataFrame:
    return D.disruption_features(
        t.flight_schedule,
        t.delay_history,
        t.crew_operations,
        t.weather_events,
        t.airport_events,
        t.passenger_demand,
        t.aircraft_health,
        delay_predictions=predictions(t),
        demand_ties=("row_key",),
    )


def scores(t: Tables) -> DataFrame:
    return t.stage("scores", lambda t: D.disruption_severity(features(t)))


def stored_scores(t: Tables) -> DataFrame:
    """The score table as its consumers read it."""
    return t.written_stage("scores", scores)


def flag(name: str):
    return F.when(F.col(name), "yes").otherwise("no").alias(name)


@query(
    "disruption_features",
    """SELECT flight_id, route_id, dep_delay AS departure_delay_minutes, arr_delay AS arrival_delay_minutes, reactionary AS reactionary_delay_minutes, round(1e-10 + pressure, 6) AS prior_route_delay_pressure, same_day AS same_day_route_disruption_count,
              round(1e-10 + load, 6) AS latest_booking_load_factor, round(1e-10 + source_risk, 6) AS source_maintenance_risk_score, round(1e-10 + impact, 6) AS max_weather_impact_score, ow AS origin_weather_event_count, dw AS destination_weather_event_count,
              ae AS airport_event_count, cast(ae_sev AS double) AS maximum_airport_event_severity, cast(ae_red AS double) AS maximum_capacity_reduction_percent, cast(ae_delay AS double) AS estimated_airport_event_delay, prob AS predicted_delay_probability,
              CASE WHEN outcome THEN 'yes' ELSE 'no' END AS delay_outcome_available, CASE WHEN severe THEN 'yes' ELSE 'no' END AS severe_weather_flag, CASE WHEN shortage THEN 'yes' ELSE 'no' END AS crew_shortage_flag,
              CASE WHEN source_risk > 0.6 THEN 'yes' ELSE 'no' END AS aircraft_disruption_flag, CASE WHEN load > 0.9 THEN 'yes' ELSE 'no' END AS passenger_pressure_flag, CASE WHEN reactionary > 0 OR pressure > 0.5 THEN 'yes' ELSE 'no' END AS network_reactionary_flag,
              CASE WHEN weather_hit THEN 'yes' ELSE 'no' END AS weather_exposure_flag, CASE WHEN ae > 0 THEN 'yes' ELSE 'no' END AS airport_event_exposure_flag
       FROM features""",
)
def disruption_features(t: Tables) -> DataFrame:
    plain = (
        "departure_delay_minutes arrival_delay_minutes reactionary_delay_minutes same_day_route_disruption_count "
        "origin_weather_event_count destination_weather_event_count airport_event_count maximum_airport_event_severity "
        "maximum_capacity_reduction_percent estimated_airport_event_delay predicted_delay_probability"
    ).split()
    rounded = (
        "prior_route_delay_pressure latest_booking_load_factor source_maintenance_risk_score max_weather_impact_score"
    ).split()
    flags = (
        "delay_outcome_available severe_weather_flag crew_shortage_flag aircraft_disruption_flag "
        "passenger_pressure_flag network_reactionary_flag weather_exposure_flag airport_event_exposure_flag"
    ).split()
    return features(t).select("flight_id", "route_id", *plain, *[r6(c) for c in rounded], *[flag(c) for c in flags])


@query(
    "disruption_components",
    """SELECT flight_id, round(1e-10 + c_delay, 6) AS delay_component_score, round(1e-10 + c_weather, 6) AS weather_component_score, round(1e-10 + c_airport, 6) AS airport_events_component_score, round(1e-10 + c_crew, 6) AS crew_component_score,
              round(1e-10 + c_health, 6) AS aircraft_health_component_score, round(1e-10 + c_load, 6) AS passenger_pressure_component_score, round(1e-10 + c_network, 6) AS network_reactionary_component_score FROM components""",
)
def disruption_components(t: Tables) -> DataFrame:
    return D.disruption_components(features(t)).select(
        "flight_id", *[r6(f"{name}_component_score") for name in D.COMPONENT_LABELS]
    )


@query(
    "forward_retrospective_score",
    """SELECT flight_id, round(1e-10 + fwd, 6) AS forward_disruption_risk_score, round(1e-10 + retro, 6) AS retrospective_disruption_score FROM severities""",
)
def forward_retrospective_score(t: Tables) -> DataFrame:
    return scores(t).select("flight_id", "forward_disruption_risk_score", "retrospective_disruption_score")


@query(
    "disruption_severity",
    """SELECT flight_id, score AS disruption_severity_score, band AS disruption_risk_band, priority AS recovery_priority, driver AS primary_disruption_driver, factors_text AS contributing_factors,
              CASE WHEN sev >= 0.25 THEN 'yes' ELSE 'no' END AS human_review_required,
              CASE WHEN sev >= 0.75 THEN 'Prioritise' WHEN sev >= 0.5 THEN 'Review' WHEN sev >= 0.25 THEN 'Assess' ELSE 'Monitor' END AS action_word
       FROM scores""",
)
def disruption_severity(t: Tables) -> DataFrame:
    return scores(t).select(
        "flight_id",
        "disruption_severity_score",
        "disruption_risk_band",
        "recovery_priority",
        "primary_disruption_driver",
        F.array_join("contributing_factors", "|").alias("contributing_factors"),
        flag("human_review_required"),
        F.substring_index("recommended_review_action", " ", 1).alias("action_word"),
    )


@query(
    "array_rank",
    """SELECT factors_text AS contributing_factors, driver AS primary_disruption_driver, count(*) AS flights FROM scores GROUP BY ALL""",
)
def array_rank(t: Tables) -> DataFrame:
    return (
        stored_scores(t)
        .groupBy(F.array_join("contributing_factors", "|").alias("contributing_factors"), "primary_disruption_driver")
        .agg(F.count(F.lit(1)).alias("flights"))
    )


@query(
    "band_case",
    """SELECT CASE WHEN probability <= 0.3 THEN 'low' WHEN probability <= 0.6 THEN 'medium' ELSE 'high' END AS risk_band, count(*) AS flights FROM predictions GROUP BY ALL""",
)
def band_case(t: Tables) -> DataFrame:
    bands = ((0.0, 0.3, "low"), (0.3, 0.6, "medium"), (0.6, 1.0, "high"))
    return t.predictions.groupBy(X.band_case("probability", bands).alias("risk_band")).agg(
        F.count(F.lit(1)).alias("flights")
    )


@query("clamp01", "SELECT l_linenumber AS line, round(1e-10 + avg(least(1.0e0, greatest(0.0e0, l_quantity / 40 - 0.2e0))), 6) AS bounded FROM lineitem GROUP BY l_linenumber")
def clamp01(t: Tables) -> DataFrame:
    value = X.clamp01(F.col("l_quantity") / 40 - 0.2)
    return t.base("lineitem").groupBy(F.col("l_linenumber").alias("line")).agg(X.round6(F.avg(value)).alias("bounded"))


SQL_ALERTS = """SELECT concat('DISR-', upper(substr(sha256(concat_ws('|', 'disruption-run', flight_id, band, priority)), 1, 12))) AS alert_id, flight_id, cast(operating_date AS varchar) AS operating_date, score AS disruption_severity_score, band AS disruption_risk_band, factors_text AS contributing_factors, dep_delay AS departure_delay_minutes
   FROM scores WHERE sev >= 0.25 ORDER BY score DESC, scheduled_departure_utc, flight_id LIMIT 100"""
sql_part("alerts", SQL_ALERTS)


def alerts(t: Tables) -> DataFrame:
    return D.disruption_alerts(stored_scores(t), RUN_ID)


@query("disruption_alerts", "SELECT * FROM alerts")
def disruption_alerts(t: Tables) -> DataFrame:
    return alerts(t).select(
        "alert_id",
        "flight_id",
        F.col("operating_date").cast("string").alias("operating_date"),
        "disruption_severity_score",
        "disruption_risk_band",
        F.array_join("contributing_factors", "|").alias("contributing_factors"),
        F.col("evidence_fields.departure_delay_minutes").alias("departure_delay_minutes"),
    )


@query("topk_global", "SELECT flight_id, score AS disruption_severity_score FROM scores ORDER BY score DESC, flight_id LIMIT 50")
def topk_global(t: Tables) -> DataFrame:
    order = [F.col("disruption_severity_score").desc(), F.col("flight_id")]
    return P.topk_global(stored_scores(t), order, 50).select("flight_id", "disruption_severity_score")


def driver_sql(source: str, key: str) -> str:
    return f"""(SELECT {key}, driver FROM (SELECT {key}, driver, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, driver) AS rn FROM {source} GROUP BY {key}, driver) WHERE rn = 1)"""


PRIORITY_SQL = "CASE max(priority_rank) WHEN 0 THEN 'monitor' WHEN 1 THEN 'review' WHEN 2 THEN 'prioritise' ELSE 'urgent_review' END AS review_priority"
STATS_SQL = "count(*) AS flight_count, round(1e-10 + avg(score), 6) AS average_disruption_score, max(score) AS maximum_disruption_score"
HIGH_SQL = "count(*) FILTER (band IN ('high', 'severe')) AS severe_or_high_count"


def summary_sql(source: str, key: str, extra: str, shown: str | None = None) -> str:
    label = shown or key
    return f"""SELECT g.{key} AS {label.split(" AS ")[-1]}, g.* EXCLUDE ({key}), d.driver AS dominant_disruption_driver FROM (SELECT {key}, {extra}, {PRIORITY_SQL} FROM {source} GROUP BY {key}) g JOIN {driver_sql(source, key)} d ON d.{key} = g.{key}"""


sql_part("dated_scores", "SELECT * REPLACE (cast(operating_date AS varchar) AS operating_date) FROM scores")
sql_part(
    "end_scores",
    "SELECT 'dep' AS e, origin_airport AS airport_code, * FROM scores UNION ALL SELECT 'arr', destination_airport, * FROM scores",
)


def tidy(df: DataFrame, rounded: tuple[str, ...] = ("average_disruption_score",)) -> DataFrame:
    out = df.withColumns({c: X.round6(c) for c in rounded})
    if "operating_date" in out.columns:
        out = out.withColumn("operating_date", F.col("operating_date").cast("string"))
    return out


@query(
    "route_summary",
    summary_sql(
        "scores",
        "route_id",
        f"{STATS_SQL}, {HIGH_SQL}, count(*) FILTER (cancelled) AS cancellation_count, count(*) FILTER (diverted) AS diversion_count, round(1e-10 + avg(dep_delay), 6) AS average_delay_minutes",
    ),
)
def route_summary(t: Tables) -> DataFrame:
    return tidy(D.route_summary(stored_scores(t)), ("average_disruption_score", "average_delay_minutes"))


@query(
    "airport_summary",
    summary_sql(
        "end_scores",
        "airport_code",
        f"count(*) FILTER (e = 'dep') AS departure_flight_count, count(*) FILTER (e = 'arr') AS arrival_flight_count, round(1e-10 + avg(score), 6) AS average_disruption_score, max(score) AS maximum_disruption_score, sum(ow + dw) AS weather_event_count, sum(ae) AS airport_event_count, {HIGH_SQL}",
    ),
)
def airport_summary(t: Tables) -> DataFrame:
    return tidy(D.airport_summary(stored_scores(t)))


@query(
    "aircraft_disruption_summary",
    summary_sql(
        "scores",
        "aircraft_id",
        f"{STATS_SQL}, max(aircraft_type) AS aircraft_type, count(*) FILTER (c_health > 0) AS maintenance_related_count, count(*) FILTER (c_network > 0) AS reactionary_delay_count",
    ),
)
def aircraft_disruption_summary(t: Tables) -> DataFrame:
    return tidy(D.aircraft_disruption_summary(stored_scores(t)))


@query(
    "daily_summary",
    summary_sql(
        "dated_scores",
        "operating_date",
        f"{STATS_SQL}, {HIGH_SQL}, count(*) FILTER (cancelled) AS cancellation_count, count(*) FILTER (diverted) AS diversion_count, count(*) FILTER (sev >= 0.25) AS alert_count",
    ),
)
def daily_summary(t: Tables) -> DataFrame:
    return tidy(D.daily_summary(stored_scores(t)))


@query("dominant_value", driver_sql("scores", "route_id").strip("()"))
def dominant_value(t: Tables) -> DataFrame:
    return P.dominant_value(stored_scores(t), ["route_id"], "primary_disruption_driver", "driver")


@query("highest_by_order", f"SELECT aircraft_id, {PRIORITY_SQL} FROM scores GROUP BY aircraft_id")
def highest_by_order(t: Tables) -> DataFrame:
    return (
        stored_scores(t)
        .groupBy("aircraft_id")
        .agg(X.highest_by_order("recovery_priority", D.PRIORITY_ORDER).alias("review_priority"))
    )


@query("label_distribution", "SELECT band AS value, count(*) AS row_count FROM scores GROUP BY band")
def label_distribution(t: Tables) -> DataFrame:
    return D.label_distribution(stored_scores(t), "disruption_risk_band")


COMPONENT_SQL = {
    "delay": "c_delay",
    "weather": "c_weather",
    "airport_events": "c_airport",
    "crew": "c_crew",
    "aircraft_health": "c_health",
    "passenger_pressure": "c_load",
    "network_reactionary": "c_network",
}


@query(
    "component_summary",
    " UNION ALL ".join(
        f"SELECT '{n}' AS component, round(1e-10 + avg({c}), 6) AS average, round(1e-10 + max({c}), 6) AS maximum FROM components"
        for n, c in COMPONENT_SQL.items()
    ),
)
def component_summary(t: Tables) -> DataFrame:
    table = D.component_summary(stored_scores(t), {n: f"{n}_component_score" for n in D.COMPONENT_LABELS})
    return table.select("component", r6("average"), r6("maximum"))


@query(
    "domain_metrics",
    """SELECT 'volume' AS metric_category, 'flight_count' AS metric_name, cast(count(*) AS double) AS metric_value FROM scores
       UNION ALL SELECT 'alerts', 'alert_count', cast(count(*) FILTER (sev >= 0.25) AS double) FROM scores
       UNION ALL SELECT 'risk', 'high_or_severe_rate', round(1e-10 + count(*) FILTER (band IN ('high', 'severe')) / count(*), 6) FROM scores""",
)
def domain_metrics(t: Tables) -> DataFrame:
    scored = stored_scores(t)
    return D.disruption_metrics(scored).select("metric_category", "metric_name", r6("metric_value"))


@query(
    "deterministic_order",
    """SELECT cast(row_number() OVER (ORDER BY operating_date, flight_id, alert_id) AS bigint) AS position, alert_id FROM alerts""",
)
def deterministic_order(t: Tables) -> DataFrame:
    from contrail.sources.readers import consecutive_row_number

    found = alerts(t)
    order = [F.col("operating_date"), F.col("flight_id"), F.col("alert_id")]
    return consecutive_row_number(found, order, [F.unix_date("operating_date")], name="position").select(
        "position", "alert_id"
    )
