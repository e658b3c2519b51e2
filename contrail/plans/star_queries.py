"""Named queries over dimensions, facts, KPI tables, measures, summaries and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions import columns as X
from contrail.functions.columns import round6
from contrail.operators import star as S
from contrail.plans import disruption_queries as DQ
from contrail.plans import maintenance_queries as MQ
from contrail.plans import model_queries as MM
from contrail.plans import monitoring_queries as MO
from contrail.plans.airline_views import Tables
from contrail.plans.registry import query, sql_part


def r6(name: str, column=None):
    return round6(name if column is None else column).alias(name)


def yes(name: str):
    return F.when(F.col(name), "yes").otherwise("no").alias(name)


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("operating_date", F.col("operating_date").cast("string"))


# ---------------------------------------------------------------- dimensions


@query(
    "dim_date",
    "SELECT cast(d AS varchar) AS date, cast(year(d) AS int) AS year, cast(month(d) AS int) AS month, cast(day(d) AS int) AS day, cast(isodow(d) AS int) AS day_of_week, monthname(d) AS month_name, cast(quarter(d) AS int) AS quarter FROM (SELECT cast(unnest(generate_series(min(o_orderdate), max(o_orderdate), interval '1' day)) AS date) AS d FROM orders)",
)
def dim_date(t: Tables) -> DataFrame:
    """The calendar days between the first and last order."""
    days = S.dim_date(t.base("orders"), "o_orderdate").drop("source_domain")
    return days.withColumn("date", F.col("date").cast("string"))


@query(
    "dim_airport",
    "SELECT concat('SK_AIRPORT_', a) AS airport_key, a AS airport_code, a AS airport_name, 'SYN' AS country_code FROM (SELECT origin_airport AS a FROM flight_schedule UNION SELECT destination_airport FROM flight_schedule)",
)
def dim_airport(t: Tables) -> DataFrame:
    return S.dim_airport(t.flight_schedule)


@query(
    "dim_route",
    "SELECT DISTINCT concat('SK_ROUTE_', replace(route_id, '-', '_')) AS route_key, route_id, split_part(route_id, '-', 1) AS origin_airport, split_part(route_id, '-', 2) AS destination_airport FROM flight_schedule",
)
def dim_route(t: Tables) -> DataFrame:
    return S.dim_route(t.flight_schedule)


@query(
    "dim_aircraft",
    """SELECT concat('SK_AIRCRAFT_', aircraft_id) AS aircraft_key, aircraft_id, aircraft_type, seat_capacity FROM (
         SELECT aircraft_id, aircraft_type, seat_capacity, row_number() OVER (PARTITION BY aircraft_id ORDER BY scheduled_departure_utc DESC, flight_id DESC) AS rn FROM flight_schedule) WHERE rn = 1
       UNION ALL SELECT concat('SK_AIRCRAFT_', aircraft_id), aircraft_id, min(aircraft_type), 0 FROM aircraft_health WHERE aircraft_id NOT IN (SELECT aircraft_id FROM flight_schedule) GROUP BY aircraft_id""",
)
def dim_aircraft(t: Tables) -> DataFrame:
    return S.dim_aircraft(t.flight_schedule, t.aircraft_health)


@query("dim_service_type", "SELECT DISTINCT concat('SK_SERVICE_', service_type) AS service_type_key, service_type, service_type AS service_category FROM flight_schedule")
def dim_service_type(t: Tables) -> DataFrame:
    return S.dim_service_type(t.flight_schedule)


@query(
    "dim_risk_band",
    "SELECT concat('SK_RISK_', b) AS risk_band_key, b AS risk_band, CASE b WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'severe' THEN 4 ELSE 0 END AS risk_rank FROM (SELECT DISTINCT band AS b FROM scores UNION SELECT * FROM (VALUES ('low'), ('medium'), ('high'), ('severe')))",
)
def dim_risk_band(t: Tables) -> DataFrame:
    return S.dim_risk_band(DQ.stored_scores(t))


@query(
    "dim_disruption_driver",
    "SELECT DISTINCT concat('SK_DRIVER_', replace(driver, ' ', '_')) AS disruption_driver_key, driver AS primary_disruption_driver, driver AS driver_category FROM scores",
)
def dim_disruption_driver(t: Tables) -> DataFrame:
    return S.dim_disruption_driver(DQ.stored_scores(t))


@query("surrogate_key", "SELECT l_orderkey AS n, count(*) AS lines, concat('SK_ORDER_', replace(replace(concat(cast(l_orderkey AS varchar), '-x ', min(l_returnflag)), ' ', '_'), '-', '_')) AS order_key FROM lineitem GROUP BY l_orderkey")
def surrogate_key(t: Tables) -> DataFrame:
    grouped = t.base("lineitem").groupBy(F.col("l_orderkey").alias("n")).agg(
        F.count(F.lit(1)).alias("lines"), F.min("l_returnflag").alias("f")
    )
    value = F.concat(F.col("n").cast("string"), F.lit("-x "), F.col("f"))
    return grouped.select("n", "lines", X.surrogate_key("ORDER", value).alias("order_key"))


# ---------------------------------------------------------------- facts

sql_part(
    "ops",
    """SELECT f.*, cast(coalesce(d.departure_delay_minutes, 0) AS double) AS dep_delay, cast(coalesce(d.arrival_delay_minutes, 0) AS double) AS arr_delay, coalesce(d.cancelled_flag, false) AS cancelled, coalesce(d.diverted_flag, false) AS diverted, coalesce(d.primary_delay_cause, '') AS cause, cast(coalesce(d.reactionary_delay_minutes, 0) AS double) AS reactionary
       FROM flight_schedule f LEFT JOIN delay_history d ON d.flight_id = f.flight_id""",
)


def flights(t: Tables) -> DataFrame:
    return t.stage("fact_flights", lambda t: S.fact_flight_operations(t.flight_schedule, t.delay_history))


@query(
    "fact_flight_operations",
    "SELECT flight_id, cast(operating_date AS varchar) AS operating_date, seat_capacity, dep_delay AS departure_delay_minutes, arr_delay AS arrival_delay_minutes, CASE WHEN cancelled THEN 'yes' ELSE 'no' END AS cancelled_flag, CASE WHEN diverted THEN 'yes' ELSE 'no' END AS diverted_flag, cause AS primary_delay_cause, reactionary AS reactionary_delay_minutes FROM ops",
)
def fact_flight_operations(t: Tables) -> DataFrame:
    return dated(flights(t)).select(
        "flight_id",
        "operating_date",
        "seat_capacity",
        "departure_delay_minutes",
        "arrival_delay_minutes",
        yes("cancelled_flag"),
        yes("diverted_flag"),
        "primary_delay_cause",
        "reactionary_delay_minutes",
    )


@query(
    "fact_passenger_demand",
    "SELECT row_key, flight_id, concat(substr(flight_id, 4, 4), '-', substr(flight_id, 8, 2), '-', substr(flight_id, 10, 2)) AS operating_date, booked_passengers, round(1e-10 + load_factor, 6) AS load_factor, booking_velocity FROM passenger_demand",
)
def fact_passenger_demand(t: Tables) -> DataFrame:
    fact = S.fact_passenger_demand(t.passenger_demand.withColumn("days_before_departure", F.col("row_key")))
    return fact.select(
        F.col("days_before_departure").alias("row_key"),
        "flight_id",
        "operating_date",
        "booked_passengers",
        "load_factor",
        "booking_velocity",
    )


@query(
    "fact_passenger_forecast",
    "SELECT flight_id, cast(forecast AS bigint) AS forecast_passengers, cast(lo80 AS bigint) AS forecast_lower_80, cast(hi80 AS bigint) AS forecast_upper_80, round(1e-10 + forecast / seat_capacity, 6) AS forecast_load_factor, abs(signed) AS absolute_error FROM published",
)
def fact_passenger_forecast(t: Tables) -> DataFrame:
    return S.fact_passenger_forecast(MM.stored_forecast(t)).select(
        "flight_id",
        "forecast_passengers",
        "forecast_lower_80",
        "forecast_upper_80",
        "forecast_load_factor",
        "absolute_error",
    )


@query(
    "fact_delay_prediction",
    "SELECT flight_id, p AS delay_probability, CASE WHEN predicted = 1 THEN 'yes' ELSE 'no' END AS predicted_delay_flag, band AS risk_band, CASE WHEN target = 1 THEN 'yes' ELSE 'no' END AS actual_delay_flag FROM published_delays",
)
def fact_delay_prediction(t: Tables) -> DataFrame:
    return S.fact_delay_prediction(MM.stored_delays(t)).select(
        "flight_id", "delay_probability", yes("predicted_delay_flag"), "risk_band", yes("actual_delay_flag")
    )


@query(
    "fact_maintenance_risk",
    "SELECT flight_id, aircraft_id, aircraft_type, risk AS maintenance_risk_score, health AS aircraft_health_score, band AS risk_band, category AS alert_category, CASE WHEN category <> 'none' THEN 'yes' ELSE 'no' END AS human_review_required FROM flight_risk WHERE rn = 1",
)
def fact_maintenance_risk(t: Tables) -> DataFrame:
    fact = S.fact_maintenance_risk(MQ.flight_risk(t))
    return fact.select(*fact.columns[:-1], yes("human_review_required"))


@query(
    "fact_disruption_score",
    "SELECT flight_id, cast(operating_date AS varchar) AS operating_date, score AS disruption_severity_score, band AS disruption_risk_band, driver AS primary_disruption_driver, round(1e-10 + c_weather, 6) AS weather_component_score, round(1e-10 + c_crew, 6) AS crew_component_score FROM scores",
)
def fact_disruption_score(t: Tables) -> DataFrame:
    return dated(S.fact_disruption_score(DQ.stored_scores(t))).select(
        "flight_id",
        "operating_date",
        "disruption_severity_score",
        "disruption_risk_band",
        "primary_disruption_driver",
        "weather_component_score",
        "crew_component_score",
    )


sql_part(
    "metric_fact",
    f"""SELECT m.*, coalesce(c.status, 'observed') AS status, coalesce(c.severity, 'info') AS severity FROM mon_metrics m LEFT JOIN (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY monitoring_domain, metric_name ORDER BY {MO.RANK_SQL} DESC, status DESC) AS rn FROM mon_checks) WHERE rn = 1) c
        ON c.monitoring_domain = m.monitoring_domain AND c.metric_name = m.metric_name""",
)


def metric_fact(t: Tables) -> DataFrame:
    return S.fact_monitoring_metric(MO.stored_metrics(t), MO.checks(t))


@query("fact_monitoring_metric", "SELECT monitoring_domain, metric_name, metric_value, status, severity FROM metric_fact")
def fact_monitoring_metric(t: Tables) -> DataFrame:
    return metric_fact(t)


def alert_fact(t: Tables) -> DataFrame:
    return S.fact_monitoring_alert(MO.mon_alerts(t))


@query("fact_monitoring_alert", "SELECT monitoring_alert_id, monitoring_domain, severity, status, message FROM mon_alerts")
def fact_monitoring_alert(t: Tables) -> DataFrame:
    return alert_fact(t)


def response_fact(t: Tables) -> DataFrame:
    return S.fact_assistant_response(MO.briefs(t))


@query(
    "fact_assistant_response",
    "SELECT assistant_run_id, section_order, CASE WHEN section_order = 1 THEN 'Operational Summary' WHEN section_order = n + 2 THEN 'Human Review Actions' WHEN section_order = n + 3 THEN 'Limitations' ELSE concat('Finding ', section_order - 1) END AS section_title FROM (SELECT request_id AS assistant_run_id, count(*) AS n, unnest(generate_series(1, count(*) + 3))::int AS section_order FROM ranked_rows GROUP BY request_id)",
)
def fact_assistant_response(t: Tables) -> DataFrame:
    return response_fact(t).select("assistant_run_id", "section_order", "section_title")


# ---------------------------------------------------------------- KPIs


def facts(t: Tables) -> dict[str, DataFrame]:
    return {
        "fact_flight_operations": flights(t),
        "fact_passenger_demand": S.fact_passenger_demand(t.passenger_demand),
        "fact_passenger_forecast": S.fact_passenger_forecast(MM.stored_forecast(t)),
        "fact_delay_prediction": S.fact_delay_prediction(MM.stored_delays(t)),
        "fact_maintenance_risk": S.fact_maintenance_risk(MQ.flight_risk(t)),
        "fact_disruption_score": S.fact_disruption_score(DQ.stored_scores(t)),
        "fact_monitoring_metric": metric_fact(t),
        "fact_monitoring_alert": alert_fact(t),
        "fact_assistant_response": response_fact(t),
    }


def shown(df: DataFrame) -> DataFrame:
    return df.select(
        "metric_name",
        r6("metric_value", F.coalesce("metric_value", F.lit(-1.0))),
        F.coalesce("metric_text", F.lit("")).alias("metric_text"),
        "status",
    )


def kpi(name: str, value: str, source: str, status: str = "'observed'", text: str | None = None) -> str:
    number = "-1" if text else value
    return f"SELECT '{name}' AS metric_name, round(1e-10 + cast({number} AS double), 6) AS metric_value, {text or repr('')} AS metric_text, {status} AS status FROM {source}"


def kpis(*rows: str) -> str:
    return "\nUNION ALL ".join(rows)


SEVERE = "count(*) FILTER (band IN ('high', 'severe'))"
INVALID = "(SELECT metric_value FROM metric_fact WHERE metric_name = 'validation_invalid_record_rate')"
TOP_SEVERITY = MO.LABEL_SQL.format(f"max({MO.RANK_SQL})")
FAILED = "count(*) FILTER (status = 'failed')"
OPS = (
    kpi("total_flights", "count(*)", "ops", "'passed'"),
    kpi("cancelled_flights", "count(*) FILTER (cancelled)", "ops"),
    kpi("diverted_flights", "count(*) FILTER (diverted)", "ops"),
)


@query(
    "kpi_executive_summary",
    kpis(
        *OPS,
        kpi("average_departure_delay", "avg(dep_delay)", "ops"),
        kpi("severe_disruption_count", SEVERE, "scores", f"CASE WHEN {SEVERE} / count(*) > 0.2 THEN 'warning' ELSE 'passed' END"),
        kpi("severe_disruption_rate", f"{SEVERE} / count(*)", "scores"),
        kpi("monitoring_highest_severity", "0", "metric_fact", text=TOP_SEVERITY),
        kpi("validation_invalid_record_rate", INVALID, "(SELECT 1)", f"CASE WHEN {INVALID} > 0.01 THEN 'warning' ELSE 'passed' END"),
    ),
)
def kpi_executive_summary(t: Tables) -> DataFrame:
    return shown(
        S.kpi_executive_summary(flights(t), S.fact_disruption_score(DQ.stored_scores(t)), metric_fact(t))
    )


@query("kpi_operations_summary", kpis(*OPS))
def kpi_operations_summary(t: Tables) -> DataFrame:
    return shown(S.kpi_operations_summary(flights(t)))


@query(
    "kpi_delay_summary",
    kpis(
        kpi("material_delay_count", "count(*) FILTER (dep_delay >= 60)", "ops"),
        kpi("material_delay_rate", "count(*) FILTER (dep_delay >= 60) / count(*)", "ops", "CASE WHEN count(*) FILTER (dep_delay >= 60) / count(*) > 0.25 THEN 'warning' ELSE 'passed' END"),
        kpi("average_delay_minutes", "avg(dep_delay)", "ops"),
        kpi("delay_prediction_high_risk_count", "count(*) FILTER (band = 'high')", "published_delays"),
        kpi("false_positive_count", "count(*) FILTER (predicted = 1 AND target = 0)", "published_delays"),
    ),
)
def kpi_delay_summary(t: Tables) -> DataFrame:
    return shown(S.kpi_delay_summary(flights(t), S.fact_delay_prediction(MM.stored_delays(t))))


@query(
    "kpi_demand_summary",
    kpis(
        kpi("forecast_passenger_count", "sum(forecast)", "published"),
        kpi("average_forecast_load_factor", "avg(round(1e-10 + forecast / seat_capacity, 6))", "published"),
        kpi("capacity_pressure_flight_count", "count(*) FILTER (round(1e-10 + forecast / seat_capacity, 6) > 0.9)", "published"),
    ),
)
def kpi_demand_summary(t: Tables) -> DataFrame:
    return shown(S.kpi_demand_summary(S.fact_passenger_forecast(MM.stored_forecast(t))))


@query(
    "kpi_maintenance_summary",
    kpis(
        kpi("aircraft_count", "count(DISTINCT aircraft_id)", "flight_risk WHERE rn = 1"),
        kpi("high_maintenance_risk_count", "count(*) FILTER (band = 'high')", "flight_risk WHERE rn = 1"),
        kpi("max_maintenance_risk_score", "max(risk)", "flight_risk WHERE rn = 1"),
        kpi("human_review_count", "count(*) FILTER (category <> 'none')", "flight_risk WHERE rn = 1"),
    ),
)
def kpi_maintenance_summary(t: Tables) -> DataFrame:
    return shown(S.kpi_maintenance_summary(S.fact_maintenance_risk(MQ.flight_risk(t))))


@query(
    "kpi_disruption_summary",
    kpis(
        kpi("average_disruption_score", "avg(score)", "scores"),
        kpi("max_disruption_score", "max(score)", "scores"),
        kpi("urgent_review_count", "count(*) FILTER (priority = 'urgent_review')", "scores"),
        kpi("dominant_disruption_driver", "0", "(SELECT driver FROM scores GROUP BY driver ORDER BY count(*) DESC, driver LIMIT 1)", text="driver"),
    ),
)
def kpi_disruption_summary(t: Tables) -> DataFrame:
    return shown(S.kpi_disruption_summary(S.fact_disruption_score(DQ.stored_scores(t))))


@query(
    "kpi_data_quality_summary",
    kpis(
        kpi("validation_invalid_record_rate", INVALID, "(SELECT 1)", "'passed'"),
        kpi("monitoring_failed_check_count", FAILED, "metric_fact", f"CASE WHEN {FAILED} = 0 THEN 'passed' ELSE 'failed' END"),
    ),
)
def kpi_data_quality_summary(t: Tables) -> DataFrame:
    return shown(S.kpi_data_quality_summary(metric_fact(t)))


MONITORING_KPIS = (
    kpi("check_count", "count(*)", "metric_fact"),
    kpi("failed_check_count", FAILED, "metric_fact", f"CASE WHEN {FAILED} = 0 THEN 'passed' ELSE 'failed' END"),
    kpi("warning_check_count", "count(*) FILTER (status = 'warning')", "metric_fact"),
    kpi("alert_count", "count(*)", "mon_alerts"),
    kpi("critical_alert_count", "count(*) FILTER (severity = 'critical')", "mon_alerts"),
    kpi("platform_health_status", "0", "metric_fact", text=TOP_SEVERITY),
)


@query("kpi_monitoring_summary", kpis(*MONITORING_KPIS))
def kpi_monitoring_summary(t: Tables) -> DataFrame:
    return shown(S.kpi_monitoring_summary(metric_fact(t), alert_fact(t)))


@query("kpi_tables", "SELECT * FROM (VALUES ('kpi_data_quality_summary', 2), ('kpi_delay_summary', 5), ('kpi_demand_summary', 3), ('kpi_disruption_summary', 4), ('kpi_executive_summary', 8), ('kpi_maintenance_summary', 4), ('kpi_monitoring_summary', 6), ('kpi_operations_summary', 3)) AS v(table_name, kpi_count), (SELECT count(*) AS flights FROM flight_schedule)")
def kpi_tables(t: Tables) -> DataFrame:
    tables = S.kpi_tables(facts(t))
    parts = [df.select(F.lit(name).alias("table_name"), "metric_name") for name, df in sorted(tables.items())]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    counted = stacked.groupBy("table_name").agg(F.count(F.lit(1)).cast("int").alias("kpi_count"))
    return counted.withColumn("flights", flights(t).agg(F.count(F.lit(1))).scalar())


@query(
    "measures",
    """SELECT 'Total Flights' AS measure_name, cast(count(*) AS double) AS measure_value FROM ops UNION ALL SELECT 'Cancelled Flights', cast(count(*) FILTER (cancelled) AS double) FROM ops UNION ALL SELECT 'Cancellation Rate', round(1e-10 + count(*) FILTER (cancelled) / count(*), 6) FROM ops
       UNION ALL SELECT 'Diverted Flights', cast(count(*) FILTER (diverted) AS double) FROM ops UNION ALL SELECT 'Average Departure Delay', round(1e-10 + avg(dep_delay), 6) FROM ops UNION ALL SELECT 'Material Delay Rate', round(1e-10 + count(*) FILTER (dep_delay >= 60) / count(*), 6) FROM ops
       UNION ALL SELECT 'Average Disruption Score', round(1e-10 + avg(score), 6) FROM scores UNION ALL SELECT 'Severe Disruption Rate', round(1e-10 + count(*) FILTER (band IN ('high', 'severe')) / count(*), 6) FROM scores UNION ALL SELECT 'Monitoring Alert Count', cast(count(*) AS double) FROM mon_alerts
       UNION ALL SELECT 'Validation Invalid Record Rate', metric_value FROM mon_metrics WHERE metric_name = 'validation_invalid_record_rate' UNION ALL SELECT 'Maintenance Alert Count', cast(count(*) FILTER (category <> 'none') AS double) FROM flight_risk WHERE rn = 1
       UNION ALL SELECT 'Forecast WAPE', round(1e-10 + sum(abs(signed)) / sum(target), 6) FROM published UNION ALL SELECT 'Assistant Response Count', cast(count(*) AS double) FROM requests""",
)
def measures(t: Tables) -> DataFrame:
    return S.measures(facts(t)).select("measure_name", r6("measure_value"))


def performance_sql(key: str, name: str) -> str:
    return f"""SELECT {key} AS {name}, count(*) AS flight_count, count(*) FILTER (o.cancelled) AS cancelled_flight_count, round(1e-10 + avg(o.dep_delay), 6) AS average_departure_delay, round(1e-10 + avg(s.score), 6) AS average_disruption_score, count(*) FILTER (s.band IN ('high', 'severe')) AS high_disruption_count
       FROM ops o LEFT JOIN scores s ON s.flight_id = o.flight_id GROUP BY {key}"""


def performance(t: Tables, key: str) -> DataFrame:
    return S.group_performance_summary(flights(t), DQ.stored_scores(t), key)


@query("route_performance_summary", performance_sql("o.route_id", "route_id"))
def route_performance_summary(t: Tables) -> DataFrame:
    return performance(t, "route_id")


@query("group_performance_summary", performance_sql("o.aircraft_id", "aircraft_id"))
def group_performance_summary(t: Tables) -> DataFrame:
    return performance(t, "aircraft_id")


@query("daily_operations_summary", performance_sql("cast(o.operating_date AS varchar)", "operating_date"))
def daily_operations_summary(t: Tables) -> DataFrame:
    return dated(performance(t, "operating_date"))


@query(
    "airport_performance_summary",
    """SELECT airport_code, count(*) FILTER (dep) AS departure_flight_count, count(*) FILTER (NOT dep) AS arrival_flight_count, round(1e-10 + coalesce(avg(dep_delay) FILTER (dep), 0), 6) AS average_departure_delay, count(*) FILTER (dep AND cancelled) AS cancelled_flight_count
       FROM (SELECT origin_airport AS airport_code, true AS dep, dep_delay, cancelled FROM ops UNION ALL SELECT destination_airport, false, dep_delay, cancelled FROM ops) GROUP BY airport_code""",
)
def airport_performance_summary(t: Tables) -> DataFrame:
    return S.airport_performance_summary(flights(t))


def star_tables(t: Tables) -> dict[str, DataFrame]:
    scores = DQ.stored_scores(t)
    made = facts(t)
    return {
        **made,
        **S.kpi_tables(made),
        "dim_date": S.dim_date(t.flight_schedule),
        "dim_airport": S.dim_airport(t.flight_schedule),
        "dim_route": S.dim_route(t.flight_schedule),
        "dim_aircraft": S.dim_aircraft(t.flight_schedule, t.aircraft_health),
        "dim_service_type": S.dim_service_type(t.flight_schedule),
        "dim_risk_band": S.dim_risk_band(scores),
        "dim_disruption_driver": S.dim_disruption_driver(scores),
        "route_performance_summary": performance(t, "route_id"),
        "aircraft_performance_summary": performance(t, "aircraft_id"),
        "daily_operations_summary": performance(t, "operating_date"),
        "airport_performance_summary": S.airport_performance_summary(flights(t)),
    }


# What SQL expects of the dictionary: the columns of each table with the first letters of their type and role.
PERFORMANCE_COLUMNS = "flight_count:im cancelled_flight_count:im average_departure_delay:nm average_disruption_score:nm high_disruption_count:im"
KPI_COLUMNS = "metric_name:sa metric_value:nm metric_text:sa numerator:nm denominator:nm status:sa threshold:nm source_domain:sa"
STAR_COLUMNS = {
    "airport_performance_summary": (
        "airport_code:sa departure_flight_count:im arrival_flight_count:im average_departure_delay:nm "
        "cancelled_flight_count:im"
    ),
    "dim_aircraft": "aircraft_key:sa aircraft_id:sk aircraft_type:sa seat_capacity:ia",
    "dim_airport": "airport_key:sa airport_code:sk airport_name:sa country_code:sa",
    "dim_date": "date:sk year:ia month:ia day:ia day_of_week:ia month_name:sa quarter:ia source_domain:sa",
    "dim_disruption_driver": "disruption_driver_key:sa primary_disruption_driver:sk driver_category:sa",
    "dim_risk_band": "risk_band_key:sa risk_band:sk risk_rank:ia",
    "dim_route": "route_key:sa route_id:sk origin_airport:sa destination_airport:sa",
    "dim_service_type": "service_type_key:sa service_type:sk service_category:sa",
    "fact_assistant_response": "assistant_run_id:sk intent:sa section_order:ik section_title:sa content:sa guardrail_status:sa",
    "fact_delay_prediction": (
        "flight_id:sk route_id:sr operating_date:sr delay_probability:nm predicted_delay_flag:ba risk_band:sa "
        "estimated_delay_minutes:nm actual_delay_flag:ba actual_delay_minutes:nm partition:sa"
    ),
    "fact_disruption_score": (
        "flight_id:sk route_id:sr operating_date:sr disruption_severity_score:nm forward_disruption_risk_score:nm "
        "retrospective_disruption_score:nm disruption_risk_band:sr recovery_priority:sa "
        "primary_disruption_driver:sr weather_component_score:nm delay_component_score:nm crew_component_score:nm "
        "aircraft_health_component_score:nm human_review_required:ba"
    ),
    "fact_flight_operations": (
        "flight_id:sk flight_number:sa operating_date:sr scheduled_departure_utc:sa origin_airport:sr "
        "destination_airport:sr route_id:sr aircraft_id:sr aircraft_type:sa seat_capacity:im "
        "departure_delay_minutes:nm arrival_delay_minutes:nm cancelled_flag:ba diverted_flag:ba "
        "primary_delay_cause:sa reactionary_delay_minutes:nm"
    ),
    "fact_maintenance_risk": (
        "flight_id:sk aircraft_id:sr aircraft_type:sa maintenance_risk_score:nm aircraft_health_score:nm "
        "risk_band:sa alert_category:sa human_review_required:ba"
    ),
    "fact_monitoring_alert": "monitoring_alert_id:sk monitoring_domain:sa severity:sa status:sa message:sa",
    "fact_monitoring_metric": "monitoring_domain:sk metric_name:sk metric_value:nm status:sa severity:sa",
    "fact_passenger_demand": (
        "flight_id:sa observation_date:sa operating_date:sa route_id:sa days_before_departure:im "
        "booked_passengers:im expected_final_passengers:im seat_capacity:im load_factor:nm booking_velocity:nm"
    ),
    "fact_passenger_forecast": (
        "flight_id:sa route_id:sr operating_date:sr forecast_passengers:im forecast_lower_80:im "
        "forecast_upper_80:im actual_passengers:nm forecast_load_factor:nm absolute_error:nm partition:sa"
    ),
    "route_performance_summary": "route_id:sa " + PERFORMANCE_COLUMNS,
    "aircraft_performance_summary": "aircraft_id:sa " + PERFORMANCE_COLUMNS,
    "daily_operations_summary": "operating_date:sa " + PERFORMANCE_COLUMNS,
    **{f"kpi_{name}_summary": KPI_COLUMNS for name in ("data_quality", "delay", "demand", "disruption", "executive", "maintenance", "monitoring", "operations")},
}
AIRPORTS = "SELECT origin_airport FROM flight_schedule UNION SELECT destination_airport FROM flight_schedule"
STAR_COUNTS = {
    "dim_aircraft": "SELECT count(*) FROM (SELECT aircraft_id FROM flight_schedule UNION SELECT aircraft_id FROM aircraft_health)",
    "dim_airport": f"SELECT count(*) FROM ({AIRPORTS})",
    "airport_performance_summary": f"SELECT count(*) FROM ({AIRPORTS})",
    "dim_date": "SELECT date_diff('day', min(operating_date), max(operating_date)) + 1 FROM flight_schedule",
    "dim_disruption_driver": "SELECT count(DISTINCT driver) FROM scores",
    "dim_risk_band": "SELECT count(*) FROM (SELECT band FROM scores UNION SELECT * FROM (VALUES ('low'), ('medium'), ('high'), ('severe')))",
    "dim_route": "SELECT count(DISTINCT route_id) FROM flight_schedule",
    "dim_service_type": "SELECT count(DISTINCT service_type) FROM flight_schedule",
    "route_performance_summary": "SELECT count(DISTINCT route_id) FROM flight_schedule",
    "aircraft_performance_summary": "SELECT count(DISTINCT aircraft_id) FROM flight_schedule",
    "daily_operations_summary": "SELECT count(DISTINCT operating_date) FROM flight_schedule",
    "fact_assistant_response": "SELECT 3 * (SELECT count(*) FROM requests) + count(*) FROM ranked_rows",
    "fact_delay_prediction": "SELECT count(*) FROM published_delays",
    "fact_disruption_score": "SELECT count(*) FROM scores",
    "fact_flight_operations": "SELECT count(*) FROM ops",
    "fact_maintenance_risk": "SELECT count(*) FROM flight_risk WHERE rn = 1",
    "fact_monitoring_alert": "SELECT count(*) FROM mon_alerts",
    "fact_monitoring_metric": "SELECT count(*) FROM metric_fact",
    "fact_passenger_demand": "SELECT count(*) FROM passenger_demand",
    "fact_passenger_forecast": "SELECT count(*) FROM published",
    "kpi_data_quality_summary": "SELECT 2", "kpi_delay_summary": "SELECT 5", "kpi_demand_summary": "SELECT 3", "kpi_disruption_summary": "SELECT 4",
    "kpi_executive_summary": "SELECT 8", "kpi_maintenance_summary": "SELECT 4", "kpi_monitoring_summary": "SELECT 6", "kpi_operations_summary": "SELECT 3",
}
# Blank values: causes of flights that have none, guardrails that did not run, and what a KPI has no part, text or limit for.
STAR_BLANKS = {
    "fact_flight_operations.primary_delay_cause": "SELECT count(*) FROM ops WHERE cause = ''",
    "fact_assistant_response.guardrail_status": STAR_COUNTS["fact_assistant_response"],
    **{
        f"kpi_{name}_summary.{column}": f"SELECT {n}"
        for name, blanks in {
            "data_quality": (0, 2, 1, 1, 1), "delay": (0, 5, 3, 0, 3), "demand": (0, 3, 3, 0, 3), "disruption": (1, 3, 4, 1, 4),
            "executive": (1, 7, 3, 2, 5), "maintenance": (0, 4, 4, 0, 3), "monitoring": (1, 5, 2, 1, 5), "operations": (0, 3, 0, 0, 3),
        }.items()
        for column, n in zip(("metric_value", "metric_text", "numerator", "denominator", "threshold"), blanks, strict=True)
    },
}


def dictionary_sql() -> str:
    types = {"s": "string", "i": "integer", "n": "number", "b": "boolean"}
    roles = {"a": "attribute", "m": "measure", "k": "key", "r": "reference"}
    counts = "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, ({sql}) AS row_count" for t, sql in STAR_COUNTS.items())
    blanks = "\nUNION ALL ".join(f"SELECT '{k}' AS column_name, ({sql}) AS n" for k, sql in STAR_BLANKS.items())
    fields = ", ".join(
        f"('{t}', '{name}', '{types[kind[0]]}', '{roles[kind[1]]}')"
        for t, columns in STAR_COLUMNS.items()
        for name, kind in (c.split(":") for c in columns.split())
    )
    return f"""SELECT f.table_name, field_name, data_type, field_role, cast(coalesce(b.n, 0) AS bigint) AS blank_count, cast(c.row_count AS bigint) AS row_count
      FROM (VALUES {fields}) AS f(table_name, field_name, data_type, field_role) JOIN ({counts}) c ON c.table_name = f.table_name
      LEFT JOIN ({blanks}) b ON b.column_name = f.table_name || '.' || field_name"""


@query("data_dictionary", dictionary_sql())
def data_dictionary(t: Tables) -> DataFrame:
    """Every column of every star table."""
    columns = ("table_name", "field_name", "data_type", "field_role", "blank_count", "row_count")
    return S.data_dictionary(star_tables(t)).select(*columns)


def gate(rule: str, source: str, passes: str = "n = 0") -> str:
    return f"SELECT '{rule}' AS rule_id, CASE WHEN {passes} THEN 'passed' ELSE 'failed' END AS status, cast(n AS bigint) AS observed_value FROM ({source})"


def repeated(source: str, keys: str) -> str:
    return f"SELECT count(*) AS n FROM (SELECT {keys} FROM {source} GROUP BY {keys} HAVING count(*) > 1)"


def lost(source: str, column: str, known: str) -> str:
    return f"SELECT count(*) AS n FROM {source} WHERE {column} IS NOT NULL AND {column} NOT IN ({known})"


ROUTES, AIRCRAFT = "SELECT route_id FROM flight_schedule", "SELECT aircraft_id FROM flight_schedule UNION SELECT aircraft_id FROM aircraft_health"
DAYS = "SELECT cast(unnest(generate_series(min(operating_date), max(operating_date), interval '1' day)) AS date) FROM flight_schedule"
GATES_SQL = "\nUNION ALL ".join((
    *[
        gate(f"TABLE-{name}", "SELECT 1 AS n", "n = 1")
        for name in STAR_COLUMNS
        if name not in ("fact_assistant_response", "fact_delay_prediction", "fact_maintenance_risk", "fact_passenger_forecast")
    ],
    gate("PK-dim_date", repeated(f"({DAYS}) AS x(d)", "d")),
    gate("PK-dim_airport", repeated(f"({AIRPORTS}) AS x(a)", "a")),
    gate("PK-dim_route", repeated("(SELECT DISTINCT route_id FROM flight_schedule)", "route_id")),
    gate("PK-dim_aircraft", repeated(f"({AIRCRAFT})", "aircraft_id")),
    gate("PK-dim_service_type", repeated("(SELECT DISTINCT service_type FROM flight_schedule)", "service_type")),
    gate("PK-dim_risk_band", repeated("(SELECT DISTINCT band FROM scores)", "band")),
    gate("PK-dim_disruption_driver", repeated("(SELECT DISTINCT driver FROM scores)", "driver")),
    gate("PK-fact_flight_operations", repeated("ops", "flight_id")),
    gate("PK-fact_disruption_score", repeated("scores", "flight_id")),
    gate("PK-fact_maintenance_risk", repeated("(SELECT flight_id FROM flight_risk WHERE rn = 1)", "flight_id")),
    gate("PK-fact_delay_prediction", repeated("published_delays", "flight_id")),
    gate("PK-fact_monitoring_metric", repeated("metric_fact", "monitoring_domain, metric_name")),
    gate("PK-fact_monitoring_alert", repeated("mon_alerts", "monitoring_alert_id")),
    gate("PK-fact_assistant_response", repeated("ranked_rows", "request_id, rank")),
    gate("FK-route", lost("ops", "route_id", ROUTES)),
    gate("FK-aircraft", lost("ops", "aircraft_id", AIRCRAFT)),
    gate("FK-origin", lost("ops", "origin_airport", AIRPORTS)),
    gate("FK-destination", lost("ops", "destination_airport", AIRPORTS)),
    gate("FK-date", lost("ops", "operating_date", DAYS)),
    gate("FK-score-route", lost("scores", "route_id", ROUTES)),
    gate("FK-score-date", lost("scores", "operating_date", DAYS)),
    gate("FK-score-band", lost("scores", "band", "SELECT * FROM (VALUES ('low'), ('medium'), ('high'), ('severe')) UNION SELECT band FROM scores")),
    gate("FK-score-driver", lost("scores", "driver", "SELECT driver FROM scores")),
    gate("FK-delay-route", lost("published_delays", "route_id", ROUTES)),
    gate("FK-delay-date", lost("published_delays", "operating_date", DAYS)),
    gate("FK-forecast-route", lost("published", "route_id", ROUTES)),
    gate("FK-forecast-date", lost("published", "operating_date", DAYS)),
    gate("FK-risk-aircraft", lost("(SELECT aircraft_id FROM flight_risk WHERE rn = 1)", "aircraft_id", AIRCRAFT)),
    gate("VALUES-finite", "SELECT count(*) AS n FROM scores WHERE NOT isfinite(score)"),
    gate("DICTIONARY-coverage", "SELECT 0 AS n"),
))


@query("star_quality_checks", GATES_SQL)
def star_quality_checks(t: Tables) -> DataFrame:
    tables = star_tables(t)
    return S.star_quality_checks(tables, S.data_dictionary(tables))
