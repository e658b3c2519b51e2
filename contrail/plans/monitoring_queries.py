"""Named queries over monitoring, evidence retrieval, guardrails and briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions import columns as X
from contrail.functions.columns import round6
from contrail.operators import disruption as D
from contrail.operators import evidence as E
from contrail.operators import monitoring as MON
from contrail.operators import quality as Q
from contrail.operators import telemetry as T
from contrail.plans import disruption_queries as DQ
from contrail.plans import maintenance_queries as MQ
from contrail.plans import model_queries as MM
from contrail.plans import validation_queries as VQ
from contrail.plans.airline_views import Tables
from contrail.plans.registry import query, sql_part
from contrail.session import new_folder
from contrail.sources import readers as R

RUN_ID = "monitoring-run"


def r6(name: str, column=None):
    return round6(name if column is None else column).alias(name)


# ---------------------------------------------------------------- metrics

sql_part("error_rows", "SELECT dataset, row_number FROM finding_rows WHERE severity IN ('error', 'fatal')")
GEN_SQL = """SELECT 'generation' AS monitoring_domain, 'generation_dataset_count' AS metric_name, cast(count(*) AS double) AS metric_value FROM table_counts
  UNION ALL SELECT 'generation', 'generation_total_rows', cast(sum(row_count) AS double) FROM table_counts
  UNION ALL SELECT 'generation', 'generation_anomaly_count', cast(count(*) AS double) FROM all_severities WHERE severity = 'warning'
  UNION ALL SELECT 'generation', 'generation_cancellation_count', cast(count(*) FILTER (cancelled_flag) AS double) FROM delay_history
  UNION ALL SELECT 'generation', 'generation_diversion_count', cast(count(*) FILTER (diverted_flag) AS double) FROM delay_history
  UNION ALL SELECT 'generation', 'generation_manifest_complete_flag', 1.0 UNION ALL SELECT 'generation', 'generation_checksum_verified_flag', 1.0"""
VAL_SQL = """SELECT 'validation' AS monitoring_domain, 'validation_total_source_rows' AS metric_name, cast(sum(row_count) AS double) AS metric_value FROM table_counts
  UNION ALL SELECT 'validation', 'validation_total_valid_rows', cast(sum(row_count) - (SELECT count(*) FROM bad_rows) AS double) FROM table_counts
  UNION ALL SELECT 'validation', 'validation_total_quarantined_rows', cast(count(*) AS double) FROM bad_rows
  UNION ALL SELECT 'validation', 'validation_invalid_record_rate', round(1e-10 + (SELECT count(*) FROM bad_rows) / sum(row_count), 6) FROM table_counts
  UNION ALL SELECT 'validation', 'validation_warning_count', cast(count(*) AS double) FROM all_severities WHERE severity = 'warning'
  UNION ALL SELECT 'validation', 'validation_error_count', cast(count(*) AS double) FROM all_severities WHERE severity = 'error'
  UNION ALL SELECT 'validation', 'validation_fatal_count', 0.0 UNION ALL SELECT 'validation', 'validation_quality_metric_count', cast(count(*) AS double) FROM table_counts
  UNION ALL SELECT 'validation', 'validation_checksum_pass_flag', 1.0"""
FCST_SQL = """SELECT 'passenger_forecasting' AS monitoring_domain, 'passenger_forecast_wape' AS metric_name, round(1e-10 + sum(abs(signed)) / sum(target), 6) AS metric_value FROM published
  UNION ALL SELECT 'passenger_forecasting', 'passenger_forecast_mae', round(1e-10 + avg(abs(signed)), 6) FROM published
  UNION ALL SELECT 'passenger_forecasting', 'passenger_forecast_bias', round(1e-10 + avg(signed), 6) FROM published
  UNION ALL SELECT 'passenger_forecasting', 'passenger_forecast_row_count', cast(count(*) AS double) FROM published
  UNION ALL SELECT 'passenger_forecasting', 'passenger_forecast_capacity_adjustment_count', cast(count(*) FILTER (changed) AS double) FROM published
  UNION ALL SELECT 'passenger_forecasting', 'passenger_forecast_champion_is_baseline_flag', 1.0"""
sql_part("delay_scored", "SELECT flight_id AS row_key, p AS probability, target, 'all' AS scope, p >= 0.5 AS hit, band FROM published_delays")
sql_part("delay_ratios", MM.ratios_sql(f"SELECT scope, {MM.CONFUSION_SQL} FROM delay_scored GROUP BY scope", "scope"))
sql_part("delay_areas", MM.areas_sql("delay_scored", "scope"))
DELAY_SQL = """SELECT 'delay_prediction' AS monitoring_domain, 'delay_prediction_pr_auc' AS metric_name, pr_auc AS metric_value FROM delay_areas
  UNION ALL SELECT 'delay_prediction', 'delay_prediction_roc_auc', roc_auc FROM delay_areas
  UNION ALL SELECT 'delay_prediction', 'delay_prediction_brier_score', round(1e-10 + avg((probability - target) * (probability - target)), 6) FROM delay_scored
  UNION ALL SELECT 'delay_prediction', 'delay_prediction_f1', f1 FROM delay_ratios UNION ALL SELECT 'delay_prediction', 'delay_prediction_recall', recall FROM delay_ratios
  UNION ALL SELECT 'delay_prediction', 'delay_prediction_positive_rate', round(1e-10 + avg(target), 6) FROM delay_scored
  UNION ALL SELECT 'delay_prediction', 'delay_prediction_high_risk_rate', round(1e-10 + count(*) FILTER (band = 'high') / count(*), 6) FROM delay_scored"""
MAINT_SQL = """SELECT 'maintenance_analytics' AS monitoring_domain, 'maintenance_observation_count' AS metric_name, cast(count(*) AS double) AS metric_value FROM health_scores
  UNION ALL SELECT 'maintenance_analytics', 'maintenance_aircraft_count', cast(count(DISTINCT aircraft_id) AS double) FROM health_scores
  UNION ALL SELECT 'maintenance_analytics', 'maintenance_alert_count', cast(count(*) FILTER (category <> 'none') AS double) FROM health_scores
  UNION ALL SELECT 'maintenance_analytics', 'maintenance_high_risk_rate', round(1e-10 + count(*) FILTER (band = 'high') / count(*), 6) FROM health_scores
  UNION ALL SELECT 'maintenance_analytics', 'maintenance_max_risk_score', max(risk) FROM health_scores
  UNION ALL SELECT 'maintenance_analytics', 'maintenance_human_review_count', cast(count(*) FILTER (category <> 'none') AS double) FROM health_scores"""
DISR_SQL = """SELECT 'disruption_scoring' AS monitoring_domain, 'disruption_score_row_count' AS metric_name, cast(count(*) AS double) AS metric_value FROM scores
  UNION ALL SELECT 'disruption_scoring', 'disruption_alert_count', cast(count(*) FILTER (sev >= 0.25) AS double) FROM scores
  UNION ALL SELECT 'disruption_scoring', 'disruption_high_or_severe_rate', round(1e-10 + count(*) FILTER (band IN ('high', 'severe')) / count(*), 6) FROM scores
  UNION ALL SELECT 'disruption_scoring', 'disruption_severe_rate', round(1e-10 + count(*) FILTER (band = 'severe') / count(*), 6) FROM scores
  UNION ALL SELECT 'disruption_scoring', 'disruption_urgent_review_count', cast(count(*) FILTER (priority = 'urgent_review') AS double) FROM scores
  UNION ALL SELECT 'disruption_scoring', 'disruption_average_score', round(1e-10 + avg(score), 6) FROM scores
  UNION ALL SELECT 'disruption_scoring', 'disruption_max_score', max(score) FROM scores"""
sql_part("mon_metrics", "\nUNION ALL ".join((GEN_SQL, VAL_SQL, FCST_SQL, DELAY_SQL, MAINT_SQL, DISR_SQL)))


def metrics(t: Tables) -> DataFrame:
    return t.stage("monitoring_metrics", build_metrics)


def build_metrics(t: Tables) -> DataFrame:
    tables = VQ.typed_tables(t)
    counts, findings = t.written_stage("source_counts", lambda t: Q.source_counts(tables)), VQ.stored_marks(t)
    declared = t.written_stage("declared_fingerprint", lambda t: R.content_fingerprint(t.base("orders")))
    verified = R.verify_table(t.base("orders"), declared, ["o_orderkey"]).select("accepted").scalar()
    scores, health = DQ.stored_scores(t), MQ.stored_health(t)
    return MON.extract_metrics(
        [
            MON.generation_metrics(counts, tables["delay_history"], findings.filter("severity = 'warning'"), verified),
            MON.validation_metrics(counts, findings, verified),
            MON.forecast_monitor_metrics(MM.stored_forecast(t)),
            MON.delay_monitor_metrics(MM.stored_delays(t)),
            MON.maintenance_monitor_metrics(health),
            MON.disruption_monitor_metrics(scores),
        ]
    )


def stored_metrics(t: Tables) -> DataFrame:
    """The monitoring metrics as checks, drift and facts read them."""
    return t.written_stage(
        "monitoring_metrics", lambda t: metrics(t).withColumn("metric_value", round6("metric_value"))
    )


@query("extract_metrics", "SELECT * FROM mon_metrics")
def extract_metrics(t: Tables) -> DataFrame:
    return metrics(t).select("monitoring_domain", "metric_name", r6("metric_value"))


def check_sql() -> str:
    parts = []
    for rule in MON.CHECK_RULES:
        value = f"coalesce((SELECT metric_value FROM mon_metrics WHERE metric_name = '{rule.metric_name}'), 0)"
        fails = {
            "present": f"(SELECT count(*) FROM mon_metrics WHERE metric_name = '{rule.metric_name}') = 0",
            "equals": f"{value} <> 1",
            "max": f"{value} >= {rule.critical}",
            "min": f"{value} <= {rule.critical}",
            "status": "false",
        }[rule.kind]
        warns = {"max": f"{value} >= {rule.warning}", "min": f"{value} <= {rule.warning}"}.get(rule.kind, "false")
        bad = "high" if rule.kind == "present" else "critical"
        observed = f"(SELECT metric_value FROM mon_metrics WHERE metric_name = '{rule.metric_name}')" if rule.kind == "present" else "NULL" if rule.kind == "status" else value
        message = {
            "present": f"CASE WHEN {fails} THEN 'Metric is missing.' ELSE 'Metric is present.' END",
            "equals": "'Checksum verification flag evaluated.'",
            "max": "'Maximum threshold evaluated.'",
            "min": "'Minimum threshold evaluated.'",
        }.get(rule.kind, f"'{rule.domain} lineage and manifest accepted'")
        parts.append(
            f"SELECT {observed} AS observed_value, {message} AS message, '{rule.rule_id}' AS rule_id, '{rule.domain}' AS monitoring_domain, '{rule.metric_name}' AS metric_name, CASE WHEN {fails} THEN 'failed' WHEN {warns} THEN 'warning' ELSE 'passed' END AS status, CASE WHEN {fails} THEN '{bad}' WHEN {warns} THEN 'warning' ELSE 'info' END AS severity"
        )
    for i, domain in enumerate(MON.DOMAINS):
        parts.append(
            f"SELECT NULL, '{domain} lineage and manifest accepted', 'MON-LIN-{len(MON.CHECK_RULES) + 1 + i:03d}', '{domain}', 'status', 'passed', 'info'"
        )
    return "\nUNION ALL ".join(parts)


sql_part("mon_checks", check_sql())
sql_part("mon_alerts", "SELECT *, 'MON-ALERT-' || substr(sha256(concat_ws('|', 'monitoring-run', rule_id, monitoring_domain, metric_name)), 1, 16) AS monitoring_alert_id FROM mon_checks WHERE status IN ('warning', 'failed')")


def checks(t: Tables) -> DataFrame:
    return MON.run_checks(stored_metrics(t), MON.DOMAINS)


def mon_alerts(t: Tables) -> DataFrame:
    return MON.monitoring_alerts(checks(t), RUN_ID)


@query("run_checks", "SELECT rule_id, monitoring_domain, metric_name, status, severity, round(observed_value, 6) AS observed_value, message FROM mon_checks")
def run_checks(t: Tables) -> DataFrame:
    found = checks(t).select("rule_id", "monitoring_domain", "metric_name", "status", "severity", "observed_value", "message")
    return found.withColumn("observed_value", F.round("observed_value", 6))


@query("check_missing_metrics", "SELECT rule_id, CASE WHEN k = 'present' THEN 'failed' WHEN k = 'min' THEN 'failed' WHEN k = 'equals' THEN 'failed' ELSE 'passed' END AS status FROM (VALUES ('MON-GEN-001','present'),('MON-GEN-002','equals'),('MON-FCST-001','present'),('MON-FCST-002','max'),('MON-DELAY-001','present'),('MON-DELAY-002','min')) AS v(rule_id, k)")
def check_missing_metrics(t: Tables) -> DataFrame:
    kept = stored_metrics(t).filter(F.col("monitoring_domain") == "validation")
    found = MON.run_checks(kept, ("generation", "passenger_forecasting", "delay_prediction"), lineage=False)
    return found.select("rule_id", "status")


# ---------------------------------------------------------------- drift against an earlier run

EAST = "route_id < 'A12'"
EARLIER_SQL = """SELECT 'passenger_forecasting' AS monitoring_domain, 'passenger_forecast_wape' AS metric_name, round(sum(abs(signed)) / sum(target), 6) AS base FROM published_east
  UNION ALL SELECT 'passenger_forecasting', 'passenger_forecast_mae', round(avg(abs(signed)), 6) FROM published_east
  UNION ALL SELECT 'passenger_forecasting', 'passenger_forecast_bias', round(avg(signed), 6) FROM published_east
  UNION ALL SELECT 'passenger_forecasting', 'passenger_forecast_row_count', cast(count(*) AS double) FROM published_east
  UNION ALL SELECT 'passenger_forecasting', 'passenger_forecast_capacity_adjustment_count', cast(count(*) FILTER (changed) AS double) FROM published_east
  UNION ALL SELECT 'passenger_forecasting', 'passenger_forecast_champion_is_baseline_flag', 1.0
  UNION ALL SELECT 'disruption_scoring', 'disruption_score_row_count', cast(count(*) AS double) FROM scores_east
  UNION ALL SELECT 'disruption_scoring', 'disruption_alert_count', cast(count(*) FILTER (sev >= 0.25) AS double) FROM scores_east
  UNION ALL SELECT 'disruption_scoring', 'disruption_high_or_severe_rate', round(count(*) FILTER (band IN ('high', 'severe')) / count(*), 6) FROM scores_east
  UNION ALL SELECT 'disruption_scoring', 'disruption_severe_rate', round(count(*) FILTER (band = 'severe') / count(*), 6) FROM scores_east
  UNION ALL SELECT 'disruption_scoring', 'disruption_urgent_review_count', cast(count(*) FILTER (priority = 'urgent_review') AS double) FROM scores_east
  UNION ALL SELECT 'disruption_scoring', 'disruption_average_score', round(avg(score), 6) FROM scores_east
  UNION ALL SELECT 'disruption_scoring', 'disruption_max_score', max(score) FROM scores_east"""
sql_part("published_east", f"SELECT * FROM published WHERE {EAST}")
sql_part("scores_east", f"SELECT * FROM scores WHERE {EAST}")
sql_part("mon_baseline", EARLIER_SQL)
THIS_RUN = "2024-03-01 00:00:00"


def metric_runs(t: Tables) -> str:
    """A store with the metrics of earlier runs over parts of the network, and of one run made after this one."""

    def build(t: Tables) -> DataFrame:
        path = new_folder(t.spark, "metric_runs")
        forecast, scores = MM.stored_forecast(t), DQ.stored_scores(t)
        for run_id, made_at, part in (
            ("west", "2024-01-01 00:00:00", f"NOT ({EAST})"), ("east", "2024-02-01 00:00:00", EAST), ("later", "2024-04-01 00:00:00", "true"),
        ):
            own = [forecast.where(part), scores.where(part)]
            found = MON.extract_metrics([MON.forecast_monitor_metrics(own[0]), MON.disruption_monitor_metrics(own[1])])
            found = found.withColumn("metric_value", F.round("metric_value", 6))
            MON.store_run(found, path, run_id, made_at, MON.input_identity(own[1].select("flight_id")))
        return t.spark.createDataFrame([(path,)], "path string")

    return t.stage("metric_runs", build).first()["path"]


def compared(t: Tables) -> DataFrame:
    """This run's metrics against the latest run before it that read other input."""
    identity = MON.input_identity(DQ.stored_scores(t).select("flight_id"))
    earlier = MON.run_before(t.spark, metric_runs(t), THIS_RUN, identity)
    return t.written_stage("drift", lambda t: MON.drift_compare(stored_metrics(t), earlier))


DRIFT_SQL = """SELECT m.monitoring_domain, m.metric_name, base, CASE WHEN base IS NULL THEN NULL WHEN base = 0 THEN CASE WHEN metric_value = 0 THEN 0 ELSE 1 END ELSE round((metric_value - base) / abs(base), 4) END AS relative_change
  FROM mon_metrics m LEFT JOIN mon_baseline b ON b.monitoring_domain = m.monitoring_domain AND b.metric_name = m.metric_name"""


@query("drift_compare", f"SELECT monitoring_domain, metric_name, cast(relative_change AS double) AS relative_change, CASE WHEN base IS NULL THEN 'skipped' WHEN abs(relative_change) >= 0.5 THEN 'failed' WHEN abs(relative_change) >= 0.25 THEN 'warning' ELSE 'passed' END AS status, CASE WHEN abs(relative_change) >= 0.5 THEN 'critical' WHEN abs(relative_change) >= 0.25 THEN 'warning' ELSE 'info' END AS severity FROM ({DRIFT_SQL})")
def drift_compare(t: Tables) -> DataFrame:
    return compared(t).select("monitoring_domain", "metric_name", F.round("relative_change", 4).alias("relative_change"), "status", "severity")


@query("baseline_join", f"SELECT monitoring_domain, metric_name, base AS baseline_value FROM ({DRIFT_SQL})")
def baseline_join(t: Tables) -> DataFrame:
    return compared(t).select("monitoring_domain", "metric_name", "baseline_value")


@query("monitoring_alerts", "SELECT monitoring_alert_id, rule_id, monitoring_domain, severity, status FROM mon_alerts")
def monitoring_alerts(t: Tables) -> DataFrame:
    return mon_alerts(t).select("monitoring_alert_id", "rule_id", "monitoring_domain", "severity", "status")


@query("alerts_by_severity", "SELECT rule_id, severity FROM mon_alerts ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END DESC, rule_id LIMIT 3")
def alerts_by_severity(t: Tables) -> DataFrame:
    return MON.alerts_by_severity(checks(t), 3).select("rule_id", "severity")


RANK_SQL = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"
LABEL_SQL = "CASE {} WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'warning' ELSE 'info' END"
sql_part(
    "domain_rows",
    f"""SELECT c.monitoring_domain, CASE WHEN failed > 0 THEN 'failed' WHEN warned > 0 THEN 'warning' ELSE 'passed' END AS domain_status, {LABEL_SQL.format("r")} AS highest_severity, r, metric_count, check_count, passed, warned, failed, coalesce(alerts, 0) AS alert_count FROM
        (SELECT monitoring_domain, count(*) AS check_count, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'warning') AS warned, count(*) FILTER (status = 'failed') AS failed, max({RANK_SQL}) AS r FROM mon_checks GROUP BY monitoring_domain) c
        JOIN (SELECT monitoring_domain, count(*) AS metric_count FROM mon_metrics GROUP BY monitoring_domain) m ON m.monitoring_domain = c.monitoring_domain
        LEFT JOIN (SELECT monitoring_domain, count(*) AS alerts FROM mon_alerts GROUP BY monitoring_domain) a ON a.monitoring_domain = c.monitoring_domain""",
)


def domains(t: Tables) -> DataFrame:
    return MON.domain_health(stored_metrics(t), checks(t), mon_alerts(t))


@query("domain_health", "SELECT monitoring_domain, domain_status, highest_severity, metric_count, check_count, passed AS passed_check_count, warned AS warning_check_count, failed AS failed_check_count, alert_count FROM domain_rows")
def domain_health(t: Tables) -> DataFrame:
    return domains(t).drop("skipped_check_count")


@query("platform_health", f"SELECT CASE WHEN sum(failed) > 0 THEN 'failed' WHEN sum(warned) > 0 THEN 'warning' ELSE 'passed' END AS overall_health_status, {LABEL_SQL.format('max(r)')} AS highest_severity, count(*) AS domain_count, cast(sum(failed) AS bigint) AS failed_check_count, cast(sum(alert_count) AS bigint) AS alert_count, (SELECT count(*) FROM mon_alerts WHERE severity = 'critical') AS critical_alert_count FROM domain_rows")
def platform_health(t: Tables) -> DataFrame:
    return MON.platform_health(domains(t), mon_alerts(t)).select(
        "overall_health_status",
        "highest_severity",
        "domain_count",
        "failed_check_count",
        "alert_count",
        "critical_alert_count",
    )


# ---------------------------------------------------------------- evidence


def evidence(t: Tables) -> DataFrame:
    scores, health = DQ.stored_scores(t), MQ.stored_health(t)
    return E.evidence_table(
        [
            E.score_evidence(scores),
            E.route_evidence(D.route_summary(scores)),
            E.disruption_alert_evidence(D.disruption_alerts(scores, DQ.RUN_ID)),
            E.delay_evidence(MM.stored_delays(t)),
            E.forecast_evidence(MM.stored_forecast(t)),
            E.maintenance_alert_evidence(T.maintenance_alerts(health, MQ.RUN_ID, MQ.SETTINGS)),
            E.aircraft_evidence(T.aircraft_health_summary(health)),
            E.metric_evidence(stored_metrics(t)),
            E.check_evidence(checks(t)),
            E.dataset_evidence(dataset_quality(t)),
        ]
    )


def dataset_quality(t: Tables) -> DataFrame:
    """(dataset, valid, quarantined, errors) of the source tables, from the stored findings."""
    findings = VQ.stored_marks(t)
    errors = findings.where("severity = 'error'").groupBy("dataset").agg(F.count(F.lit(1)).alias("errors"))
    rejected = Q.quarantined_keys(findings).groupBy("dataset").agg(F.count(F.lit(1)).alias("quarantined"))
    counted = t.written_stage("source_counts", lambda t: Q.source_counts(VQ.typed_tables(t))).join(errors, "dataset", "left").join(rejected, "dataset", "left").na.fill(0)
    return counted.select("dataset", (F.col("row_count") - F.col("quarantined")).alias("valid"), "quarantined", "errors")


def stored_evidence(t: Tables) -> DataFrame:
    """The evidence table as retrieval, guardrails and briefs read it."""
    return t.written_stage("evidence", evidence)


def evd(domain: str, kind: str, record: str, etype: str, entity: str, metric: str, summary: str) -> str:
    return f"concat('EVD-', upper(substr(sha256(concat_ws('|', '{domain}', '{kind}', {record}, '{etype}', {entity}, {metric}, {summary})), 1, 12)))"


def evidence_sql(source: str, domain: str, kind: str, record: str, etype: str, entity: str, ts: str, metric: str, value: str, severity: str, summary: str, route: str = "NULL", flight: str = "NULL", aircraft: str = "NULL", ends: str = "NULL, NULL") -> str:
    o, d = ends.split(", ")
    return f"SELECT {evd(domain, kind, record, etype, entity, metric, summary)} AS evidence_id, '{domain}' AS source_domain, '{kind}' AS evidence_type, '{etype}' AS entity_type, {entity} AS entity_id, {ts} AS ts, cast({value} AS double) AS metric_value, {severity} AS severity, {summary} AS summary_text, {route} AS route_id, {flight} AS flight_id, {aircraft} AS aircraft_id, {o} AS o, {d} AS d FROM {source}"


sql_part(
    "dataset_rows",
    """SELECT c.dataset, c.row_count - coalesce(b.n, 0) AS valid, coalesce(b.n, 0) AS quarantined, coalesce(e.n, 0) AS errors FROM table_counts c
       LEFT JOIN (SELECT dataset, count(*) AS n FROM bad_rows GROUP BY dataset) b ON b.dataset = c.dataset
       LEFT JOIN (SELECT dataset, count(*) AS n FROM all_severities WHERE severity = 'error' GROUP BY dataset) e ON e.dataset = c.dataset""",
)
sql_part("route_rows", DQ.summary_sql("scores", "route_id", "max(score) AS top"))
sql_part(
    "flight_alerts",
    "SELECT a.alert_id, s.* FROM alerts a JOIN scores s ON s.flight_id = a.flight_id",
)
sql_part(
    "evidence_rows",
    "\nUNION ALL ".join(
        (
            evidence_sql("scores", "disruption_scoring", "disruption_score", "flight_id", "flight", "flight_id", "strftime(scheduled_departure_utc, '%Y-%m-%d %H:%M:%S')", "'disruption_severity_score'", "score", "band", "concat('Flight ', flight_id, ' on route ', route_id, ' has disruption score ', score, ' and risk band ', band, '.')", "route_id", "flight_id", "aircraft_id", "origin_airport, destination_airport"),
            evidence_sql("route_rows", "disruption_scoring", "route_summary", "route_id", "route", "route_id", "NULL", "'maximum_disruption_score'", "top", "review_priority", "concat('Route ', route_id, ' has maximum disruption score ', top, ' with driver ', dominant_disruption_driver, '.')", "route_id"),
            evidence_sql("flight_alerts", "disruption_scoring", "disruption_alert", "alert_id", "flight", "flight_id", "NULL", "'disruption_severity_score'", "score", "band", "concat('Disruption alert ', alert_id, ' flags flight ', flight_id, '.')", "route_id", "flight_id", "NULL", "origin_airport, destination_airport"),
            evidence_sql("published_delays", "delay_prediction", "delay_prediction", "flight_id", "flight", "flight_id", "strftime(scheduled_departure_utc, '%Y-%m-%d %H:%M:%S')", "'delay_probability'", "p", "band", "concat('Flight ', flight_id, ' has delay probability ', p, '.')", "route_id", "flight_id", "NULL", "origin_airport, destination_airport"),
            evidence_sql("published", "passenger_forecasting", "passenger_forecast", "flight_id", "flight", "flight_id", "cast(operating_date AS varchar)", "'forecast_passengers'", "forecast", "CASE WHEN changed THEN 'warning' ELSE 'info' END", "concat('Flight ', flight_id, ' forecast passengers ', forecast, '.')", "route_id", "flight_id"),
            evidence_sql("health_alerts", "maintenance_analytics", "maintenance_alert", "alert_id", "aircraft", "aircraft_id", "strftime(event_timestamp_utc, '%Y-%m-%d %H:%M:%S')", "'aircraft_health_score'", "health", "category", "concat('Maintenance alert ', alert_id, ' applies to aircraft ', aircraft_id, '.')", "NULL", "flight_id", "aircraft_id"),
            evidence_sql("(SELECT aircraft_id, max(risk) AS top, CASE WHEN max(risk) >= 0.8 THEN 'high' WHEN max(risk) >= 0.6 THEN 'medium' ELSE 'low' END AS pr FROM health_scores GROUP BY aircraft_id)", "maintenance_analytics", "aircraft_summary", "aircraft_id", "aircraft", "aircraft_id", "NULL", "'maximum_maintenance_risk_score'", "top", "pr", "concat('Aircraft ', aircraft_id, ' maximum maintenance score ', top, '.')", "NULL", "NULL", "aircraft_id"),
            evidence_sql("mon_checks", "monitoring", "monitoring_check", "rule_id", "monitoring_rule", "rule_id", "NULL", "metric_name", "observed_value", "severity", "concat(rule_id, ' ', status, ': ', message)"),
            evidence_sql("dataset_rows", "validation", "validation_metric", "dataset", "dataset", "dataset", "NULL", "'valid_row_count'", "valid", "CASE WHEN errors = 0 THEN 'info' ELSE 'high' END", "concat(dataset, ' has ', valid, ' valid rows, ', quarantined, ' quarantined rows, and ', errors, ' errors.')"),
            evidence_sql("mon_metrics", "monitoring", "monitoring_check", "metric_name", "monitoring_metric", "monitoring_domain", "NULL", "metric_name", "metric_value", "'info'", "concat('Monitoring metric ', metric_name, ' of domain ', monitoring_domain, '.')"),
        )
    ),
)


@query(
    "evidence_table",
    "SELECT evidence_id, source_domain, evidence_type, entity_type, entity_id, round(1e-10 + metric_value, 4) AS metric_value, severity, summary_text FROM evidence_rows",
)
def evidence_table(t: Tables) -> DataFrame:
    rows = evidence(t)
    value = F.round(F.col("metric_value") + 1e-10, 4).alias("metric_value")
    return rows.select(
        "evidence_id", "source_domain", "evidence_type", "entity_type", "entity_id", value, "severity", "summary_text"
    )


@query(
    "redact_fields",
    "SELECT c_custkey AS customer, '[REDACTED]' AS customer_name, c_mktsegment AS segment FROM customer",
)
def redact_fields(t: Tables) -> DataFrame:
    fields = F.create_map(F.lit("customer_Name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    hidden = t.base("customer").select(F.col("c_custkey").alias("customer"), X.redact_fields(fields).alias("f"))
    return hidden.select(
        "customer", F.col("f")["customer_Name"].alias("customer_name"), F.col("f")["segment"].alias("segment")
    )


INTENT_LIST = list(E.INTENT_PRIORITY)
sql_part(
    "requests",
    "SELECT concat('RQ-', cast(flight_n AS string)) AS request_id, CASE flight_n % 9 "
    + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(INTENT_LIST))
    + """ END AS intent, CASE WHEN flight_n % 4 IN (0, 3) THEN flight_id ELSE '' END AS flight_id, CASE WHEN flight_n % 4 = 1 THEN route_id ELSE '' END AS route_id,
              CASE WHEN flight_n % 4 = 2 THEN aircraft_id ELSE '' END AS aircraft_id, CASE WHEN flight_n % 4 = 3 THEN origin_airport ELSE '' END AS airport_code FROM flight_schedule""",
)


def requests(t: Tables) -> DataFrame:
    return t.stage("requests", lambda t: t.sql("SELECT * FROM requests", VQ._parts()))


def ranked(t: Tables) -> DataFrame:
    return E.retrieve_evidence(requests(t), stored_evidence(t), 5)


sql_part(
    "evidence_keys",
    "\nUNION ".join(
        f"SELECT evidence_id, '{key}' AS f, {value} AS v FROM evidence_rows WHERE {value} IS NOT NULL"
        for key in E.FILTERS
        for value in ("entity_id", "o", "d", *([key] if key != "airport_code" else []))
    ),
)
sql_part(
    "request_keys",
    "\nUNION ALL ".join(f"SELECT request_id, '{key}' AS f, {key} AS v FROM requests WHERE {key} <> ''" for key in E.FILTERS),
)
sql_part(
    "intent_domains",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{i}', '{d}', {30 - n})" for i, ds in E.INTENT_PRIORITY.items() for n, d in enumerate(ds))
    + ") AS v(intent, source_domain, points)",
)
RETRIEVE_SQL = """SELECT request_id, rank, evidence_id, round(1e-10 + score, 6) AS score, matched_filters FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, coalesce(ts, ''), evidence_id) AS int) AS rank FROM (
    SELECT m.request_id, m.evidence_id, e.ts, string_agg(concat('filter:', m.f), '|' ORDER BY m.f) AS matched_filters,
           100 * count(*) + coalesce(max(d.points), 0) + max(CASE WHEN r.intent IN ('route_risk_brief', 'delay_investigation') AND entity_type = 'route' OR r.intent = 'flight_risk_brief' AND entity_type = 'flight' THEN 20 ELSE 0 END)
           + 4 * max(CASE severity WHEN 'severe' THEN 5 WHEN 'high' THEN 4 WHEN 'urgent_review' THEN 4 WHEN 'warning' THEN 3 WHEN 'medium' THEN 2 WHEN 'watch' THEN 2 WHEN 'advisory' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)
           + 10 * max(CASE WHEN metric_value <= 1 THEN metric_value ELSE least(metric_value / 100, 1) END) + 1 AS score
    FROM request_keys m JOIN evidence_keys k ON k.f = m.f AND k.v = m.v JOIN requests r ON r.request_id = m.request_id JOIN evidence_rows e ON e.evidence_id = k.evidence_id
    LEFT JOIN intent_domains d ON d.intent = r.intent AND d.source_domain = e.source_domain
    GROUP BY m.request_id, m.evidence_id, e.ts)) WHERE rank <= 5"""
RETRIEVE_SQL = RETRIEVE_SQL.replace("m.evidence_id", "k.evidence_id")
sql_part("ranked_rows", RETRIEVE_SQL)


@query("retrieve_evidence", "SELECT * FROM ranked_rows")
def retrieve_evidence(t: Tables) -> DataFrame:
    return ranked(t).select(
        "request_id", "rank", "evidence_id", r6("score"), F.array_join("matched_filters", "|").alias("matched_filters")
    )


@query(
    "response_assembly",
    """SELECT r.request_id, CASE r.intent """
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.INTENT_TITLES.items())
    + """ END AS response_title, cast(CASE WHEN x.n IS NULL THEN 3 ELSE 3 + x.n END AS int) AS section_count, coalesce(refs, '') AS refs
       FROM requests r LEFT JOIN (SELECT request_id, count(*) AS n, string_agg(evidence_id, '|' ORDER BY rank) AS refs FROM ranked_rows GROUP BY request_id) x ON x.request_id = r.request_id""",
)
def response_assembly(t: Tables) -> DataFrame:
    made = briefs(t)
    return made.select(
        "request_id", "response_title", F.size("sections").alias("section_count"), F.array_join("evidence_references", "|").alias("refs")
    )


def briefs(t: Tables) -> DataFrame:
    return E.response_assembly(requests(t), stored_ranked(t), stored_evidence(t))


def stored_ranked(t: Tables) -> DataFrame:
    return t.written_stage("ranked_evidence", ranked)


# ---------------------------------------------------------------- guardrails over conversations

sql_part(
    "response_sections",
    """SELECT cast(conv_id AS string) AS response_id, turn AS section_order, CASE WHEN role = 'assistant' THEN concat('Finding ', cast(turn AS string)) ELSE 'Note' END AS heading,
              concat(text, CASE WHEN conv_id % 3 = 0 THEN ' Synthetic evidence; human review needed.' ELSE '' END, CASE WHEN conv_id % 5 = 0 THEN ' No live LLM or Azure AI Foundry service was called.' ELSE '' END, CASE WHEN conv_id % 17 = 0 AND turn = 1 THEN ' Cancel the flight now.' ELSE '' END) AS content
       FROM conversations""",
)
sql_part("response_citations", "SELECT cast(conv_id AS string) AS response_id, turn AS section_order, concat('DOC-', cast(conv_id AS string)) AS evidence_id FROM conversations WHERE conv_id % 4 <> 0")
sql_part("known_evidence", "SELECT concat('DOC-', cast(doc_id AS string)) AS evidence_id FROM labels")
sql_part("responses", "SELECT DISTINCT cast(conv_id AS string) AS response_id, CASE WHEN conv_id % 11 = 0 THEN 'write_a_poem' ELSE 'disruption_summary' END AS intent, 0 AS unsupported_claim_count FROM conversations")
sql_part(
    "response_flags",
    """SELECT r.response_id, r.intent, bool_or(contains(lower(content), 'cancel the flight') OR contains(lower(content), 'divert the flight') OR contains(lower(content), 'ground the aircraft') OR contains(lower(content), 'rebook passengers')) AS unsafe,
              bool_or(contains(lower(content), 'synthetic')) AS syn, bool_or(contains(lower(content), 'no live llm')) AS llm, bool_or(contains(lower(content), 'human')) AND bool_or(contains(lower(content), 'review')) AS human, bool_or(contains(lower(content), 'azure ai foundry service was called')) AS azure,
              bool_or(heading LIKE 'Finding%' AND NOT EXISTS (SELECT 1 FROM response_citations c JOIN known_evidence k ON k.evidence_id = c.evidence_id WHERE c.response_id = s.response_id AND c.section_order = s.section_order)) AS loose
       FROM responses r JOIN response_sections s ON s.response_id = r.response_id GROUP BY ALL""",
)


def guardrails(t: Tables) -> DataFrame:
    def part(name: str) -> DataFrame:
        return t.sql(f"SELECT * FROM {name}", VQ._parts())

    return E.guardrail_checks(
        part("responses"), part("response_sections"), part("response_citations"), part("known_evidence")
    )


def guard(rule: str, ok: str) -> str:
    return f"SELECT response_id, '{rule}' AS guardrail_id, CASE WHEN {ok} THEN 'passed' ELSE 'failed' END AS status FROM response_flags"


@query(
    "guardrail_checks",
    "\nUNION ALL ".join(
        (
            guard("GR-INTENT-001", "intent = 'disruption_summary'"),
            guard("GR-GROUND-001", "NOT loose"),
            guard("GR-SAFETY-001", "NOT unsafe"),
            guard("GR-SYNTH-001", "syn"),
            guard("GR-LLM-001", "llm"),
            guard("GR-HUMAN-001", "human"),
            guard("GR-AZURE-001", "azure"),
            guard("GR-PII-001", "true"),
        )
    ),
)
def guardrail_checks(t: Tables) -> DataFrame:
    return guardrails(t).select("response_id", "guardrail_id", "status")
