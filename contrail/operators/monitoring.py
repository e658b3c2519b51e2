"""Monitoring: metrics out of result tables, threshold checks, drift, alerts and health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions.columns import count_when, rank_of, safe_divide, sha_id
from contrail.operators.findings import union_all
from contrail.operators.picks import topk_global

# Domains, severities, thresholds and texts.
DOMAINS = (
    "generation",
    "validation",
    "passenger_forecasting",
    "delay_prediction",
    "maintenance_analytics",
    "disruption_scoring",
)
SEVERITY_ORDER = ("info", "warning", "high", "critical")
MAXIMUM_ALERTS = 200
DRIFT_WARNING, DRIFT_CRITICAL = 0.25, 0.50
ACTIONS = {
    "validation": "Review validation quality metrics.",
    "passenger_forecasting": "Review model evidence before operational interpretation.",
    "delay_prediction": "Review model evidence before operational interpretation.",
    "generation": "Inspect source manifest and checksums.",
}
DEFAULT_ACTION = "Review monitoring evidence."
ALERT_WARNING = "Local synthetic monitoring evidence only; do not trigger operational action."


@dataclass(frozen=True)
class CheckRule:
    """One threshold check: kind is present, equals, max, min or status."""

    rule_id: str
    domain: str
    kind: str
    metric_name: str
    warning: float | None = None
    critical: float | None = None


CHECK_RULES = (
    CheckRule("MON-GEN-001", "generation", "present", "generation_manifest_complete_flag"),
    CheckRule("MON-GEN-002", "generation", "equals", "generation_checksum_verified_flag", 1.0),
    CheckRule("MON-VAL-001", "validation", "status", "status"),
    CheckRule("MON-VAL-002", "validation", "equals", "validation_checksum_pass_flag", 1.0),
    CheckRule("MON-VAL-003", "validation", "max", "validation_invalid_record_rate", 0.01, 0.05),
    CheckRule("MON-VAL-004", "validation", "max", "validation_error_count", 1.0, 10.0),
    CheckRule("MON-FCST-001", "passenger_forecasting", "present", "passenger_forecast_wape"),
    CheckRule("MON-FCST-002", "passenger_forecasting", "max", "passenger_forecast_wape", 0.25, 0.40),
    CheckRule("MON-DELAY-001", "delay_prediction", "present", "delay_prediction_pr_auc"),
    CheckRule("MON-DELAY-002", "delay_prediction", "min", "delay_prediction_pr_auc", 0.50, 0.35),
    CheckRule("MON-MAINT-001", "maintenance_analytics", "max", "maintenance_high_risk_rate", 0.20, 1.0),
    CheckRule("MON-DISR-001", "disruption_scoring", "present", "disruption_score_row_count"),
    CheckRule("MON-DISR-002", "disruption_scoring", "max", "disruption_severe_rate", 0.25, 1.0),
)


def domain_metric_rows(
    row: DataFrame, domain: str, metrics: Mapping[str, Column | tuple[Column, Column, Column]]
) -> DataFrame:
    """Long (domain, metric, value, numerator, denominator) rows of one aggregate row."""
    entries = []
    for name, value in metrics.items():
        number, top, bottom = value if isinstance(value, tuple) else (value, F.lit(None), F.lit(None))
        entries.append(
            F.struct(
                F.lit(domain).alias("monitoring_domain"),
                F.lit(name).alias("metric_name"),
                F.coalesce(number.cast("double"), F.lit(0.0)).alias("metric_value"),
                top.cast("double").alias("numerator"),
                bottom.cast("double").alias("denominator"),
            )
        )
    return row.select(F.inline(F.array(*entries)))


def generation_metrics(counts: DataFrame, delays: DataFrame, anomalies: DataFrame, verified: Column) -> DataFrame:
    """Table counts, cancellations, diversions and anomaly rows of the source data."""
    seen = delays.agg(
        F.struct(
            count_when(F.col("cancelled_flag")).alias("cancelled"), count_when(F.col("diverted_flag")).alias("diverted")
        )
    ).scalar()
    row = counts.agg(F.count(F.lit(1)).alias("tables"), F.sum("row_count").alias("rows")).withColumns(
        {"_d": seen, "_a": anomalies.agg(F.count(F.lit(1))).scalar(), "_ok": verified}
    )
    return domain_metric_rows(
        row,
        "generation",
        {
            "generation_dataset_count": F.col("tables"),
            "generation_total_rows": F.col("rows"),
            "generation_anomaly_count": F.col("_a"),
            "generation_cancellation_count": F.col("_d.cancelled"),
            "generation_diversion_count": F.col("_d.diverted"),
            "generation_manifest_complete_flag": F.lit(1.0),
            "generation_checksum_verified_flag": F.col("_ok").cast("int"),
        },
    )


def validation_metrics(counts: DataFrame, findings: DataFrame, verified: Column) -> DataFrame:
    """Rows, rejected rows, invalid rate and finding counts."""
    from contrail.operators.quality import quarantined_keys

    severities = findings.agg(
        F.struct(*[count_when(F.col("severity") == s).alias(s) for s in ("warning", "error", "fatal")])
    )
    row = counts.agg(F.count(F.lit(1)).alias("tables"), F.sum("row_count").alias("n")).withColumns(
        {"_s": severities.scalar(), "bad": quarantined_keys(findings).agg(F.count(F.lit(1))).scalar(), "_ok": verified}
    )
    n, bad = F.col("n"), F.col("bad")
    return domain_metric_rows(
        row,
        "validation",
        {
            "validation_total_source_rows": n,
            "validation_total_valid_rows": n - bad,
            "validation_total_quarantined_rows": bad,
            "validation_invalid_record_rate": (safe_divide(bad, n), bad, n),
            "validation_warning_count": F.col("_s.warning"),
            "validation_error_count": F.col("_s.error"),
            "validation_fatal_count": F.col("_s.fatal"),
            "validation_quality_metric_count": F.col("tables"),
            "validation_checksum_pass_flag": F.col("_ok").cast("int"),
        },
    )


def forecast_monitor_metrics(forecast: DataFrame) -> DataFrame:
    """Errors and adjustments of the published forecast."""
    row = forecast.agg(
        F.count(F.lit(1)).alias("n"),
        safe_divide(F.sum("absolute_error"), F.sum(F.abs("actual_passengers"))).alias("wape"),
        F.avg("absolute_error").alias("mae"),
        F.avg("signed_error").alias("bias"),
        count_when(F.col("constraint_applied")).alias("adjusted"),
        F.max(F.when(F.col("model_role") == "baseline", 1.0).otherwise(0.0)).alias("base"),
    )
    return domain_metric_rows(
        row,
        "passenger_forecasting",
        {
            "passenger_forecast_wape": F.col("wape"),
            "passenger_forecast_mae": F.col("mae"),
            "passenger_forecast_bias": F.col("bias"),
            "passenger_forecast_row_count": F.col("n"),
            "passenger_forecast_capacity_adjustment_count": F.col("adjusted"),
            "passenger_forecast_champion_is_baseline_flag": F.col("base"),
        },
    )


def delay_monitor_metrics(predictions: DataFrame, threshold: float = 0.5, pr_ties: str = "positives_first") -> DataFrame:
    """Classification metrics of the published delay predictions."""
    from contrail.operators.metrics import evaluate_classifier

    named = {"score": "delay_probability", "label": "actual_delay_flag"}
    metrics = evaluate_classifier(predictions, threshold, pr_ties=pr_ties, **named)
    high = predictions.agg(F.struct(count_when(F.col("risk_band") == "high").alias("h"), F.count(F.lit(1)).alias("n")))
    row = metrics.withColumn("_h", high.scalar())
    return domain_metric_rows(
        row,
        "delay_prediction",
        {
            "delay_prediction_pr_auc": F.col("pr_auc"),
            "delay_prediction_roc_auc": F.col("roc_auc"),
            "delay_prediction_brier_score": F.col("brier_score"),
            "delay_prediction_f1": F.col("f1"),
            "delay_prediction_recall": F.col("recall"),
            "delay_prediction_positive_rate": F.col("actual_positive_rate"),
            "delay_prediction_high_risk_rate": (
                safe_divide(F.col("_h.h"), F.col("_h.n")),
                F.col("_h.h"),
                F.col("_h.n"),
            ),
        },
    )


def maintenance_monitor_metrics(scores: DataFrame) -> DataFrame:
    row = scores.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("aircraft_id").alias("aircraft"),
        count_when(F.col("risk_band").isin("high", "critical")).alias("high"),
        F.max("maintenance_risk_score").alias("top"),
        count_when(F.col("human_review_required")).alias("review"),
        count_when(F.col("alert_category") != "none").alias("alerts"),
    )
    n, high = F.col("n"), F.col("high")
    return domain_metric_rows(
        row,
        "maintenance_analytics",
        {
            "maintenance_observation_count": n,
            "maintenance_aircraft_count": F.col("aircraft"),
            "maintenance_alert_count": F.col("alerts"),
            "maintenance_high_risk_rate": (safe_divide(high, n), high, n),
            "maintenance_max_risk_score": F.col("top"),
            "maintenance_human_review_count": F.col("review"),
        },
    )


def disruption_monitor_metrics(scores: DataFrame) -> DataFrame:
    band = F.col("disruption_risk_band")
    row = scores.agg(
        F.count(F.lit(1)).alias("n"),
        count_when(band.isin("high", "severe")).alias("bad"),
        count_when(band == "severe").alias("severe"),
        count_when(F.col("recovery_priority") == "urgent_review").alias("urgent"),
        F.avg("disruption_severity_score").alias("mean"),
        F.max("disruption_severity_score").alias("top"),
        count_when(F.col("human_review_required")).alias("alerts"),
    )
    n, bad, severe = F.col("n"), F.col("bad"), F.col("severe")
    return domain_metric_rows(
        row,
        "disruption_scoring",
        {
            "disruption_score_row_count": n,
            "disruption_alert_count": F.col("alerts"),
            "disruption_high_or_severe_rate": (safe_divide(bad, n), bad, n),
            "disruption_severe_rate": (safe_divide(severe, n), severe, n),
            "disruption_urgent_review_count": F.col("urgent"),
            "disruption_average_score": F.col("mean"),
            "disruption_max_score": F.col("top"),
        },
    )


def extract_metrics(parts: Sequence[DataFrame]) -> DataFrame:
    """All domain metric rows as one table."""
    return union_all(parts)


# ---------------------------------------------------------------- checks


def rule_frame(spark: SparkSession, rules: Sequence[CheckRule]) -> DataFrame:
    rows = [(r.rule_id, r.domain, r.kind, r.metric_name, r.warning, r.critical) for r in rules]
    return spark.createDataFrame(
        rows,
        "rule_id string, monitoring_domain string, kind string, metric_name string, warning double, critical double",
    )


def run_checks(
    metrics: DataFrame, domains: Sequence[str], rules: Sequence[CheckRule] = CHECK_RULES, lineage: bool = True
) -> DataFrame:
    """Evaluate the rules of the present domains, plus one lineage check per accepted domain.

    A missing metric reads as zero, except that a presence check then fails.
    """
    active = [r for r in rules if r.domain in domains]
    if lineage:
        start = len(active) + 1
        active += [CheckRule(f"MON-LIN-{start + i:03d}", d, "status", "status") for i, d in enumerate(domains)]
    table = rule_frame(metrics.sparkSession, active)
    values = metrics.select("metric_name", F.col("metric_value").alias("_value"))
    joined = table.join(values, "metric_name", "left")
    kind, value = F.col("kind"), F.coalesce("_value", F.lit(0.0))
    failed = (
        F.when(kind == "present", F.col("_value").isNull())
        .when(kind == "equals", value != F.col("warning"))
        .when(kind == "max", value >= F.col("critical"))
        .when(kind == "min", value <= F.col("critical"))
        .otherwise(False)
    )
    warned = (
        F.when(kind == "max", value >= F.col("warning")).when(kind == "min", value <= F.col("warning")).otherwise(False)
    )
    marked = joined.withColumn("status", F.when(failed, "failed").when(warned, "warning").otherwise("passed"))
    severity = (
        F.when(F.col("status") == "passed", "info")
        .when(F.col("status") == "warning", "warning")
        .when(kind == "present", "high")
        .otherwise("critical")
    )
    message = (
        F.when((kind == "present") & failed, "Metric is missing.")
        .when(kind == "present", "Metric is present.")
        .when(kind == "equals", "Checksum verification flag evaluated.")
        .when(kind == "max", "Maximum threshold evaluated.")
        .when(kind == "min", "Minimum threshold evaluated.")
        .otherwise(F.concat(F.col("monitoring_domain"), F.lit(" lineage and manifest accepted")))
    )
    return marked.select(
        "rule_id",
        "monitoring_domain",
        "status",
        severity.alias("severity"),
        "metric_name",
        F.when(kind == "status", F.lit(None)).when(kind == "present", F.col("_value")).otherwise(value).alias("observed_value"),
        F.col("warning").alias("threshold"),
        message.alias("message"),
    )


def input_identity(rows: DataFrame) -> str:
    """Name of a run's input: row count and an order-insensitive hash of its rows."""
    own = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0)).alias("h")).first()
    return f"{own['n']}-{own['h'] & (2**64 - 1):016x}"


def store_run(metrics: DataFrame, store: str, run_id: str, made_at: str, identity: str) -> None:
    """Add the metrics of a run to a store of runs, one folder a run; a run stored again replaces itself."""
    made = F.lit(made_at).cast("timestamp").alias("made_at")
    rows = metrics.select("monitoring_domain", "metric_name", "metric_value", made, F.lit(identity).alias("input_identity"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{store}/run_id={run_id}")  # a few dozen rows


def run_before(spark: SparkSession, store: str, moment: str, identity: str | None = None) -> DataFrame | None:
    """Metrics of the latest stored run before a moment, if any; with `identity`, of those that read other input."""
    runs = spark.read.parquet(store).where(F.col("made_at") < F.lit(moment).cast("timestamp"))
    if identity is not None:
        runs = runs.where(F.col("input_identity") != identity)
    latest = runs.agg(F.max(F.struct("made_at", F.col("run_id").cast("string").alias("run_id"))).alias("r")).first()["r"]
    return None if latest is None else runs.where(F.col("run_id").cast("string") == latest["run_id"])


def drift_compare(
    metrics: DataFrame,
    baseline: DataFrame | None,
    warning: float = DRIFT_WARNING,
    critical: float = DRIFT_CRITICAL,
) -> DataFrame:
    """Absolute and relative change against a baseline; without one, a single skipped row."""
    columns = ("monitoring_domain", "metric_name")
    if baseline is None:
        return metrics.sparkSession.range(1).select(
            F.lit("platform").alias("monitoring_domain"),
            F.lit("baseline_monitoring_run").alias("metric_name"),
            *[
                F.lit(None).cast("double").alias(c)
                for c in ("current_value", "baseline_value", "absolute_change", "relative_change")
            ],
            F.lit("skipped").alias("status"),
            F.lit("info").alias("severity"),
        )
    past = baseline.select(*columns, F.col("metric_value").alias("baseline_value"))
    joined = metrics.select(*columns, F.col("metric_value").alias("current_value")).join(past, list(columns), "left")
    now, was = F.col("current_value"), F.col("baseline_value")
    relative = F.when(was == 0, F.when(now == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide(now - was, F.abs(was)))
    out = joined.withColumns({"absolute_change": now - was, "relative_change": relative})
    size = F.abs("relative_change")
    status = (
        F.when(was.isNull(), "skipped").when(size >= critical, "failed").when(size >= warning, "warning").otherwise("passed")
    )
    severity = F.when(size >= critical, "critical").when(size >= warning, "warning").otherwise("info")
    return out.withColumns({"status": status, "severity": severity})


def alerts_by_severity(checks: DataFrame, limit: int = MAXIMUM_ALERTS) -> DataFrame:
    """Warning and failed checks, most severe first."""
    return topk_global(
        checks.filter(F.col("status").isin("warning", "failed")),
        [rank_of("severity", SEVERITY_ORDER).desc(), F.col("rule_id")],
        limit,
    )


def monitoring_alerts(checks: DataFrame, run_id: str, limit: int = MAXIMUM_ALERTS) -> DataFrame:
    action = F.lit(DEFAULT_ACTION)
    for domain, text in ACTIONS.items():
        action = F.when(F.col("monitoring_domain") == domain, text).otherwise(action)
    return alerts_by_severity(checks, limit).select(
        sha_id(
            "MON-ALERT-",
            [F.lit(run_id), F.col("rule_id"), F.col("monitoring_domain"), F.col("metric_name")],
            16,
            upper=False,
        ).alias("monitoring_alert_id"),
        "rule_id",
        "monitoring_domain",
        "severity",
        "status",
        F.concat_ws(" ", "rule_id", "monitoring_domain", F.lit("monitoring check"), "status").alias("alert_title"),
        F.col("message").alias("alert_message"),
        "observed_value",
        "threshold",
        action.alias("recommended_review_action"),
        F.lit(True).alias("human_review_required"),
        F.lit(ALERT_WARNING).alias("synthetic_data_warning"),
    )


# ---------------------------------------------------------------- health


def _status_counts() -> list[Column]:
    return [count_when(F.col("status") == s).alias(f"{s}_check_count") for s in ("passed", "warning", "failed", "skipped")]


def health_status() -> Column:
    return (
        F.when(F.col("failed_check_count") > 0, "failed")
        .when(F.col("warning_check_count") > 0, "warning")
        .otherwise("passed")
    )


def highest_severity(rank: Column) -> Column:
    names = F.array(*[F.lit(s) for s in SEVERITY_ORDER])
    return F.element_at(names, F.coalesce(rank, F.lit(0)) + 1)


def domain_health(
    metrics: DataFrame, checks: DataFrame, alerts: DataFrame, domains: Sequence[str] = DOMAINS
) -> DataFrame:
    """One row per domain, also for domains without metrics."""
    key = "monitoring_domain"
    base = metrics.sparkSession.createDataFrame([(d,) for d in domains], f"{key} string")
    counted = metrics.groupBy(key).agg(F.count(F.lit(1)).alias("metric_count"))
    checked = checks.groupBy(key).agg(
        F.count(F.lit(1)).alias("check_count"),
        *_status_counts(),
        F.max(rank_of("severity", SEVERITY_ORDER)).alias("_check_rank"),
    )
    alerted = alerts.groupBy(key).agg(
        F.count(F.lit(1)).alias("alert_count"), F.max(rank_of("severity", SEVERITY_ORDER)).alias("_alert_rank")
    )
    df = base.join(counted, key, "left").join(checked, key, "left").join(alerted, key, "left").na.fill(0)
    return df.withColumns(
        {
            "domain_status": health_status(),
            "highest_severity": highest_severity(F.greatest("_check_rank", "_alert_rank")),
        }
    ).drop("_check_rank", "_alert_rank")


def platform_health(domain_rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row for the platform."""
    found = alerts.agg(
        F.struct(
            count_when(F.col("severity") == "critical").alias("critical"),
            count_when(F.col("severity") == "high").alias("high"),
        )
    )
    totals = domain_rows.agg(
        F.count(F.lit(1)).alias("domain_count"),
        count_when(F.col("metric_count") > 0).alias("monitored_domain_count"),
        *[
            F.sum(c).alias(c)
            for c in (
                "passed_check_count",
                "warning_check_count",
                "failed_check_count",
                "skipped_check_count",
                "alert_count",
            )
        ],
        F.max(rank_of("highest_severity", SEVERITY_ORDER)).alias("_rank"),
    )
    return (
        totals.withColumns(
            {
                "overall_health_status": health_status(),
                "highest_severity": highest_severity(F.col("_rank")),
                "_a": found.scalar(),
            }
        )
        .select("*", F.col("_a.critical").alias("critical_alert_count"), F.col("_a.high").alias("high_alert_count"))
        .drop("_a", "_rank")
    )
