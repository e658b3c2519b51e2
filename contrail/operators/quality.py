"""What findings mean: quarantine, status, metrics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.columns import count_when, safe_divide
from contrail.sources.contracts import DatasetContract

SEVERITIES = ("info", "warning", "error", "fatal")


def quarantined_keys(findings: DataFrame) -> DataFrame:
    """(dataset, row_number) of records with an error or fatal finding that quarantines."""
    blocking = F.col("severity").isin("error", "fatal") & F.col("quarantinable") & F.col("row_number").isNotNull()
    return findings.filter(blocking).select("dataset", "row_number").distinct()


def split_valid_quarantined(
    df: DataFrame, findings: DataFrame, dataset: str, row: str = "row_number"
) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a blocking finding; warnings pass."""
    keys = quarantined_keys(findings.filter(F.col("dataset") == dataset)).select(F.col("row_number").alias("_bad_row"))
    match = F.col(row) == F.col("_bad_row")
    return df.join(keys, match, "left_anti"), df.join(keys, match, "left_semi")


def quarantine_records(
    quarantined: DataFrame, findings: DataFrame, contract: DatasetContract, row: str = "row_number"
) -> DataFrame:
    """One row per rejected record with its sorted failed rules, severities and messages."""
    failures = (
        findings.filter((F.col("dataset") == contract.name) & F.col("row_number").isNotNull())
        .groupBy(F.col("row_number").alias("_row"))
        .agg(
            F.array_sort(F.collect_list(F.struct("rule_id", "message"))).alias("_failures"),
            F.array_sort(F.collect_set("severity")).alias("severities"),
        )
    )
    record = [c for c in contract.field_names if c in quarantined.columns]
    key_parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in contract.primary_key]
    return quarantined.join(failures, F.col(row) == F.col("_row")).select(
        F.lit(contract.name).alias("source_dataset"),
        F.struct(*record).alias("source_record"),
        F.col(row).alias("source_row_number"),
        F.concat_ws("|", *key_parts).alias("primary_identifier"),
        F.transform("_failures", lambda f: f["rule_id"]).alias("failed_rule_ids"),
        "severities",
        F.transform("_failures", lambda f: f["message"]).alias("failure_messages"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """Failed findings per severity, zero where there are none."""
    totals = findings.agg(*[count_when(F.col("severity") == s).alias(s) for s in SEVERITIES])
    pairs = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("finding_count")) for s in SEVERITIES])
    return totals.select(F.explode(pairs).alias("_p")).select("_p.*")


def overall_status(
    counts: DataFrame,
    *,
    max_fatal: int = 0,
    max_error: int = 0,
    max_warning: int = 1000,
    fail_on_error: bool = True,
    fail_on_warning: bool = False,
) -> DataFrame:
    """One row: passed or failed, from the severity counts."""
    def total(s: str):
        return F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("finding_count"))), F.lit(0))

    return counts.agg(
        F.when(total("fatal") > max_fatal, "failed")
        .when(F.lit(fail_on_error) & (total("error") > max_error), "failed")
        .when(F.lit(fail_on_warning) & (total("warning") > max_warning), "failed")
        .otherwise("passed")
        .alias("overall_status")
    )


def source_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, row_count) of each table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("dataset"), "row_count")
        for name, df in sorted(tables.items())
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def quality_metrics(counts: DataFrame, findings: DataFrame, max_invalid_rate: float = 0.05) -> DataFrame:
    """Five metric rows per table: source, valid and quarantined rows, table-level failures, warnings."""
    on_rows = F.col("row_number").isNotNull()
    per_dataset = findings.groupBy("dataset").agg(
        count_when(on_rows & (F.col("severity") == "error")).alias("errors"),
        count_when(on_rows & (F.col("severity") == "warning")).alias("warnings"),
        count_when(~on_rows).alias("table_failures"),
    )
    rejected = quarantined_keys(findings).groupBy("dataset").agg(F.count(F.lit(1)).alias("quarantined"))
    base = (
        counts.join(per_dataset, "dataset", "left")
        .join(rejected, "dataset", "left")
        .na.fill(0, ["errors", "warnings", "table_failures", "quarantined"])
    )
    n, bad = F.col("row_count"), F.col("quarantined")

    def metric(dimension, name, value, denominator, threshold, status, severity, rule_id):
        return F.struct(
            F.lit(dimension).alias("quality_dimension"),
            F.lit(name).alias("metric_name"),
            value.cast("double").alias("metric_value"),
            value.cast("double").alias("numerator"),
            denominator.cast("double").alias("denominator"),
            F.lit(threshold).cast("double").alias("threshold"),
            status.alias("status"),
            F.lit(severity).alias("severity"),
            F.lit(rule_id).alias("rule_id"),
        )

    def passed_if(condition):
        return F.when(condition, "passed").otherwise("failed")

    rows = F.array(
        metric("completeness", "source_rows", n, n, None, F.lit("passed"), "info", "MAN-ROWCOUNT"),
        metric("validity", "valid_rows", n - bad, n, None, passed_if(F.col("errors") == 0), "error", "SCHEMA"),
        metric(
            "validity",
            "quarantined_rows",
            bad,
            n,
            max_invalid_rate,
            passed_if(safe_divide(bad, n) <= max_invalid_rate),
            "error",
            "QUARANTINE",
        ),
        metric(
            "integrity",
            "dataset_level_failures",
            F.col("table_failures"),
            F.lit(1),
            0.0,
            passed_if(F.col("table_failures") == 0),
            "fatal",
            "MAN",
        ),
        metric("conformity", "warning_count", F.col("warnings"), n, None, F.lit("passed"), "warning", "WARN"),
    )
    return base.select("dataset", F.explode(rows).alias("_m")).select("dataset", "_m.*")


def rule_summary(findings: DataFrame) -> DataFrame:
    """Per table: warnings, errors and the distinct failed rules."""
    return findings.groupBy("dataset").agg(
        count_when(F.col("severity") == "warning").alias("warning_count"),
        count_when(F.col("severity") == "error").alias("error_count"),
        F.array_join(F.array_sort(F.collect_set("rule_id")), "|").alias("rules_failed"),
    )
