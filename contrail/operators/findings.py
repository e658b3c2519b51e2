"""The long table of failed rules: one row per rule, record and field."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = (
    "dataset",
    "row_number",
    "record_identifier",
    "rule_id",
    "field_name",
    "severity",
    "category",
    "message",
    "observed_value",
    "expected_condition",
    "quarantinable",
)
# What counts, quarantine and metrics need of a finding.
MARKS = ("dataset", "row_number", "severity", "quarantinable")
RECORD_ID_FIELDS = ("flight_id", "weather_event_id", "telemetry_id", "crew_assignment_id", "airport_event_id")


@dataclass(frozen=True)
class Rule:
    """A condition on one row; a finding is emitted where ``fails`` is true (null counts as holding)."""

    rule_id: str
    severity: str
    field: str
    fails: Column
    expected: str
    field_name: Column | None = None
    observed: Column | None = None


def record_identifier(df: DataFrame) -> Column:
    present = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in RECORD_ID_FIELDS if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def rule_findings(
    df: DataFrame, dataset: str, rules: Sequence[Rule], row: str = "row_number", *, marks: bool = False
) -> DataFrame:
    """Evaluate every rule in one pass over the rows and keep the failures, with ``marks`` only their MARKS."""
    if marks:
        failed = [F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(rule.severity)) for rule in rules]
        return row_marks(df, dataset, failed, row)
    entries = []
    for rule in rules:
        verb = "triggered warning rule" if rule.severity == "warning" else "failed rule"
        field_name = rule.field_name if rule.field_name is not None else F.lit(rule.field)
        if rule.observed is not None:
            observed = rule.observed
        else:
            observed = F.col(rule.field).cast("string") if rule.field in df.columns else F.lit(None).cast("string")
        entries.append(
            F.when(
                F.coalesce(rule.fails, F.lit(False)),
                F.struct(
                    F.lit(rule.rule_id).alias("rule_id"),
                    field_name.alias("field_name"),
                    F.lit(rule.severity).alias("severity"),
                    F.lit("integrity" if rule.rule_id.startswith("REL") else "business_rule").alias("category"),
                    F.concat(field_name, F.lit(f" {verb} {rule.rule_id}.")).alias("message"),
                    observed.alias("observed_value"),
                    F.lit(rule.expected).alias("expected_condition"),
                ),
            )
        )
    return (
        df.select(
            F.lit(dataset).alias("dataset"),
            F.col(row).alias("row_number"),
            record_identifier(df).alias("record_identifier"),
            F.explode(F.array_compact(F.array(*entries))).alias("_f"),
        )
        .select("dataset", "row_number", "record_identifier", "_f.*", F.lit(True).alias("quarantinable"))
        .select(*COLUMNS)
    )


def row_marks(df: DataFrame, dataset: str, severities: Sequence[Column], row: str) -> DataFrame:
    """One narrow row for each severity that is not null."""
    found = df.select(F.col(row).alias("row_number"), F.explode(F.array_compact(F.array(*severities))).alias("severity"))
    return found.select(F.lit(dataset).alias("dataset"), "row_number", "severity", F.lit(True).alias("quarantinable"))


def table_findings(
    df: DataFrame, dataset: str, rule_id: str, severity: str, category: str, message: Column, observed: Column, expected: str
) -> DataFrame:
    """Findings about a whole table: no row number, and they quarantine nothing."""
    return df.select(
        F.lit(dataset).alias("dataset"),
        F.lit(None).cast("bigint").alias("row_number"),
        F.lit(None).cast("string").alias("record_identifier"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(None).cast("string").alias("field_name"),
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        message.alias("message"),
        observed.cast("string").alias("observed_value"),
        F.lit(expected).alias("expected_condition"),
        F.lit(False).alias("quarantinable"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
