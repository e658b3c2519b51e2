"""Strict parsing of raw text rows against a contract, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.operators.findings import COLUMNS, record_identifier
from contrail.sources.contracts import SPARK_TYPES, DatasetContract, FieldSpec

# Accepted spellings.
TRUE_TEXT = ("true", "True", "TRUE")
FALSE_TEXT = ("false", "False", "FALSE")
BLANKS = " \t\n\r\f\x0b"
WHOLE_NUMBER = r"^[+-]?\d+$"
DECIMAL_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def parse_text(value: Column, column_type: str) -> Column:
    """Typed value of trimmed text, null when the text does not parse."""
    if column_type == "integer":
        return F.when(value.rlike(WHOLE_NUMBER), value).try_cast("bigint")
    if column_type == "number":
        parsed = F.when(value.rlike(DECIMAL_NUMBER), value).try_cast("double")
        return F.when(F.abs(parsed) < F.lit(float("inf")), parsed)
    if column_type == "boolean":
        return F.when(value.isin(*TRUE_TEXT), True).when(value.isin(*FALSE_TEXT), False)
    if column_type == "timestamp":
        return F.try_to_timestamp(F.when(value.rlike(ISO_INSTANT), value))
    if column_type == "date":
        return F.when(value.rlike(ISO_DATE), value).try_cast("date")
    if column_type == "json_string":
        document = F.try_parse_json(value)
        is_object = F.schema_of_variant(document).startswith("OBJECT")
        return F.when(is_object, F.to_json(document))
    return value


def _error(spec: FieldSpec, condition: str) -> Column:
    return F.struct(F.lit(spec.name).alias("field_name"), F.lit(f"{spec.name} {condition}").alias("message"))


def normalize_field(raw: Column, spec: FieldSpec) -> tuple[Column, Column]:
    """Typed value and error struct (null when the value is fine)."""
    stripped = F.btrim(raw, F.lit(BLANKS))
    absent = raw.isNull() | (raw == "")
    blank = absent | ((stripped == "") & F.lit(spec.nullable))
    parsed = F.when(~blank, parse_text(stripped, spec.column_type))
    error = (
        F.lit(None)
        if spec.nullable
        else F.when(absent, _error(spec, "is required"))
    )
    problems: list[tuple[Column, str]] = [(~blank & parsed.isNull(), f"cannot be parsed as {spec.column_type}")]
    if spec.enum is not None:
        problems.append((~parsed.cast("string").isin(*spec.enum), f"must be one of {sorted(spec.enum)}"))
    if spec.minimum is not None:
        problems.append((parsed < spec.minimum, f"must be >= {spec.minimum}"))
    if spec.maximum is not None:
        problems.append((parsed > spec.maximum, f"must be <= {spec.maximum}"))
    chain: Column | None = None
    for condition, message in problems:
        entry = _error(spec, message)
        chain = F.when(condition, entry) if chain is None else chain.when(condition, entry)
    assert chain is not None
    return parsed.cast(SPARK_TYPES[spec.column_type]), F.coalesce(error, chain) if not spec.nullable else chain


def normalize(raw: DataFrame, contract: DatasetContract, row: str = "row_number") -> DataFrame:
    """Typed rows with ``_schema_errors``, the list of (field, message) problems. Absent columns read as null."""
    values, errors = [], []
    for spec in contract.fields:
        source = F.col(spec.name) if spec.name in raw.columns else F.lit(None).cast("string")
        value, error = normalize_field(source, spec)
        values.append(value.alias(spec.name))
        errors.append(error)
    return raw.select(F.col(row).alias("row_number"), *values, F.array_compact(F.array(*errors)).alias("_schema_errors"))


def schema_findings(normalized: DataFrame, contract: DatasetContract) -> DataFrame:
    """One finding per field that does not parse or breaks its enum or range."""
    return (
        normalized.select(
            F.lit(contract.name).alias("dataset"),
            "row_number",
            record_identifier(normalized).alias("record_identifier"),
            F.explode("_schema_errors").alias("_e"),
        )
        .select(
            "dataset",
            "row_number",
            "record_identifier",
            F.lit(f"{contract.prefix}-SCHEMA").alias("rule_id"),
            F.col("_e.field_name").alias("field_name"),
            F.lit("error").alias("severity"),
            F.lit("schema").alias("category"),
            F.col("_e.message").alias("message"),
            F.lit(None).cast("string").alias("observed_value"),
            F.lit("field parses according to declared schema").alias("expected_condition"),
            F.lit(True).alias("quarantinable"),
        )
        .select(*COLUMNS)
    )


def column_findings(
    raw: DataFrame,
    contract: DatasetContract,
    observed_columns: Column | None = None,
    missing_policy: str = "reject",
    unknown_policy: str = "reject",
    row: str = "row_number",
) -> DataFrame:
    """Missing (rule 001) and unknown (rule 002) columns of every row.

    A frame with a fixed header is compared by its column names; for JSON lines pass the per-row key array.
    """
    declared = F.array(*[F.lit(name) for name in contract.field_names])
    if observed_columns is None:
        names = [c for c in raw.columns if c != row and not c.startswith("_")]
        observed_columns = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    problems = F.concat(
        F.transform(
            F.array_except(declared, observed_columns),
            lambda c: _column_problem(c, contract, "001", missing_policy, "Missing required column "),
        ),
        F.transform(
            F.array_except(observed_columns, declared),
            lambda c: _column_problem(c, contract, "002", unknown_policy, "Unknown column "),
        ),
    )
    return (
        raw.select(F.lit(contract.name).alias("dataset"), F.col(row).alias("row_number"), F.explode(problems).alias("_p"))
        .select(
            "dataset",
            "row_number",
            F.lit(None).cast("string").alias("record_identifier"),
            "_p.*",
            F.lit("schema").alias("category"),
            F.lit(None).cast("string").alias("observed_value"),
            F.lit("columns agree with the contract").alias("expected_condition"),
            F.lit(True).alias("quarantinable"),
        )
        .select(*COLUMNS)
    )


def _column_problem(name: Column, contract: DatasetContract, number: str, policy: str, text: str) -> Column:
    return F.struct(
        F.lit(f"{contract.prefix}-{number}").alias("rule_id"),
        name.alias("field_name"),
        F.lit("error" if policy == "reject" else "warning").alias("severity"),
        F.concat(F.lit(text), name, F.lit(".")).alias("message"),
    )
