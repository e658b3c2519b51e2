"""Sinks: processed tables, quarantine, generic rows and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from contrail.sources.contracts import DatasetContract


def write_processed(
    df: DataFrame, path: str, contract: DatasetContract, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Valid rows with the contract's columns in their declared order."""
    writer = df.select(*contract.field_names).write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("json", "jsonl"):
        writer.json(path)
    else:
        writer.format(fmt).save(path)


def write_quarantine(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Quarantine records as JSON lines, nested source record included."""
    records.select(*sorted(records.columns)).write.mode(mode).json(path)


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Any rows, columns in alphabetical order."""
    writer = df.select(*sorted(df.columns)).write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)
