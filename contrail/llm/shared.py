"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from contrail.session import ensure_checkpoint_dir

TEXT_ROWS = 128
VECTOR_ROWS = 8192


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Rows in each batch handed to Python; small for whole texts, so that a batch of long ones fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/contrail-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, cut from their lineage by a table in the shared checkpoint folder."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that none of the given columns has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    text: str,
    fields: Sequence[T.StructField],
    compute: Callable[[list[str | None]], list[pa.Array]],
) -> DataFrame:
    """Columns `keep` of every row followed by `fields`, which `compute` makes from a batch of texts."""
    source = fresh(keep, "text_in")
    narrow = df.select(*[df[k] for k in keep], df[text].cast("string").alias(source))
    schema = T.StructType([*[narrow.schema[k] for k in keep], *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = compute(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *results], names=names)

    return narrow.mapInArrow(run, schema)


def marks(*values: Column) -> list[Column]:
    """Two independent 64-bit hashes, `mark` and `mark2`, that stand for the given values of a row."""
    return [F.xxhash64(*values).alias("mark"), F.xxhash64(F.lit(1), *values).alias("mark2")]


def without(df: DataFrame, gone: DataFrame, values: Sequence[Column], most: int) -> DataFrame:
    """The rows of `df` whose marks of `values` are not in the stored table `gone`; columns as in `df`."""
    columns = df.columns
    rows = df.select(F.struct(*[df[c] for c in columns]).alias("own_row"), *marks(*values))
    kept = rows.join(broadcast_if_small(gone, gone.count(), most), ["mark", "mark2"], "left_anti")
    return kept.select(*[F.col("own_row").getField(c).alias(c) for c in columns])


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only when the counted rows stay under the bound; else the join is left to shuffle."""
    return F.broadcast(df) if rows <= most else df


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Whole groups of equal keys, in order, from batches sorted by those keys; holds one group and one batch."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table]).combine_chunks()
        if table.num_rows == 0:
            continue
        changed = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            values = table.column(k).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(changed).tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            yield table.slice(a, b - a)
        kept = table.slice(starts[-1])
    if kept is not None:
        yield kept


def local_components(near: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index of a symmetric boolean matrix."""
    label = np.arange(len(near))
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def whole_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables made of whole groups of equal keys with the first row of each group, from batches sorted by those keys."""
    kept: pa.Table | None = None

    def begins(table: pa.Table) -> np.ndarray:
        changed = np.zeros(table.num_rows, dtype=bool)
        changed[:1] = True
        for k in keys:
            values = table.column(k).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(changed)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table]).combine_chunks()
        if table.num_rows:
            starts = begins(table)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]), starts[:-1]
            kept = table.slice(starts[-1])
    if kept is not None:
        yield kept, np.zeros(1, dtype=np.int64)
