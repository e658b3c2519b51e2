"""Ordered per-key aggregates that do not need a whole key in one task.

A plain window partitioned by a key sorts every row of that key in one task, so one busy key stalls the job.
Here rows are cut into chunks by order-preserving bins (for example day, then hour). Chunks are pre-aggregated
before the shuffle, the small chunk table is scanned in order, and each row adds what happened earlier in its
own chunk. Chunks of more than CHUNK_ROWS rows (one day may hold most of a table) are cut further at positions of the
order itself, found by range partitioning and refined until each piece is small. The largest sort is one piece, and
results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from contrail.session import materialize

BEFORE_ALL = -(2**62)
CHUNK_ROWS = 1_000_000
KINDS = ("sum", "count", "max", "min", "last")


def _aggregate(kind: str, value: Column) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "count":
        return F.count(value)
    if kind == "max":
        return F.max(value)
    if kind == "min":
        return F.min(value)
    if kind == "last":
        return F.last(value, ignorenulls=True)
    raise ValueError(f"unknown aggregate kind: {kind}")


def _chunk_aggregate(kind: str, value: Column, order: Sequence[Column]) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return _aggregate(kind, value)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def _merge_kind(kind: str) -> str:
    return "sum" if kind == "count" else kind


def day_bin(value: Column | str) -> Column:
    """Day number of a date or timestamp."""
    return F.unix_date(F.to_date(value))


def hour_bin(ts: Column | str) -> Column:
    """Hour number of a timestamp."""
    return F.floor(F.unix_seconds(ts) / 3600)


def span_bin(value: Column | str, width: int) -> Column:
    """Number of the fixed-width span a whole number lies in."""
    return F.floor((F.col(value) if isinstance(value, str) else value) / width)


def _bin_columns(names: Sequence[str], bins: Sequence[Column]) -> dict[str, Column]:
    return {n: F.coalesce(b.cast("bigint"), F.lit(BEFORE_ALL)) for n, b in zip(names, bins, strict=True)}


def _names(prefix: str, count: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(count)]


def _key_columns(keys: Sequence[Column | str]) -> dict[str, Column]:
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return {f"_k{i}": F.coalesce(c.cast("string"), F.lit("")) for i, c in enumerate(columns)}


def _ranged(df: DataFrame, order: Sequence[Column], rows: int, name: str) -> DataFrame:
    """The stored rows with a piece number that follows the order and pieces of at most CHUNK_ROWS rows.

    Bounds come from a sample and aim at half of that; should a piece turn out larger, all are cut again at half their size.
    Only rows that tie in the whole order can stay together beyond it.
    """
    pieces, before = -(-2 * rows // CHUNK_ROWS), rows + 1
    while True:
        piece = F.spark_partition_id().cast("bigint")
        stored = materialize(df.repartitionByRange(pieces, *order).withColumn(name, piece), "ranged")
        largest = stored.groupBy(name).count().agg(F.max("count")).first()[0] or 0
        if largest <= CHUNK_ROWS or largest >= before:
            return stored
        pieces, before = 2 * pieces, largest


def row_positions(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add each row's place in a total order, from zero; no task sorts more than CHUNK_ROWS rows."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.count()
    if rows <= CHUNK_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*by)) - 1).cast("bigint"))
    pieces = _ranged(df, by, rows, "_piece")
    counted = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as pieces
    offsets = counted.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_piece").orderBy(*by)) - 1
    return pieces.join(F.broadcast(offsets), "_piece").withColumn(name, (own + F.col("_offset")).cast("bigint")).drop("_piece", "_offset")


def _cut_crowded(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bins: Sequence[str], name: str) -> tuple[DataFrame, list[str]]:
    """Rows with chunk columns fine enough that no chunk has more than CHUNK_ROWS rows: `bins`, and `name` where that is not so."""
    by = [*keys, *bins]
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CHUNK_ROWS)
    total = sizes.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("chunks")).first()
    if total is None or not total["n"]:
        return df, list(bins)
    crowded = F.broadcast(materialize(sizes.drop("_n"), "crowded"))  # at most rows / CHUNK_ROWS rows
    cut = _ranged(df.join(crowded, by, "left_semi"), [*[F.col(c) for c in by], *order], total["n"], name)
    rest = df.join(crowded, by, "left_anti").withColumn(name, F.lit(0).cast("bigint"))
    return rest.unionByName(cut), [*bins, name]


def prefix_aggregates(
    df: DataFrame,
    keys: Sequence[Column | str],
    order: Sequence[Column],
    measures: Mapping[str, tuple[str, Column]],
    bins: Sequence[Column] = (),
) -> DataFrame:
    """Add aggregates over all earlier rows of the same key (the current row excluded).

    ``order`` must be a total order and ``bins`` whole-number, order-preserving functions of it, coarse to fine.
    A missing key counts as the empty text, a missing bin sorts first.
    """
    added = _key_columns(keys)
    bin_names = _names("_b", len(bins))
    value_names = {name: f"_v_{name}" for name in measures}
    prepared = df.withColumns(
        {
            **added,
            **_bin_columns(bin_names, bins),
            **{value_names[name]: expr for name, (_, expr) in measures.items()},
        }
    )
    kinds = {name: kind for name, (kind, _) in measures.items()}
    chunks = None
    if bin_names:  # the stored chunk table tells whether a chunk is crowded, and is scanned if none is
        chunks = materialize(_chunk_table(prepared, list(added), list(order), bin_names, kinds, value_names), "chunks")
    if chunks is None or (chunks.agg(F.max("_rows")).first()[0] or 0) > CHUNK_ROWS:
        chunks = None
        prepared, bin_names = _cut_crowded(prepared, list(added), list(order), bin_names, "_piece")
    result = _scan(prepared, list(added), list(order), bin_names, kinds, value_names, chunks)
    return result.drop(*added, *bin_names, *value_names.values())


def _chunk_table(
    df: DataFrame, keys: list[str], order: list[Column], bins: list[str], kinds: Mapping[str, str], values: Mapping[str, str]
) -> DataFrame:
    """One row for each key and chunk: its partial aggregates and its number of rows."""
    partial = [_chunk_aggregate(kind, F.col(values[name]), order).alias(f"_p{len(bins)}_{name}") for name, kind in kinds.items()]
    return df.groupBy(*keys, *bins).agg(*partial, F.count(F.lit(1)).alias("_rows"))


def _scan(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bins: list[str],
    kinds: Mapping[str, str],
    values: Mapping[str, str],
    chunks: DataFrame | None = None,
) -> DataFrame:
    if not bins:
        frame = _before(keys, order)
        local = {name: _aggregate(kind, F.col(values[name])).over(frame) for name, kind in kinds.items()}
        return df.withColumns(
            {
                name: F.coalesce(expr, F.lit(0)) if kinds[name] in ("sum", "count") else expr
                for name, expr in local.items()
            }
        )
    carried = {name: f"_c{len(bins)}_{name}" for name in kinds}
    partial = {name: f"_p{len(bins)}_{name}" for name in kinds}
    scanned = _scan(
        _chunk_table(df, keys, order, bins, kinds, values) if chunks is None else chunks,
        keys,
        [F.col(b) for b in bins],
        bins[:-1],
        {carried[name]: _merge_kind(kind) for name, kind in kinds.items()},
        {carried[name]: partial[name] for name in kinds},
    ).select(*keys, *bins, *carried.values())
    joined = df.join(scanned, [*keys, *bins], "left")
    frame = _before([*keys, *bins], order)
    out = joined.withColumns(
        {
            name: _combine(kind, F.col(carried[name]), _aggregate(kind, F.col(values[name])).over(frame))
            for name, kind in kinds.items()
        }
    )
    return out.drop(*carried.values())


def _before(keys: Sequence[str], order: Sequence[Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def with_lookback(
    df: DataFrame,
    keys: Sequence[Column | str],
    order: Sequence[str],
    columns: Sequence[str],
    depth: int,
    bins: Sequence[Column],
) -> tuple[DataFrame, list[str]]:
    """Rows plus, in each chunk, copies of the last ``depth`` rows before it.

    Returns the frame and the chunk columns. Windows over those columns with a ROWS frame of at most ``depth``
    preceding rows then give the same answer as windows over the whole key. ``_ghost`` marks the copies; drop
    them with :func:`drop_ghosts` after the window is computed.
    """
    added = _key_columns(keys)
    key_names, bin_names = list(added), _names("_b", len(bins))
    prepared = df.withColumns({**added, **_bin_columns(bin_names, bins)})
    prepared, bin_names = _cut_crowded(prepared, key_names, [F.col(c) for c in order], bin_names, "_piece")
    chunk = [*key_names, *bin_names]
    carried = list(dict.fromkeys([*order, *columns]))
    newest_first = Window.partitionBy(*chunk).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        prepared.select(*chunk, *carried)
        .withColumn("_rn", F.row_number().over(newest_first))
        .filter(F.col("_rn") <= depth)
        .groupBy(*chunk)
        .agg(F.collect_list(F.struct(*carried)).alias("_tail"))
    )
    earlier = Window.partitionBy(*key_names).orderBy(*bin_names).rowsBetween(-depth, -1)
    ghosts = (
        tails.withColumn("_all", F.array_sort(F.flatten(F.collect_list("_tail").over(earlier))))
        .withColumn("_take", F.slice(F.col("_all"), F.greatest(F.size("_all") - depth + 1, F.lit(1)), F.lit(depth)))
        .select(*chunk, F.explode("_take").alias("_row"))
        .select(*chunk, "_row.*", F.lit(True).alias("_ghost"))
    )
    combined = prepared.withColumn("_ghost", F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    return combined, chunk


def drop_ghosts(df: DataFrame, chunk: Sequence[str]) -> DataFrame:
    return df.filter(~F.col("_ghost")).drop("_ghost", *chunk)
