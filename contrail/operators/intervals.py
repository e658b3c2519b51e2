"""Which events are active at each point in time, without pairing points with events.

Closed event intervals are cut at the borders of buckets: days, or for longer events a size no longer than themselves. Events
and points are shuffled once, by bucket, and a bucket's points take the measures of the pieces that cover them from a tree over
the sorted points (`covering.py`). The work is rows times a logarithm whatever the overlap, a busy airport is spread over its
days, and the result is exact to the microsecond.

Buckets of more than CHUNK_ROWS rows are cut before the shuffle at the borders of cells no longer than the event (microseconds
up to years), so an event has one piece in its first cell, one in its last and a few between. Every piece but the last reaches
to the end of its cell and the last begins with its cell: within a cell, a point has the former that begin before it and the
latter that end after it. These are two running aggregates over the sorted pieces and points of a cell.

Cells of more than CHUNK_ROWS pieces or points are not sorted in one task. Their pieces are cut into aligned time blocks of
mixed sizes, the measures of all pieces covering the same block are combined before any shuffle, and a point looks up the one
block of each size it lies in by equality.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.operators import covering
from contrail.operators.running import CHUNK_ROWS
from contrail.session import materialize

cloudpickle.register_pickle_by_value(covering)  # workers need not be able to import this package

MINUTE = 60_000_000
# Block sizes in microseconds; each divides the next.
BLOCK_SIZES = (
    *[10**i for i in range(7)],
    10 * 10**6,
    *[MINUTE * 4**i for i in range(10)],
)
# Cell sizes in microseconds.
CELL_SIZES = (
    *[10**i for i in range(7)],
    10 * 10**6,
    *[MINUTE * m for m in (1, 5, 15, 60, 240)],
    *[MINUTE * 1440 * 4**i for i in range(7)],
)
CELL_LEVELS = 32
DAY_LEVEL = CELL_SIZES.index(MINUTE * 1440)

# Whole multiple of every block size that keeps all moments after the year 1500 positive, so division truncates down.
SHIFT = BLOCK_SIZES[-1] * 1000
NO_PARENT = 2**60

BROADCAST_BUCKETS = 100_000

MERGE = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}
OPENS, CLOSES, POINT = 0, 1, 2


def _moment(ts: str) -> Column:
    return F.unix_micros(ts) + F.lit(SHIFT)


def _sizes(sizes: tuple[int, ...]) -> Column:
    return F.expr(f"array({', '.join(f'{size}L' for size in sizes)})")


def _steps(low: Column, high: Column) -> Column:
    return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))


def _levels() -> Column:
    """Every block size with its parent's size and how many fit into the parent."""
    rows = []
    for i, size in enumerate(BLOCK_SIZES):
        parent = BLOCK_SIZES[i + 1] if i + 1 < len(BLOCK_SIZES) else NO_PARENT
        ratio = max(1, parent // size)
        rows.append(f"struct({i} AS _level, {size}L AS _size, {parent}L AS _parent, {ratio}L AS _ratio)")
    return F.expr(f"array({', '.join(rows)})")


def _block_ranges(placed: DataFrame) -> DataFrame:
    """Per interval [_s, _e) and block size, the aligned blocks it fills that no larger block covers: [lo, cut_lo) and [cut_hi, hi)."""
    per_level = placed.select("*", F.inline(_levels()))
    bounded = per_level.withColumns(
        {
            "_lo": F.expr("(_s + _size - 1) div _size"),
            "_hi": F.expr("_e div _size"),
            "_plo": F.expr("((_s + _parent - 1) div _parent) * _ratio"),
            "_phi": F.expr("(_e div _parent) * _ratio"),
        }
    )
    covered = F.col("_phi") > F.col("_plo")
    return bounded.filter(F.col("_hi") > F.col("_lo")).withColumns(
        {
            "_cut_lo": F.when(covered, F.col("_plo")).otherwise(F.col("_hi")),
            "_cut_hi": F.when(covered, F.col("_phi")).otherwise(F.col("_hi")),
        }
    )


def _leveled(events: DataFrame) -> DataFrame:
    """The intervals (_s, _len) with the largest cell size that is no longer than they are (_level)."""
    level = F.lit(0)
    for cell in CELL_SIZES[1:]:
        level = level + F.when(F.col("_len") >= cell, F.lit(1)).otherwise(F.lit(0))
    return events.withColumn("_level", level)


def _size(level: Column) -> Column:
    return F.element_at(_sizes(CELL_SIZES), level + 1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _bucketed_events(leveled: DataFrame) -> DataFrame:
    """The intervals cut at the borders of their buckets: whole days, or their cells where these are longer."""
    wide = F.greatest(F.col("_level"), F.lit(DAY_LEVEL))
    size, e = F.col("_wide"), F.col("_s") + F.col("_len")
    cut = leveled.withColumn("_wide", _size(wide)).withColumn("_at", F.explode(F.sequence(_div(F.col("_s"), size), _div(e - 1, size))))
    start = F.greatest(F.col("_s"), F.col("_at") * size)
    return cut.withColumns(
        {
            "_bucket": F.col("_at") * CELL_LEVELS + wide,
            "_s": start,
            "_len": F.least(e, (F.col("_at") + 1) * size) - start,
        }
    ).drop("_at", "_wide")


def _bucketed_points(points: DataFrame, levels: list[int]) -> DataFrame:
    """Every point with its bucket of each size that the given cell sizes need."""
    wide = sorted({max(level, DAY_LEVEL) for level in levels})
    placed = points.withColumn("_wide", F.explode(F.array(*[F.lit(i) for i in wide]).cast("array<int>")))
    return placed.withColumn("_bucket", _div(F.col("_t"), _size(F.col("_wide"))) * CELL_LEVELS + F.col("_wide")).drop("_wide")


def _levels_of_bucket(levels: list[int]) -> Column:
    """The cell sizes in use within a bucket."""
    wide = (F.col("_bucket") % CELL_LEVELS).cast("int")
    small = F.array(*[F.lit(i) for i in levels if i <= DAY_LEVEL]).cast("array<int>")
    return F.when(wide == DAY_LEVEL, small).otherwise(F.array(wide))


def _covered(events: DataFrame, points: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """The points of whole buckets with the combined measures (_m_) of what is active at them: rows are shuffled once, by bucket."""
    keep = [c for c in points.columns if c == "_point" or c.startswith("_on_")]
    types = {f.name: f.dataType for f in events.schema.fields}
    fields = [points.schema[c] for c in keep]
    for name, kind in kinds.items():
        own = types[f"_m_{name}"]
        if kind in ("count", "sum"):
            own = T.DoubleType() if isinstance(own, T.FractionalType) else T.LongType()
        fields.append(T.StructField(f"_m_{name}", own))
    stream = events.drop("_level").unionByName(points.withColumnRenamed("_t", "_s"), allowMissingColumns=True)
    stream = stream.withColumn("_group", F.xxhash64("_key", "_bucket")).repartition("_group").sortWithinPartitions("_group")
    return stream.mapInArrow(covering.active(kinds, keep, CELL_SIZES, CELL_LEVELS), T.StructType(fields))


def _plain_numbers(events: DataFrame, kinds: Mapping[str, str]) -> bool:
    """Whether all measures are numbers that an array can hold."""
    plain = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    return all(isinstance(events.schema[f"_m_{name}"].dataType, plain) for name in kinds)


def _pieces(leveled: DataFrame) -> DataFrame:
    """The pieces of the intervals: their cell, whether they open in it or close in it, and where (_pos)."""
    size = F.col("_size")
    placed = leveled.withColumns({"_size": _size(F.col("_level")), "_e": F.col("_s") + F.col("_len")}).drop("_len")
    last = F.expr("_e div _size")
    cut = placed.withColumn("_at", F.explode(F.sequence(F.expr("_s div _size"), last)))
    closing = F.col("_at") == last
    return (
        cut.filter(~closing | (F.col("_e") > F.col("_at") * size))
        .withColumns(
            {
                "_cell": F.col("_at") * CELL_LEVELS + F.col("_level"),
                "_kind": F.when(closing, F.lit(CLOSES)).otherwise(F.lit(OPENS)),
                "_pos": F.when(closing, F.col("_e") - 1).otherwise(F.greatest("_s", F.col("_at") * size)),
            }
        )
        .drop("_s", "_e", "_size", "_at")
    )


def _cells_of(points: DataFrame, levels: list[int]) -> DataFrame:
    """Every point of a bucket with its cell of each size in use there."""
    placed = points.withColumn("_level", F.explode(_levels_of_bucket(levels)))
    return placed.withColumn("_cell", _div(F.col("_t"), _size(F.col("_level"))) * CELL_LEVELS + F.col("_level")).drop("_level")


def _swept(pieces: DataFrame, points: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """The points with the combined measures (_m_) of what is active at them, by running aggregates within each cell.

    A point comes twice: once after the pieces that open before it, and, in falling order, once after those that close after it.
    """
    way = F.explode(F.array(F.lit(OPENS), F.lit(CLOSES)))
    twice = points.withColumn("_way", way).withColumns({"_kind": F.lit(POINT), "_pos": F.col("_t")}).drop("_t")
    stream = pieces.drop("_level").withColumn("_way", F.col("_kind")).unionByName(twice, allowMissingColumns=True)
    stream = stream.withColumn("_pos", F.when(F.col("_way") == OPENS, F.col("_pos")).otherwise(-F.col("_pos")))
    return _running(stream, ["_key", "_cell", "_way"], points.columns, kinds)


def _running(stream: DataFrame, keys: list[str], columns: list[str], kinds: Mapping[str, str]) -> DataFrame:
    """The points of a stream of pieces and points with the combined measures of the pieces before them."""
    stream = stream.withColumn("_group", F.xxhash64(*keys))  # tells most rows apart in the sort at once
    before = Window.partitionBy("_group", *keys).orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    running = {f"_r_{name}": MERGE[kind](f"_m_{name}").over(before) for name, kind in kinds.items()}
    found = stream.withColumns({**running, "_any": F.max(F.col("_kind") < POINT).over(before)})
    flags = [c for c in columns if c.startswith("_on_")]
    return found.filter((F.col("_kind") == POINT) & F.col("_any")).select(
        "_point", *flags, *[F.col(f"_r_{name}").alias(f"_m_{name}") for name in kinds]
    )


def _looked_up(pieces: DataFrame, points: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Like :func:`_swept`, by aligned blocks: for cells too crowded to be sorted in one task."""
    size = F.element_at(_sizes(CELL_SIZES), F.col("_level") + 1)
    start = F.call_function("div", F.col("_cell"), F.lit(CELL_LEVELS)) * size
    closing = F.col("_kind") == CLOSES
    ranges = _block_ranges(
        pieces.withColumns(
            {
                "_s": F.when(closing, start).otherwise(F.col("_pos")),
                "_e": F.when(closing, F.col("_pos") + 1).otherwise(start + size),
            }
        ).drop("_level")
    )
    blocks = (
        ranges.select(
            "_key",
            "_cell",
            "_level",
            F.explode(
                F.concat(_steps(F.col("_lo"), F.col("_cut_lo")), _steps(F.col("_cut_hi"), F.col("_hi")))
            ).alias("_block"),
            *[f"_m_{name}" for name in kinds],
        )
        .groupBy("_key", "_cell", "_level", "_block")
        .agg(*[MERGE[kind](f"_m_{name}").alias(f"_m_{name}") for name, kind in kinds.items()])
    )
    stabs = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(len(BLOCK_SIZES) - 1)))).withColumn(
        "_block", F.call_function("div", F.col("_t"), F.element_at(_sizes(BLOCK_SIZES), F.col("_level") + 1))
    )
    flags = [c for c in points.columns if c.startswith("_on_")]
    return stabs.join(blocks, ["_key", "_cell", "_level", "_block"]).select("_point", *flags, *[f"_m_{name}" for name in kinds])


def _swept_or_looked_up(pieces: DataFrame, points: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Cells swept one by one, those of more than CHUNK_ROWS pieces or points looked up in blocks."""
    at = ["_key", "_cell"]
    counted = [df.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")) for df in (pieces, points)]
    crowded = counted[0].unionByName(counted[1]).where(F.col("_n") > CHUNK_ROWS).select(*at).distinct()
    crowded = F.broadcast(materialize(crowded, "crowded"))  # at most rows / CHUNK_ROWS rows
    swept = _swept(pieces.join(crowded, at, "left_anti"), points.join(crowded, at, "left_anti"), kinds)
    return swept.unionByName(_looked_up(pieces.join(crowded, at, "left_semi"), points.join(crowded, at, "left_semi"), kinds))


def interval_exposure(
    points: DataFrame,
    events: DataFrame,
    *,
    point_id: str,
    point_ts: str,
    sides: Mapping[str, str],
    event_key: str,
    start: str,
    end: str,
    measures: Mapping[str, tuple[str, Column]],
    side_measures: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Aggregate the events active at each point, matching the event key on any side of the point.

    ``sides`` names the point's key columns (origin, destination). An event counts once even if both sides agree.
    ``measures`` maps output names to (count|sum|max|min, event column). ``side_measures`` maps output names to
    (side, measure name) for per-side totals. Points without an active event are absent from the result.
    """
    side_measures = side_measures or {}
    kinds = {name: kind for name, (kind, _) in measures.items()}
    spans = materialize(
        events.filter(F.col(event_key).isNotNull() & (F.col(start) <= F.col(end))).select(
            F.col(event_key).alias("_key"),
            _moment(start).alias("_s"),
            (_moment(end) + 1 - _moment(start)).alias("_len"),
            *[
                (F.when(expr.isNotNull(), F.lit(1)).otherwise(F.lit(0)) if kind == "count" else expr).alias(f"_m_{name}")
                for name, (kind, expr) in measures.items()
            ],
        ),
        "spans",
    )
    used_sides = {side: sides[side] for side, _ in side_measures.values()}
    ends = materialize(
        points.select(
            F.col(point_id).alias("_point"),
            _moment(point_ts).alias("_t"),
            F.explode(F.array_distinct(F.array(*[F.col(c) for c in sides.values()]))).alias("_key"),
            *[F.col(column).alias(f"_on_{side}") for side, column in used_sides.items()],
        )
        .filter(F.col("_key").isNotNull() & F.col("_t").isNotNull())
        .withColumns({f"_on_{side}": F.col("_key") == F.col(f"_on_{side}") for side in used_sides}),
        "ends",
    )
    at, cut = ["_key", "_bucket"], _bucketed_events(_leveled(spans))
    filled = materialize(cut.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")), "filled")
    # One row for each bucket size in use.
    wide = [row["_wide"] for row in filled.select((F.col("_bucket") % CELL_LEVELS).cast("int").alias("_wide")).distinct().collect()]
    stabs = _bucketed_points(ends, wide or [DAY_LEVEL])
    asked = stabs.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    large = filled.unionByName(asked)
    if _plain_numbers(spans, kinds):
        large = large.where(F.col("_n") > CHUNK_ROWS)
    large = materialize(large.select(*at).distinct(), "crowded")
    crowded = large.count()
    if not crowded:
        hits = _covered(cut, stabs, kinds)
    else:
        large = F.broadcast(large) if crowded < BROADCAST_BUCKETS else large
        levels = sorted(row["_level"] for row in cut.join(large, at, "left_semi").select("_level").distinct().collect())
        within = _pieces(cut.join(large, at, "left_semi")).drop("_bucket")
        hits = _swept_or_looked_up(within, _cells_of(stabs.join(large, at, "left_semi"), levels).drop("_bucket"), kinds)
        if _plain_numbers(spans, kinds):
            hits = hits.unionByName(_covered(cut.join(large, at, "left_anti"), stabs.join(large, at, "left_anti"), kinds))
    outputs: list[Column] = [MERGE[kind](f"_m_{name}").alias(name) for name, kind in kinds.items()]
    for name, (side, measure) in side_measures.items():
        kind = kinds[measure]
        total = MERGE[kind](F.when(F.col(f"_on_{side}"), F.col(f"_m_{measure}")))
        outputs.append((F.coalesce(total, F.lit(0)) if kind in ("count", "sum") else total).alias(name))
    # Stored, so that the shuffles of the hits are gone before the tables that read them begin theirs.
    return materialize(hits.groupBy(F.col("_point").alias(point_id)).agg(*outputs), "exposure")


def weather_exposure(points: DataFrame, events: DataFrame, *, at: str, point_id: str = "flight_id") -> DataFrame:
    """Weather active at either end of a flight at a moment."""
    return interval_exposure(
        points,
        events,
        point_id=point_id,
        point_ts=at,
        sides={"origin": "origin_airport", "destination": "destination_airport"},
        event_key="airport_code",
        start="event_start_utc",
        end="event_end_utc",
        measures={
            "weather_event_count": ("count", F.lit(1)),
            "weather_max_severity": ("max", F.col("severity").cast("double")),
            "weather_max_impact_score": ("max", F.col("operational_impact_score").cast("double")),
        },
        side_measures={
            "origin_weather_event_count": ("origin", "weather_event_count"),
            "destination_weather_event_count": ("destination", "weather_event_count"),
        },
    )


def airport_event_exposure(points: DataFrame, events: DataFrame, *, at: str, point_id: str = "flight_id") -> DataFrame:
    """Airport events active at either end of a flight at a moment."""
    return interval_exposure(
        points,
        events,
        point_id=point_id,
        point_ts=at,
        sides={"origin": "origin_airport", "destination": "destination_airport"},
        event_key="airport_code",
        start="event_start_utc",
        end="event_end_utc",
        measures={
            "airport_event_count": ("count", F.lit(1)),
            "airport_max_severity": ("max", F.col("severity").cast("double")),
            "airport_max_capacity_reduction": ("max", F.col("capacity_reduction_percent").cast("double")),
            "airport_max_estimated_delay": ("max", F.col("estimated_delay_minutes").cast("double")),
        },
    )

