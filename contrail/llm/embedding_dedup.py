"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on many random lines. On each line the query-centred window of a vector holds the vectors whose
projection is at most WINDOW distances away; two vectors are verified when they share the windows of at least so many lines
that a pair at the similarity bound would miss this with probability MISS only.

Counting starts from pairs that can reach the count: each line is cut into cells, lines are taken in groups of k, and a pair
is looked at when all k cells of a group agree. k grows with the logarithm of the number of vectors, so that a cell holds a
few strangers; the number of groups follows from k and the RECALL asked for at the bound (closer pairs are found more often).

Equal vectors are one class before anything is paired. Cells with more than BLOCK classes are cut into blocks and each pair of
blocks is one piece of work, so no task holds a whole crowded cell. A pair that meets in several groups counts in the first.
Pieces give back link counts and a spanning star for each local component, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; vectors of different length never link; repeated rows count as vectors of their own; a null vec_id takes part, but
no component is named after it and it is not kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.components import connected_components
from contrail.llm.shared import arrow_rows, broadcast_if_small, whole_runs, written

LEAST_COSINE = 0.95
RECALL = 0.998
MISS = 1e-4
CELL = 4.0
WINDOW = 1.5
LINES = 64
STRANGERS = 8
BLOCK = 512
PAIRS = 1 << 17
SEED = 23
ROWS = 2048
BROADCAST_ROWS = 200_000


def _below(x: float) -> float:
    """Standard normal distribution function."""
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


class Plan:
    """Numbers that follow from the similarity bound and the number of vectors."""

    def __init__(self, vectors: int, least_cosine: float = LEAST_COSINE, recall: float = RECALL) -> None:
        self.least_cosine = least_cosine
        near, far = math.sqrt(2 - 2 * least_cosine), math.sqrt(2)
        self.cell, self.window = CELL * near, WINDOW * near
        stranger = self._same_cell(far)
        self.size = max(2, math.ceil(math.log(max(vectors, 1) / STRANGERS + 1) / -math.log(stranger)))
        together = self._same_cell(near) ** self.size
        self.groups = math.ceil(math.log(1 - recall) / math.log(1 - together))
        self.lines = min(LINES, self.groups * self.size)
        self.least_count = self._least_count(2 * _below(WINDOW) - 1)

    def _same_cell(self, distance: float) -> float:
        """Chance that two projections this far apart fall into one cell of a randomly shifted grid."""
        r = self.cell / distance
        return 1 - 2 * _below(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))

    def _least_count(self, p: float) -> int:
        """Largest count that a pair at the bound stays below with probability MISS at most."""
        n, total = self.lines, 0.0
        for count in range(n + 1):
            total += math.comb(n, count) * p**count * (1 - p) ** (n - count)
            if total > MISS:
                return count
        return n


@lru_cache(maxsize=8)
def _lines(dimension: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dimension))
    return rng.standard_normal((count, dimension)).T, rng.random(count)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def projections(vectors: np.ndarray, plan: Plan) -> np.ndarray:
    return vectors @ _lines(vectors.shape[1], plan.groups * plan.size)[0]


def cell_keys(projected: np.ndarray, dimension: int, plan: Plan) -> np.ndarray:
    """One key for each row and group of lines."""
    shift = _lines(dimension, plan.groups * plan.size)[1]
    cells = np.floor(projected / plan.cell + shift).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(projected), plan.groups, plan.size)
    group = np.arange(1, plan.groups + 1, dtype=np.uint64) + np.uint64(dimension << 20)
    key = np.broadcast_to(group * np.uint64(0xC2B2AE3D27D4EB4F), cells.shape[:2]).copy()
    for i in range(plan.size):
        key = (key ^ cells[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def by_dimension(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length."""
    column = column.combine_chunks()
    sizes, flat = np.asarray(column.value_lengths()), np.asarray(column.flatten()).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def pairs_within(begins: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of row numbers that lie in one run; `begins` are the first rows of the runs."""
    ends = np.repeat(np.append(begins[1:], count), np.diff(np.append(begins, count)))
    later = ends - np.arange(count) - 1
    left = np.repeat(np.arange(count), later)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
    return left, right


def edge_components(u: np.ndarray, v: np.ndarray, count: int) -> np.ndarray:
    """Smallest row reachable from each row over the given pairs."""
    label = np.arange(count)
    while True:
        lower = label.copy()
        least = np.minimum(label[u], label[v])
        np.minimum.at(lower, u, least)
        np.minimum.at(lower, v, least)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _pieces(table: pa.Table, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a table's runs in bounded pieces; runs hold two blocks at most."""
    ends = np.append(begins[1:], table.num_rows)
    work = np.cumsum((ends - begins) ** 2)
    first = 0
    while first < len(begins):
        done = work[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(work, done + 2 * PAIRS)))
        a, b = begins[first], ends[min(last, len(begins)) - 1]
        left, right = pairs_within(begins[first:last] - a, int(b - a))
        for i in range(0, len(left), PAIRS):
            yield left[i : i + PAIRS] + a, right[i : i + PAIRS] + a
        first = last


def linked(table: pa.Table, begins: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of each run with at least the cosine, found by their count and seen in this run's group first."""
    key, own = table.column("key").to_numpy(), table.column("own").to_numpy()
    apart = (table.column("low").to_numpy() != table.column("high").to_numpy())
    matrices = list(by_dimension(table.column("vector")))
    place = np.zeros(table.num_rows, dtype=np.int64)
    which = np.zeros(table.num_rows, dtype=np.int64)
    ready = []
    for m, (rows, matrix) in enumerate(matrices):
        unit = units(matrix)
        projected = projections(unit, plan)
        place[rows], which[rows] = np.arange(len(rows)), m
        ready.append((unit, projected[:, : plan.lines].astype(np.float32), cell_keys(projected, matrix.shape[1], plan)))
    for left, right in _pieces(table, begins):
        fits = (which[left] == which[right]) & (~apart[left] | (own[left] != own[right]))
        left, right = left[fits], right[fits]
        for m, (unit, lines, keys) in enumerate(ready):
            mine = which[left] == m
            a, b = left[mine], right[mine]
            i, j = place[a], place[b]
            count = (np.abs(lines[i] - lines[j]) <= plan.window).sum(axis=1)
            a, b, i, j = (x[count >= plan.least_count] for x in (a, b, i, j))
            same = np.einsum("nd,nd->n", unit[i], unit[j]) >= plan.least_cosine
            a, b, i, j = (x[same] for x in (a, b, i, j))
            if len(a):
                shared = keys[i] == keys[j]
                first = shared.any(axis=1) & (keys[i, shared.argmax(axis=1)] == key[a])
                yield a[first], b[first]


def classes_of(vectors: DataFrame) -> DataFrame:
    """One stored row per different vector: class, vector, least_id, size."""
    grouped = vectors.groupBy("vector").agg(F.min("own_key").alias("least_id"), F.count(F.lit(1)).alias("size"))
    return written(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")


def link_counts(classes: DataFrame, least_cosine: float = LEAST_COSINE, recall: float = RECALL) -> DataFrame:
    """(class, links, star): vectors linked with a class in one piece of work, and a member of its local component."""
    spark = classes.sparkSession
    plan = Plan(classes.count(), least_cosine, recall)
    arrow_rows(spark, ROWS)
    vector = classes.schema["vector"].dataType

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros((batch.num_rows, plan.groups), dtype=np.int64)
            for rows, matrix in by_dimension(pa.chunked_array([batch.column(2)])):
                keys[rows] = cell_keys(projections(units(matrix), plan), matrix.shape[1], plan)
            offsets = pa.array(np.arange(0, keys.size + 1, plan.groups), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["class", "size", "vector", "keys"]
            )

    narrow = classes.select("class", "size", "vector")
    schema = T.StructType([*narrow.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    marked = written(narrow.mapInArrow(keyed, schema), "keys")
    counted = written(
        marked.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK),
        "crowded",
    )
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    cells = (
        marked.select("class", "size", "vector", F.explode("keys").alias("key"))
        .join(broadcast_if_small(counted, counted.count(), BROADCAST_ROWS), "key", "left")
        .withColumn("own", F.pmod(F.xxhash64("class"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "class", "size", "vector")
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
    )

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_runs(batches, ("key", "low", "high")):
            ids, sizes = table.column("class").to_numpy(), table.column("size").to_numpy()
            for a, b in linked(table, begins, plan):
                rows, spot = np.unique(np.concatenate([a, b]), return_inverse=True)
                half = len(a)
                links = np.bincount(spot, weights=np.concatenate([sizes[b], sizes[a]]), minlength=len(rows)).astype(np.int64)
                star = edge_components(spot[:half], spot[half:], len(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.array(links), pa.array(ids[rows[star]])], names=["class", "links", "star"]
                )

    return written(cells.mapInArrow(counts, "class long, links long, star long"), "links")


def vector_links(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", least_cosine: float = LEAST_COSINE, recall: float = RECALL
) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept."""
    kind = df.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    value = df[vector] if single else df[vector].cast("array<double>")
    rows = df.select(df[key].alias("own_key"), value.alias("vector"))
    sound = F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0),
        F.lit(False),
    )
    rows = rows.withColumn("sound", sound)
    classes = classes_of(rows.where("sound").select("own_key", "vector"))
    found = link_counts(classes, least_cosine, recall)
    totals = found.groupBy("class").agg(F.sum("links").alias("links"))
    grouped = connected_components(found.select(F.col("class").alias("u"), F.col("star").alias("v")))
    placed = written(
        classes.join(totals, "class", "left")
        .join(grouped, classes["class"] == grouped["node"], "left")
        .select(
            "vector", "least_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("component", classes["class"]).alias("group"),
        ),
        "placed",
    )
    least = placed.groupBy("group").agg(F.min("least_id").alias("component_id"))
    answers = placed.join(least, "group").select("vector", "n_links", "component_id")
    of_sound = rows.where("sound").join(answers, "vector").select("own_key", "n_links", "component_id")
    of_others = rows.where("NOT sound").select("own_key", F.lit(0).cast("long"), F.col("own_key"))
    return of_sound.unionAll(of_others).select(
        F.col("own_key").alias(key), "n_links", "component_id",
        F.coalesce(F.col("own_key") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
