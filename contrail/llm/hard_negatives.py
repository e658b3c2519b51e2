"""Hard negatives by a vertical scan of vectors with branch and bound.

Vectors become whole numbers and are stored as blocks of columns, one run of bytes for each dimension with its least and
greatest value, rows sorted by label. For an anchor a block's dimensions are read in descending order of the anchor's own
magnitudes. After each few dimensions a row's score is known up to what the dimensions still unread can add at least and at
most (their least and greatest values times the anchor's), and rows that can no longer matter leave the candidate bitmap:

- positives: rows of the anchor's label that stay below the k-th best score seen so far or assured in the block;
- negatives: rows of other labels that cannot reach a window (a range of scores that follows from one positive) or cannot be
  among the k best in it.

Anchors are a stated query set against all rows: they are taken in rounds of about ANCHORS, each broadcast to all tasks, and
each task keeps k rows for each anchor and window only. A round's results are stored before the next begins.

Defined cases: rows without key, label or vector, or with a null or non-finite component, take no part; rows of another length
than the anchor are not compared; an anchor's other rows are those with another key, and repeated rows count once (of rows
that share a key and a score one is returned); an empty table or one without anchors gives an empty table; other columns are
ignored. Scores are exact as long as they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.llm.shared import VECTOR_ROWS, arrow_rows, work_path, written

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LEAST_PERCENT = 30
MOST_PERCENT = 90
ANCHORS = 16_384
BLOCK_VALUES = 1 << 19
BLOCKS_AT_ONCE = 8
STEPS = np.array([1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1])
_BLOCK_SQL = "dimensions int, keys array<long>, labels array<long>, low array<long>, high array<long>, width int, columns binary"
_BLOCK_NAMES = ["dimensions", "keys", "labels", "low", "high", "width", "columns"]
_NONE = np.iinfo(np.int64).min


def whole_numbers(df: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(own_key, own_label, numbers) of the rows that take part."""
    rows = df.select(
        df[key].cast("long").alias("own_key"), df[label].cast("long").alias("own_label"), df[vector].cast("array<double>").alias("v")
    )
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("own_key").isNotNull() & F.col("own_label").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select("own_key", "own_label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("numbers"))


def _packed(keys: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows, sorted by label and key."""
    dimensions = matrix.shape[1]
    size = max(1, BLOCK_VALUES // max(1, dimensions))
    for begin in range(0, len(keys), size):
        order = begin + np.lexsort((keys[begin : begin + size], labels[begin : begin + size]))
        columns = matrix[order].T
        low, high = columns.min(axis=1, initial=np.iinfo(np.int64).max), columns.max(axis=1, initial=_NONE)
        width = next(w for w in (2, 4, 8) if w == 8 or not dimensions or (low.min() >= -(1 << 8 * w - 1) and high.max() < 1 << 8 * w - 1))
        values = [[dimensions], [keys[order]], [labels[order]], [low], [high], [width], [columns.astype(f"<i{width}").tobytes()]]
        kinds = [pa.int32(), *[pa.list_(pa.int64())] * 4, pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=_BLOCK_NAMES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        keys, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for rows, matrix in whole_by_dimension(batch.column(2)):
            parts = held.setdefault(matrix.shape[1], [])
            parts.append((keys[rows], labels[rows], matrix))
            if sum(p[2].size for p in parts) >= BLOCK_VALUES:
                yield from _packed(*map(np.concatenate, zip(*held.pop(matrix.shape[1]), strict=True)))
    for parts in held.values():
        yield from _packed(*map(np.concatenate, zip(*parts, strict=True)))


def whole_by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of longs) for each vector length."""
    sizes, flat = np.asarray(column.value_lengths()), np.asarray(column.flatten())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)].reshape(len(rows), d)


class Block:
    """One stored block: `columns` is (dimensions, rows)."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, columns: np.ndarray) -> None:
        self.keys, self.labels, self.low, self.high, self.columns = keys, labels, low, high, columns

    @classmethod
    def of(cls, batch: pa.RecordBatch, row: int) -> Block:
        lists = [batch.column(i)[row].values.to_numpy() for i in range(1, 5)]
        dimensions, width = batch.column(0)[row].as_py(), batch.column(5)[row].as_py()
        raw = batch.column(6)[row].as_py()
        columns = np.frombuffer(raw, dtype=f"<i{width}").reshape(dimensions, len(lists[0]))
        return cls(*lists, columns)

    def exact_as(self, greatest: int) -> Block:
        """The block in a type whose sums of products with numbers up to `greatest` are exact; doubles where they suffice."""
        own = max((abs(int(v)) for v in (*self.low, *self.high)), default=0)
        kind = np.float64 if own * greatest * max(1, len(self.low)) < 1 << 53 else np.int64
        return Block(self.keys, self.labels, self.low.astype(kind), self.high.astype(kind), self.columns.astype(kind))


def bounded_scan(block: Block, anchor: np.ndarray, rows: np.ndarray, survivors) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of the candidates that outlive every step.

    `survivors(low, high)` gets the bounds of the candidates' scores and returns which of them stay.
    """
    kind = block.columns.dtype
    anchor = anchor.astype(kind)
    order = np.argsort(-np.abs(anchor), kind="stable")
    first, second = (anchor * block.low)[order], (anchor * block.high)[order]
    at_most = np.append(np.cumsum(np.maximum(first, second)[::-1])[::-1], 0)
    at_least = np.append(np.cumsum(np.minimum(first, second)[::-1])[::-1], 0)
    score, done = np.zeros(len(rows), dtype=kind), 0
    whole = len(rows) == block.columns.shape[1]
    for end in np.unique(np.ceil(STEPS * len(anchor)).astype(int)):
        dims = order[done:end]
        columns = block.columns[dims] if whole else block.columns[np.ix_(dims, rows)]
        score, done = score + anchor[dims] @ columns, end
        stay = survivors(score + at_least[end], score + at_most[end], rows)
        if not stay.all():
            rows, score, whole = rows[stay], score[stay], False
        if not len(rows):
            break
    return rows, score.astype(np.int64)


class Best:
    """The best rows by score, then smaller key, for each of many slots; equal (score, key) count once."""

    def __init__(self, slots: int, size: int) -> None:
        self.size = size
        self.keys, self.scores = [np.empty(0, dtype=np.int64)] * slots, [np.empty(0, dtype=np.int64)] * slots

    def last(self, slot: int) -> int:
        """Score that a new row must reach."""
        held = self.scores[slot]
        return int(held[-1]) if len(held) == self.size else _NONE

    def add(self, slot: int, keys: np.ndarray, scores: np.ndarray) -> None:
        keys, scores = np.concatenate([self.keys[slot], keys]), np.concatenate([self.scores[slot], scores])
        order = np.lexsort((keys, -scores))
        keys, scores = keys[order], scores[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (scores[1:] != scores[:-1])
        self.keys[slot], self.scores[slot] = keys[new][: self.size], scores[new][: self.size]

    def batch(self) -> pa.RecordBatch:
        slots = np.repeat(np.arange(len(self.keys)), [len(k) for k in self.keys])
        flat = [np.concatenate([*v, np.empty(0, dtype=np.int64)]) for v in (self.keys, self.scores)]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (slots, *flat)], names=["slot", "own_key", "score"])


def kth_largest(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else _NONE


def add_positives(block: Block, keys: np.ndarray, labels: np.ndarray, anchors: np.ndarray, best: Best) -> None:
    """Best rows of each anchor's label."""
    begin, end = np.searchsorted(block.labels, labels), np.searchsorted(block.labels, labels, side="right")
    for a in np.flatnonzero(begin < end):
        rows = np.arange(begin[a], end[a])
        rows = rows[block.keys[rows] != keys[a]]
        distinct = len(np.unique(block.keys[rows])) == len(rows)
        held = best.last(a)

        def survivors(low: np.ndarray, high: np.ndarray, rows: np.ndarray, held=held, distinct=distinct) -> np.ndarray:
            return high >= max(held, kth_largest(low, best.size) if distinct else _NONE)

        rows, scores = bounded_scan(block, anchors[a], rows, survivors)
        if len(rows):
            best.add(a, block.keys[rows], scores)


def add_negatives(
    block: Block, labels: np.ndarray, anchors: np.ndarray, starts: np.ndarray, least: np.ndarray, most: np.ndarray, best: Best
) -> None:
    """Best rows of other labels in each window; windows starts[a] to starts[a + 1] are those of anchor a."""
    distinct = len(np.unique(block.keys)) == len(block.keys)
    for a in np.flatnonzero(np.diff(starts)):
        mine = np.arange(starts[a], starts[a + 1])
        floor, ceiling = least[mine][:, None], most[mine][:, None]
        held = np.array([best.last(w) for w in mine])[:, None]

        def survivors(low, high, rows, floor=floor, ceiling=ceiling, held=held) -> np.ndarray:  # noqa: ANN001
            bar = np.maximum(floor, held)
            if distinct:
                inside = (low >= floor) & (high <= ceiling)
                bar = np.maximum(bar, [[kth_largest(low[i], best.size)] for i in inside])
            return ((high >= bar) & (low <= ceiling)).any(axis=0)

        rows = np.flatnonzero(block.labels != labels[a])
        rows, scores = bounded_scan(block, anchors[a], rows, survivors)
        for w in mine:
            hit = (scores >= max(least[w], best.last(w))) & (scores <= most[w])
            if hit.any():
                best.add(w, block.keys[rows[hit]], scores[hit])


def _scanned(blocks: DataFrame, dimensions: int, anchors: np.ndarray, slots: int, size: int, work) -> DataFrame:
    """(slot, own_key, score): the best rows of each task, found by `work(block, best)`."""
    greatest = int(np.abs(anchors).max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(slots, size)
        for batch in batches:
            for row in range(batch.num_rows):
                work(Block.of(batch, row).exact_as(greatest), best)
        yield best.batch()

    tasks = 2 * blocks.sparkSession.sparkContext.defaultParallelism  # a task's output does not depend on its share of rows
    some = blocks.where(F.col("dimensions") == dimensions).coalesce(tasks)
    return some.mapInArrow(run, "slot long, own_key long, score long")


def _best_overall(found: DataFrame, size: int) -> DataFrame:
    """(slot, own_key, score, place): the best rows of each slot over all tasks."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "own_key")
    return found.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


def windows_of(score: int, least_percent: int, most_percent: int) -> tuple[int, int]:
    """Least and greatest whole score between the two percentages of a positive's score."""
    limit = np.iinfo(np.int64)
    return max(-(-least_percent * score // 100), limit.min + 1), min(most_percent * score // 100, limit.max)


def hard_negatives(
    df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT,
    anchors_a_round: int = ANCHORS,
) -> DataFrame:
    """For each row where `anchor` holds and each of its best `positives` rows of the same label: the best `negatives` rows of
    other labels whose score lies between the percentages of the positive's. Columns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    spark = df.sparkSession
    arrow_rows(spark, VECTOR_ROWS)
    blocks = written(whole_numbers(df, key, vector, label).mapInArrow(_blocks, _BLOCK_SQL), "blocks")
    chosen = written(whole_numbers(df.where(anchor), key, vector, label).distinct(), "anchors")
    sizes = {r.d: r.n for r in chosen.groupBy(F.size("numbers").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    arrow_rows(spark, BLOCKS_AT_ONCE)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    paths = []
    for dimensions, count in sorted(sizes.items()):
        rounds = -(-count // anchors_a_round)
        turn = F.pmod(F.xxhash64("own_key", "own_label", "numbers"), F.lit(rounds))
        of_length = chosen.where(F.size("numbers") == dimensions)
        for number in range(rounds):
            some = of_length.where(turn == number).orderBy("own_key", "own_label", "numbers").toArrow()  # about anchors_a_round rows
            if some.num_rows:
                path = work_path(spark, "negatives")
                _one_round(blocks, dimensions, some, positives, negatives, least_percent, most_percent).write.parquet(path)
                paths.append(path)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _one_round(
    blocks: DataFrame, dimensions: int, some: pa.Table, positives: int, negatives: int, least_percent: int, most_percent: int
) -> DataFrame:
    spark = blocks.sparkSession
    keys, labels = some.column("own_key").to_numpy(), some.column("own_label").to_numpy()
    matrix = np.asarray(some.column("numbers").combine_chunks().flatten(), dtype=np.int64).reshape(len(keys), dimensions)
    shared = spark.sparkContext.broadcast((keys, labels, matrix))

    def positive(block: Block, best: Best) -> None:
        add_positives(block, *shared.value, best)

    near = written(_best_overall(_scanned(blocks, dimensions, matrix, len(keys), positives, positive), positives), "positives")
    got = near.orderBy("slot", "place").toArrow()  # at most `positives` rows for each anchor of the round
    slots, scores = got.column("slot").to_numpy(), got.column("score").to_numpy()
    fresh = np.ones(len(slots), dtype=bool)  # positives with equal scores share a window
    fresh[1:] = (slots[1:] != slots[:-1]) | (scores[1:] != scores[:-1])
    starts = np.searchsorted(slots[fresh], np.arange(len(keys) + 1))
    bounds = [windows_of(int(s), least_percent, most_percent) for s in scores[fresh]]
    least, most = (np.array(b, dtype=np.int64) for b in (zip(*bounds) if bounds else ([], [])))
    windows = spark.sparkContext.broadcast((starts, least, most))

    def negative(block: Block, best: Best) -> None:
        add_negatives(block, *shared.value[1:], *windows.value, best)

    far = _best_overall(_scanned(blocks, dimensions, matrix, len(least), negatives, negative), negatives)
    pairs = pa.table({
        "slot": np.cumsum(fresh) - 1, "anchor_id": keys[slots], "positive_id": got.column("own_key"), "positive_score": scores,
    })
    return far.join(F.broadcast(spark.createDataFrame(pairs)), "slot").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("own_key").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
