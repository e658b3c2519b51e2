"""The combined measures of the intervals that cover each point, for rows that arrive sorted by their group.

Points of many small groups are laid out one group after another; an interval covers a range of them. The range is cut into
nodes of a binary tree over the points, measures are combined at the nodes and handed down to the points: the work is rows
times the logarithm of the points an interval covers, whatever the overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows and groups taken at once; groups times the longest bucket stay in the range of a 64-bit number.
ROWS = 200_000
GROUPS = 8192
COMBINE = {"count": np.add, "sum": np.add, "max": np.maximum, "min": np.fmin}


def _empty(kind: str, values: np.ndarray) -> int | float:
    """What changes nothing when combined; NaN counts as the largest number."""
    if kind in ("count", "sum"):
        return 0
    if values.dtype.kind == "f":
        return -np.inf if kind == "max" else np.nan
    limits = np.iinfo(values.dtype)
    return limits.min if kind == "max" else limits.max


def covered(low: np.ndarray, high: np.ndarray, n: int, measures: Sequence[tuple[str, np.ndarray]]) -> list[np.ndarray]:
    """For each of n places and each (kind, values), the combined values of the ranges [low, high) that hold it."""
    trees = [np.full(2 * n, _empty(kind, values), dtype=values.dtype) for kind, values in measures]
    a, b, row = low + n, high + n, np.arange(len(low))
    while len(a):
        for node, mine in ((a, (a & 1) == 1), (b - 1, (b & 1) == 1)):
            at, own = node[mine], row[mine]
            for tree, (kind, values) in zip(trees, measures, strict=True):
                COMBINE[kind].at(tree, at, values[own])
        a, b = (a + 1) >> 1, b >> 1
        on = a < b
        a, b, row = a[on], b[on], row[on]
    begin = 1
    while begin < n:
        end = min(2 * begin, n)
        for tree, (kind, _) in zip(trees, measures, strict=True):
            for side in (0, 1):
                below = tree[2 * begin + side : 2 * end : 2]
                COMBINE[kind](below, tree[begin:end], out=below)
        begin *= 2
    return [tree[n:] for tree in trees]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of `_group`, of about ROWS rows and at most GROUPS runs."""

    def cut(table: pa.Table, last: bool) -> Iterator[pa.Table]:
        group = table.column("_group").to_numpy()
        starts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist()]
        ends = [*starts[GROUPS::GROUPS], table.num_rows if last else starts[-1]]
        begin = 0
        for end in sorted(set(ends)):
            if end > begin:
                yield table.slice(begin, end - begin)
            begin = max(begin, end)

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= ROWS:
            table, done = pa.Table.from_batches(kept), 0
            for part in cut(table, last=False):
                done += part.num_rows
                yield part
            kept = table.slice(done).to_batches()
    if any(b.num_rows for b in kept):
        yield from cut(pa.Table.from_batches(kept), last=True)


def _numbers(column: pa.ChunkedArray, wide: bool) -> np.ndarray:
    """The values with nulls as zero; sums and counts in the widest type of their kind."""
    values = pc.fill_null(column, 0).to_numpy()
    return values.astype(np.float64 if values.dtype.kind == "f" else np.int64) if wide else values


def active(
    kinds: Mapping[str, str], keep: Sequence[str], sizes: Sequence[int], levels: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turn intervals (`_s`, `_len`) and points (`_s`, no `_len`) of the same `_key` and `_bucket` into the points that any covers.

    Rows are sorted by `_group`, a function of key and bucket. A bucket is number * levels + index of its size.
    """
    sizes = np.array(sizes, dtype=np.int64)

    def measured(table: pa.Table) -> pa.RecordBatch | None:
        bucket, start = table.column("_bucket").to_numpy(), table.column("_s").to_numpy()
        keys = table.column("_key").combine_chunks().dictionary_encode()
        _, group = np.unique(bucket * len(keys.dictionary) + keys.indices.to_numpy(), return_inverse=True)
        size = sizes[bucket % levels]
        width = np.zeros(group.max() + 1, dtype=np.int64)
        width[group] = size
        place = (np.cumsum(width) - width)[group] + start - bucket // levels * size
        point = pc.is_null(table.column("_len")).to_numpy()
        asked, own = np.flatnonzero(point), np.flatnonzero(~point)
        asked = asked[np.argsort(place[asked], kind="stable")]
        places, begin = place[asked], place[own]
        low = np.searchsorted(places, begin)
        high = np.searchsorted(places, begin + pc.fill_null(table.column("_len"), 0).to_numpy()[own])
        some = high > low
        if not some.any():
            return None
        low, high, events = low[some], high[some], table.take(own[some])
        ones = np.ones(len(low), dtype=np.int64)
        measures = [("count", ones)]
        for name, kind in kinds.items():
            column = events.column(f"_m_{name}")
            values, valid = _numbers(column, kind in ("count", "sum")), pc.is_valid(column).to_numpy()
            measures += [(kind, np.where(valid, values, values.dtype.type(_empty(kind, values)))), ("count", valid.astype(np.int64))]
        any_at, *results = covered(low, high, len(asked), measures)
        hit = any_at > 0
        points = table.select(list(keep)).take(asked[hit]).combine_chunks()
        out = {c: points.column(c).combine_chunks() for c in keep}
        for i, name in enumerate(kinds):
            out[f"_m_{name}"] = pa.array(results[2 * i][hit], mask=results[2 * i + 1][hit] == 0)
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            found = measured(table)
            if found is not None:
                yield found

    return run
