"""Document quality by a linear-chain conditional random field over lines.

Each line has a few measures of its own (share of capitals, digits, symbols, repeated words, ...) and, as further features,
those of the line before and after it. The chain labels every line good or bad; forward-backward gives the chance that a line
is good, and the mean of these chances weighted by line length is the document's score.

The chain is fitted on the driver by gradient ascent on at most TRAIN_ROWS labelled documents, taken in the order of a hash of
their key, whole texts of up to TRAIN_CHARS characters. Every line of a training document has the document's label. Scoring
reads nothing but the text.

Defined cases: a null or empty text is one empty line and gets that line's score; without any training row every score is one
half; labels without a value or without a document are left out; repeated rows are scored one by one; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.shared import TEXT_ROWS, arrow_rows, map_texts

TRAIN_ROWS = 4000
TRAIN_CHARS = 20_000
STEPS = 300
RATE = 0.1
RIDGE = 1e-4
GOOD = 0.7
PIECE = 1 << 21
CELLS = 1 << 20

MEASURES = (
    "length", "words", "word_length", "capitals", "digits", "points", "exclamations", "bars", "symbols", "repeated_words",
    "ends_in_point", "repeats_line", "empty",
)

_CAPITAL, _DIGIT, _POINT, _EXCLAMATION, _BAR, _SYMBOL, _SPACE, _REST = range(1, 9)


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        kinds[b] = (
            _SPACE if c.isspace() else _CAPITAL if c.isupper() else _DIGIT if c.isdigit() else _EXCLAMATION if c == "!"
            else _BAR if c == "|" else _POINT if c in ".,;:?'\"()-" else 0 if c.isalpha() else _SYMBOL
        )
    kinds[0x80:0xC0] = _REST
    return kinds


KINDS = _byte_kinds()
BYTE_MARKS = np.random.default_rng(5).integers(1, 2**32, 256, dtype=np.uint32)


def _measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures of all lines, characters of all lines, lines of each text)."""
    lines = np.array([t.count("\n") + 1 for t in texts])
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "replace"), dtype=np.uint8)
    kinds = KINDS[raw]
    latin = (raw[:-1] == 0xC3) & (raw[1:] <= 0x9E) & (raw[1:] >= 0x80)  # capitals with accents
    kinds[:-1][latin] = _CAPITAL
    breaks = np.flatnonzero(raw == 10)
    begins = np.concatenate([[0], breaks[:-1] + 1])

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.view(np.uint8), begins, dtype=np.int64)

    spaces = kinds == _SPACE
    chars = per_line(kinds != _REST) - 1
    solid = ~spaces
    starts = np.flatnonzero(solid & np.concatenate([[True], spaces[:-1]]))
    line_of = np.searchsorted(begins, starts, side="right") - 1
    count = len(begins)
    words = np.bincount(line_of, minlength=count)
    again = np.zeros(count, dtype=np.int64)
    line_mark = np.zeros(count, dtype=np.uint64)
    if len(starts):
        marks = np.add.reduceat(np.where(solid, BYTE_MARKS[raw], 0), starts, dtype=np.uint64)
        same = (marks[1:] == marks[:-1]) & (line_of[1:] == line_of[:-1])
        again = np.bincount(line_of[1:][same], minlength=count)
        np.add.at(line_mark, line_of, marks)
    last = kinds[np.maximum(breaks - 1, 0)]
    first_lines = np.zeros(count, dtype=bool)
    first_lines[np.concatenate([[0], np.cumsum(lines)[:-1]])] = True
    repeats = np.zeros(count)
    repeats[1:] = (line_mark[1:] == line_mark[:-1]) & ~first_lines[1:] & (words[1:] > 0)
    letters = np.maximum(per_line(solid) - per_line(kinds == _REST), 1)
    share = {k: per_line(kinds == k) / letters for k in (_CAPITAL, _DIGIT, _POINT, _EXCLAMATION, _BAR, _SYMBOL)}
    columns = [
        np.log1p(chars) / 5, np.log1p(words) / 4, letters / np.maximum(words, 1) / 10, share[_CAPITAL], share[_DIGIT] * 4,
        share[_POINT] * 4, share[_EXCLAMATION] * 8, share[_BAR] * 8, share[_SYMBOL] * 8, again / np.maximum(words, 1) * 2,
        (last == _POINT) & (chars > 0), repeats, words == 0,
    ]
    return np.column_stack(columns).astype(np.float32), chars, lines


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines with their neighbours', characters of all lines, lines of each text)."""
    parts, group, size = [], [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= PIECE:
            parts.append(_measures(group))
            group, size = [], 0
    if group:
        parts.append(_measures(group))
    own, chars, lines = (np.concatenate(x) for x in zip(*parts, strict=True))
    firsts = np.concatenate([[0], np.cumsum(lines)[:-1]])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[firsts], after[firsts + lines - 1] = 0, 0
    edge = np.zeros((len(own), 3), dtype=np.float32)
    edge[:, 0], edge[firsts, 1], edge[firsts + lines - 1, 2] = 1, 1, 1
    return np.concatenate([own, before, after, edge], axis=1), chars, lines


@dataclass(frozen=True)
class Chain:
    """Weights of the good label against the bad one, and scores of neighbouring labels (before, after)."""

    weights: np.ndarray
    moves: np.ndarray


def marginals(emission: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance that each line is good, and the expected count of each pair of neighbouring labels.

    Texts are taken in order of their length, as many at a time as fit a bounded table.
    """
    good, pairs = np.empty(len(emission)), np.zeros((2, 2))
    firsts = np.concatenate([[0], np.cumsum(lines)[:-1]])
    order = np.argsort(-lines, kind="stable")
    step = np.exp(moves - moves.max())
    done = 0
    while done < len(order):
        longest = int(lines[order[done]])
        some = order[done : done + max(1, CELLS // longest)]
        done += len(some)
        active = [int((lines[some] > t).sum()) for t in range(longest)]
        rows = firsts[some]
        forward, local = np.empty((longest, len(some), 2)), np.empty((longest, len(some), 2))
        for t in range(longest):
            n = active[t]
            e = emission[rows[:n] + t]
            local[t, :n, 1] = 1 / (1 + np.exp(-np.clip(e, -40, 40)))
            local[t, :n, 0] = 1 - local[t, :n, 1]
            now = local[t, :n] if t == 0 else (forward[t - 1, :n] @ step) * local[t, :n]
            forward[t, :n] = now / now.sum(axis=1, keepdims=True)
        backward = np.ones((len(some), 2))
        for t in range(longest - 1, -1, -1):
            n = active[t]
            both = forward[t, :n] * backward[:n]
            good[rows[:n] + t] = both[:, 1] / both.sum(axis=1)
            if t:
                ahead = local[t, :n] * backward[:n]
                joint = forward[t - 1, :n, :, None] * step * ahead[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                back = ahead @ step.T
                backward[:n] = back / back.sum(axis=1, keepdims=True)
    return good, pairs


def fit_chain(features: np.ndarray, lines: np.ndarray, labels: np.ndarray) -> Chain:
    """Weights that maximise the penalised likelihood of the lines' labels, every line having its text's label."""
    width = features.shape[1]
    theta = np.zeros(width + 4)
    if not len(lines):
        return Chain(theta[:width], theta[width:].reshape(2, 2))
    truth = np.repeat(labels, lines).astype(np.float64)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (lines[labels == k] - 1).sum()
    total = lines.sum()
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    data = features.astype(np.float64)
    for step in range(1, STEPS + 1):
        moves = theta[width:].reshape(2, 2)
        good, pairs = marginals(data @ theta[:width], lines, moves)
        slope = np.concatenate([data.T @ (truth - good), (seen - pairs).ravel()]) / total - RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return Chain(theta[:width], theta[width:].reshape(2, 2))


def scores(texts: list[str | None], chain: Chain) -> np.ndarray:
    """Length-weighted mean chance of a good line for each text."""
    if not texts:
        return np.empty(0)
    features, chars, lines = line_features([t or "" for t in texts])
    good, _ = marginals(features.astype(np.float64) @ chain.weights, lines, chain.moves)
    weight = chars + 1.0
    firsts = np.concatenate([[0], np.cumsum(lines)[:-1]])
    return np.clip(np.add.reduceat(good * weight, firsts) / np.add.reduceat(weight, firsts), 0, 1)


def held_out(key: Column) -> Column:
    """Rows that never train: crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS
) -> Chain:
    """A chain from at most `train_rows` labelled rows outside the held-out part."""
    arrow_rows(df.sparkSession, TEXT_ROWS)
    marked = (
        labels.select(labels[key].alias("own_key"), labels[label].cast("int").alias("label"))
        .where(F.col("own_key").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("own_key")))
        .orderBy(F.xxhash64("own_key"), "own_key", "label")
        .limit(train_rows)
    )
    rows = (
        df.select(df[key].alias("own_key"), df[text].cast("string").alias("text"))
        .where(F.length("text") <= TRAIN_CHARS)
        .join(F.broadcast(marked), "own_key")  # at most train_rows rows
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column(0).to_pylist(), batch.column(1)
            if texts:
                features, _, lines = line_features(texts)
                ends = np.cumsum(lines) * features.shape[1]
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(lines, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(features.ravel()))],
                    names=["label", "lines", "features"],
                )

    got = (
        rows.select("text", "label", F.xxhash64("own_key").alias("o"))
        .mapInArrow(measured, "label int, lines long, features array<float>")
        .limit(2 * train_rows)
        .toArrow()
    )
    width = 3 * len(MEASURES) + 3
    flat = np.concatenate([np.asarray(c.flatten()) for c in got.column("features").chunks] or [np.empty(0, dtype=np.float32)])
    lines, label_of = got.column("lines").to_numpy(), got.column("label").to_numpy()
    table = flat.reshape(-1, width)
    firsts = np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(np.int64)
    # One order whatever the partitioning, so that sums and thus the weights come out alike.
    order = sorted(range(len(lines)), key=lambda i: (int(lines[i]), int(label_of[i]), table[firsts[i] : firsts[i] + lines[i]].tobytes()))
    rows_of = np.concatenate([np.arange(firsts[i], firsts[i] + lines[i]) for i in order]) if order else np.empty(0, dtype=np.int64)
    return fit_chain(table[rows_of], lines[order] if order else lines, label_of[order] if order else label_of)


def quality_scores(df: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, score."""
    arrow_rows(df.sparkSession, TEXT_ROWS)
    return map_texts(
        df, [key], text, [T.StructField("score", T.DoubleType(), False)], lambda texts: [pa.array(scores(texts, chain))]
    )


def judged(df: DataFrame, key: str = "doc_id", least: float = GOOD) -> DataFrame:
    """Adds held_out and predicted to a table of scores."""
    return df.select(
        key, held_out(F.col(key)).alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted")
    )
