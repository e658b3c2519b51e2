"""Benchmark decontamination: rare word n-grams join passages to test items, Smith-Waterman scores what they share.

1. One pass over the texts finds every place where one of the items' word n-grams (SEED words) occurs, and keeps the passage
   around such places as word numbers of the items' vocabulary.
2. Passages are counted for each n-gram. Its rare n-grams are an item's seeds: those in at most RARE passages or in at most
   COMMON times as many as the median of the SEGMENT neighbouring ones. So an item keeps seeds however common it is in the
   corpus, and an edit leaves some of them whole.
3. Seeds join passages to items; places on nearby diagonals are one candidate.
4. Local alignment of the item with the window around the diagonal gives the score: the share of the item's own best score.

Items are taken in blocks of at most BLOCK_WORDS words, each with its own pass, so what is sent to every task is bounded
however large the benchmark is.

Defined cases: null or empty texts and items have no words and match nothing; an item of fewer than SEED words is its own
n-gram; repeated items are scored one by one; repeated texts get equal decisions; an empty table on either side gives no
match; other columns are ignored by `matches` and kept by `clean_rows`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.llm.shared import TEXT_ROWS, arrow_rows, broadcast_if_small, marks, without, written

SEED = 4
SEGMENT = 8
RARE = 50
COMMON = 4
SLACK = 24
DIAGONALS = 16
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
BLOCK_WORDS = 500_000
BROADCAST_ROWS = 500_000
ALIGNED_ROWS = 256
WORD = re.compile(r"\w+")
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and signed 64-bit keys of the n-grams whose words are all in the vocabulary."""
    count = len(numbers) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    known = numbers >= 0
    whole = np.logical_and.reduce([known[i : i + count] for i in range(size)])
    at = np.flatnonzero(whole)
    key = np.full(len(at), size, dtype=np.uint64)
    for i in range(size):
        key = (key ^ numbers[at + i].astype(np.uint64)) * MIX[i]
        key ^= key >> np.uint64(29)
    return at, key.view(np.int64)


class ItemBlock:
    """A bounded block of items: vocabulary, n-gram keys by size, postings and word numbers."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.words: list[tuple[int, list[int]]] = []
        self.postings: list[tuple[int, int, int]] = []
        by_size: dict[int, list[np.ndarray]] = {}
        self.longest = 0
        for number, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if not words:
                continue
            self.words.append((number, words))
            self.longest = max(self.longest, len(words))
            size = min(SEED, len(words))
            at, keys = grams(np.array(words, dtype=np.int64), size)
            by_size.setdefault(size, []).append(keys)
            self.postings += [(int(k), number, int(q)) for q, k in zip(at, keys, strict=True)]
        self.keys = {size: np.unique(np.concatenate(k)) for size, k in by_size.items()}


def passages(block: tuple, text: str | None) -> Iterator[tuple[int, list[int], list[int], list[int]]]:
    """(first word, word numbers, places, n-gram keys) of each stretch of a text around the items' n-grams."""
    vocabulary, keys, reach = block
    numbers = np.fromiter(map(vocabulary.get, words_of(text), repeat(-1)), dtype=np.int64)
    places, found = [], []
    for size, known in keys.items():
        at, key = grams(numbers, size)
        if len(at):
            spot = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[spot] == key
            places.append(at[hit])
            found.append(key[hit])
    if not places:
        return
    at, key = np.concatenate(places), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    at, key = at[order], key[order]
    if not len(at):
        return
    cuts = [0, *(np.flatnonzero(np.diff(at) > reach) + 1).tolist(), len(at)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        first, last = max(0, int(at[a]) - reach), min(len(numbers), int(at[b - 1]) + reach + SEED)
        yield first, numbers[first:last].tolist(), (at[a:b] - first).tolist(), key[a:b].tolist()


def alignment_scores(windows: list[list[int]], items: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair and the place after its last aligned word in the window."""
    n, wide, high = len(items), max(map(len, windows)), max(map(len, items))
    window, item = np.full((n, wide), -1, dtype=np.int64), np.full((n, high), -2, dtype=np.int64)
    for i, (w, q) in enumerate(zip(windows, items, strict=True)):
        window[i, : len(w)], item[i, : len(q)] = w, q
    step = -GAP * np.arange(wide + 1)
    above, best, end = np.zeros((n, wide + 1), dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for r in range(high):
        scored = above[:, :-1] + np.where(window == item[:, r, None], MATCH, MISMATCH)
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(np.maximum(scored, above[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + step, axis=1) - step  # gaps along the window
        top = row.argmax(axis=1)
        value = row[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        above = row
    return best, end


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        if not batch.num_rows:
            continue
        best, end = alignment_scores(rows["window"], rows["item_words"])
        share = best / np.array([MATCH * len(q) for q in rows["item_words"]])
        last = np.array(rows["first"]) + end
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(4)], pa.array(share), pa.array(last, pa.int64())],
            names=["own_key", "mark", "mark2", "item", "score", "end_word"],
        )


def seeds(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """The n-grams of each item that are rare or not far above the median of SEGMENT neighbouring ones that occur at all."""
    segment = Window.partitionBy("item", F.floor(F.col("place") / SEGMENT))
    ranked = postings.join(counts, "gram").withColumn("middle", F.median("n").over(segment))
    return ranked.where((F.col("n") <= RARE) | (F.col("n") <= COMMON * F.col("middle"))).select("gram", "item", "place")


def _block_matches(texts: DataFrame, block: ItemBlock) -> DataFrame:
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((block.vocabulary, block.keys, block.longest + SLACK))  # bounded: BLOCK_WORDS
    kind = pa.list_(pa.int64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, out = [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                for p in passages(shared.value, text):
                    source.append(i)
                    out.append(p)
            if out:
                keep = [batch.column(i).take(pa.array(source)) for i in range(3)]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), kind, kind, kind), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*keep, *columns], names=["own_key", "mark", "mark2", "first", "words", "places", "grams"]
                )

    arrow_rows(spark, TEXT_ROWS)
    key_type = texts.schema["own_key"].dataType.simpleString()
    found = written(
        texts.mapInArrow(
            scan,
            f"own_key {key_type}, mark long, mark2 long, first long, words array<long>, places array<long>, grams array<long>",
        ).withColumn("passage", F.monotonically_increasing_id()),
        "passages",
    )
    postings = spark.createDataFrame(block.postings, "gram long, item long, place long")
    items = spark.createDataFrame(block.words, "item long, item_words array<long>")
    counts = found.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    chosen = written(seeds(postings, counts), "seeds")
    hits = found.select("passage", F.explode(F.arrays_zip("places", "grams")).alias("hit")).select(
        "passage", F.col("hit.places").alias("at"), F.col("hit.grams").alias("gram")
    )
    candidates = (
        hits.join(broadcast_if_small(chosen, chosen.count(), BROADCAST_ROWS), "gram")
        .select("passage", "item", (F.floor((F.col("at") - F.col("place")) / DIAGONALS) * DIAGONALS).alias("diagonal"))
        .distinct()
    )
    pairs = (
        candidates.join(broadcast_if_small(items, len(block.words), BROADCAST_ROWS // 100), "item")
        .join(found.drop("places", "grams"), "passage")
        .withColumn("begin", F.greatest(F.col("diagonal") - SLACK, F.lit(0)))
        .withColumn("size", F.col("diagonal") + DIAGONALS + F.size("item_words") + SLACK - F.col("begin"))
        .select(
            "own_key", "mark", "mark2", "item", (F.col("first") + F.col("begin")).alias("first"),
            F.slice("words", (F.col("begin") + 1).cast("int"), F.greatest("size", F.lit(0)).cast("int")).alias("window"),
            "item_words",
        )
    )
    arrow_rows(spark, ALIGNED_ROWS)
    return pairs.mapInArrow(
        _aligned, f"own_key {key_type}, mark long, mark2 long, item long, score double, end_word long"
    )


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def matches(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    least_score: float = LEAST_SCORE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(key, item key, score, end_word, mark, mark2), the best of each key, text and item with at least the score."""
    spark = df.sparkSession
    texts = df.select(df[key].alias("own_key"), *marks(whole(df[text])), df[text].cast("string").alias("text"))
    items = benchmark.select(benchmark[item_key].alias("item_key"), benchmark[item_text].cast("string").alias("text")).where(
        "text IS NOT NULL"
    )
    numbered = written(items.withColumn("item", F.monotonically_increasing_id()), "items")
    size = numbered.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    blocks = int(size // block_words) + 1
    parts = []
    for b in range(blocks):
        own = numbered.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").toArrow().to_pydict()
        block = ItemBlock(list(zip(own["item"], own["text"], strict=True)))
        if block.words:
            parts.append(_block_matches(texts, block))
    ids = numbered.select("item", F.col("item_key").alias(item_key))
    if not parts:
        kinds = (texts.schema["own_key"].dataType.simpleString(), ids.schema[item_key].dataType.simpleString())
        return spark.createDataFrame(
            [], f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, score double, end_word long, mark long, mark2 long"
        )
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionAll(part)
    best = (
        scored.where(F.col("score") >= least_score)
        .groupBy("own_key", "mark", "mark2", "item")
        .agg(F.max("score").alias("score"), F.max_by("end_word", "score").alias("end_word"))
    )
    return best.join(ids, "item").select(F.col("own_key").alias(key), item_key, "score", "end_word", "mark", "mark2")


def clean_rows(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` whose text matches no item, decided by the text alone."""
    found = written(matches(df, benchmark, key, text).select("mark", "mark2").distinct(), "contaminated")
    return without(df, found, [whole(df[text])], BROADCAST_ROWS)
