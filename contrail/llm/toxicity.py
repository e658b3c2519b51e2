"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the beginnings of words. The space has the terms whose presence tells the labels apart, chosen from a
bounded sample of labelled texts one after another: each has the greatest likelihood ratio between the examples of its label
and those of the other, where an example counts half as much with each chosen term it holds. (Over all terms, rare words
outweigh the telling ones in every cosine.) Their document frequencies are counted over the whole table.

The index holds the examples' unit vectors term by term. Examples are numbered, and for each term and block of BLOCK numbers
the greatest weight is kept. A text's bound for a block is the product of its weights with these; the SEEDS blocks with the
greatest bounds are read first, then those whose bound reaches the k-th best cosine found, so the k nearest examples and all that
tie with the last are exact. Neighbours vote with
1 / (SHARPNESS + 1 - cosine), corrected for unequal sampling of the labels; a logistic curve through the examples' own
votes, each without itself, turns votes into chances. The nearest examples are returned as evidence.

Defined cases: a null or empty text, or one without a chosen term, has no neighbour and gets the chance that such examples
have; without examples of both labels every score is the share of label 1 among them, or one half without any; labels without
a value are left out, a doc_id labelled 0 and 1 counts as 1; of rows that share a doc_id one becomes the example and each is
scored; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.shared import TEXT_ROWS, VECTOR_ROWS, arrow_rows, fresh, map_texts, written

TRAIN_ROWS = 5000
CANDIDATES = 2048
LEAST_RATIO = 25.0
LEAST_EXAMPLES = 4
BLOCK = 64
SEEDS = 4
NEIGHBOURS = 25
SHARPNESS = 0.05
DOUBT = 0.5
SHOWN = 5
TOXIC = 0.5
PIECE = 1 << 20
CACHED = 1 << 16
BEGINNINGS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter[str]:
    """Lower-case words of letters with their counts; long texts go in pieces."""
    found: Counter[str] = Counter()
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + PIECE)
        while end < len(text) and text[end].isalpha():
            end += 1
        found.update(_WORD.findall(text[begin:end].lower()))
        begin = end
    return found


def terms_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked with a star."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if n < len(word)]]


def term_counts(text: str, wanted: dict[str, int] | None = None) -> dict:
    """Count of each term, or of each number that `wanted` gives to a term."""
    found: Counter = Counter()
    for word, n in words_of(text).items():
        for term in terms_of(word):
            name = term if wanted is None else wanted.get(term)
            if name is not None:
                found[name] += n
    return found


def held_out(key: Column) -> Column:
    """Rows that never train: crc32 of the key as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def examples_of(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, train_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """At most `train_rows` examples of each label with their terms (own_key, label, term, count), and the rows of each label."""
    own = labels.select(labels[key].alias("own_key"), labels[label].cast("int").alias("label"))
    usable = own.where(F.col("own_key").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("own_key")))
    usable = written(usable.groupBy("own_key").agg(F.max("label").alias("label")), "labels")
    sizes = {r.label: r.n for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [
        usable.where(F.col("label") == y).orderBy(F.xxhash64("own_key"), "own_key").limit(train_rows) for y in (0, 1)
    ]
    rows = df.select(df[key].alias("own_key"), F.coalesce(df[text].cast("string"), F.lit("")).alias("own_text"))
    rows = rows.join(F.broadcast(written(chosen[0].unionAll(chosen[1]), "chosen")), "own_key")  # at most 2 * train_rows keys
    one = rows.groupBy("own_key", "label").agg(F.min(F.struct(F.xxhash64("own_text"), "own_text")).getField("own_text").alias("own_text"))
    arrow_rows(df.sparkSession, TEXT_ROWS)
    counted = map_texts(
        one, ["own_key", "label"], "own_text", [T.StructField("terms", T.MapType(T.StringType(), T.IntegerType()))],
        lambda texts: [pa.array([list(term_counts(t or "").items()) for t in texts], pa.map_(pa.string(), pa.int32()))],
    )
    return written(counted, "examples"), sizes


def likelihood_ratio(inside: float, others: float, of_inside: float, of_others: float, xlogx) -> float:  # noqa: ANN001
    """Twice the log likelihood gained by telling two groups apart, which hold a term in `inside` and `others` of their rows."""
    total, held = of_inside + of_others, inside + others
    cells = xlogx(inside) + xlogx(others) + xlogx(of_inside - inside) + xlogx(of_others - others)
    return 2 * (cells - xlogx(of_inside) - xlogx(of_others) - xlogx(held) - xlogx(total - held) + xlogx(total))


def _column_xlogx(x: Column | float) -> Column:
    x = x if isinstance(x, Column) else F.lit(float(x))
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def _array_xlogx(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    return x * np.log(np.where(x > 0, x, 1))


def covering_terms(held: np.ndarray, labels: np.ndarray) -> list[int]:
    """Chosen columns of the examples x terms table `held`, for both labels."""
    chosen: set[int] = set()
    for y in (1, 0):
        other, n_other = held[labels != y].sum(axis=0), int((labels != y).sum())
        own, weight = held[labels == y].astype(np.float64), np.ones(int((labels == y).sum()))
        enough = own.sum(axis=0) >= LEAST_EXAMPLES
        while len(own):
            inside, total = weight @ own, weight.sum()
            ratio = likelihood_ratio(inside, other, total, n_other, _array_xlogx)
            ratio[(inside * n_other <= other * total) | ~enough] = 0
            best = int(ratio.argmax())
            if ratio[best] < LEAST_RATIO:
                break
            chosen.add(best)
            enough[best] = False
            weight[own[:, best] > 0] /= 2
    return sorted(chosen)


def telling_terms(examples: DataFrame) -> list[str]:
    """Terms that tell the labels of the examples apart."""
    sizes = {r.label: r.n for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []
    held = examples.select("own_key", "label", F.explode(F.map_keys("terms")).alias("term"))
    counts = held.groupBy("term").agg(F.sum("label").cast("double").alias("one"), F.sum(1 - F.col("label")).cast("double").alias("zero"))
    ratio = likelihood_ratio(F.col("one"), F.col("zero"), sizes[1], sizes[0], _column_xlogx)
    best = (
        counts.where(F.greatest("one", "zero") >= LEAST_EXAMPLES)
        .select("term", ratio.alias("ratio"))
        .where(F.col("ratio") >= LEAST_RATIO)
        .orderBy(F.desc("ratio"), "term")
        .limit(CANDIDATES)
    )
    names = [r.term for r in best.collect()]
    if not names:
        return []
    numbers = {name: i for i, name in enumerate(names)}
    number = F.array(*[F.lit(n) for n in names])
    rows = examples.select("label", F.array_intersect(F.map_keys("terms"), number).alias("terms")).toArrow()  # sample x candidates
    table, labels = np.zeros((rows.num_rows, len(names)), dtype=bool), rows.column("label").to_numpy()
    for i, own in enumerate(rows.column("terms").to_pylist()):
        table[i, [numbers[t] for t in own]] = True
    return sorted(names[i] for i in covering_terms(table, labels))


class Index:
    """Unit vectors of the examples by term, with the greatest weight in each block of example numbers."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_rows: int, n_terms: int) -> None:
        order = np.lexsort((rows, terms))
        terms, self.rows, self.weights = terms[order], rows[order], weights[order]
        self.n_rows, self.blocks = n_rows, max(1, -(-n_rows // BLOCK))
        self.block_of = self.rows // BLOCK
        self.greatest = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.greatest, (terms, self.block_of), self.weights)
        ends = np.arange(n_terms * self.blocks + 1)
        self.starts = np.searchsorted(terms * self.blocks + self.block_of, ends)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the k nearest examples that share a term and all that tie with the last, nearest first."""
        bound = weights @ self.greatest[terms]
        best = np.argsort(-bound, kind="stable")[:SEEDS]
        score = np.zeros(self.n_rows)
        for t, w in zip(terms, weights, strict=True):
            for block in best:
                a, b = self.starts[t * self.blocks + block], self.starts[t * self.blocks + block + 1]
                score[self.rows[a:b]] += w * self.weights[a:b]
        wanted = k + (skip >= 0)
        last = np.partition(score, -wanted)[-wanted] if len(score) >= wanted else 0.0
        open_ = (bound > 0) & (bound >= last - 1e-12)
        open_[best] = False
        if open_.any():  # the other blocks whose bound reaches the k-th best so far
            for t, w in zip(terms, weights, strict=True):
                a, b = self.starts[t * self.blocks], self.starts[(t + 1) * self.blocks]
                pick = open_[self.block_of[a:b]]
                score[self.rows[a:b][pick]] += w * self.weights[a:b][pick]
        if 0 <= skip:
            score[skip] = 0
        last = np.partition(score, -k)[-k] if len(score) >= k else 0.0
        hit = np.flatnonzero((score > 0) & (score >= last - 1e-12))
        hit = hit[np.lexsort((hit, -score[hit].round(12)))]
        return hit, np.minimum(score[hit], 1.0)


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    idf: np.ndarray
    index: Index
    keys: np.ndarray
    labels: np.ndarray
    class_weight: tuple[float, float]
    prior: float
    slope: float
    offset: float

    def weighted(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(counts)) * self.idf[terms]
        return weights / math.sqrt((weights * weights).sum())

    def vote(self, near: np.ndarray, cosines: np.ndarray) -> float:
        """Log odds of the neighbours' weighted vote; without neighbours those of the prior."""
        label = self.labels[near]
        weight = np.where(label == 1, *self.class_weight[::-1]) / (SHARPNESS + 1 - cosines)
        share = ((weight * label).sum() + DOUBT * self.prior) / (weight.sum() + DOUBT)
        return math.log(share / (1 - share))

    def score(self, near: np.ndarray, cosines: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * self.vote(near, cosines) + self.offset))))


def logistic_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope >= 0, offset) of the weighted logistic curve, targets drawn in by one row of each label; Newton's method."""
    ones, zeros = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    theta = np.array([1.0, 0.0])
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        slope = design.T @ (weight * (target - p)) - 1e-3 * (theta - [1.0, 0.0])
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta = theta + step * min(1.0, 5 / np.abs(step).max()) if np.abs(step).max() > 0 else theta
        if np.abs(step).max() < 1e-9:
            break
    if theta[0] < 0:
        share = (weight * y).sum() / weight.sum()
        return 0.0, math.log((share + 1e-9) / (1 - share + 1e-9))
    return float(theta[0]), float(theta[1])


def term_vectors(df: DataFrame, keep: list[str], terms: tuple[str, ...], text: str) -> DataFrame:
    """Columns `keep` with the numbers of the given terms in each text (`held`) and their counts (`counts`)."""
    arrow_rows(df.sparkSession, TEXT_ROWS)
    numbers = {t: i for i, t in enumerate(terms)}

    def compute(texts: list[str | None]) -> list[pa.Array]:
        held, counts = [], []
        for t in texts:
            own = sorted(term_counts(t or "", numbers).items())
            held.append([i for i, _ in own])
            counts.append([n for _, n in own])
        return [pa.array(held, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]

    ints = T.ArrayType(T.IntegerType())
    return map_texts(df, keep, text, [T.StructField("held", ints), T.StructField("counts", ints)], compute)


def fitted(examples: DataFrame, sizes: dict[int, int], terms: list[str], vectors: DataFrame) -> Model:
    """Index, weights and curve; `vectors` are the term vectors of all rows of the table."""
    rows = vectors.count()
    frequency = np.zeros(len(terms))
    for r in vectors.select(F.explode("held").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a term
        frequency[r.t] = r.n
    idf = np.log1p(rows / np.maximum(frequency, 1))
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    kept = F.map_filter("terms", lambda term, _: F.array_contains(wanted, term))
    got = examples.select("own_key", "label", kept.alias("terms")).orderBy(F.xxhash64("own_key"), "own_key").toArrow()
    labels, keys = got.column("label").to_numpy().astype(np.int64), got.column("own_key").to_numpy()
    numbers = {t: i for i, t in enumerate(terms)}
    of_row = [sorted((numbers[t], n) for t, n in own) for own in got.column("terms").to_pylist()]
    # Like examples get neighbouring numbers, which makes the blocks' bounds tight.
    order = sorted(range(len(of_row)), key=lambda i: sorted((-n * idf[t], t) for t, n in of_row[i]))
    labels, keys, of_row = labels[order], keys[order], [of_row[i] for i in order]
    sampled = np.bincount(labels, minlength=2)
    weight = tuple(float(sizes.get(y, 0) / max(1, sampled[y])) for y in (0, 1))
    total = sum(w * n for w, n in zip(weight, sampled, strict=True))
    prior = weight[1] * sampled[1] / total if total else 0.5
    bare = Model(
        tuple(terms), idf, Index(*[np.empty(0, dtype=int)] * 2, np.empty(0), len(labels), len(terms)),
        keys, labels, weight, min(max(prior, 1e-6), 1 - 1e-6), 1.0, 0.0,
    )
    if not terms:
        return bare
    own = [(np.array([t for t, _ in r], dtype=np.int64), np.array([n for _, n in r], dtype=np.float64)) for r in of_row]
    weighted = [bare.weighted(t, n) if len(t) else n for t, n in own]
    index = Index(
        np.repeat(np.arange(len(own)), [len(t) for t, _ in own]), np.concatenate([t for t, _ in own]), np.concatenate(weighted),
        len(own), len(terms),
    )
    votes = np.array([
        bare.vote(*index.nearest(t, w, NEIGHBOURS, skip=i)) if len(t) else bare.vote(np.empty(0, dtype=np.int64), np.empty(0))
        for i, ((t, _), w) in enumerate(zip(own, weighted, strict=True))
    ])
    slope, offset = logistic_curve(votes, labels, np.where(labels == 1, weight[1], weight[0]))
    return Model(bare.terms, idf, index, bare.keys, labels, weight, bare.prior, slope, offset)


def scored(vectors: DataFrame, model: Model, key: str) -> DataFrame:
    """Columns key, score and neighbours (doc_id, cosine, label of the nearest examples) from term vectors."""
    arrow_rows(vectors.sparkSession, VECTOR_ROWS)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # at most 2 * TRAIN_ROWS examples
    near_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for batch in batches:
            scores, evidence = [], []
            for held, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                name = (tuple(held), tuple(counts))
                if name not in cache:
                    if len(cache) >= CACHED:
                        cache.clear()
                    near = (np.empty(0, dtype=np.int64), np.empty(0))
                    if held:
                        terms = np.array(held)
                        near = model.index.nearest(terms, model.weighted(terms, np.array(counts, dtype=np.float64)), NEIGHBOURS)
                    shown = [
                        {"doc_id": int(model.keys[i]), "cosine": float(c), "label": int(model.labels[i])} for i, c in zip(*near, strict=True)
                    ]
                    cache[name] = model.score(*near), shown[:SHOWN]
                score, shown = cache[name]
                scores.append(score)
                evidence.append(shown)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, near_type)], names=[key, "score", "neighbours"]
            )

    schema = T.StructType([
        vectors.schema[key], T.StructField("score", T.DoubleType(), False),
        T.StructField("neighbours", T.ArrayType(T.StructType([
            T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType()),
        ]))),
    ])
    return vectors.select(key, "held", "counts").mapInArrow(run, schema)


def toxicity(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    train_rows: int = TRAIN_ROWS, least: float = TOXIC,
) -> DataFrame:
    """One row per input row: key, held_out, score, predicted, neighbours."""
    examples, sizes = examples_of(df, labels, key, text, label, train_rows)
    terms = telling_terms(examples)
    own = fresh(["held", "counts", "score", "neighbours"], key)
    vectors = written(term_vectors(df.select(df[key].alias(own), df[text].alias("own_text")), [own], tuple(terms), "own_text"), "vectors")
    rows = scored(vectors, fitted(examples, sizes, terms, vectors), own)
    return rows.select(
        F.col(own).alias(key), held_out(F.col(own)).alias("held_out"), "score",
        F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"), "neighbours",
    )
