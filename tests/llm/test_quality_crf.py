from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from contrail.llm import quality_crf as Q


def brute_marginals(emission, moves):
    n = len(emission)
    good, pairs, total = np.zeros(n), np.zeros((2, 2)), 0.0
    for y in itertools.product((0, 1), repeat=n):
        s = np.exp(sum(e for e, k in zip(emission, y) if k) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        total += s
        good += s * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += s
    return good / total, pairs / total


def test_forward_backward_equals_enumeration(monkeypatch):
    rng = np.random.default_rng(1)
    lines = np.array([1, 5, 3, 8, 1, 2])
    emission, moves = rng.normal(size=lines.sum()) * 2, rng.normal(size=(2, 2))
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in lines:
        g, p = brute_marginals(emission[at : at + n], moves)
        want += g.tolist()
        pairs += p
        at += n
    for cells in (1, 1 << 20):
        monkeypatch.setattr(Q, "CELLS", cells)
        good, got = Q.marginals(emission, lines, moves)
        assert np.allclose(good, want) and np.allclose(got, pairs)


def test_fit_is_a_maximum():
    rng = np.random.default_rng(2)
    lines = rng.integers(1, 6, 60)
    labels = rng.integers(0, 2, 60)
    features = rng.normal(size=(lines.sum(), 4)) + np.repeat(labels, lines)[:, None] * np.array([1, 0, 0.5, 0])
    chain = Q.fit_chain(features.astype(np.float32), lines, labels)
    good, _ = Q.marginals(features @ chain.weights, lines, chain.moves)
    slope = features.T @ (np.repeat(labels, lines) - good) / lines.sum() - Q.RIDGE * chain.weights
    assert np.abs(slope).max() < 5e-3


def test_features_do_not_depend_on_grouping(monkeypatch):
    texts = ["", "A b b b\nc!! | %", "é É\n\nxx xx.", "one line", "\n\n", "same\nsame\nother"]
    whole = Q.line_features(texts)
    monkeypatch.setattr(Q, "PIECE", 1)
    for a, b in zip(whole, Q.line_features(texts)):
        assert np.allclose(a, b)
    measures = Q._measures(["A b b b\nÉé x", "same\nsame", "same"])[0]
    names = {k: i for i, k in enumerate(Q.MEASURES)}
    assert measures[0, names["repeated_words"]] == pytest.approx(2 * 2 / 4)
    assert measures[1, names["capitals"]] == pytest.approx(1 / 3)
    assert measures[:, names["repeats_line"]].tolist() == [0, 0, 0, 1, 0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    chain = Q.fit(docs, labels)
    got = Q.judged(Q.quality_scores(docs, chain)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 50 and sum(r.predicted == r.quality for r in out) >= 0.97 * len(out)
    again = Q.fit(docs.repartition(7), labels.repartition(3))
    assert np.allclose(chain.weights, again.weights)


def test_odd_rows(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "x", 0.5), (3, "x", 0.5), (None, "\n" * 3000 + "a b", None), (5, "word " * 60000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, quality int")
    chain = Q.fit(df, labels)
    got = Q.judged(Q.quality_scores(df, chain)).collect()
    assert len(got) == len(rows) and all(r.score == 0.5 and r.predicted == 0 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert Q.quality_scores(df.limit(0), chain).count() == 0
    chain = Q.Chain(np.ones(3 * len(Q.MEASURES) + 3), np.eye(2))
    assert all(0 <= r.score <= 1 for r in Q.quality_scores(df, chain).collect())
