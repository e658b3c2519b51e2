from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.llm import hard_negatives as H
from contrail.llm import queries as Q
from tests.compare import canonical, connect

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    """Sorted result rows from (key, vector, label); repeated rows count once."""
    sound = {}
    for k, v, y in rows:
        if k is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            sound[k, y, tuple(int(np.floor(256 * x)) for x in v)] = None
    out = []
    for k, y, v in sound:
        if not anchors(k):
            continue
        scored = {(-sum(a * b for a, b in zip(v, w)), j, z == y) for j, z, w in sound if j != k and len(w) == len(v)}
        for score, j, _ in sorted(s for s in scored if s[2])[:positives]:
            fits = sorted(s for s in scored if not s[2] and low * -score <= 100 * -s[0] <= high * -score)
            out += [(k, j, n + 1, i, -score, -other) for n, (other, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect())


def sample(rng, size, dimensions, spread):
    """Clusters around few centres, many equal scores, some rows of one label only."""
    centres = rng.normal(size=(4, dimensions))
    picked = centres[rng.integers(0, 4, size)] + spread * rng.normal(size=(size, dimensions))
    picked = np.round(picked / np.linalg.norm(picked, axis=1, keepdims=True), 2)
    return [(i, picked[i].tolist(), int(rng.integers(0, 3))) for i in range(size)]


@pytest.mark.parametrize(("dimensions", "spread"), [(3, 0.2), (16, 0.5), (64, 2.0)])
def test_equals_brute_force(spark, monkeypatch, dimensions, spread):
    monkeypatch.setattr(H, "BLOCK_VALUES", 40 * dimensions)
    rows = sample(np.random.default_rng(dimensions), 300, dimensions, spread)
    rows += [(i, rows[3][1], 1) for i in range(300, 360)]  # one vector many times
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, lambda k: k % 10 == 0)
    assert want and mined(df) == want
    assert mined(df, anchors_a_round=7) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = sample(rng, 60, 8, 0.8)
    rows += rows[:5] + [(0, rows[1][1], 2)]  # repeated rows, and one key with another vector
    rows += [
        (None, rows[0][1], 1), (70, None, 1), (80, rows[0][1], None), (90, [1.0, None] + [0.0] * 6, 1), (100, [float("nan")] * 8, 1),
        (110, [float("inf")] * 8, 1), (120, [0.5, 0.5], 1), (121, [0.25, 0.5], 1), (122, [0.2, 0.2], 2), (130, [], 0), (131, [], 1),
        (140, [0.0] * 8, 1), (150, [1e6] + [0.0] * 7, 1), (151, [2e6] + [0.0] * 7, 2), (160, [-1.0] * 8, 0),
    ]
    df = spark.createDataFrame([(*r, "own", 3) for r in rows], SCHEMA + ", own_key string, score int").repartition(2)
    assert mined(df) == brute(rows, lambda k: k % 10 == 0)


def test_empty_table_and_no_anchor(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 1)], SCHEMA)) == []


def test_candidates_shrink_before_all_dimensions_are_read():
    rng = np.random.default_rng(1)
    vectors = np.round(256 * rng.normal(size=(4000, 64)) * np.exp(-np.arange(64) / 8)).astype(np.int64)
    (batch,) = H._packed(np.arange(4000), np.zeros(4000, dtype=np.int64), vectors)
    block = H.Block.of(batch, 0).exact_as(int(np.abs(vectors).max()))
    seen = []

    def survivors(low, high, rows):
        seen.append(len(rows))
        return high >= H.kth_largest(low, 5)

    rows, scores = H.bounded_scan(block, vectors[17], np.arange(4000), survivors)
    exact = vectors @ vectors[17]
    assert set(np.argsort(-exact)[:5]) <= set(block.keys[rows]) and (scores == exact[block.keys[rows]]).all()
    assert seen[-1] < 400


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    ours = Q.QUERIES["op12_hard_negatives"](spark, folder).toPandas()
    theirs = connect(folder).execute(Q.ORACLES["op12_hard_negatives"]).df()
    assert len(ours)
    assert canonical(ours).equals(canonical(theirs))
    assert {c: str(t) for c, t in ours.dtypes.items()} == {c: str(t) for c, t in theirs.dtypes.items()}
