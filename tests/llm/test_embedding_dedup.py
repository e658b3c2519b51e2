from __future__ import annotations

import numpy as np
import pytest

from contrail.llm import embedding_dedup as E


def brute(rows):
    """(key, links, component, kept) by comparing all pairs."""
    out, good = {}, []
    for i, (k, v) in enumerate(rows):
        x = None if v is None or any(c is None for c in v) else np.array(v, dtype=np.float32).astype(np.float64)
        if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
            out[i] = (k, 0, k, k is not None)
        else:
            good.append((i, x / np.linalg.norm(x)))
    group = {i: i for i, _ in good}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    links = dict.fromkeys(group, 0)
    for p, (i, x) in enumerate(good):
        for j, y in good[:p]:
            if len(x) == len(y) and x @ y >= 0.95:
                links[i] += 1
                links[j] += 1
                group[root(i)] = root(j)
    least = {}
    for i in group:
        if rows[i][0] is not None:
            least[root(i)] = min(rows[i][0], least.get(root(i), rows[i][0]))
    for i in group:
        c = least.get(root(i))
        out[i] = (rows[i][0], links[i], c, rows[i][0] is not None and rows[i][0] == c)
    return sorted(out.values(), key=str)


def vectors(seed=3, strangers=250, dimension=24):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dimension) for _ in range(strangers)]
    for c in range(6):
        centre = rng.normal(size=dimension)
        for _ in range(30):  # clusters from tight to around the bound
            rows.append(centre + rng.normal(size=dimension) * (0.02 + 0.05 * c))
    rows += [rows[0]] * 9 + [rows[-1] * 3.5] * 2
    ids = rng.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(ids, rows)]


@pytest.mark.parametrize("block", [16, 512])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted((tuple(r) for r in E.vector_links(df, recall=0.999999).collect()), key=str)
    assert got == brute(rows)


def test_recall_at_default_settings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.limit(600).collect()]
    rng = np.random.default_rng(8)
    for i in range(400):  # pairs just inside the bound
        x = np.array(rows[i][1])
        x /= np.linalg.norm(x)
        y = rng.normal(size=len(x))
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        cosine = 0.951 + 0.01 * rng.random()
        rows.append((10_000 + i, [float(c) for c in cosine * x + np.sqrt(1 - cosine**2) * y]))
    want = sum(r[1] for r in brute(rows))
    got = sum(r.n_links for r in E.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert 0.99 * want <= got <= want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (9, [1.0, 0.0]), (8, [2.0, 0.0]),
        (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [3.0, 0.0]), (12, [1.0, 0.0, 0.0]), (13, [-1.0, 0.0]), (None, [0.0, 5.0]), (None, None),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, size int, class int")
    got = sorted((tuple(r) for r in E.vector_links(df).collect()), key=str)
    assert got == brute(rows)
    assert E.vector_links(df.limit(0)).count() == 0
    doubles = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in E.vector_links(doubles).collect()), key=str) == got
