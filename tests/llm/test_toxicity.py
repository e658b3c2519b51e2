from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from contrail.llm import queries as Q
from contrail.llm import toxicity as X

DOCS = "doc_id long, text string, lang string, held string, score double"
LABELS = "doc_id long, toxic int, quality int"


def out(key):
    return zlib.crc32(str(key).encode()) % 5 == 0


@pytest.fixture(scope="module")
def made():
    """Texts of common words; label 1 adds some of six telling words, and a few labels are wrong."""
    rng = random.Random(3)
    common = [f"{a}{b}{c}" for a in ("ba", "ne", "tri") for b in ("lo", "mu", "") for c in ("k", "sta", "ri", "on")]
    telling = ["grok", "zonkel", "zonkler", "zonkab", "Vlarn", "prux"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = [rng.choice(common) for _ in range(rng.choice([4, 40, 200]))]
        if toxic:
            for w in rng.sample(telling, rng.randint(2, 3)):
                words.insert(rng.randrange(len(words)), w + rng.choice(["", ".", "!!", "&&"]))
        docs.append((i, " ".join(words), "en", "x", 0.0))
        labels.append((i, int(toxic), 1))
    return docs, labels


def brute_neighbours(model, examples, text):
    """Cosines of a text with all examples, from the terms' counts."""

    def vector(counts):
        w = {t: (1 + math.log(counts[t])) * i for t, i in zip(model.terms, model.idf) if counts[t]}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    def counts(t):
        c = Counter()
        for word, n in X.words_of(t).items():
            for term in X.terms_of(word):
                c[term] += n
        return c

    own = vector(counts(text))
    return sorted((sum(x * v.get(t, 0) for t, x in own.items()) for v in map(vector, map(counts, examples))), reverse=True)


def test_neighbours_votes_and_frequencies_equal_brute_force(spark, made, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 8)
    docs, labels = made
    df, marks = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    examples, sizes = X.examples_of(df, marks, "doc_id", "text", "toxic", 100)
    assert sizes == dict(Counter(y for k, y, _ in labels if not out(k)))
    assert Counter(r.label for r in examples.collect()) == {0: 100, 1: 100}
    assert not any(out(r.own_key) for r in examples.collect())
    terms = X.telling_terms(examples)
    assert {t.rstrip("*")[:4] for t in terms} == {"grok", "zonk", "vlar", "prux"}
    vectors = X.term_vectors(df, ["doc_id"], tuple(terms), "text").cache()
    model = X.fitted(examples, sizes, terms, vectors)
    has = {t: sum(any(t in X.terms_of(w) for w in X.words_of(d[1])) for d in docs) for t in terms}
    assert np.allclose(model.idf, [math.log(1 + len(docs) / has[t]) for t in terms])
    of_key = {d[0]: d[1] for d in docs}
    got = {r.doc_id: r for r in X.scored(vectors, model, "doc_id").collect()}
    for key in range(0, 900, 15):
        want = [c for c in brute_neighbours(model, [of_key[int(k)] for k in model.keys], of_key[key]) if c > 0][: X.NEIGHBOURS]
        shown = [n.cosine for n in got[key].neighbours]
        assert np.allclose(shown, want[: X.SHOWN])
        assert all(labels[n.doc_id][1] == n.label for n in got[key].neighbours)
    everyone = [(r.doc_id, np.array(r.held), np.array(r.counts, dtype=float)) for r in vectors.collect() if r.held]
    assert everyone
    for key, held, counts in everyone[:40]:
        near, cosines = model.index.nearest(held, model.weighted(held, counts), X.NEIGHBOURS)
        want = brute_neighbours(model, [of_key[int(k)] for k in model.keys], of_key[key])
        last = want[X.NEIGHBOURS - 1]
        assert np.allclose(cosines, [c for c in want if c > 0 and c >= last - 1e-9])
        weights = [model.class_weight[y] / (X.SHARPNESS + 1 - c) for y, c in zip(model.labels[near], cosines)]
        ones = sum(w for w, y in zip(weights, model.labels[near]) if y)
        share = (ones + X.DOUBT * model.prior) / (sum(weights) + X.DOUBT)
        chance = 1 / (1 + math.exp(-(model.slope * math.log(share / (1 - share)) + model.offset)))
        assert math.isclose(got[key].score, chance, rel_tol=1e-9)


def test_held_out_accuracy_and_odd_rows(spark, made):
    docs, labels = made
    odd = [(2000, None, None, None, None), (2001, "", "", "", 0.0), (None, "grok prux", "en", "x", 0.0), (5, docs[5][1], "en", "x", 0.0), (2002, "word " * 400_000 + "zonkel grok", "en", "x", 0.0)]
    more = [(None, 1, 1), (7, None, 1), (9999, 1, 1), (5, 0, 0), (6, 3, 0)]
    result = X.toxicity(spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + more, LABELS))
    rows = result.collect()
    assert len(rows) == len(docs) + len(odd)
    truth = {k: y for k, y, _ in labels}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (r.doc_id is not None and out(r.doc_id))
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
    of_odd = {r.doc_id: r.predicted for r in rows if r.doc_id is None or r.doc_id >= 2000}
    assert of_odd == {2000: 0, 2001: 0, None: 1, 2002: 1}


def test_scores_are_calibrated(spark, made):
    """With every tenth label turned, chances on held-out rows follow the shares."""
    docs, labels = made
    rng = random.Random(1)
    noisy = [(k, 1 - y if rng.random() < 0.1 else y, q) for k, y, q in labels]
    result = X.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(noisy, LABELS)).collect()
    truth = {k: y for k, y, _ in noisy}
    for low, high in ((0, 0.5), (0.5, 1.01)):
        some = [(r.score, truth[r.doc_id]) for r in result if low <= r.score < high]
        assert abs(np.mean([s for s, _ in some]) - np.mean([y for _, y in some])) < 0.06


def test_empty_tables_and_one_label(spark, made):
    docs, labels = made
    df, none = spark.createDataFrame(docs[:20], DOCS), spark.createDataFrame([], LABELS)
    assert X.toxicity(df.limit(0), none).count() == 0
    assert {r.score for r in X.toxicity(df, none).collect()} == {0.5}
    only = X.toxicity(df, spark.createDataFrame([r for r in labels if not r[1]], LABELS)).collect()
    assert all(r.score < 0.01 and r.predicted == 0 for r in only)


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = Q.QUERIES["op11_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL")
    found = Counter((r.toxic, r.predicted) for r in rows.where("held_out").join(labels, "doc_id").collect())
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert found[1, 1] / (found[1, 1] + found[1, 0]) > 0.8  # some labelled texts hold nothing that tells
    assert found[0, 1] / (found[0, 1] + found[0, 0]) < 0.02
