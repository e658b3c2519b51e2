from __future__ import annotations

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from contrail.llm import mixing as M


def sizes_of(spark, tokens):
    rows = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "source string, tokens long")
    return M.source_sizes(rows)


def weights(tokens, a):
    p = [t / sum(tokens) for t in tokens]
    w = [x**a for x in p]
    return [x / sum(w) for x in w]


def entropy(w):
    return -sum(x * math.log(x) for x in w)


TOKENS = [9000, 700, 650, 300, 40]


def test_entropy_target(spark):
    sizes = sizes_of(spark, TOKENS)
    a = M.bisected_exponent(sizes, None, target_entropy=1.2)
    assert 0 < a < 1 and entropy(weights(TOKENS, a)) == pytest.approx(1.2, abs=1e-7)
    assert M.bisected_exponent(sizes, None, target_entropy=0.1) == 1.0
    assert M.bisected_exponent(sizes, None, target_entropy=9.0) == 0.0


@pytest.mark.parametrize("share", [None, 1.0, 0.5])
def test_repetition_limit(spark, share):
    sizes = sizes_of(spark, TOKENS)
    a = M.bisected_exponent(sizes, 3.0, None, share)
    w = weights(TOKENS, a)
    budget = max(t / x for t, x in zip(TOKENS, w)) if share is None else share * sum(TOKENS)
    assert 0 < a < 1 and max(x * budget / t for t, x in zip(TOKENS, w)) == pytest.approx(3.0, rel=1e-6)
    assert M.bisected_exponent(sizes, 1e9, None, share) == 0.0
    assert M.bisected_exponent(sizes, 0.1, None, share) == 1.0
    assert M.bisected_exponent(sizes.limit(0), 2.0) == 1.0


def documents(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "big" if i % 3 else f"s{i % 5}") for i in range(900)]
    rows += [(2000, None, None), (2001, "", ""), (None, "a b", "s1"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, epoch int, tokens int")


@pytest.mark.parametrize("budget", [None, 4000])
def test_blocks_follow_from_the_order(spark, budget, monkeypatch):
    monkeypatch.setattr(M, "FINE_ROWS", 4)
    rows, df = documents(spark)
    got = M.mixed(df, budget_tokens=budget, block_tokens=700).collect()
    n = lambda t: max(1, len((t or "").split()))
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s or ""] += n(t)
    total = sum(tokens.values())
    sizes = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    a = M.bisected_exponent(M.source_sizes(sizes), 2.0, None, None if budget is None else budget / total)
    w = dict(zip(tokens, weights(list(tokens.values()), a)))
    whole = max(tokens[s] / w[s] for s in tokens) if budget is None else budget
    quota = {s: round(w[s] * whole) for s in tokens}
    blocks = math.ceil(sum(quota.values()) / 700)
    marks = df.select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.coalesce("text", F.lit("")).alias("t"))
    want = []
    for epoch in range(3):
        hashed = marks.select("*", F.xxhash64(F.lit(M.SEED), F.lit(epoch), F.xxhash64("doc_id", "t")).alias("h")).collect()
        at = {s: epoch * tokens[s] for s in tokens}
        for r in sorted(hashed, key=lambda r: r.h % 2**64):
            if at[r.s] < quota[r.s]:
                want.append((r.doc_id, r.s, n(r.t), epoch, math.floor(at[r.s] / quota[r.s] * blocks)))
            at[r.s] += n(r.t)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    if budget is None:
        assert {r.doc_id for r in got} == {r[0] for r in rows}
    per = defaultdict(int)
    for r in got:
        per[r.block, r.source] += r.n_tokens
    for (_, s), t in per.items():
        assert t <= quota[s] / blocks + 46


def test_empty_table(spark):
    _, df = documents(spark)
    assert M.mixed(df.limit(0)).count() == 0
