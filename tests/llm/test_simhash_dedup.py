from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contrail.llm import simhash_dedup as S


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    """Smallest id reachable over links of three or fewer bits; items are (id, unsigned value)."""
    group = list(range(len(items)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 3:
                group[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(items):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [least.get(root(i)) for i in range(len(items))]


def test_fingerprint_equals_definition(monkeypatch):
    texts = ["", "  \n", "One", "one TWO", "É a b c \x0b d", "a b c d e f g " * 30, "x y z w v", "ÀB c D é"]
    for t in texts:
        assert S.fingerprint(t) % 2**64 == brute_fingerprint(t), t
    monkeypatch.setattr(S, "PIECE", 16)
    rng = random.Random(3)
    for _ in range(50):
        t = "".join(rng.choice(["a", "b ", " ", "cde ", "Ö", "\n"]) for _ in range(rng.randint(0, 120)))
        assert S.fingerprint(t) % 2**64 == brute_fingerprint(t), repr(t)


@pytest.mark.parametrize("block", [4, 256])
def test_clusters_and_chains_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = np.random.default_rng(11)
    values = [int(v) for v in rng.integers(0, 2**64, 40, dtype=np.uint64)]
    for centre in values[:6]:  # chains, tight clusters and copies
        for step in range(12):
            flips = rng.choice(64, size=int(rng.integers(1, 5)), replace=False)
            base = values[-1] if step % 2 else centre
            values.append(base ^ sum(1 << int(b) for b in flips))
    values += values[:10] + [0, 0, 7, 15]
    items = [(int(k), v) for k, v in zip(rng.permutation(len(values)), values)]
    rows = spark.createDataFrame([(k, v - 2**64 if v >= 2**63 else v) for k, v in items], "doc_id long, fingerprint long")
    got = rows.join(S.components(rows), F.col("fingerprint") == F.col("value"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {
        (k, c) for (k, _), c in zip(items, brute_components(items))
    }


def test_rows_and_survivors(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [
        (5, base, "x"), (3, base, "y"), (9, base.replace("w399", "zz"), "x"), (7, None, "x"), (8, "", "x"), (None, " ", "x"),
        (3, base, "y"), (None, "alone here now today", None), (12, "some other text of words", "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in S.simhash_components(df).collect())
    items = [(k, brute_fingerprint(t or "")) for k, t, _ in rows]
    want = sorted((str(k), f"{v:016x}", c) for (k, v), c in zip(items, brute_components(items)))
    assert got == want
    kept = S.one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["12", "3", "7", "None"]
    assert S.simhash_components(df.limit(0)).count() == 0 and S.one_of_each_group(df.limit(0)).count() == 0
