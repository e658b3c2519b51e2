from __future__ import annotations

import random

import public_tokenizers
import pytest

from contrail.llm.token_counts import SplicedTokenizer, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def small():
    return SplicedTokenizer(MODEL, chunk=64, overlap=8)


def test_spliced_equals_whole(small):
    rng = random.Random(5)
    parts = ["the", " ", "  ", "\n", "thention", "é", "ß", "漢字", "😀", ".", ",", "123", "aaaa", "\t", "▁", "<s>", "\x00", "é"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        assert small.count(text) == len(small.processor.encode(text)), repr(text)


@pytest.mark.parametrize("text", ["a" * 1000, "漢" * 500, " " * 500, "\n" * 500, "ab" * 40 + " x" + "the" * 200, "=" * 300 + "-" * 300])
def test_runs_without_boundaries_widen(small, text):
    assert small.count(text) == len(small.processor.encode(text))


def test_rows_nulls_and_extra_columns(spark):
    long = "the onhe thention, ered.\n" * 4000
    rows = [(1, None, 7), (2, "", 7), (3, "hello wörld", 7), (3, "hello wörld", 7), (None, "x", None), (5, long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts(df, MODEL).collect())
    p = SplicedTokenizer(MODEL).processor
    want = sorted((i or -1, len((t or "").encode()), len(p.encode(t or ""))) for i, t, _ in rows)
    assert got == want
    assert token_counts(df.limit(0), MODEL).count() == 0
