from __future__ import annotations

import random

import numpy as np
import pytest

from contrail.llm import decontaminate as D


def brute_score(window, item):
    best = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    top = 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(window) + 1):
            same = D.MATCH if item[i - 1] == window[j - 1] else D.MISMATCH
            best[i][j] = max(0, best[i - 1][j - 1] + same, best[i - 1][j] + D.GAP, best[i][j - 1] + D.GAP)
            top = max(top, best[i][j])
    return top


def test_alignment_equals_the_recurrence():
    rng = random.Random(1)
    windows = [[rng.randrange(5) for _ in range(rng.randint(0, 30))] for _ in range(60)]
    items = [[rng.randrange(5) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    scores, ends = D.alignment_scores(windows, items)
    assert scores.tolist() == [brute_score(w, q) for w, q in zip(windows, items)]
    for w, q, s, e in zip(windows, items, scores, ends):
        assert brute_score(w[:e], q) == s
    assert D.alignment_scores([[]], [[1, 2]])[0].tolist() == [0]


def case():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randint(16, 50)))) for i in range(30)]
    items += [(100, "two words"), (101, None), (102, ""), (103, items[0][1])]
    docs, planted = [], set()
    for d in range(120):
        body = [word() for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            number, text = items[rng.randrange(30)]
            copy = text.split()
            kind = d % 4
            if kind == 1:  # one word in seven replaced
                copy = [word() if k % 7 == 3 else w for k, w in enumerate(copy)]
            if kind == 2:  # words left out and put in
                copy = [w for k, w in enumerate(copy) if k % 9 != 4]
                copy.insert(len(copy) // 2, word())
            if kind == 3:  # case and punctuation
                copy = [w.upper() + "," for w in copy]
            at = rng.randint(0, len(body))
            body[at:at] = copy
            planted.add((d, number))
        docs.append((d, " ".join(body)))
    return docs, items, planted


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 200])
def test_planted_copies_are_found_and_nothing_else(spark, block_words):
    docs, items, planted = case()
    docs += [(500, None), (501, ""), (502, "Here are two  WORDS."), (503, "a two b words"), (None, items[5][1])]
    docs += [(504, ("filler words here " * 9000) + items[6][1] + " tail" * 9000), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.matches(df, bench, block_words=block_words).collect()
    want = planted | {(502, 100), (None, 5), (504, 6)}
    want |= {(d, 103) for d, i in want if i == 0}
    assert {(r.doc_id, r.item_id) for r in got} == want
    vocabulary: dict = {}
    texts, benchmark = dict(docs), dict(items)
    for r in got:
        number = lambda t: [vocabulary.setdefault(w, len(vocabulary)) for w in D.words_of(t)]
        words, item = number(texts[r.doc_id]), number(benchmark[r.item_id])
        if len(words) < 400:
            assert r.score == pytest.approx(brute_score(words, item) / (D.MATCH * len(item)))
        assert brute_score(words[max(0, r.end_word - 2 * len(item)) : r.end_word], item) / (D.MATCH * len(item)) >= D.LEAST_SCORE
    kept = D.clean_rows(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in {w for w, _ in want})


def test_common_passage_keeps_its_seeds(spark, monkeypatch):
    monkeypatch.setattr(D, "RARE", 2)
    docs, items, _ = case()
    rows = [(i, f"lead {i} " + items[3][1] + f" tail {i}") for i in range(60)] + [(100 + i, t) for i, t in docs[1:20:3]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items[:10], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.matches(df, bench).collect()} == {(i, 3) for i in range(60)}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "some words in a text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some words in a text")], "item_id long, text string")
    assert D.matches(df, bench.limit(0)).count() == 0
    assert D.matches(df.limit(0), bench).count() == 0
    assert D.clean_rows(df, bench.limit(0)).count() == 1
    assert [tuple(r)[:3] for r in D.matches(df, bench).collect()] == [(1, 1, 1.0)]


def test_gram_keys_depend_on_size_and_order():
    keys = {int(D.grams(np.array(w), len(w))[1][0]) for w in ([1, 2], [2, 1], [1, 2, 0], [0, 1, 2], [1, 2, 0, 0])}
    assert len(keys) == 5
