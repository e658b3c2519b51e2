from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pandas as pd
import pytest

from contrail.llm import filter_audit as A
from contrail.llm import queries as Q
from tests.compare import canonical, connect


def brute_failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        f for f, yes in zip("ABCD", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)),
        )) if yes
    )


def brute_audit(docs, labels):
    """{(part, order, step): counts} from rows (doc_id, text, lang)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = defaultdict(list)
    for d, t, lang in docs:
        failed = brute_failed(t or "") + ("E" if d is not None and d > least[t or ""] else "")
        rows[lang or ""].append((failed, d in good, d in toxic))
    found, shares = {}, Counter()
    for part, own in rows.items():
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                c = Counter()
                for failed, g, x in own:
                    gone, fails = bool(set(failed) & set(order[:s])), f in failed
                    c["kept"] += not gone and not fails
                    c["removed"] += fails and not gone
                    c["redundant"] += fails and gone
                    c["unique_fails"] += failed == f
                    c["good_lost"] += fails and not gone and g
                    c["toxic_lost"] += fails and not gone and x
                found[part, "".join(order), s + 1] = c
                shares[part, f] += c["removed"]
    for (part, order, step), c in found.items():
        c["shapley"] = shares[part, order[step - 1]]
    return found


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def as_dict(df):
    return {(r.part, r.filter_order, r.step): Counter({n: r[n] for n in NAMES}) for r in df.collect()}


def sample(rng, size):
    words = ["Alpha", "beta", "GAMMA", "delta", "x|y", "épée", "zeta\x0bb", "eta th"]
    texts = [None, "", " \t", *[" ".join(rng.choice(words[: rng.randint(2, 8)]) for _ in range(rng.choice([3, 150, 260]))) for _ in range(12)]]
    texts += [" ".join(f"w{i}" for i in range(n)) + end for n in (199, 200, 900) for end in ("", " &", " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRST")]
    return [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(size)]


@pytest.mark.parametrize("seed", [1, 2])
def test_retractions_equal_brute_force(spark, tmp_path, seed):
    """Files come with falling ids, so that later batches take earlier masks back."""
    rng = random.Random(seed)
    docs = sample(rng, 160)
    docs.sort(key=lambda r: -(r[0] or 0))
    docs += docs[:3]
    schema = "doc_id long, text string, lang string, mask string, n long"  # columns named like the operator's own
    path = str(tmp_path / "documents.parquet")
    for i in range(0, len(docs), 30):
        spark.createDataFrame([(*r, "m", 1) for r in docs[i : i + 30]], schema).coalesce(1).write.mode("append").parquet(path)
    labels = [(i % 40, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counts = A.signed_counts(spark, path, table, batches=6)
    assert counts.where("n < 0").count() == 0
    assert counts.agg({"n": "sum"}).first()[0] == len(docs)
    got = as_dict(A.interactions(counts))
    assert got == brute_audit(docs, labels)


def test_state_keeps_the_smallest_id_and_takes_masks_back():
    def rows(*items):
        return pd.DataFrame([(1, 2, d, part, 0, False, False, n) for d, part, n in items], columns=A._TEXT + A._KINDS + ["n"]).astype({"doc": "Int64"})

    state, counts = A.updated(None, rows((9, "en", 1), (9, "de", 2)))
    assert dict(zip(zip(counts["part"], counts["mask"]), counts["n"])) == {("en", 0): 1, ("de", 0): 2}
    state, counts = A.updated(state, rows((9, "en", 1), (12, "en", 1)))
    assert dict(zip(zip(counts["part"], counts["mask"]), counts["n"])) == {("en", 0): 1, ("en", 16): 1}
    state, counts = A.updated(state, rows((4, "fr", 1)))
    got = dict(zip(zip(counts["part"], counts["mask"]), counts["n"]))
    assert got == {("fr", 0): 1, ("en", 0): -2, ("en", 16): 2, ("de", 0): -2, ("de", 16): 2}
    assert state[["doc", "part", "n"]].values.tolist() == [[4, "fr", 1]]


def test_very_long_text_and_conditions():
    assert A.failed("word " * 3_000_000) == 2
    for text in ("", "A b c", "x" * 100, " ".join(map(str, range(250))), "a b#"):
        assert "".join(f for i, f in enumerate("ABCD") if A.failed(text) >> i & 1) == brute_failed(text)


def test_empty_table_and_settings(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(path)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(spark, path, labels).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    ours = Q.QUERIES["op13_filter_audit"](spark, folder).toPandas()
    theirs = connect(folder).execute(Q.ORACLES["op13_filter_audit"]).df()
    assert len(ours) and len(ours) % 600 == 0
    assert canonical(ours).equals(canonical(theirs))
    assert {c: str(t) for c, t in ours.dtypes.items()} == {c: str(t) for c, t in theirs.dtypes.items()}
