from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.llm import language_id as L

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_accuracy_on_documents_outside_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    small = L.fit(docs, train_rows=200)
    got = L.languages_of(docs, small, "doc_id", docs.text, docs.source).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert got.where("lang = truth AND accepted").count() >= 0.97 * docs.count()


def test_pages_agree_with_their_markup(spark, model):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = L.languages_of(
        pages, model, "page_id", L.visible_text(pages.html), L.host_of(pages.url), L.declared_language(pages.html),
        L.address_language(pages.url, model.languages),
    )
    assert got.count() == pages.count()
    both = got.join(pages.select("page_id", L.declared_language(F.col("html")).alias("declared")), "page_id")
    assert both.where("lang = declared").count() >= 0.9 * pages.count()


def test_evidence_columns(spark):
    rows = [
        ("https://Blog.x.de:80/a", '<HTML class="a" lang="FR">'), ("http://a.example.com/es/1?x", "<html>"),
        ("http://u@h.co.uk", None), ("nonsense", "lang=de"), (None, "<html lang='en-GB'>"),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    got = df.select(
        L.host_of(df.url).alias("h"), L.address_language(df.url, ("en", "es")).alias("a"), L.declared_language(df.html).alias("d")
    ).collect()
    assert [tuple(r) for r in got] == [
        ("blog.x.de", "de", "fr"), ("a.example.com", "es", None), ("h.co.uk", "en", None), ("", None, None), ("", None, "en"),
    ]
    page = "a<script>var b='</p>';</script><style>p{}</style><p class=x>c&amp;d</p><script>open"
    assert spark.range(1).select(L.visible_text(F.lit(page))).first()[0].split() == ["a", "c", "d"]
    assert len(spark.range(1).select(L.visible_text(F.lit("<script>" * 20000 + "<" * 20000))).first()[0]) > 0


def brute(logs, hosts, extra):
    """Posterior of each row by the formulas, one row at a time."""
    width = len(logs[0])
    seen = [[a + b for a, b in zip(x, e)] for x, e in zip(logs, extra)]

    def share(v):
        w = [math.exp(a - max(v)) for a in v]
        return [a / sum(w) for a in w]

    shares = [share(v) for v in seen]
    k = L.STRENGTH
    total = [sum(s[i] for s in shares) for i in range(width)]
    p_all = [(c + 1) / (len(logs) + width) for c in total]

    def level(members, above):
        n = len(members)
        return [(sum(shares[m][i] for m in members) + k * above[i]) / (n + k) for i in range(width)]

    domain = lambda h: ".".join(h.split(".")[-2:]) if "." in h else ""
    suffix = lambda h: h.split(".")[-1] if "." in h else ""
    out = []
    for r, h in enumerate(hosts):
        of = lambda f: [m for m, x in enumerate(hosts) if f(x) == f(h)]
        p = level(of(suffix), p_all) if suffix(h) else p_all
        p = level([m for m in of(domain)], p) if domain(h) else p
        own = of(lambda x: x)
        prior = [math.log((max(sum(shares[m][i] for m in own) - shares[r][i], 0) + k * p[i]) / (len(own) - 1 + k)) for i in range(width)]
        out.append(share([a + b for a, b in zip(seen[r], prior)]))
    return out


def test_fusion_equals_formulas(spark):
    model = L.LanguageModel(("de", "en"), np.zeros((1 << L.BITS, 3), dtype=np.float32))
    rng = np.random.default_rng(2)
    hosts = ["a.x.com", "a.x.com", "b.x.com", "c.y.com", "c.y.com", "c.y.com", "src", "src", ""]
    logs = rng.normal(size=(len(hosts), 3)).tolist()
    says = [None, "de", "en", "xx", None, "DE", "en", None, None]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(logs, hosts, says))], "id long, logs array<double>, host string, says string")
    got = {r.id: r.language_of for r in L.fused(rows, model, "logs", "host", "says", None).collect()}

    def extra(x):
        if x is None or x.lower() not in model.languages:
            return [0.0] * 3
        return [math.log(L.DECLARED if k == x.lower() else 1 - L.DECLARED) for k in model.languages] + [math.log(0.5)]

    for i, post in enumerate(brute(logs, hosts, [extra(x) for x in says])):
        best = max(range(3), key=lambda k: post[k])
        assert got[i].lang == ["de", "en", "und"][best]
        assert got[i].confidence == pytest.approx(post[best], abs=1e-9)


def test_stage_keeps_columns_and_rejects_what_is_no_language(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("host", F.lit("x")).withColumn("logs", F.lit(1))
    odd = [(9001, None, "en", "src0", 0), (9002, "", None, None, 0), (9003, "12345 %% 77", "en", "src0", 1), (None, "天地玄黃宇宙洪荒" * 9, None, "src1", 1)]
    more = spark.createDataFrame([(*r, "y", 2) for r in odd], docs.schema)
    kept = L.with_known_language(docs.unionAll(more))
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() and kept.where("doc_id > 9000 OR doc_id IS NULL").count() == 0
    assert L.with_known_language(docs.limit(0)).count() == 0
    assert L.with_known_language(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_each_language_has_its_own_sample_and_copies_count_once(spark):
    rng = np.random.default_rng(4)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    common = [(text("abcdefgh"), "en") for _ in range(600)]
    rare = [(text("αβγδεζηθ"), "EL") for _ in range(L.LEAST_ROWS)]
    few = [(text("бвгджзик"), "ru") for _ in range(L.LEAST_ROWS - 1)]
    make = lambda rows: L.fit(spark.createDataFrame(rows, "text string, lang string"), train_rows=50)
    once = make(common + rare + few)
    assert once.languages == ("el", "en")
    again = make(common + [common[0]] * 400 + rare + few)
    assert again.languages == once.languages and np.array_equal(again.table, once.table)
    hashed = spark.createDataFrame(common, "text string, lang string").select("text", F.xxhash64("text").alias("o")).orderBy("o").limit(50)
    first = make([(r.text, "en") for r in hashed.collect()] + rare)
    assert np.array_equal(first.table, once.table)
