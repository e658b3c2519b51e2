"""Named queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm import (
    decontaminate,
    embedding_dedup,
    filter_audit,
    hard_negatives,
    language_id,
    license_scan,
    mixing,
    pii,
    quality_crf,
    simhash_dedup,
    token_counts,
    toxicity,
    warc,
)
from contrail.llm.shared import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    chain = quality_crf.fit(documents, read_table(spark, sf_dir, "labels"))
    return quality_crf.judged(quality_crf.quality_scores(documents, chain))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host prior: their source) and pages (declared language, address and host of the URL), each whole."""
    documents, pages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    model = language_id.fit(documents)
    of_documents = language_id.languages_of(documents, model, "doc_id", documents.text, documents.source)
    of_pages = language_id.languages_of(
        pages,
        model,
        "page_id",
        language_id.visible_text(pages.html),
        language_id.host_of(pages.url),
        language_id.declared_language(pages.html),
        language_id.address_language(pages.url, model.languages),
    )
    return of_documents.unionByName(of_pages, allowMissingColumns=True)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return counts.withColumn("over_limit", token_counts.over_limit(counts.n_tokens))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses_of(read_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    best = F.max("score").alias("score"), F.max_by("end_word", "score").alias("end_word")
    return found.groupBy("doc_id", "item_id").agg(*best)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(read_table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.vector_links(read_table(spark, sf_dir, "embeddings"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: vec_id divisible by 100. Every seventh label is shifted by one class before anything is scored."""
    vectors = read_table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(spark, f"{sf_dir}/documents.parquet", read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_license_scan": op4_license_scan,
    "op5_warc": op5_warc,
    "op6_decontaminate": op6_decontaminate,
    "op7_mixing": op7_mixing,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_personal_data": op9_personal_data,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}
# The SQL that expresses a query whole; the others are compared with brute force in the tests.
ORACLES: dict[str, str] = {
    "op5_warc": """
        WITH hashed AS (
            SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages
        ), grouped AS (
            SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM hashed
        ), coded AS (
            SELECT *, list_transform(range(8), lambda i: cast('0x' || substr(hex, 5 * i + 1, 5) AS bigint)) AS parts FROM grouped
        )
        SELECT page_id, cast(octet_length(body) AS bigint) AS payload_bytes,
               array_to_string(list_transform(parts, lambda p:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', p // 32768 + 1, 1)
                   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', p // 1024 % 32 + 1, 1)
                   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', p // 32 % 32 + 1, 1)
                   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', p % 32 + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM coded""",
    "op10_embedding_dedup": """
        WITH RECURSIVE sound AS (
            SELECT vec_id, cast(embedding AS double[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b
            ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), reached(u, v) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v
        ), least AS (SELECT u, min(v) AS component_id FROM reached GROUP BY u),
        counted AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
        SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN least ON least.u = e.vec_id LEFT JOIN counted ON counted.u = e.vec_id""",
    "op12_hard_negatives": """
        WITH sound AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT DISTINCT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                   cast(list_dot_product(a.v, b.v) AS bigint) AS score
            FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        ), positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id, cast(row_number() OVER best AS integer) AS rank, other_id AS negative_id,
               positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
        QUALIFY row_number() OVER best <= 10""",
    "op13_filter_audit": r"""
        WITH flags AS (
            SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
            FROM labels GROUP BY doc_id
        ), texts AS (
            SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM documents d LEFT JOIN flags USING (doc_id)
        ), counted AS (
            SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM texts
        ), judged AS (
            SELECT part, good, toxic, [
                len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
            FROM counted
        ), failing AS (
            SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f, i: fails[i]) AS failed, count(*) AS n
            FROM judged GROUP BY ALL
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), steps AS (
            SELECT filter_order, cast(s AS integer) AS step, substr(filter_order, s, 1) AS own,
                   string_split(substr(filter_order, 1, s - 1), '') AS earlier
            FROM orders, range(1, 6) r(s)
        ), applied AS (
            SELECT part, filter_order, step, own, n, good, toxic, failed, list_contains(failed, own) AS fails,
                   list_has_any(failed, earlier) AS gone
            FROM failing, steps
        ), totals AS (
            SELECT part, filter_order, step, own,
                   cast(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS bigint) AS kept,
                   cast(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS bigint) AS removed,
                   cast(coalesce(sum(n) FILTER (fails AND gone), 0) AS bigint) AS redundant,
                   cast(coalesce(sum(n) FILTER (fails AND len(failed) = 1), 0) AS bigint) AS unique_fails,
                   cast(coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS bigint) AS good_lost,
                   cast(coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS bigint) AS toxic_lost
            FROM applied GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               cast(sum(removed) OVER (PARTITION BY part, own) AS bigint) AS shapley
        FROM totals""",
}
