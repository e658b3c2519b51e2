"""Language of a text by Bayesian fusion of four kinds of evidence.

Text: character-trigram likelihoods from a hashed model, fitted on a bounded sample of each language's labelled texts
(TRAIN_ROWS of every language, copies counted once, so no language leaves the model as the table grows); each character
lies in three trigrams, so log likelihoods count a third. A uniform background model stands for "no language".
Declared language and address (country suffix or a language folder) each multiply in a reliability. Host priors come from
grouped aggregation of the evidence so far over all rows, smoothed along host, domain, suffix and whole table; a row's own
share is taken out of its host first, so nothing counts twice.

Rows join the host table, whose hot keys the adaptive join splits; the table is broadcast only below a counted bound.

Defined cases: a null or empty text or one without letters is undetermined ("und") whatever else speaks for it; without any
labelled row every text is; unknown or null declarations, addresses and hosts are no evidence; repeated rows are judged one
by one and count one by one in their host; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.shared import TEXT_ROWS, arrow_rows, broadcast_if_small, map_texts, marks, without, written

BITS = 16
TRAIN_ROWS = 20_000
LEAST_ROWS = 5
SMOOTH = 0.05
STRENGTH = 10.0
DECLARED = 0.9
ADDRESS = 0.8
NO_LETTERS = 1e-9
UNDETERMINED = "und"
ACCEPT = 0.5
PIECE = 1 << 20
BROADCAST_ROWS = 200_000
# Country suffixes and the language most used under them.
SUFFIXES = {
    "at": "de", "ar": "es", "au": "en", "ch": "de", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr", "ie": "en",
    "it": "it", "mx": "es", "nl": "nl", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "uk": "en", "us": "en",
}


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order and log probabilities (buckets x languages, the background last)."""

    languages: tuple[str, ...]
    table: np.ndarray

    @property
    def names(self) -> list[str]:
        return [*self.languages, UNDETERMINED]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point of each letter, a space for all else."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), dtype=np.uint32, count=0x110000)


def trigram_buckets(text: str) -> np.ndarray:
    """Hash bucket of each character trigram that holds a letter."""
    found = []
    for begin in range(0, len(text), PIECE):
        piece = f" {text[begin : begin + PIECE].lower()} "
        codes = _letters()[np.frombuffer(piece.encode("utf-32-le", "replace"), dtype=np.uint32)]
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        letters = (a != 32) | (b != 32) | (c != 32)
        mixed = (a * np.uint32(2654435761)) ^ (b * np.uint32(2246822519)) ^ (c * np.uint32(3266489917))
        found.append((mixed[letters] * np.uint32(668265263)) >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint32)


def _sampled(labelled: DataFrame, train_rows: int) -> tuple[DataFrame, tuple[str, ...]]:
    """The first `train_rows` distinct texts of each language in the order of a hash, each once, and the languages.

    The hash is cut into 4,096 ranges, so only the range where a language reaches its number is put in order.
    """
    hashes = written(
        labelled.groupBy("lang", F.xxhash64("text").alias("o")).agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.shiftright("o", 52)),
        "text_hashes",
    )
    modelled = hashes.groupBy("lang").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST_ROWS) & (F.col("lang") != UNDETERMINED))
    earlier = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        hashes.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("c"))
        .withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
        .where((F.col("before") < train_rows) & (F.col("before") + F.col("c") >= train_rows))
    )
    place = F.row_number().over(Window.partitionBy("lang", "range").orderBy("o"))
    last = (
        hashes.join(F.broadcast(ranges.select("lang", "range", "before")), ["lang", "range"])  # a row for each language at most
        .withColumn("place", place + F.col("before"))
        .where(F.col("place") == train_rows)
        .select("lang", F.col("o").alias("last"))
    )
    limits = written(modelled.join(last, "lang", "left").select("lang", "last"), "limits")
    languages = tuple(sorted(r["lang"] for r in limits.select("lang").collect()))
    rows = labelled.withColumn("o", F.xxhash64("text")).join(F.broadcast(limits), "lang")  # as many rows as languages
    once = rows.where("last IS NULL OR o <= last").groupBy("lang", "o").agg(F.first("text").alias("text"))
    return once.select("text", "lang"), languages


def fit(df: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Trigram model of every language with LEAST_ROWS labelled rows, from at most `train_rows` distinct texts of each."""
    labelled = df.select(
        df[text].cast("string").alias("text"), F.lower(df[lang].cast("string")).alias("lang")
    ).where("text IS NOT NULL AND lang IS NOT NULL")
    sample, languages = _sampled(labelled, train_rows)
    if not languages:
        return LanguageModel((), np.zeros((1 << BITS, 1), dtype=np.float32))
    arrow_rows(df.sparkSession, TEXT_ROWS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for one in sorted(set(langs)):
                own = [trigram_buckets(t) for t, k in zip(texts, langs, strict=True) if k == one]
                buckets, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one] * len(n)), pa.array(buckets.astype(np.int32), pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"]
                )

    counted = (
        sample.mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
        .to_pydict()
    )
    keys, buckets, n = np.array(counted["lang"], dtype=object), np.array(counted["bucket"], dtype=np.int64), np.array(counted["n"])
    table = np.full((1 << BITS, len(languages) + 1), -BITS * np.log(2.0))
    for i, one in enumerate(languages):
        own = keys == one
        seen = np.full(1 << BITS, SMOOTH)
        seen[buckets[own]] += n[own]
        table[:, i] = np.log(seen / seen.sum())
    return LanguageModel(languages, (table / 3).astype(np.float32))


def with_text_evidence(df: DataFrame, model: LanguageModel, keep: Sequence[str], text: str, name: str) -> DataFrame:
    """Columns `keep` and log likelihoods of the text (array in the model's order)."""
    spark = df.sparkSession
    arrow_rows(spark, TEXT_ROWS)
    shared = spark.sparkContext.broadcast((model.table, len(model.names)))  # bounded: buckets x languages

    def compute(texts: list[str | None]) -> list[pa.Array]:
        table, width = shared.value
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            buckets = trigram_buckets(t or "")
            if len(buckets):
                out[i] = table[buckets].sum(axis=0, dtype=np.float64)
            else:
                out[i, :-1] = np.log(NO_LETTERS)
        offsets = pa.array(np.arange(0, out.size + 1, width), pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))]

    return map_texts(df, keep, text, [T.StructField(name, T.ArrayType(T.DoubleType()))], compute)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?i:[a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def address_language(url: Column, languages: Sequence[str]) -> Column:
    """Language of the country suffix, else of a folder named like one of the languages."""
    suffix = F.regexp_extract(host_of(url), r"\.([a-z]{2,})$", 1)
    by_suffix = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[suffix]
    folder = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]+://[^/]*/([A-Za-z]{2,3})(?:[/?#]|$)", 1))
    return F.coalesce(by_suffix, F.when(folder.isin(*languages), folder) if languages else F.lit(None).cast("string"))


def declared_language(html: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^<>]{0,500}?\blang\s{0,3}=\s{0,3}[\x22\x27]?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """Markup, scripts, styles and entities replaced by spaces."""
    scripts = r"(?i)<(?:script|style)\b[^<>]*+>(?:[^<]++|<(?!/(?:script|style)))*+"
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), scripts, " "), r"<[^<>]*+>|&#?[A-Za-z0-9]{1,10};", " ")


def _share(logs: str) -> str:
    """SQL: log weights as shares of one."""
    return f"""transform(transform({logs}, v -> exp(v - array_max({logs}))),
        (v, i) -> v / aggregate(transform({logs}, w -> exp(w - array_max({logs}))), 0D, (s, w) -> s + w))"""


def _evidence(model: LanguageModel, column: str, reliability: float) -> Column:
    """Log evidence of a stated language for each language; none when null or not a language of the model."""
    others = (1 - reliability) / max(1, len(model.languages) - 1)
    known = F.lower(F.col(column)).isin(*model.languages) if model.languages else F.lit(False)
    each = [
        F.log(F.when(F.lower(F.col(column)) == k, F.lit(reliability)).otherwise(F.lit(others))) for k in model.languages
    ]
    flat = F.lit(float(np.log(1 / max(1, len(model.languages)))))
    return F.when(F.coalesce(known, F.lit(False)), F.array(*each, flat)).otherwise(
        F.array(*[F.lit(0.0)] * len(model.names))
    )


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def host_priors(shares: DataFrame, width: int, strength: float = STRENGTH) -> DataFrame:
    """(host, n, counts, parent): counts of each host and the smoothed prior of what stands above it.

    `shares` has host and share (array). Levels above a host are its domain, its suffix and the whole table.
    """
    each = [F.sum(F.col("share")[i]).alias(f"c{i}") for i in range(width)]
    hosts = shares.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *each)
    hosts = written(
        hosts.select("host", "n", F.array(*[f"c{i}" for i in range(width)]).alias("counts"))
        .withColumn("domain", F.coalesce(F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")), F.lit("")))
        .withColumn("suffix", F.coalesce(F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit("")), F.lit(""))),
        "hosts",
    )

    def level(*keys: str) -> DataFrame:
        sums = [F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(width)]
        grouped = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), *sums)
        return grouped.select(*keys, "n", F.array(*[f"c{i}" for i in range(width)]).alias("counts"))

    def smoothed(counts: str, n: str, above: Column) -> Column:
        return F.zip_with(counts, above, lambda c, p: (c + strength * p) / (F.col(n) + strength))

    whole = level().first()  # one number for each language
    base = F.array(*[F.lit((c + 1.0) / (whole["n"] + width)) for c in whole["counts"]]) if whole["n"] else F.array().cast("array<double>")
    suffixes = level("suffix").select(
        "suffix", F.when(F.col("suffix") == "", base).otherwise(smoothed("counts", "n", base)).alias("p_suffix")
    )
    domains = level("domain", "suffix").join(suffixes, "suffix").select(
        "domain", "suffix", F.when(F.col("domain") == "", F.col("p_suffix")).otherwise(smoothed("counts", "n", F.col("p_suffix"))).alias("parent")
    )
    return hosts.join(domains, ["domain", "suffix"]).select("host", "n", "counts", "parent")


def fused(rows: DataFrame, model: LanguageModel, likelihood: str, host: str, declared: str | None, address: str | None) -> DataFrame:
    """Adds `language_of` (struct of lang, confidence, accepted) to rows that hold the text evidence.

    `rows` should be stored: they are read once for the host priors and once for the result.
    """
    width, columns = len(model.names), rows.columns
    seen = F.col(likelihood)
    for column, reliability in ((declared, DECLARED), (address, ADDRESS)):
        if column:
            seen = _added(seen, _evidence(model, column, reliability))
    judged = rows.select(
        F.struct(*[rows[c] for c in columns]).alias("own_row"), F.coalesce(rows[host].cast("string"), F.lit("")).alias("host"), seen.alias("logs")
    ).withColumn("share", F.expr(_share("logs")))
    priors = written(host_priors(judged.select("host", "share"), width), "priors")
    joined = judged.join(broadcast_if_small(priors, priors.count(), BROADCAST_ROWS), "host")
    prior = F.expr(
        f"""zip_with(zip_with(counts, share, (c, r) -> greatest(c - r, 0D)), parent,
            (c, p) -> ln((c + {STRENGTH}D * p) / (n - 1 + {STRENGTH}D)))"""
    )
    names = F.array(*[F.lit(x) for x in model.names])
    posterior = joined.withColumn("total", _added(F.col("logs"), prior)).withColumn("post", F.expr(_share("total")))
    best = F.array_max("post")
    lang = names[(F.array_position("post", best) - 1).cast("int")]
    return posterior.select(
        *[F.col("own_row").getField(c).alias(c) for c in columns],
        F.struct(
            lang.alias("lang"), best.alias("confidence"), ((lang != UNDETERMINED) & (best >= ACCEPT)).alias("accepted")
        ).alias("language_of"),
    )


def languages_of(
    df: DataFrame, model: LanguageModel, key: str, text: Column, host: Column, declared: Column | None = None, address: Column | None = None
) -> DataFrame:
    """One row per input row: key, lang, confidence, accepted, host."""
    none = F.lit(None).cast("string")
    narrow = df.select(
        df[key].alias("own_key"), text.alias("own_text"), host.alias("own_host"),
        (none if declared is None else declared).alias("declared"), (none if address is None else address).alias("address"),
    )
    rows = written(with_text_evidence(narrow, model, ["own_key", "own_host", "declared", "address"], "own_text", "logs_of_text"), "evidence")
    judged = fused(rows, model, "logs_of_text", "own_host", "declared", "address")
    return judged.select(F.col("own_key").alias(key), "language_of.*", F.col("own_host").alias("host"))


def with_known_language(df: DataFrame, text: str = "text", lang: str = "lang", host: str = "source") -> DataFrame:
    """The rows of `df` whose language is accepted; the model is fitted on their own labels, which are no evidence.

    A decision follows from text and host alone, so rejected rows are taken out by marks of both and no text is stored.
    """
    model = fit(df, text, lang)
    values = [F.coalesce(df[text].cast("string"), F.lit("")), F.coalesce(df[host].cast("string"), F.lit(""))]
    narrow = df.select(*marks(*values), values[1].alias("own_host"), values[0].alias("own_text"))
    evidence = with_text_evidence(narrow, model, ["mark", "mark2", "own_host"], "own_text", "logs_of_text")
    judged = fused(written(evidence, "evidence"), model, "logs_of_text", "own_host", None, None)
    gone = written(judged.where("NOT language_of.accepted").select("mark", "mark2").distinct(), "rejected")
    return without(df, gone, values, BROADCAST_ROWS)
