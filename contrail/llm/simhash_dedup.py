"""SimHash near-duplicates through one-wildcard segment variants.

A 64-bit fingerprint is cut into two segments, so of two fingerprints with at most three different bits one segment
differs in at most one bit. Each segment is indexed under its 32 variants with one bit wiped out; equal variants are the
candidates, and whole fingerprints are compared before a link counts.

Equal fingerprints are one class before anything is paired. A variant that two classes share is one comparison; a variant
that more share is cut into blocks, and each pair of blocks is compared in one task that gives back only a spanning star
for each local component, so a group of near copies never becomes a list of pairs. Variants with the same members (equal
count, ends and combined hash) are compared once.

Defined cases: null or empty texts and texts of white space have fingerprint zero and are linked with one another; texts of
one or two words have one shingle; repeated rows share their class; a null doc_id never becomes a component's id unless
all its ids are null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.components import connected_components
from contrail.llm.shared import (
    TEXT_ROWS,
    VECTOR_ROWS,
    arrow_rows,
    broadcast_if_small,
    local_components,
    map_texts,
    marks,
    runs,
    without,
    written,
)

MAX_BITS = 3
SEGMENT = 32
SHINGLE = 3
SEED = 42
BLOCK = 256
PIECE = 1 << 20
BROADCAST_ROWS = 500_000


def words_in_pieces(text: str, shingle: int = SHINGLE) -> Iterator[list[bytes]]:
    """Words of a text in blocks of about a megabyte, each block led by the last words before it, one less than a shingle has."""
    raw = text.encode().lower()
    if len(raw) <= PIECE:
        yield raw.split()
        return
    tail: list[bytes] = []
    begin = 0
    while begin < len(raw):
        end = min(len(raw), begin + PIECE)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = raw[begin:end].split()
        if words:
            yield tail + words
            tail = (tail + words)[-(shingle - 1) :]
        begin = end


def fingerprint(text: str) -> int:
    """Signed 64-bit fingerprint: a bit is set when over half of the shingle hashes have it."""
    ones, n, short = np.zeros(64, dtype=np.int64), 0, []
    for words in words_in_pieces(text):
        short = words
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(words, words[1:], words[2:], strict=False)),
            dtype=">u8",
        )
        if len(hashes):
            n += len(hashes)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    if not n:
        if not short:
            return 0
        value = np.array([xxhash.xxh64_intdigest(b" ".join(short), SEED)], dtype=np.uint64)
        return int(value.view(np.int64)[0])
    return int(np.packbits(ones * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Columns `keep` with the fingerprint of each text."""
    arrow_rows(df.sparkSession, TEXT_ROWS)
    return map_texts(
        df,
        keep,
        text,
        [T.StructField(name, T.LongType(), False)],
        lambda texts: [pa.array([fingerprint(t or "") for t in texts], pa.int64())],
    )


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _variants(value: Column) -> Column:
    """The 64 packed keys (segment, wildcard, remaining bits) of a fingerprint."""
    keys = []
    for s in range(64 // SEGMENT):
        part = F.shiftrightunsigned(value, SEGMENT * s).bitwiseAND(F.lit((1 << SEGMENT) - 1))
        for bit in range(SEGMENT):
            wiped = part.bitwiseAND(F.lit(((1 << SEGMENT) - 1) ^ (1 << bit)))
            keys.append(wiped.bitwiseOR(F.lit((s * SEGMENT + bit) << SEGMENT)))
    return F.explode(F.array(*keys))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that span the local components of each pair of blocks."""
    for run in runs(batches, ("key", "low", "high")):
        values = np.unique(run.column("value").to_numpy())
        near = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= MAX_BITS
        first = values[local_components(near)]
        moved = first != values
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(first[moved])], names=["u", "v"])


def links(values: DataFrame) -> DataFrame:
    """Links (u, v) that connect all values (column `value`, distinct longs) at most three bits apart."""
    arrow_rows(values.sparkSession, VECTOR_ROWS)
    keyed = values.select("value", _variants(F.col("value")).alias("key"))
    shared = written(
        keyed.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.bit_xor(F.xxhash64("value")).alias("mark"),
        )
        .where("members > 1")
        .groupBy("members", "low", "high", "mark")
        .agg(F.min("key").alias("key")),
        "variants",
    )
    pairs = shared.where(
        (F.col("members") == 2) & (F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= MAX_BITS)
    ).select(F.col("low").alias("u"), F.col("high").alias("v"))
    crowded = shared.where("members > 2").select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    members = keyed.join(broadcast_if_small(crowded, crowded.count(), BROADCAST_ROWS), "key")
    own = F.pmod(F.xxhash64("value", F.lit(7)), F.col("blocks")).cast("int")
    celled = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "value")
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
    )
    return pairs.unionAll(celled.mapInArrow(_stars, "u long, v long"))


def components(rows: DataFrame, value: str = "fingerprint", key: str = "doc_id") -> DataFrame:
    """One row per distinct fingerprint: value, group (an id of its component), component_id (its smallest key)."""
    classes = written(
        rows.groupBy(F.col(value).alias("value")).agg(F.min(key).alias("least_key")), "classes"
    )
    found = connected_components(links(classes.select("value")))
    grouped = written(
        classes.join(found, classes.value == found.node, "left").select(
            "value", F.coalesce("component", "value").alias("group"), "least_key"
        ),
        "groups",
    )
    least = grouped.groupBy("group").agg(F.min("least_key").alias("component_id"))
    return grouped.join(least, "group").select("value", "group", "component_id")


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits), component_id."""
    rows = written(fingerprints(df, [key], text, "value"), "fingerprints")
    joined = rows.join(components(rows, "value", key), "value")
    return joined.select(F.col(key), as_hex(F.col("value")).alias("fingerprint"), "component_id")


def one_of_each_group(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df`, one of each group of near copies: the smallest key, null keys last, of repeated rows any one.

    Rows go by marks of key and text; only survivors that are repeated are grouped with their texts.
    """
    values = [df[key], F.coalesce(df[text].cast("string"), F.lit(""))]
    named = df.select(df[key].alias("own_key"), *marks(*values), values[1].alias("own_text"))
    narrow = written(fingerprints(named, ["own_key", "mark", "mark2"], "own_text", "value"), "fingerprints")
    order = F.struct(F.isnull("own_key").alias("last"), "own_key", "mark", "mark2")
    firsts = narrow.groupBy("value").agg(F.min(order).alias("first"))
    classes = firsts.join(components(narrow, "value", "own_key"), "value").select("value", "group", "first")
    return only_firsts(df, narrow, classes, key, text)


def only_firsts(df: DataFrame, narrow: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of `df` that are the first of their group.

    `narrow` has own_key, the marks of key and text, and the value of each row; `classes` has value, group and first, the
    order of the first row with that value.
    """
    values = [df[key], F.coalesce(df[text].cast("string"), F.lit(""))]
    order = F.struct(F.isnull("own_key").alias("last"), "own_key", "mark", "mark2")
    classes = written(classes, "classes")
    stays = written(classes.groupBy("group").agg(F.min("first").alias("stays")), "stays")
    survivors = written(classes.join(stays, "group").select("value", "stays"), "survivors")
    judged = narrow.join(survivors, "value").select("mark", "mark2", (order != F.col("stays")).alias("goes"))
    gone = written(judged.where("goes").select("mark", "mark2").distinct(), "dropped")
    repeated = written(
        judged.where("NOT goes").groupBy("mark", "mark2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated"
    )
    kept = without(df, gone, values, BROADCAST_ROWS)
    again = repeated.count()
    if not again:
        return kept
    values = [kept[key], F.coalesce(kept[text].cast("string"), F.lit(""))]
    rows = kept.select(F.struct(*[kept[c] for c in kept.columns]).alias("own_row"), *marks(*values))
    some = rows.join(broadcast_if_small(repeated, again, BROADCAST_ROWS), ["mark", "mark2"], "left_semi")
    one = some.groupBy("mark", "mark2").agg(F.first("own_row").alias("own_row"))
    single = without(kept, repeated, values, BROADCAST_ROWS)
    return single.unionAll(one.select(*[F.col("own_row").getField(c).alias(c) for c in kept.columns]))
