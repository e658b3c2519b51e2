"""How five quality filters interact, counted by incremental retraction over a stream of document files.

All files of a stored table run through a query of available-now micro-batches. Each text is measured against filters A to D
and named by a 128-bit hash. The state, kept by Spark's state store for buckets of text hashes, holds for each text the
smallest doc_id seen and what the rows with it are (part, labels). A row whose text has a smaller id fails E. When a later
file brings a smaller id, the mask counted for the earlier holder is retracted and counted anew with E. What leaves the
stream are signed counts by part, mask of failed filters and labels; their sum is all that the 120 orders need.

A bucket holds about TEXTS_A_BUCKET texts. Rows of one text are combined within each task before the shuffle: only the
smallest id and its kinds go on by key, the others are already known to fail E and travel as counts, so copies of one text
never gather in one task. The checkpoint and the sink are in the shared folder; a lost executor repeats its tasks from there.

Defined cases: a null text is the empty one and equal to it; a null part is the empty string; a null doc_id is smaller than no
other and none is smaller than it, so it never fails E; repeated rows with one doc_id are not smaller than each other; labels
of a doc_id given more than once count when one of them is 1; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from contrail.llm.shared import TEXT_ROWS, broadcast_if_small, work_path, written

LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"
DUPLICATE = 16
BATCHES = 4
TEXTS_A_BUCKET = 4096
COMBINED_ROWS = 1 << 16
BROADCAST_ROWS = 500_000
_CAPITALS = bytes(range(65, 91))
_STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's log takes megabytes at once
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(TEXT_ROWS),
}
_KINDS = ["part", "mask", "good", "toxic"]
_TEXT = ["k1", "k2", "doc"]


def failed(text: str) -> int:
    """Filters A to D that a text fails, as bits 1, 2, 4 and 8."""
    raw = text.encode()
    words = raw.split()
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MOST_CAPITALS_PERCENT * len(text)) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        names = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
        halves = [pa.array([int.from_bytes(n[i : i + 8], "little", signed=True) for n in names], pa.int64()) for i in (0, 8)]
        masks = pa.array([failed(t) for t in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], masks, *halves], names=["doc", "part", "mask", "k1", "k2"])


def _split_by_least(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series]:
    """Rows with a doc id, and which of them have a smaller id of the same text among them."""
    return rows, rows["doc"] > rows.groupby(["k1", "k2"])["doc"].transform("min")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one text in a task as one row for each kind at its smallest id, and plain counts for the rest."""

    def combine(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        unknown = rows["doc"].isna()
        known, later = _split_by_least(rows[~unknown])
        copies = known[later].assign(mask=lambda t: t["mask"] | DUPLICATE)
        settled = pd.concat([rows[unknown], copies]).groupby(_KINDS, as_index=False).size()
        settled = settled.assign(k1=range(len(settled)), k2=0, doc=pd.NA)
        open_ = known[~later].groupby(_TEXT + _KINDS, as_index=False).size()
        both = [t.rename(columns={"size": "n"})[[*_TEXT, *_KINDS, "n"]].astype({"doc": "Int64"}) for t in (open_, settled) if len(t)]
        return pa.RecordBatch.from_pandas(pd.concat(both), schema=_OPEN, preserve_index=False)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= COMBINED_ROWS:
            yield combine(held)
            held = []
    if sum(b.num_rows for b in held):
        yield combine(held)


_OPEN = pa.schema(
    [("k1", pa.int64()), ("k2", pa.int64()), ("doc", pa.int64()), ("part", pa.string()), ("mask", pa.int32()),
     ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64())]
)
_OPEN_SQL = "k1 long, k2 long, doc long, part string, mask int, good boolean, toxic boolean, n long"
_SIGNED_SQL = "part string, mask int, good boolean, toxic boolean, n long"


def _packed(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    rows.reset_index(drop=True).to_feather(out, compression="lz4")
    return out.getvalue()


def updated(held: pd.DataFrame | None, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(state, signed counts) after the rows `new` of one bucket came; a row without a doc id is a count that is settled."""
    known, settled = new[new["doc"].notna()], new[new["doc"].isna()]
    held = known.iloc[:0] if held is None else held
    rows, later = _split_by_least(pd.concat([held.assign(old=True), known.assign(old=False)], ignore_index=True))
    marked = rows["mask"] | DUPLICATE
    signed = [
        settled,
        rows[~rows["old"]].assign(mask=rows["mask"].where(~later, marked)),
        rows[rows["old"] & later].assign(n=-rows["n"]),
        rows[rows["old"] & later].assign(mask=marked),
    ]
    state = rows[~later].groupby(_TEXT + _KINDS, as_index=False)["n"].sum()
    counts = pd.concat([s[[*_KINDS, "n"]] for s in signed if len(s)]).groupby(_KINDS, as_index=False)["n"].sum()
    return state, counts[counts["n"] != 0]


def _retracting(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    new = pd.concat([f.astype({"doc": "Int64"}) for f in frames])
    held = pd.read_feather(io.BytesIO(state.get[0])) if state.exists else None
    kept, counts = updated(held, new[_TEXT + _KINDS + ["n"]])
    if len(kept):
        state.update((_packed(kept),))
    yield counts


def signed_counts(
    spark: SparkSession, path: str, labels: DataFrame,
    key: str = "doc_id", text: str = "text", part: str = "lang", batches: int = BATCHES,
) -> DataFrame:
    """(part, mask, good, toxic, n): documents of the Parquet table at `path` by the filters they fail; streamed file by file."""
    table = spark.read.parquet(path)
    names = table.inputFiles()
    if not names:
        return spark.createDataFrame([], _SIGNED_SQL)
    alone = len(names) == 1 and names[0].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]
    source = f"{path[:-1]}[{path[-1]}]" if alone else path  # a stream takes a single file only as a pattern
    buckets = max(1, -(-table.count() // TEXTS_A_BUCKET))
    flags = written(
        labels.select(labels[key].alias("doc"), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("toxic"))
        .where(F.col("doc").isNotNull())
        .groupBy("doc")
        .agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")]),
        "flags",
    )
    flags = broadcast_if_small(flags.withColumn("salt", F.lit(0).cast("long")), flags.count(), BROADCAST_ROWS)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", -(-len(names) // batches)).parquet(source)
    narrow = stream.select(
        stream[key].cast("long").alias("doc"),
        F.coalesce(stream[part].cast("string"), F.lit("")).alias("part"),
        stream[text].cast("string").alias("text"),
    ).mapInArrow(_measured, "doc long, part string, mask int, k1 long, k2 long")
    # Rows without a doc id find no label; a salt spreads them over the join's tasks.
    salted = narrow.withColumn("salt", F.when(F.col("doc").isNull(), F.col("k1")).otherwise(F.lit(0)))
    joined = salted.join(flags, (salted.doc.eqNullSafe(flags.doc)) & (salted.salt == flags.salt), "left").select(
        salted.doc, "part", "mask", "k1", "k2",
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")],
    )
    counts = (
        joined.mapInArrow(_combined, _OPEN_SQL)
        .withColumn("bucket", F.pmod("k1", F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandasWithState(_retracting, _SIGNED_SQL, "entries binary", "append", "NoTimeout")
    )
    sink = work_path(spark, "signed")
    before = {k: spark.conf.get(k, None) for k in _STREAM_SETTINGS}
    try:
        for k, v in _STREAM_SETTINGS.items():
            spark.conf.set(k, v)
        running = (
            counts.writeStream.format("parquet")
            .outputMode("append")
            .option("path", sink)
            .option("checkpointLocation", work_path(spark, "progress"))
            .trigger(availableNow=True)
            .start()
        )
    finally:  # a started query has its own copy of the settings
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    running.awaitTermination()
    read = spark.read.schema(_SIGNED_SQL).parquet(sink)
    return read.groupBy(*_KINDS).agg(F.sum("n").alias("n")).where("n <> 0")


def _orders() -> list[str]:
    found = [""]
    for _ in FILTERS:
        found = [o + f for o in found for f in FILTERS if f not in o]
    return found


def interactions(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step, from documents counted by part, mask and labels."""
    order, step, mask = F.col("filter_order"), F.col("step"), F.col("mask")
    letter, earlier = F.substr(order, step, F.lit(1)), F.substr(order, F.lit(1), step - 1)

    def bits(letters: Column) -> Column:
        return sum((F.when(F.instr(letters, f) > 0, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))

    # Masks fold first: what is left is parts x 32 x 4 rows whatever the input.
    rows = (
        counts.groupBy(*_KINDS)
        .agg(F.sum("n").alias("n"))
        .withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in _orders()])))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    )
    own, before = bits(letter), bits(earlier)
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0

    def total(which: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long").alias(name)

    steps = rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, "kept"),
        total(fails & ~gone, "removed"),
        total(fails & gone, "redundant"),
        total(mask == own, "unique_fails"),
        total(fails & ~gone & F.col("good"), "good_lost"),
        total(fails & ~gone & F.col("toxic"), "toxic_lost"),
    )
    shares = steps.groupBy("part", letter.alias("letter")).agg(F.sum("removed").cast("long").alias("shapley"))
    lettered = steps.withColumn("letter", letter)
    return lettered.join(shares, ["part", "letter"]).drop("letter")


def filter_audit(
    spark: SparkSession, path: str, labels: DataFrame,
    key: str = "doc_id", text: str = "text", part: str = "lang", batches: int = BATCHES,
) -> DataFrame:
    """One row for each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(signed_counts(spark, path, labels, key, text, part, batches))
