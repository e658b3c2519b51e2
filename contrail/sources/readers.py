"""Scans that keep every source row and where it came from, and table fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.session import materialize
from contrail.sources.contracts import DatasetContract

LEAVES = 1024


class SourceError(ValueError):
    """A source file that cannot be read at all."""


def scan_csv(spark: SparkSession, path: str, contract: DatasetContract, multi_line: bool = False) -> DataFrame:
    """Header CSV as text columns with the ``row_number`` of each record in its source; the header is row 1.

    Quoted line breaks need ``multi_line``; it reads each file whole in one task, so leave it off for splittable input.
    """
    names = csv_header(spark, path)
    if not names:
        raise SourceError(f"CSV source has no header: {path}")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("mode", "PERMISSIVE")
    rows = reader.option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").schema(schema).csv(path)
    return with_row_number(rows, start=2)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names on the first line; only that line is fetched."""
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0].value.strip():
        return []
    return spark.read.option("header", True).csv(path).columns


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines: the physical text, its keys and values as a map, and whether the line is a JSON object.

    Blank lines are skipped. Malformed lines stay as rows with ``is_object`` false, so they become findings.
    """
    lines = with_row_number(spark.read.text(path))
    fields = F.from_json("value", "map<string,string>")
    braced = F.ltrim("value", F.lit(" \t\r\n")).startswith("{")  # a valid document that opens with a brace is an object
    is_object = braced & F.try_parse_json("value").isNotNull()
    return lines.filter(F.trim("value") != "").select(
        "row_number", F.col("value").alias("line"), F.when(is_object, fields).alias("fields"), is_object.alias("is_object")
    )


def jsonl_columns(lines: DataFrame, contract: DatasetContract, *kept: str) -> DataFrame:
    """The contract's columns of scanned JSON lines as text, beside the row number and the scan's own columns in ``kept``."""
    return lines.select(
        "row_number", *kept, *[F.try_element_at("fields", F.lit(name)).alias(name) for name in contract.field_names]
    )


def with_row_number(scan: DataFrame, name: str = "row_number", start: int = 1) -> DataFrame:
    """Rows of a file scan with their place in the source, whatever the partitioning.

    A source of several files is numbered on from file to file in the order of their paths. Rows are counted for each block of
    a file that one task reads, a running sum over these blocks (a row each) gives every block its first number, and
    within a block numbers follow the reader. ``scan`` must be a reader's own frame: the file and block of a row are taken from it.
    """
    at = {"_file": "_metadata.file_path", "_block": "_metadata.file_block_start"}
    marked = scan.select("*", *[F.col(c).alias(k) for k, c in at.items()], F.monotonically_increasing_id().alias("_seen"))
    sizes = marked.groupBy(*at).agg(F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*at, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + start).alias("_shift"))
    numbered = marked.join(F.broadcast(materialize(first, "blocks")), [*at])  # one row for each block of about 128 MB
    return numbered.withColumn(name, F.col("_seen") + F.col("_shift")).select(*scan.columns, name)


def consecutive_row_number(
    df: DataFrame, order: Sequence[Column], bins: Sequence[Column], start: int = 1, name: str = "row_number"
) -> DataFrame:
    """Consecutive numbers in a total order, from chunk counts and a small offset table."""
    from contrail.operators.running import prefix_aggregates

    numbered = prefix_aggregates(df, [], order, {name: ("count", F.lit(1))}, bins)
    return numbered.withColumn(name, F.col(name) + start)


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive hash of a table: row count, sum and xor of row hashes, in one aggregate."""
    row_hash = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(row_hash.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor(row_hash), F.lit(0)).alias("hash_xor"),
    )


def verify_table(df: DataFrame, expected: DataFrame, required: Sequence[str], status: str = "passed") -> DataFrame:
    """One row telling whether a table may be used: fingerprint, row count, columns and producer status agree."""
    missing = sorted(set(required) - set(df.columns))
    declared = expected.agg(F.first(F.struct("row_count", "hash_sum", "hash_xor")))
    seen = content_fingerprint(df).withColumn("_want", declared.scalar())
    same_rows = F.col("row_count") == F.col("_want.row_count")
    same_content = (F.col("hash_sum") == F.col("_want.hash_sum")) & (F.col("hash_xor") == F.col("_want.hash_xor"))
    allowed = F.lit(status in ("passed", "passed_with_warnings") and not missing)
    return seen.select(
        "row_count",
        same_rows.alias("row_count_matches"),
        same_content.alias("content_matches"),
        F.lit(",".join(missing)).alias("missing_columns"),
        (allowed & same_rows & same_content).alias("accepted"),
    )


def file_checksums(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file_name, file_bytes, sha256) of every file below a folder, named by its path from there; files of any size.

    The digest is a tree: SHA-256 of each line of bytes, then of each LEAVES digests in order, until one is left for a file.
    Files are read in blocks, a line is the largest piece that one task holds, and the same bytes give the same digest
    however they are dealt out.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    scan = reader.text(folder)
    at = {"_file": "_metadata.file_path", "_bytes": "_metadata.file_size", "_block": "_metadata.file_block_start"}
    marked = scan.select(
        *[F.col(c).alias(k) for k, c in at.items()], F.monotonically_increasing_id().alias("_seen"),
        F.unhex(F.sha2(F.col("value").cast("binary"), 256)).alias("digest"),
    )
    sizes = marked.groupBy("_file", "_block").agg(F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(sizes.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), "blocks")
    level = marked.join(F.broadcast(first), ["_file", "_block"]).select("_file", "_bytes", (F.col("_seen") + F.col("_shift")).alias("place"), "digest")
    most = sizes.groupBy("_file").agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] or 1
    while True:
        parent = F.floor(F.col("place") / LEAVES).alias("place")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
        folded = F.unhex(F.sha2(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x)), 256))
        level = level.groupBy("_file", "_bytes", parent).agg(folded.alias("digest"))
        most = -(-most // LEAVES)
        if most <= 1:
            break
    base = urlsplit(folder).path.rstrip("/") + "/"
    decoded = F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B")))
    relative = F.substr(decoded, F.instr(decoded, base) + len(base))
    # A file of one line has one fold; the size tells a last line with a break from one without.
    return level.select(
        relative.alias("file_name"), F.col("_bytes").alias("file_bytes"),
        F.sha2(F.concat(F.col("_bytes").cast("string").cast("binary"), F.col("digest")), 256).alias("sha256"),
    )


def verify_checksums(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """Declared files with whether they exist and hash to the declared value."""
    return manifest.join(actual, "file_name", "left").select(
        "file_name",
        F.col("sha256").isNotNull().alias("present"),
        F.coalesce(F.col("sha256") == F.col("expected_sha256"), F.lit(False)).alias("verified"),
    )
