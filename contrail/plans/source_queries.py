"""Named queries over scans, sinks and acceptance of source tables: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.operators import quality as Q
from contrail.operators.findings import union_all
from contrail.plans.airline_views import BASE_TABLES, Tables
from contrail.plans.registry import query
from contrail.plans.validation_queries import stored_marks, typed_tables
from contrail.session import new_folder
from contrail.sources import contracts as C
from contrail.sources import readers as S
from contrail.sources import writers as W

CSV_TABLES = tuple(name for name, c in C.CONTRACTS.items() if c.file_format == "csv")
JSON_TABLES = tuple(name for name, c in C.CONTRACTS.items() if c.file_format != "csv")


def _scanned_sql(names: tuple[str, ...], extra: str) -> str:
    """Rows and the ends of the key of each table, as the scan has to find them."""
    return "\nUNION ALL ".join(
        f"SELECT '{n}' AS dataset, count(*) AS row_count, count(*) AS {extra}, min({k}) AS first_key, max({k}) AS last_key FROM {n}"
        for n in names
        for k in (C.CONTRACTS[n].primary_key[0],)
    )


def declared(t: Tables, name: str) -> DataFrame:
    """The contract's columns that the table has."""
    table = typed_tables(t)[name]
    return table.select(*[c for c in C.CONTRACTS[name].field_names if c in table.columns])


@query("scan_csv", _scanned_sql(CSV_TABLES, "numbered_rows"))
def scan_csv(t: Tables) -> DataFrame:
    """Each comma-separated table written out and scanned back as text."""
    parts = []
    for name in CSV_TABLES:
        contract, path = C.CONTRACTS[name], new_folder(t.spark, f"{name}.csv")
        W.write_rows(declared(t, name), path, "csv")
        key = F.col(contract.primary_key[0])
        parts.append(
            S.scan_csv(t.spark, path, contract).agg(
                F.lit(name).alias("dataset"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_distinct("row_number").alias("numbered_rows"),
                F.min(key).alias("first_key"),
                F.max(key).alias("last_key"),
            )
        )
    return union_all(parts)


@query("scan_jsonl", _scanned_sql(JSON_TABLES, "object_rows"))
def scan_jsonl(t: Tables) -> DataFrame:
    """Each JSON-lines table written out and scanned back."""
    parts = []
    for name in JSON_TABLES:
        contract, path = C.CONTRACTS[name], new_folder(t.spark, f"{name}.jsonl")
        W.write_jsonl(declared(t, name), path)
        rows = S.jsonl_columns(S.scan_jsonl(t.spark, path), contract, "is_object")
        key = F.col(contract.primary_key[0])
        found = rows.agg(
            F.count(F.lit(1)).alias("row_count"), F.count(F.when(F.col("is_object"), 1)).alias("object_rows"),
            F.min(key).alias("first_key"), F.max(key).alias("last_key"),
        )
        parts.append(found.select(F.lit(name).alias("dataset"), "row_count", "object_rows", "first_key", "last_key"))
    return union_all(parts)


@query(
    "row_number_assign",
    """SELECT l_returnflag AS flag, count(*) AS row_count, cast(sum(n) AS bigint) AS number_sum, min(n) AS first_number, max(n) AS last_number, cast(sum(n % 1009 * l_orderkey) AS bigint) AS number_by_key
       FROM (SELECT *, row_number() OVER () AS n FROM lineitem) GROUP BY l_returnflag""",
)
def row_number_assign(t: Tables) -> DataFrame:
    """Places of the rows in the table's files."""
    n = F.col("row_number")
    return S.with_row_number(t.base("lineitem")).groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(n).alias("number_sum"), F.min(n).alias("first_number"), F.max(n).alias("last_number"),
        F.sum(n % 1009 * F.col("l_orderkey")).alias("number_by_key"),
    )


@query(
    "write_processed",
    """SELECT 'flight_id|flight_number|operating_date|scheduled_departure_utc|scheduled_arrival_utc|origin_airport|destination_airport|route_id|aircraft_id|aircraft_type|seat_capacity|scheduled_block_minutes|departure_terminal|arrival_terminal|service_type|schedule_status' AS columns,
              count(*) AS row_count, cast(sum(seat_capacity) AS bigint) AS seats FROM flight_schedule WHERE flight_n NOT IN (SELECT row_number FROM bad_rows WHERE dataset = 'flight_schedule')""",
)
def write_processed(t: Tables) -> DataFrame:
    """The valid flights written in the contract's column order and read back."""
    valid, _ = Q.split_valid_quarantined(typed_tables(t)["flight_schedule"], stored_marks(t, "flight_schedule"), "flight_schedule")
    path = new_folder(t.spark, "processed")
    W.write_processed(valid, path, C.FLIGHT_SCHEDULE)
    back = t.spark.read.parquet(path)
    return back.agg(
        F.lit("|".join(back.columns)).alias("columns"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum("seat_capacity").alias("seats"),
    )


@query(
    "write_rows",
    """SELECT o_orderstatus AS status, 'o_custkey|o_orderdate|o_orderkey|o_orderpriority|o_orderstatus|o_totalprice' AS columns, count(*) AS row_count, cast(sum(o_orderkey) AS bigint) AS order_keys, cast(sum(o_custkey) AS bigint) AS customer_keys,
              round(sum(o_totalprice), 2) AS total_price, cast(cast(min(o_orderdate) AS date) AS varchar) AS first_day, cast(cast(max(o_orderdate) AS date) AS varchar) AS last_day, min(o_orderpriority) AS first_priority, max(o_orderpriority) AS last_priority FROM orders GROUP BY o_orderstatus""",
)
def write_rows(t: Tables) -> DataFrame:
    """All orders written with sorted columns and read back, every column summed up."""
    path = new_folder(t.spark, "rows")
    W.write_rows(t.base("orders"), path)
    back = t.spark.read.parquet(path)
    return back.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.lit("|".join(back.columns)).alias("columns"), F.count(F.lit(1)).alias("row_count"), F.sum("o_orderkey").alias("order_keys"),
        F.sum("o_custkey").alias("customer_keys"), F.round(F.sum("o_totalprice"), 2).alias("total_price"),
        F.min(F.to_date("o_orderdate")).cast("string").alias("first_day"), F.max(F.to_date("o_orderdate")).cast("string").alias("last_day"),
        F.min("o_orderpriority").alias("first_priority"), F.max("o_orderpriority").alias("last_priority"),
    )


@query("write_jsonl", "SELECT c_mktsegment AS segment, count(*) AS row_count, min(c_name) AS first_name FROM customer GROUP BY c_mktsegment")
def write_jsonl(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "lines")
    W.write_jsonl(t.base("customer"), path)
    fields = S.scan_jsonl(t.spark, path).select("fields.c_mktsegment", "fields.c_name")
    return fields.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("c_name").alias("first_name")
    )


# ---------------------------------------------------------------- acceptance against a declaration made beforehand


@query("content_fingerprint")
def content_fingerprint(t: Tables) -> DataFrame:
    """The fingerprint of every given table with plain columns."""
    return union_all(
        [
            S.content_fingerprint(t.base(name)).select(F.lit(name).alias("table_name"), "row_count", "hash_sum", "hash_xor")
            for name in BASE_TABLES
        ]
    )


@query(
    "verify_upstream_output",
    """SELECT 'delivered' AS delivery, count(*) AS row_count, true AS row_count_matches, true AS content_matches, '' AS missing_columns, true AS accepted FROM orders
       UNION ALL SELECT 'row_lost', count(*) - 1, false, false, '', false FROM orders
       UNION ALL SELECT 'row_doubled', count(*) + 1, false, false, '', false FROM orders
       UNION ALL SELECT 'value_changed', count(*), true, false, '', false FROM orders
       UNION ALL SELECT 'column_lost', count(*), true, false, 'o_totalprice', false FROM orders
       UNION ALL SELECT 'producer_failed', count(*), true, true, '', false FROM orders""",
)
def verify_upstream_output(t: Tables) -> DataFrame:
    """Deliveries of a table, most of them spoilt, against the fingerprint stored when it was produced."""
    orders = t.base("orders")
    declared = t.written_stage("declared_fingerprint", lambda t: S.content_fingerprint(t.base("orders")))
    last = orders.agg(F.max("o_orderkey")).scalar()
    is_last = F.col("o_orderkey") == last
    deliveries = {
        "delivered": orders,
        "row_lost": orders.where(~is_last),
        "row_doubled": orders.unionAll(orders.where(is_last)),
        "value_changed": orders.withColumn("o_totalprice", F.col("o_totalprice") + F.when(is_last, 0.01).otherwise(0.0)),
        "column_lost": orders.drop("o_totalprice"),
        "producer_failed": orders,
    }
    return union_all(
        [
            S.verify_table(
                df, declared, ["o_orderkey", "o_totalprice"], "failed" if name == "producer_failed" else "passed"
            ).withColumn("delivery", F.lit(name))
            for name, df in deliveries.items()
        ]
    )


@query(
    "verify_checksums",
    "\nUNION ALL ".join(
        f"SELECT '{n}.parquet' AS table_file, true AS present, {str(n != 'part').lower()} AS verified, count(*) AS row_count FROM {n}" for n in BASE_TABLES
    )
    + "\nUNION ALL SELECT 'absent.parquet', false, false, 0",
)
def verify_checksums(t: Tables) -> DataFrame:
    """Every file of the given tables against a manifest stored beforehand, with one wrong entry and one file that is not there."""
    actual = S.file_checksums(t.spark, t.folder).withColumn("table_file", F.split("file_name", "/")[0])

    def manifest(t: Tables) -> DataFrame:
        own = [f"{name}.parquet" for name in BASE_TABLES]
        seen = F.when(F.col("table_file") == "part.parquet", F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256"))
        listed = actual.where(F.col("table_file").isin(own)).select("file_name", seen.alias("expected_sha256"))
        return listed.unionAll(t.spark.createDataFrame([("absent.parquet", "0")], listed.schema))

    counts = union_all([t.base(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{n}.parquet").alias("table_file"), "n") for n in BASE_TABLES])
    checked = S.verify_checksums(actual, t.written_stage("manifest", manifest)).withColumn("table_file", F.split("file_name", "/")[0])
    by_table = checked.groupBy("table_file").agg(F.bool_and("present").alias("present"), F.bool_and("verified").alias("verified"))
    return by_table.join(counts, "table_file", "left").select("table_file", "present", "verified", F.coalesce("n", F.lit(0)).alias("row_count"))
