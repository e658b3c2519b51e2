"""Inputs that only arise in large tables: keys beyond the range of packed numbers, crowded cells."""

from __future__ import annotations

from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contrail.operators import intervals
from contrail.operators.intervals import interval_exposure


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_row_keys_of_large_orders(spark, tmp_path):
    """Orders from 4,194,304 on: no overflow, and ties within a flight go to the smaller line."""
    folder = str(tmp_path)
    day = datetime(1998, 2, 6)
    orders = (100, 4_194_303, 4_194_304, 9_000_000)
    write(spark, folder, "customer", [(1, 2)], "c_custkey bigint, c_nationkey bigint")
    write(spark, folder, "orders", [(o, 1, day) for o in orders], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp")
    lines = [(o, 20 + 61 * 101 * k, 59_000, line, float(q), "A", 0.1, 0.1, day) for o in orders for k, line, q in ((5, 2, 9), (5, 1, 7), (190, 1, 3))]
    write(
        spark, folder, "lineitem", lines,
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_returnflag string, l_discount double, l_tax double, l_shipdate timestamp",
    )
    found = entry.queries()["horizon_pick"](spark, folder).collect()
    assert {int(r["flight_id"][-12:]): r["booked_passengers"] for r in found} == dict.fromkeys(orders, 21)


def exposure(points, events):
    return interval_exposure(
        points, events, point_id="id", point_ts="at", sides={"a": "a", "b": "b"}, event_key="key", start="s", end="e",
        measures={"n": ("count", F.lit(1)), "most": ("max", F.col("v")), "least": ("min", F.col("v")), "total": ("sum", F.col("v"))},
        side_measures={"a_n": ("a", "n")},
    )


@pytest.mark.parametrize("chunk", [1_000_000, 20])
def test_interval_pieces_and_crowded_cells(spark, monkeypatch, chunk):
    """Lengths from nothing to years, ends that meet points exactly; with and without cells too crowded to sort."""
    monkeypatch.setattr(intervals, "CHUNK_ROWS", chunk)
    draw = Random(7)
    zero = datetime(2020, 1, 1)
    tick = lambda: zero + timedelta(minutes=15 * draw.randrange(400))
    spans = [timedelta(0), timedelta(microseconds=1), timedelta(seconds=7), timedelta(minutes=60), timedelta(minutes=225), timedelta(days=3), timedelta(days=900), timedelta(minutes=-5)]
    events = [(draw.choice("XYZ"), s := tick(), s + draw.choice(spans), draw.randrange(50)) for _ in range(300)]
    events += [(None, zero, zero + timedelta(days=1), 5), ("X", None, zero, 5)]
    points = [(i, tick() + timedelta(microseconds=draw.choice((0, 0, 1, -1))), draw.choice("XYZ"), draw.choice("XYZ")) for i in range(200)]
    got = exposure(
        spark.createDataFrame(points, "id int, at timestamp, a string, b string"),
        spark.createDataFrame(events, "key string, s timestamp, e timestamp, v int"),
    ).collect()
    expected = {}
    for i, at, a, b in points:
        hit = [(k, v) for k, s, e, v in events if k in (a, b) and s is not None and s <= at <= e]
        if hit:
            v = [x for _, x in hit]
            expected[i] = (len(hit), max(v), min(v), sum(v), sum(k == a for k, _ in hit))
    assert {r["id"]: (r["n"], r["most"], r["least"], r["total"], r["a_n"]) for r in got} == expected


def test_anomaly_score_reads_its_input_twice(spark):
    """Once for the medians and once for the scores, not again for every pass of the medians."""
    from contrail.operators.telemetry import robust_anomaly_score

    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).selectExpr("cast(id AS double) AS a", "cast(id % 7 AS double) AS b").mapInArrow(seen, "a double, b double")
    scored = robust_anomaly_score(rows, ("a", "b"), "score").collect()
    assert reads.value == 2000
    # a: median 499.5, deviation 250; b: median 3, deviation 2
    expected = {(r["a"], r["b"]): (min(1.0, abs(r["a"] - 499.5) / 250 / 6) + min(1.0, abs(r["b"] - 3) / 2 / 6)) / 2 for r in scored}
    assert all(abs(r["score"] - expected[r["a"], r["b"]]) < 1e-6 for r in scored)


def shuffled_rows(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_interval_rows_are_shuffled_before_they_are_cut(spark):
    """Events and points of some cell sizes: each is shuffled about once for its day, not once for every cell and direction."""
    zero, n = datetime(2020, 1, 1), 2000
    spans = (timedelta(minutes=2), timedelta(minutes=9), timedelta(minutes=40), timedelta(minutes=225), timedelta(minutes=360))
    events = [("X", zero + timedelta(minutes=i), zero + timedelta(minutes=i) + spans[i % 5], i) for i in range(n)]
    points = [(i, zero + timedelta(minutes=i), "X", "X") for i in range(n)]
    points, events = spark.createDataFrame(points, "id int, at timestamp, a string, b string"), spark.createDataFrame(events, "key string, s timestamp, e timestamp, v int")
    before = shuffled_rows(spark)
    assert exposure(points, events).count() == n
    assert shuffled_rows(spark) - before < 5 * n


def test_delay_features_join_flights_with_outcomes_once(spark):
    from contrail.operators.model_features import delay_features
    from contrail.plans.airline_views import Tables

    t, reads = Tables(spark, "/root/testdata/sf0.001"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    flights = t.flight_schedule.mapInArrow(seen, t.flight_schedule.schema)
    rows = delay_features(flights, t.delay_history, t.crew_operations, t.weather_events, t.airport_events, t.aircraft_health)
    assert rows.count() and reads.value == t.flight_schedule.count()


def test_interval_rows_are_not_sorted_by_cell_and_direction(spark):
    """Points take their measures from the pieces of their bucket in one pass: no window over pieces, however many cell sizes."""
    zero = datetime(2020, 1, 1)
    points = spark.createDataFrame([(1, zero, "X", "Y")], "id int, at timestamp, a string, b string")
    events = spark.createDataFrame([("X", zero, zero + timedelta(hours=h), h) for h in (0, 1, 5)], "key string, s timestamp, e timestamp, v int")
    assert "Window" not in exposure(points, events)._jdf.queryExecution().toString()


@pytest.mark.parametrize("rows, groups", [(200_000, 8192), (7, 2)])
def test_covering_equals_brute_force(monkeypatch, rows, groups):
    """Batches and slices that cut groups anywhere; nulls and NaN as Spark's aggregates take them."""
    import numpy as np
    import pyarrow as pa

    from contrail.operators import covering

    monkeypatch.setattr(covering, "ROWS", rows)
    monkeypatch.setattr(covering, "GROUPS", groups)
    draw, nan = Random(11), float("nan")
    data = []
    for g in range(12):  # key, bucket of size 100
        key, at = "XY"[g % 2], g // 2
        for i in range(draw.randrange(9)):
            data.append((g, key, at, at * 100 + draw.randrange(100), None, None, 100 * g + i))
        for _ in range(draw.randrange(9)):
            s = draw.randrange(100)
            data.append((g, key, at, at * 100 + s, draw.randint(1, 100 - s), draw.choice([None, nan, 1.0, 5.0, -2.0]), None))
    names = ["_group", "_key", "_bucket", "_s", "_len", "_m_v", "_point"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    table = pa.table([pa.array(list(c), t) for c, t in zip(zip(*data), types, strict=True)], names=names)
    table = table.append_column("_m_w", table.column("_m_v")).append_column("_m_n", pa.array([1] * len(data), pa.int32()))
    run = covering.active({"v": "max", "w": "min", "n": "count"}, ["_point"], [100], 1)
    got = {r["_point"]: (r["_m_v"], r["_m_w"], r["_m_n"]) for b in run(iter(table.to_batches(max_chunksize=5))) for r in b.to_pylist()}
    expected = {}
    for g, _, _, t, length, _, point in data:
        hit = [d[5] for d in data if d[0] == g and d[4] is not None and d[3] <= t < d[3] + d[4]]
        if length is None and hit:
            known = [v for v in hit if v is not None]
            plain = [v for v in known if v == v]
            most = None if not known else nan if len(plain) < len(known) else max(known)
            least = None if not known else min(plain) if plain else nan
            expected[point] = (most, least, len(hit))
    assert got.keys() == expected.keys() and len(got) > 10
    for point, values in expected.items():
        np.testing.assert_equal([*got[point]], [*values])


def test_marks_are_those_of_the_findings(spark):
    """The narrow findings that metrics and quarantine read, table by table."""
    from contrail.operators.findings import MARKS
    from contrail.plans import validation_queries as VQ
    from contrail.plans.airline_views import Tables

    t = Tables.of(spark, "/root/testdata/sf0.001")
    count = lambda df: {tuple(r) for r in df.groupBy(*MARKS).count().collect()}
    marks = VQ.stored_marks(t)
    assert marks.columns == list(MARKS)
    assert count(marks) == count(VQ.all_findings(t))
    assert count(VQ.stored_marks(t, "delay_history")) == count(VQ.delay_findings(t))


def test_flight_core_is_joined_once(spark):
    """Views begin with a stored table, and a finished job leaves no shuffle files."""
    from contrail.plans.airline_views import Tables

    t = Tables.of(spark, "/root/testdata/sf0.001")
    plan = t.flight_schedule._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
