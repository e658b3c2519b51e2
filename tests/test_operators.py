"""Operators on small rows, against brute force or literal expectations."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from contrail.functions import columns as X
from contrail.operators import disruption as D
from contrail.operators import evidence as E
from contrail.operators import history as H
from contrail.operators import least_squares as LS
from contrail.operators import metrics as M
from contrail.operators import models as ML
from contrail.operators import monitoring as MON
from contrail.operators import normalize as N
from contrail.operators import picks as P
from contrail.operators import quality as Q
from contrail.operators import ranks as K
from contrail.operators import rules as R
from contrail.operators import running as RN
from contrail.operators import star as S
from contrail.operators import telemetry as T
from contrail.operators.findings import rule_findings
from contrail.operators.intervals import interval_exposure
from contrail.sources import contracts as C

T0 = dt.datetime(2024, 3, 1)


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- running aggregates


def skewed(spark, n=400):
    rng = random.Random(5)
    data = [
        (
            i,
            "hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}" if rng.random() < 0.95 else None,
            rng.randrange(60),
            rng.choice([None, 1.0, 2.5, 7.0]),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id int, key string, t int, v double")


@pytest.mark.parametrize("widths", [(), (10,), (20, 5)])
def test_prefix_aggregates_match_plain_window(spark, widths):
    df = skewed(spark)
    bins = [RN.span_bin("t", w) for w in widths]
    measures = {
        "total": ("sum", F.col("v")),
        "seen": ("count", F.col("v")),
        "top": ("max", F.col("v")),
        "low": ("min", F.col("v")),
        "newest": ("last", F.col("v")),
    }
    got = RN.prefix_aggregates(df, ["key"], [F.col("t"), F.col("id")], measures, bins)
    w = (
        Window.partitionBy(F.coalesce("key", F.lit("")))
        .orderBy("t", "id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    want = df.select(
        "id",
        F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("total"),
        F.coalesce(F.count("v").over(w), F.lit(0)).alias("seen"),
        F.max("v").over(w).alias("top"),
        F.min("v").over(w).alias("low"),
        F.last("v", ignorenulls=True).over(w).alias("newest"),
    )
    names = ["id", *measures]
    assert sorted(map(tuple, got.select(names).collect()), key=lambda r: r[0]) == sorted(
        map(tuple, want.select(names).collect()), key=lambda r: r[0]
    )


@pytest.mark.parametrize("depth", [1, 3, 7])
def test_lookback_matches_plain_window(spark, depth):
    df = skewed(spark).withColumn("key", F.coalesce("key", F.lit("")))
    out, chunk = RN.with_lookback(df, ["key"], ["t", "id"], ["v"], depth, [RN.span_bin("t", 7)])
    frame = Window.partitionBy(*chunk).orderBy("t", "id").rowsBetween(-depth, -1)
    got = RN.drop_ghosts(out.withColumn("s", F.sum("v").over(frame)).withColumn("f", F.first("t").over(frame)), chunk)
    plain = Window.partitionBy("key").orderBy("t", "id").rowsBetween(-depth, -1)
    want = df.withColumn("s", F.sum("v").over(plain)).withColumn("f", F.first("t").over(plain))
    assert sorted(map(tuple, got.select("id", "s", "f").collect()), key=str) == sorted(
        map(tuple, want.select("id", "s", "f").collect()), key=str
    )


def test_prior_rate_strict_uses_only_known_outcomes(spark):
    data = [
        ("a", "R", T0, T0 - dt.timedelta(hours=2), T0 + dt.timedelta(hours=9), 1, 30.0),
        ("b", "R", T0 + dt.timedelta(hours=4), T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=5), 0, 0.0),
        ("c", "R", T0 + dt.timedelta(hours=8), T0 + dt.timedelta(hours=6), T0 + dt.timedelta(hours=10), 1, 20.0),
    ]
    df = spark.createDataFrame(
        data,
        "flight_id string, route_id string, scheduled_departure_utc timestamp, prediction_cutoff_utc timestamp, "
        "actual_arrival_utc timestamp, target int, delay_minutes double",
    )
    loose = {r["flight_id"]: r["r_rate"] for r in rows(H.prior_rate(df, {"r": "route_id"}))}
    strict = {r["flight_id"]: r["r_rate"] for r in rows(H.prior_rate_strict(df, {"r": "route_id"}))}
    assert loose == {"a": 0.5, "b": 1.0, "c": 0.5}
    assert strict == {"a": 0.5, "b": 0.5, "c": 0.0}


# ---------------------------------------------------------------- intervals


def test_interval_exposure_matches_brute_force(spark):
    rng = random.Random(9)
    airports = ["HUB", "HUB", "B", "C"]

    def moment():
        return T0 + dt.timedelta(microseconds=rng.randrange(3 * 86_400_000_000))

    points = [(f"p{i}", rng.choice(airports), rng.choice(airports), moment()) for i in range(80)]
    events = []
    for i in range(150):
        start = rng.choice([moment(), T0 + dt.timedelta(minutes=rng.randrange(4000))])
        length = rng.choice([0, 1, 59_999_999, 3_600_000_000, 86_400_000_000 * 40, -5])
        events.append((rng.choice(airports), start, start + dt.timedelta(microseconds=length), rng.randrange(1, 6)))
    points += [(f"e{i}", e[0], "Z", e[1]) for i, e in enumerate(events[:20])]
    points += [(f"x{i}", "Z", e[0], e[2]) for i, e in enumerate(events[:20])]
    got = {
        r["id"]: (r["n"], r["worst"], r["at_a"], r["at_b"])
        for r in rows(
            interval_exposure(
                spark.createDataFrame(points, "id string, a string, b string, t timestamp"),
                spark.createDataFrame(events, "airport string, s timestamp, e timestamp, severity int"),
                point_id="id",
                point_ts="t",
                sides={"a": "a", "b": "b"},
                event_key="airport",
                start="s",
                end="e",
                measures={"n": ("count", F.lit(1)), "worst": ("max", F.col("severity"))},
                side_measures={"at_a": ("a", "n"), "at_b": ("b", "n")},
            )
        )
    }
    want = {}
    for pid, a, b, t in points:
        hit = [e for e in events if e[0] in {a, b} and e[1] <= t <= e[2]]
        if hit:
            want[pid] = (
                len(hit),
                max(e[3] for e in hit),
                sum(e[0] == a for e in hit),
                sum(e[0] == b for e in hit),
            )
    assert got == want


def test_interval_plan_has_no_pairwise_join(spark):
    from contrail.plans.airline_views import Tables
    from contrail.plans.registry import QUERIES
    from contrail.plans import load_all

    load_all()
    plan = QUERIES["interval_join"].plan(Tables.of(spark, "/root/testdata/sf0.001"))
    text = plan._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    from contrail.plans.airline_views import Tables

    t = Tables.of(spark, "/root/testdata/sf0.001")
    plan = t.base("lineitem").filter("l_partkey = 7").select("l_quantity")._jdf.queryExecution().toString()
    assert "EqualTo(l_partkey,7)" in plan and "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan


# ---------------------------------------------------------------- ranks


def test_exact_medians_and_nearest_rank(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1), 1e300, 5.0]) for _ in range(999)] + [-1e-9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = K.medians(K.unpivot_fields(df, {"x": F.col("x")})).first()["median"]
    assert got == statistics.median(values)
    widths = ML.residual_quantiles(df, F.col("x"), (0.8, 0.95, 0.0, 1.0))
    found = {r["level"]: r["width"] for r in rows(widths)}
    ordered = sorted(values)
    for level in (0.8, 0.95, 0.0, 1.0):
        assert found[str(int(level * 100))] == ordered[round(level * (len(ordered) - 1))]


def test_nearest_rank_on_four_values(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8)], "x double")
    assert rows(ML.residual_quantiles(df, F.col("x"), (0.8,))) == [{"level": "80", "width": 4.0}]


@pytest.mark.parametrize("limit", [20, 1_000_000])
def test_one_day_of_one_key_may_hold_most_rows(spark, monkeypatch, limit):
    """90 % of the rows on one day of one key: every operator over days equals the plain window, in pieces of at most `limit` rows."""
    monkeypatch.setattr(RN, "CHUNK_ROWS", limit)
    rng = random.Random(9)
    data = [("busy", 5, f"id{i:04d}", rng.randint(0, 9)) for i in range(360)]
    data += [(rng.choice(["busy", "calm"]), rng.randint(0, 9), f"id{i:04d}", rng.randint(0, 9)) for i in range(360, 400)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "key string, day int, id string, v int")
    order = [F.col("day"), F.col("id")]
    plain = Window.partitionBy("key").orderBy("day", "id").rowsBetween(Window.unboundedPreceding, -1)
    measures = {"s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "l": ("last", F.col("v")), "m": ("max", F.col("v"))}
    got = RN.prefix_aggregates(df, ["key"], order, measures, [F.col("day")])
    want = df.select("id", F.coalesce(F.sum("v").over(plain), F.lit(0)), F.count("v").over(plain), F.last("v").over(plain), F.max("v").over(plain))
    assert sorted(map(tuple, got.select("id", "s", "n", "l", "m").collect())) == sorted(map(tuple, want.collect()))
    back, chunk = RN.with_lookback(df, ["key"], ["day", "id"], ["v"], 3, [F.col("day")])
    mine = RN.drop_ghosts(back.withColumn("r", F.sum("v").over(Window.partitionBy(*chunk).orderBy("day", "id").rowsBetween(-3, -1))), chunk)
    short = Window.partitionBy("key").orderBy("day", "id").rowsBetween(-3, -1)
    assert sorted(map(tuple, mine.select("id", "r").collect()), key=str) == sorted(map(tuple, df.select("id", F.sum("v").over(short)).collect()), key=str)
    if limit == 20:
        assert back.groupBy(*chunk).count().agg(F.max("count")).first()[0] <= 20 + 3
    split = K.chronological_split(df, order, [F.col("day")], K.split_counts_simple(0.7, 0.15, 2))
    ranked = sorted(data, key=lambda r: (r[1], r[2]))
    want_parts = {r[2]: "train" if i < 280 else "validation" if i < 340 else "test" for i, r in enumerate(ranked)}
    assert {r.id: r.partition for r in split.collect()} == want_parts
    placed = RN.row_positions(df, ["day", "id"], "place")
    assert {r.id: r.place for r in placed.collect()} == {r[2]: i for i, r in enumerate(ranked)}


def test_most_scores_in_one_bin(spark, monkeypatch):
    """Scores crowded below 0.001 are spread over pieces and give the same areas."""
    rng = random.Random(2)
    pairs = [(f"i{i:04d}", rng.random() / 1000 if i % 10 else rng.random(), int(rng.random() < 0.3)) for i in range(1500)]
    df = spark.createDataFrame(pairs, "id string, probability double, target int")
    want = M.curve_areas(df).first()
    monkeypatch.setattr(RN, "CHUNK_ROWS", 100)
    got = M.curve_areas(df).first()
    assert got["roc_auc"] == pytest.approx(want["roc_auc"], abs=1e-12) and got["pr_auc"] == pytest.approx(want["pr_auc"], abs=1e-12)


@pytest.mark.parametrize("n", [3, 4, 10, 57])
def test_chronological_split_matches_sorted_list(spark, n):
    data = [(f"f{i:03d}", dt.date(2024, 1, 1) + dt.timedelta(days=(i * 7) % 5)) for i in range(n)]
    df = spark.createDataFrame(data, "flight_id string, day date")
    out = K.chronological_split(
        df, [F.col("day"), F.col("flight_id")], [RN.day_bin("day")], K.split_counts_simple(0.7, 0.15, 2)
    )
    got = {r["flight_id"]: r["partition"] for r in rows(out)}
    ordered = [f for f, _ in sorted(data, key=lambda r: (r[1], r[0]))]
    train, validation = max(2, int(n * 0.7)), max(1, int(n * 0.15))
    if train + validation >= n:
        train, validation = max(1, n - 2), 1
    want = {
        f: "train" if i < train else "validation" if i < train + validation else "test" for i, f in enumerate(ordered)
    }
    assert got == want


# ---------------------------------------------------------------- normalisation and rules


def test_bad_scalars_are_errors(spark):
    contract = C.DatasetContract(
        "s", "SM", "csv", ("a",), (C.instant("a"), C.flag("b"), C.whole("c", 0), C.number("d"), C.text("e", nullable=True))
    )
    data = [
        (1, "2024-01-01T00:00:00", "yes", "1.5", "NaN", "  "),
        (2, "2024-01-01T02:00:00+02:00", "TRUE", " 7 ", "1e3", None),
        (3, None, "", "-1", "inf", "x"),
    ]
    raw = spark.createDataFrame(data, "row_number int, a string, b string, c string, d string, e string")
    out = {r["row_number"]: r for r in rows(N.normalize(raw, contract))}
    assert [e["field_name"] for e in out[1]["_schema_errors"]] == ["a", "b", "c", "d"]
    assert out[2]["_schema_errors"] == [] and out[2]["a"] == dt.datetime(2024, 1, 1) and out[2]["c"] == 7
    assert [e["message"] for e in out[3]["_schema_errors"]] == [
        "a is required",
        "b is required",
        "c must be >= 0",
        "d cannot be parsed as number",
    ]


def schedule(spark, changes=()):
    base = []
    for i in range(24):
        dep = T0 + dt.timedelta(hours=3 * i)
        row = {
            "flight_id": f"FL-{i}",
            "row_number": i + 2,
            "operating_date": dep.date(),
            "scheduled_departure_utc": dep,
            "scheduled_arrival_utc": dep + dt.timedelta(minutes=90),
            "origin_airport": "LHR",
            "destination_airport": "AMS",
            "route_id": "LHR-AMS",
            "aircraft_id": "A1",
            "aircraft_type": "A320",
            "seat_capacity": 180,
            "scheduled_block_minutes": 90,
        }
        base.append(row)
    for index, change in changes:
        base[index].update(change)
    return spark.createDataFrame(
        [tuple(r.values()) for r in base],
        "flight_id string, row_number int, operating_date date, scheduled_departure_utc timestamp, "
        "scheduled_arrival_utc timestamp, origin_airport string, destination_airport string, route_id string, "
        "aircraft_id string, aircraft_type string, seat_capacity int, scheduled_block_minutes int",
    )


def schedule_findings(spark, changes):
    airports = spark.createDataFrame([("LHR",), ("AMS",)], "code string")
    routes = spark.createDataFrame([("LHR-AMS", "LHR", "AMS")], "route_id string, origin string, destination string")
    fleet = spark.createDataFrame([("A1", "A320", 180)], "aircraft_id string, aircraft_type string, seat_capacity int")
    flights = schedule(spark, changes)
    return flights, rule_findings(
        R.enrich_schedule(flights, airports, routes, fleet), "flight_schedule", R.schedule_rules()
    )


def test_unknown_origin_is_quarantined(spark):
    flights, findings = schedule_findings(spark, [(4, {"origin_airport": "ZZZ"})])
    assert {r["rule_id"] for r in rows(findings)} == {"FS-005", "FS-006", "REL-001"}
    valid, bad = Q.split_valid_quarantined(flights, findings, "flight_schedule")
    assert (valid.count(), bad.count()) == (23, 1)
    record = Q.quarantine_records(bad, findings, C.FLIGHT_SCHEDULE).first()
    assert record["failed_rule_ids"] == ["FS-005", "FS-006", "REL-001"] and record["primary_identifier"] == "FL-4"


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"destination_airport": "LHR"}, "FS-003"),
        ({"scheduled_arrival_utc": T0 - dt.timedelta(days=9)}, "FS-004"),
        ({"aircraft_type": "E190"}, "FS-007"),
        ({"seat_capacity": 5}, "FS-008"),
        ({"scheduled_block_minutes": 200}, "FS-009"),
        ({"aircraft_id": None}, "REL-003"),
        ({"route_id": "X"}, "REL-004"),
    ],
)
def test_schedule_rule_fires(spark, change, rule):
    _, findings = schedule_findings(spark, [(2, change)])
    assert rule in {r["rule_id"] for r in rows(findings)}


def test_overlap_uses_previous_known_arrival(spark):
    flights = schedule(spark, [(3, {"scheduled_arrival_utc": T0 + dt.timedelta(hours=13)}), (4, {"scheduled_arrival_utc": None})])
    found = {r["flight_id"] for r in rows(R.overlap_check(flights))}
    assert found == {"FL-4"}


def test_pk_duplicates_keep_the_first(spark):
    flights = schedule(spark, [(5, {"flight_id": "FL-1"}), (9, {"flight_id": "FL-1"}), (7, {"flight_id": ""})])
    found = sorted((r["row_number"], r["rule_id"]) for r in rows(R.pk_findings(flights, C.FLIGHT_SCHEDULE)))
    assert found == [(7, "FS-PK-DUP"), (9, "FS-PK-NULL"), (11, "FS-PK-DUP")]


def test_legacy_coverage_reports_nothing(spark):
    flights = schedule(spark)
    empty = flights.filter("false")
    tables = {"flight_schedule": flights, **{name: empty for name, _ in R.COVERAGE_RULES}}
    assert R.coverage_findings(tables).count() == 24 * 4
    assert R.coverage_findings(tables, legacy=True).count() == 0


# ---------------------------------------------------------------- metrics and models


def delay_rows(spark):
    data = [
        (f"f{i:02d}", "LHR-AMS" if i % 2 == 0 else "AMS-LHR", i % 2, float(20 + i), [0.2, 0.7, 0.4, 0.8][i % 4])
        for i in range(12)
    ]
    return spark.createDataFrame(
        data, "flight_id string, route_id string, target int, delay_minutes double, probability double"
    )


def test_perfect_ranking_has_full_areas(spark):
    out = M.evaluate_classifier(delay_rows(spark), 0.5).first()
    assert (out["tp"], out["fp"], out["tn"], out["fn"]) == (6, 0, 6, 0)
    assert out["roc_auc"] == pytest.approx(1.0) and out["pr_auc"] == pytest.approx(1.0)


def test_constant_predictor_and_tie_rules(spark):
    df = delay_rows(spark).withColumn("probability", F.lit(0.5))
    first = M.curve_areas(df).first()
    assert first["roc_auc"] == pytest.approx(0.5) and first["pr_auc"] == pytest.approx(1.0)
    assert M.curve_areas(df, pr_ties="grouped").first()["pr_auc"] == pytest.approx(0.5)


def test_positives_first_area_matches_row_walk(spark):
    rng = random.Random(1)
    pairs = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(500)]
    tp = area = 0
    for rank, (_, label) in enumerate(sorted(pairs, reverse=True), start=1):
        if label:
            tp += 1
            area += tp / rank
    df = spark.createDataFrame(pairs, "probability double, target int")
    assert M.curve_areas(df).first()["pr_auc"] == pytest.approx(area / tp, abs=1e-9)


def test_linear_model_equals_stepwise_gradient_descent(spark):
    data = [(float(i), "a" if i % 3 else "b", 10.0 + 2 * i) for i in range(12)]
    df = spark.createDataFrame(data, "x double, c string, target double")
    model = LS.fit_linear(df, ["x"], ["c"], epochs=50, rate=0.01)
    fitted = {r["feature"]: r["coefficient"] for r in model.coefficients.collect()}
    matrix = [[r[0], float(r[1] == "a"), float(r[1] == "b")] for r in data]
    n = len(data)
    scale = [max(1.0, math.sqrt(sum(r[j] ** 2 for r in matrix) / n)) for j in range(3)]
    bias, weights = sum(r[2] for r in data) / n, [0.0] * 3
    for _ in range(50):
        errors = [
            bias + sum(w * v / s for w, v, s in zip(weights, m, scale, strict=True)) - r[2]
            for m, r in zip(matrix, data, strict=True)
        ]
        bias -= 0.01 * sum(errors) / n
        weights = [
            w - 0.01 * sum(e * m[j] / scale[j] for e, m in zip(errors, matrix, strict=True)) / n
            for j, w in enumerate(weights)
        ]
    assert fitted[LS.INTERCEPT] == pytest.approx(bias, abs=1e-9)
    for j, name in enumerate(("x", "c=a", "c=b")):
        assert fitted[name] == pytest.approx(weights[j] / scale[j], abs=1e-9)
    unseen = spark.createDataFrame([(1.0, "zzz")], "x double, c string")
    assert LS.predict_linear(unseen, model).first()["raw_prediction"] == pytest.approx(fitted[LS.INTERCEPT] + fitted["x"])


def test_linear_model_with_very_many_levels(spark):
    """50,000 levels: with one row each, a level's weight follows from its own residual in every step."""
    n = 50_000
    df = spark.range(n).select(F.concat(F.lit("r"), "id").alias("c"), (F.col("id") % 7).cast("double").alias("target"))
    model = LS.fit_linear(df, [], ["c"], epochs=3, rate=0.5)
    assert model.coefficients.count() == n + 1
    bias, weight, mean = sum(i % 7 for i in range(n)) / n, 0.0, sum(i % 7 for i in range(n)) / n
    for _ in range(3):  # the level of row 3; the mean error stays zero up to the weights' own mean
        weight, bias = weight - 0.5 * (bias + weight - 3) / n, bias - 0.5 * (bias - mean)
    got = {r["feature"]: r["coefficient"] for r in model.coefficients.where("feature IN ('c=r3', '(intercept)')").collect()}
    assert got["c=r3"] == pytest.approx(weight, abs=1e-8) and got[LS.INTERCEPT] == pytest.approx(bias, abs=1e-4)
    assert LS.predict_linear(df, model).count() == n


@pytest.mark.parametrize("rate", [0.05, 0.4])
def test_descent_in_stretches_equals_single_steps(spark, rate):
    rng = random.Random(5)
    a = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    m = [[sum(r[i] * r[j] for r in a) / 6 for j in range(4)] for i in range(4)]
    pull, x = [1.0, -2.0, 0.5, 0.0], [0.0, 1.0, 0.0, 3.0]
    table = spark.createDataFrame([(str(i), str(j), m[i][j]) for i in range(4) for j in range(4)], "i string, j string, v double")
    vector = lambda v: spark.createDataFrame([(str(i), y) for i, y in enumerate(v)], "i string, x double")
    got = {r["i"]: r["x"] for r in LS.descended(table, vector(pull), vector(x), 37, rate).collect()}
    for _ in range(37):
        x = [x[i] - rate * (sum(m[i][j] * x[j] for j in range(4)) - pull[i]) for i in range(4)]
    assert [got[str(i)] for i in range(4)] == pytest.approx(x, abs=1e-10)


def test_unseen_route_falls_back_to_global_mean(spark):
    train = delay_rows(spark)
    other = spark.createDataFrame([("n", "NEW")], "flight_id string, route_id string")
    assert ML.model_historical_mean(other, train).first()["raw_prediction"] == pytest.approx(0.5)


def test_champion_needs_to_beat_the_baseline(spark):
    metrics = spark.createDataFrame(
        [("base", "baseline", 0.20, 0.0, 1.0), ("cand", "candidate", 0.199, 0.0, 1.0)],
        "model_id string, model_role string, wape double, bias double, mae double",
    )
    pick = M.select_champion(metrics, "wape", maximize=False, tie_breakers=M.forecast_tie_breakers()).first()
    assert pick["champion_model_id"] == "cand"
    held = M.select_champion(
        metrics, "wape", maximize=False, minimum_improvement=0.1, tie_breakers=M.forecast_tie_breakers()
    ).first()
    assert held["champion_model_id"] == "base" and held["fell_back_to_baseline"]


# ---------------------------------------------------------------- scores


def test_bands_take_the_first_match(spark):
    df = spark.createDataFrame([(0.3,), (0.31,), (0.8,), (2.0,)], "x double")
    got = [r[0] for r in df.select(X.band_case("x", D.RISK_BANDS)).collect()]
    assert got == ["low", "medium", "high", "severe"]


def test_array_rank_orders_by_value_then_name(spark):
    df = spark.range(1)
    values = {"b": F.lit(0.5), "a": F.lit(0.5), "c": F.lit(0.0), "d": F.lit(0.9)}
    got = df.select(X.array_rank(values, {k: k.upper() for k in values})).first()[0]
    assert got == ["D", "A", "B"]


def health(spark):
    names = (
        "telemetry_id aircraft_id aircraft_type flight_id event_timestamp_utc engine_1_vibration engine_2_vibration "
        "engine_1_temperature_c engine_2_temperature_c hydraulic_pressure_psi oil_pressure_psi brake_temperature_c "
        "cycles_since_maintenance flight_hours_since_maintenance fault_code maintenance_risk_score"
    ).split()
    data = []
    for i, (vibration, fault) in enumerate([(7.0, "F1"), (2.0, None), (2.0, None), (7.2, None)]):
        data.append(
            (f"T{i}", "A1", "A320", f"FL-{i}", T0 + dt.timedelta(hours=i), vibration, 2.0, 600.0, 610.0, 3000.0)
            + (60.0, 100.0, 90, 240.0, fault, 10.0 * i)
        )
    types = ["string"] * 4 + ["timestamp"] + ["double"] * 7 + ["int", "double", "string", "double"]
    return spark.createDataFrame(data, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def test_health_features_use_only_earlier_readings(spark):
    delays = spark.createDataFrame([("FL-0", 20), ("FL-1", 5)], "flight_id string, departure_delay_minutes int")
    out = {r["telemetry_id"]: r for r in rows(T.health_features(health(spark), delays))}
    assert out["T0"]["vibration_warning_flag"] and not out["T0"]["vibration_critical_flag"]
    assert out["T0"]["rolling_fault_code_count"] == 0.0 and out["T0"]["recent_aircraft_delay_rate"] == 0.0
    assert out["T1"]["rolling_fault_code_count"] == 1.0 and out["T1"]["recent_aircraft_delay_rate"] == 1.0
    assert out["T3"]["rolling_average_vibration"] == pytest.approx((7.0 + 2.0 + 2.0) / 3)
    assert out["T3"]["recent_aircraft_delay_rate"] == pytest.approx(1 / 3)
    assert out["T2"]["utilisation_intensity"] == pytest.approx((90 / 450 + 240 / 1200) / 2)


def test_scores_stay_within_bounds_and_alerts_are_limited(spark):
    delays = spark.createDataFrame([], "flight_id string, departure_delay_minutes int")
    settings = T.HealthSettings(alert_advisory=0.01, maximum_alerts_per_aircraft=2)
    scored = T.maintenance_risk(T.robust_anomaly_score(T.health_features(health(spark), delays, settings)), settings)
    found = rows(scored.select("maintenance_risk_score", "aircraft_health_score"))
    assert all(0 <= r["maintenance_risk_score"] <= 1 for r in found)
    alerts = rows(T.maintenance_alerts(scored, "run", settings))
    assert len(alerts) == 2 and all(a["alert_id"].startswith("MAINT-") and len(a["alert_id"]) == 18 for a in alerts)


def test_dominant_value_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("j", "c")], "key string, v string")
    got = {r["key"]: r["dominant_v"] for r in rows(P.dominant_value(df, ["key"], "v"))}
    assert got == {"k": "a", "j": "c"}


# ---------------------------------------------------------------- monitoring


def test_drift_with_and_without_baseline(spark):
    schema = "monitoring_domain string, metric_name string, metric_value double"
    now = spark.createDataFrame([("d", "a", 1.3), ("d", "z", 0.0), ("d", "y", 2.0), ("d", "n", 1.0)], schema)
    past = spark.createDataFrame([("d", "a", 1.0), ("d", "z", 0.0), ("d", "y", 0.0)], schema)
    got = {r["metric_name"]: (r["status"], r["relative_change"]) for r in rows(MON.drift_compare(now, past))}
    assert got["a"][0] == "warning" and got["z"] == ("passed", 0.0) and got["y"] == ("failed", 1.0)
    assert got["n"][0] == "skipped"
    assert [r["status"] for r in rows(MON.drift_compare(now, None))] == ["skipped"]


# ---------------------------------------------------------------- evidence


def test_retrieval_matches_brute_force(spark):
    rng = random.Random(2)
    domains = ["disruption_scoring", "delay_prediction", "monitoring", "validation"]
    items = []
    for i in range(200):
        hub = rng.random() < 0.5
        raw = {"flight_id": f"F{rng.randrange(12)}", "route_id": f"R{rng.randrange(4)}"}
        raw["origin_airport"] = "HUB" if hub else f"P{rng.randrange(3)}"
        items.append(
            (
                f"EVD-{i:03d}",
                rng.choice(domains),
                "t",
                rng.choice(["flight", "route"]),
                raw[rng.choice(["flight_id", "route_id"])],
                rng.choice([None, "2024-01-01", "2023-01-01"]),
                rng.choice([None, 0.4, 0.9, 55.0]),
                rng.choice([None, "high", "low", "Severe"]),
                raw,
            )
        )
    evidence = spark.createDataFrame(
        items,
        "evidence_id string, source_domain string, evidence_type string, entity_type string, entity_id string, "
        "timestamp_or_date string, metric_value double, severity string, raw_fields map<string,string>",
    ).withColumns({"summary_text": F.lit("s"), "source_record_id": F.lit("r"), "metric_name": F.lit("m")})
    intents = list(E.INTENT_PRIORITY)
    asked = [
        (
            f"q{i}",
            rng.choice(intents),
            rng.choice([None, f"F{rng.randrange(12)}"]),
            rng.choice([None, f"R{rng.randrange(4)}"]),
            None,
            rng.choice([None, "HUB"]),
        )
        for i in range(40)
    ]
    requests = spark.createDataFrame(
        asked,
        "request_id string, intent string, flight_id string, route_id string, aircraft_id string, airport_code string",
    )
    got: dict[str, list] = {}
    for r in rows(E.retrieve_evidence(requests, evidence, 6)):
        got.setdefault(r["request_id"], []).append((r["rank"], r["evidence_id"], round(r["score"], 6)))

    for rid, intent, *values in asked:
        supplied = {k: v for k, v in zip(E.FILTERS, values, strict=True) if v}
        ranked = []
        for eid, domain, _, etype, entity, ts, metric, severity, raw in items:
            score = 0.0
            for k, v in supplied.items():
                if v in (entity, raw.get(k), raw.get("origin_airport"), raw.get("destination_airport")):
                    score += 100
            if supplied and score < 100:
                continue
            priority = E.INTENT_PRIORITY[intent]
            if domain in priority:
                score += 30 - priority.index(domain)
            if E.ENTITY_BONUS.get(intent) == etype:
                score += 20
            score += 4 * E.SEVERITY_POINTS.get((severity or "").lower(), 0)
            if metric is not None:
                score += 10 * (metric if metric <= 1 else min(metric / 100, 1.0))
            if domain in priority or supplied:
                score += 1
            if score > 0:
                ranked.append((-score, ts or "", eid))
        want = [(i + 1, eid, round(-s, 6)) for i, (s, _, eid) in enumerate(sorted(ranked)[:6])]
        assert sorted(got.get(rid, [])) == want, rid


def test_long_lists_are_cut_to_what_can_rank(spark, monkeypatch):
    items = [
        (f"EVD-{i:04d}", ["delay_prediction", "validation"][i % 2], "t", "flight", f"F{i}", str(i % 7), (i * 37 % 1000) / 1000, "low", {"route_id": "R"})
        for i in range(1500)
    ]
    evidence = spark.createDataFrame(
        items,
        "evidence_id string, source_domain string, evidence_type string, entity_type string, entity_id string, "
        "timestamp_or_date string, metric_value double, severity string, raw_fields map<string,string>",
    ).withColumns({"summary_text": F.lit("s"), "source_record_id": F.lit("r"), "metric_name": F.lit("m")})
    asked = [(intent, intent, None, "R", None, None) for intent in E.INTENT_PRIORITY]
    requests = spark.createDataFrame(
        asked,
        "request_id string, intent string, flight_id string, route_id string, aircraft_id string, airport_code string",
    )
    lists = E.evidence_tokens(evidence, ["route_id"]).where("value = 'R'")
    lengths = lists.groupBy("filter", "value").agg(F.count(F.lit(1)).alias("_length"))
    assert E._contenders(lists, lengths, 6).count() < 50
    cut = rows(E.retrieve_evidence(requests, evidence, 6))
    monkeypatch.setattr(E, "LONG_LIST", 10_000)
    whole = rows(E.retrieve_evidence(requests, evidence, 6))
    key = lambda r: (r["request_id"], r["rank"])
    assert sorted(cut, key=key) == sorted(whole, key=key) and len(whole) == 6 * len(asked)


def test_guardrails_need_known_citations(spark):
    responses = spark.createDataFrame(
        [("a", "disruption_summary", 0), ("b", "poem", 0)], "response_id string, intent string, unsupported_claim_count int"
    )
    sections = spark.createDataFrame(
        [
            ("a", 1, "Finding 1", "Synthetic facts. Human review."),
            ("a", 2, "Limitations", "No live LLM or Azure AI Foundry service was called."),
            ("b", 1, "Finding 1", "Ground the aircraft!"),
        ],
        "response_id string, section_order int, heading string, content string",
    )
    citations = spark.createDataFrame(
        [("a", 1, "E1"), ("b", 1, "E9")], "response_id string, section_order int, evidence_id string"
    )
    known = spark.createDataFrame([("E1",)], "evidence_id string")
    failed = {
        (r["response_id"], r["guardrail_id"])
        for r in rows(E.guardrail_checks(responses, sections, citations, known))
        if r["status"] == "failed"
    }
    assert not {f for f in failed if f[0] == "a"}
    assert {("b", g) for g in ("GR-INTENT-001", "GR-GROUND-001", "GR-SAFETY-001", "GR-SYNTH-001")} <= failed


# ---------------------------------------------------------------- stored runs


def test_baseline_is_the_latest_earlier_run_on_other_input(spark, tmp_path):
    store = str(tmp_path / "runs")

    def metrics(value):
        return spark.createDataFrame([("d", "m", value), ("d", "zero", 0.0)], "monitoring_domain string, metric_name string, metric_value double")

    for run, made, identity, value in (("a", "2024-01-01", "x", 1.0), ("b", "2024-02-01", "y", 2.0), ("c", "2024-02-10", "now", 3.0), ("d", "2024-05-01", "x", 4.0)):
        MON.store_run(metrics(value), store, run, made, identity)
    MON.store_run(metrics(2.5), store, "b", "2024-02-01", "y")  # stored again
    found = MON.run_before(spark, store, "2024-03-01", "now")
    assert {(r.run_id, r.metric_value) for r in found.where("metric_name = 'm'").collect()} == {("b", 2.5)}
    assert MON.run_before(spark, store, "2024-03-01").where("run_id = 'c'").count() == 2
    assert MON.run_before(spark, store, "2023-01-01") is None
    drift = {r.metric_name: (r.relative_change, r.status) for r in MON.drift_compare(metrics(3.75), found).collect()}
    assert drift == {"m": (0.5, "failed"), "zero": (0.0, "passed")}
    assert MON.input_identity(spark.range(5)) == MON.input_identity(spark.range(5).repartition(3)) != MON.input_identity(spark.range(6))


# ---------------------------------------------------------------- star schema


def test_dictionary_profiles_every_column_and_names_its_role(spark):
    flights = spark.createDataFrame(
        [("f2", "A-B", 3.5, ""), ("f1", "A-B", None, "fog"), ("f3", "B-A", 1.0, None)],
        "flight_id string, route_id string, departure_delay_minutes double, primary_delay_cause string",
    )
    routes = spark.createDataFrame([("A-B", 7)], "route_id string, rank int")
    found = {
        (r.table_name, r.field_name): r
        for r in S.data_dictionary({"fact_flight_operations": flights, "dim_route": routes}, {"dim_route": "flights"}).collect()
    }
    assert len(found) == 6
    cause = found["fact_flight_operations", "primary_delay_cause"]
    assert (cause.data_type, cause.field_role, cause.example_value, cause.blank_count, cause.row_count) == ("string", "attribute", "fog", 2, 3)
    roles = {k[1]: r.field_role for k, r in found.items() if k[0] == "fact_flight_operations"}
    assert roles == {"flight_id": "key", "route_id": "reference", "departure_delay_minutes": "measure", "primary_delay_cause": "attribute"}
    assert found["dim_route", "rank"].field_role == "attribute" and found["dim_route", "route_id"].source == "flights"
    assert found["fact_flight_operations", "route_id"].approximate_distinct == 2


def test_published_rows_follow_the_registry(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("a", 3, "x")], "model_id string, v int, model_role string")
    metrics = spark.createDataFrame([("a", "baseline", 0.3), ("b", "candidate", 0.1)], "model_id string, model_role string, wape double")
    for margin, want in ((0.0, [2]), (0.9, [1, 3])):
        best = M.select_champion(metrics, "wape", maximize=False, minimum_improvement=margin)
        registry = M.model_registry(metrics, best).withColumn("threshold", F.lit(0.4))
        own = M.published_rows(rows, registry, ("threshold",))
        assert sorted(r.v for r in own.collect()) == want and {r.threshold for r in own.collect()} == {0.4}
        assert registry.count() == 2
