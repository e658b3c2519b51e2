"""Named queries over model rows, splits, baselines, models, metrics and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions import columns as X
from contrail.functions.columns import round6
from contrail.operators import least_squares as LS
from contrail.operators import metrics as M
from contrail.operators import model_features as MF
from contrail.operators import models as ML
from contrail.operators import picks as P
from contrail.operators import ranks as K
from contrail.operators import running as RN
from contrail.operators.history import prior_rate_strict
from contrail.plans.airline_views import Tables
from contrail.plans.registry import query, sql_part
from contrail.session import materialize

SPLIT = K.split_counts_simple(0.7, 0.15, 2)
DELAY_SPLIT = K.split_counts_guarded(0.7, 0.15, 6, 2, 2)


def r6(name: str, column=None):
    return round6(name if column is None else column).alias(name)


# ---------------------------------------------------------------- demand rows

sql_part(
    "horizon_rows",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY days_before_departure, observation_date, row_key) AS rn FROM passenger_demand WHERE days_before_departure >= 14) WHERE rn = 1""",
)
sql_part(
    "demand_rows",
    """SELECT h.*, f.operating_date, cast(h.expected_final_passengers AS double) AS target,
              count(*) OVER w AS hist_n, avg(h.expected_final_passengers) OVER w AS hist_mean, avg(h.expected_final_passengers / h.seat_capacity) OVER w AS hist_load
       FROM horizon_rows h JOIN flight_schedule f ON f.flight_id = h.flight_id
       WINDOW w AS (PARTITION BY h.route_id ORDER BY f.operating_date, h.flight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
sql_part(
    "demand_split",
    """SELECT *, CASE WHEN pos <= tr THEN 'train' WHEN pos <= tr + va THEN 'validation' ELSE 'test' END AS part FROM (
         SELECT *, row_number() OVER (ORDER BY operating_date, flight_id) AS pos, cast(floor(count(*) OVER () * 0.7e0) AS bigint) AS tr, cast(floor(count(*) OVER () * 0.15e0) AS bigint) AS va FROM demand_rows)""",
)


def demand_rows(t: Tables) -> DataFrame:
    return t.stage(
        "demand_rows",
        lambda t: MF.demand_features(t.flight_schedule, t.passenger_demand, tie_breakers=("row_key",)),
    )


def split_demand(t: Tables) -> DataFrame:
    return t.written_stage(
        "demand_split",
        lambda t: K.chronological_split(
            demand_rows(t),
            [F.col("operating_date"), F.col("flight_id")],
            [RN.day_bin("operating_date")],
            SPLIT,
        ),
    )


@query(
    "horizon_pick",
    "SELECT flight_id, days_before_departure, cast(observation_date AS varchar) AS observation_date, booked_passengers FROM horizon_rows",
)
def horizon_pick(t: Tables) -> DataFrame:
    picked = P.horizon_pick(
        t.passenger_demand,
        14,
        ["days_before_departure", "observation_date", "booked_passengers"],
        tie_breakers=("row_key",),
    )
    return picked.withColumn("observation_date", F.col("observation_date").cast("string"))


@query(
    "prior_mean",
    "SELECT flight_id, route_id, hist_n AS historical_route_observations, round(1e-10 + coalesce(hist_mean, -1), 6) AS historical_route_mean, round(1e-10 + coalesce(hist_load, -1), 6) AS historical_route_load_factor FROM demand_rows",
)
def prior_mean(t: Tables) -> DataFrame:
    return demand_rows(t).select(
        "flight_id",
        "route_id",
        "historical_route_observations",
        r6("historical_route_mean", F.coalesce("historical_route_mean", F.lit(-1.0))),
        r6("historical_route_load_factor", F.coalesce("historical_route_load_factor", F.lit(-1.0))),
    )


@query(
    "demand_features",
    """SELECT flight_id, concat(flight_id, ':', cast(observation_date AS varchar)) AS observation_id, target, booked_passengers, seat_capacity, demand_segment, round(1e-10 + fare_discount, 6) AS fare_discount, round(1e-10 + fare_standard, 6) AS fare_standard,
              cast(isodow(operating_date) - 1 AS int) AS day_of_week, cast(month(operating_date) AS int) AS month, cast(CASE WHEN isodow(operating_date) >= 6 THEN 1 ELSE 0 END AS int) AS weekend_flag FROM demand_rows""",
)
def demand_features(t: Tables) -> DataFrame:
    return demand_rows(t).select(
        "flight_id",
        "observation_id",
        "target",
        "booked_passengers",
        "seat_capacity",
        "demand_segment",
        r6("fare_discount"),
        r6("fare_standard"),
        "day_of_week",
        "month",
        "weekend_flag",
    )


@query("filter_include_exclude", "SELECT flight_id, route_id FROM flight_schedule WHERE route_id IN ('A01-A02', 'A03-A05', 'A07-A11') AND route_id <> 'A03-A05'")
def filter_include_exclude(t: Tables) -> DataFrame:
    kept = P.filter_include_exclude(t.flight_schedule, "route_id", ["A01-A02", "A03-A05", "A07-A11"], ["A03-A05"])
    return kept.select("flight_id", "route_id")


@query("filter_min_group_size", "SELECT flight_id, route_id FROM flight_schedule WHERE route_id IN (SELECT route_id FROM flight_schedule GROUP BY route_id HAVING count(*) >= 25)")
def filter_min_group_size(t: Tables) -> DataFrame:
    return P.filter_min_group_size(t.flight_schedule.select("flight_id", "route_id"), "route_id", 25)


@query("chronological_split", "SELECT flight_id, part AS partition FROM demand_split")
def chronological_split(t: Tables) -> DataFrame:
    split = K.chronological_split(
        demand_rows(t), [F.col("operating_date"), F.col("flight_id")], [RN.day_bin("operating_date")], SPLIT
    )
    return split.select("flight_id", "partition")


@query(
    "split_boundaries",
    "SELECT part AS partition, count(*) AS row_count, cast(min(operating_date) AS varchar) AS first_value, cast(max(operating_date) AS varchar) AS last_value FROM demand_split GROUP BY part",
)
def split_boundaries(t: Tables) -> DataFrame:
    found = K.split_boundaries(split_demand(t), "operating_date")
    return found.select(
        "partition",
        "row_count",
        F.col("first_value").cast("string").alias("first_value"),
        F.col("last_value").cast("string").alias("last_value"),
    )


@query("partition_leak_check", "SELECT route_id, count(DISTINCT part) AS partition_count FROM demand_split GROUP BY route_id HAVING count(DISTINCT part) > 1")
def partition_leak_check(t: Tables) -> DataFrame:
    return P.partition_leak_check(split_demand(t), "route_id")


# ---------------------------------------------------------------- demand models

sql_part("train_rows", "SELECT * FROM demand_split WHERE part = 'train'")
sql_part(
    "route_means",
    "SELECT route_id, avg(target) AS route_mean, avg(target / greatest(1, booked_passengers)) AS conversion FROM train_rows GROUP BY route_id",
)
sql_part(
    "naive_rows",
    """SELECT d.*, coalesce(m.route_mean, (SELECT avg(target) FROM train_rows)) AS mean_raw,
              d.booked_passengers * coalesce(m.conversion, (SELECT avg(target / greatest(1, booked_passengers)) FROM train_rows)) AS naive_raw
       FROM demand_split d LEFT JOIN route_means m ON m.route_id = d.route_id""",
)
sql_part(
    "forecast_rows",
    """SELECT *, least(greatest(0.0e0, naive_raw), seat_capacity * 1.08e0) AS bounded, round_even(least(greatest(0.0e0, naive_raw), seat_capacity * 1.08e0), 0) AS forecast,
              abs(least(greatest(0.0e0, naive_raw), seat_capacity * 1.08e0) - naive_raw) > 0.0001 AS changed
       FROM naive_rows""",
)


def train_part(t: Tables) -> DataFrame:
    return split_demand(t).filter("partition = 'train'")


def naive_forecast(t: Tables) -> DataFrame:
    return t.stage(
        "naive_forecast", lambda t: ML.capacity_clamp(ML.model_seasonal_naive(split_demand(t), train_part(t)))
    )


def mean_forecast(t: Tables) -> DataFrame:
    return ML.capacity_clamp(ML.model_historical_mean(split_demand(t), train_part(t)))


def linear_forecast(t: Tables) -> DataFrame:
    train = train_part(t).na.fill(0.0, ["historical_route_mean", "historical_route_load_factor"])
    model = LS.fit_linear(train, MF.DEMAND_NUMERIC, MF.DEMAND_CATEGORICAL)
    rows = split_demand(t).na.fill(0.0, ["historical_route_mean", "historical_route_load_factor"])
    return ML.capacity_clamp(LS.predict_linear(rows, model))


@query("route_mean", "SELECT route_id, round(1e-10 + route_mean, 6) AS route_mean FROM route_means")
def route_mean(t: Tables) -> DataFrame:
    return ML.key_means(train_part(t), "route_id", F.col("target"), "route_mean").select("route_id", r6("route_mean"))


@query("route_conversion", "SELECT route_id, round(1e-10 + conversion, 6) AS conversion FROM route_means")
def route_conversion(t: Tables) -> DataFrame:
    value = F.col("target") / F.greatest(F.lit(1), F.col("booked_passengers"))
    return ML.key_means(train_part(t), "route_id", value, "conversion").select("route_id", r6("conversion"))


@query("model_historical_mean", "SELECT flight_id, round(1e-10 + mean_raw, 6) AS raw_prediction FROM naive_rows")
def model_historical_mean(t: Tables) -> DataFrame:
    return ML.model_historical_mean(split_demand(t), train_part(t)).select("flight_id", r6("raw_prediction"))


@query("model_seasonal_naive", "SELECT flight_id, round(1e-10 + naive_raw, 6) AS raw_prediction FROM naive_rows")
def model_seasonal_naive(t: Tables) -> DataFrame:
    return ML.model_seasonal_naive(split_demand(t), train_part(t)).select("flight_id", r6("raw_prediction"))


@query("model_linear")
def model_linear(t: Tables) -> DataFrame:
    return linear_forecast(t).select("flight_id", "partition", r6("raw_prediction"), "forecast_passengers")


@query(
    "one_hot_schema",
    """SELECT cast(row_number() OVER (ORDER BY kind, feature, level) - 1 AS int) AS position, CASE WHEN kind = 0 THEN feature ELSE concat(feature, '=', level) END AS feature_name FROM (
         SELECT 0 AS kind, feature, '' AS level FROM (VALUES ('booked_passengers'), ('booking_velocity'), ('cancellations_to_date'), ('day_of_week'), ('days_before_departure'), ('fare_discount'), ('fare_flex'), ('fare_standard'), ('group_booking_count'), ('historical_route_load_factor'), ('historical_route_mean'), ('historical_route_observations'), ('month'), ('seat_capacity'), ('weekend_flag')) AS v(feature)
         UNION SELECT 1, 'demand_segment', demand_segment FROM demand_split WHERE part = 'train' AND demand_segment IS NOT NULL
         UNION SELECT 1, 'route_id', route_id FROM demand_split WHERE part = 'train' AND route_id IS NOT NULL)""",
)
def one_hot_schema(t: Tables) -> DataFrame:
    return ML.one_hot_table(train_part(t), MF.DEMAND_NUMERIC, MF.DEMAND_CATEGORICAL)


@query(
    "capacity_clamp",
    "SELECT flight_id, forecast AS forecast_passengers, CASE WHEN changed THEN 'yes' ELSE 'no' END AS constraint_applied FROM forecast_rows",
)
def capacity_clamp(t: Tables) -> DataFrame:
    changed = F.when(F.col("constraint_applied"), "yes").otherwise("no").alias("constraint_applied")
    return naive_forecast(t).select("flight_id", "forecast_passengers", changed)


FORECAST_SCORES = """SELECT model_id, wape FROM (
  SELECT 'seasonal_naive' AS model_id, sum(abs(forecast - target)) / sum(target) AS wape FROM forecast_rows WHERE part = 'validation'
  UNION ALL SELECT 'historical_mean', sum(abs(round_even(least(mean_raw, seat_capacity * 1.08e0), 0) - target)) / sum(target) FROM forecast_rows WHERE part = 'validation')"""
sql_part("forecast_champion", f"{FORECAST_SCORES} ORDER BY wape, model_id LIMIT 1")
sql_part(
    "champion_rows",
    """SELECT * EXCLUDE (raw), raw AS chosen_raw, round_even(least(greatest(0.0e0, raw), seat_capacity * 1.08e0), 0) AS chosen, abs(least(greatest(0.0e0, raw), seat_capacity * 1.08e0) - raw) > 0.0001 AS moved
       FROM (SELECT f.*, c.model_id, CASE c.model_id WHEN 'seasonal_naive' THEN naive_raw ELSE mean_raw END AS raw FROM forecast_rows f, forecast_champion c)""",
)
sql_part(
    "validation_residuals",
    "SELECT *, row_number() OVER (ORDER BY res) - 1 AS i, count(*) OVER () AS n FROM (SELECT abs(chosen - target) AS res FROM champion_rows WHERE part = 'validation')",
)
sql_part(
    "widths",
    "SELECT (SELECT res FROM validation_residuals WHERE i = round_even(0.8e0 * (n - 1), 0)) AS w80, (SELECT res FROM validation_residuals WHERE i = round_even(0.95e0 * (n - 1), 0)) AS w95",
)


def forecast_candidates(t: Tables) -> DataFrame:
    """The forecasts of the baselines, stacked."""
    made = {"seasonal_naive": naive_forecast(t), "historical_mean": mean_forecast(t)}
    named = [df.withColumns({"model_id": F.lit(m), "model_role": F.lit("baseline")}) for m, df in made.items()]
    return named[0].unionByName(named[1])


def forecast_registry(t: Tables) -> DataFrame:
    """Validation scores of the forecast models and the one published."""

    def build(t: Tables) -> DataFrame:
        validation = forecast_candidates(t).filter("partition = 'validation'")
        metrics = materialize(M.forecast_metrics(validation, ("model_id", "model_role"), actual="target"), "scores")
        return M.model_registry(metrics, M.select_champion(metrics, "wape", maximize=False, tie_breakers=M.forecast_tie_breakers()))

    return t.written_stage("forecast_registry", build)


def champion_forecast(t: Tables) -> DataFrame:
    return t.stage("champion_forecast", lambda t: M.published_rows(forecast_candidates(t), forecast_registry(t)))


@query("forecast_registry", f"SELECT model_id, round(wape, 6) AS wape, CASE WHEN model_id = (SELECT model_id FROM forecast_champion) THEN 'yes' ELSE 'no' END AS published FROM ({FORECAST_SCORES})")
def forecast_registry_query(t: Tables) -> DataFrame:
    published = F.when(F.col("published"), "yes").otherwise("no").alias("published")
    return forecast_registry(t).select("model_id", F.round("wape", 6).alias("wape"), published)


def quantiles(t: Tables) -> DataFrame:
    validation = champion_forecast(t).filter("partition = 'validation'")
    return ML.residual_quantiles(validation, F.abs(F.col("forecast_passengers") - F.col("target")), (0.8, 0.95))


@query("residual_quantiles", "SELECT '80' AS level, w80 AS width FROM widths UNION ALL SELECT '95', w95 FROM widths")
def residual_quantiles(t: Tables) -> DataFrame:
    return quantiles(t)


def published_forecast(t: Tables) -> DataFrame:
    bounded = ML.interval_bounds(champion_forecast(t).filter("partition = 'test'"), quantiles(t))
    return ML.forecast_table(bounded, "forecast-run")


def stored_forecast(t: Tables) -> DataFrame:
    return t.written_stage("forecast", published_forecast)


sql_part(
    "published",
    """SELECT flight_id, route_id, operating_date, observation_date, target, model_id, chosen_raw, chosen AS forecast, seat_capacity, moved AS changed, chosen - target AS signed,
              greatest(0.0e0, round_even(chosen - w80, 0)) AS lo80, greatest(chosen, round_even(chosen + w80, 0)) AS hi80, greatest(0.0e0, round_even(chosen - w95, 0)) AS lo95, greatest(chosen, round_even(chosen + w95, 0)) AS hi95
       FROM champion_rows, widths WHERE part = 'test'""",
)


@query(
    "interval_bounds",
    "SELECT flight_id, lo80 AS forecast_lower_80, hi80 AS forecast_upper_80, lo95 AS forecast_lower_95, hi95 AS forecast_upper_95 FROM published",
)
def interval_bounds(t: Tables) -> DataFrame:
    return published_forecast(t).select(
        "flight_id", *[f"forecast_{side}_{level}" for level in (80, 95) for side in ("lower", "upper")]
    )


@query(
    "forecast_table",
    """SELECT flight_id, model_id, route_id, cast(operating_date AS varchar) AS operating_date, target AS actual_passengers, round(1e-10 + chosen_raw, 4) AS raw_forecast_passengers, forecast AS forecast_passengers, round_even(seat_capacity * 1.08e0, 0) AS allowed_capacity,
              abs(signed) AS absolute_error, signed AS signed_error, round(1e-10 + abs(signed) / target, 6) AS percentage_error FROM published""",
)
def forecast_table(t: Tables) -> DataFrame:
    return stored_forecast(t).select(
        "flight_id",
        "model_id",
        "route_id",
        F.col("operating_date").cast("string").alias("operating_date"),
        "actual_passengers",
        "raw_forecast_passengers",
        "forecast_passengers",
        "allowed_capacity",
        "absolute_error",
        "signed_error",
        r6("percentage_error"),
    )


@query(
    "forecast_adjustments",
    "SELECT flight_id, round(1e-10 + chosen_raw, 4) AS raw_forecast, forecast, CASE WHEN changed THEN 'yes' ELSE 'no' END AS constraint_applied FROM published",
)
def forecast_adjustments(t: Tables) -> DataFrame:
    changed = F.when(F.col("constraint_applied"), "yes").otherwise("no").alias("constraint_applied")
    return ML.forecast_adjustments(stored_forecast(t)).select("flight_id", "raw_forecast", "forecast", changed)


METRIC_SQL = """count(*) AS sample_size, round(1e-10 + avg(abs(e)), 6) AS mae, round(1e-10 + sqrt(avg(e * e)), 6) AS rmse, round(1e-10 + sum(abs(e)) / sum(a), 6) AS wape, round(1e-10 + avg(2 * abs(e) / (a + p)), 6) AS smape, round(1e-10 + avg(e), 6) AS bias,
   round(1e-10 + avg(CASE WHEN e < 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS underforecast_rate, round(1e-10 + avg(CASE WHEN e > 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS overforecast_rate"""
sql_part(
    "errors",
    "SELECT part, route_id, forecast AS p, target AS a, forecast - target AS e, target / seat_capacity AS load FROM forecast_rows",
)


def rounded_metrics(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.select(*keys, "sample_size", *[r6(m) for m in M.FORECAST_METRICS])


@query("forecast_metrics", f"SELECT part AS partition, {METRIC_SQL} FROM errors GROUP BY part")
def forecast_metrics(t: Tables) -> DataFrame:
    return rounded_metrics(M.forecast_metrics(naive_forecast(t), ("partition",), actual="target"), ("partition",))


@query(
    "grouped_forecast_metrics",
    f"""SELECT 'route' AS dimension, route_id AS value, {METRIC_SQL} FROM errors WHERE part = 'test' GROUP BY route_id
        UNION ALL SELECT 'load_factor_band', CASE WHEN load < 0.75 THEN 'low' WHEN load < 0.9 THEN 'medium' ELSE 'high' END AS value, {METRIC_SQL} FROM errors WHERE part = 'test' GROUP BY value""",
)
def grouped_forecast_metrics(t: Tables) -> DataFrame:
    test = naive_forecast(t).filter("partition = 'test'")
    return rounded_metrics(M.grouped_forecast_metrics(test, actual="target"), ("dimension", "value"))


@query(
    "metric_rows_long",
    f"UNPIVOT (SELECT * EXCLUDE (sample_size) FROM (SELECT part AS partition, {METRIC_SQL} FROM errors GROUP BY part)) ON mae, rmse, wape, smape, bias, underforecast_rate, overforecast_rate INTO NAME metric VALUE metric_value",
)
def metric_rows_long(t: Tables) -> DataFrame:
    metrics = M.forecast_metrics(naive_forecast(t), ("partition",), actual="target")
    return M.metric_rows_long(metrics, ["partition"], list(M.FORECAST_METRICS)).select("partition", "metric", r6("metric_value"))


@query("load_factor_band", "SELECT CASE WHEN load < 0.75 THEN 'low' WHEN load < 0.9 THEN 'medium' ELSE 'high' END AS band, count(*) AS row_count FROM errors GROUP BY band")
def load_factor_band(t: Tables) -> DataFrame:
    return naive_forecast(t).groupBy(X.load_factor_band("target", "seat_capacity").alias("band")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query("select_champion_forecast", "SELECT model_id AS champion_model_id, round(1e-10 + wape, 6) AS champion_score FROM forecast_champion")
def select_champion_forecast(t: Tables) -> DataFrame:
    chosen = forecast_registry(t).where("published")
    return chosen.select(F.col("model_id").alias("champion_model_id"), r6("champion_score", F.col("wape")))


# ---------------------------------------------------------------- delay rows

sql_part(
    "delay_marked",
    """SELECT f.*, d.actual_arrival_utc, f.scheduled_departure_utc - interval '120' minute AS cutoff, cast(greatest(0, d.departure_delay_minutes) AS double) AS delay_minutes,
              CASE WHEN d.departure_delay_minutes >= 15 THEN 1 ELSE 0 END AS target,
              CASE WHEN d.flight_id IS NULL THEN 'missing_delay_history' WHEN d.cancelled_flag THEN 'cancelled' WHEN d.actual_departure_utc IS NULL THEN 'missing_actual_departure' END AS reason
       FROM flight_schedule f LEFT JOIN delay_history d ON d.flight_id = f.flight_id""",
)
sql_part("delay_kept", "SELECT * FROM delay_marked WHERE reason IS NULL")
sql_part(
    "delay_history_rates",
    """SELECT *, """
    + ", ".join(
        f"count(*) OVER {n} AS {n}_count, coalesce(avg(target) OVER {n}, 0.5e0) AS {n}_rate, coalesce(avg(delay_minutes) OVER {n}, 0) AS {n}_mean"
        for n in ("route", "origin", "destination", "aircraft")
    )
    + """ FROM delay_kept WINDOW """
    + ", ".join(
        f"{n} AS (PARTITION BY {c} ORDER BY scheduled_departure_utc, flight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        for n, c in (
            ("route", "route_id"),
            ("origin", "origin_airport"),
            ("destination", "destination_airport"),
            ("aircraft", "aircraft_id"),
        )
    ),
)
sql_part(
    "cutoff_ends",
    "SELECT flight_id, cutoff, origin_airport AS airport FROM delay_kept UNION SELECT flight_id, cutoff, destination_airport FROM delay_kept",
)
sql_part(
    "cutoff_weather",
    "SELECT e.flight_id, count(*) AS n, max(severity) AS sev, max(operational_impact_score) AS impact FROM cutoff_ends e JOIN weather_events w ON w.airport_code = e.airport AND w.event_start_utc <= e.cutoff AND w.event_end_utc >= e.cutoff GROUP BY e.flight_id",
)
sql_part(
    "cutoff_reading",
    """SELECT flight_id, telemetry_id, maintenance_risk_score FROM (SELECT h.*, row_number() OVER (PARTITION BY h.flight_id ORDER BY h.event_timestamp_utc DESC, h.telemetry_id) AS rn
       FROM aircraft_health h JOIN delay_kept k ON k.flight_id = h.flight_id WHERE h.event_timestamp_utc <= k.cutoff) WHERE rn = 1""",
)


def marked_delays(t: Tables) -> DataFrame:
    return t.stage("marked_delays", lambda t: MF.eligible_delays(t.flight_schedule, t.delay_history))


def delay_rows(t: Tables) -> DataFrame:
    return t.stage(
        "delay_rows",
        lambda t: MF.delay_features(
            t.flight_schedule,
            t.delay_history,
            t.crew_operations,
            t.weather_events,
            t.airport_events,
            t.aircraft_health,
        ),
    )


@query("filter_exclusions_ledger", "SELECT coalesce(reason, 'modelled_rows') AS reason, count(*) AS row_count FROM delay_marked GROUP BY ALL")
def filter_exclusions_ledger(t: Tables) -> DataFrame:
    return MF.exclusion_summary(marked_delays(t))


@query("exclusion_summary", "SELECT flight_id, reason AS exclusion_reason FROM delay_marked WHERE reason IS NOT NULL")
def exclusion_summary(t: Tables) -> DataFrame:
    return marked_delays(t).filter("exclusion_reason IS NOT NULL").select("flight_id", "exclusion_reason")


@query(
    "prior_rate",
    "SELECT flight_id, route_count AS historical_route_observations, round(1e-10 + route_rate, 6) AS historical_route_delay_rate, round(1e-10 + route_mean, 6) AS historical_route_mean_delay, round(1e-10 + origin_rate, 6) AS historical_origin_delay_rate, round(1e-10 + destination_rate, 6) AS historical_destination_delay_rate, round(1e-10 + aircraft_rate, 6) AS historical_aircraft_delay_rate FROM delay_history_rates",
)
def prior_rate(t: Tables) -> DataFrame:
    from contrail.operators.history import prior_rate as run

    rated = run(
        marked_delays(t).filter("exclusion_reason IS NULL"),
        {
            "route": "route_id",
            "origin": "origin_airport",
            "destination": "destination_airport",
            "aircraft": "aircraft_id",
        },
    )
    return rated.select(
        "flight_id",
        F.col("route_count").alias("historical_route_observations"),
        r6("historical_route_delay_rate", "route_rate"),
        r6("historical_route_mean_delay", "route_mean_delay"),
        r6("historical_origin_delay_rate", "origin_rate"),
        r6("historical_destination_delay_rate", "destination_rate"),
        r6("historical_aircraft_delay_rate", "aircraft_rate"),
    )


@query(
    "prior_rate_strict",
    """SELECT a.flight_id, count(b.flight_id) AS observations, round(1e-10 + coalesce(avg(b.target), 0.5e0), 6) AS rate FROM delay_kept a
       LEFT JOIN delay_kept b ON b.route_id = a.route_id AND b.actual_arrival_utc <= a.cutoff GROUP BY a.flight_id""",
)
def prior_rate_strict_query(t: Tables) -> DataFrame:
    rated = prior_rate_strict(marked_delays(t).filter("exclusion_reason IS NULL"), {"route": "route_id"})
    return rated.select("flight_id", F.col("route_count").alias("observations"), r6("rate", "route_rate"))


@query("asof_latest", "SELECT flight_id, telemetry_id, round(1e-10 + maintenance_risk_score, 6) AS maintenance_risk_score FROM cutoff_reading")
def asof_latest(t: Tables) -> DataFrame:
    points = marked_delays(t).filter("exclusion_reason IS NULL")
    found = P.asof_latest(t.aircraft_health, points, ["telemetry_id", "maintenance_risk_score"])
    return found.select("flight_id", "telemetry_id", r6("maintenance_risk_score"))


@query(
    "delay_features",
    """SELECT k.flight_id, k.target, k.delay_minutes, cast(hour(k.scheduled_departure_utc) AS int) AS departure_hour, coalesce(w.n, 0) AS weather_event_count, cast(coalesce(w.sev, 0) AS double) AS weather_max_severity, coalesce(w.impact, 0) AS weather_max_impact_score,
              round(1e-10 + coalesce(r.maintenance_risk_score, -1), 6) AS maintenance_risk_score, coalesce(c.cabin_crew_required - c.cabin_crew_assigned, -1) AS cabin_crew_gap, round(1e-10 + k.route_rate, 6) AS historical_route_delay_rate
       FROM delay_history_rates k LEFT JOIN cutoff_weather w ON w.flight_id = k.flight_id LEFT JOIN cutoff_reading r ON r.flight_id = k.flight_id LEFT JOIN crew_operations c ON c.flight_id = k.flight_id""",
)
def delay_features(t: Tables) -> DataFrame:
    return delay_rows(t).select(
        "flight_id",
        "target",
        "delay_minutes",
        "departure_hour",
        "weather_event_count",
        "weather_max_severity",
        "weather_max_impact_score",
        r6("maintenance_risk_score", F.coalesce("maintenance_risk_score", F.lit(-1.0))),
        F.coalesce("cabin_crew_gap", F.lit(-1)).alias("cabin_crew_gap"),
        r6("historical_route_delay_rate"),
    )


def split_delays(t: Tables) -> DataFrame:
    """Model rows with their part, as the models read them; the rows are stored, the part is a comparison."""
    return t.stage(
        "delay_split",
        lambda t: K.chronological_split(
            materialize(delay_rows(t), "delay_rows"),
            [F.col("scheduled_departure_utc"), F.col("flight_id")],
            [RN.hour_bin("scheduled_departure_utc")],
            DELAY_SPLIT,
        ),
    )


sql_part(
    "delay_split",
    """SELECT *, CASE WHEN pos <= floor(n * 0.7e0) THEN 'train' WHEN pos <= floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'validation' ELSE 'test' END AS part FROM (
         SELECT *, row_number() OVER (ORDER BY scheduled_departure_utc, flight_id) AS pos, count(*) OVER () AS n FROM delay_kept)""",
)


@query("chronological_split_delay", "SELECT flight_id, part AS partition FROM delay_split")
def chronological_split_delay(t: Tables) -> DataFrame:
    return split_delays(t).select("flight_id", "partition")


def delay_train(t: Tables) -> DataFrame:
    return split_delays(t).filter("partition = 'train'")


sql_part(
    "route_rates",
    "SELECT route_id, avg(target) AS rate, avg(delay_minutes) AS mean_delay FROM delay_split WHERE part = 'train' GROUP BY route_id",
)
sql_part(
    "rated_rows",
    """SELECT s.*, least(0.999999e0, greatest(0.000001e0, coalesce(r.rate, (SELECT avg(target) FROM delay_split WHERE part = 'train')))) AS probability,
              coalesce(r.mean_delay, (SELECT avg(delay_minutes) FROM delay_split WHERE part = 'train')) AS route_delay
       FROM delay_split s LEFT JOIN route_rates r ON r.route_id = s.route_id""",
)


@query("route_rate", "SELECT route_id, round(1e-10 + rate, 6) AS rate FROM route_rates")
def route_rate(t: Tables) -> DataFrame:
    return ML.key_means(delay_train(t), "route_id", F.col("target"), "rate").select("route_id", r6("rate"))


@query("model_majority", "SELECT flight_id, round(1e-10 + (SELECT avg(target) FROM delay_split WHERE part = 'train'), 6) AS probability FROM delay_split")
def model_majority(t: Tables) -> DataFrame:
    return ML.model_majority(split_delays(t), delay_train(t)).select("flight_id", r6("probability"))


def rated(t: Tables) -> DataFrame:
    return t.stage("rated_delays", lambda t: ML.model_route_rate(split_delays(t), delay_train(t)))


@query("model_route_rate", "SELECT flight_id, round(1e-10 + probability, 6) AS probability FROM rated_rows")
def model_route_rate(t: Tables) -> DataFrame:
    return rated(t).select("flight_id", r6("probability"))


def logistic(t: Tables) -> DataFrame:
    numeric = list(MF.DELAY_NUMERIC)
    fill = {c: 0 for c in numeric}
    model = ML.fit_logistic(delay_train(t).na.fill(fill), numeric, MF.DELAY_CATEGORICAL)
    return ML.predict_logistic(split_delays(t).na.fill(fill), model)


@query("model_logistic")
def model_logistic(t: Tables) -> DataFrame:
    return logistic(t).select("flight_id", "partition", "target", r6("probability"))


@query("estimate_delay_minutes", "SELECT flight_id, round(1e-10 + greatest(0.0e0, route_delay * (0.5e0 + probability)), 4) AS estimated_delay_minutes FROM rated_rows")
def estimate_delay_minutes(t: Tables) -> DataFrame:
    return ML.estimate_delay_minutes(rated(t), delay_train(t)).select("flight_id", "estimated_delay_minutes")


THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)


def delay_candidates(t: Tables) -> DataFrame:
    """The probabilities of the baselines, stacked."""
    made = {"route_historical_rate_baseline": rated(t), "majority_class_baseline": ML.model_majority(split_delays(t), delay_train(t))}
    named = [df.withColumns({"model_id": F.lit(m), "model_role": F.lit("baseline")}) for m, df in made.items()]
    return named[0].unionByName(named[1].select(*named[0].columns))


def delay_registry(t: Tables) -> DataFrame:
    """Validation scores of the delay models, the one published and its threshold."""

    def build(t: Tables) -> DataFrame:
        validation = delay_candidates(t).filter("partition = 'validation'")
        metrics = materialize(M.evaluate_classifier(validation, 0.5, ("model_id", "model_role"), pr_ties="grouped"), "scores")
        best = M.select_champion(metrics, "pr_auc", maximize=True, tie_breakers=M.delay_tie_breakers())
        registry = materialize(M.model_registry(metrics, best), "registry")
        own = M.published_rows(validation, registry)
        chosen = M.select_threshold(M.threshold_grid(own, THRESHOLDS)).select("threshold").first()["threshold"]
        return registry.withColumn("threshold", F.lit(float(chosen)))

    return t.written_stage("delay_registry", build)


def published_delays(t: Tables) -> DataFrame:
    rows = M.published_rows(delay_candidates(t), delay_registry(t), ("threshold",))
    test = ML.estimate_delay_minutes(rows.filter("partition = 'test'"), delay_train(t))
    return ML.delay_predictions_table(test, "delay-run")


def stored_delays(t: Tables) -> DataFrame:
    return t.written_stage("delay_predictions", published_delays)


sql_part(
    "delay_candidates",
    """SELECT 'route_historical_rate_baseline' AS model_id, * FROM rated_rows
       UNION ALL BY NAME SELECT 'majority_class_baseline' AS model_id, * EXCLUDE (probability), (SELECT avg(target) FROM delay_split WHERE part = 'train') AS probability FROM rated_rows""",
)
sql_part(
    "delay_model_scores",
    """SELECT model_id, sum(p * tp / n) / sum(p) AS pr_auc FROM (
         SELECT model_id, sum(target) AS p, sum(sum(target)) OVER (PARTITION BY model_id ORDER BY probability DESC) AS tp, sum(count(*)) OVER (PARTITION BY model_id ORDER BY probability DESC) AS n
         FROM delay_candidates WHERE part = 'validation' GROUP BY model_id, probability) GROUP BY model_id""",
)
sql_part("delay_champion", "SELECT model_id FROM delay_model_scores ORDER BY pr_auc DESC, model_id LIMIT 1")


@query(
    "delay_predictions_table",
    "SELECT flight_id, model_id, p AS delay_probability, predicted AS predicted_delay_flag, band AS risk_band, target AS actual_delay_flag, delay_minutes AS actual_delay_minutes FROM published_delays",
)
def delay_predictions_table(t: Tables) -> DataFrame:
    return stored_delays(t).select(
        "flight_id",
        "model_id",
        "delay_probability",
        "predicted_delay_flag",
        "risk_band",
        "actual_delay_flag",
        "actual_delay_minutes",
    )


@query(
    "prediction_adjustments",
    "SELECT flight_id, CASE WHEN band = 'high' THEN 'review_turnaround_and_crew_buffer' ELSE 'monitor' END AS suggested_action FROM published_delays",
)
def prediction_adjustments(t: Tables) -> DataFrame:
    return ML.prediction_adjustments(stored_delays(t)).select("flight_id", "suggested_action")


@query("risk_band_summary", "SELECT band AS risk_band, count(*) AS prediction_count FROM published_delays GROUP BY band")
def risk_band_summary(t: Tables) -> DataFrame:
    return ML.risk_band_summary(stored_delays(t))


# ---------------------------------------------------------------- classification metrics on tied probabilities

CONFUSION_SQL = """count(*) FILTER (hit AND target = 1) AS tp, count(*) FILTER (hit AND target = 0) AS fp, count(*) FILTER (NOT hit AND target = 0) AS tn, count(*) FILTER (NOT hit AND target = 1) AS fn"""


def ratios_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, tp, fp, tn, fn, round(1e-10 + pr, 6) AS precision, round(1e-10 + re, 6) AS recall, round(1e-10 + sp, 6) AS specificity, round(1e-10 + CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1, round(1e-10 + (re + sp) / 2, 6) AS balanced_accuracy FROM (
      SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS re, CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS sp FROM ({source}))"""


RATIOS = ("precision", "recall", "specificity", "f1", "balanced_accuracy")
COUNTS = ("tp", "fp", "tn", "fn")


@query(
    "confusion_metrics",
    ratios_sql(
        f"SELECT origin_airport, {CONFUSION_SQL} FROM (SELECT *, probability >= 0.5 AS hit FROM predictions) GROUP BY origin_airport",
        "origin_airport",
    ),
)
def confusion_metrics(t: Tables) -> DataFrame:
    found = M.confusion_metrics(t.predictions, 0.5, ("origin_airport",))
    return found.select("origin_airport", *COUNTS, *[r6(c) for c in RATIOS])


def grid_sql(source: str) -> str:
    return ratios_sql(
        f"SELECT threshold, {CONFUSION_SQL} FROM (SELECT v.threshold, target, probability >= v.threshold AS hit FROM {source}, (VALUES (0.3e0), (0.4e0), (0.5e0), (0.6e0), (0.7e0)) AS v(threshold)) GROUP BY threshold",
        "threshold",
    )


GRID_SQL = grid_sql("predictions")
BEST_THRESHOLD = "ORDER BY f1 DESC, recall DESC, precision DESC, abs(threshold - 0.5), threshold LIMIT 1"
sql_part("chosen_delays", "SELECT * FROM delay_candidates WHERE model_id = (SELECT model_id FROM delay_champion)")
sql_part("delay_threshold", f"SELECT threshold FROM ({grid_sql('(SELECT * FROM chosen_delays WHERE part = ' + repr('validation') + ')')}) {BEST_THRESHOLD}")
sql_part(
    "published_delays",
    """SELECT *, round(1e-10 + probability, 6) AS p, CASE WHEN probability >= (SELECT threshold FROM delay_threshold) THEN 1 ELSE 0 END AS predicted, CASE WHEN probability <= 0.3 THEN 'low' WHEN probability <= 0.6 THEN 'medium' ELSE 'high' END AS band FROM chosen_delays WHERE part = 'test'""",
)


@query("delay_registry", "SELECT model_id, round(pr_auc, 6) AS pr_auc, CASE WHEN model_id = (SELECT model_id FROM delay_champion) THEN 'yes' ELSE 'no' END AS published, (SELECT threshold FROM delay_threshold) AS threshold FROM delay_model_scores")
def delay_registry_query(t: Tables) -> DataFrame:
    published = F.when(F.col("published"), "yes").otherwise("no").alias("published")
    return delay_registry(t).select("model_id", F.round("pr_auc", 6).alias("pr_auc"), published, "threshold")


@query("threshold_grid", GRID_SQL)
def threshold_grid(t: Tables) -> DataFrame:
    grid = M.threshold_grid(t.predictions, THRESHOLDS)
    return grid.select("threshold", *COUNTS, *[r6(c) for c in RATIOS])


@query("select_threshold", f"SELECT threshold, f1 FROM ({GRID_SQL}) {BEST_THRESHOLD}")
def select_threshold(t: Tables) -> DataFrame:
    grid = M.threshold_grid(t.predictions, THRESHOLDS)
    return M.select_threshold(grid).select("threshold", r6("f1"))


@query(
    "log_loss",
    "SELECT route_id, round(1e-10 - avg(target * ln(least(1 - 1e-15, greatest(1e-15, probability))) + (1 - target) * ln(least(1 - 1e-15, greatest(1e-15, 1 - probability)))), 6) AS log_loss FROM predictions GROUP BY route_id",
)
def log_loss(t: Tables) -> DataFrame:
    found = t.predictions.groupBy("route_id").agg(M.log_loss_column("probability", "target").alias("log_loss"))
    return found.select("route_id", r6("log_loss"))


@query("brier_score", "SELECT route_id, round(1e-10 + avg((probability - target) * (probability - target)), 6) AS brier_score FROM predictions GROUP BY route_id")
def brier_score(t: Tables) -> DataFrame:
    found = t.predictions.groupBy("route_id").agg(M.brier_column("probability", "target").alias("brier_score"))
    return found.select("route_id", r6("brier_score"))


def areas_sql(source: str, key: str) -> str:
    """ROC with average ranks and PR with positives first, over ranked rows."""
    return f"""SELECT {key}, round(1e-10 + CASE WHEN sum(target) = 0 OR sum(1 - target) = 0 THEN 0 ELSE (sum(CASE WHEN target = 1 THEN avg_rank END) - sum(target) * (sum(target) + 1) / 2.0e0) / (sum(target) * sum(1 - target)) END, 6) AS roc_auc,
       round(1e-10 + CASE WHEN sum(target) = 0 THEN 0 ELSE sum(CASE WHEN target = 1 THEN tp / rk END) / sum(target) END, 6) AS pr_auc FROM (
      SELECT *, avg(up) OVER (PARTITION BY {key}, probability) AS avg_rank FROM (
        SELECT {key}, probability, target, row_number() OVER (PARTITION BY {key} ORDER BY probability, row_key) AS up,
               row_number() OVER (PARTITION BY {key} ORDER BY probability DESC, target DESC, row_key) AS rk, sum(target) OVER (PARTITION BY {key} ORDER BY probability DESC, target DESC, row_key ROWS UNBOUNDED PRECEDING) AS tp FROM {source})) GROUP BY {key}"""


sql_part("keyed_predictions", "SELECT *, 'all' AS scope FROM predictions")


@query("roc_auc", f"SELECT scope, roc_auc FROM ({areas_sql('keyed_predictions', 'scope')})")
def roc_auc(t: Tables) -> DataFrame:
    return M.curve_areas(t.predictions).select(F.lit("all").alias("scope"), r6("roc_auc"))


@query("pr_auc", f"SELECT scope, pr_auc FROM ({areas_sql('keyed_predictions', 'scope')})")
def pr_auc(t: Tables) -> DataFrame:
    return M.curve_areas(t.predictions).select(F.lit("all").alias("scope"), r6("pr_auc"))


@query("curve_areas_by_route", areas_sql("predictions", "route_id"))
def curve_areas_by_route(t: Tables) -> DataFrame:
    return M.curve_areas(t.predictions, ("route_id",)).select("route_id", r6("roc_auc"), r6("pr_auc"))


@query(
    "roc_auc_ordinal",
    """SELECT round(1e-10 + (sum(CASE WHEN target = 1 THEN rk END) - sum(target) * (sum(target) + 1) / 2.0e0) / (sum(target) * sum(1 - target)), 6) AS roc_auc
       FROM (SELECT target, row_number() OVER (ORDER BY probability, row_key) AS rk FROM predictions)""",
)
def roc_auc_ordinal(t: Tables) -> DataFrame:
    return M.roc_auc_ordinal(t.predictions, "row_key", [RN.span_bin("row_key", 1_000_000)]).select(r6("roc_auc"))


@query(
    "pr_auc_grouped_ties",
    """SELECT round(1e-10 + sum(p * tp / n) / sum(p), 6) AS pr_auc FROM (SELECT sum(target) AS p, sum(sum(target)) OVER (ORDER BY probability DESC) AS tp, sum(count(*)) OVER (ORDER BY probability DESC) AS n FROM predictions GROUP BY probability)""",
)
def pr_auc_grouped_ties(t: Tables) -> DataFrame:
    return M.curve_areas(t.predictions, pr_ties="grouped").select(r6("pr_auc"))


@query(
    "calibration_bins",
    """SELECT cast(b AS int) AS bin, count(probability) AS row_count, round(1e-10 + coalesce(avg(probability), 0), 6) AS mean_probability, round(1e-10 + coalesce(avg(target), 0), 6) AS observed_delay_rate
       FROM range(10) AS r(b) LEFT JOIN predictions ON least(9, floor(probability * 10)) = b GROUP BY b""",
)
def calibration_bins(t: Tables) -> DataFrame:
    return M.calibration_bins(t.predictions).select("bin", "row_count", r6("mean_probability"), r6("observed_delay_rate"))


sql_part(
    "metric_groups",
    """SELECT p.*, probability >= 0.5 AS hit, 'route' AS dimension, p.route_id AS value FROM predictions p
       UNION ALL SELECT p.*, probability >= 0.5, 'origin_airport', origin_airport FROM predictions p
       UNION ALL SELECT p.*, probability >= 0.5, 'time_band', CASE WHEN hour(scheduled_departure_utc) < 6 THEN 'overnight' WHEN hour(scheduled_departure_utc) < 12 THEN 'morning' WHEN hour(scheduled_departure_utc) < 18 THEN 'afternoon' ELSE 'evening' END FROM predictions p
       UNION ALL SELECT p.*, probability >= 0.5, 'weather_exposure', CASE WHEN w.flight_id IS NULL THEN 'False' ELSE 'True' END FROM predictions p LEFT JOIN weather_hits w ON w.flight_id = p.flight_id""",
)


@query(
    "grouped_delay_metrics",
    f"""SELECT c.*, a.roc_auc, a.pr_auc FROM ({ratios_sql(f"SELECT dimension, value, {CONFUSION_SQL} FROM metric_groups GROUP BY dimension, value", "dimension, value")}) c
        JOIN (SELECT split_part(k, '|', 1) AS dimension, split_part(k, '|', 2) AS value, roc_auc, pr_auc FROM ({areas_sql("(SELECT *, concat(dimension, '|', value) AS k FROM metric_groups)", "k")})) a ON a.dimension = c.dimension AND a.value = c.value""",
)
def grouped_delay_metrics(t: Tables) -> DataFrame:
    from contrail.operators.intervals import weather_exposure

    hits = weather_exposure(t.flight_schedule, t.weather_events, at="scheduled_departure_utc")
    exposed = t.predictions.join(hits.select("flight_id", "weather_event_count"), "flight_id", "left").withColumn(
        "weather_exposure_flag", F.when(F.col("weather_event_count") > 0, 1).otherwise(0)
    )
    found = M.grouped_delay_metrics(exposed, 0.5)
    return found.select("dimension", "value", *COUNTS, *[r6(c) for c in (*RATIOS, "roc_auc", "pr_auc")])


@query("time_band", "SELECT CASE WHEN hour(scheduled_departure_utc) < 6 THEN 'overnight' WHEN hour(scheduled_departure_utc) < 12 THEN 'morning' WHEN hour(scheduled_departure_utc) < 18 THEN 'afternoon' ELSE 'evening' END AS time_band, count(*) AS flights FROM flight_schedule GROUP BY ALL")
def time_band(t: Tables) -> DataFrame:
    return t.flight_schedule.groupBy(X.time_band(F.hour("scheduled_departure_utc")).alias("time_band")).agg(
        F.count(F.lit(1)).alias("flights")
    )


@query("select_champion")
def select_champion(t: Tables) -> DataFrame:
    """Delay champion over both baselines and the logistic model, on validation rows."""
    models = {
        "majority_class_baseline": ("baseline", ML.model_majority(split_delays(t), delay_train(t))),
        "route_historical_rate_baseline": ("baseline", rated(t)),
        "logistic_regression": ("candidate", logistic(t)),
    }
    parts = [
        df.filter("partition = 'validation'").select(
            F.lit(name).alias("model_id"), F.lit(role).alias("model_role"), "probability", "target"
        )
        for name, (role, df) in models.items()
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    metrics = M.evaluate_classifier(stacked, 0.5, ("model_id", "model_role"), pr_ties="grouped")
    best = M.select_champion(metrics, "pr_auc", maximize=True, tie_breakers=M.delay_tie_breakers())
    return best.select("champion_model_id", r6("champion_score"), "best_baseline_id", "fell_back_to_baseline")
