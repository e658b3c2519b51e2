"""Airline-shaped views over the given tables, as SQL that Spark and other SQL engines both accept.

Each entry is one common table expression. ``with_views`` puts the entries a statement needs in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from contrail.session import apply_runtime_settings, materialize

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {
    "flight_core": """
        SELECT o_orderkey AS n,
               cast(o_orderdate AS date) AS operating_date,
               cast(o_orderdate AS timestamp) + (o_orderkey % 1440) * interval '1' minute AS dep,
               60 + o_orderkey % 240 AS block,
               c_nationkey AS o,
               (c_nationkey + 1 + o_orderkey % 24) % 25 AS d,
               o_orderkey % 40 AS ac
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "flight_schedule": """
        SELECT concat('FL-', replace(cast(operating_date AS string), '-', ''), '-', lpad(cast(n AS string), 12, '0')) AS flight_id,
               n AS flight_n,
               concat('CT', cast(100 + n % 900 AS string)) AS flight_number,
               operating_date,
               dep AS scheduled_departure_utc,
               dep + (block - CASE WHEN n % 211 = 0 THEN 400 ELSE 0 END) * interval '1' minute AS scheduled_arrival_utc,
               concat('A', lpad(cast(o AS string), 2, '0')) AS origin_airport,
               concat('A', lpad(cast(CASE WHEN n % 173 = 0 THEN o ELSE d END AS string), 2, '0')) AS destination_airport,
               concat('A', lpad(cast(o AS string), 2, '0'), '-A', lpad(cast(CASE WHEN n % 191 = 0 THEN (d + 1) % 25 ELSE d END AS string), 2, '0')) AS route_id,
               concat('AC', lpad(cast(CASE WHEN n % 307 = 0 THEN 77 ELSE ac END AS string), 3, '0')) AS aircraft_id,
               CASE (ac + CASE WHEN n % 229 = 0 THEN 1 ELSE 0 END) % 5 WHEN 0 THEN 'A320' WHEN 1 THEN 'A321' WHEN 2 THEN 'B737-800' WHEN 3 THEN 'B787-9' ELSE 'E190' END AS aircraft_type,
               cast(CASE ac % 5 WHEN 0 THEN 180 WHEN 1 THEN 220 WHEN 2 THEN 189 WHEN 3 THEN 296 ELSE 100 END + CASE WHEN n % 241 = 0 THEN 5 ELSE 0 END AS bigint) AS seat_capacity,
               cast(block + CASE WHEN n % 251 = 0 THEN 45 ELSE 0 END AS bigint) AS scheduled_block_minutes,
               concat('T', cast(1 + n % 4 AS string)) AS departure_terminal,
               concat('T', cast(1 + n % 3 AS string)) AS arrival_terminal,
               'scheduled' AS service_type,
               'scheduled' AS schedule_status
        FROM flight_core""",
    "delay_core": """
        SELECT n, dep, block,
               cast((n * 7) % 130 - 10 AS bigint) AS delay,
               n % 53 = 0 AS cancelled,
               n % 97 = 0 AND n % 53 <> 0 AS diverted,
               cast((n * 3) % 46 AS bigint) AS reactionary,
               concat('A', lpad(cast((o + 3) % 25 AS string), 2, '0')) AS alternate,
               concat('FL-', replace(cast(operating_date AS string), '-', ''), '-', lpad(cast(n AS string), 12, '0')) AS flight_id
        FROM flight_core WHERE n % 401 <> 0""",
    "delay_history": """
        SELECT flight_id, n AS row_key,
               CASE WHEN cancelled AND n % 106 <> 0 THEN NULL WHEN n % 331 = 0 THEN NULL ELSE dep + delay * interval '1' minute END AS actual_departure_utc,
               CASE WHEN cancelled THEN NULL WHEN n % 331 = 0 THEN NULL ELSE dep + (delay + block - CASE WHEN n % 337 = 0 THEN 500 ELSE 0 END) * interval '1' minute END AS actual_arrival_utc,
               delay + CASE WHEN n % 83 = 0 THEN 5 ELSE 0 END AS departure_delay_minutes,
               CASE WHEN cancelled THEN NULL ELSE delay + 3 END AS arrival_delay_minutes,
               CASE WHEN n % 61 = 0 THEN 'minor' WHEN delay + CASE WHEN n % 83 = 0 THEN 5 ELSE 0 END < 0 THEN 'early' WHEN delay + CASE WHEN n % 83 = 0 THEN 5 ELSE 0 END < 15 THEN 'on_time' WHEN delay + CASE WHEN n % 83 = 0 THEN 5 ELSE 0 END < 45 THEN 'minor' WHEN delay + CASE WHEN n % 83 = 0 THEN 5 ELSE 0 END < 90 THEN 'moderate' ELSE 'major' END AS delay_category,
               CASE WHEN cancelled THEN 'cancelled' WHEN n % 3 = 0 THEN 'weather' WHEN n % 3 = 1 THEN 'crew' ELSE 'airport' END AS primary_delay_cause,
               cancelled AS cancelled_flag,
               diverted AS diverted_flag,
               CASE WHEN diverted AND n % 194 <> 0 THEN alternate WHEN n % 349 = 0 THEN 'ZZZ' END AS diversion_airport,
               reactionary AS reactionary_delay_minutes,
               cast(n % 101 AS double) AS weather_impact_score,
               cast((n * 5) % 101 AS double) AS airport_impact_score,
               cast((n * 11) % 101 AS double) AS crew_impact_score,
               cast((n * 13) % 101 AS double) AS aircraft_impact_score
        FROM delay_core""",
    "crew_operations": """
        SELECT concat('CR-', cast(n AS string)) AS crew_assignment_id,
               CASE WHEN n % 353 = 0 THEN 'FL-UNKNOWN' ELSE concat('FL-', replace(cast(operating_date AS string), '-', ''), '-', lpad(cast(n AS string), 12, '0')) END AS flight_id,
               n AS row_key,
               n % 41 <> 0 AS captain_available,
               n % 43 <> 0 AS first_officer_available,
               cast(4 AS bigint) AS cabin_crew_required,
               cast(4 - CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END AS bigint) AS cabin_crew_assigned,
               n % 7 = 0 AS reserve_crew_used,
               dep - interval '60' minute AS duty_start_utc,
               dep + (block + 30 - CASE WHEN n % 359 = 0 THEN 600 ELSE 0 END) * interval '1' minute AS duty_end_utc,
               cast(block + 90 + CASE WHEN n % 67 = 0 THEN 4 ELSE 0 END AS bigint) AS duty_minutes,
               cast(5 + n % 76 AS bigint) AS connection_risk_minutes,
               n % 29 = 0 AS crew_disruption_flag,
               CASE WHEN n % 58 = 0 THEN 'sickness' WHEN n % 367 = 0 THEN 'roster' END AS crew_disruption_reason
        FROM flight_core""",
    "passenger_demand": """
        SELECT concat('FL-', replace(cast(operating_date AS string), '-', ''), '-', lpad(cast(n AS string), 12, '0')) AS flight_id,
               (((l_orderkey * 8 + l_linenumber) * 262144 + l_partkey) * 16384 + l_suppkey) * 64 + cast(l_quantity AS bigint) AS row_key,
               operating_date - cast(l_partkey % 61 + CASE WHEN l_suppkey % 89 = 0 THEN 1 ELSE 0 END AS int) AS observation_date,
               cast(l_partkey % 61 AS bigint) AS days_before_departure,
               concat('A', lpad(cast(o AS string), 2, '0'), '-A', lpad(cast(CASE WHEN n % 191 = 0 OR l_partkey % 101 = 0 THEN (d + 1) % 25 ELSE d END AS string), 2, '0')) AS route_id,
               cast(cast(l_quantity AS int) * 3 AS bigint) AS booked_passengers,
               cast(50 + l_orderkey % 150 AS bigint) AS expected_final_passengers,
               cast(CASE ac % 5 WHEN 0 THEN 180 WHEN 1 THEN 220 WHEN 2 THEN 189 WHEN 3 THEN 296 ELSE 100 END AS bigint) AS seat_capacity,
               (50 + l_orderkey % 150) * 1.0e0 / CASE ac % 5 WHEN 0 THEN 180 WHEN 1 THEN 220 WHEN 2 THEN 189 WHEN 3 THEN 296 ELSE 100 END + CASE WHEN l_partkey % 107 = 0 THEN 0.01e0 ELSE 0.0e0 END AS load_factor,
               l_quantity / 2 AS booking_velocity,
               cast(l_linenumber % 4 AS bigint) AS cancellations_to_date,
               cast(l_suppkey % 5 AS bigint) AS group_booking_count,
               CASE l_returnflag WHEN 'A' THEN 'business-heavy' WHEN 'N' THEN 'leisure-heavy' ELSE 'balanced' END AS demand_segment,
               l_discount AS fare_discount,
               1 - l_discount - l_tax AS fare_standard,
               l_tax AS fare_flex
        FROM lineitem JOIN flight_core ON l_orderkey = n""",
    "weather_core": """
        SELECT (((l_orderkey * 8 + l_linenumber) * 262144 + l_partkey) * 16384 + l_suppkey) * 64 + cast(l_quantity AS bigint) AS row_key,
               (s_nationkey + l_linenumber) % CASE WHEN l_partkey % 389 = 0 THEN 29 ELSE 25 END AS airport_n,
               cast(l_shipdate AS timestamp) + ((l_suppkey * 7 + l_partkey) % 1440) * interval '1' minute AS event_start_utc,
               l_partkey, l_suppkey, l_linenumber, l_orderkey, l_quantity, l_discount
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "weather_events": """
        SELECT concat('WE-', cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS weather_event_id,
               row_key,
               concat('A', lpad(cast(airport_n AS string), 2, '0')) AS airport_code,
               event_start_utc,
               event_start_utc + (60 * (1 + l_linenumber % 6) - CASE WHEN l_partkey % 397 = 0 THEN 600 ELSE 0 END) * interval '1' minute AS event_end_utc,
               CASE l_linenumber % 5 WHEN 0 THEN 'rain' WHEN 1 THEN 'fog' WHEN 2 THEN 'snow' WHEN 3 THEN 'thunderstorm' ELSE 'clear_wind' END AS weather_type,
               cast(1 + l_partkey % 5 AS bigint) AS severity,
               cast(l_partkey % 120 - 60 AS double) AS temperature_c,
               cast(l_suppkey % 60 AS double) AS wind_speed_knots,
               cast(l_suppkey % 60 + l_linenumber - 4 AS double) AS wind_gust_knots,
               least(100.0e0, 2 * l_quantity) AS operational_impact_score
        FROM weather_core""",
    "airport_events": """
        SELECT concat('AE-', cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS airport_event_id,
               (((l_orderkey * 8 + l_linenumber) * 262144 + l_partkey) * 16384 + l_suppkey) * 64 + cast(l_quantity AS bigint) AS row_key,
               concat('A', lpad(cast(s_nationkey AS string), 2, '0')) AS airport_code,
               cast(l_shipdate AS timestamp) + (l_partkey % 1440) * interval '1' minute AS event_start_utc,
               cast(l_shipdate AS timestamp) + (l_partkey % 1440 + 60 * (1 + l_linenumber % 5)) * interval '1' minute AS event_end_utc,
               CASE l_linenumber % 3 WHEN 0 THEN 'runway_restriction' WHEN 1 THEN 'equipment_outage' ELSE 'deicing_constraint' END AS event_type,
               cast(1 + l_linenumber % 5 AS bigint) AS severity,
               cast(l_quantity AS bigint) AS capacity_reduction_percent,
               cast(8 * (1 + l_linenumber % 5) AS bigint) AS estimated_delay_minutes,
               CASE WHEN l_partkey % 103 = 0 THEN 'Operational notice' ELSE 'Synthetic operational notice' END AS operational_notes
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "aircraft_health": """
        SELECT concat('TM-', lpad(cast(event_id AS string), 12, '0')) AS telemetry_id,
               event_id AS row_key,
               concat('AC', lpad(cast(CASE WHEN event_id % 113 = 0 THEN 88 WHEN event_id % 17 = 0 THEN (ac + 1) % 40 ELSE ac END AS string), 3, '0')) AS aircraft_id,
               CASE ac % 5 WHEN 0 THEN 'A320' WHEN 1 THEN 'A321' WHEN 2 THEN 'B737-800' WHEN 3 THEN 'B787-9' ELSE 'E190' END AS aircraft_type,
               dep + ((event_id * 37) % 240 - 150) * interval '1' minute AS event_timestamp_utc,
               concat('FL-', replace(cast(operating_date AS string), '-', ''), '-', lpad(cast(n AS string), 12, '0')) AS flight_id,
               value / 50 AS engine_1_vibration,
               value / 50 + (user_id % 7) * 0.1e0 AS engine_2_vibration,
               500 + value AS engine_1_temperature_c,
               495 + value + user_id % 11 AS engine_2_temperature_c,
               2400 + value * 3 AS hydraulic_pressure_psi,
               25 + value / 5 AS oil_pressure_psi,
               2000 + value AS fuel_flow_kg_h,
               value AS brake_temperature_c,
               cast(cast(regexp_extract(props, '[0-9]+', 0) AS int) * 5 AS bigint) AS cycles_since_maintenance,
               cast(regexp_extract(props, '[0-9]+', 0) AS int) * 11.5e0 AS flight_hours_since_maintenance,
               CASE WHEN event_type = 'error' THEN concat('F', cast(user_id % 9 AS string)) END AS fault_code,
               CASE event_type WHEN 'purchase' THEN 'watch' WHEN 'signup' THEN 'review' WHEN 'error' THEN 'review' ELSE 'normal' END AS health_status,
               least(100.0e0, value / 4) AS maintenance_risk_score
        FROM events JOIN flight_core ON n = event_id - event_id % 3""",
    "dim_airports": """
        SELECT concat('A', lpad(cast(n_nationkey AS string), 2, '0')) AS code, n_name AS name FROM nation""",
    "dim_fleet": """
        SELECT DISTINCT concat('AC', lpad(cast(o_orderkey % 40 AS string), 3, '0')) AS aircraft_id,
               CASE (o_orderkey % 40) % 5 WHEN 0 THEN 'A320' WHEN 1 THEN 'A321' WHEN 2 THEN 'B737-800' WHEN 3 THEN 'B787-9' ELSE 'E190' END AS aircraft_type,
               cast(CASE (o_orderkey % 40) % 5 WHEN 0 THEN 180 WHEN 1 THEN 220 WHEN 2 THEN 189 WHEN 3 THEN 296 ELSE 100 END AS bigint) AS seat_capacity
        FROM orders""",
    "dim_routes": """
        SELECT DISTINCT concat('A', lpad(cast(o AS string), 2, '0'), '-A', lpad(cast(d AS string), 2, '0')) AS route_id,
               concat('A', lpad(cast(o AS string), 2, '0')) AS origin,
               concat('A', lpad(cast(d AS string), 2, '0')) AS destination
        FROM flight_core WHERE (o + d) % 31 <> 0""",
    "dim_sensor_ranges": """
        SELECT aircraft_type, sensor, cast(low AS double) AS low, cast(high AS double) AS high FROM (VALUES
          ('A320','engine_1_vibration',0.5,6.5),('A320','engine_2_vibration',0.5,6.5),('A320','engine_1_temperature_c',540,860),('A320','engine_2_temperature_c',540,860),
          ('A320','hydraulic_pressure_psi',2450,3300),('A320','oil_pressure_psi',28,95),('A320','fuel_flow_kg_h',2010,2400),('A320','brake_temperature_c',5,380),
          ('E190','engine_1_vibration',0.4,6.0),('E190','engine_2_vibration',0.4,6.0),('E190','engine_1_temperature_c',520,840),('E190','engine_2_temperature_c',520,840),
          ('E190','hydraulic_pressure_psi',2450,3400),('E190','oil_pressure_psi',28,90),('E190','fuel_flow_kg_h',2010,2420),('E190','brake_temperature_c',4,360)
        ) AS t(aircraft_type, sensor, low, high)""",
    "predictions": """
        SELECT f.flight_id, f.flight_n AS row_key, f.route_id, f.origin_airport, f.destination_airport, f.operating_date, f.scheduled_departure_utc,
               ((f.flight_n * 37) % 1000) / 1000.0e0 AS probability,
               cast(CASE WHEN d.departure_delay_minutes >= 15 THEN 1 ELSE 0 END AS bigint) AS target,
               d.departure_delay_minutes AS delay_minutes
        FROM flight_schedule f JOIN delay_history d ON f.flight_id = d.flight_id
        WHERE NOT d.cancelled_flag AND d.actual_departure_utc IS NOT NULL""",
}

CORE = "flight_core"

# Row keys pack order, line, part, supplier and quantity into one number, which leaves the range of bigint from order 4,194,304
# on. In Spark's views such orders take the free negative half: within an order the keys keep their sequence.
PACKED_ORDER = "((l_orderkey * 8 + l_linenumber)"
FITTING_ORDER = "((CASE WHEN l_orderkey < 4194290 THEN l_orderkey ELSE l_orderkey % 4000000 - 4194304 END * 8 + l_linenumber)"


@lru_cache(maxsize=None)
def _words(sql: str) -> frozenset[str]:
    return frozenset(re.findall(r"\w+", sql))


def _mentions(name: str, sql: str) -> bool:
    return name in _words(sql)


def needed_views(sql: str, views: dict[str, str]) -> list[str]:
    """Views a statement uses, directly or not, in definition order."""
    wanted: set[str] = set()
    frontier = [sql]
    while frontier:
        text = frontier.pop()
        for name, body in views.items():
            if name not in wanted and _mentions(name, text):
                wanted.add(name)
                frontier.append(body)
    return [name for name in views if name in wanted]


def with_views(sql: str, extra: dict[str, str] | None = None, stored: tuple[str, ...] = ()) -> str:
    """The statement with the common table expressions it needs, but for those that are stored tables."""
    views = {**VIEWS, **(extra or {})}
    names = [name for name in needed_views(sql, views) if name not in stored]
    if not names:
        return sql
    body = ",\n".join(f"{name} AS ({views[name]})" for name in names)
    return f"WITH {body}\n{sql}"


class Tables:
    """The given parquet tables of one folder and the airline views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = apply_runtime_settings(spark)
        self.folder = folder
        self._views: dict[str, DataFrame] = {}
        self._base: dict[str, DataFrame] = {}

    def written_stage(self, name: str, build: Callable[[Tables], DataFrame]) -> DataFrame:
        """A named intermediate table, written once to the shared folder because several consumers read it."""
        return self.stage(f"{name}_written", lambda t: materialize(build(t), name))

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Tables:
        """The tables of a folder, analysed once per session; plans are shared, data is read by every query."""
        known = spark.__dict__.setdefault("_contrail_tables", {})
        if folder not in known:
            known[folder] = cls(spark, folder)
        apply_runtime_settings(spark)
        return known[folder]

    def stage(self, name: str, build: Callable[[Tables], DataFrame]) -> DataFrame:
        """A named intermediate plan, built once."""
        if name not in self._views:
            self._views[name] = build(self)
        return self._views[name]

    def base(self, name: str) -> DataFrame:
        if name not in self._base:
            self._base[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._base[name]

    def core(self) -> DataFrame:
        """Orders with the nation of their customer, joined once: most views begin with it."""
        for name in ("orders", "customer"):
            self.base(name).createOrReplaceTempView(name)
        return self.written_stage(CORE, lambda t: t.spark.sql(VIEWS[CORE]))

    def sql(self, statement: str, extra: dict[str, str] | None = None) -> DataFrame:
        text = with_views(statement, extra, (CORE,)).replace(PACKED_ORDER, FITTING_ORDER)
        if _mentions(CORE, text):
            self.core().createOrReplaceTempView(CORE)
        for name in BASE_TABLES:
            if _mentions(name, text):
                self.base(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._views:
            self._views[name] = self.sql(f"SELECT * FROM {name}")
        return self._views[name]
