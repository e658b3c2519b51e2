"""Named queries over ingest, validation, quarantine and quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.columns import delay_category
from contrail.operators import normalize as N
from contrail.operators import quality as Q
from contrail.operators import rules as R
from contrail.operators.findings import rule_findings, union_all
from contrail.plans.airline_views import Tables
from contrail.plans.registry import query, sql_part
from contrail.sources import contracts as C
from contrail.sources import readers as S

ROW_KEYS = {"flight_schedule": "flight_n"}


def typed_tables(t: Tables) -> dict[str, DataFrame]:
    """The seven airline tables with their source row number."""
    return {
        name: t.stage(
            f"typed_{name}",
            lambda t, name=name: getattr(t, name).withColumnRenamed(ROW_KEYS.get(name, "row_key"), "row_number"),
        )
        for name in C.CONTRACTS
    }


def dims(t: Tables) -> dict[str, DataFrame]:
    return {
        "airports": t.dim_airports,
        "routes": t.dim_routes,
        "fleet": t.dim_fleet,
        "sensor_ranges": t.dim_sensor_ranges,
    }


def short(findings: DataFrame) -> DataFrame:
    return findings.select("dataset", "rule_id", "field_name", "severity", "row_number")


def all_findings(t: Tables) -> DataFrame:
    return t.stage("findings", build_findings)


def stored_findings(t: Tables) -> DataFrame:
    """The findings table as its consumers read it."""
    return t.written_stage("findings", all_findings)


def checked_tables(t: Tables, dataset: str) -> dict[str, DataFrame]:
    """The typed tables for the rules of one table, which reads its bookings stored: several rules need them."""
    tables = typed_tables(t)
    if dataset == "passenger_demand":
        tables[dataset] = t.written_stage("typed_demand", lambda t: typed_tables(t)[dataset])
    return tables


def stored_marks(t: Tables, *datasets: str) -> DataFrame:
    """Table, row number and severity of the findings of some tables (of all when none is named), one stage a table."""

    def build(dataset: str):
        return lambda t: R.finding_marks(checked_tables(t, dataset), dims(t), dataset)

    return union_all([t.written_stage(f"marks_{name}", build(name)) for name in datasets or C.CONTRACTS])


def delay_findings(t: Tables) -> DataFrame:
    """The findings of the delay history."""
    only, tables = ("delay_history",), typed_tables(t)
    return t.stage(
        "delay_findings",
        lambda t: union_all(
            [
                R.business_findings(tables, dims(t), datasets=only),
                R.pk_findings(tables["delay_history"], C.DELAY_HISTORY),
                R.coverage_findings(tables, datasets=only),
            ]
        ),
    )


def build_findings(t: Tables) -> DataFrame:
    tables = typed_tables(t)
    return union_all(
        [
            R.business_findings(tables, dims(t)),
            R.all_pk_findings(tables),
            R.coverage_findings(tables),
        ]
    )


# ---------------------------------------------------------------- raw text rows of every column type

RAW_CONTRACT = C.DatasetContract(
    "sample",
    "SM",
    "csv",
    ("code",),
    (
        C.text("code"),
        C.text("segment", "A", "N", nullable=False),
        C.text("note", nullable=True),
        C.whole("days", 0, 40),
        C.number("load", 0.0),
        C.flag("open"),
        C.instant("seen_at"),
        C.day("on_day"),
        C.FieldSpec("mix", "json_string"),
    ),
)

sql_part(
    "raw_rows",
    """
    SELECT (((l_orderkey * 8 + l_linenumber) * 262144 + l_partkey) * 16384 + l_suppkey) * 64 + cast(l_quantity AS bigint) AS row_number,
           CASE WHEN l_partkey % 71 = 0 THEN '' ELSE concat(' P', cast(l_partkey AS string), ' ') END AS code,
           l_returnflag AS segment,
           CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE ' late ' END AS note,
           CASE l_suppkey % 8 WHEN 0 THEN 'abc' WHEN 1 THEN '12.5' WHEN 2 THEN ' 7 ' WHEN 3 THEN '-3' WHEN 4 THEN NULL ELSE cast(l_partkey % 61 AS string) END AS days,
           CASE l_linenumber WHEN 1 THEN 'NaN' WHEN 2 THEN '1e3' WHEN 3 THEN 'inf' WHEN 4 THEN '1.5d' ELSE cast(l_discount AS string) END AS load,
           CASE l_suppkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'yes' WHEN 3 THEN '1' ELSE 'False' END AS open,
           CASE l_partkey % 5 WHEN 0 THEN concat(cast(cast(l_shipdate AS date) AS string), 'T08:30:00') WHEN 1 THEN concat(cast(cast(l_shipdate AS date) AS string), 'T08:30:00+02:00') WHEN 2 THEN 'soon' ELSE concat(cast(cast(l_shipdate AS date) AS string), 'T08:30:00Z') END AS seen_at,
           CASE l_partkey % 7 WHEN 0 THEN '2024-13-45' WHEN 1 THEN '2024-2-3' ELSE cast(cast(l_shipdate AS date) AS string) END AS on_day,
           CASE l_suppkey % 4 WHEN 0 THEN '[1,2]' WHEN 1 THEN 'x' ELSE concat('{"b":', cast(l_linenumber AS string), ',"a":', cast(l_partkey AS string), '}') END AS mix
    FROM lineitem""",
)

sql_part(
    "parsed_rows",
    """
    SELECT row_number, code AS code_raw, segment, trim(note) AS note_t, days AS days_raw, load AS load_raw, open AS open_raw,
           CASE WHEN code <> '' THEN trim(code) END AS code,
           CASE WHEN trim(note) <> '' THEN trim(note) END AS note,
           CASE WHEN regexp_matches(trim(days), '^[+-]?\\d+$') THEN cast(trim(days) AS bigint) END AS days,
           CASE WHEN regexp_matches(trim(load), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN cast(trim(load) AS double) END AS load,
           CASE WHEN open IN ('true','True','TRUE') THEN true WHEN open IN ('false','False','FALSE') THEN false END AS open,
           CASE WHEN regexp_matches(seen_at, 'T08:30:00Z$') THEN cast(substr(seen_at, 1, 19) AS timestamp)
                WHEN regexp_matches(seen_at, 'T08:30:00\\+02:00$') THEN cast(substr(seen_at, 1, 19) AS timestamp) - interval '2' hour END AS seen_at,
           CASE WHEN regexp_matches(on_day, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_cast(on_day AS date) END AS on_day,
           CASE WHEN mix LIKE '{%' THEN mix END AS mix
    FROM raw_rows""",
)


@query(
    "normalize_record",
    """SELECT row_number, code, coalesce(note, '-') AS note, segment, coalesce(days, -999) AS days, coalesce(round(load, 6), -999) AS load,
              CASE WHEN open THEN 'yes' WHEN NOT open THEN 'no' ELSE '-' END AS open,
              coalesce(epoch_us(seen_at), -1) AS seen_at, coalesce(cast(on_day AS varchar), '-') AS on_day,
              CASE WHEN mix IS NULL THEN '-' ELSE concat('{"a":', regexp_extract(mix, '"a":([0-9]+)', 1), ',"b":', regexp_extract(mix, '"b":([0-9]+)', 1), '}') END AS mix
       FROM (SELECT * REPLACE (coalesce(code, '-') AS code) FROM parsed_rows)""",
)
def normalize_record(t: Tables) -> DataFrame:
    rows = N.normalize(t.sql("SELECT * FROM raw_rows", _parts()), RAW_CONTRACT)
    return rows.select(
        "row_number",
        F.coalesce("code", F.lit("-")).alias("code"),
        F.coalesce("note", F.lit("-")).alias("note"),
        "segment",
        F.coalesce("days", F.lit(-999)).alias("days"),
        F.coalesce(F.round("load", 6), F.lit(-999.0)).alias("load"),
        F.when(F.col("open"), "yes").when(~F.col("open"), "no").otherwise("-").alias("open"),
        F.coalesce(F.unix_micros("seen_at"), F.lit(-1)).alias("seen_at"),
        F.coalesce(F.col("on_day").cast("string"), F.lit("-")).alias("on_day"),
        F.coalesce("mix", F.lit("-")).alias("mix"),
    )


def _parts() -> dict[str, str]:
    from contrail.plans.registry import SQL_PARTS

    return SQL_PARTS


@query(
    "normalize_errors",
    """SELECT row_number, field_name, message FROM (
         SELECT row_number, 'code' AS field_name, 'code is required' AS message FROM parsed_rows WHERE code_raw = ''
         UNION ALL SELECT row_number, 'segment', 'segment must be one of [''A'', ''N'']' FROM parsed_rows WHERE segment NOT IN ('A','N')
         UNION ALL SELECT row_number, 'days', CASE WHEN days_raw IS NULL THEN 'days is required' WHEN days IS NULL THEN 'days cannot be parsed as integer' WHEN days < 0 THEN 'days must be >= 0' ELSE 'days must be <= 40' END
           FROM parsed_rows WHERE days IS NULL OR days < 0 OR days > 40
         UNION ALL SELECT row_number, 'load', 'load cannot be parsed as number' FROM parsed_rows WHERE load IS NULL
         UNION ALL SELECT row_number, 'open', 'open cannot be parsed as boolean' FROM parsed_rows WHERE open IS NULL
         UNION ALL SELECT row_number, 'seen_at', 'seen_at cannot be parsed as timestamp' FROM parsed_rows WHERE seen_at IS NULL
         UNION ALL SELECT row_number, 'on_day', 'on_day cannot be parsed as date' FROM parsed_rows WHERE on_day IS NULL
         UNION ALL SELECT row_number, 'mix', 'mix cannot be parsed as json_string' FROM parsed_rows WHERE mix IS NULL)""",
)
def normalize_errors(t: Tables) -> DataFrame:
    rows = N.normalize(t.sql("SELECT * FROM raw_rows", _parts()), RAW_CONTRACT)
    return N.schema_findings(rows, RAW_CONTRACT).select("row_number", "field_name", "message")


@query(
    "schema_missing_columns",
    """SELECT row_number, rule_id, field_name, 'error' AS severity FROM raw_rows,
       (VALUES ('SM-001','seen_at'), ('SM-001','mix')) AS m(rule_id, field_name)""",
)
def schema_missing_columns(t: Tables) -> DataFrame:
    raw = t.sql("SELECT * FROM raw_rows", _parts()).drop("seen_at", "mix")
    return N.column_findings(raw, RAW_CONTRACT).select("row_number", "rule_id", "field_name", "severity")


@query(
    "schema_unknown_columns",
    """SELECT event_id AS row_number, 'SM-002' AS rule_id, 'k' AS field_name, 'warning' AS severity FROM events WHERE props LIKE '%"k"%'""",
)
def schema_unknown_columns(t: Tables) -> DataFrame:
    raw = t.base("events").select(F.col("event_id").alias("row_number"), "props")
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    found = N.column_findings(raw, RAW_CONTRACT, observed_columns=keys, unknown_policy="warn")
    return found.filter(F.col("rule_id") == "SM-002").select("row_number", "rule_id", "field_name", "severity")


# ---------------------------------------------------------------- rules, table by table

SQL_FINDINGS: dict[str, str] = {}


def rule_sql(dataset: str, source: str, rules: list[tuple[str, str, str, str]], row: str = "row_key") -> str:
    """One scan per rule: (rule id, severity, field, failing condition)."""
    parts = [
        f"SELECT '{dataset}' AS dataset, '{rule}' AS rule_id, '{field}' AS field_name, '{severity}' AS severity, {row} AS row_number FROM {source} WHERE {bad}"
        for rule, severity, field, bad in rules
    ]
    return "\nUNION ALL ".join(parts)


sql_part(
    "schedule_x",
    """SELECT f.*, a.code AS oa, b.code AS da, r.route_id AS rr, r.origin AS ro, r.destination AS rd, ac.aircraft_id AS fa, ac.aircraft_type AS ft, ac.seat_capacity AS fc,
              epoch_us(f.scheduled_departure_utc) AS dep_us, epoch_us(f.scheduled_arrival_utc) AS arr_us
       FROM flight_schedule f LEFT JOIN dim_airports a ON a.code = f.origin_airport LEFT JOIN dim_airports b ON b.code = f.destination_airport
       LEFT JOIN dim_routes r ON r.route_id = f.route_id LEFT JOIN dim_fleet ac ON ac.aircraft_id = f.aircraft_id""",
)
SQL_FINDINGS["flight_schedule"] = rule_sql(
    "flight_schedule",
    "schedule_x",
    [
        ("FS-003", "error", "origin_airport", "origin_airport = destination_airport"),
        ("FS-004", "error", "scheduled_arrival_utc", "arr_us <= dep_us"),
        ("FS-005", "error", "origin_airport", "oa IS NULL OR da IS NULL"),
        ("FS-006", "error", "route_id", "rr IS NOT NULL AND (ro <> origin_airport OR rd <> destination_airport)"),
        ("FS-007", "error", "aircraft_type", "fa IS NOT NULL AND ft <> aircraft_type"),
        ("FS-008", "error", "seat_capacity", "fa IS NOT NULL AND fc <> seat_capacity"),
        (
            "FS-009",
            "warning",
            "scheduled_block_minutes",
            "abs((arr_us - dep_us) / 60000000.0 - scheduled_block_minutes) > 30",
        ),
        ("REL-001", "error", "origin_airport", "oa IS NULL"),
        ("REL-002", "error", "destination_airport", "da IS NULL"),
        ("REL-003", "error", "aircraft_id", "fa IS NULL"),
        ("REL-004", "error", "route_id", "rr IS NULL"),
    ],
    row="flight_n",
)


@query("row_rules_flight_schedule", SQL_FINDINGS["flight_schedule"])
def row_rules_flight_schedule(t: Tables) -> DataFrame:
    enriched = R.enrich_schedule(
        typed_tables(t)["flight_schedule"], t.dim_airports, t.dim_routes, t.dim_fleet
    )
    return short(rule_findings(enriched, "flight_schedule", R.schedule_rules()))


sql_part(
    "demand_x",
    """SELECT p.*, f.flight_id AS fid, f.route_id AS f_route, f.seat_capacity AS f_cap, cast(f.scheduled_departure_utc AS date) AS f_day
       FROM passenger_demand p LEFT JOIN flight_schedule f ON f.flight_id = p.flight_id""",
)
SQL_FINDINGS["passenger_demand"] = rule_sql(
    "passenger_demand",
    "demand_x",
    [
        ("PD-003", "error", "route_id", "fid IS NOT NULL AND route_id <> f_route"),
        ("PD-004", "error", "seat_capacity", "fid IS NOT NULL AND seat_capacity <> f_cap"),
        ("PD-005", "error", "observation_date", "observation_date > f_day"),
        ("PD-006", "error", "days_before_departure", "(f_day - observation_date) <> days_before_departure"),
        ("PD-007", "error", "booked_passengers", "booked_passengers > expected_final_passengers"),
        ("PD-008", "error", "expected_final_passengers", "expected_final_passengers > floor(seat_capacity * 1.08)"),
        (
            "PD-009",
            "error",
            "load_factor",
            "abs(load_factor - round(expected_final_passengers / seat_capacity, 4)) > 0.0001",
        ),
        ("PD-010", "warning", "booking_velocity", "booking_velocity > 20"),
        ("REL-010", "error", "flight_id", "fid IS NULL"),
    ],
)


@query("row_rules_passenger_demand", SQL_FINDINGS["passenger_demand"])
def row_rules_passenger_demand(t: Tables) -> DataFrame:
    tables = typed_tables(t)
    joined = R.with_flight(tables["passenger_demand"], tables["flight_schedule"])
    return short(rule_findings(joined, "passenger_demand", R.demand_rules()))


sql_part(
    "weather_x",
    """SELECT w.*, a.code AS known, epoch_us(event_start_utc) AS s_us, epoch_us(event_end_utc) AS e_us
       FROM weather_events w LEFT JOIN dim_airports a ON a.code = w.airport_code""",
)
SQL_FINDINGS["weather_events"] = rule_sql(
    "weather_events",
    "weather_x",
    [
        ("WE-002", "error", "event_end_utc", "e_us <= s_us"),
        ("WE-006", "warning", "wind_gust_knots", "wind_gust_knots + 2 < wind_speed_knots"),
        ("WE-008", "error", "temperature_c", "temperature_c < -60 OR temperature_c > 55"),
        ("REL-005", "error", "airport_code", "known IS NULL"),
    ],
)


@query("row_rules_weather_events", SQL_FINDINGS["weather_events"])
def row_rules_weather_events(t: Tables) -> DataFrame:
    rows = R.member_flag(typed_tables(t)["weather_events"], "airport_code", t.dim_airports, "code", "airport_known")
    return short(rule_findings(rows, "weather_events", R.weather_rules()))


sql_part(
    "airport_events_x",
    """SELECT w.*, a.code AS known, epoch_us(event_start_utc) AS s_us, epoch_us(event_end_utc) AS e_us
       FROM airport_events w LEFT JOIN dim_airports a ON a.code = w.airport_code""",
)
SQL_FINDINGS["airport_events"] = rule_sql(
    "airport_events",
    "airport_events_x",
    [
        ("AE-002", "error", "event_end_utc", "e_us <= s_us"),
        (
            "AE-003",
            "warning",
            "severity",
            "capacity_reduction_percent < severity * 4 OR estimated_delay_minutes < severity * 4",
        ),
        ("AE-004", "error", "operational_notes", "operational_notes NOT LIKE '%Synthetic%'"),
        ("REL-006", "error", "airport_code", "known IS NULL"),
    ],
)


@query("row_rules_airport_events", SQL_FINDINGS["airport_events"])
def row_rules_airport_events(t: Tables) -> DataFrame:
    rows = R.member_flag(typed_tables(t)["airport_events"], "airport_code", t.dim_airports, "code", "airport_known")
    return short(rule_findings(rows, "airport_events", R.airport_event_rules()))


sql_part(
    "health_x",
    """SELECT h.*, f.flight_id AS fid, f.aircraft_id AS f_ac, ac.aircraft_id AS fa, ac.aircraft_type AS ft,
              epoch_us(h.event_timestamp_utc) AS t_us, epoch_us(f.scheduled_departure_utc) AS d_us, epoch_us(f.scheduled_arrival_utc) AS a_us
       FROM aircraft_health h LEFT JOIN flight_schedule f ON f.flight_id = h.flight_id LEFT JOIN dim_fleet ac ON ac.aircraft_id = h.aircraft_id""",
)
sql_part(
    "sensor_x",
    "\nUNION ALL ".join(
        f"SELECT row_key, aircraft_type, '{s}' AS sensor, {s} AS reading FROM aircraft_health" for s in R.SENSORS
    ),
)
SQL_FINDINGS["aircraft_health"] = (
    rule_sql(
        "aircraft_health",
        "health_x",
        [
            ("AH-003", "error", "aircraft_type", "fa IS NOT NULL AND ft <> aircraft_type"),
            ("AH-004", "error", "event_timestamp_utc", "t_us < d_us - 7200000000 OR t_us > a_us + 1800000000"),
            ("AH-005", "error", "aircraft_id", "fid IS NOT NULL AND f_ac <> aircraft_id"),
            (
                "AH-007",
                "warning",
                "fault_code",
                "health_status = 'review' AND fault_code IS NULL AND maintenance_risk_score >= 70",
            ),
            ("REL-007", "error", "aircraft_id", "fa IS NULL"),
            ("REL-013", "error", "flight_id", "fid IS NULL"),
        ],
    )
    + """
UNION ALL SELECT 'aircraft_health' AS dataset, 'AH-006' AS rule_id, s.sensor AS field_name, 'error' AS severity, s.row_key AS row_number
FROM sensor_x s JOIN dim_sensor_ranges r ON r.aircraft_type = s.aircraft_type AND r.sensor = s.sensor
WHERE reading < low * 0.8e0 OR reading > high * 1.15e0"""
)


@query("row_rules_aircraft_health", SQL_FINDINGS["aircraft_health"])
def row_rules_aircraft_health(t: Tables) -> DataFrame:
    tables = typed_tables(t)
    rows = R.enrich_health(tables["aircraft_health"], tables["flight_schedule"], t.dim_fleet, t.dim_sensor_ranges)
    return short(rule_findings(rows, "aircraft_health", R.health_rules()))


sql_part(
    "crew_x",
    """SELECT c.*, f.flight_id AS fid, epoch_us(duty_start_utc) AS s_us, epoch_us(duty_end_utc) AS e_us
       FROM crew_operations c LEFT JOIN flight_schedule f ON f.flight_id = c.flight_id""",
)
SQL_FINDINGS["crew_operations"] = rule_sql(
    "crew_operations",
    "crew_x",
    [
        ("CR-002", "error", "duty_end_utc", "e_us <= s_us"),
        ("CR-003", "error", "duty_minutes", "abs(floor((e_us - s_us) / 60000000.0) - duty_minutes) > 1"),
        ("CR-004", "error", "crew_disruption_reason", "crew_disruption_flag AND crew_disruption_reason IS NULL"),
        (
            "CR-005",
            "warning",
            "crew_disruption_reason",
            "NOT crew_disruption_flag AND crew_disruption_reason IS NOT NULL",
        ),
        ("REL-011", "error", "flight_id", "fid IS NULL"),
    ],
)


@query("row_rules_crew_operations", SQL_FINDINGS["crew_operations"])
def row_rules_crew_operations(t: Tables) -> DataFrame:
    tables = typed_tables(t)
    joined = R.with_flight(tables["crew_operations"], tables["flight_schedule"])
    return short(rule_findings(joined, "crew_operations", R.crew_rules()))


sql_part(
    "delay_x",
    """SELECT d.*, f.flight_id AS fid, epoch_us(actual_departure_utc) AS dep_us, epoch_us(actual_arrival_utc) AS arr_us,
              (epoch_us(actual_departure_utc) - epoch_us(f.scheduled_departure_utc)) / 60000000.0 AS seen,
              CASE WHEN departure_delay_minutes < 0 THEN 'early' WHEN departure_delay_minutes < 15 THEN 'on_time' WHEN departure_delay_minutes < 45 THEN 'minor' WHEN departure_delay_minutes < 90 THEN 'moderate' ELSE 'major' END AS cat,
              diversion_airport IN (SELECT origin_airport FROM flight_schedule UNION SELECT destination_airport FROM flight_schedule) AS div_known
       FROM delay_history d LEFT JOIN flight_schedule f ON f.flight_id = d.flight_id""",
)
SQL_FINDINGS["delay_history"] = rule_sql(
    "delay_history",
    "delay_x",
    [
        ("DH-002", "error", "cancelled_flag", "cancelled_flag AND (dep_us IS NOT NULL OR arr_us IS NOT NULL)"),
        ("DH-003", "error", "actual_departure_utc", "NOT cancelled_flag AND (dep_us IS NULL OR arr_us IS NULL)"),
        ("DH-004", "error", "actual_arrival_utc", "arr_us <= dep_us"),
        ("DH-005", "error", "departure_delay_minutes", "abs(round(seen) - departure_delay_minutes) > 1"),
        ("DH-007", "error", "delay_category", "cat <> delay_category"),
        ("DH-008", "error", "diversion_airport", "diverted_flag AND diversion_airport IS NULL"),
        ("DH-009", "error", "diversion_airport", "NOT diverted_flag AND diversion_airport IS NOT NULL"),
        ("DH-010", "error", "departure_delay_minutes", "round(seen) < -15"),
        ("DH-011", "error", "diversion_airport", "diversion_airport IS NOT NULL AND NOT div_known"),
        ("REL-012", "error", "flight_id", "fid IS NULL"),
    ],
)


def delays_with_links(t: Tables) -> DataFrame:
    tables = typed_tables(t)
    flights = tables["flight_schedule"]
    joined = R.with_flight(tables["delay_history"], flights)
    return R.member_flag(joined, "diversion_airport", R.schedule_airports(flights), "code", "diversion_known")


@query("row_rules_delay_history", SQL_FINDINGS["delay_history"])
def row_rules_delay_history(t: Tables) -> DataFrame:
    return short(rule_findings(delays_with_links(t), "delay_history", R.delay_rules()))


# ---------------------------------------------------------------- ordered rules, keys, links

SQL_OVERLAP = """SELECT 'flight_schedule' AS dataset, 'FS-010' AS rule_id, 'aircraft_id' AS field_name, 'error' AS severity, flight_n AS row_number FROM (
  SELECT flight_n, scheduled_departure_utc, last_value(scheduled_arrival_utc IGNORE NULLS) OVER (PARTITION BY aircraft_id ORDER BY scheduled_departure_utc, flight_n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM flight_schedule)
WHERE scheduled_departure_utc < prev"""
SQL_CURVE = """SELECT 'passenger_demand' AS dataset, 'PD-011' AS rule_id, 'booked_passengers' AS field_name, 'warning' AS severity, row_key AS row_number FROM (
  SELECT row_key, booked_passengers, cancellations_to_date, lag(booked_passengers) OVER (PARTITION BY flight_id ORDER BY days_before_departure DESC, row_key) AS prev FROM passenger_demand)
WHERE prev > booked_passengers + cancellations_to_date + 5"""


@query("overlap_check", SQL_OVERLAP.replace("SELECT 'flight_schedule' AS dataset, 'FS-010' AS rule_id, 'aircraft_id' AS field_name, 'error' AS severity, flight_n AS row_number", "SELECT flight_n AS row_number, epoch_us(prev) AS previous_arrival"))
def overlap_check(t: Tables) -> DataFrame:
    found = R.overlap_check(typed_tables(t)["flight_schedule"])
    return found.select("row_number", F.unix_micros("previous_arrival").alias("previous_arrival"))


@query("curve_monotonic_check", SQL_CURVE.replace("SELECT 'passenger_demand' AS dataset, 'PD-011' AS rule_id, 'booked_passengers' AS field_name, 'warning' AS severity, row_key AS row_number", "SELECT row_key AS row_number, cast(prev AS double) AS previous_booked"))
def curve_monotonic_check(t: Tables) -> DataFrame:
    return R.curve_monotonic_check(typed_tables(t)["passenger_demand"]).select("row_number", "previous_booked")


SQL_PK = {
    "passenger_demand": ("PD", "flight_id, observation_date", "row_key"),
    "weather_events": ("WE", "weather_event_id", "row_key"),
    "airport_events": ("AE", "airport_event_id", "row_key"),
    "crew_operations": ("CR", "crew_assignment_id", "row_key"),
    "flight_schedule": ("FS", "flight_id", "flight_n"),
    "delay_history": ("DH", "flight_id", "row_key"),
    "aircraft_health": ("AH", "telemetry_id", "row_key"),
}


def pk_sql(dataset: str) -> str:
    prefix, keys, row = SQL_PK[dataset]
    return f"""SELECT '{dataset}' AS dataset, '{prefix}-PK-DUP' AS rule_id, '{keys.replace(", ", ",")}' AS field_name, 'error' AS severity, row_number FROM (
      SELECT {row} AS row_number, row_number() OVER (PARTITION BY {keys} ORDER BY {row}) AS rn FROM {dataset}) WHERE rn > 1"""


SQL_ALL_PK = "\nUNION ALL ".join(pk_sql(name) for name in SQL_PK)


@query("pk_duplicates", SQL_ALL_PK)
def pk_duplicates(t: Tables) -> DataFrame:
    return short(R.all_pk_findings(typed_tables(t)))


@query(
    "pk_null",
    """SELECT row_number, 'SM-PK-NULL' AS rule_id FROM parsed_rows WHERE code IS NULL
       UNION ALL SELECT row_number, 'SM-PK-DUP' FROM (SELECT row_number, row_number() OVER (PARTITION BY coalesce(code, '') ORDER BY row_number) AS rn FROM parsed_rows) WHERE rn > 1""",
)
def pk_null(t: Tables) -> DataFrame:
    rows = N.normalize(t.sql("SELECT * FROM raw_rows", _parts()), RAW_CONTRACT)
    return R.pk_findings(rows, RAW_CONTRACT).select("row_number", "rule_id")


@query(
    "fk_check",
    """SELECT flight_n AS row_number, route_id FROM flight_schedule WHERE route_id NOT IN (SELECT route_id FROM dim_routes)""",
)
def fk_check(t: Tables) -> DataFrame:
    missing = R.fk_check(t.flight_schedule, "route_id", t.dim_routes, "route_id")
    return missing.select(F.col("flight_n").alias("row_number"), "route_id")


SQL_COVERAGE = "\nUNION ALL ".join(
    f"SELECT '{d}' AS dataset, '{r}' AS rule_id, flight_id AS observed_value FROM (SELECT flight_id FROM flight_schedule EXCEPT SELECT flight_id FROM {d})"
    for d, r in R.COVERAGE_RULES
)


@query("coverage_check", SQL_COVERAGE)
def coverage_check(t: Tables) -> DataFrame:
    return R.coverage_findings(typed_tables(t)).select("dataset", "rule_id", "observed_value")


@query(
    "join_reference_dims",
    """SELECT flight_n AS row_number, CASE WHEN rr IS NULL THEN 'no' ELSE 'yes' END AS route_known, CASE WHEN fa IS NULL THEN 'no' ELSE 'yes' END AS aircraft_known, coalesce(ft, '-') AS fleet_type, coalesce(fc, 0) AS fleet_capacity FROM schedule_x""",
)
def join_reference_dims(t: Tables) -> DataFrame:
    rows = R.enrich_schedule(t.flight_schedule, t.dim_airports, t.dim_routes, t.dim_fleet)

    def yes(c: str):
        return F.when(F.col(c), "yes").otherwise("no")

    return rows.select(
        F.col("flight_n").alias("row_number"),
        yes("route_known").alias("route_known"),
        yes("aircraft_known").alias("aircraft_known"),
        F.coalesce("fleet_type", F.lit("-")).alias("fleet_type"),
        F.coalesce("fleet_capacity", F.lit(0)).alias("fleet_capacity"),
    )


# ---------------------------------------------------------------- all findings and what follows from them

sql_part(
    "finding_rows",
    "\nUNION ALL ".join([*SQL_FINDINGS.values(), SQL_OVERLAP, SQL_CURVE, SQL_ALL_PK]),
)
sql_part("coverage_rows", SQL_COVERAGE)
sql_part(
    "all_severities",
    "SELECT dataset, rule_id, severity, row_number FROM finding_rows UNION ALL SELECT dataset, rule_id, 'error', NULL FROM coverage_rows",
)
sql_part("bad_rows", "SELECT DISTINCT dataset, row_number FROM finding_rows WHERE severity IN ('error', 'fatal')")
sql_part(
    "table_counts",
    "\nUNION ALL ".join(f"SELECT '{name}' AS dataset, count(*) AS row_count FROM {name}" for name in C.CONTRACTS),
)


@query("count_rows", "SELECT dataset, row_count FROM table_counts")
def count_rows(t: Tables) -> DataFrame:
    return Q.source_counts(typed_tables(t))


@query(
    "manifest_checks",
    """SELECT dataset, 'MAN-ROWCOUNT' AS rule_id, 'fatal' AS severity, cast(row_count AS varchar) AS observed_value FROM table_counts WHERE dataset IN ('crew_operations', 'delay_history') AND row_count <> (SELECT count(*) FROM orders)
       UNION ALL SELECT dataset, 'MAN-CHECKSUM-WARN', 'warning', cast(row_count AS varchar) FROM table_counts""",
)
def manifest_checks(t: Tables) -> DataFrame:
    declared = t.base("orders").agg(F.count(F.lit(1)).alias("expected_rows")).select(
        F.explode(F.array(F.lit("crew_operations"), F.lit("delay_history"))).alias("dataset"), "expected_rows"
    )
    counts = Q.source_counts(typed_tables(t))
    found = R.table_count_findings(counts, declared, checksums_verified=False)
    return found.select("dataset", "rule_id", "severity", "observed_value")


@query("row_rules", "SELECT dataset, rule_id, severity, count(*) AS finding_count FROM all_severities GROUP BY ALL")
def row_rules(t: Tables) -> DataFrame:
    return all_findings(t).groupBy("dataset", "rule_id", "severity").agg(F.count(F.lit(1)).alias("finding_count"))


@query("severity_counts", "SELECT severity, (SELECT count(*) FROM all_severities a WHERE a.severity = v.severity) AS finding_count FROM (VALUES ('info'), ('warning'), ('error'), ('fatal')) AS v(severity)")
def severity_counts(t: Tables) -> DataFrame:
    return Q.severity_counts(stored_marks(t))


@query("overall_status", "SELECT CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'failed' ELSE 'passed' END AS overall_status FROM all_severities")
def overall_status(t: Tables) -> DataFrame:
    return Q.overall_status(Q.severity_counts(stored_marks(t)))


@query(
    "split_valid_quarantined",
    """SELECT 'quarantined' AS outcome, row_key AS row_number FROM passenger_demand WHERE row_key IN (SELECT row_number FROM bad_rows WHERE dataset = 'passenger_demand')
       UNION ALL SELECT 'valid', row_key FROM passenger_demand WHERE row_key NOT IN (SELECT row_number FROM bad_rows WHERE dataset = 'passenger_demand')""",
)
def split_valid_quarantined(t: Tables) -> DataFrame:
    valid, bad = Q.split_valid_quarantined(
        typed_tables(t)["passenger_demand"], stored_marks(t, "passenger_demand"), "passenger_demand"
    )
    return bad.select(F.lit("quarantined").alias("outcome"), "row_number").unionByName(
        valid.select(F.lit("valid").alias("outcome"), "row_number")
    )


@query(
    "write_quarantine",
    """SELECT d.row_key AS source_row_number, d.flight_id AS primary_identifier, string_agg(rule_id, '|' ORDER BY rule_id) AS failed_rule_ids,
              CASE WHEN bool_or(severity = 'warning') THEN 'error|warning' ELSE 'error' END AS severities
       FROM delay_history d JOIN finding_rows f ON f.dataset = 'delay_history' AND f.row_number = d.row_key
       GROUP BY ALL HAVING bool_or(severity = 'error')""",
)
def write_quarantine(t: Tables) -> DataFrame:
    findings = t.written_stage("delay_findings", delay_findings)
    _, bad = Q.split_valid_quarantined(typed_tables(t)["delay_history"], findings, "delay_history")
    records = Q.quarantine_records(bad, findings, C.DELAY_HISTORY)
    return records.select(
        "source_row_number",
        "primary_identifier",
        F.array_join("failed_rule_ids", "|").alias("failed_rule_ids"),
        F.array_join("severities", "|").alias("severities"),
    )


sql_part(
    "dataset_quality",
    """SELECT c.dataset, cast(row_count AS double) AS n, cast((SELECT count(*) FROM bad_rows b WHERE b.dataset = c.dataset) AS double) AS bad,
              (SELECT count(*) FROM all_severities a WHERE a.dataset = c.dataset AND severity = 'error' AND row_number IS NOT NULL) AS errors,
              cast((SELECT count(*) FROM all_severities a WHERE a.dataset = c.dataset AND severity = 'warning') AS double) AS warnings,
              cast((SELECT count(*) FROM all_severities a WHERE a.dataset = c.dataset AND row_number IS NULL) AS double) AS table_failures
       FROM table_counts c""",
)


@query(
    "quality_metrics",
    """SELECT dataset, 'completeness' AS quality_dimension, 'source_rows' AS metric_name, n AS metric_value, n AS denominator, 'passed' AS status FROM dataset_quality
       UNION ALL SELECT dataset, 'validity', 'valid_rows', n - bad, n, CASE WHEN errors = 0 THEN 'passed' ELSE 'failed' END FROM dataset_quality
       UNION ALL SELECT dataset, 'validity', 'quarantined_rows', bad, n, CASE WHEN bad / n <= 0.05 THEN 'passed' ELSE 'failed' END FROM dataset_quality
       UNION ALL SELECT dataset, 'integrity', 'dataset_level_failures', table_failures, 1.0, CASE WHEN table_failures = 0 THEN 'passed' ELSE 'failed' END FROM dataset_quality
       UNION ALL SELECT dataset, 'conformity', 'warning_count', warnings, n, 'passed' FROM dataset_quality""",
)
def quality_metrics(t: Tables) -> DataFrame:
    metrics = Q.quality_metrics(Q.source_counts(typed_tables(t)), stored_marks(t))
    return metrics.select("dataset", "quality_dimension", "metric_name", "metric_value", "denominator", "status")


@query(
    "rule_summary",
    """SELECT dataset, count(*) FILTER (severity = 'warning') AS warning_count, count(*) FILTER (severity = 'error') AS error_count, string_agg(DISTINCT rule_id, '|' ORDER BY rule_id) AS rules_failed FROM all_severities GROUP BY dataset""",
)
def rule_summary(t: Tables) -> DataFrame:
    return Q.rule_summary(stored_findings(t))


@query(
    "delay_category",
    """SELECT cat AS delay_category, count(*) AS flights FROM delay_x GROUP BY cat""",
)
def delay_category_counts(t: Tables) -> DataFrame:
    return t.delay_history.groupBy(delay_category("departure_delay_minutes").alias("delay_category")).agg(
        F.count(F.lit(1)).alias("flights")
    )


@query(
    "select_columns",
    """SELECT flight_id, departure_delay_minutes AS delay_minutes, CASE WHEN cancelled_flag THEN 'yes' ELSE 'no' END AS cancelled FROM delay_history""",
)
def select_columns(t: Tables) -> DataFrame:
    return t.delay_history.withColumnRenamed("departure_delay_minutes", "delay_minutes").select(
        "flight_id", "delay_minutes", F.when(F.col("cancelled_flag"), "yes").otherwise("no").alias("cancelled")
    )
