"""The rule catalogue: keys, single-row rules, rules against linked tables, ordered rules and coverage."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions.columns import delay_category, minutes_between
from contrail.operators.findings import COLUMNS, MARKS, Rule, record_identifier, row_marks, rule_findings, table_findings, union_all
from contrail.operators.picks import pick_last
from contrail.operators.running import hour_bin, prefix_aggregates
from contrail.sources.contracts import CONTRACTS, DatasetContract

SENSORS = (
    "engine_1_vibration",
    "engine_2_vibration",
    "engine_1_temperature_c",
    "engine_2_temperature_c",
    "hydraulic_pressure_psi",
    "oil_pressure_psi",
    "fuel_flow_kg_h",
    "brake_temperature_c",
)
FAR_FUTURE = "9999-12-31 00:00:00"


@dataclass(frozen=True)
class RuleSettings:
    """Tolerances of the rules. Fixed default values."""

    timestamp_tolerance_minutes: int = 30
    overbooking_tolerance: float = 1.08
    booking_velocity_max: float = 20.0
    temperature_min_c: float = -60.0
    temperature_max_c: float = 55.0
    early_departure_allowance_minutes: int = 15
    booking_drop_allowance: int = 5
    max_invalid_rate: float = 0.05


DEFAULTS = RuleSettings()


def _n(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


# ---------------------------------------------------------------- keys


def pk_findings(df: DataFrame, contract: DatasetContract, row: str = "row_number", *, marks: bool = False) -> DataFrame:
    """Blank key parts, and every occurrence of a key after its first in source order; with ``marks`` only their MARKS.

    Repeated keys are found by a map-side combined minimum, so a key shared by very many rows never sits in one task.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in contract.primary_key]
    keyed = df.withColumns({f"_pk{i}": part for i, part in enumerate(parts)})
    names = [f"_pk{i}" for i in range(len(parts))]
    repeated = (
        keyed.groupBy(*names)
        .agg(F.min(row).alias("_first_row"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .drop("_n")
    )
    joined = keyed.join(repeated, names, "left")
    shown = F.concat_ws("|", *[F.col(n) for n in names])
    blank = F.lit(False)
    for name in names:
        blank = blank | (F.col(name) == "")
    if marks:
        failed = [F.when(blank, "error"), F.when(F.col(row) > F.col("_first_row"), "error")]
        return row_marks(joined, contract.name, failed, row)
    field = F.lit(",".join(contract.primary_key))
    entries = [
        F.when(blank, _pk_entry(f"{contract.prefix}-PK-NULL", field, "Primary key is null or blank: ", shown)),
        F.when(
            F.col(row) > F.col("_first_row"),
            _pk_entry(f"{contract.prefix}-PK-DUP", field, "Duplicate primary key: ", shown),
        ),
    ]
    return (
        joined.select(
            F.lit(contract.name).alias("dataset"),
            F.col(row).alias("row_number"),
            record_identifier(df).alias("record_identifier"),
            F.explode(F.array_compact(F.array(*entries))).alias("_f"),
        )
        .select("dataset", "row_number", "record_identifier", "_f.*", F.lit(True).alias("quarantinable"))
        .select(*COLUMNS)
    )


def _pk_entry(rule_id: str, field: Column, text: str, shown: Column) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        field.alias("field_name"),
        F.lit("error").alias("severity"),
        F.lit("uniqueness").alias("category"),
        F.concat(F.lit(text), shown, F.lit(".")).alias("message"),
        shown.alias("observed_value"),
        F.lit("primary key is populated and unique").alias("expected_condition"),
    )


# ---------------------------------------------------------------- links


def member_flag(df: DataFrame, column: str, parent: DataFrame, parent_key: str, flag: str) -> DataFrame:
    """Mark rows whose value exists in the parent; a null value does not."""
    keys = parent.select(F.col(parent_key).alias("_parent_key")).distinct()
    joined = df.join(keys, F.col(column) == F.col("_parent_key"), "left")
    return joined.withColumn(flag, F.col("_parent_key").isNotNull()).drop("_parent_key")


def fk_check(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference does not resolve, null references included."""
    keys = parent.select(F.col(parent_key).alias("_parent_key")).distinct()
    return df.join(keys, F.col(column) == F.col("_parent_key"), "left_anti")


def coverage_check(parent: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    """Distinct parents without any child row."""
    keys = child.select(F.col(child_key).alias("_child_key")).distinct()
    return parent.select(key).distinct().join(keys, F.col(key) == F.col("_child_key"), "left_anti")


def linked_flights(flights: DataFrame, row: str = "row_number") -> DataFrame:
    """One row per flight id for lookups; of repeated ids the last source row counts."""
    columns = [
        "route_id",
        "seat_capacity",
        "scheduled_departure_utc",
        "scheduled_arrival_utc",
        "aircraft_id",
    ]
    picked = pick_last(flights, ["flight_id"], [F.col(row)], columns)
    return picked.select("flight_id", *[F.col(c).alias(f"flight_{c}") for c in columns], F.lit(True).alias("flight_known"))


def enrich_schedule(flights: DataFrame, airports: DataFrame, routes: DataFrame, fleet: DataFrame) -> DataFrame:
    """Schedule rows with what the reference tables say about their airports, route and aircraft."""
    known_routes = routes.select(
        F.col("route_id"),
        F.col("origin").alias("route_origin"),
        F.col("destination").alias("route_destination"),
        F.lit(True).alias("route_known"),
    )
    known_fleet = fleet.select(
        "aircraft_id",
        F.col("aircraft_type").alias("fleet_type"),
        F.col("seat_capacity").alias("fleet_capacity"),
        F.lit(True).alias("aircraft_known"),
    )
    df = member_flag(flights, "origin_airport", airports, "code", "origin_known")
    df = member_flag(df, "destination_airport", airports, "code", "destination_known")
    return df.join(known_routes, "route_id", "left").join(known_fleet, "aircraft_id", "left")


def with_flight(child: DataFrame, flights: DataFrame) -> DataFrame:
    """Child rows with their flight's columns; ``flight_known`` is null when the flight is missing."""
    return child.join(linked_flights(flights), "flight_id", "left")


def membership_rules(prefix_rules: Sequence[tuple[str, str, str]]) -> list[Rule]:
    return [
        Rule(rule_id, "error", field, ~F.coalesce(F.col(flag), F.lit(False)), "foreign key resolves")
        for rule_id, field, flag in prefix_rules
    ]


# ---------------------------------------------------------------- schedule


def schedule_rules(settings: RuleSettings = DEFAULTS) -> list[Rule]:
    """Rules on schedule rows prepared by :func:`enrich_schedule`."""
    dep, arr = F.col("scheduled_departure_utc"), F.col("scheduled_arrival_utc")
    return [
        Rule(
            "FS-003",
            "error",
            "origin_airport",
            F.col("origin_airport").eqNullSafe(F.col("destination_airport")),
            "a flight leads to another airport than it leaves",
        ),
        Rule("FS-004", "error", "scheduled_arrival_utc", arr <= dep, "arrival follows departure"),
        Rule(
            "FS-005",
            "error",
            "origin_airport",
            ~(F.col("origin_known") & F.col("destination_known")),
            "both airports are in the airport list",
        ),
        Rule(
            "FS-006",
            "error",
            "route_id",
            F.col("route_known")
            & ~(
                F.col("route_origin").eqNullSafe(F.col("origin_airport"))
                & F.col("route_destination").eqNullSafe(F.col("destination_airport"))
            ),
            "the route's ends are the flight's ends",
        ),
        Rule(
            "FS-007",
            "error",
            "aircraft_type",
            F.col("aircraft_known") & ~F.col("fleet_type").eqNullSafe(F.col("aircraft_type")),
            "the type is the fleet's type for this aircraft",
        ),
        Rule(
            "FS-008",
            "error",
            "seat_capacity",
            F.col("aircraft_known") & (_n("seat_capacity") != F.col("fleet_capacity")),
            "seats are as many as the type has",
        ),
        Rule(
            "FS-009",
            "warning",
            "scheduled_block_minutes",
            F.abs(minutes_between(dep, arr) - _n("scheduled_block_minutes")) > settings.timestamp_tolerance_minutes,
            "block time is arrival less departure",
        ),
        *membership_rules(
            (
                ("REL-001", "origin_airport", "origin_known"),
                ("REL-002", "destination_airport", "destination_known"),
                ("REL-003", "aircraft_id", "aircraft_known"),
                ("REL-004", "route_id", "route_known"),
            )
        ),
    ]


def overlap_check(flights: DataFrame, row: str = "row_number") -> DataFrame:
    """Flights departing before the previous known arrival of the same aircraft (column ``previous_arrival``)."""
    dep = F.coalesce(F.col("scheduled_departure_utc"), F.lit(FAR_FUTURE).cast("timestamp"))
    ordered = prefix_aggregates(
        flights.filter(F.col("aircraft_id").isNotNull()),
        ["aircraft_id"],
        [dep, F.col(row)],
        {"previous_arrival": ("last", F.col("scheduled_arrival_utc"))},
        [hour_bin(dep)],
    )
    return ordered.filter(F.col("scheduled_departure_utc") < F.col("previous_arrival"))


# ---------------------------------------------------------------- demand


def demand_rules(settings: RuleSettings = DEFAULTS) -> list[Rule]:
    """Rules on demand rows joined to their flight."""
    known = F.col("flight_known")
    departure_day = F.to_date("flight_scheduled_departure_utc")
    capacity = F.coalesce(F.nullif(_n("seat_capacity"), F.lit(0.0)), F.lit(1.0))
    expected, booked = _n("expected_final_passengers"), _n("booked_passengers")
    return [
        Rule(
            "PD-003",
            "error",
            "route_id",
            known & ~F.col("route_id").eqNullSafe(F.col("flight_route_id")),
            "route is that of the flight",
        ),
        Rule(
            "PD-004",
            "error",
            "seat_capacity",
            known & ~F.col("seat_capacity").eqNullSafe(F.col("flight_seat_capacity")),
            "seats are those of the flight",
        ),
        Rule(
            "PD-005",
            "error",
            "observation_date",
            F.col("observation_date") > departure_day,
            "seen on the departure day or earlier",
        ),
        Rule(
            "PD-006",
            "error",
            "days_before_departure",
            F.datediff(departure_day, F.col("observation_date")) != F.col("days_before_departure"),
            "day count is departure day less observation day",
        ),
        Rule("PD-007", "error", "booked_passengers", booked > expected, "booked <= expected final passengers"),
        Rule(
            "PD-008",
            "error",
            "expected_final_passengers",
            expected > F.floor(capacity * settings.overbooking_tolerance),
            "expected passengers stay within the overbooking limit",
        ),
        Rule(
            "PD-009",
            "error",
            "load_factor",
            F.abs(_n("load_factor") - F.bround(expected / capacity, 4)) > 0.0001,
            "load factor is expected passengers over seats",
        ),
        Rule(
            "PD-010",
            "warning",
            "booking_velocity",
            _n("booking_velocity") > settings.booking_velocity_max,
            "bookings per day stay within the limit",
        ),
        *membership_rules((("REL-010", "flight_id", "flight_known"),)),
    ]


def curve_monotonic_check(
    demand: DataFrame, settings: RuleSettings = DEFAULTS, row: str = "row_number"
) -> DataFrame:
    """Observations booked materially below the one before them on the same flight's booking curve."""
    keyed = demand.withColumn("_closeness", -F.coalesce(F.col("days_before_departure"), F.lit(0)))
    order = Window.partitionBy("flight_id").orderBy("_closeness", row)  # a flight has few observations
    earlier = keyed.withColumn("previous_booked", F.lag(_n("booked_passengers")).over(order))
    return earlier.drop("_closeness").filter(
        F.col("previous_booked")
        > _n("booked_passengers") + _n("cancellations_to_date") + settings.booking_drop_allowance
    )


# ---------------------------------------------------------------- weather, airport events


def weather_rules(settings: RuleSettings = DEFAULTS) -> list[Rule]:
    return [
        Rule(
            "WE-002",
            "error",
            "event_end_utc",
            F.col("event_end_utc") <= F.col("event_start_utc"),
            "weather ends after it begins",
        ),
        Rule(
            "WE-006",
            "warning",
            "wind_gust_knots",
            _n("wind_gust_knots") + 2 < _n("wind_speed_knots"),
            "gusts are about as strong as the wind or stronger",
        ),
        Rule(
            "WE-008",
            "error",
            "temperature_c",
            ~_n("temperature_c").between(settings.temperature_min_c, settings.temperature_max_c),
            "temperature lies in the expected range",
        ),
        *membership_rules((("REL-005", "airport_code", "airport_known"),)),
    ]


def airport_event_rules() -> list[Rule]:
    floor = _n("severity") * 4
    return [
        Rule(
            "AE-002",
            "error",
            "event_end_utc",
            F.col("event_end_utc") <= F.col("event_start_utc"),
            "event ends after it begins",
        ),
        Rule(
            "AE-003",
            "warning",
            "severity",
            (_n("capacity_reduction_percent") < floor) | (_n("estimated_delay_minutes") < floor),
            "severity and impact point the same way",
        ),
        Rule(
            "AE-004",
            "error",
            "operational_notes",
            ~F.coalesce(F.col("operational_notes"), F.lit("")).contains("Synthetic"),
            "notes follow the template",
        ),
        *membership_rules((("REL-006", "airport_code", "airport_known"),)),
    ]


# ---------------------------------------------------------------- aircraft health


def enrich_health(health: DataFrame, flights: DataFrame, fleet: DataFrame, sensor_ranges: DataFrame) -> DataFrame:
    """Telemetry with its flight, its aircraft and the sensor ranges of its type as a map."""
    known_fleet = fleet.select(
        "aircraft_id", F.col("aircraft_type").alias("fleet_type"), F.lit(True).alias("aircraft_known")
    )
    ranges = sensor_ranges.groupBy("aircraft_type").agg(
        F.map_from_entries(
            F.collect_list(F.struct("sensor", F.struct("low", "high").alias("range")))
        ).alias("sensor_ranges")
    )
    return with_flight(health, flights).join(known_fleet, "aircraft_id", "left").join(ranges, "aircraft_type", "left")


def health_rules(settings: RuleSettings = DEFAULTS, sensors: Sequence[str] = SENSORS) -> list[Rule]:
    """Rules on telemetry prepared by :func:`enrich_health`; the sensor rule yields one finding per sensor."""
    ts = F.col("event_timestamp_utc")
    early = minutes_between(ts, "flight_scheduled_departure_utc") > 120
    late = minutes_between("flight_scheduled_arrival_utc", ts) > settings.timestamp_tolerance_minutes
    out_of_range = []
    for sensor in sensors:
        bounds = F.try_element_at(F.col("sensor_ranges"), F.lit(sensor))
        out_of_range.append(
            Rule(
                "AH-006",
                "error",
                sensor,
                (_n(sensor) < bounds["low"] * 0.8) | (_n(sensor) > bounds["high"] * 1.15),
                "reading lies in the sensor's range",
            )
        )
    return [
        Rule(
            "AH-003",
            "error",
            "aircraft_type",
            F.col("aircraft_known") & ~F.col("fleet_type").eqNullSafe(F.col("aircraft_type")),
            "the type is the fleet's type for this aircraft",
        ),
        Rule("AH-004", "error", "event_timestamp_utc", early | late, "telemetry is near linked flight"),
        Rule(
            "AH-005",
            "error",
            "aircraft_id",
            F.col("flight_known") & ts.isNotNull() & ~F.col("flight_aircraft_id").eqNullSafe(F.col("aircraft_id")),
            "reading comes from the flight's aircraft",
        ),
        *out_of_range,
        Rule(
            "AH-007",
            "warning",
            "fault_code",
            (F.col("health_status") == "review") & _blank("fault_code") & (_n("maintenance_risk_score") >= 70),
            "a status for review names its fault",
        ),
        *membership_rules((("REL-007", "aircraft_id", "aircraft_known"), ("REL-013", "flight_id", "flight_known"))),
    ]


# ---------------------------------------------------------------- crew, delays


def crew_rules() -> list[Rule]:
    start, end = F.col("duty_start_utc"), F.col("duty_end_utc")
    disrupted = F.coalesce(F.col("crew_disruption_flag"), F.lit(False))
    return [
        Rule("CR-002", "error", "duty_end_utc", end <= start, "duty end follows duty start"),
        Rule(
            "CR-003",
            "error",
            "duty_minutes",
            F.abs(F.floor(minutes_between(start, end)) - _n("duty_minutes")) > 1,
            "duty time is end less start",
        ),
        Rule(
            "CR-004",
            "error",
            "crew_disruption_reason",
            disrupted & _blank("crew_disruption_reason"),
            "a disruption has a reason",
        ),
        Rule(
            "CR-005",
            "warning",
            "crew_disruption_reason",
            ~disrupted & ~_blank("crew_disruption_reason"),
            "without disruption there is no reason",
        ),
        *membership_rules((("REL-011", "flight_id", "flight_known"),)),
    ]


def delay_rules(settings: RuleSettings = DEFAULTS) -> list[Rule]:
    """Rules on delay rows joined to their flight and to the airports of the schedule."""
    dep, arr = F.col("actual_departure_utc"), F.col("actual_arrival_utc")
    cancelled = F.coalesce(F.col("cancelled_flag"), F.lit(False))
    diverted = F.coalesce(F.col("diverted_flag"), F.lit(False))
    observed = F.bround(minutes_between("flight_scheduled_departure_utc", dep), 0)
    return [
        Rule(
            "DH-002",
            "error",
            "cancelled_flag",
            cancelled & (dep.isNotNull() | arr.isNotNull()),
            "a cancelled flight never left",
        ),
        Rule(
            "DH-003",
            "error",
            "actual_departure_utc",
            ~cancelled & (dep.isNull() | arr.isNull()),
            "a flown flight has both actual times",
        ),
        Rule("DH-004", "error", "actual_arrival_utc", arr <= dep, "actual arrival follows actual departure"),
        Rule(
            "DH-005",
            "error",
            "departure_delay_minutes",
            F.abs(observed - _n("departure_delay_minutes")) > 1,
            "delay is actual less scheduled departure",
        ),
        Rule(
            "DH-007",
            "error",
            "delay_category",
            ~delay_category(_n("departure_delay_minutes")).eqNullSafe(F.col("delay_category")),
            "category is the one of these minutes",
        ),
        Rule(
            "DH-008",
            "error",
            "diversion_airport",
            diverted & _blank("diversion_airport"),
            "a diversion names its airport",
        ),
        Rule(
            "DH-009",
            "error",
            "diversion_airport",
            ~diverted & ~_blank("diversion_airport"),
            "no diversion, no diversion airport",
        ),
        Rule(
            "DH-010",
            "error",
            "departure_delay_minutes",
            observed < -settings.early_departure_allowance_minutes,
            "no earlier than the limit allows",
        ),
        Rule(
            "DH-011",
            "error",
            "diversion_airport",
            ~_blank("diversion_airport") & ~F.col("diversion_known"),
            "diversion airport is in the airport list",
        ),
        *membership_rules((("REL-012", "flight_id", "flight_known"),)),
    ]


def schedule_airports(flights: DataFrame) -> DataFrame:
    """Distinct airports at either end of a flight."""
    return (
        flights.select(F.explode(F.array("origin_airport", "destination_airport")).alias("code"))
        .filter(F.col("code").isNotNull())
        .distinct()
    )


# ---------------------------------------------------------------- all together


def business_findings(
    tables: Mapping[str, DataFrame],
    dims: Mapping[str, DataFrame],
    settings: RuleSettings = DEFAULTS,
    *,
    datasets: Collection[str] = tuple(CONTRACTS),
    marks: bool = False,
) -> DataFrame:
    """Findings of every row, link and ordered rule over the typed tables (each with ``row_number``).

    ``datasets`` keeps the findings of some tables only, ``marks`` only their MARKS.
    """
    flights = tables["flight_schedule"]
    checked: dict[str, Callable[[], list[tuple[DataFrame, list[Rule]]]]] = {
        "flight_schedule": lambda: [
            (enrich_schedule(flights, dims["airports"], dims["routes"], dims["fleet"]), schedule_rules(settings)),
            (
                overlap_check(flights),
                [Rule("FS-010", "error", "aircraft_id", F.lit(True), "aircraft flights do not overlap")],
            ),
        ],
        "passenger_demand": lambda: [
            (with_flight(tables["passenger_demand"], flights), demand_rules(settings)),
            (
                curve_monotonic_check(tables["passenger_demand"], settings),
                [
                    Rule(
                        "PD-011",
                        "warning",
                        "booked_passengers",
                        F.lit(True),
                        "bookings never fall by more than cancellations and the allowance",
                    )
                ],
            ),
        ],
        "weather_events": lambda: [
            (
                member_flag(tables["weather_events"], "airport_code", dims["airports"], "code", "airport_known"),
                weather_rules(settings),
            )
        ],
        "aircraft_health": lambda: [
            (
                enrich_health(tables["aircraft_health"], flights, dims["fleet"], dims["sensor_ranges"]),
                health_rules(settings),
            )
        ],
        "crew_operations": lambda: [(with_flight(tables["crew_operations"], flights), crew_rules())],
        "delay_history": lambda: [
            (
                member_flag(
                    with_flight(tables["delay_history"], flights),
                    "diversion_airport",
                    schedule_airports(flights),
                    "code",
                    "diversion_known",
                ),
                delay_rules(settings),
            )
        ],
        "airport_events": lambda: [
            (
                member_flag(tables["airport_events"], "airport_code", dims["airports"], "code", "airport_known"),
                airport_event_rules(),
            )
        ],
    }
    return union_all(
        [
            rule_findings(rows, dataset, rules, marks=marks)
            for dataset, parts in checked.items()
            if dataset in datasets
            for rows, rules in parts()
        ]
    )


COVERAGE_RULES = (
    ("passenger_demand", "REL-020"),
    ("crew_operations", "REL-021"),
    ("delay_history", "REL-022"),
    ("aircraft_health", "REL-023"),
)


def coverage_findings(
    tables: Mapping[str, DataFrame], legacy: bool = False, *, datasets: Collection[str] = tuple(CONTRACTS)
) -> DataFrame:
    """Flights without required child rows, as table-level errors. ``legacy`` reports none, as these used to be lost."""
    flights = tables["flight_schedule"]
    parts = []
    for dataset, rule_id in COVERAGE_RULES:
        if dataset not in datasets:
            continue
        missing = coverage_check(flights, "flight_id", tables[dataset], "flight_id")
        parts.append(
            table_findings(
                missing,
                dataset,
                rule_id,
                "error",
                "integrity",
                F.concat(F.lit("Missing required record for flight "), F.col("flight_id"), F.lit(".")),
                F.col("flight_id"),
                "no flight lacks its record",
            )
        )
    found = union_all(parts)
    return found.filter(F.lit(False)) if legacy else found


def table_count_findings(
    counts: DataFrame,
    expected: DataFrame | None = None,
    allow_empty: bool = False,
    checksums_verified: bool = True,
) -> DataFrame:
    """Row-count, emptiness and checksum findings from (dataset, row_count) and declared (dataset, expected_rows)."""
    joined = counts if expected is None else counts.join(expected, "dataset", "left")
    declared = F.col("expected_rows") if expected is not None else F.lit(None).cast("bigint")
    entries = F.array_compact(
        F.array(
            F.when(
                declared.isNotNull() & (declared != F.col("row_count")),
                _count_entry("MAN-ROWCOUNT", "fatal", "actual row count matches the declared count"),
            ),
            F.when(
                F.lit(not allow_empty) & (F.col("row_count") == 0),
                _count_entry("MAN-NONEMPTY", "error", "dataset contains at least one record"),
            ),
            F.when(
                F.lit(not checksums_verified),
                _count_entry("MAN-CHECKSUM-WARN", "warning", "source checksums are verified"),
            ),
        )
    )
    return joined.select("dataset", F.explode(entries).alias("_e"), F.col("row_count").alias("_n")).select(
        "dataset",
        F.lit(None).cast("bigint").alias("row_number"),
        F.lit(None).cast("string").alias("record_identifier"),
        F.col("_e.rule_id").alias("rule_id"),
        F.lit(None).cast("string").alias("field_name"),
        F.col("_e.severity").alias("severity"),
        F.lit("manifest").alias("category"),
        F.concat(F.lit("Expected: "), F.col("_e.expected"), F.lit(".")).alias("message"),
        F.col("_n").cast("string").alias("observed_value"),
        F.col("_e.expected").alias("expected_condition"),
        F.lit(False).alias("quarantinable"),
    )


def _count_entry(rule_id: str, severity: str, expected: str) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(expected).alias("expected")
    )


def all_pk_findings(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([pk_findings(tables[name], contract) for name, contract in CONTRACTS.items() if name in tables])


def finding_marks(tables: Mapping[str, DataFrame], dims: Mapping[str, DataFrame], dataset: str) -> DataFrame:
    """The MARKS of all findings of one table."""
    parts = [
        business_findings(tables, dims, datasets=(dataset,), marks=True),
        pk_findings(tables[dataset], CONTRACTS[dataset], marks=True),
    ]
    if dataset in dict(COVERAGE_RULES):
        parts.append(coverage_findings(tables, datasets=(dataset,)).select(*MARKS))
    return union_all(parts)
