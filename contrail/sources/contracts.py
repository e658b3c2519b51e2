"""Declared schemas: column types, nullability, allowed values and ranges, keys and references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "json_string": T.StringType(),
}


@dataclass(frozen=True)
class FieldSpec:
    """One column: type and the values it may hold."""

    name: str
    column_type: str = "string"
    nullable: bool = False
    enum: tuple[str, ...] | None = None
    minimum: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class DatasetContract:
    """One table: file format, key and columns."""

    name: str
    prefix: str
    file_format: str
    primary_key: tuple[str, ...]
    fields: tuple[FieldSpec, ...]
    foreign_keys: tuple[tuple[str, str], ...] = field(default=())

    @property
    def field_names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields)

    @property
    def file_name(self) -> str:
        return f"{self.name}.{self.file_format}"

    def schema(self) -> T.StructType:
        """Typed schema; the constraints travel in the field metadata."""
        return T.StructType(
            [
                T.StructField(
                    f.name,
                    SPARK_TYPES[f.column_type],
                    True,
                    {
                        "nullable": f.nullable,
                        "enum": list(f.enum or ()),
                        **({"minimum": f.minimum} if f.minimum is not None else {}),
                        **({"maximum": f.maximum} if f.maximum is not None else {}),
                    },
                )
                for f in self.fields
            ]
        )


def text(name: str, *enum: str, nullable: bool = False) -> FieldSpec:
    return FieldSpec(name, "string", nullable, tuple(enum) or None)


def whole(name: str, low: float | None = None, high: float | None = None, nullable: bool = False) -> FieldSpec:
    return FieldSpec(name, "integer", nullable, None, low, high)


def number(name: str, low: float | None = None, high: float | None = None) -> FieldSpec:
    return FieldSpec(name, "number", False, None, low, high)


def flag(name: str) -> FieldSpec:
    return FieldSpec(name, "boolean")


def instant(name: str, nullable: bool = False) -> FieldSpec:
    return FieldSpec(name, "timestamp", nullable)


def day(name: str) -> FieldSpec:
    return FieldSpec(name, "date")


# The columns, types, allowed values and ranges of the seven input tables.
AIRCRAFT_TYPES = ("A320", "A321", "B737-800", "B787-9", "E190")

FLIGHT_SCHEDULE = DatasetContract(
    "flight_schedule",
    "FS",
    "csv",
    ("flight_id",),
    (
        text("flight_id"),
        text("flight_number"),
        day("operating_date"),
        instant("scheduled_departure_utc"),
        instant("scheduled_arrival_utc"),
        text("origin_airport"),
        text("destination_airport"),
        text("route_id"),
        text("aircraft_id"),
        text("aircraft_type", *AIRCRAFT_TYPES),
        whole("seat_capacity", 1),
        whole("scheduled_block_minutes", 1),
        text("departure_terminal"),
        text("arrival_terminal"),
        text("service_type", "scheduled"),
        text("schedule_status", "scheduled"),
    ),
    (
        ("origin_airport", "airports"),
        ("destination_airport", "airports"),
        ("aircraft_id", "fleet"),
        ("route_id", "routes"),
    ),
)

PASSENGER_DEMAND = DatasetContract(
    "passenger_demand",
    "PD",
    "csv",
    ("flight_id", "observation_date"),
    (
        text("flight_id"),
        day("observation_date"),
        whole("days_before_departure", 0),
        text("route_id"),
        whole("booked_passengers", 0),
        whole("expected_final_passengers", 0),
        whole("seat_capacity", 1),
        number("load_factor", 0),
        number("booking_velocity", 0),
        whole("cancellations_to_date", 0),
        whole("group_booking_count", 0),
        text("demand_segment", "business-heavy", "leisure-heavy", "balanced"),
        FieldSpec("fare_class_mix", "json_string"),
    ),
    (("flight_id", "flight_schedule"), ("route_id", "routes")),
)

WEATHER_EVENTS = DatasetContract(
    "weather_events",
    "WE",
    "csv",
    ("weather_event_id",),
    (
        text("weather_event_id"),
        text("airport_code"),
        instant("event_start_utc"),
        instant("event_end_utc"),
        text("weather_type", "clear_wind", "rain", "thunderstorm", "fog", "snow"),
        whole("severity", 1, 5),
        number("temperature_c"),
        number("wind_speed_knots", 0),
        number("wind_gust_knots", 0),
        whole("visibility_metres", 0),
        number("precipitation_mm", 0),
        number("operational_impact_score", 0, 100),
    ),
    (("airport_code", "airports"),),
)

AIRCRAFT_HEALTH = DatasetContract(
    "aircraft_health",
    "AH",
    "jsonl",
    ("telemetry_id",),
    (
        text("telemetry_id"),
        text("aircraft_id"),
        text("aircraft_type", *AIRCRAFT_TYPES),
        instant("event_timestamp_utc"),
        text("flight_id"),
        number("engine_1_vibration"),
        number("engine_2_vibration"),
        number("engine_1_temperature_c"),
        number("engine_2_temperature_c"),
        number("hydraulic_pressure_psi"),
        number("oil_pressure_psi"),
        number("fuel_flow_kg_h"),
        number("brake_temperature_c"),
        whole("cycles_since_maintenance", 0),
        number("flight_hours_since_maintenance", 0),
        text("fault_code", nullable=True),
        text("health_status", "normal", "watch", "review"),
        number("maintenance_risk_score", 0, 100),
    ),
    (("aircraft_id", "fleet"), ("flight_id", "flight_schedule")),
)

CREW_OPERATIONS = DatasetContract(
    "crew_operations",
    "CR",
    "csv",
    ("crew_assignment_id",),
    (
        text("crew_assignment_id"),
        text("flight_id"),
        text("crew_base"),
        flag("captain_available"),
        flag("first_officer_available"),
        whole("cabin_crew_required", 0),
        whole("cabin_crew_assigned", 0),
        flag("reserve_crew_used"),
        instant("duty_start_utc"),
        instant("duty_end_utc"),
        whole("duty_minutes", 0),
        whole("connection_risk_minutes", 0),
        flag("crew_disruption_flag"),
        text("crew_disruption_reason", nullable=True),
    ),
    (("flight_id", "flight_schedule"),),
)

DELAY_HISTORY = DatasetContract(
    "delay_history",
    "DH",
    "csv",
    ("flight_id",),
    (
        text("flight_id"),
        instant("actual_departure_utc", nullable=True),
        instant("actual_arrival_utc", nullable=True),
        whole("departure_delay_minutes"),
        whole("arrival_delay_minutes", nullable=True),
        text("delay_category", "early", "on_time", "minor", "moderate", "major"),
        text(
            "primary_delay_cause",
            "weather",
            "airport",
            "crew",
            "aircraft",
            "reactionary",
            "airline_operations",
            "cancelled",
        ),
        text("secondary_delay_cause", nullable=True),
        whole("taxi_out_minutes", 0, nullable=True),
        whole("taxi_in_minutes", 0, nullable=True),
        whole("airborne_minutes", 0, nullable=True),
        flag("cancelled_flag"),
        flag("diverted_flag"),
        text("diversion_airport", nullable=True),
        whole("reactionary_delay_minutes", 0),
        number("weather_impact_score", 0, 100),
        number("airport_impact_score", 0, 100),
        number("crew_impact_score", 0, 100),
        number("aircraft_impact_score", 0, 100),
    ),
    (("flight_id", "flight_schedule"), ("diversion_airport", "airports")),
)

AIRPORT_EVENTS = DatasetContract(
    "airport_events",
    "AE",
    "jsonl",
    ("airport_event_id",),
    (
        text("airport_event_id"),
        text("airport_code"),
        instant("event_start_utc"),
        instant("event_end_utc"),
        text(
            "event_type",
            "runway_restriction",
            "terminal_congestion",
            "ground_handling_shortage",
            "air_traffic_flow_restriction",
            "security_incident_simulation",
            "equipment_outage",
            "deicing_constraint",
            "baggage_system_disruption",
        ),
        whole("severity", 1, 5),
        whole("capacity_reduction_percent", 0, 100),
        text("affected_terminal"),
        text("affected_runway"),
        whole("estimated_delay_minutes", 0),
        text("event_status", "synthetic_active"),
        text("operational_notes"),
    ),
    (("airport_code", "airports"),),
)

CONTRACTS: dict[str, DatasetContract] = {
    c.name: c
    for c in (
        FLIGHT_SCHEDULE,
        PASSENGER_DEMAND,
        WEATHER_EVENTS,
        AIRCRAFT_HEALTH,
        CREW_OPERATIONS,
        DELAY_HISTORY,
        AIRPORT_EVENTS,
    )
}
