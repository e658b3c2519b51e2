"""Scalar expressions: bounds, bands, ranks, keys and parsing. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key fragments whose map values are hidden.
SENSITIVE_KEY_PARTS = ("name", "email", "phone", "address", "passport", "employee")

# Upper edge (exclusive) and label of each delay category; the last has no edge.
DELAY_CATEGORIES = ((0, "early"), (15, "on_time"), (45, "minor"), (90, "moderate"), (None, "major"))
TIME_BANDS = ((6, "overnight"), (12, "morning"), (18, "afternoon"), (None, "evening"))
LOAD_FACTOR_BANDS = ((0.75, "low"), (0.9, "medium"), (None, "high"))


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clamp01(value: Column | str) -> Column:
    """Bound a number to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), as_col(value)))


def nz(value: Column | str, default: float = 0.0) -> Column:
    """Number with a default for null."""
    return F.coalesce(as_col(value).cast("double"), F.lit(default))


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient, or zero when the denominator is zero or missing."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def truthy(value: Column | str, accepted: Sequence[str] = ("true", "1", "yes")) -> Column:
    """Boolean reading of loosely typed text; anything unknown or null is false."""
    return F.coalesce(F.lower(as_col(value).cast("string")).isin(*accepted), F.lit(False))


def band_case(value: Column | str, bands: Sequence[tuple[float, float, str]]) -> Column:
    """Label by inclusive [min, max] bands sorted by min: the first match wins, no match takes the last label."""
    ordered = sorted(bands, key=lambda band: band[0])
    number = as_col(value)
    expr: Column | None = None
    for low, high, label in ordered:
        hit = number.between(F.lit(float(low)), F.lit(float(high)))
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    assert expr is not None
    return expr.otherwise(ordered[-1][2])


def band_threshold(value: Column | str, thresholds: Sequence[tuple[float, str]], default: str) -> Column:
    """Label by the highest threshold reached."""
    number = as_col(value)
    expr: Column | None = None
    for edge, label in sorted(thresholds, key=lambda item: -item[0]):
        expr = F.when(number >= edge, label) if expr is None else expr.when(number >= edge, label)
    assert expr is not None
    return expr.otherwise(default)


def upper_edge_case(value: Column | str, edges: Sequence[tuple[float | None, str]]) -> Column:
    """Label by exclusive upper edges in ascending order; the entry without an edge is the rest."""
    number = as_col(value)
    expr: Column | None = None
    rest = ""
    for edge, label in edges:
        if edge is None:
            rest = label
        else:
            expr = F.when(number < edge, label) if expr is None else expr.when(number < edge, label)
    assert expr is not None
    return expr.otherwise(rest)


def delay_category(minutes: Column | str) -> Column:
    return upper_edge_case(minutes, DELAY_CATEGORIES)


def time_band(hour: Column | str) -> Column:
    return upper_edge_case(hour, TIME_BANDS)


def load_factor_band(target: Column | str, capacity: Column | str) -> Column:
    return upper_edge_case(F.try_divide(as_col(target).cast("double"), as_col(capacity)), LOAD_FACTOR_BANDS)


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed minutes as a double."""
    return (F.unix_micros(as_col(end)) - F.unix_micros(as_col(start))) / F.lit(60_000_000.0)


def shift_minutes(ts: Column | str, minutes: int) -> Column:
    return as_col(ts) + F.expr(f"make_dt_interval(0, 0, {int(minutes)}, 0)")


def sha_id(prefix: str, parts: Sequence[Column], length: int, upper: bool = True) -> Column:
    """Deterministic identifier: prefix plus the head of the SHA-256 of pipe-joined parts."""
    joined = F.concat_ws("|", *[F.coalesce(part.cast("string"), F.lit("None")) for part in parts])
    digest = F.substring(F.sha2(joined, 256), 1, length)
    return F.concat(F.lit(prefix), F.upper(digest) if upper else digest)


def surrogate_key(kind: str, value: Column | str, prefix: str = "SK") -> Column:
    """Dimension key: prefix, kind and the value with blanks and dashes as underscores."""
    return F.concat(F.lit(f"{prefix}_{kind}_"), F.translate(as_col(value).cast("string"), " -", "__"))


def redact_fields(fields: Column | str, parts: Sequence[str] = SENSITIVE_KEY_PARTS) -> Column:
    """Hide map values whose key looks personal."""
    pattern = "|".join(parts)
    return F.transform_values(
        as_col(fields), lambda k, v: F.when(F.lower(k).rlike(pattern), F.lit("[REDACTED]")).otherwise(v)
    )


def array_rank(values: Mapping[str, Column], labels: Mapping[str, str]) -> Column:
    """Labels of the positive values, largest first, ties by name."""
    entries = [
        F.struct((-value).alias("nv"), F.lit(name).alias("name"), F.lit(labels[name]).alias("label"))
        for name, value in sorted(values.items())
    ]
    positive = F.filter(F.array(*entries), lambda item: item["nv"] < 0)
    return F.transform(F.array_sort(positive), lambda item: item["label"])


def rank_of(label: Column | str, order: Sequence[str]) -> Column:
    """Position of a label in an explicit order; unknown labels rank lowest."""
    mapping = F.create_map(*[F.lit(x) for i, name in enumerate(order) for x in (name, i)])
    return F.coalesce(F.try_element_at(mapping, as_col(label)), F.lit(0))


def highest_by_order(label: Column | str, order: Sequence[str]) -> Column:
    """Aggregate: the label with the highest rank in an explicit order."""
    column = as_col(label)
    return F.max_by(column, F.struct(rank_of(column, order), column))


def dot(values: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted sum in the order of the weights."""
    return reduce(lambda a, b: a + b, [values[name] * F.lit(float(weight)) for name, weight in weights.items()])


def round_half_even(value: Column | str) -> Column:
    """Nearest whole number, halves to even."""
    return F.bround(as_col(value), 0)


def round6(value: Column | str) -> Column:
    """Six decimals; a nudge far below them keeps float noise from flipping half-way values."""
    return F.round(as_col(value) + F.lit(1e-10), 6)
