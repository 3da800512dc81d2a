"""Column functions: signed seconds, bounded values that keep nulls, keys, bands, flags, distances.

Nulls stay nulls and no function makes NaN: Spark sorts NaN above all numbers and ``greatest`` skips nulls, so
every bound is guarded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
KM_PER_DEGREE = 111.195

#: Weather code patterns of the flags, of visible moisture, and of icing at any temperature.
WEATHER_PATTERNS = {"precip": "RA|DZ|SN|SG|PL|GR|GS", "freezing": "FZ", "snow": "SN|SG|PL", "fog": "FG"}
MOISTURE, FROZEN = "RA|DZ|SN|SG|PL|GR|GS|FZ|BR|FG", "FZ|SN|SG|PL"
#: Cloud covers that make a ceiling, and the height of none.
CEILING_COVERS, NO_CEILING_FT = ("BKN", "OVC", "VV"), 99999.0


def micros(timestamp: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (UTC session)."""
    return F.unix_micros(timestamp.cast("timestamp"))


def seconds_between(end: Column, start: Column) -> Column:
    """Whole signed seconds from start to end, truncated toward zero."""
    return F.timestamp_diff("SECOND", start.cast("timestamp"), end.cast("timestamp"))


def clip(value: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """value within [low, high]; a null value stays null and a null bound doesn't bound."""
    out = value
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(value.isNotNull(), out)


def round_half_even(value: Column) -> Column:
    """Whole numbers, halves to the even neighbour."""
    return F.bround(value, 0)


def calendar(timestamp: Column) -> dict[str, Column]:
    """hour, weekday (Monday 1), month and day_of_year."""
    t = timestamp.cast("timestamp")
    return {"hour": F.hour(t), "weekday": F.weekday(t) + 1, "month": F.month(t), "day_of_year": F.dayofyear(t)}


def composite_key(*parts: Column) -> Column:
    """Parts joined by a pipe; null if any of them is."""
    out = [parts[0].cast("string")]
    for p in parts[1:]:
        out += [F.lit("|"), p.cast("string")]
    return F.concat(*out)


def stand_group(stand: Column) -> Column:
    """A stand's neighbourhood: without its last character, or the first one of names under three."""
    n = F.length(stand)
    return F.when(n >= 3, F.substring(stand, F.lit(1), n - 1)).otherwise(F.substring(stand, 1, 1))


def aerodrome(is_departure: Column, origin: Column, destination: Column) -> Column:
    """Where a movement happens."""
    return F.when(is_departure, origin).otherwise(destination)


def missing_flags(**columns: Column) -> dict[str, Column]:
    """1 where a column is null, 0 elsewhere, as no_<name>."""
    return {f"no_{name}": c.isNull().cast("int") for name, c in columns.items()}


def within(a: Column, b: Column, tolerance: float) -> Column:
    """|a - b| <= tolerance, false where unknown."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def digitize(value: Column, edges: Sequence[float]) -> Column:
    """How many edges are at or below value: bands [edge, next edge). Null as 0."""
    return F.when(value.isNull(), F.lit(0)).otherwise(sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))).cast("int")


def band_above(value: Column, edges: Sequence[float]) -> Column:
    """The lower edge of the band (edge, next edge] that holds value, null outside."""
    out = F.lit(None).cast("double")
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        out = F.when((value > low) & (value <= high), F.lit(float(low))).otherwise(out)
    return out


def lenient_number(text: Column) -> Column:
    """A number, or null where the text isn't one; ``M`` and ``null`` are missing."""
    t = F.trim(text)
    return F.when(~t.isin("M", "null"), t).try_cast("double")


def weather_flags(codes: Column) -> dict[str, Column]:
    """0/1 flags of a weather code text; a null text has none."""
    return {name: F.coalesce(codes.rlike(p), F.lit(False)).cast("int") for name, p in WEATHER_PATTERNS.items()}


def ceiling_ft(cover: Column, height: Column) -> Column:
    """The cloud base where the cover makes a ceiling, else none."""
    return F.when(cover.isin(*CEILING_COVERS), height).otherwise(F.lit(NO_CEILING_FT))


def icing_risk(temperature: Column, spread: Column, codes: Column, below_c: float = 3.0, least_spread: float = 2.0) -> Column:
    """0/1: cold with visible moisture or a small dewpoint spread, or frozen precipitation at all.

    Three-valued: null where the missing numbers would decide.
    """
    known = F.coalesce(codes, F.lit(""))
    return (((temperature <= below_c) & (known.rlike(MOISTURE) | (spread <= least_spread))) | known.rlike(FROZEN)).cast("int")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    h = F.sin((F.radians(lat2) - F.radians(lat1)) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(h))


def nearest_quantile(values: Column, q: float) -> Column:
    """The value at the rounded rank (n - 1) * q of the sorted non-null values of an array."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.when(F.size(s) > 0, F.element_at(s, (F.round((F.size(s) - 1) * F.lit(q)) + 1).cast("int")))


def array_median(values: Column) -> Column:
    """The median of an array without nulls; null if empty."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.element_at(s, low) + F.element_at(s, high)) / 2)


def wake(text: Column) -> Column:
    """A wake category L, M, H or J in either case, else null."""
    u = F.upper(text)
    return F.when(u.isin("L", "M", "H", "J"), u)
