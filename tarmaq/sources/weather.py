"""Weather reports from CSV: all columns as text, lenient casts, derived conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.functions import scalar
from tarmaq.operators.temporal import asof, window_aggregates

COLUMNS = ("station", "valid", "tmpc", "dwpc", "vsby", "wxcodes", "sknt", "gust", "skyl1", "skyc1")
HOUR = 3_600_000_000
FEATURES = ("wx_temp_c", "wx_dewpoint_spread_c", "wx_visibility_mi", "wx_wind_kt", "wx_gust_kt", "wx_ceiling_ft", "wx_precip", "wx_freezing", "wx_snow", "wx_fog", "wx_icing_risk", "wx_icing_hours_6h")


def scan_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """Raw reports; ``M`` and ``null`` are missing values."""
    raw = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in COLUMNS)).csv(pattern)
    return raw.select(*[F.when(~F.trim(c).isin("M", "null"), F.trim(c)).alias(c) for c in COLUMNS])


def conditions(raw: DataFrame) -> DataFrame:
    """One row per report with a readable time: wx_time (microseconds) and the derived columns."""
    number = {c: scalar.lenient_number(F.col(c)) for c in ("tmpc", "dwpc", "vsby", "sknt", "gust", "skyl1")}
    spread = number["tmpc"] - number["dwpc"]
    flags = scalar.weather_flags(F.col("wxcodes"))
    out = raw.select(
        "station",
        F.unix_micros(F.try_to_timestamp("valid", F.lit("yyyy-MM-dd HH:mm"))).alias("wx_time"),
        number["tmpc"].alias("wx_temp_c"), spread.alias("wx_dewpoint_spread_c"), number["vsby"].alias("wx_visibility_mi"),
        number["sknt"].alias("wx_wind_kt"), number["gust"].alias("wx_gust_kt"), scalar.ceiling_ft(F.col("skyc1"), number["skyl1"]).alias("wx_ceiling_ft"),
        *[c.alias(f"wx_{n}") for n, c in flags.items()],
        scalar.icing_risk(number["tmpc"], spread, F.col("wxcodes")).alias("wx_icing_risk"),
    ).where("wx_time IS NOT NULL")
    return window_aggregates(out, "station", "wx_time", {"wx_icing_hours_6h": (-6 * HOUR + 1, 0, F.avg("wx_icing_risk"))}, 10 * 24 * HOUR)


def join_weather(departures: DataFrame, weather: DataFrame, airport: str, t: str) -> DataFrame:
    """departures with the latest report of their airport within the two hours before t (microseconds)."""
    return asof(departures, weather, airport, t, "wx_time", {c: F.col(c) for c in FEATURES}, 10 * 24 * HOUR, tolerance=2 * HOUR) if airport == "station" else asof(departures, weather.withColumnRenamed("station", airport), airport, t, "wx_time", {c: F.col(c) for c in FEATURES}, 10 * 24 * HOUR, tolerance=2 * HOUR)
