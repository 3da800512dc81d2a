"""Which runways an airport uses in a period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_with_null(c: str):
    """Distinct values, null counted as one."""
    return (F.count_distinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))).cast("long")


def configuration(departures: DataFrame, arrivals: DataFrame, airport: str = "apt", runway: str = "rwy", t: str = "t", period: int = 3600) -> DataFrame:
    """For each departure(id): runways in use for departures and arrivals in its airport's period, its own runway's share of the departures, and whether it takes arrivals too.

    One small row per airport or runway and period is joined to the departures.
    """
    h = F.floor(F.col(t) / period).alias("_h")
    d, a = departures.select("id", airport, runway, h), arrivals.select(airport, runway, h)
    deps = d.groupBy(airport, "_h").agg(distinct_with_null(runway).alias("dep_runways"), F.count("*").alias("_deps"))
    arrs = a.groupBy(airport, "_h").agg(distinct_with_null(runway).alias("arr_runways"))
    own = d.groupBy(runway, "_h").agg(F.count("*").alias("_own"))
    mixed = a.groupBy(runway, "_h").agg(F.count("*").alias("_arr"))
    j = d.join(deps, [airport, "_h"], "left").join(arrs, [airport, "_h"], "left").join(own, [runway, "_h"], "left").join(mixed, [runway, "_h"], "left")
    return j.select("id", "dep_runways", F.coalesce("arr_runways", F.lit(0)).alias("arr_runways"), F.try_divide("_own", "_deps").alias("runway_share"), (F.coalesce("_arr", F.lit(0)) > 0).cast("int").alias("mixed"))
