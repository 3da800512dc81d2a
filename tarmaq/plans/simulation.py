"""Queue delays of whole tables of movements: shaping, replay by aerodrome, day and runway, and a synthetic day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.functions.scalar import wake
from tarmaq.operators.queues import replay

DAY = 86400
#: Where a movement has no wake category, runway or reference.
DEFAULT_WAKE, DEFAULT_RUNWAY, DEFAULT_UNIMPEDED = "M", "UNK", 600.0


def to_queue(df: DataFrame) -> DataFrame:
    """df(id, phase, apt, rwy, wake, t, aobt, unimpeded) to rows that a replay takes; seconds within the day.

    Departures without an off-block time go. Departures reach the runway after their unimpeded taxi; arrivals land at t.
    """
    day = F.floor(F.col("t") / DAY)
    off = F.col("aobt") - day * DAY
    taxi = F.coalesce(F.col("unimpeded").cast("double"), F.lit(DEFAULT_UNIMPEDED))
    departure = F.col("phase") == "DEP"
    rows = df.select(
        "id", "apt", day.alias("day"), F.coalesce(F.col("rwy").cast("string"), F.lit(DEFAULT_RUNWAY)).alias("rwy"), departure.alias("departure"), F.coalesce(wake(F.col("wake")), F.lit(DEFAULT_WAKE)).alias("wake"),
        F.when(departure, off + taxi).otherwise((F.col("t") - day * DAY).cast("double")).alias("ready"), F.when(departure, off.cast("double")).alias("off_block"), F.when(departure, taxi).alias("unimpeded"),
    )
    return rows.where("ready IS NOT NULL")


def queue_delay(df: DataFrame) -> DataFrame:
    """id, takeoff (seconds in the day), taxi_out, queue_delay (at least 0, in tenths) of every departure that can be replayed.

    Groups without a departure have no output; without any row the result is empty and typed.
    """
    rows = to_queue(df)
    started = replay(rows, ["apt", "day", "rwy"])
    j = started.select("id", "start").join(rows.where("departure").select("id", "off_block", "unimpeded"), "id")
    taxi = F.col("start") - F.col("off_block")
    return j.select("id", F.col("start").alias("takeoff"), taxi.alias("taxi_out"), F.round(F.greatest(taxi - F.col("unimpeded"), F.lit(0.0)), 1).alias("queue_delay"))


def with_queue_delay(df: DataFrame) -> DataFrame:
    """df with the queue delay of its departures, null elsewhere."""
    return df.join(queue_delay(df).select("id", "queue_delay"), "id", "left")


def synthetic_day(spark: SparkSession, banks: int = 6, seed: int = 7, apt: str = "SYN") -> DataFrame:
    """A seeded day at one airport: banks of departures around evenly spread hours, an arrival every 150 s from 5 h to 23 h.

    The same rows for the same seed and Spark version, as random columns follow partitions: one partition makes them.
    """
    per = 49
    deps = spark.range(0, banks * per, 1, 1).select(
        "id", F.lit("DEP").alias("phase"), (F.lit(6 * 3600) + F.floor(F.col("id") / per) * (15 * 3600 // banks) + F.col("id") % per * 60 + F.round(F.randn(seed) * 240)).cast("long").alias("aobt"),
        F.element_at(F.array(*map(F.lit, "LMMMMMHHJM")), (F.floor(F.rand(seed + 1) * 10) + 1).cast("int")).alias("wake"), (F.lit(600.0) + F.round(F.abs(F.randn(seed + 2)) * 60)).alias("unimpeded"),
    )
    deps = deps.withColumn("t", F.col("aobt") + F.col("unimpeded").cast("long"))
    arrs = spark.range(100_000, 100_000 + 18 * 24, 1, 1).select("id", F.lit("ARR").alias("phase"), F.lit(None).cast("long").alias("aobt"), F.lit("M").alias("wake"), F.lit(None).cast("double").alias("unimpeded"), (F.lit(5 * 3600) + (F.col("id") - 100_000) * 150).alias("t"))
    return deps.unionByName(arrs).select("id", "phase", F.lit(apt).alias("apt"), F.when(F.col("id") % 2 == 0, "09L").otherwise("09R").alias("rwy"), "wake", "t", "aobt", "unimpeded")
