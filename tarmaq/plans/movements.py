"""Movement-shaped views of the generic test tables, in Spark and in SQL.

``events`` plays the movement table. Times are whole seconds since the epoch. Airport, runway and stand nest by
construction; one in ten departures has no network manager record; the windows of the queries are scaled to this
sparse table (about 33 events a day and airport).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400
#: Time bucket of the windows over movements: several times the widest frame.
BUCKET = 10 * DAY


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, phase, apt, rwy, stand, t, aobt, sched, lobt, block, target, wake, k."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    aobt = F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 23 == 0, F.col("t") + 600).otherwise(F.col("t") - F.floor("value").cast("long") * 60)
    base = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type").isin("purchase", "signup", "error"), "DEP").otherwise("ARR").alias("phase"), "event_type", (F.col("user_id") % 10).alias("apt"), (F.col("user_id") % 30).alias("rwy"), F.col("user_id").alias("stand"), t.alias("t"), k.alias("k"), "value")
    base = base.withColumns({"aobt": aobt.cast("long"), "sched": F.col("t") - F.col("k") * 900, "lobt": F.when(F.col("k") % 17 != 0, F.col("t") - (F.col("k") % 13) * 600)})
    block = F.when(F.col("k") % 7 == 0, F.col("sched")).otherwise(F.coalesce("aobt", F.col("t") - 900) + F.col("id") % 121 - 60)
    base = base.withColumn("block", block).withColumn("target", F.col("t") - F.col("block"))
    wake = F.element_at(F.array(*map(F.lit, "LMHJ")), (F.col("k") % 4 + 1).cast("int"))
    return base.select("id", "phase", "event_type", "apt", "rwy", "stand", "t", "aobt", "sched", "lobt", "block", "target", wake.alias("wake"), "k")


MOVEMENTS_SQL = """
e0 AS (
  SELECT event_id AS id, CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 'DEP' ELSE 'ARR' END AS phase, event_type,
         user_id % 10 AS apt, user_id % 30 AS rwy, user_id AS stand, epoch_us(ts) // 1000000 AS t,
         regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, value
  FROM events
), e1 AS (
  SELECT *, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 23 = 0 THEN t + 600 ELSE t - floor(value)::BIGINT * 60 END AS aobt,
         t - k * 900 AS sched, CASE WHEN k % 17 <> 0 THEN t - (k % 13) * 600 END AS lobt
  FROM e0
), m AS (
  SELECT *, CASE WHEN k % 7 = 0 THEN sched ELSE coalesce(aobt, t - 900) + id % 121 - 60 END AS block,
         t - (CASE WHEN k % 7 = 0 THEN sched ELSE coalesce(aobt, t - 900) + id % 121 - 60 END) AS target,
         substr('LMHJ', (k % 4 + 1)::INT, 1) AS wake
  FROM e1
), dep AS (SELECT * FROM m WHERE phase = 'DEP'), arr AS (SELECT * FROM m WHERE phase = 'ARR')
"""


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movements(spark, sf_dir).where("phase = 'DEP'")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movements(spark, sf_dir).where("phase = 'ARR'")
