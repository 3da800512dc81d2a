"""Q01-Q07: filters, calendar, keys, flags and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.functions import scalar
from tarmaq.operators.configuration import distinct_with_null
from tarmaq.plans.evaluate import fold_of_month
from tarmaq.plans.movements import MOVEMENTS_SQL, departures, movements
from tarmaq.sources.tables import scan


def q01_departures_per_airport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departures(spark, sf_dir).groupBy("apt").agg(F.count("*").alias("n"), F.count_distinct("rwy").alias("runways"))


def q02_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scan(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    c = {k: v.cast("int") for k, v in scalar.calendar(F.col("o_orderdate")).items()}
    return o.select("o_orderkey", *[v.alias(k) for k, v in c.items()], c["month"].isin(1, 7).alias("held_out"), fold_of_month(c["month"]).alias("fold"))


def q03_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = departures(spark, sf_dir)
    flags = scalar.missing_flags(aobt=F.col("aobt"), lobt=F.col("lobt"))
    at = scalar.within(F.col("block"), F.col("sched"), 10)
    return d.groupBy("apt").agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in flags.items()], F.count_if(at).alias("at_schedule"), F.avg(at.cast("double")).alias("at_schedule_share"), F.count_if(F.col("aobt").isNotNull()).alias("matched"))


def q04_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = movements(spark, sf_dir)
    place = scalar.aerodrome(F.col("phase") == "DEP", F.col("apt"), F.col("apt") + 100)
    return m.select("id", place.alias("aerodrome"), scalar.composite_key(place, F.col("rwy")).alias("runway_key"), scalar.composite_key(place, F.when(F.col("k") % 17 != 0, F.col("stand"))).alias("stand_key"))


def q05_stand_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scan(spark, f"{sf_dir}/part.parquet").select("p_brand", "p_size")
    code = F.when(F.col("p_size") % 3 == 0, F.substring("p_brand", 1, 2)).otherwise(F.col("p_brand"))
    return p.groupBy(scalar.stand_group(code).alias("stand_group")).agg(F.count("*").alias("n"), distinct_with_null("p_brand").alias("brands"))


def q06_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = scan(spark, f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    o = scan(spark, f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    off = F.expr("make_dt_interval(0, 0, 0, l_linenumber * 0.25)")
    j = l.join(o, "l_orderkey").withColumn("due", F.col("o_orderdate") + off)
    s = scalar.seconds_between
    per = j.select("l_orderkey", s(F.col("l_shipdate"), F.col("o_orderdate")).alias("a"), s(F.col("due"), F.col("l_shipdate")).alias("b"), F.second(F.col("l_shipdate").cast("timestamp")).cast("long").alias("c"))
    return per.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("a").alias("ship_after_order"), F.min("a").alias("least"), F.sum("b").alias("due_after_ship"), F.sum("c").alias("ship_seconds"))


def q07_weather_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scan(spark, f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    codes = F.when(F.col("p_size") % 5 != 0, F.upper("p_name"))
    text = F.when(F.col("p_size") % 7 == 0, "M").when(F.col("p_size") % 11 == 0, "x1").otherwise(F.col("p_size").cast("string"))
    temperature = scalar.lenient_number(text) - 20
    spread = F.when(F.col("p_partkey") % 6 != 0, F.col("p_partkey") % 9)
    flags = scalar.weather_flags(codes)
    cover = F.element_at(F.array(*map(F.lit, ("BKN", "FEW", "OVC", "SCT"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", temperature.alias("temperature"), *[c.alias(n) for n, c in flags.items()], scalar.icing_risk(temperature, spread, codes).alias("icing"), scalar.ceiling_ft(cover, F.col("p_retailprice")).alias("ceiling"))


QUERIES = {f.__name__: f for f in (q01_departures_per_airport, q02_calendar, q03_flags, q04_keys, q05_stand_group, q06_differences, q07_weather_flags)}
_M = "WITH " + MOVEMENTS_SQL
_SECONDS = "CAST(trunc((epoch_us({a}) - epoch_us({b})) / 1000000.0) AS BIGINT)"
ORACLES = {
    "q01_departures_per_airport": _M + "SELECT apt, count(*) AS n, count(DISTINCT rwy) AS runways FROM dep GROUP BY apt",
    "q02_calendar": """
SELECT o_orderkey, hour(o_orderdate)::INT AS hour, isodow(o_orderdate)::INT AS weekday, month(o_orderdate)::INT AS month, dayofyear(o_orderdate)::INT AS day_of_year,
       month(o_orderdate) IN (1, 7) AS held_out, ((month(o_orderdate) - 1) % 6)::INT AS fold FROM orders""",
    "q03_flags": _M + """
SELECT apt, count(*) AS n, (count(*) - count(aobt)) AS no_aobt, (count(*) - count(lobt)) AS no_lobt, count(*) FILTER (WHERE abs(block - sched) <= 10) AS at_schedule,
       count(*) FILTER (WHERE abs(block - sched) <= 10)::DOUBLE / count(*) AS at_schedule_share, count(aobt) AS matched FROM dep GROUP BY apt""",
    "q04_keys": _M + """
, p AS (SELECT *, CASE WHEN phase = 'DEP' THEN apt ELSE apt + 100 END AS a FROM m)
SELECT id, a AS aerodrome, a || '|' || rwy AS runway_key, a || '|' || (CASE WHEN k % 17 <> 0 THEN stand END) AS stand_key FROM p""",
    "q05_stand_group": """
WITH c AS (SELECT p_brand, CASE WHEN p_size % 3 = 0 THEN substr(p_brand, 1, 2) ELSE p_brand END AS s FROM part)
SELECT CASE WHEN length(s) >= 3 THEN substr(s, 1, length(s) - 1) ELSE substr(s, 1, 1) END AS stand_group, count(*) AS n, count(DISTINCT p_brand) AS brands FROM c GROUP BY 1""",
    "q06_differences": f"""
WITH j AS (SELECT l_orderkey, l_shipdate, o_orderdate, o_orderdate + to_microseconds((l_linenumber * 250000)::BIGINT) AS due FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT l_orderkey, {_SECONDS.format(a="l_shipdate", b="o_orderdate")} AS a, {_SECONDS.format(a="due", b="l_shipdate")} AS b, second(l_shipdate) AS c FROM j)
SELECT l_orderkey, count(*) AS n, sum(a)::BIGINT AS ship_after_order, min(a) AS least, sum(b)::BIGINT AS due_after_ship, sum(c)::BIGINT AS ship_seconds FROM p GROUP BY l_orderkey""",
    "q07_weather_flags": """
WITH p AS (
  SELECT *, CASE WHEN p_size % 5 <> 0 THEN upper(p_name) ELSE '' END AS codes,
         try_cast(CASE WHEN p_size % 7 = 0 THEN 'M' WHEN p_size % 11 = 0 THEN 'x1' ELSE p_size::VARCHAR END AS DOUBLE) - 20 AS temperature,
         CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 9 END AS spread, ['BKN', 'FEW', 'OVC', 'SCT'][(p_partkey % 4 + 1)::INT] AS cover
  FROM part)
SELECT p_partkey, temperature, regexp_matches(codes, 'RA|DZ|SN|SG|PL|GR|GS')::INT AS precip, regexp_matches(codes, 'FZ')::INT AS freezing, regexp_matches(codes, 'SN|SG|PL')::INT AS snow,
       regexp_matches(codes, 'FG')::INT AS fog, (((temperature <= 3) AND (regexp_matches(codes, 'RA|DZ|SN|SG|PL|GR|GS|FZ|BR|FG') OR spread <= 2)) OR regexp_matches(codes, 'FZ|SN|SG|PL'))::INT AS icing,
       CASE WHEN cover IN ('BKN', 'OVC', 'VV') THEN p_retailprice ELSE 99999.0 END AS ceiling FROM p""",
}
