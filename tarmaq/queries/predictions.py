"""Q24, Q25, Q27, Q28, Q31, Q37: mixtures, rules, shares and means, ablation, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.functions.scalar import band_above, digitize, within
from tarmaq.operators.reference import band_lookup, smoothed_means
from tarmaq.operators.temporal import frame_median
from tarmaq.plans import rules
from tarmaq.plans.evaluate import ablation, block_bootstrap, day_folds, day_sums, mae, rmse
from tarmaq.plans.movements import BUCKET, DAY, MOVEMENTS_SQL, departures

#: The airport with rules of its own.
SPECIAL = 0
NORMAL_TAXI = 900.0
CAPS = (600, 1800, 3600, 7200, 14400, 28800, 43200, 57600, 72000, 86400)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures with fixed formulas in place of fitted models: p in sixteenths, r in whole seconds."""
    d = departures(spark, sf_dir).select("id", "apt", "t", "sched", "lobt", "block", "target", "aobt", "k", F.col("aobt").isNotNull().alias("matched"))
    d = d.withColumn("nm_taxi", F.col("t") - F.col("aobt")).withColumn("gap", F.when(F.col("k") % 23 != 0, F.col("t") - F.col("sched")))
    return d.withColumns({"p": (F.col("k") % 16) / 16.0, "r": (F.lit(600) + F.col("id") % 977 * 8).cast("double"), "unimpeded": F.when(F.col("k") % 5 != 0, 300 + F.col("apt") * 60)})


def q24_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _rows(spark, sf_dir)
    a = rules.anchor(F.col("nm_taxi"), F.col("unimpeded"))
    return rules.predict(d.withColumn("r", F.col("r") + a)).select("id", a.cast("long").alias("anchor"), "pred")


def q25_schedule_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rules.lobt_projection(rules.predict(rules.impossible_schedule(_rows(spark, sf_dir))))
    return d.select("id", rules.schedule_possible(F.col("sched"), F.col("lobt")).alias("possible"), "p", "pred")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where("NOT matched")


def _band_shares(orphans: DataFrame) -> DataFrame:
    """band, share at the schedule of the special airport's ordinary orphans; 1 for an empty band."""
    own = orphans.where((F.col("apt") == SPECIAL) & (F.col("target") < 80_000))
    found = own.select(band_above(F.col("gap") / 3600, rules.LATE_BANDS_H).alias("band"), within(F.col("block"), F.col("sched"), 10).alias("at")).where("band IS NOT NULL").groupBy("band").agg(F.avg(F.col("at").cast("double")).alias("share"))
    bands = orphans.sparkSession.createDataFrame([(float(b),) for b in rules.LATE_BANDS_H[:-1]], "band double")
    return bands.join(found, "band", "left").select("band", F.coalesce("share", F.lit(1.0)).alias("band_share"))


def q27_late_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orphans(spark, sf_dir)
    d = o.withColumn("band", band_above(F.col("gap") / 3600, rules.LATE_BANDS_H)).join(_band_shares(o), "band", "left")
    d = rules.day_shift(rules.late_orphans(d, SPECIAL, NORMAL_TAXI), SPECIAL, NORMAL_TAXI)
    return rules.predict(d).select("id", "p", "r", F.round("pred", 6).alias("pred"))


def q27b_normal_taxi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orphans(spark, sf_dir)
    ordinary = (F.col("apt") == SPECIAL) & ~within(F.col("block"), F.col("sched"), 10) & (F.col("target") < 80_000)
    # Banded counts with their shares, and the filtered median, in one aggregate.
    band = digitize(F.col("gap") / 3600, rules.SHRINK_BANDS_H)
    return o.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("gap") > 14 * 3600).alias("day_shifts"), F.coalesce(F.percentile(F.when(ordinary, F.col("target")), 0.5), F.lit(0.0)).alias("normal_taxi"))


def _prior(o: DataFrame) -> DataFrame:
    banded = o.withColumn("band", digitize(F.col("gap") / 3600, rules.SHRINK_BANDS_H))
    # Means of the first half only, so that some bands have none of their own.
    means = smoothed_means(banded.where((F.col("apt") != SPECIAL) & (F.col("id") % 20 == 0)), "apt", "band", "target", rules.SHRINK_PRIOR_ROWS)
    return band_lookup(banded, means, "apt", "band", "prior")


def q28_cap_and_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rules.orphan_shrink(rules.orphan_cap(rules.predict(_prior(_orphans(spark, sf_dir))), SPECIAL), SPECIAL)
    return d.select("id", "band", F.round("prior", 6).alias("prior"), F.round("pred", 6).alias("pred"))


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frame_median(_rows(spark, sf_dir), "apt", "t", "nm_taxi", DAY // 4, rules.FLOOR_LEAST, "level", BUCKET)
    return rules.predict(d)


def q29b_congestion_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.final_rules(_final(spark, sf_dir), SPECIAL).select("id", F.round("pred", 6).alias("pred"))


def q31_clip_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rules.predict(_rows(spark, sf_dir)).withColumn("cap", F.explode(F.array(*map(F.lit, CAPS))))
    p = F.least("pred", F.col("cap").cast("double"))
    return d.groupBy("cap").agg(F.round(rmse(p, F.col("target")), 6).alias("rmse"), F.round(mae(p, F.col("target")), 6).alias("mae"))


def q31b_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _final(spark, sf_dir)
    out = ablation(d, lambda x, leave_out=(): rules.final_rules(x, SPECIAL, leave_out), ("lobt_projection", "orphan_cap", "congestion_floor"), "id", "target")
    return out.select("rule", F.round("rmse", 5).alias("rmse"), F.round("delta", 5).alias("delta"), "changed")


def q31c_sliced_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rules.predict(_rows(spark, sf_dir))
    share = F.sum((F.col("pred") - F.col("target")) ** 2)
    per = d.groupBy("apt", "matched").agg(F.count("*").alias("n"), F.round(rmse(F.col("pred"), F.col("target")), 6).alias("rmse"), F.round(share, 3).alias("squares"))
    return per.drop("squares")


def q37_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rules.predict(_rows(spark, sf_dir)).withColumn("day", F.floor(F.col("t") / DAY))
    days = day_sums(d, "day", {"plain": F.col("r"), "mixed": F.col("pred")}, F.col("target"))
    draws = block_bootstrap(days, "day", ["plain", "mixed"], 100)
    diff = F.col("mixed") - F.col("plain")
    return draws.agg(F.round(F.percentile(diff, 0.025), 5).alias("low"), F.round(F.percentile(diff, 0.5), 5).alias("middle"), F.round(F.percentile(diff, 0.975), 5).alias("high"))


def q37b_day_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = departures(spark, sf_dir).select("id", F.floor(F.col("t") / DAY).alias("day"))
    return day_folds(d, "day").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))


QUERIES = {f.__name__: f for f in (q24_mixture, q25_schedule_rules, q27_late_rules, q27b_normal_taxi, q28_cap_and_shrink, q29b_congestion_floor, q31_clip_curve, q31b_rule_ablation, q31c_sliced_errors, q37_bootstrap, q37b_day_folds)}
_R = "WITH " + MOVEMENTS_SQL + """
, b AS (SELECT *, aobt IS NOT NULL AS matched, t - aobt AS nm_taxi, CASE WHEN k % 23 <> 0 THEN t - sched END AS gap, (k % 16) / 16.0::DOUBLE AS p, (600 + id % 977 * 8)::DOUBLE AS r, CASE WHEN k % 5 <> 0 THEN 300 + apt * 60 END AS unimpeded FROM dep)"""
_MIX = "p * coalesce(gap, r) + (1 - p) * r"
_BAND = "CASE " + " ".join(f"WHEN gap / 3600.0 > {a} AND gap / 3600.0 <= {b} THEN {a}" for a, b in zip(rules.LATE_BANDS_H[:-1], rules.LATE_BANDS_H[1:])) + " END"
_DIGIT = "(CASE WHEN gap IS NULL THEN 0 ELSE " + " + ".join(f"(gap / 3600.0 >= {e})::INT" for e in rules.SHRINK_BANDS_H) + " END)::INT"
_FINAL = f"""
, l AS (SELECT *, CASE WHEN count(nm_taxi) OVER w >= 3 THEN median(nm_taxi) OVER w END AS level, {_MIX} AS p0 FROM b WINDOW w AS (PARTITION BY apt ORDER BY t RANGE BETWEEN {DAY // 4} PRECEDING AND {DAY // 4} FOLLOWING)),
z AS (SELECT *, NOT matched AND apt <> {SPECIAL} AS els, CASE WHEN lobt IS NULL THEN -1e18 ELSE t - lobt - 3606 END AS lo, CASE WHEN lobt IS NULL THEN 1e18 ELSE t - lobt + 3606 END AS hi FROM l),
f AS (SELECT *, least(greatest(y3, 0), 172800) AS pred FROM (SELECT *, CASE WHEN els AND level > 1500 THEN greatest(y2, 0.95 * level) ELSE y2 END AS y3 FROM (
  SELECT *, CASE WHEN els THEN least(y1, 3600) ELSE y1 END AS y2 FROM (SELECT *, CASE WHEN matched THEN least(greatest(p0, lo), hi) ELSE p0 END AS y1 FROM z)))),
-- each rule left out
na AS (SELECT id, target, least(greatest(CASE WHEN els AND level > 1500 THEN greatest(x2, 0.95 * level) ELSE x2 END, 0), 172800) AS pred FROM (SELECT *, CASE WHEN els THEN least(p0, 3600) ELSE p0 END AS x2 FROM f)),
nb AS (SELECT id, target, least(greatest(CASE WHEN els AND level > 1500 THEN greatest(y1, 0.95 * level) ELSE y1 END, 0), 172800) AS pred FROM f),
nc AS (SELECT id, target, least(greatest(y2, 0), 172800) AS pred FROM f)"""
ORACLES = {
    "q24_mixture": _R + f""", a AS (SELECT id, p, gap, r AS r0, coalesce(CASE WHEN nm_taxi IS NOT NULL THEN least(greatest(nm_taxi, 0), 7200) END, unimpeded, 0) AS anchor FROM b), c AS (SELECT *, r0 + anchor AS r FROM a)
SELECT id, anchor, {_MIX} AS pred FROM c""",
    "q25_schedule_rules": _R + f"""
, c AS (SELECT id, t, lobt, gap, r, matched, coalesce(abs(sched - lobt) <= 3606, true) AS possible, CASE WHEN matched AND NOT coalesce(abs(sched - lobt) <= 3606, true) THEN 0.0::DOUBLE ELSE p END AS p FROM b)
SELECT id, possible, p, CASE WHEN matched AND lobt IS NOT NULL THEN least(greatest({_MIX}, t - lobt - 3606), t - lobt + 3606) ELSE {_MIX} END AS pred FROM c""",
    "q27_late_rules": _R + f"""
, o AS (SELECT *, {_BAND} AS band FROM b WHERE NOT matched), s AS (SELECT band, avg((coalesce(abs(block - sched) <= 10, false))::INT::DOUBLE) AS share FROM o WHERE apt = {SPECIAL} AND target < 80000 AND band IS NOT NULL GROUP BY band),
j AS (SELECT o.*, coalesce(share, 1.0) AS bs, coalesce(apt = {SPECIAL} AND o.band IS NOT NULL, false) AS late, coalesce(apt = {SPECIAL} AND gap / 3600.0 > 14 AND gap / 3600.0 <= 26, false) AS shifted FROM o LEFT JOIN s ON s.band = o.band),
q AS (SELECT id, gap, CASE WHEN late AND gap / 3600.0 > 6 THEN bs WHEN late THEN (p + bs) / 2 ELSE p END AS p, CASE WHEN shifted THEN {86400 + NORMAL_TAXI} WHEN late THEN {NORMAL_TAXI} ELSE r END::DOUBLE AS r FROM j)
SELECT id, p, r, round({_MIX}, 6) AS pred FROM q""",
    "q27b_normal_taxi": _R + f"""
SELECT {_DIGIT} AS band, count(*) AS n, count(*) FILTER (WHERE gap > 14 * 3600) AS day_shifts, coalesce(median(target) FILTER (WHERE apt = {SPECIAL} AND NOT coalesce(abs(block - sched) <= 10, false) AND target < 80000), 0.0) AS normal_taxi FROM b WHERE NOT matched GROUP BY 1""",
    "q28_cap_and_shrink": _R + f"""
, o AS (SELECT *, {_DIGIT} AS band FROM b WHERE NOT matched), h AS (SELECT * FROM o WHERE apt <> {SPECIAL} AND id % 20 = 0), w AS (SELECT apt, avg(target) AS whole FROM h GROUP BY apt),
e AS (SELECT apt, band, (sum(target)::DOUBLE + {rules.SHRINK_PRIOR_ROWS} * any_value(whole)) / (count(*) + {rules.SHRINK_PRIOR_ROWS}) AS mean FROM h JOIN w USING (apt) GROUP BY apt, band),
j AS (SELECT o.*, coalesce(e.mean, w.whole) AS prior, CASE WHEN o.apt <> {SPECIAL} THEN least({_MIX}, 3600) ELSE {_MIX} END AS x FROM o LEFT JOIN e ON e.apt = o.apt AND e.band = o.band LEFT JOIN w ON w.apt = o.apt)
SELECT id, band, round(prior, 6) AS prior, round(CASE WHEN apt <> {SPECIAL} AND prior IS NOT NULL THEN 0.75 * x + 0.25 * prior ELSE x END, 6) AS pred FROM j""",
    "q29b_congestion_floor": _R + _FINAL + " SELECT id, round(pred, 6) AS pred FROM f",
    "q31_clip_curve": _R + f"""
, x AS (SELECT target, cap, least({_MIX}, cap::DOUBLE) AS c FROM b, (SELECT unnest([{', '.join(map(str, CAPS))}])::INT AS cap))
SELECT cap, round(sqrt(avg((c - target) * (c - target))), 6) AS rmse, round(avg(abs(c - target)), 6) AS mae FROM x GROUP BY cap""",
    "q31b_rule_ablation": _R + _FINAL + """
, v AS (SELECT 'lobt_projection' AS rule, * FROM na UNION ALL SELECT 'orphan_cap', * FROM nb UNION ALL SELECT 'congestion_floor', * FROM nc)
SELECT rule, round(sqrt(avg((v.pred - v.target) ** 2)), 5) AS rmse, round(sqrt(avg((v.pred - v.target) ** 2)) - sqrt(avg((f.pred - v.target) ** 2)), 5) AS delta, count(*) FILTER (WHERE v.pred <> f.pred) AS changed FROM v JOIN f USING (id) GROUP BY rule""",
    "q31c_sliced_errors": _R + f"SELECT apt, matched, count(*) AS n, round(sqrt(avg(({_MIX} - target) ** 2)), 6) AS rmse FROM b GROUP BY ALL",
    "q37_bootstrap": _R + f"""
, d AS (SELECT t // {DAY} AS day, count(*) AS n, sum((r - target) ** 2) AS plain, sum(({_MIX} - target) ** 2) AS mixed FROM b GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS c FROM d),
s AS (SELECT draw, (7919 * draw + 104729 * (i + 1) * (draw + 1)) % c AS i FROM i, (SELECT unnest(range(100)) AS draw)),
x AS (SELECT draw, sqrt(sum(mixed) / sum(n)) - sqrt(sum(plain) / sum(n)) AS diff FROM s JOIN i USING (i) GROUP BY draw)
SELECT round(quantile_cont(diff, 0.025), 5) AS low, round(quantile_cont(diff, 0.5), 5) AS middle, round(quantile_cont(diff, 0.975), 5) AS high FROM x""",
    "q37b_day_folds": "WITH " + MOVEMENTS_SQL + f", d AS (SELECT t // {DAY} AS day, count(*) AS n FROM dep GROUP BY 1), r AS (SELECT n, ((row_number() OVER (ORDER BY day) - 1) % 10)::INT AS fold FROM d) SELECT fold, sum(n)::BIGINT AS n, count(*) AS days FROM r GROUP BY fold",
}
