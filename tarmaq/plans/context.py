"""All context features of a departure in one plan: stand, queue and configuration, keyed by id.

Departures' block times are never read, so rows that have one and rows that don't get the same features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmaq.operators.configuration import configuration
from tarmaq.operators.temporal import asof, counts_before, gap_sessions, strict_neighbours, window_aggregates

#: Minutes around take-off, and seconds that end a busy period.
AROUND_MIN = (5, 10, 20, 40)
BUSY_GAP = 150


def stand_features(deps: DataFrame, arrs: DataFrame, bucket: int) -> DataFrame:
    """deps(id, stand, t, aobt), arrs(stand, t, block): seconds to the arrivals and departures at the stand around take-off."""
    known = arrs.where("block IS NOT NULL AND stand IS NOT NULL").select("stand", F.col("block").alias("in_t"))
    known = known.withColumn("in_prev", F.lag("in_t").over(Window.partitionBy("stand").orderBy("in_t")))
    base = deps.select("id", "stand", "t", "aobt")
    lands, others = arrs.select("stand", F.col("t").alias("land_t")), deps.select("stand", F.col("t").alias("dep_t"))
    # Each on its own and joined by id: chained, every one would read the ones before several times over.
    found = [
        asof(base, known, "stand", "t", "in_t", {"_in": F.col("in_t"), "_in2": F.col("in_prev")}, bucket),
        asof(base, known, "stand", "t", "in_t", {"_next": F.col("in_t")}, bucket, forward=True),
        asof(base, lands, "stand", "t", "land_t", {"_land": F.col("land_t")}, bucket),
        asof(base, others, "stand", "t", "dep_t", {"_pd": F.col("dep_t")}, bucket, strict=True),
        asof(base, others, "stand", "t", "dep_t", {"_nd": F.col("dep_t")}, bucket, forward=True, strict=True),
        asof(base, known, "stand", "aobt", "in_t", {"_since": F.col("in_t")}, bucket, forward=True),
    ]
    out = base
    for one in found:
        out = out.join(one.drop("stand", "t", "aobt"), "id")
    c = F.col
    return out.select(
        "id", (c("t") - c("_in")).alias("stand_prev_in_gap"), (c("t") - c("_in2")).alias("stand_prev2_in_gap"), (c("_next") - c("t")).alias("stand_next_in_gap"), (c("t") - c("_land")).alias("stand_prev_land_gap"),
        (c("t") - c("_pd")).alias("stand_prev_dep_gap"), (c("_nd") - c("t")).alias("stand_next_dep_gap"), (c("_since") - c("t")).alias("stand_in_since_aobt"),
    )


def queue_features(deps: DataFrame, arrs: DataFrame, bucket: int) -> DataFrame:
    """Counts of movements on the airport and the runway since the off-block and around take-off, gaps and busy periods."""
    d, a = deps.select("id", "apt", "rwy", "t", "aobt"), arrs.select("apt", "rwy", "t")
    probes = {"at_aobt": (F.col("aobt"), False), "upto_aobt": (F.col("aobt"), True), "at_t": (F.col("t"), False), "upto_t": (F.col("t"), True)}
    apt = counts_before(d, "id", "apt", probes, {"d": (d, "apt", "t"), "p": (d, "apt", "aobt")}, bucket)
    rwy = counts_before(d, "id", "rwy", {k: probes[k] for k in ("at_aobt", "at_t")}, {"rd": (d, "rwy", "t"), "ra": (a, "rwy", "t")}, bucket)
    both = d.withColumn("_dep", F.lit(1)).unionByName(a.withColumn("_dep", F.lit(0)), allowMissingColumns=True)
    around = {f"apt_deps_around_{m}m": (-60 * m, 60 * m - 1, F.sum("_dep")) for m in AROUND_MIN}
    lanes = {f"rwy_deps_before_{m}m": (-60 * m, -1, F.sum("_dep")) for m in AROUND_MIN} | {f"rwy_deps_after_{m}m": (1, 60 * m - 1, F.sum("_dep")) for m in AROUND_MIN} | {f"rwy_arrs_around_{m}m": (-60 * m, 60 * m - 1, F.sum(1 - F.col("_dep"))) for m in AROUND_MIN}
    wide = window_aggregates(both, "apt", "t", around, bucket)
    wide = window_aggregates(wide, "rwy", "t", lanes, bucket).where("_dep = 1")
    names = [*around, *lanes]
    filled = [F.when(F.col("rwy").isNotNull() if n.startswith("rwy") else F.lit(True), F.coalesce(n, F.lit(0))).alias(n) for n in names]
    wide = wide.select("id", *filled)
    gaps = strict_neighbours(d.where("rwy IS NOT NULL"), "rwy", "t", "_p", "_f", bucket)
    gaps = gaps.select("id", (F.col("t") - F.col("_p")).alias("rwy_prev_dep_gap"), (F.col("_f") - F.col("t")).alias("rwy_next_dep_gap"))
    busy = gap_sessions(d.where("rwy IS NOT NULL"), "rwy", "t", BUSY_GAP).select("id", F.col("rank").alias("rwy_busy_rank"), F.col("elapsed").alias("rwy_busy_elapsed"))
    c = F.col
    counted = apt.join(rwy, "id").select(
        "id", (c("d_at_t") - c("d_at_aobt")).alias("apt_deps_since_aobt"), (c("p_upto_t") - c("d_at_t")).alias("apt_surface_at_takeoff"), (c("p_at_aobt") - c("d_upto_aobt")).alias("apt_surface_at_aobt"),
        (c("p_at_t") - c("p_upto_aobt")).alias("apt_pushbacks_during_taxi"), (c("p_at_aobt") - c("d_upto_aobt") + c("p_at_t") - c("p_upto_aobt")).alias("apt_adjusted_traffic"),
        (c("rd_at_t") - c("rd_at_aobt")).alias("rwy_deps_since_aobt"), (c("ra_at_t") - c("ra_at_aobt")).alias("rwy_arrs_since_aobt"),
    )
    return counted.join(wide, "id", "left").join(gaps, "id", "left").join(busy, "id", "left")


def build(movements: DataFrame, bucket: int = 86400, period: int = 3600) -> DataFrame:
    """movements(id, phase, apt, rwy, stand, t, aobt, block), times in seconds, to one row of features per departure."""
    deps = movements.where("phase = 'DEP'").drop("block")
    arrs = movements.where("phase = 'ARR'")
    config = configuration(deps, arrs, period=period)
    return stand_features(deps, arrs, bucket).join(queue_features(deps, arrs, bucket), "id", "full").join(config, "id", "left")
