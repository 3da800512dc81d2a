"""Rules that bound a prediction, as functions DataFrame -> DataFrame in a fixed order, each of which can be left out.

Rows have: apt, matched boolean, p (probability that the record stands at the schedule), r (normal taxi), gap
(take-off minus schedule, may be null), t, lobt, sched, and what single rules name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmaq.functions.scalar import band_above, clip

#: Fixed values of the model, in seconds unless said otherwise.
ANCHOR_MAX = 7200
LOBT_WINDOW = 3606
LATE_BANDS_H = (1, 2, 3, 4, 6, 8, 14)
LATE_TRUSTED_H = 6
DAY, DAY_SHIFT_BAND_H = 86400, (14, 26)
ORPHAN_CAP = 3600
SHRINK, SHRINK_BANDS_H, SHRINK_PRIOR_ROWS = 0.25, (0.5, 1, 2, 4, 8), 30
FLOOR_RATIO, FLOOR_ABOVE, FLOOR_WINDOW, FLOOR_LEAST = 0.95, 1500, 1800, 3
MOST = 172800


def anchor(nm_taxi: Column, unimpeded: Column) -> Column:
    """The network manager's taxi time within bounds, else the reference, else 0."""
    return F.coalesce(clip(nm_taxi, 0, ANCHOR_MAX), unimpeded, F.lit(0))


def lobt_bounds(t: Column, lobt: Column, window: float = LOBT_WINDOW) -> tuple[Column, Column]:
    """Least and greatest taxi time that keep the off-block near LOBT; null bounds where it is unknown."""
    return t - lobt - window, t - lobt + window


def schedule_possible(sched: Column, lobt: Column, window: float = LOBT_WINDOW) -> Column:
    """Whether an off-block at the schedule is near LOBT; true where unknown."""
    return F.coalesce(F.abs(sched - lobt) <= window, F.lit(True))


def mixture(p: Column, r: Column, gap: Column) -> Column:
    """p * gap + (1 - p) * r; without a gap, r."""
    return p * F.coalesce(gap, r) + (1 - p) * r


def impossible_schedule(df: DataFrame) -> DataFrame:
    return df.withColumn("p", F.when(F.col("matched") & ~schedule_possible(F.col("sched"), F.col("lobt")), 0.0).otherwise(F.col("p")))


def late_orphans(df: DataFrame, special: object, normal_taxi: float) -> DataFrame:
    """Orphans of the special airport in a late band with a known share (column band_share): share for p, normal taxi for r."""
    gap_h = F.col("gap") / 3600
    late = ~F.col("matched") & (F.col("apt") == special) & band_above(gap_h, LATE_BANDS_H).isNotNull() & F.col("band_share").isNotNull()
    late = F.coalesce(late, F.lit(False))
    p = F.when(gap_h > LATE_TRUSTED_H, F.col("band_share")).otherwise((F.col("p") + F.col("band_share")) / 2)
    return df.withColumn("_late", late).withColumns({"p": F.when(F.col("_late"), p).otherwise(F.col("p")), "r": F.when(F.col("_late"), F.lit(float(normal_taxi))).otherwise(F.col("r"))}).drop("_late")


def day_shift(df: DataFrame, special: object, normal_taxi: float) -> DataFrame:
    gap_h = F.col("gap") / 3600
    shifted = F.coalesce(~F.col("matched") & (F.col("apt") == special) & (gap_h > DAY_SHIFT_BAND_H[0]) & (gap_h <= DAY_SHIFT_BAND_H[1]), F.lit(False))
    return df.withColumn("r", F.when(shifted, F.lit(float(DAY + normal_taxi))).otherwise(F.col("r")))


def predict(df: DataFrame) -> DataFrame:
    return df.withColumn("pred", mixture(F.col("p"), F.col("r"), F.col("gap").cast("double")))


def lobt_projection(df: DataFrame) -> DataFrame:
    low, high = lobt_bounds(F.col("t"), F.col("lobt"))
    return df.withColumn("pred", F.when(F.col("matched"), clip(F.col("pred"), low, high)).otherwise(F.col("pred")))


def _elsewhere(special: object) -> Column:
    return ~F.col("matched") & (F.col("apt") != special)


def orphan_cap(df: DataFrame, special: object) -> DataFrame:
    return df.withColumn("pred", F.when(_elsewhere(special), clip(F.col("pred"), None, ORPHAN_CAP)).otherwise(F.col("pred")))


def orphan_shrink(df: DataFrame, special: object) -> DataFrame:
    """Toward the column prior, where it is known."""
    drawn = (1 - SHRINK) * F.col("pred") + SHRINK * F.col("prior")
    return df.withColumn("pred", F.when(_elsewhere(special) & F.col("prior").isNotNull(), drawn).otherwise(F.col("pred")))


def congestion_floor(df: DataFrame, special: object) -> DataFrame:
    """Toward the column level, the neighbours' median taxi time; after the cap, so it may exceed it."""
    up = F.greatest("pred", F.lit(FLOOR_RATIO) * F.col("level"))
    return df.withColumn("pred", F.when(_elsewhere(special) & (F.col("level") > FLOOR_ABOVE), up).otherwise(F.col("pred")))


def final_clip(df: DataFrame) -> DataFrame:
    return df.withColumn("pred", clip(F.col("pred"), 0, MOST))


#: The final rules after a correction, by name, in order.
FINAL = ("lobt_projection", "orphan_cap", "congestion_floor", "final_clip")


def final_rules(df: DataFrame, special: object, leave_out: Sequence[str] = ()) -> DataFrame:
    """The rules that hold again after a correction; ``leave_out`` names those to ablate."""
    steps = {"lobt_projection": lobt_projection, "orphan_cap": lambda d: orphan_cap(d, special), "congestion_floor": lambda d: congestion_floor(d, special), "final_clip": final_clip}
    for name in FINAL:
        if name not in leave_out:
            df = steps[name](df)
    return df


def corrected(df: DataFrame, correction: Column) -> DataFrame:
    """Rows that were observed get their correction; the others keep their prediction."""
    return df.withColumn("pred", F.col("pred") + F.when(F.col("observed"), correction).otherwise(0.0))
