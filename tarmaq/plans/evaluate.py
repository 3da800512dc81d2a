"""Evaluation: metrics, folds, bootstraps, ablation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MONTH_PAIRS = ((1, 7), (2, 8), (3, 9), (4, 10), (5, 11), (6, 12))


def rmse(pred: Column, truth: Column) -> Column:
    return F.sqrt(F.avg((pred - truth) * (pred - truth)))


def mae(pred: Column, truth: Column) -> Column:
    return F.avg(F.abs(pred - truth))


def brier(p: Column, label: Column) -> Column:
    return F.avg((p - label.cast("double")) * (p - label.cast("double")))


def month_split(df: DataFrame, timestamp: str, months: Sequence[int] = (1, 7)) -> tuple[DataFrame, DataFrame]:
    """(other months, these months). Rows without time are in neither."""
    inside = F.month(F.col(timestamp).cast("timestamp")).isin(*months)
    return df.where(~inside), df.where(inside)


def fold_of_month(month: Column) -> Column:
    """The pair of months, from 0, that a month is held out in."""
    return F.coalesce(*[F.when(month.isin(*pair), F.lit(k)) for k, pair in enumerate(MONTH_PAIRS)])


def day_folds(df: DataFrame, day: str, folds: int = 10) -> DataFrame:
    """Add fold: the day's place among the distinct days modulo folds. The window runs over one row per day."""
    days = df.select(day).distinct().withColumn("fold", ((F.row_number().over(Window.orderBy(day)) - 1) % folds).cast("int"))
    return df.join(days, day, "left")


def day_sums(df: DataFrame, day: str, preds: dict[str, Column], truth: Column) -> DataFrame:
    """day, n and one sum of squared errors per prediction: all that a day-block bootstrap needs."""
    return df.groupBy(day).agg(F.count("*").alias("n"), *[F.sum((p - truth) * (p - truth)).alias(name) for name, p in preds.items()])


def block_bootstrap(days: DataFrame, day: str, errors: Sequence[str], draws: int = 300, a: int = 7919, b: int = 104729) -> DataFrame:
    """draw and the RMSE of each error column, with days resampled: slot i of draw r takes the day
    numbered (a * r + b * (i + 1) * (r + 1)) mod n of the days in order, so every engine draws alike.

    days has one row per day; draws times days rows are made by an equi join on the day number.
    """
    numbered = days.withColumn("_i", F.row_number().over(Window.orderBy(day)) - 1)
    n = F.count("*").over(Window.partitionBy())
    slots = numbered.select(F.col("_i").alias("_slot"), n.alias("_n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    slots = slots.withColumn("_i", ((F.lit(a) * F.col("draw") + F.lit(b) * (F.col("_slot") + 1) * (F.col("draw") + 1)) % F.col("_n")).cast("int"))
    return slots.join(numbered, "_i").groupBy("draw").agg(*[F.sqrt(F.sum(e) / F.sum("n")).alias(e) for e in errors])


def row_bootstrap(df: DataFrame, id_column: str, errors: dict[str, Column], draws: int = 300) -> DataFrame:
    """draw and RMSEs with rows resampled by Poisson(1) weights of a hash of (id, draw): paired across predictions.

    Weights are summed on the map side, so no resample is ever materialised.
    """
    u = (F.pmod(F.xxhash64(F.col(id_column), "draw"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight, limit, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        limit += term
        weight = weight + F.when(u > limit, 1).otherwise(0)
        term /= k
    rows = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_w", weight)
    return rows.groupBy("draw").agg(*[F.sqrt(F.sum(F.col("_w") * e * e) / F.sum("_w")).alias(name) for name, e in errors.items()])


def ablation(df: DataFrame, rules: Callable[..., DataFrame], names: Sequence[str], id_column: str, truth: str) -> DataFrame:
    """rule, rmse, delta to all rules, rows changed, for each rule left out.

    rules keep every row and change pred only. A row without a rule meets the rows of its id with all rules; all rules
    left out share one join, so df is computed twice however many they are.
    """
    full = rules(df).select(id_column, F.col("pred").alias("_full"))
    less = df.withColumn("_pred", F.col("pred"))
    for i, name in enumerate(names):
        less = rules(less.withColumn("pred", F.col("_pred")), leave_out=(name,)).withColumn(f"_less_{i}", F.col("pred"))
    cut = {name: F.col(f"_less_{i}") for i, name in enumerate(names)}
    j = less.select(id_column, truth, *cut.values()).join(full, id_column)
    base = rmse(F.col("_full"), F.col(truth))
    found = {name: F.struct(F.lit(name).alias("rule"), rmse(c, F.col(truth)).alias("rmse"), (rmse(c, F.col(truth)) - base).alias("delta"), F.count_if(~c.eqNullSafe(F.col("_full"))).alias("changed")) for name, c in cut.items()}
    return j.agg(F.array(*found.values()).alias("_found")).select(F.inline("_found"))


def out_of_fold(df: DataFrame, fold: str, folds: Sequence[int], fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Predictions for each fold by a model fitted on the others."""
    out = None
    for k in folds:
        part = fit(df.where(F.col(fold) != k))(df.where(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out
