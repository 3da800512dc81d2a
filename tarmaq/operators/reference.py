"""Hierarchical quantile references with fallback, and smoothed band means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmaq.functions.scalar import nearest_quantile


def level_references(df: DataFrame, levels: Mapping[str, Sequence[str]], value: str, q: float = 0.1) -> DataFrame:
    """One row per group of every level: all level columns (null where a level lacks one), level, ref, n.

    One pass over the data by GROUPING SETS; quantiles are at the nearest rank of the non-null values.
    """
    columns = list(dict.fromkeys(c for cs in levels.values() for c in cs))
    sets = ", ".join("(" + ", ".join(f"`{c}`" for c in cs) + ")" for cs in levels.values())
    name = F.coalesce(*[F.when(F.col("_gid") == sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cs), F.lit(level)) for level, cs in levels.items()])
    listed = ", ".join(f"`{c}`" for c in columns)
    view = df.select(*columns, value)
    grouped = view.sparkSession.sql(
        f"SELECT {listed}, grouping_id({listed}) AS _gid, collect_list(`{value}`) AS _v, count(*) AS n FROM {{df}} GROUP BY GROUPING SETS ({sets})", df=view
    )
    return grouped.select(*columns, name.alias("level"), nearest_quantile(F.col("_v"), q).alias("ref"), "n")


def with_reference(df: DataFrame, refs: DataFrame, levels: Mapping[str, Sequence[str]], name: str = "ref") -> DataFrame:
    """df with the reference of the first level that has one, and the level's number (null without any).

    The levels' tables are joined as the optimizer sees fit: small ones are broadcast by their size.
    """
    out = df
    for k, (level, columns) in enumerate(levels.items()):
        part = refs.where(F.col("level") == level).select(*columns, F.col("ref").alias(f"_r{k}"))
        out = out.join(part, list(columns), "left")
    found = [F.col(f"_r{k}") for k in range(len(levels))]
    number: Column = F.lit(None).cast("int")
    for k in reversed(range(len(levels))):
        number = F.when(found[k].isNotNull(), F.lit(k)).otherwise(number)
    return out.withColumns({name: F.coalesce(*found), f"{name}_level": number}).drop(*[f"_r{k}" for k in range(len(levels))])


def smoothed_means(df: DataFrame, key: str, band: str, value: str, prior_rows: int) -> DataFrame:
    """key, band, mean: band means drawn to the key's mean as if by prior_rows more rows; band null: the key's mean."""
    bands = df.groupBy(key, band).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    whole = bands.groupBy(key).agg((F.sum("s") / F.sum("n")).alias("all"))
    joined = bands.join(whole, key)
    smooth = joined.select(key, band, ((F.col("s") + F.lit(prior_rows) * F.col("all")) / (F.col("n") + prior_rows)).alias("mean"))
    return smooth.unionByName(whole.select(key, F.lit(None).cast(df.schema[band].dataType).alias(band), F.col("all").alias("mean")))


def band_lookup(df: DataFrame, means: DataFrame, key: str, band: str, name: str) -> DataFrame:
    """df with the mean of its band, else of its key, else null."""
    exact = means.where(F.col(band).isNotNull()).select(key, band, F.col("mean").alias("_exact"))
    whole = means.where(F.col(band).isNull()).select(key, F.col("mean").alias("_whole"))
    return df.join(exact, [key, band], "left").join(whole, key, "left").withColumn(name, F.coalesce("_exact", "_whole")).drop("_exact", "_whole")
