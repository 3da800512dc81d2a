"""Spatial operators: nearest of a few places, labels near a point by a grid join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmaq.functions.scalar import KM_PER_DEGREE, haversine_m


def nearest_place(lat: Column, lon: Column, places: dict[str, tuple[float, float]]) -> Column:
    """struct(code, km) of the nearest place on a plane through each place; ties go to the first code.

    The places are literals: no join, no shuffle. Null coordinates give null.
    """
    options = []
    for code, (y, x) in sorted(places.items()):
        dy, dx = (lat - y) * KM_PER_DEGREE, (lon - x) * KM_PER_DEGREE * math.cos(math.radians(y))
        options.append(F.struct(F.sqrt(dx * dx + dy * dy).alias("km"), F.lit(code).alias("code")))
    best = F.array_min(F.array(*options))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(best["code"].alias("code"), best["km"].alias("km")))


def labels_near(points: DataFrame, radius_m: float, id_column: str = "id", label: str = "label") -> DataFrame:
    """points(id, lat, lon, label) to (id, n_labels): distinct non-null labels within radius_m, a point's own too.

    Points meet in grid cells of the radius: every point is posted to its cell's neighbours, and the distance
    decides. Labels are made distinct per cell and position first, so repeated places don't multiply.
    """
    step = radius_m / 111_000.0
    cells = points.select(F.col(id_column).alias("_id"), "lat", "lon", F.floor(F.col("lat") / step).alias("_y"))
    cells = cells.withColumn("_w", F.lit(step) / F.greatest(F.cos(F.radians((F.floor(F.abs(F.col("lat")) + 1)))), F.lit(0.01)))
    other = points.where(F.col(label).isNotNull()).select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col(label).alias("_label"), F.floor(F.col("lat") / step).alias("_y")).distinct()
    near = cells.withColumn("_y", F.explode(F.array(F.col("_y") - 1, F.col("_y"), F.col("_y") + 1)))
    near = near.withColumn("_x", F.explode(F.sequence(F.floor((F.col("lon") - F.col("_w")) / step).cast("long"), F.floor((F.col("lon") + F.col("_w")) / step).cast("long"))))
    other = other.withColumn("_x", F.floor(F.col("_lon") / step).cast("long"))
    hits = near.join(other, ["_y", "_x"]).where(haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= radius_m)
    counted = hits.groupBy("_id").agg(F.count_distinct("_label").alias("n_labels"))
    return points.select(F.col(id_column)).join(counted.withColumnRenamed("_id", id_column), id_column, "left").fillna({"n_labels": 0})
