"""Writing and checking keyed outputs, versioned names, simulator CSV, day partitions, JSON reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.functions.scalar import clip, round_half_even

MOST = 172_800.0
MEDIAN_TOLERANCE = 0.5


def fill_template(template: DataFrame, predictions: DataFrame, id_column: str, target: str, most: float = MOST) -> DataFrame:
    """The template with its target set by id from predictions(id, pred): bounded, rounded half to even, in the template's type.

    ValueError if any id has no prediction, with how many and the first few.
    """
    missing = template.join(predictions.where("pred IS NOT NULL"), id_column, "left_anti").select(id_column)
    few = missing.orderBy(id_column).limit(5).collect()
    if few:
        raise ValueError(f"{missing.count()} rows have no prediction (first few: {[r[0] for r in few]})")
    value = round_half_even(clip(F.col("pred"), 0.0, most)).cast(template.schema[target].dataType)
    joined = template.drop(target).join(predictions.select(id_column, "pred"), id_column, "left").withColumn(target, value)
    return joined.select(*template.columns)


def verify_output(written: DataFrame, template: DataFrame, predictions: DataFrame, id_column: str, target: str, usual_median: float | None = None, most: float = MOST) -> list[str]:
    """Problems of a written output read back; empty if there are none. One pass over one join."""
    problems = []
    if [(f.name, f.dataType) for f in written.schema] != [(f.name, f.dataType) for f in template.schema]:
        problems.append("schema differs from the template's")
    per_id = written.groupBy(id_column).agg(F.count("*").alias("_n"), F.max(F.col(target).cast("double")).alias("_v"))
    wanted = template.select(id_column).withColumn("_t", F.lit(1))
    j = wanted.join(per_id, id_column, "full").join(predictions.select(id_column, clip(F.col("pred"), 0.0, most).alias("_p")), id_column, "left")
    finite = F.abs("_v") < float("inf")
    r = j.agg(
        F.sum(F.coalesce("_n", F.lit(0))).alias("rows"), F.sum(F.coalesce("_t", F.lit(0))).alias("wanted"), F.count_if(F.col("_n") > 1).alias("dups"),
        F.count_if(F.col("_t").isNotNull() & F.col("_v").isNull()).alias("nulls"), F.count_if(F.col("_v").isNotNull() & ~(finite & ~F.isnan("_v"))).alias("infinite"),
        F.count_if(F.col("_v") < 0).alias("negative"), F.max(F.when(F.col("_t").isNotNull(), F.abs(F.col("_v") - F.col("_p")))).alias("off"), F.median(F.when(F.col("_t").isNotNull(), F.col("_v"))).alias("median"),
    ).first()
    if r["rows"] != r["wanted"]:
        problems.append(f"{r['rows']} rows, the template has {r['wanted']}")
    for name, text in (("dups", "ids occur more than once"), ("nulls", "template ids have no value"), ("infinite", "values are not finite"), ("negative", "values are negative")):
        if r[name]:
            problems.append(f"{r[name]} {text}")
    if r["off"] is not None and not r["off"] <= 0.5:
        problems.append(f"values differ from predictions by up to {r['off']:.1f}")
    if usual_median is not None and r["median"] is not None and abs(r["median"] - usual_median) > MEDIAN_TOLERANCE * usual_median:
        problems.append(f"median {r['median']:.0f} is far from the usual {usual_median:.0f}")
    return problems


def next_version(names: list[str], team: str, suffix: str = ".parquet") -> str:
    """The next free versioned name: one above the greatest version of this team among names."""
    found = [int(m[1]) for n in names if (m := re.fullmatch(rf"{re.escape(team)}_v(\d+){re.escape(suffix)}", n.rpartition("/")[2]))]
    return f"{team}_v{max(found, default=0) + 1}{suffix}"


def write_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Zstandard Parquet partitioned by day; rewriting some days leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(day).parquet(path)


def write_final(df: DataFrame, path: str) -> None:
    """Parquet that is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


MOVEMENT_CSV = "id long, phase string, wake string, runway string, off_block_time double, unimpeded_taxi_sec double, landing_time double"


def read_movements_csv(spark: SparkSession, path: str) -> DataFrame:
    """Simulator movements; a malformed line, phase or wake category fails the job."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).schema(MOVEMENT_CSV).csv(path)
    bad = ~F.col("phase").isin("DEP", "ARR") | ~F.upper("wake").isin("L", "M", "H", "J") | F.col("id").isNull()
    return df.withColumn("id", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("malformed movement "), F.coalesce(F.col("id").cast("string"), F.lit("?"))))).otherwise(F.col("id")))


def write_predictions_csv(df: DataFrame, path: str) -> None:
    """id, takeoff_time, taxi_out_sec, queue_delay_sec with a header, doubles in full."""
    df.select("id", "takeoff_time", "taxi_out_sec", "queue_delay_sec").write.mode("errorifexists").option("header", True).csv(path)


def report(**aggregates: DataFrame) -> str:
    """Small aggregate tables as one compact JSON text. Each must be an aggregate: it is collected."""
    return json.dumps({name: [r.asDict(recursive=True) for r in df.collect()] for name, df in aggregates.items()}, separators=(",", ":"), default=str)
