"""Tables written to the cluster's shared folder, to cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or the one set with setCheckpointDir. There is no other: a local folder would not be shared."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        set_already = context._jsc.sc().getCheckpointDir()
        if set_already.isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            # A local master is one machine: its warehouse is as shared as it gets.
            context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
            set_already = context._jsc.sc().getCheckpointDir()
        folder = set_already.get()
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: later reads don't recompute it.

    The files are replicated by the shared store, so a lost executor costs only its running tasks.
    They stay until the folder is cleaned, as checkpoint files do.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tarmaq-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The cluster's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; of a file scan, the files' size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
