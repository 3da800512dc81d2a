"""Reading tables: existence and column checks, day partitions, stage results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file matches the pattern, in whatever store Spark reads."""
    p, fs = _path(spark, pattern)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def scan(spark: SparkSession, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    """All Parquet files of a pattern; FileNotFoundError if there is none. Filters and columns push down."""
    if not exists(spark, pattern):
        raise FileNotFoundError(pattern)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(pattern)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that df lacks, in order."""
    return [c for c in required if c not in df.columns]


def scan_days(spark: SparkSession, root: str, days: Sequence[str]) -> DataFrame:
    """A table partitioned by ``day``, of some days only: other partitions are not listed or read."""
    return spark.read.parquet(root).where(F.col("day").cast("string").isin(list(days)))


def materialise(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result kept at path, made and written first if it isn't there. A failed write leaves no marker."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
