"""Operator 8: an exact histogram of encoded lengths answers every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmaq.llm import textkit, tokens
from tarmaq.llm.store import written

#: Lengths summed in one window group of the suffix sums.
BLOCK = 1024


def _count(path: str, specials: bool):
    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in textkit.chunks(batch.column(0), tokens.TOKEN_CHUNK):
                length, n = np.unique(tokens.encode(t, path, specials).counts(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], names=["length", "n"])

    return run


def histogram(docs: DataFrame, path: str | None = None, specials: bool = False) -> DataFrame:
    """length, n_docs: how many texts have each encoded length. Null and empty texts have length 0.
    ``specials`` as in ``tokens.encode``.

    Tasks send one row per distinct length and chunk, so a length that a third of all texts share
    is no hot key. Repeated rows count each time. An empty table gives no rows.
    """
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(path or tokens.default_path(), specials), "length long, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("n_docs"))


def context_limits(hist: DataFrame) -> DataFrame:
    """Suffix sums of a histogram: one row for every length that occurs, taken as context limit.

    n_docs, n_tokens: of exactly this length; docs_over: longer documents; tokens_upto: tokens of
    those not longer; truncated_tokens: what is left if all are cut to this limit; quantile: share of
    documents not longer. Any limit x in between has the truncated total of the next lower row
    plus (x - length) * docs_over. Sums run within blocks of lengths and over block totals, so no
    task gets more than one block or one row per block.
    """
    hist = written(hist)  # read twice below, counted once
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    order = Window.orderBy("block")
    totals = totals.select(
        "block",
        (F.sum("bd").over(order) - F.col("bd")).alias("docs_before"),
        (F.sum("bt").over(order) - F.col("bt")).alias("tokens_before"),
        F.sum("bd").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_docs"),
    )
    inside = Window.partitionBy("block").orderBy("length")
    d = h.join(totals, "block").select(
        "length", "n_docs", "n_tokens", "all_docs",
        (F.col("docs_before") + F.sum("n_docs").over(inside)).alias("docs_upto"),
        (F.col("tokens_before") + F.sum("n_tokens").over(inside)).alias("tokens_upto"),
    )
    over = F.col("all_docs") - F.col("docs_upto")
    return d.select("length", "n_docs", "n_tokens", over.alias("docs_over"), "tokens_upto", (F.col("tokens_upto") + over * F.col("length")).alias("truncated_tokens"), (F.col("docs_upto") / F.col("all_docs")).alias("quantile"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals of all documents for every context limit."""
    return context_limits(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"), specials=True))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
