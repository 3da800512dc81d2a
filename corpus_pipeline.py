"""The training-data pipeline: five operators of ``tarmaq.llm`` in a row.

toxicity: documents with a toxic score go. lines: lines that ten or more documents share go, the documents stay.
near: one document of each near-duplicate group stays. mix: each document comes as often as the mix takes it.
pack: pieces of all documents, repetitions included, packed into sequences; the only stage that does not return
the columns of ``documents``.

Every stage's result is written as Parquet to the shared folder and read again as the next one's input, so a lost
executor never costs more than the stage it was working on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarmaq.llm.line_dedup import pipeline_lines
from tarmaq.llm.mixing import pipeline_mix
from tarmaq.llm.near_dedup import pipeline_near
from tarmaq.llm.packing import pipeline_pack
from tarmaq.llm.store import written
from tarmaq.llm.toxicity import pipeline_toxicity

STAGES = [
    ("toxicity", pipeline_toxicity),
    ("line_dedup", pipeline_lines),
    ("minhash_near_dedup", pipeline_near),
    ("mix_sources", pipeline_mix),
    ("best_fit_packing", pipeline_pack),
]

#: Compression distances and tokens are not SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs)
    return docs
