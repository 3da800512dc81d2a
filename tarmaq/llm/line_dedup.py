"""Operator 9: drop lines that many documents share.

Lines are exploded as 128-bit hashes of their normalised form, distinct documents are counted per
hash, and each document gets back the hashes among its own lines that are over the threshold.
A hash is frequent for the join if it has at least one in ``HOT_KEYS`` of all counted pairs, so there
are at most ``HOT_KEYS`` frequent ones: they are broadcast, and no task gets all rows of one line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmaq.llm import textkit
from tarmaq.llm.store import written

MIN_DOCS = 10
MIN_CHARS = 1
HOT_KEYS = 4096

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Stands for a missing doc_id: all rows without one count as one document.
NO_ID = -(1 << 63)


def key_of(line: bytes) -> bytes:
    """The line without separators at its ends, A-Z lower-cased."""
    return line.strip(textkit.SPACES).translate(_LOWER)


def _hash(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh128_digest(key)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _keys(min_chars: int):
    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for t in textkit.chunks(batch.column(1)):
                rows = [(ids[t.rows.start + i], *_hash(k)) for i in range(len(t)) for k in set(map(key_of, t.bytes_of(i).split(b"\n"))) if _long_enough(k, min_chars)]
                cols = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "a", "b"])

    return run


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """id, hits: for each document that has any, the hashes of its lines found in min_docs documents."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))
    pairs = written(source.mapInArrow(_keys(min_chars), "id long, a long, b long"))
    counted = written(pairs.groupBy("a", "b").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= min_docs))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_KEYS >= F.lit(total)  # at most HOT_KEYS rows, whatever the input
    few = pairs.join(F.broadcast(counted.where(hot).select("a", "b")), ["a", "b"])
    many = pairs.join(counted.where(~hot).select("a", "b"), ["a", "b"])
    return few.unionByName(many).groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("hits"))


def _drop(text_at: int, with_text: bool):
    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, dropped, sha = [], [], [], []
            hits_at = batch.num_columns - 1
            for t in textkit.chunks(batch.column(text_at)):
                for i in range(len(t)):
                    hits = batch.column(hits_at)[t.rows.start + i]
                    lines = t.bytes_of(i).split(b"\n")
                    kept = lines
                    if hits.is_valid:
                        out = {(h["a"], h["b"]) for h in hits.as_py()}
                        kept = [x for x in lines if _hash(key_of(x)) not in out]
                    whole = b"\n".join(kept)
                    texts.append(whole.decode("utf-8") if t.valid[i] and with_text else None)
                    n.append(len(lines))
                    dropped.append(len(lines) - len(kept))
                    sha.append(hashlib.sha256(whole).hexdigest())
            columns = [pa.array(texts, pa.string()) if k == text_at else batch.column(k) for k in range(hits_at)]
            columns += [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    return run


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, with_text: bool = True) -> DataFrame:
    """Documents without the lines whose key at least min_docs distinct doc_ids have.

    A text is split at line feeds; a null or empty text is one empty line (a null text stays null).
    Keys shorter than min_chars code points always stay. All columns are returned by position, text
    replaced, followed by three: lines before, lines dropped, SHA-256 of what is kept. Repeated rows
    of one doc_id count as one document and are each returned; so do all rows without doc_id.
    An empty table gives no rows. Without with_text the texts are null: only the counts and digests are wanted.
    """
    cols = docs.columns
    hits = frequent_lines(docs, min_docs, min_chars)
    plain = docs.toDF(*[f"c{k}" for k in range(len(cols))])
    at = {c: f"c{k}" for k, c in enumerate(cols)}
    plain = plain.withColumn(at["text"], F.col(at["text"]).cast("string")).withColumn("id", F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(NO_ID)))
    joined = plain.join(hits, "id", "left").select(*at.values(), "hits")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in joined.schema.fields[:-1]])
    for k, kind in enumerate((T.LongType(), T.LongType(), T.StringType())):
        schema = schema.add(f"c{len(cols) + k}", kind)
    return joined.mapInArrow(_drop(cols.index("text"), with_text), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts before and after, and a digest of what is kept, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_frequent_lines(docs, with_text=False).toDF("doc_id", "text", "n_lines", "n_dropped", "kept_sha256").drop("text")


def pipeline_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The line stage: documents with the frequent lines gone and n_chars counted anew."""
    cols = docs.columns
    out = drop_frequent_lines(docs).toDF(*cols, "_lines", "_dropped", "_sha").drop("_lines", "_dropped", "_sha")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cols else out


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), judged AS (
  SELECT doc_id, pos, line, f.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent f USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": _SQL}
