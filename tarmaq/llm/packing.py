"""Operator 7: hierarchical residual best-fit packing of token sequences.

Every task tokenises its documents, cuts the long ones and packs its own pieces best-fit,
largest first. Bins that are nearly full are final. The others go up a tree as items: each node
packs the underfull bins of several nodes below it, best-fit again, until one node is left. A node holds about
``node_items`` bins: more bins make more nodes. Rounds at the same number of nodes deal the bins anew, and sizes that
can share a sequence are in the same proportion at every node, so mates meet; the tree ends where such a round merges next to nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.llm import textkit, tokens
from tarmaq.llm.store import partitions, written

CAPACITY = 1024
EOS = 2
#: Free places up to which a bin counts as nearly full and is final.
SLACK = 2
FAN_IN = 8
NODE_ITEMS = 200_000
#: Rounds at one number of nodes, at most, and the least share of the bins that one must merge for another.
SAME_ROUNDS, LEAST_MERGED = 6, 0.01

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, off long, fill long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit, largest first: the bin and the offset of each item, and the fill of each bin.

    Residuals are at most ``capacity``, so one bit per residual finds the tightest open bin.
    """
    bin_of = np.zeros(len(sizes), np.int64)
    offset = np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    residuals = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = residuals >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                residuals ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bin_of[i], offset[i] = b, fills[b]
        fills[b] += size
        if left := room - size:
            open_bins[left].append(b)
            residuals |= 1 << left
    return bin_of, offset, np.array(fills, np.int64)


def cut(n: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of n ids: full pieces, but for a shorter first one."""
    if n <= capacity:
        return np.zeros(1, np.int64), np.full(1, n, np.int64)
    bounds = np.concatenate(([0], np.arange(n % capacity or capacity, n + 1, capacity)))
    return bounds[:-1], np.diff(bounds)


def _pack_partition(path: str, capacity: int, eos: int, specials: bool):
    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: list[tuple[np.ndarray, ...]] = []
        nulls: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0)
            for t in textkit.chunks(batch.column(1), tokens.TOKEN_CHUNK):
                e = tokens.encode(t, path, specials)
                doc = ids.slice(t.rows.start, len(t))
                counts = e.counts()
                rows: list[tuple[int, int, int, int, int]] = []
                at = 0
                while at < len(t):  # few documents at a time: their ids are made flat
                    to = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), 1 << 20)) + at)
                    ps = slice(e.first[at], e.first[to])
                    flat = e.ids[textkit.pieces_of(e.start[ps], e.length[ps])]
                    begin = 0
                    for i in range(at, to):
                        own = np.append(flat[begin : begin + counts[i]], np.uint32(eos)).astype("<u4")
                        begin += counts[i]
                        for p, (s, n) in enumerate(zip(*cut(len(own), capacity), strict=True)):
                            rows.append((i, p, s, n, zlib.crc32(own[s : s + n].tobytes())))
                    at = to
                got = np.array(rows, np.int64).reshape(-1, 5)
                found.append((np.asarray(doc.fill_null(0))[got[:, 0]], got[:, 1], got[:, 2], got[:, 3], got[:, 4]))
                nulls.append(~np.asarray(doc.is_valid())[got[:, 0]])
        if not found:
            return
        doc, piece, start, length, crc = (np.concatenate(x) for x in zip(*found, strict=True))
        null = np.concatenate(nulls)
        bin_of, offset, fills = best_fit(length, capacity)
        base = np.int64(TaskContext.get().partitionId()) << np.int64(32)
        columns = [pa.array(doc, pa.int64(), mask=null), pa.array(piece, pa.int32()), *map(pa.array, (start, length, crc, base + bin_of, offset, fills[bin_of]))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "off", "fill"]
        for at in range(0, len(doc), 100_000):
            yield pa.RecordBatch.from_arrays([c.slice(at, 100_000) for c in columns], names=names)

    return run


def _merge(capacity: int):
    def run(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        bin_of, offset, fills = best_fit(node["fill"].to_numpy(), capacity)
        lead = np.zeros(len(fills), np.int64)
        lead[bin_of[::-1]] = node["bin"].to_numpy()[::-1]  # a merged bin is named after its first item
        return pd.DataFrame({"bin": node["bin"], "into": lead[bin_of], "shift": offset, "fill": fills[bin_of]})

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, eos: int = EOS, slack: int = SLACK, fan_in: int = FAN_IN, node_items: int = NODE_ITEMS, specials: bool = False) -> DataFrame:
    """Pack the token ids of docs(doc_id, text) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty
    text is the ``eos`` id alone. Only documents longer than a sequence are cut; all their pieces are
    full but the first. Repeated rows (and rows without doc_id) are packed each on its own; other
    columns are not read. ``specials`` as in ``tokens.encode``. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(source.mapInArrow(_pack_partition(path or tokens.default_path(), capacity, eos, specials), _PIECES))
    level = pieces.where((F.col("off") == 0) & (F.col("fill") < capacity - slack)).select("bin", "fill", F.lit(0).alias("node"))
    nodes = partitions(spark)
    moved: DataFrame | None = None
    left = level.count()
    same = turn = 0
    while left > 1:
        before_nodes, nodes = nodes, max(-(-nodes // fan_in), -(-left // node_items))
        same = same + 1 if nodes >= before_nodes else 0
        turn += 1
        # Another seed each round: bins that did not meet at the same number of nodes would never do so.
        dealt = level.withColumn("node", F.pmod(F.xxhash64("bin", F.lit(nodes), F.lit(turn)), F.lit(nodes)).cast("int"))
        step = written(dealt.groupBy("node").applyInPandas(_merge(capacity), "bin long, into long, shift long, fill long"))
        if moved is None:
            moved = step.select("bin", "into", "shift")
        else:
            now = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moved = written(moved.join(now, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")))
        level = step.where((F.col("shift") == 0) & (F.col("fill") < capacity - slack)).select(F.col("into").alias("bin"), "fill")
        before, left = left, level.count()
        # Bins that can't share a sequence would only travel on, for ever at an unchanged number of nodes.
        if nodes == 1 or same >= SAME_ROUNDS or (nodes <= -(-before // node_items) and left > (1 - LEAST_MERGED) * before):
            break
    out = pieces if moved is None else pieces.join(moved, "bin", "left")
    into, shift = (F.col("bin"), F.lit(0)) if moved is None else (F.coalesce("into", "bin"), F.coalesce("shift", F.lit(0)))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", into.alias("sequence_id"), (F.col("off") + shift).cast("long").alias("offset"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), specials=True)


def pipeline_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last pipeline stage: packed pieces of what is left, repetitions included."""
    return pack(docs, specials=True)


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
