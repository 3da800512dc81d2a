"""Operator 2: remove long word sequences that already stand earlier, by a compacted de Bruijn graph.

Nodes and edges. A word 20-mer is an edge. Consecutive edges of a text whose minimiser (the least
hash among their ``seed``-word runs, leftmost on ties) is the same occurrence form a nonbranching
path, which is compacted at once into one record: minimiser, fingerprint of all its words, and the
source coordinates (document, first word, edges). Equal edges have equal minimisers, so all copies of
an edge meet in the records of one minimiser, and only there.

Joining. Records are dealt by minimiser. Where all paths of a minimiser are the same words, the path
is a repeat as a whole: all but the earliest coordinates are removed and its edges are never
listed. Where paths differ (the graph branches: ends of a passage, edited copies), one source each is
looked up by its coordinates, its edges are listed, and the earliest coordinates of every edge decide.
A last join takes the covered spans to their documents. Words are equal if two hashes of 64 bits are: the minimiser's (of ``seed``
words) and the fingerprint (of all).

Skew. A task first compacts equal paths among its own texts, so the commonest passage has one record
a chunk of texts; a minimiser with many different paths in one chunk sends two of them as witnesses, and
the edges listed for all are dealt by their own fingerprints, again compacted first. Records travel as packed arrays, one row a task chunk and bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.llm import textkit
from tarmaq.llm.store import input_bytes, partitions, written

WINDOW = 20
#: Words of a minimiser.
SEED = 8
#: Text bytes whose paths are compacted together before they are sent.
LOCAL_BYTES = 24 << 20
#: Input bytes for each bucket of records, one of which is unpacked at a time; the cluster's width times two at least.
BUCKET_BYTES = 32 << 20
#: Edges that are compacted together before they are sent.
LOCAL_EDGES = 1 << 20
#: Different paths of one minimiser that a task's chunk sends to the minimiser's bucket at most.
LOCAL_PATHS = 16
#: Marks a path that is asked for its edges without its bucket; runs are shorter than a window.
ASK = 1 << 20

_BLOCK = "bucket int, m binary, h binary, doc binary, start binary, run binary"
#: kind 0: words start:start + span are covered by a repeat; 1: the edges of the path are to be listed.
_SPANS = "doc long, kind byte, start int, span int"
_U = np.uint64


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The index of the least of values[i:i + width], the leftmost on ties, for each i that has them."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    v, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        k = len(v) - step
        right = v[step:] < v[:k]
        at = np.where(right, at[step:], at[:k])
        v = np.where(right, v[step:], v[:k])
        have += step
    return at


def paths(first: np.ndarray, hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Compacted paths of a chunk: minimiser hash, fingerprint, index of the first word, edges."""
    at = textkit.full_runs(first, window)
    if not len(at):
        none = np.empty(0, np.int64)
        return none.astype(_U), none.astype(_U), none, none
    seeds = textkit.grams(hashes, seed)
    least = leftmost_minimum(seeds, window - seed + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(at)))
    start = at[head]
    print_ = textkit.span_hash(textkit.prefix_hash(hashes), start, start + run + window - 1)
    return seeds[least[head]], print_, start, run


def _packed(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket with its part of every column as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, np.int64)
    bounds = np.append(heads, len(bucket))
    out = [pa.array(bucket[heads].astype(np.int32))]
    for k, c in enumerate(columns):
        c = c[order]
        parts = [c[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if k == 2:  # documents: differences compress
            parts = [np.diff(p, prepend=np.int64(0)) for p in parts]
        out.append(pa.array([p.tobytes() for p in parts], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=["bucket", "m", "h", "doc", "start", "run"])


def _unpacked(table: pa.Table) -> list[np.ndarray]:
    kinds = (_U, _U, np.int64, np.int32, np.int32)
    out = []
    for k, kind in enumerate(kinds):
        parts = [np.frombuffer(x.as_buffer(), kind) for x in table.column(k + 1).combine_chunks()] if table.num_rows else []
        if k == 2:
            parts = [np.cumsum(p) for p in parts]
        out.append(np.concatenate(parts) if parts else np.empty(0, kind))
    return out


def _spans(doc: np.ndarray, kind: int, start: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(np.full(n, kind, np.int8)), pa.array(start.astype(np.int32)), pa.array(span.astype(np.int32))], names=["doc", "kind", "start", "span"])


def _ordered(m: np.ndarray, h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (m, h, doc, start), and whether each row in it opens a new (m, h)."""
    order = np.lexsort((start, doc, h, m))
    m, h = m[order], h[order]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (h[1:] != h[:-1])
    return order, new


def _later(doc: np.ndarray, start: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Whether a row stands after the first of its group (a repeated row of the table does not)."""
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc != doc[head]) | (start != start[head])


def _flush(held: list[tuple[np.ndarray, ...]], buckets: int, by_minimiser: bool) -> Iterator[pa.RecordBatch]:
    """Compact the records of a task's chunk and send them, dealt by minimiser or by fingerprint.

    Of equal records the earliest goes on; the others (run < 0) are repeats already and are dealt by
    document. A minimiser with more than LOCAL_PATHS different paths branches for sure: two of them go on
    as its witnesses, and all are asked for their edges at once (run >= ASK), dealt by document.
    """
    m, h, doc, start, run = (np.concatenate(x) for x in zip(*held, strict=True))
    order, new = _ordered(m, h, doc, start)
    m, h, doc, start, run = (x[order] for x in (m, h, doc, start, run))
    again = _later(doc, start, new)
    run = np.where(again, -run, run)
    key = m if by_minimiser else h
    bucket = key % _U(buckets)
    by_doc = textkit.mix(doc.astype(_U)) % _U(buckets)
    if by_minimiser and len(m):
        heads = np.flatnonzero(~again)
        opens = np.ones(len(heads), bool)
        opens[1:] = m[heads[1:]] != m[heads[:-1]]
        group = np.cumsum(opens) - 1
        count = np.bincount(group)[group]
        rank = np.arange(len(heads)) - np.flatnonzero(opens)[group]
        many = heads[(count > LOCAL_PATHS) & (rank >= 2)]
        run[many] += ASK
    direct = (run < 0) | (run >= ASK)
    bucket = np.where(direct, by_doc, bucket)
    m, h = np.where(direct, _U(0), m), np.where(direct, _U(0), h)
    back = np.lexsort((start, doc))
    bucket, m, h, doc, start, run = (x[back] for x in (bucket, m, h, doc, start, run))
    yield _packed(bucket.astype(np.int64), [m, h, doc, start.astype(np.int32), run.astype(np.int32)])


def _find(window: int, seed: int, buckets: int):
    """Texts to blocks of compacted paths."""

    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for t in textkit.chunks(batch.column(1)):
                w = textkit.words(t)
                m, h, at, edges = paths(w.first, textkit.word_hashes(t, w), window, seed)
                doc = np.searchsorted(w.first, at, "right") - 1
                held.append((m, h, ids[t.rows][doc], at - w.first[doc], edges))
                size += len(t.data)
                if size >= LOCAL_BYTES:
                    yield from _flush(held, buckets, True)
                    held, size = [], 0
        if held:
            yield from _flush(held, buckets, True)

    return run


def _decide(window: int):
    """The paths of a bucket: repeats are covered whole, paths that branch are asked for their edges."""

    def run(table: pa.Table) -> pa.Table:
        m, h, doc, start, run = _unpacked(table)
        local, asked = run < 0, run >= ASK
        out = [_spans(doc[local], 0, start[local], window - 1 - run[local]), _spans(doc[asked], 1, start[asked], window - 1 + run[asked] - ASK)]
        m, h, doc, start, run = (x[~local & ~asked] for x in (m, h, doc, start, run))
        order, new = _ordered(m, h, doc, start)
        m, doc, start, run = (x[order] for x in (m, doc, start, run))
        again = _later(doc, start, new)
        out.append(_spans(doc[again], 0, start[again], window - 1 + run[again]))
        heads = np.flatnonzero(new)
        same = m[heads[1:]] == m[heads[:-1]]
        branch = np.zeros(len(heads), bool)
        branch[1:] |= same
        branch[:-1] |= same
        heads = heads[branch]
        out.append(_spans(doc[heads], 1, start[heads], window - 1 + run[heads]))
        return pa.Table.from_batches(out)

    return run


def _list_edges(window: int, seed: int, buckets: int):
    """The edges of the asked paths as blocks, dealt by their own fingerprints."""

    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            asked = batch.column(2).is_valid()
            batch = batch.filter(asked)
            if not batch.num_rows:
                continue
            ids, asks = np.asarray(batch.column(0)), batch.column(2)
            bounds = np.asarray(asks.offsets)
            begin, span = (np.asarray(asks.values.field(k)) for k in (0, 1))
            for t in textkit.chunks(batch.column(1)):
                w = textkit.words(t)
                hashes = textkit.word_hashes(t, w)
                a, b = bounds[t.rows.start], bounds[t.rows.stop]
                doc = np.repeat(np.arange(len(t)), np.diff(bounds[t.rows.start : t.rows.stop + 1]))
                edges = span[a:b] - (window - 1)
                start = textkit.pieces_of(w.first[doc] + begin[a:b], edges)
                seeds = textkit.grams(hashes, seed)
                least = leftmost_minimum(seeds, window - seed + 1)[start]
                m = seeds[least]
                h = textkit.span_hash(textkit.prefix_hash(hashes), start, start + window)
                own = np.repeat(doc, edges)
                held.append((m, h, ids[t.rows][own], start - w.first[own], np.ones(len(m), np.int64)))
                size += len(m)
                if size >= LOCAL_EDGES:
                    yield from _flush(held, buckets, False)
                    held, size = [], 0
        if held:
            yield from _flush(held, buckets, False)

    return run


def _earliest(window: int):
    """Edges of a bucket: those that stand later than an equal one, joined to runs."""

    def run(table: pa.Table) -> pa.Table:
        m, h, doc, start, run = _unpacked(table)
        local = run < 0
        known = doc[local], start[local]
        m, h, doc, start = (x[~local] for x in (m, h, doc, start))
        order, new = _ordered(m, h, doc, start)
        doc, start = doc[order], start[order]
        again = _later(doc, start, new)
        doc, start = np.concatenate((known[0], doc[again])), np.concatenate((known[1], start[again]))
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
        heads = np.flatnonzero(new)
        run = np.diff(np.append(heads, len(doc)))
        return pa.Table.from_batches([_spans(doc[heads], 0, start[heads], window - 1 + run)])

    return run


@textkit.lean
def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply the covered spans: word counts, digest and text of what is kept."""
    for batch in batches:
        spans = batch.column(2)
        n, removed, sha, texts = [], [], [], []
        for t in textkit.chunks(batch.column(1)):
            for i in range(len(t)):
                found = t.bytes_of(i).split()
                n.append(len(found))
                own = spans[t.rows.start + i]
                if own.is_valid:
                    edge = np.zeros(len(found) + 1, np.int64)
                    values = own.values
                    start, span = np.asarray(values.field(0)), np.asarray(values.field(1))
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + span, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    found = [x for x, c in zip(found, covered.tolist(), strict=True) if not c]
                removed.append(n[-1] - len(found))
                kept = b" ".join(found)
                sha.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8") if removed[-1] else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "new_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Remove from docs(doc_id, text) each word covered by a window that also starts earlier.

    One row per input row: doc_id, n_words, n_removed, kept_sha256, and new_text (null where nothing
    was removed). Null and empty texts have no words. Rows without doc_id have no place in the order:
    they keep all words and are nobody's source. Repeated rows of a doc_id are one document: they
    don't count as earlier than each other and get the same result (two different texts of one
    doc_id are not supported). An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    buckets = max(2 * partitions(spark), min(input_bytes(docs) // BUCKET_BYTES, 1 << 24))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    known = texts.where(F.col("doc").isNotNull())
    blocks = known.mapInArrow(_find(window, seed, buckets), _BLOCK)
    spans = written(blocks.groupBy("bucket").applyInArrow(_decide(window), _SPANS))
    of_doc = F.collect_list(F.struct("start", "span")).alias("spans")
    asked = spans.where("kind = 1").groupBy("doc").agg(of_doc)
    # Both joins keep all texts, so they read one and the same exchange of the texts.
    edges = texts.join(asked.hint("shuffle_hash"), "doc", "left").mapInArrow(_list_edges(window, seed, buckets), _BLOCK)
    more = edges.groupBy("bucket").applyInArrow(_earliest(window), _SPANS)
    covered = spans.where("kind = 0").unionByName(more).groupBy("doc").agg(of_doc)
    return texts.join(covered.hint("shuffle_hash"), "doc", "left").mapInArrow(_cover, "doc_id long, n_words long, n_removed long, kept_sha256 string, new_text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of the words kept of every document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("new_text")


_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i AS pos, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM words WHERE len(w) >= {WINDOW})
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM windows
), gone AS (
  SELECT DISTINCT doc_id, pos + j AS pos FROM (SELECT doc_id, pos, unnest(generate_series(0, {WINDOW - 1})) AS j FROM ranked WHERE r > 1)
), single AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words WHERE len(w) > 0
), judged AS (
  SELECT s.doc_id, s.pos, s.word, g.pos IS NOT NULL AS out FROM single s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.pos = s.pos
), counted AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE out) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT out), '')) AS kept_sha256
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id
"""

QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {"op2_substring_dedup": _SQL}
