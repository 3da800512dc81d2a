"""Operator 1: toxicity by compression distance.

Two zstandard dictionaries are made from labelled text, by choosing their content: zstandard's own trainer, run on each class's texts
or windows, keeps what is common in both and tells the classes hardly apart (see the README). That of toxic text has the byte strings that are much
commoner in toxic documents besides the strings that are common everywhere, that of ordinary text the latter
only. Each window of six words is compressed with both; the bytes that the toxic dictionary saves are its
distance. A document is described by how many of its windows reach each of several distances, and a logistic
calibration, fitted on documents that the dictionaries have not seen, turns that into a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmaq.llm import textkit
from tarmaq.llm.store import partitions, written

#: The bound of the training sample: documents of each class. Their texts are read whole, by the executors.
SAMPLE_DOCS = 2500
#: Lengths, in bytes, of the strings that are tested for being typical of a class.
GRAMS = (5, 7)
#: A string is toxic if at least MIN_DOCS and MIN_SHARE of the toxic documents have it, RATIO times the ordinary share.
MIN_DOCS, MIN_SHARE, RATIO = 4, 0.02, 20.0
#: Share of the ordinary documents that have a string of the ordinary dictionary.
COMMON_SHARE = 0.03
TOXIC_BYTES, ORDINARY_BYTES = 1024, 4096
#: Words of a window.
WINDOW = 6
LEVEL = 9
#: Distances, in bytes, of the calibrated window counts.
DISTANCES = (1, 2, 3, 4, 6)
FEATURES = 2 * len(DISTANCES) + 2
THRESHOLD = 0.5
FOLDS = 5

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    """Whether a label must not be learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _normal(text: str) -> bytes:
    return b" " + b" ".join(text.encode("utf-8", "replace").translate(_LOWER).split()) + b" "


def _grams(raw: bytes, length: int) -> np.ndarray:
    """Every run of length bytes of raw as one number, 0 where a blank stands inside."""
    a = np.frombuffer(raw, np.uint8).astype(_U)
    n = len(a) - length + 1
    out = np.zeros(max(n, 0), _U)
    for i in range(length if n > 0 else 0):
        out = (out << _U(8)) | a[i : n + i]
    within = np.concatenate(([0], np.cumsum(a == 32)))
    inner = within[length - 1 : length - 1 + len(out)] - within[1 : 1 + len(out)]
    return np.where(inner == 0, out, _U(0))


def _among(values: np.ndarray, kept: np.ndarray) -> np.ndarray:
    if not len(kept):
        return np.zeros(len(values), bool)
    at = np.searchsorted(kept, values)
    at[at == len(kept)] = 0
    return kept[at] == values


def _stretches(raw: bytes, kept: dict[int, np.ndarray]) -> list[bytes]:
    """The longest stretches of kept strings in a text."""
    edge = np.zeros(len(raw) + 1, np.int64)
    for length, strings in kept.items():
        at = np.flatnonzero(_among(_grams(raw, length), strings))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
    step = np.diff(np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False])).astype(np.int8))
    return [raw[a:b] for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]


@dataclass
class Model:
    """Contents of the two dictionaries and the calibration: scale, weights, bias; or a constant score."""

    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float = 0.0


#: Halves of the sample that a set of dictionaries is made from: either, and both.
_SETS = ((0,), (1,), (0, 1))


def _count_grams(sides: dict[int, tuple[int, bool]]):
    """length, gram, t0, t1, o0, o1: toxic and ordinary documents of each half that have a string, summed over some documents."""

    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [(sides[i], _normal(x)) for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                for length in GRAMS:
                    found = [np.unique(_grams(raw, length)) for _, raw in texts]
                    keys, which = np.unique(np.concatenate(found), return_inverse=True)
                    column = np.repeat([side if toxic else 2 + side for (side, toxic), _ in texts], [len(x) for x in found])
                    counts = np.bincount(which * 4 + column, minlength=4 * len(keys)).reshape(-1, 4)[keys > 0]
                    keys = keys[keys > 0].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), length, np.int32)), pa.array(keys), *(pa.array(counts[:, k]) for k in range(4))], names=["length", "gram", "t0", "t1", "o0", "o1"])

    return run


def _count_stretches(sides: dict[int, tuple[int, bool]], kept: dict[tuple[int, bool], dict[int, np.ndarray]]):
    """which, toxic, part, n: stretches of the strings kept for the sets that a document is in."""

    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[int, bool, bytes]] = Counter()
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                side, toxic = sides[i]
                raw = _normal(x)
                for k, halves in enumerate(_SETS):
                    if side in halves:
                        found.update((k, toxic, part) for part in _stretches(raw, kept[k, toxic]))
            rows = [(k, toxic, part, n) for (k, toxic, part), n in found.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("which", "toxic", "part", "n"), r, strict=True)) for r in rows], pa.schema([("which", pa.int32()), ("toxic", pa.bool_()), ("part", pa.binary()), ("n", pa.int64())]))

    return run


def _dictionaries(sample: DataFrame, sides: dict[int, tuple[int, bool]]) -> list[tuple[bytes, bytes]]:
    """Contents of the toxic and the ordinary dictionary of each of _SETS. Both hold the ordinary strings, so that these cancel."""
    n = {(k, c): sum(1 for side, toxic in sides.values() if side in halves and toxic == c) for k, halves in enumerate(_SETS) for c in (True, False)}
    counts = sample.mapInArrow(_count_grams(sides), "length int, gram long, t0 long, t1 long, o0 long, o1 long")
    counts = counts.groupBy("length", "gram").agg(*(F.sum(c).alias(c) for c in ("t0", "t1", "o0", "o1")))
    chosen = []
    for k, halves in enumerate(_SETS):
        t, o = (sum((F.col(f"{c}{side}") for side in halves), F.lit(0)) for c in "to")
        typical = (t >= max(MIN_DOCS, MIN_SHARE * n[k, True])) & (t / n[k, True] >= RATIO * (o + 1) / n[k, False])
        chosen += [typical.alias(f"t{k}"), (o >= COMMON_SHARE * n[k, False]).alias(f"o{k}")]
    # A string is in some share of the documents, so few are left, however many the texts have.
    few = counts.select("length", "gram", *chosen).where(" OR ".join(f"t{k} OR o{k}" for k in range(len(_SETS)))).toPandas()
    few = few.assign(gram=few["gram"].to_numpy(np.int64).view(_U)).sort_values(["length", "gram"])
    kept = {(k, c): {length: few.loc[(few["length"] == length) & few[f"{'t' if c else 'o'}{k}"].astype(bool), "gram"].to_numpy(_U) for length in GRAMS} for k, c in n}
    found = sample.mapInArrow(_count_stretches(sides, kept), "which int, toxic boolean, part binary, n long")
    found = written(found.groupBy("which", "toxic", "part").agg(F.sum("n").alias("n")))

    def content(k: int, toxic: bool, most: int) -> bytes:
        """The commonest stretches, the very commonest last, where they are cheapest to copy."""
        own = found.where((F.col("which") == k) & (F.col("toxic") == toxic))
        out, size = [], 0
        for r in own.orderBy(F.desc("n"), "part").limit(most // min(GRAMS) + 1).collect():
            if size + len(r["part"]) > most:
                break
            out.append(bytes(r["part"]))
            size += len(r["part"])
        return b"".join(reversed(out))

    out = []
    for k in range(len(_SETS)):
        ordinary = content(k, False, ORDINARY_BYTES)
        out.append((content(k, True, TOXIC_BYTES) + ordinary, ordinary))
    return out


class Distances:
    """Compression distances of windows under two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.compress = []
        for content in (toxic, ordinary):
            d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress)

    def of(self, window: bytes) -> int:
        padded = b" " + window + b" "
        toxic, ordinary = self.compress
        return len(ordinary(padded)) - len(toxic(padded))


def features(t: textkit.Texts, distances: Distances) -> np.ndarray:
    """A row for each text: log counts and shares of the windows at each distance, the largest distance, log length."""
    w = textkit.words(t)
    length = np.diff(w.first)
    n = -(-length // WINDOW)  # windows of each text; the last one may be shorter
    out = np.zeros((len(t), FEATURES))
    if not len(w):
        return out
    first = np.concatenate(([0], np.cumsum(n)))
    head = textkit.pieces_of(np.zeros(len(n), np.int64), n) * WINDOW + np.repeat(w.first[:-1], n)
    tail = np.minimum(head + WINDOW, np.repeat(w.first[1:], n)) - 1
    data = textkit._FOLD[t.data]
    data[textkit._IS_SPACE[data]] = 32
    raw = data.tobytes()
    each = np.fromiter((distances.of(raw[a:b]) for a, b in zip(w.start[head].tolist(), w.end[tail].tolist(), strict=True)), np.int64, len(head))
    some = np.flatnonzero(n)
    for k, least in enumerate(DISTANCES):
        upto = np.concatenate(([0], np.cumsum(each >= least)))
        count = upto[first[1:]] - upto[first[:-1]]
        out[:, 2 * k] = np.log1p(count)
        out[:, 2 * k + 1] = 10 * count / np.maximum(n, 1)
    out[some, -2] = np.maximum.reduceat(each, first[:-1][some]) / 4
    out[:, -1] = np.log1p(n)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * beta
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _describe(sides: dict[int, tuple[int, bool]], contents: list[tuple[bytes, bytes]]):
    """id, row: features of each document by the dictionaries of the other half."""

    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = [Distances(*x) for x in contents[:2]]
        for batch in batches:
            side = np.array([sides[i][0] for i in batch.column(0).to_pylist()], np.int64)
            for k in (0, 1):
                own = batch.filter(pa.array(side == k))
                for t in textkit.chunks(own.column(1)):
                    yield pa.RecordBatch.from_arrays([own.column(0).slice(t.rows.start, len(t)), pa.array(features(t, distances[1 - k]).tolist(), pa.list_(pa.float64()))], names=["id", "row"])

    return run


def fit(sample: DataFrame, share: float | None = None) -> Model:
    """Fit on sample(id, text, toxic), ids distinct. share: of toxic documents among all labelled ones, if the sample is not in proportion.

    Each half's documents are described by dictionaries made from the other half; the calibration is fitted on
    these, and the final dictionaries are made from all. Without both classes the score is constant. Executors read the texts;
    the driver gets ids, common strings and features.
    """
    marks = sorted((r["id"], r["toxic"] > 0) for r in sample.select("id", "toxic").collect())
    y = np.array([toxic for _, toxic in marks], bool)
    if len(y) < 4 or y.all() or not y.any() or min(y.sum(), (~y).sum()) < 2:
        return Model(constant=float(share if share is not None else (y.mean() if len(y) else 0.0)))
    sides = {}
    for c in (True, False):
        sides |= {i: (at % 2, c) for at, i in enumerate(i for i, toxic in marks if toxic == c)}
    texts = sample.select("id", "text")
    contents = _dictionaries(texts, sides)
    found = dict(texts.mapInArrow(_describe(sides, contents), "id long, row array<double>").collect())
    rows = np.array([found[i] for i, _ in marks])
    share = float(y.mean()) if share is None else share
    weight = np.where(y, share / y.mean(), (1 - share) / (1 - y.mean()))
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    return Model(*contents[2], mean, scale, _logistic((rows - mean) / scale, y.astype(float), weight))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most SAMPLE_DOCS labelled documents of each class, the first in a hash order of their ids.

    Held-out labels, null labels and labels without a document are not used; of repeated labels the largest counts, of different texts of one id the least.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("toxic").isNotNull())
    usable = usable.groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = usable.join(texts.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id")
    few = order.where("toxic > 0").limit(SAMPLE_DOCS).unionByName(order.where("toxic <= 0").limit(SAMPLE_DOCS))
    # At most 2 * SAMPLE_DOCS ids are broadcast and collected, whatever the input.
    sample = texts.join(F.broadcast(few), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    sample = written(sample.repartition(partitions(spark), "id"))
    total = sum(counts.values())
    return fit(sample, counts.get(True, 0) / total if total else None)


def score_chunk(t: textkit.Texts, model: Model, distances: Distances) -> np.ndarray:
    """Scores from 0 to 1 of the texts of a chunk; those of empty texts too."""
    if model.weights is None:
        return np.full(len(t), model.constant)
    x = (features(t, distances) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, by position as c0, c1, ..., and ``score``: the probability of label 1.

    Whole texts are scored; a null text counts as empty. Equal texts score alike, so repeated rows do too. The text is
    the only input. An empty table gives no rows.
    """
    cols = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(cols))])
    at = cols.index("text")
    plain = plain.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))

    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.toxic, model.ordinary)
        for batch in batches:
            parts = [score_chunk(t, model, distances) for t in textkit.chunks(batch.column(at))]
            scores = pa.array(np.concatenate(parts) if parts else np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in plain.schema.fields]).add("score", T.DoubleType())
    return plain.mapInArrow(run, schema)


def _slim(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score only: texts don't come back from Python."""

    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.toxic, model.ordinary)
        for batch in batches:
            parts = [score_chunk(t, model, distances) for t in textkit.chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.empty(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = _slim(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def pipeline_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The toxicity stage: documents with a score of THRESHOLD or more go."""
    model = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where(F.col("score") < THRESHOLD).drop("score").toDF(*docs.columns)


def crc_held_out(doc_id: int) -> bool:
    """The same as held_out, for tests."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
