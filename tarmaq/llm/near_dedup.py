"""Operator 3: near-duplicate groups by an inverted join on MinHash coordinates.

1. Each text becomes its set of distinct 4-word shingles (64-bit hashes), a 128-bit fingerprint of the set and
   a MinHash signature. Equal sets are one class; only its least doc_id, the representative, goes on.
2. Every (coordinate, value) is a posting key. Pairs at Jaccard 0.8 agree in at least MATCHES of
   COORDINATES keys but for one in 3e7, so with keys ordered by rarity a representative is posted only
   under its COORDINATES - MATCHES + 1 rarest (the prefix), and one with too few shared keys not at all.
3. Collisions are counted on the signatures of candidate pairs; those under MATCHES are skipped, the rest
   are confirmed on the full sets.
4. Every posting list is joined to its most central member (its centre) only, which is linear in the list
   and links most of a large group of copies. Lists whose members are in one component then are skipped.
5. In the lists that are left, heavily edited copies of one text share keys with all others and are linked with few. All their
   pairs are decided without listing them: each member is written as its difference to the list's centre. Two
   members' sets differ by what their differences differ by, so two that are to be linked, not both linked with the
   centre, must have some of their differences in common, the same word edited in the same way. The differences are posted in
   order of rarity, prefixes only, and pairs that could still reach the similarity by what follows are confirmed. Random edits are nobody else's and are not posted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.llm import textkit
from tarmaq.llm.components import components
from tarmaq.llm.rounds import Linked, centred, several
from tarmaq.llm.store import written

WORDS = 4
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 80
COORDINATES = 48
#: Binomial(48, 0.8) is below 22 with probability 3.4e-8.
MATCHES = 22

_U = np.uint64
_SIGNED = "doc_id long, n_shingles long, ha long, hb long, sig array<long>"
_KEYS = textkit.mix(np.arange(1, COORDINATES + 1, dtype=_U) * _U(0xD1342543DE82EF95))


def shingle_hashes(t: textkit.Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word runs, document after document, and each document's bounds in them.

    A document with fewer words has its whole sequence as the only one.
    """
    w = textkit.words(t)
    hashes = textkit.word_hashes(t, w, fold=True)
    count = np.diff(w.first)
    runs = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    length = np.where(count >= words, words, count)
    start = textkit.pieces_of(w.first[:-1], runs)
    return textkit.span_hash(textkit.prefix_hash(hashes), start, start + np.repeat(length, runs)), np.concatenate(([0], np.cumsum(runs)))


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each document, and their bounds."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else hashes), np.concatenate(([0], np.cumsum(sizes)))


def _sign(words: int):
    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for t in textkit.chunks(batch.column(1)):
                hashes, bounds = _distinct(*shingle_hashes(t, words))
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                sig = np.zeros((len(t), COORDINATES), _U)
                ha, hb = np.zeros(len(t), _U), np.zeros(len(t), _U)
                if len(some):
                    at = bounds[:-1][some]
                    ha[some] = np.add.reduceat(textkit.mix(hashes ^ _U(0x2545F4914F6CDD1D)), at)
                    hb[some] = np.add.reduceat(textkit.mix(hashes + _U(0x9FB21C651E98DF25)), at)
                    for c, key in enumerate(_KEYS):
                        x = (hashes ^ key) * _U(0x9E3779B97F4A7C15)
                        x ^= x >> _U(32)
                        x *= _U(0xD6E8FEB86659FD93)
                        sig[some, c] = textkit.mix(np.minimum.reduceat(x, at) + key)
                flat = pa.array(sig.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, COORDINATES, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([ids.slice(t.rows.start, len(t)), pa.array(n), pa.array(ha.view(np.int64)), pa.array(hb.view(np.int64)), lists], names=["doc_id", "n_shingles", "ha", "hb", "sig"])

    return run


def _sets(words: int):
    """Sorted distinct shingle hashes of each text."""

    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in textkit.chunks(batch.column(1)):
                hashes, bounds = _distinct(*shingle_hashes(t, words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.rows.start, len(t)), pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["id", "shingles"])

    return run


def _wide(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), _U)


def _member(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of b's elements the sorted, not empty a has."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return a[at] == b


def _confirm(percent: int):
    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last: tuple[int, np.ndarray] | None = None
            a_ids = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                if last is None or last[0] != a_ids[i]:
                    last = (a_ids[i], _wide(batch.column(2)[i]))
                a, b = last[1], _wide(batch.column(3)[i])
                both = int(_member(a, b).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


@textkit.lean
def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(o, id, c, n, no, shingles, centre's) to (o, id, c, n, no, m, d): what id has and o lacks, or the other way round, as hashes, and how many."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = []
            for i in range(part.num_rows):
                a, b = _wide(part.column(5)[i]), _wide(part.column(6)[i])
                more, less = a[~_member(b, a)], b[~_member(a, b)]
                found.append(np.concatenate((textkit.mix(more), textkit.mix(less ^ _U(0x5851F42D4C957F2D)))))
            size = np.array([len(x) for x in found], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(size), lists], names=["o", "id", "c", "n", "no", "m", "d"])


def _prefixes(reps: DataFrame, matches: int) -> DataFrame:
    """key, id, score: the postings of each signature's rarest coordinates, but for those nobody shares.

    Two signatures with ``matches`` equal coordinates share one of the first COORDINATES - matches + 1 in any common
    order, here by rarity. Unshared coordinates come first in it and fill the prefix; a signature with fewer than
    ``matches`` shared ones has no postings. score is the share of shared coordinates: the member that others were edited
    from has the most.
    """
    items = reps.select("id", F.explode("sig").alias("key"))
    shared = items.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    own = items.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys")).where(F.size("keys") >= matches)
    prefix = F.slice("keys", F.lit(1), F.size("keys") - matches + 1)
    return own.select("id", F.explode(prefix).alias("k"), (F.size("keys") / COORDINATES).alias("score")).select(F.col("k")["key"].alias("key"), "id", "score")


def difference_pairs(first: Linked, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components, from one open list, that may reach percent: none that does is missing.

    z and y are linked if |z ^ y| * (100 + percent) <= (100 - percent) * (|z| + |y|), ^ being what either has alone. With the differences
    dz = z ^ o, dy = y ^ o to a centre o, z ^ y = dz ^ dy: they need |dz & dy| >= (|dz| + |dy| - share * (|z| + |y|)) / 2
    in common. A member within share * (|z| + |o|) of its centre is linked with it; pairs of two such are in one component
    already. For any other pair the need is positive, and its least value over all partners gives each side's prefix.
    """
    near, far = 100 - percent, 100 + percent  # share = near / far
    groups = several(first.open.join(first.centres, "key").select("o", "id", "c").distinct(), ["o"])
    size_of = lambda x, n: sizes.select(F.col("id").alias(x), F.col("n_shingles").alias(n))
    whole = groups.join(size_of("id", "n"), "id").join(size_of("o", "no"), "o").join(sets, "id").join(sets.toDF("o", "centre"), "o")
    diff = written(whole.select("o", "id", "c", "n", "no", "shingles", "centre").mapInArrow(_difference, "o long, id long, c long, n long, no long, m long, d array<long>"))
    items = diff.select("o", "id", F.explode("d").alias("e"))
    shared = items.groupBy("o", "e").agg(F.count("*").alias("df")).where("df > 1")
    own = items.join(shared, ["o", "e"]).groupBy("o", "id").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("keys"))
    own = own.join(diff.drop("d"), ["o", "id"])
    inside = F.col("m") * far <= near * (F.col("n") + F.col("no"))
    # Twice the need, times far, for the partner that needs least: an outer member's has few differences (at least one), an inner one's is just outside.
    least = F.when(inside, F.col("m") * far + near * (F.col("no") - F.col("n")) + 1).otherwise(F.col("m") * far - near * (F.col("n") + F.col("no")) + 2 * percent)
    need = F.greatest(F.ceil(least / (2 * far)), F.lit(1)).cast("int")
    own = own.withColumn("inside", inside).withColumn("need", need).where(F.size("keys") >= F.col("need"))
    spot = F.posexplode(F.slice("keys", F.lit(1), F.size("keys") - F.col("need") + 1)).alias("at", "k")
    post = own.select("o", "id", "c", "n", "m", "inside", F.size("keys").alias("shared"), spot)
    post = post.select("o", F.col("k")["e"].alias("e"), "id", "c", "n", "m", "inside", (F.col("shared") - F.col("at")).alias("rest"))
    post = written(post)
    other = post.where("NOT inside").select("o", "e", *(F.col(x).alias(f"{x}2") for x in ("id", "c", "n", "m", "rest")))
    enough = F.least("rest", "rest2") * 2 * far >= (F.col("m") + F.col("m2")) * far - near * (F.col("n") + F.col("n2"))
    once = F.col("inside") | (F.col("id") < F.col("id2"))
    pairs = post.join(other, ["o", "e"]).where((F.col("c") != F.col("c2")) & once & enough)
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs(doc_id, text).

    Links join documents whose shingle sets have 100 * intersection >= percent * union; component_id is the
    least doc_id reachable. A-Z count as a-z. Documents without words (null and empty texts too)
    have n_shingles 0 and are linked with nothing. Rows without doc_id are linked with nothing: their
    component_id is null and they are kept. Repeated rows get the same component, so all rows of the
    least doc_id are kept. An empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(texts.mapInArrow(_sign(words), _SIGNED))
    same = ["ha", "hb", "n_shingles"]
    reps = written(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    sizes = reps.select("id", "n_shingles")
    post = written(_prefixes(reps, matches))
    post = written(post.join(post.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key", "left_semi"))
    wanted = post.select("id").distinct()
    sets = written(texts.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi").mapInArrow(_sets(words), "id long, shingles binary").dropDuplicates(["id"]))

    def confirm(pairs: DataFrame) -> DataFrame:
        one, two = (reps.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
        near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        agreeing = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
        likely = pairs.join(one, "a").join(two, "b").where(near & (agreeing >= matches)).select("a", "b")
        whole = likely.join(sets.toDF("b", "zb"), "b").join(sets.toDF("a", "za"), "a").select("a", "b", "za", "zb")
        return whole.mapInArrow(_confirm(percent), "a long, b long")

    first = centred(post, confirm)
    label = first.label
    if not first.open.isEmpty():
        more = written(confirm(written(difference_pairs(first, sets, sizes, percent))))
        if not more.isEmpty():
            label = components(more if first.links is None else first.links.unionByName(more))
    classes = reps.select(*same, F.col("id").alias("rep"))
    if label is not None:
        classes = classes.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    else:
        classes = classes.withColumnRenamed("rep", "component")
    slim = signed.select("doc_id", *same)
    grouped = slim.join(classes, same, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return grouped.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pipeline_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The near-duplicate stage: one document of each group stays."""
    gone = near_groups(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {WORDS - 1}, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.n >= {PERCENT} * (x.n + y.n - p.n)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS id, a AS other FROM both_ways UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
), least_id AS (
  SELECT id, min(other) AS component FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least_id c ON c.id = d.doc_id
"""

QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
ORACLES = {"op3_minhash_near_dedup": _SQL}
