"""Operator 6: quality rules by distribution divergence.

Each document's histograms of character classes and of common words are compared with those of its
language by the Jensen-Shannon distance (base 2, 0 to 1). The references are counted over all documents of the language: one
pass counts words and character classes per language, a second one judges. Only shares are compared, so one
very common source weighs as many words as it has and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.llm import textkit
from tarmaq.llm.store import written

MIN_WORDS = 50
#: Base rule: more than this percentage of the words lie in repeated three-word windows.
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
SYMBOLS = b"#*$%&|<>"
#: A word is common in a language if it has at least this share of its words, so at most 1 / COMMON are.
COMMON = 0.002
#: References of languages from this share of all words on are collected, at most 1 / LANGUAGE_SHARE; those of other
#: languages are joined to their documents, from so many words on. Below both there is no reference and no distance.
LANGUAGE_SHARE = 0.001
REFERENCE_WORDS = 5_000
#: Distances above these fail. The guards: histograms of fewer characters or words are not compared.
MAX_CHARS, GUARD_CHARS = 0.30, 200
MAX_WORDS, GUARD_WORDS = 0.335, 100
#: Text bytes whose counts a task sums before it sends them.
COUNT_BYTES = 64 << 20

_CLASSES = 9
_CLASS = np.full(256, 8, np.int64)  # letters outside ASCII
_CLASS[:128] = 6  # other ASCII characters
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[32] = 3
_CLASS[10] = 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[list(SYMBOLS)] = 7
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_U = np.uint64


def class_histograms(t: textkit.Texts) -> np.ndarray:
    """Characters of each class in each text."""
    if not len(t.data):
        return np.zeros((len(t), _CLASSES), np.int64)
    lead = np.flatnonzero((t.data & 0xC0) != 0x80)
    doc = np.searchsorted(t.offsets, lead, "right") - 1
    return np.bincount(doc * _CLASSES + _CLASS[t.data[lead]], minlength=len(t) * _CLASSES).reshape(len(t), _CLASSES)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed counts."""
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


@textkit.lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, kind, key, n: word hashes (kind 0) and character classes (kind 1) with their counts, summed over COUNT_BYTES of text."""
    words: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    shapes: dict[str, np.ndarray] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for name, parts in words.items():
            key, n = _merged(parts)
            kind = np.concatenate((np.zeros(len(key), np.int8), np.ones(_CLASSES, np.int8)))
            keys = np.concatenate((key.view(np.int64), np.arange(_CLASSES)))
            counts = np.concatenate((n, shapes[name])).astype(np.int64)
            names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), np.int32)), pa.array([name])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(kind), pa.array(keys), pa.array(counts)], names=["lang", "kind", "key", "n"])
        words.clear()
        shapes.clear()

    for batch in batches:
        for t in textkit.chunks(batch.column(1)):
            langs = batch.column(0).slice(t.rows.start, len(t)).fill_null("").dictionary_encode()
            lang = np.asarray(langs.indices)
            w = textkit.words(t)
            hashes = textkit.word_hashes(t, w, fold=True)
            of_word = lang[textkit.doc_of(w.first)]
            found = class_histograms(t)
            for k, name in enumerate(langs.dictionary.to_pylist()):
                mine = words.setdefault(name, [])
                mine.append(np.unique(hashes[of_word == k], return_counts=True))
                if len(mine) >= 8:
                    words[name] = [_merged(mine)]
                shapes[name] = shapes.get(name, 0) + found[lang == k].sum(0)
            size += len(t.data)
            if size >= COUNT_BYTES:
                yield from flush()
                size = 0
    yield from flush()


Reference = tuple[np.ndarray, np.ndarray, np.ndarray]


def _reference(shape: list[tuple[int, int]], words: list[tuple[int, int]], total: int) -> Reference:
    """Character class shares, sorted hashes of common words, their shares, of counts by class and by hash."""
    shapes = np.zeros(_CLASSES)
    for key, n in shape:
        shapes[key] = n
    found = sorted((np.int64(key).astype(_U), n) for key, n in words)
    return shapes / max(shapes.sum(), 1), np.array([k for k, _ in found], _U), np.array([n for _, n in found], float) / max(total, 1)


def references(docs: DataFrame) -> tuple[dict[str, Reference], DataFrame]:
    """The references of languages of at least LANGUAGE_SHARE, and a table (lang, total, shape, words) of the counts of others.

    The former are at most 1 / LANGUAGE_SHARE languages, each of at most 1 / COMMON words, whatever the input: these are collected.
    """
    source = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = source.mapInArrow(_count, "lang string, kind byte, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counted = written(counted)
    per_lang = counted.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    everything = per_lang.agg(F.sum("total")).first()[0] or 0
    large = F.col("total") >= LANGUAGE_SHARE * everything

    def counts(own: DataFrame) -> DataFrame:
        rows = counted.join(own, "lang").where((F.col("kind") == 1) | (F.col("n") >= COMMON * F.col("total")))
        pair = F.struct("key", "n")
        return rows.groupBy("lang", "total").agg(F.collect_list(F.when(F.col("kind") == 1, pair)).alias("shape"), F.collect_list(F.when(F.col("kind") == 0, pair)).alias("words"))

    big = {r["lang"]: _reference(r["shape"], r["words"], r["total"]) for r in counts(F.broadcast(per_lang.where(large))).collect()}
    return big, written(counts(per_lang.where(~large & (F.col("total") >= REFERENCE_WORDS))))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q; rows sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def base_counts(t: textkit.Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = textkit.words(t)
    n = np.diff(w.first)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(flags)))
        return upto[t.offsets[1:]] - upto[t.offsets[:-1]]

    chars = per_doc(((t.data & 0xC0) != 0x80) & ~textkit._IS_SPACE[t.data])
    symbols = per_doc(_SYMBOL[t.data])
    repeat = np.zeros(len(t), np.int64)
    at = textkit.full_runs(w.first, REPEAT_WINDOW)
    if len(at):
        doc = textkit.doc_of(w.first)
        key = textkit.grams(textkit.word_hashes(t, w), REPEAT_WINDOW)[at] ^ textkit.mix(doc[at].astype(_U) + _U(1))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[which] > 1]
        covered = np.zeros(len(w), bool)
        for k in range(REPEAT_WINDOW):
            covered[twice + k] = True
        repeat = np.bincount(doc[covered], minlength=len(t))
    dup = np.zeros(len(t), np.int64)
    breaks = per_doc(t.data == 10)
    for i in np.flatnonzero(breaks):
        lines = [x for x in t.bytes_of(i).split(b"\n") if x.strip(textkit.SPACES)]
        dup[i] = len(lines) - len(set(lines))
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}


def _joined(batch: pa.RecordBatch) -> dict[str, Reference]:
    """The references that stand beside the documents of a batch, one for each of its languages."""
    first: dict[str, int] = {}
    for i, name in enumerate(batch.column(1).to_pylist()):
        first.setdefault(name, i)
    pairs = lambda x: [(r["key"], r["n"]) for r in x.as_py()]
    return {name: _reference(pairs(batch.column(4)[i]), pairs(batch.column(5)[i]), batch.column(3)[i].as_py()) for name, i in first.items()}


def _judge(collected: dict[str, Reference] | None):
    """Judge doc_id, lang, text by the collected references, or by those in the columns total, shape and words."""

    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = _joined(batch) if collected is None else collected
            for t in textkit.chunks(batch.column(2)):
                base = base_counts(t)
                n = base["n_words"]
                failed = (n < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
                names = np.array(batch.column(1).slice(t.rows.start, len(t)).to_pylist(), object)
                w = textkit.words(t)
                hashes = textkit.word_hashes(t, w, fold=True)
                doc = textkit.doc_of(w.first)
                shapes = class_histograms(t)
                size = shapes.sum(1)
                far_chars, far_words = np.zeros(len(t)), np.zeros(len(t))
                for name in set(names) & refs.keys():
                    shape, keys, shares = refs[name]
                    own = np.flatnonzero((names == name) & (size > 0) & (n > 0))
                    if not len(own):
                        continue
                    far_chars[own] = js_distance(shapes[own] / size[own, None], shape)
                    if not len(keys):
                        continue
                    row = np.full(len(t), -1)
                    row[own] = np.arange(len(own))
                    mine = row[doc] >= 0
                    at = np.minimum(np.searchsorted(keys, hashes[mine]), len(keys) - 1)
                    at = np.where(keys[at] == hashes[mine], at, len(keys))
                    wide = len(keys) + 1
                    for a in range(0, len(own), 512):  # a histogram has up to 1 / COMMON bins
                        b = min(a + 512, len(own))
                        part = (row[doc[mine]] >= a) & (row[doc[mine]] < b)
                        hist = np.bincount((row[doc[mine]][part] - a) * wide + at[part], minlength=(b - a) * wide).reshape(b - a, wide)
                        far_words[own[a:b]] = js_distance(hist / n[own[a:b], None], np.append(shares, max(0.0, 1 - shares.sum())))
                bad = ((size >= GUARD_CHARS) & (far_chars > MAX_CHARS)) | ((n >= GUARD_WORDS) & (far_words > MAX_WORDS))
                columns = [batch.column(0).slice(t.rows.start, len(t)), *(pa.array(x.astype(np.int64)) for x in base.values()), pa.array(failed), pa.array(~failed & ~bad), pa.array(far_chars), pa.array(far_words)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *base, "base_failed", "kept", "js_chars", "js_words"])

    return run


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, lang, text): base counts, base_failed, kept, js_chars, js_words.

    Null and empty texts have no words, fail the base rules and are not kept; their distances are 0. A null
    language counts as the empty one. Documents of a language without a reference are judged by the base rules only, their
    distances are 0: another language's words say nothing about them. Repeated rows are judged each, and weigh in the
    references each. An empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    out = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_chars double, js_words double"
    big, small = references(docs)
    if small.isEmpty():
        return source.mapInArrow(_judge(big), out)
    rest = source.join(small.select("lang"), "lang", "left_anti").select("doc_id", "lang", "text")
    beside = source.join(small, "lang").select("doc_id", "lang", "text", "total", "shape", "words")
    return rest.mapInArrow(_judge(big), out).unionByName(beside.mapInArrow(_judge(None), out))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("js_chars", "js_words")


_W = "[^\\x20\\x09-\\x0D]"
_CLASS_SQL = ("[a-z]", "[A-Z]", "[0-9]", "[ ]", "\\n", "[.,;:!?''\"()-]", None, "[#*$%&|<>]", "[^\\x00-\\x7F]")
_COUNTS = ", ".join("length(text)" + "".join(f" - len(regexp_extract_all(text, '{c}'))" for c in _CLASS_SQL if c) if x is None else f"len(regexp_extract_all(text, '{x}'))" for x in _CLASS_SQL)
_HALF = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"
# The oracle holds languages under LANGUAGE_SHARE against all documents, which judge() does not; the tables here have none.
_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, lang, text, regexp_extract_all(text, '{_W}+') AS ws, [{_COUNTS}] AS shape FROM d
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_W}') GROUP BY r
), runs AS (
  SELECT r, i, ws[i:i + 2] AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM runs) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r
), base AS (
  SELECT w.r, doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, shape, length(text) AS size
  FROM w LEFT JOIN lines ON lines.r = w.r LEFT JOIN repeats ON repeats.r = w.r
), single AS (
  SELECT r, lang, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM (SELECT r, lang, unnest(ws) AS x FROM w)
), totals AS (
  SELECT lang, count(*) AS total FROM single GROUP BY lang
), own AS (
  SELECT lang, total FROM totals WHERE total >= {LANGUAGE_SHARE} * (SELECT sum(total) FROM totals)
), ref AS (
  SELECT b.*, coalesce(own.lang, chr(1)) AS ref FROM base b LEFT JOIN own ON own.lang = b.lang
), shapes AS (
  SELECT ref, k, sum(c) / sum(sum(c)) OVER (PARTITION BY ref) AS q FROM (
    SELECT lang AS ref, unnest(range(1, 10)) AS k, unnest(shape) AS c FROM base UNION ALL SELECT chr(1), unnest(range(1, 10)), unnest(shape) FROM base) GROUP BY ref, k
), common AS (
  SELECT s.lang AS ref, x, count(*) / any_value(total) AS q FROM single s JOIN own ON own.lang = s.lang GROUP BY s.lang, x HAVING count(*) >= {COMMON} * any_value(total)
  UNION ALL SELECT chr(1), x, count(*) / (SELECT sum(total) FROM totals) FROM single GROUP BY x HAVING count(*) >= {COMMON} * (SELECT sum(total) FROM totals)
), far_chars AS (
  SELECT r, sqrt(greatest(0, (sum({_HALF.format(x="p", y="q")}) + sum({_HALF.format(x="q", y="p")})) / 2)) AS c
  FROM (SELECT r, k, p, q FROM (SELECT r, ref, unnest(range(1, 10)) AS k, unnest(shape) / size AS p FROM ref WHERE size > 0 AND n_words > 0) JOIN shapes USING (ref, k)) GROUP BY r
), hits AS (
  SELECT r, any_value(ref.ref) AS ref, x, count(*) / any_value(n_words) AS p FROM single JOIN ref USING (r) GROUP BY r, x
), parts AS (
  SELECT r, sum({_HALF.format(x="p", y="q")}) AS a, sum({_HALF.format(x="q", y="p")}) AS b, sum(p) AS ps, sum(q) AS qs FROM hits JOIN common USING (ref, x) GROUP BY r
), rest AS (
  SELECT ref.r, coalesce(a, 0) AS a, coalesce(b, 0) AS b, greatest(0, 1 - coalesce(ps, 0)) AS po, greatest(0, 1 - coalesce(t.q, 0)) AS qo, coalesce(t.q, 0) - coalesce(qs, 0) AS missed
  FROM ref LEFT JOIN parts ON parts.r = ref.r LEFT JOIN (SELECT ref, sum(q) AS q FROM common GROUP BY ref) t ON t.ref = ref.ref
), far_words AS (
  SELECT r, sqrt(greatest(0, (a + b + missed + {_HALF.format(x="po", y="qo")} + {_HALF.format(x="qo", y="po")}) / 2)) AS v FROM rest
), judged AS (
  SELECT ref.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         (size >= {GUARD_CHARS} AND coalesce(c, 0) > {MAX_CHARS}) OR (n_words >= {GUARD_WORDS} AND v > {MAX_WORDS}) AS bad
  FROM ref LEFT JOIN far_chars ON far_chars.r = ref.r LEFT JOIN far_words ON far_words.r = ref.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM judged
"""

QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": _SQL}
