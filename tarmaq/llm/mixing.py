"""Operator 4: mix sources to target weights by capped water-filling, in DataFrame functions only.

A source's documents are ordered by a seeded digest and cut into ``2**BUCKET_BITS`` buckets of that
order. Bucket totals tell, by prefix sums, which buckets are taken whole; only the rows of one bucket
are ever ordered within a task, so a source with a third of all rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarmaq.llm.store import written

WEIGHTS = (3, 1, 2)
#: Size of the mix in percent of all words.
PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"
BUCKET_BITS = 12

#: Digest bits that order the documents: the first 13 hexadecimal digits.
_ORDER_BITS = 52
_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def draw_order(seed: str, doc_id: Column) -> Column:
    """A seeded 52-bit number per doc_id, the same in any engine that has MD5."""
    hexed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources(source, source_size), one row each: adds ``target``.

    Weights repeat over the sources by code point, null last. Sources fill in the order of
    cap / weight: with the first k at their caps, the others share the rest by weight, and the right
    k is the least for which none of the others is above its cap. Ties fill together. The windows run
    over one small row per source. Sources without words have target 0.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.select("source", "source_size", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).alias("rank"))
    ranked = ranked.select("source", "source_size", cycle.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    fill = F.col("cap") / F.col("weight")
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy(fill).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranked.select(
        "source", "source_size", "weight", "cap",
        (F.sum("cap").over(upto) - F.sum("cap").over(Window.partitionBy(fill))).alias("capped"),
        (F.sum("weight").over(every) - F.sum("weight").over(upto) + F.sum("weight").over(Window.partitionBy(fill))).alias("open_weight"),
        (F.sum("source_size").over(every) * F.lit(percent) / F.lit(100)).alias("total"),
    )
    # A source is open if the level reached when only lighter ones are capped leaves it below its cap.
    level = (F.col("total") - F.col("capped")) / F.col("open_weight")
    leveled = sums.select("*", level.alias("level"), (level * F.col("weight") < F.col("cap")).alias("open"))
    final = F.min(F.when(F.col("open"), F.struct(fill.alias("fill"), F.col("level").alias("level")))).over(every)["level"]
    return leveled.select("source", "source_size", F.when(F.col("open"), final * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, size: str | None = None, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs followed by size, source_size, target and copies: how often the mix takes each document.

    target / source_size = n + f: each document is taken n times, and those that come first in the
    seeded order once more, up to the document that brings the source nearest to its target. So a
    source misses its target by half a document at most. ``size`` names the column of sizes; without it they are the text's words. Rows tie by
    size and text digest where a doc_id repeats; equal rows are interchangeable. A null text has size 0, a null source is a source
    of its own, a null doc_id is ordered as the word null. Rows of size 0 are taken as their place in
    the order has it. An empty table gives no rows. Columns of docs may have any names: they come back in their places, also
    beside new ones of the same name.
    """
    cols = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(cols))])
    source, doc_id, text = (F.col(f"c{cols.index(c)}") for c in ("source", "doc_id", "text"))
    size_column = word_count(text) if size is None else F.coalesce(F.col(f"c{cols.index(size)}").cast("long"), F.lit(0).cast("long"))
    rows = plain.withColumns({"size": size_column, "u": draw_order(seed, doc_id), "none": source.isNull(), "key": F.coalesce(source.cast("string"), F.lit(""))})
    rows = rows.withColumn("bucket", F.shiftright("u", _ORDER_BITS - BUCKET_BITS).cast("int"))
    key = ["none", "key"]
    parts = rows.groupBy(*key, "bucket").agg(F.sum("size").alias("part"))
    totals = parts.groupBy(*key).agg(F.sum("part").alias("source_size"))
    filled = water_fill(totals.select(F.when(~F.col("none"), F.col("key")).alias("source"), "source_size"), weights, percent, max_epochs)
    filled = filled.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("key"), "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    before = F.sum("part").over(Window.partitionBy(*key).orderBy("bucket")) - F.col("part")
    plan = parts.withColumn("before", before).join(filled, key).withColumn("whole", whole).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.drop("part")
    placed = rows.join(plan.hint("merge"), [*key, "bucket"])
    inside = Window.partitionBy(*key, "bucket").orderBy("u", doc_id, "size", F.md5(F.coalesce(text.cast("string"), F.lit("")))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum("size").over(inside) - F.col("size")
    # Taken once more if its middle lies before the remainder: that rounds to the nearest document.
    again = F.when(2 * start + F.col("size") < 2 * F.col("more"), 1).otherwise(0)
    return placed.withColumn("copies", (F.col("whole") + again).cast("int")).select(*plain.columns, "size", "source_size", "target", "copies").toDF(*cols, "size", "source_size", "target", "copies")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document in a mix of 150 percent."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Texts are read and counted once; the plan below reads sizes twice.
    slim = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")))
    mixed = mix(slim.withColumn("text", F.lit(None).cast("string")), size="words")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def pipeline_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixing stage: each document as often as the mix takes it."""
    cols = docs.columns
    mixed = mix(docs)
    plain = mixed.toDF(*[f"c{k}" for k in range(len(cols))], "size", "source_size", "target", "copies")
    own = plain.columns[: len(cols)]
    return plain.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*own).toDF(*cols)


_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source
), w AS (
  SELECT source, source_size, source_size * {MAX_EPOCHS} AS cap, [{", ".join(map(str, WEIGHTS))}][((rank - 1) % {len(WEIGHTS)}) + 1] AS weight FROM s
), l AS (
  SELECT a.source, a.source_size, a.cap, a.weight, a.cap::DOUBLE / a.weight AS fill,
         (SELECT sum(source_size)::DOUBLE * {PERCENT} / 100 FROM w)
         - coalesce((SELECT sum(cap)::DOUBLE FROM w b WHERE b.cap::DOUBLE / b.weight < a.cap::DOUBLE / a.weight), 0) AS rest,
         (SELECT sum(weight)::DOUBLE FROM w b WHERE b.cap::DOUBLE / b.weight >= a.cap::DOUBLE / a.weight) AS open_weight
  FROM w a
), o AS (
  SELECT *, rest / open_weight AS level, rest / open_weight * weight < cap AS open FROM l
), t AS (
  SELECT source, source_size, CASE WHEN open THEN (SELECT arg_min(level, fill) FROM o WHERE open) * weight ELSE cap::DOUBLE END AS target FROM o
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY u, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * before + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""

QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLES = {"op4_mix_sources": _SQL}
