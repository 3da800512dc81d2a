"""Ground tracks from archives of trace files: bytes, prefilter, JSON, points near an airport."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmaq.operators.spatial import nearest_place
from tarmaq.operators.temporal import fill_legs

KEEP_KM, KEEP_ALT_FT = 12.0, 8000
NEW_LEG = 2
TRACE = "struct<icao:string,timestamp:double,trace:array<variant>>"


def prefilter(places: dict[str, tuple[float, float]], km: float = KEEP_KM) -> re.Pattern[bytes]:
    """A byte pattern that every trace with a point near a place matches, so most are never parsed."""
    import math

    def tenths(centre: float, reach: float) -> str:
        first, last = math.floor((centre - reach) * 10), math.floor((centre + reach) * 10 + 1e-9)
        # Truncated towards zero, as the digits are written.
        texts = {f"{'-' if k < 0 else ''}{abs(k + (k < 0)) // 10}.{abs(k + (k < 0)) % 10}" for k in range(first, last + 1)} | {f"{'-' if k < 0 else ''}{abs(k) // 10}.{abs(k) % 10}" for k in range(first, last + 1)}
        return "|".join(sorted(map(re.escape, texts)))

    near = (f"(?:{tenths(y, km / 111.0)})\\d*,\\s*(?:{tenths(x, km / (111.0 * math.cos(math.radians(y))))})\\d*" for y, x in places.values())
    return re.compile(("\\[\\s*[0-9.]+,\\s*(?:" + "|".join(near) + ")").encode())


def unpacked(raw: bytes) -> bytes:
    """The bytes, gunzipped if they are gzip."""
    try:
        return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    except (OSError, EOFError):
        return raw


def archive_members(spark: SparkSession, pattern: str, name: str = "trace_full_") -> DataFrame:
    """(path, content) of the members of tar archives whose file name starts with name; one task per archive.

    An archive split into parts must be joined beforehand: tar members cross part borders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                with tarfile.open(fileobj=io.BytesIO(raw.as_py()), mode="r:*") as tar:
                    for member in tar:
                        if member.isfile() and member.name.rpartition("/")[2].startswith(name):
                            yield pa.RecordBatch.from_arrays([pa.array([member.name]), pa.array([tar.extractfile(member).read()], pa.binary())], names=["path", "content"])

    return spark.read.format("binaryFile").load(pattern).select("content").mapInArrow(run, "path string, content binary")


def documents(files: DataFrame, places: dict[str, tuple[float, float]]) -> DataFrame:
    """(json) of the trace files that may have a point near a place."""
    pattern = prefilter(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [x for x in (unpacked(raw.as_py() or b"") for raw in batch.column(0)) if pattern.search(x)]
            yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())], names=["json"])

    return files.select("content").mapInArrow(run, T.StructType([T.StructField("json", T.StringType())]))


def decode(docs: DataFrame, places: dict[str, tuple[float, float]], km: float = KEEP_KM, altitude: float = KEEP_ALT_FT) -> DataFrame:
    """Points of docs(json) near a place and low: icao, t, lat, lon, ground, alt, gs, apt, callsign, callsign_next.

    A trace point is [seconds, lat, lon, altitude or "ground", speed, _, flags, _, {"flight": ...}, ...]. Unreadable JSON
    and points without position or altitude go. Callsigns are filled before points are dropped.
    """
    def at(k: int, kind: str):
        return F.try_variant_get(F.col("p"), f"$[{k}]", kind)

    read = docs.select(F.try_parse_json("json").alias("d")).where("d IS NOT NULL")
    head = read.select(F.try_variant_get("d", "$.icao", "string").alias("icao"), F.coalesce(F.try_variant_get("d", "$.timestamp", "double"), F.lit(0.0)).alias("t0"), F.posexplode(F.try_variant_get("d", "$.trace", "array<variant>")).alias("pos", "p"))
    points = head.select(
        "icao", "pos", (F.col("t0") + at(0, "double")).alias("t"), at(1, "double").alias("lat"), at(2, "double").alias("lon"),
        (F.coalesce(at(3, "string"), F.lit("")) == "ground").alias("ground"), F.try_variant_get(F.col("p"), "$[3]", "string").try_cast("double").alias("_alt"),
        at(4, "double").alias("gs"), F.coalesce(at(6, "int"), F.lit(0)).alias("flags"), F.nullif(F.trim(F.try_variant_get(F.col("p"), "$[8].flight", "string")), F.lit("")).alias("flight"),
    )
    track = points.withColumn("_k", F.col("icao"))
    filled = fill_legs(track, "_k", "pos", "flight", F.col("flags").bitwiseAND(F.lit(NEW_LEG)) != 0, "callsign", "callsign_next")
    near = filled.withColumn("_n", nearest_place(F.col("lat"), F.col("lon"), places)).where((F.col("_n.km") <= km) & (F.col("ground") | (F.col("_alt") <= altitude)))
    return near.select("icao", "t", "lat", "lon", "ground", F.when(~F.col("ground"), F.col("_alt").cast("int")).alias("alt"), "gs", F.col("_n.code").alias("apt"), "callsign", "callsign_next")
