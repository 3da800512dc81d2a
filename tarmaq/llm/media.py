"""Operator 5: copies among images, cropped or edited ones too, by local descriptors.

1. An image is decoded to grey and scanned at several scales for corners (Harris). Each corner gets an orientation
   (intensity centroid) and a 256-bit descriptor of brightness comparisons of the smoothed image, in a pattern turned by it.
   A comparison asks for a difference that is large beside the patch's own, so flat areas give the same bits in every copy.
2. Hamming tables: each corner and its nearest neighbours make pairs of descriptors, which are posted in TABLES tables under
   some bits of either descriptor, drawn for each table, and the pair's turns, in sectors. Images that share a key are
   candidates. A pair of corners is far rarer than one, so unrelated images hardly ever meet, and a copy keeps many of its
   pairs. Fewer bits find copies edited more and cost more candidates (the tests measure it for KEY_BITS and for fewer).
3. Geometric consensus: candidates' descriptors are matched by Hamming distance; every match proposes
   a scale, a turn and a shift, and the pair is a copy if enough matches agree on one proposal.
Equal images are one class beforehand; lists of candidates go through ``rounds``, so groups of copies of
any size are linked without all their pairs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.llm import textkit
from tarmaq.llm.rounds import in_turns, settled
from tarmaq.llm.store import written

SCALES = (1.0, 0.7, 0.5)
#: Corners described per image, the strongest of all scales: one for so many pixels, CORNERS at least.
CORNERS = 32
CORNER_PIXELS = 256
PATCH = 13
TURNS = 32
BITS = 256
#: Hamming tables, the bits of each descriptor in a key, and the neighbours that a corner is paired with.
TABLES, KEY_BITS, NEIGHBOURS = 4, 25, 3
#: The lists of one in so many keys are tried first; most others then lie within one component.
FIRST_KEYS = 8
#: Sectors of a pair's two turns: of its direction, and of the neighbour's orientation, both against the corner's own.
SECTORS = 12
#: Rounds of smoothing before brightness is compared, and the least difference, in mean deviations of the patch.
SMOOTH, CONTRAST = 4, 0.3
#: Corners nearer than this are one spot, seen at several scales.
SPOT = 2.0
#: Most bits in which two matched descriptors differ.
NEAR_BITS = 48
#: Matches that must agree on one transform, and their least share of the image with fewer corners.
INLIERS, INLIER_SHARE = 5, 0.15
#: Agreement of two matches: pixels of shift, radians of turn, ratio of scales.
SHIFT, TURN, RATIO = 4.0, 0.5, 1.25
#: Pixels per cell when a vector is drawn.
CELL = 8

_random = np.random.default_rng(20240229)
_PATTERN = np.clip(_random.normal(0, PATCH / 2.2, (BITS, 2, 2)), -PATCH + 1, PATCH - 1)
_ANGLES = np.arange(TURNS) * 2 * np.pi / TURNS
_TURNED = np.stack([np.rint(_PATTERN @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])).astype(np.int64) for a in _ANGLES])
_DISC = np.stack(np.meshgrid(np.arange(-PATCH, PATCH + 1), np.arange(-PATCH, PATCH + 1), indexing="ij"), -1).reshape(-1, 2)
_DISC = _DISC[(_DISC**2).sum(1) <= PATCH**2]
_PAD = 2 * PATCH
_draws = [np.random.default_rng([5, k]) for k in range(TABLES)]
_ORDERS = [(r.permutation(BITS), r.permutation(BITS)) for r in _draws]


def _png(raw: bytes) -> np.ndarray | None:
    at, packed, head = 8, [], None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 4, 6):
        return None
    wide, high, step = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    data = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(high, wide * step + 1)
    out = np.zeros((high, wide * step), np.uint8)
    above = np.zeros(wide * step, np.int64)
    for y in range(high):
        kind, line = data[y, 0], data[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind:
            for x in range(len(line)):
                a, c = (line[x - step], above[x - step]) if x >= step else (0, 0)
                b = above[x]
                if kind == 1:
                    add = a
                elif kind == 3:
                    add = (a + b) // 2
                else:
                    p = a + b - c
                    add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + add) & 255
        above = line & 255
        out[y] = above
    return out.reshape(high, wide, step)[:, :, : 3 if step > 2 else 1].mean(2)


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey values of an 8-bit PGM, PPM or PNG; None for nulls and what can't be read."""
    try:
        if not raw:
            return None
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        kind, wide, high, most, body = raw.split(maxsplit=4) if raw[:2] in (b"P5", b"P6") else (None,) * 5
        if kind is None or int(most) != 255:
            return None
        body = raw[len(raw) - int(wide) * int(high) * (3 if kind == b"P6" else 1) :]
        return np.frombuffer(body, np.uint8).reshape(int(high), int(wide), -1).astype(float).mean(2)
    except (ValueError, struct.error, zlib.error, KeyError):
        return None


def encode_pgm(image: np.ndarray) -> bytes:
    """An 8-bit PGM of a grey image."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes()


def draw(vector: np.ndarray) -> np.ndarray:
    """A vector as an image: one cell of CELL pixels per component, brightness by its value."""
    side = int(np.ceil(np.sqrt(max(len(vector), 1))))
    cells = np.zeros(side * side)
    cells[: len(vector)] = np.nan_to_num(vector)
    return np.clip(128 + 320 * np.kron(cells.reshape(side, side), np.ones((CELL, CELL))), 0, 255)


def _blur(x: np.ndarray) -> np.ndarray:
    # A row or column at the rim takes its missing neighbour from the other side, which callers pad.
    for _ in (0, 1):
        out = x * 2.0
        out[1:] += x[:-1]
        out[0] += x[-1]
        out[:-1] += x[1:]
        out[-1] += x[0]
        out /= 4
        x = out.T
    return x


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return x
    high, wide = max(8, int(x.shape[0] * scale)), max(8, int(x.shape[1] * scale))
    ys, xs = (np.arange(high) + 0.5) / scale - 0.5, (np.arange(wide) + 0.5) / scale - 0.5
    ys, xs = np.clip(ys, 0, x.shape[0] - 1.001), np.clip(xs, 0, x.shape[1] - 1.001)
    y, z = ys.astype(int), xs.astype(int)
    fy, fx = (ys - y)[:, None], (xs - z)[None]
    return (1 - fy) * ((1 - fx) * x[y][:, z] + fx * x[y][:, z + 1]) + fy * ((1 - fx) * x[y + 1][:, z] + fx * x[y + 1][:, z + 1])


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (y, x, scale, angle), in the image's own pixels, and their descriptors as four words each."""
    found, words = [], []
    most = max(CORNERS, image.size // CORNER_PIXELS)
    for scale in SCALES:
        if min(image.shape) * scale < 16:
            continue
        x = np.pad(_blur(np.pad(_resize(image, scale), 2, "edge"))[2:-2, 2:-2], _PAD, "reflect" if min(image.shape) * scale > _PAD + 1 else "edge")
        gy, gx = np.gradient(x)
        a, b, c = _blur(_blur(gy * gy)), _blur(_blur(gx * gx)), _blur(_blur(gy * gx))
        harris = a * b - c * c - 0.05 * (a + b) ** 2
        inner = harris[_PAD - 1 : 1 - _PAD, _PAD - 1 : 1 - _PAD]
        middle = inner[1:-1, 1:-1]
        peak = np.ones(middle.shape, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= middle >= inner[1 + dy : inner.shape[0] - 1 + dy, 1 + dx : inner.shape[1] - 1 + dx]
        ys, xs = np.nonzero(peak & (middle > 1.0))
        if not len(ys):
            continue
        strength = middle[ys, xs]
        best = np.argsort(-strength, kind="stable")[:most]
        ys, xs, strength = ys[best], xs[best], strength[best]
        patch = x[(ys[:, None] + _PAD + _DISC[:, 0]), (xs[:, None] + _PAD + _DISC[:, 1])]
        angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
        turn = np.rint(angle / (2 * np.pi / TURNS)).astype(int) % TURNS
        at = _TURNED[turn]
        for _ in range(SMOOTH):
            x = _blur(x)
        p = x[ys[:, None] + _PAD + at[:, :, 0, 0], xs[:, None] + _PAD + at[:, :, 0, 1]]
        q = x[ys[:, None] + _PAD + at[:, :, 1, 0], xs[:, None] + _PAD + at[:, :, 1, 1]]
        least = CONTRAST * np.abs(patch - patch.mean(1, keepdims=True)).mean(1, keepdims=True)
        words.append(np.packbits(p > q + least, axis=1).view("<u8"))
        found.append(np.column_stack([(ys + 0.5) / scale, (xs + 0.5) / scale, np.full(len(ys), scale), angle, strength]))
    if not found:
        return np.zeros((0, 4), np.float32), np.zeros((0, BITS // 64), np.uint64)
    corners, bits = np.concatenate(found), np.concatenate(words)
    best = np.argsort(-corners[:, 4], kind="stable")[:most]
    return corners[best, :4].astype(np.float32), bits[best]


def keys(corners: np.ndarray, words: np.ndarray, key_bits: int = KEY_BITS) -> np.ndarray:
    """The distinct keys of an image: hashes of table, sampled bits and turns of each corner and each of its neighbours.

    A single corner is its own neighbour.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(n, BITS // 8), axis=1)
    weights = np.uint64(1) << np.arange(key_bits, dtype=np.uint64)
    parts = [tuple(textkit.mix((bits[:, order[:key_bits]] * weights).sum(1, dtype=np.uint64) + np.uint64(k << 60)) for order in orders) for k, orders in enumerate(_ORDERS)]
    at = corners[:, 1].astype(float) + 1j * corners[:, 0]  # the axes of the angles
    own_turn = corners[:, 3].astype(float)
    sector = lambda x: np.floor(x / (2 * np.pi) * SECTORS + 0.5).astype(np.int64) % SECTORS
    out = []
    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        far = np.abs(at[a : a + step, None] - at[None])
        far[far < SPOT] = np.inf
        near = np.argsort(far, axis=1, kind="stable")[:, : min(NEIGHBOURS, max(n - 1, 1))]
        own, other = np.repeat(np.arange(a, a + len(far)), near.shape[1]), near.reshape(-1)
        turns = sector(np.angle(at[other] - at[own]) - own_turn[own]) * SECTORS + sector(own_turn[other] - own_turn[own])
        for one, two in parts:
            out.append(textkit.mix(one[own] ^ (two[other] << np.uint64(1)) ^ textkit.mix(turns.astype(np.uint64) + np.uint64(1))))
    return np.unique(np.concatenate(out)).view(np.int64)


def _nearest(da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest of db for each of da, and in how many bits they differ."""
    near, least = np.empty(len(da), np.int64), np.empty(len(da), np.int64)
    step = max(1, (1 << 20) // len(db))
    for at in range(0, len(da), step):
        bits = np.bitwise_count(da[at : at + step, None, :] ^ db[None, :, :]).sum(2, dtype=np.int64)
        near[at : at + step], least[at : at + step] = bits.argmin(1), bits.min(1)
    return near, least


def consensus(ka: np.ndarray, da: np.ndarray, kb: np.ndarray, db: np.ndarray, least: float = 0) -> int:
    """The most matches that agree on one scale, turn and shift; 0 where fewer than ``least`` match at all."""
    if not len(ka) or not len(kb):
        return 0
    near, bits = _nearest(da, db)
    own = np.flatnonzero(bits <= NEAR_BITS)
    if len(own) < max(least, 1):
        return 0
    back, _ = _nearest(db[near[own]], da)
    own = own[back == own]
    if len(own) < max(least, 1):
        return 0
    a, b = ka[own].astype(float), kb[near[own]].astype(float)
    scale = a[:, 2] / b[:, 2]  # b's pixels for one of a's
    turn = np.angle(np.exp(1j * (b[:, 3] - a[:, 3])))
    za, zb = a[:, 1] + 1j * a[:, 0], b[:, 1] + 1j * b[:, 0]
    best = 0
    for k in range(len(own)):
        agree = (np.abs(np.angle(np.exp(1j * (turn - turn[k])))) < TURN) & (np.maximum(scale, scale[k]) < RATIO * np.minimum(scale, scale[k]))
        moved = zb[k] + (za - za[k]) * scale[k]
        turned = zb[k] + (za - za[k]) * scale[k] * np.exp(1j * turn[k])
        best = max(best, *(int((agree & (np.abs(zb - z) < SHIFT)).sum()) for z in (moved, turned)))
    return best


@textkit.lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = []
            for raw in part.column(1).to_pylist():
                image = decode(raw)
                if image is None:
                    rows.append((f"raw {hashlib.sha256(raw).hexdigest()}" if raw else None, 0, b"", b""))
                    continue
                corners, words = describe(image)
                digest = hashlib.sha256(repr(image.shape).encode() + image.astype(np.float32).tobytes()).hexdigest()
                rows.append((digest, len(corners), corners.astype("<f4").tobytes(), words.astype("<u8").tobytes()))
            digest, n, corners, words = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.string()), pa.array(n, pa.int32()), pa.array(corners, pa.binary()), pa.array(words, pa.binary())], names=["id", "digest", "n", "corners", "words"])


def _corners(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), "<f4").reshape(-1, 4)


def _words(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), "<u8").reshape(-1, BITS // 64)


def _posted(key_bits: int):
    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [keys(_corners(part.column(1)[i]), _words(part.column(2)[i]), key_bits) for i in range(part.num_rows)]
                ids = np.repeat(np.asarray(part.column(0)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(ids)], names=["key", "id"])

    return run


@textkit.lean
def _consensus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            ka, da, kb, db = (f(batch.column(c)[i]) for c, f in ((2, _corners), (3, _words), (4, _corners), (5, _words)))
            least = max(INLIERS, INLIER_SHARE * min(len(ka), len(kb)))
            keep.append(consensus(ka, da, kb, db, least) >= least)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def image_groups(media: DataFrame, id_column: str = "media_id", bytes_column: str = "content", key_bits: int = KEY_BITS) -> DataFrame:
    """id, n_corners, component_id, kept: groups of copies among the images of a binary column.

    component_id is the least id reachable over confirmed pairs and equal images. Images without corners are linked
    with equal images only, undecodable ones with equal bytes only, nulls and empty values with nothing. Rows without id have a
    null component and are kept; repeated rows get the same. An empty table gives no rows. ``key_bits``: see the module.
    """
    source = media.select(F.col(id_column).cast("long").alias("id"), F.col(bytes_column).cast("binary").alias("content"))
    found = written(source.mapInArrow(_features, "id long, digest string, n int, corners binary, words binary"))
    some = found.where("digest IS NOT NULL AND id IS NOT NULL")
    classes = written(some.groupBy("digest").agg(F.min("id").alias("rep")))
    reps = some.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi").dropDuplicates(["id"])
    # One exchange of all postings serves the count and the join.
    post = reps.select("id", "corners", "words").mapInArrow(_posted(key_bits), "key long, id long").repartition("key")
    shared = post.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select("key")
    post = written(post.join(shared, "key", "left_semi"))
    # The image that others were edited from shares the most keys.
    post = written(post.join(post.groupBy("id").agg(F.count("*").alias("score")), "id").select("key", "id", "score"))
    parts = reps.select("id", "corners", "words")

    def confirm(pairs: DataFrame) -> DataFrame:
        whole = pairs.join(parts.toDF("a", "ca", "wa"), "a").join(parts.toDF("b", "cb", "wb"), "b")
        return whole.select("a", "b", "ca", "wa", "cb", "wb").mapInArrow(_consensus, "a long, b long")

    label = settled(post, confirm, in_turns(post, confirm, FIRST_KEYS))
    if label is not None:
        classes = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    else:
        classes = classes.withColumnRenamed("rep", "component")
    out = found.select("id", "digest", F.col("n").alias("n_corners")).join(classes, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return out.select("id", "n_corners", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


@textkit.lean
def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pictures = [None if v is None else encode_pgm(draw(np.array(v, float))) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pictures, pa.binary())], names=["media_id", "content"])


def op5_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of copies among all rows of ``embeddings``, each drawn as an image (no table holds images)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("media_id"), F.col("embedding").cast("array<double>"))
    return image_groups(vectors.mapInArrow(_drawn, "media_id long, content binary")).withColumnRenamed("id", "vec_id")


QUERIES = {"op5_media_copies": op5_media_copies}
ORACLES: dict[str, str] = {}
