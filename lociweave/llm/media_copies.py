"""Cropped and edited copies of images, by local descriptors.

Corners are found on several scales of the grey image, all that are strong enough, so their number grows with
the image. Each gets an orientation from the intensity centroid around it and 128 binary tests between pairs of
points turned by that orientation. Descriptors of a query and of an image match if they differ in at most
``MOST_BITS`` bits. Blocks of images meet in a cross join and all their descriptors are compared (``media_bound``), as no key
covers that many bits with less: in flat scenes a sixtieth of all pairs match. An image is a copy if enough of
the matches agree on one rotation, scale and shift, clearly more than would by chance.

Images are a column of portable grey or colour maps (binary, ``P5`` or ``P6``).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.media_bound import likely_pairs
from lociweave.runtime import shuffle_partitions, store

SCALES = (1.0, 1.5, 2.0)
RADIUS = 9
TESTS = 128
ANGLES = 32
MOST_BITS = 16
LEAST_INLIERS = 5
CHANCE = 10  # so often chance; corners of flat scenes are alike and lie together, so chance alone reaches LEAST_INLIERS
TOLERANCE = 3.0
TURN, STRETCH = 0.4, 1.6  # by which the angle and scale of matches that agree may differ
BLOCK = 8192  # corners a row, or one image
CELLS = 1 << 20  # numbers held at once

_rng = np.random.default_rng(77)
_POINTS = np.clip(_rng.normal(0, RADIUS / 2.2, (TESTS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
_TURNED = np.stack([np.rint(_POINTS @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])).astype(int) for t in np.arange(ANGLES) * 2 * np.pi / ANGLES])
_YX = np.mgrid[-7:8, -7:8]
_DISC = (_YX**2).sum(0) <= 49


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary portable map; None for anything else."""
    m = re.match(rb"P([56])\s+(\d+)\s+(\d+)\s+255\s", data or b"")
    if not m:
        return None
    w, h, c = int(m[2]), int(m[3]), 1 if m[1] == b"5" else 3
    raw = np.frombuffer(data, np.uint8, offset=m.end())
    if len(raw) < w * h * c:
        return None
    return raw[: w * h * c].reshape(h, w, c).astype(np.float32).mean(2)


def encode_image(grey: np.ndarray) -> bytes:
    return f"P5 {grey.shape[1]} {grey.shape[0]} 255\n".encode() + np.clip(grey, 0, 255).astype(np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    p = np.pad(a, r + 1, mode="edge")[:-1, :-1].cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)


def _smaller(grey: np.ndarray, factor: float) -> np.ndarray:
    if factor == 1:
        return grey
    h, w = (max(1, int(n / factor)) for n in grey.shape)
    y, x = np.minimum((np.arange(h) + 0.5) * factor - 0.5, grey.shape[0] - 1.001), np.minimum((np.arange(w) + 0.5) * factor - 0.5, grey.shape[1] - 1.001)
    y0, x0 = y.astype(int), x.astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    g = _box(grey, 1)
    y1, x1 = np.minimum(y0 + 1, grey.shape[0] - 1), np.minimum(x0 + 1, grey.shape[1] - 1)
    return (g[y0][:, x0] * (1 - fy) * (1 - fx) + g[y1][:, x0] * fy * (1 - fx) + g[y0][:, x1] * (1 - fy) * fx + g[y1][:, x1] * fy * fx).astype(np.float32)


def descriptors(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, angle) of each corner in the image's own pixels, and its four 32-bit words."""
    where, words = [], []
    edge = RADIUS + 1
    for factor in SCALES:
        g = _smaller(grey, factor)
        if min(g.shape) <= 2 * edge + 2:
            continue
        dy, dx = np.gradient(g)
        xx, yy, xy = _box(dx * dx, 1), _box(dy * dy, 1), _box(dx * dy, 1)
        strength = (xx * yy - xy * xy - 0.05 * (xx + yy) ** 2)[edge:-edge, edge:-edge]
        p = np.pad(strength, 1, constant_values=-np.inf)
        top = np.max([p[i : i + strength.shape[0], j : j + strength.shape[1]] for i in range(3) for j in range(3)], 0)
        y, x = np.nonzero((strength == top) & (strength > 50))
        if not len(y):
            continue
        y, x = y + edge, x + edge
        s = _box(g, 1)
        patch = s[y[:, None, None] + _YX[0], x[:, None, None] + _YX[1]] * _DISC
        angle = np.arctan2((patch * _YX[0]).sum((1, 2)), (patch * _YX[1]).sum((1, 2)))
        turn = np.rint(angle / (2 * np.pi / ANGLES)).astype(int) % ANGLES
        at = _TURNED[turn]  # corner, test, end, (x, y)
        value = s[y[:, None, None] + at[..., 1], x[:, None, None] + at[..., 0]]
        words.append(np.packbits(value[..., 0] < value[..., 1], axis=1).view(">u4").astype(np.int64))
        where.append(np.stack(((x + 0.5) * factor, (y + 0.5) * factor, np.full(len(x), factor), angle), 1))
    if not where:
        return np.zeros((0, 4)), np.zeros((0, 4), np.int64)
    return np.concatenate(where), np.concatenate(words)


_BLOCKS = "ids binary, counts binary, places binary, words binary"


def describe(media: DataFrame, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """Blocks of images with their corners; null and undecodable images, and such without corners, are left out."""

    def packed(images):
        ids, where, words = zip(*images, strict=True)
        columns = np.array(ids, np.int64), np.array([len(w) for w in where], np.int64), np.concatenate(where).astype(np.float32), np.concatenate(words).astype(">u4").view(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=[x.split()[0] for x in _BLOCKS.split(", ")])

    def run(batches):
        images, size = [], 0
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grey = decode_image(data.as_py())
                if grey is None:
                    continue
                where, words = descriptors(grey)
                if images and size + len(where) > BLOCK:
                    yield packed(images)
                    images, size = [], 0
                if len(where):
                    images.append((i, where, words))
                    size += len(where)
        if images:
            yield packed(images)

    return media.select(F.col(id_col).cast("long"), image_col).filter(F.col(id_col).isNotNull()).mapInArrow(run, _BLOCKS)


def _unpacked(ids: bytes, counts: bytes, places: bytes, words: bytes) -> tuple:
    return np.frombuffer(ids, np.int64), np.r_[0, np.cumsum(np.frombuffer(counts, np.int64))], np.frombuffer(places, np.float32).reshape(-1, 4).astype(np.float64), np.frombuffer(words, np.uint64).reshape(-1, 2)


def _matches(q: np.ndarray, m: np.ndarray):
    """(query corner, image corner) of all pairs of descriptors within MOST_BITS."""
    found = []
    step = max(1, CELLS // 4 // len(q))
    for k in range(0, len(m), step):
        part = m[k : k + step]
        apart = np.bitwise_count(q[:, 0, None] ^ part[:, 0]) + np.bitwise_count(q[:, 1, None] ^ part[:, 1])
        a, b = np.nonzero(apart <= MOST_BITS)
        found.append((a, b + k))
    return (np.concatenate(c) for c in zip(*found, strict=True))


def _compare(asked: tuple, media: tuple, likely: bytes) -> list[tuple]:
    """(query_id, media_id, inliers, scale, rotation, dx, dy) of the copies between two blocks, of pairs that may be such."""
    rows = []
    ids, ends, places, words = _unpacked(*asked)
    m_ids, m_ends, m_places, m_words = _unpacked(*media)
    for k, i in np.frombuffer(likely, "<i4").reshape(-1, 2):
        mine, its = slice(ends[k], ends[k + 1]), slice(m_ends[i], m_ends[i + 1])
        a, b = _matches(words[mine], m_words[its])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        got = consensus(places[mine][a], m_places[its][b], _area(places[mine]), _area(m_places[its]))
        if got is not None:
            rows.append((int(ids[k]), int(m_ids[i]), *got))
    return rows


def find_copies(queries: DataFrame, media: DataFrame, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """(query_id, media_id, inliers, scale, rotation, dx, dy) for each query image and each image it is a copy of.

    The transform takes the query's pixels to the other image's; the one with most inliers is given. Repeated
    images are all found, rows that repeat an id as well. Either side may be empty. Null ids and columns beside the two
    are ignored. Images of any size are read whole. Of transforms with equally many inliers the first is given, in the
    order of the query's corners. Time grows with the product of the corners of both sides.
    """
    index, asked = store(describe(media, id_col, image_col), "corners"), store(describe(queries, id_col, image_col), "corners")
    named = lambda df, side: df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])

    def run(batches):
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                row = [x.as_py() for x in row]
                if out := _compare(row[:4], row[4:8], row[8]):
                    yield _found(out)

    met = named(asked, "q").crossJoin(named(index, "m").repartition(4 * shuffle_partitions(media.sparkSession)))
    limits = {"TURN": TURN, "STRETCH": STRETCH, "TOLERANCE": TOLERANCE, "LEAST": LEAST_INLIERS, "CHANCE": CHANCE, "BITS": MOST_BITS, "EDGE": 2 * RADIUS}
    met = met.withColumn("likely", likely_pairs(media.sparkSession, limits, [c for c in met.columns if c[0] == "q"], [c for c in met.columns if c[0] == "m"]))
    return met.mapInArrow(run, "query_id long, media_id long, inliers long, scale double, rotation double, dx double, dy double")


def _found(rows):
    kinds = [pa.int64()] * 3 + [pa.float64()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["query_id", "media_id", "inliers", "scale", "rotation", "dx", "dy"])


def _area(places: np.ndarray) -> float:
    return float(np.prod(np.ptp(places[:, :2], axis=0) + 2 * RADIUS))


def consensus(q: np.ndarray, m: np.ndarray, q_area: float, m_area: float) -> tuple | None:
    """(inliers, scale, rotation, dx, dy) of the similarity that most matches agree on, or None.

    Every match proposes the similarity of its own position, scale and angle; a match agrees if it lands
    within the tolerance and its own scale and angle are near. Matches at the same place of either image count
    once. Needed are LEAST_INLIERS places, and CHANCE times the matches that would land by chance more.
    """
    scale, turn = m[:, 2] / q[:, 2], m[:, 3] - q[:, 3]
    c, s = np.cos(turn) * scale, np.sin(turn) * scale
    dx, dy = m[:, 0] - (c * q[:, 0] - s * q[:, 1]), m[:, 1] - (s * q[:, 0] + c * q[:, 1])
    reach = (TOLERANCE * np.maximum(1.0, scale)) ** 2
    need = LEAST_INLIERS + CHANCE * len(q) * np.pi * reach / np.maximum(m_area, q_area * scale**2)
    if len(q) < need.min():
        return None
    one = np.ones(len(q))
    to_x, to_y, by_x, by_y = (x.astype(np.float32) for x in (np.stack((q[:, 0], q[:, 1], one, m[:, 0])), np.stack((q[:, 0], q[:, 1], one, m[:, 1])), np.stack((c, -s, dx, -one), 1), np.stack((s, c, dy, -one), 1)))
    least = reach.astype(np.float32)[:, None]
    best, at = 0, None
    step = max(1, CELLS // 4 // len(q))
    for k in range(0, len(q), step):
        near = (by_x[k : k + step] @ to_x) ** 2 + (by_y[k : k + step] @ to_y) ** 2 <= least[k : k + step]
        some = np.nonzero(near.sum(1) >= np.maximum(need[k : k + step], best + 1))[0]
        for i in some + k:
            j = np.nonzero(near[i - k])[0]
            j = j[(np.cos(turn[j] - turn[i]) >= np.cos(TURN)) & (np.abs(np.log(scale[j] / scale[i])) <= np.log(STRETCH))]
            if len(j) < max(need[i], best + 1):
                continue
            places = min(len({*map(tuple, np.rint(x[j, :2] / 2).tolist())}) for x in (q, m))
            if places >= need[i] and places > best:
                best, at = places, i
    if at is None:
        return None
    return (best, *(round(float(v), 3) for v in (scale[at], np.arctan2(s[at], c[at]), dx[at], dy[at])))


# --- Images for the query: the test tables hold none --------------------------------------------------


def draw(seed: bytes, size: int = 80) -> np.ndarray:
    """A scene of overlapping rectangles and discs that depends on nothing but ``seed``."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed).digest()[:8], "little"))
    grey = np.full((size, size), 128, np.float32)
    yy, xx = np.mgrid[:size, :size]
    for _ in range(36):
        x, y, w, h = rng.integers(0, size, 2).tolist() + rng.integers(5, 22, 2).tolist()
        level = rng.integers(0, 256)
        if rng.random() < 0.7:
            grey[y : y + h, x : x + w] = level
        else:
            grey[(xx - x) ** 2 + (yy - y) ** 2 <= (w / 2) ** 2] = level
    return _box(grey, 1)


def _taken(grey: np.ndarray, turn: float, scale: float) -> np.ndarray:
    """The image turned about its middle and resized, by bilinear samples; its borders repeat outwards."""
    h, w = grey.shape
    yy, xx = np.mgrid[: int(h * scale), : int(w * scale)]
    u, v = (xx + 0.5) / scale - w / 2, (yy + 0.5) / scale - h / 2
    x, y = np.clip(np.cos(turn) * u - np.sin(turn) * v + w / 2 - 0.5, 0, w - 1.001), np.clip(np.sin(turn) * u + np.cos(turn) * v + h / 2 - 0.5, 0, h - 1.001)
    x0, y0 = x.astype(int), y.astype(int)
    fx, fy = x - x0, y - y0
    return grey[y0, x0] * (1 - fy) * (1 - fx) + grey[y0 + 1, x0] * fy * (1 - fx) + grey[y0, x0 + 1] * (1 - fy) * fx + grey[y0 + 1, x0 + 1] * fy * fx


KINDS = ("cut", "turned", "larger", "smaller", "noisy")


def edited(grey: np.ndarray, kind: str = "cut") -> np.ndarray:
    """A copy: cut out, darkened and its lower right corner painted over; or turned; or resized; or with noise."""
    if kind == "turned":
        return _taken(grey, 0.5, 1.0)[8:-8, 8:-8]
    if kind in ("larger", "smaller"):
        return _taken(grey, 0.0, 1.4 if kind == "larger" else 0.75)
    if kind == "noisy":
        return grey + np.random.default_rng(int(grey.sum())).normal(0, 8, grey.shape)
    cut = grey[9:72, 6:74] * 0.8 + 12
    cut[-10:, -12:] = 200
    return cut


def drawn(vectors: DataFrame, edit: bool = False) -> DataFrame:
    """(vec_id, embedding) -> (media_id, image): each vector's bytes seed its image; a null vector has none.

    Edits are of each kind in turn, by the hundreds of ``vec_id``.
    """

    def run(batches):
        for batch in batches:
            images = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grey = None if not v.is_valid else draw(np.asarray(v.values.to_numpy(zero_copy_only=False), np.float32).tobytes())
                images.append(None if grey is None else encode_image(edited(grey, KINDS[(i or 0) // 100 % len(KINDS)]) if edit else grey))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], names=["media_id", "image"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "media_id long, image binary")


def op6_media_copies(spark, sf_dir):
    """Edited copies of every hundredth image against the images of all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return find_copies(drawn(vectors.filter("vec_id % 100 = 0"), edit=True), drawn(vectors))
