"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors, each
rotated by its place; a text is the sum of its trigrams; a language is the sum of its texts. A text
gets the language whose vector has the largest cosine with its own.

Case is folded, runs of anything but letters are one boundary symbol, and trigrams are centred on a
letter. Letters beyond a-z share 37 symbols by code point. Vectors come from a fixed seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociweave.llm.side_tables import released, sliced

DIMENSIONS = 1024
SYMBOLS = 64
SEED = 20240601
#: Letters end below this code point.
LETTERS_END = 0x32400
CHUNK_CHARS = 400_000


@dataclass(frozen=True)
class Profiles:
    """Languages in order and their vectors of unit length, one row each."""

    langs: tuple
    vectors: np.ndarray


class Encoder:
    """Trigrams of texts as numbers, and their vectors; one per task."""

    def __init__(self, dimensions: int = DIMENSIONS):
        points = np.arange(LETTERS_END)
        letter = np.fromiter((chr(c).isalpha() for c in points), bool, LETTERS_END)
        self.symbol = np.where(letter, 27 + points % 37, 0).astype(np.uint8)
        self.symbol[97:123] = np.arange(1, 27)
        letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
        self.first, self.second, self.third = np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters
        self.dimensions = dimensions

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, trigram) of every trigram; texts do not run into each other."""
        low = [t.lower() for t in texts]
        points = np.frombuffer(("  " + "  ".join(low) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbol[np.where(points < LETTERS_END, points, 0)].astype(np.int32)
        owner = np.repeat(np.arange(len(low) + 1), [2, *(len(t) + 2 for t in low)])
        at = np.flatnonzero(s[1:-1]) + 1
        return owner[at] - 1, (s[at - 1] << 12) + (s[at] << 6) + s[at + 1]

    def vectors(self, trigrams: np.ndarray) -> np.ndarray:
        return (self.first[trigrams >> 12] * self.second[(trigrams >> 6) & 63] * self.third[trigrams & 63]).astype(np.float32)

    def bundle(self, owner: np.ndarray, trigrams: np.ndarray, n: int) -> np.ndarray:
        """The summed vectors of each of ``n`` texts."""
        there = np.zeros(SYMBOLS**3, bool)
        there[trigrams] = True
        used = np.flatnonzero(there)
        if not len(used):
            return np.zeros((n, self.dimensions), np.float32)
        place = np.zeros(SYMBOLS**3, np.int64)
        place[used] = np.arange(len(used))
        counts = np.bincount(owner * len(used) + place[trigrams], minlength=n * len(used)).reshape(n, len(used))
        return counts.astype(np.float32) @ self.vectors(used)


def chunks(texts: list[str]):
    """(start, end) of runs of texts of bounded total length; a longer text is alone in its run."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > CHUNK_CHARS or i - start >= 256):
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> Profiles:
    """Profiles from all rows of ``labelled`` with a language and a text.

    Each task sums up its trigrams by language and sends one vector per language; the vectors are added up
    before they reach the driver, which gets (number of languages x dimensions) numbers. No rows: no languages.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")

    def run(batches):
        encoder, sums = Encoder(dimensions), {}
        for batch in sliced(batches):
            texts, langs = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in chunks(texts):
                owner, trigrams = encoder.trigrams(texts[a:b])
                names = sorted({*langs[a:b]})
                place = np.array([names.index(x) for x in langs[a:b]])
                codes = np.bincount(place[owner] * SYMBOLS**3 + trigrams, minlength=len(names) * SYMBOLS**3).reshape(len(names), -1)
                for name, row in zip(names, codes, strict=True):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            used = np.flatnonzero(row)
            vector = sum(row[u].astype(np.float64) @ encoder.vectors(u) for u in np.array_split(used, max(1, len(used) // 20_000))) if len(used) else np.zeros(dimensions)
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(vector)], names=["lang", "at", "x"])

    sums = rows.mapInArrow(released(run), "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    got: dict[str, np.ndarray] = {}
    for lang, at, x in sums.collect():
        got.setdefault(lang, np.zeros(dimensions))[at] = x
    langs = tuple(sorted(k for k, v in got.items() if v.any()))
    return Profiles(langs, np.array([got[k] / np.linalg.norm(got[k]) for k in langs]).reshape(-1, dimensions))


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and the cosine with it (0 to 1).

    A null text or one without letters is ``und`` with score 0, as is every text if there are no profiles.
    Equal cosines: the language that sorts first. All other columns pass through unread; columns of the two
    new names are replaced.
    """
    docs = docs.drop(pred_col, score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    place = docs.columns.index(text_col)
    langs, vectors = profiles.langs, profiles.vectors.astype(np.float32)

    def run(batches):
        encoder = Encoder(vectors.shape[1])
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            for a, b in chunks(texts) if langs else ():
                bundles = encoder.bundle(*encoder.trigrams(texts[a:b]), b - a)
                norms = np.linalg.norm(bundles, axis=1)
                cosines = bundles @ vectors.T / np.maximum(norms, 1e-9)[:, None]
                best = cosines.argmax(1)
                for i in np.flatnonzero(norms > 0):
                    pred[a + i] = langs[best[i]]
                    score[a + i] = min(1.0, max(0.0, float(cosines[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names, pred_col, score_col])

    return docs.mapInArrow(released(run), schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profiles = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).drop("text")
