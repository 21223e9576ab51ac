"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``: null and empty texts, repeated rows and
null ids, languages or sources are rows like any others, with the results stated below; an empty table gives an empty
one; further columns of any names pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import exact_dedup, jaccard_join, language_id, mixing, sentencepiece_lattice
from lociweave.runtime import drop_stored, small_batches, store

#: A text below this cosine with every language has next to no trigram in common with any. The shortest clean texts are above 0.05.
LEAST_COSINE = 0.02
#: No source repeats more often than this, the largest being read once.
MOST_REPEATS = 2.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the known languages go; the others get the predicted language where they had none.

    Profiles come from the documents that have a language. Without any, nothing can be said, and all stay. Rejected
    are texts without letters (null and empty ones too) and those below ``LEAST_COSINE`` with every language. A language
    that a document has stays as it is.
    """
    small_batches(spark)
    profiles = language_id.fit(docs)
    if not profiles.langs:
        return docs
    said = language_id.predict(docs, profiles, pred_col="__lang", score_col="__score")
    kept = said.filter((F.col("__lang") != "und") & (F.col("__score") >= LEAST_COSINE))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null counts as empty, a null id loses against any other."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the smallest doc_id stays; texts without words and rows without id all stay."""
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to ``MOST_REPEATS`` times against the largest; every document stays at least once.

    Rows come in the order of training: epoch by epoch, blocks and the documents within them permuted. A null source is
    a source of its own. The columns are those of ``docs``.
    """
    rows = mixing.mix(docs, max_repeats=MOST_REPEATS)
    order = [f"mix_{c}" if c in docs.columns else c for c in ("epoch", "block_key", "doc_key")]
    return rows.orderBy(*order).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every row, in the same order; null and empty texts have no ids."""
    small_batches(spark)
    ids = sentencepiece_lattice.encode(docs, sentencepiece_lattice.load_model(), keep_text=False)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("mixing", mixed),
    ("sentencepiece", token_ids),
]

#: Profiles, set joins and merges have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents of ``sf_dir``. A stage's table goes once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
