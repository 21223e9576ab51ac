"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed number of code points. All distinct blocks are sorted and get
integer names; then adjacent names are paired and the distinct pairs get names in turn, until each
text is one name (the doubling scheme of Karp, Miller and Rosenberg). Two texts have the same
(number of blocks, name) exactly if they are identical: names are given to contents, not to hashes.

Occurrences find the name of their block by a 128-bit fingerprint. That is only a shorter join key:
whether two different blocks share a fingerprint is checked on the sorted contents, and if any do,
the join runs on the contents instead.

Cost: the distinct blocks cross the network once, after a map-side distinct, so a text with very many
copies arrives once per task. Further levels carry integers, and only for texts of over one block.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.runtime import drop_stored, shuffle_partitions, store

BLOCK_CHARS = 4096


def _fingerprint(block: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), block).alias("fp1"), F.xxhash64(F.lit(2), block, F.lit(2)).alias("fp2")]


def _named(distinct: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Integer names in sort order within each partition: (partition number, rank) packed in a long."""
    return distinct.repartition(parts, *keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per distinct (id, text): id, text_sha256, copies (identical rows), n_blocks, name.

    (n_blocks, name) is equal for two rows exactly if their texts are. Null text counts as empty, which is
    one empty block. Null ids are a value like any other. Columns beside the two named ones are not read.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.length("text") / block_chars).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.substring("text", i * block_chars + 1, F.lit(block_chars)))

    blocks = rows.select(F.explode(pieces).alias("block"))
    names = _named(blocks.distinct(), ["block"], parts)
    level0 = store(names.select(*_fingerprint(F.col("block")), "name"), "block-names")
    clash = level0.groupBy("fp1", "fp2").count().filter("count > 1")
    exact_join = bool(clash.limit(1).count())
    keys = ["fp1", "fp2"]
    if exact_join:
        keys = ["block"]
        drop_stored(level0)
        level0 = store(names, "block-names")

    placed = rows.select("id", F.sha2("text", 256).alias("text_sha256"), n_blocks.alias("n_blocks"), F.posexplode(pieces).alias("pos", "block"))
    placed = placed.select("id", "text_sha256", "n_blocks", "pos", *(["block"] if exact_join else _fingerprint(F.col("block"))))
    placed = placed.groupBy("id", "text_sha256", "n_blocks", "pos", *keys).agg(F.count("*").alias("copies"))
    current = store(placed.join(level0, keys).select("id", "text_sha256", "copies", "n_blocks", "pos", "name"), "named-0")
    drop_stored(level0)

    done = [current.filter("n_blocks = 1").select("id", "text_sha256", "copies", "n_blocks", "name")]
    most = current.agg(F.max("n_blocks")).first()[0] or 1
    width, level = 1, 0
    while width < most:
        width, level = width * 2, level + 1
        pairs = (
            current.filter(F.col("n_blocks") > width // 2)
            .groupBy("id", "text_sha256", "copies", "n_blocks", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pairs = store(pairs, f"pairs-{level}")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], parts)
        current = store(pairs.join(names, ["a", "b"]).select("id", "text_sha256", "copies", "n_blocks", "pos", "name"), f"named-{level}")
        drop_stored(pairs)
        done.append(current.filter(F.col("n_blocks") <= width).select("id", "text_sha256", "copies", "n_blocks", "name"))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Where that id itself stands on several equal rows,
    exactly one of them is kept; null ids lose against any other. An empty table gives an empty result.
    """
    named = block_names(docs, id_col, text_col, block_chars)
    # Stored, so that the join below has an exchange on both sides and the partition of a hot group can be split.
    groups = store(named.groupBy("n_blocks", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    rows = named.join(groups, ["n_blocks", "name"])
    rows = rows.select("id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows that agree in id and text but differ elsewhere count as equal; the least by all columns stays (by those
    that can be ordered, then by a text of the row). Null text counts as empty; a null id loses against any other.
    Columns of any type and name pass through. An empty table gives an empty one.
    """
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    held = docs.toDF(*own.values())
    id_col, text_col = own[id_col], own[text_col]
    named = block_names(held, id_col, text_col, block_chars)
    groups = store(named.groupBy("n_blocks", "name").agg(F.max(F.struct(F.col("id").isNotNull().alias("has_id"), F.col("id"))).alias("top")), "groups")
    keep = named.join(groups, ["n_blocks", "name"]).filter(F.col("id").eqNullSafe(F.col("top.id"))).select(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("copies").alias("__copies"))
    keyed = held.withColumn("__sum", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    kept = keyed.join(keep, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sum") == F.col("__sha")))
    single = kept.filter("__copies = 1").select(*held.columns)
    # Maps and variants have no order: the text of the row decides there.
    plain = [f.name for f in held.schema.fields if not re.search("map|variant", f.dataType.simpleString())]
    order = F.struct(*plain, F.to_json(F.struct(*[F.col(c).cast("string") for c in held.columns])).alias("__text"))
    several = kept.filter("__copies > 1").groupBy("__id", "__sha").agg(F.min_by(F.struct(*held.columns), order).alias("__row")).select("__row.*")
    return single.unionAll(several).select(*[F.col(inner).alias(c) for c, inner in own.items()])


def op10_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
