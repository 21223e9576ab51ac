"""Automatic placement and orientation of contigs, as tables in and tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.operators.ordering import best, numbered
from lociweave.operators.placement import assign


def auto_assign(sources: DataFrame, hits: DataFrame, existing: DataFrame, least_percent: float = 60.0, least_block: int = 1000, least_block_percent: int = 25, skip_manual: bool = True, assign_unplaced: bool = True) -> DataFrame:
    """All instances after automatic assignment: (source, instance, chr, mode, support_bp, support_percent, anchor, member_order, outcome).

    ``sources`` (source, length), ``hits`` as :func:`assign` reads them (query is the source), ``existing`` (source,
    instance, chr, mode: auto, manual or unplaced). Automatic instances are rebuilt. A source gets one instance for each
    chromosome that covers it enough; the first by name takes over the instance it had (its smallest automatic or unplaced
    one), the others are new and named ``source@chr``. Sources with a manual instance keep it and get no other if
    ``skip_manual``. Sources without evidence, or all if not ``assign_unplaced``, have one unplaced instance. Order is by
    anchor within the chromosome, over manual ones too (they have no anchor, so they come last, by name).
    """
    manual = existing.filter("mode = 'manual'").select("source", "instance", "chr", "mode")
    free = best(existing.filter("mode <> 'manual'"), ["source"], [F.col("instance")]).select("source", F.col("instance").alias("had"))
    asked = sources.join(manual.select("source").distinct(), "source", "left_anti") if skip_manual else sources
    found = assign(hits, least_percent, least_block, least_block_percent).select(F.col("query").alias("source"), F.col("target").alias("chr"), "support_bp", "support_percent", "anchor")
    if not assign_unplaced:
        found = found.filter("false")
    rows = numbered(asked.select("source").join(found, "source", "left").join(free, "source", "left"), ["source"], [F.col("chr")], "nth")
    fresh = F.concat_ws("@", F.col("source").cast("string"), F.coalesce("chr", F.lit("unplaced")))
    first = F.col("nth") == 1
    rows = rows.withColumns({"instance": F.when(first, F.coalesce("had", fresh)).otherwise(fresh), "mode": F.when(F.col("chr").isNull(), "unplaced").otherwise("auto"), "outcome": F.when(F.col("chr").isNull(), "no_evidence").when(first & F.col("had").isNotNull(), "reused").otherwise("created")})
    kept = manual.withColumn("outcome", F.lit("skipped_manual" if skip_manual else "kept_manual"))
    out = rows.drop("had", "nth").unionByName(kept, allowMissingColumns=True)
    placed = numbered(out.filter("chr is not null"), ["chr"], [F.col("anchor").asc_nulls_last(), F.col("instance")], "member_order")
    return placed.unionByName(out.filter("chr is null").withColumn("member_order", F.lit(None).cast("int")))


def auto_orient(instances: DataFrame, hits: DataFrame, least_block: int = 1000, least_block_percent: int = 25) -> DataFrame:
    """``instances`` (source, chr, orientation) with new_orientation and outcome: the orientation that most aligned bases on its chromosome say, ties to +; without evidence it stays."""
    from lociweave.functions.coordinates import qualified
    from lociweave.operators.aggregates import majority_strand

    good = hits.filter(qualified(F.col("block"), F.col("query_length"), least_block, least_block_percent))
    said = good.groupBy(F.col("query").alias("source"), F.col("target").alias("chr")).agg(majority_strand(F.col("strand"), F.col("block")).alias("said"))
    rows = instances.join(said, ["source", "chr"], "left").withColumn("new_orientation", F.coalesce("said", "orientation"))
    return rows.withColumn("outcome", F.when(F.col("said").isNull(), "no_evidence").when(F.col("said") == F.col("orientation"), "unchanged").otherwise("flipped")).drop("said")


def summary(rows: DataFrame) -> DataFrame:
    """(outcome, n)."""
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))
