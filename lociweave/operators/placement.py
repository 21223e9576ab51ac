"""Contigs to chromosomes: coverage, anchor, orientation, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions.coordinates import anchor, qualified
from lociweave.operators.aggregates import majority_strand, weighted_median
from lociweave.operators.intervals import covered
from lociweave.operators.ordering import numbered


def assign(hits: DataFrame, least_percent: float = 60.0, least_block: int = 1000, least_block_percent: int = 25) -> DataFrame:
    """Hits (query, query_length, target, query_start, query_end, ref_start, strand, block) -> a row per query and target that covers enough of it.

    (query, target, support_bp, support_percent, orientation, anchor, member_order). All three aggregates group
    by (query, target): after the first shuffle the others reuse its partitioning.
    """
    keys = ["query", "target"]
    good = hits.filter(qualified(F.col("block"), F.col("query_length"), least_block, least_block_percent))
    good = good.repartition(*keys)
    support = covered(good, keys, "query_start", "query_end").withColumnRenamed("covered", "support_bp")
    strands = good.groupBy(*keys).agg(majority_strand(F.col("strand"), F.col("block")).alias("orientation"), F.max("query_length").alias("query_length"))
    anchors = weighted_median(good.withColumn("__a", anchor(F.col("strand"), F.col("ref_start"), F.col("query_start"), F.col("query_end"), F.col("query_length"))), keys, "__a", "block").withColumnRenamed("median", "anchor")
    rows = support.join(strands, keys).join(anchors, keys)
    rows = rows.withColumn("support_percent", F.col("support_bp") * 100.0 / F.greatest("query_length", F.lit(1))).filter(F.col("support_percent") >= least_percent)
    return numbered(rows, ["target"], [F.col("anchor").asc_nulls_last(), F.col("query")], "member_order").drop("query_length")


def forced(hits: DataFrame, target: str, least_block: int = 1000, least_block_percent: int = 25) -> DataFrame:
    """:func:`assign` to one given target, whatever share of the query it covers. A query without a good hit there has no row; callers that need one use :func:`require`."""
    rows = assign(hits.filter(F.col("target") == target), 0.0, least_block, least_block_percent)
    return rows.drop("member_order")


def require(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` of all ``names`` (query); one that has none raises."""
    joined = names.select("query").join(rows, "query", "left")
    missing = F.raise_error(F.concat(F.lit("no qualified hit for "), F.col("query").cast("string")))
    return joined.withColumn("target", F.when(F.col("target").isNull(), missing).otherwise(F.col("target")))


def contig_classes(assignments: DataFrame) -> DataFrame:
    """Targets of each query beside the current one, sorted."""
    every = F.array_sort(F.collect_set("target").over(Window.partitionBy("query")))
    return assignments.withColumn("also_on", F.array_except(every, F.array("target")))
