"""Aggregates over evidence: medians by weight, majorities, assembly statistics, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_median(df: DataFrame, keys: list[str], position: str, weight: str) -> DataFrame:
    """(keys, median): the least position at which the running weight reaches total // 2 + 1.

    Negative weights count as 0; without any weight it is the middle element. Equal positions are summed
    before the window, so its rows are distinct positions.
    """
    points = df.groupBy(*keys, position).agg(F.sum(F.greatest(F.col(weight), F.lit(0))).alias("__w"), F.count("*").alias("__c"))
    order = Window.partitionBy(*keys).orderBy(position)
    run, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    marked = points.select(*keys, position, F.sum("__w").over(run).alias("__r"), F.sum("__w").over(whole).alias("__t"), F.sum("__c").over(run).alias("__n"), F.sum("__c").over(whole).alias("__all"))
    reached = F.when(F.col("__t") > 0, F.col("__r") >= F.expr("__t div 2 + 1")).otherwise(F.col("__n") >= F.expr("__all div 2 + 1"))
    return marked.filter(reached).groupBy(*keys).agg(F.min(position).alias("median"))


def majority_strand(strand: Column, weight: Column) -> Column:
    """``-`` if that strand has more weight, else ``+``."""
    minus, plus = F.sum(F.when(strand == "-", weight).otherwise(0)), F.sum(F.when(strand == "+", weight).otherwise(0))
    return F.when(minus > plus, "-").otherwise("+")


def flip_score(agrees: Column, weight: Column) -> Column:
    """Positive: flipping would put more weight in agreement."""
    return F.sum(F.when(agrees, -weight).otherwise(weight))


def one_or_null(value: Column) -> Column:
    """The value if there is exactly one distinct, else null. Minimum and maximum instead of a distinct count: partial aggregates only."""
    return F.when(F.min(value) == F.max(value), F.max(value))


def assembly_statistics(df: DataFrame, keys: list[str], length: str) -> DataFrame:
    """(keys, n, total, longest, median, n50): median of even counts is the mean of the middle two; N50 is the first length, longest first, where the running total exceeds half."""
    sizes = df.groupBy(*keys, length).agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*keys)
    down = whole.orderBy(F.col(length).desc()).rowsBetween(Window.unboundedPreceding, 0)
    marked = sizes.withColumns({
        "__sum": F.sum(F.col(length) * F.col("__c")).over(down),
        "__total": F.sum(F.col(length) * F.col("__c")).over(whole),
        "__upto": F.sum("__c").over(down),
        "__n": F.sum("__c").over(whole),
    })
    low, high = F.expr("(__n + 1) div 2"), F.expr("__n div 2 + 1")  # ranks of the middle, from the longest
    at = lambda rank: F.max(F.when(F.col("__upto") >= rank, F.col(length)))
    out = marked.groupBy(*keys).agg(F.max("__n").alias("n"), F.max("__total").alias("total"), F.max(length).alias("longest"), ((at(low) + at(high)) / 2).alias("median"), F.max(F.when(F.col("__sum") * 2 > F.col("__total"), F.col(length))).alias("n50"))
    return out


def genotype_distance(calls: DataFrame, taxon: str, marker: str, call: str) -> DataFrame:
    """(a, b, markers, mismatches, distance) for each two taxa that share a marker; ``NN`` always mismatches.

    Joined on the marker, so nothing is compared without shared evidence, and summed map-side. Identical taxa
    have distance 0.
    """
    a = calls.select(F.col(marker).alias("m"), F.col(taxon).alias("a"), F.col(call).alias("ca"))
    b = calls.select(F.col(marker).alias("m"), F.col(taxon).alias("b"), F.col(call).alias("cb"))
    differ = (F.col("ca") != F.col("cb")) | (F.col("ca") == "NN") | (F.col("cb") == "NN")
    pairs = a.join(b, "m").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("markers"), F.sum(differ.cast("long")).alias("mismatches"))
    return pairs.withColumn("distance", F.col("mismatches") / F.col("markers"))


def group_contrast(calls: DataFrame, marker: str, call: str, in_first: Column, in_second: Column) -> DataFrame:
    """Markers uniform in either group, different between them, without ``NN``: (marker, first_call, second_call)."""
    one = lambda where: (F.min(F.when(where, F.col(call))), F.max(F.when(where, F.col(call))))
    (a, b), (c, d) = one(in_first), one(in_second)
    sums = calls.filter(in_first | in_second).groupBy(marker).agg(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    return sums.filter("a = b and c = d and a <> c and a <> 'NN' and c <> 'NN'").select(marker, F.col("a").alias("first_call"), F.col("c").alias("second_call"))


def argmax_sum(df: DataFrame, keys: list[str], choice: str, weight: Column) -> DataFrame:
    """(keys, choice, weight) of the choice with the largest sum; ties: the smallest choice."""
    sums = df.groupBy(*keys, choice).agg(F.sum(weight).alias("weight"))
    best = F.max(F.struct(F.col("weight"))).over(Window.partitionBy(*keys))["weight"]
    return sums.withColumn("__b", best).filter("weight = __b").groupBy(*keys).agg(F.min(choice).alias(choice), F.max("weight").alias("weight"))


def evidence_score(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, one 0/1 column per set, score): union and sum, so one shuffle for any number of sets."""
    flags = list(sets)
    rows = None
    for name, df in sets.items():
        part = df.select(key, *[F.lit(int(f == name)).alias(f) for f in flags])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(*[F.max(f).alias(f) for f in flags]).withColumn("score", sum(F.col(f) for f in flags))


def uncovered_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side: set difference both ways in one aggregate."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).filter("l <> r").select(key, F.when(F.col("l") == 1, "left_only").otherwise("right_only").alias("side"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with their count: how a uniqueness rule is checked on files."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
