"""Interval operators. Intervals are closed and 1-based unless a function says otherwise; columns are start and end.

Functions with windows (islands, gaps, lonely) sort the rows of a key in one task: add a column that parts a hot key, such
as the chromosome beside the contig, to the keys. Joins meet in bins and spread a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", adjacent: bool = True, extra: dict[str, Column] | None = None) -> DataFrame:
    """Merged intervals per key: (keys, start, end, n_merged, extra aggregates).

    Touching intervals ([1,5] and [6,9]) merge if ``adjacent``; otherwise only those that share a point do.
    Two windows over one partitioning and order, so one shuffle and one sort.
    """
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(*BEFORE))
    marked = df.withColumn("__new", F.when(F.col(start) > reach + (1 if adjacent else 0), 1).when(reach.isNull(), 1).otherwise(0))
    numbered = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n_merged"), *[c.alias(n) for n, c in (extra or {}).items()])
    return merged.drop("__island")


def covered(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, covered): positions under at least one interval, each counted once."""
    return islands(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))


def gaps(df: DataFrame, keys: list[str], low: Column | None = None, high: Column | None = None) -> DataFrame:
    """What islands (keys, start, end) leave open between them, and to ``low`` and ``high`` if given (columns of the islands)."""
    order = Window.partitionBy(*keys).orderBy("start")
    before = F.lag("end").over(order)
    inner = df.select(*keys, (F.coalesce(before, low - 1) if low is not None else before).alias("__p"), F.col("start").alias("__s"), *([high.alias("__high")] if high is not None else []), F.col("end").alias("__e"))
    open_ = inner.filter(F.col("__s") > F.col("__p") + 1).select(*keys, (F.col("__p") + 1).alias("start"), (F.col("__s") - 1).alias("end"))
    if high is None:
        return open_
    tail = inner.groupBy(*keys).agg(F.max("__e").alias("__e"), F.max("__high").alias("__high")).filter(F.col("__e") < F.col("__high"))
    return open_.unionByName(tail.select(*keys, (F.col("__e") + 1).alias("start"), F.col("__high").alias("end")))


def clip(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """Clipped ends, and whether anything is left."""
    s, e = F.greatest(start, low), F.least(end, high)
    return s, e, s <= e


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def range_join(left: DataFrame, right: DataFrame, keys: list[str], bin_size: int, half_open: bool = False) -> DataFrame:
    """Pairs with equal keys whose intervals (l_start, l_end) and (r_start, r_end) overlap.

    Both sides are cut into bins and joined by key and bin; a pair is taken in the bin where the overlap
    starts, so once. The key-and-bin equality keeps it a hash or merge join, and a hot key spreads over its
    bins. Intervals should be of the order of the bin, or long on one side only.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor(F.col(e) / bin_size)))
    a = left.withColumn("__bin", bins("l_start", "l_end"))
    b = right.withColumn("__bin", bins("r_start", "r_end"))
    meet = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) if half_open else overlaps(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    first = F.col("__bin") == F.floor(F.greatest("l_start", "r_start") / bin_size)
    return a.join(b, [*keys, "__bin"]).filter(meet & first).drop("__bin")


def stab(points: DataFrame, spans: DataFrame, keys: list[str], point: str, bin_size: int) -> DataFrame:
    """Points and the spans (r_start, r_end) they lie in."""
    return range_join(points.withColumns({"l_start": F.col(point), "l_end": F.col(point)}), spans, keys, bin_size).drop("l_start", "l_end")


def lonely(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that overlap no other of their key: an anti-join by two running extremes instead of pairs."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach, following = F.max(end).over(order.rowsBetween(*BEFORE)), F.lead(start).over(order)
    clear = F.coalesce(F.col(start) > reach, F.lit(True)) & F.coalesce(F.col(end) < following, F.lit(True))
    return df.withColumn("__clear", clear).filter("__clear").drop("__clear")


def covers(container: DataFrame, subject: DataFrame, keys: list[str], bin_size: int = 1000) -> DataFrame:
    """(keys, covers): whether the merged container holds every subject interval; false without subjects.

    ``container`` is (keys, start, end) of islands. A subject must lie in one island as a whole: the one that its start lies in.
    """
    a = subject.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e")).distinct()
    held = stab(a, container.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end")), keys, "__s", bin_size).filter("__e <= r_end").select(*a.columns).distinct()
    open_ = a.join(held, a.columns, "left_anti").select(*keys, F.lit(True).alias("open"))
    every = container.select(*keys).distinct()
    have = a.select(*keys, F.lit(True).alias("some")).distinct()
    return every.join(have, keys, "left").join(open_.distinct(), keys, "left").select(*keys, (F.col("some").isNotNull() & F.col("open").isNull()).alias("covers"))


def contained_once(inner: DataFrame, outer: DataFrame, keys: list[str], inner_id: str, bin_size: int = 1000) -> DataFrame:
    """Rows of ``inner`` (l_start, l_end) with the only interval of ``outer`` (r_start, r_end) that holds them; none if several or none do."""
    n = F.count("*").over(Window.partitionBy(inner_id))
    point = inner.withColumn("__p", F.col("l_start"))
    held = stab(point.withColumnsRenamed({"l_start": "__ls", "l_end": "__le"}), outer, keys, "__p", bin_size).filter("__le <= r_end").drop("__p").withColumnsRenamed({"__ls": "l_start", "__le": "l_end"})
    return held.withColumn("__n", n).filter("__n = 1").drop("__n")


def lanes(df: DataFrame, key: str, schema: str, gap: int = 0) -> DataFrame:
    """First-fit lane of each interval (start, end) per key, in order of start: sequential by nature, so one pass per key.

    ``schema`` is that of ``df`` with ``lane int`` appended. Rows stream through sorted, so memory is a number per lane.
    """
    cols = df.columns
    ks, ss, es = cols.index(key), cols.index("start"), cols.index("end")

    def run(batches):
        import pandas as pd

        now, ends = object(), []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row[ks] != now:
                    now, ends = row[ks], []
                lane = next((i for i, e in enumerate(ends) if row[ss] > e + gap), len(ends))
                ends[lane : lane + 1] = [row[es]]
                out.append(lane)
            yield pd.DataFrame(pdf).assign(lane=out)

    return df.repartition(key).sortWithinPartitions(key, "start", "end").mapInPandas(run, schema)
