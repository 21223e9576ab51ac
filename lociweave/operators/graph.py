"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.runtime import drop_stored, store


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Alternating large-star and small-star steps. Nodes may be of any ordered type. Edges with a null end and
    loops add nothing. Each round writes its edges to the shared folder; a hub's neighbours are met by a
    minimum with map-side combine and by a join that can be split, never gathered. Rounds grow with the
    logarithm of the longest path.
    """
    apart = edges.filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    now = apart.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("p"))
    now = store(now.distinct(), "star")
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("p").alias("u"), F.col("u").alias("p")))
        least = both.groupBy("u").agg(F.least(F.min("p"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("p > u").select(F.col("p").alias("u"), F.col("m").alias("p"))
        own = large.groupBy("u").agg(F.min("p").alias("m"))
        small = large.join(own, "u").filter("p <> m").select(F.col("p").alias("u"), F.col("m").alias("p")).unionAll(own)
        following = store(small.distinct(), "star")
        seen = tuple(following.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "p"))).first())
        drop_stored(now)
        now = following
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("p").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("p").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))


def merged_contigs(contigs: DataFrame, joins: DataFrame) -> DataFrame:
    """Contigs (contig, chr, position) joined end to end (left, right) -> (contig, merged, member_order): each component is one contig, members by position."""
    from lociweave.operators.ordering import numbered

    parts = connected_components(joins, "left", "right")
    rows = contigs.join(parts, F.col("contig") == F.col("node"), "left").withColumn("merged", F.coalesce("component", "contig"))
    return numbered(rows.select("contig", "merged", "position"), ["merged"], [F.col("position").asc_nulls_last(), "contig"], "member_order")


def buried(sequences: DataFrame, hits: DataFrame, least_cover: float = 0.99) -> DataFrame:
    """Sequences hidden as redundant, to a fixpoint: covered to ``least_cover`` by one visible longer sequence (or an equal one of smaller name), both ends touched.

    ``sequences`` (name, length), ``hits`` (query, target, q_start, q_end). Cover is a partial order, so the
    visible set is what no visible sequence covers; each round decides all whose coverers are decided, and
    writes what is left.
    """
    size = sequences.select(F.col("name"), F.col("length"))
    q = size.select(F.col("name").alias("query"), F.col("length").alias("ql"))
    t = size.select(F.col("name").alias("target"), F.col("length").alias("tl"))
    span = hits.groupBy("query", "target").agg(F.min("q_start").alias("lo"), F.max("q_end").alias("hi"), F.sum(F.expr("q_end - q_start + 1")).alias("bp"))
    edges = span.join(q, "query").join(t, "target").filter((F.col("query") != F.col("target")) & (F.col("lo") == 1) & (F.col("hi") == F.col("ql")) & (F.col("bp") >= least_cover * F.col("ql")) & ((F.col("tl") > F.col("ql")) | ((F.col("tl") == F.col("ql")) & (F.col("target") < F.col("query")))))
    open_ = store(edges.select("query", "target"), "cover")
    hidden = None
    while open_.limit(1).count():
        waiting = open_.select(F.col("query").alias("target")).distinct()
        ready = open_.join(waiting, "target", "left_anti")  # their coverers are visible for good
        found = store(ready.select("query").distinct(), "hidden")
        hidden = found if hidden is None else hidden.unionAll(found)
        rest = open_.join(found, "query", "left_anti").join(found.withColumnRenamed("query", "target"), "target", "left_anti").select("query", "target")
        following = store(rest, "cover")
        drop_stored(open_)
        open_ = following
    return hidden.select(F.col("query").alias("name")) if hidden is not None else sequences.select("name").filter("false")
