"""Reports on contigs and final paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.operators.intervals import gaps, islands


def composition(members: DataFrame) -> DataFrame:
    """Members (contig, source, length, hidden) by contig and source, with a total per contig and in all: (contig, source, n, n_hidden, bp, bp_hidden)."""
    hidden = F.col("hidden").cast("long")
    sums = members.rollup("contig", "source").agg(F.count("*").alias("n"), F.sum(hidden).alias("n_hidden"), F.sum("length").alias("bp"), F.sum(F.col("length") * hidden).alias("bp_hidden"), F.grouping_id().alias("level"))
    return sums.filter("level in (0, 1, 3)")


def completed_rules(rules: DataFrame, whole: DataFrame) -> DataFrame:
    """Rules (contig, start, end, value) and a rule of value 0 for each stretch of the contig (contig, length) that they leave open."""
    merged = islands(rules, ["contig"]).select("contig", "start", "end").join(whole, "contig")
    open_ = gaps(merged, ["contig"], F.lit(1), F.col("length"))
    bare = whole.join(rules.select("contig").distinct(), "contig", "left_anti").select("contig", F.lit(1).cast("long").alias("start"), F.col("length").alias("end"))
    return rules.select("contig", "start", "end", "value").unionByName(open_.unionByName(bare).withColumn("value", F.lit(0).cast(rules.schema["value"].dataType)))


def usage_log(segments: DataFrame, primaries: DataFrame, hidden: DataFrame) -> DataFrame:
    """A row per chromosome: contigs and bases of the primary set that its final path uses.

    ``segments`` (chr, identity, length, kind: primary, support, gap, reference), ``primaries`` (chr, identity, length) assigned,
    ``hidden`` (chr, identity) those set aside, which count as used with their whole length unless they stand in the path.
    ``elsewhere`` lists the path's primary contigs that other chromosomes' paths use too.
    """
    used = segments.filter("kind = 'primary'")
    path = used.groupBy("chr").agg(F.countDistinct("identity").alias("appended"), F.sum("length").alias("appended_bp"))
    support = segments.filter("kind = 'support'").groupBy("chr").agg(F.count("*").alias("support"), F.sum("length").alias("support_bp"))
    aside = hidden.distinct().join(primaries, ["chr", "identity"]).join(used.select("chr", "identity").distinct(), ["chr", "identity"], "left_anti").groupBy("chr").agg(F.count("*").alias("hidden"), F.sum("length").alias("hidden_bp"))
    total = primaries.groupBy("chr").agg(F.count("*").alias("assigned"), F.sum("length").alias("assigned_bp"))
    places = used.select("chr", "identity").distinct().withColumn("on", F.count("*").over(Window.partitionBy("identity")))
    elsewhere = places.filter("on > 1").groupBy("chr").agg(F.array_sort(F.collect_list("identity")).alias("elsewhere"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = total.join(path, "chr", "full").join(aside, "chr", "full").join(support, "chr", "full").join(elsewhere, "chr", "left")
    counts = rows.select("chr", *[zero(c) for c in ("assigned", "assigned_bp", "appended", "appended_bp", "hidden", "hidden_bp", "support", "support_bp")], F.coalesce("elsewhere", F.array().cast("array<string>")).alias("elsewhere"))
    return counts.withColumns({"used": F.col("appended") + F.col("hidden"), "used_bp": F.col("appended_bp") + F.col("hidden_bp")})


def project_statistics(log: DataFrame, unplaced: DataFrame) -> DataFrame:
    """One row over all chromosomes of :func:`usage_log` and the unplaced contigs (identity, length); what is left over is never below 0."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = log.agg(*[s(c) for c in ("assigned", "assigned_bp", "used", "used_bp")])
    rest = unplaced.agg(F.count("*").alias("unassigned"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("unassigned_bp"))
    return sums.crossJoin(rest).withColumns({"placed_not_used": F.greatest(F.lit(0), F.col("assigned") - F.col("used")), "placed_not_used_bp": F.greatest(F.lit(0), F.col("assigned_bp") - F.col("used_bp"))})  # one row each


def source_cards(events: DataFrame) -> DataFrame:
    """Accepted events (card, source, orientation, chr, start, event) by card: (card, source, orientation, chr, anchor, events). A card of several sources, orientations or chromosomes raises."""
    same = ["source", "orientation", "chr"]
    cards = events.groupBy("card").agg(*[F.first(c).alias(c) for c in same], *[F.countDistinct(c).alias(f"n_{c}") for c in same], F.min("start").alias("anchor"), F.array_sort(F.collect_list("event")).alias("events"))
    mixed = F.expr(" or ".join(f"n_{c} > 1" for c in same))
    return cards.withColumn("source", F.when(mixed, F.raise_error(F.concat(F.lit("mixed source card "), F.col("card")))).otherwise(F.col("source"))).select("card", *same, "anchor", "events")


def attempts(candidates: DataFrame) -> DataFrame:
    """(stage, object, strategies, attempts, accepted)."""
    return candidates.groupBy("stage", "object").agg(F.array_sort(F.collect_set("strategy")).alias("strategies"), F.count("*").alias("attempts"), F.sum((F.col("outcome") == "accepted").cast("long")).alias("accepted"))


def pool_report(jobs: DataFrame, pools: DataFrame) -> DataFrame:
    """Jobs (job, sequence, circular, assigned) with the size of their pool (job, clones), and whole percents cut off, not rounded."""
    sums = jobs.groupBy("job").agg(F.count("*").alias("sequences"), F.sum(F.col("circular").cast("long")).alias("circular"), F.sum(F.col("assigned").cast("long")).alias("assigned"))
    size = pools.groupBy("job").agg(F.countDistinct("clone").alias("clones"))
    return sums.join(size, "job", "left").select("job", "sequences", F.coalesce("clones", F.lit(0)).alias("clones"), F.expr("circular * 100 div sequences").alias("circular_percent"), F.expr("assigned * 100 div sequences").alias("assigned_percent"))
