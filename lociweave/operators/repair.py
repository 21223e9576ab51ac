"""Gap repair: anchors on both sides of gaps, candidates, classification, telomere ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.ordering import best


def anchor_pairs(flanks: DataFrame, most_apart: int = 1_000_000, tolerance: int = 0) -> DataFrame:
    """Hits of left and right flanks (gap, side, donor, strand, d_start, d_end, identity, block) -> a row per pair on one donor, with ``reason`` null if the donor can bridge the gap."""
    side = lambda s, p: flanks.filter(F.col("side") == s).select("gap", "donor", *[F.col(c).alias(p + c) for c in ("strand", "d_start", "d_end", "identity", "block")])
    pairs = side("L", "l_").join(side("R", "r_"), ["gap", "donor"])
    forward = F.col("l_strand") == "+"
    inner_start = F.when(forward, F.col("l_d_end") + 1).otherwise(F.col("r_d_end") + 1)
    inner_end = F.when(forward, F.col("r_d_start") - 1).otherwise(F.col("l_d_start") - 1)
    reason = F.when(F.col("l_strand") != F.col("r_strand"), "strand").when(inner_end < inner_start - 1 - tolerance, "order").when(inner_end - inner_start + 1 > most_apart, "distance")
    return pairs.withColumns({"patch_start": inner_start, "patch_end": inner_end, "reason": reason, "score_identity": F.least("l_identity", "r_identity"), "score_block": F.least("l_block", "r_block")})


def nearest_pairs(pairs: DataFrame, per_donor: bool = True) -> DataFrame:
    """The closest usable pair of each gap and donor, or of each gap."""
    keys = ["gap", "donor"] if per_donor else ["gap"]
    return best(pairs.filter("reason is null"), keys, [F.expr("patch_end - patch_start"), F.col("score_identity").desc(), F.col("score_block").desc(), F.col("donor"), F.col("patch_start")])


def missing_flanks(gaps: DataFrame, flanks: DataFrame) -> DataFrame:
    """(gap, reason) of gaps without a hit on one side or on both."""
    sides = flanks.groupBy("gap").agg(F.max((F.col("side") == "L").cast("int")).alias("l"), F.max((F.col("side") == "R").cast("int")).alias("r"))
    return gaps.select("gap").join(sides, "gap", "left").select("gap", F.when(F.coalesce(F.col("l") + F.col("r"), F.lit(0)) == 0, "no_hit").when(F.col("l") == 0, "no_left").when(F.col("r") == 0, "no_right").alias("reason")).filter("reason is not null")


def pair_features(pairs: DataFrame) -> DataFrame:
    """Overlaps and distances of two consecutive alignments (q and r: query and reference)."""
    gap = lambda p: F.col(f"b_{p}_start") - F.col(f"a_{p}_end") - 1
    q, r = gap("q"), gap("r")
    return pairs.withColumns({
        "q_overlap": F.greatest(-q, F.lit(0)), "r_overlap": F.greatest(-r, F.lit(0)), "q_gap": F.greatest(q, F.lit(0)), "r_gap": F.greatest(r, F.lit(0)),
        "same_strand": F.col("a_strand") == F.col("b_strand"), "ratio": q / F.greatest(r, F.lit(1)),
    })


def ordered_decision(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds: every decision table is this with its own rules."""
    out = None
    for condition, name in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(otherwise)


def terminal_signals(ends: DataFrame, least_bp: int = 500) -> DataFrame:
    """(chr, terminal, eligible) from repeats (chr, terminal, start, end) found in the windows at the ends."""
    return ends.groupBy("chr", "terminal").agg((F.max(F.expr("end - start + 1")) >= least_bp).alias("eligible"))


def pairs_by_share(top: DataFrame, bottom: DataFrame, key: str, bin_size: int, least: float = 0.5) -> DataFrame:
    """Segments of two tracks that overlap by at least half of the shorter; touching ends do not pair."""
    from lociweave.operators.intervals import range_join

    met = range_join(top, bottom, [key], bin_size, half_open=True)
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    shorter = F.least(F.expr("l_end - l_start"), F.expr("r_end - r_start"))
    return met.withColumn("share", shared / shorter).filter(F.col("share") >= least)


def extract_between(sequence: Column, position: Column, flank: int, left: bool) -> Column:
    """The flank of a gap; null where it holds a run of 100 N."""
    piece = F.substring(sequence, F.greatest(F.lit(1), position - flank).cast("int"), F.least(F.lit(flank), position - 1).cast("int")) if left else F.substring(sequence, (position + 1).cast("int"), F.lit(flank))
    return F.when(~piece.rlike("N{100,}"), piece)
