"""Decision tables of gap repair and structural correction, and projection through edits. All columns, no code per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.intervals import range_join

# Thresholds of the decisions.
SEARCH_RANGE = 500_000
MARGIN = 100
LARGE_EDIT = 1_000_000
MOST_EDIT_RATIO = 10.0
BASE = {"type1": 0.55, "type2": 0.75, "type3": 0.70, "type4": 0.70, "type5": 0.85, "type6": 0.80}


def step2_strategy(gaps: Column, candidates: Column, accepted: Column) -> Column:
    """How to go on with a chromosome, from its counts of gaps, patch candidates and accepted patches."""
    return F.when(gaps == 0, "no_gaps").when(candidates == 0, "no_patch_fixer").when(accepted == 0, "full_fixer_reuse_patches").otherwise("partial_success_no_fixer")


def _ref_overlap() -> Column:
    return F.when(F.col("l_ref") == F.col("r_ref"), F.greatest(F.lit(0), F.least("l_ref_max", "r_ref_max") - F.greatest("l_ref_min", "r_ref_min") + 1)).otherwise(F.lit(0))


def alignment_features(pairs: DataFrame) -> DataFrame:
    """Features of anchor pairs around a gap.

    ``pairs`` are gap_pos and, for the left (l_) and right (r_) anchor, ref, ref_min, ref_max, q_min, q_max, strand,
    aligned, identity. A null r_ref means that the left alignment crosses the gap.
    """
    crossing = F.col("r_ref").isNull()
    one = lambda alone, both: F.when(crossing, alone).otherwise(both)
    shared = F.least("l_q_max", "r_q_max") - F.greatest("l_q_min", "r_q_min") + 1
    left, right = F.col("gap_pos") - F.col("l_q_max"), F.col("r_q_min") - F.col("gap_pos")
    anchor = F.least(F.expr("l_ref_max - l_ref_min + 1"), F.expr("r_ref_max - r_ref_min + 1"))
    zero, yes = F.lit(0).cast("long"), F.lit(True)
    out = pairs.withColumns({
        "crossing": crossing,
        "query_overlap": one(F.expr("l_q_max - l_q_min + 1"), F.greatest(F.lit(0), shared)).cast("long"),
        "ref_overlap": one(zero, _ref_overlap()).cast("long"),
        "direction_match": one(yes, F.col("l_strand") == F.col("r_strand")),
        "ref_match": one(yes, F.col("l_ref") == F.col("r_ref")),
        "left_distance": one(zero, left), "right_distance": one(zero, right),
        "left_quality": F.col("l_aligned") * F.col("l_identity"), "right_quality": one(F.lit(0.0), F.col("r_aligned") * F.col("r_identity")),
        "total_gap": one(zero, left + right),
    })
    return out.withColumn("ref_overlap_ratio", F.when((F.col("ref_overlap") > 0) & (anchor > 0), F.col("ref_overlap") / anchor).otherwise(F.lit(0.0)))


def classify(features: DataFrame) -> DataFrame:
    """``features`` with error_type (type1 to type6), subtype, evidence (sorted names) and score."""
    c = F.col
    sized = F.when(c("total_gap") < 1_000, "small_gap").when(c("total_gap") < 50_000, "medium_gap").otherwise("large_gap")
    overlap, turned, moved = c("ref_overlap") > 0, ~c("direction_match"), ~c("ref_match")
    kind = F.when(c("crossing"), "type1").when(overlap, "type5").when(turned & moved, "type6").when(turned, "type2").when(moved, "type3").when(c("query_overlap") > 0, "type4").otherwise("type1")
    subtype = (
        F.when(c("crossing"), "crossing_alignment")
        .when(overlap, F.when(c("ref_overlap") < 10_000, "small_ref_overlap").when(c("ref_overlap") < 50_000, "medium_ref_overlap").otherwise("large_ref_overlap"))
        .when(turned & moved, "complex_conflict").when(turned, "direction_conflict").when(moved, "simple_translocation").when(c("query_overlap") > 0, "query_overlap").otherwise(sized)
    )
    named = lambda name, n: F.concat(F.lit(name), n.cast("string"))
    names = F.array_sort(F.array_compact(F.array(
        F.when(c("query_overlap") > 0, named("query_overlap_", c("query_overlap"))), F.when(turned, "direction_conflict"), F.when(moved, "ref_contig_conflict"),
        F.when(c("left_distance") > 100_000, named("large_left_gap_", c("left_distance"))), F.when(c("right_distance") > 100_000, named("large_right_gap_", c("right_distance"))), sized,
    )))
    evidence = F.when(c("crossing"), F.array(F.lit("crossing_alignment"))).when(overlap, F.array(named("ref_overlap_", c("ref_overlap")))).otherwise(names)
    far = F.greatest("left_distance", "right_distance")
    base = F.create_map(*[x for k, v in BASE.items() for x in (F.lit(k), F.lit(v))])[kind]
    quality = F.least((c("left_quality") + c("right_quality")) / 1_000_000.0, F.lit(1.0))
    mixed = F.least(F.lit(1.0), base * 0.45 + quality * 0.35 + F.when(far <= 10_000, 1.0).when(far <= 100_000, 0.9).otherwise(0.5) * 0.20)
    score = F.when(c("crossing"), F.lit(0.90)).when(overlap, F.least(c("ref_overlap") / 1_000_000.0 + 0.9, F.lit(0.99))).when(kind.isin("type2", "type3", "type6"), F.greatest(mixed, F.lit(0.60))).otherwise(mixed)
    return features.withColumns({"error_type": kind, "subtype": subtype, "evidence": evidence, "score": score})


def _projected(start: Column, end: Column) -> tuple[Column, Column]:
    """A stretch of the reference on the query of the right anchor; halves round to even."""
    c = F.col
    ref_span, q_span = F.greatest(F.lit(1), c("r_ref_max") - c("r_ref_min")), F.greatest(F.lit(1), c("r_q_max") - c("r_q_min"))
    at = lambda x: F.bround((x - c("r_ref_min")) * q_span / ref_span).cast("long")
    forward = c("r_strand") == "+"
    a = F.when(forward, c("r_q_min") + at(start)).otherwise(c("r_q_max") - at(end))
    b = F.when(forward, c("r_q_min") + at(end)).otherwise(c("r_q_max") - at(start))
    return F.least(a, b), F.greatest(a, b)


def replace_region(classified: DataFrame) -> DataFrame:
    """``classified`` (with gap_pos, gap_end) with edit_start, edit_end and edit_reason: what a correction of this type replaces."""
    c, kind = F.col, F.col("error_type")
    left_turned, left_shorter = c("l_strand") == "-", c("l_aligned") <= c("r_aligned")
    start, end = _projected(F.greatest("l_ref_min", "r_ref_min"), F.least("l_ref_max", "r_ref_max"))
    forward = c("r_strand") == "+"

    def table(crossing, simple, turned, shorter, overlap, otherwise):
        return F.when(c("crossing"), crossing).when(kind.isin("type1", "type6"), simple).when(kind == "type2", turned).when(kind.isin("type3", "type4"), shorter).when(kind == "type5", overlap).otherwise(otherwise)

    return classified.withColumns({
        "edit_start": table(c("l_q_min"), c("l_q_max") + 1, F.when(left_turned, c("l_q_min")).otherwise(c("r_q_min")), F.when(left_shorter, c("l_q_min")).otherwise(c("r_q_min")), F.when(forward, start).otherwise(F.greatest(F.lit(1), start - MARGIN)), c("gap_pos")),
        "edit_end": table(c("l_q_max"), c("r_q_min") - 1, F.when(left_turned, c("l_q_max")).otherwise(c("r_q_max")), F.when(left_shorter, c("l_q_max")).otherwise(c("r_q_max")), F.when(forward, end + MARGIN).otherwise(end), c("gap_end")),
        "edit_reason": table(F.lit("crossing_alignment_error_region"), F.when(kind == "type6", "complex_conflict").otherwise("simple_gap"), F.lit("direction_conflict"), F.when(kind == "type3", "reference_contig_conflict").otherwise("reference_overlap"), F.lit("reference_overlap_with_margin"), F.lit("unclassified_structural_error")),
    })


def repair_decision(edits: DataFrame, aggressive: bool = False) -> DataFrame:
    """``edits`` with eligible and decision: near anchors and a fair score, or (aggressive) anchors longer than the edit; overlap-driven edits must not exceed their evidence by far."""
    c = F.col
    length = F.greatest(F.lit(1), c("edit_end") - c("edit_start") + 1)
    near = (c("r_q_min") - c("l_q_max") <= SEARCH_RANGE) & (c("score") >= 0.40)
    strong = F.lit(aggressive) & (c("l_aligned") + c("r_aligned") > length)
    shared = F.greatest("query_overlap", "ref_overlap")
    beyond = c("error_type").isin("type4", "type5") & (length > LARGE_EDIT) & (shared > 0) & (length > shared * MOST_EDIT_RATIO)
    met = F.when(c("crossing"), "crossing_alignment").when(near, "conservative_conditions_met").when(strong, "aggressive_sufficient_anchors")
    return edits.withColumns({"eligible": met.isNotNull() & ~beyond, "decision": F.when(met.isNull(), "repair_mode_conditions_not_met").when(beyond, "automatic_edit_exceeds_overlap_evidence").otherwise(met)})


def projected_through(intervals: DataFrame, edits: DataFrame, bin_size: int = 1_000_000) -> DataFrame:
    """``intervals`` (id, chr, start, end) after ``edits`` (chr, edit_start, edit_end, new_length): (id, chr, start, end, new_start, new_end, blocked).

    Edits that end before an interval shift it by the lengths they add, summed up over the edits of the chromosome in
    order. An edit that overlaps the interval makes it ``blocked`` and its new ends null.
    """
    from pyspark.sql import Window

    added = edits.select("chr", F.col("edit_end").alias("at"), F.expr("new_length - (edit_end - edit_start + 1)").alias("d"), F.lit(None).cast("string").alias("id"))
    asked = intervals.select("chr", (F.col("start") - 1).alias("at"), F.lit(0).cast("long").alias("d"), F.col("id").cast("string").alias("id"))
    upto = Window.partitionBy("chr").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    shifts = added.unionByName(asked).withColumn("shift", F.sum("d").over(upto)).filter("id is not null").select("id", "shift")
    met = range_join(intervals.select("chr", F.col("id").cast("string").alias("id"), F.col("start").alias("l_start"), F.col("end").alias("l_end")), edits.select("chr", F.col("edit_start").alias("r_start"), F.col("edit_end").alias("r_end")), ["chr"], bin_size)
    out = intervals.withColumn("id", F.col("id").cast("string")).join(shifts, "id").join(met.select("id", F.lit(True).alias("blocked")).distinct(), "id", "left")
    free = F.col("blocked").isNull()
    return out.select("id", "chr", "start", "end", F.when(free, F.col("start") + F.col("shift")).alias("new_start"), F.when(free, F.col("end") + F.col("shift")).alias("new_end"), (~free).alias("blocked"))
