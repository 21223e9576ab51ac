"""Ordered segment paths: slicing, rewriting, sequence and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions.coordinates import to_source
from lociweave.functions.sequence import oriented_slice
from lociweave.operators.intervals import range_join


def laid_out(path: DataFrame) -> DataFrame:
    """(chr, idx, kind, source, source_start, source_end, orientation, length) with 1-based start and end on the chromosome."""
    run = Window.partitionBy("chr").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return path.withColumn("end", F.sum("length").over(run)).withColumn("start", F.col("end") - F.col("length") + 1)


def sliced(path: DataFrame, cuts: DataFrame, bin_size: int = 1_000_000) -> DataFrame:
    """The parts of a laid-out path inside intervals (chr, cut_id, cut_start, cut_end), source coordinates kept in either orientation."""
    met = range_join(path.withColumnsRenamed({"start": "l_start", "end": "l_end"}), cuts.withColumnsRenamed({"cut_start": "r_start", "cut_end": "r_end"}), ["chr"], bin_size)
    met = met.withColumnsRenamed({"l_start": "start", "l_end": "end", "r_start": "cut_start", "r_end": "cut_end"})
    s, e = F.greatest("start", "cut_start"), F.least("end", "cut_end")
    a, b = to_source(s - F.col("start") + 1, e - F.col("start") + 1, F.col("source_start"), F.col("source_end"), F.col("orientation"))
    return met.select("chr", "cut_id", "idx", "kind", "source", F.when(F.col("kind") == "source", a).alias("source_start"), F.when(F.col("kind") == "source", b).alias("source_end"), "orientation", (e - s + 1).alias("length"))


def rewritten(path: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace stretches of a laid-out path. Edits (chr, edit_start, edit_end, source, source_start, source_end, orientation) must not overlap.

    What stays are the stretches between edits (by ``lag`` over edit ends); new and kept pieces are sorted by
    position and numbered anew.
    """
    order = Window.partitionBy("chr").orderBy("edit_start")
    bounds = path.groupBy("chr").agg(F.max("end").alias("chr_end"))
    before = edits.select("chr", (F.coalesce(F.lag("edit_end").over(order), F.lit(0)) + 1).alias("cut_start"), (F.col("edit_start") - 1).alias("cut_end"))
    tail = bounds.join(edits.groupBy("chr").agg(F.max("edit_end").alias("last")), "chr", "left").select("chr", (F.coalesce("last", F.lit(0)) + 1).alias("cut_start"), F.col("chr_end").alias("cut_end"))
    keep = before.unionByName(tail).filter("cut_start <= cut_end").withColumn("cut_id", F.col("cut_start"))
    kept = sliced(path, keep).select("chr", F.col("cut_id").alias("pos"), "idx", "kind", "source", "source_start", "source_end", "orientation", "length")
    new = edits.select("chr", F.col("edit_start").alias("pos"), F.lit(0).alias("idx"), F.lit("source").alias("kind"), "source", "source_start", "source_end", "orientation", (F.col("source_end") - F.col("source_start") + 1).alias("length"))
    rank = F.row_number().over(Window.partitionBy("chr").orderBy("pos", "idx"))
    return kept.unionByName(new).withColumn("__n", rank).drop("idx", "pos").withColumnRenamed("__n", "idx")


def sequences(path: DataFrame, records: DataFrame) -> DataFrame:
    """(chr, sequence, length, sha256): pieces are cut from (name, sequence) and joined in order; gaps are N."""
    joined = path.join(records.select(F.col("name").alias("source"), "sequence"), "source", "left")
    piece = F.when(F.col("kind") == "gap", F.repeat(F.lit("N"), F.col("length").cast("int"))).otherwise(oriented_slice(F.col("sequence"), F.col("source_start"), F.col("source_end"), F.col("orientation")))
    parts = joined.select("chr", "idx", piece.alias("piece")).groupBy("chr").agg(F.array_sort(F.collect_list(F.struct("idx", "piece"))).alias("p"))
    seq = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return parts.select("chr", seq.alias("sequence")).select("chr", "sequence", F.length("sequence").alias("length"), F.sha2("sequence", 256).alias("sha256"))


def verified(built: DataFrame, expected: DataFrame) -> DataFrame:
    """(chr, code) of chromosomes that are missing, of another length, or of another content."""
    both = built.select("chr", F.col("length").alias("l"), F.col("sha256").alias("h")).join(expected.select("chr", F.col("length").alias("el"), F.col("sha256").alias("eh")), "chr", "full")
    code = F.when(F.col("l").isNull() | F.col("el").isNull(), "missing").when(F.col("l") != F.col("el"), "length").when(F.col("h") != F.col("eh"), "CHECKSUM_MISMATCH")
    return both.select("chr", code.alias("code")).filter("code is not null")


def exploded_cigar(hits: DataFrame) -> DataFrame:
    """A row per operation of the ``cigar`` column: (…, pos, op, length, query_from, ref_from), walking both sequences."""
    ops = hits.select("*", F.posexplode(F.regexp_extract_all("cigar", F.lit(r"(\d+[MXIDN=])"), F.lit(1))).alias("pos", "__o"))
    ops = ops.withColumns({"op": F.substring(F.col("__o"), -1, 1), "length": F.regexp_replace("__o", r"\D", "").cast("long")}).drop("__o")
    run = Window.partitionBy("hit_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    moved = lambda which: F.coalesce(F.sum(F.when(F.col("op").isin(*which), F.col("length")).otherwise(0)).over(run), F.lit(0))
    query = F.when(F.col("strand") == "-", F.col("query_end") - moved("MX=I")).otherwise(F.col("query_start") + moved("MX=I"))
    return ops.withColumns({"query_from": query, "ref_from": F.col("ref_start") + moved("MX=DN")})
