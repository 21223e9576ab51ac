"""Writers: tables, AGP, distance matrices, and merges into existing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str) -> None:
    """Written by Spark's committer: complete or not there."""
    df.write.option("sep", "\t").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Keys in order."""
    df.select(*sorted(df.columns)).write.json(path)


def agp_lines(pieces: DataFrame, gap: int = 100) -> DataFrame:
    """(object, ord, component, length, orientation) -> AGP 2.0 lines with a gap between components: (object, part, line).

    Component and gap positions follow from one running sum; gaps are rows of their own.
    """
    run = Window.partitionBy("object").orderBy("ord")
    upto = F.sum("length").over(run.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.row_number().over(run)
    laid = pieces.select("*", rank.alias("__r"), (upto + (rank - 1) * gap).alias("end")).withColumn("start", F.col("end") - F.col("length") + 1)
    own = F.concat_ws("\t", "object", "start", "end", (F.col("__r") * 2 - 1).cast("string"), F.lit("W"), "component", F.lit("1"), "length", "orientation")
    between = F.concat_ws("\t", "object", F.col("start") - gap, F.col("start") - 1, (F.col("__r") * 2 - 2).cast("string"), F.lit("N"), F.lit(str(gap)), F.lit("scaffold"), F.lit("yes"), F.lit("align_genus"))
    lines = laid.select("object", F.explode(F.filter(F.array(F.when(F.col("__r") > 1, F.struct((F.col("__r") * 2 - 2).alias("part"), between.alias("line"))), F.struct((F.col("__r") * 2 - 1).alias("part"), own.alias("line"))), lambda x: x.isNotNull())).alias("x"))
    return lines.select("object", "x.part", "x.line")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changed rows replace those of equal key, new ones are added."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def append_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table with unknown keys added, and the incoming rows whose key is taken."""
    new = incoming.join(current.select(*keys), keys, "left_anti")
    return current.unionByName(new), incoming.join(current.select(*keys), keys, "left_semi")


def replace_groups(current: DataFrame, incoming: DataFrame, group: list[str]) -> DataFrame:
    """All rows of a group go where the incoming rows have any of it."""
    return current.join(incoming.select(*group).distinct(), group, "left_anti").unionByName(incoming)


def square_matrix(distances: DataFrame, taxa: list[str]) -> DataFrame:
    """PHYLIP rows (taxon, line): names of ten characters, distances of seven. The reference of taxa is small by definition (100 at most)."""
    both = distances.select("a", "b", "distance").unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    cells: list[Column] = [F.coalesce(F.max(F.when(F.col("b") == t, F.col("distance"))), F.lit(0.0)) for t in taxa]
    return both.groupBy("a").agg(F.concat_ws(" ", F.rpad(F.col("a"), 10, " "), *[F.substring(F.format_string("%.5f", c), 1, 7) for c in cells]).alias("line")).select(F.col("a").alias("taxon"), "line")


def path_lines(segments: DataFrame) -> DataFrame:
    """Final-path segments (chr, n, kind, contig, start, end, orientation) as lines of its table: (chr, n, line); gaps have no contig."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return segments.select("chr", "n", F.concat_ws("\t", *[cell(c) for c in ("chr", "n", "kind", "contig", "start", "end", "orientation")]).alias("line"))


def log_lines(log: DataFrame) -> DataFrame:
    """Usage by chromosome (:func:`lociweave.operators.reports.usage_log`) as lines (chr, part, line): counts, then bases, used of assigned."""
    part = lambda n, name, used, total: F.struct(F.lit(n).alias("part"), F.concat_ws("\t", F.col("chr").cast("string"), F.lit(name), F.concat(F.col(used).cast("string"), F.lit("/"), F.col(total).cast("string"))).alias("line"))
    parts = F.array(part(1, "count", "used", "assigned"), part(2, "length", "used_bp", "assigned_bp"))
    return log.select("chr", F.explode(parts).alias("x")).select("chr", "x.part", "x.line")
