"""Alignment files as DataFrames in closed 1-based coordinates. Lines keep their number for tie-breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAF = ["query_name", "query_length", "query_start", "query_end", "strand", "ref_name", "ref_length", "ref_start", "ref_end", "matches", "block_length", "mapq"]
_NUMBERS = {"query_length": 1, "query_start": 2, "query_end": 3, "ref_length": 6, "ref_start": 7, "ref_end": 8, "matches": 9, "block_length": 10, "mapq": 11}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): numbers restart with each file. Offsets within a split come from the scan, split sizes from one count per split."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"), "value")
    first = lines.groupBy("file", "__at").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = first.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return lines.join(before, ["file", "__at"]).select("file", (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias("line_no"), "value")


def _tag(parts, name):
    return F.get(F.filter(F.slice(parts, 13, F.greatest(F.size(parts) - 12, F.lit(0))), lambda x: x.startswith(name)), F.lit(0))


def parse_paf(lines: DataFrame) -> DataFrame:
    """Hits, with cigar and divergence where tagged, and ``defect`` telling why a line is none (blank lines and comments go)."""
    parts = F.split("value", "\t")
    text = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("__p", parts)
    p = F.col("__p")
    number = lambda name: F.expr(f"try_cast(get(__p, {_NUMBERS[name]}) as bigint)")
    cols = {n: number(n) if n in _NUMBERS else F.get(p, F.lit(i)) for i, n in enumerate(PAF)}
    cols |= {"query_start": number("query_start") + 1, "ref_start": number("ref_start") + 1}
    typed = text.withColumns(cols | {"cigar": F.substring(_tag(p, "cg:Z:"), 6, 1 << 30), "divergence": F.expr("try_cast(substring(coalesce(%s), 6) as double)" % "get(filter(slice(__p, 13, greatest(size(__p) - 12, 0)), x -> startswith(x, 'dv:f:') or startswith(x, 'de:f:')), 0)")})
    bad_number = F.lit(False)
    for n in _NUMBERS:
        bad_number = bad_number | F.col(n).isNull()
    defect = (
        F.when(F.size(p) < 12, "columns")
        .when(~F.col("strand").isin("+", "-"), "strand")
        .when(bad_number, "number")
        .when((F.col("query_start") > F.col("query_end")) | (F.col("query_end") > F.col("query_length")) | (F.col("ref_start") > F.col("ref_end")) | (F.col("ref_end") > F.col("ref_length")), "range")
    )
    return typed.withColumn("defect", defect).drop("__p", "value")


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Lenient: lines with a defect in columns, strand or numbers are left out."""
    return parse_paf(numbered_lines(spark, path)).filter("defect is null or defect = 'range'").drop("defect")


def paf_violations(hits: DataFrame, queries: DataFrame, targets: DataFrame, need_cigar: bool = True) -> DataFrame:
    """Strict reading: (line_no, code) of every defect. Catalogs are (name, length); empty means the file may be used."""
    q = queries.select(F.col("name").alias("query_name"), F.col("length").alias("__ql"))
    t = targets.select(F.col("name").alias("ref_name"), F.col("length").alias("__tl"))
    seen = hits.join(q, "query_name", "left").join(t, "ref_name", "left")
    code = F.coalesce(
        F.col("defect"),
        F.when(F.col("__ql").isNull(), "unknown_query").when(F.col("__tl").isNull(), "unknown_target"),
        F.when((F.col("__ql") != F.col("query_length")) | (F.col("__tl") != F.col("ref_length")), "length"),
        F.when(F.lit(need_cigar) & F.col("cigar").isNull(), "cigar"),
    )
    return seen.select("line_no", code.alias("code")).filter("code is not null")


def parse_show_coords(lines: DataFrame) -> DataFrame:
    """``show-coords`` rows: banners go, pipes go, the query's order tells the strand, identity as a fraction."""
    p = F.split(F.trim(F.regexp_replace("value", r"\|", " ")), r"\s+")
    n = lambda i: F.expr(f"try_cast(get(__p, {i}) as bigint)")
    rows = lines.withColumn("__p", p).filter(F.size("__p") >= 11).withColumns({"__a": n(0), "__b": n(1), "__c": n(2), "__d": n(3), "identity": F.expr("try_cast(get(__p, 6) as double)") / 100}).filter("__a is not null and __d is not null and identity is not null")
    return rows.select("line_no", F.least("__a", "__b").alias("ref_start"), F.greatest("__a", "__b").alias("ref_end"), F.least("__c", "__d").alias("query_start"), F.greatest("__c", "__d").alias("query_end"), F.when(F.col("__c") > F.col("__d"), "-").otherwise("+").alias("strand"), "identity", F.element_at("__p", -2).alias("ref_name"), F.element_at("__p", -1).alias("query_name"))


BLAST = "query_name string, ref_name string, identity_pct double, length long, mismatches long, gap_opens long, q_start long, q_end long, s_start long, s_end long, evalue string, bit_score string"


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    """Tabular hits; scores stay text, strand from the subject's order."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=BLAST)
    return rows.select("query_name", "ref_name", "identity_pct", "length", "mismatches", "gap_opens", F.least("q_start", "q_end").alias("query_start"), F.greatest("q_start", "q_end").alias("query_end"), F.least("s_start", "s_end").alias("ref_start"), F.greatest("s_start", "s_end").alias("ref_end"), F.when((F.col("s_start") > F.col("s_end")) != (F.col("q_start") > F.col("q_end")), "-").otherwise("+").alias("strand"), "evalue", "bit_score")


def blast_to_paf(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """As PAF rows with mapq 255 and the divergence that identity implies. ``lengths`` is (name, length)."""
    q, t = (lengths.select(F.col("name").alias(n), F.col("length").alias(c)) for n, c in (("query_name", "query_length"), ("ref_name", "ref_length")))
    out = hits.join(q, "query_name").join(t, "ref_name")
    return out.select(*[F.col(c) for c in PAF[:9] if c in ("query_name", "query_length", "query_start", "query_end", "strand", "ref_name", "ref_length", "ref_start", "ref_end")], F.round(F.col("length") * F.col("identity_pct") / 100).cast("long").alias("matches"), F.col("length").alias("block_length"), F.lit(255).cast("long").alias("mapq"), (1 - F.col("identity_pct") / 100).alias("divergence"))


def both_directions(hits: DataFrame) -> DataFrame:
    """The hits and their mirror images: query and reference swap columns."""
    swap = {c: c.replace("query_", "\0").replace("ref_", "query_").replace("\0", "ref_") for c in hits.columns}
    return hits.unionByName(hits.select(*[F.col(swap[c]).alias(c) for c in hits.columns]))
