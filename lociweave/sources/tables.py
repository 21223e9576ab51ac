"""Header-checked tables, JSON lines, and the text formats of maps and genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociweave.sources.alignments import numbered_lines


class HeaderError(ValueError):
    """The header is not the one the contract names."""


def read_contract(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Exact header, exact order; cells that do not cast are found by :func:`cell_violations`."""
    head = spark.read.text(path).limit(1).collect()
    found = head[0][0].split("\t") if head else []
    if found != schema.names:
        raise HeaderError(f"{path}: {found} instead of {schema.names}")
    return spark.read.csv(path, sep="\t", header=True, schema=T.StructType([T.StructField(n, T.StringType()) for n in schema.names]), enforceSchema=True)


def typed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Text cells as their types; those that do not cast become null."""
    return rows.select(*[F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in schema.fields])


def cell_violations(rows: DataFrame, schema: T.StructType, enums: dict[str, tuple] | None = None, least: int = 0, most: int | None = None) -> DataFrame:
    """(code, key, message) for cells that do not cast or are outside their enumeration, and row counts out of bounds."""
    codes = [F.when(F.col(f.name).isNotNull() & F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").isNull(), F.struct(F.lit("INVALID_VALUE").alias("code"), F.lit(f.name).alias("key"), F.col(f.name).alias("message"))) for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    codes += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.struct(F.lit("INVALID_VALUE").alias("code"), F.lit(c).alias("key"), F.col(c).alias("message"))) for c, values in (enums or {}).items()]
    counts = rows.agg(F.count("*").alias("n")).filter((F.col("n") < least) | (F.col("n") > (most if most is not None else 1 << 62))).select(F.lit("INVALID_TSV").alias("code"), F.lit("rows").alias("key"), F.col("n").cast("string").alias("message"))
    if not codes:
        return counts
    return rows.select(F.explode(F.filter(F.array(*codes), lambda x: x.isNotNull())).alias("v")).select("v.*").unionByName(counts)


def read_by_name(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header-by-name import: extra columns are let be, cells trimmed, blank lines gone."""
    rows = spark.read.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise HeaderError(f"{path}: no {missing}")
    return rows.select(*columns).dropna("all")


def lenient_flag(cell):
    """1, true and yes are true, and so is an empty cell."""
    return F.coalesce(F.trim(cell), F.lit("")) .isin("", "1", "true", "yes")


#: Settings are few; a table of more rows than this is no table of settings.
MOST_SETTINGS = 100_000


def key_values(spark: SparkSession, path: str) -> dict[str, str]:
    """A two-column table of settings, whole; more than ``MOST_SETTINGS`` rows raise."""
    rows = spark.read.csv(path, sep="\t", schema="key string, value string").limit(MOST_SETTINGS + 1).collect()
    if len(rows) > MOST_SETTINGS:
        raise ValueError(f"{path} has over {MOST_SETTINGS} rows")
    return {r[0]: r[1] for r in rows}


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


AGP = "object string, object_start long, object_end long, part long, kind string, c6 string, c7 string, c8 string, c9 string"


def read_agp(spark: SparkSession, path: str) -> DataFrame:
    """Components and gaps; of a component used several times the first place counts."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=AGP)
    gap = F.col("kind").isin("N", "U")
    parts = rows.select("object", "object_start", "object_end", "part", gap.alias("is_gap"), F.when(~gap, F.col("c6")).alias("component"), F.when(~gap, F.expr("try_cast(c7 as bigint)")).alias("start"), F.when(~gap, F.expr("try_cast(c8 as bigint)")).alias("end"), F.when(gap, F.expr("try_cast(c6 as bigint)")).alias("gap_length"), F.when(~gap, F.col("c9")).alias("orientation"))
    rank = F.row_number().over(Window.partitionBy("component").orderBy("object", "part"))
    return parts.withColumn("__n", F.when(F.col("is_gap"), 1).otherwise(rank)).filter("__n = 1").drop("__n")


def read_fpc(spark: SparkSession, path: str) -> DataFrame:
    """Clones of a physical map: (bac, contig, left, right). Sections and records are carried down by windows over line numbers of a file."""
    lines = numbered_lines(spark, path)
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    bac = F.regexp_extract("value", r'^BAC\s*:\s*"([^"]+)"', 1)
    started = lines.withColumn("bac", F.last(F.when(F.col("value").rlike(r"^(BAC\s*:|Markerdata|Contigdata|Seqdata)"), bac), ignorenulls=True).over(order)).filter("bac <> ''")
    spot = started.filter(F.col("value").rlike(r'^Map\s+".*Ends Left')).select("bac", F.regexp_extract("value", r'^Map\s+"([^"]+)"', 1).alias("contig"), F.regexp_extract("value", r"Ends Left\s+(-?[\d.]+)", 1).try_cast("double").alias("left"))
    right = started.filter(F.col("value").contains("Ends Right")).select("bac", F.regexp_extract("value", r"Ends Right\s+(-?[\d.]+)", 1).try_cast("double").alias("right"))
    return spot.join(right, "bac", "left")


def tag_clones(rows: DataFrame) -> DataFrame:
    """(sequence, id, ``bac1,bac2``) -> a row per clone."""
    return rows.select("sequence", "id", F.explode(F.split("clones", ",")).alias("clone"))


def genotype_long(rows: DataFrame, marker: str) -> DataFrame:
    """A matrix with a column per genotype -> (marker, genotype, call)."""
    names = [c for c in rows.columns if c != marker]
    return rows.select(F.col(marker).alias("marker"), F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"`{c}`").cast("string") for c in names]))).alias("genotype", "call"))


def rows_as_json(rows: DataFrame, id_col: str) -> DataFrame:
    """Any upload as (id, note)."""
    return rows.select(F.col(id_col).cast("string").alias("id"), F.to_json(F.struct(*rows.columns)).alias("note"))


def quality_report(lines: DataFrame) -> DataFrame:
    """``name ... value`` lines of a quality tool; infinite values count as 0."""
    p = F.split(F.trim("value"), r"\s+")
    value = F.element_at(p, -1)
    return lines.filter(F.trim("value") != "").select(F.get(p, F.lit(0)).alias("name"), F.when(value.isin("+inf", "inf"), 0.0).otherwise(value.try_cast("double")).alias("score"))
