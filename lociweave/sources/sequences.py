"""FASTA and its index as DataFrames, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions.sequence import wrapped


def read_fasta(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(name, length, sequence), upper case. Records are split at line starts with ``>``, so one record is one row and files split between tasks.

    ``wanted`` (name) keeps only those records, before sequences are cleaned.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "")
    body = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(body, r"^[ \t]*([^\s]*)", 1)
    rows = raw.select(head.alias("name"), F.regexp_replace(body, r"^[^\n]*\n?", "").alias("rest"))
    if wanted is not None:
        rows = rows.join(wanted.select("name"), "name", "left_semi")
    seq = F.upper(F.regexp_replace("rest", r"\s+", ""))
    return rows.select("name", F.length(seq).cast("long").alias("length"), seq.alias("sequence"))


def fasta_violations(records: DataFrame) -> DataFrame:
    """(name, code) for missing or repeated names, empty sequences and letters outside IUPAC."""
    repeated = records.groupBy("name").count().filter("count > 1").select("name", F.lit("duplicate").alias("code"))
    single = F.when(F.col("name") == "", "no_name").when(F.col("length") == 0, "empty").when(~F.col("sequence").rlike("^[ACGTRYSWKMBDHVN]*$"), "alphabet")
    return repeated.unionByName(records.select("name", single.alias("code")).filter("code is not null"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema="name string, length long, offset long, line_bases long, line_width long")
    return rows.filter("name is not null and length is not null")


def clone_ends(records: DataFrame) -> DataFrame:
    """Names ``clone.direction`` of end sequences, split."""
    return records.withColumns({"clone": F.regexp_extract("name", r"^(.*?)(?:\.([^.]*))?$", 1), "direction": F.regexp_extract("name", r"^(.*?)(?:\.([^.]*))?$", 2)})


def chromosome_number(name):
    """The first digits of a name; 0 without any."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("int"), F.lit(0))


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    text = F.concat(F.lit(">"), "name", F.lit("\n"), wrapped(F.col("sequence"), width))
    records.select(text.alias("value")).write.text(path)
