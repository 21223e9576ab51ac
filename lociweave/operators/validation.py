"""Rules of a delivered package as violation rows (code, relpath, key, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes of the contract.
CODES = ("MISSING_REQUIRED_FILE", "UNSUPPORTED_SCHEMA", "INVALID_TSV", "INVALID_VALUE", "INVALID_COORDINATE", "BROKEN_REFERENCE", "CHECKSUM_MISMATCH")


def _rows(df: DataFrame, code: str, relpath: str, key: Column, message: str) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(relpath).alias("relpath"), key.cast("string").alias("key"), F.lit(message).alias("message"))


def references(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str], relpath: str) -> DataFrame:
    """Non-null keys of the child that the parent lacks, each once."""
    keys = child.select(*columns).dropna("all").distinct()
    known = parent.select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns, strict=True)]).distinct()
    return _rows(keys.join(known, columns, "left_anti"), "BROKEN_REFERENCE", relpath, F.concat_ws("/", *columns), "not in " + "/".join(parent_columns))


def unique(df: DataFrame, columns: list[str], relpath: str) -> DataFrame:
    return _rows(df.groupBy(*columns).count().filter("count > 1"), "INVALID_VALUE", relpath, F.concat_ws("/", *columns), "repeated")


def coordinates(df: DataFrame, start: str, end: str, key: Column, relpath: str, length: str | None = None) -> DataFrame:
    bad = (F.col(start) < 1) | (F.col(end) < F.col(start))
    bad = bad | (F.col(end) > F.col(length)) if length else bad
    return _rows(df.filter(bad), "INVALID_COORDINATE", relpath, key, f"{start}..{end}")


def contiguous(df: DataFrame, keys: list[str], order: str, relpath: str) -> DataFrame:
    """Orders must be 1..n: least, greatest and number tell it without a window."""
    sums = df.groupBy(*keys).agg(F.min(order).alias("a"), F.max(order).alias("b"), F.countDistinct(order).alias("d"), F.count("*").alias("n"))
    return _rows(sums.filter("a <> 1 or b <> n or d <> n"), "INVALID_VALUE", relpath, F.concat_ws("/", *keys), f"{order} is not 1 to n")


def stage_chain(status: DataFrame, relpath: str) -> DataFrame:
    """Each stage must start from the version and hash that the one before it left."""
    from pyspark.sql import Window

    order = Window.orderBy("ord")  # a row per stage, eight by contract
    before_version, before_hash = F.lag("q_output_version").over(order), F.lag("q_output_sha256").over(order)
    linked = status.withColumns({"v": before_version, "h": before_hash})
    return _rows(linked.filter("v is not null and (v <> q_input_version or h <> q_input_sha256)"), "CHECKSUM_MISMATCH", relpath, F.col("stage"), "does not continue the stage before")


def checksums(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` (relpath, content) of a binaryFile read against ``manifest`` (relpath, sha256)."""
    both = manifest.join(files.select("relpath", F.sha2("content", 256).alias("found")), "relpath", "left")
    code = F.when(F.col("found").isNull(), "MISSING_REQUIRED_FILE").when(F.col("found") != F.col("sha256"), "CHECKSUM_MISMATCH")
    return both.select(code.alias("code"), "relpath", F.col("relpath").alias("key"), F.coalesce("found", F.lit("no file")).alias("message")).filter("code is not null")


def all_of(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)
