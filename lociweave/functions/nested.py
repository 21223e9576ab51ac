"""JSON cells, delimited lists and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def string_list(cell: Column) -> Column:
    return F.from_json(cell, "array<string>")


def note_entries(df: DataFrame, note: str, key: str = "key", value: str = "value") -> DataFrame:
    """A row per entry of a JSON object."""
    return df.select("*", F.explode(F.from_json(note, "map<string,string>")).alias(key, value))


def members(df: DataFrame, cell: str) -> DataFrame:
    """``(12),-(15)`` -> rows (position, member, hidden); a leading minus hides."""
    parts = df.select("*", F.posexplode(F.filter(F.split(cell, ","), lambda x: x != "")).alias("position", "__m"))
    return parts.withColumns({"member": F.regexp_replace("__m", "[^A-Za-z0-9]", ""), "hidden": F.col("__m").startswith("-")}).drop("__m")


def member_cell(df: DataFrame, keys: list[str], order: list[Column], member: Column, hidden: Column, name: str = "cell") -> DataFrame:
    """The reverse of :func:`members`: one delimited cell per key, in order."""
    item = F.concat(F.when(hidden, "-").otherwise(""), F.lit("("), member, F.lit(")"))
    packed = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], item.alias("item"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["item"]), ",").alias(name))


def flipped(cells: Column) -> Column:
    return F.reverse(cells)


def distinct_sorted(cells: Column) -> Column:
    return F.array_sort(F.array_distinct(cells))


def canonical_json(*fields: str) -> Column:
    """JSON with keys in order and no spaces."""
    return F.to_json(F.struct(*sorted(fields)))


def fingerprint(cells: Column) -> Column:
    return F.sha2(F.to_json(cells), 256)
