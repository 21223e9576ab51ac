"""Names by the longest of given prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_prefix(rows: DataFrame, name: str, prefixes: DataFrame, only: bool = False) -> DataFrame:
    """``rows`` with the longest prefix (column prefix of ``prefixes``) of their name, or null.

    Names are cut to the lengths that prefixes have, which are no more than the longest has letters, and equi-joined.
    With ``only``, a single prefix stands for all names, whether they start with it or not.
    """
    known = prefixes.select("prefix").filter("prefix is not null").distinct()
    lengths = sorted(r[0] for r in known.select(F.length("prefix")).distinct().collect())
    if only and len(lengths) == 1 and known.limit(2).count() == 1:
        return rows.withColumn("prefix", F.lit(known.first()[0]))
    if not lengths:
        return rows.withColumn("prefix", F.lit(None).cast("string"))
    cuts = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring(F.col(name), F.lit(1), n)), lambda x: F.length(x) > 0)
    found = rows.select(name).distinct().select(name, F.explode(F.array_distinct(cuts)).alias("prefix")).join(known, "prefix")
    return rows.drop("prefix").join(found.groupBy(name).agg(F.max_by("prefix", F.length("prefix")).alias("prefix")), name, "left")
