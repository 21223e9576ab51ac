"""Filters, lookups and orders that many reports share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_optional(df: DataFrame, **values) -> DataFrame:
    """Rows that equal each given value; None leaves a column open."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), ((k, v) for k, v in values.items() if v is not None), df)


def by_keys(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows of some keys in one scan, instead of a lookup each."""
    return df.filter(F.col(key).isin(values))


def is_blank(value: Column) -> Column:
    """Unplaced: null or empty."""
    return F.coalesce(value, F.lit("")) == ""


def with_tokens(df: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text has any word of the query, whatever its case."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    asked = [w for w in "".join(c.lower() if c.isalnum() or c == "_" else " " for c in query).split()]
    return df.filter(F.arrays_overlap(words, F.array(*map(F.lit, asked)).cast("array<string>"))) if asked else df.filter("false")


def centromere_hits(hits: DataFrame, least_length: int, least_identity: float, suffix: str = "_centromere") -> DataFrame:
    """Hits (query, target, start, end, length, identity) of a chromosome's centromere (query is its name and the suffix) -> (chr, target, start, end, length, identity)."""
    named = hits.filter(F.col("query").endswith(suffix) & (F.col("length") >= least_length) & (F.col("identity") >= least_identity))
    return named.withColumn("chr", F.expr(f"left(query, length(query) - {len(suffix)})")).select("chr", "target", "start", "end", "length", "identity")


def long_enough(contigs: DataFrame, rules: DataFrame, default: int) -> DataFrame:
    """Contigs (contig, rule, length) no shorter than their rule (rule, least), or the default."""
    return contigs.join(rules, "rule", "left").filter(F.col("length") >= F.coalesce("least", F.lit(default))).drop("least")


def pairwise_hits(hits: DataFrame, least_block: int, least_mapq: int, preserved: list | None = None) -> DataFrame:
    """Hits (query, target, block, mapq, key) between different contigs that are long and sure enough, and those with a preserved key."""
    good = (F.col("block") >= least_block) & (F.col("mapq") >= least_mapq)
    return hits.filter((F.col("query") != F.col("target")) & (good | F.col("key").isin(preserved or [])))


def matched_once(events: DataFrame, segments: DataFrame, columns: list[str]) -> DataFrame:
    """Events with the one segment that agrees in all columns; none or several raise."""
    found = events.join(segments.groupBy(*columns).agg(F.count("*").alias("__n"), F.first("segment").alias("segment")), columns, "left")
    said = F.concat_ws(" ", F.lit("an event matches"), F.coalesce("__n", F.lit(0)).cast("string"), F.lit("segments"))
    return found.withColumn("segment", F.when(F.coalesce("__n", F.lit(0)) != 1, F.raise_error(said)).otherwise(F.col("segment"))).drop("__n")


def with_defaults(rows: DataFrame, known: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """A left join in which missing values of ``known`` become the defaults."""
    joined = rows.join(known.select(*keys, *defaults), keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def around_gaps(segments: DataFrame) -> DataFrame:
    """Gaps (kind gap) of segments (chr, n, kind, contig) with the nearest source before and after: (chr, n, left_contig, right_contig); null at an end."""
    order = Window.partitionBy("chr").orderBy("n")
    source = F.when(F.col("kind") == "source", F.col("contig"))
    before = F.last(source, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(source, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return segments.withColumns({"left_contig": before, "right_contig": after}).filter("kind = 'gap'").select("chr", "n", "left_contig", "right_contig")


def natural(name: Column) -> list[Column]:
    """Sort keys: by the letters before the first number, then by that number, then by the name."""
    return [F.regexp_extract(name, r"^\D*", 0), F.coalesce(F.regexp_extract(name, r"\d+", 0).try_cast("decimal(38,0)"), F.lit(-1)), name]


def in_both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def assignment_class(sources: DataFrame, assignments: DataFrame) -> DataFrame:
    """Sources (source, chr: where a path uses them) as assigned, cross_chr (assigned elsewhere) or unplaced, with placement mode and card key."""
    places = assignments.groupBy("source").agg(F.collect_set("chr").alias("places"))
    rows = sources.join(places, "source", "left")
    kind = F.when(F.col("places").isNull(), "unplaced").when(F.array_contains("places", F.col("chr")), "assigned").otherwise("cross_chr")
    return rows.withColumn("class", kind).withColumns({"mode": F.when(F.col("class") == "assigned", "auto").otherwise("manual"), "card": F.concat_ws(":", "source", "chr", F.when(F.col("class") == "assigned", "normal").otherwise(F.col("class")))}).drop("places")
