"""Upkeep: integrity of assemblies, audit log, states, memberships and counts for pickers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def integrity(contigs: DataFrame, sequences: DataFrame, sources: DataFrame) -> DataFrame:
    """Faults of an assembly as (code, key, n).

    ``contigs`` (contig, cell: ``(12),-(15)``), ``sequences`` (seq, source), ``sources`` (source). Codes: empty_contig,
    null_member, malformed_member (several leading signs), repeated_member (n times in all), member_without_sequence
    (its sequence or that one's source is missing), unused_sequence.
    """
    fault = lambda df, code, key, n: df.select(F.lit(code).alias("code"), key.cast("string").alias("key"), n.cast("long").alias("n"))
    one = F.lit(1)
    empty = contigs.filter(F.coalesce("cell", F.lit("")) == "")
    items = contigs.filter(F.col("cell") != "").select("contig", F.explode(F.split("cell", ",")).alias("item"))
    some = items.filter(F.col("item").rlike(r"\S")).withColumn("seq", F.regexp_replace("item", "[^A-Za-z0-9]", ""))
    counts = some.groupBy("seq").agg(F.count("*").alias("n"))
    known = sequences.withColumn("seq", F.col("seq").cast("string"))
    whole = known.join(sources.select("source").distinct(), "source", "left_semi").select("seq").distinct()
    parts = [
        fault(empty, "empty_contig", F.col("contig"), one),
        fault(items.filter(~F.col("item").rlike(r"\S")).groupBy("contig").agg(F.count("*").alias("n")), "null_member", F.col("contig"), F.col("n")),
        fault(some.filter(F.col("item").startswith("--")).groupBy("contig").agg(F.count("*").alias("n")), "malformed_member", F.col("contig"), F.col("n")),
        fault(counts.filter("n > 1"), "repeated_member", F.col("seq"), F.col("n")),
        fault(counts.join(whole, "seq", "left_anti"), "member_without_sequence", F.col("seq"), F.col("n")),
        fault(known.join(counts, "seq", "left_anti"), "unused_sequence", F.col("seq"), one),
    ]
    return reduce(DataFrame.unionByName, parts)


def logged(log: DataFrame, entries: DataFrame) -> DataFrame:
    """An audit log (n, at, actor, action) with new entries (at, actor, action), numbered on in order of time."""
    last = log.agg(F.coalesce(F.max("n"), F.lit(0)).alias("last"))  # one row
    n = F.row_number().over(Window.orderBy("at", "actor", "action"))  # the new entries of one request
    return log.unionByName(entries.withColumn("k", n).crossJoin(last).select((F.col("last") + F.col("k")).cast(log.schema["n"].dataType).alias("n"), "at", "actor", "action"))


def newest(log: DataFrame, limit: int) -> DataFrame:
    return log.orderBy(F.col("n").desc()).limit(limit)


def with_state(df: DataFrame, which: Column, frozen: bool, frozen_code: int = 2, open_code: int = 1) -> DataFrame:
    """Freeze or unfreeze rows; others keep their status."""
    return df.withColumn("status", F.when(which, F.lit(frozen_code if frozen else open_code)).otherwise(F.col("status")))


def marked_clones(clones: DataFrame, marks: DataFrame, replace: bool) -> DataFrame:
    """Clones (clone, mark) with the marks of a list (clone, mark); without ``replace`` a mark that stands stays."""
    rows = clones.join(marks.select("clone", F.col("mark").alias("__new")), "clone", "left")
    order = ("__new", "mark") if replace else (F.when(F.col("mark") != "", F.col("mark")), "__new", "mark")
    return rows.withColumn("mark", F.coalesce(*order)).drop("__new")


def permitted(users: DataFrame, edges: DataFrame, lists: DataFrame, item: str) -> DataFrame:
    """Users (user) that an item's permission list (item, allowed: ``g1,u2``) names, themselves or by a group (edges: group, user)."""
    allowed = lists.filter(F.col("item") == item).select(F.explode(F.split("allowed", ",")).alias("name")).filter("name <> ''").distinct()
    own = users.join(allowed.withColumnRenamed("name", "user"), "user", "left_semi")
    by_group = edges.join(allowed.withColumnRenamed("name", "group"), "group", "left_semi").select("user").distinct()
    return own.unionByName(users.join(by_group, "user", "left_semi")).distinct()


def assigned_by_longest(contigs: DataFrame, hits: DataFrame, chromosome: str) -> DataFrame:
    """Contigs put on a chromosome at the place of their longest hit (contig, chr, position, length) there; without a hit at 0."""
    best = hits.filter(F.col("chr") == chromosome).groupBy("contig").agg(F.max(F.struct("length", (-F.col("position")).alias("p"))).alias("b"))
    return contigs.join(best, "contig", "left").select(*[c for c in contigs.columns if c not in ("chr", "position")], F.lit(chromosome).alias("chr"), F.coalesce(-F.col("b.p"), F.lit(0)).alias("position"))


def picker_counts(datasets: DataFrame, sequences: DataFrame) -> DataFrame:
    """Datasets (dataset) with the number and total length of their sequences (dataset, length); none count 0."""
    sums = sequences.groupBy("dataset").agg(F.count("*").alias("n"), F.sum("length").alias("bp"))
    return datasets.join(sums, "dataset", "left").select(*datasets.columns, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bp", F.lit(0)).cast("long").alias("bp"))


def new_names(incoming: DataFrame, existing: DataFrame, name: str = "contig") -> DataFrame:
    """``incoming``; a name that stands already, or twice among the new ones, raises."""
    taken = existing.select(name).distinct().withColumn("__taken", F.lit(True))
    many = F.count("*").over(Window.partitionBy(name))
    said = F.raise_error(F.concat(F.lit("the name is taken: "), F.col(name).cast("string")))
    return incoming.join(taken, name, "left").withColumn("__many", many).withColumn(name, F.when(F.col("__taken").isNotNull() | (F.col("__many") > 1), said).otherwise(F.col(name))).drop("__taken", "__many")


def reconciled_lengths(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Segments (identity, length) with the authoritative length (identity, length); a known one that differs raises, a missing one is filled in."""
    rows = segments.join(lengths.select("identity", F.col("length").alias("__true")), "identity", "left")
    clash = F.col("length").isNotNull() & F.col("__true").isNotNull() & (F.col("length") != F.col("__true"))
    said = F.raise_error(F.concat(F.lit("lengths differ for "), F.col("identity").cast("string")))
    return rows.withColumn("length", F.when(clash, said).otherwise(F.coalesce("__true", "length"))).drop("__true")
