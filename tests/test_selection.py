"""Selections, lookups, reports and lines on small tables."""

import pytest
from pyspark.sql import functions as F

from lociweave.operators import reports, selection, starting_path
from lociweave.sources import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_filters(spark):
    df = spark.createDataFrame([("c1", "d1", 5, ""), ("c1", "d2", 9, None), ("c2", "d1", 7, "x")], "chr string, dataset string, length int, place string")
    assert selection.by_optional(df, chr="c1", dataset=None).count() == 2 and selection.by_optional(df, chr="c1", dataset="d2").count() == 1 and selection.by_optional(df).count() == 3
    assert selection.by_keys(df, "length", [5, 7, 8]).count() == 2
    assert df.filter(selection.is_blank(F.col("place"))).count() == 2
    hits = spark.createDataFrame([("Chr1_centromere", "t", 1, 9, 900, 99.0), ("Chr1_centromere", "t", 1, 9, 100, 99.0), ("Chr2_centromere", "u", 3, 4, 900, 80.0), ("other", "u", 3, 4, 900, 99.0)], "query string, target string, start int, end int, length int, identity double")
    assert rows(selection.centromere_hits(hits, 500, 90.0)) == [("Chr1", "t", 1, 9, 900, 99.0)]
    contigs = spark.createDataFrame([("a", "r", 10), ("b", "r", 9), ("c", "none", 4), ("d", None, 5)], "contig string, rule string, length int")
    assert rows(selection.long_enough(contigs, spark.createDataFrame([("r", 10)], "rule string, least int"), 5).select("contig")) == [("a",), ("d",)]
    pairs = spark.createDataFrame([("a", "b", 100, 60, "k1"), ("a", "a", 100, 60, "k2"), ("a", "c", 10, 60, "k3"), ("a", "d", 10, 60, "k4")], "query string, target string, block int, mapq int, key string")
    assert rows(selection.pairwise_hits(pairs, 50, 30, ["k4"]).select("key")) == [("k1",), ("k4",)] and selection.pairwise_hits(pairs, 50, 30).count() == 1
    assert selection.with_tokens(spark.createDataFrame([("The cat",), ("catalog",), (None,)], "t string"), "t", "CAT").count() == 1 and selection.with_tokens(df, "chr", " ,").count() == 0


def test_lookups(spark):
    segments = spark.createDataFrame([("s1", "c", 1), ("s2", "c", 2), ("s3", "c", 3), ("s4", "c", 3)], "segment string, chr string, start int")
    events = lambda *starts: spark.createDataFrame([(f"e{s}", "c", s) for s in starts], "event string, chr string, start int")
    assert rows(selection.matched_once(events(1, 2), segments, ["chr", "start"]).select("event", "segment")) == [("e1", "s1"), ("e2", "s2")]
    for bad in (3, 9):
        with pytest.raises(Exception, match="an event matches"):
            selection.matched_once(events(bad), segments, ["chr", "start"]).collect()
    known = spark.createDataFrame([(1, "x")], "k int, status string")
    assert rows(selection.with_defaults(spark.createDataFrame([(1,), (2,)], "k int"), known, ["k"], {"status": "unused"})) == [(1, "x"), (2, "unused")]
    assert rows(selection.in_both(known, spark.createDataFrame([(1,), (1,), (3,)], "k int"), ["k"])) == [(1,)]
    names = spark.createDataFrame([("ctg10",), ("ctg9",), ("ctg",), ("bac2x",)], "n string")
    assert [r.n for r in names.orderBy(*selection.natural(F.col("n"))).collect()] == ["bac2x", "ctg", "ctg9", "ctg10"]


def test_cards_attempts_and_pools(spark):
    events = spark.createDataFrame([("k", "s", "+", "c", 9, "e2"), ("k", "s", "+", "c", 4, "e1"), ("m", "t", "-", "c", 1, "e3")], "card string, source string, orientation string, chr string, start int, event string")
    assert rows(reports.source_cards(events)) == [("k", "s", "+", "c", 4, ["e1", "e2"]), ("m", "t", "-", "c", 1, ["e3"])]
    with pytest.raises(Exception, match="mixed source card"):
        reports.source_cards(events.withColumn("card", F.lit("k"))).collect()
    tries = spark.createDataFrame([("s1", "o", "b", "accepted"), ("s1", "o", "a", "rejected"), ("s1", "o", "a", "conflicted")], "stage string, object string, strategy string, outcome string")
    assert rows(reports.attempts(tries)) == [("s1", "o", ["a", "b"], 3, 1)]
    jobs = spark.createDataFrame([("j", "s1", True, True), ("j", "s2", False, True), ("j", "s3", True, False), ("i", "s4", False, False)], "job string, sequence string, circular boolean, assigned boolean")
    assert rows(reports.pool_report(jobs, spark.createDataFrame([("j", "c1"), ("j", "c2"), ("j", "c2")], "job string, clone string"))) == [("i", 1, 0, 0, 0), ("j", 3, 2, 66, 66)]


def test_choices_and_lines(spark):
    given = spark.createDataFrame([("a", "c1", 90, 70.0, 1), ("a", "c2", 90, 70.0, 0), ("b", "c1", 10, 5.0, 1), ("b", "c2", 11, 4.0, 0)], "contig string, chr string, support_bp int, support_percent double, place int")
    assert rows(starting_path.chosen_assignments(given, F.col("place")).select("contig", "chr")) == [("a", "c2"), ("b", "c2")]
    qualities = spark.createDataFrame([("a", 10.0, 5.0, 0.1, 100, 1), ("b", 30.0, 1.0, 0.2, 50, 2), ("c", 30.0, 1.0, 0.0, 40, 3)], "contig string, qv double, craq double, n_fraction double, length int, stable int")
    assert [r.contig for r in qualities.orderBy(*starting_path.quality_order(True)).collect()] == ["c", "b", "a"]
    assert [r.contig for r in qualities.orderBy(*starting_path.quality_order(False)).collect()] == ["a", "b", "c"]
    path = spark.createDataFrame([("c", 1, "source", "x", 1, 9, "+"), ("c", 2, "gap", None, 10, 19, None)], "chr string, n int, kind string, contig string, start int, end int, orientation string")
    assert [r.line for r in sinks.path_lines(path).orderBy("n").collect()] == ["c\t1\tsource\tx\t1\t9\t+", "c\t2\tgap\t\t10\t19\t"]
    log = spark.createDataFrame([("c", 3, 4, 30, 40)], "chr string, used int, assigned int, used_bp int, assigned_bp int")
    assert [r.line for r in sinks.log_lines(log).orderBy("part").collect()] == ["c\tcount\t3/4", "c\tlength\t30/40"]
