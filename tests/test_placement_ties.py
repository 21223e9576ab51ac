"""Hits with the same ends count once, whatever else differs."""

from lociweave.operators import placement


def test_hits_with_equal_ends_count_once(spark):
    ends = [(10, 46, 18153, "+"), (30, 64, 19072, "+"), (70, 110, 4182, "+"), (70, 110, 7823, "-")]
    for hits in (ends, ends[::-1]):
        df = spark.createDataFrame([("q", 120, "chr2", s, e, r, strand, e - s) for s, e, r, strand in hits], "query string, query_length long, target string, query_start long, query_end long, ref_start long, strand string, block long")
        assert [(r.support_bp, r.support_percent) for r in placement.forced(df, "chr2", 20, 25).collect()] == [(96, 80.0)]
