"""Redundant contigs by brute force, and with many equal ones."""

import random
from threading import Timer

from lociweave.operators import starting_path


def brute(candidates, hits):
    spans = {}
    for chr_, contig, start, end in sorted(hits):
        mine = spans.setdefault((chr_, contig), [])
        if mine and start <= mine[-1][1] + 1:
            mine[-1][1] = max(mine[-1][1], end)
        else:
            mine.append([start, end])
    covers = lambda a, b: all(any(s <= x and y <= e for s, e in spans[b]) for x, y in spans[a])
    found = set()
    for chr_, contig, quality, _ in candidates:
        a = (chr_, contig)
        others = [(st, o) for c, o, q, st in candidates if a in spans and c == chr_ and o != contig and (c, o) in spans and covers(a, (c, o)) and (not covers((c, o), a) or q < quality)]
        if others:
            found.add((*a, min(others)[1]))
    return found


def test_redundant_contigs_by_brute_force(spark):
    rng = random.Random(5)
    candidates = [(c, i, rng.randrange(6), rng.randrange(20)) for c in ("a", "b") for i in range(60)]
    hits = []
    for c, i, _, _ in candidates[:-2]:
        if i % 3 == 1:  # the places of the one before
            hits += [(c, i, s, e) for x, j, s, e in hits if (x, j) == (c, i - 1)]
            continue
        for _ in range(rng.choice([1, 1, 2, 3])):
            start = rng.randrange(-400, 4_000)
            hits.append((c, i, start, start + rng.choice([0, 5, 60, 700, 2_500])))
    frames = spark.createDataFrame(candidates, "chr string, contig long, quality int, stable int"), spark.createDataFrame(hits, "chr string, contig long, start long, end long")
    want = brute(candidates, hits)
    assert len(want) > 60
    for bin_size in (1, 40, 100_000):
        assert {tuple(r) for r in starting_path.redundant(*frames, bin_size).collect()} == want


def test_redundant_contigs_that_are_all_alike(spark):
    """A chromosome of equal contigs: the best stays, and nothing grows with their square."""
    n = 60_000
    candidates = spark.range(n).selectExpr("'a' as chr", "id as contig", "id as quality", "-id as stable")
    hits = spark.range(n).selectExpr("'a' as chr", "id as contig", "explode(array(100, 300)) as start").selectExpr("*", "start + 50 as end")
    stop = Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = starting_path.redundant(candidates, hits, 40).selectExpr("count(*)", "min(contig)", "count_if(covered_by = contig - 1)").collect()
    finally:
        stop.cancel()
    assert [tuple(r) for r in got] == [(n - 1, 1, n - 1)]


def test_first_path_of_contigs_that_are_all_alike(spark, tmp_path):
    """60,000 customers with the same two orders each: one stays, as the path's only segment."""
    from lociweave.plans.reporting import q52_first_path

    n = 60_000
    spark.range(n).selectExpr("id as c_custkey", "1 as c_nationkey", "cast(id as double) as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2 * n).selectExpr("id * 60 as o_orderkey", "id div 2 as o_custkey", "timestamp '2020-01-01' + make_interval(0, 0, 0, cast(id % 2 * 90 as int)) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    stop = Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = q52_first_path(spark, str(tmp_path)).select("chr", "n", "kind", "contig", "start", "end", "orientation").collect()
    finally:
        stop.cancel()
    assert [tuple(r) for r in got] == [(1, 1, "source", n - 1, 1, (n - 1) % 50 + 10, "+")]


def test_redundant_contigs_with_unknown_places(spark):
    """Nothing covers a contig with a hit of unknown place, not even an equal one; its known places still cover others."""
    candidates = spark.createDataFrame([("a", i, i, i) for i in range(4)], "chr string, contig long, quality int, stable int")
    hits = spark.createDataFrame([("a", 0, 10, 90), ("a", 0, None, None), ("a", 1, 10, 90), ("a", 1, None, None), ("a", 2, 20, 30), ("a", 3, None, None)], "chr string, contig long, start long, end long")
    assert [tuple(r) for r in starting_path.redundant(candidates, hits, 40).collect()] == [("a", 2, 0)]


def test_hits_without_a_chromosome(spark):
    """They are on the chromosome of their candidate; hits of no candidate and candidates without hits do not count."""
    rng = random.Random(6)
    candidates = [("ab"[i % 2], i, rng.randrange(6), rng.randrange(20)) for i in range(80)]
    chr_ = {i: c for c, i, _, _ in candidates}
    hits = [(i, s := rng.randrange(300), s + rng.choice([5, 60, 200])) for i in range(2, 90) for _ in range(rng.choice([1, 1, 2]))]
    want = brute(candidates, [(chr_[i], i, s, e) for i, s, e in hits if i in chr_])
    assert len(want) > 20
    frames = spark.createDataFrame(candidates, "chr string, contig long, quality int, stable int"), spark.createDataFrame(hits, "contig long, start long, end long")
    got = [tuple(r) for r in starting_path.footprint_covers(*frames, 40).select("chr", "contig", "covered_by").collect()]
    assert {r for r in got if r[2] is not None} == want
    assert sorted(r[1] for r in got) == list(range(2, 80))


def test_first_path_moves_each_order_once(spark, tmp_path):
    """Orders are dealt once, as they are; nothing is joined to them one by one."""
    from lociweave.plans.reporting import contigs

    spark.createDataFrame([(1, 1, 5.0)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1)], "o_orderkey long, o_custkey long").selectExpr("*", "timestamp '2020-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in contigs(spark, str(tmp_path))]
    assert not any("Join" in p or "Exchange" in p for p in plans)
