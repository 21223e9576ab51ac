"""Operators against plain sequential versions on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from lociweave.functions import coordinates, nested, sequence
from lociweave.operators import aggregates, arbitration, decisions, graph, greedy, intervals, ordering, paths, placement, trees


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain_islands(spans, touch=1):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + touch:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def random_spans(spark, n=300, seed=1):
    rng = random.Random(seed)
    data = [(rng.randrange(8), s, s + rng.randrange(12)) for s in (rng.randrange(1, 400) for _ in range(n))]
    return data, spark.createDataFrame(data, "k int, start long, end long")


def test_islands_merge_touching_intervals(spark):
    data, df = random_spans(spark)
    for adjacent, touch in ((True, 1), (False, 0)):
        want = sorted((k, *x) for k in {d[0] for d in data} for x in plain_islands([d[1:] for d in data if d[0] == k], touch))
        assert rows(intervals.islands(df, ["k"], adjacent=adjacent).select("k", "start", "end")) == want


def test_adjacent_rule_is_plus_one(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 6, 9), (1, 11, 12)], "k int, start long, end long")
    assert rows(intervals.islands(df, ["k"]).select("start", "end")) == [(1, 9), (11, 12)]
    assert rows(intervals.covered(df, ["k"])) == [(1, 11)]
    assert rows(intervals.gaps(intervals.islands(df, ["k"]), ["k"], F.lit(0), F.lit(20))) == [(1, 0, 0), (1, 10, 10), (1, 13, 20)]


def test_range_join_equals_nested_loop(spark):
    a, left = random_spans(spark, 120, 2)
    b, right = random_spans(spark, 120, 3)
    left = left.select("k", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = right.select("k", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    want = sorted((k, s, e, x, y) for k, s, e in a for j, x, y in b if j == k and s <= y and x <= e)
    assert rows(intervals.range_join(left, right, ["k"], 10).select("k", "l_start", "l_end", "r_start", "r_end")) == want
    want = sorted((k, s, e, x, y) for k, s, e in a for j, x, y in b if j == k and s < y and x < e)
    assert rows(intervals.range_join(left, right, ["k"], 10, half_open=True).select("k", "l_start", "l_end", "r_start", "r_end")) == want


def test_lonely_and_covers(spark):
    data, df = random_spans(spark, 60, 4)
    want = sorted(d for i, d in enumerate(data) if not any(j != i and o[0] == d[0] and o[1] <= d[2] and d[1] <= o[2] for j, o in enumerate(data)))
    assert rows(intervals.lonely(df, ["k"])) == want
    box = spark.createDataFrame([(1, 1, 10), (1, 20, 30), (2, 1, 5), (3, 1, 5)], "k int, start long, end long")
    sub = spark.createDataFrame([(1, 2, 3), (1, 20, 30), (2, 4, 6)], "k int, start long, end long")
    assert rows(intervals.covers(box, sub, ["k"])) == [(1, True), (2, False), (3, False)]


def test_lanes_first_fit(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 4, 9), ("a", 6, 7), ("b", 1, 1)], "k string, start long, end long")
    assert rows(intervals.lanes(df, "k", "k string, start long, end long, lane int")) == [("a", 1, 5, 0), ("a", 2, 3, 1), ("a", 4, 9, 1), ("a", 6, 7, 0), ("b", 1, 1, 0)]


def test_weighted_median_threshold_and_zero_weights(spark):
    df = spark.createDataFrame([(1, 10, 1), (1, 20, 1), (2, 5, 0), (2, 6, 0), (2, 7, -3), (3, 1, 2), (3, 9, 2)], "k int, p long, w long")
    # total // 2 + 1: with 1 + 1 the second is needed; without weight the middle element
    assert rows(aggregates.weighted_median(df, ["k"], "p", "w")) == [(1, 20), (2, 6), (3, 9)]


def test_statistics_of_even_and_odd_counts(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (1, 30), (1, 40), (2, 7), (2, 7), (2, 1)], "k int, n long")
    assert rows(aggregates.assembly_statistics(df, ["k"], "n")) == [(1, 4, 100, 40, 25.0, 30), (2, 3, 15, 7, 7.0, 7)]


def test_identical_genotypes_have_distance_zero_not_one(spark):
    df = spark.createDataFrame([("a", 1, "AA"), ("b", 1, "AA"), ("a", 2, "NN"), ("b", 2, "NN"), ("c", 1, "TT")], "t string, m int, c string")
    assert rows(aggregates.genotype_distance(df, "t", "m", "c")) == [("a", "b", 2, 1, 0.5), ("a", "c", 1, 1, 1.0), ("b", "c", 1, 1, 1.0)]


def test_majority_tie_is_plus(spark):
    df = spark.createDataFrame([("-", 5), ("+", 5)], "s string, w int")
    assert df.agg(aggregates.majority_strand(F.col("s"), F.col("w"))).first()[0] == "+"


def test_runs_and_segments(spark):
    df = spark.createDataFrame([("NNACGNNNT",), ("ACG",), ("NNN",), ("",)], "s string")
    got = [(r[0], [tuple(x) for x in r[1]], [tuple(x) for x in r[2]]) for r in df.select("s", sequence.runs_of(F.col("s"), "N"), sequence.segments_between(F.col("s"), "N", 3)).collect()]
    assert got == [("NNACGNNNT", [(1, 2), (6, 8)], [(1, 5), (9, 9)]), ("ACG", [], [(1, 3)]), ("NNN", [(1, 3)], []), ("", [], [])]


def test_reverse_complements_differ_on_iupac(spark):
    r = spark.createDataFrame([("ACRn",)], "s string").select(sequence.reverse_complement(F.col("s")), sequence.reverse_complement_plain(F.col("s"))).first()
    assert tuple(r) == ("NYGT", "NRGT")


def test_tandem_repeats_on_both_strands(spark):
    s = "TTAGGG" * 3 + "A" + "CCCTAA" * 2
    r = spark.createDataFrame([(s,)], "s string").select(sequence.tandem_repeats(F.col("s"), "TTAGGG", 2)).first()[0]
    assert [tuple(x) for x in r] == [(1, 18, "+"), (20, 31, "-")]


def test_rounding_rules(spark):
    r = spark.createDataFrame([(2.5,), (-2.5,)], "x double").select(coordinates.half_even(F.col("x")), coordinates.half_up(F.col("x"))).collect()
    assert [tuple(x) for x in r] == [(2, 3), (-2, -2)]


def test_members_round_trip(spark):
    df = spark.createDataFrame([(1, "(12),-(15),(20)")], "c int, cell string")
    out = nested.members(df, "cell")
    assert rows(out.select("position", "member", "hidden")) == [(0, "12", False), (1, "15", True), (2, "20", False)]
    back = nested.member_cell(out, ["c"], [F.col("position")], F.col("member"), F.col("hidden"))
    assert back.first()["cell"] == "(12),-(15),(20)"


def candidates(spark, *rows):
    return spark.createDataFrame(list(rows), "candidate_id string, target string, source string, start long, end long, orientation string, score int")


def test_a_stretch_is_used_again_for_other_targets_in_one_orientation_only(spark):
    best_first = [-F.col("score")]
    df = candidates(spark, ("c1", "g1", "d", 1001, 2000, "+", 9), ("c2", "g2", "d", 1001, 2000, "+", 9))
    assert rows(arbitration.arbitrate(df, best_first).select("candidate_id", "outcome", F.coalesce("reuse_of", F.lit("")))) == [("c1", "accepted", ""), ("c2", "accepted", "c1")]
    df = candidates(spark, ("c1", "g1", "d", 1001, 2000, "+", 9), ("c2", "g2", "d", 1001, 2000, "-", 9), ("c3", "g1", "e", 1, 5, "+", 1), ("c4", "g4", "d", 2001, 2100, "-", 1))
    assert rows(arbitration.arbitrate(df, best_first).select("candidate_id", "outcome")) == [("c1", "accepted"), ("c2", "conflicted"), ("c3", "rejected"), ("c4", "accepted")]
    before = candidates(spark, ("u1", "g1", "d", 1500, 1600, "+", 0)).drop("score")
    got = arbitration.arbitrate(candidates(spark, ("c1", "g1", "d", 1001, 2000, "+", 9), ("c2", "g2", "d", 1590, 2000, "+", 9), ("c3", "g3", "d", 1600, 1700, "-", 5)), best_first, before)
    assert rows(got.select("candidate_id", "outcome", "reason")) == [("c1", "conflicted", "source_interval_consumed_by:u1"), ("c2", "accepted", "accepted_with_donor_reuse_of:u1"), ("c3", "conflicted", "source_interval_reuse_orientation_conflict")]


def test_an_edit_over_an_interval_blocks_its_projection(spark):
    edits = spark.createDataFrame([("a", 10, 19, 5), ("a", 50, 59, 20), ("b", 1, 1, 9)], "chr string, edit_start long, edit_end long, new_length long")
    spans = spark.createDataFrame([("x", "a", 1, 9), ("y", "a", 20, 30), ("z", "a", 55, 70), ("w", "a", 60, 61), ("v", "c", 5, 6)], "id string, chr string, start long, end long")
    got = {r.id: (r.new_start, r.new_end, r.blocked) for r in decisions.projected_through(spans, edits, 25).collect()}
    assert got == {"x": (1, 9, False), "y": (15, 25, False), "z": (None, None, True), "w": (65, 66, False), "v": (5, 6, False)}


def test_contained_once_by_nested_loop(spark):
    inner = [(i, i % 3, s, s + n) for i, (s, n) in enumerate([(1, 4), (10, 5), (20, 9), (2400, 30), (5, 2), (30, 1)])]
    outer = [(0, 1, 20), (0, 1, 8), (1, 1, 4000), (2, 15, 40), (1, 9, 13)]
    got = intervals.contained_once(spark.createDataFrame(inner, "i int, k int, l_start long, l_end long"), spark.createDataFrame(outer, "k int, r_start long, r_end long"), ["k"], "i", 10)
    want = []
    for i, k, s, e in inner:
        held = [(a, b) for j, a, b in outer if j == k and a <= s and e <= b]
        want += [(i, s, e, *held[0])] if len(held) == 1 else []
    assert rows(got.select("i", "l_start", "l_end", "r_start", "r_end")) == sorted(want)


def test_tiling(spark):
    df = spark.createDataFrame([("k", "a", 1, 10), ("k", "b", 5, 12), ("k", "c", 8, 20), ("k", "d", 12, 25), ("k", "e", 40, 50)], "k string, i string, start long, end long")
    assert rows(greedy.tiling_path(df, "k", "i").select("step", "i")) == [(1, "a"), (2, "c"), (3, "d"), (4, "e")]


def test_overlaps_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("AC") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        want = []
        for t in range(4):
            x = a[: len(a) - t] if t < len(a) else ""
            want.append(max(k for k in range(min(len(x), len(b), 6) + 1) if x.endswith(b[:k])))
        assert greedy._overlaps(a, b, 6, 3) == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    got = dict(rows(graph.connected_components(spark.createDataFrame(edges, "u int, v int"))))
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 130)} == {100}
    assert not graph.connected_components(spark.createDataFrame([], "u int, v int")).count()


def test_buried_fixpoint(spark):
    seqs = spark.createDataFrame([("a", 100), ("b", 50), ("c", 20), ("d", 50)], "name string, length long")
    hits = spark.createDataFrame([("b", "a", 1, 50), ("c", "b", 1, 20), ("d", "c", 1, 20)], "query string, target string, q_start long, q_end long")
    # c is covered by b only, and b is hidden, so c stays
    assert rows(graph.buried(seqs, hits)) == [("b",)]


def test_path_rewrite_keeps_source_coordinates(spark):
    path = spark.createDataFrame([("c", 1, "source", "s1", 1, 100, "+", 100), ("c", 2, "gap", None, None, None, None, 100), ("c", 3, "source", "s2", 11, 60, "-", 50)], "chr string, idx int, kind string, source string, source_start long, source_end long, orientation string, length long")
    edit = spark.createDataFrame([("c", 91, 210, "d", 5, 44, "+")], "chr string, edit_start long, edit_end long, source string, source_start long, source_end long, orientation string")
    got = paths.rewritten(paths.laid_out(path), edit).orderBy("idx").select("source", "source_start", "source_end", "orientation", "length").collect()
    assert [tuple(r) for r in got] == [("s1", 1, 90, "+", 90), ("d", 5, 44, "+", 40), ("s2", 11, 50, "-", 40)]


def test_path_sequence_and_verification(spark):
    path = spark.createDataFrame([("c", 1, "source", "s", 1, 4, "+", 4), ("c", 2, "gap", None, None, None, None, 3), ("c", 3, "source", "s", 2, 4, "-", 3)], "chr string, idx int, kind string, source string, source_start long, source_end long, orientation string, length long")
    built = paths.sequences(path, spark.createDataFrame([("s", "AACGT")], "name string, sequence string"))
    assert built.first()["sequence"] == "AACGNNNCGT"
    assert not paths.verified(built, built).count()
    wrong = built.withColumn("sha256", F.lit("x"))
    assert rows(paths.verified(built, wrong)) == [("c", "CHECKSUM_MISMATCH")]


def test_assignment_counts_overlapping_hits_once(spark):
    hits = [("q", 2000, "chr1", 1, 1000, 101, "+", 1000), ("q", 2000, "chr1", 501, 1500, 601, "+", 1000), ("q", 2000, "chr2", 1, 1000, 5, "-", 1000), ("q", 2000, "chr1", 1900, 1950, 1, "+", 51)]
    df = spark.createDataFrame(hits, "query string, query_length long, target string, query_start long, query_end long, ref_start long, strand string, block long")
    assert [tuple(r) for r in placement.assign(df).collect()] == [("q", "chr1", 1500, "+", 101, 75.0, 1)]


def test_exploded_cigar_on_both_strands(spark):
    hits = spark.createDataFrame([(1, "+", 11, 20, 101, "4M2I4M"), (2, "-", 11, 20, 101, "4M3D6M")], "hit_id int, strand string, query_start long, query_end long, ref_start long, cigar string")
    got = paths.exploded_cigar(hits).orderBy("hit_id", "pos").select("op", "length", "query_from", "ref_from").collect()
    assert [tuple(r) for r in got] == [("M", 4, 11, 101), ("I", 2, 15, 105), ("M", 4, 17, 105), ("M", 4, 20, 101), ("D", 3, 16, 105), ("M", 6, 16, 108)]


def test_ordering_helpers(spark):
    df = spark.createDataFrame([(1, "a", 1, 5), (1, "b", 6, 9), (1, "c", 8, 9), (1, "d", 20, 21)], "k int, i string, start long, end long")
    got = ordering.neighbour_classes(df, ["k"], ["start"]).orderBy("start").select("relation", "bp").collect()
    assert [tuple(r) for r in got] == [("first", 0), ("adjacent", 0), ("overlap", 2), ("gap", 10)]


def test_neighbour_joining_gives_back_an_additive_tree(spark):
    far = {"ab": 5, "ac": 9, "ad": 9, "ae": 8, "bc": 10, "bd": 10, "be": 9, "cd": 8, "ce": 7, "de": 3}
    df = spark.createDataFrame([(k[0], k[1], float(v)) for k, v in far.items()], "a string, b string, distance double")
    tree = trees.neighbour_joining(df)
    assert tree in ("(d:2.00000,e:1.00000,(c:4.00000,(a:2.00000,b:3.00000):3.00000):2.00000);", "(e:1.00000,d:2.00000,(c:4.00000,(a:2.00000,b:3.00000):3.00000):2.00000);")
    assert trees.neighbour_joining(df.filter("a = 'a' and b = 'b'")) == "(a:2.50000,b:2.50000);"
    with pytest.raises(ValueError, match="no distance"):
        trees.neighbour_joining(df.filter("a <> 'a' or b <> 'b'"))


def test_direct_merges_by_brute_force(spark):
    rng = random.Random(8)
    data = []
    for i in range(150):
        a, b = "".join(rng.choice("AC") for _ in range(rng.randrange(1, 14))), "".join(rng.choice("AC") for _ in range(rng.randrange(1, 14)))
        data.append((i, 100, 120, a, b))
    got = {r.i: (r.trim_left, r.trim_right, r.edit_start, r.edit_end) for r in greedy.merged_directly(spark.createDataFrame(data, "i int, gap_start long, gap_end long, left_sequence string, right_sequence string"), 3, 20, 2).collect()}
    for i, s, e, a, b in data:
        over = [max(k for k in range(min(len(x), len(b)) + 1) if x.endswith(b[:k])) if x else 0 for x in (a[: len(a) - t] if t < len(a) else "" for t in range(3))]
        if over[0] >= len(b):
            want = None
        elif over[0] >= 3:
            want = (0, over[0])
        else:
            best = max(((n, -t) for t, n in enumerate(over) if 0 < t < len(a) and 3 <= n < len(b)), default=None)
            want = best and (-best[1], best[0])
        assert got[i] == ((want[0], want[1], s - want[0], e + want[1]) if want else (None,) * 4), (a, b)
