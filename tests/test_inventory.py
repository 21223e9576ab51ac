"""Inventory, validation, repair and streaming operators."""

import pytest
from pyspark.sql import functions as F

from lociweave.operators import inventory, repair, upkeep, validation
from lociweave.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_views_and_edges(spark):
    e = spark.createDataFrame([(1, "sequence", "s", 1, 2, 300, 4, "b", "n"), (2, "assemblyCtg", "c", 9, 1, 5, 70, "100", "n")], "id long, container string, name string, o int, x int, y int, z int, barcode string, note string")
    assert inventory.view(e, "sequence").select("length", "chr").first() == (300, 4)
    assert inventory.view(e, "assemblyCtg").select("assembly", "order", "length").first() == (9, 5, "100")
    edges = spark.createDataFrame([(7, "2", "group"), (7, "x", "group"), (8, "1", "box")], "parent long, child string, type string")
    assert rows(inventory.children(edges, e, "group").select("parent", "id")) == [(7, 2)]


def test_contig_edits(spark):
    contigs = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 2, 1)], "contig string, chr int, order int")
    members = spark.createDataFrame([("a", 0, 10), ("a", 1, 20), ("a", 2, 30), ("b", 0, 5)], "contig string, position int, length long")
    new, moved = inventory.broken(contigs, members, "a", 1, "a2")
    assert rows(new.select("contig", "order", F.coalesce("length", F.lit(0)))) == [("a", 1, 10), ("a2", 2, 50), ("b", 3, 5), ("c", 1, 0)]
    assert rows(moved.filter("contig = 'a2'")) == [("a2", 0, 20), ("a2", 1, 30)]
    m = spark.createDataFrame([("a", 0, "+"), ("a", 1, "-")], "contig string, position int, strand string")
    c = spark.createDataFrame([("a", 4), ("b", 1)], "contig string, end_type int")
    t, e = inventory.turned(m, c, F.col("contig") == "a")
    assert rows(t) == [("a", 0, "+"), ("a", 1, "-")] and rows(e) == [("a", 5), ("b", 1)]


def test_merge_rekeys_and_dedups(spark):
    edges = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "parent int, child int")
    ids = spark.createDataFrame([(2, 1)], "old int, new int")
    assert rows(inventory.rekeyed(edges, ids, ["parent"], distinct=True).select("parent", "child")) == [(1, 10), (3, 11)]


def test_reports(spark):
    clones = spark.createDataFrame([("l", 1, True), ("l", 1, False), ("l", 2, True)], "library string, plate int, sequenced boolean")
    assert sorted((r.library or "", r.plate or 0, r.clones, r.sequenced, r.percent) for r in inventory.progress(clones).collect()) == [("", 0, 3, 2, 66), ("l", 0, 3, 2, 66), ("l", 1, 2, 1, 50), ("l", 2, 1, 1, 100)]
    status = spark.createDataFrame([("c", 4), ("c", 2), ("d", 5), ("d", 3)], "clone string, status int")
    assert rows(inventory.status_of_clones(status)) == [("c", 2), ("d", 3)]
    ends = spark.createDataFrame([("c", "t", 100, "+", "f"), ("c", "t", 50_100, "-", "r"), ("d", "t", 1, "+", "f"), ("d", "t", 60_000, "+", "r")], "clone string, target string, position long, strand string, direction string")
    assert rows(inventory.paired_ends(ends).select("clone", "distance")) == [("c", 50_000)]
    tracks = spark.createDataFrame([("x", "A"), ("x", "C")], "k string, track string")
    assert rows(inventory.first_free(tracks, ["k"])) == [("x", "B")]


def test_violations(spark):
    child, parent = spark.createDataFrame([("a",), ("b",), (None,)], "k string"), spark.createDataFrame([("a",)], "p string")
    bad = validation.all_of(
        validation.references(child, parent, ["k"], ["p"], "t.tsv"),
        validation.unique(spark.createDataFrame([("q",), ("q",)], "k string"), ["k"], "u.tsv"),
        validation.coordinates(spark.createDataFrame([("x", 5, 4)], "k string, s long, e long"), "s", "e", F.col("k"), "c.tsv"),
        validation.contiguous(spark.createDataFrame([("y", 1), ("y", 3)], "k string, o int"), ["k"], "o", "o.tsv"),
    )
    assert rows(bad.select("code", "key")) == [("BROKEN_REFERENCE", "b"), ("INVALID_COORDINATE", "x"), ("INVALID_VALUE", "q"), ("INVALID_VALUE", "y")]
    assert {r.code for r in bad.collect()} <= set(validation.CODES)


def test_anchor_pairs_give_reasons(spark):
    flanks = [("g", "L", "d", "+", 1, 100, 0.9, 100), ("g", "R", "d", "+", 201, 300, 0.8, 100), ("g", "R", "d", "-", 201, 300, 0.9, 100), ("g", "R", "d", "+", 5_000_000, 5_000_100, 0.9, 100), ("h", "L", "d", "+", 1, 100, 0.9, 100)]
    df = spark.createDataFrame(flanks, "gap string, side string, donor string, strand string, d_start long, d_end long, identity double, block long")
    pairs = repair.anchor_pairs(df)
    assert rows(pairs.select(F.coalesce("reason", F.lit("ok")), "patch_start")) == [("distance", 101), ("ok", 101), ("strand", 101)]
    assert rows(repair.nearest_pairs(pairs).select("gap", "patch_start", "patch_end")) == [("g", 101, 200)]
    assert rows(repair.missing_flanks(spark.createDataFrame([("g",), ("h",), ("i",)], "gap string"), df)) == [("h", "no_right"), ("i", "no_hit")]


def test_half_overlap_pairs(spark):
    top = spark.createDataFrame([("k", 0, 10), ("k", 20, 30)], "k string, l_start long, l_end long")
    bottom = spark.createDataFrame([("k", 5, 15), ("k", 10, 20), ("k", 26, 60)], "k string, r_start long, r_end long")
    assert rows(repair.pairs_by_share(top, bottom, "k", 8).select("l_start", "r_start")) == [(0, 5)]


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    folder, table = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    line = "q\t100\t0\t10\t+\tt\t500\t20\t30\t9\t10\t60\n"
    (folder / "a.paf").write_text(line * 3 + "broken\n")
    incremental.append_to(incremental.stream_paf(spark, str(folder)), str(table), str(tmp_path / "cp")).awaitTermination()
    (folder / "b.paf").write_text(line * 2)
    incremental.append_to(incremental.stream_paf(spark, str(folder)), str(table), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(table)).filter("query_start = 1").count() == 5
    batch = incremental.activity(spark.read.parquet(f"{sf_dir}/events.parquet"))
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event*.parquet")
    q = incremental.activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("activity")) == rows(batch)


def test_orders_ranges_signs_and_hidden_hits(spark):
    contigs = spark.createDataFrame([("a", "1", 1), ("b", "1", 2), ("c", "1", 3), ("d", "2", 1)], "contig string, chr string, order int")
    assert sorted((r.contig, r.order) for r in inventory.reordered(contigs, "c,x,a").collect()) == [("a", 2), ("b", 3), ("c", 1), ("d", 1)]
    members = spark.createDataFrame([("a", 0, "s", 5, 9, "+"), ("a", 1, "t", 2, 3, "-")], "contig string, position int, seq string, start long, end long, strand string")
    lengths = spark.createDataFrame([("s", 20), ("t", 7)], "seq string, length long")
    m, total = inventory.full_length(members, lengths)
    assert sorted((r.seq, r.start, r.end) for r in m.collect()) == [("s", 1, 20), ("t", 1, 7)] and total.first()["length"] == 27
    assert sorted(r.strand for r in inventory.toggled(members, F.col("seq") == "s", "strand").collect()) == ["-", "-"]
    hits = spark.createDataFrame([("s", "t", 1, False), ("t", "s", 2, False), ("t", "s", 1, False), ("u", "s", 1, False)], "query_name string, ref_name string, line_no int, hidden boolean")
    assert sorted((r.query_name, r.line_no) for r in inventory.hidden_hit(hits, "s", "t", 1).filter("hidden").collect()) == [("s", 1), ("t", 1)]
    users = spark.createDataFrame([("x",), ("y",)], "user string")
    values, defaults = spark.createDataFrame([("x", "f", "1")], "user string, field string, value string"), spark.createDataFrame([("f", "9"), ("f", "8"), ("g", "0")], "field string, value string")
    assert sorted((r.user, r.value) for r in inventory.setting(users, values, defaults, "f").collect()) == [("x", "1"), ("y", "8")]
    assert [r.value for r in inventory.setting(users, values.limit(0), defaults.limit(0), "f").collect()] == [None, None]


def test_upkeep(spark):
    log = spark.createDataFrame([(1, 10, "a", "x")], "n long, at int, actor string, action string")
    grown = upkeep.logged(log, spark.createDataFrame([(30, "b", "z"), (20, "b", "y")], "at int, actor string, action string"))
    assert [(r.n, r.action) for r in upkeep.newest(grown, 2).collect()] == [(3, "z"), (2, "y")]
    users = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "user string")
    edges, lists = spark.createDataFrame([("g1", "u1")], "group string, user string"), spark.createDataFrame([("i", "g1,u2,"), ("j", "u3")], "item string, allowed string")
    assert sorted(r.user for r in upkeep.permitted(users, edges, lists, "i").collect()) == ["u1", "u2"]
    clones, marks = spark.createDataFrame([("a", "old"), ("b", ""), ("c", "k")], "clone string, mark string"), spark.createDataFrame([("a", "new"), ("b", "new")], "clone string, mark string")
    assert sorted((r.clone, r.mark) for r in upkeep.marked_clones(clones, marks, False).collect()) == [("a", "old"), ("b", "new"), ("c", "k")]
    assert sorted((r.clone, r.mark) for r in upkeep.marked_clones(clones, marks, True).collect()) == [("a", "new"), ("b", "new"), ("c", "k")]
    hits = spark.createDataFrame([("a", "1", 50, 9), ("a", "1", 20, 9), ("a", "2", 7, 99)], "contig string, chr string, position int, length int")
    placed = upkeep.assigned_by_longest(spark.createDataFrame([("a", "0", 3), ("b", "0", 4)], "contig string, chr string, position int"), hits, "1")
    assert sorted((r.contig, r.chr, r.position) for r in placed.collect()) == [("a", "1", 20), ("b", "1", 0)]
    assert upkeep.with_state(clones.withColumn("status", F.lit(1)), F.col("clone") == "a", True).agg(F.sum("status")).first()[0] == 4
    names = spark.createDataFrame([("n",)], "contig string")
    assert upkeep.new_names(names, names.filter("false")).count() == 1
    for bad in (upkeep.new_names(names, names), upkeep.new_names(names.unionAll(names), names.filter("false")), upkeep.reconciled_lengths(spark.createDataFrame([("n", 5)], "identity string, length int"), spark.createDataFrame([("n", 6)], "identity string, length int"))):
        with pytest.raises(Exception, match="taken|differ"):
            bad.collect()
