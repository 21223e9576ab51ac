"""Readers and writers on files written by the tests."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociweave.sources import alignments, sequences, sinks, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_paf_is_one_based_and_lenient(spark, tmp_path):
    p = tmp_path / "a.paf"
    p.write_text("q\t100\t0\t10\t+\tt\t500\t20\t30\t9\t10\t60\tcg:Z:10M\tdv:f:0.1\n\n#c\nq\t100\t0\n" + "q\t100\t0\t10\t*\tt\t500\t20\t30\t9\t10\t60\nq\t100\tx\t10\t-\tt\t500\t20\t30\t9\t10\t60\nq\t100\t90\t100\t-\tt\t500\t0\t10\t9\t10\t60\n")
    got = alignments.read_paf(spark, str(p)).orderBy("line_no").select("line_no", "query_start", "query_end", "ref_start", "ref_end", "strand", "cigar", "divergence").collect()
    assert [tuple(r) for r in got] == [(1, 1, 10, 21, 30, "+", "10M", 0.1), (7, 91, 100, 1, 10, "-", None, None)]
    names = spark.createDataFrame([("q", 100)], "name string, length long")
    found = alignments.paf_violations(alignments.parse_paf(alignments.numbered_lines(spark, str(p))), names, spark.createDataFrame([("t", 501)], "name string, length long"))
    assert rows(found) == [(1, "length"), (4, "columns"), (5, "strand"), (6, "number"), (7, "length")]


def test_line_numbers_across_splits(spark, tmp_path):
    p = tmp_path / "long.txt"
    p.write_text("".join(f"{i}\n" for i in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        assert not alignments.numbered_lines(spark, str(p)).filter("cast(value as long) <> line_no").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_show_coords(spark, tmp_path):
    p = tmp_path / "x.coords"
    p.write_text("/a /b\nNUCMER\n\n    [S1]     [E1]  |     [S2]     [E2]\n=====\n  1  100  |  300  201  |  100  100  |  98.50  |  500  600  | ref  qry\n")
    got = rows(alignments.parse_show_coords(alignments.numbered_lines(spark, str(p))).drop("line_no"))
    assert got == [(1, 100, 201, 300, "-", 0.985, "ref", "qry")]


def test_blast_to_paf_and_both_directions(spark, tmp_path):
    p = tmp_path / "x.tbl"
    p.write_text("q\tt\t90.0\t100\t10\t0\t1\t100\t200\t101\t1e-200\t180\n")
    hits = alignments.read_blast(spark, str(p))
    assert hits.first()["evalue"] == "1e-200" and hits.first()["strand"] == "-"
    paf = alignments.blast_to_paf(hits, spark.createDataFrame([("q", 150), ("t", 300)], "name string, length long")).first()
    assert (paf["matches"], paf["mapq"], paf["ref_start"], round(paf["divergence"], 6)) == (90, 255, 101, 0.1)
    both = rows(alignments.both_directions(hits).select("query_name", "ref_name", "query_start", "ref_start"))
    assert both == [("q", "t", 1, 101), ("t", "q", 101, 1)]


def test_fasta_round_trip(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">one first\nacgt\nNN\n>two\n" + "A" * 200 + "\n>three\n")
    got = sequences.read_fasta(spark, str(p))
    assert rows(got.select("name", "length")) == [("one", 6), ("three", 0), ("two", 200)]
    assert rows(sequences.fasta_violations(got)) == [("three", "empty")]
    assert rows(sequences.read_fasta(spark, str(p), spark.createDataFrame([("one",)], "name string")).select("sequence")) == [("ACGTNN",)]
    sequences.write_fasta(got.filter("length > 0"), str(tmp_path / "out"))
    assert rows(sequences.read_fasta(spark, str(tmp_path / "out"))) == rows(got.filter("length > 0"))
    assert max(len(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()) == 80


def test_contract_header_and_cells(spark, tmp_path):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])
    p = tmp_path / "t.tsv"
    p.write_text("name\tn\na\t1\nb\tx\n")
    raw = tables.read_contract(spark, str(p), schema)
    assert rows(tables.typed(raw, schema).select("name", F.coalesce("n", F.lit(-1)))) == [("a", 1), ("b", -1)]
    assert rows(tables.cell_violations(raw, schema, {"name": ("a",)}, most=1)) == [("INVALID_TSV", "rows", "2"), ("INVALID_VALUE", "n", "x"), ("INVALID_VALUE", "name", "b")]
    p.write_text("n\tname\n")
    with pytest.raises(tables.HeaderError):
        tables.read_contract(spark, str(p), schema)


def test_agp_first_use_and_writer(spark, tmp_path):
    p = tmp_path / "a.agp"
    p.write_text("chr1\t1\t10\t1\tW\tc1\t1\t10\t+\nchr1\t11\t110\t2\tN\t100\tscaffold\tyes\tx\nchr1\t111\t120\t3\tW\tc1\t1\t10\t-\n")
    assert rows(tables.read_agp(spark, str(p)).select("part", "is_gap")) == [(1, False), (2, True)]
    pieces = spark.createDataFrame([("o", 1, "a", 10, "+"), ("o", 2, "b", 5, "-")], "object string, ord int, component string, length long, orientation string")
    assert [r[2].split("\t")[1:5] for r in sinks.agp_lines(pieces).orderBy("part").collect()] == [["1", "10", "1", "W"], ["11", "110", "2", "N"], ["111", "115", "3", "W"]]


def test_fpc_sections(spark, tmp_path):
    p = tmp_path / "m.fpc"
    p.write_text('BAC : "a0001A01"\nMap "ctg1" Ends Left 5.0\nMap "ctg1" Ends Right 20.0\nBAC : "a0001A02"\nMap "ctg2" Ends Left 1.0\nContigdata 2\nMap "x" Ends Left 1.0\n')
    assert rows(tables.read_fpc(spark, str(p)).select("bac", "contig", "left", F.coalesce("right", F.lit(-1.0)))) == [("a0001A01", "ctg1", 5.0, 20.0), ("a0001A02", "ctg2", 1.0, -1.0)]


def test_merges(spark):
    now, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert rows(sinks.upsert(now, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    added, taken = sinks.append_new(now, new, ["k"])
    assert (rows(added), rows(taken)) == ([(1, "a"), (2, "b"), (3, "d")], [(2, "c")])
    assert rows(sinks.replace_groups(now, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]


def test_archives_are_extracted_only_if_safe(spark, tmp_path):
    import zipfile

    from lociweave.sources import archives

    def packed(name, *members):
        path = str(tmp_path / name)
        with zipfile.ZipFile(path, "w") as z:
            for m, text in members:
                z.writestr(m, text)
        return path

    good = packed("good.zip", ("a/b.tsv", "x"), ("c.fa", "y"))
    assert archives.extract_zip(good, str(tmp_path / "out")) == ["a/b.tsv", "c.fa"] and (tmp_path / "out/a/b.tsv").read_text() == "x"
    link = zipfile.ZipInfo("l")
    link.external_attr = 0o120777 << 16
    for i, bad in enumerate([("../x", "1"), ("/x", "1"), ("a/../../x", "1"), (link, "t"), ("C:\\x", "1")]):
        with pytest.raises(archives.UnsafeArchive):
            archives.extract_zip(packed(f"bad{i}.zip", ("fine", "1"), bad), str(tmp_path / f"bad{i}"))
        assert not (tmp_path / f"bad{i}").exists()
    with pytest.raises(archives.UnsafeArchive, match="large"):
        archives.extract_zip(good, str(tmp_path / "small"), 1)
    manifest = spark.createDataFrame([("t.tsv",), ("g.FA",), ("g.fai",)], "relpath string")
    assert [r.relpath for r in archives.delivered(manifest, False).collect()] == ["t.tsv"] and archives.delivered(manifest, True).count() == 3
    tables = {"c": spark.createDataFrame([("a", 1), ("b", 2)], "contig string, n int"), "other": manifest}
    got = archives.add_package(tables, {"c": "contig"}, spark.createDataFrame([("b",), ("b",)], "name string"), "name")
    assert [r.n for r in got["c"].collect()] == [2] and got["other"].count() == 3
