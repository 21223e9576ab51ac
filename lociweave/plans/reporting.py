"""Starting paths, reports, selections and lookups over the driver's tables. Each query has SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lociweave.operators import fragments, placement, reports, selection, starting_path, upkeep
from lociweave.plans.relational import SPANS, order_spans
from lociweave.plans.repairing import PLACED, placement_hits
from lociweave.runtime import table

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


COVERED = f"""{SPANS}, i AS (SELECT c_nationkey AS chr, c_custkey AS contig, s, e, count(*) OVER (PARTITION BY c_custkey) AS n, c_acctbal, c_custkey % 50 + 10 AS len FROM islands JOIN customer ON c_custkey = o_custkey),
held AS (SELECT a.chr, a.contig, b.contig AS other FROM i a JOIN i b ON a.chr = b.chr AND a.contig <> b.contig AND b.s <= a.s AND a.e <= b.e GROUP BY 1, 2, 3 HAVING count(DISTINCT a.s) = max(a.n)),
beaten AS (SELECT h.chr, h.contig, min(h.other) AS covered_by FROM held h JOIN customer x ON x.c_custkey = h.contig JOIN customer y ON y.c_custkey = h.other
  WHERE NOT EXISTS (SELECT 1 FROM held b WHERE b.contig = h.other AND b.other = h.contig) OR (-y.c_acctbal, y.c_custkey) < (-x.c_acctbal, x.c_custkey) GROUP BY 1, 2)"""


def contigs(spark, sf_dir):
    """Customers as contigs of their nation, better with more money, and their orders as hits."""
    money = F.col("c_acctbal")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("chr"), F.col("c_custkey").alias("contig"), F.struct(money.isNull().alias("none"), (-money).alias("less"), "c_custkey").alias("quality"), F.col("c_custkey").alias("stable"))
    return rows, order_spans(spark, sf_dir).select(F.col("o_custkey").alias("contig"), "start", "end")


@query(f"WITH {COVERED} SELECT chr, contig, covered_by FROM beaten")
def q51_redundant_contigs(spark, sf_dir):
    return starting_path.redundant(*contigs(spark, sf_dir), bin_size=40)


@query(f"""WITH {COVERED}, k AS (SELECT DISTINCT chr, contig, len, 'k' AS x FROM i WHERE contig NOT IN (SELECT contig FROM beaten)), p AS (SELECT *, row_number() OVER w AS k, sum(len) OVER w AS upto FROM k WINDOW w AS (PARTITION BY chr ORDER BY contig ROWS UNBOUNDED PRECEDING))
SELECT chr, k * 2 - 1 AS n, 'source' AS kind, contig, (upto + (k - 1) * 100 - len + 1)::BIGINT AS start, (upto + (k - 1) * 100)::BIGINT AS "end", CASE WHEN contig % 3 = 0 THEN '-' ELSE '+' END AS orientation FROM p UNION ALL
SELECT chr, k * 2 - 2, 'gap', NULL, (upto + (k - 1) * 100 - len - 99)::BIGINT, (upto + (k - 1) * 100 - len)::BIGINT, NULL FROM p WHERE k > 1""")
def q52_first_path(spark, sf_dir):
    kept = starting_path.footprint_covers(*contigs(spark, sf_dir), bin_size=40).filter("covered_by is null")
    k = F.col("contig")
    return starting_path.first_path(kept.select("chr", "contig", (k.cast("long") % 50 + 10).alias("length"), F.when(k % 3 == 0, "-").otherwise("+").alias("orientation"), k.alias("member_order"), F.lit(0).alias("anchor"), "stable"))


LOG = """s AS (SELECT o_orderpriority AS chr, o_custkey::VARCHAR AS identity, (o_orderkey % 1000)::BIGINT AS length, CASE o_orderstatus WHEN 'F' THEN 'primary' WHEN 'O' THEN 'support' ELSE 'gap' END AS kind, o_totalprice FROM orders),
p AS (SELECT DISTINCT chr, identity, identity::BIGINT % 500 + 100 AS length FROM s WHERE o_totalprice > 100000), h AS (SELECT DISTINCT chr, identity FROM s WHERE o_totalprice < 150000),
u AS (SELECT DISTINCT chr, identity FROM s WHERE kind = 'primary'), aside AS (SELECT p.* FROM p JOIN h USING (chr, identity) ANTI JOIN u USING (chr, identity)),
log AS (SELECT c.chr, (SELECT count(*) FROM p WHERE p.chr = c.chr) AS assigned, (SELECT coalesce(sum(length), 0) FROM p WHERE p.chr = c.chr)::BIGINT AS assigned_bp, (SELECT count(*) FROM u WHERE u.chr = c.chr) AS appended, (SELECT coalesce(sum(length), 0) FROM s WHERE s.chr = c.chr AND kind = 'primary')::BIGINT AS appended_bp,
  (SELECT count(*) FROM aside a WHERE a.chr = c.chr) AS hidden, (SELECT coalesce(sum(length), 0) FROM aside a WHERE a.chr = c.chr)::BIGINT AS hidden_bp, (SELECT count(*) FROM s WHERE s.chr = c.chr AND kind = 'support') AS support, (SELECT coalesce(sum(length), 0) FROM s WHERE s.chr = c.chr AND kind = 'support')::BIGINT AS support_bp,
  (SELECT count(*) FROM u WHERE u.chr = c.chr AND u.identity IN (SELECT identity FROM u o WHERE o.chr <> c.chr)) AS elsewhere FROM (SELECT DISTINCT chr FROM s) c)"""


def log_of(spark, sf_dir):
    price, who = F.col("o_totalprice"), F.col("o_custkey").cast("string").alias("identity")
    s = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("chr"), who, (F.col("o_orderkey").cast("long") % 1000).alias("length"), F.when(F.col("o_orderstatus") == "F", "primary").when(F.col("o_orderstatus") == "O", "support").otherwise("gap").alias("kind"), price)
    primaries = s.filter(price > 100000).select("chr", "identity", (F.col("identity").cast("long") % 500 + 100).alias("length")).distinct()
    return reports.usage_log(s, primaries, s.filter(price < 150000).select("chr", "identity").distinct())


@query(f"WITH {LOG} SELECT *, appended + hidden AS used, appended_bp + hidden_bp AS used_bp FROM log")
def q53_usage_log(spark, sf_dir):
    """Priorities as chromosomes, customers as contigs."""
    return log_of(spark, sf_dir).withColumn("elsewhere", F.size("elsewhere").cast("long"))


@query(f"""WITH {LOG}, t AS (SELECT sum(assigned)::BIGINT AS assigned, sum(assigned_bp)::BIGINT AS assigned_bp, sum(appended + hidden)::BIGINT AS used, sum(appended_bp + hidden_bp)::BIGINT AS used_bp FROM log), r AS (SELECT count(*) AS unassigned, sum(c_custkey % 500 + 100)::BIGINT AS unassigned_bp FROM customer WHERE c_acctbal < 0)
SELECT *, greatest(0, assigned - used) AS placed_not_used, greatest(0, assigned_bp - used_bp) AS placed_not_used_bp FROM t, r""")
def q54_project_statistics(spark, sf_dir):
    unplaced = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("identity"), (F.col("c_custkey").cast("long") % 500 + 100).alias("length"))
    return reports.project_statistics(log_of(spark, sf_dir), unplaced)


@query("""SELECT coalesce(l_suppkey, -1)::BIGINT AS contig, coalesce(l_returnflag, 'all') AS source, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS n_hidden, sum(l_quantity::BIGINT)::BIGINT AS bp, coalesce(sum(l_quantity::BIGINT) FILTER (l_discount > 0.05), 0)::BIGINT AS bp_hidden
FROM lineitem GROUP BY ROLLUP (l_suppkey, l_returnflag)""")
def q55_composition(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig"), F.col("l_returnflag").alias("source"), F.col("l_quantity").cast("long").alias("length"), (F.col("l_discount") > 0.05).alias("hidden"))
    return reports.composition(members).select(F.coalesce(F.col("contig").cast("long"), F.lit(-1)).alias("contig"), F.coalesce("source", F.lit("all")).alias("source"), "n", "n_hidden", "bp", "bp_hidden")


@query(f"""WITH {SPANS}, r AS (SELECT o_custkey AS contig, s - 7000 AS start, e - 7000 AS e, 1::BIGINT AS value FROM spans), i AS (SELECT o_custkey, s - 7000 AS s, e - 7000 AS e, lag(e - 7000) OVER (PARTITION BY o_custkey ORDER BY s) AS p FROM islands)
SELECT contig, start, e AS "end", value FROM r UNION ALL SELECT o_custkey, coalesce(p, 0) + 1, s - 1, 0 FROM i WHERE s > coalesce(p, 0) + 1 UNION ALL
SELECT c_custkey, coalesce(m, 0) + 1, 5000, 0 FROM customer LEFT JOIN (SELECT o_custkey, max(e) AS m FROM i GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(m, 0) < 5000""")
def q56_completed_rules(spark, sf_dir):
    rules = order_spans(spark, sf_dir).select(F.col("o_custkey").alias("contig"), (F.col("start") - 7000).alias("start"), (F.col("end") - 7000).alias("end"), F.lit(1).cast("long").alias("value"))
    return reports.completed_rules(rules, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contig"), F.lit(5000).cast("long").alias("length")))


PATH = """g AS (SELECT l_orderkey AS chr, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, CASE WHEN l_returnflag = 'R' THEN 'gap' ELSE 'source' END AS kind, CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS contig, l_quantity::BIGINT AS length FROM lineitem)"""


def path_segments(spark, sf_dir):
    """Line items of an order as segments; returned ones are gaps."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    gap = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chr"), F.row_number().over(order).alias("n"), F.when(gap, "gap").otherwise("source").alias("kind"), F.when(~gap, F.col("l_partkey")).alias("contig"), F.col("l_quantity").cast("long").alias("length"), F.when(~gap, F.lit("+")).alias("orientation"))


@query(f"""WITH {PATH}, q AS (SELECT *, sum((kind = 'gap')::INT) OVER (PARTITION BY chr ORDER BY n ROWS UNBOUNDED PRECEDING) AS piece FROM g), z AS (SELECT chr, piece, sum(length) >= 40 AS kept FROM q WHERE kind <> 'gap' GROUP BY 1, 2),
w AS (SELECT chr, bool_or(kept) AND NOT bool_and(kept) AS cut FROM z GROUP BY 1), m AS (SELECT q.*, z.kept, coalesce(w.cut, false) AS cut FROM q LEFT JOIN z USING (chr, piece) LEFT JOIN w USING (chr)),
stay AS (SELECT *, lag(piece) OVER (PARTITION BY chr ORDER BY n) <> piece AS new FROM m WHERE cut AND kept AND kind <> 'gap'),
a AS (SELECT chr, n * 2 AS n, kind, contig, length FROM m WHERE NOT cut UNION ALL SELECT chr, n * 2, kind, contig, length FROM stay UNION ALL SELECT chr, n * 2 - 1, 'gap', NULL, 100 FROM stay WHERE new)
SELECT chr, row_number() OVER (PARTITION BY chr ORDER BY n) AS n, kind, contig, length FROM a""")
def q57_short_pieces(spark, sf_dir):
    out = starting_path.without_short_pieces(path_segments(spark, sf_dir), 40)
    return out.select("chr", F.col("n").cast("long").alias("n"), "kind", "contig", "length")


@query(f"""WITH {PATH} SELECT chr, n, left_contig, right_contig FROM (SELECT *, last_value(contig IGNORE NULLS) OVER (PARTITION BY chr ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_contig,
first_value(contig IGNORE NULLS) OVER (PARTITION BY chr ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS right_contig FROM g) WHERE kind = 'gap'""")
def q58_around_gaps(spark, sf_dir):
    return selection.around_gaps(path_segments(spark, sf_dir)).withColumn("n", F.col("n").cast("long"))


@query(r"""SELECT doc_id FROM documents WHERE len(list_intersect(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), ['license', 'the', 'und'])) > 0""")
def q59_token_match(spark, sf_dir):
    return selection.with_tokens(table(spark, sf_dir, "documents"), "text", "License, THE und").select("doc_id")


@query("""SELECT c_custkey AS source, c_mktsegment AS chr, CASE WHEN n IS NULL THEN 'unplaced' WHEN here THEN 'assigned' ELSE 'cross_chr' END AS class, CASE WHEN here THEN 'auto' ELSE 'manual' END AS mode,
c_custkey || ':' || c_mktsegment || ':' || CASE WHEN n IS NULL THEN 'unplaced' WHEN here THEN 'normal' ELSE 'cross_chr' END AS card
FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey) FILTER (o_totalprice > 150000) AS k, CASE WHEN count(o_orderkey) FILTER (o_totalprice > 150000) > 0 THEN 1 END AS n, coalesce(bool_or(o_totalprice > 150000 AND (CASE WHEN o_orderpriority < '3' THEN 'BUILDING' ELSE 'MACHINERY' END) = c_mktsegment), false) AS here FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)""")
def q60_assignment_class(spark, sf_dir):
    placed = table(spark, sf_dir, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("source"), F.when(F.col("o_orderpriority") < "3", "BUILDING").otherwise("MACHINERY").alias("chr"))
    return selection.assignment_class(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.col("c_mktsegment").alias("chr")), placed)


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 97, 'ctg' || (p_partkey % 97) || '-' || p_partkey) AS place FROM part""")
def q61_natural_order(spark, sf_dir):
    """Parts under names with numbers, numbered in natural order within their brand."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.lit("ctg"), (F.col("p_partkey") % 97).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("name"))
    return rows.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(*selection.natural(F.col("name")))).cast("long").alias("place"))


@query("""SELECT s_suppkey, CASE WHEN keep THEN '' WHEN s_suppkey % 4 <> 0 THEN 'not_primary_dataset' WHEN s_suppkey % 3 = 1 THEN 'invalid_sequence' WHEN NOT (len >= 100000 OR s_acctbal >= 3000) THEN 'failed_reads_qc' ELSE 'unassigned' END AS path_reason,
CASE WHEN s_suppkey % 3 = 1 THEN 'invalid_sequence' WHEN len < 1000 THEN 'length_lt_1000' WHEN NOT (len >= 100000 OR s_acctbal >= 3000) THEN 'failed_reads_qc' WHEN keep THEN 'same_source_interval_used_by_q0' ELSE '' END AS donor_reason, CASE WHEN s_suppkey % 3 = 1 THEN 'invalid_sequence' WHEN s_suppkey % 5 <> 0 THEN 'no_reliable_telomere_repeat' ELSE '' END AS telomere_reason
FROM (SELECT *, s_suppkey * 3701 % 150000 AS len, s_suppkey % 16 = 0 AND s_suppkey % 3 <> 1 AND (s_suppkey * 3701 % 150000 >= 100000 OR s_acctbal >= 3000) AS keep FROM supplier)""")
def q62_contig_roles(spark, sf_dir):
    k = F.col("s_suppkey").cast("long")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 4 == 0).alias("is_primary"), (k % 3 != 1).alias("valid"), (k * 3701 % 150000).alias("length"), (k % 5 == 0).alias("telomere"), F.lit(None).cast("string").alias("covered_by"), (k % 16 == 0).alias("assigned"), "s_acctbal")
    rows = rows.withColumn("passed", starting_path.passes_reads_check(F.col("length"), F.col("s_acctbal") / 100))
    return starting_path.roles(rows.withColumn("used", F.expr("assigned and valid and passed"))).select("s_suppkey", "path_reason", "donor_reason", "telomere_reason")


@query(f"""WITH {SPANS}, b AS (SELECT c_custkey AS contig, 1::BIGINT AS start FROM customer UNION SELECT o_custkey, s - 7000 FROM spans WHERE s - 7000 BETWEEN 1 AND 3000)
SELECT contig, start, coalesce(lead(start) OVER (PARTITION BY contig ORDER BY start) - 1, 3000) AS "end" FROM b""")
def q63_cut_fragments(spark, sf_dir):
    whole = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contig"), F.lit(3000).cast("long").alias("length"))
    return fragments.at_cuts(whole, order_spans(spark, sf_dir).select(F.col("o_custkey").alias("contig"), (F.col("start") - 7000).alias("cut")))


TEXTS = """t AS (SELECT doc_id, upper(replace(text, 'ß', 's')) AS t FROM documents)"""


def capital_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id"), F.upper(F.replace("text", F.lit("ß"), F.lit("s"))).alias("sequence"))  # its capital is two letters in one engine only


@query(f"""WITH {TEXTS}, m AS (SELECT doc_id, 'a' AS rule, 2 AS unit, unnest(regexp_extract_all(t, '(?:AN){{2,}}')) AS x FROM t UNION ALL SELECT doc_id, 'b', 3, unnest(regexp_extract_all(t, '(?:ING){{1,}}')) FROM t)
SELECT doc_id, count(*) AS n, sum(length(x))::BIGINT AS bp, max(length(x))::BIGINT AS longest, arg_min(rule, (-length(x), -(length(x) // unit), rule)) AS rule FROM m GROUP BY 1""")
def q64_tandem_rules(spark, sf_dir):
    found = fragments.tandem_table(capital_texts(spark, sf_dir).withColumnRenamed("doc_id", "name"), [("a", "AN", 2), ("b", "ING", 1)])
    first = F.max(F.when(F.col("rank") == 1, F.col("rule")))
    return found.groupBy(F.col("name").alias("doc_id")).agg(F.count("*").alias("n"), F.sum("length").cast("long").alias("bp"), F.max("length").cast("long").alias("longest"), first.alias("rule"))


@query(f"""WITH {TEXTS}, p AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[AEIOU]{{2,}}'), lambda x: x <> '') AS x FROM t)
SELECT doc_id, sha256(x[i]) AS sha256, length(x[i])::BIGINT AS length, i = 1 AND NOT regexp_matches(t, '^[AEIOU]{{2,}}') AS left_boundary, i = len(x) AND NOT regexp_matches(t, '[AEIOU]{{2,}}$') AS right_boundary FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM p)""")
def q65_donor_fragments(spark, sf_dir):
    out = fragments.donor_fragments(capital_texts(spark, sf_dir).withColumnRenamed("doc_id", "member"), "d0", "[AEIOU]", 2)
    return out.select(F.col("member").alias("doc_id"), "sha256", (F.col("end") - F.col("start") + 1).alias("length"), "left_boundary", "right_boundary")


@query("""WITH p AS (SELECT l_orderkey AS o, l_linenumber, l_partkey::BIGINT AS contig, l_suppkey::BIGINT * 10 AS s, l_suppkey::BIGINT * 10 + l_quantity::BIGINT AS e, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, l_linenumber::BIGINT * 1000 AS place FROM lineitem),
m AS (SELECT DISTINCT l_partkey::BIGINT AS contig, 'mark' AS kind, l_suppkey::BIGINT * 10 + 5 AS s, l_suppkey::BIGINT * 10 + 25 AS e FROM lineitem)
SELECT p.o AS chr, p.contig, kind, place + CASE WHEN strand = '-' THEN p.e - least(m.e, p.e) ELSE greatest(m.s, p.s) - p.s END AS start, place + CASE WHEN strand = '-' THEN p.e - greatest(m.s, p.s) ELSE least(m.e, p.e) - p.s END AS "end" FROM p JOIN m ON m.contig = p.contig AND m.s <= p.e AND m.e >= p.s""")
def q66_placed_marks(spark, sf_dir):
    """Parts as contigs, their line items as the pieces that orders show."""
    k, s = F.col("l_partkey").cast("long").alias("contig"), F.col("l_suppkey").cast("long") * 10
    items = table(spark, sf_dir, "lineitem")
    layout = items.select(k, s.alias("piece_start"), (s + F.col("l_quantity").cast("long")).alias("piece_end"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("orientation"), F.col("l_orderkey").alias("chr"), (F.col("l_linenumber").cast("long") * 1000).alias("position"))
    marks = items.select(k, F.lit("mark").alias("kind"), (s + 5).alias("start"), (s + 25).alias("end")).distinct()
    return fragments.placed_marks(marks, layout, 50)


@query(f"""WITH {PLACED}, w2 AS (SELECT q, sum(x)::BIGINT AS bp FROM (SELECT q, max(qe) - min(qs) + 1 AS x FROM r2 WHERE t = 'chr2' GROUP BY q, n) GROUP BY 1),
o AS (SELECT q, CASE WHEN sum(CASE WHEN strand = '-' THEN block ELSE 0 END) > sum(CASE WHEN strand = '+' THEN block ELSE 0 END) THEN '-' ELSE '+' END AS orientation FROM k WHERE t = 'chr2' GROUP BY 1)
SELECT w2.q AS query, 'chr2' AS target, bp AS support_bp, bp * 100.0::DOUBLE / 120 AS support_percent, orientation, anchor FROM w2 JOIN o USING (q) JOIN anchors ON anchors.q = w2.q AND anchors.t = 'chr2'""")
def q67_forced_assignment(spark, sf_dir):
    """Every customer with a good hit on one given chromosome, whatever it covers."""
    return placement.forced(placement_hits(spark, sf_dir), "chr2", 20, 25)


@query("""WITH i AS (SELECT l_orderkey AS contig, CASE WHEN l_tax = 0 THEN ' ' ELSE CASE WHEN l_discount >= 0.09 THEN '--' WHEN l_returnflag = 'R' THEN '-' ELSE '' END || '(' || l_partkey || ')' END AS item, l_partkey::VARCHAR AS seq FROM lineitem), m AS (SELECT * FROM i WHERE item <> ' '), n AS (SELECT seq, count(*) AS n FROM m GROUP BY 1)
SELECT 'empty_contig' AS code, o_orderkey::VARCHAR AS key, 1 AS n FROM orders WHERE o_orderkey NOT IN (SELECT contig FROM i) UNION ALL SELECT 'null_member', contig::VARCHAR, count(*) FROM i WHERE item = ' ' GROUP BY contig UNION ALL
SELECT 'malformed_member', contig::VARCHAR, count(*) FROM m WHERE starts_with(item, '--') GROUP BY contig UNION ALL SELECT 'repeated_member', seq, n FROM n WHERE n > 1 UNION ALL
SELECT 'member_without_sequence', seq, n FROM n WHERE seq NOT IN (SELECT p_partkey::VARCHAR FROM part WHERE p_partkey % 20 IN (SELECT s_suppkey FROM supplier)) UNION ALL SELECT 'unused_sequence', p_partkey::VARCHAR, 1 FROM part WHERE p_partkey::VARCHAR NOT IN (SELECT seq FROM n)""")
def q68_integrity(spark, sf_dir):
    """Orders as contigs whose member lists hold parts."""
    items = table(spark, sf_dir, "lineitem")
    sign = F.when(F.col("l_discount") >= 0.09, "--").when(F.col("l_returnflag") == "R", "-").otherwise("")
    item = F.when(F.col("l_tax") == 0, " ").otherwise(F.concat(sign, F.lit("("), F.col("l_partkey").cast("string"), F.lit(")")))
    cells = items.groupBy(F.col("l_orderkey").alias("contig")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("item")))).getField("item"), ",").alias("cell"))
    contigs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contig")).join(cells, "contig", "left")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 20).alias("source"))
    return upkeep.integrity(contigs, parts, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("source")))
