"""Operators over the driver's tables: intervals, medians, ordering, pairs, reports. Each query has SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lociweave.functions import coordinates, nested, sequence
from lociweave.operators import aggregates, greedy, intervals, inventory, ordering, placement, prefix, validation
from lociweave.runtime import table
from lociweave.sources import alignments
from lociweave.sources.sinks import agp_lines

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def order_spans(spark, sf_dir):
    """Each order as a closed interval of days of its customer."""
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("start"), (day + 1 + F.col("o_orderkey") % 60).alias("end"))


SPANS = """spans AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS s,
  date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT + 1 + o_orderkey % 60 AS e FROM orders),
reach AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans),
marked AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey) AS island FROM reach),
islands AS (SELECT o_custkey, island, min(s) AS s, max(e) AS e FROM marked GROUP BY ALL)"""


@query(f"""WITH {SPANS} SELECT o_custkey, sum(e - s + 1)::BIGINT AS covered_days, max(e) - min(s) + 1 AS span_days,
sum(e - s + 1)::BIGINT * 100.0::DOUBLE / (max(e) - min(s) + 1) AS support_percent FROM islands GROUP BY 1
HAVING sum(e - s + 1) * 100 >= 60 * (max(e) - min(s) + 1)""")
def q01_interval_coverage(spark, sf_dir):
    merged = intervals.islands(order_spans(spark, sf_dir), ["o_custkey"])
    sums = merged.groupBy("o_custkey").agg(F.sum(F.expr("end - start + 1")).alias("covered_days"), (F.max("end") - F.min("start") + 1).alias("span_days"))
    return sums.withColumn("support_percent", F.col("covered_days") * F.lit(100.0) / F.col("span_days")).filter("covered_days * 100 >= 60 * span_days")


@query("""WITH p AS (SELECT l_suppkey, l_partkey, sum(l_quantity::BIGINT) AS w FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS c, sum(w) OVER (PARTITION BY l_suppkey) AS t FROM p)
SELECT l_suppkey, min(l_partkey) AS median FROM r WHERE c >= t // 2 + 1 GROUP BY 1""")
def q02_weighted_median(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("w"))
    return aggregates.weighted_median(rows, ["l_suppkey"], "l_partkey", "w")


@query("""SELECT l_partkey, CASE WHEN sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) > sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END)
THEN '-' ELSE '+' END AS orientation FROM lineitem GROUP BY 1""")
def q03_majority_strand(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"), F.col("l_quantity").cast("long").alias("w"))
    return rows.groupBy("l_partkey").agg(aggregates.majority_strand(F.col("strand"), F.col("w")).alias("orientation"))


def part_hits(spark, sf_dir):
    """Line items as alignments of parts (queries) to supplier nations (targets)."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.lit(20) * F.col("p_size")).cast("long").alias("query_length"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target"))
    block = (F.col("l_quantity") * 2).cast("long")
    rows = items.join(parts, "l_partkey").join(suppliers, "l_suppkey").withColumn("block", block)
    rows = rows.withColumn("query_start", F.col("l_orderkey") % F.greatest(F.col("query_length") - F.col("block"), F.lit(1)) + 1)
    return rows.select(F.col("l_partkey").alias("query"), "query_length", "target", "query_start", F.least("query_length", F.expr("query_start + block - 1")).alias("query_end"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 100000 + 1).alias("ref_start"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"), "block")


@query("""WITH h0 AS (SELECT l_partkey AS q, 20 * p_size::BIGINT AS len, s_nationkey AS t, l_orderkey, l_linenumber, (l_quantity * 2)::BIGINT AS block,
  CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
h1 AS (SELECT *, l_orderkey % greatest(len - block, 1) + 1 AS qs, (l_orderkey * 7 + l_linenumber) % 100000 + 1 AS rs FROM h0),
h AS (SELECT *, least(len, qs + block - 1) AS qe, row_number() OVER () AS id FROM h1 WHERE block >= 80 OR block * 100 >= 5 * len),
reach AS (SELECT *, max(qe) OVER (PARTITION BY q, t ORDER BY qs, qe, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM h),
marked AS (SELECT *, sum(CASE WHEN r IS NULL OR qs > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY q, t ORDER BY qs, qe, id) AS island FROM reach),
support AS (SELECT q, t, sum(n)::BIGINT AS bp FROM (SELECT q, t, max(qe) - min(qs) + 1 AS n FROM marked GROUP BY q, t, island) GROUP BY 1, 2),
votes AS (SELECT q, t, max(len) AS len, CASE WHEN sum(CASE WHEN strand = '-' THEN block ELSE 0 END) > sum(CASE WHEN strand = '+' THEN block ELSE 0 END) THEN '-' ELSE '+' END AS orientation FROM h GROUP BY 1, 2),
a AS (SELECT q, t, CASE WHEN strand = '-' THEN rs - len + qe ELSE rs - qs + 1 END AS pos, sum(block) AS w FROM h GROUP BY 1, 2, 3),
c AS (SELECT *, sum(w) OVER (PARTITION BY q, t ORDER BY pos) AS run, sum(w) OVER (PARTITION BY q, t) AS total FROM a),
anchors AS (SELECT q, t, min(pos) AS anchor FROM c WHERE run >= total // 2 + 1 GROUP BY 1, 2)
SELECT q AS query, t AS target, bp AS support_bp, bp * 100.0::DOUBLE / len AS support_percent, orientation, anchor,
  row_number() OVER (PARTITION BY t ORDER BY anchor, q) AS member_order
FROM support JOIN votes USING (q, t) JOIN anchors USING (q, t) WHERE bp * 100.0::DOUBLE / len >= 10""")
def q04_assignment_flagship(spark, sf_dir):
    return placement.assign(part_hits(spark, sf_dir), least_percent=10.0, least_block=80, least_block_percent=5)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) AS member_order FROM orders")
def q05_chr_renumber(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ordering.numbered(rows, ["o_custkey"], [F.col("o_orderdate").asc_nulls_last(), "o_orderkey"], "member_order").drop("o_orderdate")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
ORDER BY l_extendedprice DESC, l_quantity DESC, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def q06_best_hit_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return ordering.best_struct(rows, ["l_orderkey"], [-F.col("l_extendedprice"), -F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")], ["l_partkey", "l_linenumber", "l_extendedprice"])


@query("""WITH e AS (SELECT * FROM events WHERE event_type = 'error'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
b AS (SELECT e.event_id, p.event_id AS pid, row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC, p.event_id DESC) AS n FROM e JOIN p ON e.user_id = p.user_id AND (p.ts, p.event_id) < (e.ts, e.event_id)),
a AS (SELECT e.event_id, p.event_id AS pid, row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts, p.event_id) AS n FROM e JOIN p ON e.user_id = p.user_id AND (p.ts, p.event_id) > (e.ts, e.event_id))
SELECT e.event_id, e.user_id, b1.pid AS before_1, b2.pid AS before_2, a1.pid AS after_1, a2.pid AS after_2 FROM e
LEFT JOIN b b1 ON b1.event_id = e.event_id AND b1.n = 1 LEFT JOIN b b2 ON b2.event_id = e.event_id AND b2.n = 2
LEFT JOIN a a1 ON a1.event_id = e.event_id AND a1.n = 1 LEFT JOIN a a2 ON a2.event_id = e.event_id AND a2.n = 2""")
def q07_top2_flanking(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type").filter(F.col("event_type").isin("error", "purchase"))
    out = ordering.flanking(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase", F.col("event_type") == "error", "event_id")
    return out.drop("ts", "event_type")


@query("""WITH p AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 * (1 + event_id % 3) AS e, event_id FROM events WHERE event_type = 'purchase'),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM p),
m AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS i FROM r),
islands AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM m GROUP BY user_id, i)
SELECT ev.event_id, ev.user_id, i.s AS island_start, i.n AS island_size FROM events ev JOIN islands i ON ev.user_id = i.user_id AND epoch_us(ev.ts) BETWEEN i.s AND i.e""")
def q08_stab_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("at").alias("start"), (F.col("at") + F.lit(3600000000) * (1 + F.col("event_id") % 3)).alias("end"))
    spans = intervals.islands(bought, ["user_id"]).select("user_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "n_merged")
    return intervals.stab(events.select("event_id", "user_id", "at"), spans, ["user_id"], "at", 6 * 3600 * 10**6).select("event_id", "user_id", F.col("r_start").alias("island_start"), F.col("n_merged").alias("island_size"))


@query(f"""WITH {SPANS} SELECT o_custkey, o_orderkey FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE a.o_custkey = b.o_custkey
AND a.o_orderkey <> b.o_orderkey AND a.s <= b.e AND b.s <= a.e)""")
def q09_overlap_antijoin(spark, sf_dir):
    return intervals.lonely(order_spans(spark, sf_dir), ["o_custkey"]).select("o_custkey", "o_orderkey")


@query(f"""WITH {SPANS}, l AS (SELECT *, lag(e) OVER (PARTITION BY o_custkey ORDER BY s) AS p FROM islands)
SELECT o_custkey, p + 1 AS start, s - 1 AS "end" FROM l WHERE s > p + 1""")
def q10_complement_gaps(spark, sf_dir):
    return intervals.gaps(intervals.islands(order_spans(spark, sf_dir), ["o_custkey"]), ["o_custkey"])


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN max(o_orderpriority) END AS priority, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS status FROM orders GROUP BY 1")
def q11_single_or_null(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(aggregates.one_or_null(F.col("o_orderpriority")).alias("priority"), aggregates.one_or_null(F.col("o_orderstatus")).alias("status"))


@query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders,
sum(CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 100)::BIGINT ELSE 0 END)::BIGINT AS finished_cents,
sum(CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice * 100)::BIGINT ELSE 0 END)::BIGINT AS open_cents,
coalesce(sum(round(o_totalprice * 100)::BIGINT), 0)::BIGINT AS all_cents
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def q12_conditional_sums(spark, sf_dir):
    """Orders are summed per customer before the joins, so the joins and the distinct count are over customers."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    when = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, cents).otherwise(0))
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"), when("F").alias("f"), when("O").alias("o"), F.sum(cents).alias("a"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(per, "c_custkey", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(customers, "n_nationkey", "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"), zero("n").alias("orders"), zero("f").alias("finished_cents"), zero("o").alias("open_cents"), zero("a").alias("all_cents"))


@query("""WITH r AS (SELECT lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS run, sum(n_chars) OVER (PARTITION BY lang) AS total FROM documents)
SELECT lang, count(*) AS n, max(total)::BIGINT AS total, max(n_chars) AS longest, median(n_chars)::DOUBLE AS median, max(n_chars) FILTER (run * 2 > total) AS n50 FROM r GROUP BY 1""")
def q13_n50_stats(spark, sf_dir):
    return aggregates.assembly_statistics(table(spark, sf_dir, "documents").select("lang", "n_chars"), ["lang"], "n_chars")


@query("""SELECT coalesce(event_type, 'total') AS event_type, coalesce(plate, -1)::BIGINT AS plate, count(*) AS n, count(*) FILTER (value > 10) AS large,
(count(*) FILTER (value > 10) * 100) // count(*) AS percent FROM (SELECT *, user_id % 10 AS plate FROM events) GROUP BY ROLLUP (event_type, plate)""")
def q14_progress_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("plate"), (F.col("value") > 10).alias("sequenced"))
    out = inventory.progress(rows, "event_type")
    return out.select(F.coalesce("event_type", F.lit("total")).alias("event_type"), F.coalesce(F.col("plate").cast("long"), F.lit(-1)).alias("plate"), F.col("clones").alias("n"), F.col("sequenced").alias("large"), "percent")


@query("""WITH p AS (SELECT c_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT a AS query_nation, b AS ref_nation, n FROM p UNION ALL SELECT b, a, n FROM p""")
def q15_pairwise_both_dirs(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").groupBy("l_orderkey", "l_suppkey").count()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("b"))
    pairs = items.join(suppliers, "l_suppkey").join(orders.join(customers, "c_custkey"), "l_orderkey").groupBy("a", "b").agg(F.sum("count").alias("n"))
    return alignments.both_directions(pairs.select(F.col("a").alias("query_nation"), F.col("b").alias("ref_nation"), "n"))


@query("""SELECT doc_id, 'left_only' AS side FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) UNION ALL
SELECT doc_id, 'right_only' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def q16_set_reconcile(spark, sf_dir):
    return aggregates.uncovered_keys(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")


@query("""SELECT p_partkey, CASE WHEN min(p_brand) OVER (PARTITION BY p_name) <> max(p_brand) OVER (PARTITION BY p_name) THEN p_name || '@' || p_brand ELSE p_name END AS display_name FROM part""")
def q17_dup_disambiguate(spark, sf_dir):
    return ordering.disambiguated(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_name", "p_brand").select("p_partkey", "display_name")


@query("""SELECT (json_extract(props, '$.k')::INT // 10)::INT AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def q18_json_notes(spark, sf_dir):
    rows = nested.note_entries(table(spark, sf_dir, "events").select("event_type", "props"), "props").filter("key = 'k'")
    return rows.groupBy(F.expr("cast(cast(value as int) div 10 as int)").alias("bucket"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS position,
l_partkey::VARCHAR AS member, l_returnflag = 'R' AS hidden FROM lineitem""")
def q19_membership_explode(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    cells = nested.member_cell(items, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")], F.col("l_partkey").cast("string"), F.col("l_returnflag") == "R")
    return nested.members(cells, "cell").select("l_orderkey", F.col("position").cast("long").alias("position"), "member", "hidden")


@query(f"""WITH {SPANS}, l AS (SELECT *, s - lag(e) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) - 1 AS d FROM spans)
SELECT o_custkey, o_orderkey, CASE WHEN d IS NULL THEN 'first' WHEN d < 0 THEN 'overlap' WHEN d = 0 THEN 'adjacent' ELSE 'gap' END AS relation, coalesce(abs(d), 0) AS bp,
CASE WHEN d IS NULL THEN 'unknown' WHEN d < 0 THEN 'overlap' WHEN d = 0 THEN 'adjacent' ELSE 'gap' END AS placed FROM l""")
def q20_adjacent_classify(spark, sf_dir):
    spans = order_spans(spark, sf_dir)
    relation, _ = coordinates.placement(F.lag("end").over(Window.partitionBy("o_custkey").orderBy("start", "o_orderkey")), F.col("start"))
    return ordering.neighbour_classes(spans.withColumn("placed", relation), ["o_custkey"], ["start", "o_orderkey"]).select("o_custkey", "o_orderkey", "relation", "bp", "placed")


ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (e - q + 1)::BIGINT AS start, e::BIGINT AS "end" FROM (SELECT *, l_quantity::BIGINT AS q,
sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS e FROM lineitem)""")
def q21_running_positions(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *ITEM_ORDER).withColumn("length", F.col("l_quantity").cast("long"))
    return ordering.running_positions(items, ["l_orderkey"], ITEM_ORDER, "length").select("l_orderkey", "l_linenumber", "l_partkey", "start", "end")


@query("""WITH o AS (SELECT user_id, event_id, ts, 1 + event_id % 5 AS n, CASE event_type WHEN 'click' THEN 'I' WHEN 'error' THEN 'D' WHEN 'signup' THEN 'X' ELSE 'M' END AS op FROM events)
SELECT event_id, sum(CASE WHEN op IN ('M', 'X', 'I') THEN n ELSE 0 END) OVER w AS query_pos, sum(CASE WHEN op IN ('M', 'X', 'D') THEN n ELSE 0 END) OVER w AS ref_pos
FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def q22_cigar_walk(spark, sf_dir):
    op = F.when(F.col("event_type") == "click", "I").when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "X").otherwise("M")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (1 + F.col("event_id") % 5).alias("length"), op.alias("op"))
    return ordering.cigar_walk(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "query_pos", "ref_pos")


@query(f"""WITH RECURSIVE {SPANS}, walk(c, k, reach, step) AS (
  SELECT o_custkey, arg_min(o_orderkey, (s, -e, o_orderkey)), arg_min(e, (s, -e, o_orderkey)), 1 FROM spans GROUP BY 1
  UNION ALL
  SELECT w.c, n.k, n.e, w.step + 1 FROM walk w, LATERAL (
    SELECT o_orderkey AS k, e FROM spans WHERE o_custkey = w.c AND e > w.reach
    ORDER BY s > w.reach, CASE WHEN s <= w.reach THEN -e ELSE s END, CASE WHEN s <= w.reach THEN s ELSE -e END, o_orderkey LIMIT 1) n)
SELECT c AS o_custkey, k AS o_orderkey, step FROM walk""")
def q23_tiling_path(spark, sf_dir):
    return greedy.tiling_path(order_spans(spark, sf_dir), "o_custkey", "o_orderkey")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_quantity, l_tax FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
CASE WHEN l_discount >= 0.08 AND l_tax <= 0.02 THEN 'type1' WHEN l_discount >= 0.08 THEN 'type2' WHEN l_quantity < 5 THEN 'type3' WHEN l_tax > 0.06 THEN 'type4' WHEN l_quantity > 45 THEN 'type5' ELSE 'type6' END AS error_type,
CASE WHEN l_quantity / 50 >= 0.7 THEN 'high' WHEN l_quantity / 50 >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM f""")
def q25_decision_tables(spark, sf_dir):
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    kind = F.when((d >= 0.08) & (t <= 0.02), "type1").when(d >= 0.08, "type2").when(q < 5, "type3").when(t > 0.06, "type4").when(q > 45, "type5").otherwise("type6")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("error_type"), coordinates.confidence(q / 50).alias("confidence"))


@query("""WITH i AS (SELECT user_id, event_type, event_id, greatest(epoch_us(ts), 1704067200000000 + 432000000000) AS s,
  least(epoch_us(ts) + 7200000000 * (1 + event_id % 4), 1704067200000000 + 1728000000000) AS e FROM events),
c AS (SELECT * FROM i WHERE s <= e),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c),
m AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY s, e, event_id) AS k FROM r),
v AS (SELECT user_id, event_type, sum(n)::BIGINT AS covered FROM (SELECT user_id, event_type, max(e) - min(s) + 1 AS n FROM m GROUP BY user_id, event_type, k) GROUP BY 1, 2)
SELECT user_id, event_type, covered FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY covered DESC, event_type DESC) AS n FROM v) WHERE n = 1""")
def q26_coverage_rules(spark, sf_dir):
    """The event type that covers most of each user's time between day 5 and day 20; ties to the larger name."""
    at, base = F.unix_micros(F.col("ts").cast("timestamp")), 1704067200000000
    s, e, some = intervals.clip(at, at + F.lit(7200000000) * (1 + F.col("event_id") % 4), F.lit(base + 432000000000), F.lit(base + 1728000000000))
    rows = table(spark, sf_dir, "events").filter(some).select("user_id", "event_type", s.alias("start"), e.alias("end"))
    per_rule = intervals.covered(rows, ["user_id", "event_type"])
    return per_rule.groupBy("user_id").agg(F.max(F.struct("covered", "event_type")).alias("b")).select("user_id", "b.event_type", "b.covered")


CALLS = """calls AS (SELECT s_nationkey AS taxon, l_partkey AS marker, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) ELSE 'NN' END AS call
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


def genotype_calls(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("taxon"))
    rows = items.join(suppliers, "l_suppkey").groupBy("taxon", F.col("l_partkey").alias("marker"))
    return rows.agg(F.coalesce(aggregates.one_or_null(F.col("l_returnflag")), F.lit("NN")).alias("call"))


@query(f"""WITH {CALLS} SELECT a.taxon AS a, b.taxon AS b, count(*) AS markers, sum((a.call <> b.call OR a.call = 'NN' OR b.call = 'NN')::INT)::BIGINT AS mismatches,
sum((a.call <> b.call OR a.call = 'NN' OR b.call = 'NN')::INT)::DOUBLE / count(*) AS distance FROM calls a JOIN calls b ON a.marker = b.marker AND a.taxon < b.taxon GROUP BY 1, 2""")
def q27_genotype_distance(spark, sf_dir):
    """Nations as genotypes (25 at any scale), parts as markers."""
    return aggregates.genotype_distance(genotype_calls(spark, sf_dir), "taxon", "marker", "call")


@query(f"""WITH {CALLS}, g AS (SELECT marker, min(call) FILTER (taxon < 3) AS a, max(call) FILTER (taxon < 3) AS b, min(call) FILTER (taxon >= 22) AS c, max(call) FILTER (taxon >= 22) AS d FROM calls GROUP BY 1)
SELECT marker, a AS first_call, c AS second_call FROM g WHERE a = b AND c = d AND a <> c AND a <> 'NN' AND c <> 'NN'""")
def q28_group_contrast(spark, sf_dir):
    return aggregates.group_contrast(genotype_calls(spark, sf_dir), "marker", "call", F.col("taxon") < 3, F.col("taxon") >= 22)


@query("""WITH u AS (SELECT doc_id, 1 AS labelled, 0 AS long, 0 AS talked FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 0, 1, 0 FROM documents WHERE n_chars >= 2000
UNION ALL SELECT conv_id, 0, 0, 1 FROM conversations) SELECT doc_id, max(labelled) AS labelled, max(long) AS long, max(talked) AS talked, max(labelled) + max(long) + max(talked) AS score
FROM u GROUP BY 1 HAVING max(labelled) + max(long) + max(talked) >= 2""")
def q29_evidence_score(spark, sf_dir):
    sets = {
        "labelled": table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"),
        "long": table(spark, sf_dir, "documents").filter("n_chars >= 2000").select("doc_id"),
        "talked": table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")),
    }
    return aggregates.evidence_score(sets, "doc_id").filter("score >= 2")


@query("""WITH p AS (SELECT DISTINCT substr(p_name, 1, 3 + p_partkey::INT % 5) AS prefix FROM part)
SELECT p_partkey, (SELECT arg_max(prefix, length(prefix)) FROM p WHERE starts_with(p_name, prefix)) AS prefix FROM part""")
def q30_longest_prefix(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    prefixes = parts.select(F.expr("substring(p_name, 1, 3 + cast(p_partkey as int) % 5)").alias("prefix"))
    return prefix.longest_prefix(parts, "p_name", prefixes).select("p_partkey", "prefix")


@query("""SELECT conv_id, count(*) AS pieces, sum(length(coalesce(text, '')))::BIGINT AS length, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text)) AS sha256,
'piece-' || substr(sha256('{"conv":' || conv_id || ',"pieces":' || count(*) || '}'), 1, 24) AS stable_id FROM conversations GROUP BY 1""")
def q31_hash_verify(spark, sf_dir):
    """Texts reconstructed from ordered pieces, verified by length and digest."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("p")).select("conv_id", F.size("p").cast("long").alias("pieces"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("t"))
    return parts.select("conv_id", "pieces", F.length("t").cast("long").alias("length"), F.sha2("t", 256).alias("sha256"), sequence.stable_id("piece", F.to_json(F.struct(F.col("conv_id").alias("conv"), "pieces")), 24).alias("stable_id"))


@query("""WITH d AS (SELECT doc_id, upper(replace(text, 'ß', 's')) AS t FROM documents)
SELECT doc_id, sha256(reverse(translate(t, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN'))) AS reversed, length(t) - length(replace(t, 'N', '')) AS n_count,
len(regexp_extract_all(t, '[AEIOU]{2,}')) AS n_runs, len(list_filter(regexp_split_to_array(t, '[AEIOU]{2,}'), lambda x: x <> '')) AS n_segments FROM d""")
def q32_revcomp_nsplit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.replace("text", F.lit("ß"), F.lit("s"))).alias("t"))  # its capital is two letters in one engine only
    upper = F.col("t")
    n_count = F.length("t") - F.length(F.replace(upper, F.lit("N")))
    return rows.select("doc_id", F.sha2(sequence.reverse_complement(upper), 256).alias("reversed"), n_count.cast("long").alias("n_count"), F.size(F.regexp_extract_all(upper, F.lit("([AEIOU]{2,})"))).cast("long").alias("n_runs"), F.size(F.filter(F.split(upper, "[AEIOU]{2,}"), lambda x: x != "")).cast("long").alias("n_segments"))


@query("""SELECT 'BROKEN_REFERENCE' AS code, 'lineitem.tsv' AS relpath, key::VARCHAR AS key, 'not in o_orderkey' AS message FROM (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL
SELECT 'BROKEN_REFERENCE', 'documents.tsv', key::VARCHAR, 'not in doc_id' FROM (SELECT DISTINCT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL
SELECT 'INVALID_VALUE', 'lineitem.tsv', l_orderkey || '/' || l_linenumber, 'repeated' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL
SELECT 'INVALID_COORDINATE', 'lineitem.tsv', l_orderkey || '/' || l_linenumber || '/' || l_partkey, 'start..end' FROM lineitem WHERE l_linenumber * 10 + l_quantity::BIGINT > 100 UNION ALL
SELECT 'INVALID_VALUE', 'lineitem.tsv', l_orderkey::VARCHAR, 'l_linenumber is not 1 to n' FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)""")
def q33_validation(spark, sf_dir):
    """Violations of a package whose tables are the driver's: references, keys, coordinates, orders."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    spans = items.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber").cast("long") * 10).alias("start"), (F.col("l_linenumber").cast("long") * 10 + F.col("l_quantity").cast("long")).alias("end"), F.lit(100).alias("length"))
    return validation.all_of(
        validation.references(items, orders, ["l_orderkey"], ["o_orderkey"], "lineitem.tsv"),
        validation.references(docs, labels, ["doc_id"], ["doc_id"], "documents.tsv"),
        validation.unique(items, ["l_orderkey", "l_linenumber"], "lineitem.tsv"),
        validation.coordinates(spans, "start", "end", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey"), "lineitem.tsv", "length"),
        validation.contiguous(items, ["l_orderkey"], "l_linenumber", "lineitem.tsv"),
    )


@query("""WITH h AS (SELECT c_custkey, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice >= 200000) AS here, count(*) FILTER (o_orderstatus = 'O') AS elsewhere, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice < 200000) AS weak
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, CASE WHEN here > 1 THEN 'multi_hit' WHEN here = 1 THEN 'hit' WHEN weak > 0 THEN 'weak_hit' WHEN elsewhere > 0 THEN 'other_chr_only' ELSE 'no_hit' END AS status FROM h""")
def q34_reference_status(spark, sf_dir):
    n = lambda c: F.sum(F.expr(c).cast("long"))
    hits = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n("o_orderstatus = 'F' and o_totalprice >= 200000").alias("here"), n("o_orderstatus = 'O'").alias("elsewhere"), n("o_orderstatus = 'F' and o_totalprice < 200000").alias("weak"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return table(spark, sf_dir, "customer").select("c_custkey").join(hits, "c_custkey", "left").select("c_custkey", coordinates.reference_status(zero("here"), zero("elsewhere"), zero("weak")).alias("status"))


@query("""WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'signup'),
j AS (SELECT p.user_id, p.event_id AS purchase_id, s.event_id AS signup_id, s.t - p.t AS d, row_number() OVER (PARTITION BY p.event_id ORDER BY s.t, s.event_id) AS n FROM p JOIN s ON p.user_id = s.user_id AND s.t BETWEEN p.t + 1500000000 AND p.t + 18000000000)
SELECT user_id, purchase_id, signup_id, d // 1000000 AS seconds FROM j WHERE n = 1""")
def q35_pair_range_join(spark, sf_dir):
    """The first signup 25 to 300 minutes after each purchase of the same user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("t").alias("p"), (F.col("t") + 1500000000).alias("l_start"), (F.col("t") + 18000000000).alias("l_end"))
    joined = events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("t").alias("r_start"), F.col("t").alias("r_end"))
    pairs = intervals.range_join(bought, joined, ["user_id"], 18000000000)
    return pairs.groupBy("user_id", "purchase_id").agg(F.min(F.struct("r_start", "signup_id", "p")).alias("b")).select("user_id", "purchase_id", "b.signup_id", F.expr("(b.r_start - b.p) div 1000000").alias("seconds"))


@query("""WITH o AS (SELECT l_orderkey AS object, l_partkey::VARCHAR AS component, l_quantity::BIGINT AS len, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
row_number() OVER w AS r, sum(l_quantity::BIGINT) OVER w AS upto FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, upto + (r - 1) * 100 AS e, upto + (r - 1) * 100 - len + 1 AS s FROM o)
SELECT object, r * 2 - 1 AS part, concat_ws(chr(9), object, s, e, r * 2 - 1, 'W', component, 1, len, strand) AS line FROM p UNION ALL
SELECT object, r * 2 - 2, concat_ws(chr(9), object, s - 100, s - 1, r * 2 - 2, 'N', 100, 'scaffold', 'yes', 'align_genus') FROM p WHERE r > 1""")
def q36_agp_lines(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    pieces = items.select(F.col("l_orderkey").alias("object"), F.struct(*ITEM_ORDER).alias("ord"), F.col("l_partkey").cast("string").alias("component"), F.col("l_quantity").cast("long").alias("length"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("orientation"))
    return agp_lines(pieces).withColumn("part", F.col("part").cast("long"))


@query("""SELECT c_custkey, c_nationkey, CASE WHEN placed THEN rank ELSE total - rank + 1 END AS n FROM (SELECT c_custkey, c_nationkey, c_acctbal >= 0 AS placed,
row_number() OVER (PARTITION BY c_nationkey, c_acctbal >= 0 ORDER BY c_acctbal, c_custkey) AS rank, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer)""")
def q37_placed_unplaced(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return ordering.placed_then_unplaced(rows, ["c_nationkey"], F.col("c_acctbal") >= 0, ["c_acctbal", "c_custkey"]).drop("c_acctbal")


@query("""SELECT event_id, CASE WHEN sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 2 = 0 THEN '+' ELSE '-' END AS orientation FROM events""")
def q38_orientation_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return ordering.orientation_runs(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "orientation")


@query("""WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view'),
b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click')
SELECT t.user_id, t.event_id AS view_id, b.event_id AS click_id FROM t JOIN b USING (user_id, n)""")
def q39_fifo_pairs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    side = lambda kind, name: events.filter(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    each = lambda kind, name: side(kind, name).withColumn("id", F.col(name))
    return ordering.fifo_pairs(each("view", "view_id"), each("click", "click_id"), ["user_id"], ["ts", "id"]).select("user_id", "view_id", "click_id")


@query("""WITH v AS (SELECT c_nationkey, o_orderpriority, count(*) AS weight FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_nationkey, o_orderpriority, weight FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY weight DESC, o_orderpriority) AS n FROM v) WHERE n = 1""")
def q40_chromosome_vote(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return aggregates.argmax_sum(rows, ["c_nationkey"], "o_orderpriority", F.lit(1))


@query(f"""WITH {SPANS}, s AS (SELECT o_custkey, s, e FROM islands), q AS (SELECT o_custkey, o_orderkey, s, s + 20 AS e FROM spans)
SELECT o_custkey, count(q.o_orderkey) > 0 AND coalesce(bool_and(ok), false) AS covers FROM (SELECT DISTINCT o_custkey FROM s) k LEFT JOIN
(SELECT q.*, EXISTS (SELECT 1 FROM s WHERE s.o_custkey = q.o_custkey AND s.s <= q.s AND q.e <= s.e) AS ok FROM q) q USING (o_custkey) GROUP BY 1""")
def q41_interval_covers(spark, sf_dir):
    spans = order_spans(spark, sf_dir)
    asked = spans.select("o_custkey", "start", (F.col("start") + 20).alias("end"))
    return intervals.covers(intervals.islands(spans, ["o_custkey"]).select("o_custkey", "start", "end"), asked, ["o_custkey"])


@query(f"""WITH {SPANS}, b AS (SELECT *, lag(e) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey) AS p FROM spans),
r2 AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rr FROM spans),
m2 AS (SELECT *, sum(CASE WHEN rr IS NULL OR s > rr THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey) AS k FROM r2)
SELECT o_custkey, min(s) AS start, max(e) AS "end", count(*) AS n_merged FROM m2 GROUP BY o_custkey, k""")
def q42_overlap_clusters(spark, sf_dir):
    """Clusters that merge on overlap only: touching intervals stay apart."""
    return intervals.islands(order_spans(spark, sf_dir), ["o_custkey"], adjacent=False)


@query("""SELECT o_custkey, o_orderkey, list_sort(list_filter(list_distinct(list(o_orderpriority) OVER (PARTITION BY o_custkey)), lambda x: x <> o_orderpriority)) AS others FROM orders""")
def q43_co_assigned(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderpriority").alias("target"), "o_orderkey")
    return placement.contig_classes(rows).select(F.col("query").alias("o_custkey"), "o_orderkey", F.col("also_on").alias("others"))
