"""URL filters with redirect equivalence.

Rules name a host and a path prefix; the longest that fits decides. Pages that redirect to each other
(``meta refresh``) or name each other as canonical are aliases: connected components over those
links carry a block from any member to the members that no rule decides. An explicit allow has
precedence: a page that a rule allows is never blocked by an alias, and a component in which a rule
allows any member passes no block on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.graph import connected_components

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Up to so many rules are one CASE expression; more are joined by host suffix.
INLINE_RULES = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def decide(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (with host and path) and the columns rule and rule_verdict, null where no rule fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    if len(ordered) <= INLINE_RULES:
        host, path = F.col("host"), F.col("path")
        fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), v, h + p) for v, h, p in ordered]
        pick = lambda i: reduce(lambda rest, f: F.when(f[0], F.lit(f[i])).otherwise(rest), reversed(fits), F.lit(None).cast("string"))
        return pages.withColumns({"rule": pick(2), "rule_verdict": pick(1)})
    table = pages.sparkSession.createDataFrame([(h, p, h + p, v, i) for i, (v, h, p) in enumerate(ordered)], "r_host string, r_path string, rule string, rule_verdict string, r int")
    places = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = places.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("r_host"))
    best = suffixes.join(table, "r_host").filter(F.col("path").startswith(F.col("r_path"))).groupBy("host", "path").agg(F.min(F.struct("r", "rule", "rule_verdict")).alias("b")).select("host", "path", "b.rule", "b.rule_verdict")
    return pages.join(best, ["host", "path"], "left")


def alias_links(pages: DataFrame) -> DataFrame:
    """(u, v) of urls without fragment: one row per redirect and per canonical link in a page's html, all of them, but for those in comments."""
    html = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    tags = lambda name, mark: F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0)), lambda t: t.rlike(mark))
    named = lambda name: lambda t: F.regexp_extract(t, rf"(?is)\b{name}\s*=\s*[\"']?([^\"'\s>]+)", 1)
    links = F.transform(tags("link", r"(?is)\brel\s*=\s*[\"']?canonical\b"), named("href"))
    moves = F.transform(tags("meta", r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"), named("url"))
    plain = lambda x: F.regexp_replace(x, "&(?:amp|#38|#x26);", "&")
    some = pages.filter(F.col("html").rlike("(?i)canonical|refresh") & F.col("url").isNotNull())
    found = some.select("url", F.explode(F.transform(F.filter(F.concat(links, moves), lambda x: x != ""), plain)).alias("to"))
    site, here = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract("url", r"(?s)^(.*?://[^?#]*/)", 1)
    target = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.regexp_extract("url", r"(?s)^(.*?:)//", 1), "to"))
        .when(F.col("to").startswith("/"), F.concat(site, "to"))
        .otherwise(F.concat(F.when(here == "", F.concat(site, F.lit("/"))).otherwise(here), "to"))
    )
    return found.select(page_key(F.col("url")).alias("u"), page_key(target).alias("v")).distinct()


def page_key(url: Column) -> Column:
    """The url without its fragment, its host in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    return F.when(bare.contains("://"), F.concat(F.regexp_extract(bare, r"(?s)^(.*?://)", 1), url_host(bare), F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1))).otherwise(bare)


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """(page_id, url, html) -> page_id, host, path, rule, verdict; one row per input row.

    Null url, or one without ``://``: host and path are empty, no rule fits and it has no aliases. Null
    html has no links. Rows that repeat are judged alike. Other columns are ignored.
    """
    rows = decide(pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")), rules)
    links = alias_links(pages)
    classes = connected_components(links)
    keyed = rows.withColumn("node", page_key(F.col("url")))
    ruled = keyed.filter("rule_verdict is not null").select("node", "rule_verdict").distinct()
    # A link's target need not be a page of the table; the rules judge its url all the same.
    targets = decide(links.select(F.col("v").alias("node"), url_host(F.col("v")).alias("host"), url_path(F.col("v")).alias("path")), rules).filter("rule_verdict is not null").select("node", "rule_verdict")
    said = classes.join(ruled.unionAll(targets), "node").groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    passed = classes.join(said.filter("blocked and not allowed"), "component").select("node", F.lit("block").alias("passed"))
    return keyed.join(passed, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "passed", F.lit(default)).alias("verdict"))


def op9_url_filter(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


ORACLE = r"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
clean AS (SELECT url, regexp_replace(html, '<!--.*?-->', '', 'gs') AS html FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
links AS (
  SELECT regexp_replace(url, '#.*$', '', 's') AS u, regexp_replace(regexp_replace(x, '&(?:amp|#38|#x26);', '&', 'g'), '#.*$', '', 's') AS v FROM (
    SELECT url, unnest(list_concat(
      list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical\b')), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
      list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS x
    FROM clean) WHERE x <> ''),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
nodes AS (
  SELECT page_id, regexp_replace(url, '#.*$', '', 's') AS node,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
judged AS (
  SELECT nodes.*, (SELECT arg_max({'r': h || p, 'v': verdict}, length(h || p)) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM nodes),
reach(a, b) AS (SELECT u, v FROM edges UNION SELECT reach.a, edges.v FROM reach JOIN edges ON reach.b = edges.u),
said AS (SELECT reach.a AS node, bool_or(judged.best.v = 'allow') AS allowed, bool_or(judged.best.v = 'block') AS blocked
  FROM reach JOIN judged ON judged.node = reach.b WHERE judged.best IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, judged.best.r AS rule,
  coalesce(judged.best.v, CASE WHEN said.blocked AND NOT said.allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN said ON said.node = judged.node
"""
