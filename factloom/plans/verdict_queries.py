"""Verdict, counter and header queries over the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verdicts as ve
from .catalogue import query, table

CLASSES = "c AS (SELECT DISTINCT o_orderkey AS child, o_custkey AS base FROM orders WHERE o_orderkey > o_custkey)"
METHODS = "m AS (SELECT DISTINCT o_custkey AS owner, o_orderpriority AS name FROM orders)"


def classes(spark, sf):
    """A base stands before its child, as in source: a smaller key."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("base"))
    return o.where("child > base").distinct()


def methods(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("name")).distinct()


@query("override_expansion", f"""
WITH RECURSIVE {CLASSES}, {METHODS}, s AS (SELECT o_orderkey AS site, o_custkey AS owner, o_orderpriority AS name FROM orders),
b(src, dst) AS (SELECT DISTINCT owner, owner FROM s UNION SELECT b.src, c.child FROM b JOIN c ON c.base = b.dst),
h AS (SELECT DISTINCT s.site, m.owner AS holder FROM s JOIN b ON b.src = s.owner JOIN m ON m.owner = b.dst AND m.name = s.name),
g AS (SELECT site, count(*) AS n, array_to_string(list_sort(list(holder)), ',') AS candidates FROM h GROUP BY 1)
SELECT s.site, CASE WHEN g.n = 1 THEN 'resolved' WHEN g.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution, g.candidates FROM (SELECT DISTINCT site FROM s) s LEFT JOIN g USING (site)""")
def override_expansion(spark, sf):
    o = table(spark, sf, "orders")
    s = o.select(F.col("o_orderkey").alias("site"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("name"))
    out = ve.override_expansion(s, classes(spark, sf), methods(spark, sf))
    return out.select("site", "resolution", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


@query("first_in_chain", f"""
WITH RECURSIVE {CLASSES}, {METHODS}, r(src, dst, depth) AS (SELECT DISTINCT child, child, 0 FROM c UNION SELECT r.src, c.base, r.depth + 1 FROM r JOIN c ON c.child = r.dst),
h AS (SELECT r.*, row_number() OVER (PARTITION BY src ORDER BY depth, dst) AS k FROM r WHERE dst IN (SELECT owner FROM m))
SELECT src, dst AS holder FROM h WHERE k = 1""")
def first_in_chain(spark, sf):
    c = classes(spark, sf)
    return ve.first_in_chain(c.select(F.col("child").alias("src")), c, methods(spark, sf))


@query("reaches_effect", """
WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders), m AS (SELECT DISTINCT dst AS node FROM e WHERE dst % 9 = 0),
r(node) AS (SELECT node FROM m UNION SELECT e.src FROM r JOIN e ON e.dst = r.node)
SELECT node, node IN (SELECT node FROM m) AS own FROM r""")
def reaches_effect(spark, sf):
    """Order keys call customer keys; every ninth customer key has the effect."""
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return ve.reaches_effect(e, e.where("dst % 9 = 0").select(F.col("dst").alias("node")))


@query("closed_world", """
WITH s AS (SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_mktsegment LIKE 'B%' THEN 'segment' END,
  CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'silent' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer)
SELECT c_custkey, reasons, reasons = '' AS passed FROM s""")
def closed_world(spark, sf):
    seen = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    c = table(spark, sf, "customer").join(seen, "c_custkey", "left")
    reasons = [("debt", F.col("c_acctbal") < 0), ("segment", F.col("c_mktsegment").startswith("B")), ("silent", F.col("seen").isNull())]
    return ve.closed_world(c, reasons).select("c_custkey", F.array_join("reasons", ",").alias("reasons"), "passed")


@query("live_outside", """
WITH d AS (SELECT DISTINCT 'm' || l_suppkey || '.f' || l_linenumber AS qname, 'p' || l_partkey AS name FROM lineitem),
u AS (SELECT DISTINCT 'p' || l_partkey AS name, 'm' || l_suppkey || '.f' || l_linenumber || CASE WHEN l_orderkey % 2 = 0 THEN '.g' ELSE '' END AS scope FROM lineitem)
SELECT DISTINCT d.qname, d.name FROM d JOIN u USING (name) WHERE u.scope <> d.qname AND NOT starts_with(u.scope, d.qname || '.')""")
def live_outside(spark, sf):
    li = table(spark, sf, "lineitem")
    q = F.concat(F.lit("m"), F.col("l_suppkey"), F.lit(".f"), F.col("l_linenumber"))
    name = F.concat(F.lit("p"), F.col("l_partkey")).alias("name")
    scope = F.concat(q, F.when(F.col("l_orderkey") % 2 == 0, ".g").otherwise("")).alias("scope")
    return ve.live_outside(li.select(q.alias("qname"), name).distinct(), li.select(name, scope).distinct())


@query("unspoken_names", """
SELECT event_type AS name, count(*) AS sites, array_to_string(list_sort(list(DISTINCT user_id % 20)), ',') AS guesses FROM events WHERE event_id % 4 <> 0 GROUP BY 1""")
def unspoken_names(spark, sf):
    state = F.when(F.col("event_id") % 4 == 0, "resolved").otherwise("unresolved").alias("resolution")
    s = table(spark, sf, "events").select(F.col("event_type").alias("name"), state, (F.col("user_id") % 20).alias("guess"))
    return ve.unspoken(s).select("name", "sites", F.array_join(F.col("guesses").cast("array<string>"), ",").alias("guesses"))


@query("edge_counters", """
SELECT count(*) AS edges, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_quantity > 25) AS big,
  count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS both_ FROM lineitem""")
def edge_counters(spark, sf):
    r, b = F.col("l_returnflag") == "R", F.col("l_quantity") > 25
    return ve.counters(table(spark, sf, "lineitem"), {"edges": F.lit(True), "returned": r, "big": b, "both_": r & b})


@query("shipped_subsets", """
WITH u AS (SELECT DISTINCT l_linenumber AS item FROM lineitem), n AS (SELECT l_orderkey AS owner, list_sort(list(DISTINCT l_linenumber)) AS named FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 2),
e AS (SELECT list_sort(list(item)) AS every FROM u), x AS (SELECT owner, named, list_filter(every, lambda i: NOT list_contains(named, i)) AS lacks FROM n, e)
SELECT owner, array_to_string(named, ',') AS named, array_to_string(lacks, ',') AS lacks FROM x WHERE len(lacks) > 0""")
def shipped_subsets(spark, sf):
    li = table(spark, sf, "lineitem")
    out = ve.subset_holders(li.select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("item")), li.select(F.col("l_linenumber").alias("item")))
    return out.select("owner", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("named", "lacks")))


@query("header_counts", """
SELECT count(*) AS findings, count(*) FILTER (o_orderstatus = 'F') AS proven, count(*) FILTER (o_orderstatus = 'O') AS strong,
  count(*) FILTER (o_orderstatus = 'P') AS moderate, count(DISTINCT o_custkey) AS symbols, greatest(count(*) - 1000, 0)::BIGINT AS cut FROM orders""")
def header_counts(spark, sf):
    o = table(spark, sf, "orders")
    tiers = {"proven": "F", "strong": "O", "moderate": "P"}
    return o.agg(
        F.count("*").alias("findings"), *(F.count(F.when(F.col("o_orderstatus") == v, 1)).alias(k) for k, v in tiers.items()),
        F.countDistinct("o_custkey").alias("symbols"), F.greatest(F.count("*") - 1000, F.lit(0)).alias("cut"),
    )


@query("median_runs", "SELECT event_type, round(median(floor(value * 1000)), 6) AS middle, count(*) AS runs FROM events GROUP BY 1")
def median_runs(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type")
    return e.agg(F.round(F.median(F.floor(F.col("value") * 1000)), 6).alias("middle"), F.count("*").alias("runs"))


@query("explain_roster", """
WITH s AS (SELECT d.source, count(*) AS n, sum(l.quality)::BIGINT AS tp FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id % 3 <> 0 GROUP BY 1),
r AS (SELECT d.source, count(*) AS covered FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.toxic = 1 GROUP BY 1), a AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1)
SELECT a.source, a.docs, s.tp, s.n, r.covered FROM a LEFT JOIN s USING (source) LEFT JOIN r USING (source)""")
def explain_roster(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    j = table(spark, sf, "labels").join(docs, "doc_id")
    s = j.where("doc_id % 3 <> 0").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("tp"))
    r = j.where("toxic = 1").groupBy("source").agg(F.count("*").alias("covered"))
    a = docs.groupBy("source").agg(F.count("*").alias("docs"))
    return a.join(s, "source", "left").join(r, "source", "left").select("source", "docs", "tp", "n", "covered")
