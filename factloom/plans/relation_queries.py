"""Lookup, graph, mining and counting queries over the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_ratio
from ..operators import graph as g
from ..operators import lookup as lo
from ..operators import mining as mi
from .catalogue import query, table

EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 AS dst FROM lineitem WHERE l_quantity >= 50 AND l_discount < 0.02)"


def edges(spark, sf, *more):
    rows = table(spark, sf, "lineitem").where("l_quantity >= 50 and l_discount < 0.02")
    return rows.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), *more)


PREFIXES = [("example", "c1"), ("example.com", "c2"), ("site1", "c3"), ("site1.example", "c4"), ("www", "c5"), ("https:", "c6"), ("http:", "c7")]
PREFIX_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in PREFIXES)


@query("longest_prefix", f"""
WITH t(k, v) AS (VALUES {PREFIX_ROWS}), p AS (SELECT page_id, replace(url, '/', '.') AS name FROM pages),
m AS (SELECT p.page_id, arg_max(t.v, length(t.k)) AS cls FROM p JOIN t ON p.name = t.k OR starts_with(p.name, t.k || '.') GROUP BY 1)
SELECT p.page_id, m.cls FROM p LEFT JOIN m USING (page_id)""")
def longest_prefix(spark, sf):
    t = spark.createDataFrame(PREFIXES, "key string, cls string")
    p = table(spark, sf, "pages").select("page_id", F.translate("url", "/", ".").alias("name"))
    return lo.longest_prefix(p, "name", t, "key", "cls").select("page_id", "cls")


@query("interval_owner", """
WITH p AS (SELECT event_id, user_id, epoch_us(ts)::BIGINT // 1000000 AS sec FROM events),
s AS (SELECT user_id, event_id AS owner, sec AS lo, sec + (event_id % 7) * 600 AS hi FROM p WHERE event_id % 5 = 0)
SELECT p.event_id, arg_min(s.owner, ((s.hi - s.lo)::HUGEINT * 100000000000 + s.lo)) AS owner
FROM p LEFT JOIN s ON s.user_id = p.user_id AND p.sec BETWEEN s.lo AND s.hi GROUP BY 1""")
def interval_owner(spark, sf):
    p = table(spark, sf, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("at"))
    s = p.where("event_id % 5 = 0").select("user_id", F.col("event_id").alias("owner"), F.col("at").alias("lo"), (F.col("at") + (F.col("event_id") % 7) * 600).alias("hi"))
    return lo.innermost_interval(p, s, ["user_id"], "at", "lo", "hi", 3600).select("event_id", "owner")


@query("span_newest", """
WITH p AS (SELECT user_id AS rel, event_id AS line, event_id * 7 % 1000 AS ts FROM events),
s AS (SELECT user_id AS rel, event_id AS owner, event_id AS lo, event_id + event_id % 3 AS hi FROM events WHERE event_id % 11 = 0),
c AS (SELECT s.*, unnest(range(lo, hi + 1)) AS at FROM s)
SELECT c.rel, c.owner, CASE WHEN bool_and(p.ts IS NOT NULL) THEN max(p.ts) END AS ts FROM c LEFT JOIN p ON p.rel = c.rel AND p.line = c.at GROUP BY 1, 2""")
def span_newest(spark, sf):
    e = table(spark, sf, "events")
    p = e.select(F.col("user_id").alias("rel"), F.col("event_id").alias("line"), (F.col("event_id") * 7 % 1000).alias("ts"))
    s = e.where("event_id % 11 = 0").select(F.col("user_id").alias("rel"), F.col("event_id").alias("owner"), F.col("event_id").alias("lo"), (F.col("event_id") + F.col("event_id") % 3).alias("hi"))
    return lo.group_max_in_spans(p, s, "rel", "line", "lo", "hi", "ts", 64).select("rel", "owner", "ts")


PATTERNS = [("small", "g"), ("red w", "t"), ("b", "bolt"), ("hot", "gear"), ("", "nut"), ("green", "xyz")]


@query("pattern_semi", "SELECT p_partkey, p_name FROM part WHERE " + " OR ".join(
    f"(starts_with(p_name, '{a}') AND ends_with(p_name, '{b}') AND length(p_name) >= {len(a) + len(b)})" for a, b in PATTERNS))
def pattern_semi(spark, sf):
    pats = spark.createDataFrame(PATTERNS, "prefix string, suffix string")
    return lo.pattern_semi(table(spark, sf, "part"), "p_name", pats).select("p_partkey", "p_name")


@query("only_from", "SELECT o_custkey, count(*) AS refs FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus IN ('F', 'P'))")
def only_from(spark, sf):
    return lo.only_from(table(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus").isin("F", "P"))


@query("fan_in", """
WITH home AS (SELECT l_partkey, min(l_suppkey) AS owner FROM lineitem GROUP BY 1),
i AS (SELECT l.l_partkey, h.owner, count(*) AS inbound FROM lineitem l JOIN home h USING (l_partkey) WHERE l.l_suppkey <> h.owner GROUP BY 1, 2)
SELECT owner, count(*) AS symbols, sum(inbound)::BIGINT AS inbound FROM i GROUP BY 1""")
def fan_in(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    home = li.groupBy("l_partkey").agg(F.min("l_suppkey").alias("owner"))
    inbound = li.join(home, "l_partkey").where("l_suppkey <> owner").groupBy("l_partkey", "owner").agg(F.sum("n").alias("inbound"))
    return inbound.groupBy("owner").agg(F.count("*").alias("symbols"), F.sum("inbound").alias("inbound"))


@query("price_top3", """
WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2), h AS (SELECT * FROM c WHERE n >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS k FROM h)
SELECT l_suppkey, count(*) AS hot, sum(n)::BIGINT AS refs, string_agg(CASE WHEN k <= 3 THEN l_partkey::VARCHAR END, ',' ORDER BY k) AS top FROM r GROUP BY 1""")
def price_top3(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).where("n >= 3")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "l_partkey")))
    out = c.groupBy("l_suppkey").agg(F.count("*").alias("hot"), F.sum("n").alias("refs"), ordered.alias("t"))
    return out.select("l_suppkey", "hot", "refs", F.array_join(F.transform(F.slice("t", 1, 3), lambda x: x["l_partkey"].cast("string")), ",").alias("top"))


@query("fan_out", """
WITH a AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS imports FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
b AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS readers FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_suppkey, imports, readers FROM a JOIN b USING (l_suppkey) WHERE imports >= 10 AND readers >= 2""")
def fan_out(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.where("l_linenumber <= 2").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("imports"))
    b = li.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("readers"))
    return a.join(b, "l_suppkey").where("imports >= 10 and readers >= 2")


@query("dup_groups", "SELECT substr(sha256(text), 1, 12) AS key, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) >= 2")
def dup_groups(spark, sf):
    return mi.duplicate_groups(table(spark, sf, "documents"), "text", "doc_id")


@query("repeated_windows", """
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),
w AS (SELECT doc_id, pos, array_agg(t) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a FROM l),
k AS (SELECT doc_id AS seq, pos AS start, sha256(array_to_string(a, chr(10))) AS key FROM w WHERE len(a) = 5)
SELECT key, seq, start::INTEGER AS start, count(*) OVER (PARTITION BY key) AS runs FROM k QUALIFY count(*) OVER (PARTITION BY key) > 1""")
def repeated_windows(spark, sf):
    return mi.repeated_windows(doc_lines(spark, sf), "doc_id", "pos", "t").select("key", "seq", "start", "runs")


def doc_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))


@query("maximal_repeats")
def maximal_repeats(spark, sf):
    rows = doc_lines(spark, sf).withColumn("pos", F.col("pos").cast("long")).withColumn("t", F.substring(F.sha2("t", 256), 1, 12))
    return mi.maximal_repeats(rows, "doc_id", "pos", "t", size=5)


@query("combo_mining", """
WITH i AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), n AS (SELECT o FROM i GROUP BY 1 HAVING count(*) BETWEEN 3 AND 15),
j AS (SELECT i.* FROM i JOIN n USING (o)),
c AS (SELECT a.s AS x, b.s AS y, d.s AS z, a.o FROM j a JOIN j b ON a.o = b.o AND a.s < b.s JOIN j d ON d.o = a.o AND b.s < d.s),
w AS (SELECT x, y, z, list_sort(list(o)) AS owners FROM c GROUP BY 1, 2, 3 HAVING count(*) >= 3),
u AS (SELECT owners, list_sort(list_distinct(flatten(list([x, y, z])))) AS items FROM w GROUP BY 1)
SELECT array_to_string(owners, ',') AS owners, array_to_string(items, ',') AS items FROM u""")
def combo_mining(spark, sf):
    out = mi.combination_groups(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", 3, 3)
    return out.select(*(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("owners", "items")))


@query("comment_runs", """
WITH t AS (SELECT conv_id, turn, role, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM (SELECT DISTINCT conv_id, turn, role FROM conversations))
SELECT conv_id, role, min(turn) AS start, max(turn) AS stop, count(*) AS length FROM t GROUP BY conv_id, role, i""")
def comment_runs(spark, sf):
    return mi.runs(table(spark, sf, "conversations"), ["conv_id", "role"], "turn")


@query("reach", f"""
WITH RECURSIVE {EDGES}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r""")
def reach(spark, sf):
    return g.reach(edges(spark, sf))


@query("scc", f"""
WITH RECURSIVE {EDGES}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), m AS (SELECT a.src AS node, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src)
SELECT n.node, least(n.node, coalesce(min(m.other), n.node)) AS scc FROM n LEFT JOIN m USING (node) GROUP BY n.node""")
def scc(spark, sf):
    return g.components(edges(spark, sf))


@query("hidden_cycles", """
WITH RECURSIVE f AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 AS dst, l_linenumber % 2 AS late FROM lineitem WHERE l_quantity >= 50 AND l_discount < 0.02),
t(src, dst) AS (SELECT src, dst FROM f WHERE late = 0 UNION SELECT t.src, f.dst FROM t JOIN f ON t.dst = f.src AND f.late = 0),
a(src, dst) AS (SELECT src, dst FROM f UNION SELECT a.src, f.dst FROM a JOIN f ON a.dst = f.src),
x AS (SELECT DISTINCT array_to_string(list_sort(list(DISTINCT p.dst)), ',') AS members FROM t p JOIN t q ON p.src = q.dst AND p.dst = q.src GROUP BY p.src HAVING count(DISTINCT p.dst) > 1),
y AS (SELECT DISTINCT array_to_string(list_sort(list(DISTINCT p.dst)), ',') AS members FROM a p JOIN a q ON p.src = q.dst AND p.dst = q.src GROUP BY p.src HAVING count(DISTINCT p.dst) > 1)
SELECT members, false AS hidden FROM x UNION ALL SELECT members, true AS hidden FROM y WHERE members NOT IN (SELECT members FROM x)""")
def hidden_cycles(spark, sf):
    full = edges(spark, sf, (F.col("l_linenumber") % 2).alias("late"))
    out = g.hidden_cycles(full.where("late = 0").select("src", "dst"), full.select("src", "dst"))
    return out.select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "hidden")


@query("class_closure", """
WITH RECURSIVE c AS (SELECT DISTINCT o_orderkey AS child, o_custkey AS base FROM orders WHERE o_orderkey > o_custkey),
r(src, dst, depth) AS (SELECT DISTINCT child, child, 0 FROM c UNION SELECT r.src, c.base, r.depth + 1 FROM r JOIN c ON c.child = r.dst)
SELECT src, dst, min(depth)::INTEGER AS depth FROM r GROUP BY 1, 2""")
def class_closure(spark, sf):
    """A base stands before its child, as in source: a smaller key."""
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("base")).where("child > base").distinct()
    return g.class_closure(c, c.select(F.col("child").alias("src")))


@query("hot_amplification")
def hot_amplification(spark, sf):
    e = edges(spark, sf, (F.col("l_linenumber") % 3).cast("long").alias("depth"))
    return g.hot_amplification(e, e.where("src % 10 = 0").select(F.col("src").alias("node")))


@query("effect_fold", f"""
WITH RECURSIVE {EDGES}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
o AS (SELECT DISTINCT user_id AS node, event_type AS atom FROM events),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT node FROM o),
a AS (SELECT node, atom FROM o UNION SELECT r.src, o.atom FROM r JOIN o ON o.node = r.dst)
SELECT n.node, coalesce(array_to_string(list_sort(list(DISTINCT a.atom)), ','), '') AS atoms FROM n LEFT JOIN a USING (node) GROUP BY n.node""")
def effect_fold(spark, sf):
    ev = table(spark, sf, "events")
    own = ev.groupBy(F.col("user_id").alias("node")).agg(F.collect_set("event_type").alias("atoms"), F.lit(False).alias("unknown"))
    return g.effect_fold(edges(spark, sf), own).select("node", F.array_join("atoms", ",").alias("atoms"))


@query("follow_aliases", """
WITH RECURSIVE a AS (SELECT n_nationkey AS name, n_regionkey + 5 AS target FROM nation WHERE n_nationkey > n_regionkey + 5),
r(name, target) AS (SELECT name, target FROM a UNION SELECT r.name, a.target FROM r JOIN a ON a.name = r.target)
SELECT name, target FROM r WHERE target NOT IN (SELECT name FROM a)""")
def follow_aliases(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("name"), (F.col("n_regionkey") + 5).alias("target")).where("name > target")
    return g.follow_aliases(n)


@query("exact_value_params", """
SELECT l_orderkey, min(l_returnflag) AS value, count(*) AS sites FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1 AND count(*) >= 3""")
def exact_value_params(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey")
    out = li.agg(F.min("l_returnflag").alias("value"), F.max("l_returnflag").alias("b"), F.count("*").alias("sites"))
    return out.where("value = b and sites >= 3").drop("b")


@query("dead_keys", """
WITH w AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'purchase' OR event_type = 'error'),
r AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'click' OR event_type = 'view')
SELECT user_id, k AS key FROM w WHERE k IS NOT NULL AND (user_id, k) NOT IN (SELECT user_id, k FROM r WHERE k IS NOT NULL)""")
def dead_keys(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("key")).where("key is not null")
    written = e.where("event_type in ('purchase', 'error')").select("user_id", "key").distinct()
    return written.join(e.where("event_type in ('click', 'view')"), ["user_id", "key"], "left_anti")


@query("tri_state_join", """
WITH d AS (SELECT l_partkey, min(l_suppkey) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1),
s AS (SELECT l_orderkey, d.q FROM lineitem l LEFT JOIN d USING (l_partkey))
SELECT l_orderkey, CASE WHEN NOT bool_and(q IS NOT NULL) THEN 'unresolved' WHEN count(DISTINCT q) = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution,
  CASE WHEN bool_and(q IS NOT NULL) THEN array_to_string(list_sort(list(DISTINCT q)), ',') END AS answers FROM s GROUP BY 1""")
def tri_state_join(spark, sf):
    li = table(spark, sf, "lineitem")
    defs = li.where("l_linenumber = 1").select("l_partkey", F.col("l_suppkey").alias("q"))
    sites = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey")).alias("targets"))
    out = lo.resolve_all(sites, "l_orderkey", "targets", defs, ["l_partkey"], "q")
    return out.select("l_orderkey", "resolution", F.array_join(F.col("answers").cast("array<string>"), ",").alias("answers"))


@query("sheet_carry", """
WITH o AS (SELECT doc_id, doc_id // 10 AS site, quality AS verdict FROM labels WHERE doc_id % 3 <> 0), n AS (SELECT doc_id + CASE WHEN doc_id % 7 = 0 THEN 1000000 ELSE 0 END AS doc_id, doc_id // 10 AS site FROM labels),
e AS (SELECT n.doc_id, o.doc_id AS old, verdict FROM n JOIN o USING (doc_id)),
a AS (SELECT * FROM o WHERE doc_id NOT IN (SELECT old FROM e) QUALIFY count(*) OVER (PARTITION BY site) = 1),
b AS (SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM e) QUALIFY count(*) OVER (PARTITION BY site) = 1)
SELECT n.doc_id, n.site, coalesce(e.verdict, a.verdict) AS verdict, CASE WHEN e.doc_id IS NOT NULL THEN 'key' WHEN a.site IS NOT NULL THEN 'site' END AS carried
FROM n LEFT JOIN e USING (doc_id) LEFT JOIN b ON b.doc_id = n.doc_id LEFT JOIN a ON a.site = b.site""")
def sheet_carry(spark, sf):
    lab = table(spark, sf, "labels")
    site = F.floor(F.col("doc_id") / 10).alias("site")
    old = lab.where("doc_id % 3 <> 0").select("doc_id", site, F.col("quality").alias("verdict"))
    new = lab.select((F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 1000000).otherwise(0)).alias("doc_id"), site)
    return lo.carry(new, old, ["doc_id"], ["site"], "verdict").select("doc_id", "site", "verdict", "carried")


@query("nearest_names")
def nearest_names(spark, sf):
    """For each nation the names nearest to it by common subsequence."""
    # the fixed geography of the schema: 25 rows at any scale
    n = table(spark, sf, "nation").select("n_name", F.lit(1).alias("one"))
    pairs = n.join(n.withColumnRenamed("n_name", "other"), "one").where("n_name <> other")
    rated = pairs.select("n_name", "other", name_ratio(F.lower("n_name"), F.lower("other")).alias("ratio")).where("ratio >= 0.4")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("ratio")).alias("m"), "other"))), 1, 5)
    return rated.groupBy("n_name").agg(F.array_join(F.transform(best, lambda x: x["other"]), ",").alias("nearest"))
