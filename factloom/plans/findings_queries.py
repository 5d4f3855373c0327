"""Findings pipeline and measuring queries over the plain tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.bounds import posterior, score
from ..functions.paths import excluded, owner_list
from ..operators import findings as fo
from ..operators import measure as mo
from ..operators.ranks import rank_in_ranges
from .catalogue import query, table


def orders_as_findings(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderpriority").alias("rule"), F.concat(F.lit("c"), F.col("o_custkey")).alias("symbol"), F.col("o_orderkey").alias("ord"),
        F.col("o_totalprice").alias("salience"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("day"), F.col("o_custkey").alias("cust"),
    )


FINDINGS = """f AS (SELECT o_orderpriority AS rule, 'c' || o_custkey AS symbol, o_orderkey AS ord, o_totalprice AS salience,
  o_orderstatus AS status, o_orderdate AS day, o_custkey AS cust FROM orders)"""


@query("posterior_bound", """
WITH s AS (SELECT d.source, count(*) AS n, sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS tp
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.source),
m AS (SELECT source, n, tp, tp::DOUBLE + 4.0::DOUBLE * 0.8::DOUBLE AS a, (n - tp)::DOUBLE + 4.0::DOUBLE * (1.0::DOUBLE - 0.8::DOUBLE) AS b FROM s)
SELECT source, n::BIGINT AS n, tp::BIGINT AS tp, round(a / (a + b), 9) AS mean,
  round(a / (a + b) - sqrt((a / (a + b)) * (1.0::DOUBLE - a / (a + b)) / (a + b + 1.0::DOUBLE)), 9) AS bound FROM m""")
def posterior_bound(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    s = d.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("tp"))
    mean, _ = posterior(F.col("tp"), F.col("n"), 0.8)
    return s.select("source", "n", "tp", F.round(mean, 9).alias("mean"), F.round(score(F.col("tp"), F.col("n"), 0.8), 9).alias("bound"))


@query("tier_rank", f"""
WITH {FINDINGS}, w AS (SELECT rule, ord, salience, row_number() OVER (PARTITION BY rule ORDER BY salience DESC, ord) - 1 AS within FROM f)
SELECT rule, ord, within::INTEGER AS within, row_number() OVER (ORDER BY within, rule, ord)::INTEGER AS rank FROM w""")
def tier_rank(spark, sf):
    f = orders_as_findings(spark, sf).select("rule", "ord", "salience")
    placed = rank_in_ranges(f, ["rule"], [F.desc("salience"), F.asc("ord")], "k").select("rule", "ord", (F.col("k") - 1).alias("within"))
    out = rank_in_ranges(placed, [], [F.asc("within"), F.asc("rule"), F.asc("ord")], "rank")
    return out.select("rule", "ord", F.col("within").cast("int").alias("within"), F.col("rank").cast("int").alias("rank"))


@query("top_n_cut", f"""
WITH {FINDINGS}, r AS (SELECT ord, salience, row_number() OVER (ORDER BY salience DESC, ord) AS rank, count(*) OVER () AS total FROM f)
SELECT ord, salience, rank::INTEGER AS rank, greatest(total - 40, 0)::BIGINT AS cut FROM r WHERE rank <= 40""")
def top_n_cut(spark, sf):
    return fo.top_n(orders_as_findings(spark, sf).select("ord", "salience"), [F.desc("salience"), F.asc("ord")], 40)


@query("rollup_order", f"""
WITH {FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY salience DESC, ord) AS own FROM f),
b AS (SELECT *, min(own) OVER (PARTITION BY status, symbol) AS symbol_rank FROM r)
SELECT status, symbol, ord, row_number() OVER (PARTITION BY status ORDER BY symbol_rank, own)::INTEGER AS place FROM b""")
def rollup_order(spark, sf):
    f = orders_as_findings(spark, sf).select("status", "symbol", "ord", "salience")
    r = rank_in_ranges(f, ["status"], [F.desc("salience"), F.asc("ord")], "own")
    b = r.withColumn("symbol_rank", F.min("own").over(Window.partitionBy("status", "symbol")))
    out = rank_in_ranges(b, ["status"], [F.asc("symbol_rank"), F.asc("own")], "place")
    return out.select("status", "symbol", "ord", F.col("place").cast("int").alias("place"))


SHAPE = "md5(concat(status, '|', cast(ord % 7 as string)))"
SHAPE_SQL = "md5(status || '|' || (ord % 7))"
CUT = "1998-04-25"


@query("baseline_snapshot", f"""
WITH {FINDINGS} SELECT rule, symbol, count(*) AS "count", arg_min({SHAPE_SQL}, ord) AS shape FROM f WHERE day < DATE '{CUT}' GROUP BY rule, symbol""")
def baseline_snapshot(spark, sf):
    f = orders_as_findings(spark, sf).withColumn("shape", F.expr(SHAPE)).where(F.col("day") < F.lit(CUT).cast("timestamp"))
    return fo.snapshot(f, ["rule", "symbol"], "shape", "ord")


BASE = f"""b AS (SELECT rule, symbol, count(*) AS n, arg_min({SHAPE_SQL}, ord) AS shape FROM f WHERE day < DATE '{CUT}' GROUP BY ALL),
w AS (SELECT rule, symbol, count(*) AS n, arg_min({SHAPE_SQL}, ord) AS shape FROM f WHERE day >= DATE '{CUT}' GROUP BY ALL)"""


def old_new(spark, sf):
    f = orders_as_findings(spark, sf).withColumn("shape", F.expr(SHAPE))
    cut = F.lit(CUT).cast("timestamp")
    return f, f.where(F.col("day") < cut), f.where(F.col("day") >= cut)


@query("baseline_prune", f"""
WITH {FINDINGS}, {BASE} SELECT rule, symbol, least(b.n, w.n) AS "count", w.shape FROM b JOIN w USING (rule, symbol)""")
def baseline_prune(spark, sf):
    _, old, new = old_new(spark, sf)
    return fo.prune(fo.snapshot(old, ["rule", "symbol"], "shape", "ord"), fo.snapshot(new, ["rule", "symbol"], "shape", "ord"), ["rule", "symbol"])


@query("budgeted_diff", f"""
WITH {FINDINGS}, {BASE},
r AS (SELECT *, row_number() OVER (PARTITION BY rule, symbol ORDER BY day, ord) AS place FROM f WHERE day >= DATE '{CUT}')
SELECT r.rule, r.symbol, r.ord, r.place::INTEGER AS place, coalesce(b.n, 0)::BIGINT AS budget
FROM r LEFT JOIN b USING (rule, symbol) WHERE place > coalesce(b.n, 0)""")
def budgeted_diff(spark, sf):
    _, old, new = old_new(spark, sf)
    base = fo.snapshot(old, ["rule", "symbol"], "shape", "ord")
    out = fo.budgeted_diff(new, base, ["rule", "symbol"], [F.asc("day"), F.asc("ord")])
    return out.select("rule", "symbol", "ord", F.col("place").cast("int").alias("place"), F.col("budget").cast("long").alias("budget"))


@query("budget_absorbed", f"""
WITH {FINDINGS}, {BASE} SELECT coalesce(sum(least(b.n, w.n)), 0)::BIGINT AS absorbed FROM b JOIN w USING (rule, symbol)""")
def budget_absorbed(spark, sf):
    _, old, new = old_new(spark, sf)
    return fo.absorbed(new, fo.snapshot(old, ["rule", "symbol"], "shape", "ord"), ["rule", "symbol"])


@query("moved_budget", f"""
WITH {FINDINGS}, {BASE},
m AS (SELECT w.*, row_number() OVER (PARTITION BY rule, shape ORDER BY symbol) AS k FROM w WHERE (rule, symbol) NOT IN (SELECT (rule, symbol) FROM b)),
p AS (SELECT b.*, row_number() OVER (PARTITION BY rule, shape ORDER BY symbol) AS k FROM b WHERE (rule, symbol) NOT IN (SELECT (rule, symbol) FROM w))
SELECT m.rule, m.symbol, p.symbol AS from_symbol, p.n AS from_count FROM m JOIN p USING (rule, shape, k)""")
def moved_budget(spark, sf):
    _, old, new = old_new(spark, sf)
    key = ["rule", "symbol"]
    base, now = fo.snapshot(old, key, "shape", "ord"), fo.snapshot(new, key, "shape", "ord")
    out = fo.moved_budget(now.join(base, key, "left_anti"), base.join(now, key, "left_anti"), ["rule", "shape"], "symbol")
    return out.select("rule", "symbol", "from_symbol", "from_count")


@query("suppress_split", """
WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
f AS (SELECT doc_id, line, CASE WHEN line % 2 = 0 THEN 'even' ELSE 'odd' END AS rule FROM l WHERE length(t) > 200),
m AS (SELECT DISTINCT doc_id, CASE WHEN regexp_matches(t, '^The') THEN 0 WHEN regexp_matches(t, '^[A-Z][a-z]{0,2}\\.') THEN line + 1 ELSE line END AS line,
        CASE WHEN length(t) % 2 = 0 THEN 'even' ELSE 'odd' END AS rule
      FROM l WHERE regexp_matches(t, '^The .*and.*of|^[A-Z][a-z]{0,2}\\.|[a-z]{14,}'))
SELECT f.doc_id, f.line::INTEGER AS line, f.rule, (f0.doc_id IS NOT NULL OR f1.doc_id IS NOT NULL) AS suppressed FROM f
LEFT JOIN (SELECT DISTINCT doc_id, rule FROM m WHERE line = 0) f0 ON f0.doc_id = f.doc_id AND f0.rule = f.rule
LEFT JOIN m f1 ON f1.doc_id = f.doc_id AND f1.rule = f.rule AND f1.line = f.line""".replace("\\\\", "\\"))
def suppress_split(spark, sf):
    d = table(spark, sf, "documents")
    lines = d.select(F.col("doc_id").alias("rel"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    t = F.col("text")
    parity = lambda c: F.when(c % 2 == 0, "even").otherwise("odd")
    found = lines.where(F.length("text") > 200).select(F.xxhash64("rel", "line").alias("ord"), "rel", "line", parity(F.col("line")).alias("rule"), F.lit("-").alias("symbol"))
    marks = lines.where(t.rlike(r"^The .*and.*of|^[A-Z][a-z]{0,2}\.|[a-z]{14,}"))
    at = F.when(t.rlike("^The"), 0).when(t.rlike(r"^[A-Z][a-z]{0,2}\."), F.col("line") + 1).otherwise(F.col("line"))
    marks = marks.select("rel", at.alias("line"), parity(F.length("text")).alias("name"))
    none = lines.select("rel", "line", F.lit("none").alias("qname")).limit(0)
    out = fo.suppress(found, marks, none)
    return out.select(F.col("rel").alias("doc_id"), "line", "rule", "suppressed")


@query("override_paths", """
SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS rel,
  (list_contains(string_split(regexp_replace(url, '^https?://[^/]+/', ''), '/'), 'index')
   OR regexp_matches(regexp_replace(url, '^https?://[^/]+/', ''), '^.*1.*3$')
   OR starts_with(regexp_replace(url, '^https?://[^/]+/', ''), 'a/')) AS off FROM pages""")
def override_paths(spark, sf):
    rel = F.regexp_replace("url", "^https?://[^/]+/", "")
    p = table(spark, sf, "pages").select("page_id", rel.alias("rel"))
    return p.withColumn("off", excluded(F.col("rel"), ["index", "*1*3", "a"]))


@query("grouping_tally", """
SELECT d.lang, d.source, l.toxic, l.quality, grouping(d.lang, d.source, l.toxic, l.quality)::BIGINT AS level, count(*) AS n
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
GROUP BY GROUPING SETS ((d.lang, l.quality), (d.lang, d.source, l.quality), (d.lang, l.toxic, l.quality))""")
def grouping_tally(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    out = mo.tally(d, [["lang"], ["lang", "source"], ["lang", "toxic"]], "quality")
    return out.select("lang", "source", "toxic", "quality", "level", "n")


@query("fire_rates", """
SELECT event_type, sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS r0, sum(CASE WHEN user_id % 3 = 1 THEN 1 ELSE 0 END)::BIGINT AS r1,
  sum(CASE WHEN user_id % 3 = 2 THEN 1 ELSE 0 END)::BIGINT AS r2 FROM events GROUP BY event_type""")
def fire_rates(spark, sf):
    e = table(spark, sf, "events").withColumn("repo", F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")))
    return mo.fire_rates(e, "event_type", "repo", ["r0", "r1", "r2"])


@query("profile_grown", """
WITH e AS (SELECT user_id, ts, floor(value * 1000)::BIGINT AS v, count(*) OVER () AS c, event_id FROM events),
a AS (SELECT user_id, sum(v)::BIGINT AS x FROM e WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, sum(v)::BIGINT AS x FROM e WHERE event_id % 2 = 1 GROUP BY 1)
SELECT b.user_id, b.x AS now, a.x AS before FROM a JOIN b USING (user_id) WHERE b.x > greatest(a.x * 2.0, a.x + 100.0)""")
def profile_grown(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.floor(F.col("value") * 1000))
    half = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.sum("v").alias("x"))
    return mo.grown(half(1), half(0), "user_id", "x", 2.0, 100.0)


@query("loc_buckets", """
SELECT CASE WHEN source IN ('src0', 'src1') THEN 'vendored' WHEN lang <> 'en' THEN 'test' WHEN text LIKE 'The%' THEN 'generated' ELSE 'prod' END AS bucket,
  count(*) AS files, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))::BIGINT AS lines FROM documents GROUP BY 1""")
def loc_buckets(spark, sf):
    rules = [("vendored", F.col("source").isin("src0", "src1")), ("test", F.col("lang") != "en"), ("generated", F.col("text").startswith("The"))]
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return mo.line_buckets(table(spark, sf, "documents"), rules, "prod", lines)


@query("stratified_sample")
def stratified_sample(spark, sf):
    out = mo.stratified_sample(table(spark, sf, "events"), "event_type", [F.asc("event_id")], 20)
    return out.select("event_type", "event_id")


@query("world_diff", """
SELECT doc_id, quality, toxic FROM labels WHERE (doc_id, quality) NOT IN (SELECT (doc_id - 1, quality) FROM labels)""")
def world_diff(spark, sf):
    now = table(spark, sf, "labels")
    base = now.select((F.col("doc_id") - 1).alias("doc_id"), "quality")
    return mo.world_diff(base, now, ["doc_id", "quality"]).select("doc_id", "quality", "toxic")


@query("compose_fixes", """
WITH e AS (SELECT o_orderkey % 1500 AS fix, o_custkey % 500 AS rel, o_orderkey % 11 AS line, o_orderstatus = 'F' AS deletes FROM orders),
g AS (SELECT DISTINCT fix, rel, line FROM e WHERE deletes), t AS (SELECT DISTINCT fix, rel, line FROM e WHERE NOT deletes),
n AS (SELECT fix, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT t.fix FROM t JOIN g USING (rel, line) WHERE t.fix <> g.fix),
s AS (SELECT a.fix, b.fix AS other, count(*) AS c FROM g a JOIN g b USING (rel, line) WHERE a.fix <> b.fix GROUP BY 1, 2),
i AS (SELECT s.fix FROM s JOIN n x ON x.fix = s.fix JOIN n y ON y.fix = s.other WHERE s.c = x.n AND x.n < y.n)
SELECT DISTINCT fix FROM e WHERE fix NOT IN (SELECT fix FROM c) AND fix NOT IN (SELECT fix FROM i)""")
def compose_fixes(spark, sf):
    o = table(spark, sf, "orders")
    e = o.select((F.col("o_orderkey") % 1500).alias("fix"), (F.col("o_custkey") % 500).alias("rel"), (F.col("o_orderkey") % 11).alias("line"), (F.col("o_orderstatus") == "F").alias("deletes"))
    return fo.compose_fixes(e)


@query("owner_lists", """
WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT 's' || l_suppkey)) AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(a[1:3], ', ') || CASE WHEN len(a) > 3 THEN ' +' || (len(a) - 3) || ' more' ELSE '' END AS owners FROM s""")
def owner_lists(spark, sf):
    names = F.sort_array(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey"))))
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(names.alias("a"))
    return per.select("l_orderkey", owner_list(F.col("a")).alias("owners"))


@query("flagship_ranked_excess", """
WITH s AS (SELECT d.source, count(*) AS n, sum(l.quality) AS tp FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1),
p AS (SELECT source, (tp::DOUBLE + 4.0::DOUBLE * 0.8::DOUBLE) AS a, (n - tp)::DOUBLE + 4.0::DOUBLE * (1.0::DOUBLE - 0.8::DOUBLE) AS b FROM s),
q AS (SELECT source, round(a / (a + b) - sqrt((a / (a + b)) * (1.0::DOUBLE - a / (a + b)) / (a + b + 1.0::DOUBLE)), 9) AS bound FROM p),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t FROM documents),
k AS (SELECT t, count(*) AS c FROM l WHERE t <> '' GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT l.doc_id, l.source, substr(sha256(l.t), 1, 12) AS key, max(k.c) AS salience FROM l JOIN k USING (t) GROUP BY ALL),
b AS (SELECT key, count(*) AS budget FROM f WHERE doc_id % 2 = 0 GROUP BY 1),
x AS (SELECT f.*, coalesce(b.budget, 0) AS budget, row_number() OVER (PARTITION BY f.key ORDER BY doc_id) AS place FROM f LEFT JOIN b USING (key)),
r AS (SELECT x.*, coalesce(q.bound, 0.0) AS bound, row_number() OVER (PARTITION BY x.source ORDER BY salience DESC, key, doc_id) - 1 AS within FROM x LEFT JOIN q USING (source) WHERE place > budget),
o AS (SELECT doc_id, source, key, salience, bound, within, row_number() OVER (ORDER BY bound DESC, within, source, key, doc_id) AS rank FROM r)
SELECT doc_id, source, key, salience::BIGINT AS salience, bound::DOUBLE AS bound, within::INTEGER AS within, rank::INTEGER AS rank FROM o WHERE rank <= 20""")
def flagship_ranked_excess(spark, sf):
    """Repeated lines as findings, a baseline from half the documents, the excess
    ranked by the measured quality of its source, the first twenty."""
    docs = table(spark, sf, "documents")
    s = table(spark, sf, "labels").join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("tp"))
    bound = s.select("source", F.round(score(F.col("tp"), F.col("n"), 0.8), 9).alias("bound"))
    lines = docs.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("t")).where("t <> ''")
    keyed = lines.select("doc_id", "source", F.substring(F.sha2("t", 256), 1, 12).alias("key"), F.xxhash64("t").alias("h"))
    per = keyed.groupBy("key", "h", "doc_id", "source").agg(F.count("*").alias("c"))
    total = per.groupBy("key", "h").agg(F.sum("c").alias("all")).where(F.col("all") > 1)
    found = per.join(total, ["key", "h"]).groupBy("doc_id", "source", "key").agg(F.max("all").alias("salience"))
    base = found.where(F.col("doc_id") % 2 == 0).groupBy("key").agg(F.count("*").alias("count"))
    excess = fo.budgeted_diff(found, base, ["key"], [F.asc("doc_id")])
    judged = excess.join(bound, "source", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    within = fo.rank_within(judged, ["source"], [F.desc("salience"), F.asc("key"), F.asc("doc_id")])
    order = [F.desc("bound"), F.asc("within"), F.asc("source"), F.asc("key"), F.asc("doc_id")]
    out = fo.top_n(within, order, 20)
    return out.select("doc_id", "source", "key", "salience", "bound", F.col("within").cast("int").alias("within"), F.col("rank").cast("int").alias("rank"))
