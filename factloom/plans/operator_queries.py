"""One query for each operator that the other modules leave out, on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pytext, text, typestrings
from ..functions.bounds import p_real
from ..functions.paths import is_bench_path, is_test_path, under
from ..operators import checker, effects, graph, mining, resolve, rules, world
from ..operators import findings as fo
from ..operators import lookup as lo
from ..operators import measure as mo
from ..sources import files as fs
from ..sources import git
from .audit import by_arm
from .catalogue import query, table

# paths made of part names: folders, a test file in every third, a test folder in every seventh
REL = "concat(if(p_partkey % 7 = 0, 'tests/', if(p_partkey % 5 = 0, 'benches/', 'src/')), replace(p_name, ' ', '/'), if(p_partkey % 3 = 0, '/test_', '/'), p_partkey, '.py')"
REL_SQL = "CASE WHEN p_partkey % 7 = 0 THEN 'tests/' WHEN p_partkey % 5 = 0 THEN 'benches/' ELSE 'src/' END || replace(p_name, ' ', '/') || CASE WHEN p_partkey % 3 = 0 THEN '/test_' ELSE '/' END || p_partkey || '.py'"


def parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", F.expr(REL).alias("rel"))


@query("path_predicates", f"""
WITH p AS (SELECT p_partkey, {REL_SQL} AS rel FROM part)
SELECT p_partkey, (p_partkey % 7 = 0 OR p_partkey % 3 = 0) AS test, (p_partkey % 7 = 0 OR p_partkey % 5 = 0) AS bench,
  (starts_with(rel, 'src/small/') OR starts_with(rel, 'benches/')) AS inside FROM p""")
def path_predicates(spark, sf):
    rel = F.col("rel")
    return parts(spark, sf).select("p_partkey", is_test_path(rel).alias("test"), is_bench_path(rel).alias("bench"), under(rel, ["src/small/", "benches"]).alias("inside"))


@query("kind_scan", """
SELECT 'k' || p_size % 4 AS kind, count(*) AS n, count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 3 <> 0) AS prod FROM part GROUP BY 1""")
def kind_scan(spark, sf):
    facts = rules.Facts(parts(spark, sf).withColumn("kind", F.concat(F.lit("k"), F.col("p_size") % 4)))
    kinds = [(facts(f"k{k}", prod=False).agg(F.count("*").alias("n")), facts(f"k{k}").agg(F.count("*").alias("prod"))) for k in range(4)]
    rows = [a.crossJoin(b).select(F.lit(f"k{k}").alias("kind"), "n", "prod").where("n > 0") for k, (a, b) in enumerate(kinds)]
    return world.united(rows)


@query("unique_lookup", """
SELECT l_orderkey, l_returnflag, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) = 1""")
def unique_lookup(spark, sf):
    return lo.unique_or_null(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"], "l_suppkey")


@query("reach_from", """
WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey > o_custkey), s AS (SELECT DISTINCT o_orderkey AS src FROM orders WHERE o_orderstatus = 'P'),
r(src, dst) AS (SELECT e.src, e.dst FROM e JOIN s USING (src) UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r""")
def reach_from(spark, sf):
    o = table(spark, sf, "orders")
    return graph.reach(o.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")).where("src > dst"), o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("src")))


@query("condensation_levels", """
WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey > o_custkey),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node)
SELECT node, node AS scc, max(level)::INTEGER AS level FROM r GROUP BY 1""")
def condensation_levels(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.condensation(o.where("src > dst"))[0]


@query("per_file_verdicts", """
WITH c AS (SELECT d.source, count(*) AS n, sum(l.quality)::BIGINT AS tp FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1)
SELECT source, n, tp, CASE WHEN n < 5 THEN 'THIN' WHEN tp::DOUBLE / n < 0.6::DOUBLE THEN 'FAIL' ELSE 'PASS' END AS verdict FROM c""")
def per_file_verdicts(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    counts = d.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("tp"))
    return mo.judged(counts, 0.6, 5)


@query("p_real_by_tier", """
WITH s AS (SELECT d.source, count(*) AS n, sum(l.quality)::BIGINT AS tp, CASE WHEN d.source LIKE '%0' THEN 0.95::DOUBLE WHEN d.source LIKE '%1' THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS bar
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1, 4),
m AS (SELECT source, n, tp::DOUBLE + 4.0::DOUBLE * bar AS a, (n - tp)::DOUBLE + 4.0::DOUBLE * (1.0::DOUBLE - bar) AS b FROM s)
SELECT source, round(CASE WHEN n >= 5 THEN a / (a + b) - sqrt((a / (a + b)) * (1.0::DOUBLE - a / (a + b)) / (a + b + 1.0::DOUBLE)) ELSE 0.0::DOUBLE END, 9) AS p FROM m""")
def p_real_by_tier(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    s = d.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("tp"))
    tier = F.when(F.col("source").endswith("0"), "PROVEN").when(F.col("source").endswith("1"), "STRONG").otherwise("MODERATE")
    return s.select("source", F.round(p_real(F.col("n") >= 5, F.col("tp"), F.col("n"), tier), 9).alias("p"))


@query("doc_headers", """
WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10))[1:3], lambda x: '# ' || x) AS a FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_filter(list_transform(a, lambda x: trim(regexp_replace(x, '^#+', ''))), lambda x: x <> '' AND NOT regexp_matches(x, '^[-=*_~/# ]*$')
  AND NOT regexp_matches(x, '(?i)^(?:!|-\\*-|noqa\\b|coding[:=]|[\\w.-]+:\\s*(?:ignore|noqa|disable|enable|skip|off|on)\\b)')) AS p FROM d)
SELECT doc_id, len(p) > 0 AND len(list_filter(p, lambda x: regexp_matches(x, '(?i)copyright|licen[sc]e|SPDX|warrant'))) = 0 AS told FROM s""".replace("\\\\", "\\"))
def doc_headers(spark, sf):
    lines = F.transform(F.slice(F.split("text", "\n"), 1, 3), lambda x: F.concat(F.lit("# "), x))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.reads_as_doc(lines).alias("told"))


@query("phase_labels", r"""
WITH l AS (SELECT doc_id, '# ' || CASE WHEN doc_id % 3 = 0 THEN 'Step ' || doc_id || ' ' ELSE '' END || unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(t, '(?i)^(?:#)+\s*((step|phase|stage|part)\s*\d|\d+[.):]\s|[-=*#]{3,})')) AS labels FROM l GROUP BY 1""")
def phase_labels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    step = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Step "), "doc_id", F.lit(" "))).otherwise("")
    hit = text.is_phase_label(F.concat(F.lit("# "), step, "t"))
    return d.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(F.when(hit, 1)).alias("labels"))


@query("line_ages", """
WITH p AS (SELECT user_id AS rel, event_id AS line, 86400 * (event_id % 400) AS ts FROM events),
s AS (SELECT event_type AS grp, user_id AS rel, event_id AS lo, event_id + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS hi FROM events),
c AS (SELECT s.*, unnest(range(lo, hi + 1)) AS at FROM s), m AS (SELECT c.grp, max(p.ts) AS ts, bool_and(p.ts IS NOT NULL) AS known FROM c LEFT JOIN p ON p.rel = c.rel AND p.line = c.at GROUP BY 1)
SELECT grp AS "group", CASE WHEN known THEN (100000000 - ts) // 86400 END::BIGINT AS days FROM m""")
def line_ages(spark, sf):
    e = table(spark, sf, "events")
    lines = e.select(F.col("user_id").alias("rel"), F.col("event_id").alias("line"), (F.col("event_id") % 400 * 86400).alias("ts"))
    spans = e.select(F.col("event_type").alias("group"), F.col("user_id").alias("rel"), F.col("event_id").alias("lo"), (F.col("event_id") + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).alias("hi"))
    return git.youngest_ages(spans, lines, 100_000_000)


@query("marker_lines", r"""
WITH l AS (SELECT doc_id AS rel, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
m AS (SELECT rel, line, CASE WHEN line % 4 = 0 THEN '  # loom allow: a, b' WHEN line % 4 = 1 THEN t || ' # loom allow-file: c' WHEN line % 4 = 2 THEN t || ' # loom  allow: d' ELSE t END AS t FROM l),
h AS (SELECT rel, line % 4 AS k, line, unnest(CASE line % 4 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['c'] ELSE ['d'] END) AS name FROM m WHERE line % 4 <> 3)
SELECT DISTINCT rel, CASE k WHEN 0 THEN line + 1 WHEN 1 THEN 0 ELSE line END::INTEGER AS line, name FROM h""")
def marker_lines(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("rel"), F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("line", F.col("line") + 1)
    k = F.col("line") % 4
    said = F.when(k == 0, "  # loom allow: a, b").when(k == 1, F.concat("t", F.lit(" # loom allow-file: c"))).when(k == 2, F.concat("t", F.lit(" # loom  allow: d"))).otherwise(F.col("t"))
    return fo.marker_table(d.select("rel", "line", said.alias("text")), r"#\s*loom", "#")


@query("merged_baseline", """
WITH r AS (SELECT o_orderpriority AS rule, 'c' || o_custkey AS symbol, o_orderkey % 5 + 1 AS n, substr(md5(o_orderkey::VARCHAR), 1, 16) AS shape FROM orders)
SELECT rule, symbol, max(n) AS "count", arg_max(shape, (n, shape)) AS shape FROM r GROUP BY 1, 2""")
def merged_baseline(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderpriority").alias("rule"), F.concat(F.lit("c"), "o_custkey").alias("symbol"), (F.col("o_orderkey") % 5 + 1).alias("count"), F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 16).alias("shape"))
    return fo.merge_baseline(rows, ["rule", "symbol"])


@query("line_split", """
WITH l AS (SELECT doc_id, string_split(text || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END, chr(10)) AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END)::INTEGER AS lines FROM l""")
def line_split(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    whole = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n").otherwise(""))
    return d.select("doc_id", F.size(text.source_lines(whole)).alias("lines"))


@query("string_semantics", r"""
WITH p AS (SELECT page_id, ' ' || chr(9) || url || chr(10) AS t, url FROM pages)
SELECT page_id, url AS stripped, 3 AS pieces, split_part(url, '/', 1) AS head, substr(url, instr(url, '/') + 1) AS tail, reverse(split_part(reverse(url), '/', 1)) AS last,
  CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS bare,
  regexp_matches(reverse(split_part(reverse(url), '/', 1)), '^[0-9]+$') AS digits, regexp_matches(split_part(url, '/', 4), '^[A-Za-z_][A-Za-z0-9_]*$') AS name FROM p""")
def string_semantics(spark, sf):
    t = F.concat(F.lit(" \t"), "url", F.lit("\n"))
    url = pytext.strip(t)
    last = pytext.rpartition(url, "/")["tail"]
    # three lines: a file separator and a line separator end one each, and so does the last newline
    lines = F.size(pytext.splitlines(F.concat(F.lit("a\x1cb "), "url", F.lit("\n"))))
    return table(spark, sf, "pages").select(
        "page_id", url.alias("stripped"), lines.alias("pieces"), pytext.partition(url, "/")["head"].alias("head"), pytext.partition(url, "/")["tail"].alias("tail"), last.alias("last"),
        pytext.removeprefix(url, "https://").alias("bare"), pytext.is_digit(last).alias("digits"), pytext.is_identifier(F.get(F.split(url, "/"), 3)).alias("name"),
    )


@query("normal_paths", f"""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '/' ELSE '' END || replace({REL_SQL}, '/x/', '/') AS path,
  CASE WHEN p_partkey % 4 = 0 THEN '/' || {REL_SQL} ELSE 'base/' || {REL_SQL} END AS joined FROM part""")
def normal_paths(spark, sf):
    rooted = F.when(F.col("p_partkey") % 4 == 0, "/").otherwise("")
    messy = F.concat(rooted, F.regexp_replace("rel", "/", "/./zz/..//"))
    base = F.when(F.col("p_partkey") % 2 == 0, "base/").otherwise("base")
    return parts(spark, sf).select("p_partkey", pytext.normpath(messy).alias("path"), pytext.posix_join(base, F.concat(rooted, "rel")).alias("joined"))


@query("type_unions", """
WITH u AS (SELECT l_orderkey, l_linenumber, ['str', CASE WHEN l_returnflag = 'R' THEN 'None' ELSE 'int' END, CASE WHEN l_linestatus = 'O' THEN 'list[A | B]' ELSE 'str' END] AS m, l_returnflag = 'A' AND l_linestatus = 'O' AS dark FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT dark THEN array_to_string(list_sort(list_distinct(m)), ' | ') END AS type FROM u""")
def type_unions(spark, sf):
    member = F.concat_ws(
        " | ", F.lit("Literal['x, y', \"|\"]"), F.when(F.col("l_returnflag") == "R", "None").otherwise("Literal[-3]"), F.when(F.col("l_linestatus") == "O", "list[A | B]").otherwise("str"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "Unknown"),
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", typestrings.joined_union(member).alias("type"))


@query("precision_arms", """
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'py' ELSE 'rs' END AS lang, (o_custkey % 3 + 1)::VARCHAR AS rule, CASE o_orderkey % 4 WHEN 0 THEN 'clone:x' WHEN 1 THEN 'clone-block:y' WHEN 2 THEN 'clone' ELSE 'z' END AS cause FROM orders),
t(key, tp, n) AS (VALUES ('1', 10, 20), ('1:clone', 9, 9), ('rs:1', 3, 4), ('rs:2:clone-block', 1, 2), ('2:clone:x', 7, 8))
SELECT f.o_orderkey, coalesce(a.tp, b.tp)::BIGINT AS tp, coalesce(a.n, b.n)::BIGINT AS n FROM f
LEFT JOIN t a ON a.key LIKE '%' || f.rule || ':%' AND starts_with(a.key, CASE WHEN lang = 'py' THEN '' ELSE 'rs:' END || f.rule || ':') AND (CASE WHEN lang = 'py' THEN '' ELSE 'rs:' END || f.rule || ':' || f.cause = a.key OR starts_with(CASE WHEN lang = 'py' THEN '' ELSE 'rs:' END || f.rule || ':' || f.cause, a.key || ':'))
LEFT JOIN t b ON b.key = CASE WHEN lang = 'py' THEN '' ELSE 'rs:' END || f.rule""")
def precision_arms(spark, sf):
    o = table(spark, sf, "orders")
    cause = F.element_at(F.array(*map(F.lit, ("clone:x", "clone-block:y", "clone", "z"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    found = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "py").otherwise("rs").alias("lang"), (F.col("o_custkey") % 3 + 1).cast("string").alias("rule"), cause.alias("cause"))
    table_ = spark.createDataFrame([("1", 10, 20), ("1:clone", 9, 9), ("rs:1", 3, 4), ("rs:2:clone-block", 1, 2), ("2:clone:x", 7, 8)], "rule string, tp long, n long")
    return by_arm(found, table_).select("o_orderkey", "tp", "n")


@query("module_importers", """
SELECT 'm' || l_partkey AS module, array_to_string(list_sort(list(DISTINCT 'm' || l_suppkey)), ',') AS importers FROM lineitem GROUP BY 1""")
def module_importers(spark, sf):
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("m"), "l_suppkey").alias("src"), F.concat(F.lit("m"), "l_partkey").alias("dst"))
    return world.importers(e).select("module", F.array_join("importers", ",").alias("importers"))


HOME = "CASE WHEN doc_id % 11 = 0 THEN 'm' || doc_id || '.py' ELSE 'p' || doc_id % 5 || '/q' || doc_id % 3 || '/m' || doc_id || '.py' END"


@query("shared_homes", f"""
WITH m AS (SELECT 'd' || doc_id AS module, doc_id, {HOME} AS rel FROM documents),
i AS (SELECT DISTINCT m.doc_id % 5 AS p, m.doc_id % 3 AS q FROM m WHERE doc_id % 11 <> 0 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT module, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 5 = 1 AND doc_id % 3 = 2 THEN 'p1/q2' WHEN doc_id % 5 = 1 THEN 'p1' WHEN doc_id % 5 = 2 AND doc_id % 3 = 0 THEN ''
  WHEN i.p IS NOT NULL THEN 'p' || doc_id % 5 || '/q' || doc_id % 3 ELSE rel END AS home FROM m LEFT JOIN i ON i.p = doc_id % 5 AND i.q = doc_id % 3 AND doc_id % 11 <> 0""")
def shared_homes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    rel = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("m"), "doc_id", F.lit(".py"))).otherwise(F.concat(F.lit("p"), F.col("doc_id") % 5, F.lit("/q"), F.col("doc_id") % 3, F.lit("/m"), "doc_id", F.lit(".py")))
    mods = d.select(F.concat(F.lit("d"), "doc_id").alias("module"), rel.alias("rel"))
    extra = spark.createDataFrame([("package", "p2/q0/__init__.py")], "module string, rel string")
    files = spark.createDataFrame([("p1/pyproject.toml",), ("p1/q2/setup.py",), ("README.md",), ("p3/notes.txt",)], "rel string")
    edges = table(spark, sf, "labels").where("toxic = 1").select(F.lit("x").alias("src"), F.concat(F.lit("d"), "doc_id").alias("dst"))
    return world.shared_homes(mods.union(extra), files, edges).where("module <> 'package'")


@query("published_names", """
WITH RECURSIVE s AS (SELECT o_orderkey AS symbol, CASE WHEN o_custkey < o_orderkey AND o_orderkey % 4 <> 0 THEN o_custkey END AS parent, o_orderkey % 5 <> 0 AS cls, o_orderstatus <> 'P' AS pub, o_orderpriority AS module FROM orders),
r(src, up) AS (SELECT symbol, parent FROM s WHERE parent IS NOT NULL UNION SELECT r.src, s.parent FROM r JOIN s ON s.symbol = r.up WHERE s.parent IS NOT NULL),
b AS (SELECT DISTINCT r.src FROM r JOIN s ON s.symbol = r.up WHERE NOT s.cls)
SELECT symbol FROM s WHERE pub AND module <> '1-URGENT' AND symbol NOT IN (SELECT src FROM b)""")
def published_names(spark, sf):
    o = table(spark, sf, "orders")
    s = o.select(
        F.col("o_orderkey").alias("symbol"), F.when((F.col("o_custkey") < F.col("o_orderkey")) & (F.col("o_orderkey") % 4 != 0), F.col("o_custkey")).alias("parent"),
        F.when(F.col("o_orderkey") % 5 != 0, "class").otherwise("function").alias("kind"), (F.col("o_orderstatus") != "P").alias("public"), F.col("o_orderpriority").alias("module"),
    )
    return world.published(s, s.where("module <> '1-URGENT'").select("module")).select("symbol")


@query("hot_root_names", """
SELECT p_partkey || '.' || p_name AS symbol FROM part WHERE p_name LIKE 'hot%' OR p_name LIKE '%bolt' OR (p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 AND p_size % 10 = 0)""")
def hot_root_names(spark, sf):
    p = parts(spark, sf).join(table(spark, sf, "part").select("p_partkey", F.concat("p_partkey", F.lit("."), "p_name").alias("symbol")), "p_partkey")
    said = F.when(F.col("p_size") % 10 == 0, "Runs per row of the table.").otherwise("Runs as often as asked.")
    return world.hot_roots(p.select("symbol", "rel"), p.select("symbol", said.alias("value")), ["*.hot*", "*bolt", "zz*"])[0]


@query("judged_calls", """
WITH s AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'unresolved' END AS resolution, CASE WHEN event_id % 3 = 0 THEN 'own' END AS target FROM events),
j AS (SELECT event_id, event_id % 5 AS k FROM events WHERE event_id % 2 = 0)
SELECT s.event_id, CASE WHEN resolution = 'resolved' OR k IS NULL OR k = 4 THEN resolution WHEN k = 0 THEN 'external' WHEN k IN (1, 2) THEN 'resolved' ELSE 'ambiguous' END AS resolution,
  CASE WHEN resolution = 'resolved' OR k IS NULL OR k = 4 THEN target WHEN k IN (1, 2) THEN 't' || k END AS target FROM s LEFT JOIN j USING (event_id)""")
def judged_calls(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("rel"), F.col("event_id").alias("line"), F.lit(0).alias("col"), F.col("event_id").alias("end_line"), F.lit(4).alias("end_col"), "event_id",
        F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("unresolved").alias("resolution"), F.when(F.col("event_id") % 3 == 0, "own").alias("target"),
    )
    k = F.col("event_id") % 5
    none = F.expr("cast(array() as array<string>)")
    name = F.concat(F.lit("t"), k)
    told = F.when(k.isin(1, 2), F.array(name, name)).when(k == 3, F.array(name, F.lit("t9"))).otherwise(none)
    edges = e.where("event_id % 2 = 0").select("rel", "line", "col", "end_line", "end_col", told.alias("targets"), F.when(k == 0, F.array(F.lit("os.path"))).otherwise(none).alias("external"))
    return resolve.judged(e, edges).select("event_id", "resolution", "target")


@query("standing_errors", """
WITH d AS (SELECT event_id, user_id, event_type FROM events), b AS (SELECT DISTINCT user_id FROM d WHERE event_type = 'error' AND event_id % 10 = 0)
SELECT event_id FROM d WHERE (event_type IN ('click', 'error') OR (event_type = 'view' AND event_id % 2 = 0)) AND user_id NOT IN (SELECT user_id FROM b) AND event_id % 7 <> 0""")
def standing_errors(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 10 == 0), checker.MISSING_IMPORT).when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), checker.WARNINGS[0]).otherwise("reportOther")
    severity = F.when(F.col("event_type").isin("click", "error"), "error").otherwise("warning")
    told = e.select("event_id", F.col("user_id").cast("string").alias("rel"), F.col("event_id").alias("line"), kind.alias("rule"), severity.alias("severity"))
    facts = e.where("event_id % 7 = 0").select(F.lit("comment").alias("kind"), F.col("user_id").cast("string").alias("rel"), F.col("event_id").alias("line"), F.lit("# type: ignore").alias("value"))
    return checker.errors(told, facts).select("event_id")


@query("effect_classes", """
WITH c AS (SELECT page_id, regexp_replace(replace(regexp_replace(url, '^https?://', ''), '/', '.'), '\\.$', '') AS target FROM pages),
k(key, e) AS (VALUES ('www', 'a'), ('m', 'b'), ('m', 'c'), ('www.example', 'd'), ('.fr', 'z'))
SELECT c.page_id, coalesce((SELECT string_agg(DISTINCT e, ',' ORDER BY e) FROM k WHERE key = (SELECT arg_max(key, length(key)) FROM k WHERE NOT starts_with(key, '.') AND (c.target = key OR starts_with(c.target, key || '.')))),
  (SELECT string_agg(DISTINCT e, ',' ORDER BY e) FROM k WHERE starts_with(key, '.') AND '.' || reverse(split_part(reverse(c.target), '.', 1)) = key)) AS effects FROM c""".replace("\\\\", "\\"))
def effect_classes(spark, sf):
    target = F.regexp_replace(F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(".")), r"\.$", "")
    names = effects.catalog(spark, {"a": "www", "b": "m", "c": "m", "d": "www.example", "z": ".fr"})
    return effects.classified(table(spark, sf, "pages").select("page_id", target.alias("target")), names).select("page_id", F.array_join("effects", ",").alias("effects"))


@query("handler_outcomes", """
WITH h AS (SELECT user_id AS symbol, unnest(CASE WHEN event_id % 2 = 0 THEN ['A'] ELSE ['A', 'B'] END) AS caught, event_type AS outcome FROM events)
SELECT symbol, caught, array_to_string(list_sort(list(DISTINCT outcome)), ',') AS outcomes FROM h GROUP BY 1, 2""")
def handler_outcomes(spark, sf):
    a, b = F.array(F.lit("A")), F.array(F.lit("A"), F.lit("B"))
    facts = table(spark, sf, "events").select(F.lit("handler").alias("kind"), F.col("user_id").alias("symbol"), F.when(F.col("event_id") % 2 == 0, a).otherwise(b).alias("items"), F.col("event_type").alias("value"))
    return effects.handler_outcomes(facts).select("symbol", "caught", F.array_join("outcomes", ",").alias("outcomes"))


@query("ambient_filter", """
WITH g AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, list(DISTINCT l_partkey) AS items FROM lineitem GROUP BY 1), h AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS held FROM lineitem GROUP BY 1),
w AS (SELECT DISTINCT g.l_orderkey FROM g, unnest(g.items) AS u(i) JOIN h ON h.l_partkey = u.i WHERE h.held > 8 * g.n)
SELECT l_orderkey AS symbol, n::INTEGER AS owners FROM g WHERE l_orderkey NOT IN (SELECT l_orderkey FROM w)""")
def ambient_filter(spark, sf):
    li = table(spark, sf, "lineitem")
    groups = li.groupBy(F.col("l_orderkey").alias("symbol")).agg(F.collect_set("l_suppkey").alias("owners"), F.collect_set("l_partkey").alias("items"))
    params = li.select(F.col("l_orderkey").alias("symbol"), F.col("l_partkey").alias("name")).distinct()
    return rules.ambient_free(groups, params).select("symbol", F.size("owners").alias("owners"))


@query("one_fact_groups", """
SELECT l_orderkey AS key FROM lineitem GROUP BY 1
HAVING count(DISTINCT CASE WHEN l_linenumber <> 4 THEN l_returnflag END) <= 1 AND count(DISTINCT CASE WHEN l_linenumber <> 4 THEN l_linestatus END) <= 1""")
def one_fact_groups(spark, sf):
    li = table(spark, sf, "lineitem")
    return rules.one_fact(li.select(F.col("l_orderkey").alias("key"), F.array("l_returnflag").alias("types"), F.col("l_linestatus").alias("home"), (F.col("l_linenumber") == 4).alias("is_test")))


@query("retired_rules", """
WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '#1' || p_size ELSE 'after #1' || p_size END || CASE WHEN p_partkey % 3 = 0 THEN ' cut' ELSE ' kept' END AS decision FROM part),
n AS (SELECT * FROM d WHERE regexp_matches(decision, '#17([^0-9]|$)') AND decision LIKE '%cut%')
SELECT p_partkey FROM n WHERE starts_with(decision, '#17') OR NOT EXISTS (SELECT 1 FROM n WHERE starts_with(decision, '#17'))""")
def retired_rules(spark, sf):
    p = table(spark, sf, "part")
    lead = F.when(F.col("p_partkey") % 2 == 0, F.lit("#1")).otherwise("after #1")
    decision = F.concat(lead, F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " cut").otherwise(" kept"))
    return fs.retired(p.select("p_partkey", decision.alias("decision")), "17").select("p_partkey")


@query("best_groups", """
WITH i AS (SELECT l_orderkey AS o, list_sort(list(DISTINCT l_suppkey)) AS owners, list_sort(list(DISTINCT l_partkey)) AS items FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY owners[1] ORDER BY len(owners) DESC, len(items) DESC, array_to_string(items, ',') DESC) AS k FROM i)
SELECT owners[1] AS anchor, array_to_string(items, ',') AS items FROM r WHERE k = 1""")
def best_groups(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("owners"), F.sort_array(F.collect_set("l_partkey")).alias("items"))
    out = mining.best_per_anchor(g.select("owners", "items"))
    return out.select(F.element_at("owners", 1).alias("anchor"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))
