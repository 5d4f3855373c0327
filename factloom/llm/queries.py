"""One registered query per training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import JaccardJoin

    return JaccardJoin(shingle=4, percent=85).classes(table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import LanguageIdentifier, fold

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold() == 2, F.lit(False))
    ident = LanguageIdentifier().fit(docs.where(~held_out))
    out = ident.annotate(docs, keep=[F.col("doc_id"), held_out.alias("held_out")])
    return out.withColumnRenamed("lang_score", "score")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import HilbertPacker

    pieces = HilbertPacker(word_bpe(), length=2048, end_id=1).pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import SubstringDedup

    out = SubstringDedup(window=13).clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import TopKSearch

    return TopKSearch(k=5, scale=256).search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL["op7_topk_search"] = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import Fingerprinter

    docs = table(spark, sf_dir, "documents")
    maker = Fingerprinter()
    return maker.edited(docs, maker.fit(docs))


def every_line():
    """Line dedup of all lines that are not empty; those that can be cut into
    segments are compared for likeness, too."""
    from .line_dedup import LineDedup

    return LineDedup(near_chars=3, exact_chars=1, short_chars=12)


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = every_line().clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_kept", "lines_dropped", F.sha2("text", 256).alias("kept_sha256"))

# weights of the mix, by level and name; names not listed weigh 1
MIX_WEIGHTS = {("domain", "web"): 4, ("domain", "books"): 3, ("domain", "code"): 2, ("domain", "forum"): 1, ("lang", "en"): 5, ("lang", "de"): 2, ("lang", "fr"): 2}
MIX_DOMAINS = ("web", "books", "code", "forum")


def source_domain():
    """The domain of a source: its number, modulo the domains; web without one."""
    n = F.coalesce(F.regexp_extract("source", r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % len(MIX_DOMAINS)
    return F.element_at(F.array(*map(F.lit, MIX_DOMAINS)), n + 1)


def mixture():
    from .mixing import MixtureBudget

    levels = {"domain": source_domain(), "lang": F.col("lang"), "source": F.col("source")}
    return MixtureBudget(levels, MIX_WEIGHTS, max_epochs=2, seed=11)


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture().select(table(spark, sf_dir, "documents"), percent=80)
    return out.select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_epoch", "mix_tokens", "mix_taken")


def _split_sql(tier: str, parents: str, name: str, out: str) -> str:
    """One level of the budget: tier (parents..., name, supply, w, given) to out (..., got)."""
    by = f"PARTITION BY {parents}" if parents else ""
    order = f"{by} ORDER BY ratio ASC NULLS FIRST, {name}"
    return f"""
{out}_a AS (SELECT *, CASE WHEN w > 0 THEN supply::DOUBLE / w END AS ratio FROM {tier}),
{out}_b AS (SELECT *, coalesce(sum(supply) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM {out}_a),
{out}_c AS (SELECT *, (w <= 0 OR supply * rest_w <= (given - spent) * w) AS spent_up FROM {out}_b),
{out}_d AS (SELECT *, given - coalesce(sum(CASE WHEN spent_up THEN supply END) OVER ({by}), 0) AS rest,
  sum(CASE WHEN NOT spent_up THEN w END) OVER ({by}) AS pool,
  sum(CASE WHEN NOT spent_up THEN w ELSE 0 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {out}_c),
{out} AS (SELECT *, CASE WHEN spent_up THEN supply ELSE (rest * upto) // pool - (rest * (upto - w)) // pool END AS got FROM {out}_d)"""


def _weight_sql(level: str, column: str) -> str:
    rows = " ".join(f"WHEN {column} = '{name}' THEN {w}" for (lv, name), w in sorted(MIX_WEIGHTS.items()) if lv == level)
    return f"(CASE {rows} ELSE 1 END)" if rows else "1"


ORACLE_SQL["op2_mixing"] = rf"""
WITH d AS (SELECT doc_id, ['web', 'books', 'code', 'forum'][coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INTEGER), 0) % 4 + 1] AS dom,
    coalesce(lang, '(null)') AS lng, coalesce(source, '(null)') AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::HUGEINT AS n FROM documents),
leaf AS (SELECT dom, lng, src, sum(n) AS tokens, 2 * sum(n) AS supply FROM d GROUP BY ALL),
top AS (SELECT dom, sum(supply) AS supply, {_weight_sql("domain", "dom")}::HUGEINT AS w,
  least((SELECT sum(n) * 80 // 100 FROM d), sum(sum(supply)) OVER ()) AS given FROM leaf GROUP BY dom),
{_split_sql("top", "", "dom", "l1")},
mid AS (SELECT leaf.dom, lng, sum(leaf.supply) AS supply, {_weight_sql("lang", "lng")}::HUGEINT AS w, any_value(l1.got) AS given
  FROM leaf JOIN l1 USING (dom) GROUP BY leaf.dom, lng),
{_split_sql("mid", "dom", "lng", "l2")},
low AS (SELECT leaf.dom, leaf.lng, src, tokens, leaf.supply, {_weight_sql("source", "src")}::HUGEINT AS w, l2.got AS given FROM leaf JOIN l2 ON l2.dom = leaf.dom AND l2.lng = leaf.lng),
{_split_sql("low", "dom, lng", "src", "l3")},
cut AS (SELECT dom, lng, src, CASE WHEN tokens > 0 THEN got // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN got - (got // tokens) * tokens ELSE got END AS part FROM l3),
p AS (SELECT d.*, cut.epochs, cut.part, md5('11|' || cut.epochs || '|' || doc_id) AS spot FROM d JOIN cut USING (dom, lng, src)),
q AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY dom, lng, src ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
e AS (SELECT dom, lng, src, max(spot) AS last FROM q WHERE part > 0 AND start < part GROUP BY ALL),
t AS (SELECT q.*, e.last, q.epochs + CASE WHEN q.spot <= e.last THEN 1 ELSE 0 END AS times FROM q LEFT JOIN e USING (dom, lng, src)),
x AS (SELECT *, unnest(range(0, times::BIGINT)) AS k FROM t)
SELECT doc_id, dom AS mix_domain, lng AS mix_lang, src AS mix_source, k::INTEGER AS mix_epoch, n::BIGINT AS mix_tokens,
  CASE WHEN k = epochs AND spot = last THEN least(n, part - start) ELSE n END::BIGINT AS mix_taken FROM x
"""


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is chosen; rejected is the same one with its last
    assistant turn replaced by that of the conversation with the next id that is
    there."""
    from .chat_format import following, gathered, preference_pairs

    turns = gathered(table(spark, sf_dir, "conversations"))
    is_answer = F.transform("turns", lambda t: t["role"] == "assistant")
    last = F.size("turns") - F.array_position(F.reverse(is_answer), True).cast("int")  # size, if there is none
    own = turns.withColumn("last", last).withColumn("answer", F.get("turns", F.col("last")))
    other = own.where("answer is not null").select(F.col("conv").alias("next"), F.col("answer.text").alias("instead"))
    both = own.join(following(turns, "conv"), "conv").join(other, "next", "left")
    swapped = F.transform("turns", lambda t, k: F.when(k == F.col("last"), F.struct(t["role"].alias("role"), F.col("instead").alias("text"))).otherwise(t))
    pairs = both.select(F.col("conv").alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("instead").isNotNull(), swapped).alias("rejected"))
    out = preference_pairs(pairs)
    spans = [F.array_join(F.transform(m, lambda x: F.concat_ws("-", x["start"], x["stop"])), " ").alias(m) for m in ("chosen_mask", "rejected_mask")]
    return out.select("pair_id", "prefix_turns", "prompt", "chosen", "rejected", *spans, "status")


ORACLE_SQL["op4_chat_format"] = r"""
WITH t AS (
  SELECT conv_id AS conv, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv, max(k) AS last, arg_max(text, k) AS answer FROM t WHERE role = 'assistant' GROUP BY conv),
x AS (SELECT conv, lead(conv) OVER (ORDER BY conv) AS follower FROM (SELECT DISTINCT conv FROM t)),
s AS (
  SELECT t.*, a.last, n.answer AS instead,
         CASE WHEN t.k = a.last THEN n.answer ELSE t.text END AS other
  FROM t JOIN x ON x.conv = t.conv LEFT JOIN a ON a.conv = t.conv LEFT JOIN a n ON n.conv = x.follower),
p AS (SELECT conv, count(*) AS n, bool_or(instead IS NOT NULL) AS there,
             coalesce(min(CASE WHEN text <> other THEN k END), count(*)) AS prefix FROM s GROUP BY conv),
w AS (
  SELECT s.conv, s.k, s.role, p.prefix, p.there, s.text, s.other,
    '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS shown,
    '<|' || role || '|>' || chr(10) || other || chr(10) || '<|end|>' || chr(10) AS shown_other
  FROM s JOIN p ON p.conv = s.conv),
o AS (
  SELECT *,
    sum(CASE WHEN k >= prefix THEN length(shown) ELSE 0 END) OVER (PARTITION BY conv ORDER BY k) AS stop,
    sum(CASE WHEN k >= prefix THEN length(shown_other) ELSE 0 END) OVER (PARTITION BY conv ORDER BY k) AS stop_other
  FROM w),
g AS (
  SELECT conv, any_value(prefix) AS prefix, any_value(there) AS there, count(*) AS n,
    coalesce(string_agg(CASE WHEN k < prefix THEN shown END, '' ORDER BY k), '') AS prompt,
    coalesce(string_agg(CASE WHEN k >= prefix THEN shown END, '' ORDER BY k), '') AS chosen,
    coalesce(string_agg(CASE WHEN k >= prefix THEN shown_other END, '' ORDER BY k), '') AS rejected,
    coalesce(string_agg(CASE WHEN k >= prefix AND role = 'assistant' THEN (stop - length(text) - 9)::BIGINT || '-' || stop::BIGINT END, ' ' ORDER BY k), '') AS chosen_mask,
    coalesce(string_agg(CASE WHEN k >= prefix AND role = 'assistant' THEN (stop_other - length(other) - 9)::BIGINT || '-' || stop_other::BIGINT END, ' ' ORDER BY k), '') AS rejected_mask,
    coalesce(bool_or(k >= prefix AND role = 'assistant'), false) AS answers
  FROM o GROUP BY conv)
SELECT conv AS pair_id,
  CASE WHEN there THEN prefix ELSE 0 END::INTEGER AS prefix_turns,
  CASE WHEN there THEN prompt ELSE '' END AS prompt, CASE WHEN there THEN chosen ELSE '' END AS chosen,
  CASE WHEN there THEN rejected ELSE '' END AS rejected, CASE WHEN there THEN chosen_mask ELSE '' END AS chosen_mask,
  CASE WHEN there THEN rejected_mask ELSE '' END AS rejected_mask,
  CASE WHEN NOT there THEN 'missing' WHEN prefix = n THEN 'equal' WHEN NOT answers THEN 'no_completion' ELSE 'ok' END AS status
FROM g
"""


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import SuffixDedup

    out = SuffixDedup(least=50).report(table(spark, sf_dir, "documents"))
    shown = F.array_join(F.transform("passages", lambda s: F.concat_ws("-", s["lo"], s["hi"])), " ")
    return out.select("doc_id", "n_repeated", "n_removed", F.col("mate").alias("copy_doc_id"), shown.alias("passages"))


ORACLE_SQL["op1_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos FROM documents),
g AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER f AS k, count(*) OVER f AS c FROM w
      WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT k, min(doc_id) AS least FROM g WHERE c = 13 GROUP BY k),
h AS (SELECT g.*, (c = 13 AND m.least < doc_id) AS hit FROM g LEFT JOIN m USING (k)),
v AS (SELECT doc_id, pos, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h),
r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n, 0)::BIGINT AS n_words, coalesce(r.g, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""

ORACLE_SQL["op5_jaccard_join"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS total FROM t),
g AS (SELECT doc_id, total, string_agg(word, ' ') OVER f AS k, count(*) OVER f AS c, pos FROM w
      WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, k FROM g WHERE c = 4 OR (total < 4 AND pos = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""
