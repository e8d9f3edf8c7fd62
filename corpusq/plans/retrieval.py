"""Retrieval queries: benchmark items over the documents of one source, turns over earlier turns, vectors by label."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusq.operators import evaluation as ev
from corpusq.operators import retrieval as rt
from corpusq.operators import stats
from corpusq.operators import trajectory as tr
from corpusq.operators import visibility as vis
from corpusq.sources.tables import table


def words(c):
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def doc_terms(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("doc"), "source", F.explode(words(F.col("text"))).alias("term"))


def items(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query"), "text", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))


def query_terms(s, d):
    return items(s, d).select("query", "source", F.explode(words(F.col("text"))).alias("term"))


def candidates(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("doc"), "source", F.col("doc_id").alias("ordinal"), "lang")
    return docs.join(items(s, d).select("query", "source"), "source").select("query", "doc", "ordinal", "lang")


def scored(s, d):
    x = rt.bm25(query_terms(s, d), doc_terms(s, d), candidates(s, d), scope="source")
    return x.withColumn("score", F.round("score", 6))


TOK = "tok AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)"
QT = "qt AS (SELECT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark)"
CAND = "cand AS (SELECT item_id AS query, doc_id AS doc, doc_id AS ordinal, lang FROM benchmark JOIN documents ON source = 'src' || CAST(item_id % 20 AS VARCHAR))"
STAT = """tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY 1, 2), len AS (SELECT doc, count(*) AS len FROM tok GROUP BY doc),
 size AS (SELECT query, doc, ordinal, lang, coalesce(len, 0) AS len, count(*) OVER (PARTITION BY query) AS n, avg(coalesce(len, 0)) OVER (PARTITION BY query) AS al FROM cand LEFT JOIN len USING (doc)),
 q AS (SELECT query, term, count(*) AS qtf FROM qt GROUP BY 1, 2),
 hit AS (SELECT size.*, q.term, qtf, tf, count(*) OVER (PARTITION BY size.query, q.term) AS df FROM q JOIN tf ON q.term = tf.term JOIN size ON size.query = q.query AND size.doc = tf.doc)"""
BM = """bm AS (SELECT c.query, c.doc, c.ordinal, c.lang, round(coalesce(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.8 / (tf + 1.8 * (0.25 + 0.75 * len / al))), 0), 6) AS score FROM cand c LEFT JOIN hit h ON c.query = h.query AND c.doc = h.doc GROUP BY 1, 2, 3, 4),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ordinal) AS rank FROM bm)"""


def _bm(sql: str) -> str:
    return f"WITH {TOK}, {QT}, {CAND}, {STAT}, {BM} {sql}"


def agg_tf(s, d):
    return rt.term_frequencies(doc_terms(s, d))


def agg_df(s, d):
    return rt.document_frequencies(doc_terms(s, d))


def agg_avg_len(s, d):
    return candidates(s, d).join(rt.lengths(doc_terms(s, d)), "doc", "left").groupBy("query").agg(F.round(F.avg(F.coalesce("len", F.lit(0))), 6).alias("avg_len"))


def _idf(s, d, f):
    df, n = rt.document_frequencies(doc_terms(s, d)), table(s, d, "documents").agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", F.round(f(F.col("n"), F.col("df")), 6).alias("idf"))


def math_idf_plain(s, d):
    return _idf(s, d, lambda n, df: F.log(n / df))


def math_idf_bm25(s, d):
    return _idf(s, d, lambda n, df: F.log((n - df + 0.5) / (df + 0.5) + 1))


def math_aug_tf(s, d):
    q = query_terms(s, d).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    return q.select("query", "term", F.round(0.5 + 0.5 * F.col("qtf") / F.max("qtf").over(Window.partitionBy("query")), 6).alias("w"))


def join_scores_postings(s, d):
    q = query_terms(s, d).select("query", "term").distinct()
    return q.join(rt.term_frequencies(doc_terms(s, d)), "term").groupBy("query").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))


def q_bm25(s, d):
    return rt.top_k(scored(s, d), 10)


def q_tfidf(s, d):
    x = rt.tfidf(query_terms(s, d), doc_terms(s, d), candidates(s, d), scope="source").withColumn("score", F.round("score", 6))
    return rt.top_k(x, 10)


def top_argsort_desc(s, d):
    return rt.ranked(scored(s, d)).select("query", "doc", "rank")


def top_cut_zero(s, d):
    return rt.top_k(scored(s, d), 1000000, positive=True).select("query", "doc", "rank")


def top_k_slice(s, d):
    return rt.top_k(scored(s, d), 3).select("query", "doc")


def _ranked(s, d):
    return rt.ranked(scored(s, d).join(candidates(s, d).select("query", "doc", "lang"), ["query", "doc"]))


def win_rank_cutoff_distinct(s, d):
    return rt.distinct_cutoff(_ranked(s, d), "lang", 3).select("query", "doc", "rank")


def win_first_occurrence(s, d):
    return rt.first_occurrence(_ranked(s, d), "lang").select("query", "doc", "lang")


def q_sparse_proofs(s, d):
    return rt.first_occurrence(rt.distinct_cutoff(_ranked(s, d), "lang", 2), "lang").select("query", "lang", "rank")


def top_two_stage(s, d):
    return rt.two_stage(scored(s, d), (F.col("doc") % 97).cast("double"), 20, 5).select("query", "doc", "rank")


def q_rerank(s, d):
    x = scored(s, d).withColumn("typed", (F.col("doc") % 7).cast("double"))
    return rt.blended(rt.top_k(x, 10), "typed").select("query", "doc", F.round("blend", 6).alias("blend"), "new_rank")


def top_blend_rerank(s, d):
    x = scored(s, d).withColumn("typed", (F.col("doc") % 3).cast("double"))
    return rt.blended(rt.top_k(x, 20), "typed").where("new_rank <= 5").select("query", "doc")


def _positives(s, d):
    return candidates(s, d).where(F.col("doc") % 11 == F.col("query") % 11).select("query", "doc")


def q_hit_ranks(s, d):
    return rt.hit_ranks(rt.ranked(scored(s, d)), _positives(s, d)).select("query", "doc", "rank")


def _recall(s, d, column):
    x = rt.hit_ranks(rt.ranked(scored(s, d)), _positives(s, d)).select("query", "rank", F.col("doc").alias("gold"))
    return ev.recall_at(x, 20).select(F.round(column, 6).alias("recall"))


def agg_recall_step(s, d):
    return _recall(s, d, "step_recall")


def agg_recall_overall(s, d):
    return _recall(s, d, "overall_recall")


def agg_recall_any(s, d):
    return _recall(s, d, "any_recall")


def agg_rank_eval(s, d):
    x = rt.ranked(scored(s, d)).where(F.col("doc") % 11 == F.col("query") % 11).groupBy("query").agg(F.min("rank").alias("rank"))
    m = ev.rank_quality(x.withColumn("method", F.lit("bm25")))
    return m.select("method", *[F.round(c, 6).alias(c) for c in ("top1", "top5", "median_rank")])


def math_softmax(s, d):
    x = rt.top_k(scored(s, d), 10)
    return x.select("query", "doc", F.round(stats.softmax(F.col("score"), 2.0, "query"), 5).alias("p"))


def math_kl(s, d):
    x = rt.top_k(scored(s, d), 10).withColumn("p", stats.softmax(F.col("score"), 2.0, "query")).withColumn("q", F.lit(0.1))
    return stats.kl(x, "p", "q", "query").select("query", F.round("kl", 5).alias("kl"))


def q_lookup(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("doc"), "source", (F.col("lang") == "en").alias("std"), F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("name"))
    q = items(s, d).select("query", "source", F.slice(words(F.col("text")), 1, 15).alias("goal"), words(F.col("text")).alias("hyps"))
    x = rt.lookup(docs.where("name <> ''").join(q, "source"), "goal", "hyps", "name", "std")
    return x.select("query", "doc", F.col("score").cast("double").alias("score"))


def _turns(s, d):
    return table(s, d, "conversations")


def _visible(s, d):
    t = _turns(s, d)
    q = t.where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("query"), F.col("conv_id").alias("file"), F.col("turn").alias("at"))
    i = t.select(F.struct("conv_id", "turn").alias("item"), F.col("conv_id").alias("file"), F.col("turn").alias("at"))
    deps = t.select(F.col("conv_id").alias("file"), (F.col("conv_id") - 1).alias("depends_on")).distinct()
    return vis.visible(q, i, deps).select(
        F.col("query.conv_id").alias("conv_id"), F.col("query.turn").alias("turn"), F.col("item.conv_id").alias("seen_conv"), F.col("item.turn").alias("seen_turn"), "in_file")


def join_visible_proofs(s, d):
    return _visible(s, d)


def join_visible_premises(s, d):
    return _visible(s, d).groupBy("conv_id", "turn").agg(F.sum(F.col("in_file").cast("long")).alias("inside"), F.sum((~F.col("in_file")).cast("long")).alias("outside"))


def flt_visible_in_file(s, d):
    return _visible(s, d).where("in_file AND seen_turn < turn").select("conv_id", "turn", "seen_turn")


def join_dependencies(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.struct("l_linenumber", "l_suppkey").alias("pos"), F.col("l_suppkey").alias("target"))
    return vis.dependencies(li).select("file", F.array_join("targets", ",").alias("targets"))


def join_interval_overlap(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("value").alias("start"), (F.col("value") + 10).alias("end"), "event_type")
    return vis.overlaps(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), ["user_id"])


def join_ambiguous_nth(s, d):
    e = table(s, d, "events")
    a, b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a")), e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("b"))
    return vis.nth_aligned(a, b, ["user_id"], "a", "b").select("user_id", "a", "b")


def join_idx_or_inline(s, d):
    docs = table(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("len"))
    stored = table(s, d, "labels").select("doc_id", F.col("quality").cast("long").alias("v"))
    return vis.either_or(docs, stored, "doc_id", "v", F.col("len")).select("doc_id", "v")


def join_cache_lookup(s, d):
    docs, lab = table(s, d, "documents"), table(s, d, "labels")
    return docs.join(lab.select("doc_id", F.lit(True).alias("cached")), "doc_id", "left").groupBy(F.coalesce("cached", F.lit(False)).alias("cached")).agg(F.count("*").alias("n"))


def vec_page_read(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))
    req = table(s, d, "benchmark").select(F.col("item_id").alias("request"), F.array(F.col("item_id"), F.col("item_id") + 1, F.col("item_id"), F.lit(3)).alias("ids"))
    return rt.gather(req, v).select("request", F.col("pos").cast("long").alias("pos"), "id", "x")


def _dense(s, d, score):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select("label", F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))
    x = rt.dense(q, e.select("label", F.col("vec_id").alias("doc"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("v")), ["label"], 5, F.round(score, 6))
    return x.select("query", "doc", "score", "rank")


def q_dense_premises(s, d):
    return _dense(s, d, rt.dot(F.col("qv"), F.col("v")))


def q_dense_proofs(s, d):
    """Vectors are steps; three in a row are a proof, and proofs of one number modulo 500 have one text."""
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select("label", F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))
    text = F.concat(F.lit("proof "), (F.floor(F.col("vec_id") / 3) % 500).cast("string"))
    docs = e.select("label", F.col("vec_id").alias("ordinal"), F.col("embedding").alias("v"), text.alias("proof"))
    return rt.dense_groups(q, docs, ["label"], "proof", 5, F.round(rt.cosine(F.col("qv"), F.col("v")), 6)).select("query", "proof", "ordinal", "score", "rank")


def vec_dot(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(rt.dot(F.col("embedding"), F.col("embedding")), 5).alias("dot"))


def win_prefix_concat(s, d):
    t = _turns(s, d).withColumn("i", F.col("turn"))
    return t.select("conv_id", "turn", F.md5(tr.prefix_text("text", "conv_id", "|")).alias("prefix"))


def win_suffix_list(s, d):
    t = _turns(s, d).withColumn("i", F.col("turn"))
    return t.select("conv_id", "turn", F.array_join(tr.suffix_list("role", "conv_id"), ",").alias("rest"))


def _budget(s, d, order):
    size = F.length("text")
    w = Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _turns(s, d).withColumn("used", F.sum(size).over(w)).where("used <= 400").groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max("turn").alias("last"))


def win_token_budget(s, d):
    return _budget(s, d, F.col("turn"))


def win_prev_lines(s, d):
    return _budget(s, d, F.desc("turn"))


def q_prev_proof_recs(s, d):
    w = Window.partitionBy("conv_id", "text").orderBy("turn")
    first = _turns(s, d).withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("k <= 2").select("conv_id", "turn")


def label_matrix(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 8).alias("batch"))
    a, b = e.select("batch", F.col("vec_id").alias("row"), F.col("label").alias("x")), e.select("batch", F.col("vec_id").alias("col"), F.col("label").alias("y"))
    return a.join(b, "batch").select("row", "col", (F.col("x") == F.col("y")).alias("same"))


_TFIDF = f"""WITH {TOK}, {QT}, {CAND}, {STAT}, m AS (SELECT query, max(qtf) AS most FROM q GROUP BY query),
 sc AS (SELECT c.query, c.doc, c.ordinal, round(coalesce(sum((0.5 + 0.5 * qtf / most) * tf / len * ln(n / df) * ln(n / df)), 0), 6) AS score FROM cand c LEFT JOIN (hit JOIN m ON hit.query = m.query) h ON c.query = h.query AND c.doc = h.doc GROUP BY 1, 2, 3)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ordinal) AS rank FROM sc) WHERE rank <= 10""".replace("(hit JOIN m ON hit.query = m.query) h", "(SELECT hit.*, most FROM hit JOIN m ON hit.query = m.query) h")
_CUT = "fo AS (SELECT *, row_number() OVER (PARTITION BY query, lang ORDER BY rank) = 1 AS f FROM rk), seen AS (SELECT *, coalesce(sum(CAST(f AS INT)) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM fo)"
_REC = "p AS (SELECT c.query, c.doc, rank FROM cand c JOIN rk USING (query, doc) WHERE c.doc % 11 = c.query % 11), per AS (SELECT query, count(*) FILTER (WHERE rank <= 20) AS hits, count(*) AS n FROM p GROUP BY query)"
_SOFT = "sm AS (SELECT query, doc, exp((score - max(score) OVER (PARTITION BY query)) / 2.0) AS e FROM rk WHERE rank <= 10), pr AS (SELECT query, doc, e / sum(e) OVER (PARTITION BY query) AS p FROM sm)"
_VIS = """v AS (SELECT q.conv_id, q.turn, i.conv_id AS seen_conv, i.turn AS seen_turn, true AS in_file FROM conversations q JOIN conversations i ON q.conv_id = i.conv_id AND i.turn < q.turn WHERE q.role = 'assistant'
 UNION ALL SELECT q.conv_id, q.turn, i.conv_id, i.turn, false FROM conversations q JOIN conversations i ON i.conv_id = q.conv_id - 1 WHERE q.role = 'assistant')"""
_DENSE = """SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT a.vec_id AS query, b.vec_id AS doc, round({score}, 6) AS score
 FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0)) WHERE rank <= 5"""
_BUD = "SELECT conv_id, count(*) AS n, min(turn) AS first, max(turn) AS last FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn {o} ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 400 GROUP BY conv_id"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"

ORACLE_SQL = {
    "agg_tf": f"WITH {TOK} SELECT doc, term, count(*) AS tf FROM tok GROUP BY 1, 2",
    "agg_df": f"WITH {TOK} SELECT term, count(DISTINCT doc) AS df FROM tok GROUP BY term",
    "agg_avg_len": f"WITH {TOK}, {CAND}, len AS (SELECT doc, count(*) AS len FROM tok GROUP BY doc) SELECT query, round(avg(coalesce(len, 0)), 6) AS avg_len FROM cand LEFT JOIN len USING (doc) GROUP BY query",
    "math_idf_plain": f"WITH {TOK} SELECT term, round(ln((SELECT count(*) FROM documents) / count(DISTINCT doc)), 6) AS idf FROM tok GROUP BY term",
    "math_idf_bm25": f"WITH {TOK} SELECT term, round(ln(((SELECT count(*) FROM documents) - count(DISTINCT doc) + 0.5) / (count(DISTINCT doc) + 0.5) + 1), 6) AS idf FROM tok GROUP BY term",
    "math_aug_tf": f"WITH {QT} SELECT query, term, round(0.5 + 0.5 * n / max(n) OVER (PARTITION BY query), 6) AS w FROM (SELECT query, term, count(*) AS n FROM qt GROUP BY 1, 2)",
    "join_scores_postings": f"WITH {TOK}, {QT}, tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY 1, 2) SELECT query, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens FROM (SELECT DISTINCT query, term FROM qt) JOIN tf USING (term) GROUP BY query",
    "q_bm25": _bm("SELECT query, doc, ordinal, score, rank FROM rk WHERE rank <= 10"),
    "q_tfidf": _TFIDF,
    "top_argsort_desc": _bm("SELECT query, doc, rank FROM rk"),
    "top_cut_zero": _bm("SELECT query, doc, rank FROM rk WHERE score > 0"),
    "top_k_slice": _bm("SELECT query, doc FROM rk WHERE rank <= 3"),
    "win_rank_cutoff_distinct": _bm("SELECT query, doc, rank FROM seen WHERE b < 3").replace(" SELECT query, doc, rank FROM seen", f", {_CUT} SELECT query, doc, rank FROM seen"),
    "win_first_occurrence": _bm("SELECT query, doc, lang FROM fo WHERE f").replace(" SELECT query, doc, lang FROM fo", f", {_CUT} SELECT query, doc, lang FROM fo"),
    "q_sparse_proofs": _bm("SELECT query, lang, rank FROM seen WHERE b < 2 AND f").replace(" SELECT query, lang, rank FROM seen", f", {_CUT} SELECT query, lang, rank FROM seen"),
    "top_two_stage": _bm("SELECT query, doc, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc % 97 DESC, rank) AS n FROM rk WHERE rank <= 20) WHERE n <= 5"),
    "q_rerank": _bm("SELECT query, doc, round(bl, 6) AS blend, row_number() OVER (PARTITION BY query ORDER BY bl DESC, rank) AS new_rank FROM (SELECT *, count(*) OVER (PARTITION BY query) - rank + 1 + 5.0 * (doc % 7) AS bl FROM rk WHERE rank <= 10)"),
    "top_blend_rerank": _bm("SELECT query, doc FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bl DESC, rank) AS n FROM (SELECT *, count(*) OVER (PARTITION BY query) - rank + 1 + 5.0 * (doc % 3) AS bl FROM rk WHERE rank <= 20)) WHERE n <= 5"),
    "q_hit_ranks": _bm("SELECT query, doc, rank FROM rk WHERE doc % 11 = query % 11"),
    "agg_recall_step": _bm("SELECT round(avg(CAST(hits = n AS INT)), 6) AS recall FROM per").replace(" SELECT round(avg(CAST(hits = n", f", {_REC} SELECT round(avg(CAST(hits = n"),
    "agg_recall_overall": _bm("SELECT round(sum(hits) / sum(n), 6) AS recall FROM per").replace(" SELECT round(sum(hits)", f", {_REC} SELECT round(sum(hits)"),
    "agg_recall_any": _bm("SELECT round(avg(CAST(hits > 0 AS INT)), 6) AS recall FROM per").replace(" SELECT round(avg(CAST(hits >", f", {_REC} SELECT round(avg(CAST(hits >"),
    "agg_rank_eval": _bm("SELECT 'bm25' AS method, round(avg(CAST(r = 1 AS INT)), 6) AS top1, round(avg(CAST(r <= 5 AS INT)), 6) AS top5, round(median(r), 6) AS median_rank FROM (SELECT query, min(rank) AS r FROM rk WHERE doc % 11 = query % 11 GROUP BY query)"),
    "math_softmax": _bm("SELECT query, doc, round(p, 5) AS p FROM pr").replace(" SELECT query, doc, round(p", f", {_SOFT} SELECT query, doc, round(p"),
    "math_kl": _bm("SELECT query, round(sum(p * (ln(p) - ln(0.1))), 5) AS kl FROM pr GROUP BY query").replace(" SELECT query, round(sum(p", f", {_SOFT} SELECT query, round(sum(p"),
    "q_lookup": "SELECT query, doc, CAST((CASE WHEN list_contains(w[1:15], name) THEN 1.0 ELSE 0.7 END) * (CASE WHEN std THEN 0.5 ELSE 1.0 END) AS DOUBLE) AS score FROM (SELECT doc_id AS doc, source, lang = 'en' AS std, regexp_extract_all(lower(text), '[a-z]+')[1] AS name FROM documents) d JOIN (SELECT item_id AS query, 'src' || CAST(item_id % 20 AS VARCHAR) AS source, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark) q USING (source) WHERE list_contains(w, name)",
    "join_visible_proofs": f"WITH {_VIS} SELECT * FROM v",
    "join_visible_premises": f"WITH {_VIS} SELECT conv_id, turn, count(*) FILTER (WHERE in_file) AS inside, count(*) FILTER (WHERE NOT in_file) AS outside FROM v GROUP BY 1, 2",
    "flt_visible_in_file": f"WITH {_VIS} SELECT conv_id, turn, seen_turn FROM v WHERE in_file",
    "join_dependencies": "SELECT file, string_agg(t, ',' ORDER BY n, t) AS targets FROM (SELECT l_orderkey AS file, CAST(l_suppkey AS VARCHAR) AS t, min(l_linenumber * 1000000 + l_suppkey) AS n FROM lineitem WHERE l_orderkey <> l_suppkey GROUP BY 1, 2) GROUP BY file",
    "join_interval_overlap": "SELECT a.user_id, a.event_id AS id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND a.value < b.value + 10 AND b.value < a.value + 10",
    "join_ambiguous_nth": "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.n = b.n AND a.event_type = 'purchase' AND b.event_type = 'click'",
    "join_idx_or_inline": "SELECT doc_id, coalesce(CAST(quality AS BIGINT), length(text)) AS v FROM documents LEFT JOIN labels USING (doc_id)",
    "join_cache_lookup": "SELECT labels.doc_id IS NOT NULL AS cached, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "vec_page_read": "SELECT item_id AS request, p AS pos, i AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM (SELECT item_id, unnest([0, 1, 2, 3]) AS p, unnest([item_id, item_id + 1, item_id, 3]) AS i FROM benchmark) LEFT JOIN embeddings ON vec_id = i",
    "q_dense_premises": _DENSE.format(score=_DOT.format(a="a.embedding", b="b.embedding")),
    "q_dense_proofs": "SELECT query, proof, ordinal, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, ordinal) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query, proof ORDER BY score DESC, ordinal) AS n FROM (SELECT a.vec_id AS query, 'proof ' || (b.vec_id // 3) % 500 AS proof, b.vec_id AS ordinal, round(" + _DOT.format(a="a.embedding", b="b.embedding") + " / (sqrt(" + _DOT.format(a="a.embedding", b="a.embedding") + ") * sqrt(" + _DOT.format(a="b.embedding", b="b.embedding") + ")), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0)) WHERE n = 1 QUALIFY rank <= 5",
    "vec_dot": "SELECT vec_id, round(" + _DOT.format(a="embedding", b="embedding") + ", 5) AS dot FROM embeddings",
    "win_prefix_concat": "SELECT conv_id, turn, md5(coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS prefix FROM conversations",
    "win_suffix_list": "SELECT conv_id, turn, string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM conversations",
    "win_token_budget": _BUD.format(o=""),
    "win_prev_lines": _BUD.format(o="DESC"),
    "q_prev_proof_recs": "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT conv_id, text, min(turn) AS turn FROM conversations GROUP BY 1, 2)) WHERE k <= 2",
    "label_matrix": "SELECT a.vec_id AS row, b.vec_id AS col, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON a.vec_id // 8 = b.vec_id // 8",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
