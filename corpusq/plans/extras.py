"""Remaining queries: goals and names, training rows, candidates, labels and non-regular strings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusq.functions import arrow
from corpusq.functions import text as tx
from corpusq.operators import corpus as cp
from corpusq.operators import evaluation as ev
from corpusq.operators import retrieval as rt
from corpusq.sources.scratch import scratch
from corpusq.sources.tables import table


def _part(s, d):
    return table(s, d, "part")


def _statement(s, d):
    """Statements made of a part: Lemma name: type."""
    return _part(s, d).withColumn("st", F.concat(F.lit("Lemma "), F.regexp_replace("p_name", " ", "_"), F.lit(" : "), "p_type", F.lit(" = "), "p_brand"))


def str_theorem_name(s, d):
    return _statement(s, d).select("p_partkey", tx.theorem_name(F.col("st")).alias("name"))


def str_premise_name(s, d):
    return _statement(s, d).select("p_partkey", tx.premise_name(F.col("st")).alias("name"))


def str_goal_ids(s, d):
    hyps = F.array(F.concat("p_brand", F.lit(": "), "p_type"), F.concat(F.lit("H: "), "p_brand"))
    g = tx.goal_ids(hyps, F.col("p_type"))
    return _part(s, d).select("p_partkey", g.alias("g")).select("p_partkey", F.array_join("g.hyp_ids", ",").alias("hyp_ids"), F.array_join("g.goal_ids", ",").alias("goal_ids"))


def str_typed_score(s, d):
    return _part(s, d).select("p_partkey", F.round(tx.typed_score(F.col("p_name"), F.col("p_type")), 6).alias("score"))


def str_typed_score_v1(s, d):
    return _part(s, d).select("p_partkey", F.round(tx.typed_score(F.col("p_name"), F.col("p_type"), 3.0, 0.3, 0.0, 0.5), 6).alias("score"))


def str_split_steps(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.size(tx.split_steps(F.col("text"))).cast("long").alias("n"))


def str_ansi_strip(s, d):
    return _part(s, d).select("p_partkey", tx.ansi_strip(F.concat(F.lit("\x1b[31m"), "p_name", F.lit("\x1b[0m"))).alias("plain"))


def str_dp_name(s, d):
    return _part(s, d).select("p_partkey", tx.data_name(F.concat(F.lit("raw/repos/"), "p_brand", F.lit("/x/"), F.col("p_partkey").cast("string"), F.lit(".v"))).alias("name"))


def flt_in_out_file(s, d):
    p = F.concat(F.lit("../../"), "p_brand", F.lit("/a.v"))
    return _part(s, d).select("p_partkey", tx.strip_parent(p).endswith("1/a.v").alias("inside"))


def str_blocks(s, d):
    t = F.concat(F.lit("<goal>"), "p_name", F.lit("</goal> and <goal> "), "p_type", F.lit("</goal>"))
    return _part(s, d).select("p_partkey", F.array_join(tx.blocks(t, "goal"), "|").alias("goals"))


def json_parse_fallback(s, d):
    t = F.when(F.col("p_size") > 25, F.concat(F.lit('x ["'), "p_brand", F.lit('", "b"] y'))).otherwise(F.concat(F.lit("- "), "p_name", F.lit(".\nno stop\n2. "), "p_type", F.lit(".")))
    return _part(s, d).select("p_partkey", F.array_join(tx.parsed_list(t), "|").alias("moves"))


def str_collate(s, d):
    parts = [F.concat(F.lit(n + "\n"), tx.first_tokens(F.col(c), k)) for n, c, k in (("[STATE]", "p_type", 2), ("[SCRIPT]", "p_name", 3), ("[PREMISES]", "p_brand", 1))]
    return _part(s, d).select("p_partkey", F.concat_ws("\n", *parts).alias("prompt"))


def arr_expand(s, d):
    return _part(s, d).select("p_partkey", F.array_join(tx.expand(F.array(F.lit(0.5), F.lit(1.5)), F.array(F.col("p_size") % 3, F.lit(2)), 5), ",").alias("a"))


def vec_cosine(s, d):
    e = table(s, d, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(rt.cosine(F.col("embedding"), F.col("q")), 5).alias("cos"))


def build_lm_example(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(s, d, "conversations")
    rows = t.select("conv_id", "turn", F.concat_ws("\n", F.collect_list("text").over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("script"), F.col("text").alias("target"),
                    F.collect_list("text").over(w.rowsBetween(0, 2)).alias("next"))
    return rows.select("conv_id", "turn", F.md5("script").alias("script"), F.md5("target").alias("target"), F.size("next").cast("long").alias("n_next"))


def build_lemma_example(s, d):
    """For every part, the others of its brand with another text: how many, and the first; counted by text."""
    p = _part(s, d)
    by_text = p.groupBy("p_brand", "p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("m"))
    by_brand = by_text.groupBy("p_brand").agg(F.sum("n").alias("all"), F.slice(F.array_sort(F.collect_list(F.struct("m", "p_name"))), 1, 2).alias("low"))
    x = p.select("p_partkey", "p_brand", "p_name").join(by_text.drop("m"), ["p_brand", "p_name"]).join(by_brand, "p_brand").where(F.col("all") > F.col("n"))
    first = F.when(F.col("low")[0]["p_name"] != F.col("p_name"), F.col("low")[0]["m"]).otherwise(F.col("low")[1]["m"])
    return x.select(F.col("p_partkey").alias("target"), (F.col("all") - F.col("n")).alias("candidates"), first.alias("first"))


def build_dpo(s, d):
    p = _part(s, d)
    good, bad = p.where("p_size > 40").select("p_brand", F.col("p_partkey").alias("chosen")), p.where("p_size < 5").select("p_brand", F.col("p_partkey").alias("rejected"))
    return good.join(bad, "p_brand")


def flt_positive(s, d):
    p = _part(s, d)
    pos = p.where("p_type IN ('PROMO', 'LARGE')").select("p_partkey", "p_brand", "p_size")
    avail = p.where("p_size <= 30").select("p_partkey", F.lit(True).alias("available"))
    x = pos.join(avail, "p_partkey", "left")
    why = F.when(F.col("p_brand").endswith("5"), "filtered").when(F.col("available").isNull(), "unavailable").otherwise("kept")
    return x.select("p_partkey", why.alias("why"))


def join_pos_avail(s, d):
    p = _part(s, d)
    return p.where("p_type IN ('PROMO', 'LARGE')").join(p.where("p_size <= 30").select("p_partkey"), "p_partkey", "left_semi").select("p_partkey")


def flt_success_attempts(s, d):
    a = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), (F.col("l_quantity") > 25).alias("ok"))).alias("attempts"))
    return a.select("l_orderkey", F.size(F.filter("attempts", lambda x: x["ok"])).cast("long").alias("n")).where("n > 0")


def prj_flatten_eval(s, d):
    a = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("steps"))
    return a.select("l_orderkey", F.explode("steps").alias("x")).select("l_orderkey", "x.l_linenumber", "x.l_quantity")


def join_thm_to_proof(s, d):
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return li.withColumn("was", F.lag("l_linenumber").over(w)).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("was").isNull() | (F.col("was") < F.col("l_linenumber"))).alias("rising"))


def top_dedup_score(s, d):
    x = _part(s, d).select("p_brand", F.trim(tx.stop_cut(F.col("p_name"), [" "])).alias("text"), "p_retailprice", "p_partkey")
    return cp.first_per(x, ["p_brand", "text"], F.desc("p_retailprice"), "p_partkey").select("p_brand", "text", "p_partkey")


def _definitions(s, d):
    """Names made of parts: a first word is defined by its second words, a second word by types and first words; types are the library's."""
    p = _part(s, d).select(F.element_at(F.split("p_name", " "), 1).alias("a"), F.element_at(F.split("p_name", " "), 2).alias("b"), F.col("p_type").alias("t"), "p_brand")
    edges = p.select(F.col("a").alias("name"), F.col("b").alias("refers")).union(p.where("p_brand LIKE '%5'").select("b", "a")).union(p.select("b", "t")).distinct()
    index = edges.groupBy("name").agg(F.least(F.count("*"), F.lit(50)).alias("size"), F.count("*").alias("parts")).withColumn("std", F.lit(False))
    library = p.select(F.col("t").alias("name"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("parts"), F.lit(True).alias("std")).distinct()
    return index.unionByName(library), edges


def q_structured_context(s, d):
    """Every part is a goal: its second word is a hypothesis' type, its type and first word stand in the conclusion."""
    index, edges = _definitions(s, d)
    p = _part(s, d).withColumnRenamed("p_partkey", "goal")
    hyp = p.select("goal", F.element_at(F.split("p_name", " "), 2).alias("name"), F.lit(True).alias("in_hyp"), F.lit(False).alias("in_goal"))
    words = F.explode(F.array("p_type", F.element_at(F.split("p_name", " "), 1)))
    concl = p.where("p_size % 2 = 0").select("goal", words.alias("name"), F.lit(False).alias("in_hyp"), F.lit(True).alias("in_goal"))
    x = rt.structured_context(hyp.unionByName(concl), index, edges, 1, 8, 60)
    return x.select("goal", "name", F.col("depth").cast("long").alias("depth"), "rank")


def q_precompute_pages(s, d):
    """The ranked table of all goals, written in pages and read again."""
    path = scratch(s, "ranks")
    ranked = q_structured_context(s, d).withColumn("page", (F.col("goal") / 256).cast("long"))
    ranked.repartition("page").write.mode("errorifexists").partitionBy("page").parquet(path)
    return s.read.parquet(path).select("goal", "name", "rank", F.col("page").cast("long").alias("page"))


def q_sparse_premises(s, d):
    """The first turn of a conversation is its goal, later turns are its premises."""
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    goal = table(s, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("goal")).select(
        F.col("conv_id").alias("query"), F.col("conv_id").alias("scope"), words("goal").alias("term"))
    t = table(s, d, "conversations").where("turn > 0").select(
        F.concat_ws("/", "conv_id", "turn").alias("doc"), F.col("conv_id").alias("query"), F.col("conv_id").alias("scope"), F.col("turn").alias("ordinal"), "text")
    x = rt.bm25(goal, t.select("doc", "scope", words("text").alias("term")), t.select("query", "doc", "ordinal"), scope="scope")
    return rt.top_k(x.withColumn("score", F.round("score", 6)), 3).select("query", "doc", "rank")


def cur_gold_traj(s, d):
    a = table(s, d, "conversations").where("turn = 0").select("conv_id", F.lower(tx.norm_ws(F.col("text"))).alias("k"))
    b = table(s, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"), F.count("*").alias("n")).select(F.col("conv_id").alias("match"), F.lower(tx.norm_ws(F.col("t"))).alias("k"), "n")
    return a.join(b.where("n BETWEEN 2 AND 6"), "k").groupBy("conv_id").agg(F.min("match").alias("match"))


def cur_suffix_path_match(s, d):
    """For every page, the first page whose address ends in the same last part."""
    p = table(s, d, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("tail"))
    return p.select(F.col("page_id").alias("wanted"), "tail").join(p.groupBy("tail").agg(F.min("page_id").alias("page_id")), "tail").select("wanted", "page_id")


def cur_match_state(s, d):
    """For every part, the first of its brand and price class whose type holds its goal; goals meet types, once each."""
    keys = ["p_brand", "class"]
    p = _part(s, d).withColumn("class", F.floor(F.col("p_retailprice") / 5)).withColumn("goal", F.substring("p_type", 2, 4))
    types = p.groupBy(*keys, "p_type").agg(F.min("p_partkey").alias("m"), F.count("*").alias("n"))
    all_types = types.groupBy(*keys).agg(F.sum("n").alias("all"), F.min("m").alias("only"))
    hits = p.where("p_size % 2 = 0").select(*keys, "goal").distinct().join(types, keys).where(F.expr("contains(p_type, goal)")).groupBy(*keys, "goal").agg(F.min("m").alias("m"))
    x = p.select(F.col("p_partkey").alias("state"), *keys, "goal").join(all_types, keys).join(hits, [*keys, "goal"], "left")
    return x.select("state", F.coalesce("m", F.when(F.col("all") == 1, F.col("only"))).alias("match"))


def cur_enumerate_cands(s, d):
    names = F.filter(F.split("p_name", " "), lambda x: F.length(x) > 3)
    c = F.slice(F.array_distinct(F.concat(F.transform(names, lambda x: F.concat(F.lit("destruct "), x)), F.transform(names, lambda x: F.concat(F.lit("induction "), x)), F.array(F.lit("intros")))), 1, 4)
    return _part(s, d).select("p_partkey", F.array_join(c, ";").alias("cands"))


def traj_cands_full(s, d):
    w = F.split("p_type", " ")
    c = F.slice(F.array_distinct(F.flatten(F.transform(w, lambda x: F.array(F.concat(F.lit("apply "), x), F.concat(F.lit("rewrite "), x))))), 1, 5)
    return _part(s, d).select("p_partkey", F.array_join(c, ";").alias("cands"))


def traj_scrutinees(s, d):
    t = F.concat(F.lit("match "), "p_name", F.lit(" with if "), "p_brand", F.lit(" then match "), "p_name", F.lit(" with"))
    x = F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit(r"match ([^()]{1,80}?) with"), F.lit(1)), lambda v: F.length(v) <= 80))
    return _part(s, d).select("p_partkey", F.array_join(x, ";").alias("found"))


def cov_ref_lemmas(s, d):
    t = F.concat(F.lit("apply "), F.regexp_replace("p_name", " ", "_"), F.lit(". rewrite ab. exact "), F.element_at(F.split("p_type", " "), 1), F.lit("."))
    x = F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit(r"(?:apply|rewrite|exact) ([A-Za-z_]+)"), F.lit(1)), lambda v: (F.length(v) > 2) & ~v.isin("in", "with")))
    return _part(s, d).select("p_partkey", F.array_join(x, ";").alias("lemmas"))


def agg_pos_types(s, d):
    found = F.regexp_extract_all("p_type", F.lit(r"[A-Z]{4,}"), F.lit(0))
    return cp.first_per(_part(s, d), ["p_brand"], "p_partkey").select("p_brand", F.array_join(found, ",").alias("constructors"))


def _shape(*shapes):
    return F.element_at(F.array(*shapes), (F.col("p_partkey") % len(shapes) + 1).cast("int"))


def _join(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _words(s, d):
    return _part(s, d).withColumn("a", F.element_at(F.split("p_name", " "), 1)).withColumn("b", F.element_at(F.split("p_name", " "), 2)).withColumn("t", F.col("p_type"))


def g_alpha_equiv(s, d):
    """Pairs of goals of five shapes: renamed, another goal, only a second choice fits, two names for one, a variable of another type."""
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    one = F.array(_join("x: ", a), _join("y: ", a), F.lit("H: x = y"), F.lit("K: y < x"))
    goal = _join("f x ( forall z , z = ", t, " )")
    renamed = F.array(F.lit("M: v < u"), _join("v: ", a), _join("u: ", a), F.lit("N: u = v"))
    chain = F.array(_join("p, q, r: ", b), F.lit("h1: p = q"), F.lit("h2: q < p"), F.lit("h3: q = r"))
    back = F.array(_join("p, q, r: ", b), F.lit("g1: q = r"), F.lit("g2: q < p"), F.lit("g3: p = q"))
    left = _shape(one, one, chain, F.array(_join("x: ", a), _join("y: ", a), F.lit("H: x = y")), one)
    right = _shape(renamed, renamed, back, F.array(_join("u: ", a), F.lit("N: u = u")), F.array(_join("v: ", a), _join("u: ", b), F.lit("N: u = v"), F.lit("M: v < u")))
    goals = _shape(goal, goal, F.lit("False"), b, goal)
    others = _shape(_join("f u ( forall w , w = ", t, " )"), _join("f u ( forall w , u = ", t, " )"), F.lit("False"), b, _join("f u ( forall w , w = ", t, " )"))
    return _words(s, d).select("p_partkey", arrow.as_hard(left, goals, right, others).alias("same"))


def str_kill_comments(s, d):
    t = _shape(_join(F.col("a"), " (* a (* b *) ", F.col("t"), " *) ", F.col("b")), _join('"(* ', F.col("t"), ' *)" ', F.col("a")), _join(F.col("b"), ' (* "*)" ', F.col("a"), " *)!"), _join(F.col("t"), " (* open ", F.col("a")))
    return _words(s, d).select("p_partkey", arrow.kill_comments(t).alias("plain"))


def str_top_level_arrow(s, d):
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    x = _shape(_join("(a -> ", a, ") -> ", b, " -> ", t), b, _join("f (", a, " -> ", b, ")"), _join("{", a, " -> [x -> ", b, "]} -> ", t, " (u -> v)"))
    return _words(s, d).select("p_partkey", arrow.top_level_conclusion(x).alias("concl"))


def str_sigma_rename(s, d):
    """The first statement's words become those of the second where they stand alone in a text."""
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    old, new = _join("lemma ", a, "_ok uses ", b), _join("lemma ", t, "_ok uses ", F.lower("t"))
    text = _join("apply ", a, "_ok, ", b, ", ", b, "x, ", a, " and (", b, ")")
    return _words(s, d).select("p_partkey", arrow.sigma_renamed(text, old, new).alias("text"))


def str_rename_variants(s, d):
    a = F.col("a")
    old = F.array(_join("M.", a), F.when(F.col("p_partkey") % 2 == 0, _join("and_", a)).otherwise(a))
    new = F.array(_join("N.", a), F.when(F.col("p_partkey") % 2 == 0, _join("or_", a)).otherwise(F.upper(a)))
    return _words(s, d).select("p_partkey", F.explode(arrow.variants(old, new)).alias("v")).select(
        "p_partkey", F.split("v", ": ")[0].alias("kind"), F.split("v", ": ")[1].alias("names"))


def scan_foreign_results(s, d):
    li = table(s, d, "lineitem")
    from corpusq.sources.readers import foreign_results

    x = foreign_results(li, {"project": F.col("l_returnflag"), "path": F.col("l_linestatus"), "line": F.col("l_linenumber"), "success": F.col("l_quantity") > 10, "time": F.col("l_quantity")})
    return x.groupBy("project", "path").agg(F.sum("line").alias("lines"), F.sum(F.col("success").cast("long")).alias("ok"), F.round(F.sum("time"), 4).alias("time"))


def scan_dir(s, d):
    return table(s, d, "region").select("r_regionkey", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))


def chk_invariants(s, d):
    p = _part(s, d).withColumn("old", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).withColumn(
        "new", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")))
    g = p.groupBy("p_brand").agg(F.sum("old").alias("a"), F.sum("new").alias("b"), F.countDistinct("new").alias("u"), F.count("*").alias("n"))
    return g.agg(F.sum(((F.col("a") != F.col("b")) | (F.col("u") != F.col("n"))).cast("long")).alias("broken"))


_W = "regexp_extract_all({c}, '[A-Za-z_][A-Za-z0-9_'']*')"
_SCORE = "round(CASE WHEN regexp_extract(trim(p_name), '^[A-Za-z_][A-Za-z0-9_'']*') = regexp_extract(trim(p_type), '^[A-Za-z_][A-Za-z0-9_'']*') THEN 3.0 ELSE 0.0 END + {a} * len(list_intersect(list_distinct(" + _W.format(c="p_name") + "), list_distinct(" + _W.format(c="p_type") + "))) + CASE WHEN contains(p_name, '=') = contains(p_type, '=') THEN {b} ELSE 0.0 END, 6)"

_CONTEXT = """WITH p AS (SELECT p_partkey AS goal, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_type AS t, p_brand, p_size FROM part),
 e AS (SELECT a AS name, b AS refers FROM p UNION SELECT b, a FROM p WHERE p_brand LIKE '%5' UNION SELECT b, t FROM p),
 ix AS (SELECT name, least(count(*), 50) AS size, count(*) AS parts FROM e GROUP BY name),
 seed AS (SELECT goal, name, bool_or(h) AS h, bool_or(c) AS c FROM (SELECT goal, b AS name, true AS h, false AS c FROM p UNION ALL SELECT goal, unnest([t, a]), false, true FROM p WHERE p_size % 2 = 0) GROUP BY 1, 2),
 f0 AS (SELECT goal, name, 0 AS depth FROM seed JOIN ix USING (name)),
 f AS (SELECT goal, name, min(depth) AS depth FROM (SELECT * FROM f0 UNION ALL SELECT DISTINCT goal, e.refers, 1 FROM f0 JOIN e USING (name) WHERE e.refers IN (SELECT name FROM ix)) GROUP BY 1, 2),
 v AS (SELECT f.goal, f.name, depth, size, CASE WHEN h THEN 10 ELSE 0 END + CASE WHEN c THEN 5 ELSE 0 END + (1 - depth) * 2 + greatest(0, 3 - 0.2 * parts) AS value FROM f JOIN ix USING (name) LEFT JOIN seed USING (goal, name)),
 r AS (SELECT *, row_number() OVER w AS rank, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM v WINDOW w AS (PARTITION BY goal ORDER BY value DESC, depth, name))
 {select} FROM r WHERE used <= 60 AND rank <= 8"""
_SAID = "regexp_extract_all(lower({c}), '[a-z]+')"

ORACLE_SQL = {
    "q_sparse_premises": """WITH g AS (SELECT conv_id AS query, arg_min(text, turn) AS goal FROM conversations GROUP BY 1), qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest(""" + _SAID.format(c="goal") + """) AS term FROM g) GROUP BY 1, 2),
 c AS (SELECT conv_id AS query, turn AS ordinal, conv_id || '/' || turn AS doc, """ + _SAID.format(c="text") + """ AS ws FROM conversations WHERE turn > 0),
 size AS (SELECT query, doc, ordinal, len(ws) AS len, count(*) OVER (PARTITION BY query) AS n, avg(len(ws)) OVER (PARTITION BY query) AS al FROM c),
 tf AS (SELECT query, doc, term, count(*) AS tf FROM (SELECT query, doc, unnest(ws) AS term FROM c) GROUP BY 1, 2, 3),
 hit AS (SELECT size.*, qtf, tf, count(*) OVER (PARTITION BY query, term) AS df FROM qt JOIN tf USING (query, term) JOIN size USING (query, doc)),
 sc AS (SELECT s.query, s.doc, s.ordinal, round(coalesce(sum(qtf * ln((h.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.8 / (tf + 1.8 * (0.25 + 0.75 * h.len / h.al))), 0), 6) AS score FROM size s LEFT JOIN hit h ON s.query = h.query AND s.doc = h.doc GROUP BY 1, 2, 3)
 SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, ordinal) AS rank FROM sc QUALIFY rank <= 3""",
    "str_theorem_name": "SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part",
    "str_premise_name": "SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part",
    "str_goal_ids": "SELECT p_partkey, array_to_string(list_filter(string_split(p_type, ' '), lambda x: x <> p_brand AND x <> 'H'), ',') AS hyp_ids, array_to_string(list_filter(string_split(p_type, ' '), lambda x: x <> p_brand AND x <> 'H'), ',') AS goal_ids FROM part",
    "str_typed_score": "SELECT p_partkey, CAST(" + _SCORE.format(a="0.1", b="0.3") + " AS DOUBLE) AS score FROM part",
    "str_typed_score_v1": "SELECT p_partkey, CAST(" + _SCORE.format(a="0.3", b="0.5") + " AS DOUBLE) AS score FROM part",
    "str_split_steps": "SELECT conv_id, turn, len(list_filter(string_split(regexp_replace(text, '\\.(\\s|$)', '.' || chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, ' ') <> '')) AS n FROM conversations",
    "str_ansi_strip": "SELECT p_partkey, p_name AS plain FROM part",
    "str_dp_name": "SELECT p_partkey, p_brand || '-x-' || p_partkey || '.v' AS name FROM part",
    "flt_in_out_file": "SELECT p_partkey, p_brand LIKE '%1' AS inside FROM part",
    "str_blocks": "SELECT p_partkey, CASE WHEN p_name = p_type THEN p_name ELSE p_name || '|' || p_type END AS goals FROM part",
    "json_parse_fallback": "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || '|b' ELSE p_name || '.|' || p_type || '.' END AS moves FROM part",
    "str_collate": "SELECT p_partkey, '[STATE]' || chr(10) || array_to_string(string_split(p_type, ' ')[1:2], ' ') || chr(10) || '[SCRIPT]' || chr(10) || array_to_string(string_split(p_name, ' ')[1:3], ' ') || chr(10) || '[PREMISES]' || chr(10) || string_split(p_brand, ' ')[1] AS prompt FROM part",
    "arr_expand": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '1.5,1.5,0.0,0.0,0.0' WHEN 1 THEN '0.5,1.5,1.5,0.0,0.0' ELSE '0.5,0.5,1.5,1.5,0.0' END AS a FROM part",
    "vec_cosine": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cos FROM embeddings a, embeddings b WHERE b.vec_id = 0",
    "build_lm_example": "SELECT conv_id, turn, md5(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS script, md5(text) AS target, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n_next FROM conversations",
    "build_lemma_example": "SELECT a.p_partkey AS target, count(*) AS candidates, min(b.p_partkey) AS first FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name <> b.p_name GROUP BY 1",
    "build_dpo": "SELECT a.p_brand, a.p_partkey AS chosen, b.p_partkey AS rejected FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size > 40 AND b.p_size < 5",
    "flt_positive": "SELECT p_partkey, CASE WHEN p_brand LIKE '%5' THEN 'filtered' WHEN p_size > 30 THEN 'unavailable' ELSE 'kept' END AS why FROM part WHERE p_type IN ('PROMO', 'LARGE')",
    "join_pos_avail": "SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'LARGE') AND p_size <= 30",
    "flt_success_attempts": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1",
    "prj_flatten_eval": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
    "join_thm_to_proof": "SELECT l_orderkey, l_linenumber, l_partkey, was IS NULL OR was < l_linenumber AS rising FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS was FROM lineitem) JOIN orders ON o_orderkey = l_orderkey",
    "top_dedup_score": "SELECT p_brand, text, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, text ORDER BY p_retailprice DESC, p_partkey) AS n FROM (SELECT *, string_split(p_name, ' ')[1] AS text FROM part)) WHERE n = 1",
    "q_structured_context": _CONTEXT.format(select="SELECT goal, name, CAST(depth AS BIGINT) AS depth, rank"),
    "cur_gold_traj": "WITH c AS (SELECT conv_id, lower(trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g'), ' ')) AS k, count(*) AS n FROM conversations GROUP BY 1), a AS (SELECT conv_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS k FROM conversations WHERE turn = 0) SELECT a.conv_id, min(c.conv_id) AS match FROM a JOIN c ON a.k = c.k AND n BETWEEN 2 AND 6 GROUP BY 1",
    "cur_suffix_path_match": "SELECT a.page_id AS wanted, min(b.page_id) AS page_id FROM pages a JOIN pages b ON string_split(a.url, '/')[-1] = string_split(b.url, '/')[-1] GROUP BY 1",
    "cur_match_state": "WITH p AS (SELECT *, floor(p_retailprice / 5) AS k, substring(p_type, 2, 4) AS g FROM part), h AS (SELECT DISTINCT p_brand, k, g FROM p WHERE p_size % 2 = 0) SELECT state, coalesce(m, CASE WHEN n = 1 THEN o END) AS match FROM (SELECT a.p_partkey AS state, min(b.p_partkey) FILTER (WHERE contains(b.p_type, a.g) AND h.g IS NOT NULL) AS m, count(*) AS n, min(b.p_partkey) AS o FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.k = b.k LEFT JOIN h ON h.p_brand = a.p_brand AND h.k = a.k AND h.g = a.g GROUP BY 1)",
    "cur_enumerate_cands": "SELECT p_partkey, array_to_string(CASE WHEN len(n) = 0 THEN ['intros'] WHEN len(n) = 1 THEN ['destruct ' || n[1], 'induction ' || n[1], 'intros'] ELSE (list_transform(n, lambda x: 'destruct ' || x) || list_transform(n, lambda x: 'induction ' || x) || ['intros'])[1:4] END, ';') AS cands FROM (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: length(x) > 3) AS n FROM part)",
    "traj_cands_full": "SELECT p_partkey, array_to_string(flatten(list_transform(string_split(p_type, ' '), lambda x: ['apply ' || x, 'rewrite ' || x]))[1:5], ';') AS cands FROM part",
    "traj_scrutinees": "SELECT p_partkey, p_name AS found FROM part",
    "cov_ref_lemmas": "SELECT p_partkey, replace(p_name, ' ', '_') || CASE WHEN replace(p_name, ' ', '_') <> string_split(p_type, ' ')[1] THEN ';' || string_split(p_type, ' ')[1] ELSE '' END AS lemmas FROM part",
    "agg_pos_types": "SELECT p_brand, array_to_string(regexp_extract_all(arg_min(p_type, p_partkey), '[A-Z]{4,}'), ',') AS constructors FROM part GROUP BY p_brand",
    "g_alpha_equiv": "SELECT p_partkey, p_partkey % 5 IN (0, 2) AS same FROM part",
    "str_kill_comments": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN a || '  ' || b WHEN 1 THEN '\"(* ' || t || ' *)\" ' || a WHEN 2 THEN b || ' !' ELSE t || ' ' END AS plain FROM (SELECT *, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_type AS t FROM part)",
    "str_top_level_arrow": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN t WHEN 1 THEN b WHEN 2 THEN 'f (' || a || ' -> ' || b || ')' ELSE t || ' (u -> v)' END AS concl FROM (SELECT *, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_type AS t FROM part)",
    "str_sigma_rename": "SELECT p_partkey, 'apply ' || t || '_ok, ' || lower(t) || ', ' || b || 'x, ' || a || ' and (' || lower(t) || ')' AS text FROM (SELECT *, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_type AS t FROM part)",
    "str_rename_variants": "WITH w AS (SELECT *, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_type AS t FROM part), p AS (SELECT p_partkey, 'M.' || a || '>N.' || a AS m, CASE WHEN p_partkey % 2 = 0 THEN 'and_' || a || '>or_' || a ELSE a || '>' || upper(a) END AS n, CASE WHEN p_partkey % 2 = 0 THEN 'and>or' ELSE a || '>' || upper(a) END AS c, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS even FROM w), l AS (SELECT *, CASE WHEN even = 1 THEN n || ',' || m ELSE m || ',' || n END AS o FROM p) SELECT p_partkey, 'base' AS kind, m || ',' || n AS names FROM l UNION ALL SELECT p_partkey, 'module', o || ',M.>N.' FROM l UNION ALL SELECT p_partkey, 'stem', o || ',' || c FROM l UNION ALL SELECT p_partkey, 'both', o || ',' || c || ',M.>N.' FROM l",
    "scan_foreign_results": "SELECT l_returnflag AS project, l_linestatus AS path, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(*) FILTER (WHERE l_quantity > 10) AS ok, round(sum(l_quantity), 4) AS time FROM lineitem GROUP BY 1, 2",
    "scan_dir": "SELECT r_regionkey, 'region.parquet' AS file FROM region",
    "chk_invariants": "SELECT CAST(0 AS BIGINT) AS broken",
    "q_precompute_pages": _CONTEXT.format(select="SELECT goal, name, rank, goal // 256 AS page"),
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
