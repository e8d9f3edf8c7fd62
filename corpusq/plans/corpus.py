"""Corpus, string and graph queries over documents, conversations, pages, customers and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusq.functions import arrow
from corpusq.functions import text as tx
from corpusq.operators import corpus as cp
from corpusq.operators import graph as gr
from corpusq.sources.scratch import written
from corpusq.sources.tables import table


def _docs(s, d):
    return table(s, d, "documents")


def _turns(s, d):
    return table(s, d, "conversations")


def _pages(s, d):
    return table(s, d, "pages")


def _lines(s, d):
    return _docs(s, d).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def dedup_lines(s, d):
    return cp.duplicate_report(_lines(s, d), "line")


def dedup_hash_per_split(s, d):
    return _lines(s, d).select("source", F.md5(F.trim("line")).alias("h")).distinct().groupBy("source").agg(F.count("*").alias("n"))


def agg_dup_count(s, d):
    return cp.duplicate_report(_docs(s, d), "text")


def dedup_sentences(s, d):
    return cp.first_per(_turns(s, d), ["role", "text"], "conv_id", "turn").select("conv_id", "turn")


def set_union_splits(s, d):
    a, b = _docs(s, d).where(F.col("source").isin("src1", "src2")).select("source", "lang"), _docs(s, d).where("lang = 'en'").select("source", "lang")
    return a.union(b).distinct()


def set_leak_disjoint(s, d):
    a = _lines(s, d).where("length(line) > 20").select("doc_id", "source", F.md5(F.trim("line")).alias("h"))
    b = a.where(F.col("source").isin("src1", "src2")).select("h").distinct()
    return a.where(~F.col("source").isin("src1", "src2")).join(b, "h", "left_semi").select("doc_id").distinct()


def split_random(s, d):
    return cp.split_random(_docs(s, d).select("doc_id"), "doc_id", 0.8, 0.1)


def split_predefined(s, d):
    files = _docs(s, d).select(F.col("doc_id").alias("file"), "source")
    texts = _lines(s, d).select(F.col("doc_id").alias("file"), F.md5("line").alias("text"))
    return cp.split_predefined(files, texts, F.col("source").isin("src1", "src2"), F.col("source").isin("src3", "src4", "src5"))


def split_test_only(s, d):
    return _docs(s, d).where(F.col("source").isin("src1", "src2")).select("doc_id")


def external_shuffle(s, d):
    return _docs(s, d).select("doc_id", cp.hash_order("doc_id").alias("h")).orderBy("h", "doc_id")


def sample_balanced(s, d):
    r = _docs(s, d).withColumn("bucket", F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "mid").otherwise("long"))
    return cp.sample_per_group(r, "bucket", cp.hash_order("doc_id"), 20).select("doc_id", "bucket")


def sample_first_per_group(s, d):
    return cp.sample_per_group(_docs(s, d), "source", F.col("doc_id"), 3).select("source", "doc_id")


def sample_negatives(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))
    c = _docs(s, d).select(F.col("doc_id").alias("doc"), "source", (F.col("lang") == "en").alias("inside")).join(q, "source")
    return cp.negatives(c, "query", "inside", 8, 3).select("query", "doc")


def sample_rerank_negs(s, d):
    return cp.sample_per_group(_docs(s, d).where("lang <> 'en'"), "source", cp.hash_order("doc_id"), 4).select("source", "doc_id")


def kv_point_lookup(s, d):
    return _docs(s, d).where("doc_id = 17").select("doc_id", "source")


def kv_count(s, d):
    return _docs(s, d).agg(F.count("*").alias("n"))


def kv_find(s, d):
    stored = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    wanted = table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), (F.col("c_nationkey") + F.when(F.col("c_custkey") % 4 == 0, 100).otherwise(0)).alias("nation"))
    return cp.find(wanted, stored, ["name", "nation"])


def kv_upsert(s, d):
    stored = table(s, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("id")).where("id % 2 = 0")
    return cp.upsert(stored, table(s, d, "part").select("p_brand"), ["p_brand"])


def merge_override(s, d):
    a, b = (_docs(s, d).where(f"doc_id % {n} = 0").select("source", F.lit(n).alias("v")).distinct() for n in (2, 3))
    return cp.merged([a, b], "source")


def sq_resume(s, d):
    return cp.resumed(_docs(s, d).select("doc_id"), table(s, d, "labels"), "doc_id")


def sq_missing_outputs(s, d):
    return cp.resumed(_docs(s, d).select("doc_id"), table(s, d, "labels"), "doc_id").agg(F.count("*").alias("missing"))


def idx_inverted(s, d):
    x = cp.inverted(table(s, d, "part"), F.split("p_type", " "), "p_brand")
    return x.select("key", F.array_join("values", ",").alias("brands"))


def idx_notation_map(s, d):
    x = cp.inverted(table(s, d, "part"), F.split("p_name", " "), "p_brand", 6)
    return x.select("key", F.array_join("values", ",").alias("brands"))


def idx_merge(s, d):
    p = table(s, d, "part")
    a = cp.inverted(p, F.split("p_type", " "), "p_brand").unionByName(cp.inverted(p, F.split("p_name", " "), "p_brand"))
    return a.groupBy("key").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))), ",").alias("brands"))


def cov_hit_rate(s, d):
    p = table(s, d, "part")
    rows = p.select("p_partkey", "p_brand", "p_size", F.explode(F.split("p_type", " ")).alias("k"))
    index = rows.groupBy("k", "p_brand", "p_size").agg(F.count("*").alias("n"))
    # a part is covered if another part holds one of its keys
    hit = rows.join(index, ["k", "p_brand", "p_size"]).groupBy("p_partkey").agg(F.max((F.col("n") > 1).cast("int")).alias("hit"))
    return hit.agg(F.round(F.avg("hit"), 6).alias("rate"))


def cov_exact_match(s, d):
    t = _turns(s, d).select("text", F.lead("text").over(_w("conv_id", "turn")).alias("next")).where("next IS NOT NULL")
    same = (F.col("text") == F.col("next"), F.trim("text") == F.trim("next"), F.regexp_replace("text", r"\.$", "") == F.regexp_replace("next", r"\.$", ""))
    return t.agg(*[F.sum(c.cast("long")).alias(n) for c, n in zip(same, ("strict", "trimmed", "dotless"), strict=True)])


def _w(key, order):
    return Window.partitionBy(key).orderBy(order)


def flt_premise(s, d):
    r = table(s, d, "part").withColumn("kind", F.element_at(F.split("p_type", " "), 1))
    return cp.type_filter(r, "kind", "p_brand", ["PROMO"], ["SMALL"], ["LARGE"], "Brand#1").select("p_partkey")


def flt_admitted(s, d):
    last = _docs(s, d).withColumn("last", F.element_at(F.split("text", "\n"), -1))
    return last.where(~F.col("last").rlike(r"(?:reserved|License)\.$")).select("doc_id")


def flt_independent(s, d):
    return _docs(s, d).where(~F.col("text").contains("License")).select("doc_id")


def flt_cheat_tokens(s, d):
    return _docs(s, d).where(F.col("text").rlike("License|reserved|token")).select("doc_id")


def flt_trivial(s, d):
    return _turns(s, d).where(~F.col("text").rlike(r"^\s*[-+*{}]")).groupBy("role").agg(F.count("*").alias("n"))


def prj_explode_steps(s, d):
    return _lines(s, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pos").cast("long").alias("last"))


def str_ids(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(tx.ids(F.concat("p_type", F.lit(" ("), "p_name", F.lit("):="), "p_brand")), "|").alias("ids"))


def str_norm_ws(s, d):
    return _pages(s, d).select("page_id", F.md5(tx.norm_ws(F.col("html"))).alias("h"))


def str_strip_comment_flat(s, d):
    return _pages(s, d).select("page_id", F.md5(tx.strip_flat_comments(F.regexp_replace(F.regexp_replace("html", "<!--|<nav>", "(*"), "-->|</nav>", "*)"))).alias("plain"))


def str_path_clean(s, d):
    return _pages(s, d).select("page_id", tx.tool_path(F.col("url")).alias("path"))


def str_tactic_head(s, d):
    return _turns(s, d).select("conv_id", "turn", tx.head(F.col("text")).alias("head"))


def str_head_strip_bullets(s, d):
    return _turns(s, d).select("conv_id", "turn", tx.head_without_bullets(F.concat(F.lit("- 1. "), "text")).alias("head"))


def str_edit_distance(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("d"))


def str_goal_hyp_distance(s, d):
    return table(s, d, "part").select("p_partkey", tx.nearest_hypothesis(F.col("p_name"), F.array("p_type", "p_brand")).alias("d"))


def str_stop_cut(s, d):
    return table(s, d, "part").select("p_partkey", tx.stop_cut(F.col("p_type"), ["ANOD", "BRUSH", " "]).alias("cut"))


def str_format_goals(s, d):
    return table(s, d, "part").select("p_partkey", tx.format_goals(F.array("p_name", "p_type")).alias("goals"))


def str_context_format(s, d):
    return table(s, d, "part").select("p_partkey", tx.context(F.col("p_brand"), F.array("p_name", "p_type")).alias("context"))


def str_truncate_tokens(s, d):
    return _turns(s, d).select("conv_id", "turn", tx.first_tokens(F.col("text"), 4).alias("head"), tx.last_tokens(F.col("text"), 4).alias("tail"))


def str_truncate_lines(s, d):
    w = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return _lines(s, d).withColumn("used", F.sum(F.length("line")).over(w)).where("used <= 2000").groupBy("doc_id").agg(F.count("*").alias("lines"))


def str_pair_budget(s, d):
    return table(s, d, "part").select("p_partkey", tx.pair_budget(F.col("p_name"), F.col("p_type"), 3).alias("pair"))


def _first(c):
    return F.element_at(F.split(c, " "), 1)


def _second(c):
    return F.element_at(F.split(c, " "), 2)


def str_features28(s, d):
    """Statements of four shapes made of parts."""
    a, b, t = _first("p_name"), _second("p_name"), F.col("p_type")
    shapes = [
        F.concat(F.lit("forall "), a, F.lit(" "), b, F.lit(" : "), t, F.lit(", ("), a, F.lit(" -> "), b, F.lit(") -> "), a, F.lit(" <= "), b, F.lit(" -> ~ "), "p_brand", F.lit(" /\\ "), a),
        F.concat(F.lit("exists "), a, F.lit(", "), t, F.lit(" = "), b, F.lit(" \\/ [x -> y] <-> False.")),
        F.concat(t, F.lit(" >= "), b, F.lit(" -> (forall q, "), a, F.lit(") -> False.")),
        F.concat(F.lit("forall x, forall y, let n := "), a, F.lit(" in list nat <> "), b),
    ]
    rows = table(s, d, "part").withColumn("st", F.element_at(F.array(*shapes), (F.col("p_partkey") % 4 + 1).cast("int")))
    rows = rows.select("p_partkey", "st", arrow.introductions(F.col("st")).alias("i"))
    return rows.select("p_partkey", *tx.features(F.col("st"), F.col("i.hyps"), F.col("i.goal")).values())


def str_proof_length(s, d):
    return _turns(s, d).select("conv_id", "turn", tx.proof_length(F.concat(F.lit("Proof. "), "text", F.lit(" Qed."))).cast("long").alias("n"))


def _errors(s, d):
    """Error messages about turns: two classes at once in some, none in others."""
    said = F.element_at(F.split("text", " "), 1)
    kinds = [F.concat(F.lit("Unable to unify "), said, F.lit(" with x: syntax")), F.concat(F.lit("The reference "), said, F.lit(" was not found. Syntax error")),
             F.concat(F.lit("Syntax error: "), said), F.lit("  \n"), F.concat(F.lit("No such goal "), said), F.concat(F.lit("Timeout "), said)]
    return _turns(s, d).withColumn("message", F.element_at(F.array(*kinds), ((F.col("conv_id") * 7 + F.col("turn")) % 6 + 1).cast("int")))


def map_errtype(s, d):
    return _errors(s, d).select("conv_id", "turn", tx.error_class(F.col("message")).alias("kind"))


def agg_error_taxonomy(s, d):
    x = _errors(s, d).groupBy("role", tx.error_class(F.col("message")).alias("kind")).agg(F.count("*").alias("n"))
    return x.select("role", "kind", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("role")), 6).alias("pct"))


def hash_md5_key(s, d):
    return _docs(s, d).select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("<a>"), "source", F.lit("<b>"), "text")).alias("key"))


def hash_sha256_file(s, d):
    return _docs(s, d).select("doc_id", F.sha2("text", 256).alias("sha"))


def json_step_key(s, d):
    return _turns(s, d).select(F.to_json(F.struct("conv_id", "turn")).alias("key"))


def json_roundtrip(s, d):
    x = table(s, d, "events").select("event_id", F.from_json("props", "struct<k: bigint>").alias("p"))
    return x.select("event_id", F.col("p.k").alias("k"))


def arr_common_suffix(s, d):
    return table(s, d, "part").select("p_partkey", tx.common_suffix(F.split("p_type", ""), F.split(F.reverse("p_type"), "")).cast("long").alias("n"))


def agg_constructors(s, d):
    p = table(s, d, "part").select(F.element_at(F.split("p_name", " "), 1).alias("name"), "p_type", "p_partkey", (F.col("p_size") > 25).alias("std"))
    any_std = p.groupBy("name").agg(F.max("std").alias("std"))
    return cp.first_per(p.drop("std"), ["name"], "p_partkey").join(any_std, "name").select("name", "p_type", "std")


def join_nearest_symbol(s, d):
    """Misspelt names and brands against all of them; a nearest name shares its first three characters, as the operator asks."""
    whole = F.concat("p_name", F.lit(" "), F.regexp_replace("p_brand", "Brand#", ""))
    vocab = table(s, d, "part").select(whole.alias("b")).distinct()
    names = vocab.select(F.concat(F.substring("b", 1, 4), F.lit("q"), F.expr("substring(b, 6)")).alias("a")).distinct()
    pairs = names.withColumn("k", F.substring("a", 1, 3)).join(vocab.withColumn("k", F.substring("b", 1, 3)), "k").withColumn("d", F.levenshtein("a", "b"))
    near = pairs.where(F.col("d") <= F.greatest(F.lit(2), F.floor(F.length("a") / 3)))
    return near.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))


def join_suffix_sibling(s, d):
    """Names are compared once each, by last word; parts of a name share its sibling."""
    p = table(s, d, "part").select("p_partkey", F.concat("p_type", F.lit(" "), "p_name").alias("name"))
    names = p.groupBy("name").agg(F.min("p_partkey").alias("other")).withColumn("head", F.element_at(F.split("name", " "), -1))
    x = names.select("name", "head").join(names.select(F.col("name").alias("n2"), "head", "other"), "head").where("name <> n2")
    x = x.withColumn("n", tx.common_suffix(F.split("name", " "), F.split("n2", " ")))
    best = x.groupBy("name").agg(F.min_by("other", F.struct((-F.col("n")).alias("n"), "other")).alias("other"))
    return p.join(best, "name").select("p_partkey", "other")


def sort_parsed_key(s, d):
    return _docs(s, d).select("doc_id", F.regexp_extract("source", r"src(\d+)", 1).cast("long").alias("k")).orderBy("k", "doc_id")


def top_by_max_part(s, d):
    x = _turns(s, d).groupBy("conv_id").agg(F.max(F.length("text")).cast("long").alias("most"))
    return x.withColumn("rank", F.dense_rank().over(Window.partitionBy(F.col("conv_id") % 10).orderBy(F.desc("most"))).cast("long"))


def preview_limit(s, d):
    return _docs(s, d).orderBy("doc_id").limit(50).select("doc_id", "source")


def _nodes(s, d):
    n = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 9000).alias("solved"))
    depth = F.floor(F.log2(F.col("id").cast("double"))).cast("int")
    return n.where("id >= 1").select("id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2).cast("long")).alias("parent"), depth.alias("depth"), "solved")


def _tree(s, d):
    return _nodes(s, d)


def _depth(s, d):
    return _nodes(s, d).agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]


def g_tree_label(s, d):
    return gr.tree_labels(_tree(s, d), _depth(s, d)).select("id", "below", F.col("dist").cast("long").alias("dist"))


def g_path_to_root(s, d):
    t = _tree(s, d)
    return gr.paths_to_root(t, t.where("solved"), _depth(s, d))


def g_value_iteration(s, d):
    t = _tree(s, d)
    nodes = t.select("id", F.when(F.col("solved"), 1.0).alias("reward"))
    return gr.value_iteration(
        nodes, t.where("parent IS NOT NULL").select(F.col("parent").alias("id"), F.col("id").alias("child")), 0.9, cut=lambda df: written(df, "values")).select("id", F.round("v", 6).alias("v"))


def agg_argmax_goal(s, d):
    return g_value_iteration(s, d).groupBy((F.col("id") % 10).alias("goal")).agg(F.max("v").alias("v"))


def g_bounded_bfs(s, d):
    t = _tree(s, d)
    edges = t.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    return gr.bounded_reach(t.select(F.col("id").alias("start")), edges, 3).select("start", "node", F.col("steps").cast("long").alias("steps"))


_LINES = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)"
_TREE = "tree AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent, c_acctbal > 9000 AS solved FROM customer WHERE c_custkey >= 1)"
_UP = f"WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS top, 0 AS n FROM tree WHERE solved UNION ALL SELECT up.id, t.parent, n + 1 FROM up JOIN tree t ON t.id = up.top WHERE t.parent IS NOT NULL)"
_VAL = _UP.replace("top, 0 AS n FROM tree", "top, 0 AS n FROM tree") + ", v AS (SELECT t.id, round(CASE WHEN t.solved THEN 1.0 ELSE coalesce(pow(0.9, (SELECT min(n) FROM up WHERE top = t.id)), 0.0) END, 6) AS v FROM tree t)"
_KIND = "['unify', 'not_found', 'syntax', 'empty', 'not_found', 'other'][(conv_id * 7 + turn) % 6 + 1]"
_F_SHAPES = """w AS (SELECT *, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_type AS t FROM part),
 st AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'forall ' || a || ' ' || b || ' : ' || t || ', (' || a || ' -> ' || b || ') -> ' || a || ' <= ' || b || ' -> ~ ' || p_brand || ' /\\ ' || a
  WHEN 1 THEN 'exists ' || a || ', ' || t || ' = ' || b || ' \\/ [x -> y] <-> False.' WHEN 2 THEN t || ' >= ' || b || ' -> (forall q, ' || a || ') -> False.' ELSE 'forall x, forall y, let n := ' || a || ' in list nat <> ' || b END AS st,
  CASE p_partkey % 4 WHEN 0 THEN [a || ' ' || b || ' : ' || t, '(' || a || ' -> ' || b || ')', a || ' <= ' || b] WHEN 1 THEN ['exists ' || a || ', ' || t || ' = ' || b || ' \\/ [x -> y] <'] WHEN 2 THEN [t || ' >= ' || b, '(forall q, ' || a || ')'] ELSE ['x', 'y'] END AS hyps,
  CASE p_partkey % 4 WHEN 0 THEN '~ ' || p_brand || ' /\\ ' || a WHEN 1 THEN 'False' WHEN 2 THEN 'False' ELSE 'let n := ' || a || ' in list nat <> ' || b END AS goal FROM w)"""


def _n(c, *parts):
    """How often substrings stand in a column, in SQL."""
    return "(" + " + ".join(f"len(string_split({c}, '{p}')) - 1" for p in parts) + ")"


def _m(c, pattern):
    return f"len(regexp_extract_all({c}, '{pattern}'))"


_F_TOKEN, _F_LET = "[A-Za-z_][A-Za-z0-9_'']*|[^\\sA-Za-z0-9]", "\\b(?:match|fix|let)\\b"
_F_LOGIC, _F_CMP = ("/\\", "\\/", "<->", "~"), ("<=", ">=", "<>", "=", "<", ">")
_F_COLUMNS = {
    "num_goals": "1", "goal_len": "length(goal)", "goal_tok_count": _m("goal", _F_TOKEN), "forall_left": _n("goal", "forall"), "goal_arrow": _n("goal", "->"), "goal_logic_ops": _n("goal", *_F_LOGIC),
    "cmp_ops": _n("goal", *_F_CMP), "is_contra_goal": "CAST(goal = 'False' AS INT)", "num_hyps": "len(hyps)", "hyp_total_len": "length(array_to_string(hyps, ''))",
    "hyp_len_avg": "coalesce(list_avg(list_transform(hyps, lambda h: length(h))), 0)", "hyp_len_max": "coalesce(list_max(list_transform(hyps, lambda h: length(h))), 0)",
    "hyp_tok_count_total": "coalesce(list_sum(list_transform(hyps, lambda h: " + _m("h", _F_TOKEN) + ")), 0)", "hyp_tok_count_max": "coalesce(list_max(list_transform(hyps, lambda h: " + _m("h", _F_TOKEN) + ")), 0)",
    "hyp_logic_ops_total": "coalesce(list_sum(list_transform(hyps, lambda h: " + _n("h", *_F_LOGIC) + ")), 0)", "match_fix_let": _m("goal", _F_LET),
    "mapset_tokens": _m("goal", "\\b(?:Map|Maps|PTree|PMap|ZMap|Set|list|option|nat|Z|positive)\\b"), "goal_exists": _n("goal", "exists"), "hyp_forall_total": _n("array_to_string(hyps, ' ')", "forall"),
    "stmt_len": "length(st)", "stmt_tok_count": _m("st", _F_TOKEN), "stmt_forall": _n("st", "forall"), "stmt_exists": _n("st", "exists"), "stmt_arrow": _n("st", "->"), "stmt_logic_ops": _n("st", *_F_LOGIC),
    "stmt_cmp_ops": _n("st", *_F_CMP), "stmt_match_fix_let": _m("st", _F_LET), "stmt_is_eq_goal": "CAST(contains(st, '=') AS INT)"}
_FEATURES = f"WITH {_F_SHAPES} SELECT p_partkey, " + ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in _F_COLUMNS.items()) + " FROM st"
_HEAD = "CASE WHEN trim(t) = '' THEN '<empty>' WHEN regexp_extract(trim(t), '^[A-Za-z_][A-Za-z0-9_'']*') <> '' THEN regexp_extract(trim(t), '^[A-Za-z_][A-Za-z0-9_'']*') ELSE substring(trim(t), 1, 1) END AS head"

ORACLE_SQL = {
    "dedup_lines": f"WITH {_LINES} SELECT count(*) AS rows, count(DISTINCT line) AS distinct_rows, count(*) - count(DISTINCT line) AS dropped FROM lines",
    "dedup_hash_per_split": f"WITH {_LINES} SELECT source, count(DISTINCT trim(line, ' ')) AS n FROM lines GROUP BY source",
    "agg_dup_count": "SELECT count(*) AS rows, count(DISTINCT text) AS distinct_rows, count(*) - count(DISTINCT text) AS dropped FROM documents",
    "dedup_sentences": "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS n FROM conversations) WHERE n = 1",
    "set_union_splits": "SELECT source, lang FROM documents WHERE source IN ('src1', 'src2') UNION SELECT source, lang FROM documents WHERE lang = 'en'",
    "set_leak_disjoint": f"WITH {_LINES} SELECT DISTINCT doc_id FROM lines WHERE length(line) > 20 AND source NOT IN ('src1', 'src2') AND trim(line, ' ') IN (SELECT trim(line, ' ') FROM lines WHERE length(line) > 20 AND source IN ('src1', 'src2'))",
    "split_random": "SELECT doc_id, CASE WHEN i <= floor(0.8 * n) THEN 'train' WHEN i <= floor(0.8 * n) + floor(0.1 * n) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS i, count(*) OVER () AS n FROM documents)",
    "split_predefined": f"WITH {_LINES}, f AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'test' WHEN source IN ('src3', 'src4', 'src5') THEN 'val' ELSE 'train' END AS split FROM documents), l AS (SELECT doc_id, line, split FROM lines JOIN f USING (doc_id)), vb AS (SELECT DISTINCT doc_id FROM l WHERE split = 'val' AND line IN (SELECT line FROM l WHERE split = 'test')), tb AS (SELECT DISTINCT doc_id FROM l WHERE split = 'train' AND line IN (SELECT line FROM l WHERE split = 'test' OR (split = 'val' AND doc_id NOT IN (SELECT doc_id FROM vb)))) SELECT doc_id AS file, split FROM f WHERE doc_id NOT IN (SELECT doc_id FROM vb) AND doc_id NOT IN (SELECT doc_id FROM tb)",
    "split_test_only": "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')",
    "external_shuffle": "SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents ORDER BY h, doc_id",
    "sample_balanced": "SELECT doc_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(CAST(doc_id AS VARCHAR))) AS n FROM (SELECT *, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'mid' ELSE 'long' END AS bucket FROM documents)) WHERE n <= 20",
    "sample_first_per_group": "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3",
    "sample_negatives": "WITH c AS (SELECT item_id AS query, doc_id AS doc, lang = 'en' AS inside FROM documents JOIN benchmark ON source = 'src' || CAST(item_id % 20 AS VARCHAR)), k AS (SELECT *, count(*) FILTER (WHERE inside) OVER (PARTITION BY query) AS ni, count(*) OVER (PARTITION BY query) AS na, row_number() OVER (PARTITION BY query, inside ORDER BY md5(query || '|' || doc), doc) AS n FROM c) SELECT query, doc FROM k WHERE na >= 8 AND n <= CASE WHEN inside THEN greatest(least(ni, 3), 8 - (na - ni)) ELSE 8 - greatest(least(ni, 3), 8 - (na - ni)) END",
    "sample_rerank_negs": "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS n FROM documents WHERE lang <> 'en') WHERE n <= 4",
    "kv_point_lookup": "SELECT doc_id, source FROM documents WHERE doc_id = 17",
    "kv_count": "SELECT count(*) AS n FROM documents",
    "kv_find": "SELECT w.name, w.nation, c.c_custkey AS id FROM (SELECT c_name AS name, c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 100 ELSE 0 END AS nation FROM customer WHERE c_custkey % 2 = 0) w LEFT JOIN customer c ON c.c_name = w.name AND c.c_nationkey = w.nation",
    "kv_upsert": "WITH st AS (SELECT p_brand, min(p_partkey) AS id FROM part GROUP BY p_brand HAVING min(p_partkey) % 2 = 0) SELECT id, p_brand FROM st UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM st) + row_number() OVER (ORDER BY p_brand), p_brand FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM st))",
    "merge_override": "SELECT source, max(v) AS v FROM (SELECT source, 2 AS v FROM documents WHERE doc_id % 2 = 0 UNION SELECT source, 3 FROM documents WHERE doc_id % 3 = 0) GROUP BY source",
    "sq_resume": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "sq_missing_outputs": "SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "idx_inverted": "SELECT key, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS key FROM part) GROUP BY key",
    "idx_notation_map": "SELECT key, array_to_string(list_sort(list_distinct(list(p_brand)))[1:6], ',') AS brands FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS key FROM part) GROUP BY key",
    "idx_merge": "SELECT key, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS key FROM part UNION ALL SELECT p_brand, unnest(string_split(p_name, ' ')) FROM part) GROUP BY key",
    "cov_hit_rate": "WITH k AS (SELECT p_partkey, p_brand, p_size, unnest(string_split(p_type, ' ')) AS k FROM part) SELECT round(avg(hit), 6) AS rate FROM (SELECT p_partkey, max(hit) AS hit FROM (SELECT p_partkey, CAST(count(*) OVER (PARTITION BY k, p_brand, p_size) > 1 AS INT) AS hit FROM k) GROUP BY 1)",
    "cov_exact_match": "SELECT count(*) FILTER (WHERE text = nx) AS strict, count(*) FILTER (WHERE trim(text, ' ') = trim(nx, ' ')) AS trimmed, count(*) FILTER (WHERE regexp_replace(text, '\\.$', '') = regexp_replace(nx, '\\.$', '')) AS dotless FROM (SELECT text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) WHERE nx IS NOT NULL",
    "flt_premise": "SELECT p_partkey FROM (SELECT *, string_split(p_type, ' ')[1] AS kind FROM part) WHERE kind <> 'PROMO' AND CASE WHEN p_brand LIKE '%Brand#1%' THEN kind <> 'SMALL' ELSE kind <> 'LARGE' END",
    "flt_admitted": "SELECT doc_id FROM documents WHERE NOT regexp_matches(string_split(text, chr(10))[-1], '(?:reserved|License)\\.$')",
    "flt_independent": "SELECT doc_id FROM documents WHERE NOT contains(text, 'License')",
    "flt_cheat_tokens": "SELECT doc_id FROM documents WHERE regexp_matches(text, 'License|reserved|token')",
    "flt_trivial": "SELECT role, count(*) AS n FROM conversations WHERE NOT regexp_matches(text, '^\\s*[-+*{}]') GROUP BY role",
    "prj_explode_steps": f"WITH {_LINES} SELECT doc_id, count(*) AS n, max(pos) AS last FROM lines GROUP BY doc_id",
    "str_ids": r"SELECT p_partkey, array_to_string(regexp_extract_all(p_type || ' (' || p_name || '):=' || p_brand, '[^\[\]\{\}\(\):=,\s]+'), '|') AS ids FROM part",
    "str_norm_ws": r"SELECT page_id, md5(trim(regexp_replace(html, '[ \t\n\r]+', ' ', 'g'), ' ')) AS h FROM pages",
    "str_strip_comment_flat": "SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<!--|<nav>', '(*', 'g'), '-->|</nav>', '*)', 'g'), '(?s)\\(\\*.*?\\*\\)', '', 'g')) AS plain FROM pages",
    "str_path_clean": "SELECT page_id, array_to_string(string_split(url, '/')[-2:], '/') AS path FROM pages",
    "str_tactic_head": f"SELECT conv_id, turn, {_HEAD} FROM (SELECT conv_id, turn, text AS t FROM conversations)",
    "str_head_strip_bullets": f"SELECT conv_id, turn, {_HEAD} FROM (SELECT conv_id, turn, regexp_replace('- 1. ' || text, '^[\\s\\-+*{{}}0-9:.]+', '') AS t FROM conversations)",
    "str_edit_distance": "SELECT p_partkey, levenshtein(p_name, p_type) AS d FROM part",
    "str_goal_hyp_distance": "SELECT p_partkey, CAST(least(levenshtein(p_name, p_type), levenshtein(p_name, p_brand)) AS DOUBLE) AS d FROM part",
    "str_stop_cut": "SELECT p_partkey, CASE WHEN contains(p_type, 'ANOD') THEN string_split(p_type, 'ANOD')[1] WHEN contains(p_type, 'BRUSH') THEN string_split(p_type, 'BRUSH')[1] ELSE string_split(p_type, ' ')[1] END AS cut FROM part",
    "str_format_goals": "SELECT p_partkey, p_name || chr(10) || '[GOAL]' || chr(10) || p_type AS goals FROM part",
    "str_context_format": "SELECT p_partkey, p_brand || chr(10) || 'Goal 1:' || chr(10) || p_name || chr(10) || 'Goal 2:' || chr(10) || p_type AS context FROM part",
    "str_truncate_tokens": "SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:4], ' ') AS head, array_to_string(string_split(text, ' ')[-4:], ' ') AS tail FROM conversations",
    "str_truncate_lines": f"WITH {_LINES} SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS used FROM lines) WHERE used <= 2000 GROUP BY doc_id",
    "str_pair_budget": "SELECT p_partkey, array_to_string(string_split(p_name, ' ')[1:1], ' ') || ' [SEP] ' || array_to_string(string_split(p_type, ' ')[-2:], ' ') AS pair FROM part",
    "str_features28": _FEATURES,
    "str_proof_length": "SELECT conv_id, turn, len(list_filter(regexp_split_to_array(trim(regexp_replace('Proof. ' || text || ' Qed.', '\\b(?:Proof|Qed|Defined)\\.', '', 'g'), ' '), '[.;]\\s+|[.;]$'), lambda x: trim(x, ' ') <> '')) AS n FROM conversations",
    "map_errtype": f"SELECT conv_id, turn, {_KIND} AS kind FROM conversations",
    "agg_error_taxonomy": f"SELECT role, kind, n, round(100 * n / sum(n) OVER (PARTITION BY role), 6) AS pct FROM (SELECT role, {_KIND} AS kind, count(*) AS n FROM conversations GROUP BY 1, 2)",
    "hash_md5_key": "SELECT doc_id, md5(doc_id || '<a>' || source || '<b>' || text) AS key FROM documents",
    "hash_sha256_file": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "json_step_key": "SELECT '{\"conv_id\":' || conv_id || ',\"turn\":' || turn || '}' AS key FROM conversations",
    "json_roundtrip": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "arr_common_suffix": "SELECT p_partkey, coalesce((SELECT min(i) FROM range(0, 1000) r(i) WHERE i < length(p_type) AND substring(reverse(p_type), i + 1, 1) <> substring(p_type, i + 1, 1)), length(p_type)) AS n FROM part",
    "agg_constructors": "SELECT name, arg_min(p_type, p_partkey) AS p_type, bool_or(p_size > 25) AS std FROM (SELECT string_split(p_name, ' ')[1] AS name, * FROM part) GROUP BY name",
    "join_nearest_symbol": "WITH v AS (SELECT DISTINCT p_name || ' ' || replace(p_brand, 'Brand#', '') AS b FROM part) SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY levenshtein(a, b), b) AS n FROM (SELECT DISTINCT substring(b, 1, 4) || 'q' || substring(b, 6) AS a FROM v) JOIN v ON left(a, 3) = left(b, 3) AND levenshtein(a, b) <= greatest(2, length(a) // 3)) WHERE n = 1",
    "join_suffix_sibling": "WITH p AS (SELECT p_partkey, p_type || ' ' || p_name AS name, string_split(p_type || ' ' || p_name, ' ') AS t FROM part), m AS (SELECT name, any_value(t) AS t, min(p_partkey) AS other FROM p GROUP BY name), x AS (SELECT a.name, b.other, row_number() OVER (PARTITION BY a.name ORDER BY CASE WHEN a.t[-2] <> b.t[-2] THEN 1 WHEN a.t[-3] <> b.t[-3] THEN 2 ELSE 3 END DESC, b.other) AS n FROM m a JOIN m b ON a.t[-1] = b.t[-1] AND a.name <> b.name) SELECT p_partkey, other FROM p JOIN x USING (name) WHERE n = 1",
    "sort_parsed_key": "SELECT doc_id, CAST(regexp_extract(source, 'src(\\d+)', 1) AS BIGINT) AS k FROM documents ORDER BY k, doc_id",
    "top_by_max_part": "SELECT conv_id, most, dense_rank() OVER (PARTITION BY conv_id % 10 ORDER BY most DESC) AS rank FROM (SELECT conv_id, max(length(text)) AS most FROM conversations GROUP BY conv_id)",
    "preview_limit": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50",
    "g_tree_label": _UP + " SELECT t.id, (SELECT count(*) FROM up WHERE top = t.id) > 0 AS below, (SELECT min(n) FROM up WHERE top = t.id) AS dist FROM tree t",
    "g_path_to_root": _UP + " SELECT DISTINCT top AS id FROM up",
    "g_value_iteration": _VAL + " SELECT * FROM v",
    "agg_argmax_goal": _VAL + " SELECT id % 10 AS goal, max(v) AS v FROM v GROUP BY 1",
    "g_bounded_bfs": f"WITH RECURSIVE {_TREE}, r AS (SELECT id AS start, id AS node, 0 AS steps FROM tree UNION ALL SELECT start, t.id, steps + 1 FROM r JOIN tree t ON t.parent = r.node WHERE steps < 3) SELECT start, node, CAST(min(steps) AS BIGINT) AS steps FROM r GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
