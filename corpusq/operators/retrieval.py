"""Sparse and dense retrieval with statistics of each query's own candidates.

Inputs are exploded: query terms (query, term), document terms (doc, term) and
candidates (query, doc, ordinal).  A term's frequencies are counted once for each
document.  Where candidates are the documents of a query's scope (a source, a
file), both term tables carry it, and terms meet by scope and term; otherwise
document terms are cut to those asked for and meet the candidates by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_frequencies(terms: DataFrame, *more: str) -> DataFrame:
    return terms.groupBy("doc", *more, "term").agg(F.count("*").alias("tf"))


def document_frequencies(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.countDistinct("doc").alias("df"))


def lengths(terms: DataFrame) -> DataFrame:
    return terms.groupBy("doc").agg(F.count("*").alias("len"))


def _statistics(query_terms: DataFrame, doc_terms: DataFrame, candidates: DataFrame, scope: str | None) -> tuple[DataFrame, DataFrame]:
    """Candidates with length and their query's N and mean length; (query, doc, term, qtf, tf, df)."""
    more = (scope,) if scope else ()
    counted = term_frequencies(doc_terms, *more)
    size = candidates.join(counted.groupBy("doc").agg(F.sum("tf").alias("len")), "doc", "left").withColumn("len", F.coalesce("len", F.lit(0)))
    n = size.groupBy("query").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    asked = query_terms.groupBy("query", *more, "term").agg(F.count("*").alias("qtf"))
    if scope:
        hits = counted.join(asked, [scope, "term"]).drop(scope)
    else:
        wanted = counted.join(asked.select("term").distinct(), "term", "left_semi")
        hits = wanted.join(candidates.select("query", "doc"), "doc").join(asked, ["query", "term"])
    df = hits.groupBy("query", "term").agg(F.count("*").alias("df"))
    return size.join(n, "query"), hits.join(df, ["query", "term"])


def _scored(candidates: DataFrame, hits: DataFrame, term_score: Column) -> DataFrame:
    """Every candidate with the sum of its terms' scores, 0 without a shared term."""
    total = hits.groupBy("query", "doc").agg(F.sum(term_score).alias("score"))
    return candidates.join(total, ["query", "doc"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def bm25(query_terms: DataFrame, doc_terms: DataFrame, candidates: DataFrame, k1: float = 1.8, b: float = 0.75, scope: str | None = None) -> DataFrame:
    """Scores of all candidates; a repeated query term counts each time.  Returns query, doc, ordinal, score."""
    size, hits = _statistics(query_terms, doc_terms, candidates, scope)
    rows = hits.join(size.select("query", "doc", "len", "n", "avg_len"), ["query", "doc"])
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return _scored(candidates, rows, part).select("query", "doc", "ordinal", "score")


def tfidf(query_terms: DataFrame, doc_terms: DataFrame, candidates: DataFrame, scope: str | None = None) -> DataFrame:
    """Augmented query frequency * (tf / length) * idf squared; a repeated query term counts once, with its frequency."""
    size, hits = _statistics(query_terms, doc_terms, candidates, scope)
    most = query_terms.groupBy("query", "term").count().groupBy("query").agg(F.max("count").alias("most"))
    rows = hits.join(size.select("query", "doc", "len", "n"), ["query", "doc"]).join(most, "query")
    idf = F.log(F.col("n") / F.col("df"))
    part = (0.5 + 0.5 * F.col("qtf") / F.col("most")) * F.col("tf") / F.col("len") * idf * idf
    return _scored(candidates, rows, part).select("query", "doc", "ordinal", "score")


def ranked(scores: DataFrame, *by: str) -> DataFrame:
    """rank from 1 by falling score, ties in candidate order."""
    w = Window.partitionBy(*(by or ("query",))).orderBy(F.desc("score"), "ordinal")
    return scores.withColumn("rank", F.row_number().over(w).cast("long"))


def top_k(scores: DataFrame, k: int, positive: bool = False) -> DataFrame:
    return ranked(scores.where("score > 0") if positive else scores).where(F.col("rank") <= k)


def distinct_cutoff(rows: DataFrame, of: str, k: int, *by: str) -> DataFrame:
    """Ranked rows up to the one at which k distinct values of `of` have been seen; all if there are fewer."""
    by = by or ("query",)
    first = F.row_number().over(Window.partitionBy(*by, of).orderBy("rank")) == 1
    seen = Window.partitionBy(*by).orderBy("rank")
    marked = rows.withColumn("_first", first.cast("int")).withColumn("_seen", F.sum("_first").over(seen.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.lag("_seen").over(seen), F.lit(0))
    return marked.withColumn("_before", before).where(F.col("_before") < k).drop("_first", "_seen", "_before")


def first_occurrence(rows: DataFrame, of: str, *by: str) -> DataFrame:
    w = Window.partitionBy(*(by or ("query",)), of).orderBy("rank")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def two_stage(scores: DataFrame, second: Column, first_k: int, k: int) -> DataFrame:
    """The first_k best by score, ranked again by a second score; ties keep the first order."""
    some = top_k(scores, first_k).withColumnRenamed("rank", "first_rank").withColumn("second", second)
    w = Window.partitionBy("query").orderBy(F.desc("second"), "first_rank")
    return some.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def blended(ranked_rows: DataFrame, typed: str, weight: float = 5.0) -> DataFrame:
    """Order by (n - i) + weight * typed score, ties by the first rank."""
    n = F.count("*").over(Window.partitionBy("query"))
    rows = ranked_rows.withColumn("blend", n - F.col("rank") + 1 + weight * F.col(typed))
    w = Window.partitionBy("query").orderBy(F.desc("blend"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(w).cast("long"))


def lookup(candidates: DataFrame, goal_names: str, hyp_names: str, name: str, stdlib: str) -> DataFrame:
    """1 for a name of the goal, 0.7 for one of the hypotheses, half of it from the standard library; others are dropped."""
    base = F.when(F.array_contains(goal_names, F.col(name)), 1.0).when(F.array_contains(hyp_names, F.col(name)), 0.7).otherwise(0.0)
    return candidates.withColumn("score", base * F.when(F.col(stdlib), 0.5).otherwise(1.0)).where("score > 0")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def dense(queries: DataFrame, docs: DataFrame, on: list[str], k: int, score: Column) -> DataFrame:
    """Exact top k of the documents that share the `on` columns with a query (query, qv; doc, ordinal, v).

    Only the best k of each partition part are exchanged: ranks are taken in 64
    parts of a query's candidates first, then over their winners.
    """
    pairs = docs.join(queries, on).select("query", "doc", "ordinal", score.alias("score")).withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(64)))
    return top_k(ranked(pairs, "query", "part").where(F.col("rank") <= k).drop("rank", "part"), k)


def dense_groups(queries: DataFrame, docs: DataFrame, on: list[str], group: str, k: int, score: Column) -> DataFrame:
    """The k best distinct groups (proofs) of each query: a group counts with its best member (step), ties to the smaller ordinal."""
    pairs = docs.join(queries, on).select("query", group, "ordinal", score.alias("score"))
    best = pairs.groupBy("query", group).agg(F.max(F.struct("score", (-F.col("ordinal")).alias("n"))).alias("b"))
    return top_k(best.select("query", group, F.col("b.score").alias("score"), (-F.col("b.n")).alias("ordinal")), k)


def structured_context(goals: DataFrame, index: DataFrame, edges: DataFrame, depth: int, most: int, budget: int) -> DataFrame:
    """Definitions that a goal refers to: seeds, then what they refer to up to a depth, ranked and cut to a budget.

    goals: goal, name, in_hyp, in_goal (one row for each name); index: name, size
    (tokens), parts (constructors), std; edges: name, refers.  Standard library
    names are leaves and are left out.  Names of hypotheses go before those of the
    conclusion, near ones before far ones, small ones before large ones.
    """
    known = index.where("NOT std").select("name", "size", "parts")
    seeds = goals.groupBy("goal", "name").agg(F.max("in_hyp").alias("in_hyp"), F.max("in_goal").alias("in_goal"))
    front = seeds.select("goal", "name").join(known.select("name"), "name", "left_semi").withColumn("depth", F.lit(0))
    found = front
    for d in range(1, depth + 1):
        front = front.join(edges, "name").select("goal", F.col("refers").alias("name"), F.lit(d).alias("depth")).distinct().join(
            known.select("name"), "name", "left_semi").select("goal", "name", "depth")
        found = found.select("goal", "name", "depth").unionByName(front)
    rows = found.groupBy("goal", "name").agg(F.min("depth").alias("depth")).join(known, "name").join(seeds, ["goal", "name"], "left")
    value = (
        F.when(F.col("in_hyp"), 10).otherwise(0) + F.when(F.col("in_goal"), 5).otherwise(0) + (depth - F.col("depth")) * 2
        + F.greatest(F.lit(0.0), 3 - F.col("parts") * 0.2))
    w = Window.partitionBy("goal").orderBy(F.desc("value"), "depth", "name")
    ranked_rows = rows.withColumn("value", value).withColumn("rank", F.row_number().over(w).cast("long")).withColumn(
        "used", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked_rows.where((F.col("used") <= budget) & (F.col("rank") <= most)).select("goal", "name", "depth", "rank")


def gather(requests: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of requested ids in request order, repeats included."""
    return requests.select("request", F.posexplode("ids").alias("pos", "id")).join(vectors, "id", "left")


def hit_ranks(ranked_rows: DataFrame, positives: DataFrame) -> DataFrame:
    """The rank of each positive, null if it is not ranked."""
    return positives.join(ranked_rows.select("query", "doc", "rank"), ["query", "doc"], "left")


def least_squares(pairs: DataFrame, x: str, y: str, dims_x: int, dims_y: int, ridge: float = 1e-9):
    """The matrix that maps x to y with least squares; the sums of products are made by executors, dims_x * (dims_x + dims_y) numbers."""
    import numpy as np

    row = pairs.agg(*[
        F.sum(F.col(x)[i].cast("double") * F.col(c)[j].cast("double")).alias(f"{c}{i}_{j}") for i in range(dims_x) for c, n in ((x, dims_x), (y, dims_y)) for j in range(n)]).first()
    xx = np.array([[row[f"{x}{i}_{j}"] for j in range(dims_x)] for i in range(dims_x)])
    xy = np.array([[row[f"{y}{i}_{j}"] for j in range(dims_y)] for i in range(dims_x)])
    return np.linalg.solve(xx + ridge * np.eye(dims_x), xy)
