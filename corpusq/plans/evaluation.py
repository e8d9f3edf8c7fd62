"""Evaluation queries over lineitem and labels.

An item is an order, a system a line number (1 to 7), a project a return flag and a
status; the time is 20 times the quantity, null for lines without tax.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators import evaluation as ev
from corpusq.operators import stats
from corpusq.sources.tables import table

RANGES = [(0, 4), (5, 9), (10, 19), (20, 39), (40, None)]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.when(F.col("l_tax") > 0, F.col("l_quantity") * 20)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item"), F.col("l_linenumber").cast("long").alias("system"),
        F.concat("l_returnflag", "l_linestatus").alias("project"), time.alias("time"),
        ev.succeeded(F.col("l_partkey"), time).alias("success"), F.col("l_extendedprice").alias("price"))


RESULTS = """results AS (SELECT l_orderkey AS item, CAST(l_linenumber AS BIGINT) AS system, l_returnflag || l_linestatus AS project,
 CASE WHEN l_tax > 0 THEN l_quantity * 20 END AS time, coalesce(l_partkey IS NOT NULL AND l_tax > 0 AND l_quantity * 20 < 600, false) AS success, l_extendedprice AS price FROM lineitem)"""


def of(r: DataFrame, system: int) -> DataFrame:
    return r.where(F.col("system") == system)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def flt_success(s, d):
    return results(s, d).groupBy("system").agg(F.sum(F.col("success").cast("long")).alias("n"), F.sum(F.col("time").isNull().cast("long")).alias("broken"))


def agg_by_project(s, d):
    return _rounded(ev.summary(results(s, d), "project"), "rate")


def agg_totals(s, d):
    return _rounded(ev.summary(results(s, d)), "rate")


def agg_pivot_systems(s, d):
    return ev.pivot_systems(results(s, d), "project", [1, 2, 3])


def agg_split_counts(s, d):
    r = results(s, d).withColumn("split", F.when(F.col("system") == 1, "test").when(F.col("system") == 2, "val").otherwise("train"))
    return r.rollup("split").agg(F.countDistinct("project").alias("repos"), F.countDistinct("item").alias("proofs"), F.count("*").alias("steps")).select(
        F.coalesce("split", F.lit("total")).alias("split"), "repos", "proofs", "steps")


def agg_mean_median(s, d):
    return _rounded(results(s, d).where("success").groupBy("system").agg(F.avg("time").alias("mean"), F.median("time").alias("median")), "mean", "median")


def agg_bucket_len(s, d):
    r = results(s, d).withColumn("bucket", ev.bucket(F.col("price") / 1000, RANGES))
    return _rounded(ev.summary(r.where("bucket IS NOT NULL"), "bucket"), "rate")


def agg_num_deps(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg((F.countDistinct("l_suppkey") - 1).alias("deps"), F.count("*").alias("links"))


def agg_bucket_dep(s, d):
    deps = agg_num_deps(s, d).select(F.col("l_orderkey").alias("item"), "deps")
    r = results(s, d).join(deps, "item").withColumn("bucket", ev.bucket(F.col("deps"), [(0, 0), (1, 2), (3, None)]))
    return r.groupBy("system", "bucket").agg(F.sum(F.col("success").cast("long")).alias("ok"), F.count("*").alias("n"))


def agg_error_fraction(s, d):
    return results(s, d).groupBy("system").agg(F.round(F.avg(F.col("time").isNull().cast("int")), 6).alias("share"))


def agg_cost(s, d):
    per = results(s, d).groupBy("item").agg(F.collect_list(F.col("price").cast("decimal(18,2)")).alias("costs"))
    return per.agg(F.sum(F.aggregate("costs", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x).cast("decimal(28,2)"))).cast("double").alias("cost"))


def agg_best_run(s, d):
    runs = results(s, d).groupBy("project", "system").agg(F.sum(F.col("success").cast("long")).alias("successes"))
    late, early = ev.best_run(runs, "project", F.col("system"), True), ev.best_run(runs, "project", F.col("system"), False)
    return late.withColumnRenamed("system", "late").join(early.select("project", F.col("system").alias("early")), "project")


def agg_union_solvers(s, d):
    return ev.solvers(results(s, d), "item").select("item", F.array_join("systems", ",").alias("systems"))


def agg_passk(s, d):
    return ev.first_k_solved(results(s, d), "item", "system", [1, 2, 4, 7]).select(F.col("k").cast("long").alias("k"), "solved")


def agg_paired_2x2(s, d):
    lab = table(s, d, "labels")
    return lab.agg(*stats.paired_2x2(F.col("quality") == 1, F.col("toxic") == 1))


def agg_wilson(s, d):
    g = results(s, d).groupBy("system").agg(F.sum(F.col("success").cast("long")).alias("x"), F.count("*").alias("n"))
    lo, hi = stats.wilson(F.col("x"), F.col("n"))
    return g.select("system", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def agg_mcnemar(s, d):
    c = agg_paired_2x2(s, d).select(F.least("only_a", F.lit(60)).alias("b"), F.least("only_b", F.lit(40)).alias("c"))
    return c.select(F.round(stats.mcnemar(F.col("b"), F.col("c")), 8).alias("p"))


def agg_mixed_dead(s, d):
    g = results(s, d).groupBy("item").agg(F.min("success").alias("lo"), F.max("success").alias("hi"))
    return g.groupBy(F.when(F.col("lo"), "all").when(F.col("hi"), "mixed").otherwise("dead").alias("kind")).agg(F.count("*").alias("n"))


def agg_hist_capped(s, d):
    size = results(s, d).groupBy("item").agg(F.count("*").alias("n"))
    return size.groupBy(F.least("n", F.lit(5)).alias("capped")).agg(F.count("*").alias("items"))


def join_eval_outer(s, d):
    r = results(s, d)
    return ev.joint(of(r, 1), of(r, 4), ["item"], normalise=True).select("item", F.round("time", 6).alias("time"), "success")


def join_eval_index(s, d):
    r = results(s, d)
    return ev.restricted(of(r, 1), of(r, 3), ["item"]).select("item", "success")


def join_a_beats_b(s, d):
    r = results(s, d)
    return ev.a_beats_b(of(r, 1), of(r, 2), "item")


def join_two_subsets(s, d):
    return ev.venn(results(s, d), "item", [1, 2])


def join_three_subsets(s, d):
    return ev.venn(results(s, d), "item", [1, 2, 3])


def join_unique_regress(s, d):
    r = results(s, d)
    ok = r.where("success")
    return ev.unique_and_regress(*(f.select("item").distinct() for f in (of(ok, 2), of(ok, 1), of(r, 2))), "item")


def join_mutual(s, d):
    r = results(s, d).where("system <= 3")
    return ev.mutual(r, "item", 3).withColumn("kind", F.lit("tried")).unionByName(ev.mutual(r, "item", 3, True).withColumn("kind", F.lit("solved")))


def join_positional(s, d):
    r = results(s, d)
    a, b = of(r, 1).select("item", F.col("time").alias("t1")), of(r, 2).select("item", F.col("time").alias("t2"))
    return a.join(b, "item").select("item", F.round(F.col("t1") - F.col("t2"), 6).alias("diff"))


def set_total_success(s, d):
    return results(s, d).where("success AND system IN (1, 2)").agg(F.countDistinct("item").alias("n"))


def set_diff(s, d):
    ok = results(s, d).where("success")
    return of(ok, 1).select("item").subtract(of(ok, 2).select("item"))


def set_inter(s, d):
    ok = results(s, d).where("success")
    return of(ok, 1).select("item").intersect(of(ok, 2).select("item"))


def set_same_keys(s, d):
    r = results(s, d)
    return of(r, 1).select("item", F.lit(1).alias("a")).join(of(r, 2).select("item", F.lit(1).alias("b")), "item", "full").agg(
        F.sum((F.col("a").isNull() | F.col("b").isNull()).cast("long")).alias("different"))


def dedup_nondup_keys(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n = 1").select("l_orderkey")


def dedup_shortest(s, d):
    return results(s, d).where("success").groupBy("item").agg(F.min_by("system", F.struct("time", "system")).alias("system"))


def win_cumulative_curve(s, d):
    return ev.cumulative_curve(results(s, d).where("system <= 2"), "system", "time", "item")


def win_curve_with_endpoint(s, d):
    return ev.curve_with_endpoint(results(s, d).where("system <= 2"), "system", "time", "item", 600.0)


def sort_multi_key(s, d):
    runs = results(s, d).groupBy("system").agg(F.sum(F.col("success").cast("long")).alias("ok"), F.countDistinct("project").alias("projects"))
    return runs.orderBy(F.desc("projects"), F.desc("ok"), "system")


def agg_run_report(s, d):
    r = results(s, d)
    return ev.report(of(r, 1), of(r, 2), "item")


def flt_project(s, d):
    return results(s, d).where(F.col("project").isin("AF", "RF")).dropDuplicates(["item", "system", "project"]).groupBy("project").agg(F.count("*").alias("n"))


def flt_range_len(s, d):
    return results(s, d).where(F.col("success") & F.col("price").between(1000, 20000)).groupBy("system").agg(F.count("*").alias("n"))


def agg_threshold_sweep(s, d):
    grid = [(a, b) for a in (10, 20, 40) for b in (100, 300, 500)]
    r = results(s, d).select((F.col("price") / 1000).alias("a"), F.coalesce("time", F.lit(0.0)).alias("b"))
    return ev.threshold_sweep(r, "a", "b", grid).select(F.col("t1").cast("long").alias("t1"), F.col("t2").cast("long").alias("t2"), "n")


_BUCKET = "CASE WHEN price/1000 BETWEEN 0 AND 4 THEN '0-4' WHEN price/1000 BETWEEN 5 AND 9 THEN '5-9' WHEN price/1000 BETWEEN 10 AND 19 THEN '10-19' WHEN price/1000 BETWEEN 20 AND 39 THEN '20-39' WHEN price/1000 >= 40 THEN '40-' END"
_OK = "CAST(sum(CAST(success AS INT)) AS BIGINT)"
_VENN = "SELECT {names}, count(*) AS n FROM (SELECT item, {flags} FROM results GROUP BY item) WHERE {any} GROUP BY {names}"


def _venn(n: int) -> str:
    names = ", ".join(f"in{i}" for i in range(n))
    return f"WITH {RESULTS} " + _VENN.format(names=names, flags=", ".join(f"bool_or(system = {i + 1} AND success) AS in{i}" for i in range(n)), any=" OR ".join(f"in{i}" for i in range(n)))


def _with(sql: str) -> str:
    return f"WITH {RESULTS} {sql}"


QUERIES = {f.__name__: f for f in (
    flt_success, agg_by_project, agg_totals, agg_pivot_systems, agg_split_counts, agg_mean_median, agg_bucket_len, agg_num_deps, agg_bucket_dep,
    agg_error_fraction, agg_cost, agg_best_run, agg_union_solvers, agg_passk, agg_paired_2x2, agg_wilson, agg_mcnemar, agg_mixed_dead, agg_hist_capped,
    join_eval_outer, join_eval_index, join_a_beats_b, join_two_subsets, join_three_subsets, join_unique_regress, join_mutual, join_positional,
    set_total_success, set_diff, set_inter, set_same_keys, dedup_nondup_keys, dedup_shortest, win_cumulative_curve, win_curve_with_endpoint,
    sort_multi_key, agg_run_report, flt_project, flt_range_len, agg_threshold_sweep)}

ORACLE_SQL = {
    "flt_success": _with(f"SELECT system, {_OK} AS n, count(*) - count(time) AS broken FROM results GROUP BY system"),
    "agg_by_project": _with(f"SELECT project, round(avg(CAST(success AS INT)), 6) AS rate, {_OK} AS successes, count(*) AS total FROM results GROUP BY project"),
    "agg_totals": _with(f"SELECT round(avg(CAST(success AS INT)), 6) AS rate, {_OK} AS successes, count(*) AS total FROM results"),
    "agg_pivot_systems": _with("SELECT project, " + ", ".join(f"count(*) FILTER (WHERE system = {i} AND success) AS s{i}" for i in (1, 2, 3)) + " FROM results GROUP BY project"),
    "agg_split_counts": _with("SELECT coalesce(split, 'total') AS split, count(DISTINCT project) AS repos, count(DISTINCT item) AS proofs, count(*) AS steps FROM (SELECT *, CASE system WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS split FROM results) GROUP BY ROLLUP (split)"),
    "agg_mean_median": _with("SELECT system, round(avg(time), 6) AS mean, round(median(time), 6) AS median FROM results WHERE success GROUP BY system"),
    "agg_bucket_len": _with(f"SELECT bucket, round(avg(CAST(success AS INT)), 6) AS rate, {_OK} AS successes, count(*) AS total FROM (SELECT *, {_BUCKET} AS bucket FROM results) WHERE bucket IS NOT NULL GROUP BY bucket"),
    "agg_num_deps": "SELECT l_orderkey, count(DISTINCT l_suppkey) - 1 AS deps, count(*) AS links FROM lineitem GROUP BY l_orderkey",
    "agg_bucket_dep": _with(f"SELECT system, CASE WHEN deps = 0 THEN '0-0' WHEN deps <= 2 THEN '1-2' ELSE '3-' END AS bucket, {_OK} AS ok, count(*) AS n FROM results JOIN (SELECT l_orderkey AS item, count(DISTINCT l_suppkey) - 1 AS deps FROM lineitem GROUP BY 1) USING (item) GROUP BY 1, 2"),
    "agg_error_fraction": _with("SELECT system, round(avg(CASE WHEN time IS NULL THEN 1 ELSE 0 END), 6) AS share FROM results GROUP BY system"),
    "agg_cost": "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM lineitem",
    "agg_best_run": _with(f"SELECT project, max(successes) AS successes, arg_max(system, successes * 100 + system) AS late, arg_max(system, successes * 100 - system) AS early FROM (SELECT project, system, {_OK} AS successes FROM results GROUP BY 1, 2) GROUP BY project"),
    "agg_union_solvers": _with("SELECT item, string_agg(DISTINCT CAST(system AS VARCHAR), ',' ORDER BY CAST(system AS VARCHAR)) AS systems FROM results WHERE success GROUP BY item"),
    "agg_passk": _with("SELECT k, (SELECT count(*) FROM (SELECT item, min(system) AS f FROM results WHERE success GROUP BY item) WHERE f <= k) AS solved FROM (VALUES (CAST(1 AS BIGINT)), (2), (4), (7)) AS t(k)"),
    "agg_paired_2x2": "SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS \"both\", count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS only_a, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS only_b, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS neither FROM labels",
    "agg_wilson": _with(f"SELECT system, round(100 * ((x/n + 1.96*1.96/(2*n)) - 1.96*sqrt(x/n*(1-x/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n), 6) AS lo, round(100 * ((x/n + 1.96*1.96/(2*n)) + 1.96*sqrt(x/n*(1-x/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n), 6) AS hi FROM (SELECT system, CAST({_OK} AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n FROM results GROUP BY system)"),
    "agg_mcnemar": "WITH c AS (SELECT least(count(*) FILTER (WHERE quality = 1 AND toxic <> 1), 60) AS b, least(count(*) FILTER (WHERE quality <> 1 AND toxic = 1), 40) AS c FROM labels) SELECT round(least(1.0, 2 * sum(exp(lgamma(b+c+1.0) - lgamma(i+1.0) - lgamma(b+c-i+1.0) - (b+c)*ln(2.0)))), 8) AS p FROM c, range(0, 1000) AS r(i) WHERE i <= least(b, c)",
    "agg_mixed_dead": _with("SELECT CASE WHEN bool_and(success) THEN 'all' WHEN bool_or(success) THEN 'mixed' ELSE 'dead' END AS kind, count(*) AS n FROM results GROUP BY item").replace("SELECT CASE", "SELECT kind, count(*) AS n FROM (SELECT CASE").replace(", count(*) AS n FROM results GROUP BY item", " FROM results GROUP BY item) GROUP BY kind").replace("ELSE 'dead' END AS kind FROM", "ELSE 'dead' END AS kind FROM"),
    "agg_hist_capped": _with("SELECT least(n, 5) AS capped, count(*) AS items FROM (SELECT item, count(*) AS n FROM results GROUP BY item) GROUP BY 1"),
    "join_eval_outer": _with("SELECT coalesce(a.item, b.item) AS item, round(2 * least(a.time, b.time), 6) AS time, (coalesce(a.success, false) OR coalesce(b.success, false)) AND coalesce(2 * least(a.time, b.time) < 600, false) AS success FROM (SELECT * FROM results WHERE system = 1) a FULL JOIN (SELECT * FROM results WHERE system = 4) b ON a.item = b.item"),
    "join_eval_index": _with("SELECT item, success FROM results a WHERE system = 1 AND EXISTS (SELECT 1 FROM results b WHERE b.system = 3 AND b.item = a.item)"),
    "join_a_beats_b": _with("SELECT a.item, a.time AS time_a, b.time AS time_b FROM results a JOIN results b ON a.item = b.item WHERE a.system = 1 AND b.system = 2 AND a.success AND NOT b.success"),
    "join_two_subsets": _venn(2),
    "join_three_subsets": _venn(3),
    "join_unique_regress": _with("SELECT DISTINCT item, 'unique' AS kind FROM results a WHERE system = 2 AND success AND item NOT IN (SELECT item FROM results WHERE system = 1 AND success) UNION ALL SELECT DISTINCT item, 'regress' FROM results WHERE system = 1 AND success AND item IN (SELECT item FROM results WHERE system = 2) AND item NOT IN (SELECT item FROM results WHERE system = 2 AND success)"),
    "join_mutual": _with("SELECT item, 'tried' AS kind FROM results WHERE system <= 3 GROUP BY item HAVING count(DISTINCT system) = 3 UNION ALL SELECT item, 'solved' FROM results WHERE system <= 3 AND success GROUP BY item HAVING count(DISTINCT system) = 3"),
    "join_positional": _with("SELECT a.item, round(a.time - b.time, 6) AS diff FROM results a JOIN results b ON a.item = b.item AND a.system = 1 AND b.system = 2"),
    "set_total_success": _with("SELECT count(DISTINCT item) AS n FROM results WHERE success AND system IN (1, 2)"),
    "set_diff": _with("SELECT item FROM results WHERE success AND system = 1 EXCEPT SELECT item FROM results WHERE success AND system = 2"),
    "set_inter": _with("SELECT item FROM results WHERE success AND system = 1 INTERSECT SELECT item FROM results WHERE success AND system = 2"),
    "set_same_keys": _with("SELECT count(*) FILTER (WHERE a.item IS NULL OR b.item IS NULL) AS different FROM (SELECT item FROM results WHERE system = 1) a FULL JOIN (SELECT item FROM results WHERE system = 2) b ON a.item = b.item"),
    "dedup_nondup_keys": "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1",
    "dedup_shortest": _with("SELECT item, system FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY time, system) AS n FROM results WHERE success) WHERE n = 1"),
    "win_cumulative_curve": _with("SELECT system, time, item, row_number() OVER (PARTITION BY system ORDER BY time, item) AS y FROM results WHERE success AND system <= 2"),
    "win_curve_with_endpoint": _with(", c AS (SELECT system, time, row_number() OVER (PARTITION BY system ORDER BY time, item) AS y FROM results WHERE success AND system <= 2) SELECT * FROM c UNION ALL SELECT system, 600.0, max(y) FROM c GROUP BY system").replace(") , c", "), c"),
    "sort_multi_key": _with(f"SELECT system, {_OK} AS ok, count(DISTINCT project) AS projects FROM results GROUP BY system ORDER BY projects DESC, ok DESC, system"),
    "agg_run_report": _with("SELECT count(*) AS common, count(*) FILTER (WHERE a.success) AS base, count(*) FILTER (WHERE b.success) AS new, count(*) FILTER (WHERE b.success AND NOT a.success) AS newly, count(*) FILTER (WHERE a.success AND NOT b.success) AS regressed, count(*) FILTER (WHERE b.success AND NOT a.success) - count(*) FILTER (WHERE a.success AND NOT b.success) AS net FROM results a JOIN results b ON a.item = b.item AND a.system = 1 AND b.system = 2"),
    "flt_project": _with("SELECT project, count(*) AS n FROM (SELECT DISTINCT item, system, project FROM results WHERE project IN ('AF', 'RF')) GROUP BY project"),
    "flt_range_len": _with("SELECT system, count(*) AS n FROM results WHERE success AND price BETWEEN 1000 AND 20000 GROUP BY system"),
    "agg_threshold_sweep": _with("SELECT t1, t2, (SELECT count(*) FROM results WHERE price / 1000 >= t1 AND coalesce(time, 0) >= t2) AS n FROM (VALUES (CAST(10 AS BIGINT)), (20), (40)) AS x(t1), (VALUES (CAST(100 AS BIGINT)), (300), (500)) AS y(t2)"),
}
