"""Result sets of experiments: success, joint results, subsets, buckets, curves and reports.

A result frame has one row for each system and item: key columns, `success` and
`time` (null where the run broke).  Keys are equi-join keys throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def succeeded(proof: Column, time: Column, timeout: float = 600.0) -> Column:
    """A result counts if there is one, its time is known and strictly below the timeout."""
    return F.coalesce(proof.isNotNull() & time.isNotNull() & (time < timeout), F.lit(False))


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Share, number and total of successes, in all or by columns."""
    ok = F.col("success").cast("int")
    return results.groupBy(*by).agg(
        F.avg(ok).alias("rate"), F.sum(ok).cast("long").alias("successes"), F.count("*").alias("total"))


def pivot_systems(results: DataFrame, by: str, systems: list) -> DataFrame:
    """Successes side by side, one column for each named system."""
    return results.groupBy(by).agg(*[
        F.sum(F.when(F.col("system") == s, F.col("success").cast("long")).otherwise(0)).alias(f"s{s}") for s in systems])


def joint(a: DataFrame, b: DataFrame, keys: list[str], timeout: float = 600.0, normalise: bool = False) -> DataFrame:
    """Two systems as one: the shorter known time (doubled if normalised) and success of either within the timeout."""
    x = a.select(*keys, F.col("success").alias("s1"), F.col("time").alias("t1"))
    y = b.select(*keys, F.col("success").alias("s2"), F.col("time").alias("t2"))
    time = F.least("t1", "t2") * (2 if normalise else 1)
    either = F.coalesce("s1", F.lit(False)) | F.coalesce("s2", F.lit(False))
    return x.join(y, keys, "full").select(*keys, time.alias("time"), (either & F.coalesce(time < timeout, F.lit(False))).alias("success"))


def restricted(results: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    return results.join(index.select(*keys), keys, "left_semi")


def flags(results: DataFrame, key: str, systems: list) -> DataFrame:
    """For each item, whether each system solved it."""
    return results.groupBy(key).agg(*[
        F.max((F.col("system") == s) & F.col("success")).alias(f"in{i}") for i, s in enumerate(systems)])


def venn(results: DataFrame, key: str, systems: list) -> DataFrame:
    """Sizes of the parts of a Venn diagram of the solved items."""
    names = [f"in{i}" for i in range(len(systems))]
    solved = flags(results, key, systems)
    some = F.lit(False)
    for n in names:
        some = some | F.col(n)
    return solved.where(some).groupBy(*names).agg(F.count("*").alias("n"))


def a_beats_b(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Items that a solved and b tried without success."""
    won = a.where("success").select(key, F.col("time").alias("time_a"))
    return won.join(b.where(~F.col("success")).select(key, F.col("time").alias("time_b")), key)


def duplicate_keys(frame: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once; an evaluation requires that there be none."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique_and_regress(solved: DataFrame, baseline: DataFrame, tried: DataFrame, key: str) -> DataFrame:
    """Solved but not by the baseline ('unique'); solved by the baseline, tried and lost ('regress')."""
    unique = solved.join(baseline, key, "left_anti").select(key, F.lit("unique").alias("kind"))
    lost = baseline.join(tried, key, "left_semi").join(solved, key, "left_anti").select(key, F.lit("regress").alias("kind"))
    return unique.unionByName(lost)


def mutual(results: DataFrame, key: str, n_systems: int, solved: bool = False) -> DataFrame:
    """Items that all systems tried, or all solved."""
    rows = results.where("success") if solved else results
    return rows.groupBy(key).agg(F.countDistinct("system").alias("n")).where(F.col("n") == n_systems).select(key)


def best_run(runs: DataFrame, by: str, order: Column, later_wins: bool) -> DataFrame:
    """The run with most successes of each system; ties to the later or the earlier run."""
    w = Window.partitionBy(by).orderBy(F.desc("successes"), order.desc() if later_wins else order.asc())
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def solvers(results: DataFrame, key: str) -> DataFrame:
    """The systems that solved an item, in order."""
    return results.where("success").groupBy(key).agg(F.array_sort(F.collect_set("system")).alias("systems"))


def bucket(value: Column, ranges: list[tuple[int, int | None]]) -> Column:
    """Label of the first range with lo <= value <= hi; a missing hi is open."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(ranges):
        inside = (value >= lo) if hi is None else value.between(lo, hi)
        out = F.when(inside, F.lit(f"{lo}-{'' if hi is None else hi}")).otherwise(out)
    return out


def cumulative_curve(results: DataFrame, by: str, time: str, tie: str) -> DataFrame:
    """Successes in order of time with their running number."""
    w = Window.partitionBy(by).orderBy(time, tie)
    return results.where("success").select(by, time, tie, F.row_number().over(w).cast("long").alias("y"))


def curve_with_endpoint(results: DataFrame, by: str, time: str, tie: str, timeout: float) -> DataFrame:
    curve = cumulative_curve(results, by, time, tie).select(by, time, "y")
    return curve.unionByName(curve.groupBy(by).agg(F.lit(timeout).alias(time), F.max("y").alias("y")))


def first_k_solved(results: DataFrame, key: str, attempt: str, ks: list[int]) -> DataFrame:
    """For each k, the items solved within the first k attempts."""
    first = results.where("success").groupBy(key).agg(F.min(attempt).alias("first"))
    counts = first.agg(*[F.sum((F.col("first") <= k).cast("long")).alias(f"k{k}") for k in ks])
    return counts.select(F.explode(F.create_map(*[x for k in ks for x in (F.lit(k), F.col(f"k{k}"))])).alias("k", "solved"))


def report(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Counts over the common items: solved by each, newly solved, regressed and net."""
    both = base.select(key, F.col("success").alias("b")).join(new.select(key, F.col("success").alias("n")), key)
    gain, loss = F.sum((F.col("n") & ~F.col("b")).cast("long")), F.sum((F.col("b") & ~F.col("n")).cast("long"))
    return both.agg(F.count("*").alias("common"), F.sum(F.col("b").cast("long")).alias("base"), F.sum(F.col("n").cast("long")).alias("new"),
                    gain.alias("newly"), loss.alias("regressed"), (gain - loss).alias("net"))


def recall_at(ranked: DataFrame, k: int) -> DataFrame:
    """From (query, rank or null of each gold item): share of queries with all gold within k, of gold within k, of queries with any."""
    hit = F.coalesce((F.col("rank") <= k).cast("long"), F.lit(0))
    per = ranked.groupBy("query").agg(F.sum(hit).alias("hits"), F.count("gold").alias("n"))
    return per.agg(
        F.avg((F.col("hits") == F.col("n")).cast("int")).alias("step_recall"),
        (F.sum("hits") / F.expr("nullif(sum(n), 0)")).alias("overall_recall"), F.avg((F.col("hits") > 0).cast("int")).alias("any_recall"))


def rank_quality(ranked: DataFrame) -> DataFrame:
    """Top-1 and top-5 share and median rank of the gold item, by method."""
    return ranked.groupBy("method").agg(
        F.avg((F.col("rank") == 1).cast("int")).alias("top1"), F.avg((F.col("rank") <= 5).cast("int")).alias("top5"), F.median("rank").alias("median_rank"))


def threshold_sweep(pairs: DataFrame, a: str, b: str, grid: list[tuple[int, int]]) -> DataFrame:
    """How many pairs reach both thresholds, for each of a fixed grid."""
    counts = pairs.agg(*[F.sum(((F.col(a) >= x) & (F.col(b) >= y)).cast("long")).alias(f"{x}_{y}") for x, y in grid])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("t1"), F.lit(y).alias("t2"), F.col(f"{x}_{y}").alias("n")) for x, y in grid])).alias("r")).select("r.*")
