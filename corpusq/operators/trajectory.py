"""Step sequences: rewards, values, spans and training pairs.

A step frame has one row for each step: a trajectory key, its position `i` from 0,
and columns of the operator.  Every window is partitioned by the trajectory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(key: str, i: str = "i"):
    return Window.partitionBy(key).orderBy(i)


def up_to(key: str, i: str = "i"):
    return order(key, i).rowsBetween(Window.unboundedPreceding, 0)


def previous(column: str, key: str, default: str = "<bos>") -> Column:
    return F.lag(column, 1, default).over(order(key))


def remaining(key: str) -> Column:
    return F.count("*").over(Window.partitionBy(key)) - F.col("i") - 1


def bigrams(steps: DataFrame, column: str, key: str, least: int = 1) -> DataFrame:
    """Counts of (previous, next) with a start mark, and of next alone."""
    pairs = steps.withColumn("prev", previous(column, key)).groupBy("prev", F.col(column).alias("next")).agg(F.count("*").alias("n"))
    return pairs.where(F.col("n") >= least)


def backoff_logprob(pairs: DataFrame, k: float = 1.0, weight: float = 0.5) -> DataFrame:
    """Log of the add-k bigram probability mixed with the unigram one, at least 1e-12."""
    sizes = pairs.agg(F.countDistinct("next").alias("v"), F.sum("n").alias("all"))
    prev = pairs.groupBy("prev").agg(F.sum("n").alias("pn"))
    single = pairs.groupBy("next").agg(F.sum("n").alias("un"))
    p = weight * (F.col("n") + k) / (F.col("pn") + k * F.col("v")) + (1 - weight) * F.col("un") / F.col("all")
    return pairs.join(prev, "prev").join(single, "next").crossJoin(F.broadcast(sizes)).select("prev", "next", F.log(F.greatest(p, F.lit(1e-12))).alias("logprob"))


def nested_map(pairs: DataFrame) -> DataFrame:
    """{previous: {next: count}} as one map for each previous."""
    return pairs.groupBy("prev").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("next", "n")))).alias("next"))


def state_values(steps: DataFrame, key: str, state: str, success: str) -> DataFrame:
    """For each state, the share of successful trajectories through it; a trajectory counts once."""
    return steps.select(key, state, success).distinct().groupBy(state).agg(
        F.count("*").alias("attempts"), F.avg(F.col(success).cast("int")).alias("value"))


def next_value_rewards(steps: DataFrame, values: DataFrame, key: str, state: str, success: str) -> DataFrame:
    """The value of the next state; the last step gets the outcome."""
    v = steps.join(values.select(state, F.col("value")), state, "left")
    return v.withColumn("reward", F.coalesce(F.lead("value").over(order(key)), F.col(success).cast("double")))


def potential_shaping(phi: str, key: str, gamma: float, kind: str | None = None) -> Column:
    """gamma * potential of the next state - potential of this; the last, complete and invalid steps have no next potential."""
    ahead = F.coalesce(F.lead(phi).over(order(key)), F.lit(0.0))
    if kind is not None:
        ahead = F.when(F.col(kind).isin("COMPLETE", "INVALID"), F.lit(0.0)).otherwise(ahead)
    return gamma * ahead - F.col(phi)


def checker_rewards(result: Column, solved: Column) -> Column:
    """1 for steps of a solved attempt and -0.05 otherwise; an invalid step always -0.1."""
    return F.when(result == "INVALID", -0.1).when(solved, 1.0).otherwise(-0.05)


def sticky(flag: Column, key: str) -> Column:
    """True from the first step with the flag on."""
    return F.max(flag).over(up_to(key))


def aligned(equal: Column, key: str) -> Column:
    """True as long as no step has deviated."""
    return F.min(equal).over(up_to(key))


def carried(count: str, key: str) -> Column:
    """A count of 0 takes the last count that was not, at first 1."""
    return F.coalesce(F.last(F.nullif(F.col(count), F.lit(0)), ignorenulls=True).over(up_to(key)), F.lit(1))


def subtree_spans(steps: DataFrame, key: str, count: str) -> DataFrame:
    """For each step with a count of 2 or more, the first later step whose count is below it, if it is just one below."""
    a = steps.select(key, F.col("i").alias("start"), F.col(count).alias("c")).where("c >= 2")
    b = steps.select(key, F.col("i").alias("k"), F.col(count).alias("ck"))
    first = a.join(b, key).where((F.col("k") > F.col("start")) & (F.col("ck") <= F.col("c") - 1)).groupBy(key, "start", "c").agg(
        F.min(F.struct("k", "ck")).alias("m"))
    return first.where(F.col("m.ck") == F.col("c") - 1).select(key, "start", F.col("m.k").alias("end"))


def segments(steps: DataFrame, key: str, term: str) -> DataFrame:
    """Number of each run of equal terms."""
    changed = F.coalesce(F.col(term) != F.lag(term).over(order(key)), F.lit(True)).cast("int")
    return steps.withColumn("_c", changed).withColumn("segment", F.sum("_c").over(up_to(key))).drop("_c")


def prefix_text(text: str, key: str, sep: str = "") -> Column:
    return F.concat_ws(sep, F.collect_list(text).over(order(key).rowsBetween(Window.unboundedPreceding, -1)))


def suffix_list(text: str, key: str) -> Column:
    return F.collect_list(text).over(order(key).rowsBetween(0, Window.unboundedFollowing))


def prefixes(steps: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Every start 1 to L - 1 that leaves low to high steps."""
    return steps.withColumn("left", F.count("*").over(Window.partitionBy(key)) - F.col("i")).where((F.col("i") >= 1) & F.col("left").between(low, high))


def last_k(steps: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """The last min(k, L - 1) steps of trajectories of two or more, and the rest as prefix."""
    n = steps.withColumn("n", F.count("*").over(Window.partitionBy(key))).where("n >= 2").withColumn("cut", F.col("n") - F.least(F.lit(k), F.col("n") - 1))
    row = F.struct("i", text)
    parts = n.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("i") < F.col("cut"), row))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("i") >= F.col("cut"), row))).alias("b"))
    return parts.select(key, F.array_join(F.transform("a", lambda x: x[text]), "").alias("prefix"), F.array_join(F.transform("b", lambda x: x[text]), "").alias("target"))


def decompose_starts(steps: DataFrame, key: str, count: str, cap: int) -> DataFrame:
    """Steps after which the count grows, with the number of parts; the smallest counts first, at most cap."""
    rows = steps.withColumn("up", F.lead(count).over(order(key)) - F.col(count)).where("up > 0")
    w = Window.partitionBy(key).orderBy(count, "i")
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap).select(key, "i", (F.col("up") + 1).alias("n_sub"))


def leaf_starts(steps: DataFrame, key: str, count: str, cap: int) -> DataFrame:
    """Steps where the count changes, with the distance to the first later lower count or the end; smallest first, at most cap."""
    rows = steps.withColumn("n", F.count("*").over(Window.partitionBy(key))).withColumn("was", F.lag(count).over(order(key)))
    a = rows.where(F.col("was").isNotNull() & (F.col("was") != F.col(count))).select(key, F.col("i").alias("start"), F.col(count).alias("c"), "n")
    b = steps.select(F.col(key).alias("_k"), F.col("i").alias("k"), F.col(count).alias("ck"))
    ends = a.join(b, (F.col(key) == F.col("_k")) & (F.col("k") > F.col("start")) & (F.col("ck") < F.col("c")), "left").groupBy(key, "start", "n").agg(F.min("k").alias("k"))
    sized = ends.withColumn("size", F.coalesce("k", "n") - F.col("start"))
    w = Window.partitionBy(key).orderBy("size", "start")
    return sized.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap).select(key, "start", "size")


def until_first(steps: DataFrame, key: str, close: Column) -> DataFrame:
    """Steps before the first closing one, and that one."""
    seen = F.sum(F.coalesce(close, F.lit(False)).cast("int")).over(order(key).rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("_s", F.coalesce(seen, F.lit(0))).where("_s = 0").drop("_s")


def opening_spans(steps: DataFrame, key: str, text: str, at: Column, opening: Column) -> DataFrame:
    """For each marked step, it and the run of opening steps just before it, joined."""
    shut = F.max(F.when(~opening, F.col("i"))).over(order(key).rowsBetween(Window.unboundedPreceding, -1))
    marked = steps.withColumn("low", F.coalesce(shut, F.lit(-1)) + 1).where(at).select(key, F.col("i").alias("at"), "low")
    s = steps.select(key, "i", text)
    return marked.join(s, key).where((F.col("i") >= F.col("low")) & (F.col("i") <= F.col("at"))).groupBy(key, "at").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text))), lambda x: x[text]), " ").alias("span")).dropDuplicates([key, "span"])


def dpo_pairs(nodes: DataFrame, state: str, action: str, good: Column, cap: int | None = None) -> DataFrame:
    """Chosen and rejected actions of one state, unlike each other; an action that is also chosen is not rejected; at most cap."""
    chosen = nodes.where(good).select(state, F.col(action).alias("chosen")).distinct()
    rejected = nodes.where(~good).select(state, F.col(action).alias("rejected")).distinct()
    rejected = rejected.join(chosen.select(state, F.col("chosen").alias("rejected")), [state, "rejected"], "left_anti")
    pairs = chosen.join(rejected, state)
    if cap is None:
        return pairs
    w = Window.partitionBy(state).orderBy("chosen", "rejected")
    return pairs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap).drop("nth")


def divergence(steps: DataFrame, gold: DataFrame, key: str, state: str) -> DataFrame:
    """The last step on the gold path before the first that isn't."""
    on = steps.join(gold.select(state, F.lit(True).alias("on")).distinct(), state, "left").withColumn("on", F.coalesce("on", F.lit(False)))
    off = on.where("NOT on").groupBy(key).agg(F.min("i").alias("off"))
    return on.where("on").join(off, key).where(F.col("i") < F.col("off")).groupBy(key).agg(F.max("i").alias("last"), F.first("off").alias("off"))


def mc_advantages(value: str, key: str, kind: str) -> Column:
    """Value of the next state less that of this; complete counts as 1, invalid as 0."""
    ahead = F.when(F.col(kind) == "COMPLETE", 1.0).when(F.col(kind) == "INVALID", 0.0).otherwise(F.lead(value).over(order(key)))
    return ahead - F.col(value)


def group_diagnostics(attempts: DataFrame, group: str) -> DataFrame:
    """Numbers of groups, dead and mixed ones, and the mean population deviation of rewards."""
    g = attempts.groupBy(group).agg(F.max("reward").alias("hi"), F.min("reward").alias("lo"), F.stddev_pop("reward").alias("sd"))
    return g.agg(F.count("*").alias("groups"), F.sum((F.col("hi") < 1).cast("long")).alias("dead"),
                 F.sum(((F.col("hi") >= 1) & (F.col("lo") < 1)).cast("long")).alias("mixed"), F.avg("sd").alias("mean_sd"))
