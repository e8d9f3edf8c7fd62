"""Trajectory queries over events: a user is a trajectory, an event type an action.

The state of a step is its event type and the tens of its value; the count of open
goals is the value modulo 4; a trajectory succeeds if its first event is a purchase
or its values sum to an even number.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusq.operators import stats
from corpusq.operators import trajectory as tr
from corpusq.sources.tables import table


def steps(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").withColumn("v", F.floor(F.abs("value")).cast("long"))
    return e.select(
        "user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("event_type").alias("act"), "v", (F.col("v") % 4).alias("goals"),
        F.concat("event_type", F.lit("/"), (F.col("v") % 7).cast("string")).alias("state"),
        (F.sum("v").over(Window.partitionBy("user_id")) % 2 == 0).alias("success"),
        F.when(F.col("v") % 5 == 0, "INVALID").when(F.col("v") % 11 == 0, "COMPLETE").otherwise("VALID").alias("kind"))


STEPS = """steps AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type AS act, v, v % 4 AS goals,
 event_type || '/' || CAST(v % 7 AS VARCHAR) AS state, sum(v) OVER (PARTITION BY user_id) % 2 = 0 AS success,
 CASE WHEN v % 5 = 0 THEN 'INVALID' WHEN v % 11 = 0 THEN 'COMPLETE' ELSE 'VALID' END AS kind FROM (SELECT *, CAST(floor(abs(value)) AS BIGINT) AS v FROM events))"""
VALUES = "vals AS (SELECT state, count(*) AS attempts, avg(CAST(success AS INT)) AS value FROM (SELECT DISTINCT user_id, state, success FROM steps) GROUP BY state)"
W = "OVER (PARTITION BY user_id ORDER BY i)"
UP = "OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)"


def _with(sql: str, *more: str) -> str:
    return "WITH " + ", ".join([STEPS, *more]) + " " + sql


def _r(c, name):
    return F.round(c, 6).alias(name)


def _values(x):
    return tr.state_values(x, "user_id", "state", "success")


def win_prev_token(s, d):
    return steps(s, d).select("event_id", tr.previous("act", "user_id").alias("prev"))


def win_remaining(s, d):
    return steps(s, d).select("event_id", tr.remaining("user_id").alias("left"))


def agg_bigram(s, d):
    return tr.bigrams(steps(s, d), "act", "user_id", 2)


def map_nested_bigram(s, d):
    return tr.nested_map(tr.bigrams(steps(s, d), "act", "user_id")).select("prev", F.array_join(F.transform(F.map_entries("next"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias("next"))


def math_backoff_logprob(s, d):
    return tr.backoff_logprob(tr.bigrams(steps(s, d), "act", "user_id")).select("prev", "next", _r("logprob", "logprob"))


def agg_min_remaining(s, d):
    return steps(s, d).withColumn("left", tr.remaining("user_id")).groupBy("state").agg(F.min("left").alias("least"))


def agg_state_value(s, d):
    return _values(steps(s, d)).select("state", "attempts", _r("value", "value"))


def win_process_reward_next(s, d):
    x = steps(s, d)
    return tr.next_value_rewards(x, _values(x), "user_id", "state", "success").select("event_id", _r("reward", "reward"))


def win_potential_shaping(s, d):
    x = steps(s, d).withColumn("phi", F.col("v") / 100)
    return x.select("event_id", _r(tr.potential_shaping("phi", "user_id", 0.9, "kind"), "shaped"))


def join_potential(s, d):
    x = steps(s, d).withColumn("exact", F.concat("act", F.lit("/"), F.col("v").cast("string")))
    gold = x.where("success").select("exact").distinct().withColumn("phi", F.lit(1.0))
    y = x.join(gold, "exact", "left").withColumn("phi", F.coalesce("phi", F.lit(0.0)))
    return y.select("event_id", _r(tr.potential_shaping("phi", "user_id", 1.0), "shaped"))


def win_first_error_propagate(s, d):
    return steps(s, d).select("event_id", tr.sticky(F.col("kind") == "INVALID", "user_id").alias("bad"), _r(tr.checker_rewards(F.col("kind"), F.col("success")), "reward"))


def traj_alignment_flag(s, d):
    return steps(s, d).select("event_id", tr.aligned(F.col("kind") == "VALID", "user_id").alias("on_path"))


def win_carry_forward(s, d):
    return steps(s, d).select("event_id", tr.carried("goals", "user_id").cast("long").alias("goals"))


def win_subtree_span(s, d):
    return tr.subtree_spans(steps(s, d), "user_id", "goals")


def win_contiguous_segments(s, d):
    return tr.segments(steps(s, d), "user_id", "act").select("event_id", F.col("segment").cast("long").alias("segment"))


def win_group_zscore(s, d):
    return steps(s, d).select("event_id", _r(stats.zscore("v", "user_id"), "z"))


def win_group_zscore_floor(s, d):
    return steps(s, d).select("event_id", _r(stats.zscore_floor("v", "user_id"), "z"))


def win_process_norm(s, d):
    return steps(s, d).select("event_id", _r(stats.process_norm("v", "user_id"), "z"))


def win_nth_duplicate(s, d):
    w = Window.partitionBy("user_id", "state").orderBy("i")
    return steps(s, d).select("event_id", (F.row_number().over(w) - 1).cast("long").alias("nth"))


def cur_prefix_k(s, d):
    return tr.last_k(steps(s, d), "user_id", "act", 3)


def cur_all_prefixes(s, d):
    return tr.prefixes(steps(s, d), "user_id", 2, 4).select("event_id", "left")


def cur_decompose_starts(s, d):
    return tr.decompose_starts(steps(s, d), "user_id", "goals", 3)


def cur_stage_pick(s, d):
    x = tr.decompose_starts(steps(s, d), "user_id", "goals", 100)
    return x.groupBy("user_id").agg(F.min("i").alias("first"), F.max("i").alias("last"))


def cur_leaf_starts(s, d):
    return tr.leaf_starts(steps(s, d), "user_id", "goals", 4)


def cur_stage_buckets(s, d):
    x = tr.leaf_starts(steps(s, d), "user_id", "goals", 1000)
    return x.groupBy(F.when(F.col("size") <= 2, "1-2").when(F.col("size") <= 5, "3-5").otherwise("6+").alias("stage")).agg(F.count("*").alias("n"))


def cur_until_first(s, d):
    return tr.until_first(steps(s, d), "user_id", F.col("kind") == "COMPLETE").select("event_id")


def cur_opening_span(s, d):
    x = tr.opening_spans(steps(s, d), "user_id", "act", F.col("goals") == 3, F.col("act").isin("view", "click"))
    return x.select("user_id", "span")


def cur_first_n_split(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.when(F.rank().over(Window.partitionBy("event_type").orderBy("event_id")) <= 100, "first").otherwise("rest").alias("part"))


def join_dpo_pairs(s, d):
    return tr.dpo_pairs(steps(s, d).withColumn("a", F.col("v").cast("string")), "state", "a", F.col("success"))


def join_dpo_capped(s, d):
    return tr.dpo_pairs(steps(s, d), "state", "kind", F.col("kind") == "VALID", 2)


def build_sft(s, d):
    return steps(s, d).where("success").select("state", "act").distinct()


def join_divergence(s, d):
    x = steps(s, d).withColumn("exact", F.concat("act", F.lit("/"), F.col("v").cast("string")))
    return tr.divergence(x, x.where("success"), "user_id", "exact")


def traj_dedup_in_state(s, d):
    w = Window.partitionBy("user_id", "act", "goals").orderBy("i")
    return steps(s, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("event_id")


def traj_subgoal_reward(s, d):
    first = F.first("goals").over(tr.up_to("user_id"))
    return steps(s, d).select("event_id", (F.col("goals") < first).cast("int").alias("reward"))


def traj_shaped_reward(s, d):
    x = steps(s, d)
    last = x.where("kind = 'VALID'").groupBy("user_id").agg(F.max_by("state", "i").alias("state"))
    got = x.groupBy("user_id").agg(F.first("success").alias("success"))
    return got.join(last, "user_id", "left").join(_values(x).select("state", "value"), "state", "left").select(
        "user_id", _r(F.when(F.col("success"), 1.0).otherwise(0.5 * F.coalesce("value", F.lit(0.0))), "reward"))


def traj_mc_value(s, d):
    return steps(s, d).groupBy("state").agg(_r(F.avg((F.col("kind") != "INVALID").cast("int")), "value"))


def traj_mc_advantage(s, d):
    x = steps(s, d)
    return x.join(_values(x).select("state", "value"), "state").select("event_id", _r(tr.mc_advantages("value", "user_id", "kind"), "advantage")).where("advantage IS NOT NULL")


def agg_group_diag(s, d):
    x = steps(s, d).groupBy("act", "user_id").agg((F.max("success").cast("int")).cast("double").alias("reward"))
    return tr.group_diagnostics(x, "act").withColumn("mean_sd", F.round("mean_sd", 6))


def agg_moment_diag(s, d):
    x = steps(s, d).select(F.col("v").cast("double").alias("v"), F.col("goals").cast("double").alias("g"), (F.col("i") % 50).cast("double").alias("n"))
    m = stats.moments(x, "v", "g", "n")
    return m.select(*[_r(c, c) for c in m.columns])


def flt_failed_memo(s, d):
    x = steps(s, d)
    bad = x.where("kind = 'INVALID'").select("state", "goals").distinct()
    return x.join(bad, ["state", "goals"], "left_anti").select("event_id")


def flt_no_progress(s, d):
    was = F.lag("state").over(tr.order("user_id"))
    return steps(s, d).withColumn("was", was).where("i = 0 OR was <> state").select("event_id")


def part_stride(s, d):
    return steps(s, d).select("event_id", (F.col("i") % 3).alias("shard"))


def cov_reach(s, d):
    x = steps(s, d)
    target = x.where("i = 0").select("state").distinct()
    seen = x.where("NOT success").select("state").distinct().withColumn("hit", F.lit(1))
    return target.join(seen, "state", "left").agg(_r(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), "reach"))


def dedup_subproofs(s, d):
    return steps(s, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "act"))), lambda x: x["act"]), ",").alias("acts")).groupBy("acts").agg(F.min("user_id").alias("user_id"))


def dedup_prefer_positive(s, d):
    w = Window.partitionBy("state", "goals").orderBy(F.desc("success"), "event_id")
    return steps(s, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("event_id", "success")


def dedup_trace(s, d):
    w = Window.partitionBy("state", "goals").orderBy("event_id")
    return steps(s, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("event_id")


def math_kl_k3(s, d):
    return steps(s, d).select("event_id", _r(stats.kl_k3((F.col("v") % 50) - 25.0), "kl"))


def math_clip_surrogate(s, d):
    x = steps(s, d).withColumn("l", stats.clipped(F.col("v") / 50, F.col("goals") - 1.0))
    return x.groupBy("user_id").agg(F.avg("l").alias("l")).agg(_r(F.avg("l"), "objective"))


def math_overlong(s, d):
    return steps(s, d).select("event_id", _r(stats.overlong(F.lit(1.0), F.col("v"), 80.0, 40.0, 0.5), "reward"))


def math_pref_losses(s, d):
    return steps(s, d).select("event_id", _r(stats.dpo_loss(F.col("v") / 10, F.col("goals") * 1.0, F.lit(1.0), F.lit(2.0), 0.1), "loss"))


def math_len_norm(s, d):
    return steps(s, d).select("event_id", _r(stats.length_norm(-F.col("v") / 10, F.col("i") + 1, 0.5), "score"))


def math_ducb(s, d):
    return steps(s, d).select("event_id", _r(stats.ducb(F.col("goals") / 4, F.col("i") + 1, F.lit(1000)), "score"))


def math_blend_score(s, d):
    return steps(s, d).select("event_id", _r(stats.blend(F.col("goals") / 4, -F.col("v") / 10, F.col("i") + 1, 0.3), "score"))


def math_gamma_dist(s, d):
    return steps(s, d).select("event_id", _r(F.pow(F.lit(0.95), tr.remaining("user_id")), "target"))


def math_linear_score(s, d):
    return steps(s, d).select("event_id", _r(stats.linear_score([F.col("v"), F.col("goals")], [50.0, 1.5], [25.0, 1.1], [0.3, -0.2]), "score"))


def math_backup(s, d):
    arr = F.collect_list(F.col("goals") / 4 + 0.25)
    x = steps(s, d).groupBy("user_id").agg(arr.alias("g"))
    one = F.lit(1.0)
    return x.select("user_id", _r(F.aggregate("g", one, lambda a, v: a * v), "product"), _r(F.aggregate("g", F.lit(0.0), lambda a, v: a + v), "total"), _r(F.array_min("g"), "least"))


def agg_token_kl(s, d):
    x = steps(s, d).where("kind <> 'INVALID'").groupBy("user_id").agg(F.avg(F.col("v") - F.col("goals")).alias("m"))
    return x.agg(_r(F.avg("m"), "kl"))


_NTH = "SELECT event_id{more} FROM (SELECT *, row_number() OVER ({over}) AS n FROM steps) WHERE n = 1"
_DECOMP = "SELECT user_id, i, up + 1 AS n_sub FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY goals, i) AS nth FROM (SELECT *, lead(goals) " + W + " - goals AS up FROM steps) WHERE up > 0) WHERE nth <= {cap}"
_LEAF = "leaf AS (SELECT user_id, a.i AS start, coalesce((SELECT min(b.i) FROM steps b WHERE b.user_id = a.user_id AND b.i > a.i AND b.goals < a.goals), a.n) - a.i AS size FROM (SELECT *, lag(goals) " + W + " AS was, count(*) OVER (PARTITION BY user_id) AS n FROM steps) a WHERE was IS NOT NULL AND was <> goals)"

ORACLE_SQL = {
    "win_prev_token": _with(f"SELECT event_id, coalesce(lag(act) {W}, '<bos>') AS prev FROM steps"),
    "win_remaining": _with("SELECT event_id, count(*) OVER (PARTITION BY user_id) - i - 1 AS \"left\" FROM steps"),
    "agg_bigram": _with(f"SELECT prev, act AS next, count(*) AS n FROM (SELECT *, coalesce(lag(act) {W}, '<bos>') AS prev FROM steps) GROUP BY 1, 2 HAVING count(*) >= 2"),
    "map_nested_bigram": _with(f"SELECT prev, string_agg(next || ':' || n, ',' ORDER BY next) AS next FROM (SELECT prev, act AS next, count(*) AS n FROM (SELECT *, coalesce(lag(act) {W}, '<bos>') AS prev FROM steps) GROUP BY 1, 2) GROUP BY prev"),
    "math_backoff_logprob": _with("SELECT prev, next, round(ln(greatest(0.5 * (n + 1) / (sum(n) OVER (PARTITION BY prev) + (SELECT count(DISTINCT next) FROM p)) + 0.5 * sum(n) OVER (PARTITION BY next) / sum(n) OVER (), 1e-12)), 6) AS logprob FROM p", f"p AS (SELECT prev, act AS next, count(*) AS n FROM (SELECT *, coalesce(lag(act) {W}, '<bos>') AS prev FROM steps) GROUP BY 1, 2)"),
    "agg_min_remaining": _with("SELECT state, min(l) AS least FROM (SELECT state, count(*) OVER (PARTITION BY user_id) - i - 1 AS l FROM steps) GROUP BY state"),
    "agg_state_value": _with("SELECT state, attempts, round(value, 6) AS value FROM vals", VALUES),
    "win_process_reward_next": _with(f"SELECT event_id, round(coalesce(lead(value) {W}, CAST(success AS INT)), 6) AS reward FROM steps JOIN vals USING (state)", VALUES),
    "win_potential_shaping": _with(f"SELECT event_id, round(0.9 * CASE WHEN kind IN ('COMPLETE', 'INVALID') THEN 0 ELSE coalesce(lead(v / 100) {W}, 0) END - v / 100, 6) AS shaped FROM steps"),
    "join_potential": _with(f"SELECT event_id, round(coalesce(lead(phi) {W}, 0) - phi, 6) AS shaped FROM (SELECT *, CASE WHEN (act || '/' || v) IN (SELECT act || '/' || v FROM steps WHERE success) THEN 1.0 ELSE 0.0 END AS phi FROM steps)"),
    "win_first_error_propagate": _with(f"SELECT event_id, bool_or(kind = 'INVALID') {UP} AS bad, CAST(CASE WHEN kind = 'INVALID' THEN -0.1 WHEN success THEN 1.0 ELSE -0.05 END AS DOUBLE) AS reward FROM steps"),
    "traj_alignment_flag": _with(f"SELECT event_id, bool_and(kind = 'VALID') {UP} AS on_path FROM steps"),
    "win_carry_forward": _with(f"SELECT event_id, coalesce(last_value(nullif(goals, 0) IGNORE NULLS) {UP}, 1) AS goals FROM steps"),
    "win_subtree_span": _with("SELECT user_id, start, \"end\" FROM (SELECT a.user_id, a.i AS start, a.goals AS c, min(b.i) AS \"end\", arg_min(b.goals, b.i) AS ck FROM steps a JOIN steps b ON a.user_id = b.user_id AND b.i > a.i AND b.goals <= a.goals - 1 WHERE a.goals >= 2 GROUP BY 1, 2, 3) WHERE ck = c - 1"),
    "win_contiguous_segments": _with(f"SELECT event_id, CAST(sum(ch) {UP} AS BIGINT) AS segment FROM (SELECT *, CASE WHEN lag(act) {W} = act THEN 0 ELSE 1 END AS ch FROM steps)"),
    "win_group_zscore": _with("SELECT event_id, round(CASE WHEN stddev_pop(v) OVER w < 1e-4 THEN 0 ELSE (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-4) END, 6) AS z FROM steps WINDOW w AS (PARTITION BY user_id)"),
    "win_group_zscore_floor": _with("SELECT event_id, round((v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 0.1), 6) AS z FROM steps WINDOW w AS (PARTITION BY user_id)"),
    "win_process_norm": _with("SELECT event_id, round(CASE WHEN stddev_pop(v) OVER w < 1e-8 THEN 0 ELSE (v - avg(v) OVER w) / stddev_pop(v) OVER w END, 6) AS z FROM steps WINDOW w AS (PARTITION BY user_id)"),
    "win_nth_duplicate": _with("SELECT event_id, row_number() OVER (PARTITION BY user_id, state ORDER BY i) - 1 AS nth FROM steps"),
    "cur_prefix_k": _with("SELECT user_id, coalesce(string_agg(act, '' ORDER BY i) FILTER (WHERE i < n - least(3, n - 1)), '') AS prefix, string_agg(act, '' ORDER BY i) FILTER (WHERE i >= n - least(3, n - 1)) AS target FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM steps) WHERE n >= 2 GROUP BY user_id"),
    "cur_all_prefixes": _with("SELECT event_id, n - i AS \"left\" FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM steps) WHERE i >= 1 AND n - i BETWEEN 2 AND 4"),
    "cur_decompose_starts": _with(_DECOMP.format(cap=3)),
    "cur_stage_pick": _with("SELECT user_id, min(i) AS first, max(i) AS last FROM (" + _DECOMP.format(cap=100) + ") GROUP BY user_id"),
    "cur_leaf_starts": _with("SELECT user_id, start, size FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY size, start) AS nth FROM leaf) WHERE nth <= 4", _LEAF),
    "cur_stage_buckets": _with("SELECT CASE WHEN size <= 2 THEN '1-2' WHEN size <= 5 THEN '3-5' ELSE '6+' END AS stage, count(*) AS n FROM leaf GROUP BY 1", _LEAF),
    "cur_until_first": _with("SELECT event_id FROM (SELECT *, min(CASE WHEN kind = 'COMPLETE' THEN i END) OVER (PARTITION BY user_id) AS f FROM steps) WHERE f IS NULL OR i <= f"),
    "cur_opening_span": _with("SELECT DISTINCT user_id, (SELECT string_agg(b.act, ' ' ORDER BY b.i) FROM steps b WHERE b.user_id = a.user_id AND b.i BETWEEN a.low AND a.i) AS span FROM (SELECT *, coalesce(max(CASE WHEN act NOT IN ('view', 'click') THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS low FROM steps) a WHERE goals = 3"),
    "cur_first_n_split": "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 100 THEN 'first' ELSE 'rest' END AS part FROM events",
    "join_dpo_pairs": _with("SELECT a.state, a.a AS chosen, b.a AS rejected FROM (SELECT DISTINCT state, a FROM x WHERE success) a JOIN (SELECT state, a FROM x WHERE NOT success EXCEPT SELECT state, a FROM x WHERE success) b ON a.state = b.state", "x AS (SELECT *, CAST(v AS VARCHAR) AS a FROM steps)"),
    "join_dpo_capped": _with("SELECT state, chosen, rejected FROM (SELECT a.state, a.kind AS chosen, b.kind AS rejected, row_number() OVER (PARTITION BY a.state ORDER BY a.kind, b.kind) AS nth FROM (SELECT DISTINCT state, kind FROM steps WHERE kind = 'VALID') a JOIN (SELECT DISTINCT state, kind FROM steps WHERE kind <> 'VALID') b ON a.state = b.state) WHERE nth <= 2"),
    "build_sft": _with("SELECT DISTINCT state, act FROM steps WHERE success"),
    "join_divergence": _with("SELECT user_id, max(i) AS last, min(off) AS off FROM (SELECT *, min(CASE WHEN NOT ok THEN i END) OVER (PARTITION BY user_id) AS off FROM (SELECT *, (act || '/' || v) IN (SELECT act || '/' || v FROM steps WHERE success) AS ok FROM steps)) WHERE ok AND i < off GROUP BY user_id"),
    "traj_dedup_in_state": _with(_NTH.format(more="", over="PARTITION BY user_id, act, goals ORDER BY i")),
    "traj_subgoal_reward": _with(f"SELECT event_id, CAST(goals < first_value(goals) {UP} AS INT) AS reward FROM steps"),
    "traj_shaped_reward": _with("SELECT user_id, round(CASE WHEN s THEN 1.0 ELSE 0.5 * coalesce(value, 0) END, 6) AS reward FROM (SELECT user_id, bool_and(success) AS s, arg_max(state, i) FILTER (WHERE kind = 'VALID') AS state FROM steps GROUP BY user_id) LEFT JOIN vals USING (state)", VALUES),
    "traj_mc_value": _with("SELECT state, round(avg(CAST(kind <> 'INVALID' AS INT)), 6) AS value FROM steps GROUP BY state"),
    "traj_mc_advantage": _with(f"SELECT * FROM (SELECT event_id, round(CASE kind WHEN 'COMPLETE' THEN 1.0 WHEN 'INVALID' THEN 0.0 ELSE lead(value) {W} END - value, 6) AS advantage FROM steps JOIN vals USING (state)) WHERE advantage IS NOT NULL", VALUES),
    "agg_group_diag": _with("SELECT count(*) AS \"groups\", count(*) FILTER (WHERE hi < 1) AS dead, count(*) FILTER (WHERE hi >= 1 AND lo < 1) AS mixed, round(avg(sd), 6) AS mean_sd FROM (SELECT act, max(r) AS hi, min(r) AS lo, stddev_pop(r) AS sd FROM (SELECT act, user_id, max(CAST(success AS INT)) AS r FROM steps GROUP BY 1, 2) GROUP BY act)"),
    "agg_moment_diag": _with("SELECT round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(1 - var_pop(goals - v) / var_pop(goals), 6) AS explained, round(corr(i % 50, v), 6) AS corr FROM steps"),
    "flt_failed_memo": _with("SELECT event_id FROM steps a WHERE NOT EXISTS (SELECT 1 FROM steps b WHERE b.kind = 'INVALID' AND b.state = a.state AND b.goals = a.goals)"),
    "flt_no_progress": _with(f"SELECT event_id FROM (SELECT *, lag(state) {W} AS was FROM steps) WHERE i = 0 OR was <> state"),
    "part_stride": _with("SELECT event_id, i % 3 AS shard FROM steps"),
    "cov_reach": _with("SELECT round(avg(CAST(state IN (SELECT state FROM steps WHERE NOT success) AS INT)), 6) AS reach FROM (SELECT DISTINCT state FROM steps WHERE i = 0)"),
    "dedup_subproofs": _with("SELECT acts, min(user_id) AS user_id FROM (SELECT user_id, string_agg(act, ',' ORDER BY i) AS acts FROM steps GROUP BY user_id) GROUP BY acts"),
    "dedup_prefer_positive": _with(_NTH.format(more=", success", over="PARTITION BY state, goals ORDER BY success DESC, event_id")),
    "dedup_trace": _with(_NTH.format(more="", over="PARTITION BY state, goals ORDER BY event_id")),
    "math_kl_k3": _with("SELECT event_id, round(exp(d) - d - 1, 6) AS kl FROM (SELECT event_id, greatest(-20.0, least(20.0, v % 50 - 25.0)) AS d FROM steps)").replace("greatest(-20.0, least(20.0, v % 50 - 25.0))", "CAST(greatest(-20.0, least(20.0, v % 50 - 25.0)) AS DOUBLE)"),
    "math_clip_surrogate": _with("SELECT round(avg(l), 6) AS objective FROM (SELECT user_id, avg(least(v / 50 * (goals - 1), greatest(0.8, least(1.2, v / 50)) * (goals - 1))) AS l FROM steps GROUP BY user_id)"),
    "math_overlong": _with("SELECT event_id, round(1.0 - greatest(0.0, least(1.0, (v - 40.0) / 40.0)) * 0.5, 6) AS reward FROM steps"),
    "math_pref_losses": _with("SELECT event_id, round(ln(1 + exp(-0.1 * ((v / 10 - 1) - (goals - 2)))), 6) AS loss FROM steps"),
    "math_len_norm": _with("SELECT event_id, round(-v / 10 / sqrt(i + 1), 6) AS score FROM steps"),
    "math_ducb": _with("SELECT event_id, round(goals / 4 + sqrt(2 * ln(1000) / (i + 1)), 6) AS score FROM steps"),
    "math_blend_score": _with("SELECT event_id, round(0.3 * goals / 4 + 0.7 * exp(-v / 10 / (i + 1)), 6) AS score FROM steps"),
    "math_gamma_dist": _with("SELECT event_id, round(pow(0.95, count(*) OVER (PARTITION BY user_id) - i - 1), 6) AS target FROM steps"),
    "math_linear_score": _with("SELECT event_id, round((v - 50) / 25 * 0.3 - (goals - 1.5) / 1.1 * 0.2, 6) AS score FROM steps"),
    "math_backup": _with("SELECT user_id, round(product(goals / 4 + 0.25), 6) AS product, round(sum(goals / 4 + 0.25), 6) AS total, round(min(goals / 4 + 0.25), 6) AS least FROM steps GROUP BY user_id"),
    "agg_token_kl": _with("SELECT round(avg(m), 6) AS kl FROM (SELECT user_id, avg(v - goals) AS m FROM steps WHERE kind <> 'INVALID' GROUP BY user_id)"),
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
