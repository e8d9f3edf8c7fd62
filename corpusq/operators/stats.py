"""Intervals, tests and group statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(x: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's score interval of a share, in percent; null for no trials."""
    n = F.nullif(n, F.lit(0)).cast("double")
    p = x / n
    centre, scale = (p + z * z / (2 * n)), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return 100 * (centre - half) / scale, 100 * (centre + half) / scale


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided sign test of discordant counts: twice the smaller binomial tail, at most 1."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = F.when(i == 0, -n * F.log(F.lit(2.0))).otherwise(s["term"] + F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double")))
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), k), start, add, lambda s: s["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired_2x2(a: Column, b: Column) -> list[Column]:
    """Counts of both, only a, only b and neither."""
    cells = {"both": a & b, "only_a": a & ~b, "only_b": ~a & b, "neither": ~a & ~b}
    return [F.sum(cell.cast("long")).alias(name) for name, cell in cells.items()]


def zscore(x: str, *by: str, epsilon: float = 1e-4) -> Column:
    """(x - mean) / (population deviation + epsilon) within a group; 0 where the deviation is below epsilon."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd < epsilon, F.lit(0.0)).otherwise((F.col(x) - F.avg(x).over(w)) / (sd + epsilon))


def zscore_floor(x: str, *by: str, floor: float = 0.1) -> Column:
    w = Window.partitionBy(*by)
    return (F.col(x) - F.avg(x).over(w)) / F.greatest(F.stddev_pop(x).over(w), F.lit(floor))


def process_norm(x: str, *by: str) -> Column:
    """As zscore without epsilon in the divisor; 0 where the deviation is below 1e-8."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd < 1e-8, F.lit(0.0)).otherwise((F.col(x) - F.avg(x).over(w)) / sd)


def softmax(x: Column, beta: float, *by: str) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp((x - F.max(x).over(w)) / beta)
    return e / F.sum(e).over(w)


def kl(rows: DataFrame, p: str, q: str, *by: str) -> DataFrame:
    """Sum of p * (log p - log max(q, 1e-9)) over a group; terms with p = 0 are 0."""
    term = F.when(F.col(p) > 0, F.col(p) * (F.log(p) - F.log(F.greatest(F.col(q), F.lit(1e-9))))).otherwise(0.0)
    return rows.groupBy(*by).agg(F.sum(term).alias("kl"))


def kl_k3(d: Column) -> Column:
    d = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), d))
    return F.exp(d) - d - 1


def clipped(ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """The smaller of ratio * advantage and the clipped ratio * advantage."""
    return F.least(ratio * advantage, F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio)) * advantage)


def overlong(reward: Column, length: Column, cap: float, buffer: float, penalty: float) -> Column:
    return reward - F.greatest(F.lit(0.0), F.least(F.lit(1.0), (length - (cap - buffer)) / buffer)) * penalty


def dpo_loss(chosen: Column, rejected: Column, chosen_ref: Column, rejected_ref: Column, beta: float) -> Column:
    """-log sigmoid of beta times the difference of log ratios."""
    return F.log1p(F.exp(-beta * ((chosen - chosen_ref) - (rejected - rejected_ref))))


def length_norm(logp: Column, length: Column, alpha: float) -> Column:
    return logp / F.pow(F.greatest(length, F.lit(1)).cast("double"), F.lit(alpha))


def ducb(q: Column, n: Column, total: Column) -> Column:
    return q + F.sqrt(2 * F.log(total.cast("double")) / n)


def blend(critic: Column, logp: Column, depth: Column, alpha: float) -> Column:
    return alpha * critic + (1 - alpha) * F.exp(logp / F.greatest(depth, F.lit(1)))


def linear_score(features: list[Column], mean: list[float], sd: list[float], theta: list[float]) -> Column:
    """Sum of z-scored features times their weights."""
    out = F.lit(0.0)
    for f, m, s, t in zip(features, mean, sd, theta, strict=True):
        out = out + (f - m) / s * t
    return out


def moments(rows: DataFrame, value: str, target: str, length: str) -> DataFrame:
    """Mean and population variance of a value, explained variance of a target, and correlation with length."""
    rest = F.var_pop(F.col(target) - F.col(value))
    return rows.agg(
        F.avg(value).alias("mean"), F.var_pop(value).alias("variance"),
        (1 - rest / F.nullif(F.var_pop(target), F.lit(0.0))).alias("explained"), F.corr(length, value).alias("corr"))
