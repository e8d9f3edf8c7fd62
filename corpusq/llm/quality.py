"""Quality by importance resampling.

Two generative models over hashed words and word pairs, one of good texts and one
of all texts, give each document the logarithm of its importance weight: the sum
of log ratios of its n-grams.  Gumbel noise from the document's id and text turns
weights into keys, and the documents with the largest keys are a sample without
replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.shingles import U, mix, shingle_runs
from corpusq.llm.tables import read_table, text_or_empty, written

BUCKETS = 1 << 15
SMOOTHING = 1.0
#: Labelled good rows that the target model uses at most, the smallest by hash of doc_id.
TARGET_ROWS = 20_000
SHARE = 0.8
SEED = 23
_FINE = 1 << 20


def _grams(column) -> Iterator[tuple[int, np.ndarray]]:
    """Row and buckets of its words and pairs."""
    for row, one in shingle_runs(column, 1):
        two = mix(one[:-1] * U(0x9DDFEA08EB382D69) + one[1:]) if len(one) > 1 else one[:0]
        yield row, (np.concatenate([one, two]) & U(BUCKETS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        target = batch.column("target").to_pylist()
        for row, grams in _grams(batch.column("text")):
            n = np.bincount(grams, minlength=BUCKETS) if len(grams) > 2000 else None
            for counts in (raw, good) if target[row] else (raw,):
                if n is None:
                    np.add.at(counts, grams, 1)
                else:
                    counts += n
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])


def models(docs: DataFrame, labels: DataFrame, most: int = TARGET_ROWS) -> np.ndarray:
    """Logarithm of target over raw probability for each bucket.

    Counts come from all documents, added up per partition and then per bucket;
    the driver holds BUCKETS rows.
    """
    target = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality = 1 AND doc_id IS NOT NULL")
        .select("doc_id").distinct().orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most).withColumn("target", F.lit(True)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = (
        texts.join(F.broadcast(target), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
        .mapInArrow(_counted, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect())
    raw, good = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def _weighed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    ratio = shared.value
    for batch in batches:
        n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for row, grams in _grams(batch.column("text")):
            n[row] = len(grams)
            weight[row] = ratio[grams].sum()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("print"), pa.array(n), pa.array(weight)], names=["doc_id", "print", "n_grams", "log_weight"])


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th largest value of a column of longs, and how many rows have larger ones.

    Histograms of 4096 steps close in on it, so no task and no driver holds the rows.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        step = max(1, -(-(high - low + 1) // 4096))
        inside = rows.where(F.col(column).between(low, high))
        counts = dict(inside.groupBy(F.expr(f"(`{column}` - {low}L) div {step}L").cast("long").alias("s")).count().collect())
        for s in sorted(counts, reverse=True):
            if above + counts[s] >= k:
                low, high = low + s * step, min(high, low + (s + 1) * step - 1)
                break
            above += counts[s]
    return low, above


def resampled(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """Importance weight of every document and whether the sample of share * rows keeps it.

    Returns doc_id, n_grams, log_weight, gumbel_key and kept.

    Nulls and edge cases: null, empty and blank texts have no n-grams and weight
    0; rows of a null doc_id have noise by their texts; rows with equal keys enter
    by doc_id, null first, then by text hash; repeated rows have equal keys and
    are each a row of the sample's size; very long texts are hashed in pieces;
    without good labels both models are smoothed alike; an empty table gives an
    empty result; columns other than doc_id and text are ignored.
    """
    ratio = models(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("print")).mapInArrow(
        lambda b: _weighed(b, shared), "doc_id long, print long, n_grams long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "print"), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    rows = written(keyed.withColumn("fine", F.floor(F.col("gumbel_key") * _FINE).cast("long")), "weighed")
    total = rows.count()
    k = int(total * share)
    out = ["doc_id", "n_grams", "log_weight", "gumbel_key"]
    if not k:
        return rows.select(*out, F.lit(False).alias("kept"))
    cut, above = kth_largest(rows, "fine", k)
    # rows at the cut: equal ones are counted first, and the window orders what is left, a step of 2**-20 of the keys
    tied = rows.where(F.col("fine") == cut).groupBy(*out, "print").agg(F.count("*").alias("copies"))
    order = Window.orderBy(F.desc("gumbel_key"), "doc_id", "print").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("ahead", F.coalesce(F.sum("copies").over(order), F.lit(0))).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    clear = rows.where(F.col("fine") != cut).select(*out, (F.col("fine") > cut).alias("kept"))
    return clear.unionByName(tied.select(*out, (F.col("ahead") + F.col("nth") <= k - above).alias("kept")))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Importance resampling of all documents towards those labelled good."""
    return resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
