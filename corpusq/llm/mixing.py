"""Mixing sources to target weights, in DataFrame operations only.

Documents are ordered by a hash-random key within their source.  Word counts are
summed per key interval, then over the intervals of a source, then within one
interval, which gives every document its place in its source without a task that
holds a whole source.  A source is taken in whole epochs and then up to the exact
word at which its target is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.tables import read_table, text_or_empty, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 11
#: Rows of one key interval of a source; more where a source has over CELL_ROWS * 2**17 rows.
CELL_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words_in(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def random_key() -> Column:
    """63 random bits of a document, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.xxhash64(text_or_empty())), 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Each source's number, size, rows, target, epochs and rest, from (source, size) rows.

    Sources in code point order, null last, take the weights in turn.  Targets
    share all words by weight; one that would exceed `most` times its source
    stops there and the others share the excess by weight.  With the sources in
    order of size over weight, the stopped ones are a prefix: the level of the
    others is what is left over their weights, for the first source that isn't
    above its own limit.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*[F.lit(w) for w in weights])
    ordered = by_source.withColumn("sid", number).withColumn("weight", F.element_at(turn, (F.col("sid") - 1) % len(weights) + 1))
    whole = Window.partitionBy()
    rising = Window.orderBy("limit", "sid")
    levels = (
        ordered.withColumn("limit", most * F.col("source_size") / F.col("weight"))
        .withColumn("stopped", F.coalesce(F.sum(most * F.col("source_size")).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("stopped")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "sid", "level"))).over(whole)["level"])
    )
    target = F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        levels.withColumn("target", target).withColumn("epochs", epochs)
        .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .select("source", "sid", "source_size", "source_rows", "target", "epochs", "rest")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """How many words the mix takes of each document.

    Returns doc_id, source, size, source_size, target, taken, key, epochs and
    extra (the words beyond whole epochs; taken = epochs * size + extra), one row
    for each row of docs.  A source's taken words are its target, rounded.

    Nulls and edge cases: a null text has no words; a null source is a source of
    its own, the last; a source without words has target 0; repeated rows are
    placed one after the other; an empty table gives an empty result; columns
    other than doc_id, text and source are ignored.
    """
    sizes = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        words_in(text_or_empty()).alias("size"), random_key().alias("key")), "sizes")
    sources = written(source_targets(sizes, weights, most), "sources")
    bits = F.greatest(F.lit(0), F.least(F.lit(17), F.ceil(F.log2(F.col("source_rows") / CELL_ROWS)))).cast("int")
    rows = sizes.join(
        sources.select(F.col("source").alias("of"), "sid", bits.alias("bits")), F.col("source").eqNullSafe(F.col("of"))
    ).withColumn("cell", F.call_function("shiftright", F.col("key"), F.lit(63) - F.col("bits"))).drop("of", "bits")
    ahead = Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("sid", "cell").agg(F.sum("size").alias("s")).select(
        F.col("sid").alias("i"), F.col("cell").alias("c"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("sid", "cell").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("upto", F.sum("size").over(within))
        .join(starts, (F.col("sid") == F.col("i")) & (F.col("cell") == F.col("c")))
        .withColumn("begin", F.col("ahead") + F.col("upto") - F.col("size"))
    )
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("begin")))
    return placed.join(sources.select("sid", "source_size", "target", "epochs", "rest"), "sid").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).alias("taken"),
        "key", "epochs", extra.alias("extra"), (F.col("begin") < F.col("rest")).alias("started"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed documents themselves: rows of docs, each as often as the mix takes it.

    The document at a source's cut is taken whole if at least half of it lies
    before the cut.  As documents are in key order, a source's epochs and its
    last key decide for each row, so texts are not exchanged.
    """
    took = mixed(docs, weights, most)
    last = F.max(F.when(F.when(F.col("size") > 0, 2 * F.col("extra") >= F.col("size")).otherwise(F.col("started")), F.col("key")))
    rule = written(took.groupBy("source").agg(F.max("epochs").alias("_epochs"), last.alias("_last")).withColumnRenamed("source", "_source"), "rule")
    times = (F.col("_epochs") + F.coalesce((random_key() <= F.col("_last")).cast("int"), F.lit(0))).cast("int")
    return (
        docs.join(rule, F.col("source").cast("string").eqNullSafe(F.col("_source")))
        .withColumn("_times", times).where("_times > 0")
        .withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 of their sources."""
    return mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
