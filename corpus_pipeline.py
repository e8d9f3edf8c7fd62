"""A corpus pipeline of five operators; each stage is written and read again.

Toxic documents go, one document of each group of near-duplicates stays, personal
data gets pseudonyms, sources are mixed to their target weights, and the texts are
encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm import bpe, minhash, mixing, pii, toxicity
from corpusq.llm.tables import read_table, written

ORACLE_SQL = None


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    labels = read_table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.marked(docs, machine).where("_predicted = 0").drop("_predicted")


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group, that of the smallest doc_id; of rows equal in doc_id and text, one."""
    found = minhash.near_duplicates(docs, k=5, percent=80).where("kept AND doc_id IS NOT NULL")
    alone = F.when(F.col("component").isNull(), F.col("text_hash"))
    kept = found.groupBy("doc_id", "component", alone.alias("alone")).agg(F.min("text_hash").alias("_text")).select("doc_id", "_text").distinct()
    known = docs.withColumn("_text", F.xxhash64(F.col("text").cast("string"))).join(kept, ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"])
    return docs.where("doc_id IS NULL").unionByName(known.drop("_text")).select(*docs.columns)


def pseudonymise(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced under the session's key; n_chars follows."""
    out = pii.pseudonymised(docs, pii.session_key(spark)).drop("pii")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode_decode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens and digests of every text."""
    return bpe.digests(docs, bpe.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("bpe", encode_decode),
]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
