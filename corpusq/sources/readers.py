"""Readers of nested data points, line-delimited JSON, result folders and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("module", T.ArrayType(T.StringType())),
    T.StructField("type", T.StringType()), T.StructField("line", T.IntegerType()),
])
GOAL = T.StringType()
STEP = T.StructType([
    T.StructField("n_step", T.IntegerType()), T.StructField("step", T.StructType([T.StructField("text", T.StringType()), T.StructField("context", T.ArrayType(SENTENCE))])),
    T.StructField("goals", T.ArrayType(GOAL)),
])
PROOF = T.StructType([T.StructField("proof_idx", T.IntegerType()), T.StructField("theorem", T.StructType([T.StructField("term", SENTENCE)])), T.StructField("steps", T.ArrayType(STEP))])
#: A data point: the context is a list of JSON strings, the first of metadata, the others of sentences.
DATAPOINT = T.StructType([T.StructField("file_context", T.ArrayType(T.StringType())), T.StructField("proofs", T.ArrayType(PROOF))])
METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("file", "workspace", "repository")])


def data_points(spark: SparkSession, path: str, metadata_only: bool = False) -> DataFrame:
    """One row for each nested file; without premises, Catalyst prunes their parsing."""
    rows = spark.read.schema(DATAPOINT).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))
    out = rows.select("path", F.from_json(F.col("file_context")[0], METADATA).alias("meta"), "file_context", "proofs").select("path", "meta.*", "file_context", "proofs")
    if metadata_only:
        return out.drop("file_context")
    sentences = F.transform(F.slice(F.col("file_context"), F.lit(2), F.size("file_context")), lambda s: F.from_json(s, SENTENCE))
    return out.withColumn("premises", sentences).drop("file_context")


def steps(points: DataFrame) -> DataFrame:
    """File, proof and step numbers with the step."""
    proofs = points.select("file", F.explode("proofs").alias("p"))
    return proofs.select("file", F.col("p.proof_idx").alias("proof_idx"), F.posexplode("p.steps").alias("step_idx", "s")).select(
        "file", "proof_idx", "step_idx", F.col("s.step.text").alias("text"), F.col("s.goals").alias("goals"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, skip_bad: bool = False) -> DataFrame:
    """Line-delimited JSON, also gzipped; bad lines fail or are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST").json(path)


def json_lines_by_file(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Line-delimited JSON with the file of each line; bad lines are skipped."""
    return json_lines(spark, path, schema, True).withColumn("source_file", F.col("_metadata.file_path"))


def result_folder(spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str]) -> DataFrame:
    """All JSON files below a folder; of one key, the file that was written last."""
    rows = (
        spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
        .withColumn("_t", F.col("_metadata.file_modification_time")).withColumn("_p", F.col("_metadata.file_path")))
    w = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_p"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_t", "_p")


def foreign_results(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Another tool's results in the common schema: project, path, line, success, time."""
    kinds = {"project": "string", "path": "string", "line": "int", "success": "boolean", "time": "double"}
    return rows.select(*[columns.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def log_blocks(spark: SparkSession, path: str, block: str, fields: dict[str, str]) -> DataFrame:
    """Rows from logs: each match of a block pattern, and a field pattern's first group within it."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    found = text.select("path", F.posexplode(F.regexp_extract_all("value", F.lit(block), F.lit(0))).alias("pos", "block"))
    return found.select("path", "pos", *[F.nullif(F.regexp_extract("block", p, 1), F.lit("")).alias(n) for n, p in fields.items()])


def split_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON split with train_files, val_files and test_files as one table."""
    info = "array<struct<dp_name: string, file: string, workspace: string, repository: string>>"
    raw = spark.read.schema(f"train_files {info}, val_files {info}, test_files {info}").option("multiLine", True).json(path)
    parts = [raw.select(F.lit(n).alias("split"), F.explode(f"{n}_files").alias("f")).select("split", "f.*") for n in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
