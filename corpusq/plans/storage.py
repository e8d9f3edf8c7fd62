"""Queries of scans, sinks, queues and named filters: what is written is read back and must equal its source."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusq.operators import corpus as cp
from corpusq.operators import evaluation as ev
from corpusq.operators import retrieval as rt
from corpusq.plans.corpus import _nodes
from corpusq.sources import readers, writers
from corpusq.sources.scratch import scratch
from corpusq.sources.tables import table

# Kinds of statements in natural order; the first row of kinds has a proof.
STATEMENTS = ["THEOREM", "LEMMA", "FACT", "REMARK", "COROLLARY", "PROPOSITION", "PROPERTY"]
OTHERS = ["DEFINITION", "NOTATION", "INDUCTIVE", "COINDUCTIVE", "RECORD", "CLASS", "INSTANCE", "FIXPOINT", "COFIXPOINT", "SCHEME", "VARIANT",
          "OBLIGATION", "TACTIC", "RELATION", "SETOID", "FUNCTION", "DERIVE", "OTHER"]
#: Kinds dropped inside and outside the standard library, by name of the filter.
KNOWN = {"all": ([], []), "proj": (STATEMENTS + OTHERS, []), "thm": (OTHERS, OTHERS), "proj-thm": (STATEMENTS + OTHERS, OTHERS)}
TURN = "conv_id long, turn long, role string, text string"


def _turns(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("text"))


def sink_jsonl(s, d):
    path = scratch(s, "jsonl")
    writers.json_lines(_turns(s, d), path, "role")
    return s.read.schema(TURN).json(path).select("conv_id", "turn", "role", "text")


def scan_jsonl(s, d):
    path = scratch(s, "jsonl")
    writers.json_lines(_turns(s, d), path)
    return readers.json_lines(s, path, TURN)


def scan_gz_jsonl(s, d):
    path = scratch(s, "gz")
    good = _turns(s, d).select(F.to_json(F.struct("conv_id", "turn")).alias("value"))
    good.union(s.range(3).select(F.lit("{broken").alias("value"))).write.option("compression", "gzip").text(path)
    return readers.json_lines(s, path, "conv_id long, turn long", True)


def scan_tree_by_file(s, d):
    path = scratch(s, "files")
    writers.json_lines(_turns(s, d), path, "role")
    x = readers.json_lines_by_file(s, path, "conv_id long, turn long")
    return x.groupBy(F.regexp_extract("source_file", "role=([a-z]+)", 1).alias("role")).agg(F.count("*").alias("n"))


def scan_eval_dir(s, d):
    path = scratch(s, "results")
    table(s, d, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").alias("k")).write.partitionBy("k").json(f"{path}/a")
    return readers.result_folder(s, path, "n_nationkey int, n_name string", ["n_nationkey"]).select("n_nationkey", "n_name")


def scan_log_blocks(s, d):
    path = scratch(s, "log")
    lines = table(s, d, "nation").select(F.concat(F.lit("run "), F.col("n_nationkey").cast("string"), F.lit("\nname="), "n_name").alias("value"))
    lines.coalesce(1).write.text(path)
    x = readers.log_blocks(s, path, r"run \d+\nname=[^\n]+", {"id": r"run (\d+)", "name": r"name=(.+)"})
    return x.select(F.col("id").cast("int").alias("id"), "name")


def scan_datapoint(s, d):
    path = scratch(s, "points")
    meta = F.to_json(F.struct(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file"), F.lit("w").alias("workspace"), F.lit("r").alias("repository")))
    step = F.struct(F.col("turn").cast("int").alias("n_step"), F.struct("text", F.array().cast("array<string>").alias("context")).alias("step"), F.array("role").alias("goals"))
    x = _turns(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps")).select(
        F.array(meta).alias("file_context"), F.array(F.struct(F.lit(0).alias("proof_idx"), "steps")).alias("proofs"))
    x.write.json(path)
    points = s.read.schema(readers.DATAPOINT).json(path).select(F.from_json(F.col("file_context")[0], readers.METADATA).alias("meta"), "proofs").select("meta.*", "proofs")
    return readers.steps(points).select("file", F.col("step_idx").cast("long").alias("step_idx"), "text", F.col("goals")[0].alias("role"))


def sink_example_db(s, d):
    path = scratch(s, "examples")
    writers.examples(_turns(s, d).withColumn("id", F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn")).cast("long")), path)
    return s.read.parquet(path).select("id", "role", "conv_id", "turn")


def sink_csv(s, d):
    path = scratch(s, "csv")
    writers.csv(table(s, d, "supplier").select("s_suppkey", "s_name"), path, "s_name")
    return s.read.option("header", True).schema("s_suppkey long, s_name string").csv(path)


def vec_page_write(s, d):
    path = scratch(s, "pages")
    writers.vector_pages(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), path, 64)
    return s.read.parquet(path).groupBy(F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def cache_page_read_through(s, d):
    path = scratch(s, "cache")
    for _ in range(2):
        out = writers.read_through(s, path, lambda: table(s, d, "nation").select("n_nationkey", "n_name"))
    return out


def flt_known_confs(s, d):
    kinds = F.array(*[F.lit(k) for k in STATEMENTS + OTHERS])
    rows = table(s, d, "part").select(
        F.element_at(kinds, (F.col("p_partkey") % 25 + 1).cast("int")).alias("kind"), F.when(F.col("p_size") > 25, "/x/lib/coq/theories/a.v").otherwise("/y/b.v").alias("path"))
    out = None
    for name, (inside, outside) in KNOWN.items():
        part = cp.type_filter(rows, "kind", "path", [], inside, outside, "lib/coq/theories").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def flt_pairs(s, d):
    keys = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = table(s, d, "lineitem").join(keys, "l_orderkey", "left_semi")
    return cp.first_per(kept, ["l_orderkey"], "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber")


def flt_range_dep(s, d):
    deps = table(s, d, "lineitem").groupBy("l_orderkey").agg((F.countDistinct("l_suppkey") - 1).alias("deps"))
    return deps.withColumn("range", ev.bucket(F.col("deps"), [(1, 2), (3, None)])).where("range IS NOT NULL").select("l_orderkey", "range")


def hash_fingerprint(s, d):
    one = F.md5(F.concat_ws("|", "p_partkey", "p_name"))
    return table(s, d, "part").groupBy("p_brand").agg(F.md5(F.array_join(F.array_sort(F.collect_list(one)), ",")).alias("print"))


def sq_file_queue(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 10).alias("queue"), "ts", "event_id", "event_type")
    x = cp.fifo(e, "queue", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "click")
    return x.select("event_id", F.col("item.event_id").alias("item"))


def sort_frontier(s, d):
    open_nodes = _nodes(s, d).where("NOT solved").select((F.col("id") % 5).alias("query"), (-F.col("depth")).cast("double").alias("score"), F.col("id").alias("ordinal"))
    return rt.top_k(open_nodes, 10).select("query", "ordinal", "rank")


def vec_lstsq(s, d):
    e = table(s, d, "embeddings").select(F.slice("embedding", 1, 2).cast("array<double>").alias("x"))
    y = e.withColumn("y", F.array(2 * F.col("x")[0] + 3 * F.col("x")[1], F.col("x")[0] - F.col("x")[1]))
    m = rt.least_squares(y, "x", "y", 2, 2)
    return s.createDataFrame([(i, j, round(float(m[i][j]), 4) + 0.0) for i in range(2) for j in range(2)], "i long, j long, v double")


_SAME = "SELECT conv_id, turn, role, md5(text) AS text FROM conversations"
_N = len(STATEMENTS)
ORACLE_SQL = {
    "sink_jsonl": _SAME,
    "scan_jsonl": _SAME,
    "scan_gz_jsonl": "SELECT conv_id, turn FROM conversations",
    "scan_tree_by_file": "SELECT role, count(*) AS n FROM conversations GROUP BY role",
    "scan_eval_dir": "SELECT n_nationkey, n_name FROM nation",
    "scan_log_blocks": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "scan_datapoint": "SELECT 'f' || conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_idx, md5(text) AS text, role FROM conversations",
    "sink_example_db": "SELECT row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS id, role, conv_id, turn FROM conversations",
    "sink_csv": "SELECT s_suppkey, s_name FROM supplier",
    "vec_page_write": "SELECT vec_id // 64 AS page, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY 1",
    "cache_page_read_through": "SELECT n_nationkey, n_name FROM nation",
    "flt_known_confs": f"WITH k AS (SELECT p_partkey % 25 < {_N} AS st, p_size > 25 AS std FROM part) SELECT 'all' AS name, count(*) AS n FROM k UNION ALL SELECT 'proj', count(*) FILTER (WHERE NOT std) FROM k UNION ALL SELECT 'thm', count(*) FILTER (WHERE st) FROM k UNION ALL SELECT 'proj-thm', count(*) FILTER (WHERE st AND NOT std) FROM k",
    "flt_pairs": "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) WHERE n = 1",
    "flt_range_dep": "SELECT l_orderkey, CASE WHEN d <= 2 THEN '1-2' ELSE '3-' END AS range FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) - 1 AS d FROM lineitem GROUP BY 1) WHERE d >= 1",
    "hash_fingerprint": "SELECT p_brand, md5(string_agg(h, ',' ORDER BY h)) AS print FROM (SELECT p_brand, md5(p_partkey || '|' || p_name) AS h FROM part) GROUP BY p_brand",
    "sq_file_queue": """WITH RECURSIVE e AS (SELECT user_id % 10 AS q, event_id, event_type, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('purchase', 'click')),
 r AS (SELECT DISTINCT q, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS puts, CAST(0 AS BIGINT) AS gets, CAST(NULL AS BIGINT) AS taken FROM e
  UNION ALL SELECT r.q, e.i, puts + CAST(event_type = 'purchase' AS INT), gets + CAST(event_type = 'click' AND gets < puts AS INT), CASE WHEN event_type = 'click' AND gets < puts THEN gets + 1 END
  FROM r JOIN e ON e.q = r.q AND e.i = r.i + 1),
 p AS (SELECT q, event_id, row_number() OVER (PARTITION BY q ORDER BY i) AS n FROM e WHERE event_type = 'purchase')
 SELECT e.event_id, p.event_id AS item FROM e JOIN r ON e.q = r.q AND e.i = r.i LEFT JOIN p ON p.q = e.q AND p.n = r.taken WHERE e.event_type = 'click'""",
    "sort_frontier": "SELECT query, ordinal, rank FROM (SELECT c_custkey % 5 AS query, c_custkey AS ordinal, row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY floor(log2(c_custkey)), c_custkey) AS rank FROM customer WHERE c_custkey >= 1 AND NOT c_acctbal > 9000) WHERE rank <= 10",
    "vec_lstsq": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(2.0 AS DOUBLE)), (0, 1, 1.0), (1, 0, 3.0), (1, 1, -1.0)) AS t(i, j, v)",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
