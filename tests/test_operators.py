"""Semantics that no SQL oracle covers, on fixtures worked out by hand."""

import gzip
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusq.functions import arrow
from corpusq.functions import text as tx
from corpusq.operators import corpus, evaluation, graph, retrieval, stats, trajectory, visibility
from corpusq.plans import storage
from corpusq.sources import readers, writers
from corpusq.streaming import queue


def test_state_values(spark):
    steps = spark.createDataFrame([(1, 0, "A", True), (1, 1, "B", True), (2, 0, "A", False), (2, 1, "C", False), (2, 2, "C", False)], "k int, i int, s string, ok boolean")
    got = {r.s: r.value for r in trajectory.state_values(steps, "k", "s", "ok").collect()}
    assert got == {"A": 0.5, "B": 1.0, "C": 0.0}


@pytest.mark.parametrize(("k", "n"), [(1, 1), (2, 3), (3, 5), (9, 6)])
def test_distinct_cutoff(spark, k, n):
    rows = spark.createDataFrame([("q", p, i + 1) for i, p in enumerate(["p1", "p1", "p2", "p1", "p3", "p1"])], "query string, p string, rank int")
    assert sorted(r["rank"] for r in retrieval.distinct_cutoff(rows, "p", k).collect()) == list(range(1, n + 1))


def test_gather_keeps_order_and_repeats(spark):
    v = spark.createDataFrame([(i, i * 10) for i in range(1, 6)], "id int, x int")
    for ids in ([1, 2, 3, 4, 5], [5, 4, 3, 2, 1], [5, 3, 3, 4, 3, 1, 1, 2, 1]):
        req = spark.createDataFrame([("r", ids)], "request string, ids array<int>")
        assert [r.x for r in retrieval.gather(req, v).orderBy("pos").collect()] == [i * 10 for i in ids]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(st.sampled_from(["a", "b", "c ", "", "dd"]), max_size=30))
def test_duplicates(spark, lines):
    got = corpus.duplicate_report(spark.createDataFrame([(x,) for x in lines], "line string"), "line").first()
    assert (got.rows or 0, got.distinct_rows, got.dropped or 0) == (len(lines), len(set(lines)), len(lines) - len(set(lines)))


def test_intervals_are_half_open(spark):
    a = spark.createDataFrame([("k", 1, 0, 2), ("k", 2, 0, 5)], "k string, id int, start int, end int")
    b = spark.createDataFrame([("k", 7, 2, 4), ("k", 8, 1, 9), ("z", 9, 0, 9)], "k string, id int, start int, end int")
    assert {(r.id, r.other) for r in visibility.overlaps(a, b, ["k"]).collect()} == {(1, 8), (2, 7), (2, 8)}


def test_published_statistics(spark):
    lo, hi = stats.wilson(F.col("x"), F.col("n"))
    got = spark.createDataFrame([(237, 251), (242, 251), (0, 0)], "x int, n int").select(F.round(lo, 1).alias("lo"), F.round(hi, 1).alias("hi")).collect()
    assert [tuple(r) for r in got] == [(90.9, 96.6), (93.3, 98.1), (None, None)]
    p = spark.createDataFrame([(13, 8), (0, 0), (3, 3)], "b int, c int").select(F.round(stats.mcnemar(F.col("b"), F.col("c")), 3).alias("p")).collect()
    assert [r.p for r in p] == [0.383, 1.0, 1.0]


def test_group_scores(spark):
    x = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 2.0)], "g string, x double")
    assert [round(r.z, 3) for r in x.select(stats.zscore("x", "g").alias("z")).collect()] == [0.0, 0.0, -1.0, 1.0]
    assert [round(r.z, 6) for r in x.select(stats.zscore_floor("x", "g").alias("z")).collect()] == [0.0, 0.0, -1.0, 1.0]


def test_split_leakage(spark):
    files = spark.createDataFrame([(1, "t"), (2, "v"), (3, "v"), (4, "x"), (5, "x"), (6, "x")], "file int, p string")
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c"), (6, "d"), (2, "d")], "file int, text string")
    got = {r.file: r.split for r in corpus.split_predefined(files, texts, F.col("p") == "t", F.col("p") == "v").collect()}
    assert got == {1: "test", 3: "val", 5: "train", 6: "train"}


def test_checker_rewards(spark):
    x = spark.createDataFrame([("VALID", True), ("INVALID", True), ("COMPLETE", True), ("VALID", False), ("INVALID", False)], "r string, ok boolean")
    assert [float(r.v) for r in x.select(trajectory.checker_rewards(F.col("r"), F.col("ok")).alias("v")).collect()] == [1.0, -0.1, 1.0, -0.05, -0.1]


def test_goal_ids(spark):
    x = spark.createDataFrame([(["n, m: nat", "H: n = m"], "m = n")], "h array<string>, g string").select(tx.goal_ids(F.col("h"), F.col("g")).alias("x")).first().x
    assert (x.hyp_ids, x.goal_ids) == (["nat"], [])


def test_strings(spark):
    one = spark.range(1)
    lit = lambda c: one.select(c.alias("x")).first().x
    assert lit(tx.split_steps(F.lit("intros. apply Int.eq. auto."))) == ["intros.", "apply Int.eq.", "auto."]
    assert lit(tx.head(F.lit("  rewrite H."))) == "rewrite" and lit(tx.head(F.lit(" "))) == "<empty>" and lit(tx.head(F.lit("{ x"))) == "{"
    assert lit(tx.error_class(F.lit("Unable to unify a with b"))) == "unify" and lit(tx.error_class(F.lit(" "))) == "empty"
    assert lit(tx.common_suffix(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "xbc")))) == 2
    assert arrow.without_comments('a (* b (* c *) d *) "(* e *)"') == 'a  "(* e *)"'
    assert arrow.conclusion("(a -> b) -> c -> d") == "d" and arrow.conclusion("(a -> b)") == "(a -> b)"
    assert arrow.renamed("foo foo' x", arrow.renaming("lemma foo x", "lemma bar x")) == "bar foo' x"
    assert arrow.covers(["x y: T"], "f x y", ["a b: T"], "f a b") and not arrow.covers(["x: T"], "f x x", ["a b: T"], "f a b")
    chain, back = ["a, b, c: T", "h: a = b", "i: b < a", "j: b = c"], ["a, b, c: T", "h: b = c", "i: b < a", "j: a = b"]
    assert arrow.covers(chain, "False", back, "False") and not arrow.covers(chain, "False", back[:3], "False")
    assert arrow.covers([], "forall x, (forall y, x = y) -> x = z", [], "forall u, (forall v, u = v) -> u = z")
    assert not arrow.covers([], "(forall y, y = y) -> y = z", [], "(forall v, v = v) -> v = z")
    assert arrow.introduced("forall x y, x = y -> (a -> b) -> forall z, P z.") == (["x y", "x = y", "(a -> b)", "z"], "P z")
    assert arrow.rename_variants([("Vint", "Vlong")])["module"] == [("Vint", "Vlong"), ("Int.", "Int64.")]


def test_joint_results(spark):
    a = spark.createDataFrame([(1, True, 5.0), (2, False, None)], "item int, success boolean, time double")
    b = spark.createDataFrame([(1, False, 3.0), (3, True, 700.0)], "item int, success boolean, time double")
    got = {r.item: (r.time, r.success) for r in evaluation.joint(a, b, ["item"]).collect()}
    assert got == {1: (3.0, True), 2: (None, False), 3: (700.0, False)}


def test_value_iteration_and_labels(spark):
    nodes = spark.createDataFrame([(1, None, 0, False), (2, 1, 1, False), (3, 1, 1, False), (4, 2, 2, True)], "id int, parent int, depth int, solved boolean")
    v = {r.id: r.v for r in graph.value_iteration(nodes.select("id", F.when(F.col("solved"), 1.0).alias("reward")), nodes.where("parent IS NOT NULL").select(F.col("parent").alias("id"), F.col("id").alias("child")), 0.5).collect()}
    assert v == {1: 0.25, 2: 0.5, 3: 0.0, 4: 1.0}
    assert {r.id: (r.below, r.dist) for r in graph.tree_labels(nodes, 2).collect()} == {1: (True, 2), 2: (True, 1), 3: (False, None), 4: (True, 0)}


def test_least_squares(spark):
    rows = [([float(i), float(i * i % 7)], [2.0 * i, i + 3.0 * (i * i % 7)]) for i in range(20)]
    m = retrieval.least_squares(spark.createDataFrame(rows, "x array<double>, y array<double>"), "x", "y", 2, 2)
    assert abs(m - [[2, 1], [0, 3]]).max() < 1e-6


def test_readers_and_writers(spark, tmp_path):
    sentence = {"text": "Lemma a : x.", "file_path": "f.v", "module": ["M"], "type": "LEMMA", "line": 3}
    point = {
        "file_context": [json.dumps({"file": "f.v", "workspace": "w", "repository": "r"}), json.dumps(sentence)],
        "proofs": [{"proof_idx": 0, "theorem": {"term": sentence}, "steps": [{"n_step": 0, "step": {"text": "auto.", "context": []}, "goals": ["x"]}]}]}
    (tmp_path / "dp").mkdir()
    (tmp_path / "dp/a.json").write_text(json.dumps(point, indent=1))
    points = readers.data_points(spark, str(tmp_path / "dp"))
    r = points.first()
    assert (r.file, r.premises[0].line, r.premises[0].module) == ("f.v", 3, ["M"])
    assert "premises" not in readers.data_points(spark, str(tmp_path / "dp"), True).columns
    assert [(s.step_idx, s.text) for s in readers.steps(points).collect()] == [(0, "auto.")]
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "x.jsonl.gz"), "a int", True).collect()) == [1, 2]
    (tmp_path / "log.txt").write_text("run 1\nok=3\nrun 2\nok=4\n")
    assert [(b.n, b.ok) for b in readers.log_blocks(spark, str(tmp_path / "log.txt"), r"run \d+\nok=\d+", {"n": r"run (\d+)", "ok": r"ok=(\d+)"}).orderBy("pos").collect()] == [("1", "3"), ("2", "4")]
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string")
    writers.json_lines(rows, str(tmp_path / "out"), "v")
    with pytest.raises(Exception, match="(?i)exists"):
        writers.json_lines(rows, str(tmp_path / "out"), "v")
    writers.csv(rows, str(tmp_path / "csv"), "id")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    writers.vector_pages(rows, str(tmp_path / "pages"), 2)
    assert spark.read.parquet(str(tmp_path / "pages")).where("page = 0").count() == 1
    calls = []
    for _ in range(2):
        assert writers.read_through(spark, str(tmp_path / "cache"), lambda: calls.append(1) or rows).count() == 2
    assert calls == [1]
    split = {f"{n}_files": [{"dp_name": n, "file": "f", "workspace": "w", "repository": "r"}] for n in ("train", "val", "test")}
    (tmp_path / "split.json").write_text(json.dumps(split))
    assert {(r.split, r.dp_name) for r in readers.split_file(spark, str(tmp_path / "split.json")).collect()} == {(n, n) for n in ("train", "val", "test")}
    (tmp_path / "res/sub").mkdir(parents=True)
    (tmp_path / "res/a.json").write_text('{"thm": "t", "ok": true}')
    (tmp_path / "res/sub/b.json").write_text('{"thm": "u", "ok": false}')
    assert readers.result_folder(spark, str(tmp_path / "res"), "thm string, ok boolean", ["thm"]).count() == 2


def test_streaming_counts(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", "ab"[i % 2], float(i)) for i in range(12)], "id int, ts string, k string, value double").write.parquet(str(tmp_path / "in"))
    stream = queue.arriving(spark, str(tmp_path / "in"), "id int, ts string, k string, value double")
    run = queue.windowed_counts(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("counts")
    assert got.agg(F.sum("n")).first()[0] == 12 and got.count() == 6


def test_frontier_takes_all_nodes(spark, tmp_path):
    rows = [(i, 9999.0 if i < 1024 else 1.0) for i in range(1, 1400)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = [(r.query, r.rank, r.ordinal) for r in storage.sort_frontier(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(q, n, 1024 + (q - 1024) % 5 + 5 * (n - 1)) for q in range(5) for n in range(1, 11)]


def test_fifo_takes_each_item_once(spark):
    rows = [(1, "g"), (2, "p"), (3, "p"), (4, "g"), (5, "g"), (6, "g"), (7, "p"), (8, "p"), (9, "g"), (10, "p")]
    events = spark.createDataFrame([(q, *r) for q in (1, 2) for r in rows], "queue int, at int, what string")
    got = corpus.fifo(events, "queue", ["at"], F.col("what") == "p", F.col("what") == "g").collect()
    assert {(r.queue, r.at): r.item and r.item["at"] for r in got} == {(q, at): item for q in (1, 2) for at, item in ((1, None), (4, 2), (5, 3), (6, None), (9, 7))}
