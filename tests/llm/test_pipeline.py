"""The corpus pipeline against a plain, single-machine application of its rules."""

import collections
import hashlib
import itertools
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corpusq.llm import bpe, mixing, pii, queries, toxicity


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(spark, data):
    """Rows of the pipeline by loops over lists; the model, pseudonyms and random keys are the operators' own."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    machine = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    rows = []
    for r in docs.collect():
        margins = np.clip(machine.worst([r.text])[0][0], -3, 3)
        if 1 / (1 + np.exp(-(float(margins @ np.array(machine.scale[:-1])) + machine.scale[-1]))) < 0.5:
            rows.append(r)
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(r.text)) else set() for r in rows}
    first = {i: i for i in sets}

    def top(x):
        while first[x] != x:
            x = first[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b])):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                first[y] = x
    rows = [r for r in rows if top(r.doc_id) == r.doc_id]
    changed = pii.pseudonymised(spark.createDataFrame(rows, docs.schema), pii.session_key(spark)).withColumn("key", mixing.random_key()).collect()
    by_source = collections.defaultdict(list)
    for r in changed:
        by_source[r.source].append(r)
    sizes = {s: sum(len(words(r.text)) for r in v) for s, v in by_source.items()}
    order = sorted(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = min(3.0 * sizes[s], level * weight[s])
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    use = bpe.codec(bpe.tokenizer_path())
    out = []
    for s, v in by_source.items():
        epochs = int(target[s] // sizes[s])
        rest, begin = round(target[s] - epochs * sizes[s]), 0
        for r in sorted(v, key=lambda r: (r.key, r.doc_id)):
            n = len(words(r.text))
            times = epochs + (2 * max(0, min(n, rest - begin)) >= n if n else begin < rest)
            begin += n
            ids = use.library.encode(r.text, add_special_tokens=False).ids
            row = (r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
            out += [row] * int(times)
    return sorted(out)


def test_run_equals_plain_loops(spark, data):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, data).collect())
    assert got == plain(spark, data) and len(got) > 50


def test_stages_keep_the_columns_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "pii", "mixing", "bpe"]
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns


def test_near_duplicates_of_repeated_ids(spark, data):
    """Of each group one text stays, though its doc_id has other texts; blank texts and rows without doc_id stay."""
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, a), (1, a), (1, a.upper()), (1, b), (2, a), (2, b + " u"), (2, "v w x y z"), (3, ""), (3, ""), (3, " "), (3, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, data)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, (r.text or "-").lower()) for r in got.collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (2, "v w x y z"), (3, "-"), (3, " "), (3, "-"), (None, a), (None, a)], key=str)


def test_ten_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
