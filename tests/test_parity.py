"""Every query with an oracle gives DuckDB's rows."""

import numpy as np
import pandas as pd
import pytest

from corpusq.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating, int, np.integer)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, duck, name):
    got = registry.queries()[name](spark, data).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_lookup_of_texts_without_words(spark, tmp_path):
    """Documents whose text is null, empty or has no letter name nothing and are found by no item."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["Alpha beta", "", None, "2024 !?", "数据 7", "3 Omega", "gamma", "alpha"]
    docs = [(i, x, "de" if i % 2 else "en", "src1") for i, x in enumerate(texts)]
    docs[-1] = (7, "alpha", None, "src2")
    items = [(1, "alpha gamma" + " x" * 20 + " omega"), (21, ""), (2, "12"), (22, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.queries()["q_lookup"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(registry.oracle_sql()["q_lookup"]).df())
    assert sorted(zip(got["query"], got["doc"], got["score"], strict=True)) == [(1, 0, 0.5), (1, 5, 0.7), (1, 6, 0.5)]
