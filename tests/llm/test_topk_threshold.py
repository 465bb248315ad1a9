import duckdb
import numpy as np
from pyspark.sql import functions as F

from laminara.llm import topk_threshold as t


def test_same_rows_as_sql(spark, sf):
    duckdb.execute(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, t.op4_threshold(spark, sf).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(duckdb.execute(t.OP4_SQL).fetchall())


def test_lists_stop_early_and_are_exact():
    rng = np.random.default_rng(0)
    for n, dim in ((3000, 3), (500, 8), (3, 4), (1, 2)):
        x = rng.integers(-50, 50, (n, dim))
        lists = t.Lists(np.arange(n), x)
        for own in (0, n - 1, 10**6):
            q = rng.integers(-50, 50, dim)
            ids, scores = lists.top(own, q, 5)
            want = sorted(((-int(x[i] @ q), i) for i in range(n) if i != own))[:5]
            assert [(-s, i) for i, s in zip(ids, scores, strict=True)] == want
    assert list(t.Lists(np.arange(4), np.ones((4, 2), int)).top(1, np.zeros(2, int), 5)[0]) == [0, 2, 3]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 3)
    monkeypatch.setattr(t, "QUERY_BLOCK", 1)
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (8, [float("inf"), 0.0]), (None, [1.0, 1.0]), (50, [0.5, 2.0]), (9, [3.0e4, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "b", "qb", "asks")})
    v = t.whole_vectors(df, "vec_id", "embedding")
    got = [(r.query_id, r["rank"], r.vec_id) for r in t.top_k(v, "id % 50 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9), (0, 2, 1), (0, 3, 2), (0, 4, 2), (0, 5, 50), (50, 1, 9), (50, 2, 0), (50, 3, 1), (50, 4, 2), (50, 5, 2)]
    assert t.top_k(v.where("id < 0"), "true").count() == 0


def test_repeated_ids_as_in_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 7)
    monkeypatch.setattr(t, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 3, 3) / 4]) for i in rng.integers(0, 60, 80)] + [(50, [0.5, 0.5, 0.25])] * 3 + [(0, [1.0, -1.0, 0.0]), (0, [0.0, 1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.execute(f"create or replace view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, t.op4_threshold(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(duckdb.execute(t.OP4_SQL).fetchall()) and len(got) >= 25
