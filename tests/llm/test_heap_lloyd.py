import duckdb
import numpy as np
from pyspark.sql import functions as F

from laminara.llm import heap_lloyd as t


def brute(rows, parts=4, entries=256, rounds=4):
    """(id, code, error, label_error) and codebooks from (id, v, label) by full scans with Python's integers."""
    rows = sorted(rows)
    w = len(rows[0][1]) // parts
    cut = [[[v[p * w : (p + 1) * w] for _, v, _ in rows] for p in range(parts)]][0]
    books = [[list(x) for x in c[:entries]] for c in cut]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for k in range(rounds + 1):
        at = [[min(range(len(b)), key=lambda e: (far(x, b[e]), e)) for x in c] for c, b in zip(cut, books, strict=True)]  # noqa: B023
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    if own := [x for x, a in zip(cut[p], at[p], strict=True) if a == e]:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    errors = [sum(far(cut[p][i], books[p][at[p][i]]) for p in range(parts)) for i in range(len(rows))]
    labels = {y: sum(e for e, r in zip(errors, rows, strict=True) if r[2] == y) for _, _, y in rows}
    return sorted((r[0], "".join(f"{at[p][i]:02x}" for p in range(parts)), errors[i], labels[r[2]]) for i, r in enumerate(rows)), books


def rows_of(df):
    return sorted(map(tuple, df.select("id", "code", "error", "label_error").collect()))


def test_same_rows_as_sql(spark, sf):
    duckdb.execute(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, t.op12_codes(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))
    assert got == sorted(duckdb.execute(t.OP12_SQL).fetchall()) and len(got) == 500


def test_brute_force_with_ties_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 37)
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (6, 8))
    clustered = [(i, [int(c) for c in centres[i % 6] + rng.integers(-6, 7, 8)], i % 3 or None) for i in range(300)]
    tied = [(i, [int(c) for c in rng.integers(-2, 3, 8)], None) for i in range(200)]
    huge = [(i, [int(c) * 2**40 + i for c in rng.integers(-3, 4, 4)], 1) for i in range(40)]
    for rows, parts, entries in ((clustered, 4, 12), (tied, 4, 9), (tied, 2, 1), (huge, 2, 5)):
        scans = []
        df, books = t.compress(spark.createDataFrame(rows, "id long, v array<long>, label int").repartition(3), parts, entries, scans=scans)
        want, wanted = brute(rows, parts, entries)
        fits = lambda x: x if x < 2**63 else None
        got = rows_of(df.withColumn("label_error", F.coalesce("label_error", F.lit(-1))).withColumn("error", F.coalesce("error", F.lit(-1))))
        whole = all(r[2] < 2**63 for r in want)
        assert got == [(a, b, -1 if fits(c) is None else c, d if whole and d < 2**63 else -1) for a, b, c, d in want]
        assert [[list(map(int, e)) for e in b] for b in books] == wanted
        assert scans[0] == len(rows) * parts
        if rows is clustered:  # bounds spare most of the later scans
            assert sum(scans[1:]) < 0.6 * 4 * scans[0]


def test_odd_rows(spark):
    rows = [(3, [1.0, 2.0, 3.0, -0.0001], 1), (1, [0.5] * 4, None), (1, [0.5] * 4, None), (2, None, 1), (4, [1.0, None, 0.0, 0.0], 1), (5, [float("nan")] * 4, 1), (6, [float("inf")] * 4, 1), (7, [1.0], 2), (8, [], 2), (9, [-1.0, 0.0, 1.0, 1e-9], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("id", "v", "x", "n", "code", "error", "same")})
    v = t.usable(df, "vec_id", "embedding", "label", 1024)
    want, books = brute([(1, [512] * 4, None), (1, [512] * 4, None), (3, [1024, 2048, 3072, -1], 1), (9, [-1024, 0, 1024, 0], None)])
    got, made = t.compress(v)
    assert rows_of(got) == want and made.shape == (4, 4, 1)
    none, _ = t.compress(v.where("false"))
    assert none.count() == 0 and none.columns == ["id", "code", "error", "label", "label_error"]


def test_more_labels_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(t, "BROADCAST_IDS", 0)
    rows = [(i, [i, -i], "a" if i % 3 else None) for i in range(20)]
    got, _ = t.compress(spark.createDataFrame(rows, "id long, v array<long>, label string"), 2, 3)
    assert rows_of(got) == brute(rows, 2, 3)[0]
