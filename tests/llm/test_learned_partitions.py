import numpy as np
from pyspark.sql import functions as F

from laminara.llm import learned_partitions as t
from tests.llm.helpers import table


def brute(rows, every=50, k=5):
    """[(query_id, rank, vec_id)] and scores from (id, x) by comparing all rows."""
    x = np.array([v for _, v in rows], float)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    ids = np.array([i for i, _ in rows])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = np.round(u @ u[q], 12)
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out.setdefault(int(ids[q]), []).append([(int(ids[j]), float(s[j])) for j in order])
    return out


def recall(got, want):
    near = {}
    for r in got:
        near.setdefault(r.query_id, {})[r.vec_id] = r.score
    pairs = [(q, v, s) for q, lists in want.items() for v, s in lists[0]]
    return sum(v in near.get(q, {}) and abs(near[q][v] - s) < 1e-9 for q, v, s in pairs) / len(pairs)


def test_recall_on_given_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    v = t.usable(table(spark, sf, "embeddings"), "vec_id", "embedding")
    want = brute(rows)
    got = t.op11_partitions(spark, sf).collect()
    assert recall(got, want) >= 0.9 and len(got) == 5 * len(want)
    for args in ({"part_rows": 40}, {"part_rows": 40, "split_rows": 90}):  # one level and two
        assert recall(t.nearest(v, "id % 50 = 0", **args).collect(), want) >= 0.9


def test_clusters_are_reached_by_few_parts(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((16, 12))
    u = t.unit(np.repeat(centres, 60, 0) + 0.1 * rng.standard_normal((960, 12)))
    router = t.fitted(u, 4, 0.95)
    routes, parts = router.routes(u), router.dealt(u)
    near = t.links(u, 5)
    assert np.mean([routes[i, parts[near[i]]].mean() for i in range(len(u))]) >= 0.93
    assert routes.sum(1).mean() < 4 and np.bincount(parts, minlength=16).max() < 200


def test_halves_are_balanced_and_cut_few_links():
    rng = np.random.default_rng(0)
    u = t.unit(np.concatenate([rng.standard_normal((101, 6)) + 4 * s for s in (-1, 1)]))
    near = t.links(u, 6)
    a, b = np.repeat(np.arange(202), 6), near.ravel()
    part = t.halved(np.r_[a, b], np.r_[b, a], np.zeros(202, np.int64), rng)
    assert sorted(np.bincount(part)) == [101, 101] and (part[a] != part[b]).mean() < 0.02
    for n in (2, 3, 5):
        part = t.halved(np.array([0, 1]), np.array([1, 0]), np.zeros(n, np.int64), rng)
        assert abs(np.bincount(part, minlength=2)[0] - n / 2) <= 0.5


def test_many_copies_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 7)
    monkeypatch.setattr(t, "QUERY_BLOCK", 2)
    rows = [(i, [1.0, 1.0]) for i in range(100)] + [(200, [2.0, 2.0]), (201, [1.0, 0.0]), (250, [0.0, 1.0]), (250, [0.0, 1.0]), (300, [3e200, 0.0]), (301, [1e-200, 1e-201]), (350, [-1.0, 0.5])]
    odd = [(400, None), (450, []), (500, [0.0, 0.0]), (550, [None, 1.0]), (600, [float("nan"), 1.0]), (650, [float("inf"), 1.0]), (None, [1.0, 0.0]), (700, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "x", "row", "cls", "node", "h", "g", "b", "n")})
    v = t.usable(df, "vec_id", "embedding")
    got = t.nearest(v, "id % 50 = 0").orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert by[0] == [(k, k, 1.0) for k in range(1, 6)] and by[50] == [(k, k - 1, 1.0) for k in range(1, 6)]
    assert by[200] == [(k, k - 1, 1.0) for k in range(1, 6)]
    assert [x[1] for x in by[300]] == [201, 301, 0, 1, 2]
    assert [x[:2] for x in sorted(by[250])] == sorted([(1, 250), (1, 250)] + [(k, k - 2) for k in range(2, 6)] * 2)
    assert 700 not in by and set(by) == {0, 50, 200, 250, 300, 350}
    assert t.nearest(v.where("false"), "true").count() == 0
    few = t.nearest(v.where("id in (0, 201, 250)"), "id = 0").collect()
    assert sorted(r.vec_id for r in few) == [201, 250, 250]
