import random

import xxhash
from pyspark.sql import functions as F

from laminara.llm import simhash as s
from laminara.llm.common import components
from tests.llm.helpers import empty, odd, table, words


def brute_print(text, n=3):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """prints: id to unsigned fingerprint."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents").collect()
    prints = {d.doc_id: brute_print(d.text) for d in docs}
    want = brute_components(prints)
    got = {r.doc_id: r for r in s.op2_simhash(spark, sf).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want


def test_links_of_a_dense_cloud(spark):
    """Thousands of fingerprints around few centres share segments: the way for crowded entries has to find all links."""
    rng = random.Random(1)
    prints = set()
    for _ in range(3):
        c = rng.getrandbits(64)
        prints |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)}
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    want = brute_components({signed(p): p for p in prints})
    for hot in (2, 64):
        found = components(s.near_pairs(fps, hot=hot))
        got = {r.node: r.component for r in found.df.collect()}
        assert all(got.get(i, i) == c for i, c in want.items())


def test_components_of_a_path(spark):
    edges = spark.range(1, 400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert [(r.component) for r in components(edges).df.select("component").distinct().collect()] == [1]
    assert components(edges.where("u = v")) is None
    down = spark.range(2, 300).select((F.lit(1000) - F.col("id")).alias("u"), (F.lit(1001) - F.col("id")).alias("v")).unionByName(spark.createDataFrame([(1, 999)], "u long, v long"))
    assert [r.component for r in components(down).df.select("component").distinct().collect()] == [1]


def test_odd_rows(spark):
    out = s.near_duplicates(odd(spark)).collect()
    assert len(out) == 11
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[2].fp == by[3].fp == by[4].fp == 0 and by[3].component_id == by[4].component_id == 2
    assert by[6].component_id == 1 and by[1].n_same == 3
    assert sorted(r.component_id for r in out if r.doc_id is None and r.fp == 0) == [2]
    assert s.near_duplicates(empty(spark)).count() == 0
    kept = s.keep_one(odd(spark), n=3, percent=None)
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 5, 7, 8]
    assert kept.where("doc_id is null").count() == 2
