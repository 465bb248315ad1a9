"""The near-dedup stage against brute force over five-word shingles."""

import random

import corpus_pipeline as c
from laminara.llm import simhash as s
from tests.llm.helpers import empty, odd, table


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    return {v for v in sets for u in sets if u < v and sets[u] and 10 * len(sets[u] & sets[v]) >= 8 * len(sets[u] | sets[v])}


def similar(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = s.similar_rows(df, s.signatures(df.selectExpr("doc_id", "doc_id as row", "text")))
    return set() if found is None else {r.doc_id for r in found.df.collect()}


def test_stage_leaves_no_similar_pair(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").cache()
    by_print = {d.doc_id: d.text for d in s.keep_one(docs, percent=None).collect()}
    gone = brute(by_print)
    assert gone  # edited copies that lie further apart than two bits
    got = dict(c.STAGES)["SimHash near-dedup"](spark, docs, sf)
    assert got.columns == docs.columns and sorted(d.doc_id for d in got.collect()) == sorted(set(by_print) - gone)


def test_chains_and_bounds(spark):
    base = [f"w{i}" for i in range(200)]
    texts = {k: base[k * 4 : k * 4 + 100] for k in range(12)}  # each like its neighbours, far ones not
    texts |= {20: ["a", "b"], 21: ["A", "b"], 22: ["b", "a"], 23: []}
    docs = {k: " ".join(w) for k, w in texts.items()}
    assert similar(spark, docs) == brute(docs) != set()


def test_a_crowd_and_a_joined_id_list(spark, monkeypatch):
    docs = {k: " ".join(f"w{i}" if i != k else "x" for i in range(300)) for k in range(60)} | {100 + k: f"other {k} text" for k in range(5)}
    assert similar(spark, docs) == brute(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = sorted(r.doc_id for r in s.keep_one(df).collect())
    monkeypatch.setattr("laminara.llm.common.BROADCAST_IDS", 1)
    assert sorted(r.doc_id for r in s.keep_one(df).collect()) == want == [0, *range(100, 105)]


def test_odd_rows(spark):
    assert s.keep_one(empty(spark)).count() == 0
    rows = [(1, "a b"), (1, "c d"), (1, "c d"), (2, "a b"), (3, "c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = s.keep_one(df).collect()
    assert [r.doc_id for r in kept].count(1) == 1 and len(kept) == 2  # one of the rows of id 1, and the text it is not
    kept = s.keep_one(odd(spark))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 5, 7, 8]


def template(n, blocks=30, taken=20, words=40, seed=3):
    """Documents that each hold some of a few common blocks, in the blocks' order; few of them are alike at 0.8."""
    rng = random.Random(seed)
    common = [[f"b{k}w{i}" for i in range(words)] for k in range(blocks)]
    seen, docs = set(), {}
    while len(docs) < n:
        some = tuple(sorted(rng.sample(range(blocks), taken)))
        if some not in seen:
            seen.add(some)
            docs[len(docs)] = " ".join(w for k in some for w in common[k])
    return docs


def test_templates_make_few_pairs(spark, monkeypatch):
    """Join rows follow the documents, and what is alike is found all the same."""
    rows = []
    for n in (500, 1000, 2000):
        docs = template(n, words=15)
        near = docs[7].split()
        docs |= {n + 1: " ".join([*near[:100], "edited", *near[101:]]), n + 2: docs[9] + " with an end of its own"}
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4).cache()
        joined = []
        found = {r.doc_id for r in s.similar_rows(df, s.signatures(df.selectExpr("doc_id", "doc_id as row", "text")), joined=joined).df.collect()}
        assert {n + 1, n + 2} <= found
        if n == 500:
            assert found == brute(docs)
        rows.append(sum(joined))
        df.unpersist()
    assert rows[2] < 2 ** (1.3 * 2) * rows[0] and rows[2] < 150 * 2000, rows


def test_crowds_are_found_on_every_level(spark, monkeypatch):
    """With every key crowded, documents go down to the last level, and nothing is lost."""
    monkeypatch.setattr(s, "CROWD", 0)
    monkeypatch.setattr(s, "LATE_CROWD", 0)
    docs = template(40, 16, 14, 24) | {100 + k: f"other {k} text" for k in range(5)}
    assert similar(spark, docs) == brute(docs) != set()


def test_copies_edited_too_much_leave_the_crowd(spark, monkeypatch):
    """Crowded keys: only documents that can be similar by one of them get the keys of longer bands."""
    draw, docs = random.Random(11), {}
    for k in range(60):
        words = [f"w{i}" for i in range(200)]
        for i in range(k % 5, 200, 28):
            words[i] = f"edit{draw.random()}"
        docs[k] = " ".join(words)
    docs[100] = docs[3].replace("w100 ", "other ")
    seen, longer = [], s.longer_bands
    monkeypatch.setattr(s, "longer_bands", lambda sets, level: (seen.append(sets.count()), longer(sets, level))[1])
    monkeypatch.setattr(s, "CROWD", 0)
    assert similar(spark, docs) == brute(docs) == {100}
    assert max(seen, default=0) < 10


def test_prefixes_that_can_be_reached_hold_every_similar_pair(spark):
    """Sets of one family at sizes up to twice each other's: similar ones share an entry that stays, and some entries go."""
    draw, sets = random.Random(12), {}
    for k in range(150):
        size = draw.randint(4, 60)
        sets[k] = {draw.randint(0, size + 8) if draw.random() < 0.97 else draw.randint(1000, 9000) for _ in range(3 * size)}
    df = spark.createDataFrame([(k, sorted(x)) for k, x in sets.items()], "doc_id long, set array<long>")
    spent, keys = [], s.prefixes(df, 80)
    got = {}
    for r in s.reachable(keys, 80, spent).collect():
        got.setdefault(r.doc_id, set()).add(r.key)
    pairs = [(u, v) for u in sets for v in sets if u < v and 10 * len(sets[u] & sets[v]) >= 8 * len(sets[u] | sets[v])]
    assert len(pairs) > 50 and all(got[u] & got[v] for u, v in pairs)
    assert sum(map(len, got.values())) < keys.count()
    for t in spent:
        t.drop()
