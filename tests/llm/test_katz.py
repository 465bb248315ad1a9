import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminara.llm import katz as k
from tests.llm.helpers import empty, odd, table, words


class Brute:
    """The same model with dictionaries and plain recursion."""

    def __init__(self, texts):
        self.counts = [collections.Counter() for _ in range(4)]  # by order; contexts as tuples, nearest word last
        for t in texts:
            w = ["<s>", "<s>", *self.tokens(t)]
            for i in range(2, len(w)):
                for n in (1, 2, 3):
                    self.counts[n][tuple(w[i - n + 1 : i + 1])] += 1
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.discounts = [None, *(k.Discounts(collections.Counter(c.values())).d for c in self.counts[1:])]
        lost = sum((1 - self.d(1, x)) * x for x in self.counts[1].values())
        self.unk = max(lost / self.n, 1 / (self.n + 1))
        self.scale = (1 - self.unk) / (1 - lost / self.n)
        self.after = collections.defaultdict(dict)
        for c in self.counts[2:]:
            for gram, x in c.items():
                self.after[gram[:-1]][gram[-1]] = x
        self.memo = {}

    @staticmethod
    def tokens(t):
        return [*(w.lower() for w in words(t)), "</s>"]

    def d(self, order, x):
        return self.discounts[order][x] if x <= k.K else 1.0

    def total(self, h):
        seen = self.after[h]
        return sum(seen.values()) + (not any(self.d(len(h) + 1, x) < 1 for x in seen.values()))

    def backoff(self, h):
        if h not in self.memo:
            seen, n = self.after[h], self.total(h)
            self.memo[h] = (1 - sum(self.d(len(h) + 1, x) * x for x in seen.values()) / n) / (1 - sum(self.p(h[1:], w) for w in seen))
        return self.memo[h]

    def p(self, h, w):
        if not h:
            c = self.counts[1][w,]
            return self.d(1, c) * c / self.n * self.scale if c else self.unk
        if h not in self.after:
            return self.p(h[1:], w)
        x = self.after[h].get(w)
        return self.d(len(h) + 1, x) * x / self.total(h) if x else self.backoff(h) * self.p(h[1:], w)

    def score(self, t):
        w = ["<s>", "<s>", *self.tokens(t)]
        return sum(math.log10(self.p((w[i - 2], w[i - 1]), w[i])) for i in range(2, len(w)))


def split(docs):
    return {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 7 == 2 for d in docs}


def test_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents").collect()
    out = split(docs)
    m = Brute(d.text for d in docs if not out[d.doc_id])
    vocabulary = [w for (w,) in m.counts[1]]
    for h in (("<s>", "<s>"), ("<s>", b"the"), (b"the",), ("<s>",), *list(m.counts[2])[:5]):  # exactly normalised
        rest = 1.0
        for i in range(len(h)):
            rest *= m.backoff(h[i:]) if h[i:] in m.after else 1
        assert abs(sum(m.p(h, w) for w in vocabulary) + rest * m.unk - 1) < 1e-9
    got = {r.doc_id: r for r in k.op3_katz(spark, sf).collect()}
    assert len(got) == len(docs)
    gain = 0.0
    for d in docs:
        w, r = m.tokens(d.text), got[d.doc_id]
        assert r.held_out == out[d.doc_id] and r.n_tokens == len(w) and r.train_tokens == m.n
        assert r.n_known == sum(m.counts[1][x,] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((m.counts[1][x,] + 1) / (m.n + m.v + 1)) for x in w), abs=1e-6)
        assert r.score == pytest.approx(m.score(d.text), abs=1e-6)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


@pytest.mark.parametrize("hot", [3, 20, 200])
def test_small_blocks_buckets_and_hot_words_change_nothing(spark, sf, monkeypatch, hot):
    docs = table(spark, sf, "documents").where("doc_id < 40")
    rows = lambda **x: sorted((r.doc_id, r.n_known, round(r.score, 6)) for r in k.score_documents(docs, F.expr(k.HELD_OUT), **x).collect())
    want = rows()
    m = Brute(d.text for d in docs.collect() if not split([d])[d.doc_id])
    assert [x[2] for x in want] == [pytest.approx(m.score(d.text), abs=1e-5) for d in sorted(docs.collect(), key=lambda d: d.doc_id)]
    monkeypatch.setattr(k, "BLOCK", 500)
    assert rows(bucket=300, hot_count=hot) == want


def test_stored_tables(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id < 60")
    m = Brute(d.text for d in docs.collect() if not split([d])[d.doc_id])
    t = k.fit(docs, F.expr(k.HELD_OUT), hot_count=30)
    assert sorted(r.c for r in k.unigrams(t).where("c > 0").collect()) == sorted(m.counts[1].values())
    rows = k.ngrams(t).collect()
    assert sorted(r.c for r in rows) == sorted(m.counts[3].values())
    assert sorted(round(r.p, 9) for r in rows) == sorted(round(m.p(g[:2], g[2]), 9) for g in m.counts[3])
    t.drop()


def test_long_words_that_other_hashes_confuse(spark):
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = bits.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(0, f"{bits} x"), (1, f"{bits} x"), (2, f"{other} x")], "doc_id long, text string")
    got = {r.doc_id: r.n_known for r in k.score_documents(docs, F.expr("doc_id = 2")).collect()}
    assert got == {0: 3, 1: 3, 2: 2}


def test_odd_rows(spark):
    out = k.score_documents(odd(spark), F.expr(k.HELD_OUT)).collect()
    assert len(out) == 11 and all(np.isfinite([r.score, r.base_score]).all() for r in out)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1 and by[2].score == by[3].score
    twice = [r for r in out if r.doc_id == 6]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert sum(r.doc_id is None for r in out) == 2
    assert k.score_documents(empty(spark), F.expr(k.HELD_OUT)).count() == 0
    none = k.score_documents(odd(spark), F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and abs(r.score) < 1e-9 for r in none)


def test_discounts_fall_back():
    assert k.Discounts({}).d[1] == 0.5 and k.Discounts({1: 10, 2: 100}).d[1] == 0.5
    d = k.Discounts({1: 1000, 2: 400, 3: 200, 4: 120, 5: 80, 6: 50}).d
    assert all(0 < x < 1 for x in d[1:])
