import zlib

import numpy as np

from laminara.llm import toxicity_mil as t
from tests.llm.helpers import empty, labels, odd, table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"  # the smallest table has too few labels; of these toxic ones a tenth hold no telling word
    out = {r.doc_id: r for r in t.op6_toxicity(spark, sf).collect()}
    assert len(out) == table(spark, sf, "documents").count()
    truth = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in list(out)[:500])
    y, p = np.array([truth[i] for i in held]), np.array([out[i].predicted for i in held])
    assert (p[y == 1] == 1).mean() > 0.85 and (p[y == 0] == 0).mean() > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_noisy_or_finds_the_sentence():
    """Bags in which one sentence of label 1 holds the word; the trained weights name that sentence."""
    rng = np.random.default_rng(0)
    docs = []
    for i in range(200):
        y = i % 2
        full = [[int(rng.integers(1, 4))] for _ in range(3)] + ([[0, int(rng.integers(1, 4))]] if y else [])
        docs.append((y, 5, full))
    m = t.fit(docs, ["bad", "b", "c", "d"])
    s = t.Scorer(m)
    found = s.sentences("A b here. This is BAD, b. c d!\nc")
    assert len(found) == 4 and max(found, key=lambda x: x[2])[:2] == (9, 24) and s.score(found) > 0.5
    assert s.score(s.sentences("b c. d b.")) < 0.5


def test_gradient_of_the_noisy_or():
    docs = [(1, 2, [[0], [1, 2]]), (0, 1, [[1]]), (1, 0, [[2]]), (0, 3, [])]
    m = t.fit(docs, ["x", "y", "z"], rounds=400)
    s = t.Scorer(m)
    assert s.score(s.sentences("x. y z. n. n.")) > 0.5 > s.score(s.sentences("y. n."))


def test_odd_rows(spark):
    m = t.Model({"alpha": 9.0, "^word": 0.0}, -5.0, 0.01)
    out = t.score_documents(odd(spark), m).collect()
    assert len(out) == 11 and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[2].score == by[3].score == by[4].score and abs(by[2].score - 0.01) < 1e-9 and by[2].n_sentences == 0
    assert by[1].score > 0.9 and len(by[1].offending) == 1 and by[1].offending[0].begin == 0
    assert t.score_documents(empty(spark), m).count() == 0
    for rows in ([], [(1, 1, 1), (6, 1, 1)], [(1, 1, None), (None, 0, 1)]):
        none = t.train(odd(spark), labels(spark, rows))
        assert not none.weights and 0 < none.leak < 1
