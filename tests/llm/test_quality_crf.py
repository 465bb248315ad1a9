import itertools

import numpy as np
import pytest

from laminara.llm import quality_crf as q
from tests.llm.helpers import empty, labels, odd, table, words


def brute(text):
    text = text or ""
    w = words(text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    marked = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(5)} if len(w) < 3000 else None
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), again, len(marked) if marked is not None else None


def test_counts_and_verdicts(spark, sf):
    out = {r.doc_id: r for r in q.op1_quality(spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(out) == len(docs)
    for d in docs:
        r, (n, chars, symbols, again, rep) = out[d.doc_id], brute(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, again)
        assert rep is None or r.n_repeat_words == rep
        assert r.base_failed == (n < 10 or 100 * r.n_repeat_words > 20 * n)
        assert not (r.base_failed and r.kept)
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    clean = [out[i].kept for i, y in truth.items() if y == 1 and not out[i].base_failed]
    junk = [out[i].kept for i, y in truth.items() if y == 0]
    assert np.mean(clean) > 0.95 and np.mean(junk) < 0.2


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(20):
        m = q.Model(tuple(rng.normal(size=len(q.FEATURES))), tuple(map(tuple, rng.normal(size=(2, 2)))))
        feats = [tuple(bool(x) for x in rng.integers(0, 2, len(q.FEATURES))) for _ in range(6)]

        def score(ys, m=m, feats=feats):
            s = sum(sum(w for w, f in zip(m.emission, x, strict=True) if f) for x, y in zip(feats, ys, strict=True) if y)
            return s + sum(m.transition[a][b] for a, b in itertools.pairwise(ys))

        best = max(itertools.product((0, 1), repeat=6), key=score)
        assert abs(score(q.viterbi(m, feats)) - score(best)) < 1e-9
    assert q.viterbi(q.PLAIN, []) == []


def test_odd_rows(spark):
    out = q.assess_documents(odd(spark), q.PLAIN).collect()
    assert len(out) == 11
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[k][0].n_words == 0 and by[k][0].base_failed and not by[k][0].kept for k in (2, 3, 4))
    assert len(by[6]) == 2 and by[6][0] == by[6][1] and by[6][0].kept
    assert by[5][0].n_words == 40_001 and by[5][0].base_failed
    assert q.assess_documents(empty(spark), q.PLAIN).count() == 0
    kept = q.keep_documents(odd(spark), q.PLAIN)
    assert kept.columns == odd(spark).columns and kept.count() == 4


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(1, None, 0), (None, 1, 0), (6, 0, None)]])
def test_without_two_classes_the_plain_model(spark, rows):
    assert q.train(odd(spark), labels(spark, rows)) == q.PLAIN


def test_repeated_words():
    assert q.repeated_words(b"a b c d e x a b c d e".split()) == 10
    assert q.repeated_words(b"a a a a a a".split()) == 6
    assert q.repeated_words(b"a b c d".split()) == q.repeated_words(b"a b c d e".split()) == q.repeated_words([]) == 0


def test_spliced_pages(spark):
    """A good page with boilerplate in the middle has a share between nothing and everything, and both kinds of lines."""
    sf = "/root/testdata/sf0.1"
    docs, known = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = q.train(docs, known)
    rows = docs.join(known, "doc_id").select("doc_id", "text", "quality").where("n_chars between 1500 and 4000").orderBy("doc_id").collect()
    good = [r.text for r in rows if r.quality == 1 and q.assess(r.text, model)["content_share"] == 1][:40]
    junk = "SALE!!! BUY NOW!!! CLICK | HERE | NOW |\n### *** $$$ %%% &&&\nHome | About | Contact | Login\n" * 2
    pages = []
    for text in good:
        lines = text.split("\n")
        pages.append("\n".join(lines[: len(lines) // 2]) + "\n" + junk + "\n".join(lines[len(lines) // 2 :]))
    found = [q.assess(t, model) for t in pages]
    mixed = [f for f in found if 0 < f["content_share"] < 1]
    right = [np.mean([y == (i >= start and i < start + 6) for i, y in enumerate(1 - np.array(f["content_lines"]))]) for f, start in zip(found, [len([x for x in t.split("\n")[: len(t.split("\n")) // 2] if x.strip()]) for t in good], strict=True)]
    print(f"pages with a share inside (0, 1): {len(mixed)} of {len(pages)}; lines labelled right: {np.mean(right):.3f}")
    assert len(mixed) >= 0.9 * len(pages) and np.mean(right) > 0.9
    shares = [r.content_share for r in q.assess_documents(docs, model).collect()]
    print(f"documents of the table with such a share: {sum(0 < s < 1 for s in shares)} of {len(shares)}")
    assert sum(0 < s < 1 for s in shares) > 0.02 * len(shares)
    assert not q.assess(junk * 3, model)["kept"]
