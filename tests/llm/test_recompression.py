import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from laminara.llm import recompression as r
from tests.llm.helpers import empty, odd, table, words


def brute(rows, window=50):
    """(doc_id, text) to (doc_id, n_words, n_removed, kept)."""
    lowest = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                x = tuple(w[k : k + window])
                lowest[x] = min(i, lowest.get(x, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and lowest[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def test_against_brute_force(spark, sf):
    docs = [(d.doc_id, d.text) for d in table(spark, sf, "documents").collect()]
    got = sorted(map(tuple, r.op8_recompression(spark, sf).collect()))
    assert got == sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(docs))
    assert sum(x[2] for x in got) > 0


@settings(max_examples=40, deadline=None)
@given(hs.integers(0, 10**6), hs.integers(2, 6), hs.sampled_from([1, 3, 8]))
def test_anchors_follow_from_a_window_alone(seed, letters, rounds):
    """Equal windows have equal anchors at equal places, in texts of few words with many runs."""
    rng = np.random.default_rng(seed)
    shared = rng.integers(0, letters, 30)
    texts = [b" ".join(b"%d" % x for x in np.concatenate([rng.integers(0, letters, rng.integers(0, 20)), shared, rng.integers(0, letters, rng.integers(0, 20))])) for _ in range(4)]
    name, _, first = r.words_of(texts)
    s, a, i, n = r.anchors(name, first, window=12, rounds=rounds)
    seen, covered = {}, 0
    for sym, at, start, count in zip(s, a, i, n, strict=True):
        for k in range(start, start + count):
            key = name[k : k + 12].tobytes()
            assert seen.setdefault(key, (sym, at - k)) == (sym, at - k)
            covered += 1
    assert covered == sum(max(0, len(t.split()) - 11) for t in texts)


def test_runs_and_many_copies(spark):
    rows = [(i, " ".join(["a"] * (40 + i))) for i in range(30)] + [(100 + i, " ".join(f"w{k % 7}" for k in range(i, i + 80))) for i in range(20)]
    rows += [(200 + i, " ".join([f"x{i}"] * 3 + [f"p{k}" for k in range(60)] + [f"y{i}"] * 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, r.remove_repeats(df).collect())) == sorted(brute(rows))


def test_odd_rows(spark):
    long = " ".join(f"t{k}" for k in range(3000))
    rows = [(1, long), (2, None), (2, ""), (3, long), (3, long), (3, "short text"), (None, long), (4, " " + long + "\n"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("anchor", "row", "n", "spans", "start")})
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, r.remove_repeats(df).collect()), key=key) == sorted(brute(rows), key=key)
    assert r.remove_repeats(odd(spark)).count() == 11 and r.remove_repeats(empty(spark)).count() == 0


def test_names_of_words():
    name, other, first = r.words_of([b"ab  cd", b"", b"cd ab\n"])
    assert list(first) == [0, 2, 2, 4] and name[0] == name[3] and name[1] == name[2] and name[0] != name[1] and other[0] != name[0]


def test_words_and_ranges_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[b ^ x] for b in bits[:1024]) for x in (0, 1))
    rest = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"{one} {rest[:-1]}"), (2, f"{two} {rest[:-2]}"), (3, " ".join("xy"[b] for b in bits)), (4, " ".join("yx"[b] for b in bits))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, r.remove_repeats(df).collect())) == sorted(brute(rows))


def test_many_repeated_rows(spark):
    text = " ".join(f"t{k % 97}" for k in range(400))
    rows = [(1, text)] * 60 + [(2, "a b " + text)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, r.remove_repeats(df).collect())) == sorted(brute(rows))
