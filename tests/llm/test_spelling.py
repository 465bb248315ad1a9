import itertools
import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from laminara.llm import spelling as t
from tests.llm.helpers import CLASHING, empty


def brute(rows):
    """All rows of the result from (doc_id, text), with every pair of words compared."""
    n = {}
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w
            n[w] = n.get(w, 0) + 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            close[a].append(b)
            close[b].append(a)
    form = {w: min(c, key=lambda x: (-n[x], x)) if c else None for w, c in close.items()}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_same_rows_as_sql(spark, sf):
    duckdb.execute(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    got = rows_of(t.op13_spelling(spark, sf))
    assert got == sorted(duckdb.execute(t.OP13_SQL).fetchall(), key=str) and len(got) > 1000


def test_brute_force(spark, monkeypatch):
    """Words of few letters, so that runs of equal letters, transpositions, chains and ties abound; keys of either kind."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(150)]
    rows = [(i if i % 9 else None, " ".join(rng.choice(words[: 10 + 2 * (i % 70)]).title() for _ in range(60))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert rows_of(t.group_variants(df)) == want and sum(r[1] is not None for r in want) > 20
    assert any(r[2] != r[1] for r in want if r[1])
    words = df.transform(t.vocabulary).cache()
    for points in (3, 5, 6):
        assert sorted(map(tuple, t.near_pairs(words, points).collect())) == sorted(map(tuple, t.near_pairs(words).collect()))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " 123 !"), (None, "Straße straße STRASSE"), (5, "naïve naive naive naive"), (6, "naïve " * 4), (6, "naive " * 9), (7, "日本語テキスト " * 5), (8, "x×y÷z " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in [*CLASHING, "word", "d", "r", "h", "len"]})
    assert rows_of(t.group_variants(df)) == brute(rows)
    assert rows_of(t.group_variants(empty(spark))) == []


def test_very_long_runs(spark):
    """Runs of 200,000 letters that differ in one of them find each other, in time linear in the run."""
    long = "abcdefghij" * 20_000
    rows = [(i, long if i % 4 else long[:70_000] + "x" + long[70_001:]) for i in range(16)] + [(20 + i, long[:-1]) for i in range(3)]
    got = {r.word: r for r in t.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    top = max(got.values(), key=lambda r: r.n)
    assert top.n >= 8 and top.n_near == 2 and sum(r.form == top.word for r in got.values()) == 2
