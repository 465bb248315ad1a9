"""Spelling variants grouped by a symmetric-delete join.

Every word emits itself and its distinct single deletions as keys. Words at distance one share a key: a replaced code point
is deleted on both sides, an inserted one is deleted on one. So an equi-join on keys finds all near pairs, and an exact
edit distance removes the others. A word's form is its commonest near word, if that is twice as common; forms are
followed to their roots by doubling pointers, in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.llm.common import Stored, read_table

#: Maximal runs of these make words; only A-Z is lower-cased.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of up to so many code points are strings; longer ones are rolling hashes, found in one pass over the word.
KEY_POINTS = 64
MOD, BASE = 2**61 - 1, 1_000_003


def occurrences(docs: DataFrame, noise: int = 97) -> DataFrame:
    """(word): one row for each run of each text, lower-cased, one code point dropped where the contract says so.

    Null texts have no runs; a null doc_id stands as an empty string in the hash. Repeated rows count again.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("r"))
    runs = runs.select("d", F.translate("r", UPPER, LOWER).alias("r"))
    runs = runs.select("r", F.crc32(F.concat_ws(":", "d", "r").cast("binary")).alias("h"), F.length("r").alias("len"))
    cut = F.concat(F.expr("substring(r, 1, cast(h % len as int))"), F.expr("substring(r, cast(h % len as int) + 2)"))
    return runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("r")).alias("word"))


def vocabulary(docs: DataFrame, least_points: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n): words of at least so many code points and occurrences."""
    words = occurrences(docs).where(F.length("word") >= least_points)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def rolling_keys(word: str, least: int) -> set[int]:
    """Hashes of the word and its single deletions, those of over ``least`` code points, in time linear in the word."""
    n, ends, total = len(word), [0] * (len(word) + 1), 0
    for i in range(n - 1, -1, -1):  # ends[i]: hash of word[i:] whose first code point has the highest power
        total = (ord(word[i]) * pow_of(n - 1 - i) + total) % MOD
        ends[i] = total
    out = {ends[0]} if n > least else set()
    if n - 1 > least:
        head = 0  # hash of word[:i]
        for i in range(n):
            if i + 1 == n or word[i] != word[i + 1]:
                out.add((head * pow_of(n - 1 - i) + ends[i + 1]) % MOD)
            head = (head * BASE + ord(word[i])) % MOD
    return out


POWERS = [1]


def pow_of(k: int) -> int:
    while len(POWERS) <= k:
        POWERS.append(POWERS[-1] * BASE % MOD)
    return POWERS[k]


def long_keys(words: DataFrame, least: int) -> DataFrame:
    """(key, id) of the keys of over ``least`` code points; keys start with a digit sign, as no word does."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            for id_, word in zip(t["id"], t.word, strict=True):
                keys = list(rolling_keys(word, least))
                for a in range(0, len(keys), 10_000):
                    some = keys[a : a + 10_000]
                    yield pd.DataFrame({"key": [f"#{k}" for k in some], "id": id_})

    return words.select("id", "word").mapInPandas(run, "key string, id string")


def keys(words: DataFrame, key_points: int) -> DataFrame:
    """(key, id): every word of (id, word) and its distinct single deletions."""
    size = F.length("word")
    cut = "transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1)))"
    own = words.where(size <= key_points).select(F.col("word").alias("key"), "id")
    less = words.where(size <= key_points + 1).select(F.explode(F.array_distinct(F.expr(cut))).alias("key"), "id")
    return own.union(less).union(long_keys(words.where(size > key_points), key_points))


def one_apart(a: str, b: str) -> bool:
    """Whether one code point is inserted, deleted or replaced; in time linear in the words, unlike an edit distance."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # the length of what both begin with
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a != b and (a[low + 1 :] == b[low + 1 :] or a[low + 1 :] == b[low:] or a[low:] == b[low + 1 :])


def long_near(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of long words that are one apart."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            yield t[[one_apart(a, b) for a, b in zip(t.a, t.b, strict=True)]]

    return pairs.select("a", "b").mapInPandas(run, "a string, b string")


def near_pairs(words: DataFrame, key_points: int = KEY_POINTS) -> DataFrame:
    """(a, b): all ordered pairs of different words of (word, n) at exactly one inserted, deleted or replaced code point.

    Words move by a short id (the word itself, or its SHA-256 after a digit sign), so a long word is not repeated for
    each of its keys. A key is shared by the words that one more letter makes of it, at most its length times the letters.
    """
    named = words.withColumn("id", F.when(F.length("word") <= key_points, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2("word", 256))))
    k = keys(named, key_points)
    pairs = k.select("key", F.col("id").alias("x")).join(k.select("key", F.col("id").alias("y")), "key").where("x < y").select("x", "y").distinct()
    a, b = (named.select(F.col("id").alias(x), F.col("word").alias(w)) for x, w in (("x", "a"), ("y", "b")))
    met = pairs.join(a, "x").join(b, "y")
    long = F.greatest(F.length("a"), F.length("b")) > key_points
    near = met.where(~long).where(F.expr("levenshtein(a, b, 1) = 1")).select("a", "b").union(long_near(met.where(long)))
    return near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")


def forms(words: DataFrame, near: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n) for every word."""
    other = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = near.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("b"))).alias("best"))
    out = words.join(best, "word", "left")
    good = -F.col("best.less") >= times * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.b")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"))


def with_roots(table: DataFrame) -> DataFrame:
    """``table`` (word, form, ...) with the last of each word's chain of forms; a form is commoner than its word, so chains end.

    Each round doubles the steps that a pointer takes, until no pointer moves."""
    at = Stored(table.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        ahead = at.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = Stored(at.df.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        at.drop()
        at = step
        if at.df.where("moved").isEmpty():
            return table.join(at.df.select("word", "root"), "word")


def group_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs`` (doc_id, text); other columns take no part.

    Empty texts and tables give no words. Of near words of equal counts the smallest in code-point order is the form.
    """
    words = Stored(vocabulary(docs))
    table = Stored(forms(words.df, near_pairs(words.df)))
    return with_roots(table.df).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the spelling variants of all words of all documents."""
    return group_variants(read_table(spark, sf_dir, "documents"))


#: Two words are near if one without one code point is the other, or if both without their i-th are the same.
OP13_SQL = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), runs AS MATERIALIZED (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY 1, 2
), bytes AS (
  SELECT d, r, n, list_transform(range(octet_length(encode(d || ':' || r))), lambda i: CAST('0x' || substr(hex(encode(d || ':' || r)), 2 * i + 1, 2) AS BIGINT)) AS b FROM runs
), hashed AS (
  SELECT r, n, length(r) AS len, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % len) || substr(r, h % len + 2) ELSE r END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.key = y.key AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word FROM cut x JOIN words y ON x.key = y.word
  UNION SELECT y.word, x.word FROM cut x JOIN words y ON x.key = y.word
), best AS (
  SELECT a, CAST(count(*) AS BIGINT) AS n_near, min(struct_pack(less := -n, word := b)) AS best FROM near JOIN words ON word = b GROUP BY a
), form AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * n THEN best.word END AS form, CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n
  FROM words LEFT JOIN best ON a = words.word
), chain AS (
  SELECT word, word AS root FROM form
  UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.root WHERE form.form IS NOT NULL
)
SELECT form.word, form.form, root, n, n_near, form_n FROM chain JOIN form ON form.word = chain.word
WHERE NOT EXISTS (SELECT 1 FROM form f WHERE f.word = root AND f.form IS NOT NULL)
"""
