"""Soft-membership mixing: rates of documents, so that expected tokens of domains match targets.

Everything is DataFrame and SQL functions. A naive Bayes classifier is counted from labelled rows over binned features
of the text, one of them the summed log odds of all words and word beginnings that tell toxic documents from others.
It gives every document posteriors over the domains. Documents of equal bins have equal posteriors, so sums over
documents are kept by cell of bins, exactly; the number of cells follows the bins and not the data. Spark sums the
cells over all documents; the rates of the cells are the nonnegative least-squares solution for the wanted tokens of
each domain, by accelerated projected gradient until the conditions of an optimum hold.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.llm.common import Stored, read_table

#: A domain is a pair of labels; share of all tokens wanted from each.
DOMAINS = ("low", "high", "low_toxic", "high_toxic")
TARGETS = {"low": 0.08, "high": 0.90, "low_toxic": 0.01, "high_toxic": 0.01}
#: Bounds of the bins: symbols and capitals as shares of characters, characters, and log odds of the words.
BINS = {"symbols": [0.0, 0.004, 0.02, 0.08], "capitals": [0.01, 0.04, 0.1, 0.3], "size": [200, 800, 2000, 5000, 20000], "told": [0.5, 2.0, 4.0, 8.0]}
CELL = tuple(BINS)
#: Labelled documents of either kind in which telling words are looked for, words kept at most, how far from chance
#: they must be, documents they must occur in, and letters of a word beginning.
TELLING_DOCS, TELLING, Z, LEAST_DOCS, STEM = 6000, 1000, 3.5, 3, 5
#: Steps of the projected gradient at most, and the slope at which it stops, as a share of all wanted tokens.
STEPS, SLOPE = 200_000, 1e-10


def domain_of() -> Column:
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (1 + F.col("quality") + 2 * F.col("toxic")).cast("int"))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): rows with null or other labels take no part; of repeated ids the largest labels count."""
    rows = labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)")
    return rows.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).select("doc_id", domain_of().alias("domain"))


def word_hashes(text: Column) -> Column:
    """Hashes of the different words of letters of a text, in lower case, and of the beginnings of longer ones."""
    words = F.array_distinct(F.split(F.lower(text), "[^\\p{L}]+"))
    starts = F.filter(words, lambda w: F.length(w) > STEM)
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.array_distinct(F.transform(starts, lambda w: F.xxhash64(F.substring(w, 1, STEM), F.lit("^")))))


def telling_words(docs: DataFrame, labels: DataFrame, limit: int = TELLING_DOCS) -> dict[int, float]:
    """Hash to log odds of the words most typical of toxic documents, from at most ``limit`` labelled ids of either kind.

    A word counts if its log odds lie ``Z`` standard errors above none, with as many words as there are up to
    ``TELLING``; so rarer languages have theirs too.
    """
    rows = labelled(labels).withColumn("y", F.col("domain").endswith("toxic").cast("int"))
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", "y") for y in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * limit rows at most
    words = docs.join(sample, "doc_id").select("y", F.explode(F.concat(F.array(F.lit(0)), word_hashes(F.col("text")))).alias("w"))
    counts = Stored(words.groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") >= LEAST_DOCS))
    total = counts.df.where("w = 0").first()
    if total is None or not total.b:
        counts.drop()
        return {}
    odds = F.log((F.col("a") + 0.5) / (total.a + 1.0)) - F.log((F.col("b") + 0.5) / (total.b + 1.0))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    rows = counts.df.where("w <> 0").select("w", odds.alias("odds"), z.alias("z")).where(F.col("z") > Z).orderBy(F.desc("z"), "w").limit(TELLING).collect()
    counts.drop()
    return {r.w: r.odds for r in rows}


def feature_struct(telling: dict[int, float], text: Column) -> Column:
    """n_tokens and the bins of a text; a null one counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    told = F.lit(0.0)
    if telling:
        odds = F.create_map(*(F.lit(x) for pair in sorted(telling.items()) for x in pair))
        # Few of a text's words are telling, so the map is asked for these alone.
        found = F.array_intersect(word_hashes(text), F.array(*map(F.lit, sorted(telling))))
        told = F.aggregate(found, F.lit(0.0), lambda a, w: a + F.element_at(odds, w))
    bin_ = lambda x, bounds: sum(((x > b).cast("int") for b in bounds), F.lit(0))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))
    # Bound to names by transform, so that each pattern is counted once.
    raw = F.array(F.struct(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("t"), share("[#*$%&|<>!]").alias("symbols"), share("\\p{Lu}").alias("capitals"), F.length(text).alias("size"), told.alias("told")))
    return F.element_at(F.transform(raw, lambda r: F.struct(r["t"].alias("n_tokens"), *(bin_(r[c], BINS[c]).alias(c) for c in CELL))), 1)


def features(docs: DataFrame, telling: dict[int, float]) -> DataFrame:
    """(doc_id, n_tokens, symbols, capitals, size, told) for every row; a null text counts as empty.

    Tokens are words between ASCII white space; the other columns are numbers of bins.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), feature_struct(telling, F.col("text")).alias("f")).select("doc_id", "f.*")


def classifier(seen: DataFrame) -> Column:
    """An array with the probability of each domain, from the counts of (domain, cell): naive Bayes with add-one counts.

    Without labelled rows all domains are equally likely.
    """
    rows = [(r.domain, r, r["count"]) for r in seen.groupBy("domain", *CELL).count().collect()]  # bounded by bins
    total = sum(n for _, _, n in rows)
    logs = []
    for d in DOMAINS:
        here = [(r, n) for x, r, n in rows if x == d]
        size = sum(n for _, n in here)
        out = F.lit(math.log((size + 1) / (total + len(DOMAINS))))
        for f in CELL:
            k = len(BINS[f]) + 1
            table = [math.log((sum(n for r, n in here if r[f] == b) + 1) / (size + k)) for b in range(k)]
            out = out + F.element_at(F.array(*map(F.lit, table)), (F.col(f) + 1).cast("int"))
        logs.append(out)
    # Bound to a name once, or else the code for one row would hold every table many times.
    soft = lambda ls: F.transform(ls, lambda x: F.exp(x - F.array_max(ls)))
    shares = lambda odds: F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, y: a + y))
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    return bound(bound(F.array(*logs), soft), shares)


def fit_rates(tokens: np.ndarray, posterior: np.ndarray, want: np.ndarray, max_rate: float | None) -> np.ndarray:
    """Rates r >= 0 (and <= ``max_rate``) of cells that bring sum(r * tokens * posterior) closest to ``want``.

    Projected gradient with momentum, started at 1, in the metric of the cells' tokens; momentum starts anew when it
    points uphill. It stops where the slope is none for rates inside their bounds, and points outwards at a bound.
    """
    top = np.inf if max_rate is None else float(max_rate)
    rate = np.clip(np.ones(len(tokens)), 0, top)
    scale = float(np.abs(want).sum()) or 1.0
    a, b = posterior * (tokens / scale)[:, None], want / scale
    step = 1 / max(float(np.linalg.eigvalsh(posterior.T @ a)[-1]), 1e-300)
    ahead, t = rate, 1.0
    for _ in range(STEPS):
        slope = posterior @ (ahead @ a - b)
        new = np.clip(ahead - step * slope, 0, top)
        own = posterior @ (new @ a - b)
        stuck = ((new <= 0) & (own > 0)) | ((new >= top) & (own < 0))
        if not len(own) or np.abs(np.where(stuck, 0, own)).max() < SLOPE:
            return new
        if ((ahead - new) * tokens) @ (new - rate) > 0:
            t, ahead, rate = 1.0, new, new
            continue
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, rate, t = new + (t - 1) / after * (new - rate), new, after
    return rate


def fitted(feats: DataFrame, labels: DataFrame, targets: dict[str, float] | None, kept: dict[str, float] | None, max_rate: float | None) -> DataFrame:
    """One row for each cell: its bins, the probabilities ``p`` of the domains, and its rate.

    Wanted tokens are ``targets`` as shares of all tokens, or ``kept`` as shares of what each domain has. The cells,
    bounded by the bins, are summed by Spark over all documents; only these sums reach the driver.
    """
    targets = TARGETS if targets is None and kept is None else targets
    of = classifier(feats.join(labelled(labels), "doc_id").select("domain", *CELL))
    cells = feats.groupBy(*CELL).agg(F.sum("n_tokens").cast("double").alias("n")).withColumn("p", of).collect()
    n, p = np.array([r.n for r in cells]), np.array([r.p for r in cells]).reshape(-1, len(DOMAINS))
    have = n @ p
    rates = np.ones(len(n))
    if have.sum():
        want = np.array([targets[d] for d in DOMAINS]) * have.sum() / sum(targets.values()) if targets else have * np.array([kept[d] for d in DOMAINS])
        rates = fit_rates(n, p, want, max_rate)
    rows = [(*(int(r[c]) for c in CELL), [float(x) for x in r.p], float(x)) for r, x in zip(cells, rates, strict=True)]
    return feats.sparkSession.createDataFrame(rows, ", ".join(f"{c} int" for c in CELL) + ", p array<double>, rate double")


def copies(rate: Column, coin: Column) -> Column:
    """How often a row comes: the whole part of its rate, and once more in the share of cases of the rest."""
    u = F.shiftrightunsigned(coin, 11) / F.lit(float(1 << 53))
    return F.floor(rate + u).cast("int")


def coin_of(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), text.cast("string"), F.lit("mix"))


def prepared(docs: DataFrame, labels: DataFrame) -> tuple[Stored, DataFrame]:
    """``docs`` in one column ``doc`` with a coin and features, stored, so that every text is looked at once; and the features."""
    words = telling_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    packed = docs.select(F.struct(*docs.columns).alias("doc"), coin_of(F.col("doc_id"), F.col("text")).alias("coin"), feature_struct(words, F.col("text")).alias("f"))
    rows = Stored(packed)
    return rows, rows.df.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "f.*")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, kept: dict[str, float] | None = None, max_rate: float | None = None) -> DataFrame:
    """(doc_id, n_tokens, p_<domain> ..., rate, copies) for every row of ``docs``.

    ``rate`` is how often a document is wanted on average, ``copies`` its whole part plus one more in the share of
    cases of the rest, by a hash of id and text, so a run can be repeated. Targets that can't be met are met as well as
    squares allow. Null and empty texts have no tokens and the rate of their cell; rows with a null id count too, and
    repeated rows are each a row. An empty table gives an empty result; other columns are not read.
    """
    words = telling_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    rows = Stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), coin_of(F.col("doc_id"), F.col("text")).alias("coin"), feature_struct(words, F.col("text")).alias("f")).select("doc_id", "coin", "f.*"))
    rated = fitted(rows.df.drop("coin"), labels, targets, kept, max_rate)
    out = rows.df.join(F.broadcast(rated), list(CELL))  # one row for each cell, bounded by the bins
    return out.select("doc_id", "n_tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", copies(F.col("rate"), F.col("coin")).alias("copies"))


def mixed_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, kept: dict[str, float] | None = None, max_rate: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` says, with their columns; no text is shuffled."""
    rows, feats = prepared(docs, labels)
    rated = fitted(feats, labels, targets, kept, max_rate)
    cells = rated.select(F.struct(*CELL).alias("cell"), "rate")
    joined = rows.df.withColumn("cell", F.struct(*(F.col(f"f.{c}").alias(c) for c in CELL))).join(F.broadcast(cells), "cell")
    n = copies(F.col("rate"), F.col("coin"))
    joined = joined.where(n > 0)
    if max_rate is None or max_rate > 1:
        joined = joined.withColumn("place", F.explode(F.sequence(F.lit(1), n)))
    return joined.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the default targets."""
    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
