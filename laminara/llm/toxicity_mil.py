"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is a bag of sentences. Each sentence gets a probability from a logistic model over its words and their
first letters, and the document is toxic if at least one sentence is: 1 - (1 - leak) * prod(1 - p). The weights are
trained on document labels only, by the gradient of this noisy-or, which passes most of a document's error to its
worst sentences. The same weights then point out the offending sentences.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laminara.llm.common import Stored, read_table, small_batches, training_rows

SENTENCE = re.compile(r"[^.!?\n]+")
EDGES = ".,;:!?\"'()[]{}|#*$%&<>"
#: Lengths of word beginnings that are features, marked by a leading "^".
STEMS = (4, 5, 6)
#: Training documents of label 1 and 0, features that are kept, and documents that a feature must occur in.
MAX_TOXIC, MAX_CLEAN, MAX_FEATURES, MIN_DOCS = 4000, 8000, 2000, 8
#: Sentences of one training document that hold a feature and take part; of more, those of smallest hash.
MAX_SENTENCES = 200
#: Words whose weight a worker remembers.
MEMORY = 300_000


@dataclass(frozen=True)
class Model:
    """weights: feature to weight; bias: of a sentence; leak: probability without any sentence."""

    weights: dict[str, float]
    bias: float
    leak: float


def features(word: str) -> list[str]:
    """A lower-case word and its beginnings."""
    return [word, *("^" + word[:k] for k in STEMS if len(word) > k)]


class Scorer:
    """Scores sentences and documents under one model."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.empty = 1 / (1 + math.exp(-model.bias))

    def weight(self, raw: str) -> float:
        w = self.known.get(raw)
        if w is None:
            word, get = raw.lower().strip(EDGES), self.model.weights.get
            w = sum(get(f, 0.0) for f in features(word)) if word else 0.0
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[raw] = w
        return w

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Begin, end and probability of each sentence that holds a word; of equal words in a sentence one counts."""
        out, weight = [], self.weight
        for m in SENTENCE.finditer(text):
            words = set(m[0].split())
            if words:
                z = sum(map(weight, words))
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-max(-50.0, min(50.0, z + self.model.bias)))) if z else self.empty))
        return out

    def score(self, found: list[tuple[int, int, float]]) -> float:
        rest = math.log1p(-self.model.leak) + sum(math.log1p(-min(p, 1 - 1e-12)) for _, _, p in found)
        return -math.expm1(rest)


def bags(text: str) -> list[list[str]]:
    """The features of each sentence with a word."""
    out = []
    for m in SENTENCE.finditer(text):
        words = {w.lower().strip(EDGES) for w in m[0].split()} - {""}
        if words:
            out.append([f for w in words for f in features(w)])
    return out


def choose(counts: list[tuple[str, int, int]], n1: int, n0: int) -> list[str]:
    """The features whose document counts tell the labels apart best, by the z-value of the log odds."""
    def z(a: int, b: int) -> float:
        p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        return (math.log(p) - math.log(q)) / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

    ranked = sorted(((-abs(z(a, b)), f) for f, a, b in counts if abs(z(a, b)) > 3))
    return [f for _, f in ranked[:MAX_FEATURES]]


def fit(docs: list[tuple[int, int, list[list[int]]]], names: list[str], rounds: int = 300, rate: float = 0.1, decay: float = 3e-5) -> Model:
    """Train by Adam on the mean log likelihood of the noisy-or.

    docs: label, number of sentences without a feature, and the feature numbers of the others. With one label only,
    or no document, the model has no weights and its leak is the share of label 1.
    """
    y = np.array([d[0] for d in docs], float)
    if not len(y) or y.min() == y.max():
        return Model({}, -20.0, float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)))
    owner = np.array([i for i, d in enumerate(docs) for _ in d[2]], int)
    sent = np.array([k for k, s in enumerate(s for d in docs for s in d[2]) for _ in s], int)
    feat = np.array([f for d in docs for s in d[2] for f in s], int)
    plain = np.array([d[1] for d in docs], float)
    n, k = len(owner), len(names)
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    theta, mean, square = np.zeros(k + 2), np.zeros(k + 2), np.zeros(k + 2)
    theta[k], theta[k + 1] = -6.0, -4.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        w, b, leak = theta[:k], theta[k], sigmoid(theta[k + 1])
        p = sigmoid(np.bincount(sent, w[feat], minlength=n) + b)
        pb = sigmoid(b)
        rest = np.log1p(-leak) + plain * np.log1p(-pb) + np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        total = np.clip(-np.expm1(rest), 1e-9, 1 - 1e-9)
        # d log likelihood / d (-rest): y * (1 - total) / total - (1 - y); d (-log(1 - p)) / dz = p
        out = balance * (y * (1 - total) / total - (1 - y))
        dz = out[owner] * p
        g = np.concatenate([np.bincount(feat, dz[sent], minlength=k) - decay * w, [dz.sum() + (out * plain).sum() * pb], [out.sum() * leak]])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    keep = {f: float(x) for f, x in zip(names, theta[:k], strict=True) if abs(x) > 1e-6}
    return Model(keep, float(theta[k]), float(sigmoid(theta[k + 1])))


def train(docs: DataFrame, labels: DataFrame, where: str = "true", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on a bounded, repeatable sample of the labelled rows that satisfy ``where``.

    The words of at most ``max_toxic + max_clean`` documents are counted by Spark; the driver gets at most
    ``MAX_FEATURES`` features and, for each sampled id, at most ``MAX_SENTENCES`` sentences that hold one. Of rows
    that share an id one counts. Null ids, labels and texts take no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = training_rows(labels, F.col("toxic").isin(0, 1) & F.expr(where), {0: max_clean, 1: max_toxic}, "toxic")
    ids = F.broadcast(sample)  # a bounded number of rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(ids, "doc_id")
    # One text stands for each sampled id, however often it comes: that of smallest hash.
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    picked = Stored(rows.withColumn("place", F.row_number().over(order)).where("place = 1").select("text", "y"))
    rows = picked.df

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y].update({f for s in bags(text) for f in s} | {""})
            both = sorted(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([seen[1][f] for f in both], pa.int64()), pa.array([seen[0][f] for f in both], pa.int64())], ["f", "a", "b"])

    counts = rows.mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n1, n0 = next(((r.a, r.b) for r in counts.where("f = ''").collect()), (0, 0))
    # The log odds' z-value is done again exactly in choose(); this keeps what reaches the driver bounded.
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = counts.where((F.col("a") + F.col("b") >= MIN_DOCS) & (F.col("f") != "")).orderBy(F.abs(odds / spread).desc(), "f").limit(MAX_FEATURES).collect()
    names = choose([(r.f, r.a, r.b) for r in top], n1, n0)
    number = {f: i for i, f in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain, full = [], []
            for text in b.column(0).to_pylist():
                got = [[number[f] for f in s if f in number] for s in bags(text)]
                telling = [s for s in got if s]
                plain.append(len(got) - len(telling))
                if len(telling) > MAX_SENTENCES:
                    order = sorted(range(len(telling)), key=lambda i: zlib.crc32(str((i, telling[i])).encode()))
                    telling = [telling[i] for i in sorted(order[:MAX_SENTENCES])]
                full.append(telling)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(plain, pa.int64()), pa.array(full, pa.list_(pa.list_(pa.int32())))], ["y", "plain", "full"])

    # Bounded: one row for each sampled id, with the features of at most MAX_SENTENCES sentences.
    got = rows.mapInArrow(encode, "y int, plain long, full array<array<int>>").collect()
    picked.drop()
    return fit([(r.y, r.plain, r.full) for r in got], names)


SCHEMA = "doc_id long, score double, n_sentences long, offending array<struct<begin:int,end:int,score:double>>"


def score_documents(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """Score and offending sentences (code-point spans of score ``at`` or more) for every row of ``docs``.

    Null, empty and wordless texts get the score of the leak alone and no sentence. Repeated ids give repeated rows;
    columns other than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            scores, n, bad = [], [], []
            for text in b.column(1).to_pylist():
                found = scorer.sentences(text or "")
                scores.append(min(1.0, max(0.0, scorer.score(found))))
                n.append(len(found))
                bad.append([{"begin": x, "end": y, "score": p} for x, y, p in found if p >= at])
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(n, pa.int64()), pa.array(bad, kind)], ["doc_id", "score", "n_sentences", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: toxicity of every document, learnt from labelled rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"), f"not ({HELD_OUT})")
    out = score_documents(docs, model)
    return out.select(
        "doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences", F.size("offending").alias("n_offending"), "offending",
    )
