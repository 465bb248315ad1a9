"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

The lines of a text are a sequence; each has a few yes-or-no features, and Viterbi decoding gives the most likely
sequence of labels under the trained weights. A document stays if enough of its words stand in content lines and the
plain counts don't speak against it. The weights are trained by maximum likelihood on a bounded sample of documents
with a quality label. Its lines get weak labels: that of their document, but for lines of good documents that repeat an
earlier one or consist of symbols, and lines of bad documents that are plain prose. Half of the good documents also
get lines of a bad one spliced in, so that the field learns how labels follow each other within a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.llm.common import read_table, small_batches, training_rows

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FEATURES = ("bias", "short", "long", "symbol", "symbols_tenth", "symbols_half", "upper", "exclaims", "pipes", "repeated_line", "words_repeat", "words_repeat_much", "full_stop")
#: Training documents of either class, lines in one training sequence, and sequences in all.
MAX_DOCS, MAX_LINES, MAX_SEQUENCES = 1000, 32, 2000
MIN_SHARE = 0.5


@dataclass(frozen=True)
class Model:
    """emission[k]: what feature k adds to content over boilerplate; transition[a][b]: from label a to b."""

    emission: tuple[float, ...]
    transition: tuple[tuple[float, float], tuple[float, float]]
    cache: dict = field(default_factory=dict, compare=False, hash=False, repr=False)


#: Used where the labels hold only one class, so that nothing can be learnt.
PLAIN = Model((2.0, 0.0, 0.0, -1.0, -1.5, -2.0, -3.0, -1.5, -3.0, -1.0, -3.0, -3.0, 0.5), ((0.5, 0.0), (0.0, 0.5)))


def lines_of(text: str) -> tuple[list[tuple[bool, ...]], list[int], int]:
    """Features and word count of each line that holds a word, and how many of these lines equal an earlier one."""
    feats, counts, seen, again = [], [], set(), 0
    for line in text.split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        n = len(words)
        if not n:
            continue
        repeated = line in seen
        again += repeated
        seen.add(line)
        symbols = sum(map(line.count, SYMBOLS)) / n
        varied = len(set(words)) / n
        feats.append((
            True, n <= 2, n >= 8, symbols > 0, symbols >= 0.1, symbols >= 0.5, line.isupper() and n > 2, line.count("!") >= 0.3 * n,
            line.count("|") >= 0.3 * n, repeated, n >= 5 and varied < 0.5, n >= 10 and varied < 0.2, line.rstrip()[-1:] in (".", "!", "?"),
        ))
        counts.append(n)
    return feats, counts, again


def viterbi(model: Model, feats: list[tuple[bool, ...]]) -> list[int]:
    """The most likely labels, 1 for content; boilerplate on exact ties."""
    (t00, t01), (t10, t11) = model.transition
    cache, emission = model.cache, model.emission
    back, s0, s1 = [], 0.0, 0.0
    for k, f in enumerate(feats):
        e = cache.get(f)
        if e is None:
            e = cache[f] = sum(w for w, on in zip(emission, f, strict=True) if on)
        if not k:
            s1 = e
            continue
        a, b, c, d = s0 + t00, s1 + t10, s0 + t01, s1 + t11
        back.append((b > a, d > c))
        s0, s1 = (b if b > a else a), (d if d > c else c) + e
    if not feats:
        return []
    out = [int(s1 > s0)]
    for to0, to1 in reversed(back):
        out.append(int(to1 if out[-1] else to0))
    return out[::-1]


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """How many words stand in windows of ``n`` words that occur twice or more, the first occurrence included."""
    total = len(words)
    if total <= n:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, total)
    if len(number) == total:
        return 0
    size = total - n + 1
    key = np.zeros(size, np.uint64)
    for k in range(n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + size].astype(np.uint64)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    rows = np.stack([ids[at + k] for k in range(n)], axis=1)
    _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[count[inverse.reshape(-1)] > 1]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:total] > 0).sum())


def assess(text: str | None, model: Model, min_share: float = MIN_SHARE) -> dict:
    """All counts and the verdict on one text; a null text is one without words, which the base counts reject."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    feats, counts, again = lines_of(text)
    labels = viterbi(model, feats)
    n = len(words)
    repeats = repeated_words(words)
    share = sum(c for c, y in zip(counts, labels, strict=True) if y) / n if n else 0.0
    failed = n < 10 or 100 * repeats > 20 * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": again,
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": not failed and share >= min_share,
        "content_share": share,
        "content_lines": labels,
    }


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, content_lines array<tinyint>"


def line_labels(m: np.ndarray, y: int) -> np.ndarray:
    """Weak labels of the lines (rows of features) of a document of quality ``y``, 1 for content."""
    on = lambda name: m[:, FEATURES.index(name)] > 0
    odd = on("symbols_half") | on("pipes") | on("repeated_line")
    if y:
        return (~odd).astype(np.int64)
    bad = odd | on("symbols_tenth") | on("upper") | on("exclaims") | on("words_repeat") | on("words_repeat_much")
    return (on("long") & on("full_stop") & ~bad).astype(np.int64)


def spliced(documents: list[tuple[np.ndarray, int]], seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of the lines of training sequences: the documents with weak labels, and in every second good
    one a run of lines of a bad one, which keep their labels."""
    rng = np.random.default_rng(seed)
    bad = [(m, line_labels(m, y)) for m, y in documents if not y]
    out = list(bad)
    for k, (m, y) in enumerate((m, y) for m, y in documents if y):
        labels = line_labels(m, y)
        if k % 2 and bad:
            x, other = bad[rng.integers(len(bad))]
            n = int(rng.integers(1, min(len(x), 6) + 1))
            lo, at = int(rng.integers(len(x) - n + 1)), int(rng.integers(len(m) + 1))
            m = np.concatenate([m[:at], x[lo : lo + n], m[at:]])
            labels = np.concatenate([labels[:at], other[lo : lo + n], labels[at:]])
        out.append((m, labels))
    return out


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Model:
    """Maximum-likelihood weights by forward-backward and Adam; ``PLAIN`` if there is only one label.

    sequences: the features of consecutive lines as a 0/1 matrix, and their labels. Either label gets half of the
    weight of the emissions.
    """
    every = np.concatenate([y for _, y in sequences]) if sequences else np.zeros(0)
    if not len(every) or every.min() == every.max():
        return PLAIN
    longest, k = max(len(x) for x, _ in sequences), len(FEATURES)
    x, y = np.zeros((len(sequences), longest, k)), np.zeros((len(sequences), longest), np.int64)
    for i, (m, labels) in enumerate(sequences):
        x[i, : len(m)], y[i, : len(m)] = m, labels
    size = np.array([len(m) for m, _ in sequences])
    on = np.arange(longest)[None, :] < size[:, None]
    # A sequence weighs as its lines do, where lines of the rarer label weigh more.
    of = np.array([0.5 / (every == 0).sum(), 0.5 / (every == 1).sum()])
    weight = np.where(on, of[y], 0).sum(axis=1) / size
    theta, mean, square = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    rows = np.arange(len(size))
    for step in range(1, rounds + 1):
        e, t = x @ theta[:k], theta[k:].reshape(2, 2)
        emit = np.stack([np.zeros_like(e), e], axis=2)
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for j in range(1, longest):
            a = np.logaddexp(alpha[:, j - 1, 0, None] + t[0], alpha[:, j - 1, 1, None] + t[1]) + emit[:, j]
            alpha[:, j] = np.where(on[:, j, None], a, alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            nxt = beta[:, j + 1] + emit[:, j + 1]
            b = np.logaddexp(t[:, 0] + nxt[:, 0, None], t[:, 1] + nxt[:, 1, None])
            beta[:, j] = np.where(on[:, j + 1, None], b, 0.0)
        last = alpha[rows, size - 1]
        z = np.logaddexp(last[:, 0], last[:, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * on
        grad = np.einsum("ij,ijk->k", (y * on - p1) * weight[:, None], x)
        pair = alpha[:, :-1, :, None] + t + (beta + emit)[:, 1:, None, :] - z[:, None, None, None]
        pair = np.exp(pair) * on[:, 1:, None, None] * weight[:, None, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1], y[:, 1:]), on[:, 1:] * weight[:, None])
        g = np.concatenate([grad, (seen - pair.sum(axis=(0, 1))).reshape(-1)]) - decay * theta
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    t = theta[k:].reshape(2, 2)
    return Model(tuple(map(float, theta[:k])), ((float(t[0, 0]), float(t[0, 1])), (float(t[1, 0]), float(t[1, 1]))))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fit the field on at most ``max_docs`` labelled documents of either quality.

    Only the features of sampled lines reach the driver, at most ``MAX_SEQUENCES`` sequences of ``MAX_LINES`` lines,
    drawn by a hash of document and place. Null ids, labels and texts take no part.
    """
    small_batches(docs.sparkSession)
    sample = training_rows(labels, F.col("quality").isin(0, 1), {0: max_docs, 1: max_docs}, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs, ys, ids, places = [], [], [], []
            for text, y, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = np.array(lines_of(text)[0], dtype=np.uint8).reshape(-1, len(FEATURES))
                for at in range(0, len(m), MAX_LINES):
                    blobs.append(m[at : at + MAX_LINES].tobytes())
                    ys.append(y)
                    ids.append(i)
                    places.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(ys, pa.int32()), pa.array(ids, pa.int64()), pa.array(places, pa.int64())], ["m", "y", "doc_id", "place"])

    ids = F.broadcast(sample)  # 2 * max_docs rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(ids, "doc_id").select("text", "y", "doc_id")
    rows = rows.mapInArrow(run, "m binary, y int, doc_id long, place long").orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place", "m").limit(MAX_SEQUENCES).collect()
    return fit(spliced([(np.frombuffer(r.m, np.uint8).reshape(-1, len(FEATURES)), r.y) for r in rows if r.m]))


def assess_documents(docs: DataFrame, model: Model, min_share: float = MIN_SHARE) -> DataFrame:
    """The counts, the label of every line with a word, and the verdict for every row of ``docs``.

    Null and empty texts have no words: all counts are 0 and the base counts reject them. Repeated ids give repeated
    rows; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [assess(t, model, min_share) for t in b.column(1).to_pylist()]
            names = list(done[0]) if done else []
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.list_(pa.int8())]
            cols = [pa.array([d[n] for d in done], k) for n, k in zip(names, kinds, strict=False)]
            if done:
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_documents(docs: DataFrame, model: Model, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``docs`` that the field keeps, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([assess(t, model, min_share)["kept"] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict for every document."""
    docs = read_table(spark, sf_dir, "documents")
    out = assess_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
