"""Repeated passages by recompression.

Words become 128-bit hashes, whose halves are two 64-bit names. Rounds over the first names shorten the sequence of each text: a run of one name gets a new name, and so
does each pair of neighbours whose first name falls into the left half and whose second into the right half of the
names, as a bit of the round's hash deals them out. A new name is a hash of what it stands for, so all partitions give
equal passages equal names without exchanging a dictionary; what is found is verified on names of all its windows, two
for each, made from the two names of every word. For every symbol we keep the range of words on which its
forming depended. A symbol whose range lies within a passage forms wherever the passage occurs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.llm.common import Stored, read_table, release, small_batches

WINDOW, ROUNDS = 50, 8
#: Bytes of text that are worked on at a time; a longer text is worked on alone.
CHUNK = 1 << 21
U = np.uint64
#: Odd constants for mixing; any will do, but they must not change between runs that are compared.
MIX_A, MIX_B, BASE = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
FAR = 1 << 40


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of several texts: their two names, and the number of the first word of each text."""
    import xxhash

    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    parts, first = [], [0]
    for t in texts:
        found = t.split()
        parts.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        first.append(first[-1] + len(found))
    names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), np.uint64).reshape(-1, 2)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return names[ids, 0], names[ids, 1], np.array(first)


def window_names(name: np.ndarray, window: int, start: np.ndarray) -> np.ndarray:
    """A 64-bit name of the ``window`` words from each ``start`` on; windows are short, so a polynomial tells them apart."""
    total = np.concatenate([[U(0)], np.cumsum(mix(name ^ BASE) * powers(BASE, len(name)), dtype=np.uint64)])
    return mix((total[start + window] - total[start]) * powers(BASE_INVERSE, len(name) + 1)[start])


def range_names(name: np.ndarray, window: int, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit name of all windows in order of each range of ``count`` windows from ``start`` on."""
    head = np.cumsum(count) - count
    place = np.arange(count.sum()) - np.repeat(head, count)
    each = window_names(name, window, np.repeat(start, count) + place)
    return mix(np.add.reduceat(mix(each ^ mix(place.astype(np.uint64))), head) + count.astype(np.uint64))


def anchors(name: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
    """Ranges of windows with one anchor: (anchor name, its first word, first window, number of windows).

    The anchor of a window is the leftmost symbol of the highest round whose forming depends on words of the window
    only, so windows of equal words have equal anchors at equal places.
    """
    n = len(name)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    sym, at, end = name, np.arange(n), np.arange(1, n + 1)
    left, right, own = at.copy(), end.copy(), doc
    levels = [(sym, at, left, right)]
    for r in range(rounds):
        if len(sym) < 2:
            break
        same = own[1:] == own[:-1]
        if r % 2 == 0:  # runs
            equal = (sym[1:] == sym[:-1]) & same
            head = np.concatenate([[True], ~equal])
            start = np.flatnonzero(head)
            stop = np.concatenate([start[1:], [len(sym)]])
            length = (stop - start).astype(np.uint64)
            s = sym[start]
            b, e, o = at[start], end[stop - 1], own[start]
            # What stands beside a run isn't another of its symbols; mostly the word there tells, else its symbol does.
            beside_l, beside_r = np.maximum(b - 1, 0), np.minimum(e, n - 1)
            l, rr = left[start], right[stop - 1]
            inner_l, inner_r = b > first[o], e < first[o + 1]
            tells_l, tells_r = name[beside_l] != name[e - 1], name[beside_r] != name[b]
            prev, nxt = np.maximum(start - 1, 0), np.minimum(stop, len(sym) - 1)
            l = np.where(inner_l, np.minimum(l, np.where(tells_l, b - 1, left[prev])), -FAR)
            rr = np.where(inner_r, np.maximum(rr, np.where(tells_r, e + 1, right[nxt])), FAR)
            sym = np.where(length > 1, mix(s ^ mix(length + U(2 * r + 1))), s)
            at, end, own, left, right = b, e, o, l, rr
            same = own[1:] == own[:-1]
        side = (mix(sym + U(1000 + r)) & U(1)).astype(bool)  # False: left half
        pair = ~side[:-1] & side[1:] & same
        is_head, is_tail = np.concatenate([pair, [False]]), np.concatenate([[False], pair])
        next_right = np.concatenate([np.where(same, right[1:], FAR), [FAR]])
        prev_left = np.concatenate([[-FAR], np.where(same, left[:-1], -FAR)])
        alone = ~is_head & ~is_tail
        left = np.where(alone & side, np.minimum(left, prev_left), left)
        right = np.where(alone & ~side, np.maximum(right, next_right), right)
        k = np.flatnonzero(is_head)
        sym, end, right = sym.copy(), end.copy(), right.copy()
        sym[k] = mix(mix(sym[k] + U(3 + 2 * r)) * BASE + sym[k + 1])
        end[k], right[k] = end[k + 1], right[k + 1]
        keep = ~is_tail
        sym, at, end, left, right, own = sym[keep], at[keep], end[keep], left[keep], right[keep], own[keep]
        levels.append((sym, at, left, right))
    last = np.maximum(first[1:] - window + 1, first[:-1])  # one past the last window of each text
    open_ = np.arange(n) < last[doc]
    out_sym, out_at, out_i = [], [], []
    for level in range(len(levels) - 1, -1, -1):
        sym, at, left, right = levels[level]
        fits = right - left <= window
        sym, at, left, right = sym[fits], at[fits], left[fits], right[fits]
        todo = np.flatnonzero(open_)
        if not len(todo) or not len(sym):
            continue
        j = np.searchsorted(left, todo)
        ok = j < len(left)
        ok[ok] = right[j[ok]] <= todo[ok] + window
        i, j = todo[ok], j[ok]
        open_[i] = False
        out_i.append(i)
        out_at.append(at[j])
        out_sym.append(mix(sym[j] + U(level)))
    if not out_i:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    i, a, s = np.concatenate(out_i), np.concatenate(out_at), np.concatenate(out_sym)
    order = np.argsort(i)
    i, a, s = i[order], a[order], s[order]
    head = np.concatenate([[True], (i[1:] != i[:-1] + 1) | (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (doc[i[1:]] != doc[i[:-1]])])
    start = np.flatnonzero(head)
    count = np.diff(np.concatenate([start, [len(i)]]))
    return s[start], a[start], i[start], count


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in order, cut into lists of about ``CHUNK`` bytes, with the number of the first."""
    part, size, begin = [], 0, 0
    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if part and size + len(raw) > CHUNK:
            yield begin, part
            part, size, begin = [], 0, k
        part.append(raw)
        size += len(raw)
    if part:
        yield begin, part


def with_row(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text); row is a hash of id and text, so that equal rows have one and rows that share an id don't."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("row", F.xxhash64("doc_id", "text")).select("doc_id", "row", "text")


def occurrences(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Each text's ranges of windows with one anchor: (anchor, variant, check, doc_id, row, start, n).

    variant and check name the anchor's place and all windows of the range, so where both are equal the windows are.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for begin, part in chunks(b.column(2).to_pylist()):
                name, other, first = words_of(part)
                if not len(name):
                    continue
                s, a, i, n = anchors(name, first, window, rounds)
                if not len(i):
                    continue
                own = np.searchsorted(first, i, "right") - 1
                v = mix(range_names(name, window, i, n) ^ mix(s + (i - a + window).astype(np.uint64)))
                cols = [s.view(np.int64), v.view(np.int64), range_names(other, window, i, n).view(np.int64), ids[begin + own], rows[begin + own], (i - first[own]).astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "variant", "check", "doc_id", "row", "start", "n"])

    return with_row(docs).where("doc_id is not null").mapInArrow(run, "anchor long, variant long, check long, doc_id long, row long, start int, n int")


def single_windows(asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """(name, check, doc_id, row, start) of every window in the ranges ``asked``: rows (doc_id, row, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, spans = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_pylist()
            for begin, part in chunks(b.column(2).to_pylist()):
                name, other, first = words_of(part)
                own = np.array([k for k in range(len(part)) for x in spans[begin + k] for _ in range(x["n"])], np.int64)
                at = np.array([x["start"] + j for k in range(len(part)) for x in spans[begin + k] for j in range(x["n"])], np.int64)
                names, checks = (window_names(x, window, first[own] + at) for x in (name, other))
                cols = [names.view(np.int64), checks.view(np.int64), ids[begin + own], rows[begin + own], at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["name", "check", "doc_id", "row", "start"])

    return asked.select("doc_id", "row", "text", "spans").mapInArrow(run, "name long, check long, doc_id long, row long, start int")


def repeated_spans(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, row, spans): the windows that also start in a document of smaller id, as ranges of starts.

    1. Each text gives its ranges of windows by anchor. Only anchors that stand in two or more documents go on.
    2. A range whose variant also stands in a document of smaller id is repeated as a whole.
    3. Where an anchor has several variants, the ranges in each variant's first document are taken apart into windows,
       and equal windows are looked for among these. Repeated rows give equal ranges, which count once.
    Counts and minima are pre-aggregated, and what is not shared is never expanded, so no group of copies is paired.
    """
    spark = docs.sparkSession
    found = Stored(occurrences(docs, window, rounds))
    shared = Stored(found.df.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"))
    release(spark)
    some = Stored(found.df.join(shared.df, "anchor", "left_semi"))
    found.drop()
    shared.drop()
    release(spark)
    # Stored, as a join that also has to finish an aggregate can't be split where one anchor has very many rows.
    variants = Stored(some.df.groupBy("anchor", "variant", "check").agg(F.min("doc_id").alias("lowest")))
    several = Stored(variants.df.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor", F.lit(True).alias("several")))
    told = Stored(some.df.join(variants.df, ["anchor", "variant", "check"]).join(several.df, "anchor", "left").select("doc_id", "row", "start", "n", "lowest", "several"))
    some.drop()
    variants.drop()
    several.drop()
    release(spark)
    asked = told.df.where("doc_id = lowest and several").groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    single = Stored(single_windows(with_row(docs).join(asked, ["doc_id", "row"]), window))
    release(spark)
    repeated = single.df.groupBy("name", "check").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("b")).where("lowest < b").select("name", "check", "lowest")
    parts = single.df.join(repeated, ["name", "check"]).where("doc_id > lowest").select("doc_id", "row", "start", F.lit(1).alias("n"))
    whole = told.df.where("doc_id > lowest").select("doc_id", "row", "start", "n")
    spans = Stored(whole.unionByName(parts).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("spans")))
    told.drop()
    single.drop()
    release(spark)
    return spans.df


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs``: each text without its repeated windows.

    A word goes if it stands in a window of ``window`` words that also starts in a document of smaller id. Words are
    separated by ASCII white space and kept ones joined by single spaces. Null, empty and shorter texts lose nothing.
    Rows with a null id lose nothing and take nothing from others; rows that share an id don't affect each other.
    """
    texts = with_row(docs)
    spans = repeated_spans(docs, window, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at, size = np.array([x["start"] for x in found]), np.array([x["n"] for x in found])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size + window - 1, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                    words = [w for w, k in zip(words, stays.tolist(), strict=True) if k]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = texts.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: what every document loses to windows of 50 words that stand in earlier documents."""
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
