"""Katz backoff scores of whole texts, with n-grams of orders one to three.

    P(w | g h) = d3(r) r / c(g h)           for r = count of (g, h, w) > 0
               = a(g h) P(w | h)            else; P(w | h) itself where (g, h) was never seen
    P(w | h)   = d2(r) r / c(h)             for r = count of (h, w) > 0
               = a(h) P(w)                  else; P(w) itself where h was never seen
    P(w)       = d1(c) c / N                for c = count of w > 0; all unknown words together have what is left.

d are the discounts of Good and Turing for counts up to ``K``, and a(.) is what the discounts leave, divided by what the
shorter context gives to all words not seen here, so probabilities sum to one exactly. A context whose counts are all
above ``K`` leaves nothing: only there c(.) + 1 stands in place of c(.), so that no word becomes impossible.

Tables, all written to shared storage: ``words`` (one row for each word with a dense number and its count), ``blocks``
(texts as numbers of words), and ``grams``, one row for each bucket of middle words h. As every occurrence of (g, h, w)
lies in the bucket of h, a bucket holds its trigrams, its bigrams and the weights of its contexts, and a token is
evaluated there, level by level. What goes to a bucket is counted by block of texts before: one entry for each
different trigram and document. Words seen more than ``HOT`` times are dealt out by (g, h), and contexts seen as often by
(g, h, w); the counts of the pairs behind such words, then spread over buckets, are made before and travel with the blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.llm.common import Stored, arrow_rows, read_table, release, small_batches, trim

#: Counts up to this are discounted.
K = 5
#: Tokens in a block of texts, tokens in a bucket (about), the least number of buckets, and the count of a hot word.
BLOCK, BUCKET, BUCKETS, HOT = 1_000_000, 900_000, 12, 450_000
#: Parts of the buckets that are dealt one after another, so that not all pieces lie on disk at once.
PASSES = 3
#: Local numbers of the end of a text and of what stands before its first word; the global number of the latter.
END, START = 0, 1
START_ID = 0


class Discounts:
    """d(1..K) from the numbers of types seen once, twice, ... K + 1 times; (r - 0.5) / r where those don't fit."""

    def __init__(self, types: dict[int, int]) -> None:
        n = [0] + [types.get(r, 0) for r in range(1, K + 2)]
        cut = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        self.d = np.ones(K + 1)
        for r in range(1, K + 1):
            d = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
            self.d[r] = d if 0 < d < 1 else (r - 0.5) / r

    def of(self, r: np.ndarray) -> np.ndarray:
        return np.where(r <= K, self.d[np.minimum(r, K)], 1.0)


class Unigrams:
    """Discounted unigram probabilities from the number of training tokens and the numbers of types by count."""

    def __init__(self, tokens: int, types: dict[int, int]) -> None:
        self.tokens, self.discounts = tokens, Discounts(types)
        lost = sum((1 - self.discounts.d[c]) * c * types.get(c, 0) for c in range(1, K + 1))
        #: All unknown words together; never nothing, so every text has a probability.
        self.unknown = max(lost / tokens, 1 / (tokens + 1)) if tokens else 1.0
        self.scale = (1 - self.unknown) / (1 - lost / tokens) if tokens and lost < tokens else 0.0

    def of(self, c: np.ndarray) -> np.ndarray:
        known = self.discounts.of(np.maximum(c, 1)) * c / max(self.tokens, 1) * self.scale
        return np.where(c > 0, known, self.unknown)


@dataclass
class Model:
    """What evaluation needs beside the tables; every part is bounded (hot words and contexts have ``HOT`` tokens each)."""

    tokens: int
    types: int
    texts: int
    unigrams: Unigrams
    d2: Discounts | None = None
    d3: Discounts | None = None
    #: Number of a hot word to its weight, and (g, h) of a hot context to its weight.
    weight: dict[int, float] = field(default_factory=dict)
    context_weight: dict[tuple[int, int], float] = field(default_factory=dict)


def pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on, or doubles, compressed plane of bytes by plane of bytes."""
    import zstandard

    a = np.ascontiguousarray(a)
    if a.dtype != np.float64:
        most = int(a.max(initial=0))
        a = a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))
    kind = b"f" if a.dtype == np.float64 else str(a.itemsize).encode()
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b""
    return kind + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    kind = raw[:1]
    size = 8 if kind == b"f" else int(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(size, -1)
    flat = np.ascontiguousarray(planes.T).reshape(-1)
    return flat.view(np.float64) if kind == b"f" else flat.view(np.dtype(f"u{size}")).astype(np.int64)


def pack_names(names: np.ndarray) -> bytes:
    """Sorted 64-bit names by their differences, whose upper bytes are small where names are many."""
    return pack(np.diff(names, prepend=np.uint64(0)))


def unpack_names(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw).view(np.uint64), dtype=np.uint64)


def heads(*arrays: np.ndarray) -> np.ndarray:
    """Where a row of sorted arrays differs from the row before."""
    new = np.zeros(len(arrays[0]), bool)
    new[:1] = True
    for a in arrays:
        new[1:] |= a[1:] != a[:-1]
    return new


def spread(a: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = a.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLOCKS = "block long, ids binary, sizes binary, doc_id binary, no_id binary, held binary, names binary, n_names long"


def blocks(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` (doc_id, text, held_out) as numbers of words, in blocks of about ``BLOCK`` tokens.

    ids are the local numbers of all tokens, ``END`` after each text; names the 64-bit hashes of the local words, zero
    for ``END`` and ``START``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        block = TaskContext.get().partitionId() << 33

        def fresh() -> defaultdict:
            number: defaultdict = defaultdict()
            number.default_factory = lambda: len(number) + 2
            return number

        number, parts, rows, count = fresh(), [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, count, block
            names = np.array([0, 0, *map(xxhash.xxh64_intdigest, number)], np.uint64)
            doc, none, held = zip(*rows, strict=True)
            cols = [pack(np.concatenate(parts)), pack(np.array([len(p) for p in parts])), np.array(doc, np.int64).tobytes(), pack(np.array(none)), pack(np.array(held)), names.tobytes()]
            out = pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([c], pa.binary()) for c in cols), pa.array([len(names)])], [c.split()[0] for c in BLOCKS.split(", ")])
            number, count, block = fresh(), 0, block + 1
            parts.clear()
            rows.clear()
            return out

        for b in batches:
            for i, text, out in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                ids = np.zeros(len(found) + 1, np.uint32)
                ids[:-1] = np.fromiter(map(number.__getitem__, found), np.uint32, len(found))
                parts.append(ids)
                rows.append((i or 0, i is None, bool(out)))
                count += len(ids)
                if count >= BLOCK:
                    yield flush()
        if parts:
            yield flush()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, BLOCKS)


class Block:
    """The arrays of one row of ``blocks`` or ``numbered_blocks``."""

    def __init__(self, row: dict, lists: dict[str, list[np.ndarray]]) -> None:
        self.block, self.lists = row["block"], lists
        self.ids, self.sizes, self.held = unpack(row["ids"]), unpack(row["sizes"]), unpack(row["held"]).astype(bool)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.row = row

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The word before each token and the one before that, as local numbers."""
        first = np.cumsum(self.sizes) - self.sizes
        h = np.empty_like(self.ids)
        h[1:] = self.ids[:-1]
        h[first] = START
        g = np.empty_like(h)
        g[1:] = h[:-1]
        g[first] = START
        return g, h

    def numbered(self, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Global number and count of each local word."""
        number, count = unpack(self.row["number"]), unpack(self.row["count"])
        count[START] = texts
        return number, count


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        names = b.schema.names
        plain = [n for n in names if not pa.types.is_list(b.schema.field(n).type)]
        for k, row in enumerate(b.select(plain).to_pylist()):
            listed = {n: b.column(n)[k].values for n in names if n not in plain}
            trim()
            yield Block(row, {n: [v.field(i).to_numpy(zero_copy_only=False) for i in range(v.type.num_fields)] for n, v in listed.items() if v is not None})


def word_order(names: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """The share of each local word but ``START``, and the local words in order of share and name."""
    local = np.delete(np.arange(len(names)), START)
    share = (names[local] % np.uint64(shares)).astype(np.int64)
    order = np.lexsort((names[local], share))
    return share[order], local[order]


NUMBERED = "block long, ids binary, sizes binary, doc_id binary, no_id binary, held binary, number binary, count binary, pair binary, pair_count binary"
NUMBERED_NAMES = [c.split()[0] for c in NUMBERED.split(", ")]


def hot_pairs(b: Block, hot: np.ndarray, start_hot: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a hot word and the next one: code of local words, number of training tokens, and 64-bit name; in order
    of code."""
    names = np.frombuffer(b.row["names"], np.uint64)
    is_hot = np.isin(names.view(np.int64), hot)
    is_hot[[END, START]] = False, start_hot
    _, h = b.contexts()
    at = np.flatnonzero(is_hot[h])
    code, inverse = np.unique(h[at] * len(names) + b.ids[at], return_inverse=True)
    n = np.bincount(inverse, ~b.held[b.doc[at]], minlength=len(code)).astype(np.int64)
    first, second = code // len(names), code % len(names)
    return code, n, spread(spread(names[first] + (first == START)) + names[second])


def shared_order(name: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    share = (name % np.uint64(shares)).astype(np.int64)
    order = np.lexsort((name, share))
    return share[order], order


def pair_pieces(stored: DataFrame, shares: int, hot: np.ndarray, start_hot: bool) -> DataFrame:
    """(share, block, names, n): the pairs of each block that ``hot_pairs`` gives, by share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches):
            _, n, name = hot_pairs(b, hot, start_hot)
            share, order = shared_order(name, shares)
            edges = np.append(np.flatnonzero(heads(share)), len(share))
            rows = [(int(share[lo]), b.block, pack_names(name[order[lo:hi]]), pack(n[order[lo:hi]])) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["share", "block", "names", "n"])

    return stored.mapInArrow(run, "share int, block long, names binary, n binary")


def count_pairs(pieces: DataFrame) -> DataFrame:
    """(share, block, c, types): the counts of each block's pairs, and without a block the counts of counts of a share."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [unpack_names(r["names"]) for r in rows]
        names, at = np.unique(np.concatenate(parts), return_inverse=True)
        c = np.bincount(at, np.concatenate([unpack(r["n"]) for r in rows]), minlength=len(names)).astype(np.int64)
        edges = np.cumsum([0, *map(len, parts)])
        out = [(r["share"], r["block"], pack(c[at[lo:hi]]), None) for r, lo, hi in zip(rows, edges[:-1], edges[1:], strict=True)]
        out.append((rows[0]["share"], None, None, types_of(c[c > 0])))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())], strict=True)], ["share", "block", "c", "types"])

    return pieces.groupBy("share").applyInArrow(run, "share int, block long, c binary, types array<long>")


def numbered_blocks(joined: DataFrame, shares: int, pair_shares: int, hot: np.ndarray, start_hot: bool) -> DataFrame:
    """Blocks with the global number and the count of each local word in place of its name, and the counts of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches):
            parts = sorted(zip(*b.lists["known"], strict=True))
            names = np.frombuffer(b.row["names"], np.uint64)
            cols = []
            for i in (1, 2):
                values = np.zeros(len(names), np.int64)
                values[word_order(names, shares)[1]] = np.concatenate([unpack(p[i]) for p in parts])
                cols.append(pack(values))
            code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if b.lists.get("of_pairs"):
                code, _, name = hot_pairs(b, hot, start_hot)
                count = np.zeros(len(code), np.int64)
                found = dict(zip(*b.lists["of_pairs"], strict=True))
                count[shared_order(name, pair_shares)[1]] = np.concatenate([unpack(found[k]) for k in sorted(found)])
            cols += [pack(np.diff(code, prepend=0)), pack(count)]
            kept = [pa.array([b.row[n]], pa.int64() if n == "block" else pa.binary()) for n in NUMBERED_NAMES[:6]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([c], pa.binary()) for c in cols)], NUMBERED_NAMES)

    return joined.mapInArrow(run, NUMBERED)


def word_pieces(stored: DataFrame, shares: int) -> DataFrame:
    """(share, block, names, n): the words of each block by share of names, with their training tokens there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches):
            names = np.frombuffer(b.row["names"], np.uint64)
            n = np.bincount(b.ids[~b.held[b.doc]], minlength=len(names))
            share, local = word_order(names, shares)
            edges = np.append(np.flatnonzero(heads(share)), len(share))
            rows = [(int(share[lo]), b.block, pack_names(names[local[lo:hi]]), pack(n[local[lo:hi]])) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["share", "block", "names", "n"])

    return stored.mapInArrow(run, "share int, block long, names binary, n binary")


#: Rows of two kinds: with a block, the numbers and counts of its words of a share; without, the words of the share
#: themselves with names, statistics and the hot ones.
WORDS = "share int, block long, names binary, number binary, c binary, tokens long, seen long, texts long, types array<long>, hot array<long>, hot_c array<long>, hot_name array<long>"
WORD_NAMES = [c.split()[0] for c in WORDS.split(", ")]
WORD_KINDS = [pa.int32(), pa.int64(), *[pa.binary()] * 3, *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 4]


def types_of(c: np.ndarray) -> list[int]:
    """How many of the counts are 1, 2, ... K + 1."""
    return np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def count_words(pieces: DataFrame, shares: int, hot_count: int) -> DataFrame:
    """``WORDS``: the count and a dense number of every word."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        share = rows[0]["share"]
        parts = [unpack_names(r["names"]) for r in rows]
        names, at = np.unique(np.concatenate(parts), return_inverse=True)
        c = np.bincount(at, np.concatenate([unpack(r["n"]) for r in rows]), minlength=len(names)).astype(np.int64)
        # Small numbers for frequent words: in the order of numbers, differences and counts then pack well.
        place = np.empty(len(names), np.int64)
        place[np.argsort(-c, kind="stable")] = np.arange(len(names))
        number = place * shares + share + 1
        ends = names == 0
        hot = np.flatnonzero((c > hot_count) & ~ends)
        out = [(share, None, names.tobytes(), pack(number), pack(c), int(c.sum()), int((c > 0).sum()), int(c[ends].sum()), types_of(c[c > 0]), number[hot].tolist(), c[hot].tolist(), names[hot].view(np.int64).tolist())]
        done = 0
        for r, p in zip(rows, parts, strict=True):
            k = at[done : done + len(p)]
            done += len(p)
            out.append((share, r["block"], None, pack(number[k]), pack(c[k]), *[None] * 7))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), WORD_KINDS, strict=True)], WORD_NAMES)

    return pieces.groupBy("share").applyInArrow(run, WORDS)


#: words: global numbers, and n their counts; contexts: code g * words + h of local words by h, g; each: trigrams of a context; w: their last words; both:
#: count of (h, w) where h is hot; context_count: where the context is hot; docs: entries of a trigram; doc, times: the entries.
PIECES = "bucket int, block long, held binary, words binary, n binary, g binary, h binary, each binary, w binary, both binary, context_count binary, docs binary, doc binary, times binary"
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def dealt(known: DataFrame, buckets: int, hot: list[int], texts: int, hot_count: int, part: int, passes: int) -> DataFrame:
    """The trigrams of each block with their documents, dealt out to the buckets of their middle words.

    Only the buckets whose number gives ``part`` modulo ``passes``.
    """
    frequent = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches):
            number, count = b.numbered(texts)
            m = len(number)
            g, h = b.contexts()
            context = h * m + g
            pair_keys = pair_values = np.zeros(0, np.int64)
            if len(frequent):
                pair_keys, pair_values = np.cumsum(unpack(b.row["pair"])), unpack(b.row["pair_count"])

            def looked_up(first: np.ndarray, second: np.ndarray, m=m, keys=pair_keys, values=pair_values) -> np.ndarray:
                if not len(keys):
                    return np.zeros(len(first), np.int64)
                code = first * m + second
                at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                return np.where(keys[at] == code, values[at], 0)

            key = spread(number)[h]
            if len(frequent):
                is_hot = np.isin(number, frequent)
                far = is_hot[h]
                key = np.where(far, spread(key + number[g].astype(np.uint64)), key)
                seen = looked_up(g, h)
                seen = np.where((g == START) & (h == START), texts, seen)
                key = np.where(far & (seen > hot_count), spread(key + number[b.ids].astype(np.uint64)), key)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            here = np.flatnonzero(bucket % passes == part)
            if not len(here):
                continue
            bucket, context, w, doc = bucket[here], context[here], b.ids[here], b.doc[here]
            # Tokens are in order of documents, which a stable sort keeps.
            if m**3 * buckets < 1 << 63:
                order = np.argsort((bucket * m * m + context) * m + w, kind="stable")
            else:
                order = np.lexsort((w, context, bucket))
            bucket, context, w, doc = bucket[order], context[order], w[order], doc[order]
            entry = np.flatnonzero(heads(bucket, context, w, doc))
            times = np.diff(np.append(entry, len(w)))
            bucket, context, w, doc = bucket[entry], context[entry], w[entry], doc[entry]
            edges = np.flatnonzero(heads(bucket))
            rows = []
            for lo, hi in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
                co, wo = context[lo:hi], w[lo:hi]
                tri = np.flatnonzero(heads(co, wo))
                docs = np.diff(np.append(tri, hi - lo))
                co, wo = co[tri], wo[tri]
                ctx = np.flatnonzero(heads(co))
                each = np.diff(np.append(ctx, len(co)))
                both = looked_up(co // m, wo)
                co = co[ctx]
                hh, gg = co // m, co % m
                seen = looked_up(gg, hh)
                seen = np.where(seen > hot_count, seen, 0)
                if len(frequent):
                    seen = np.where((gg == START) & (hh == START) & (texts > hot_count), texts, seen)
                used = np.unique(np.concatenate([hh, gg, wo]))
                used = used[np.argsort(number[used])]
                place = np.zeros(m, np.int64)
                place[used] = np.arange(len(used))
                cols = [pack(b.held), pack(np.diff(number[used], prepend=0)), pack(count[used]), pack(place[gg]), pack(place[hh]), pack(each), pack(place[wo]), pack(both), pack(seen), pack(docs), pack(doc[lo:hi]), pack(times[lo:hi])]
                rows.append((int(bucket[lo]), b.block, *cols))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 12]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], PIECE_NAMES)

    return known.mapInArrow(run, PIECES)


#: One row of n-gram tables for each bucket; ``types2`` and ``types3`` count bigrams and trigrams by count.
GRAMS = "bucket int, words binary, n binary, g binary, h binary, context_count binary, context binary, w binary, both binary, c3 binary, docs binary, blocks binary, block binary, doc binary, times binary, types2 array<long>, types3 array<long>, has_hot boolean"
GRAM_NAMES = [c.split()[0] for c in GRAMS.split(", ")]


def count_grams(pieces: DataFrame) -> DataFrame:
    """``GRAMS`` of every bucket: pieces put together, counts of the training texts added up."""

    def run(table: pa.Table) -> pa.Table:
        trim()
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        bucket = rows[0]["bucket"]
        parts = defaultdict(list)
        ids = np.array(sorted({r["block"] for r in rows}), np.int64)
        n_words = n_contexts = 0
        for r in rows:
            x = {n: unpack(r[n]) for n in PIECE_NAMES[2:]}
            held = x["held"].astype(bool)
            tri = np.repeat(np.arange(len(x["w"])), x["docs"])
            parts["number"].append(np.cumsum(x["words"]))
            parts["count"].append(x["n"])
            for name in "ghw":
                parts[name].append((x[name] + n_words).astype(np.int32))
            parts["seen"].append(x["context_count"])
            parts["ctx"].append(np.repeat(np.arange(n_contexts, n_contexts + len(x["g"]), dtype=np.int32), x["each"]))
            parts["both"].append(x["both"])
            parts["n"].append(np.bincount(tri, x["times"] * ~held[x["doc"]], minlength=len(x["w"])).astype(np.int32))
            parts["docs"].append(x["docs"].astype(np.int32))
            parts["block"].append(np.full(len(x["doc"]), np.searchsorted(ids, r["block"]), np.int32))
            parts["doc"].append(x["doc"].astype(np.int32))
            parts["times"].append(x["times"].astype(np.int32))
            n_words, n_contexts = n_words + len(x["words"]), n_contexts + len(x["g"])
        rows.clear()
        p = {n: np.concatenate(parts.pop(n)) for n in list(parts)}
        words, at, place = np.unique(p.pop("number"), return_index=True, return_inverse=True)
        count = p.pop("count")[at]
        m = len(words)
        contexts, at, ctx = np.unique(place[p.pop("h")] * m + place[p.pop("g")], return_index=True, return_inverse=True)
        seen = p.pop("seen")[at]
        ctx = ctx[p.pop("ctx")]
        tris, at, tri = np.unique(ctx * m + place[p.pop("w")], return_index=True, return_inverse=True)
        both = p.pop("both")[at]
        c3 = np.bincount(tri, p.pop("n"), minlength=len(tris)).astype(np.int64)
        entry = np.repeat(tri, p.pop("docs"))
        order = np.argsort(entry, kind="stable")  # by block and document within
        context, w = tris // m, tris % m
        g, h = contexts % m, contexts // m
        c2, pair, _ = pairs_of(h[context] * m + w, c3, both)
        first = np.zeros(len(c2), np.int64)
        first[pair] = both
        local = c2[(first == 0) & (c2 > 0)]  # pairs behind hot words are counted elsewhere
        cols = [np.diff(words, prepend=0), count, g, h, seen, np.diff(context, prepend=0), w, both, c3, np.bincount(entry, minlength=len(tris)), np.diff(ids, prepend=0), p["block"][order], p["doc"][order], p["times"][order]]
        row = [bucket, *map(pack, cols), types_of(local), types_of(c3[c3 > 0]), bool((seen > 0).any())]
        kinds = [pa.int32(), *[pa.binary()] * 14, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], GRAM_NAMES)

    return pieces.groupBy("bucket").applyInArrow(run, GRAMS)


def pairs_of(code: np.ndarray, c3: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The count of each different (h, w), the place of each trigram's pair, and the pairs."""
    pairs, pair = np.unique(code, return_inverse=True)
    c2 = np.bincount(pair, c3, minlength=len(pairs)).astype(np.int64)
    known = np.zeros(len(pairs), np.int64)
    known[pair] = both
    return np.where(known > 0, known, c2), pair, pairs


class Grams:
    """The tables of one bucket with probabilities under a model."""

    def __init__(self, row: dict, model: Model) -> None:
        x = {n: unpack(row[n]) for n in GRAM_NAMES[1:15]}
        self.x, self.model = x, model
        self.words = np.cumsum(x["words"])
        self.count, self.g, self.h, self.w, self.c3 = x["n"], x["g"], x["h"], x["w"], x["c3"]
        self.context = np.cumsum(x["context"])
        m = len(self.words)
        self.c2, self.pair, pairs = pairs_of(self.h[self.context] * m + self.w, self.c3, x["both"])
        self.pair_h, self.pair_w = pairs // m, pairs % m
        local = np.bincount(self.context, self.c3, minlength=len(self.g)).astype(np.int64)
        self.context_count = np.where(x["context_count"] > 0, x["context_count"], local)
        self.p1 = model.unigrams.of(self.count)
        self.weights()

    def weights(self) -> None:
        """p2 and p3 of what was seen, and what each context and each middle word passes on."""
        m, d2, d3 = self.model, self.model.d2, self.model.d3
        size = len(self.words)
        cut = np.where(self.c2 > 0, (1 - d2.of(self.c2)) * self.c2, 0.0)
        total = self.count[self.pair_h].astype(float)
        left = np.bincount(self.pair_h, cut, minlength=size)
        for_h = np.maximum(self.count, 1).astype(float)
        hot = np.flatnonzero(np.isin(self.words, list(m.weight)))
        bare = left == 0
        bare[hot] = [m.weight[int(self.words[i])][1] for i in hot]
        self.p2 = np.where(self.c2 > 0, d2.of(self.c2) * self.c2 / np.maximum(total + bare[self.pair_h], 1), 0.0)
        free = np.where(bare, 1.0, left) / (for_h + bare)
        rest = 1 - np.bincount(self.pair_h, np.where(self.c2 > 0, self.p1[self.pair_w], 0.0), minlength=size)
        self.weight = free / np.maximum(rest, 1e-300)
        self.weight[hot] = [m.weight[int(self.words[i])][0] for i in hot]
        n = len(self.g)
        cut = np.where(self.c3 > 0, (1 - d3.of(self.c3)) * self.c3, 0.0)
        self.left3 = np.bincount(self.context, cut, minlength=n)
        self.seen2 = np.bincount(self.context, np.where(self.c3 > 0, self.p2[self.pair], 0.0), minlength=n)
        bare = self.left3 == 0
        self.spread = self.x["context_count"] > 0
        given = {}
        for i in np.flatnonzero(self.spread):
            given[i] = m.context_weight.get((int(self.words[self.g[i]]), int(self.words[self.h[i]])), (1.0, False))
            bare[i] = given[i][1]
        total = self.context_count.astype(float) + bare
        self.p3 = np.where(self.c3 > 0, d3.of(self.c3) * self.c3 / np.maximum(total[self.context], 1), 0.0)
        self.context_weight = np.where(bare, 1.0, self.left3) / np.maximum(total, 1) / np.maximum(1 - self.seen2, 1e-300)
        for i, (a, _) in given.items():
            self.context_weight[i] = a

    def logs(self) -> np.ndarray:
        """log10 P(w | g h) of every trigram, by recursion through the shorter contexts."""
        h = self.h[self.context]
        low = np.where(self.count[h] > 0, self.weight[h], 1.0) * self.p1[self.w]
        low = np.where(self.c2[self.pair] > 0, self.p2[self.pair], low)
        low = np.where(self.context_count[self.context] > 0, self.context_weight[self.context], 1.0) * low
        return np.log10(np.where(self.c3 > 0, self.p3, low))


def hot_sums(grams: DataFrame, model: Model) -> DataFrame:
    """(g, h, total, left, seen): what each bucket has of the contexts that are spread over buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                t = Grams(row, model)
                at = np.flatnonzero(t.spread)
                cols = [t.words[t.g[at]], t.words[t.h[at]], t.context_count[at], t.left3[at], t.seen2[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["g", "h", "total", "left", "seen"])

    rows = grams.where("has_hot").mapInArrow(run, "g long, h long, total long, left double, seen double")
    return rows.groupBy("g", "h").agg(F.max("total").alias("total"), F.sum("left").alias("left"), F.sum("seen").alias("seen"))


PARTS = "block long, doc binary, x binary, doc_id binary, no_id binary, held binary, sizes binary, known binary"
PART_NAMES = [c.split()[0] for c in PARTS.split(", ")]


def evaluated(grams: DataFrame, model: Model) -> DataFrame:
    """Sums of log10 probabilities by document, one row for each bucket and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                trim()
                t = Grams(row, model)
                x = t.x
                value = np.repeat(t.logs(), x["docs"]) * x["times"]
                ids = np.cumsum(x["blocks"])
                most = int(x["doc"].max(initial=0)) + 1
                keys, inverse = np.unique(x["block"] * most + x["doc"], return_inverse=True)
                sums = np.bincount(inverse, value, minlength=len(keys))
                block, doc = keys // most, keys % most
                edges = np.append(np.flatnonzero(heads(block)), len(block))
                out = [(int(ids[block[lo]]), pack(doc[lo:hi]), pack(sums[lo:hi]), *[None] * 5) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.binary()] * 7], strict=True)], PART_NAMES)

    return grams.mapInArrow(run, PARTS)


def own_rows(known: DataFrame, model: Model) -> DataFrame:
    """One row for each block with its documents: ids, sizes, known tokens and the base sum as ``x``."""
    texts = model.texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches):
            _, count = b.numbered(texts)
            c = count[b.ids]
            base, hits = (np.bincount(b.doc, v, minlength=len(b.sizes)) for v in (np.log10(c + 1.0), c > 0))
            row = [b.block, None, pack(base), b.row["doc_id"], b.row["no_id"], b.row["held"], b.row["sizes"], pack(hits.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), *[pa.binary()] * 7], strict=True)], PART_NAMES)

    return known.mapInArrow(run, PARTS)


#: Sums by document that a task holds before it passes them on.
HELD = 4_000_000


def combined(parts: DataFrame) -> DataFrame:
    """``parts`` with the sums of each task's buckets added up by document, so that what is shuffled doesn't grow with
    the number of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            rows = [(k, *map(pack, (at, v[at])), *[None] * 5) for k, v in sorted(sums.items()) for at in [np.flatnonzero(v)]]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 7], strict=True)], PART_NAMES)

        for b in batches:
            own = b.filter(b.column("sizes").is_valid())
            if own.num_rows:
                yield own
            for r in b.select(["block", "doc", "x"]).to_pylist():
                if r["doc"] is None:
                    continue
                doc = unpack(r["doc"])
                had, most = sums.get(r["block"], np.zeros(0)), int(doc.max(initial=0)) + 1
                if len(had) < most:
                    had = sums[r["block"]] = np.append(had, np.zeros(most - len(had)))
                had[doc] += unpack(r["x"])
            if sum(map(len, sums.values())) > HELD:
                yield flush()
        if sums:
            yield flush()

    return parts.mapInArrow(run, PARTS)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def put_together(parts: DataFrame, model: Model) -> DataFrame:
    """The scores of all documents of each block."""
    tokens, log_v = model.tokens, np.log10(model.tokens + model.types + 1)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["sizes"] is not None)
        size = unpack(own["sizes"])
        score = np.zeros(len(size))
        # In the same order whichever task ends first; what a task adds up before follows its files.
        for d, x in sorted((r["doc"], r["x"]) for r in rows if r["doc"] is not None):
            score[unpack(d)] += unpack(x)
        ids = pa.array(np.frombuffer(own["doc_id"], np.int64), mask=unpack(own["no_id"]).astype(bool))
        cols = [ids, pa.array(unpack(own["held"]).astype(bool)), pa.array(size), pa.array(unpack(own["known"])), pa.array(np.full(len(size), tokens)), pa.array(unpack(own["x"]) - size * log_v), pa.array(score)]
        return pa.Table.from_arrays(cols, [c.split()[0] for c in SCORES.split(", ")])

    return parts.groupBy("block").applyInArrow(run, SCORES)


class Several:
    """Stored tables of one schema as one."""

    def __init__(self, parts: list[Stored]) -> None:
        self.parts, self.df = parts, parts[0].df
        for p in parts[1:]:
            self.df = self.df.unionByName(p.df)

    def drop(self) -> None:
        for p in self.parts:
            p.drop()


@dataclass
class Tables:
    """The model and its tables."""

    model: Model
    words: Stored
    blocks: Stored
    grams: Several

    def drop(self) -> None:
        for t in (self.words, self.blocks, self.grams):
            t.drop()


def hot_weights(grams: DataFrame, model: Model, count: dict[int, int]) -> dict[int, tuple[float, bool]]:
    """The backoff weight of each hot word, and whether none of its counts is discounted; one row a word.

    A pair may lie in several buckets; each takes the share of it that its own occurrences are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                trim()
                x = {n: unpack(row[n]) for n in ("words", "n", "h", "context", "w", "both", "c3")}
                at = np.flatnonzero((x["both"] > 0) & (x["c3"] > 0))
                h, c2, c3 = x["h"][np.cumsum(x["context"])[at]], x["both"][at], x["c3"][at]
                hs, inverse = np.unique(h, return_inverse=True)
                left = np.bincount(inverse, (1 - model.d2.of(c2)) * c3, minlength=len(hs))
                seen = np.bincount(inverse, model.unigrams.of(x["n"][x["w"][at]]) * c3 / c2, minlength=len(hs))
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(x["words"])[hs]), pa.array(left), pa.array(seen)], ["h", "left", "seen"])

    rows = grams.mapInArrow(run, "h long, left double, seen double").groupBy("h").agg(F.sum("left").alias("left"), F.sum("seen").alias("seen")).collect()
    out = {}
    for r in rows:
        bare = r["left"] == 0
        out[r["h"]] = ((1.0 if bare else r["left"]) / (count[r["h"]] + bare) / max(1 - r["seen"], 1e-300), bare)
    return out


def by_count(name: str, tables: DataFrame) -> dict[int, int]:
    """Sums of the counts of counts in the arrays ``name``."""
    rows = tables.select(F.posexplode(name).alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()
    return {r.pos + 1: r.n for r in rows}


def fit(docs: DataFrame, held_out: Column, bucket: int | None = None, hot_count: int | None = None) -> Tables:
    """Count the n-grams of the rows where ``held_out`` is not true and store them, with the tokens of all rows."""
    spark = docs.sparkSession
    bucket, hot_count = bucket or BUCKET, hot_count or HOT
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    texts = Stored(blocks(docs))
    arrow_rows(spark, 1)  # a row is a block from here on
    shares = max(BUCKETS, -(-(texts.df.agg(F.sum("n_names")).first()[0] or 0) // BLOCK))
    found = Stored(count_words(word_pieces(texts.df, shares), shares, hot_count))
    release(spark)
    words = Stored(found.df.where("block is null"))
    each = words.df.select("tokens", "seen", "texts", "types", "hot", "hot_c").agg(*(F.sum(c).alias(c) for c in ("tokens", "seen", "texts"))).first()
    n, v, n_texts = each.tokens or 0, each.seen or 0, each.texts or 0
    types = by_count("types", words.df)
    model = Model(n, v, n_texts, Unigrams(n, types))
    # Each has more than hot_count of the tokens, which bounds their number.
    rows = words.df.select(F.explode(F.arrays_zip("hot", "hot_c", "hot_name")).alias("x")).select("x.*").collect()
    hot, hot_names = {r.hot: r.hot_c for r in rows}, np.array(sorted(r.hot_name for r in rows), np.int64)
    start_hot = n_texts > hot_count
    if start_hot:
        hot[START_ID] = n_texts
    listed = found.df.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("share", "number", "c")).alias("known"))
    joined, types2, pairs = texts.df.join(listed, "block"), {}, None
    pair_shares = max(BUCKETS, -(-n // BLOCK))
    if hot:
        pairs = Stored(count_pairs(pair_pieces(texts.df, pair_shares, hot_names, start_hot)))
        release(spark)
        types2 = by_count("types", pairs.df.where("block is null"))
        of_pairs = pairs.df.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("share", "c")).alias("of_pairs"))
        joined = joined.join(of_pairs, "block", "left")
    known = Stored(numbered_blocks(joined, shares, pair_shares, hot_names, start_hot))
    for t in (texts, found, pairs):
        if t is not None:
            t.drop()
    release(spark)
    buckets, done = max(BUCKETS, -(-n // bucket)), []
    for part in range(PASSES):
        done.append(Stored(count_grams(dealt(known.df, buckets, list(hot), n_texts, hot_count, part, PASSES))))
        release(spark)
    grams = Several(done)
    for r, c in by_count("types2", grams.df).items():
        types2[r] = types2.get(r, 0) + c
    model.d2, model.d3 = Discounts(types2), Discounts(by_count("types3", grams.df))
    if hot:
        model.weight = hot_weights(grams.df, model, hot)
        for r in hot_sums(grams.df, model).collect():
            bare = r["left"] == 0
            model.context_weight[r.g, r.h] = ((1.0 if bare else r["left"]) / (r.total + bare) / max(1 - r.seen, 1e-300), bare)
    return Tables(model, words, known, grams)


def unigrams(tables: Tables) -> DataFrame:
    """(name, number, c): the 64-bit hash, the number and the count of every word; the end of a text has name 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.select(["names", "number", "c"]).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["names"], np.int64)), pa.array(unpack(row["number"])), pa.array(unpack(row["c"]))], ["name", "number", "c"])

    return tables.words.df.mapInArrow(run, "name long, number long, c long")


def ngrams(tables: Tables) -> DataFrame:
    """(g, h, w, c, p, weight): every trigram seen, by numbers of words, with its count and probability, and the weight of its context."""
    model = tables.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                t = Grams(row, model)
                k = np.flatnonzero(t.c3 > 0)
                c = t.context[k]
                cols = [t.words[t.g[c]], t.words[t.h[c]], t.words[t.w[k]], t.c3[k], t.p3[k], t.context_weight[c]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["g", "h", "w", "c", "p", "weight"])

    return tables.grams.df.mapInArrow(run, "g long, h long, w long, c long, p double, weight double")


def score_documents(docs: DataFrame, held_out: Column, bucket: int | None = None, hot_count: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    The model is trained on the rows where ``held_out`` is not true (null counts as not). Texts that are null count as
    empty: they have the end token only. Repeated rows are repeated texts, and null ids stay null. Without training
    texts every token is unknown and has probability one. An empty table gives an empty result; columns other than
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    tables = fit(docs, held_out, bucket, hot_count)
    parts = Stored(evaluated(tables.grams.df, tables.model).unionByName(own_rows(tables.blocks.df, tables.model)))
    model = tables.model
    tables.drop()
    release(spark)
    small_batches(spark)
    out = Stored(put_together(combined(parts.df), model))
    parts.drop()
    return out.df


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2"


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: Katz and add-one scores of every document."""
    return score_documents(read_table(spark, sf_dir, "documents"), F.expr(HELD_OUT))
