"""Product codes for vectors by Lloyd's rounds that look again only at parts whose bounds no longer hold.

Vectors are cut into parts, each with a codebook of its own. Blocks of vectors keep, for every part and every entry, a heap of
the parts assigned to the entry. A part's key is the slack between its distance to the next best entry (lower bound)
and to its own (upper bound), on top of the drift summed up at the time: the way that its entry and the farthest other
one have moved in all rounds so far. While the drift stays below the key the part can't have another nearest entry; only
parts that the drift has overtaken are popped, scanned against the whole codebook and pushed again. Distances are exact
integers, and keys are taken a little too small, so that ties and roundings lead to a scan.

The driver holds codebooks and their sums only: parts * entries * components numbers, whatever the input. Blocks are rows
of a stored table, written anew in each round, so that a lost executor costs its share of a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.llm.common import BROADCAST_IDS, Stored, arrow_rows, read_table, small_batches

#: Vectors in a block.
BLOCK = 4096
#: Relative and absolute room for roundings in the keys.
ROOM, LEAST = 1e-9, 1e-6
#: Sums are carried in two longs, so that no number of rows makes them overflow.
HALF = 32

STATE = "ids array<long>, labels array<{label}>, x binary, wide boolean, heap_keys binary, heap_items binary, heap_sizes binary, sums array<struct<part:int,entry:int,n:long,hi:array<long>,lo:array<long>>>, scanned long, codes array<string>, errors array<long>"


def usable(table: DataFrame, id_: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, v, label): components as floor(scale * x) for every row but those with a null vector or null or non-finite
    components, which take no part. Components beyond a long saturate."""
    rows = table.select(F.col(id_).alias("id"), F.col(vector).alias("x"), F.col(label).alias("label")).where("size(x) > 0")
    rows = rows.where("not exists(x, c -> c is null or isnan(c) or abs(cast(c as double)) = double('infinity'))")
    return rows.select("id", F.expr(f"transform(x, c -> cast(floor({scale}D * cast(c as double)) as bigint))").alias("v"), "label")


def exact(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, rows of ``x`` against entries: by floating point where all steps are whole numbers that it
    holds, else by Python's integers."""
    big = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * big * big * x.shape[1] < 2**53:
        a, c = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
    a, c = x.astype(object), book.astype(object)
    return np.stack([((a - e) ** 2).sum(1) for e in c], axis=1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row (ties to the lower one) and the slack of its bounds."""
    d = exact(x, book)
    best = d.argmin(1).astype(np.int64) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64)
    if d.shape[1] == 1:
        return best, np.full(len(x), np.inf)
    at = np.arange(len(x))
    own = d[at, best]
    d[at, best] = d.max() + 1
    other = d.min(1)
    return best, roots(other) * (1 - ROOM) - roots(own) * (1 + ROOM) - LEAST


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much each entry's slack may shrink in a step: the entry's own move and the largest move of another."""
    moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + ROOM)
    if len(moved) == 1:
        return moved
    order = np.argsort(-moved, kind="stable")
    other = np.full(len(moved), moved[order[0]])
    other[order[0]] = moved[order[1]]
    return moved + other


def two_longs(total: int) -> tuple[int, int]:
    return total >> HALF, total & ((1 << HALF) - 1)


def gathered(x: np.ndarray, was: np.ndarray, now: np.ndarray, part: int) -> list[dict]:
    """What the moves of rows from entries ``was`` (-1: none) to ``now`` add to the entries' counts and sums."""
    out = []
    for e in np.unique(np.concatenate([was[was >= 0], now])):
        into, off = x[(now == e) & (was != e)].astype(object), x[(was == e) & (now != e)].astype(object)
        if len(into) + len(off):
            halves = [two_longs(int(t)) for t in (into.sum(0) if len(into) else 0) - (off.sum(0) if len(off) else np.zeros(x.shape[1], object))]
            out.append({"part": part, "entry": int(e), "n": len(into) - len(off), "hi": [h for h, _ in halves], "lo": [w for _, w in halves]})
    return out


class Heaps:
    """The heaps of one part of one block: for each entry pairs (key, row), smallest key first."""

    def __init__(self, entries: int) -> None:
        self.of: list[list[tuple[float, int]]] = [[] for _ in range(entries)]

    def overtaken(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pop the rows whose key the summed drift of their entry has reached; rows and their entries."""
        rows, entries = [], []
        for e, heap in enumerate(self.of):
            while heap and heap[0][0] <= drift[e]:
                rows.append(heappop(heap)[1])
                entries.append(e)
        return np.array(rows, np.int64), np.array(entries, np.int64)

    def push(self, rows: np.ndarray, entries: np.ndarray, keys: np.ndarray) -> None:
        for r, e, k in zip(rows.tolist(), entries.tolist(), keys.tolist(), strict=True):
            heappush(self.of[e], (k, r))

    def assigned(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        for e, heap in enumerate(self.of):
            out[[r for _, r in heap]] = e
        return out

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = [p for heap in self.of for p in heap]
        return np.array([k for k, _ in pairs], np.float64), np.array([r for _, r in pairs], np.int32), np.array([len(h) for h in self.of], np.int32)

    @classmethod
    def unpacked(cls, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> Heaps:
        out, at = cls(len(sizes)), 0
        for e, n in enumerate(sizes.tolist()):
            out.of[e] = list(zip(keys[at : at + n].tolist(), rows[at : at + n].tolist(), strict=True))
            heapify(out.of[e])
            at += n
        return out


def one_round(blocks: DataFrame, books: np.ndarray, drift: np.ndarray, label: str, last: bool) -> DataFrame:
    """Assign the parts of all blocks to ``books`` (part, entry, component); ``drift`` (part, entry) is summed over rounds.

    Blocks are new rows (id, v, label), one block for each batch, or rows of the state of the round before.
    """
    parts, entries, wide = books.shape
    schema = STATE.format(label=label)
    names = ["ids", "labels", "x", "wide", "heap_keys", "heap_items", "heap_sizes", "sums", "scanned", "codes", "errors"]
    fresh = "v" in blocks.columns

    def block(ids: pa.Array, labels: pa.Array, x: np.ndarray, heaps: list[Heaps] | None) -> pa.RecordBatch:
        n, scanned, sums, codes, new = len(x), 0, [], [], []
        errors = np.zeros(n, object)
        for p in range(parts):
            own, book, d = x[:, p * wide : (p + 1) * wide], books[p], drift[p]
            if heaps is None:
                heap, rows, was = Heaps(entries), np.arange(n), np.full(n, -1)
            else:
                heap = heaps[p]
                rows, was = heap.overtaken(d)
            if len(rows):
                now, slack = scan(own[rows], book)
                heap.push(rows, now, slack + d[now])
                scanned += len(rows)
                sums += gathered(own[rows], was, now, p)
            if last:
                code = heap.assigned(n)
                codes.append(code.astype(np.uint8))
                gap = own.astype(object if int(np.abs(own).max(initial=0)) + int(np.abs(book).max(initial=0)) > 2**28 else np.int64) - book[code]
                errors = errors + (gap * gap).sum(1)
            new.append(heap.packed())
        column = lambda k, kind: b"".join(y[k].astype(kind).tobytes() for y in new)
        narrow = int(np.abs(x).max(initial=0)) < 2**31
        row = {
            "x": x.astype(np.int32 if narrow else np.int64).tobytes(), "wide": not narrow,
            "heap_keys": column(0, np.float64), "heap_items": column(1, np.int32), "heap_sizes": column(2, np.int32),
            "sums": sums, "scanned": scanned,
            "codes": [bytes(c).hex() for c in np.stack(codes, 1)] if last else [],
            "errors": [e if e < 2**63 else None for e in errors.tolist()] if last else [],
        }
        return ids, labels, row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if fresh:
                if b.num_rows:
                    yield packed(*block(b.column("id"), b.column("label"), values(b.column("v")), None))
                continue
            for i in range(b.num_rows):
                get = lambda c, i=i, b=b: b.column(c)[i].as_py()
                x = np.frombuffer(get("x"), np.int64 if get("wide") else np.int32).astype(np.int64).reshape(-1, parts * wide)
                n, sizes = len(x), np.frombuffer(get("heap_sizes"), np.int32).reshape(parts, entries)
                keys, items = np.frombuffer(get("heap_keys")).reshape(parts, n), np.frombuffer(get("heap_items"), np.int32).reshape(parts, n)
                heaps = [Heaps.unpacked(keys[p], items[p], sizes[p]) for p in range(parts)]
                yield packed(*block(b.column("ids")[i].values, b.column("labels")[i].values, x, heaps))

    def values(v: pa.Array) -> np.ndarray:
        return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), -1)

    def packed(ids: pa.Array, labels: pa.Array, row: dict) -> pa.RecordBatch:
        long = pa.list_(pa.int64())
        kinds = {"sums": pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("hi", long), ("lo", long)])), "codes": pa.list_(pa.string()), "errors": long}
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        made = {"ids": whole(ids.cast(pa.int64())), "labels": whole(labels)} | {k: pa.array([v], kinds.get(k)) for k, v in row.items()}
        return pa.RecordBatch.from_arrays([made[c] for c in names], names)

    return blocks.mapInArrow(run, schema)


def moved_sums(state: DataFrame) -> list:
    """What a round adds to the entries' counts and sums: rows (part, entry, pos, n, hi, lo), a bounded number."""
    flat = state.select(F.inline("sums")).select("part", "entry", "n", F.posexplode(F.arrays_zip("hi", "lo")).alias("pos", "s"))
    return flat.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("s.hi").alias("hi"), F.sum("s.lo").alias("lo")).collect()


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scans: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """Codes of ``vectors`` (id, v, label), and the codebooks (part, entry, component).

    A codebook starts as that part of the vectors of the ``entries`` smallest ids (fewer, if there are fewer; of repeated
    ids smaller vectors come first, null ids come before others). In each round all parts are assigned to their nearest
    entries, ties to the lower, and entries become the floor of their parts' means; then parts are assigned once more. The length
    is that of the first vector which ``parts`` divides; vectors of other lengths take no part. Returns (id, code, error, label,
    label_error): error is null where it is beyond a long. An empty table gives no row. ``scans`` gets the number of parts
    that each round has scanned.
    """
    spark = vectors.sparkSession
    first = vectors.where(F.size("v") % parts == 0).orderBy("id", "v").select(F.size("v").alias("n")).first()
    wide = first.n if first else parts
    kind = vectors.schema["label"].dataType.simpleString()
    same = vectors.where(F.size("v") == wide)
    begin = [r.v for r in same.orderBy("id", "v").limit(entries).collect()]
    if not begin:
        return vectors.where("false").select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label", F.lit(0).cast("long").alias("label_error")), np.zeros((parts, 0, wide // parts), object)
    books = np.array(begin, np.int64).reshape(len(begin), parts, -1).transpose(1, 0, 2)
    counts, sums = np.zeros(books.shape[:2], object), np.zeros(books.shape, object)
    drift = np.zeros(books.shape[:2])
    state = None
    arrow_rows(spark, BLOCK)
    for k in range(rounds + 1):
        step = Stored(one_round(state.df if state else same, books, drift, kind, k == rounds))
        arrow_rows(spark, 1)  # from now on a row is a block
        if state:
            state.drop()
        state = step
        if scans is not None:
            scans.append(state.df.agg(F.sum("scanned")).first()[0])
        if k == rounds:
            break
        for r in moved_sums(state.df):
            sums[r.part, r.entry, r.pos] += (r.hi << HALF) + r.lo
            counts[r.part, r.entry] += r.n if r.pos == 0 else 0
        new = books.copy()
        used = counts > 0
        new[used] = (sums[used] // counts[used][:, None]).astype(np.int64)
        drift = drift + np.stack([drifts(a, b) for a, b in zip(books, new, strict=True)])
        books = new
    small_batches(spark)
    rows = state.df.select(F.inline(F.arrays_zip("ids", "codes", "errors", "labels"))).toDF("id", "code", "error", "label")
    return with_label_error(rows), books


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with the error summed over equal labels, nulls together; null where one is null or the sum beyond a long.

    Labels are counted first: few sums are broadcast, more are joined by sorting, where Spark splits a hot label."""
    total = F.when(F.count(F.lit(1)) == F.count("error"), F.expr("try_cast(sum(cast(error as decimal(38, 0))) as bigint)"))
    sums = Stored(rows.groupBy(F.col("label").alias("same")).agg(total.alias("label_error"))).df
    few = sums.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(sums) if few else sums.hint("merge"), rows["label"].eqNullSafe(sums["same"])).drop("same")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: codes of all vectors in 4 parts of 256 entries, after 4 rounds."""
    coded, books = compress(usable(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 1024))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql(rounds: int = 4) -> str:
    """The same rows by full scans in every round."""
    near = "SELECT o.p, o.vec_id, arg_min(b.e, struct_pack(d := {d}, e := b.e)) AS e, min({d}) AS d FROM own o JOIN b{k} b ON b.p = o.p GROUP BY 1, 2"
    d = "list_sum(list_transform(list_zip(o.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(d=d, k=k)})")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT a.p, a.e, i, CAST(floor(sum(o.v[i]) / count(*)) AS BIGINT) AS m FROM a{k} a JOIN own o USING (p, vec_id), range(1, 17) r(i) GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (p, e))")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), own AS MATERIALIZED (
  SELECT vec_id, p, v[16 * p + 1 : 16 * p + 16] AS v FROM kept, range(4) r(p)
), b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM own QUALIFY e < 256
), {", ".join(steps)}, codes AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
), book AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), book
"""


OP12_SQL = sql()
