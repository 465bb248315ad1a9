"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks, whose sorted lists are made and stored once: every dimension has a list of the block's
vectors in order of their component. Queries are dealt into blocks too and go to all blocks of vectors. A query reads all lists in step, from the top where its own
component is positive and from the bottom where it is negative; whatever it meets is scored in full. The components at
the depth reached bound every vector not met yet, and reading stops once that bound is below the k-th score. Each query
first meets one block alone; the k-th score found there is a bound that holds for all blocks, so that they are left as
soon as nothing in them can reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laminara.llm.common import Stored, arrow_rows, read_table, small_batches

#: Vectors and queries in a block, about.
BLOCK, QUERY_BLOCK = 4096, 512
FIRST_STEP = 16


def whole_vectors(table: DataFrame, id_: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, v): components as floor(scale * x), for every row but those with a null id, a null or empty vector, or null
    or non-finite components, which take no part. Rows that share an id stay apart."""
    rows = table.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("x")).where("id is not null and size(x) > 0")
    rows = rows.where("not exists(x, c -> c is null or isnan(c) or abs(cast(c as double)) = double('infinity'))")
    return rows.select("id", F.expr(f"transform(x, c -> cast(floor({scale}D * cast(c as double)) as bigint))").alias("v"))


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact. Beyond 64 bits they wrap around."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(q).max() or 1) * len(q) < 2.0**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


class Lists:
    """The sorted lists of one block of vectors; rows are in order of id, so that ties fall to smaller ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None, down: np.ndarray | None = None) -> None:
        rows = ids if rows is None else rows
        if down is None:
            order = np.lexsort((rows, ids))
            ids, x, rows = ids[order], x[order], rows[order]
            down = np.argsort(-x, axis=0, kind="stable")
        self.ids, self.x, self.rows, self.down = ids, x, rows, down
        self.up = self.down[::-1]
        big = float(np.abs(x).max()) if len(x) else 0.0
        self.plain = self.x.astype(np.float64) if big < 2.0**40 else None

    def top(self, own: int, q: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k vectors but row ``own``, best first, ties to smaller ids; scores below ``floor``
        may be left out."""
        n = len(self.ids)
        pos, neg = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        exact = self.plain is not None and float(np.abs(self.plain).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q) < 2.0**53
        if not exact or not len(pos) + len(neg):
            score, met = inner(self.x, q), np.ones(n, bool)
            return self.best(score, met, own, k)
        qf = q.astype(np.float64)
        met, score = np.zeros(n, bool), np.zeros(n)
        depth, step = 0, FIRST_STEP
        while depth < n:
            to = min(n, depth + step)
            new = np.zeros(n, bool)
            new[self.down[depth:to, pos].ravel()] = True
            new[self.up[depth:to, neg].ravel()] = True
            new &= ~met
            at = np.flatnonzero(new)
            score[at] = self.plain[at] @ qf
            met[at] = True
            depth, step = to, step * 2
            if met.all():
                break
            bound = (qf[pos] * self.plain[self.down[depth - 1, pos], pos]).sum() + (qf[neg] * self.plain[self.up[depth - 1, neg], neg]).sum()
            if bound < floor:
                break
            got = score[met & (self.rows != own)]
            if len(got) >= k and np.partition(got, len(got) - k)[len(got) - k] > bound:
                break
        return self.best(score.astype(np.int64), met, own, k)

    def best(self, score: np.ndarray, met: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(met & (self.rows != own))
        if len(at) > k:
            kth = np.partition(score[at], len(at) - k)[len(at) - k]
            at = at[score[at] >= kth]
        at = at[np.lexsort((self.ids[at], -score[at]))][:k]
        return self.ids[at], score[at]


LISTS = "dim int, b int, ids binary, rows binary, x binary, down binary"
ASKED = "dim int, qids binary, qrows binary, qx binary, floors binary"


def sorted_lists(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row for each block of vectors (id, row, v, dim) of one length: its arrays and sorted lists."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(t.v.to_list()).astype(np.int64)
        lists = Lists(t.id.to_numpy(np.int64), x, t.row.to_numpy(np.int64))
        return pd.DataFrame({"dim": [x.shape[1]], "b": [t.b.iloc[0]], "ids": [lists.ids.tobytes()], "rows": [lists.rows.tobytes()], "x": [lists.x.tobytes()], "down": [lists.down.astype(np.int32).tobytes()]})

    dealt = vectors.withColumn("b", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "b").applyInPandas(run, LISTS)


def asked(queries: DataFrame, blocks: int) -> DataFrame:
    """One row for each block of queries (id, row, v, dim, floor) of one length."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(t.v.to_list()).astype(np.int64)
        floors = t.floor.fillna(-np.inf).to_numpy(np.float64)
        return pd.DataFrame({"dim": [x.shape[1]], "qids": [t.id.to_numpy(np.int64).tobytes()], "qrows": [t.row.to_numpy(np.int64).tobytes()], "qx": [x.tobytes()], "floors": [floors.tobytes()]})

    dealt = queries.withColumn("qb", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "qb").applyInPandas(run, ASKED)


def met(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, query_row, vec_id, score): the best k of each query in the block of vectors of the same row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            for r in t.itertuples():
                long = lambda raw: np.frombuffer(raw, np.int64)
                found = Lists(long(r.ids), long(r.x).reshape(-1, r.dim), long(r.rows), np.frombuffer(r.down, np.int32).reshape(-1, r.dim))
                out = []
                for qid, row, q, floor in zip(long(r.qids), long(r.qrows), long(r.qx).reshape(-1, r.dim), np.frombuffer(r.floors), strict=True):
                    ids, scores = found.top(row, q, k, floor)
                    keep = scores >= floor
                    out.append(pd.DataFrame({"query_id": qid, "query_row": row, "vec_id": ids[keep], "score": scores[keep]}))
                yield pd.concat(out)

    return pairs.mapInPandas(run, "query_id long, query_row long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: str, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that satisfies ``queries`` its ``k`` best other rows, or all if fewer.

    ``vectors`` is (id, v) as from ``whole_vectors``; rows may share an id, and a query leaves out its own row only.
    Queries meet vectors of the same length only. An empty table gives an empty result. Every vector is met by every
    query, in blocks of bounded size; what leaves a task is k rows for each of its queries.
    """
    spark = vectors.sparkSession
    stored = Stored(vectors.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    blocks = max(1, -(-stored.df.count() // BLOCK))
    wanted = stored.df.where(queries)
    query_blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    lists = Stored(sorted_lists(stored.df, blocks))
    arrow_rows(spark, 1)  # a row is a block
    first = lists.df.join(lists.df.groupBy("dim").agg(F.min("b").alias("b")), ["dim", "b"])
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    asks = Stored(asked(wanted.withColumn("floor", F.lit(None).cast("double")), query_blocks))
    # One block of vectors for each length of vectors is broadcast, BLOCK vectors each.
    seen = met(asks.df.repartition(query_blocks, "qids").join(F.broadcast(first), "dim"), k)
    floors = seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"))
    questions = Stored(asked(wanted.join(floors, "row", "left"), query_blocks))
    # The queries go to every block of vectors, which are the keys of the join and come once each.
    everywhere = questions.df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = Stored(met(lists.df.hint("merge").join(everywhere, ["dim", "b"]), k))
    for t in (stored, lists, asks, questions):
        t.drop()
    small_batches(spark)
    return near.df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 5 best of all vectors for every vector whose id is divisible by 50."""
    v = whole_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(v, "id % 50 = 0")


OP4_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.own <> c.own AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
