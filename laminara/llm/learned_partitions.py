"""Nearest neighbours by cosine through learned partitions.

On a bounded sample the graph of nearest neighbours is cut into balanced parts: halves by a slow vector of the random
walk over the graph, mended by swaps that remove cut edges, then halves of the halves. A small classifier learns which
parts a vector's neighbours lie in. It deals every row to its likeliest part, and routes a query to parts in order of
probability until their sum reaches a level measured on held-out rows of the sample. A part with too many rows is split
once more, by a classifier of its own. Rows of the parts that a query reaches are ranked by exact cosines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laminara.llm.common import Stored, arrow_rows, read_table, small_batches

#: Rows that a classifier and its graph are fitted on, about; neighbours of each in the graph.
SAMPLE, LINKS = 8192, 10
#: Rows in a part that the first level aims at; parts at most; rows above which a part is split once more.
PART_ROWS, MOST_PARTS, SPLIT_ROWS = 512, 256, 65_536
#: Share of held-out links that routing must reach, over both levels.
TARGET = 0.95
HIDDEN, EPOCHS, BATCH, RATE = 64, 20, 256, 0.003
#: Rows of a block of vectors and of a block of queries.
BLOCK, QUERY_BLOCK = 4096, 512
#: Cosines this close are ranked by a sum in fixed order.
NEAR = 1e-9


def usable(table: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, x) with x in double precision, for every row but those with a null id, and vectors that are null, empty, zero or
    hold null or non-finite components, which take no part."""
    rows = table.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("id is not null and size(x) > 0")
    rows = rows.where("not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    return rows.where("exists(x, c -> c <> 0)")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that very large or small components don't overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def links(u: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, a stripe of rows at a time."""
    out = []
    for a in range(0, len(u), 1024):
        g = u[a : a + 1024] @ u.T
        g[np.arange(len(g)), np.arange(a, a + len(g))] = -np.inf
        out.append(np.argpartition(-g, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def halved(a: np.ndarray, b: np.ndarray, part: np.ndarray, rng: np.random.Generator, walks: int = 30, swaps: int = 12) -> np.ndarray:
    """Every part cut into two halves of equal size (but for one row) with few links (a, b) between them."""
    n, parts = len(part), int(part.max()) + 1
    inside = part[a] == part[b]
    a, b = a[inside], b[inside]
    degree = np.maximum(np.bincount(a, minlength=n), 1).astype(float)
    sizes, mass = np.bincount(part, minlength=parts), np.bincount(part, degree, parts)
    y = rng.standard_normal(n)
    for _ in range(walks):  # what a lazy walk forgets last, within each part
        y = (y + np.bincount(a, y[b], n) / degree) / 2
        y -= (np.bincount(part, y * degree, parts) / mass)[part]
        y /= np.sqrt(np.bincount(part, y * y, parts) / sizes + 1e-300)[part]

    def ranked(key: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((*by, key))
        first = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=2 * parts))])
        return order, np.arange(n) - first[key[order]]

    order, rank = ranked(part, y)
    side = np.empty(n, np.int64)
    side[order] = rank >= (sizes[part[order]] + 1) // 2
    for _ in range(swaps):
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), n)
        order, rank = ranked(2 * part + side, rng.random(n), -gain)
        left, right = order[side[order] == 0], order[side[order] == 1]
        lrank, rrank = rank[side[order] == 0], rank[side[order] == 1]
        key = part[right] * n + rrank  # the i-th of one side may change places with the i-th of the other
        if not len(key):
            break
        at = np.minimum(np.searchsorted(key, part[left] * n + lrank), len(key) - 1)
        met = key[at] == part[left] * n + lrank
        left, right = left[met], right[at[met]]
        good = (gain[left] + gain[right] > 0) & (rng.random(len(left)) < 0.5)
        side[left[good]], side[right[good]] = 1, 0
    return 2 * part + side


def share(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Router:
    """One hidden layer over unit vectors; ``level`` is the probability that routing has to gather."""

    def __init__(self, weights: list[np.ndarray], level: float = 1.0) -> None:
        self.weights, self.level = weights, level

    def shares(self, u: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return share(np.maximum((u * np.sqrt(u.shape[1])).astype(np.float32) @ w1 + b1, 0) @ w2 + b2).astype(np.float64)

    def routes(self, u: np.ndarray) -> np.ndarray:
        """For each row the parts that it is routed to, as booleans: likeliest first, until their sum reaches the level."""
        p = self.shares(u)
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_ = np.take_along_axis(p, order, 1)
        out = np.empty(p.shape, bool)
        np.put_along_axis(out, order, np.cumsum(sorted_, axis=1) - sorted_ <= self.level, 1)
        return out

    def dealt(self, u: np.ndarray) -> np.ndarray:
        return self.shares(u).argmax(1)


def trained(u: np.ndarray, wanted: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Weights fitted to the shares ``wanted`` by gradients with running moments."""
    dim, parts = u.shape[1], wanted.shape[1]
    w = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    w = [x.astype(np.float32) for x in w]
    one, two = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    x, y, step = (u * np.sqrt(dim)).astype(np.float32), wanted.astype(np.float32), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in np.array_split(order, -(-len(x) // BATCH)):
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            g = (share(h @ w[2] + w[3]) - y[at]) / len(at)
            back = (g @ w[2].T) * (h > 0)
            step += 1
            for v, d, m, s in zip(w, (x[at].T @ back, back.sum(0), h.T @ g, g.sum(0)), one, two, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                v -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w


def fitted(u: np.ndarray, halvings: int, target: float) -> Router:
    """A router with 2**halvings parts from the unit rows of a sample."""
    rng = np.random.default_rng(len(u))
    k = min(LINKS, len(u) - 1)
    near = links(u, k)
    a, b = np.repeat(np.arange(len(u)), k), near.ravel()
    part = np.zeros(len(u), np.int64)
    for _ in range(halvings):
        part = halved(np.concatenate([a, b]), np.concatenate([b, a]), part, rng)
    wanted = np.zeros((len(u), 2**halvings))
    np.add.at(wanted, (a, part[b]), 0.5 / k)
    wanted[np.arange(len(u)), part] += 0.5
    held = rng.random(len(u)) < 0.125
    held[:1], held[1:2] = True, False
    router = Router(trained(u[~held], wanted[~held], rng))
    # The probability gathered before a held-out row's link is reached; enough of the links must come before the level.
    p = router.shares(u[held])
    order = np.argsort(-p, axis=1, kind="stable")
    sorted_ = np.take_along_axis(p, order, 1)
    before = np.empty_like(p)
    np.put_along_axis(before, order, np.cumsum(sorted_, axis=1) - sorted_, 1)
    reached = np.take_along_axis(before, router.dealt(u)[near[held]], 1)
    router.level = float(np.quantile(reached, target, method="higher"))
    return router


MODEL = "node string, dim int, parts int, level double, weights binary"


def fit(sample: DataFrame, target: float) -> dict[str, Router]:
    """A router for each node of ``sample`` (node, dim, halvings, x), a bounded number of rows each; fitted in Spark, a
    node to a task. Routers hold (dim + parts) * HIDDEN numbers about and come to the driver, to be broadcast."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        made = fitted(unit(np.stack(t.x.to_list())), int(t.halvings.iloc[0]), target)
        raw = b"".join(w.astype(np.float32).tobytes() for w in made.weights)
        return pd.DataFrame({"node": [t.node.iloc[0]], "dim": [t.dim.iloc[0]], "parts": [made.weights[3].size], "level": [made.level], "weights": [raw]})

    out = {}
    for r in sample.groupBy("node").applyInPandas(run, MODEL).collect():
        sizes = [(r.dim, HIDDEN), (HIDDEN,), (HIDDEN, r.parts), (r.parts,)]
        flat, cuts = np.frombuffer(r.weights, np.float32), np.cumsum([int(np.prod(s)) for s in sizes])
        out[r.node] = Router([w.reshape(s) for w, s in zip(np.split(flat, cuts[:-1]), sizes, strict=True)], r.level)
    return out


def dealt(rows: DataFrame, models: dict[str, Router], query: bool) -> DataFrame:
    """``rows`` (cls, x, node) at the nodes of the next level: one for each row, or all on the routes of a query."""
    shipped = rows.sparkSession.sparkContext.broadcast(models)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            for node, g in t.groupby("node"):
                router = shipped.value.get(node)
                if router is None:
                    yield g
                    continue
                u = unit(np.stack(g.x.to_list()))
                at, part = np.nonzero(router.routes(u)) if query else (np.arange(len(g)), router.dealt(u))
                for a in range(0, len(at), 8192):
                    yield g.iloc[at[a : a + 8192]].assign(node=[f"{node}.{p}" for p in part[a : a + 8192]])

    return rows.select("cls", "x", "node").mapInPandas(run, "cls long, x array<double>, node string")


def sampled(rows: DataFrame, sizes: DataFrame, part_rows: int) -> DataFrame:
    """About SAMPLE rows of each node of ``sizes`` (node, n), by hash, with the number of halvings that suits its size."""
    halvings = F.least(F.floor(F.log2(F.col("n") / part_rows)), F.lit(int(np.log2(MOST_PARTS)))).cast("int")
    picked = rows.join(F.broadcast(sizes), "node").where(F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(SAMPLE) / F.col("n")) * (1 << 30))
    return picked.select("node", F.size("x").alias("dim"), halvings.alias("halvings"), "x").where("halvings > 0")


PACKED = "node string, b int, dim int, classes binary, x binary"


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each block of ``rows`` (node, b, cls, x), with its vectors in the order of classes."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("cls")
        x = np.stack(t.x.to_list())
        return pd.DataFrame({"node": [t.node.iloc[0]], "b": [int(t.b.iloc[0])], "dim": [x.shape[1]], "classes": [t.cls.to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})

    return rows.groupBy(*keys).applyInPandas(run, PACKED)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(query, cls, score): the best k classes of each query (with ties) among the block of vectors of the same row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            for r in t.itertuples():
                long, real = (lambda raw: np.frombuffer(raw, np.int64)), (lambda raw, d=r.dim: np.frombuffer(raw).reshape(-1, d))
                ids, x, asks, q = long(r.classes), real(r.x), long(r.asks), real(r.q)
                near, u = unit(q) @ unit(x).T, None
                for i in range(len(q)):
                    at = np.arange(len(ids))
                    if len(ids) > k:
                        at = np.flatnonzero(near[i] >= np.partition(near[i], len(ids) - k)[len(ids) - k] - NEAR)
                    yield pd.DataFrame({"query": asks[i], "cls": ids[at], "score": cosines(q[i], x[at])})

    return pairs.mapInPandas(run, "query long, cls long, score double")


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products over lengths, each summed in the same order, whatever block a vector lies in."""
    with np.errstate(all="ignore"):
        lengths = np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1))
        out = (x * q).sum(1) / lengths
    odd = ~np.isfinite(out + lengths) | (lengths < 1e-290)
    if odd.any():  # very large or small components
        a, b = unit(q[None])[0], unit(x[odd])
        out[odd] = (b * a).sum(1)
    return out


def nearest(vectors: DataFrame, queries: str, k: int = 5, part_rows: int = 0, split_rows: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (id, x) that satisfies ``queries`` the ``k`` nearest other
    rows found, or all if fewer; ties to the smaller id. An empty table gives an empty result.

    Equal vectors are one class, which keeps the ids of its k + 1 first rows: no more of them can come into a result. So a
    vector that a third of all rows hold is searched for once and met once. Rows that share an id stay apart; a query
    leaves out its own row only. Queries meet vectors of the same length only.
    """
    spark = vectors.sparkSession
    part_rows, split_rows = part_rows or PART_ROWS, split_rows or SPLIT_ROWS
    rows = Stored(vectors.withColumn("row", F.monotonically_increasing_id()).withColumns({"h": F.xxhash64("x"), "g": F.xxhash64(F.lit(1), "x")}))
    first = Window.partitionBy("h", "g").orderBy("id", "row")
    some = rows.df.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    classes = some.groupBy("h", "g").agg(F.min("row").alias("cls"), F.min_by("x", "row").alias("x"), F.array_sort(F.collect_list(F.struct("id", "row"))).alias("members"))
    classes = Stored(classes.withColumn("node", F.size("x").cast("string")))
    asking = Stored(rows.df.where(queries).select("id", "row", "h", "g").join(classes.df.select("h", "g", "cls"), ["h", "g"]).select("id", "row", "cls"))
    small_batches(spark)
    # Down the levels: a node with enough rows is split by a router of its own.
    leaves, asks = classes.df.select("cls", "x", "node"), classes.df.join(asking.df.select("cls").distinct(), "cls").select("cls", "x", "node")
    sizes = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    one_level = sizes.where(F.col("n") > split_rows * MOST_PARTS // 2).isEmpty()
    stored = [rows]
    for least in (2 * part_rows, split_rows):
        sample = sampled(leaves, sizes.where(F.col("n") >= least), part_rows)
        models = fit(sample, TARGET if one_level else TARGET**0.5)
        if not models:
            break
        leaves, asks = Stored(dealt(leaves, models, False)), Stored(dealt(asks, models, True))
        stored += [leaves, asks]
        leaves, asks = leaves.df, asks.df
        sizes = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    # Blocks of leaves meet blocks of the queries routed there.
    sizes = Stored(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).select("node", "blocks"))
    salt = lambda seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col("blocks")).cast("int")
    index = packed(leaves.join(F.broadcast(sizes.df), "node").withColumn("b", salt(1)), ["node", "b"])
    asked = asks.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    asked = packed(asks.join(F.broadcast(asked), "node").withColumn("b", salt(2)), ["node", "b"])
    asked = asked.select("node", F.col("classes").alias("asks"), F.col("x").alias("q")).join(F.broadcast(sizes.df), "node")
    asked = asked.select("node", "asks", "q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    arrow_rows(spark, 1)  # a row is a block
    index = Stored(index)
    found = Stored(ranked(index.df.hint("merge").join(asked, ["node", "b"]), k + 1))
    small_batches(spark)
    # The k + 1 best rows of each class of queries, then each query without its own row.
    members = found.df.join(classes.df.select("cls", "members"), "cls").select("query", "score", F.col("members")[0]["id"].alias("id"), "members")
    best = members.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("at") <= k + 1)
    flat = best.select("query", F.inline(F.transform("members", lambda m: F.struct((-F.col("score")).alias("less"), m["id"].alias("id"), m["row"].alias("row")))))
    lists = flat.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("less", "id", "row"))), 1, k + 1).alias("near"))
    answers = asking.df.join(lists.withColumnRenamed("query", "cls"), "cls")
    own = answers.select(F.col("id").alias("query_id"), F.expr(f"slice(filter(near, m -> m.row <> row), 1, {k})").alias("near"))
    for t in (*stored, index):
        t.drop()
    return own.select("query_id", F.posexplode("near").alias("at", "m")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("m.id").alias("vec_id"), (-F.col("m.less")).alias("score"))


def op11_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 5 nearest of all vectors for every vector whose id is divisible by 50."""
    return nearest(usable(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "id % 50 = 0")
