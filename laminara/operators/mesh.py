"""Triangular lattices: nodes, edges, location of points, barycentric weights, deformation. All in expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIN60, TAN60 = math.sin(math.pi / 3), math.tan(math.pi / 3)


@dataclass(frozen=True)
class Lattice:
    """Rows of nodes ``length`` apart that cover an image with one node to spare; even rows are shifted by half."""

    height: float
    width: float
    length: float

    @property
    def pitch(self) -> tuple[float, float]:
        return self.length * SIN60, self.length

    @property
    def dims(self) -> tuple[int, int]:
        return int(self.height // self.pitch[0]) + 3, int(self.width // self.pitch[1]) + 3

    @property
    def origin(self) -> tuple[float, float]:
        return math.fmod(self.height, self.pitch[0]) / 2 - self.pitch[0], math.fmod(self.width, self.pitch[1]) / 2 - self.pitch[1]

    @property
    def count(self) -> int:
        rows, cols = self.dims
        return (rows + 1) // 2 * cols + rows // 2 * (cols - 1)


def exists(m: Lattice, i: Column, j: Column) -> Column:
    rows, cols = m.dims
    return i.between(1, rows) & j.between(1, cols) & ~((i % 2 == 0) & (j == cols))


def node(m: Lattice, i: Column, j: Column) -> Column:
    """Number of a node; null where there is none."""
    cols = m.dims[1]
    k = F.floor((i - 1) / 2) * (cols - 1) + F.floor(i / 2) * cols + j
    return F.when(exists(m, i, j), k.cast("int"))


def coordinate(m: Lattice, i: Column, j: Column) -> tuple[Column, Column]:
    (d1, d2), (o1, o2) = m.pitch, m.origin
    return F.lit(o1) + (i - 1) * F.lit(d1), F.lit(o2) + F.when(i % 2 == 1, (j - 1.0) * F.lit(d2)).otherwise((j - 0.5) * F.lit(d2))


def nodes(spark: SparkSession, m: Lattice) -> DataFrame:
    """(node, i, j, src_i, src_j) of all nodes."""
    rows, cols = m.dims
    grid = spark.range(1, rows + 1).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(cols))).alias("j"))
    x, y = coordinate(m, F.col("i"), F.col("j"))
    return grid.where(exists(m, F.col("i"), F.col("j"))).select(node(m, F.col("i"), F.col("j")).alias("node"), "i", "j", x.alias("src_i"), y.alias("src_j"))


def edges(spark: SparkSession, m: Lattice) -> DataFrame:
    """(a, b): from each node to those before it in its row and in the rows above."""
    cols = m.dims[1]
    i, j = F.col("i"), F.col("j")
    even, odd = i % 2 == 0, i % 2 == 1
    link = lambda cond, a, b: F.when(cond, node(m, a, b))
    ends = F.array_compact(F.array(
        link(j != 1, i, j - 1), link((i != 1) & (even | (j != cols)), i - 1, j), link((i != 1) & even & (j != cols), i - 1, j + 1),
        link((i != 1) & odd & (j != 1), i - 1, j - 1), link((i != 1) & odd & ((j == 1) | (j == cols)), i - 2, j),
    ))
    return nodes(spark, m).select(F.col("node").alias("a"), F.explode(ends).alias("b"))


def locate(m: Lattice, x: Column, y: Column) -> Column:
    """struct<k0, ka, kb> of the triangle that holds a point, null where there is none."""
    (d1, d2), (o1, o2) = m.pitch, m.origin
    p1, p2 = x - o1, y - o2
    i0 = F.rint(p1 / d1 + 1).cast("int")
    j0 = F.when(i0 % 2 == 1, F.rint(p2 / d2 + 1)).otherwise(F.rint(p2 / d2 + 0.5)).cast("int")
    raw = F.array(F.struct(x.alias("x"), y.alias("y"), i0.alias("i"), j0.alias("j")))

    def corner(t: Column) -> Column:
        i, j = t["i"], t["j"]
        cx, cy = coordinate(m, i, j)
        r1, r2 = t["x"] - cx, t["y"] - cy
        s = F.when(r1 >= 0, 1).otherwise(-1)
        even = i % 2 == 0
        side, right = F.abs(r1) < F.lit(TAN60) * F.abs(r2), r2 >= 0
        n = lambda a, b: node(m, a, b)
        a = (
            F.when(side & right, F.coalesce(n(i, j + 1), F.when(even, n(i - s, j + 1))))
            .when(side, F.coalesce(n(i, j - 1), F.when(even, n(i - s, j))))
            .when(even, n(i + s, j))
            .otherwise(F.coalesce(n(i + s, j - 1), n(i + 2 * s, j)))
        )
        b = (
            F.when(side & right, F.when(even, n(i + s, j + 1)).otherwise(n(i + s, j)))
            .when(side, F.when(even, n(i + s, j)).otherwise(n(i + s, j - 1)))
            .when(even, n(i + s, j + 1))
            .otherwise(F.coalesce(n(i + s, j), n(i + 2 * s, j)))
        )
        k0 = n(i, j)
        found = F.struct(k0.alias("k0"), a.alias("ka"), b.alias("kb"))
        return F.when(k0.isNotNull() & a.isNotNull() & b.isNotNull(), found)

    # Bound to a name once by transform, or the nested cases would repeat the arithmetic.
    return F.element_at(F.transform(raw, corner), 1)


def node_place(m: Lattice, k: Column) -> tuple[Column, Column]:
    """Row and column of a node's number."""
    cols = m.dims[1]
    pair = 2 * cols - 1
    q, rest = F.floor((k - 1) / pair), F.pmod(k - 1, F.lit(pair))
    return (2 * q + F.when(rest >= cols, 2).otherwise(1)).cast("int"), (F.when(rest >= cols, rest - cols).otherwise(rest) + 1).cast("int")


def weights(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """Barycentric weights of (x, y) in the triangle a, b, c."""
    det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    w0 = ((by - cy) * (x - cx) + (cx - bx) * (y - cy)) / det
    w1 = ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / det
    return w0, w1, 1 - w0 - w1


def located(points: DataFrame, m: Lattice, x: str, y: str) -> DataFrame:
    """``points`` with k0, ka, kb and w0, wa, wb; points without a triangle are left out."""
    # An explode is worked out once; a column would be by the filter and by what comes after it.
    found = points.select(*points.columns, F.explode(F.array_compact(F.array(locate(m, F.col(x), F.col(y))))).alias("_t")).select(*points.columns, "_t.*")
    xy = [c for k in ("k0", "ka", "kb") for c in coordinate(m, *node_place(m, F.col(k)))]
    w = weights(F.col(x), F.col(y), *xy)
    return found.withColumns({"w0": w[0], "wa": w[1], "wb": w[2]})


def deform(points: DataFrame, m: Lattice, moved: DataFrame, id_: str, x: str, y: str) -> DataFrame:
    """(id, dst_i, dst_j): weighted sums of the moved places (node, dst_i, dst_j) of each point's triangle."""
    three = F.explode(F.array(*(F.struct(F.col(k).alias("node"), F.col(w).alias("w")) for k, w in (("k0", "w0"), ("ka", "wa"), ("kb", "wb"))))).alias("t")
    spread = located(points, m, x, y).select(id_, three).select(id_, "t.*")
    return spread.join(moved, "node").groupBy(id_).agg(F.sum(F.col("w") * F.col("dst_i")).alias("dst_i"), F.sum(F.col("w") * F.col("dst_j")).alias("dst_j"))


def edge_ends(edge: DataFrame, place: DataFrame, i: str = "src_i", j: str = "src_j", keys: list[str] | None = None) -> DataFrame:
    """(keys, a, b, a_i, a_j, b_i, b_j, mid_i, mid_j, length); ``keys`` tell meshes apart where there are many."""
    keys = keys or []
    at = lambda p: place.select(*keys, F.col("node").alias(p), F.col(i).alias(f"{p}_i"), F.col(j).alias(f"{p}_j"))
    out = edge.join(at("a"), [*keys, "a"]).join(at("b"), [*keys, "b"])
    return out.select(*keys, "a", "b", "a_i", "a_j", "b_i", "b_j", ((F.col("a_i") + F.col("b_i")) / 2).alias("mid_i"), ((F.col("a_j") + F.col("b_j")) / 2).alias("mid_j"), F.hypot(F.col("a_i") - F.col("b_i"), F.col("a_j") - F.col("b_j")).alias("length"))


def dims_of(place: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows, columns and pitches recovered from the list of nodes (src_i, src_j), for each of ``keys``."""
    keys = keys or []
    rows = place.groupBy(*keys, F.round("src_i", 6).alias("row")).agg(F.count(F.lit(1)).alias("n"), F.min("src_j").alias("lo"), F.max("src_j").alias("hi"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("cols"), ((F.max("row") - F.min("row")) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("pitch_i"), F.max((F.col("hi") - F.col("lo")) / F.nullif(F.col("n") - 1, F.lit(0))).alias("pitch_j"))
