"""Piecewise-affine warps: each pixel of the result lies in a triangle of moved nodes and is read, by interpolation
between four pixels, from where the triangle was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.operators.mesh import Lattice, node, nodes, weights


def triangles(spark: SparkSession, m: Lattice) -> DataFrame:
    """(ka, kb, kc): over and under each link of a row, and at the ends of odd rows."""
    cols = m.dims[1]
    i, j = F.col("i"), F.col("j")
    odd = i % 2 == 1
    beside = node(m, i, j + 1)
    apex = lambda d: node(m, i + d, F.when(odd, j).otherwise(j + 1))
    below = node(m, i + 2, j)
    edge = F.when(odd & (j == 1), node(m, i + 1, j)).when(odd & (j == cols), node(m, i + 1, j - 1))
    three = lambda b, c: F.when(b.isNotNull() & c.isNotNull(), F.struct(F.col("node").alias("ka"), b.alias("kb"), c.alias("kc")))
    found = F.array_compact(F.array(three(beside, apex(1)), three(beside, apex(-1)), three(below, edge)))
    return nodes(spark, m).select(F.explode(found).alias("t")).select("t.*")


def warp(px: DataFrame, tri: DataFrame, place: DataFrame, height: int, width: int, interpolate: bool = True) -> DataFrame:
    """(z, i, j, px) of ``px`` moved by ``place`` (z, node, src_i, src_j, dst_i, dst_j).

    Swap src and dst for the inverse. Only pixels inside 1..height and 1..width come out; what nothing maps to is
    left out and so zero. A pixel on an edge between triangles is taken once.
    """
    t = tri
    for k in "abc":
        at = place.select("z", F.col("node").alias(f"k{k}"), *(F.col(c).alias(f"{k}_{c}") for c in ("src_i", "src_j", "dst_i", "dst_j")))
        t = t.join(at, ["z", f"k{k}"] if k != "a" else [f"k{k}"])
    lowest = lambda c: F.greatest(F.lit(1), F.ceil(F.least(*(f"{k}_dst_{c}" for k in "abc")) - 1e-9).cast("int"))
    highest = lambda c, size: F.least(F.lit(size), F.floor(F.greatest(*(f"{k}_dst_{c}" for k in "abc")) + 1e-9).cast("int"))
    span = lambda c, size: F.when(lowest(c) <= highest(c, size), F.sequence(lowest(c), highest(c, size), F.lit(1)))
    grid = t.withColumn("i", F.explode(span("i", height))).withColumn("j", F.explode(span("j", width)))
    w = weights(F.col("i").cast("double"), F.col("j").cast("double"), *(F.col(f"{k}_dst_{c}") for k in "abc" for c in "ij"))
    grid = grid.withColumns({"wa": w[0], "wb": w[1], "wc": w[2]}).where("wa >= -1e-9 and wb >= -1e-9 and wc >= -1e-9")
    src = lambda c: F.round(sum((F.col(f"w{k}") * F.col(f"{k}_src_{c}") for k in "bc"), F.col("wa") * F.col(f"a_src_{c}")), 9)
    hit = grid.select("z", "i", "j", F.struct(src("i").alias("si"), src("j").alias("sj")).alias("s")).groupBy("z", "i", "j").agg(F.min("s").alias("s")).select("z", "i", "j", "s.*")
    if not interpolate:
        near = hit.select("z", F.col("i").alias("ti"), F.col("j").alias("tj"), F.rint("si").cast("int").alias("i"), F.rint("sj").cast("int").alias("j"))
        return near.join(px, ["z", "i", "j"]).select("z", F.col("ti").alias("i"), F.col("tj").alias("j"), "px")
    fi, fj = F.col("si") - F.floor("si"), F.col("sj") - F.floor("sj")
    four = F.explode(F.array(*(F.struct((F.floor("si") + a).cast("int").alias("i"), (F.floor("sj") + b).cast("int").alias("j"), ((fi if a else 1 - fi) * (fj if b else 1 - fj)).alias("w")) for a in (0, 1) for b in (0, 1)))).alias("q")
    parts = hit.select("z", F.col("i").alias("ti"), F.col("j").alias("tj"), four).select("z", "ti", "tj", "q.*").where("w > 0")
    out = parts.join(px, ["z", "i", "j"]).groupBy("z", "ti", "tj").agg(F.sum(F.col("w") * F.col("px")).alias("v"))
    return out.select("z", F.col("ti").alias("i"), F.col("tj").alias("j"), F.rint(F.round("v", 6)).cast("int").alias("px"))
