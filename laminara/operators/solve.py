"""Spring systems and transforms: energy and forces as aggregates, fits by normal equations, relaxation by group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def spring_vectors(springs: DataFrame, ends: DataFrame, place: DataFrame) -> DataFrame:
    """``springs`` (spring, k, rest) with the summed vector (s_i, s_j) and length of each.

    ``ends`` (spring, node, val) is the incidence with signs and weights, ``place`` (node, i, j).
    """
    s = ends.join(place, "node").groupBy("spring").agg(F.sum(F.col("val") * F.col("i")).alias("s_i"), F.sum(F.col("val") * F.col("j")).alias("s_j"))
    return springs.join(s, "spring").withColumn("length", F.sqrt(F.col("s_i") * F.col("s_i") + F.col("s_j") * F.col("s_j")) + TINY)


def energy(vectors: DataFrame) -> DataFrame:
    stretch = F.col("length") - F.col("rest")
    return vectors.agg(F.sum(0.5 * F.col("k") * stretch * stretch).alias("energy"))


def gradient(vectors: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, g_i, g_j)."""
    f = lambda c: F.col("k") * (F.col(c) - F.col(c) * F.col("rest") / F.col("length"))
    force = vectors.select("spring", f("s_i").alias("f_i"), f("s_j").alias("f_j"))
    return ends.join(force, "spring").groupBy("node").agg(F.sum(F.col("val") * F.col("f_i")).alias("g_i"), F.sum(F.col("val") * F.col("f_j")).alias("g_j"))


def relax(x0: np.ndarray, fixed: np.ndarray, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, k: np.ndarray, rest: np.ndarray, max_iters: int = 4000, ftol: float = 1e-6) -> tuple[np.ndarray, int]:
    """Polak-Ribiere conjugate gradients with a backtracking search; the best places seen, and the iterations.

    rows, cols, vals: node, spring and value of the incidence.
    """
    x = x0.astype(float).copy()
    free = ~fixed
    n = len(k)

    def at(y: np.ndarray) -> tuple[float, np.ndarray]:
        s = np.stack([np.bincount(cols, vals * y[rows, a], minlength=n) for a in (0, 1)], 1)
        length = np.sqrt((s * s).sum(1)) + TINY
        e = float((0.5 * k * (length - rest) ** 2).sum())
        f = (k * (1 - rest / length))[:, None] * s
        g = np.stack([np.bincount(rows, vals * f[cols, a], minlength=len(y)) for a in (0, 1)], 1)
        g[~free] = 0
        return e, g

    e, g = at(x)
    d, step, it = -g, 1.0 / max(1e-12, float(k.max(initial=1.0)) * 8), 0
    for it in range(1, max_iters + 1):  # noqa: B007
        slope = float((g * d).sum())
        if slope >= 0:
            d, slope = -g, -float((g * g).sum())
        if slope == 0:
            break
        step *= 2
        while True:
            y = x + step * d
            e2, g2 = at(y)
            if e2 <= e + 1e-4 * step * slope or step < 1e-18:
                break
            step /= 2
        if e2 >= e:
            break
        small = abs(e - e2) <= ftol * max(abs(e), TINY)
        beta = max(0.0, float((g2 * (g2 - g)).sum()) / max(float((g * g).sum()), 1e-300))
        x, e, d, g = y, e2, -g2 + beta * d, g2
        if small:
            break
    return x, it


SYSTEM = "block long, node long, dst_i double, dst_j double, energy_before double, energy_after double, iters int"


def relax_blocks(nodes: DataFrame, ends: DataFrame, max_iters: int = 4000, ftol: float = 1e-6) -> DataFrame:
    """Relax each block of sections on its own.

    nodes: block, node, i, j, fixed. ends: block, spring, node, val, k, rest. A block is a bounded run of sections, so
    it fits a task; the blocks run side by side.
    """

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("node")
        b = b[b.node.isin(a.node)]
        spring, cols = np.unique(b.spring.to_numpy(), return_inverse=True)
        rows = np.searchsorted(a.node.to_numpy(), b.node.to_numpy())
        one = b.drop_duplicates("spring").sort_values("spring")
        k, rest = one.k.to_numpy(float), one.rest.to_numpy(float)
        x0 = a[["i", "j"]].to_numpy(float)

        def e(y: np.ndarray) -> float:
            s = np.stack([np.bincount(cols, b.val.to_numpy() * y[rows, c], minlength=len(spring)) for c in (0, 1)], 1)
            return float((0.5 * k * (np.sqrt((s * s).sum(1)) + TINY - rest) ** 2).sum())

        x, it = (relax(x0, a.fixed.to_numpy(bool), rows, cols, b.val.to_numpy(float), k, rest, max_iters, ftol)) if len(b) else (x0, 0)
        return pd.DataFrame({"block": key[0], "node": a.node.to_numpy(), "dst_i": x[:, 0], "dst_j": x[:, 1], "energy_before": e(x0), "energy_after": e(x), "iters": it})

    nodes, ends = nodes.toDF(*nodes.columns), ends.toDF(*ends.columns)  # both may come from one table
    return nodes.groupBy("block").cogroup(ends.groupBy("block")).applyInPandas(run, SYSTEM)


def moments(df: DataFrame, keys: list[str], p: tuple[str, str], q: tuple[str, str]) -> DataFrame:
    """Sums for least-squares fits of q from p, one row for each key."""
    a, b, x, y = F.col(p[0]), F.col(p[1]), F.col(q[0]), F.col(q[1])
    s = {"n": F.lit(1.0), "a": a, "b": b, "x": x, "y": y, "aa": a * a, "ab": a * b, "bb": b * b, "ax": a * x, "ay": a * y, "bx": b * x, "by": b * y}
    return df.groupBy(*keys).agg(*(F.sum(v).alias(f"s_{k}") for k, v in s.items()))


def affine(m: DataFrame) -> DataFrame:
    """Adds t11..t32 of (a, b, 1) T = (x, y), from ``moments``, by Cramer's rule on centred sums; null if they are flat."""
    n = F.col("s_n")
    c = lambda u, v: F.col(f"s_{u}{v}") - F.col(f"s_{u}") * F.col(f"s_{v}") / n
    det = c("a", "a") * c("b", "b") - c("a", "b") * c("a", "b")
    det = F.when(F.abs(det) > 1e-9, det)
    out = {}
    for k, v in ((1, "x"), (2, "y")):
        out[f"t1{k}"] = (c("a", v) * c("b", "b") - c("b", v) * c("a", "b")) / det
        out[f"t2{k}"] = (c("b", v) * c("a", "a") - c("a", v) * c("a", "b")) / det
    m = m.withColumns(out)
    return m.withColumns({f"t3{k}": (F.col(f"s_{v}") - F.col("s_a") * F.col(f"t1{k}") - F.col("s_b") * F.col(f"t2{k}")) / n for k, v in ((1, "x"), (2, "y"))})


def rigid(m: DataFrame) -> DataFrame:
    """The same for a rotation and a shift."""
    n = F.col("s_n")
    c = lambda u, v: F.col(f"s_{u}{v}") - F.col(f"s_{u}") * F.col(f"s_{v}") / n
    m = m.withColumn("theta", F.atan2(c("a", "y") - c("b", "x"), c("a", "x") + c("b", "y")))
    m = m.withColumns({"t11": F.cos("theta"), "t12": F.sin("theta"), "t21": -F.sin("theta"), "t22": F.cos("theta")})
    return m.withColumns({f"t3{k}": (F.col(f"s_{v}") - F.col("s_a") * F.col(f"t1{k}") - F.col("s_b") * F.col(f"t2{k}")) / n for k, v in ((1, "x"), (2, "y"))})


T = [f"t{r}{c}" for r in (1, 2, 3) for c in (1, 2)]


def regularised(m: DataFrame, keys: list[str], lam: float) -> DataFrame:
    """lam times the affine plus the rest times the rigid fit."""
    a = affine(m).select(*keys, *(F.col(t).alias(f"a_{t}") for t in T))
    b = rigid(m).select(*keys, *(F.col(t).alias(f"r_{t}") for t in T))
    return a.join(b, keys).select(*keys, *((lam * F.col(f"a_{t}") + (1 - lam) * F.col(f"r_{t}")).alias(t) for t in T))


def apply_transform(i: Column, j: Column) -> tuple[Column, Column]:
    return i * F.col("t11") + j * F.col("t21") + F.col("t31"), i * F.col("t12") + j * F.col("t22") + F.col("t32")


def decompose(tforms: DataFrame) -> DataFrame:
    """Scales, shear, rotation in degrees and shift of affine rows."""
    a, b, c, d = F.col("t11"), F.col("t21"), F.col("t12"), F.col("t22")
    det, p = a * d - b * c, F.sqrt(a * a + b * b)
    return tforms.withColumns({
        "scale_i": p, "scale_j": det / F.nullif(p, F.lit(0.0)), "shear": (a * c + b * d) / F.nullif(det, F.lit(0.0)),
        "rotation": F.degrees(F.atan(F.try_divide(b, a))), "shift_i": F.col("t31"), "shift_j": F.col("t32"),
    })


def z_blocks(z0: int, z1: int, increment: int = 20, overlap: int = 2) -> list[tuple[int, int]]:
    """Overlapping runs of sections from z0 to z1; the last ends at z1."""
    sign = int(math.copysign(1, increment))
    starts = list(range(z0, z1 - sign + sign, increment))
    stops = list(range(z0 + increment + overlap - sign, z1 + sign, increment))
    if z1 not in stops:
        stops.append(z1)
    return list(zip(starts, stops, strict=False))
