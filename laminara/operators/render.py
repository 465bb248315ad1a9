"""Rendering of sections on chunks: layers masked, each sub-section warped by its own mesh, merged by maximum.

Every chunk of the result is one group of bounded size: the triangles whose moved outline touches it and the pixels, with a
halo, that they came from. Nothing holds a whole plane.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminara.operators.chunks import assembled, cell, chunk_row, halved, pieces
from laminara.sources.storage import CHUNK

CORNERS = tuple(f"{k}_{s}_{c}" for k in "abc" for s in ("src", "dst") for c in "ij")


def placed_triangles(tri: DataFrame, place: DataFrame) -> DataFrame:
    """(z, sub, triangle, corners) from (ka, kb, kc) and meshes (z, sub, node, src_i, src_j, dst_i, dst_j)."""
    out = tri.withColumn("triangle", F.concat_ws("-", "ka", "kb", "kc"))
    for n, k in enumerate("abc"):
        at = place.select("z", "sub", F.col("node").alias(f"k{k}"), *(F.col(f"{s}_{c}").alias(f"{k}_{s}_{c}") for s in ("src", "dst") for c in "ij"))
        out = out.join(at, [f"k{k}"] if n == 0 else ["z", "sub", f"k{k}"])
    return out.select("z", "sub", "triangle", *CORNERS)


def warped(img: np.ndarray, i0: int, j0: int, triangles: list[tuple], top: int, left: int, size: int) -> np.ndarray:
    """The chunk at (top, left): pixels inside moved triangles, read between four pixels of ``img``, whose first is (i0, j0)."""
    out, done = np.zeros((size, size), np.uint8), np.zeros((size, size), bool)
    edge = np.pad(img.astype(float), 1)
    for asi, asj, adi, adj, bsi, bsj, bdi, bdj, csi, csj, cdi, cdj in triangles:
        det = (bdj - cdj) * (adi - cdi) + (cdi - bdi) * (adj - cdj)
        if det == 0:
            continue
        lo = lambda *v, first: max(first, int(np.ceil(min(v) - 1e-9)))
        hi = lambda *v, first: min(first + size - 1, int(np.floor(max(v) + 1e-9)))
        ii, jj = np.mgrid[lo(adi, bdi, cdi, first=top) : hi(adi, bdi, cdi, first=top) + 1, lo(adj, bdj, cdj, first=left) : hi(adj, bdj, cdj, first=left) + 1]
        wa = ((bdj - cdj) * (ii - cdi) + (cdi - bdi) * (jj - cdj)) / det
        wb = ((cdj - adj) * (ii - cdi) + (adi - cdi) * (jj - cdj)) / det
        wc = 1 - wa - wb
        inside = (wa >= -1e-9) & (wb >= -1e-9) & (wc >= -1e-9) & ~done[ii - top, jj - left]
        if not inside.any():
            continue
        ii, jj, wa, wb, wc = (x[inside] for x in (ii, jj, wa, wb, wc))
        si, sj = np.round(wa * asi + wb * bsi + wc * csi, 9), np.round(wa * asj + wb * bsj + wc * csj, 9)
        fi, fj = np.floor(si), np.floor(sj)
        di, dj, value = si - fi, sj - fj, np.zeros(len(si))
        for a in (0, 1):
            for b in (0, 1):
                pi, pj = (fi + a - i0 + 1).astype(int), (fj + b - j0 + 1).astype(int)
                there = (pi >= 0) & (pi < edge.shape[0]) & (pj >= 0) & (pj < edge.shape[1])
                value[there] += ((di if a else 1 - di) * (dj if b else 1 - dj))[there] * edge[pi[there], pj[there]]
        out[ii - top, jj - left] = np.rint(np.round(value, 6)).astype(np.uint8)
        done[ii - top, jj - left] = True
    return out


def render(triangles: DataFrame, layers: dict[str, DataFrame], size: int, box: tuple[int, int, int, int], values: dict[str, int] | None = None) -> DataFrame:
    """Chunks of the rendered sections, within ``box`` (i0, i1, j0, j1) of the moved plane; chunks of zeros only are left out.

    ``layers`` holds chunks: "image", and as far as wanted "roi" and "defect", outside of whose value of ``values`` pixels
    are removed, and "split", whose value 0 is removed and whose other values name the sub-section a pixel belongs to. Without
    a split every sub-section takes the whole image. Where moved sub-sections meet, the brighter pixel wins.
    """
    values = {"roi": 1, "defect": 1} | (values or {})
    i0, i1, j0, j1 = box
    low = lambda s, c: F.least(*(f"{k}_{s}_{c}" for k in "abc"))
    high = lambda s, c: F.greatest(*(f"{k}_{s}_{c}" for k in "abc"))
    for c, a, b in (("i", i0, i1), ("j", j0, j1)):
        first, last = F.greatest(F.ceil(low("dst", c) - 1e-9), F.lit(a)), F.least(F.floor(high("dst", c) + 1e-9), F.lit(b))
        triangles = triangles.where(first <= last).withColumn(f"o{c}", F.explode(F.sequence(cell(first, size), cell(last, size))))
    touched = triangles.withColumns({"oi": F.col("oi").cast("int"), "oj": F.col("oj").cast("int")})
    ends = lambda c: (F.floor(F.min(low("src", c))).cast("int").alias(f"{c}0"), F.ceil(F.max(high("src", c))).cast("int").alias(f"{c}1"))
    boxes = touched.groupBy("z", "oi", "oj").agg(*ends("i"), *ends("j")).withColumn("own", F.col("z"))
    found, names = None, set(layers)
    for name, chunks in layers.items():
        some = pieces(boxes, chunks, size, name)
        found = some if found is None else found.unionByName(some)

    def run(key: tuple, tri: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        z, oi, oj = key
        if not len(tri) or not len(got):
            return pd.DataFrame({c: [] for c in ("z", "mip", "ci", "cj", "h", "w", "data")})
        src = tri[[c for c in CORNERS if "_src_" in c]].to_numpy()
        a, b, c, d = int(np.floor(src[:, ::2].min())), int(np.ceil(src[:, ::2].max())), int(np.floor(src[:, 1::2].min())), int(np.ceil(src[:, 1::2].max()))
        layer = lambda name: assembled(got[got.layer == name], a, b, c, d)
        img = layer("image")
        for name in ("roi", "defect"):
            if name in names:
                img[layer(name) != values[name]] = 0
        split = layer("split") if "split" in names else None
        out, top, left = np.zeros((size, size), np.uint8), oi * size + 1, oj * size + 1
        for sub, t in tri.sort_values(["sub", "triangle"]).groupby("sub"):
            own = img if split is None else np.where(split == sub, img, 0)
            out = np.maximum(out, warped(own, a, c, [tuple(r) for r in t[list(CORNERS)].to_numpy()], top, left, size))
        ii, jj = np.arange(top, top + size), np.arange(left, left + size)
        out[(ii < i0) | (ii > i1)] = 0
        out[:, (jj < j0) | (jj > j1)] = 0
        return chunk_row(z, 0, oi, oj, out).iloc[: int(out.any())]

    return touched.groupBy("z", "oi", "oj").cogroup(found.select(F.col("own").alias("pz"), F.col("oi").alias("pi"), F.col("oj").alias("pj"), "layer", "top", "left", "strips").groupBy("pz", "pi", "pj")).applyInPandas(run, CHUNK)


def with_levels(chunks: DataFrame, size: int, levels: int) -> DataFrame:
    """Chunks of mip 0 and of ``levels`` further ones."""
    out = last = chunks
    for _ in range(levels):
        last = halved(last, size)
        out = out.unionByName(last)
    return out
