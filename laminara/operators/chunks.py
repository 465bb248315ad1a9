"""Planes in binary chunks: boxes of pixels gathered from the chunks they touch, and levels of lower resolution.

A volume is (z, mip, ci, cj, h, w, data); all chunks of a plane are ``size`` squared bytes, and pixels that no chunk holds are
zero. Only the rows and columns that a box needs leave a chunk, cut out by built-in functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminara.sources.storage import CHUNK


def cell(c, size: int):
    return F.floor((c - 1) / size).cast("int")


def pieces(boxes: DataFrame, chunks: DataFrame, size: int, layer: str = "image") -> DataFrame:
    """For each box (any keys, z, i0, i1, j0, j1; both ends included) what chunks hold of it: the keys and
    (layer, top, left, strips), one strip of bytes for each row. Boxes may reach beyond the plane; what isn't there comes
    not at all. A box meets few chunks, and a chunk sends a box no more than their overlap."""
    keys = [c for c in boxes.columns if c not in ("z", "i0", "i1", "j0", "j1")]
    cells = boxes.withColumn("ci", F.explode(F.sequence(cell(F.col("i0"), size), cell(F.col("i1"), size))))
    cells = cells.withColumn("cj", F.explode(F.sequence(cell(F.col("j0"), size), cell(F.col("j1"), size))))
    met = cells.join(chunks.select("z", "ci", "cj", "data"), ["z", "ci", "cj"])
    first = lambda a, c: F.greatest(F.col(f"{a}0"), F.col(c) * size + 1).cast("int")
    final = lambda a, c: F.least(F.col(f"{a}1"), (F.col(c) + 1) * size).cast("int")
    met = met.select(*keys, "data", "ci", "cj", first("i", "ci").alias("top"), final("i", "ci").alias("bottom"), first("j", "cj").alias("left"), final("j", "cj").alias("right"))
    strip = f"transform(sequence(top, bottom), r -> substring(data, (r - 1 - ci * {size}) * {size} + left - cj * {size}, right - left + 1))"
    return met.select(*keys, F.lit(layer).alias("layer"), "top", "left", F.expr(strip).alias("strips"))


def assembled(found: pd.DataFrame, i0: int, i1: int, j0: int, j1: int) -> np.ndarray:
    """One layer's pieces laid into the box; nothing is zero."""
    out = np.zeros((i1 - i0 + 1, j1 - j0 + 1), np.uint8)
    for top, left, strips in zip(found.top, found.left, found.strips, strict=True):
        block = np.stack([np.frombuffer(s, np.uint8) for s in strips])
        out[top - i0 : top - i0 + block.shape[0], left - j0 : left - j0 + block.shape[1]] = block
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by the keys into as many tasks as shuffles have. Before work in Python that follows rows more than bytes:
    few bytes are else put together into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def chunk_row(z: int, mip: int, ci: int, cj: int, img: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"z": [z], "mip": [mip], "ci": [ci], "cj": [cj], "h": [img.shape[0]], "w": [img.shape[1]], "data": [img.tobytes()]})


def halved(chunks: DataFrame, size: int) -> DataFrame:
    """The next level: means of two by two pixels, rounded half to even; four chunks become one."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros((2 * size, 2 * size), np.uint8)
        for r in t.itertuples():
            whole[r.ci % 2 * size : (r.ci % 2 + 1) * size, r.cj % 2 * size : (r.cj % 2 + 1) * size] = np.frombuffer(r.data, np.uint8).reshape(size, size)
        mean = whole.reshape(size, 2, size, 2).astype(float).mean((1, 3))
        first = t.iloc[0]
        return chunk_row(int(first.z), int(first.mip) + 1, int(first.ci) // 2, int(first.cj) // 2, np.rint(mean).astype(np.uint8))

    return chunks.groupBy("z", "mip", F.floor(F.col("ci") / 2).alias("pi"), F.floor(F.col("cj") / 2).alias("pj")).applyInPandas(run, CHUNK)


def filtered(chunks: DataFrame, size: int, height: int, width: int, radius: int, f) -> DataFrame:
    """Chunks whose pixels ``f`` makes of the chunk with a halo of ``radius``, and the plane's mean outside of the plane.

    ``f`` takes an array of size + 2 * radius squared floats and gives size squared ones; the result is (z, ci, cj, data)
    with doubles, since filters may give negative values."""
    at = lambda a, c, o: (F.col(c) * size + o).alias(a)
    # A box carries its chunk's place under other names, since it meets chunks of its own.
    boxes = chunks.select("z", F.col("z").alias("own"), F.col("ci").alias("oi"), F.col("cj").alias("oj"), at("i0", "ci", 1 - radius), at("i1", "ci", size + radius), at("j0", "cj", 1 - radius), at("j1", "cj", size + radius))
    total = F.expr("aggregate(sequence(1, length(data)), 0L, (s, k) -> s + cast(conv(hex(substring(data, k, 1)), 16, 10) as bigint))")
    means = chunks.groupBy(F.col("z").alias("own")).agg((F.sum(total) / (height * width)).alias("mean"))
    found = pieces(boxes, chunks, size).join(means, "own")

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        z, oi, oj = key
        i0, j0, n = oi * size + 1 - radius, oj * size + 1 - radius, size + 2 * radius
        img = assembled(t, i0, i0 + n - 1, j0, j0 + n - 1).astype(float)
        i, j = np.arange(i0, i0 + n), np.arange(j0, j0 + n)
        img[(i < 1) | (i > height)] = t["mean"].iloc[0]
        img[:, (j < 1) | (j > width)] = t["mean"].iloc[0]
        return pd.DataFrame({"z": [z], "ci": [oi], "cj": [oj], "data": [np.ascontiguousarray(f(img)).tobytes()]})

    return found.groupBy("own", "oi", "oj").applyInPandas(run, "z int, ci int, cj int, data binary")


def inside_outline(outline, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pixels of rows ``i`` and columns ``j`` lie in a closed polygon of (x, y), by the even-odd rule."""
    out = np.zeros((len(i), len(j)), bool)
    for p, q in zip(outline, [*outline[1:], outline[0]], strict=True):
        (px, py), (qx, qy) = ((c["x"], c["y"]) for c in (p, q))
        between = (py > i) != (qy > i)
        if between.any():
            out[between] ^= j[None, :] < ((qx - px) * (i[between] - py) / (qy - py) + px)[:, None]
    return out


def preprocessed(chunks: DataFrame, size: int, extent: tuple[int, int], ends: DataFrame, outlines: DataFrame, order: DataFrame) -> DataFrame:
    """Chunks stretched, masked and put in order, in one pass; no chunk meets another one.

    ``ends`` (z, lo, hi) stretches a section's pixels, zeros too, to 1..255; sections without ends, or with equal ones, stay.
    Pixels beyond the height and width of ``extent`` are 0.
    ``outlines`` (z, outline array<struct<x, y>>) holds what is kept of a section, all else becomes 0; sections without an
    outline, or with fewer than three corners, are empty. ``order`` (dst_z, src_z) names where each section comes from: a
    source may go to several targets, of several sources of a target the smallest counts, and sections that it doesn't
    name as a source are left out. Each of the three has a row for a section at most, in its source's numbers.
    """
    wanted = order.where("src_z is not null and dst_z is not null").groupBy("dst_z").agg(F.min("src_z").alias("z"))
    rows = chunks.join(wanted, "z").join(ends.select("z", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")), "z", "left")
    rows = rows.join(outlines.select("z", "outline"), "z", "left").select("dst_z", "mip", "ci", "cj", "data", "lo", "hi", "outline")

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                img = np.frombuffer(r.data, np.uint8).reshape(size, size)
                if r.lo == r.lo and r.hi == r.hi and r.lo != r.hi:
                    img = np.floor(255 * np.minimum(1.0, np.maximum(1 / 255, (np.arange(256) - r.lo) / (r.hi - r.lo)))).astype(np.uint8)[img]
                kept = np.zeros((size, size), bool)
                if r.outline is not None and len(r.outline) > 2:
                    kept = inside_outline(list(r.outline), np.arange(1, size + 1) + r.ci * size, np.arange(1, size + 1) + r.cj * size)
                kept[max(0, extent[0] - r.ci * size) :] = kept[:, max(0, extent[1] - r.cj * size) :] = False
                yield chunk_row(r.dst_z, r.mip, r.ci, r.cj, np.where(kept, img, 0).astype(np.uint8))

    return rows.mapInPandas(run, CHUNK)
