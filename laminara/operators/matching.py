"""Matching of pairs of sections on chunks: for every node its block and its window are cut out of the chunks they touch
and correlated, a few nodes to a group. What is found replaces the pair's earlier result, so that a task can run again."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.operators import blockmatch as bm
from laminara.operators.chunks import assembled, dealt, pieces
from laminara.sources.storage import read_volume

FOUND = "src_z int, dst_z int, src_sub int, dst_sub int, node int, pre_i double, pre_j double, dv_i double, dv_j double, r_max double, delta_5 double, delta_10 double, delta_15 double, sigma_05 double, sigma_075 double, sigma_095 double, dyn_range double, kurt_src double, kurt_dst double"

#: Nodes of a group at most, and pixels of its windows.
NODES, PIXELS = 64, 1 << 21


def match_pairs(pairs: DataFrame, nodes: DataFrame, layers: dict[str, DataFrame], size: int, height: int, width: int, block_r: int, search_r: int, bandpass: tuple[float, float] = (0, 0)) -> DataFrame:
    """Correspondences of ``pairs`` (src_z, dst_z) at ``nodes`` (node, src_i, src_j), with their features.

    ``layers`` holds chunks "image", and as far as wanted "roi" (pixels outside of value 1 are removed) and "split": then each
    component of the block is matched with each component of the window, and the numbers of both are in the result. Nodes
    outside the image, empty blocks and pairs without a result give no row.
    """
    places = nodes.select("node", F.col("src_i").alias("i"), F.col("src_j").alias("j"))
    rows = bm.ranges(pairs.select("src_z", "dst_z").distinct().join(F.broadcast(places), F.lit(True)), block_r, search_r, height, width)
    keys = ["src_z", "dst_z", "node", "i", "j"]
    ends = lambda kind: [F.col(f"{kind}_{a}{e}").cast("int").alias(f"{a}{e}") for a in "ij" for e in "01"]
    all_ends = [f"{k}_{a}{e}" for k in ("src", "dst", "full") for a in "ij" for e in "01"]
    found, names = None, set(layers)
    for side in ("src", "dst"):
        boxes = rows.select(*keys, *all_ends, F.col(f"{side}_z").alias("z"), *ends(side))
        for name, chunks in layers.items():
            some = pieces(boxes, chunks, size, f"{side} {name}")
            found = some if found is None else found.unionByName(some)
    kernel = bm.gauss_pair(*bandpass) if tuple(bandpass) != (0, 0) else None

    def matches(r, layers: dict) -> list[dict]:
        box = lambda kind: tuple(int(getattr(r, f"{kind}_{a}{e}")) for a in "ij" for e in "01")

        def layer(name: str, kind: str) -> np.ndarray:
            some = layers.get(name, [])
            return assembled(SimpleNamespace(top=[p.top for p in some], left=[p.left for p in some], strips=[p.strips for p in some]), *box(kind))

        src, dst = layer("src image", "src"), layer("dst image", "full")
        if "roi" in names:
            src[layer("src roi", "src") != 1] = 0
            dst[layer("dst roi", "full") != 1] = 0
        parts = [(0, 0)]
        if "split" in names:
            a, b = layer("src split", "src"), layer("dst split", "full")
            parts = [(int(x), int(y)) for x in np.unique(a) if x for y in np.unique(b) if y]
        out = []
        for x, y in parts:
            s, d = (np.where(a == x, src, 0), np.where(b == y, dst, 0)) if x else (src, dst)
            got = bm.match_patches(s, d, kernel=kernel)
            if got is not None:
                got["dv_i"] = got.pop("peak_i") - 1 - (int(r.src_i0) - int(r.full_i0))
                got["dv_j"] = got.pop("peak_j") - 1 - (int(r.src_j0) - int(r.full_j0))
                out.append({"src_z": r.src_z, "dst_z": r.dst_z, "src_sub": x, "dst_sub": y, "node": r.node, "pre_i": r.i, "pre_j": r.j} | got)
        return out

    def run(t: pd.DataFrame) -> pd.DataFrame:
        by_node: dict = {}
        for r in t.itertuples(index=False):
            by_node.setdefault(r.node, (r, {}))[1].setdefault(r.layer, []).append(r)
        out = [one for r, some in by_node.values() for one in matches(r, some)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    # As many nodes to a group as their pixels allow.
    many = max(1, min(NODES, PIXELS // (len(names) * (2 * (block_r + search_r) + 1) ** 2)))
    found = dealt(found.withColumn("some", F.floor(F.col("node") / many)), "src_z", "dst_z", "some")
    return found.groupBy("src_z", "dst_z", "some").applyInPandas(run, FOUND)


def write_matches(found: DataFrame, path: str) -> None:
    """Store by pair; pairs that ``found`` has rows of are replaced, others stay."""
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("src_z", "dst_z").parquet(path)


def overlap_correlation(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Correlation of ``a``, shifted by all offsets, with ``b`` over the pixels where both are, by Fourier transforms padded
    to the whole; NaN where fewer than ``least`` pixels overlap or one side is constant. Entry [h - 1, w - 1] of ``a``'s height
    and width is the unshifted place."""
    shape = [x + y - 1 for x, y in zip(a.shape, b.shape, strict=True)]
    spectrum = lambda x: np.fft.rfft2(x, shape)
    a, b = a.astype(float) - a.mean(), b.astype(float) - b.mean()
    flipped, one, here = a[::-1, ::-1], np.ones(a.shape), np.ones(b.shape)
    both = lambda x, y: np.fft.irfft2(spectrum(x) * spectrum(y), shape)
    n = np.rint(both(one, here))
    sa, sb, saa, sbb, sab = both(flipped, here), both(one, b), both(flipped**2, here), both(one, b**2), both(flipped, b)
    with np.errstate(invalid="ignore", divide="ignore"):
        va, vb = saa - sa * sa / n, sbb - sb * sb / n
        r = (sab - sa * sb / n) / np.sqrt(va * vb)
    floor = 1e-9 * max((a * a).sum(), (b * b).sum(), 1e-300)
    return np.where((n >= least) & (va > floor) & (vb > floor), r, np.nan)


def translations(patches: DataFrame, least: int, highpass: float = 0, scale: int = 1) -> DataFrame:
    """Shift of the first patch that makes it agree best with the second, for rows of keys and (src, dst, src_h, src_w, dst_h,
    dst_w): keys, di, dj, r. Patches may lose their slow changes and be halved ``scale`` - 1 times before; shifts are in whole
    pixels of the given ones. Ties go to the smaller di, then dj; patches that never overlap enough give no row."""
    keys = [c for c in patches.columns if c not in ("src", "dst", "src_h", "src_w", "dst_h", "dst_w")]
    schema = ", ".join([*(f"{c} {t}" for c, t in patches.select(*keys).dtypes), "di int, dj int, r double"])

    def made(raw: bytes, h: int, w: int) -> np.ndarray:
        x = np.frombuffer(raw, np.uint8).reshape(h, w).astype(float)
        if highpass:
            x = x - bm.smoothed(np.pad(x, bm.reach(highpass), mode="edge"), highpass)
        for _ in range(scale - 1):
            x = x[: x.shape[0] // 2 * 2, : x.shape[1] // 2 * 2].reshape(x.shape[0] // 2, 2, x.shape[1] // 2, 2).mean((1, 3))
        return x

    def run(batches):
        for t in batches:
            out = []
            for r in t.itertuples(index=False):
                a, b = made(r.src, r.src_h, r.src_w), made(r.dst, r.dst_h, r.dst_w)
                xc = np.round(overlap_correlation(a, b, least), 9)
                if np.isfinite(xc).any():
                    i, j = divmod(int(np.nanargmax(xc)), xc.shape[1])
                    step = 2 ** (scale - 1)
                    out.append({k: getattr(r, k) for k in keys} | {"di": (i - a.shape[0] + 1) * step, "dj": (j - a.shape[1] + 1) * step, "r": float(xc[i, j])})
            yield pd.DataFrame(out, columns=[*keys, "di", "dj", "r"])

    return patches.mapInPandas(run, schema)


def correspondence_patches(spark: SparkSession, matches: str, image: str, roi: str | None, src_z: int, dst_z: int, node: int, size: int, extent: tuple[int, int], block_r: int, search_r: int, bandpass: tuple[float, float] = (0, 0)) -> DataFrame:
    """(layer, i, j, v): what one stored correspondence was made of, for review: the pixels of its block ("src") and of its
    window ("dst") at their places in the planes, and the correlation ("xc") by shift, from 0.

    One row of the stored matches is looked up; of the volumes at ``image`` and ``roi`` only the folders of the two sections
    are read, and in them only row groups with the chunks that the boxes touch. A correspondence that isn't there gives no row.
    """
    schema = "layer string, i int, j int, v double"
    found = spark.read.schema(FOUND).parquet(matches).where((F.col("src_z") == src_z) & (F.col("dst_z") == dst_z) & (F.col("node") == node))
    row = found.select("pre_i", "pre_j").first()
    if row is None:
        return spark.createDataFrame([], schema)
    boxes = {}
    for side, z in (("src", src_z), ("dst", dst_z)):
        out = [z]
        for c, n in zip(row, extent, strict=True):
            c = int(np.ceil(c))
            lo, hi = (max(1, c - block_r), min(c + block_r, n)) if side == "src" else (c - block_r - search_r, c + block_r + search_r)
            # Blocks are made odd in length at their end, as for the match.
            out += [lo, hi - (side == "src" and (hi - lo + 1) % 2 == 0)]
        boxes[side] = out
    parts = None
    for side, (z, i0, i1, j0, j1) in boxes.items():
        box = spark.createDataFrame([(1, z, i0, i1, j0, j1)], "one int, z int, i0 int, i1 int, j0 int, j1 int")
        near = lambda c, a, b: F.col(c).between((a - 1) // size, (b - 1) // size)
        for layer, path in (("image", image), ("roi", roi)):
            if path is not None:
                chunks = read_volume(spark, path, z=[z], mip=0).where(near("ci", i0, i1) & near("cj", j0, j1))
                some = pieces(box, chunks, size, f"{side} {layer}")
                parts = some if parts is None else parts.unionByName(some)
    kernel = bm.gauss_pair(*bandpass) if tuple(bandpass) != (0, 0) else None

    def run(t: pd.DataFrame) -> pd.DataFrame:
        rows, patch = [], {}
        for side, (_, i0, i1, j0, j1) in boxes.items():
            img = assembled(t[t.layer == f"{side} image"], i0, i1, j0, j1)
            if roi is not None:
                img[assembled(t[t.layer == f"{side} roi"], i0, i1, j0, j1) != 1] = 0
            patch[side] = bm.mean_padded(img)
            i, j = np.mgrid[i0 : i1 + 1, j0 : j1 + 1]
            rows.append(pd.DataFrame({"layer": side, "i": i.ravel(), "j": j.ravel(), "v": img.ravel().astype(float)}))
        if kernel:
            patch = {k: bm.mean_bordered(x, kernel) for k, x in patch.items()}
        xc = bm.ncc(patch["src"], patch["dst"])
        i, j = np.mgrid[: xc.shape[0], : xc.shape[1]]
        return pd.concat([*rows, pd.DataFrame({"layer": "xc", "i": i.ravel(), "j": j.ravel(), "v": xc.ravel()})])

    return parts.groupBy("one").applyInPandas(run, schema)
