"""Block matching: for each node the shift at which a source block correlates best with a target window.

Ranges and guards are expressions or small array code; the correlation itself runs on Arrow batches in tasks, one
node at a time, since Fourier transforms have no expression form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_range(c: Column, radius: Column | int, size: Column | int, odd: bool = False) -> tuple[Column, Column]:
    """First and last pixel of a block around ``c``, clipped to 1..size, and made odd in length at its end."""
    lo, hi = F.greatest(F.lit(1), c - radius), F.least(c + radius, F.lit(size) if isinstance(size, int) else size)
    return lo, F.when((hi - lo + 1) % 2 == 0, hi - 1).otherwise(hi) if odd else hi


def ranges(nodes: DataFrame, block_r: int, search_r: int, height: int, width: int) -> DataFrame:
    """Source block and target window (clipped, and whole) of each node (i, j); nodes outside the image go."""
    ci, cj = F.ceil("i").cast("int"), F.ceil("j").cast("int")
    rows = nodes.withColumns({"ci": ci, "cj": cj}).where(F.col("ci").between(1, height) & F.col("cj").between(1, width))
    out = {}
    for axis, size in (("i", height), ("j", width)):
        c = F.col(f"c{axis}")
        out[f"src_{axis}0"], out[f"src_{axis}1"] = block_range(c, block_r, size, odd=True)
        out[f"dst_{axis}0"], out[f"dst_{axis}1"] = block_range(c, block_r + search_r, size)
        out[f"full_{axis}0"], out[f"full_{axis}1"] = c - (block_r + search_r), c + (block_r + search_r)
    return rows.withColumns(out)


def mean_padded(img: np.ndarray, value: float = 0.0) -> np.ndarray:
    """Pixels of the value become the mean of all pixels, themselves included."""
    out = img.astype(float)
    out[out == value] = out.mean()
    return out


def reach(sigma: float) -> int:
    """Half the width of a Gaussian's support."""
    return 2 * int(np.ceil(sigma))


def gauss(sigma: float) -> np.ndarray:
    """Weights along one axis, summing to one; a sigma of 0 is the identity."""
    x = np.arange(-reach(sigma), reach(sigma) + 1)
    w = np.exp(-(x * x) / (2 * sigma * sigma)) if sigma > 0 else np.ones(1)
    return w / w.sum()


def smoothed(img: np.ndarray, sigma: float, spare: int = 0) -> np.ndarray:
    """Rows and columns averaged in turn; the result lacks the support's reach at every side, and ``spare`` more pixels."""
    if spare:
        img = img[spare:-spare, spare:-spare]
    w = gauss(sigma)
    rows = sum(w[k] * img[k : img.shape[0] - len(w) + 1 + k] for k in range(len(w)))
    return sum(w[k] * rows[:, k : rows.shape[1] - len(w) + 1 + k] for k in range(len(w)))


def gauss_pair(low: float, high: float) -> tuple[float, float]:
    """Sigmas of a band-pass: the image under the first Gaussian minus the image under the second; a sigma of 0 leaves its
    part out, the first as the image itself, the second as nothing."""
    if low < 0 or high < 0:
        raise ValueError("a sigma can't be negative")
    return low, high


def bandpassed(img: np.ndarray, sigmas: tuple[float, float]) -> np.ndarray:
    """The band of an image that already has the reach of the wider Gaussian around it."""
    low, high = sigmas
    most = max(reach(low), reach(high))
    out = smoothed(img, low, most - reach(low))
    return out - smoothed(img, high, most - reach(high)) if high > 0 else out


def mean_bordered(img: np.ndarray, sigmas: tuple[float, float]) -> np.ndarray:
    """The band of a patch, with its mean around it."""
    return bandpassed(np.pad(img, max(map(reach, sigmas)), constant_values=img.mean()), sigmas)


def box_sums(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums over all h by w boxes, from cumulative sums."""
    c = np.pad(img, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return c[h:, w:] - c[:-h, w:] - c[h:, :-w] + c[:-h, :-w]


def convolve(a: np.ndarray, b: np.ndarray, crop: str = "valid") -> np.ndarray:
    """Convolution by Fourier transform, whole ("full"), of the first's size ("same"), or where both overlap fully."""
    shape = [x + y - 1 for x, y in zip(a.shape, b.shape, strict=True)]
    full = np.fft.irfft2(np.fft.rfft2(a, shape) * np.fft.rfft2(b, shape), shape)
    if crop == "full":
        return full
    size = a.shape if crop == "same" else tuple(x - y + 1 for x, y in zip(a.shape, b.shape, strict=True))
    start = [(y - 1) // 2 if crop == "same" else y - 1 for y in b.shape]
    return full[start[0] : start[0] + size[0], start[1] : start[1] + size[1]]


def ncc(template: np.ndarray, img: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at all offsets where the template lies in the image.

    0 where the window's variance is at most 1e-4; NaN everywhere for a constant template.
    """
    t = template - template.mean()
    n = t.size
    energy = (t * t).sum()
    if energy <= 0:
        return np.full((img.shape[0] - t.shape[0] + 1, img.shape[1] - t.shape[1] + 1), np.nan)
    top = convolve(img, t[::-1, ::-1])
    s, s2 = box_sums(img, *t.shape), box_sums(img * img, *t.shape)
    var = s2 - s * s / n
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(var <= 1e-4 * n, 0.0, top / np.sqrt(np.maximum(var, 0) * energy))


def peak(xc: np.ndarray) -> tuple[int, int, float, float]:
    """Row and column (from 1) of the maximum, the first in order of columns, and the same refined.

    The refinement weighs rows over two steps and columns over one, both by the sum of the five by five around.
    """
    j, i = divmod(int(np.argmax(xc.T)), xc.shape[0])
    fi, fj = i + 1.0, j + 1.0
    if 2 < i + 1 < xc.shape[0] - 1 and 2 < j + 1 < xc.shape[1] - 1:
        w = xc[i - 2 : i + 3, j - 2 : j + 3]
        total = w.sum()
        if total:
            rows = w.sum(1)
            cols = w[1:4, :].sum(0)
            fi += (2 * rows[4] + rows[3] - rows[1] - 2 * rows[0]) / total
            fj += (cols[3] - cols[1]) / total
    return i + 1, j + 1, fi, fj


def spread(xc: np.ndarray, beta: float) -> float:
    """Root of the summed variances of the places, weighted by what exceeds beta times the maximum."""
    w = np.maximum(xc - beta * xc.max(), 0)
    total = w.sum()
    if total <= 0:
        return float("inf")
    w = w / total
    out = 0.0
    for axis in (0, 1):
        m, x = w.sum(1 - axis), np.arange(w.shape[axis])
        mu = (m * x).sum()
        out += (m * (x - mu) ** 2).sum()
    return float(np.sqrt(out))


def kurtosis(x: np.ndarray) -> float:
    x = x.astype(float).ravel()
    v = x.var()
    return float(((x - x.mean()) ** 4).mean() / v**2 - 3) if v > 0 else float("nan")


def usable(src: np.ndarray, dst: np.ndarray) -> bool:
    """False where an edge or the middle row or column of the source, or the ring of the target, is empty."""
    h, w = src.shape
    if min(h, w) < 1 or any(x.sum() == 0 for x in (src[:, 0], src[:, -1], src[0], src[-1], src[:, w // 2], src[h // 2])):
        return False
    quarter = lambda n: (round((n - 1) / 4), round(3 * (n - 1) / 4))
    (a, b), (c, d) = quarter(dst.shape[0]), quarter(dst.shape[1])
    return all(x.sum() != 0 for x in (dst[a, c : d + 1], dst[b, c : d + 1], dst[a : b + 1, c], dst[a : b + 1, d]))


def match_patches(src: np.ndarray, dst: np.ndarray, scale: float = 1.0, kernel: tuple[float, float] | None = None) -> dict | None:
    """Shift and quality of one block, or None where it can't be matched. Both patches are padded with zeros; ``kernel`` names
    the Gaussians of a band-pass before the correlation."""
    if not usable(src, dst) or any(a > b for a, b in zip(src.shape, dst.shape, strict=True)):
        return None
    a, b = mean_padded(src), mean_padded(dst)
    xc = ncc(mean_bordered(a, kernel), mean_bordered(b, kernel)) if kernel else ncc(a, b)
    if np.isnan(xc).any():
        return None
    i, j, fi, fj = peak(xc)
    out = {"r_max": float(xc.max()), "peak_i": fi, "peak_j": fj}
    for r in (5, 10, 15):
        rest = xc.copy()
        rest[max(0, i - 1 - r) : i + r, max(0, j - 1 - r) : j + r] = -np.inf
        out[f"delta_{r}"] = out["r_max"] - float(rest.max()) if np.isfinite(rest.max()) else float("inf")
    for b in (0.5, 0.75, 0.95):
        out[f"sigma_{b:g}".replace("0.", "0")] = spread(xc, b) / scale
    out |= {"dyn_range": (float(src.max()) - float(src.min())) / 255, "kurt_src": kurtosis(src), "kurt_dst": kurtosis(dst)}
    return out


FIELDS = "r_max double, peak_i double, peak_j double, delta_5 double, delta_10 double, delta_15 double, sigma_05 double, sigma_075 double, sigma_095 double, dyn_range double, kurt_src double, kurt_dst double"


def match_blocks(patches: DataFrame, scale: float = 1.0) -> DataFrame:
    """``patches`` has match and node columns ending with src, dst (binary bytes), src_h, src_w, dst_h, dst_w. Rows that
    can't be matched are left out; features replace the patches."""
    keys = [c for c in patches.columns if c not in ("src", "dst", "src_h", "src_w", "dst_h", "dst_w")]
    schema = ", ".join([*(f"{c} {t}" for c, t in patches.select(*keys).dtypes), FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                got = match_patches(np.frombuffer(r.src, np.uint8).reshape(r.src_h, r.src_w), np.frombuffer(r.dst, np.uint8).reshape(r.dst_h, r.dst_w), scale)
                if got is not None:
                    rows.append({k: getattr(r, k) for k in keys} | got)
            yield pd.DataFrame(rows, columns=[*keys, *(f.split()[0] for f in FIELDS.split(", "))])

    return patches.mapInPandas(run, schema)


def section_patches(px: DataFrame, key: str) -> DataFrame:
    """(key, img, h, w): all pixels of a tile as bytes in order of rows; tiles are small by definition."""
    packed = px.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "j", "px"))).alias("p"), F.max("i").alias("h"), F.max("j").alias("w"))
    hexes = F.transform("p", lambda s: F.lpad(F.hex(s["px"].cast("long")), 2, "0"))
    return packed.select(key, F.unhex(F.array_join(hexes, "")).alias("img"), "h", "w")


def correlation_rows(template: DataFrame, image: DataFrame) -> DataFrame:
    """The same correlation as rows: (match, oi, oj, r) for offsets where the template lies in the image.

    template: match, i, j, px; image: match, i, j, px. For small patches and checks.
    """
    size = template.groupBy("match").agg(F.max("i").alias("h"), F.max("j").alias("w"))
    room = image.groupBy("match").agg(F.max("i").alias("ih"), F.max("j").alias("iw"))
    off = size.join(room, "match").select("match", F.explode(F.sequence(F.lit(0), F.col("ih") - F.col("h"))).alias("oi"), (F.col("iw") - F.col("w")).alias("more")).select("match", "oi", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("oj"))
    t = template.select("match", F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("px").cast("double").alias("t"))
    placed = t.join(off, "match").select("match", "oi", "oj", (F.col("ti") + F.col("oi")).alias("i"), (F.col("tj") + F.col("oj")).alias("j"), "t")
    return placed.join(image.select("match", "i", "j", F.col("px").cast("double").alias("x")), ["match", "i", "j"]).groupBy("match", "oi", "oj").agg(F.corr("t", "x").alias("r"))
