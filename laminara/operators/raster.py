"""Raster operators on pixel rows (z, i, j, px); a missing pixel is zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminara.functions.registry import COMPARATORS
from laminara.sources.storage import Stored

AT = ["z", "i", "j"]


def threshold(px: DataFrame, value: int = 180, comparator: str = ">") -> DataFrame:
    return px.withColumn("px", COMPARATORS[comparator](F.col("px"), F.lit(value)).cast("int"))


def mask(px: DataFrame, masks: DataFrame, id_: int, keep: bool = True, val: int = 0) -> DataFrame:
    """Pixels where the mask has the value (or hasn't); the others become ``val``."""
    here = F.coalesce(F.col("m") == id_, F.lit(False))
    out = px.join(masks.select(*AT, F.col("px").alias("m")), AT, "left")
    return out.withColumn("px", F.when(here if keep else ~here, F.col("px")).otherwise(val)).drop("m")


def union_masks(a: DataFrame, av: int, b: DataFrame, bv: int) -> DataFrame:
    """1 where the first has its value or the second has its own."""
    j = a.select(*AT, F.col("px").alias("x")).join(b.select(*AT, F.col("px").alias("y")), AT, "full")
    return j.select(*AT, (F.coalesce(F.col("x") == av, F.lit(False)) | F.coalesce(F.col("y") == bv, F.lit(False))).cast("int").alias("px"))


def over_sections(px: DataFrame, offsets: list[int], conjunction: bool) -> DataFrame:
    """Bits of the pixels of the sections z + offset: all of them, lowest bit, or any of them. Sections that lack one
    of the others give none."""
    spread = px.select("z", "i", "j", "px", F.explode(F.array(*map(F.lit, offsets))).alias("o")).select((F.col("z") - F.col("o")).alias("z"), "i", "j", "px")
    agg = F.bit_and("px").bitwiseAND(1) if conjunction else F.bit_or("px")
    return spread.groupBy(*AT).agg(agg.cast("int").alias("px"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(offsets)).drop("n")


def dilate(px: DataFrame, height: int, width: int, val: int = 0, radius: int = 3, comparator: str = "==") -> DataFrame:
    """1 where a pixel that satisfies the comparison lies in the square of ``radius`` around; only hits are spread."""
    lo, hi = -((radius - 1) // 2), radius // 2
    hits = px.where(COMPARATORS[comparator](F.col("px"), F.lit(val))).select(*AT)
    step = lambda: F.explode(F.sequence(F.lit(lo), F.lit(hi)))
    near = hits.select("z", "i", "j", step().alias("di")).select("z", "i", "j", "di", step().alias("dj"))
    near = near.select("z", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j")).where(F.col("i").between(1, height) & F.col("j").between(1, width)).distinct()
    return px.select(*AT).join(near.withColumn("v", F.lit(1)), AT, "left").select(*AT, F.coalesce("v", F.lit(0)).alias("px"))


def upsample(px: DataFrame, factor: int) -> DataFrame:
    step = lambda: F.explode(F.sequence(F.lit(1), F.lit(factor)))
    out = px.select("z", "i", "j", "px", step().alias("di")).select("z", "i", "j", "px", "di", step().alias("dj"))
    return out.select("z", ((F.col("i") - 1) * factor + F.col("di")).alias("i"), ((F.col("j") - 1) * factor + F.col("dj")).alias("j"), "px")


def downsample(px: DataFrame, factor: int = 2) -> DataFrame:
    """Means of blocks, rounded half to even."""
    at = lambda c: F.floor((F.col(c) - 1) / factor).cast("int") + 1
    return px.groupBy("z", at("i").alias("i"), at("j").alias("j")).agg(F.rint(F.avg("px")).cast("int").alias("px"))


def mips(px: DataFrame, levels: int) -> DataFrame:
    """(mip, z, i, j, px): each level from the one before."""
    out, level = None, px
    for m in range(1, levels + 1):
        level = downsample(level)
        one = level.select(F.lit(m).alias("mip"), *AT, "px")
        out = one if out is None else out.unionByName(one)
    return out


def rescope(px: DataFrame, i0: int, j0: int, height: int, width: int) -> DataFrame:
    """Cropped or padded with zeros to rows i0.. and columns j0.., renumbered from 1."""
    sections = px.select("z").distinct()
    grid = sections.select("z", F.explode(F.sequence(F.lit(i0), F.lit(i0 + height - 1))).alias("i")).select("z", "i", F.explode(F.sequence(F.lit(j0), F.lit(j0 + width - 1))).alias("j"))
    out = grid.join(px.select(*AT, "px"), AT, "left")
    return out.select("z", (F.col("i") - i0 + 1).alias("i"), (F.col("j") - j0 + 1).alias("j"), F.coalesce("px", F.lit(0)).alias("px"))


def pad(px: DataFrame, height: int, width: int, xlow: int, ylow: int, xhigh: int, yhigh: int) -> DataFrame:
    """Zero rows and columns: ylow above, yhigh below, xlow left, xhigh right."""
    return rescope(px, 1 - ylow, 1 - xlow, height + ylow + yhigh, width + xlow + xhigh)


def merge(images: DataFrame) -> DataFrame:
    """Images (z, image, off_i, off_j, i, j, px) laid together at their offsets; the brighter pixel wins."""
    return images.groupBy("z", (F.col("i") + F.col("off_i")).alias("i"), (F.col("j") + F.col("off_j")).alias("j")).agg(F.max("px").alias("px"))


def overlay(a: DataFrame, b: DataFrame, di: int, dj: int) -> DataFrame:
    """Two images in one number: the first in the high byte, the second, shifted, in the low one."""
    moved = b.select("z", (F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.col("px").alias("y"))
    j = a.select(*AT, F.col("px").alias("x")).join(moved, AT, "full")
    return j.select(*AT, (F.coalesce("x", F.lit(0)) * 256 + F.coalesce("y", F.lit(0))).alias("px"))


def stretched(x: Column, lo: Column, hi: Column) -> Column:
    """Linear stretch to 1..255, truncated; 0 stays free for masked pixels. Equal ends give null."""
    part = F.try_divide(x.cast("double") - lo, hi - lo)
    return F.when(part.isNotNull(), F.floor(255 * F.least(F.lit(1.0), F.greatest(F.lit(1.0) / 255, part)))).cast("int")


def stretch(px: DataFrame, ends: DataFrame) -> DataFrame:
    """Stretch by each section's lo and hi; sections without them stay."""
    out = px.join(ends.select("z", "lo", "hi"), "z", "left")
    return out.select(*AT, F.coalesce(stretched(F.col("px"), F.col("lo"), F.col("hi")), F.col("px")).alias("px"))


def correct_bias(px: DataFrame, bias: DataFrame) -> DataFrame:
    """Pixel minus the bias at its place plus the bias's mean, rounded and clamped to a byte."""
    mean = bias.agg(F.avg("bias").alias("m"))
    out = px.join(bias, ["i", "j"]).crossJoin(F.broadcast(mean))
    return out.select(*AT, F.least(F.lit(255), F.greatest(F.lit(0), F.rint(F.round(F.col("px") - F.col("bias") + F.col("m"), 6)).cast("int"))).alias("px"))


def fill_rectangle(px: DataFrame, i0: int, i1: int, j0: int, j1: int, mip: int = 0, value: int = 0) -> DataFrame:
    """Pixels of a rectangle given at mip 0 set to a value, its edges rounded half to even to the level."""
    at = lambda x: F.rint(F.lit(x / 2.0**mip)).cast("int")
    inside = F.col("i").between(at(i0), at(i1)) & F.col("j").between(at(j0), at(j1))
    return px.withColumn("px", F.when(inside, value).otherwise(F.col("px")))


def in_polygon(i: Column, j: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule, by crossings of the ray along j. The corners are a bounded list known at plan time."""
    crossings = F.lit(0)
    for (ai, aj), (bi, bj) in zip(corners, corners[1:] + corners[:1], strict=True):
        if ai == bi:
            continue
        spans = (F.lit(float(ai)) > i) != (F.lit(float(bi)) > i)
        crossings = crossings + (spans & (j < (bj - aj) * (i - ai) / F.lit(float(bi - ai)) + aj)).cast("int")
    return crossings % 2 == 1


def components(px: DataFrame, diagonal: bool = True, max_rounds: int = 1000) -> DataFrame:
    """(z, tile, i, j, label): connected pixels of ``px`` (z, tile, i, j); label is the least of (i - 1) * 2^20 + j.

    Each round takes the least label around and then the label of the pixel that the label names, so rounds follow the
    logarithm of the longest path. Rows are cut off their lineage in shared storage.
    """
    key = ["z", "tile"]
    code = (F.col("i") - 1) * (1 << 20) + F.col("j")
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    around = F.explode(F.array(*(F.lit(a * (1 << 20) + b) for a, b in steps)))
    nodes = Stored(px.select(*key, code.cast("long").alias("n")).distinct())
    edge = nodes.df.select(*key, "n", around.alias("d")).select(*key, "n", (F.col("n") + F.col("d")).alias("m"))
    edge = Stored(edge.join(nodes.df.withColumnRenamed("n", "m"), [*key, "m"]).select(*key, "n", "m"))
    labels = Stored(nodes.df.withColumn("label", F.col("n")))
    for _ in range(max_rounds):
        old = labels.df.select(*key, "n", "label")
        near = edge.df.join(old.select(*key, F.col("n").alias("m"), "label"), [*key, "m"]).groupBy(*key, "n").agg(F.min("label").alias("least"))
        step = old.join(near, [*key, "n"], "left").select(*key, "n", F.least("label", F.coalesce("least", "label")).alias("up"), F.col("label").alias("was"))
        for _ in range(2):
            upper = old.select(*key, F.col("n").alias("up"), F.col("label").alias("upper"))
            step = step.join(upper, [*key, "up"]).select(*key, "n", F.least("up", "upper").alias("up"), "was")
        new = Stored(step.withColumnRenamed("up", "label"))
        done = new.df.where("label <> was").isEmpty()
        labels.drop()
        labels = new
        if done:
            nodes.drop()
            edge.drop()
            return labels.df.select(*key, (F.floor(F.col("n") / (1 << 20)) + 1).cast("int").alias("i"), (F.col("n") % (1 << 20)).cast("int").alias("j"), "label")
    raise RuntimeError("components did not settle")


def equalised(px: DataFrame, clip: float = 4.0, bins: int = 64) -> DataFrame:
    """Contrast-limited equalisation of each tile by its own histogram, and a full-range stretch.

    A tile's histogram is cut at ``clip`` times its mean height and what is cut off is spread over all bins; a pixel
    becomes the share of the tile at or below its bin.
    """
    width = 256 // bins
    binned = px.withColumn("bin", F.floor(F.col("px") / width).cast("int"))
    hist = binned.groupBy("z", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = hist.groupBy("z").agg(F.sum("n").alias("total"))
    all_bins = total.select("z", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    top = clip * F.col("total") / bins
    cut = all_bins.join(hist, ["z", "bin"], "left").select("z", "bin", "total", F.least(F.coalesce("n", F.lit(0)).cast("double"), top).alias("h"))
    spare = cut.groupBy("z").agg(((F.max("total") - F.sum("h")) / bins).alias("spare"))
    from pyspark.sql import Window

    w = Window.partitionBy("z").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # ``bins`` rows for each tile
    curve = cut.join(spare, "z").select("z", "bin", (F.sum(F.col("h") + F.col("spare")).over(w) / F.col("total")).alias("share"))
    return binned.join(curve, ["z", "bin"]).select(*AT, F.least(F.lit(255), F.floor(F.round(255 * F.col("share"), 6)).cast("int")).alias("px"))
