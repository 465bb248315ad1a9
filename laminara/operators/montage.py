"""Tiles put into place: a best spanning forest of their seams, with every tile's offset along it, and tiles searched for in
an overview of their section, from coarse levels to fine ones."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminara.operators import blockmatch as bm
from laminara.operators.chunks import assembled, dealt, pieces
from laminara.sources.storage import Stored

# Seams


def _followed(hooks: Stored) -> Stored:
    """(z, root, up, ui, uj): pointers followed to their ends, offsets added up on the way; they double in reach each round."""
    while True:
        h = hooks.df
        over = h.select("z", F.col("root").alias("up"), F.col("up").alias("up2"), F.col("ui").alias("vi"), F.col("uj").alias("vj"))
        step = Stored(h.join(over, ["z", "up"]).select("z", "root", F.col("up2").alias("up"), (F.col("ui") + F.col("vi")).alias("ui"), (F.col("uj") + F.col("vj")).alias("uj"), (F.col("up") != F.col("up2")).alias("moved")))
        hooks.drop()
        hooks = step
        if step.df.where("moved").isEmpty():
            return hooks


def spanning_forest(edges: DataFrame) -> tuple[Stored, Stored]:
    """The spanning forest of greatest weight in each section, in rounds: every tree takes its best edge to another one.

    ``edges`` has z, a, b, r and the place (di, dj) of b seen from a. Ties of r go to the smaller of the ends, then to the
    other one, so there is just one forest. Of repeated edges the one of greatest r stays (then of smallest di and dj); loops,
    and edges without ends or weight, are left out. Returns stored tables, which the caller drops: the edges (z, a, b, r, di,
    dj; a < b), and (z, node, root, i, j) with the smallest node of the tree as root, at (0, 0), and the nodes' places seen
    from it. Trees at least halve in number each round; no section has to fit a task.
    """
    e = edges.where("a <> b and r is not null and not isnan(r) and z is not null").withColumn("turned", F.col("a") > F.col("b"))
    sign = F.when(F.col("turned"), -1).otherwise(1)
    e = e.select(F.col("z").cast("long").alias("z"), F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), F.col("r").cast("double").alias("r"), (F.col("di") * sign).cast("double").alias("di"), (F.col("dj") * sign).cast("double").alias("dj"))
    best = F.max_by(F.struct("r", "di", "dj"), F.struct("r", -F.col("di"), -F.col("dj")))
    edge = Stored(e.groupBy("z", "a", "b").agg(best.alias("e")).select("z", "a", "b", "e.*"))
    ends = edge.df.select("z", F.explode(F.array("a", "b")).alias("node")).distinct()
    state = Stored(ends.select("z", "node", F.col("node").alias("root"), F.lit(0.0).alias("i"), F.lit(0.0).alias("j")))
    chosen: list[Stored] = []
    left = edge
    while True:
        side = lambda x: state.df.select("z", F.col("node").alias(x), F.col("root").alias(f"{x}r"), F.col("i").alias(f"{x}i"), F.col("j").alias(f"{x}j"))
        near = left.df.select("z", "a", "b", "r", "di", "dj").join(side("a"), ["z", "a"]).join(side("b"), ["z", "b"]).where("ar <> br")
        # Edges within a tree are never needed again.
        live = Stored(near)
        if left is not edge:
            left.drop()
        left = live
        if left.df.isEmpty():
            break
        # The place of b's root seen from a's, and the other way.
        across = [(F.col(f"a{c}") + F.col(f"d{c}") - F.col(f"b{c}")) for c in "ij"]
        one = F.struct(F.col("ar").alias("root"), F.col("br").alias("up"), (-across[0]).alias("ui"), (-across[1]).alias("uj"))
        two = F.struct(F.col("br").alias("root"), F.col("ar").alias("up"), across[0].alias("ui"), across[1].alias("uj"))
        offers = left.df.select("z", "a", "b", "r", "di", "dj", F.explode(F.array(one, two)).alias("o")).select("z", "a", "b", "r", "di", "dj", "o.*")
        order = F.struct("r", -F.col("a"), -F.col("b"))
        taken = Stored(offers.groupBy("z", "root").agg(F.max_by(F.struct("a", "b", "r", "di", "dj", "up", "ui", "uj"), order).alias("t")).select("z", "root", "t.*"))
        chosen.append(taken)
        # Two trees that take the same edge: the smaller root stays one. There are no longer rings, as no two edges tie.
        back = taken.df.select("z", F.col("root").alias("up"), F.col("up").alias("back"))
        mine = taken.df.join(back, ["z", "up"], "left")
        stays = (F.col("back") == F.col("root")) & (F.col("root") < F.col("up"))
        keep = lambda c, own: F.when(F.coalesce(stays, F.lit(False)), own).otherwise(F.col(c)).alias(c)
        hooks = _followed(Stored(mine.select("z", "root", keep("up", F.col("root")), keep("ui", F.lit(0.0)), keep("uj", F.lit(0.0)))))
        new = state.df.join(hooks.df, ["z", "root"], "left").select("z", "node", F.coalesce("up", "root").alias("root"), *((F.col(c) + F.coalesce(f"u{c}", F.lit(0.0))).alias(c) for c in "ij"))
        step = Stored(new)
        state.drop()
        hooks.drop()
        state = step
    kept = [t.df.select("z", "a", "b") for t in chosen] or [edge.df.select("z", "a", "b").limit(0)]
    forest = Stored(edge.df.join(reduce(DataFrame.union, kept).distinct(), ["z", "a", "b"], "left_semi"))
    first = state.df.groupBy("z", "root").agg(F.min_by(F.struct("node", "i", "j"), "node").alias("f"))
    places = Stored(state.df.join(first, ["z", "root"]).select("z", "node", F.col("f.node").alias("root"), (F.col("i") - F.col("f.i")).alias("i"), (F.col("j") - F.col("f.j")).alias("j")))
    for t in (*chosen, left, state, edge):
        t.drop()
    return forest, places


# Overviews

FOUND = "z int, tile long, i int, j int, r double"
#: Bytes of tiles, at the coarsest level, that meet a chunk of the overview in one row.
PACK = 1 << 20


def shrunk(img: np.ndarray, times: int) -> np.ndarray:
    """Means of two by two pixels, rounded half to even, so many times; odd rows and columns at the end go."""
    for _ in range(times):
        h, w = img.shape[0] // 2, img.shape[1] // 2
        img = np.rint(img[: 2 * h, : 2 * w].reshape(h, 2, w, 2).astype(float).mean((1, 3))).astype(np.uint8)
    return img


#: Templates of more pixels are correlated by Fourier transforms, others as one product of matrices.
SMALL = 256
#: Numbers of that product that are held at once.
HELD = 1 << 20


def best_offsets(templates: np.ndarray, window: np.ndarray, keep: int, rows: int, cols: int) -> list[list[tuple[int, int, float]]]:
    """For each template (row, column, r) from 0 of the ``keep`` best offsets within the first ``rows`` and ``cols``, ties to
    smaller columns, then rows; none for a constant template, or for a window that is smaller than the templates.

    The correlation is 0 where the window's variance is at most 1e-4.
    """
    h, w = templates.shape[1:]
    rows, cols = min(rows, window.shape[0] - h + 1), min(cols, window.shape[1] - w + 1)
    if rows < 1 or cols < 1:
        return [[] for _ in templates]
    if h * w > SMALL:
        flat = (bm.ncc(t.astype(float), window.astype(float))[:rows, :cols].T.ravel() for t in templates)
        return [_top(x, keep, rows) for x in flat]
    views = np.lib.stride_tricks.sliding_window_view(window, (h, w))[:rows, :cols]
    # In order of columns, so that ties are in order too.
    views = views.transpose(1, 0, 2, 3).reshape(rows * cols, h * w).astype(float)
    views -= views.mean(1, keepdims=True)
    power = (views * views).sum(1)
    flat_there = power <= 1e-4 * h * w
    views /= np.where(flat_there, 1.0, np.sqrt(power))[:, None]
    views[flat_there] = 0
    out, step = [], max(1, HELD // len(views))
    for k in range(0, len(templates), step):
        t = templates[k : k + step].reshape(-1, h * w).astype(float)
        t -= t.mean(1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            t /= np.sqrt((t * t).sum(1, keepdims=True))
        out += [_top(x, keep, rows) for x in t @ views.T]
    return out


def _top(xc: np.ndarray, keep: int, rows: int) -> list[tuple[int, int, float]]:
    if np.isnan(xc).any():
        return []
    if keep < xc.size:
        # Rounding comes after, and may put what is a little less at par.
        at = np.flatnonzero(xc >= np.partition(xc, -keep)[-keep] - 2e-9)
    else:
        at = np.arange(xc.size)
    r = np.round(xc[at], 9)
    first = np.argsort(-r, kind="stable")[:keep]
    return [(int(at[k] % rows), int(at[k] // rows), float(r[k])) for k in first]


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("z", "tile").orderBy(F.col("r").desc(), "j", "i")
    return found.distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep).drop("k")


def _refiner(h: int, w: int, keep: int):
    """Search of each tile around each of its offsets."""

    def refine(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                template = np.frombuffer(r.img, np.uint8).reshape(1, h, w)
                for box in r.boxes:
                    i0, i1, j0, j1 = (int(box[f"b{a}{e}"]) for a in "ij" for e in "01")
                    window = np.zeros((i1 - i0 + 1, j1 - j0 + 1), np.uint8)
                    for p in box["parts"]:
                        block = np.stack([np.frombuffer(s, np.uint8) for s in p["strips"]])
                        window[p["top"] - i0 : p["top"] - i0 + block.shape[0], p["left"] - j0 : p["left"] - j0 + block.shape[1]] = block
                    out += [(r.z, r.tile, i0 + i, j0 + j, x) for i, j, x in best_offsets(template, window, keep, i1, j1)[0]]
            yield pd.DataFrame(out, columns=["z", "tile", "i", "j", "r"])

    return refine


def place_in_overview(tiles: DataFrame, overview: DataFrame, size: int, extent: tuple[int, int], tile_shape: tuple[int, int], levels: int, keep: int = 4, margin: int = 2, shrink: int = 0) -> DataFrame:
    """(z, tile, i, j, r): where each tile lies in its section's overview, by the greatest correlation.

    ``tiles`` has z, tile (once in a section) and ``img``, bytes of ``tile_shape``; they are halved ``shrink`` times to the overview's resolution.
    ``overview`` holds chunks of levels 0 to ``levels``, of ``extent`` pixels at level 0. The coarsest level is searched as a
    whole: batches of tiles meet its chunks, each with a halo. The ``keep`` best offsets go down a level, where the overview
    around them, ``margin`` pixels to each side, is cut out of its chunks. Places count in pixels of the overview at level 0,
    from 1. Ties go to smaller j, then i. Constant tiles, null images and sections without an overview give no row.
    """
    h, w = (n >> (shrink + levels) for n in tile_shape)
    if min(h, w) < 2:
        raise ValueError("a tile must keep two by two pixels at the coarsest level")
    t = tiles.where("z is not null and tile is not null and img is not null").select(F.col("z").cast("int").alias("z"), F.col("tile").cast("long").alias("tile"), "img")

    def at_level(level: int) -> DataFrame:
        """The tiles' images at a level, so that no more than this is shuffled."""

        def run(batches):
            for b in batches:
                yield b.assign(img=[shrunk(np.frombuffer(x, np.uint8).reshape(tile_shape), shrink + level).tobytes() for x in b.img])

        return t.mapInPandas(run, "z int, tile long, img binary") if shrink + level else t

    high, wide = (n >> levels for n in extent)

    # The coarsest level as a whole.
    at = lambda a, c, o: (F.col(c) * size + o).alias(a)
    coarse = overview.where(F.col("mip") == levels)
    boxes = coarse.select("z", F.col("z").alias("own"), F.col("ci").alias("oi"), F.col("cj").alias("oj"), at("i0", "ci", 1), at("i1", "ci", size + h - 1), at("j0", "cj", 1), at("j1", "cj", size + w - 1))

    def halo(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        z, oi, oj = key
        img = assembled(p, oi * size + 1, oi * size + size + h - 1, oj * size + 1, oj * size + size + w - 1)
        return pd.DataFrame({"z": [z], "oi": [oi], "oj": [oj], "part": [img.tobytes()]})

    parts = pieces(boxes, coarse, size).groupBy("own", "oi", "oj").applyInPandas(halo, "z int, oi int, oj int, part binary")
    groups = at_level(levels).join(t.groupBy("z").agg(F.ceil(F.count(F.lit(1)) * (h * w) / PACK).alias("n")), "z").withColumn("g", F.pmod(F.xxhash64("tile"), "n"))
    packs = groups.groupBy("z", "g").agg(F.collect_list(F.struct("tile", "img")).alias("pack"))

    def search(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                i0, j0 = r.oi * size, r.oj * size
                img = np.frombuffer(r.part, np.uint8).reshape(size + h - 1, size + w - 1)[: high - i0, : wide - j0]
                templates = np.frombuffer(b"".join(one["img"] for one in r.pack), np.uint8).reshape(-1, h, w)
                for one, got in zip(r.pack, best_offsets(templates, img, keep, size, size), strict=True):
                    out += [(r.z, one["tile"], i0 + i + 1, j0 + j + 1, x) for i, j, x in got]
            yield pd.DataFrame(out, columns=["z", "tile", "i", "j", "r"])

    found = _ranked(dealt(packs.join(parts, "z").select("z", "g", "oi", "oj", "part", "pack"), "z", "g", "oi", "oj").mapInPandas(search, FOUND), keep)

    for level in range(levels - 1, -1, -1):
        th, tw = (n >> (shrink + level) for n in tile_shape)
        lh, lw = (n >> level for n in extent)
        lo = lambda c: F.greatest(F.lit(1), 2 * F.col(c) - 1 - margin).cast("int")
        hi = lambda c, n, m: F.least(F.lit(n), 2 * F.col(c) - 1 + margin + m).cast("int")
        boxes = found.select("z", F.col("z").alias("own"), "tile", lo("i").alias("bi0"), hi("i", lh, th).alias("bi1"), lo("j").alias("bj0"), hi("j", lw, tw).alias("bj1"))
        boxes = boxes.withColumns({f"{a}{e}": F.col(f"b{a}{e}") for a in "ij" for e in "01"})
        # A tile has ``keep`` boxes, and a box few parts.
        box = ["bi0", "bi1", "bj0", "bj1"]
        parts = pieces(boxes, overview.where(F.col("mip") == level), size).groupBy("own", "tile", *box).agg(F.collect_list(F.struct("top", "left", "strips")).alias("parts"))
        cut = parts.groupBy(F.col("own").alias("z"), "tile").agg(F.collect_list(F.struct(*box, "parts")).alias("boxes"))
        found = _ranked(cut.join(at_level(level), ["z", "tile"]).mapInPandas(_refiner(th, tw, keep), FOUND), keep)
    return _ranked(found, 1)
