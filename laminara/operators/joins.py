"""Joins: section pairs, neighbours within a radius, overlapping boxes, merging and pruning of match sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laminara.functions.names import z_of

ENDS = ["src_z", "dst_z"]


def section_pairs(sections: DataFrame, depth: int = 1, symmetric: bool = False) -> DataFrame:
    """(src_z, dst_z) with 1 <= dst - src <= depth, among the given sections; both ways if symmetric.

    Each section names the ``depth`` sections after it, which are then hash-joined; a range condition would make
    Spark compare all pairs.
    """
    z = sections.select(F.col("z").cast("int").alias("z")).distinct()
    ahead = z.select(F.col("z").alias("src_z"), F.explode(F.sequence(F.col("z") + 1, F.col("z") + depth)).alias("dst_z"))
    out = ahead.join(z.select(F.col("z").alias("dst_z")), "dst_z", "left_semi").select(*ENDS)
    if symmetric:
        out = out.unionByName(out.select(F.col("dst_z").alias("src_z"), F.col("src_z").alias("dst_z")))
    return out.distinct()


def subsection_pairs(index: DataFrame, depth: int = 1) -> DataFrame:
    """(src_idx, dst_idx) of fractional indices whose sections are a pair."""
    rows = index.select("idx", z_of(F.col("idx")).alias("z")).distinct()
    ahead = rows.select(F.col("idx").alias("src_idx"), F.explode(F.sequence(F.col("z") + 1, F.col("z") + depth)).alias("z"))
    return ahead.join(rows.withColumnRenamed("idx", "dst_idx"), "z").select("src_idx", "dst_idx")


def is_preceding(a: Column, b: Column, within: int = 1) -> Column:
    return (z_of(b) - z_of(a)).between(1, within)


def component_matches(pairs: DataFrame, components: DataFrame, defect: int = 0) -> DataFrame:
    """One match for each two components of a pair of sections, but for the defect value."""
    good = components.where(F.col("v") != defect).select("z", "v").distinct()
    left = good.select(F.col("z").alias("src_z"), F.col("v").alias("src_v"))
    right = good.select(F.col("z").alias("dst_z"), F.col("v").alias("dst_v"))
    return pairs.join(left, "src_z").join(right, "dst_z").select("src_z", "src_v", "dst_z", "dst_v")


def concat_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both sets; where both have a key, only the first set's rows."""
    return a.unionByName(b.join(a.select(*keys).distinct(), keys, "left_anti"))


def remove_section(matches: DataFrame, z: int) -> DataFrame:
    return matches.where((F.col("src_z") != z) & (F.col("dst_z") != z))


def missing_endpoints(matches: DataFrame, meshes: DataFrame) -> DataFrame:
    """(idx, parent): end points without a mesh, with the section whose mesh to copy."""
    ends = matches.select(F.col("src_idx").alias("idx")).union(matches.select("dst_idx")).distinct()
    lacking = ends.join(meshes.select("idx"), "idx", "left_anti").withColumn("parent", z_of(F.col("idx")).cast("decimal(12,3)"))
    return lacking.join(meshes.select(F.col("idx").alias("parent")), "parent", "left_semi").select("idx", "parent")


def prune(counts: DataFrame, meshes: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Matches and meshes that stay. ``counts`` has src_z, dst_z, n, n_acc; ``meshes`` has z.

    A match counts if more than ``least`` rows are accepted and both meshes exist; a mesh stays with ``least`` or more
    over its counting matches, a counting match if both its meshes stay.
    """
    q = counts.where((F.col("n_acc") > least) & (F.col("n") > 0))
    for c in ENDS:
        q = q.join(meshes.select(F.col("z").alias(c)), c, "left_semi")
    ends = q.select(F.col("src_z").alias("z"), "n_acc").unionByName(q.select(F.col("dst_z").alias("z"), "n_acc"))
    kept = ends.groupBy("z").agg(F.sum("n_acc").alias("total")).where(F.col("total") >= least).select("z")
    stay = q
    for c in ENDS:
        stay = stay.join(kept.select(F.col("z").alias(c)), c, "left_semi")
    return stay.select(*counts.columns), meshes.join(kept, "z", "left_semi")


def neighbours(rows: DataFrame, keys: list[str], id_: str, i: str, j: str, radius: float, values: list[str]) -> DataFrame:
    """For each row the other rows of its keys within the radius (exclusive, and not at distance zero).

    Rows are dealt into squares as wide as the radius; each row looks into its own and the eight around, so only
    those are compared. Returns keys, ``id_``, and the neighbours' values with the prefix "n_".
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("s")
    left = rows.select(*keys, id_, F.col(i).alias("_i"), F.col(j).alias("_j"), around, cell(i).alias("_ci"), cell(j).alias("_cj"))
    left = left.withColumn("_ci", F.col("_ci") + F.col("s.a")).withColumn("_cj", F.col("_cj") + F.col("s.b")).drop("s")
    right = rows.select(*keys, F.col(i).alias("_ni"), F.col(j).alias("_nj"), cell(i).alias("_ci"), cell(j).alias("_cj"), *(F.col(v).alias(f"n_{v}") for v in values))
    d2 = (F.col("_i") - F.col("_ni")) * (F.col("_i") - F.col("_ni")) + (F.col("_j") - F.col("_nj")) * (F.col("_j") - F.col("_nj"))
    return left.join(right, [*keys, "_ci", "_cj"]).where((d2 > 0) & (d2 < radius * radius)).select(*keys, id_, d2.alias("d2"), *(f"n_{v}" for v in values))


def consensus(rows: DataFrame, radius: float, accepted_neighbours: bool = False) -> DataFrame:
    """Per row: the number of neighbours, its shift's standard score against theirs, and its distance from their mean.

    A row without neighbours has an infinite score and no distance; a neighbourhood without spread scores a row that
    differs as infinite and one that doesn't as zero.
    """
    near = neighbours(rows, ENDS, "corr_id", "pre_i", "pre_j", radius, ["dv_i", "dv_j", "rejected"])
    if accepted_neighbours:
        near = near.where("not n_rejected")
    stats = near.groupBy(*ENDS, "corr_id").agg(F.count(F.lit(1)).alias("n"), *(f(f"n_{c}").alias(f"{k}_{c}") for c in ("dv_i", "dv_j") for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = rows.join(stats, [*ENDS, "corr_id"], "left")
    inf = F.lit(float("inf"))

    def z(c: str) -> Column:
        off = F.col(c) - F.col(f"m_{c}")
        return F.when(F.col("n").isNull(), inf).when(F.col(f"s_{c}") > 1e-9, off / F.col(f"s_{c}")).when(F.abs(off) < 1e-9, 0.0).otherwise(inf)

    return out.select(*rows.columns, F.coalesce("n", F.lit(0)).alias("n_near"), F.sqrt(z("dv_i") * z("dv_i") + z("dv_j") * z("dv_j")).alias("score"), F.hypot(F.col("dv_i") - F.col("m_dv_i"), F.col("dv_j") - F.col("m_dv_j")).alias("off"))


#: Ids of one shape that meet another shape in one row.
MEMBERS = 256


def box_overlaps(boxes: DataFrame, cell: int = 100) -> DataFrame:
    """(a, b) for all two boxes (id, i, j, h, w) that meet, edges included, in both directions.

    Boxes of equal corner and size are one shape: shapes are compared, and a pair of them is spread over its boxes at the end,
    where only pairs that meet are made. A shape stands in every square of the grid that it touches; a pair is taken from the
    square that holds the upper left corner of what they share, so it comes once.
    """
    shape = ["i", "j", "h", "w"]
    pack = F.floor((F.row_number().over(Window.partitionBy(*shape).orderBy("id")) - 1) / MEMBERS)
    packs = boxes.where("id is not null").withColumn("pack", pack).groupBy(*shape, "pack").agg(F.collect_list("id").alias("ids"))
    span = lambda c, s: F.sequence(F.floor(F.col(c) / cell), F.floor((F.col(c) + F.col(s)) / cell))
    laid = packs.withColumn("ci", F.explode(span("i", "h"))).withColumn("cj", F.explode(span("j", "w")))
    # What a square yields grows with the square of its rows: few bytes must not be put together into few tasks.
    laid = laid.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ci", "cj")
    a, b = laid.alias("a"), laid.alias("b")
    hit = (F.col("a.i") <= F.col("b.i") + F.col("b.h")) & (F.col("b.i") <= F.col("a.i") + F.col("a.h")) & (F.col("a.j") <= F.col("b.j") + F.col("b.w")) & (F.col("b.j") <= F.col("a.j") + F.col("a.w"))
    once = (F.floor(F.greatest("a.i", "b.i") / cell) == F.col("a.ci")) & (F.floor(F.greatest("a.j", "b.j") / cell) == F.col("a.cj"))
    on = (F.col("a.ci") == F.col("b.ci")) & (F.col("a.cj") == F.col("b.cj"))
    met = a.join(b, on).where(hit & once).select(F.col("a.ids").alias("a_ids"), F.col("b.ids").alias("b_ids"))
    return met.select(F.explode("a_ids").alias("a"), "b_ids").select("a", F.explode("b_ids").alias("b")).where("a <> b")


def tile_neighbours(tiles: DataFrame, least: int = 1000) -> DataFrame:
    """(z, a, b): tiles beside or below each other on the grid that share more than ``least`` pixels along the side.

    ``tiles`` has z, row, col, tile, i, j, h, w; each pair comes once.
    """
    step = F.explode(F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")))).alias("s")
    a = tiles.select("z", F.col("tile").alias("a"), *(F.col(c).alias(f"a_{c}") for c in "ijhw"), "row", "col", step)
    a = a.withColumn("row", F.col("row") + F.col("s.dr")).withColumn("col", F.col("col") + F.col("s.dc"))
    b = tiles.select("z", "row", "col", F.col("tile").alias("b"), *(F.col(c).alias(f"b_{c}") for c in "ijhw"))
    common = lambda p, s: F.least(F.col(f"a_{p}") + F.col(f"a_{s}"), F.col(f"b_{p}") + F.col(f"b_{s}")) - F.greatest(f"a_{p}", f"b_{p}")
    j = a.join(b, ["z", "row", "col"])
    return j.withColumn("side", F.when(F.col("s.dc") == 1, common("i", "h")).otherwise(common("j", "w"))).where(F.col("side") > least).select("z", "a", "b", "side")


def nearest(rows: DataFrame, i: float, j: float, n: int = 1) -> DataFrame:
    """The accepted rows nearest to a point, ties to smaller ids; each partition sends on ``n`` rows only."""
    d2 = (F.col("pre_i") - i) * (F.col("pre_i") - i) + (F.col("pre_j") - j) * (F.col("pre_j") - j)
    return rows.where("not rejected").withColumn("d2", d2).orderBy("d2", "corr_id").limit(n)


def nearest_if_single(rows: DataFrame, i: float, j: float, limit: float) -> DataFrame:
    """One row: the id of the point within the limit if there is just one, else 0."""
    d2 = (F.col("pre_i") - i) * (F.col("pre_i") - i) + (F.col("pre_j") - j) * (F.col("pre_j") - j)
    near = rows.where(d2 < limit * limit)
    return near.agg(F.when(F.count(F.lit(1)) == 1, F.min("corr_id")).otherwise(F.lit(0).cast("long")).alias("corr_id"))


def segment_distance2(i: float, j: float) -> Column:
    """Squared distance of a point from the segment pre - pre + dv."""
    wi, wj = i - F.col("pre_i"), j - F.col("pre_j")
    len2 = F.col("dv_i") * F.col("dv_i") + F.col("dv_j") * F.col("dv_j")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((wi * F.col("dv_i") + wj * F.col("dv_j")) / F.nullif(len2, F.lit(0.0)), F.lit(0.0))))
    di, dj = wi - t * F.col("dv_i"), wj - t * F.col("dv_j")
    return di * di + dj * dj


def with_offsets(sizes: DataFrame, key: str, n: str) -> DataFrame:
    """First number of each key's range of ``n`` numbers, in order of key. Keys are sections or matches, so few."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("first", F.sum(n).over(w) - F.col(n) + 1)


def gather_sections(dst_to_src: DataFrame, values: DataFrame, fill: int = 0) -> DataFrame:
    """(z, i, j, px): each target section gets its source's pixels; sections without a source are filled."""
    grid = values.select("i", "j").distinct()
    want = dst_to_src.select("dst_z", "src_z")
    got = want.join(values.withColumnRenamed("z", "src_z"), "src_z").select(F.col("dst_z").alias("z"), "i", "j", "px")
    bare = want.join(values.select(F.col("z").alias("src_z")).distinct(), "src_z", "left_anti")
    # The bare sections are few; the grid of a section is met by each of them.
    return got.unionByName(bare.select(F.col("dst_z").alias("z")).join(F.broadcast(grid), F.lit(True)).select("z", "i", "j", F.lit(fill).alias("px")))


def minus_neighbour_mean(rows: DataFrame, keys: list[str], id_: str, i: str, j: str, value: str, radius: float, k: int = 30, finer: int = 10) -> DataFrame:
    """Value minus the mean of the ``k`` nearest rows by the larger of the two distances, within the radius
    (inclusive, itself too); ties to smaller ids. Ids differ within their keys.

    Rows at one place have the same nearest rows, and none but a place's ``k`` smallest ids are among them, so places are
    compared and not rows. A place with ``k`` rows needs no other one. Each other place looks into its own square and the
    eight around, of the finest of ``finer`` halvings of the radius at which its own square holds ``k`` rows: these lie within
    a square's width, so nothing outside is nearer. Below it every square holds fewer, so a square is looked into by few
    places, however dense the rows are.
    """
    place = [*keys, "_i", "_j"]
    # Differences are zero for finite numbers only; others, and nulls, are near to nothing.
    found = rows.select(*keys, F.col(id_).alias("_id"), F.col(i).alias("_i"), F.col(j).alias("_j"), F.col(value).alias("_v")).dropna(subset=keys).where("_i - _i = 0 and _j - _j = 0")
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy(*place).orderBy("_id"))).where(F.col("_k") <= k)
    places = first.groupBy(*place).agg(F.collect_list(F.struct(F.col("_id").alias("id"), F.col("_v").alias("v"))).alias("_near"))
    crowds, sparse = places.where(F.size("_near") >= k), places.where(F.size("_near") < k)

    def laid(df: DataFrame) -> DataFrame:
        cell = lambda c: F.floor(F.col(c) / radius * F.pow(F.lit(2.0), F.col("_l")))
        return df.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(finer)))).withColumns({"_ci": cell("_i"), "_cj": cell("_j")})

    square = [*keys, "_l", "_ci", "_cj"]
    full = laid(places.select(*place, F.size("_near").alias("_n"))).groupBy(*square).agg(F.sum("_n").alias("_n")).where(F.col("_n") >= k).select(*square, F.lit(True).alias("_full"))
    level = laid(sparse.select(*place)).join(full, square, "left").where("_full or _l = 0").groupBy(*place).agg(F.max(F.struct("_l", "_ci", "_cj")).alias("_s")).select(*place, "_s.*")
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("_s")
    asks = level.select(*place, "_l", "_ci", "_cj", around).withColumns({"_ci": F.col("_ci") + F.col("_s.a"), "_cj": F.col("_cj") + F.col("_s.b")}).drop("_s")
    there = laid(places.withColumnsRenamed({"_i": "_ni", "_j": "_nj"}).withColumns({"_i": F.col("_ni"), "_j": F.col("_nj")})).drop("_i", "_j")
    d = F.greatest(F.abs(F.col("_i") - F.col("_ni")), F.abs(F.col("_j") - F.col("_nj")))
    # A little more than a square's width, for the sake of rounding.
    width = F.least(F.lit(float(radius)), F.lit(1.001 * radius) / F.pow(F.lit(2.0), F.col("_l")))
    near = asks.join(there, square).withColumn("_d", d).where(F.col("_d") <= width).select(*place, "_d", F.inline("_near"))
    nearest = near.withColumn("_k", F.row_number().over(Window.partitionBy(*place).orderBy("_d", "id"))).where(F.col("_k") <= k)
    own = crowds.select(*place, F.inline("_near")).groupBy(*place).agg(F.avg("v").alias("_mean"))
    means = own.unionByName(nearest.groupBy(*place).agg(F.avg("v").alias("_mean")))
    return found.join(means, place).select(*keys, F.col("_id").alias(id_), (F.col("_v") - F.col("_mean")).alias("rest"))


def spanning_tree(edge: DataFrame, section: str = "z") -> DataFrame:
    """(section, a, b, r, step): from the smallest tile on, always the best edge with one end in the tree.

    ``edge`` has section, a, b, r. A section's tiles are few thousand at most, so each section is one group. Ties go to
    smaller ends; tiles that no edge reaches are left out.
    """
    import heapq

    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list] = {}
        for a, b, r in zip(rows.a, rows.b, rows.r, strict=True):
            near.setdefault(a, []).append((-r, min(a, b), max(a, b), b))
            near.setdefault(b, []).append((-r, min(a, b), max(a, b), a))
        start = min(near)
        seen, heap, out = {start}, list(near[start]), []
        heapq.heapify(heap)
        while heap:
            r, a, b, to = heapq.heappop(heap)
            if to in seen:
                continue
            seen.add(to)
            out.append((key[0], a, b, -r, len(out) + 1))
            for x in near[to]:
                heapq.heappush(heap, x)
        return pd.DataFrame(out, columns=[section, "a", "b", "r", "step"])

    return edge.select(F.col(section).cast("long").alias(section), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("r").cast("double").alias("r")).groupBy(section).applyInPandas(run, f"{section} long, a long, b long, r double, step int")


def sides(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1): the sides of closed polygons given as array<struct<x, y>> in ``outline``."""
    closed = "transform(outline, (p, k) -> struct(p.x as x0, p.y as y0, outline[(k + 1) % size(outline)].x as x1, outline[(k + 1) % size(outline)].y as y1))"
    return polygons.where("size(outline) > 2").select(*keys, F.inline(F.expr(closed)))


def in_cells(df: DataFrame, cell: float, x: tuple[Column, Column], y: tuple[Column, Column]) -> DataFrame:
    """A row for each grid cell that the box touches."""
    at = lambda c: F.floor(c / cell).cast("long")
    return df.withColumn("cx", F.explode(F.sequence(at(x[0]), at(x[1])))).withColumn("cy", F.explode(F.sequence(at(y[0]), at(y[1]))))


def outlines_meet(tiles: DataFrame, rois: DataFrame, section: str, tile: str, roi: str, cell: float) -> DataFrame:
    """(section, tile, roi) of polygons of a section that have a point in common, edges and corners included.

    Both tables have an ``outline``, convex or not, by the even-odd rule. Sides meet in the grid cells that both touch;
    without a crossing one polygon lies inside the other, which the first corner tells. So work follows sides, whatever
    number a polygon has. Outlines of fewer than three corners and nulls meet nothing.
    """
    few = lambda df, key: df.where("size(outline) > 2").select(section, key, "outline")
    tiles, rois = few(tiles, tile), few(rois, roi)

    def cut(df: DataFrame, key: str, name: str) -> DataFrame:
        e = sides(df, [section, key])
        e = in_cells(e, cell, (F.least("x0", "x1"), F.greatest("x0", "x1")), (F.least("y0", "y1"), F.greatest("y0", "y1")))
        return e.select(section, "cx", "cy", key, *(F.col(c).alias(f"{name}_{c}") for c in ("x0", "y0", "x1", "y1")))

    turn = lambda a, b, x, y: f"(({b}_x - {a}_x) * ({y} - {a}_y) - ({b}_y - {a}_y) * ({x} - {a}_x))"
    near = cut(tiles, tile, "a").join(cut(rois, roi, "b"), [section, "cx", "cy"])
    named = near.withColumnsRenamed({f"{p}_{c}{k}": f"{p}{k}_{c}" for p in "ab" for c in "xy" for k in "01"})
    apart = " and ".join(f"greatest(least(a0_{c}, a1_{c}), least(b0_{c}, b1_{c})) <= least(greatest(a0_{c}, a1_{c}), greatest(b0_{c}, b1_{c}))" for c in "xy")
    both = lambda p, q: f"{turn(f'{p}0', f'{p}1', f'{q}0_x', f'{q}0_y')} * {turn(f'{p}0', f'{p}1', f'{q}1_x', f'{q}1_y')} <= 0"
    crossed = named.where(f"{apart} and {both('a', 'b')} and {both('b', 'a')}").select(section, tile, roi)

    def inside(points: DataFrame, key: str, areas: DataFrame, other: str) -> DataFrame:
        p = points.select(section, key, F.col("outline")[0]["x"].alias("x"), F.col("outline")[0]["y"].alias("y"))
        p = in_cells(p, cell, (F.col("x"), F.col("x")), (F.col("y"), F.col("y")))
        low, high = (lambda c: F.array_min(F.transform("outline", lambda q: q[c]))), (lambda c: F.array_max(F.transform("outline", lambda q: q[c])))
        a = in_cells(areas, cell, (low("x"), high("x")), (low("y"), high("y")))
        cuts = "filter(transform(outline, (p, k) -> struct(p as p, outline[(k + 1) % size(outline)] as q)), e -> (e.p.y > y) <> (e.q.y > y) and x < (e.q.x - e.p.x) * (y - e.p.y) / (e.q.y - e.p.y) + e.p.x)"
        return p.join(a, [section, "cx", "cy"]).where(f"size({cuts}) % 2 = 1").select(section, tile, roi)

    return crossed.union(inside(tiles, tile, rois, roi)).union(inside(rois, roi, tiles, tile)).distinct()
