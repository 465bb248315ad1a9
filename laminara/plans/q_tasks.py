"""Queries of whole tasks on planes in chunks: rendering, matching, filtering, translations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.operators import blockmatch as bm
from laminara.operators import chunks as ch
from laminara.operators import matching as mt
from laminara.operators import mesh as ms
from laminara.operators import render as rn
from laminara.operators import stats as st
from laminara.operators import warp as wp
from laminara.plans.q_systems import scratch
from laminara.sources import storage
from laminara.sources.derive import ACROSS, SQL_PLANE, SQL_PX, mosaic, mosaic_extent, table
from laminara.streaming import tasks as tk

R = st.r
SIZE = 64

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def layer(chunks: DataFrame, f) -> DataFrame:
    """Chunks at the same places whose pixels are ``f`` of section, row and column."""

    def run(parts):
        for t in parts:
            for r in t.itertuples():
                i, j = np.mgrid[r.ci * SIZE + 1 : (r.ci + 1) * SIZE + 1, r.cj * SIZE + 1 : (r.cj + 1) * SIZE + 1]
                yield ch.chunk_row(r.z, 0, r.ci, r.cj, f(r.z, i, j).astype(np.uint8))

    return chunks.select("z", "ci", "cj").mapInPandas(run, storage.CHUNK)


def stored_volume(spark: SparkSession, chunks: DataFrame, path: str) -> DataFrame:
    storage.write_volume(chunks, path)
    return storage.read_volume(spark, path, mip=0)


def source_layers(spark: SparkSession, sf: str, folder: str, split: bool) -> dict[str, DataFrame]:
    image = stored_volume(spark, mosaic(spark, sf, SIZE), f"{folder}/image")
    out = {"image": image, "roi": stored_volume(spark, layer(image, lambda z, i, j: (i + 2 * j + z) % 7 != 3), f"{folder}/roi")}
    if split:
        out["split"] = stored_volume(spark, layer(image, lambda z, i, j: np.where(j <= 100, 1, np.where(j <= 102, 0, 2))), f"{folder}/split")
    return out


# Rendering

#: How far the two sub-sections of every plane are moved.
SHIFTS = {1: (3.0, 5.5), 2: (-2.0, 4.25)}
RENDERED = f"""WITH {SQL_PLANE}, kept AS (SELECT *, CASE WHEN j <= 100 THEN 1 WHEN j <= 102 THEN 0 ELSE 2 END AS sub FROM plane WHERE (i + 2 * j + z) % 7 <> 3),
shift AS (SELECT * FROM (VALUES {", ".join(f"({s}, {int(di)}, {dj}::DOUBLE)" for s, (di, dj) in SHIFTS.items())}) t(sub, di, dj)),
spread AS (SELECT z, sub, i + di AS i, j + c AS j, sum(px * (1 - abs(c - dj))) AS v FROM kept JOIN shift USING (sub), generate_series(4, 6) g(c) WHERE abs(c - dj) < 1 GROUP BY ALL),
m0 AS (SELECT CASE WHEN z % 3 = 0 THEN z + 100 ELSE z END AS z, i, j, max(CAST(round_even(round(v, 6), 0) AS INT)) AS px FROM spread, extent WHERE i BETWEEN 1 AND h AND j BETWEEN 1 AND w GROUP BY ALL),
m1 AS (SELECT z, (i - 1) // 2 + 1 AS i, (j - 1) // 2 + 1 AS j, CAST(round_even(sum(px) / 4.0::DOUBLE, 0) AS INT) AS px FROM m0 GROUP BY ALL),
m2 AS (SELECT z, (i - 1) // 2 + 1 AS i, (j - 1) // 2 + 1 AS j, CAST(round_even(sum(px) / 4.0::DOUBLE, 0) AS INT) AS px FROM m1 GROUP BY ALL)
SELECT mip, CAST(z AS INT) AS z, CAST(i AS INT) AS i, CAST(j AS INT) AS j, px FROM (SELECT 0 AS mip, * FROM m0 UNION ALL SELECT 1, * FROM m1 UNION ALL SELECT 2, * FROM m2) WHERE px > 0"""


def meshes(spark: SparkSession, sf: str, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triangles, and the nodes of both sub-sections of every plane with where they go."""
    lattice = ms.Lattice(*(float(x) for x in mosaic_extent(spark, sf)), 40.0)
    subs = spark.createDataFrame([(s, di, dj) for s, (di, dj) in SHIFTS.items()], "sub int, di double, dj double")
    n = ms.nodes(spark, lattice).join(F.broadcast(subs), F.lit(True)).select("sub", "node", "src_i", "src_j", (F.col("src_i") + F.col("di")).alias("dst_i"), (F.col("src_j") + F.col("dj")).alias("dst_j"))
    # Planes times nodes are the meshes themselves.
    return wp.triangles(spark, lattice), sections.join(n, F.lit(True))


def rendered(spark: SparkSession, sf: str, folder: str) -> None:
    """Stored layers and meshes, one message for each section, and a stream that renders them to ``folder``/out."""
    layers = source_layers(spark, sf, folder, True)
    height, width = mosaic_extent(spark, sf)
    sections = layers["image"].select("z").distinct()
    triangles, place = meshes(spark, sf, sections)
    place.write.mode("overwrite").partitionBy("z").parquet(f"{folder}/meshes")
    tri = rn.placed_triangles(triangles, spark.read.parquet(f"{folder}/meshes"))
    z_map = spark.range(0, 12, 3).select(F.col("id").cast("int").alias("old_z"), (F.col("id") + 100).cast("int").alias("new_z"))
    tk.publish(tk.pair_tasks(sections.select(F.col("z").alias("src_z"), F.col("z").alias("dst_z")), "render", "{}").coalesce(2), f"{folder}/queue")
    handlers = {"render": tk.render_task(layers, tri, f"{folder}/out", SIZE, (1, height, 1, width), 2, z_map)}
    tk.subscribe(spark, f"{folder}/queue", f"{folder}/state", handlers).awaitTermination()


@query("tsk_render", RENDERED)
def tsk_render(spark, sf):
    """All planes masked, split, warped, merged, stored with two lower levels and read again."""
    folder = scratch(spark)
    rendered(spark, sf, folder)
    return storage.from_chunks(storage.read_volume(spark, f"{folder}/out")).select("mip", "z", "i", "j", "px")


# Matching

BLOCK_R, SEARCH_R = 4, 3
FULL = 2 * (BLOCK_R + SEARCH_R) + 1
LOW, HIGH = round((FULL - 1) / 4), round(3 * (FULL - 1) / 4)
ODD = lambda c, n: f"least({c} + {BLOCK_R}, {n}) - greatest({c} - {BLOCK_R}, 1) + 1 - (least({c} + {BLOCK_R}, {n}) - greatest({c} - {BLOCK_R}, 1) + 1 + 1) % 2"
MATCHED = f"""WITH {SQL_PLANE}, img AS (SELECT z, i, j, px FROM plane WHERE (i + 2 * j + z) % 7 <> 3),
node AS (SELECT DISTINCT tile // 10 AS node, tile // 10 // {ACROSS} * 8 + 4 AS ci, tile // 10 % {ACROSS} * 8 + 4 AS cj FROM px),
task AS (SELECT a.z AS src_z, b.z AS dst_z, node.*, greatest(ci - {BLOCK_R}, 1) AS i0, greatest(cj - {BLOCK_R}, 1) AS j0, {ODD("ci", "extent.h")} AS th, {ODD("cj", "extent.w")} AS tw
FROM (SELECT DISTINCT z FROM plane) a JOIN (SELECT DISTINCT z FROM plane) b ON b.z = a.z + 1, node, extent),
t0 AS (SELECT src_z, dst_z, node, th, tw, a, b, COALESCE(px, 0) AS t FROM task CROSS JOIN generate_series(0, {2 * BLOCK_R}) x(a) CROSS JOIN generate_series(0, {2 * BLOCK_R}) y(b) LEFT JOIN img ON img.z = src_z AND img.i = i0 + a AND img.j = j0 + b WHERE a < th AND b < tw),
x0 AS (SELECT src_z, dst_z, node, a, b, COALESCE(px, 0) AS x FROM task CROSS JOIN generate_series(0, {FULL - 1}) x(a) CROSS JOIN generate_series(0, {FULL - 1}) y(b) LEFT JOIN img ON img.z = dst_z AND img.i = ci - {BLOCK_R + SEARCH_R} + a AND img.j = cj - {BLOCK_R + SEARCH_R} + b),
tg AS (SELECT src_z, dst_z, node, avg(t) AS tm FROM t0 GROUP BY ALL HAVING least(sum(t) FILTER (b = 0), sum(t) FILTER (b = tw - 1), sum(t) FILTER (a = 0), sum(t) FILTER (a = th - 1), sum(t) FILTER (b = tw // 2), sum(t) FILTER (a = th // 2)) > 0 AND var_pop(CASE WHEN t = 0 THEN 0 ELSE t END) > 0),
xg AS (SELECT src_z, dst_z, node, avg(x) AS xm FROM x0 GROUP BY ALL HAVING least(sum(x) FILTER (a = {LOW} AND b BETWEEN {LOW} AND {HIGH}), sum(x) FILTER (a = {HIGH} AND b BETWEEN {LOW} AND {HIGH}), sum(x) FILTER (b = {LOW} AND a BETWEEN {LOW} AND {HIGH}), sum(x) FILTER (b = {HIGH} AND a BETWEEN {LOW} AND {HIGH})) > 0),
t AS (SELECT src_z, dst_z, node, th, tw, a, b, CASE WHEN t = 0 THEN tm ELSE t END AS t FROM t0 JOIN tg USING (src_z, dst_z, node)),
x AS (SELECT src_z, dst_z, node, a, b, CASE WHEN x = 0 THEN xm ELSE x END AS x FROM x0 JOIN xg USING (src_z, dst_z, node)),
r AS MATERIALIZED (SELECT src_z, dst_z, node, max(th) AS th, max(tw) AS tw, x.a - t.a AS oi, x.b - t.b AS oj, CASE WHEN var_pop(x) <= 1e-4 THEN 0 ELSE corr(t, x) END AS r
FROM t JOIN x USING (src_z, dst_z, node) WHERE x.a - t.a BETWEEN 0 AND {FULL} - th AND x.b - t.b BETWEEN 0 AND {FULL} - tw GROUP BY src_z, dst_z, node, x.a - t.a, x.b - t.b),
top AS (SELECT src_z, dst_z, node, arg_max(struct_pack(oi := oi, oj := oj), struct_pack(r := r, oj := -oj, oi := -oi)) AS p, max(r) AS r_max, max(th) AS th, max(tw) AS tw FROM r GROUP BY ALL),
fine AS (SELECT top.src_z, top.dst_z, top.node, sum((oi - p.oi) * r) / sum(r) AS fi, sum(CASE WHEN abs(oi - p.oi) <= 1 AND abs(oj - p.oj) <= 1 THEN (oj - p.oj) * r ELSE 0 END) / sum(r) AS fj
FROM top JOIN r ON r.src_z = top.src_z AND r.dst_z = top.dst_z AND r.node = top.node AND abs(oi - p.oi) <= 2 AND abs(oj - p.oj) <= 2
WHERE p.oi BETWEEN 2 AND {FULL} - top.th - 2 AND p.oj BETWEEN 2 AND {FULL} - top.tw - 2 GROUP BY ALL)
SELECT src_z, dst_z, CAST(node AS INT) AS node, round(p.oi + COALESCE(fi, 0) - (i0 - (ci - {BLOCK_R + SEARCH_R})), 4) + 0.0 AS dv_i, round(p.oj + COALESCE(fj, 0) - (j0 - (cj - {BLOCK_R + SEARCH_R})), 4) + 0.0 AS dv_j, round(r_max, 6) + 0.0 AS r_max
FROM top JOIN task USING (src_z, dst_z, node) LEFT JOIN fine USING (src_z, dst_z, node)"""


def tile_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A node at each tile's middle."""
    k = table(spark, sf, "embeddings").select(F.expr("cast(vec_id div 10 as int)").alias("node")).distinct()
    return k.select("node", F.expr(f"cast(node div {ACROSS} * 8 + 4 as double)").alias("src_i"), (F.col("node") % ACROSS * 8 + 4).cast("double").alias("src_j"))


def matched(spark: SparkSession, sf: str, folder: str, **more) -> None:
    """Stored layers, one message for each pair of neighbours, and a stream that matches them to ``folder``/matches."""
    layers = source_layers(spark, sf, folder, more.pop("split", False))
    z = layers["image"].select("z").distinct()
    pairs = z.select(F.col("z").alias("src_z"), (F.col("z") + 1).alias("dst_z")).join(z.withColumnRenamed("z", "dst_z"), "dst_z")
    tk.publish(tk.pair_tasks(pairs, "match", "{}").coalesce(2), f"{folder}/queue")
    handlers = {"match": tk.match_task(layers, tile_nodes(spark, sf), f"{folder}/matches", SIZE, mosaic_extent(spark, sf), BLOCK_R, SEARCH_R, **more)}
    tk.subscribe(spark, f"{folder}/queue", f"{folder}/state", handlers).awaitTermination()


@query("tsk_match", MATCHED)
def tsk_match(spark, sf):
    """All pairs of neighbouring planes matched at every tile, stored by pair and read again."""
    folder = scratch(spark)
    matched(spark, sf, folder)
    found = spark.read.schema(mt.FOUND).parquet(f"{folder}/matches")
    return found.select("src_z", "dst_z", "node", *(F.round(c, 4).alias(c) for c in ("dv_i", "dv_j")), R(F.col("r_max")).alias("r_max"))


PATCH = f"""WITH {SQL_PLANE}, img AS (SELECT z, i, j, px FROM plane WHERE (i + 2 * j + z) % 7 <> 3), m AS ({MATCHED}),
one AS (SELECT src_z, dst_z, node // {ACROSS} * 8 + 4 AS ci, node % {ACROSS} * 8 + 4 AS cj FROM m ORDER BY r_max, src_z, dst_z, node LIMIT 1),
box AS (SELECT 'src' AS layer, src_z AS z, greatest(ci - {BLOCK_R}, 1) AS i0, greatest(cj - {BLOCK_R}, 1) AS j0, {ODD("ci", "h")} AS n, {ODD("cj", "w")} AS k FROM one, extent
UNION ALL SELECT 'dst', dst_z, ci - {BLOCK_R + SEARCH_R}, cj - {BLOCK_R + SEARCH_R}, {FULL}, {FULL} FROM one),
spot AS (SELECT layer, z, i0 + a AS i, j0 + b AS j FROM box, generate_series(0, {FULL}) x(a), generate_series(0, {FULL}) y(b) WHERE a < n AND b < k)
SELECT layer, CAST(i AS INT) AS i, CAST(j AS INT) AS j, COALESCE(px, 0)::DOUBLE AS v FROM spot LEFT JOIN img USING (z, i, j)"""


@query("mat_patches", PATCH)
def mat_patches(spark, sf):
    """Block and window of the weakest of all correspondences, ties to smaller sections and nodes."""
    folder = scratch(spark)
    matched(spark, sf, folder)
    found = spark.read.schema(mt.FOUND).parquet(f"{folder}/matches")
    one = found.orderBy(F.round("r_max", 6), "src_z", "dst_z", "node").select("src_z", "dst_z", "node").first()
    out = mt.correspondence_patches(spark, f"{folder}/matches", f"{folder}/image", f"{folder}/roi", *one, SIZE, mosaic_extent(spark, sf), BLOCK_R, SEARCH_R)
    return out.where("layer <> 'xc'")


# Filtering and translations

SIGMAS = (0.7, 1.6)
GAUSS = lambda s: f"(CASE WHEN greatest(abs(a), abs(b)) <= {bm.reach(s)} THEN exp(-(a * a + b * b) / {2 * s * s}) / {float(bm.gauss(s).max() ** -2)!r} ELSE 0 END)"
REACH = bm.reach(SIGMAS[1])


@query("mat_bandpass", f"""WITH {SQL_PLANE}, grid AS (SELECT z, i, j FROM (SELECT DISTINCT z FROM plane), extent, generate_series(1, h) x(i), generate_series(1, w) y(j)),
img AS (SELECT g.z, g.i, g.j, COALESCE(px, 0) AS px FROM grid g LEFT JOIN plane p ON p.z = g.z AND p.i = g.i AND p.j = g.j), mean AS (SELECT z, avg(px) AS m FROM img GROUP BY z),
kernel AS (SELECT a, b, {GAUSS(SIGMAS[0])} - {GAUSS(SIGMAS[1])} AS w FROM generate_series({-REACH}, {REACH}) x(a), generate_series({-REACH}, {REACH}) y(b))
SELECT g.z, CAST(g.i AS INT) AS i, CAST(g.j AS INT) AS j, round(sum(kernel.w * COALESCE(p.px, m)), 4) + 0.0 AS v FROM grid g CROSS JOIN kernel JOIN mean USING (z) LEFT JOIN img p ON p.z = g.z AND p.i = g.i + a AND p.j = g.j + b GROUP BY ALL""")
def mat_bandpass(spark, sf):
    """The band of every plane between two Gaussians, chunk by chunk with halos."""
    height, width = mosaic_extent(spark, sf)
    out = ch.filtered(mosaic(spark, sf, SIZE), SIZE, height, width, REACH, lambda img: bm.bandpassed(img, SIGMAS))

    def rows(parts):
        for t in parts:
            for r in t.itertuples():
                v = np.frombuffer(r.data).reshape(SIZE, SIZE)[: height - r.ci * SIZE, : width - r.cj * SIZE]
                i, j = np.mgrid[: v.shape[0], : v.shape[1]]
                yield pd.DataFrame({"z": r.z, "i": i.ravel() + r.ci * SIZE + 1, "j": j.ravel() + r.cj * SIZE + 1, "v": v.ravel()})

    return out.mapInPandas(rows, "z int, i int, j int, v double").withColumn("v", F.round("v", 4) + 0.0)


LEAST = 24


@query("mat_translation", f"""WITH {SQL_PX}, r AS (SELECT b.tile AS tile, b.i - a.i AS di, b.j - a.j AS dj, round(corr(a.px, b.px), 9) AS r, count(*) AS n FROM px a JOIN px b ON b.tile = a.tile + 10 GROUP BY ALL HAVING count(*) >= {LEAST} AND var_pop(a.px) > 0 AND var_pop(b.px) > 0)
SELECT tile, CAST(p.di AS INT) AS di, CAST(p.dj AS INT) AS dj, round(r, 6) + 0.0 AS r FROM (SELECT tile, arg_max(struct_pack(di := di, dj := dj), struct_pack(r := r, di := -di, dj := -dj)) AS p, max(r) AS r FROM r GROUP BY tile)""")
def mat_translation(spark, sf):
    """The shift at which each tile agrees best with the next one of its plane, over all that overlap enough."""
    bytes_ = "unhex(array_join(transform(embedding, v -> lpad(hex(cast(least(255, greatest(0, floor(cast(v as double) * 127.5 + 127.5))) as bigint)), 2, '0')), ''))"
    t = table(spark, sf, "embeddings").select(F.col("vec_id").alias("tile"), F.expr(bytes_).alias("img"))
    pairs = t.select((F.col("tile") + 10).alias("tile"), F.col("img").alias("src")).join(t.withColumnRenamed("img", "dst"), "tile")
    eight = {c: F.lit(8) for c in ("src_h", "src_w", "dst_h", "dst_w")}
    return mt.translations(pairs.withColumns(eight), LEAST).withColumn("r", R(F.col("r")))
