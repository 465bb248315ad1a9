"""Queries that put tiles into place, and chunks stretched, masked and put in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminara.operators import chunks as ch
from laminara.operators import joins as jon
from laminara.operators import matching as mt
from laminara.operators import montage as mo
from laminara.plans.q_points import TILES, tiles
from laminara.plans.q_systems import scratch
from laminara.plans.q_tasks import LEAST, R, SIZE, layer, stored_volume
from laminara.sources import storage
from laminara.sources.derive import ACROSS, SQL_PLANE, SQL_PX, mosaic, mosaic_extent, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Trees of seams

#: An edge belongs to the forest if no path of better edges joins its ends.
REACH = """reach AS (SELECT z, k, a AS node FROM e UNION SELECT reach.z, reach.k, CASE WHEN s.a = node THEN s.b ELSE s.a END FROM reach JOIN e s ON s.z = reach.z AND s.k < reach.k AND node IN (s.a, s.b)),
tree AS (SELECT * FROM e WHERE (z, k, b) NOT IN (SELECT (z, k, node) FROM reach))"""


@query("win_spanning_edges", f"""WITH RECURSIVE {TILES}, n AS (SELECT a.z, a.tile AS a, b.tile AS b FROM tiles a JOIN tiles b ON a.z = b.z AND ((b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col))),
w AS (SELECT z, a, b, (a * 7 + b * 13) % 101 / 101::DOUBLE AS r FROM n), e AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY r DESC, a, b) AS k FROM w), {REACH} SELECT z, a, b, round(r, 6) AS r FROM tree""")
def win_spanning_edges(spark, sf):
    """The edges of the best spanning tree of every section, ties and all."""
    e = jon.tile_neighbours(tiles(spark, sf), 0).withColumn("r", (F.col("a") * 7 + F.col("b") * 13) % 101 / 101.0)
    forest, places = mo.spanning_forest(e.withColumns({"di": F.lit(0.0), "dj": F.lit(0.0)}))
    places.drop()
    return forest.df.select("z", "a", "b", F.round("r", 6).alias("r"))


SEAMS = f"""{SQL_PX}, pair AS (SELECT DISTINCT tile AS a, tile + 10 AS b FROM px WHERE tile // 10 % {ACROSS} < {ACROSS - 1} UNION ALL SELECT DISTINCT tile, tile + {10 * ACROSS} FROM px),
r AS (SELECT pair.a, pair.b, x.i - y.i AS di, x.j - y.j AS dj, round(corr(x.px, y.px), 9) AS r FROM pair JOIN px x ON x.tile = pair.a JOIN px y ON y.tile = pair.b GROUP BY ALL HAVING count(*) >= {LEAST} AND var_pop(x.px) > 0 AND var_pop(y.px) > 0),
top AS (SELECT a % 10 AS z, a, b, arg_max(struct_pack(di := di, dj := dj), struct_pack(r := r, di := di, dj := dj)) AS p, max(r) AS r FROM r GROUP BY ALL),
e AS (SELECT z, a, b, p.di AS di, p.dj AS dj, row_number() OVER (PARTITION BY z ORDER BY r DESC, a, b) AS k FROM top)"""
#: Walks along the tree from every tile to every other one.
WALK = """walk AS (SELECT DISTINCT z, node AS start, node, node AS prev, 0 AS i, 0 AS j FROM (SELECT z, a AS node FROM e UNION SELECT z, b FROM e)
UNION ALL SELECT walk.z, start, CASE WHEN t.a = node THEN t.b ELSE t.a END, node, walk.i + CASE WHEN t.a = node THEN t.di ELSE -t.di END, walk.j + CASE WHEN t.a = node THEN t.dj ELSE -t.dj END
FROM walk JOIN tree t ON t.z = walk.z AND node IN (t.a, t.b) AND prev NOT IN (CASE WHEN t.a = node THEN t.b ELSE t.a END))"""


@query("win_premontage", f"WITH RECURSIVE {SEAMS}, {REACH}, {WALK} SELECT CAST(z AS BIGINT) AS z, node AS tile, min(start) AS root, CAST(arg_min(i, start) AS BIGINT) AS i, CAST(arg_min(j, start) AS BIGINT) AS j FROM walk GROUP BY ALL")
def win_premontage(spark, sf):
    """Every tile's place in its plane: shifts between neighbours, the best tree of them, and shifts added up along it."""
    bytes_ = "unhex(array_join(transform(embedding, v -> lpad(hex(cast(least(255, greatest(0, floor(cast(v as double) * 127.5 + 127.5))) as bigint)), 2, '0')), ''))"
    t = table(spark, sf, "embeddings").select(F.col("vec_id").alias("tile"), F.expr(bytes_).alias("img"))
    right = F.when(F.expr(f"tile div 10 % {ACROSS}") < ACROSS - 1, F.col("tile") + 10)
    pairs = t.select(F.col("tile").alias("a"), F.col("img").alias("src"), F.explode(F.array(right, F.col("tile") + 10 * ACROSS)).alias("b"))
    pairs = pairs.join(t.select(F.col("tile").alias("b"), F.col("img").alias("dst")), "b")
    found = mt.translations(pairs.withColumns({c: F.lit(8) for c in ("src_h", "src_w", "dst_h", "dst_w")}), LEAST)
    # The second tile's place seen from the first is the shift's opposite.
    forest, places = mo.spanning_forest(found.select((F.col("a") % 10).alias("z"), "a", "b", "r", (-F.col("di")).alias("di"), (-F.col("dj")).alias("dj")))
    forest.drop()
    return places.df.select("z", F.col("node").alias("tile"), "root", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


# Overviews

KEEP, MARGIN = 4, 2
#: Best offsets, ties to smaller columns, then rows.
BEST = lambda r, n: f"SELECT tile, z, i, j, r FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY r DESC, j, i) AS rank FROM {r}) WHERE rank <= {n}"
NCC = "round(CASE WHEN var_pop(x.px) <= 1e-4 THEN 0 ELSE corr(t.px, x.px) END, 9) AS r"


@query("mat_overview", f"""WITH {SQL_PLANE}, grid AS (SELECT z, i, j FROM (SELECT DISTINCT z FROM plane), extent, generate_series(1, h) a(i), generate_series(1, w) b(j)),
o0 AS (SELECT z, i, j, COALESCE(px, 0) AS px FROM grid LEFT JOIN (SELECT * FROM plane WHERE (i + 2 * j + z) % 7 <> 3) p USING (z, i, j)),
o1 AS (SELECT z, (i - 1) // 2 + 1 AS i, (j - 1) // 2 + 1 AS j, CAST(round_even(sum(px) / 4.0::DOUBLE, 0) AS INT) AS px FROM o0 GROUP BY ALL),
t0 AS (SELECT tile, tile % 10 AS z, i, j, px FROM px), t1 AS (SELECT tile, z, (i - 1) // 2 + 1 AS i, (j - 1) // 2 + 1 AS j, CAST(round_even(sum(px) / 4.0::DOUBLE, 0) AS INT) AS px FROM t0 GROUP BY ALL),
r1 AS (SELECT t.tile, t.z, x.i - t.i + 1 AS i, x.j - t.j + 1 AS j, {NCC} FROM t1 t JOIN o1 x ON x.z = t.z JOIN extent ON x.i - t.i BETWEEN 0 AND h // 2 - 4 AND x.j - t.j BETWEEN 0 AND w // 2 - 4 GROUP BY t.tile, t.z, x.i - t.i, x.j - t.j HAVING var_pop(t.px) > 0),
b1 AS ({BEST("r1", KEEP)}), spot AS (SELECT DISTINCT tile, z, 2 * i - 1 + a AS i, 2 * j - 1 + b AS j FROM b1, extent, generate_series({-MARGIN}, {MARGIN + 1}) p(a), generate_series({-MARGIN}, {MARGIN + 1}) q(b) WHERE 2 * i - 1 + a BETWEEN 1 AND h - 7 AND 2 * j - 1 + b BETWEEN 1 AND w - 7),
r0 AS (SELECT s.tile, s.z, s.i, s.j, {NCC} FROM spot s JOIN t0 t ON t.tile = s.tile JOIN o0 x ON x.z = s.z AND x.i = s.i + t.i - 1 AND x.j = s.j + t.j - 1 GROUP BY s.tile, s.z, s.i, s.j HAVING var_pop(t.px) > 0)
SELECT CAST(z AS INT) AS z, tile, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(r, 6) + 0.0 AS r FROM ({BEST("r0", 1)})""")
def mat_overview(spark, sf):
    """Every tile searched for in its plane's overview, of which every seventh pixel is missing."""
    folder, extent = scratch(spark), mosaic_extent(spark, sf)
    image = stored_volume(spark, mosaic(spark, sf, SIZE), f"{folder}/image")
    holes = layer(image, lambda z, i, j: (i + 2 * j + z) % 7 != 3).select("z", "ci", "cj", F.col("data").alias("kept"))

    def masked(batches):
        for b in batches:
            yield b.assign(data=[bytes(x * y for x, y in zip(d, k, strict=True)) for d, k in zip(b.data, b.kept, strict=True)]).drop(columns="kept")

    path = f"{folder}/overview"
    storage.write_volume(image.join(holes, ["z", "ci", "cj"]).select("z", "mip", "ci", "cj", "h", "w", "data", "kept").mapInPandas(masked, storage.CHUNK), path)
    storage.write_volume(ch.halved(storage.read_volume(spark, path, mip=0), SIZE), path)
    bytes_ = "unhex(array_join(transform(embedding, v -> lpad(hex(cast(least(255, greatest(0, floor(cast(v as double) * 127.5 + 127.5))) as bigint)), 2, '0')), ''))"
    t = table(spark, sf, "embeddings").select((F.col("vec_id") % 10).cast("int").alias("z"), F.col("vec_id").alias("tile"), F.expr(bytes_).alias("img"))
    return mo.place_in_overview(t, storage.read_volume(spark, path), SIZE, extent, (8, 8), 1, KEEP, MARGIN).withColumn("r", R(F.col("r")))


# Chunks

#: Fixed shape of the outlines: corners in shares of width and height, concave; each plane's are moved by its number.
CORNERS = ((0.03, 0.1), (0.97, 0.05), (0.55, 0.45), (0.9, 0.95), (0.1, 0.85))
WIDE = 8.0 * ACROSS


def outlines(sections: DataFrame, height: int) -> DataFrame:
    """A polygon for each plane but the seventh."""
    corners = [F.struct((F.lit(x * WIDE) + F.col("z") * 0.5).alias("x"), (F.lit(y * height) + F.col("z") * 0.25).alias("y")) for x, y in CORNERS]
    return sections.where("z <> 7").select("z", F.array(*corners).alias("outline"))


CROSSED = [(f"({ay!r}::DOUBLE * h + z * 0.25)::DOUBLE", f"({ax * WIDE!r}::DOUBLE + z * 0.5)::DOUBLE", f"({by!r}::DOUBLE * h + z * 0.25)::DOUBLE", f"({bx * WIDE!r}::DOUBLE + z * 0.5)::DOUBLE") for (ax, ay), (bx, by) in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True)]
INSIDE = reduce(lambda a, b: f"{a} + {b}", (f"CAST((({ay} > i) <> ({by} > i)) AND j < ({bx} - {ax}) * (i - {ay}) / ({by} - {ay}) + {ax} AS INT)" for ay, ax, by, bx in CROSSED))


@query("tsk_preprocess", f"""WITH {SQL_PLANE}, e AS (SELECT z, min(px) + 10 AS lo, max(px) - 10 AS hi FROM plane WHERE z % 4 <> 0 GROUP BY z),
grid AS (SELECT z, i, j FROM (SELECT DISTINCT z FROM plane), extent, generate_series(1, h) a(i), generate_series(1, w) b(j)),
filled AS (SELECT z, i, j, COALESCE(px, 0) AS px FROM grid LEFT JOIN plane USING (z, i, j)),
s AS (SELECT z, i, j, CASE WHEN lo IS NULL OR hi = lo THEN px ELSE CAST(floor(255 * least(1.0::DOUBLE, greatest(1.0::DOUBLE / 255, (px - lo) / CAST(hi - lo AS DOUBLE)))) AS INT) END AS px FROM filled LEFT JOIN e USING (z)),
m AS (SELECT z, i, j, px FROM s, extent WHERE z <> 7 AND ({INSIDE}) % 2 = 1 AND px > 0)
SELECT CAST(dst_z AS INT) AS z, CAST(i AS INT) AS i, CAST(j AS INT) AS j, px FROM m JOIN (SELECT d AS dst_z, (d * 3 + 1) % 10 AS z FROM generate_series(0, 8) t(d)) USING (z)""")
def tsk_preprocess(spark, sf):
    """All planes stretched, masked, put in another order, stored and read again; the last target is taken out."""
    folder, extent = scratch(spark), mosaic_extent(spark, sf)
    image = stored_volume(spark, mosaic(spark, sf, SIZE), f"{folder}/image")
    px = F.expr("transform(embedding, v -> cast(least(255, greatest(0, floor(cast(v as double) * 127.5 + 127.5))) as int))")
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 10).cast("int").alias("z"), px.alias("px")).where("z % 4 <> 0")
    ends = e.groupBy("z").agg((F.min(F.array_min("px")) + 10).alias("lo"), (F.max(F.array_max("px")) - 10).alias("hi"))
    order = spark.range(9).select(F.col("id").cast("int").alias("dst_z"), ((F.col("id") * 3 + 1) % 10).cast("int").alias("src_z"))
    storage.write_volume(ch.preprocessed(image, SIZE, extent, ends, outlines(image.select("z").distinct(), extent[0]), order), f"{folder}/out")
    return storage.from_chunks(storage.read_volume(spark, f"{folder}/out")).select("z", "i", "j", "px")
