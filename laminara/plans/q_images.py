"""Queries on pixels: masks, morphology, resampling, contrast, components, block matching, warps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.operators import blockmatch as bm
from laminara.operators import mesh as ms
from laminara.operators import raster as ra
from laminara.operators import stats as st
from laminara.operators import warp as wp
from laminara.sources import storage
from laminara.sources.derive import SQL_PX, pixels

R = st.r
#: Every tile is an image of its own: z is the tile.
IMG = f"WITH {SQL_PX}, img AS (SELECT tile AS z, i, j, px FROM px)"
SEC = f"WITH {SQL_PX}, sec AS (SELECT z, i, j, CAST(max(px) AS INT) AS px FROM px GROUP BY ALL)"


def images(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select(F.col("tile").alias("z"), "i", "j", "px")


def merged_sections(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).groupBy("z", "i", "j").agg(F.max("px").alias("px"))


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("img_section_stats", f"WITH {SQL_PX} SELECT z, count(*) AS n, min(px) AS lo, max(px) AS hi, CAST(sum(px) AS BIGINT) AS total FROM px GROUP BY z")
def img_section_stats(spark, sf):
    return pixels(spark, sf).groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.min("px").alias("lo"), F.max("px").alias("hi"), F.sum("px").alias("total"))


@query("img_threshold", f"{IMG} SELECT z, i, j, CAST(px > 140 AS INT) AS px FROM img")
def img_threshold(spark, sf):
    return ra.threshold(images(spark, sf), 140)


@query("img_mask", f"{IMG} SELECT z, i, j, CASE WHEN (z + i + j) % 3 = 1 THEN px ELSE 0 END AS px FROM img")
def img_mask(spark, sf):
    p = images(spark, sf)
    return ra.mask(p, p.withColumn("px", ((F.col("z") + F.col("i") + F.col("j")) % 3).cast("int")), 1)


@query("img_mask_out", f"{IMG} SELECT z, i, j, CASE WHEN i = 1 OR (z + i + j) % 3 <> 1 THEN px ELSE 7 END AS px FROM img")
def img_mask_out(spark, sf):
    p = images(spark, sf)
    m = p.where("i <> 1").withColumn("px", ((F.col("z") + F.col("i") + F.col("j")) % 3).cast("int"))
    return ra.mask(p, m, 1, keep=False, val=7)


@query("img_union_masks", f"{IMG} SELECT z, i, j, CAST(px % 4 = 1 OR px % 5 = 2 AS INT) AS px FROM img")
def img_union_masks(spark, sf):
    p = images(spark, sf)
    return ra.union_masks(p.withColumn("px", F.col("px") % 4), 1, p.withColumn("px", F.col("px") % 5), 2)


def over_sql(f: str) -> str:
    return f"{SEC} SELECT a.z, a.i, a.j, CAST({f} AS INT) AS px FROM sec a JOIN sec b ON b.z = a.z - 1 AND b.i = a.i AND b.j = a.j JOIN sec c ON c.z = a.z + 1 AND c.i = a.i AND c.j = a.j"


@query("win_conjunction", over_sql("a.px & b.px & c.px & 1"))
def win_conjunction(spark, sf):
    return ra.over_sections(merged_sections(spark, sf), [-1, 0, 1], conjunction=True)


@query("win_disjunction", over_sql("a.px | b.px | c.px"))
def win_disjunction(spark, sf):
    return ra.over_sections(merged_sections(spark, sf), [-1, 0, 1], conjunction=False)


@query("img_dilate", f"{IMG} SELECT a.z, a.i, a.j, CAST(max(CASE WHEN b.px > 190 THEN 1 ELSE 0 END) AS INT) AS px FROM img a JOIN img b ON b.z = a.z AND a.i - b.i BETWEEN -1 AND 1 AND a.j - b.j BETWEEN -1 AND 1 GROUP BY ALL")
def img_dilate(spark, sf):
    return ra.dilate(images(spark, sf), 8, 8, 190, 3, ">")


@query("img_upsample", f"{IMG}, g AS (SELECT a, b FROM generate_series(1, 2) x(a), generate_series(1, 2) y(b)) SELECT z, CAST((i - 1) * 2 + a AS INT) AS i, CAST((j - 1) * 2 + b AS INT) AS j, px FROM img, g")
def img_upsample(spark, sf):
    return ra.upsample(images(spark, sf), 2)


@query("img_downsample", f"{IMG} SELECT z, CAST((i - 1) // 2 + 1 AS INT) AS i, CAST((j - 1) // 2 + 1 AS INT) AS j, CAST(round_even(avg(px), 0) AS INT) AS px FROM img GROUP BY ALL")
def img_downsample(spark, sf):
    return ra.downsample(images(spark, sf))


HALF = "SELECT z, CAST((i - 1) // 2 + 1 AS INT) AS i, CAST((j - 1) // 2 + 1 AS INT) AS j, CAST(round_even(avg(px), 0) AS INT) AS px FROM {} GROUP BY ALL"


@query("img_mips", f"{IMG}, m1 AS ({HALF.format('img')}), m2 AS ({HALF.format('m1')}), m3 AS ({HALF.format('m2')}) SELECT 1 AS mip, * FROM m1 UNION ALL SELECT 2, * FROM m2 UNION ALL SELECT 3, * FROM m3")
def img_mips(spark, sf):
    return ra.mips(images(spark, sf), 3)


@query("img_rescope", f"{IMG}, z AS (SELECT DISTINCT z FROM img), g AS (SELECT z, i, j FROM z, generate_series(-1, 5) x(i), generate_series(3, 10) y(j)) SELECT g.z, CAST(g.i + 2 AS INT) AS i, CAST(g.j - 2 AS INT) AS j, COALESCE(px, 0) AS px FROM g LEFT JOIN img ON img.z = g.z AND img.i = g.i AND img.j = g.j")
def img_rescope(spark, sf):
    return ra.rescope(images(spark, sf), -1, 3, 7, 8)


@query("img_pad", f"{IMG}, z AS (SELECT DISTINCT z FROM img), g AS (SELECT z, i, j FROM z, generate_series(1, 14) x(i), generate_series(1, 12) y(j)) SELECT g.z, CAST(g.i AS INT) AS i, CAST(g.j AS INT) AS j, COALESCE(px, 0) AS px FROM g LEFT JOIN img ON img.z = g.z AND img.i = g.i - 2 AND img.j = g.j - 1")
def img_pad(spark, sf):
    return ra.pad(images(spark, sf), 8, 8, 1, 2, 3, 4)


@query("img_merge", f"WITH {SQL_PX} SELECT z, CAST(i + tile % 5 AS INT) AS i, CAST(j + tile % 7 AS INT) AS j, max(px) AS px FROM px GROUP BY z, i + tile % 5, j + tile % 7")
def img_merge(spark, sf):
    p = pixels(spark, sf)
    return ra.merge(p.withColumns({"off_i": (F.col("tile") % 5).cast("int"), "off_j": (F.col("tile") % 7).cast("int")}))


@query("img_overlay", f"{IMG}, b AS (SELECT z, i + 2 AS i, j + 3 AS j, 255 - px AS y FROM img) SELECT COALESCE(img.z, b.z) AS z, COALESCE(img.i, b.i) AS i, COALESCE(img.j, b.j) AS j, COALESCE(px, 0) * 256 + COALESCE(y, 0) AS px FROM img FULL JOIN b ON img.z = b.z AND img.i = b.i AND img.j = b.j")
def img_overlay(spark, sf):
    p = images(spark, sf)
    return ra.overlay(p, p.withColumn("px", 255 - F.col("px")), 2, 3)


@query("img_stretch", f"{IMG}, e AS (SELECT z, min(px) + 10 AS lo, max(px) - 10 AS hi FROM img WHERE z % 4 <> 0 GROUP BY z) SELECT img.z, i, j, CASE WHEN lo IS NULL OR hi = lo THEN px ELSE CAST(floor(255 * least(1.0::DOUBLE, greatest(1.0::DOUBLE / 255, (px - lo) / CAST(hi - lo AS DOUBLE)))) AS INT) END AS px FROM img LEFT JOIN e USING (z)")
def img_stretch(spark, sf):
    p = images(spark, sf)
    return ra.stretch(p, p.where("z % 4 <> 0").groupBy("z").agg((F.min("px") + 10).alias("lo"), (F.max("px") - 10).alias("hi")))


@query("img_bias", f"{IMG}, b AS (SELECT i, j, avg(px) AS bias FROM img GROUP BY ALL), m AS (SELECT avg(bias) AS m FROM b) SELECT z, i, j, CAST(least(255, greatest(0, round_even(round(px - bias + m, 6), 0))) AS INT) AS px FROM img JOIN b USING (i, j), m")
def img_bias(spark, sf):
    p = images(spark, sf)
    return ra.correct_bias(p, p.groupBy("i", "j").agg(F.avg("px").alias("bias")))


@query("agg_bias_field", f"{IMG} SELECT i, j, round(avg(px), 6) + 0.0 AS bias FROM img GROUP BY ALL")
def agg_bias_field(spark, sf):
    return images(spark, sf).groupBy("i", "j").agg(R(F.avg("px")).alias("bias"))


@query("img_rectangle", f"{IMG} SELECT z, i, j, CASE WHEN i BETWEEN 2 AND 4 AND j BETWEEN 1 AND 6 THEN 0 ELSE px END AS px FROM img")
def img_rectangle(spark, sf):
    return ra.fill_rectangle(images(spark, sf), 8, 17, 3, 25, mip=2)


SQUARE = [(1.5, 1.5), (1.5, 6.5), (4.5, 8.5), (7.5, 3.5)]


@query("img_polygon", f"{IMG} SELECT z, i, j, CASE WHEN (" + " + ".join(f"CAST((({a}::DOUBLE > i) <> ({b}::DOUBLE > i) AND j < ({d} - {c}) * (i - {a}) / CAST({b - a} AS DOUBLE) + {c}) AS INT)" for (a, c), (b, d) in zip(SQUARE, SQUARE[1:] + SQUARE[:1], strict=True) if a != b) + ") % 2 = 1 THEN px ELSE 0 END AS px FROM img")
def img_polygon(spark, sf):
    return images(spark, sf).withColumn("px", F.when(ra.in_polygon(F.col("i"), F.col("j"), SQUARE), F.col("px")).otherwise(0))


@query("img_gather", f"{SEC} SELECT d.z, i, j, CASE WHEN s.src IS NULL THEN 0 ELSE px END AS px FROM (VALUES (100, 1), (101, 3), (102, NULL)) AS d(z, want) LEFT JOIN (SELECT DISTINCT z AS src FROM sec) s ON s.src = d.want JOIN sec ON sec.z = COALESCE(s.src, 0)")
def img_gather(spark, sf):
    from laminara.operators.joins import gather_sections

    return gather_sections(spark.createDataFrame([(100, 1), (101, 3), (102, None)], "dst_z int, src_z int").fillna(-1), merged_sections(spark, sf))


@query("img_components", f"""WITH RECURSIVE {SQL_PX}, n AS (SELECT tile, i, j, (i - 1) * 1048576 + j AS n FROM px WHERE px > 150),
r AS (SELECT tile, n AS label, i, j FROM n UNION SELECT r.tile, r.label, n.i, n.j FROM r JOIN n ON n.tile = r.tile AND abs(n.i - r.i) <= 1 AND abs(n.j - r.j) <= 1)
SELECT tile, i, j, CAST(min(label) AS BIGINT) AS label FROM r GROUP BY ALL""")
def img_components(spark, sf):
    return ra.components(pixels(spark, sf).where("px > 150")).select("tile", "i", "j", "label")


@query("img_components_large", f"""WITH RECURSIVE {SQL_PX}, n AS (SELECT tile, i, j, (i - 1) * 1048576 + j AS n FROM px WHERE px > 150),
r AS (SELECT tile, n AS label, i, j FROM n UNION SELECT r.tile, r.label, n.i, n.j FROM r JOIN n ON n.tile = r.tile AND abs(n.i - r.i) + abs(n.j - r.j) <= 1),
l AS (SELECT tile, i, j, min(label) AS label FROM r GROUP BY ALL) SELECT tile, CAST(label AS BIGINT) AS label, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 4""")
def img_components_large(spark, sf):
    return ra.components(pixels(spark, sf).where("px > 150"), diagonal=False).groupBy("tile", "label").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")


@query("agg_quantiles_plotting", f"""WITH {SQL_PX}, s AS (SELECT z, px, row_number() OVER (PARTITION BY z ORDER BY px) AS k, count(*) OVER (PARTITION BY z) AS n FROM px),
p AS (SELECT DISTINCT z, n, q AS k, q * 0.05::DOUBLE AS p FROM s, generate_series(0, 19) g(q)), m AS (SELECT z, n, k, n * p + 0.4 + p * 0.2 AS m FROM p),
a AS (SELECT *, CAST(greatest(1, least(n - 1, floor(m))) AS BIGINT) AS lo FROM m)
SELECT a.z, CAST(a.k AS INT) AS k, round((1 - greatest(0, least(1, m - lo))) * x.px + greatest(0, least(1, m - lo)) * y.px, 6) + 0.0 AS q FROM a JOIN s x ON x.z = a.z AND x.k = lo JOIN s y ON y.z = a.z AND y.k = lo + 1""")
def agg_quantiles_plotting(spark, sf):
    return st.plotting_quantiles(pixels(spark, sf), ["z"], "px", [k * 0.05 for k in range(20)]).select("z", "k", R(F.col("q")).alias("q"))


@query("agg_quantiles_linear", f"WITH {SQL_PX} " + " UNION ALL ".join(f"SELECT z, {k} AS k, round(quantile_cont(px, {k / 20}), 6) + 0.0 AS q FROM px GROUP BY z" for k in (0, 5, 10, 15, 20)))
def agg_quantiles_linear(spark, sf):
    ks = [0, 5, 10, 15, 20]
    q = pixels(spark, sf).groupBy("z").agg(F.percentile("px", F.array(*(F.lit(k / 20) for k in ks))).alias("q"))
    return q.select("z", F.posexplode("q").alias("p", "q")).select("z", F.element_at(F.array(*map(F.lit, ks)), F.col("p") + 1).alias("k"), R(F.col("q")).alias("q"))


@query("agg_accept_sample", f"{IMG} SELECT z, count(*) FILTER (px < 20) < 0.1 AS accepted FROM img GROUP BY z")
def agg_accept_sample(spark, sf):
    return images(spark, sf).groupBy("z").agg((F.count_if(F.col("px") < 20) < 0.1).alias("accepted"))


@query("agg_value_pivot", f"WITH {SQL_PX} SELECT z, count(*) FILTER (px // 64 = 0) AS v0, count(*) FILTER (px // 64 = 1) AS v1, count(*) FILTER (px // 64 = 2) AS v2, count(*) FILTER (px // 64 = 3) AS v3 FROM px GROUP BY z")
def agg_value_pivot(spark, sf):
    p = pixels(spark, sf).withColumn("v", F.concat(F.lit("v"), F.floor(F.col("px") / 64)))
    return p.groupBy("z").pivot("v", ["v0", "v1", "v2", "v3"]).agg(F.count(F.lit(1))).fillna(0)


@query("agg_chunk_pivot", f"WITH {SQL_PX}, b AS (SELECT *, CASE WHEN px > 230 THEN 1 ELSE 0 END AS v FROM px), s AS (SELECT z FROM b WHERE v = 1 GROUP BY z) SELECT tile, count(*) FILTER (v = 0) AS v0, count(*) FILTER (v = 1) AS v1 FROM b WHERE z IN (SELECT z FROM s) GROUP BY tile")
def agg_chunk_pivot(spark, sf):
    b = pixels(spark, sf).withColumn("v", (F.col("px") > 230).cast("int"))
    return b.join(b.where("v = 1").select("z").distinct(), "z", "left_semi").groupBy("tile").pivot("v", [0, 1]).agg(F.count(F.lit(1))).fillna(0).toDF("tile", "v0", "v1")


@query("agg_balanced_sample", f"WITH {SQL_PX}, c AS (SELECT tile, max(px) > 225 AS pos FROM px GROUP BY tile), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY md5(CAST(tile AS VARCHAR)), tile) AS k FROM c) SELECT tile, pos FROM r WHERE pos OR k <= (SELECT count(*) FROM c WHERE pos)")
def agg_balanced_sample(spark, sf):
    c = pixels(spark, sf).groupBy("tile").agg((F.max("px") > 225).alias("pos"))
    n = c.where("pos").count()
    neg = c.where("not pos").orderBy(F.md5(F.col("tile").cast("string").cast("binary")), "tile").limit(n)
    return c.where("pos").unionByName(neg)


@query("agg_nonzero_min", f"WITH {SQL_PX} SELECT z, COALESCE(min(nullif(greatest(px - 60, 0), 0)), 0) AS lo, max(px) AS hi FROM px GROUP BY z")
def agg_nonzero_min(spark, sf):
    v = F.greatest(F.col("px") - 60, F.lit(0))
    return pixels(spark, sf).groupBy("z").agg(F.coalesce(F.min(F.when(v != 0, v)), F.lit(0)).alias("lo"), F.max("px").alias("hi"))


@query("img_equalise", f"""{IMG}, b AS (SELECT *, px // 4 AS bin FROM img), t AS (SELECT z, count(*) AS total FROM img GROUP BY z),
h AS (SELECT t.z, g.bin, total, least(COALESCE(n, 0)::DOUBLE, 4.0 * total / 64) AS h FROM t CROSS JOIN generate_series(0, 63) g(bin) LEFT JOIN (SELECT z, bin, count(*) AS n FROM b GROUP BY ALL) c ON c.z = t.z AND c.bin = g.bin),
s AS (SELECT z, (max(total) - sum(h)) / 64 AS spare FROM h GROUP BY z), w AS (SELECT h.z, bin, sum(h + spare) OVER (PARTITION BY h.z ORDER BY bin) / total AS share FROM h JOIN s ON s.z = h.z)
SELECT b.z, i, j, CAST(least(255, floor(round(255 * share, 6))) AS INT) AS px FROM b JOIN w ON w.z = b.z AND w.bin = b.bin""")
def img_equalise(spark, sf):
    return ra.equalised(images(spark, sf))


@query("img_xc_byte", f"{IMG} SELECT z, i, j, CASE WHEN px = 0 THEN 0 ELSE CAST(least(254, greatest(1, round_even((px / 255.0 * 2 - 1) * 127 + 127, 0))) AS INT) END AS px FROM img")
def img_xc_byte(spark, sf):
    xc = F.col("px") / 255.0 * 2 - 1
    return images(spark, sf).withColumn("px", F.when(F.col("px") == 0, 0).otherwise(F.least(F.lit(254), F.greatest(F.lit(1), F.rint(xc * 127 + 127).cast("int")))))


# Block matching


def patch_rows(p):
    """Rows 3 to 5 and columns 3 to 5 of a tile against the whole next tile."""
    src = p.where("i between 3 and 5 and j between 3 and 5").select(F.col("z").alias("match"), (F.col("i") - 2).alias("i"), (F.col("j") - 2).alias("j"), "px")
    return src, p.where("z > 0").select((F.col("z") - 1).alias("match"), "i", "j", "px")


XC = f"""{IMG}, t AS (SELECT z AS match, i - 2 AS i, j - 2 AS j, px AS t FROM img WHERE i BETWEEN 3 AND 5 AND j BETWEEN 3 AND 5),
x AS (SELECT z - 1 AS match, i, j, px AS x FROM img WHERE z > 0),
r AS (SELECT match, x.i - t.i AS oi, x.j - t.j AS oj, corr(t, x) AS r FROM t JOIN x USING (match) WHERE x.i - t.i BETWEEN 0 AND 5 AND x.j - t.j BETWEEN 0 AND 5 GROUP BY ALL)"""


@query("mat_correlation", f"{XC} SELECT match, CAST(oi AS INT) AS oi, CAST(oj AS INT) AS oj, round(r, 6) + 0.0 AS r FROM r")
def mat_correlation(spark, sf):
    return bm.correlation_rows(*patch_rows(images(spark, sf))).select("match", "oi", "oj", R(F.col("r")).alias("r"))


def patches(p):
    src, dst = patch_rows(p)
    pack = lambda d, n: bm.section_patches(d, "match").toDF("match", n, f"{n}_h", f"{n}_w")
    return pack(src, "src").join(pack(dst, "dst"), "match").select("match", "src", "dst", "src_h", "src_w", "dst_h", "dst_w")


@query("mat_peak", f"{XC} SELECT match, round(max(r), 6) + 0.0 AS r_max FROM r GROUP BY match")
def mat_peak(spark, sf):
    return bm.match_blocks(patches(images(spark, sf))).select("match", R(F.col("r_max")).alias("r_max"))


@query("mat_features")
def mat_features(spark, sf):
    """All features of every block; the refinement and the spread have no compact SQL, tests hold them."""
    return bm.match_blocks(patches(images(spark, sf)))


@query("mat_dyn_kurtosis", f"{IMG} SELECT z, round((max(px) - min(px)) / 255, 6) + 0.0 AS dyn_range, round(kurtosis_pop(px), 6) + 0.0 AS kurt FROM img GROUP BY z")
def mat_dyn_kurtosis(spark, sf):
    return images(spark, sf).groupBy("z").agg(R((F.max("px") - F.min("px")) / 255).alias("dyn_range"), R(F.kurtosis("px")).alias("kurt"))


@query("mat_mean_pad", f"{IMG}, m AS (SELECT z, avg(px) AS m FROM img GROUP BY z) SELECT z, i, j, round(CASE WHEN px < 60 THEN m ELSE px END, 6) + 0.0 AS px FROM img JOIN m USING (z)")
def mat_mean_pad(spark, sf):
    p = images(spark, sf)
    return p.join(p.groupBy("z").agg(F.avg("px").alias("m")), "z").select("z", "i", "j", R(F.when(F.col("px") < 60, F.col("m")).otherwise(F.col("px"))).alias("px"))


@query("mat_guards", f"{IMG} SELECT z, (min(e) > 0) AS usable FROM (SELECT z, sum(CASE WHEN px > 120 THEN 1 ELSE 0 END) FILTER (i = 1) AS e FROM img GROUP BY z UNION ALL SELECT z, sum(CASE WHEN px > 120 THEN 1 ELSE 0 END) FILTER (i = 8) FROM img GROUP BY z UNION ALL SELECT z, sum(CASE WHEN px > 120 THEN 1 ELSE 0 END) FILTER (j = 1) FROM img GROUP BY z UNION ALL SELECT z, sum(CASE WHEN px > 120 THEN 1 ELSE 0 END) FILTER (j = 8) FROM img GROUP BY z) GROUP BY z")
def mat_guards(spark, sf):
    on = (F.col("px") > 120).cast("int")
    edges = [F.sum(F.when(c, on)) for c in (F.col("i") == 1, F.col("i") == 8, F.col("j") == 1, F.col("j") == 8)]
    return images(spark, sf).groupBy("z").agg(F.least(*edges).alias("e")).select("z", (F.col("e") > 0).alias("usable"))


@query("mat_spread", f"{IMG}, w AS (SELECT *, greatest(px - 0.5 * max(px) OVER (PARTITION BY z), 0) AS w FROM img), s AS (SELECT z, sum(w) AS t, sum(w * i) / sum(w) AS mi, sum(w * j) / sum(w) AS mj, sum(w * i * i) / sum(w) AS ii, sum(w * j * j) / sum(w) AS jj FROM w GROUP BY z) SELECT z, round(sqrt(ii - mi * mi + jj - mj * mj), 6) + 0.0 AS sigma FROM s")
def mat_spread(spark, sf):
    p = images(spark, sf)
    w = p.join(p.groupBy("z").agg(F.max("px").alias("m")), "z").withColumn("w", F.greatest(F.col("px") - 0.5 * F.col("m"), F.lit(0.0)))
    m = lambda e: F.sum(F.col("w") * e) / F.sum("w")
    s = w.groupBy("z").agg(m(F.col("i")).alias("mi"), m(F.col("j")).alias("mj"), m(F.col("i") * F.col("i")).alias("ii"), m(F.col("j") * F.col("j")).alias("jj"))
    return s.select("z", R(F.sqrt(F.col("ii") - F.col("mi") * F.col("mi") + F.col("jj") - F.col("mj") * F.col("mj"))).alias("sigma"))


@query("mat_integral", f"{IMG} SELECT a.z, a.i, a.j, CAST(sum(b.px) AS BIGINT) AS s, CAST(sum(b.px * b.px) AS BIGINT) AS s2 FROM img a JOIN img b ON b.z = a.z AND b.i <= a.i AND b.j <= a.j GROUP BY ALL")
def mat_integral(spark, sf):
    from pyspark.sql import Window

    p = images(spark, sf)
    row, col = Window.partitionBy("z", "i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("z", "j").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    along = p.withColumns({"s": F.sum("px").over(row), "s2": F.sum(F.col("px") * F.col("px")).over(row)})
    return along.select("z", "i", "j", F.sum("s").over(col).alias("s"), F.sum("s2").over(col).alias("s2"))


# Warps

LATTICE = ms.Lattice(8, 8, 3.0)


def placed(spark, sf, f):
    n = ms.nodes(spark, LATTICE)
    z = images(spark, sf).select("z").distinct()
    i, j = f(F.col("src_i"), F.col("src_j"))
    return z.join(F.broadcast(n.withColumns({"dst_i": i, "dst_j": j})), F.lit(True))


@query("img_warp_identity", f"{IMG} SELECT * FROM img")
def img_warp_identity(spark, sf):
    return wp.warp(images(spark, sf), wp.triangles(spark, LATTICE), placed(spark, sf, lambda i, j: (i, j)), 8, 8)


@query("img_warp_shift", f"{IMG}, s AS (SELECT z, i, j, px * 0.5 + lead(px) OVER (PARTITION BY z, i ORDER BY j) * 0.5 AS v FROM img) SELECT z, CAST(i + 1 AS INT) AS i, CAST(j + 1 AS INT) AS j, CAST(round_even(v, 0) AS INT) AS px FROM s WHERE v IS NOT NULL AND i < 8 AND j < 8")
def img_warp_shift(spark, sf):
    out = wp.warp(images(spark, sf), wp.triangles(spark, LATTICE), placed(spark, sf, lambda i, j: (i + 1, j + 0.5)), 8, 8)
    return out.where("i between 2 and 8 and j between 2 and 8")


@query("img_warp_nearest", f"{IMG} SELECT z, CAST(i + 1 AS INT) AS i, CAST(j + 2 AS INT) AS j, px FROM img WHERE i < 8 AND j < 7")
def img_warp_nearest(spark, sf):
    return wp.warp(images(spark, sf), wp.triangles(spark, LATTICE), placed(spark, sf, lambda i, j: (i + 1, j + 2)), 8, 8, interpolate=False)


@query("img_rotate", f"{IMG} SELECT z, CAST(9 - i AS INT) AS i, CAST(9 - j AS INT) AS j, px FROM img")
def img_rotate(spark, sf):
    """Half a turn round the middle of the tile."""
    return wp.warp(images(spark, sf), wp.triangles(spark, LATTICE), placed(spark, sf, lambda i, j: (9 - i, 9 - j)), 8, 8)
