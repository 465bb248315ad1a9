"""Queries on meshes, spring systems, transforms, tasks and storage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.operators import joins as jon
from laminara.operators import mesh as ms
from laminara.operators import solve as so
from laminara.operators import stats as st
from laminara.plans.q_images import images
from laminara.plans.q_points import BASE, SECTIONS, TILES, base, sections, tiles
from laminara.sources import storage
from laminara.sources.derive import SQL_PLANE, SQL_PX, correspondences, mosaic_extent
from laminara.streaming import tasks as tk

R = st.r
M = ms.Lattice(1000.0, 800.0, 100.0)
(D1, D2), (O1, O2), (ROWS, COLS) = M.pitch, M.origin, M.dims
NODES = f"""n AS (SELECT CAST((i - 1) // 2 * {COLS - 1} + i // 2 * {COLS} + j AS INT) AS node, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {O1!r}::DOUBLE + (i - 1) * {D1!r}::DOUBLE AS src_i,
{O2!r}::DOUBLE + CASE WHEN i % 2 = 1 THEN j - 1.0::DOUBLE ELSE j - 0.5::DOUBLE END * {D2!r}::DOUBLE AS src_j
FROM generate_series(1, {ROWS}) a(i), generate_series(1, {COLS}) b(j) WHERE i % 2 = 1 OR j < {COLS})"""
#: Two nodes are linked if they are one length apart, or two rows apart at the end of odd rows.
EDGES = f"""e AS (SELECT a.node AS a, b.node AS b, a.src_i AS ai, a.src_j AS aj, b.src_i AS bi, b.src_j AS bj, sqrt((a.src_i - b.src_i) ** 2 + (a.src_j - b.src_j) ** 2) AS length FROM n a JOIN n b ON a.node > b.node
AND ((a.src_i - b.src_i) ** 2 + (a.src_j - b.src_j) ** 2 < {(1.01 * M.length) ** 2} OR (a.i - b.i = 2 AND a.i % 2 = 1 AND a.j = b.j AND a.j IN (1, {COLS}))))"""
#: Every section's mesh; the nodes of a section move by an affine map and the mean shift of its correspondences.
STACK = f"{BASE}, {NODES}, z AS ({SECTIONS}), drift AS (SELECT src_z AS z, avg(dv_i) AS di, avg(dv_j) AS dj FROM base GROUP BY ALL), off AS (SELECT z.z, COALESCE(di, 0) AS di, COALESCE(dj, 0) AS dj FROM z LEFT JOIN drift ON drift.z = z.z)"
TO_I, TO_J = "({0} * 1.01 + {1} * 0.02 + 3 + di)", "({1} * 0.98 - {0} * 0.01 - 2 + dj)"
MOVED = f"m AS (SELECT z, node, {TO_I.format('src_i', 'src_j')} AS dst_i, {TO_J.format('src_i', 'src_j')} AS dst_j FROM n, off)"

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def stack(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of every section's mesh."""
    # The lattice is a bounded plan-time table.
    return sections(spark, sf).join(F.broadcast(ms.nodes(spark, M)), F.lit(True))


def drift(spark: SparkSession, sf: str) -> DataFrame:
    """(z, di, dj): mean shift of each section's correspondences, zero without any."""
    mean = correspondences(spark, sf).groupBy(F.col("src_z").alias("z")).agg(F.avg("dv_i").alias("di"), F.avg("dv_j").alias("dj"))
    return sections(spark, sf).join(mean, "z", "left").fillna(0.0, ["di", "dj"])


def stack_moved(spark: SparkSession, sf: str) -> DataFrame:
    i, j = (F.expr(t.format("src_i", "src_j")) for t in (TO_I, TO_J))
    return stack(spark, sf).join(F.broadcast(drift(spark, sf)), "z").select("z", "node", i.alias("dst_i"), j.alias("dst_j"))


def moved(spark: SparkSession) -> DataFrame:
    n = ms.nodes(spark, M)
    return n.select("node", (F.col("src_i") * 1.01 + F.col("src_j") * 0.02 + 3).alias("dst_i"), (F.col("src_j") * 0.98 - F.col("src_i") * 0.01 - 2).alias("dst_j"))


@query("msh_nodes", f"{STACK} SELECT z, node, i, j, round(src_i, 6) + 0.0 AS src_i, round(src_j, 6) + 0.0 AS src_j FROM n, z")
def msh_nodes(spark, sf):
    return stack(spark, sf).withColumns({c: R(F.col(c)) for c in ("src_i", "src_j")})


@query("msh_edges", f"{STACK}, {EDGES} SELECT z, a, b, round(length, 6) + 0.0 AS length, round((ai + bi) / 2, 6) + 0.0 AS mid_i, round((aj + bj) / 2, 6) + 0.0 AS mid_j FROM e, z")
def msh_edges(spark, sf):
    edges = ms.edges(spark, M).join(sections(spark, sf), F.lit(True))
    return ms.edge_ends(edges, stack(spark, sf), keys=["z"]).select("z", "a", "b", *(R(F.col(c)).alias(c) for c in ("length", "mid_i", "mid_j")))


@query("msh_node_lookup", f"{STACK}, g AS (SELECT corr_id, CAST(floor(pre_i / 75) AS INT) - 1 AS i, CAST(floor(pre_j / 75) AS INT) - 1 AS j FROM base) SELECT corr_id, g.i, g.j, node FROM g LEFT JOIN n ON n.i = g.i AND n.j = g.j")
def msh_node_lookup(spark, sf):
    """The node at a row and column made of each correspondence's place; some lie outside."""
    at = lambda c: (F.floor(F.col(c) / 75) - 1).cast("int")
    return correspondences(spark, sf).select("corr_id", at("pre_i").alias("i"), at("pre_j").alias("j")).withColumn("node", ms.node(M, F.col("i"), F.col("j")))


@query("msh_dims", f"{STACK} SELECT z, count(DISTINCT i) AS rows, CAST(max(j) AS BIGINT) AS cols, round({D1!r}::DOUBLE, 4) AS pitch_i, round({D2!r}::DOUBLE, 4) AS pitch_j FROM n, z GROUP BY z")
def msh_dims(spark, sf):
    return ms.dims_of(stack(spark, sf), ["z"]).select("z", "rows", "cols", F.round("pitch_i", 4).alias("pitch_i"), F.round("pitch_j", 4).alias("pitch_j"))


@query("msh_locate", f"""{BASE}, {NODES}, p AS (SELECT corr_id, pre_i + 0.25 AS x, pre_j + 0.125 AS y FROM base),
k AS (SELECT corr_id, node, (x - src_i) ** 2 + (y - src_j) ** 2 AS d2, row_number() OVER (PARTITION BY corr_id ORDER BY (x - src_i) ** 2 + (y - src_j) ** 2, node) AS k FROM p JOIN n ON abs(x - src_i) < {2 * M.length} AND abs(y - src_j) < {2 * M.length})
SELECT corr_id, min(node) AS a, CAST(sum(node) - min(node) - max(node) AS INT) AS b, max(node) AS c FROM k WHERE k <= 3 GROUP BY corr_id""")
def msh_locate(spark, sf):
    p = correspondences(spark, sf).select("corr_id", (F.col("pre_i") + 0.25).alias("x"), (F.col("pre_j") + 0.125).alias("y"))
    # A point's triangle is that of the three nodes nearest to it, as all sides are equal.
    k = F.array_sort(F.array("t.k0", "t.ka", "t.kb"))
    return p.withColumn("t", ms.locate(M, F.col("x"), F.col("y"))).select("corr_id", k.alias("k")).select("corr_id", *(F.get("k", F.lit(i)).alias(n) for i, n in enumerate("abc")))


@query("msh_weights", f"{BASE} SELECT corr_id, 1.0::DOUBLE AS total, TRUE AS inside, pre_i AS i, pre_j AS j FROM base")
def msh_weights(spark, sf):
    """Weights of every point: they sum to one, none is negative, and they give the point back."""
    p = correspondences(spark, sf).select("corr_id", "pre_i", "pre_j")
    w = ms.located(p, M, "pre_i", "pre_j")
    back = [sum((F.col(a) * ms.coordinate(M, *ms.node_place(M, F.col(k)))[c] for a, k in (("wa", "ka"), ("wb", "kb"))), F.col("w0") * ms.coordinate(M, *ms.node_place(M, F.col("k0")))[c]) for c in (0, 1)]
    return w.select("corr_id", R(F.col("w0") + F.col("wa") + F.col("wb")).alias("total"), (F.least("w0", "wa", "wb") > -1e-9).alias("inside"), R(back[0]).alias("i"), R(back[1]).alias("j"))


@query("msh_deform", f"{BASE} SELECT corr_id, round(pre_i * 1.01 + pre_j * 0.02 + 3, 6) + 0.0 AS dst_i, round(pre_j * 0.98 - pre_i * 0.01 - 2, 6) + 0.0 AS dst_j FROM base")
def msh_deform(spark, sf):
    out = ms.deform(correspondences(spark, sf).select("corr_id", "pre_i", "pre_j"), M, moved(spark), "corr_id", "pre_i", "pre_j")
    return out.select("corr_id", R(F.col("dst_i")).alias("dst_i"), R(F.col("dst_j")).alias("dst_j"))


@query("msh_strain", f"{STACK}, {EDGES}, {MOVED} SELECT x.z, a, b, round(sqrt((x.dst_i - y.dst_i) ** 2 + (x.dst_j - y.dst_j) ** 2) - length, 6) + 0.0 AS strain FROM e JOIN m x ON x.node = a JOIN m y ON y.node = b AND y.z = x.z")
def msh_strain(spark, sf):
    e = ms.edges(spark, M)
    pre = ms.edge_ends(e, ms.nodes(spark, M)).select("a", "b", F.col("length").alias("pre"))
    post = ms.edge_ends(e.join(sections(spark, sf), F.lit(True)), stack_moved(spark, sf), "dst_i", "dst_j", ["z"]).select("z", "a", "b", "length")
    return post.join(F.broadcast(pre), ["a", "b"]).select("z", "a", "b", R(F.col("length") - F.col("pre")).alias("strain"))


@query("msh_box_edges", f"""{STACK}, {EDGES}, box AS (SELECT src_z AS z, min(pre_i) + 100 AS i0, min(pre_i) + 300 AS i1, max(pre_j) - 400 AS j0, max(pre_j) - 100 AS j1 FROM base GROUP BY ALL)
SELECT z, a, b FROM e, box WHERE (ai BETWEEN i0 AND i1 AND aj BETWEEN j0 AND j1) OR (bi BETWEEN i0 AND i1 AND bj BETWEEN j0 AND j1)""")
def msh_box_edges(spark, sf):
    """Edges with an end in a box that each section's correspondences place."""
    from laminara.operators.filters import in_box

    boxes = correspondences(spark, sf).groupBy(F.col("src_z").alias("z")).agg((F.min("pre_i") + 100).alias("i0"), (F.max("pre_j") - 400).alias("j0"))
    box = (F.col("i0"), F.col("j0"), 200, 300)
    ends = ms.edge_ends(ms.edges(spark, M), ms.nodes(spark, M)).join(boxes, F.lit(True))
    return ends.where(in_box(F.col("a_i"), F.col("a_j"), box) | in_box(F.col("b_i"), F.col("b_j"), box)).select("z", "a", "b")


@query("msh_stack", f"{BASE}, {NODES}, z AS ({SECTIONS}) SELECT z, count(*) AS n, round(min(src_i), 6) + 0.0 AS i0, round(max(src_j), 6) + 0.0 AS j1 FROM z, n GROUP BY z")
def msh_stack(spark, sf):
    # The lattice is a bounded plan-time table.
    return sections(spark, sf).join(F.broadcast(ms.nodes(spark, M)), F.lit(True)).groupBy("z").agg(F.count(F.lit(1)).alias("n"), R(F.min("src_i")).alias("i0"), R(F.max("src_j")).alias("j1"))


@query("msh_homogeneous", f"{BASE} SELECT corr_id, pre_i, pre_j, 1.0::DOUBLE AS one FROM base")
def msh_homogeneous(spark, sf):
    return correspondences(spark, sf).select("corr_id", "pre_i", "pre_j", F.lit(1.0).alias("one"))


# Springs


def system(spark, sf):
    """Springs along all edges of all sections' meshes, and one from each correspondence's point of its source mesh to that of
    its target mesh, both as weighted sums of three nodes."""
    ms_key = lambda z, k: F.concat_ws(":", z, k)
    e = ms.edge_ends(ms.edges(spark, M), ms.nodes(spark, M)).join(sections(spark, sf), F.lit(True)).withColumn("spring", F.concat_ws(":", "z", "a", "b"))
    inner = e.select("spring", F.lit(2.0).alias("k"), F.col("length").alias("rest"))
    ends = e.select("spring", F.explode(F.array(F.struct(ms_key("z", "a").alias("node"), F.lit(-1.0).alias("val")), F.struct(ms_key("z", "b").alias("node"), F.lit(1.0).alias("val")))).alias("s")).select("spring", "s.*")
    c = correspondences(spark, sf).select("corr_id", "src_z", "dst_z", "pre_i", "pre_j", (F.col("pre_i") + F.col("dv_i")).alias("post_i"), (F.col("pre_j") + F.col("dv_j")).alias("post_j"))
    across = c.select(F.col("corr_id").cast("string").alias("spring"), (F.lit(100.0) / F.abs(F.col("dst_z") - F.col("src_z"))).alias("k"), F.lit(0.0).alias("rest"))
    for z, i, j, sign in (("src_z", "pre_i", "pre_j", -1.0), ("dst_z", "post_i", "post_j", 1.0)):
        at = ms.located(c.select("corr_id", z, i, j), M, i, j)
        three = F.explode(F.array(*(F.struct(ms_key(F.col(z), F.col(k)).alias("node"), (F.col(w) * sign).alias("val")) for k, w in (("k0", "w0"), ("ka", "wa"), ("kb", "wb"))))).alias("s")
        ends = ends.union(at.select(F.col("corr_id").cast("string").alias("spring"), three).select("spring", "s.*"))
    place = stack_moved(spark, sf).select(ms_key("z", "node").alias("node"), F.col("dst_i").alias("i"), F.col("dst_j").alias("j"))
    return inner.union(across), ends, place


AFFINE = lambda i, j, di, dj: (f"({i} * 1.01 + {j} * 0.02 + 3 + {di})", f"({j} * 0.98 - {i} * 0.01 - 2 + {dj})")
#: Moved places of points within triangles follow the affine map of their section, so springs of correspondences need no nodes.
SPRINGS = f"""{STACK}, {EDGES}, {MOVED}, s0 AS (SELECT x.z || ':' || a || ':' || b AS spring, 2.0::DOUBLE AS k, length AS rest, y.dst_i - x.dst_i AS si, y.dst_j - x.dst_j AS sj FROM e JOIN m x ON x.node = a JOIN m y ON y.node = b AND y.z = x.z
UNION ALL SELECT CAST(corr_id AS VARCHAR), 100.0::DOUBLE / abs(dst_z - src_z), 0, {AFFINE("(pre_i + dv_i)", "(pre_j + dv_j)", "t.di", "t.dj")[0]} - {AFFINE("pre_i", "pre_j", "s.di", "s.dj")[0]}, {AFFINE("(pre_i + dv_i)", "(pre_j + dv_j)", "t.di", "t.dj")[1]} - {AFFINE("pre_i", "pre_j", "s.di", "s.dj")[1]} FROM base JOIN off s ON s.z = src_z JOIN off t ON t.z = dst_z),
s AS (SELECT *, sqrt(si * si + sj * sj) + 1e-12 AS len FROM s0)"""


@query("sol_lengths", f"{SPRINGS} SELECT spring, round(len, 5) + 0.0 AS length FROM s")
def sol_lengths(spark, sf):
    return so.spring_vectors(*system(spark, sf)).select("spring", R(F.col("length"), 5).alias("length"))


@query("sol_energy", f"{SPRINGS} SELECT CAST(round(sum(0.5 * k * (len - rest) ** 2)) AS BIGINT) AS energy FROM s")
def sol_energy(spark, sf):
    return so.energy(so.spring_vectors(*system(spark, sf))).select(F.round("energy").cast("long").alias("energy"))


@query("sol_gradient", f"""{SPRINGS}, f AS (SELECT spring, k * (si - si * rest / len) AS fi, k * (sj - sj * rest / len) AS fj FROM s),
p AS (SELECT corr_id, src_z AS z, -1 AS sign, pre_i AS x, pre_j AS y FROM base UNION ALL SELECT corr_id, dst_z, 1, pre_i + dv_i, pre_j + dv_j FROM base),
near AS (SELECT corr_id, z, sign, node, x, y, src_i, src_j, row_number() OVER (PARTITION BY corr_id, sign ORDER BY (x - src_i) ** 2 + (y - src_j) ** 2, node) AS nth FROM p JOIN n ON abs(x - src_i) < {2 * M.length} AND abs(y - src_j) < {2 * M.length}),
w AS (SELECT a.corr_id, a.z, a.sign, unnest([a.node, b.node, c.node]) AS node, unnest([((b.src_j - c.src_j) * (a.x - c.src_i) + (c.src_i - b.src_i) * (a.y - c.src_j)) / det, ((c.src_j - a.src_j) * (a.x - c.src_i) + (a.src_i - c.src_i) * (a.y - c.src_j)) / det,
1 - ((b.src_j - c.src_j) * (a.x - c.src_i) + (c.src_i - b.src_i) * (a.y - c.src_j)) / det - ((c.src_j - a.src_j) * (a.x - c.src_i) + (a.src_i - c.src_i) * (a.y - c.src_j)) / det]) AS w
FROM (SELECT *, 1 AS one FROM near WHERE nth = 1) a JOIN (SELECT * FROM near WHERE nth = 2) b USING (corr_id, sign) JOIN (SELECT * FROM near WHERE nth = 3) c USING (corr_id, sign), LATERAL (SELECT (b.src_j - c.src_j) * (a.src_i - c.src_i) + (c.src_i - b.src_i) * (a.src_j - c.src_j) AS det) d)
SELECT node, round(sum(gi), 3) + 0.0 AS g_i, round(sum(gj), 3) + 0.0 AS g_j FROM (
SELECT z || ':' || node AS node, sign * w * fi AS gi, sign * w * fj AS gj FROM w JOIN f ON f.spring = CAST(w.corr_id AS VARCHAR)
UNION ALL SELECT string_split(spring, ':')[1] || ':' || string_split(spring, ':')[2], -fi, -fj FROM f WHERE spring LIKE '%:%'
UNION ALL SELECT string_split(spring, ':')[1] || ':' || string_split(spring, ':')[3], fi, fj FROM f WHERE spring LIKE '%:%') GROUP BY node""")
def sol_gradient(spark, sf):
    """The pull of all springs on every node of every mesh."""
    springs, ends, place = system(spark, sf)
    return so.gradient(so.spring_vectors(springs, ends, place), ends).select("node", R(F.col("g_i"), 3).alias("g_i"), R(F.col("g_j"), 3).alias("g_j"))


@query("sol_match_stiffness", f"{BASE} SELECT DISTINCT src_z, dst_z, 100.0::DOUBLE / abs(dst_z - src_z) AS k FROM base")
def sol_match_stiffness(spark, sf):
    return correspondences(spark, sf).select("src_z", "dst_z").distinct().withColumn("k", F.lit(100.0) / F.abs(F.col("dst_z") - F.col("src_z")))


FIT = f"""{BASE}, s AS (SELECT src_z, dst_z, regr_count(dv_i, pre_i) AS n, covar_pop(pre_i, pre_i) AS aa, covar_pop(pre_i, pre_j) AS ab, covar_pop(pre_j, pre_j) AS bb, covar_pop(pre_i, pre_i + dv_i) AS ax, covar_pop(pre_i, pre_j + dv_j) AS ay,
covar_pop(pre_j, pre_i + dv_i) AS bx, covar_pop(pre_j, pre_j + dv_j) AS byy, avg(pre_i) AS a, avg(pre_j) AS b, avg(pre_i + dv_i) AS x, avg(pre_j + dv_j) AS y FROM base WHERE NOT rejected GROUP BY ALL),
f AS (SELECT src_z, dst_z, a, b, x, y, (ax * bb - bx * ab) / (aa * bb - ab * ab) AS t11, (bx * aa - ax * ab) / (aa * bb - ab * ab) AS t21, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS t12, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS t22,
atan2(ay - bx, ax + byy) AS theta FROM s)"""


def fits(spark, sf):
    c = base(spark, sf).where("not rejected").withColumns({"post_i": F.col("pre_i") + F.col("dv_i"), "post_j": F.col("pre_j") + F.col("dv_j")})
    return so.moments(c, ["src_z", "dst_z"], ("pre_i", "pre_j"), ("post_i", "post_j"))


def rounded(df, columns, digits=4):
    return df.select("src_z", "dst_z", *(R(F.col(c), digits).alias(c) for c in columns))


@query("sol_affine", f"{FIT} SELECT src_z, dst_z, round(t11, 4) + 0.0 AS t11, round(t12, 4) + 0.0 AS t12, round(t21, 4) + 0.0 AS t21, round(t22, 4) + 0.0 AS t22, round(x - a * t11 - b * t21, 4) + 0.0 AS t31, round(y - a * t12 - b * t22, 4) + 0.0 AS t32 FROM f")
def sol_affine(spark, sf):
    return rounded(so.affine(fits(spark, sf)), so.T)


@query("sol_rigid", f"{FIT} SELECT src_z, dst_z, round(cos(theta), 4) + 0.0 AS t11, round(sin(theta), 4) + 0.0 AS t12, round(-sin(theta), 4) + 0.0 AS t21, round(cos(theta), 4) + 0.0 AS t22, round(x - a * cos(theta) + b * sin(theta), 4) + 0.0 AS t31, round(y - a * sin(theta) - b * cos(theta), 4) + 0.0 AS t32 FROM f")
def sol_rigid(spark, sf):
    return rounded(so.rigid(fits(spark, sf)), so.T)


@query("sol_regularised", f"{FIT} SELECT src_z, dst_z, round(0.9 * t11 + 0.1 * cos(theta), 4) + 0.0 AS t11, round(0.9 * (x - a * t11 - b * t21) + 0.1 * (x - a * cos(theta) + b * sin(theta)), 4) + 0.0 AS t31 FROM f")
def sol_regularised(spark, sf):
    return rounded(so.regularised(fits(spark, sf), ["src_z", "dst_z"], 0.9), ["t11", "t31"])


@query("sol_apply", f"{FIT} SELECT corr_id, round(pre_i * t11 + pre_j * t21 + (x - a * t11 - b * t21), 4) + 0.0 AS i, round(pre_i * t12 + pre_j * t22 + (y - a * t12 - b * t22), 4) + 0.0 AS j FROM base JOIN f USING (src_z, dst_z)")
def sol_apply(spark, sf):
    t = so.affine(fits(spark, sf)).select("src_z", "dst_z", *so.T)
    i, j = so.apply_transform(F.col("pre_i"), F.col("pre_j"))
    return correspondences(spark, sf).join(t, ["src_z", "dst_z"]).select("corr_id", R(i, 4).alias("i"), R(j, 4).alias("j"))


@query("sol_decompose", f"{FIT}, d AS (SELECT *, sqrt(t11 * t11 + t21 * t21) AS p, t11 * t22 - t21 * t12 AS det FROM f) SELECT src_z, dst_z, round(p, 4) + 0.0 AS scale_i, round(det / p, 4) + 0.0 AS scale_j, round((t11 * t12 + t21 * t22) / det, 4) + 0.0 AS shear, round(degrees(atan(t21 / t11)), 3) + 0.0 AS rotation FROM d")
def sol_decompose(spark, sf):
    d = so.decompose(so.affine(fits(spark, sf)))
    return d.select("src_z", "dst_z", *(R(F.col(c), 3 if c == "rotation" else 4).alias(c) for c in ("scale_i", "scale_j", "shear", "rotation")))


@query("sol_relax", f"""{STACK}, {EDGES}, {MOVED}, s AS (SELECT x.z, length AS rest, sqrt((x.dst_i - y.dst_i) ** 2 + (x.dst_j - y.dst_j) ** 2) + 1e-12 AS len FROM e JOIN m x ON x.node = a JOIN m y ON y.node = b AND y.z = x.z)
SELECT CAST(z AS BIGINT) AS block, {M.count} AS n, round(sum(0.5 * 2.0 * (len - rest) ** 2), 3) + 0.0 AS energy_before, TRUE AS lower, TRUE AS held FROM s GROUP BY z""")
def sol_relax(spark, sf):
    """Every section's mesh relaxed on its own with its first row fixed: the energy falls and the fixed nodes stay."""
    e = ms.edge_ends(ms.edges(spark, M), ms.nodes(spark, M)).join(sections(spark, sf), F.lit(True))
    ends = e.select(F.col("z").cast("long").alias("block"), F.concat_ws("-", "a", "b").alias("spring"), F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(-1.0).alias("val")), F.struct(F.col("b").alias("node"), F.lit(1.0).alias("val")))).alias("s"), F.lit(2.0).alias("k"), F.col("length").alias("rest")).select("block", "spring", "s.*", "k", "rest")
    place = stack_moved(spark, sf).select(F.col("z").cast("long").alias("block"), "node", F.col("dst_i").alias("i"), F.col("dst_j").alias("j"))
    out = so.relax_blocks(place.withColumn("fixed", F.col("node") <= COLS), ends, max_iters=200)
    j = out.join(place, ["block", "node"])
    held = (F.col("node") > COLS) | ((F.abs(F.col("dst_i") - F.col("i")) < 1e-9) & (F.abs(F.col("dst_j") - F.col("j")) < 1e-9))
    return j.groupBy("block").agg(F.count(F.lit(1)).cast("int").alias("n"), R(F.max("energy_before"), 3).alias("energy_before"), F.bool_and(F.col("energy_after") < F.col("energy_before")).alias("lower"), F.bool_and(held).alias("held"))


@query("sol_elastic")
def sol_elastic(spark, sf):
    """Sections' shifts relaxed in overlapping blocks of sections: springs between sections pull by the mean shifts of
    their accepted rows; the numbers of a descent have no SQL."""
    mean = base(spark, sf).where("not rejected").groupBy("src_z", "dst_z").agg(F.avg("dv_i").alias("di"), F.avg("dv_j").alias("dj"), F.count(F.lit(1)).alias("n"))
    blocks = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(so.z_blocks(0, 11, 5, 2))], "block long, z0 int, z1 int")
    z = sections(spark, sf).select(F.col("z").cast("int").alias("z"))
    nodes = z.join(F.broadcast(blocks), (F.col("z") >= F.col("z0")) & (F.col("z") <= F.col("z1"))).select("block", F.col("z").cast("long").alias("node"), F.lit(0.0).alias("i"), F.lit(0.0).alias("j"), (F.col("z") == F.col("z0")).alias("fixed"))
    # Each match adds a fixed node of its own at the mean shift, joined to its target by a spring without length.
    m = mean.join(F.broadcast(blocks), (F.col("src_z") >= F.col("z0")) & (F.col("dst_z") <= F.col("z1")))
    own = (F.lit(1000) + F.col("src_z") * 100 + F.col("dst_z")).cast("long")
    anchors = m.select("block", own.alias("node"), F.col("di").alias("i"), F.col("dj").alias("j"), F.lit(True).alias("fixed"))
    three = F.array(F.struct(F.col("src_z").cast("long").alias("node"), F.lit(-1.0).alias("val")), F.struct(F.col("dst_z").cast("long").alias("node"), F.lit(1.0).alias("val")), F.struct(own.alias("node"), F.lit(1.0).alias("val")))
    ends = m.select("block", own.alias("spring"), F.explode(three).alias("s"), (F.lit(100.0) / (F.col("dst_z") - F.col("src_z"))).alias("k"), F.lit(0.0).alias("rest")).select("block", "spring", "s.*", "k", "rest")
    return so.relax_blocks(nodes.unionByName(anchors), ends).where("node < 1000").select("block", "node", "dst_i", "dst_j")


@query("win_spanning_tree", f"WITH {TILES}, n AS (SELECT a.z FROM tiles a JOIN tiles b ON a.z = b.z AND ((b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col))) SELECT t.z, count(*) - 1 AS n FROM tiles t WHERE z IN (SELECT z FROM n) GROUP BY t.z")
def win_spanning_tree(spark, sf):
    """The trees reach every tile of a grid without holes; tests hold their weights."""
    e = jon.tile_neighbours(tiles(spark, sf), 0).withColumn("r", (F.col("a") * 7 + F.col("b") * 13) % 101 / 101.0)
    return jon.spanning_tree(e).groupBy("z").agg(F.count(F.lit(1)).alias("n"))


# Tasks and storage


@query("tsk_pair_messages", f"{BASE}, z AS ({SECTIONS}) SELECT 'match-' || a.z || '-' || b.z AS task_id, 'match' AS method, a.z AS src_z, b.z AS dst_z, '{{\"depth\":2}}' AS params FROM z a JOIN z b ON b.z - a.z BETWEEN 1 AND 2")
def tsk_pair_messages(spark, sf):
    return tk.pair_tasks(jon.section_pairs(sections(spark, sf), 2), "match", '{"depth":2}')


@query("tsk_chunks", f"WITH {SQL_PLANE} SELECT CAST(x AS INT) AS x0, CAST(least(x + 100, w) AS INT) AS x1, CAST(y AS INT) AS y0, CAST(least(y + 100, h) AS INT) AS y1, CAST(z AS INT) AS z0, CAST(least(z + 4, 10) AS INT) AS z1 FROM extent, generate_series(0, w - 1, 100) a(x), generate_series(0, h - 1, 100) b(y), generate_series(0, 9, 4) c(z)")
def tsk_chunks(spark, sf):
    """Chunk tasks over the planes that all tiles make up."""
    height, width = mosaic_extent(spark, sf)
    return tk.chunk_tasks(spark, ((0, width), (0, height), (0, 10)), (100, 100, 4))


def scratch(spark: SparkSession) -> str:
    import uuid

    storage.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/laminara-{uuid.uuid4().hex}"


@query("tsk_queue", SQL["tsk_pair_messages"].replace("SELECT 'match-'", "SELECT 'match-'").replace("'match' AS method", "'match' AS method"))
def tsk_queue(spark, sf):
    """Messages published as files, worked off by a stream, and what its handler wrote."""
    folder = scratch(spark)
    tk.publish(tsk_pair_messages(spark, sf), f"{folder}/queue")
    handlers = {"match": lambda df: df.write.mode("append").parquet(f"{folder}/done")}
    tk.subscribe(spark, f"{folder}/queue", f"{folder}/state", handlers, files_at_once=2).awaitTermination()
    return spark.read.parquet(f"{folder}/done").select("task_id", "method", "src_z", "dst_z", "params")


@query("src_volume", f"WITH {SQL_PX} SELECT CAST(tile AS INT) AS z, i, j, px FROM px WHERE tile IN (3, 7, 11) AND i > 4 AND px > 0")
def src_volume(spark, sf):
    """Pixels written as chunks, and a cut-out read again by section and rows. Every tile is a section, so that these are
    many and small and share folders."""
    path = scratch(spark)
    p = images(spark, sf).select(F.col("z").cast("int").alias("z"), "i", "j", "px")
    storage.write_volume(storage.by_blocks(storage.to_chunks(p, 4), 1024), path)
    return storage.from_chunks(storage.read_volume(spark, path, z=[3, 7, 11], mip=0, box=(5, 8, 1, 8))).select("z", "i", "j", "px").where("i > 4")


@query("src_manual_csv", f"{BASE} SELECT corr_id, rejected AS manual FROM base")
def src_manual_csv(spark, sf):
    path = scratch(spark)
    b = base(spark, sf)
    storage.write_points(b, path, manual_only=False)
    return storage.read_manual(b, path).select("corr_id", "manual")


@query("src_match_set", f"{BASE}, c AS (SELECT src_z, dst_z, count(*) AS n FROM base GROUP BY ALL) SELECT src_z, dst_z, n FROM c WHERE src_z BETWEEN 2 AND 6 AND dst_z BETWEEN 2 AND 6")
def src_match_set(spark, sf):
    path = scratch(spark)
    c = correspondences(spark, sf)
    storage.save_set(sections(spark, sf).withColumn("fixed", F.lit(False)), c.groupBy("src_z", "dst_z").agg(F.count(F.lit(1)).alias("n")), path)
    return storage.load_set(spark, path, 2, 6)[1].select("src_z", "dst_z", "n")


@query("src_missing_pairs", f"{BASE}, z AS ({SECTIONS}) SELECT a.z AS src_z, b.z AS dst_z FROM z a JOIN z b ON b.z - a.z BETWEEN 1 AND 3 WHERE (a.z, b.z) NOT IN (SELECT (src_z, dst_z) FROM base)")
def src_missing_pairs(spark, sf):
    path = scratch(spark)
    c = correspondences(spark, sf)
    storage.save_set(sections(spark, sf).withColumn("fixed", F.lit(False)), c.groupBy("src_z", "dst_z").agg(F.count(F.lit(1)).alias("n")), path)
    return storage.load_set(spark, path, 0, 99, jon.section_pairs(sections(spark, sf), 3))[2]


@query("src_z_map", f"{BASE} SELECT corr_id, CASE WHEN src_z % 3 = 0 THEN src_z + 100 ELSE src_z END AS src_z FROM base")
def src_z_map(spark, sf):
    z_map = spark.range(0, 20).where("id % 3 = 0").select(F.col("id").cast("int").alias("old_z"), (F.col("id") + 100).cast("int").alias("new_z"))
    return storage.with_z_map(correspondences(spark, sf).select("corr_id", "src_z"), z_map, "src_z")


@query("src_params", f"""{BASE} SELECT DISTINCT src_z, dst_z, CASE WHEN src_z % 2 = 0 THEN dst_z - src_z ELSE 2 END AS depth, CASE WHEN src_z % 3 = 0 THEN 10.0 * dst_z ELSE 160.0 END::DOUBLE AS mesh_length, CASE WHEN src_z % 5 = 0 THEN 'rigid' ELSE 'elastic' END AS method, 128 AS block_r, [0, CASE WHEN src_z % 2 = 0 THEN 3 ELSE 0 END]::DOUBLE[] AS bandpass_sigmas FROM base""")
def src_params(spark, sf):
    """Parameter files of all pairs, with some keys each, written and read again over the defaults, and looked up by key."""
    path, c = scratch(spark), correspondences(spark, sf).select("src_z", "dst_z").distinct()
    even, third, fifth = (F.col("src_z") % k == 0 for k in (2, 3, 5))
    text = F.to_json(F.struct(
        F.struct(F.when(even, F.col("dst_z") - F.col("src_z")).alias("depth"), F.when(even, F.array(F.lit(0.0), F.lit(3.0))).alias("bandpass_sigmas")).alias("match"),
        F.when(third, F.struct((F.col("dst_z") * 10.0).alias("mesh_length"))).alias("mesh"), F.when(fifth, F.struct(F.lit("rigid").alias("method"))).alias("solve"),
    ))
    c.withColumn("value", text).write.partitionBy("src_z", "dst_z").text(path)
    p = storage.with_params(spark.read.text(path), "value")
    wanted = ("depth", "mesh_length", "method", "block_r", "bandpass_sigmas")
    return p.select("src_z", "dst_z", *(storage.param(k).alias(k) for k in wanted))


@query("src_pairs_text", f"{BASE} SELECT src_z, dst_z FROM base")
def src_pairs_text(spark, sf):
    """All pairs written in three forms, one line or many, and read again."""
    path, c = scratch(spark), correspondences(spark, sf).select("corr_id", "src_z", "dst_z")
    line = F.when(F.col("corr_id") % 3 == 0, F.format_string("%d,%d", "src_z", "dst_z")).otherwise(F.format_string("((%d, %d),)", "src_z", "dst_z"))
    c.where("corr_id % 3 < 2").select(line).write.text(f"{path}/lines")
    c.where("corr_id % 3 = 2").groupBy((F.col("corr_id") % 64).alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.format_string("(%d,%d)", "src_z", "dst_z")), ","), F.lit("]")).alias("t")).select("t").write.text(f"{path}/lists")
    return storage.read_pairs(spark, f"{path}/*")


@query("src_tiles_tsv", f"WITH {TILES} SELECT tile, z, row, col FROM tiles")
def src_tiles_tsv(spark, sf):
    path = scratch(spark)
    tiles(spark, sf).select("tile", "z", "row", "col").write.option("sep", "\t").option("header", True).csv(path)
    return storage.read_tiles(spark, path, "tile long, z long, row long, col long")
