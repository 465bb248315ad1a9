"""Queries on correspondences: rules, pairs, joins, statistics, windows, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laminara.functions import names
from laminara.functions.registry import norm
from laminara.operators import filters as flt
from laminara.operators import joins as jon
from laminara.operators import stats as st
from laminara.operators.solve import z_blocks
from laminara.sources.derive import SQL_CORR, correspondences, table

R = st.r
REJECTED = """(sigma_095 > 6.5 OR sigma_075 > 20 OR sigma_05 > 150 OR dyn_range < 0.5 OR r_max < 0.0275 OR kurt_src > 25
OR kurt_dst > 50 OR kurt_src < -1.6 OR delta_5 < 0.07)"""
BASE = f"WITH {SQL_CORR}, base AS (SELECT *, sqrt(dv_i * dv_i + dv_j * dv_j) AS norm, {REJECTED} AS rejected FROM corr)"
COUNTS = f"""{BASE}, counts AS (SELECT src_z, dst_z, count(*) AS n, count(*) FILTER (NOT rejected) AS n_acc,
count(*) FILTER (rejected) AS n_rej, COALESCE(max(norm) FILTER (NOT rejected), 0) / 30 AS edge FROM base GROUP BY ALL)"""
SECTIONS = "SELECT DISTINCT src_z AS z FROM base UNION SELECT DISTINCT dst_z FROM base"


def base(spark: SparkSession, sf: str) -> DataFrame:
    return flt.with_rejected(correspondences(spark, sf))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    c = correspondences(spark, sf)
    return c.select(F.col("src_z").alias("z")).union(c.select("dst_z")).distinct()


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Rules and projections


@query("flt_chain", f"""{COUNTS} SELECT src_z, dst_z, n, n_acc, n_rej, round(n_acc / greatest(n, 1), 6) + 0.0 AS acc_ratio,
round(n_rej / greatest(n, 1), 6) + 0.0 AS rej_ratio, round(edge, 6) + 0.0 AS edge,
concat_ws(',', CASE WHEN n < 100 THEN 'too_few' END, CASE WHEN n_rej / greatest(n, 1) > 0.35 THEN 'rejected_ratio' END,
CASE WHEN edge > 0.8 THEN 'edge_proximity' END) AS flags,
(n < 100 OR n_rej / greatest(n, 1) > 0.35 OR edge > 0.8) AS flagged FROM counts""")
def flt_chain(spark, sf):
    out = st.review(st.match_counts(base(spark, sf)))
    return out.select("src_z", "dst_z", "n", "n_acc", "n_rej", R(F.col("acc_ratio")).alias("acc_ratio"), R(F.col("rej_ratio")).alias("rej_ratio"), R(F.col("edge")).alias("edge"), F.array_join("flags", ",").alias("flags"), "flagged")


@query("flt_columns", f"{BASE} SELECT corr_id, sigma_095 > 6.5 AS s95, sigma_075 > 20 AS s75, sigma_05 > 150 AS s5, dyn_range < 0.5 AS dyn, r_max < 0.0275 AS r, kurt_src > 25 AS ks, kurt_dst > 50 AS kd, kurt_src < -1.6 AS kl, delta_5 < 0.07 AS d5, rejected FROM base")
def flt_columns(spark, sf):
    b = base(spark, sf)
    return b.select("corr_id", *(F.col(c).alias(a) for c, a in zip(flt.rule_columns(b), ("s95", "s75", "s5", "dyn", "r", "ks", "kd", "kl", "d5"), strict=True)), "rejected")


@query("flt_rule_totals", f"{BASE} " + " UNION ALL ".join(f"SELECT '{flt.DEFAULT_RULES[k].column}' AS rule, count(*) FILTER ({r.feature} {r.compare} {r.threshold}) AS n FROM base" for k, r in enumerate(flt.DEFAULT_RULES)))
def flt_rule_totals(spark, sf):
    return flt.rule_totals(correspondences(spark, sf))


@query("flt_undo", f"WITH {SQL_CORR} SELECT src_z, dst_z, count(*) FILTER ({REJECTED.replace(' OR delta_5 < 0.07', '')}) AS n_rej FROM corr GROUP BY ALL")
def flt_undo(spark, sf):
    b = flt.undo_rule(flt.apply_rules(correspondences(spark, sf)))
    return b.withColumn("rejected", flt.rejected(b)).groupBy("src_z", "dst_z").agg(F.count_if("rejected").alias("n_rej"))


@query("flt_refilter", f"WITH {SQL_CORR} SELECT src_z, dst_z, count(*) FILTER (sigma_05 > 80 OR r_max < 0.1) AS n_rej FROM corr GROUP BY ALL")
def flt_refilter(spark, sf):
    b = flt.refilter(base(spark, sf), [flt.Rule(2, "r_max", "<", 0.1), flt.Rule(1, "sigma_05", ">", 80.0)])
    return b.groupBy("src_z", "dst_z").agg(F.count_if("rejected").alias("n_rej"))


@query("flt_manual_only", f"{BASE} SELECT corr_id, (corr_id % 7 = 0) AS by_hand, (corr_id % 7 = 0 OR rejected) AS by_any FROM base")
def flt_manual_only(spark, sf):
    b = flt.apply_rules(correspondences(spark, sf)).withColumn("manual", F.col("corr_id") % 7 == 0)
    return b.select("corr_id", flt.rejected(b, manual_only=True).alias("by_hand"), flt.rejected(b).alias("by_any"))


@query("flt_points", f"{BASE} SELECT corr_id, pre_i + 10 AS src_i, pre_j + 20 AS src_j, round(pre_i + 10 + dv_i, 6) + 0.0 AS dst_i, round(pre_j + 20 + dv_j, 6) + 0.0 AS dst_j FROM base WHERE NOT rejected")
def flt_points(spark, sf):
    return flt.points(base(spark, sf), accepted_only=True, offset=(10, 20)).withColumns({"dst_i": R(F.col("dst_i")), "dst_j": R(F.col("dst_j"))})


@query("flt_property", f"{BASE} SELECT corr_id, r_max, round(norm, 6) + 0.0 AS norm FROM base WHERE NOT rejected")
def flt_property(spark, sf):
    return base(spark, sf).where("not rejected").select("corr_id", "r_max", R(norm()).alias("norm"))


@query("flt_piecewise", f"{BASE} SELECT CAST(floor((src_z - 0) / 20) AS BIGINT) AS block, count(*) AS n, count(*) FILTER (delta_5 <= 0.07 OR norm >= 12) AS n_rej FROM base GROUP BY ALL")
def flt_piecewise(spark, sf):
    b = correspondences(spark, sf).withColumn("bad", flt.piecewise_reject(F.col("delta_5"), norm(), most=12.0))
    return b.groupBy(F.floor(F.col("src_z") / 20).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_rej"))


@query("flt_sanitize", f"{BASE} SELECT corr_id, (pre_i < 5 OR pre_j > 795 OR rejected) AS rejected FROM base")
def flt_sanitize(spark, sf):
    tri = F.when((F.col("pre_i") >= 5) & (F.col("pre_j") <= 795), F.struct("pre_i"))
    return base(spark, sf).select("corr_id", (tri.isNull() | F.col("rejected")).alias("rejected"))


@query("flt_snap", f"{BASE} SELECT corr_id, CAST(floor((pre_i - 3) / 64) * 64 + 3 AS INT) AS lo, CAST(ceil((pre_i - 3) / 64) * 64 + 3 AS INT) AS hi, least(greatest(pre_j - 100, 1), 500) AS kept FROM base")
def flt_snap(spark, sf):
    return correspondences(spark, sf).select("corr_id", flt.snap(F.col("pre_i"), 3, 64).alias("lo"), flt.snap(F.col("pre_i"), 3, 64, up=True).alias("hi"), flt.clamp(F.col("pre_j"), 100, 500).alias("kept"))


@query("flt_box", f"{BASE} SELECT corr_id, (pre_i BETWEEN 100 AND 400 AND pre_j BETWEEN 200 AND 450) AS at_start, ((pre_i BETWEEN 100 AND 400 AND pre_j BETWEEN 200 AND 450) OR (pre_i + dv_i BETWEEN 100 AND 400 AND pre_j + dv_j BETWEEN 200 AND 450)) AS line FROM base WHERE NOT (pre_i BETWEEN 0 AND 50 AND pre_j BETWEEN 0 AND 50)")
def flt_box(spark, sf):
    box = (100, 200, 300, 250)
    start = flt.in_box(F.col("pre_i"), F.col("pre_j"), box)
    end = flt.in_box(F.col("pre_i") + F.col("dv_i"), F.col("pre_j") + F.col("dv_j"), box)
    brush = flt.in_box(F.col("pre_i"), F.col("pre_j"), (0, 0, 50, 50))
    return correspondences(spark, sf).where(~brush).select("corr_id", start.alias("at_start"), (start | end).alias("line"))


@query("flt_export", f"{BASE} SELECT corr_id, CAST(trunc(pre_i * 4) AS INT) AS x0, CAST(trunc(pre_j * 4) AS INT) AS y0, CAST(trunc((pre_i + 2 * dv_i) * 4) AS INT) AS x1, CAST(trunc((pre_j + 2 * dv_j) * 4) AS INT) AS y1 FROM base WHERE NOT rejected")
def flt_export(spark, sf):
    return flt.export_points(base(spark, sf), scale=2.0, mip=2)


@query("flt_invert", f"{BASE} SELECT src_z, dst_z, count(*) FILTER (NOT rejected) AS n FROM (SELECT src_z, dst_z, NOT rejected AS rejected FROM base) GROUP BY ALL")
def flt_invert(spark, sf):
    return base(spark, sf).withColumn("rejected", ~F.col("rejected")).groupBy("src_z", "dst_z").agg(F.count_if(~F.col("rejected")).alias("n"))


@query("flt_lookup", f"{BASE} SELECT corr_id, src_z, dst_z FROM base WHERE src_z = 3 AND dst_z = 4")
def flt_lookup(spark, sf):
    return correspondences(spark, sf).where("src_z = 3 and dst_z = 4").select("corr_id", "src_z", "dst_z")


@query("flt_distance_sigma", f"{BASE} SELECT src_z, dst_z, count(*) FILTER (norm > 15) AS far, count(*) FILTER (sigma_05 > 60) AS wide FROM base GROUP BY ALL")
def flt_distance_sigma(spark, sf):
    b = flt.apply_rules(correspondences(spark, sf), [flt.Rule(1, "norm", ">", 15.0), flt.Rule(2, "sigma_05", ">", 60.0)])
    far, wide = flt.rule_columns(b)
    return b.groupBy("src_z", "dst_z").agg(F.count_if(far).alias("far"), F.count_if(wide).alias("wide"))


# Pairs and joins


@query("jon_pairs", f"{BASE}, z AS ({SECTIONS}) SELECT a.z AS src_z, b.z AS dst_z FROM z a JOIN z b ON b.z - a.z BETWEEN 1 AND 2")
def jon_pairs(spark, sf):
    return jon.section_pairs(sections(spark, sf), 2)


@query("jon_pairs_symmetric", f"{BASE}, z AS ({SECTIONS}) SELECT a.z AS src_z, b.z AS dst_z FROM z a JOIN z b ON abs(b.z - a.z) BETWEEN 1 AND 2")
def jon_pairs_symmetric(spark, sf):
    return jon.section_pairs(sections(spark, sf), 2, symmetric=True)


SUB = "s AS (SELECT DISTINCT CAST(CAST(user_id % 10 AS DECIMAL(12,3)) + CAST(event_id % 3 AS DECIMAL(12,3)) / 1000 AS DECIMAL(12,3)) AS idx FROM events)"


def subsections(spark, sf):
    e = table(spark, sf, "events")
    return e.select(names.index_of((F.col("user_id") % 10).cast("int"), (F.col("event_id") % 3).cast("int")).alias("idx")).distinct()


@query("jon_subsection_pairs", f"WITH {SUB} SELECT a.idx AS src_idx, b.idx AS dst_idx FROM s a JOIN s b ON floor(b.idx) - floor(a.idx) = 1")
def jon_subsection_pairs(spark, sf):
    return jon.subsection_pairs(subsections(spark, sf), 1)


@query("jon_component_matches", f"""{BASE}, z AS ({SECTIONS}), c AS (SELECT DISTINCT src_z AS z, CAST(corr_id % 4 AS INT) AS v FROM base WHERE corr_id % 4 <> 0),
p AS (SELECT a.z AS src_z, b.z AS dst_z FROM z a JOIN z b ON b.z - a.z = 1)
SELECT src_z, x.v AS src_v, dst_z, y.v AS dst_v FROM p JOIN c x ON x.z = src_z JOIN c y ON y.z = dst_z""")
def jon_component_matches(spark, sf):
    comps = correspondences(spark, sf).select(F.col("src_z").alias("z"), (F.col("corr_id") % 4).cast("int").alias("v"))
    return jon.component_matches(jon.section_pairs(sections(spark, sf), 1), comps)


@query("jon_concat", f"{BASE}, a AS (SELECT src_z, dst_z, count(*) AS n FROM base WHERE src_z < 6 GROUP BY ALL), b AS (SELECT src_z, dst_z, count(*) * 10 AS n FROM base WHERE src_z > 3 GROUP BY ALL) SELECT * FROM a UNION ALL SELECT * FROM b WHERE (src_z, dst_z) NOT IN (SELECT (src_z, dst_z) FROM a)")
def jon_concat(spark, sf):
    c = correspondences(spark, sf)
    a = c.where("src_z < 6").groupBy("src_z", "dst_z").agg(F.count(F.lit(1)).alias("n"))
    b = c.where("src_z > 3").groupBy("src_z", "dst_z").agg((F.count(F.lit(1)) * 10).alias("n"))
    return jon.concat_sets(a, b, ["src_z", "dst_z"])


@query("jon_sync", f"WITH {SUB} SELECT idx, CAST(floor(idx) AS DECIMAL(12,3)) AS parent FROM s WHERE idx <> floor(idx) AND floor(idx) IN (SELECT idx FROM s)")
def jon_sync(spark, sf):
    s = subsections(spark, sf)
    meshes = s.where(F.col("idx") == F.floor("idx"))
    pairs = jon.subsection_pairs(s, 1)
    return jon.missing_endpoints(pairs, meshes)


PRUNE = f"""{COUNTS}, m AS (SELECT z FROM ({SECTIONS}) WHERE z <> 4), q AS (SELECT src_z, dst_z, n, n_acc FROM counts WHERE n_acc > 30 AND src_z IN (SELECT z FROM m) AND dst_z IN (SELECT z FROM m)),
t AS (SELECT z, sum(n_acc) AS total FROM (SELECT src_z AS z, n_acc FROM q UNION ALL SELECT dst_z, n_acc FROM q) GROUP BY z), k AS (SELECT z FROM t WHERE total >= 30)"""


def pruned(spark, sf):
    b = base(spark, sf)
    counts = b.groupBy("src_z", "dst_z").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("rejected")).alias("n_acc"))
    return jon.prune(counts, sections(spark, sf).where("z <> 4"), least=30)


@query("jon_prune_matches", f"{PRUNE} SELECT src_z, dst_z, n, n_acc FROM q WHERE src_z IN (SELECT z FROM k) AND dst_z IN (SELECT z FROM k)")
def jon_prune_matches(spark, sf):
    return pruned(spark, sf)[0]


@query("jon_prune_meshes", f"{PRUNE} SELECT z FROM m WHERE z IN (SELECT z FROM k)")
def jon_prune_meshes(spark, sf):
    return pruned(spark, sf)[1]


@query("jon_remove_mesh", f"{BASE} SELECT src_z, dst_z, count(*) AS n FROM base WHERE src_z <> 5 AND dst_z <> 5 GROUP BY ALL")
def jon_remove_mesh(spark, sf):
    return jon.remove_section(correspondences(spark, sf), 5).groupBy("src_z", "dst_z").agg(F.count(F.lit(1)).alias("n"))


NEAR = """near AS (SELECT a.corr_id, count(*) AS n, avg(b.dv_i) AS mi, avg(b.dv_j) AS mj, stddev_pop(b.dv_i) AS si, stddev_pop(b.dv_j) AS sj
FROM base a JOIN base b ON a.src_z = b.src_z AND a.dst_z = b.dst_z AND abs(a.pre_i - b.pre_i) < 25 AND abs(a.pre_j - b.pre_j) < 25
AND (a.pre_i - b.pre_i) ** 2 + (a.pre_j - b.pre_j) ** 2 > 0 AND (a.pre_i - b.pre_i) ** 2 + (a.pre_j - b.pre_j) ** 2 < 625 {extra} GROUP BY a.corr_id)"""
ZED = """CASE WHEN n IS NULL THEN 'Infinity'::DOUBLE WHEN s{c} > 1e-9 THEN (dv_{c} - m{c}) / s{c} WHEN abs(dv_{c} - m{c}) < 1e-9 THEN 0 ELSE 'Infinity'::DOUBLE END"""


def consensus_sql(extra: str) -> str:
    zi, zj = ZED.format(c="i"), ZED.format(c="j")
    near = NEAR.format(extra=extra)
    return f"""{BASE}, {near}, z AS (SELECT corr_id, COALESCE(n, 0) AS n_near, {zi} AS zi, {zj} AS zj, sqrt((dv_i - mi) ** 2 + (dv_j - mj) ** 2) AS off
FROM base LEFT JOIN near USING (corr_id)) SELECT corr_id, n_near, round(sqrt(zi * zi + zj * zj), 4) + 0.0 AS score, round(off, 4) + 0.0 AS off FROM z"""


@query("agg_consensus", consensus_sql(""))
def agg_consensus(spark, sf):
    return jon.consensus(base(spark, sf), 25.0).select("corr_id", "n_near", R(F.col("score"), 4).alias("score"), R(F.col("off"), 4).alias("off"))


@query("agg_consensus_accepted", consensus_sql("AND NOT b.rejected"))
def agg_consensus_accepted(spark, sf):
    return jon.consensus(base(spark, sf), 25.0, accepted_neighbours=True).select("corr_id", "n_near", R(F.col("score"), 4).alias("score"), R(F.col("off"), 4).alias("off"))


@query("agg_consensus_both_accepted", consensus_sql("AND NOT b.rejected").replace("FROM base LEFT JOIN near", "FROM (SELECT * FROM base WHERE NOT rejected) LEFT JOIN near"))
def agg_consensus_both_accepted(spark, sf):
    out = jon.consensus(base(spark, sf), 25.0, accepted_neighbours=True).where("not rejected")
    return out.select("corr_id", "n_near", R(F.col("score"), 4).alias("score"), R(F.col("off"), 4).alias("off"))


BOXES = "boxes AS (SELECT p_partkey AS id, (p_partkey * 37) % 3000 AS i, (p_partkey * 91) % 3000 AS j, p_size AS h, (p_size * 3) % 70 + 5 AS w FROM part)"


def boxes(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), ((k * 37) % 3000).alias("i"), ((k * 91) % 3000).alias("j"), F.col("p_size").alias("h"), ((F.col("p_size") * 3) % 70 + 5).alias("w"))


@query("jon_box_overlaps", f"WITH {BOXES} SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.id <> b.id AND a.i <= b.i + b.h AND b.i <= a.i + a.h AND a.j <= b.j + b.w AND b.j <= a.j + a.w")
def jon_box_overlaps(spark, sf):
    return jon.box_overlaps(boxes(spark, sf))


TILES = "tiles AS (SELECT DISTINCT s_suppkey % 5 AS z, s_suppkey // 5 // 10 AS row, s_suppkey // 5 % 10 AS col, s_suppkey AS tile, s_suppkey // 5 // 10 * 900 + s_suppkey % 7 AS i, s_suppkey // 5 % 10 * 900 + s_suppkey % 11 AS j, 1000 AS h, 1000 + s_suppkey % 3 AS w FROM supplier)"


def tiles(spark, sf):
    k = F.col("s_suppkey")
    n = F.expr("s_suppkey div 5")
    return table(spark, sf, "supplier").select((k % 5).alias("z"), F.expr("s_suppkey div 5 div 10").alias("row"), (n % 10).alias("col"), k.alias("tile"), (F.expr("s_suppkey div 5 div 10") * 900 + k % 7).alias("i"), ((n % 10) * 900 + k % 11).alias("j"), F.lit(1000).alias("h"), (1000 + k % 3).alias("w"))


@query("jon_tile_neighbours", f"""WITH {TILES}, n AS (SELECT a.z, a.tile AS a, b.tile AS b, CASE WHEN b.col = a.col + 1 THEN least(a.i + a.h, b.i + b.h) - greatest(a.i, b.i)
ELSE least(a.j + a.w, b.j + b.w) - greatest(a.j, b.j) END AS side FROM tiles a JOIN tiles b ON a.z = b.z AND ((b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col)))
SELECT * FROM n WHERE side > 995""")
def jon_tile_neighbours(spark, sf):
    return jon.tile_neighbours(tiles(spark, sf), 995)


@query("jon_nearest", f"{BASE} SELECT corr_id, (pre_i - 500) ** 2 + (pre_j - 400) ** 2 AS d2 FROM base WHERE NOT rejected ORDER BY 2, 1 LIMIT 1")
def jon_nearest(spark, sf):
    return jon.nearest(base(spark, sf), 500.0, 400.0).select("corr_id", "d2")


@query("jon_nearest_single", f"{BASE} SELECT CASE WHEN count(*) = 1 THEN min(corr_id) ELSE 0 END AS corr_id FROM base WHERE (pre_i - 500) ** 2 + (pre_j - 400) ** 2 < 25")
def jon_nearest_single(spark, sf):
    return jon.nearest_if_single(correspondences(spark, sf), 500.0, 400.0, 5.0)


@query("jon_nearest_segment", f"""{BASE}, t AS (SELECT *, greatest(0, least(1, COALESCE(((500 - pre_i) * dv_i + (400 - pre_j) * dv_j) / nullif(dv_i * dv_i + dv_j * dv_j, 0), 0))) AS t FROM base)
SELECT corr_id, round((500 - pre_i - t * dv_i) ** 2 + (400 - pre_j - t * dv_j) ** 2, 6) + 0.0 AS d2 FROM t ORDER BY 2, 1 LIMIT 1""")
def jon_nearest_segment(spark, sf):
    d = R(jon.segment_distance2(500.0, 400.0))
    return correspondences(spark, sf).select("corr_id", d.alias("d2")).orderBy("d2", "corr_id").limit(1)


@query("jon_node_offsets", f"{COUNTS}, s AS (SELECT src_z AS z, sum(n) AS n FROM counts GROUP BY 1) SELECT z, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (ORDER BY z) - n + 1 AS BIGINT) AS first FROM s")
def jon_node_offsets(spark, sf):
    return jon.with_offsets(correspondences(spark, sf).groupBy(F.col("src_z").alias("z")).agg(F.count(F.lit(1)).alias("n")), "z", "n")


@query("jon_minus_neighbour_mean", f"""{BASE}, p AS (SELECT * FROM base), n AS (SELECT a.corr_id, a.r_max AS v, b.r_max AS nv, row_number() OVER (PARTITION BY a.corr_id ORDER BY greatest(abs(a.pre_i - b.pre_i), abs(a.pre_j - b.pre_j)), b.corr_id) AS k
FROM p a JOIN p b ON a.src_z = b.src_z AND abs(a.pre_i - b.pre_i) <= 80 AND abs(a.pre_j - b.pre_j) <= 80)
SELECT corr_id, round(max(v) - avg(nv), 9) + 0.0 AS rest FROM n WHERE k <= 8 GROUP BY corr_id""")
def jon_minus_neighbour_mean(spark, sf):
    p = correspondences(spark, sf)
    return jon.minus_neighbour_mean(p, ["src_z"], "corr_id", "pre_i", "pre_j", "r_max", 80.0, 8).select("corr_id", R(F.col("rest"), 9).alias("rest"))


@query("jon_split_by_date", "SELECT CAST(o_orderdate AS DATE) >= DATE '1995-06-01' AS keep, count(*) AS n, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY ALL")
def jon_split_by_date(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").groupBy((d >= F.lit("1995-06-01").cast("date")).alias("keep")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(d).alias("days"))


# Statistics


@query("agg_counts_least", f"{COUNTS} SELECT src_z, dst_z, CASE WHEN n < 400 THEN 1.0 ELSE round(n_acc / greatest(n, 1), 6) + 0.0 END AS acc_ratio, CASE WHEN n < 400 THEN 0.0 ELSE round(n_rej / greatest(n, 1), 6) + 0.0 END AS rej_ratio FROM counts")
def agg_counts_least(spark, sf):
    return st.match_counts(base(spark, sf), min_count=400).select("src_z", "dst_z", R(F.col("acc_ratio")).alias("acc_ratio"), R(F.col("rej_ratio")).alias("rej_ratio"))


@query("agg_outlier_norms", f"""{BASE}, s AS (SELECT src_z, dst_z, avg(norm) AS m, stddev_samp(norm) AS s FROM base WHERE NOT rejected GROUP BY ALL)
SELECT src_z, dst_z, count(*) FILTER (round((norm - m) / nullif(s, 0), 6) > 1.5) AS n FROM base LEFT JOIN s USING (src_z, dst_z) GROUP BY ALL""")
def agg_outlier_norms(spark, sf):
    return st.scored(base(spark, sf)).groupBy("src_z", "dst_z").agg(F.count_if(F.round("score", 6) > 1.5).alias("n"))


@query("agg_median_dv", f"{BASE} SELECT src_z, dst_z, round(median(dv_i) FILTER (NOT rejected), 6) + 0.0 AS med_i, round(median(dv_j) FILTER (NOT rejected), 6) + 0.0 AS med_j FROM base GROUP BY ALL")
def agg_median_dv(spark, sf):
    return st.medians(base(spark, sf)).select("src_z", "dst_z", R(F.col("med_i")).alias("med_i"), R(F.col("med_j")).alias("med_j"))


CENTRED = f"""{BASE}, m AS (SELECT src_z, dst_z, median(dv_i) FILTER (NOT rejected) AS mi, median(dv_j) FILTER (NOT rejected) AS mj FROM base GROUP BY ALL),
c AS (SELECT *, sqrt((dv_i - mi) ** 2 + (dv_j - mj) ** 2) AS centred FROM base JOIN m USING (src_z, dst_z))"""


@query("agg_centred_norms", f"{CENTRED} SELECT corr_id, round(centred, 6) + 0.0 AS centred FROM c")
def agg_centred_norms(spark, sf):
    return st.centred(base(spark, sf)).select("corr_id", R(F.col("centred")).alias("centred"))


@query("agg_max_centred_norm", f"{CENTRED} SELECT src_z, dst_z, round(max(centred) FILTER (NOT rejected), 6) + 0.0 AS m FROM c GROUP BY ALL")
def agg_max_centred_norm(spark, sf):
    return st.centred(base(spark, sf)).groupBy("src_z", "dst_z").agg(R(F.max(F.when(~F.col("rejected"), F.col("centred")))).alias("m"))


@query("agg_property_ratios", f"{BASE} SELECT corr_id, round(sigma_05 / nullif(sigma_075, 0) / nullif(sigma_095, 0), 6) + 0.0 AS ratio FROM base")
def agg_property_ratios(spark, sf):
    return correspondences(spark, sf).select("corr_id", R(F.try_divide(F.try_divide(F.col("sigma_05"), F.col("sigma_075")), F.col("sigma_095"))).alias("ratio"))


@query("agg_norm_std", f"{BASE} SELECT src_z, dst_z, round(COALESCE(stddev_samp(norm) FILTER (NOT rejected), 0), 6) + 0.0 AS std FROM base GROUP BY ALL")
def agg_norm_std(spark, sf):
    return base(spark, sf).groupBy("src_z", "dst_z").agg(R(F.coalesce(F.stddev_samp(F.when(~F.col("rejected"), norm())), F.lit(0.0))).alias("std"))


@query("agg_norm_sigmas", f"""{BASE}, s AS (SELECT src_z, dst_z, avg(norm) AS m, stddev_samp(norm) AS s FROM base WHERE NOT rejected GROUP BY ALL)
SELECT corr_id, round((norm - m) / nullif(s, 0), 6) + 0.0 AS score FROM base LEFT JOIN s USING (src_z, dst_z)""")
def agg_norm_sigmas(spark, sf):
    return st.scored(base(spark, sf)).select("corr_id", R(F.col("score")).alias("score"))


STATS = f"{BASE}, p AS (SELECT src_z, dst_z, count(r_max) AS n, round(min(r_max), 2) + 0.0 AS min, round(median(r_max), 2) + 0.0 AS med, round(max(r_max), 2) + 0.0 AS max, round(stddev_samp(r_max), 2) + 0.0 AS std FROM base GROUP BY ALL)"


@query("agg_property_stats", f"{STATS} SELECT * FROM p")
def agg_property_stats(spark, sf):
    return st.property_stats(base(spark, sf), "r_max")


@query("agg_flag_stats", f"{STATS}, t AS (SELECT median(med) AS m, stddev_samp(med) AS s FROM p) SELECT src_z, dst_z, med, (med < m - 1.5 * s OR med > m + 1.5 * s) AS flagged FROM p, t")
def agg_flag_stats(spark, sf):
    return st.flag_outlying(st.property_stats(base(spark, sf), "r_max")).select("src_z", "dst_z", "med", "flagged")


WIDE = ", ".join(f"round(avg({c}), 6) + 0.0 AS {c}_avg, round(stddev_samp({c}), 6) + 0.0 AS {c}_std, round(max({c}), 6) + 0.0 AS {c}_max" for c in ("sigma_095", "sigma_075", "sigma_05"))


@query("agg_residual_stats", f"""{BASE} SELECT src_z, dst_z, count(*) AS n, round(sqrt(avg(norm * norm)), 6) + 0.0 AS rms, round(avg(norm), 6) + 0.0 AS avg, round(stddev_samp(norm), 6) + 0.0 AS std, round(max(norm), 6) + 0.0 AS max,
round(avg(dv_i), 6) + 0.0 AS drift_i, round(avg(dv_j), 6) + 0.0 AS drift_j, round(avg(r_max), 6) + 0.0 AS r_avg, round(stddev_samp(r_max), 6) + 0.0 AS r_std, round(min(r_max), 6) + 0.0 AS r_min, {WIDE}
FROM base WHERE NOT rejected GROUP BY ALL HAVING count(*) > 1""")
def agg_residual_stats(spark, sf):
    s = st.residual_stats(base(spark, sf))
    return s.select(*s.columns[:3], *(R(F.col(c)).alias(c) for c in s.columns[3:]))


@query("agg_residual_summary", f"""{BASE}, m AS (SELECT src_z, dst_z, count(*) AS n, avg(dv_i) AS di, avg(dv_j) AS dj, sum(norm * norm) AS s2, sum(norm) AS s1, max(norm) AS m FROM base WHERE NOT rejected GROUP BY ALL HAVING count(*) > 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sqrt(sum(s2) / sum(n)), 6) + 0.0 AS rms, round(sum(s1) / sum(n), 6) + 0.0 AS avg, round(max(m), 6) + 0.0 AS max, round(avg(di), 6) + 0.0 AS drift_i, round(avg(dj), 6) + 0.0 AS drift_j FROM m""")
def agg_residual_summary(spark, sf):
    s = st.residual_summary(base(spark, sf))
    return s.select("n", *(R(F.col(c)).alias(c) for c in s.columns[1:]))


@query("agg_drift", f"""{BASE}, z AS ({SECTIONS}), c AS (SELECT dst_z AS z, -avg(dv_i) AS di, -avg(dv_j) AS dj FROM base WHERE NOT rejected GROUP BY src_z, dst_z),
s AS (SELECT z.z, COALESCE(sum(di), 0) AS di, COALESCE(sum(dj), 0) AS dj FROM z LEFT JOIN c ON c.z = z.z GROUP BY z.z)
SELECT z, round(sum(di) OVER (ORDER BY z) + 1, 4) + 0.0 AS cum_i, round(sum(dj) OVER (ORDER BY z) + 2, 4) + 0.0 AS cum_j FROM s""")
def agg_drift(spark, sf):
    return st.drift(base(spark, sf), bias=(1.0, 2.0)).select("z", R(F.col("cum_i"), 4).alias("cum_i"), R(F.col("cum_j"), 4).alias("cum_j"))


@query("agg_post_residuals", f"{BASE} SELECT corr_id, round(dv_i + (dst_z - src_z) * 0.5, 6) + 0.0 AS di, round(dv_j - (dst_z - src_z) * 0.25, 6) + 0.0 AS dj, round(sqrt((dv_i + (dst_z - src_z) * 0.5) ** 2 + (dv_j - (dst_z - src_z) * 0.25) ** 2), 6) + 0.0 AS norm FROM base")
def agg_post_residuals(spark, sf):
    c = correspondences(spark, sf)
    shift = sections(spark, sf).select("z", (F.col("z") * 0.5).alias("si"), (F.col("z") * -0.25).alias("sj"))
    at = lambda p: shift.select(F.col("z").alias(f"{p}_z"), F.col("si").alias(f"{p}_si"), F.col("sj").alias(f"{p}_sj"))
    j = c.join(at("src"), "src_z").join(at("dst"), "dst_z")
    di, dj = F.col("dv_i") + F.col("dst_si") - F.col("src_si"), F.col("dv_j") + F.col("dst_sj") - F.col("src_sj")
    return j.select("corr_id", R(di).alias("di"), R(dj).alias("dj"), R(F.sqrt(di * di + dj * dj)).alias("norm"))


@query("agg_count_outliers", f"{BASE}, s AS (SELECT src_z, dst_z, avg(norm) AS m, stddev_pop(norm) AS s FROM base GROUP BY ALL) SELECT src_z, dst_z, count(*) FILTER (norm > round(m + 1.5 * s, 6)) AS n FROM base JOIN s USING (src_z, dst_z) GROUP BY ALL")
def agg_count_outliers(spark, sf):
    b = base(spark, sf).withColumn("norm", norm())
    s = b.groupBy("src_z", "dst_z").agg(F.round(F.avg("norm") + 1.5 * F.stddev_pop("norm"), 6).alias("top"))
    return b.join(s, ["src_z", "dst_z"]).groupBy("src_z", "dst_z").agg(F.count_if(F.col("norm") > F.col("top")).alias("n"))


EVAL = f"{BASE}, e AS (SELECT src_z, dst_z, count(*) FILTER (rejected AND corr_id % 3 <> 0) AS false_rej, count(*) FILTER (NOT rejected AND corr_id % 3 = 0) AS false_acc, count(*) FILTER (rejected AND corr_id % 3 = 0) AS common FROM base GROUP BY ALL)"


@query("agg_evaluate", f"{EVAL} SELECT *, false_rej + common > 100 AS reject FROM e")
def agg_evaluate(spark, sf):
    return st.evaluate(base(spark, sf), F.col("corr_id") % 3 == 0, F.col("rejected"), 100)


@query("agg_precision_recall", f"{EVAL} SELECT round(sum(common) / sum(common + false_rej), 6) + 0.0 AS precision, round(sum(common) / sum(common + false_acc), 6) + 0.0 AS recall, count(*) FILTER (false_rej + common > 100) AS workload FROM e")
def agg_precision_recall(spark, sf):
    p = st.precision_recall(st.evaluate(base(spark, sf), F.col("corr_id") % 3 == 0, F.col("rejected"), 100))
    return p.select(R(F.col("precision")).alias("precision"), R(F.col("recall")).alias("recall"), "workload")


@query("agg_sweep", f"""{BASE} SELECT CAST(k AS INT) AS k, count(*) FILTER (r_max < k * 0.01::DOUBLE AND rejected) AS tp, count(*) FILTER (r_max < k * 0.01::DOUBLE AND NOT rejected) AS fp,
count(*) FILTER (NOT r_max < k * 0.01::DOUBLE AND rejected) AS fn, count(*) FILTER (NOT r_max < k * 0.01::DOUBLE AND NOT rejected) AS tn FROM base, generate_series(1, 100) AS g(k) GROUP BY ALL""")
def agg_sweep(spark, sf):
    return st.sweep(base(spark, sf), "r_max", F.col("rejected"))


@query("agg_histogram", f"""{BASE}, e AS (SELECT min(sigma_05) AS lo, max(sigma_05) AS hi FROM base)
SELECT least(20, CAST(floor((sigma_05 - lo) / (hi - lo) * 20) AS INT) + 1) AS bin, count(*) AS n FROM base, e GROUP BY ALL""")
def agg_histogram(spark, sf):
    return st.histogram(base(spark, sf), "sigma_05")


@query("agg_describe_by_depth", f"{BASE} SELECT rejected, dst_z - src_z AS depth, count(*) AS n, round(avg(r_max), 6) + 0.0 AS mean, round(stddev_samp(r_max), 6) + 0.0 AS std, round(quantile_cont(r_max, 0.25), 6) + 0.0 AS q1, round(median(r_max), 6) + 0.0 AS q2, round(quantile_cont(r_max, 0.75), 6) + 0.0 AS q3 FROM base GROUP BY ALL")
def agg_describe_by_depth(spark, sf):
    return base(spark, sf).groupBy("rejected", (F.col("dst_z") - F.col("src_z")).alias("depth")).agg(F.count(F.lit(1)).alias("n"), R(F.avg("r_max")).alias("mean"), R(F.stddev_samp("r_max")).alias("std"), *(R(F.percentile("r_max", F.lit(p))).alias(q) for p, q in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))))


@query("agg_stats_wide", f"{BASE} SELECT src_z, " + ", ".join(f"count(*) FILTER (dst_z - src_z = {d} AND NOT rejected) AS d{d}" for d in (1, 2)) + " FROM base GROUP BY ALL")
def agg_stats_wide(spark, sf):
    b = base(spark, sf).withColumn("depth", F.concat(F.lit("d"), F.col("dst_z") - F.col("src_z")))
    return b.groupBy("src_z").pivot("depth", ["d1", "d2"]).agg(F.count_if(~F.col("rejected"))).fillna(0)


@query("agg_bbox", f"{BASE} SELECT src_z, min(pre_i) AS i0, min(pre_j) AS j0, max(pre_i) AS i1, max(pre_j) AS j1 FROM base GROUP BY ALL")
def agg_bbox(spark, sf):
    return correspondences(spark, sf).groupBy("src_z").agg(F.min("pre_i").alias("i0"), F.min("pre_j").alias("j0"), F.max("pre_i").alias("i1"), F.max("pre_j").alias("j1"))


@query("agg_tile_extents", f"WITH {TILES} SELECT z, max(col) AS cols, max(row) AS rows, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM tiles GROUP BY ALL")
def agg_tile_extents(spark, sf):
    return tiles(spark, sf).groupBy("z").agg(F.max("col").alias("cols"), F.max("row").alias("rows"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))


@query("agg_lost_ids", f"{BASE}, s AS (SELECT DISTINCT src_z AS z, corr_id % 997 AS id FROM base) SELECT a.z, count(*) AS n, count(*) FILTER (b.id IS NULL) AS lost FROM s a LEFT JOIN s b ON b.z = a.z + 1 AND b.id = a.id GROUP BY a.z")
def agg_lost_ids(spark, sf):
    s = correspondences(spark, sf).select(F.col("src_z").alias("z"), (F.col("corr_id") % 997).alias("id")).distinct()
    nxt = s.select((F.col("z") - 1).alias("z"), "id", F.lit(1).alias("stays"))
    return s.join(nxt, ["z", "id"], "left").groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stays").isNull()).alias("lost"))


@query("agg_compare_labels", f"{BASE}, l AS (SELECT src_z AS z, corr_id % 50 AS id, bool_or(corr_id % 2 = 0) AS a, bool_or(corr_id % 3 = 0) AS b FROM base GROUP BY ALL) SELECT z, count(*) FILTER (a AND b) AS both_, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM l GROUP BY z")
def agg_compare_labels(spark, sf):
    c = correspondences(spark, sf).select(F.col("src_z").alias("z"), (F.col("corr_id") % 50).alias("id"), "corr_id")
    a, b = (c.where(f"corr_id % {k} = 0").select("z", "id").distinct() for k in (2, 3))
    count = lambda d, n: d.groupBy("z").agg(F.count(F.lit(1)).alias(n))
    z = c.select("z").distinct()
    out = z.join(count(a.intersect(b), "both_"), "z", "left").join(count(a.exceptAll(b), "only_a"), "z", "left").join(count(b.exceptAll(a), "only_b"), "z", "left")
    return out.fillna(0)


@query("agg_rule_union", f"{BASE} SELECT count(*) FILTER (sigma_095 > 6.5) AS a, count(*) FILTER (kurt_src > 25) AS b, count(*) FILTER (norm > 12) AS c, count(*) FILTER (sigma_095 > 6.5 OR kurt_src > 25 OR norm > 12) AS any_ FROM base")
def agg_rule_union(spark, sf):
    rules = [F.col("sigma_095") > 6.5, F.col("kurt_src") > 25, norm() > 12]
    return correspondences(spark, sf).agg(*(F.count_if(r).alias(n) for r, n in zip(rules, "abc", strict=True)), F.count_if(flt.any_of(rules)).alias("any_"))


@query("agg_parameter_grid", f"{BASE} SELECT low, high, round(count(*) FILTER (r_max * (1 - low / 10) < delta_5 * (1 + high / 10)) / count(*), 6) + 0.0 AS error FROM base, (VALUES (0.0::DOUBLE), (1.0), (2.0)) a(low), (VALUES (5.0::DOUBLE), (10.0)) b(high) GROUP BY ALL")
def agg_parameter_grid(spark, sf):
    # A handful of parameter pairs, known at plan time: each is a conditional sum in one pass over the rows.
    pairs = [(a, b) for a in (0.0, 1.0, 2.0) for b in (5.0, 10.0)]
    one = correspondences(spark, sf).agg(F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), (F.count_if(F.col("r_max") * (1 - a / 10) < F.col("delta_5") * (1 + b / 10)) / F.count(F.lit(1))).alias("error")) for a, b in pairs)).alias("g"))
    return one.select(F.explode("g").alias("g")).select("g.low", "g.high", R(F.col("g.error")).alias("error"))


@query("agg_training_data", f"{BASE} SELECT corr_id, CASE WHEN rejected THEN -1 ELSE 1 END AS label, round(r_max, 6) + 0.0 AS r_max, round(norm, 6) + 0.0 AS norm, round(CASE WHEN rejected THEN n / (2.0 * nr) ELSE n / (2.0 * (n - nr)) END, 6) + 0.0 AS weight FROM base, (SELECT count(*) AS n, count(*) FILTER (rejected) AS nr FROM base)")
def agg_training_data(spark, sf):
    b = base(spark, sf)
    t = b.agg(F.count(F.lit(1)).alias("n"), F.count_if("rejected").alias("nr"))
    w = F.col("n") / (2.0 * F.when(F.col("rejected"), F.col("nr")).otherwise(F.col("n") - F.col("nr")))
    return b.crossJoin(F.broadcast(t)).select("corr_id", F.when(F.col("rejected"), -1).otherwise(1).alias("label"), R(F.col("r_max")).alias("r_max"), R(norm()).alias("norm"), R(w).alias("weight"))


@query("agg_logistic_regression")
def agg_logistic_regression(spark, sf):
    """Coefficients of a logistic regression of rejection; parity of digits isn't promised, so there is no SQL."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    b = base(spark, sf).withColumn("label", F.col("rejected").cast("double")).withColumn("norm", norm())
    x = VectorAssembler(inputCols=["r_max", "delta_5", "norm"], outputCol="features").transform(b)
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(x)
    rows = [("intercept", float(model.intercept)), *zip(("r_max", "delta_5", "norm"), map(float, model.coefficients), strict=True)]
    return spark.createDataFrame(rows, "name string, value double")


# Windows, order and sets


@query("win_blocks", f"""{BASE}, z AS ({SECTIONS}), e AS (SELECT min(z) AS a, max(z) AS b FROM z), w AS (SELECT CAST(s AS INT) AS z0, CAST(least(s + 4, b) AS INT) AS z1, lag(s + 4) OVER (ORDER BY s) AS before, b FROM e, generate_series(a, b - 1, 3) g(s))
SELECT w.z0, w.z1, count(*) AS n FROM w JOIN base ON src_z BETWEEN w.z0 AND w.z1 AND dst_z BETWEEN w.z0 AND w.z1 WHERE before IS NULL OR before < b GROUP BY ALL""")
def win_blocks(spark, sf):
    """Overlapping runs over all sections, and the correspondences within each."""
    ends = sections(spark, sf).agg(F.min("z"), F.max("z")).first()
    runs = spark.createDataFrame(z_blocks(ends[0], ends[1], 3, 2), "z0 int, z1 int")
    within = (F.col("src_z") >= F.col("z0")) & (F.col("src_z") <= F.col("z1")) & (F.col("dst_z") >= F.col("z0")) & (F.col("dst_z") <= F.col("z1"))
    # The runs are a few numbers made at plan time.
    return correspondences(spark, sf).select("src_z", "dst_z").join(F.broadcast(runs), within).groupBy("z0", "z1").agg(F.count(F.lit(1)).alias("n"))


@query("win_shift_row", f"WITH {TILES} SELECT tile, COALESCE(lead(j, 2) OVER (PARTITION BY z, row ORDER BY col), max(j) OVER (PARTITION BY z, row) + 900 * (col + 2 - max(col) OVER (PARTITION BY z, row))) AS j FROM tiles")
def win_shift_row(spark, sf):
    row = Window.partitionBy("z", "row")
    t = tiles(spark, sf)
    tail = F.max("j").over(row) + 900 * (F.col("col") + 2 - F.max("col").over(row))
    return t.select("tile", F.coalesce(F.lead("j", 2).over(row.orderBy("col")), tail).alias("j"))


@query("win_cumulative", f"{COUNTS}, s AS (SELECT src_z AS z, sum(n_acc) AS n FROM counts GROUP BY 1) SELECT z, CAST(sum(n) OVER (ORDER BY z) AS BIGINT) AS total FROM s")
def win_cumulative(spark, sf):
    s = base(spark, sf).groupBy(F.col("src_z").alias("z")).agg(F.count_if(~F.col("rejected")).alias("n"))
    return s.select("z", F.sum("n").over(Window.orderBy("z").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


@query("win_spiral", f"WITH {TILES}, c AS (SELECT *, greatest(abs(row - 2), abs(col - 4)) AS ring, atan2(row - 2, col - 4) AS angle FROM tiles WHERE z = 0) SELECT tile, row_number() OVER (ORDER BY ring, angle, tile) AS k FROM c")
def win_spiral(spark, sf):
    t = tiles(spark, sf).where("z = 0")
    ring = F.greatest(F.abs(F.col("row") - 2), F.abs(F.col("col") - 4))
    return t.select("tile", F.row_number().over(Window.orderBy(ring, F.atan2((F.col("row") - 2).cast("double"), (F.col("col") - 4).cast("double")), "tile")).cast("long").alias("k"))


@query("srt_argmax", f"{BASE} SELECT src_z, dst_z, corr_id, r_max FROM (SELECT *, row_number() OVER (PARTITION BY src_z, dst_z ORDER BY r_max DESC, pre_j, pre_i, corr_id) AS k FROM base) WHERE k = 1")
def srt_argmax(spark, sf):
    best = F.min(F.struct((-F.col("r_max")).alias("r"), "pre_j", "pre_i", "corr_id")).alias("s")
    return correspondences(spark, sf).groupBy("src_z", "dst_z").agg(best).select("src_z", "dst_z", "s.corr_id", (-F.col("s.r")).alias("r_max"))


@query("set_algebra", f"{BASE}, z AS ({SECTIONS}) SELECT z, z IN (3, 4, 99) AS fixed, z NOT BETWEEN 2 AND 7 AS outside FROM z")
def set_algebra(spark, sf):
    z = sections(spark, sf)
    listed = spark.createDataFrame([(3,), (4,), (99,)], "z int")
    fixed = z.intersect(listed).withColumn("fixed", F.lit(True))
    outside = z.join(spark.range(2, 8).select(F.col("id").cast("int").alias("z")), "z", "left_anti").withColumn("outside", F.lit(True))
    return z.join(fixed, "z", "left").join(outside, "z", "left").fillna(False)


@query("set_unwritten", f"WITH {TILES} SELECT tile FROM tiles WHERE row < 3 AND tile % 4 <> 0")
def set_unwritten(spark, sf):
    t = tiles(spark, sf)
    written = t.where("tile % 4 = 0").select("tile")
    return t.where("row < 3").join(written, "tile", "left_anti").select("tile")


# Review and names


@query("rev_set", f"{COUNTS} SELECT bool_or(n < 100 OR n_rej / greatest(n, 1) > 0.35 OR edge > 0.8) AS flagged, count(*) FILTER (n_rej / greatest(n, 1) > 0.35) AS n_ratio FROM counts")
def rev_set(spark, sf):
    return st.review(st.match_counts(base(spark, sf))).agg(F.bool_or("flagged").alias("flagged"), F.count_if(F.array_contains("flags", "rejected_ratio")).alias("n_ratio"))


@query("rev_unflag", f"{COUNTS} SELECT src_z, dst_z, CASE WHEN n < 100 THEN 'too_few' ELSE '' END AS flags FROM counts")
def rev_unflag(spark, sf):
    out = st.review(st.match_counts(base(spark, sf)))
    return out.select("src_z", "dst_z", F.array_join(F.array_except("flags", F.array(F.lit("rejected_ratio"), F.lit("edge_proximity"))), ",").alias("flags"))


@query("rev_reconcile", f"{BASE} SELECT corr_id, (rejected OR corr_id % 11 = 0) AS rejected FROM base")
def rev_reconcile(spark, sf):
    b = base(spark, sf)
    shown = b.where("corr_id % 11 <> 0").select("corr_id")
    gone = b.join(shown, "corr_id", "left_anti").select("corr_id", F.lit(True).alias("gone"))
    return b.join(gone, "corr_id", "left").select("corr_id", (F.col("rejected") | F.coalesce("gone", F.lit(False))).alias("rejected"))


@query("str_names", f"WITH {SUB} SELECT idx, '(' || CAST(idx AS VARCHAR) || ', ' || CAST(idx + 1 AS VARCHAR) || ')' AS name, CAST(floor(idx) AS INT) AS z, CAST(round((idx - floor(idx)) * 1000) AS INT) AS sub, 1 / 2.0 ** CAST(floor(idx) % 4 AS INT) AS scale FROM s")
def str_names(spark, sf):
    i = F.col("idx")
    return subsections(spark, sf).select("idx", names.match_name(i, (i + 1).cast("decimal(12,3)")).alias("name"), names.z_of(i).alias("z"), names.sub_of(i).alias("sub"), names.scale_of(names.z_of(i) % 4).alias("scale"))


#: A region with a slot, as shares of the extent of a section's tiles.
REGION = [(0.1, 0.1), (0.9, 0.1), (0.9, 0.4), (0.3, 0.4), (0.3, 0.6), (0.9, 0.6), (0.9, 0.9), (0.1, 0.9)]
TURNED = lambda i, j: (f"(1.0::DOUBLE * {i} - 0.1::DOUBLE * {j})", f"(0.1::DOUBLE * {i} + 1.0::DOUBLE * {j})")
CORNERS = [("i", "j"), ("i", "(j + w)"), ("(i + h)", "(j + w)"), ("(i + h)", "j")]


@query("jon_roi", f"""WITH {TILES}, c AS (SELECT z, tile, unnest([{", ".join(f"struct_pack(k := {k}, x := {TURNED(i, j)[0]}, y := {TURNED(i, j)[1]})" for k, (i, j) in enumerate(CORNERS))}]) AS p FROM tiles),
q AS (SELECT z, unnest([{", ".join(f"struct_pack(k := {k}, x := {a}::DOUBLE * max(i + h), y := {b}::DOUBLE * max(j + w))" for k, (a, b) in enumerate(REGION))}]) AS p FROM tiles GROUP BY z),
a AS (SELECT s.z, s.tile, s.p.x AS x0, s.p.y AS y0, t.p.x AS x1, t.p.y AS y1, s.p.k AS k FROM c s JOIN c t ON s.tile = t.tile AND t.p.k = (s.p.k + 1) % 4),
b AS (SELECT s.z, s.p.x AS x0, s.p.y AS y0, t.p.x AS x1, t.p.y AS y1, s.p.k AS k FROM q s JOIN q t ON s.z = t.z AND t.p.k = (s.p.k + 1) % {len(REGION)}),
hit AS (SELECT DISTINCT a.tile FROM a JOIN b ON a.z = b.z WHERE greatest(least(a.x0, a.x1), least(b.x0, b.x1)) <= least(greatest(a.x0, a.x1), greatest(b.x0, b.x1)) AND greatest(least(a.y0, a.y1), least(b.y0, b.y1)) <= least(greatest(a.y0, a.y1), greatest(b.y0, b.y1))
AND ((a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0)) * ((a.x1 - a.x0) * (b.y1 - a.y0) - (a.y1 - a.y0) * (b.x1 - a.x0)) <= 0
AND ((b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0)) * ((b.x1 - b.x0) * (a.y1 - b.y0) - (b.y1 - b.y0) * (a.x1 - b.x0)) <= 0),
tin AS (SELECT s.tile FROM a s JOIN b ON s.z = b.z AND s.k = 0 AND (b.y0 > s.y0) <> (b.y1 > s.y0) AND s.x0 < (b.x1 - b.x0) * (s.y0 - b.y0) / (b.y1 - b.y0) + b.x0 GROUP BY s.tile HAVING count(*) % 2 = 1),
rin AS (SELECT a.tile FROM a JOIN b s ON s.z = a.z AND s.k = 0 AND (a.y0 > s.y0) <> (a.y1 > s.y0) AND s.x0 < (a.x1 - a.x0) * (s.y0 - a.y0) / (a.y1 - a.y0) + a.x0 GROUP BY a.tile HAVING count(*) % 2 = 1)
SELECT z, tile, m AS meets, m AND tile % 4 <> 0 AS include FROM (SELECT *, tile IN (SELECT tile FROM hit UNION SELECT tile FROM tin UNION SELECT tile FROM rin) AS m FROM tiles)""")
def jon_roi(spark, sf):
    """Turned tiles that meet their section's region, and those of them to include, since not flagged as bad."""
    t = tiles(spark, sf)
    d = lambda c: F.col(c).cast("double")
    corner = lambda i, j: F.struct((1.0 * i - 0.1 * j).alias("x"), (0.1 * i + 1.0 * j).alias("y"))
    top, left, bottom, right = d("i"), d("j"), d("i") + d("h"), d("j") + d("w")
    outlined = t.select("z", "tile", F.array(corner(top, left), corner(top, right), corner(bottom, right), corner(bottom, left)).alias("outline"))
    far = t.groupBy("z").agg(F.max(F.col("i") + F.col("h")).alias("x"), F.max(F.col("j") + F.col("w")).alias("y"))
    regions = far.select("z", F.lit(0).alias("roi"), F.array(*(F.struct((a * F.col("x")).alias("x"), (b * F.col("y")).alias("y")) for a, b in REGION)).alias("outline"))
    met = jon.outlines_meet(outlined, regions, "z", "tile", "roi", 1000.0).select("tile", F.lit(True).alias("met"))
    meets = F.coalesce("met", F.lit(False))
    return t.join(met, "tile", "left").select("z", "tile", meets.alias("meets"), (meets & (F.col("tile") % 4 != 0)).alias("include"))
