import math

"""Invariants and golden values of single operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from laminara.functions.names import parse_pairs
from laminara.functions.registry import compare, feature
from laminara.operators import blockmatch as bm
from laminara.operators import filters as flt
from laminara.operators import joins as jon
from laminara.operators import mesh as ms
from laminara.operators import raster as ra
from laminara.operators import solve as so
from laminara.streaming import tasks as tk

PX = "z int, i int, j int, px int"


def image(spark, a):
    return spark.createDataFrame([(0, i + 1, j + 1, int(v)) for i, row in enumerate(a) for j, v in enumerate(row)], PX)


def array(df):
    rows = df.collect()
    out = np.zeros((max(r.i for r in rows), max(r.j for r in rows)), int)
    for r in rows:
        out[r.i - 1, r.j - 1] = r.px
    return out


@pytest.mark.parametrize(("sides", "shape"), [((0, 0, 0, 0), (5, 2)), ((1, 2, 3, 4), (11, 6)), ((0, 1, 1, 0), (6, 3))])
def test_pad_sizes(spark, sides, shape):
    out = array(ra.pad(image(spark, np.ones((5, 2))), 5, 2, *sides))
    assert out.shape == shape and out.sum() == 10


def test_rescope_golden(spark):
    one = image(spark, [[1]])
    assert (array(ra.rescope(one, 0, 0, 2, 2)) == [[0, 0], [0, 1]]).all()
    assert array(ra.rescope(one, -1, -1, 4, 4))[2, 2] == 1
    r = np.random.default_rng(0).integers(1, 255, (5, 5))
    img = image(spark, r)
    assert (array(ra.rescope(img, 2, 2, 3, 3)) == r[1:4, 1:4]).all()
    assert not array(ra.rescope(img, 10, 10, 3, 3)).any()


def test_overlay_golden(spark):
    a = np.arange(25).reshape(5, 5) + 1
    out = array(ra.overlay(image(spark, a), image(spark, a), 2, 3))
    assert out.shape == (7, 8) and (out[:5, :5] // 256 == a).all() and (out[2:, 3:] % 256 == a).all()


def test_components(spark):
    px = spark.createDataFrame([(0, 0, i, j) for i, j in [(1, 1), (1, 2), (2, 3), (5, 5), (5, 6), (7, 7)]], "z int, tile int, i int, j int")
    assert ra.components(px).select("label").distinct().count() == 3
    assert ra.components(px, diagonal=False).select("label").distinct().count() == 4
    snake = [(0, 0, i, j) for i in range(1, 8) for j in range(1, 8) if i % 2 or j == (7 if i % 4 else 1)]
    assert ra.components(spark.createDataFrame(snake, "z int, tile int, i int, j int"), diagonal=False).select("label").distinct().count() == 1


@pytest.mark.parametrize(("dims", "count", "edges"), [((3, 3), 8, 15), ((4, 4), 14, 30), ((5, 4), 18, 41), ((6, 5), 27, 65)])
def test_lattice_counts(spark, dims, count, edges):
    m = ms.Lattice((dims[0] - 3) * 10 * ms.SIN60 + 1, (dims[1] - 3) * 10 + 1, 10.0)
    assert m.dims == dims and m.count == count
    nodes = ms.nodes(spark, m)
    assert sorted(r.node for r in nodes.collect()) == list(range(1, count + 1))
    assert ms.edges(spark, m).distinct().count() == edges
    back = nodes.select("i", "j", *(c.alias(n) for c, n in zip(ms.node_place(m, F.col("node")), ("bi", "bj"), strict=True)))
    assert back.where("i <> bi or j <> bj").isEmpty()


@settings(max_examples=5, deadline=None)
@given(hs.floats(50, 300), hs.floats(50, 300), hs.floats(15, 60), hs.integers(0, 9))
def test_weights_sum_to_one(spark, h, w, length, seed):
    m = ms.Lattice(h, w, length)
    rng = np.random.default_rng(seed)
    pts = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(0, h, 40), rng.uniform(0, w, 40), strict=True))], "id int, x double, y double")
    out = ms.located(pts, m, "x", "y").collect()
    assert len(out) == 40
    assert all(abs(r.w0 + r.wa + r.wb - 1) < 1e-9 and min(r.w0, r.wa, r.wb) > -1e-9 for r in out)
    same = ms.deform(pts, m, ms.nodes(spark, m).select("node", F.col("src_i").alias("dst_i"), F.col("src_j").alias("dst_j")), "id", "x", "y").join(pts, "id").collect()
    assert all(abs(r.dst_i - r.x) < 1e-6 and abs(r.dst_j - r.y) < 1e-6 for r in same)


def test_point_outside_has_no_triangle(spark):
    m = ms.Lattice(100, 100, 20)
    pts = spark.createDataFrame([(1, -500.0, 0.0), (2, 50.0, 50.0), (3, None, 1.0)], "id int, x double, y double")
    assert [r.id for r in ms.located(pts, m, "x", "y").collect()] == [2]


def test_ncc_of_a_patch_with_itself():
    rng = np.random.default_rng(1)
    img = rng.uniform(1, 255, (40, 50))
    xc = bm.ncc(img[10:21, 15:26], img)
    assert xc.shape == (30, 40) and abs(xc[10, 15] - 1) < 1e-9 and np.argmax(xc) == np.ravel_multi_index((10, 15), xc.shape)
    t = img[3:8, 4:9]
    direct = np.array([[np.corrcoef(t.ravel(), img[i : i + 5, j : j + 5].ravel())[0, 1] for j in range(46)] for i in range(36)])
    assert np.allclose(bm.ncc(t, img), direct)
    assert np.isnan(bm.ncc(np.ones((3, 3)), img)).all()
    assert (bm.ncc(t, np.ones((9, 9))) == 0).all()


def test_convolution_crops():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(7, 9)), rng.normal(size=(3, 3))
    full = np.zeros((9, 11))
    for i in range(3):
        for j in range(3):
            full[i : i + 7, j : j + 9] += b[i, j] * a
    assert np.allclose(bm.convolve(a, b, "full"), full)
    assert np.allclose(bm.convolve(a, b, "same"), full[1:8, 1:10])
    assert np.allclose(bm.convolve(a, b), full[2:7, 2:9])
    assert np.allclose(bm.box_sums(a, 2, 3)[1, 2], a[1:3, 2:5].sum())


def test_match_finds_the_shift():
    rng = np.random.default_rng(3)
    dst = rng.integers(1, 255, (61, 61)).astype(np.uint8)
    got = bm.match_patches(dst[20:41, 25:46], dst)
    assert round(got["peak_i"]) == 21 and round(got["peak_j"]) == 26 and abs(got["r_max"] - 1) < 1e-9 and got["delta_5"] > 0.3
    assert bm.match_patches(np.zeros((5, 5), np.uint8), dst) is None


def test_spread_of_a_gaussian():
    ii, jj = np.mgrid[-10:11, -10:11]
    assert abs(bm.spread(np.exp(-(ii**2 + jj**2) / 8.0), 0.0) ** 2 - 8) < 0.05
    assert bm.spread(np.zeros((3, 3)), 0.5) == float("inf")


def test_relaxation_lowers_energy_and_holds_fixed_nodes():
    rng = np.random.default_rng(4)
    n = 30
    x0 = np.stack([np.arange(n) * 1.0, rng.normal(size=n)], 1)
    a, b = np.arange(n - 1), np.arange(1, n)
    rows, cols, vals = np.concatenate([a, b]), np.concatenate([np.arange(n - 1)] * 2), np.concatenate([-np.ones(n - 1), np.ones(n - 1)])
    fixed = np.zeros(n, bool)
    fixed[0] = True
    x, _ = so.relax(x0, fixed, rows, cols, vals, np.ones(n - 1), np.ones(n - 1), 2000, 1e-12)
    length = np.hypot(*(x[1:] - x[:-1]).T)
    assert (x[0] == x0[0]).all() and np.abs(length - 1).max() < 1e-3


def test_gradient_is_the_slope_of_the_energy(spark):
    springs = spark.createDataFrame([(1, 2.0, 1.0), (2, 3.0, 0.5)], "spring int, k double, rest double")
    ends = spark.createDataFrame([(1, 1, -1.0), (1, 2, 1.0), (2, 2, -1.0), (2, 3, 1.0)], "spring int, node int, val double")

    def e(d):
        place = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.5 + d, 0.7), (3, 2.0, 2.0)], "node int, i double, j double")
        v = so.spring_vectors(springs, ends, place)
        return so.energy(v).first().energy, so.gradient(v, ends).where("node = 2").first().g_i

    (up, _), (down, _), (_, g) = e(1e-5), e(-1e-5), e(0.0)
    assert abs((up - down) / 2e-5 - g) < 1e-4


def test_spanning_tree_has_the_greatest_weight(spark):
    rng = np.random.default_rng(5)
    edges = [(1, a, b, float(rng.uniform())) for a in range(8) for b in range(a + 1, 8)]
    tree = jon.spanning_tree(spark.createDataFrame(edges, "z int, a int, b int, r double")).collect()
    parent = list(range(8))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    best = 0.0
    for _, a, b, r in sorted(edges, key=lambda e: -e[3]):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            best += r
    assert len(tree) == 7 and abs(sum(t.r for t in tree) - best) < 1e-9


def test_rules_guard_nan_and_unknown_names(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "x double")
    assert [r.v for r in df.select(compare(F.col("x"), ">", 1.0).alias("v")).collect()] == [False, True, None]
    with pytest.raises(KeyError):
        feature("__import__('os')")
    assert flt.find_key({"a": {"b": {"c": 5}}, "d": 1}, "c") == 5 and flt.find_key({"a": 1}, "x") is None


def test_pair_texts(spark):
    df = spark.createDataFrame([("117,118",), ("((0, 1),)",), ("[(376,379),(503,506)]",), ("none",), (None,)], "t string")
    got = [r.p for r in df.select(parse_pairs(F.col("t")).alias("p")).collect()]
    assert [[tuple(x) for x in p] if p else p for p in got] == [[(117, 118)], [(0, 1)], [(376, 379), (503, 506)], [], None]


def test_blocks():
    assert so.z_blocks(1, 100) == [(1, 22), (21, 42), (41, 62), (61, 82), (81, 100)]


def test_decompose_rotation(spark):
    a = np.deg2rad(30)
    t = spark.createDataFrame([(float(np.cos(a)), float(np.sin(a)), float(-np.sin(a)), float(np.cos(a)), 5.0, 6.0)], "t11 double, t12 double, t21 double, t22 double, t31 double, t32 double")
    d = so.decompose(t).first()
    assert abs(d.scale_i - 1) < 1e-9 and abs(d.scale_j - 1) < 1e-9 and abs(d.shear) < 1e-9 and abs(abs(d.rotation) - 30) < 1e-9


def test_queue_runs_each_message_once(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src_z int, dst_z int")
    tk.publish(tk.pair_tasks(pairs, "match", "{}"), str(tmp_path / "q"))
    seen, odd = [], []
    handlers = {"match": lambda df: seen.extend(r.task_id for r in df.collect()), "*": lambda df: odd.extend(df.collect())}
    for _ in range(2):
        tk.subscribe(spark, str(tmp_path / "q"), str(tmp_path / "s"), handlers).awaitTermination()
    assert sorted(seen) == ["match-1-2", "match-2-3", "match-3-4"] and not odd
    tk.publish(tk.pair_tasks(pairs.limit(1), "render", "{}"), str(tmp_path / "q"))
    tk.subscribe(spark, str(tmp_path / "q"), str(tmp_path / "s"), handlers).awaitTermination()
    assert len(seen) == 3 and len(odd) == 1 and tk.drain(spark, str(tmp_path / "q")).count() == 4


def test_outlines_meet_against_all_pairs(spark):
    """Concave polygons that cross, contain, touch or miss one another, for several sizes of cells."""
    import random

    from laminara.operators.joins import outlines_meet

    rng = random.Random(4)
    star = lambda x, y, r, n: [(x + r * (0.4 + 0.6 * rng.random()) * math.cos(2 * math.pi * k / n), y + r * (0.4 + 0.6 * rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    a = [(k % 3, k, star(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([1, 5, 40]), 7)) for k in range(60)]
    b = [(k % 3, k, star(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([2, 10, 60]), 9)) for k in range(25)]
    a += [(0, 100, [(200, 0), (201, 0), (201, 1), (200, 1)]), (0, 101, [(210.0, 0.0), (211.0, 0.0)]), (0, 102, None)]
    b += [(0, 100, [(201, 1), (203, 1), (203, 3)]), (0, 101, [(150, -50), (250, -50), (250, 50), (150, 50), (150, 49), (249, 49), (249, -49), (150, -49)])]
    a, b = ([(z, k, None if o is None else [(float(x), float(y)) for x, y in o]) for z, k, o in t] for t in (a, b))

    def sides(o):
        return list(zip(o, o[1:] + o[:1], strict=True))

    def inside(p, o):
        return sum((s[1] > p[1]) != (t[1] > p[1]) and p[0] < (t[0] - s[0]) * (p[1] - s[1]) / (t[1] - s[1]) + s[0] for s, t in sides(o)) % 2 == 1

    def cross(e, f):
        turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        boxes = all(max(min(e[0][c], e[1][c]), min(f[0][c], f[1][c])) <= min(max(e[0][c], e[1][c]), max(f[0][c], f[1][c])) for c in (0, 1))
        return boxes and turn(*e, f[0]) * turn(*e, f[1]) <= 0 and turn(*f, e[0]) * turn(*f, e[1]) <= 0

    want = {(z, i, k) for z, i, o in a for y, k, p in b if z == y and o and len(o) > 2 and (inside(o[0], p) or inside(p[0], o) or any(cross(e, f) for e in sides(o) for f in sides(p)))}
    df = lambda t, key: spark.createDataFrame(t, f"z int, {key} int, outline array<struct<x:double,y:double>>")
    for cell in (3.0, 50.0):
        got = {tuple(r) for r in outlines_meet(df(a, "tile"), df(b, "roi"), "z", "tile", "roi", cell).collect()}
        assert got == want and (0, 100, 100) in want and (0, 100, 101) not in want and len(want) > 50


def test_parameters_over_defaults(spark):
    from laminara.sources import storage

    texts = ['{"match": {"depth": 7, "new": 1}}', "{}", "no json", None, '{"match": {"depth": null}, "solve": {"lambda": 0.5}}']
    df = storage.with_params(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string"), "t")
    got = {r.id: (r.depth, r.block_r, r.lam, list(r.bandpass_sigmas)) for r in df.select("id", *(storage.param(k) for k in ("depth", "block_r", "bandpass_sigmas")), storage.param("lambda").alias("lam")).collect()}
    assert got == {0: (7, 128, 0.9, [0, 0]), 1: (2, 128, 0.9, [0, 0]), 2: (2, 128, 0.9, [0, 0]), 3: (2, 128, 0.9, [0, 0]), 4: (2, 128, 0.5, [0, 0])}
    with pytest.raises(KeyError):
        storage.param("unknown")
