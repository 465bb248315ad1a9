"""Forests, places, overviews and preprocessing against plain code on small cases."""

import numpy as np
import pytest

from laminara.operators import chunks as ch
from laminara.operators import montage as mo
from tests.test_tasks import as_chunks

EDGE = "z long, a long, b long, r double, di double, dj double"


def kruskal(edges):
    """The forest and the places seen from the smallest node of each tree."""
    up, tree, near = {}, set(), {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for z, a, b, _, di, dj in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if root((z, a)) != root((z, b)):
            up[root((z, a))] = root((z, b))
            tree.add((z, a, b))
            near.setdefault((z, a), []).append((b, di, dj))
            near.setdefault((z, b), []).append((a, -di, -dj))
    place = {}
    for z, n in sorted(up):
        if (z, n) not in place:
            place[z, n], todo = (n, 0.0, 0.0), [n]
            while todo:
                x = todo.pop()
                _, i, j = place[z, x]
                for y, di, dj in near.get((z, x), []):
                    if (z, y) not in place:
                        place[z, y] = (n, i + di, j + dj)
                        todo.append(y)
    return tree, place


def test_forest_and_places_as_by_plain_code(spark):
    rng = np.random.default_rng(3)
    edges = []
    for z in (1, 2):
        pairs = sorted({tuple(sorted(map(int, rng.choice(24, 2, replace=False)))) for _ in range(60)})
        edges += [(z, a, b, float(rng.integers(0, 4)), float(rng.integers(-9, 9)), float(rng.integers(-9, 9))) for a, b in pairs]
    # A chain whose weights rise, so that all but one hook in a row; and a section of its own.
    edges += [(3, k, k + 1, k / 40, 1.0, -2.0) for k in range(40)] + [(4, 5, 9, 0.5, 2.0, 3.0)]
    turned = [(z, b, a, r, -di, -dj) if k % 2 else (z, a, b, r, di, dj) for k, (z, a, b, r, di, dj) in enumerate(edges)]
    odd = [(1, 3, 3, 9.0, 1.0, 1.0), (1, 0, 99, None, 0.0, 0.0), (2, 0, 98, float("nan"), 0.0, 0.0), (None, 1, 2, 5.0, 0.0, 0.0)]
    forest, places = mo.spanning_forest(spark.createDataFrame(turned + turned[:7] + odd, EDGE))
    tree, place = kruskal(edges)
    got = forest.df.collect()
    assert {(r.z, r.a, r.b) for r in got} == tree and len(got) == len(tree)
    assert {(r.z, r.node): (r.root, r.i, r.j) for r in places.df.collect()} == place
    forest.drop()
    places.drop()


def test_forest_of_nothing(spark):
    forest, places = mo.spanning_forest(spark.createDataFrame([], EDGE))
    assert forest.df.isEmpty() and places.df.isEmpty()


def test_tiles_found_in_a_half_size_overview(spark):
    """Three levels below the tile's own resolution and over several chunks; constant and null tiles give no row."""
    rng = np.random.default_rng(1)
    fine = np.kron(rng.integers(0, 256, (24, 40)), np.ones((8, 8))).astype(np.uint8)
    over = mo.shrunk(fine, 1)  # 96 by 160
    layers = as_chunks(spark, {4: over}, 32)
    volume = layers.unionByName(ch.halved(layers, 32)).unionByName(ch.halved(ch.halved(layers, 32), 32))
    at = [(0, 0), (16, 64), (64, 208), (128, 256), (48, 30)]
    rows = [(4, k, bytearray(fine[i : i + 64, j : j + 64].tobytes())) for k, (i, j) in enumerate(at)]
    rows += [(4, 90, bytearray(bytes(64 * 64))), (4, 91, None), (5, 92, rows[0][2])]
    got = mo.place_in_overview(spark.createDataFrame(rows, "z int, tile long, img binary"), volume, 32, over.shape, (64, 64), 2, shrink=1).collect()
    assert sorted((r.tile, r.i, r.j) for r in got) == [(k, i // 2 + 1, j // 2 + 1) for k, (i, j) in enumerate(at)]
    assert all(r.r > 0.999 for r in got)
    with pytest.raises(ValueError):
        mo.place_in_overview(layers, volume, 32, over.shape, (8, 8), 3)


def test_offsets_by_product_and_by_transform_agree(monkeypatch):
    rng = np.random.default_rng(2)
    window = np.kron(rng.integers(0, 4, (9, 12)), np.ones((2, 2))).astype(np.uint8)
    window[:8, :8] = 5  # nothing varies here
    window[10:14, 2:8] = window[10:14, 14:20]  # a tie
    templates = np.stack([window[10:14, 2:8], window[4:8, 9:15], np.full((4, 6), 7, np.uint8), rng.integers(0, 255, (4, 6)).astype(np.uint8)])
    got = mo.best_offsets(templates, window, 5, 99, 99)
    monkeypatch.setattr(mo, "HELD", 1)
    assert mo.best_offsets(templates, window, 5, 99, 99) == got
    monkeypatch.setattr(mo, "SMALL", 0)
    assert [[x[:2] for x in g] for g in mo.best_offsets(templates, window, 5, 99, 99)] == [[x[:2] for x in g] for g in got]
    for k, t in enumerate(templates):
        r = sorted((-round(float(np.corrcoef(t.ravel(), x.ravel())[0, 1]), 9) if x.var() > 1e-4 else 0.0, j, i) for i in range(15) for j in range(19) for x in [window[i : i + 4, j : j + 6]]) if t.std() else []
        assert [(j, i) for i, j, _ in got[k]] == [(j, i) for _, j, i in r[:5]]
    assert got[0][:2] == [(10, 2, 1.0), (10, 14, 1.0)] and mo.best_offsets(templates, window[:3], 5, 9, 9) == [[]] * 4


def test_preprocessing_in_one_pass(spark):
    a = np.arange(11 * 13, dtype=np.uint8).reshape(11, 13)
    chunks = as_chunks(spark, {0: a, 1: a, 2: a}, 8)
    ends = spark.createDataFrame([(0, 20.0, 120.0), (1, 50.0, 50.0)], "z int, lo double, hi double")
    shape = [(1.5, 1.5), (12.5, 2.5), (6.5, 5.5), (11.5, 20.0)]
    outlines = spark.createDataFrame([(0, shape), (1, shape), (2, shape[:2])], "z int, outline array<struct<x: double, y: double>>")
    order = spark.createDataFrame([(5, 0), (6, 0), (7, 1), (7, 2), (8, 2), (9, None), (10, 77)], "dst_z int, src_z int")
    got = {}
    df = ch.preprocessed(chunks, 8, (11, 13), ends, outlines, order)
    for r in df.collect():
        got.setdefault(r.z, np.zeros((16, 16), np.uint8))[r.ci * 8 : r.ci * 8 + 8, r.cj * 8 : r.cj * 8 + 8] = np.frombuffer(r.data, np.uint8).reshape(8, 8)

    def kept(i, j):
        odd = False
        for (px, py), (qx, qy) in zip(shape, shape[1:] + shape[:1], strict=True):
            odd ^= (py > i) != (qy > i) and j < (qx - px) * (i - py) / (qy - py) + px
        return odd

    mask = np.array([[kept(i, j) for j in range(1, 14)] for i in range(1, 12)])
    stretched = np.floor(255 * np.clip((a - 20.0) / 100, 1 / 255, 1)).astype(np.uint8)
    assert sorted(got) == [5, 6, 7, 8] and mask.any() and not mask.all()
    for z, want in ((5, stretched), (6, stretched), (7, a)):
        assert (got[z][:11, :13] == np.where(mask, want, 0)).all() and not got[z][11:].any() and not got[z][:, 13:].any()
    assert not got[8].any()
