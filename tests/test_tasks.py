"""Whole tasks on chunks: replays, sub-sections, filters and translations against plain array code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminara.operators import blockmatch as bm
from laminara.operators import chunks as ch
from laminara.operators import matching as mt
from laminara.operators import render as rn
from laminara.plans import q_tasks
from laminara.sources import storage
from laminara.streaming import tasks as tk


def as_chunks(spark, planes, size):
    """Chunks of {z: array}; the array need not be a multiple of the size."""
    rows = []
    for z, a in planes.items():
        h, w = (-(-n // size) * size for n in a.shape)
        whole = np.zeros((h, w), np.uint8)
        whole[: a.shape[0], : a.shape[1]] = a
        rows += [(z, 0, i, j, size, size, bytearray(whole[i * size : (i + 1) * size, j * size : (j + 1) * size].tobytes())) for i in range(h // size) for j in range(w // size)]
    return spark.createDataFrame(rows, storage.CHUNK)


def test_boxes_cross_chunks_and_reach_beyond(spark):
    a = np.arange(1, 21 * 17 + 1, dtype=np.uint64).astype(np.uint8).reshape(21, 17)
    boxes = [(1, 0, -3, 9, 5, 30), (2, 0, 8, 9, 8, 9), (3, 0, 40, 44, 1, 2), (4, 5, 1, 2, 1, 2)]
    df = spark.createDataFrame(boxes, "id int, z int, i0 int, i1 int, j0 int, j1 int")
    got = ch.pieces(df, as_chunks(spark, {0: a}, 8), 8).toPandas()
    wide = np.zeros((100, 100), np.uint8)
    wide[20:41, 20:37] = a
    for id_, z, i0, i1, j0, j1 in boxes[:3]:
        assert (ch.assembled(got[got.id == id_], i0, i1, j0, j1) == wide[19 + i0 : 20 + i1, 19 + j0 : 20 + j1]).all()
    assert not (got.id == 4).any() and all(len(s[0]) <= 8 for s in got.strips)


def test_levels_and_filters(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (13, 18)).astype(np.uint8)
    chunks = as_chunks(spark, {3: a}, 8)
    half = np.zeros((16, 32))
    half[:13, :18] = a
    want = np.rint(half.reshape(8, 2, 16, 2).mean((1, 3)))
    got = {(r.ci, r.cj): np.frombuffer(r.data, np.uint8).reshape(8, 8) for r in ch.halved(chunks, 8).collect()}
    assert all((got[0, j] == want[:, 8 * j : 8 * j + 8]).all() for j in (0, 1)) and len(got) == 2
    sigmas = (0.5, 1.2)
    r = bm.reach(1.2)
    full = bm.bandpassed(np.pad(a.astype(float), r, constant_values=a.mean()), sigmas)
    for row in ch.filtered(chunks, 8, 13, 18, r, lambda img: bm.bandpassed(img, sigmas)).collect():
        part = full[row.ci * 8 : row.ci * 8 + 8, row.cj * 8 : row.cj * 8 + 8]
        assert np.allclose(np.frombuffer(row.data).reshape(8, 8)[: part.shape[0], : part.shape[1]], part)
    with pytest.raises(ValueError):
        bm.gauss_pair(-1, 2)


def test_render_joins_sub_sections_and_removes_defects(spark):
    a = np.full((8, 8), 100, np.uint8)
    split = np.repeat([[1, 1, 1, 0, 2, 2, 2, 2]], 8, 0).astype(np.uint8)
    roi, defect = np.ones((8, 8), np.uint8), np.ones((8, 8), np.uint8)
    roi[0], defect[:, 1] = 0, 0
    layers = {k: as_chunks(spark, {0: v}, 4) for k, v in (("image", a), ("split", split), ("roi", roi), ("defect", defect))}
    tri = [(0, s, t, *(x for p in pts for x in (*map(float, p), float(p[0]), float(p[1] + d)))) for s, d in ((1, 2), (2, -2)) for t, pts in (("a", ((0, 0), (0, 9), (9, 0))), ("b", ((9, 9), (0, 9), (9, 0))))]
    df = spark.createDataFrame(tri, "z int, sub int, triangle string, " + ", ".join(f"{c} double" for c in rn.CORNERS))
    out = np.zeros((8, 8), int)
    for r in rn.render(df, layers, 4, (1, 8, 1, 8)).collect():
        out[r.ci * 4 : r.ci * 4 + 4, r.cj * 4 : r.cj * 4 + 4] = np.frombuffer(r.data, np.uint8).reshape(4, 4)
    want = np.zeros((8, 8), int)
    want[1:, [2, 4]] = 100  # the first, without its second column, moved right by two
    want[1:, [2, 3, 4, 5]] = np.maximum(want[1:, [2, 3, 4, 5]], 100)  # the second, moved left by two
    assert (out == want).all()


def rows_of(spark, path, schema):
    """All rows, with columns in the schema's order, bytes too."""
    names = [c.split()[0] for c in schema.split(", ")]
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in spark.read.schema(schema).parquet(path).select(*names).collect()), key=repr)


def test_render_task_replayed_gives_the_same_volume(spark, sf, tmp_path):
    folder = str(tmp_path)
    q_tasks.rendered(spark, sf, folder)
    first = rows_of(spark, f"{folder}/out", storage.CHUNK)
    zs = {r[0] for r in first}
    assert {100, 103, 106, 109} <= zs and not zs & {0, 3, 6, 9} and {r[1] for r in first} == {0, 1, 2}
    # The same messages once more, from a stream that remembers nothing.
    layers = {k: storage.read_volume(spark, f"{folder}/{k}", mip=0) for k in ("image", "roi", "split")}
    height, width = q_tasks.mosaic_extent(spark, sf)
    triangles, _ = q_tasks.meshes(spark, sf, layers["image"].select("z").distinct())
    tri = rn.placed_triangles(triangles, spark.read.parquet(f"{folder}/meshes"))
    z_map = spark.createDataFrame([(z, z + 100) for z in (0, 3, 6, 9)], "old_z int, new_z int")
    handler = tk.render_task(layers, tri, f"{folder}/out", q_tasks.SIZE, (1, height, 1, width), 2, z_map)
    handler(tk.drain(spark, f"{folder}/queue").where("src_z in (3, 4)"))
    assert rows_of(spark, f"{folder}/out", storage.CHUNK) == first


def test_match_task_replayed_gives_the_same_rows(spark, sf, tmp_path):
    folder = str(tmp_path)
    q_tasks.matched(spark, sf, folder)
    first = rows_of(spark, f"{folder}/matches", mt.FOUND)
    layers = {k: storage.read_volume(spark, f"{folder}/{k}", mip=0) for k in ("image", "roi")}
    handler = tk.match_task(layers, q_tasks.tile_nodes(spark, sf), f"{folder}/matches", q_tasks.SIZE, q_tasks.mosaic_extent(spark, sf), q_tasks.BLOCK_R, q_tasks.SEARCH_R)
    handler(tk.drain(spark, f"{folder}/queue").where("src_z < 3"))
    assert rows_of(spark, f"{folder}/matches", mt.FOUND) == first and len(first) > 100


def test_matches_find_known_shifts_by_component(spark):
    """Two halves of a plane that moved apart are matched component by component, with and without a band-pass."""
    rng = np.random.default_rng(1)
    a = rng.integers(1, 256, (60, 80)).astype(np.uint8)
    b = np.zeros_like(a)
    b[:, :40], b[:, 40:] = np.roll(a[:, :40], (2, -1), (0, 1)), np.roll(a[:, 40:], (-3, 2), (0, 1))
    split = np.repeat([[1] * 40 + [2] * 40], 60, 0).astype(np.uint8)
    image, parts = as_chunks(spark, {0: a, 1: b}, 16), as_chunks(spark, {0: split, 1: split}, 16)
    nodes = spark.createDataFrame([(1, 30.0, 20.0), (2, 30.0, 60.0), (3, 200.0, 1.0), (4, 30.0, 41.0)], "node int, src_i double, src_j double")
    pairs = spark.createDataFrame([(0, 1), (0, 1), (1, 7)], "src_z int, dst_z int")
    for band in ((0, 0), (0.6, 3)):
        got = {(r.node, r.src_sub, r.dst_sub): (round(r.dv_i), round(r.dv_j)) for r in mt.match_pairs(pairs, nodes, {"image": image, "split": parts}, 16, 60, 80, 8, 6, band).where("r_max > 0.8").collect()}
        assert got[1, 1, 1] == (2, -1) and got[2, 2, 2] == (-3, 2)
        assert all(k[1] == k[2] for k in got) and not any(k[0] == 3 for k in got)
    plain = {r.node: (round(r.dv_i), round(r.dv_j)) for r in mt.match_pairs(pairs, nodes, {"image": image}, 16, 60, 80, 8, 6).collect()}
    assert plain[1] == (2, -1) and plain[2] == (-3, 2)


def test_translation_over_partial_overlap(spark):
    rng = np.random.default_rng(2)
    whole = rng.integers(0, 256, (40, 40)).astype(np.uint8)
    cut = lambda i, j: np.ascontiguousarray(whole[i : i + 24, j : j + 24])
    a, b = cut(0, 3), cut(10, 0)  # b's pixel (i, j) is a's (i + 10, j - 3)
    want = np.full((47, 47), np.nan)
    for di in range(-23, 24):
        for dj in range(-23, 24):
            x, y = a[max(0, -di) : 24 - max(0, di), max(0, -dj) : 24 - max(0, dj)], b[max(0, di) : 24 + min(0, di), max(0, dj) : 24 + min(0, dj)]
            if x.size >= 30:
                want[di + 23, dj + 23] = np.corrcoef(x.ravel(), y.ravel())[0, 1]
    assert np.allclose(mt.overlap_correlation(a, b, 30), want, equal_nan=True)
    flat = np.full((24, 24), 7, np.uint8)
    rows = [(k, bytearray(x.tobytes()), bytearray(y.tobytes()), 24, 24, 24, 24) for k, (x, y) in enumerate(((a, b), (b, a), (flat, a)))]
    df = spark.createDataFrame(rows, "id int, src binary, dst binary, src_h int, src_w int, dst_h int, dst_w int").withColumn("more", F.lit("x"))
    for args in ({}, {"highpass": 3.0}):
        got = {r.id: (r.di, r.dj) for r in mt.translations(df, 60, **args).collect()}
        assert got == {0: (-10, 3), 1: (10, -3)}
    coarse = {r.id: (r.di, r.dj) for r in mt.translations(df, 30, scale=2).collect()}
    assert abs(coarse[0][0] + 10) <= 1 and abs(coarse[0][1] - 3) <= 1


def test_patches_of_one_correspondence_read_their_chunks_only(spark, sf, tmp_path):
    folder = str(tmp_path)
    q_tasks.matched(spark, sf, folder)
    r = spark.read.schema(mt.FOUND).parquet(f"{folder}/matches").orderBy(F.desc("node"), "src_z").first()
    look = lambda node: mt.correspondence_patches(spark, f"{folder}/matches", f"{folder}/image", f"{folder}/roi", r.src_z, r.dst_z, node, q_tasks.SIZE, q_tasks.mosaic_extent(spark, sf), q_tasks.BLOCK_R, q_tasks.SEARCH_R)
    df = look(r.node)
    got = df.toPandas()
    assert abs(got[got.layer == "xc"].v.max() - r.r_max) < 1e-9 and len(got[got.layer == "dst"]) == q_tasks.FULL**2
    scans = df._jdf.queryExecution().sparkPlan().toString()
    assert scans.count("PartitionFilters: [") == 4 and scans.count("(z#") >= 4
    assert scans.count("GreaterThanOrEqual(ci,") == 4 and scans.count("LessThanOrEqual(ci,") == 4
    assert look(10**6).isEmpty()
