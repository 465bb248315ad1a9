"""Work on crowded rows: joins make no more rows than the result or the input calls for."""

from __future__ import annotations

import random

import pytest

from laminara.operators import joins as jon


@pytest.fixture
def join_rows(spark):
    """Rows that the joins of a table make while it is collected, with the collected rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def run(df):
        rows, total, left = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
        while left:
            node = left.pop()
            if "Join" in node.nodeName():
                total += node.metrics().apply("numOutputRows").value()
            left += [node.children().apply(k) for k in range(node.children().size())]
        return rows, total

    yield run
    spark.conf.unset("spark.sql.adaptive.enabled")


def brute_mean(rows, radius, k):
    out = {}
    for z, a, i, j, v in rows:
        near = sorted((max(abs(i - y), abs(j - x)), b, w) for q, b, y, x, w in rows if q == z and max(abs(i - y), abs(j - x)) <= radius)[:k]
        out[z, a] = v - sum(n[2] for n in near) / len(near)
    return out


def test_minus_neighbour_mean_of_crowds(spark, join_rows):
    """Rows dense, sparse and at one place: as compared one with all, with joins in proportion to the rows."""
    draw, rows = random.Random(3), []
    for n in range(900):
        z = n % 2
        i, j = ((draw.uniform(0, 900), draw.uniform(0, 900)), (draw.gauss(200, 1), draw.gauss(200, 1)), (float(draw.randint(0, 4)), 7.0))[n % 3]
        rows.append((z, n, i, j, draw.random()))
    df = spark.createDataFrame(rows, "z int, id long, i double, j double, v double")
    got, made = join_rows(jon.minus_neighbour_mean(df, ["z"], "id", "i", "j", "v", 80.0, 8))
    want = brute_mean(rows, 80.0, 8)
    assert len(got) == len(rows) and all(abs(r.rest - want[r.z, r.id]) < 1e-9 for r in got)
    # All pairs within the radius are some 70,000, of which the join of before made more than these.
    assert made < 40 * len(rows)


def test_minus_neighbour_mean_leaves_out_what_has_no_place(spark):
    rows = [(0, 1, 1.0, 1.0, 2.0), (0, 2, float("nan"), 1.0, 2.0), (0, 3, None, 1.0, 2.0), (None, 4, 1.0, 1.0, 2.0), (0, 5, float("inf"), 1.0, 2.0), (0, 6, 81.0, 1.0, None)]
    df = spark.createDataFrame(rows, "z int, id long, i double, j double, v double")
    got = {r.id: r.rest for r in jon.minus_neighbour_mean(df, ["z"], "id", "i", "j", "v", 80.0, 8).collect()}
    assert got == {1: 0.0, 6: None}


def test_box_overlaps_of_copies(spark, join_rows, monkeypatch):
    """Copies of boxes are spread over at the end: joins make pairs of shapes."""
    monkeypatch.setattr(jon, "MEMBERS", 7, raising=False)
    boxes = [(n, n % 5 * 60, n % 3 * 90, 50 + n % 2, 70) for n in range(240)] + [(900, 5000, 5000, 1, 1), (901, None, 1, 1, 1)]
    got, made = join_rows(jon.box_overlaps(spark.createDataFrame(boxes, "id long, i long, j long, h long, w long")))
    whole = [b for b in boxes if b[1] is not None]
    want = [(a, b) for a, i, j, h, w in whole for b, y, x, g, v in whole if a != b and i <= y + g and y <= i + h and j <= x + v and x <= j + w]
    assert sorted((r.a, r.b) for r in got) == sorted(want)
    assert made < len(want) / 10


def test_points_are_located_once(spark):
    """The triangle's case, the only lambda of the plan, is not repeated for each weight."""
    from pyspark.sql import functions as F

    from laminara.operators import mesh as ms

    points = spark.range(100).select(F.col("id").alias("corr_id"), (F.col("id") * 1.5).alias("x"), (F.col("id") * 2.5).alias("y"))
    found = ms.located(points, ms.Lattice(1000.0, 800.0, 100.0), "x", "y")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("transform(array(struct(") + found._jdf.queryExecution().optimizedPlan().toString().count("transform(array(named_struct(") == 1
    assert found.count() == 100


def test_small_rows_are_dealt(spark):
    """Few bytes stay in as many tasks as shuffles have, where much work follows."""
    from laminara.operators.chunks import dealt

    rows = dealt(spark.range(400), "id").groupBy("id").count()
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_small_sections_share_folders(spark, sf, monkeypatch):
    """folders of src_volume follow blocks of tiles and not tiles."""
    from laminara.plans import registry
    from laminara.sources import storage

    seen, write = [], storage.write_volume
    monkeypatch.setattr(storage, "write_volume", lambda chunks, path: (write(chunks, path), seen.append(path)))
    assert registry.queries()["src_volume"](spark, sf).count() > 0
    ids = [r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()]
    folders = {f.rsplit("/", 1)[0] for f in spark.read.parquet(seen[0]).inputFiles()}
    assert len(folders) == len({k // 1024 for k in ids}) < len(ids) / 50


def test_blocks_of_sections_keep_what_is_not_written(spark, tmp_path):
    from laminara.sources import storage

    def chunks(zs, mip, byte):
        rows = [(z, mip, ci, 0, 1, 1, bytes([byte])) for z in zs for ci in range(2)]
        return storage.by_blocks(spark.createDataFrame(rows, storage.CHUNK), 4)

    path = f"{tmp_path}/volume"
    for zs, mip, byte in (([-1, 0, 1, 3, 4, 9], 0, 1), ([1, 5], 0, 2), ([3, 4], 1, 3), ([1, 2], 0, 4)):
        storage.write_volume(chunks(zs, mip, byte), path)
    whole = storage.read_volume(spark, path)
    want = {(0, z): 1 for z in (-1, 0, 3, 4, 9)} | {(0, 5): 2, (1, 3): 3, (1, 4): 3, (0, 1): 4, (0, 2): 4}
    assert set(whole.columns) == {"z", "mip", "ci", "cj", "h", "w", "data"}
    assert sorted((r.mip, r.z, r.ci, r.data[0]) for r in whole.collect()) == sorted((*k, ci, v) for k, v in want.items() for ci in range(2))
    some = storage.read_volume(spark, path, z=[-1, 4], mip=0, box=(1, 1, 1, 1))
    assert sorted((r.z, r.ci, r.data[0]) for r in some.collect()) == [(-1, 0, 1), (4, 0, 1)]
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "z_by_4" in scan[scan.index("PartitionFilters") :].split("]")[0]


def test_chunks_of_missing_and_null_pixels(spark):
    from laminara.sources import storage

    draw, pixels = random.Random(5), {}
    for _ in range(300):
        pixels[draw.randint(-2, 3), draw.randint(1, 11), draw.randint(1, 9)] = draw.choice([None, 0, 1, 200, 255])
    pixels[7, 1, 1] = None
    df = spark.createDataFrame([(*k, v) for k, v in pixels.items()], "z int, i int, j int, px int").repartition(3)
    got = {(r.z, r.ci, r.cj): r.data for r in storage.to_chunks(df, 4).collect()}
    want = {}
    for (z, i, j), v in pixels.items():
        want.setdefault((z, (i - 1) // 4, (j - 1) // 4), bytearray(16))[(i - 1) % 4 * 4 + (j - 1) % 4] = v or 0
    assert got == want
    rows = {(r.z, r.i, r.j): r.px for r in storage.from_chunks(storage.to_chunks(df, 4)).collect()}
    assert rows == {k: v for k, v in pixels.items() if v}
