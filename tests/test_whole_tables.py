"""Queries without a cut in their SQL run over all tiles."""

from laminara.plans import registry
from laminara.sources import storage


def tiles(spark, sf):
    return {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}


def test_features_of_all_tiles(spark, sf):
    every = tiles(spark, sf)
    got = [r.match for r in registry.queries()["mat_features"](spark, sf).select("match").collect()]
    assert sorted(got) == sorted(z for z in every if z + 1 in every)


def test_volume_holds_all_tiles(spark, sf, monkeypatch):
    seen, write = [], storage.write_volume
    monkeypatch.setattr(storage, "write_volume", lambda chunks, path: (write(chunks, path), seen.append(path)))
    assert registry.queries()["src_volume"](spark, sf).count() > 0
    assert {r.z for r in spark.read.parquet(seen[0]).select("z").distinct().collect()} == tiles(spark, sf)
