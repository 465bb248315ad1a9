"""The library's tables, derived from the star-schema tables without chance or writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One correspondence for each event; the same text serves both engines.
CORR = """event_id AS corr_id, CAST(user_id % 10 AS INT) AS src_z, CAST(user_id % 10 + 1 + event_id % 2 AS INT) AS dst_z,
CAST((event_id * 37) % 1000 AS DOUBLE) AS pre_i, CAST((event_id * 91) % 800 AS DOUBLE) AS pre_j, value / 10 - 5 AS dv_i,
CAST((event_id * 13) % 41 - 20 AS DOUBLE) AS dv_j, CAST(46 + event_id % 60 AS DOUBLE) / 100 AS dyn_range,
CAST((event_id * 7) % 31 - 3 AS DOUBLE) AS kurt_src, CAST((event_id * 11) % 55 - 3 AS DOUBLE) AS kurt_dst,
LEAST(value / 100, 1.0) AS r_max, CAST((event_id * 3) % 50 + user_id % 10 AS DOUBLE) / 100 AS delta_5,
value / 20 AS sigma_095, value / 5 AS sigma_075, value AS sigma_05"""


def correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*split_top(CORR))


def split_top(text: str) -> list[str]:
    """Split at commas outside parentheses."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, z, i, j, px): each vector of 64 is a tile of 8 by 8 pixels from 0 to 255, of the section its label names."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "v"))
    px = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("v").cast("double") * 127.5 + 127.5))).cast("int")
    return e.select(F.col("vec_id").alias("tile"), F.col("label").alias("z"), F.expr("cast(p div 8 + 1 as int)").alias("i"), (F.col("p") % 8 + 1).cast("int").alias("j"), px.alias("px"))


#: Tiles side by side in a plane of ``mosaic``.
ACROSS = 32


def mosaic(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """Ten planes as chunks: the tile of id t lies in plane t % 10, at place t div 10 of rows of ACROSS tiles."""
    import numpy as np
    import pandas as pd

    per = size // 8
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, v -> cast(least(255, greatest(0, floor(cast(v as double) * 127.5 + 127.5))) as int))").alias("px"))
    at = e.select((F.col("vec_id") % 10).cast("int").alias("z"), F.expr(f"cast(vec_id div 10 div {ACROSS} as int)").alias("row"), F.expr(f"cast(vec_id div 10 % {ACROSS} as int)").alias("col"), "px")
    at = at.withColumns({"ci": F.expr(f"cast(row div {per} as int)"), "cj": F.expr(f"cast(col div {per} as int)")})

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        img, first = np.zeros((per, 8, per, 8), np.uint8), t.iloc[0]
        img[t.row % per, :, t.col % per] = np.stack(t.px.to_list()).reshape(-1, 8, 8)
        return pd.DataFrame({"z": [first.z], "mip": [0], "ci": [first.ci], "cj": [first.cj], "h": [size], "w": [size], "data": [img.tobytes()]})

    return at.groupBy("z", "ci", "cj").applyInPandas(pack, "z int, mip int, ci int, cj int, h int, w int, data binary")


def mosaic_extent(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Height and width of the planes."""
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0
    return 8 * (last // 10 // ACROSS + 1), 8 * ACROSS


#: SQL of the same tables for an independent engine.
SQL_CORR = f"corr AS (SELECT {CORR} FROM events)"
SQL_PX = """px AS (SELECT vec_id AS tile, label AS z, CAST((p - 1) // 8 + 1 AS INT) AS i, CAST((p - 1) % 8 + 1 AS INT) AS j,
CAST(LEAST(255, GREATEST(0, FLOOR(CAST(embedding[p] AS DOUBLE) * 127.5 + 127.5))) AS INT) AS px
FROM (SELECT *, UNNEST(generate_series(1, 64)) AS p FROM embeddings))"""
SQL_PLANE = f"""{SQL_PX}, plane AS (SELECT CAST(tile % 10 AS INT) AS z, CAST(tile // 10 // {ACROSS} * 8 + i AS INT) AS i, CAST(tile // 10 % {ACROSS} * 8 + j AS INT) AS j, px FROM px),
extent AS (SELECT 8 * (max(tile) // 10 // {ACROSS} + 1) AS h, {8 * ACROSS} AS w FROM px)"""
