"""Reading and writing of the library's tables: chunked volumes, correspondences as CSV, meshes and matches, parameters."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "z int, mip int, ci int, cj int, h int, w int, data binary"
POINTS = "corr_id long, src_z int, dst_z int, pre_x double, pre_y double, pre_z double, post_x double, post_y double, post_z double, filter boolean"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; set a temporary one only in local sessions, where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="laminara-"))


class Stored:
    """A table written to the shared folder, so that what follows doesn't carry its lineage; ``drop`` deletes it."""

    def __init__(self, df: DataFrame) -> None:
        spark = self.spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        self.path = f"{spark.sparkContext.getCheckpointDir()}/laminara-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def to_chunks(px: DataFrame, size: int, mip: int = 0) -> DataFrame:
    """Pixel rows (z, i, j, px) as chunks of ``size`` squared bytes, pixels that are missing as zero. Spark gathers each
    chunk's places and values as one number a pixel; Python lays out many chunks at a time."""
    at = lambda c: F.floor((F.col(c) - 1) / size).cast("int")
    inside = lambda c: F.pmod(F.col(c) - 1, F.lit(size)).cast("long")
    code = (inside("i") * size + inside("j")) * 256 + F.pmod(F.col("px").cast("int"), F.lit(256))
    cells = px.select("z", at("i").alias("ci"), at("j").alias("cj"), code.alias("code"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        step = max(1, (1 << 24) // size**2)  # chunks laid out at a time
        for whole in batches:
            for k in range(0, len(whole), step):
                b = whole.iloc[k : k + step]
                code, img = np.concatenate(b.codes.to_list()), np.zeros((len(b), size * size), np.uint8)
                img[np.repeat(np.arange(len(b)), b.codes.str.len()), code >> 8] = code & 255
                yield pd.DataFrame({"z": b.z, "mip": mip, "ci": b.ci, "cj": b.cj, "h": size, "w": size, "data": [x.tobytes() for x in img]})

    return cells.groupBy("z", "ci", "cj").agg(F.collect_list("code").alias("codes")).mapInPandas(pack, CHUNK)


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Pixel rows of chunks, zeros left out."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for r in b.itertuples(index=False):
                img = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w)
                i, j = np.nonzero(img)
                yield pd.DataFrame({"z": r.z, "mip": r.mip, "i": i + 1 + r.ci * r.h, "j": j + 1 + r.cj * r.w, "px": img[i, j].astype(int)})

    return chunks.mapInPandas(unpack, "z int, mip int, i int, j int, px int")


#: Name of the folders that hold more than one section, before the number of sections in each.
BLOCK = "z_by_"


def by_blocks(chunks: DataFrame, sections: int) -> DataFrame:
    """``chunks`` for a volume of many small sections, of which so many in a row share a folder. A volume keeps the number
    that it began with."""
    return chunks.withColumn(f"{BLOCK}{sections}", F.floor(F.col("z") / sections).cast("int"))


def block_of(columns: list[str]) -> str | None:
    return next((c for c in columns if c.startswith(BLOCK)), None)


def write_volume(chunks: DataFrame, path: str) -> None:
    """Overwrite the sections and levels that ``chunks`` holds, and no others. Each section and level has its folder, or
    each block of sections and level if ``chunks`` come from ``by_blocks``; what other sections a block has is kept."""
    block, stored = block_of(chunks.columns), []
    if block is not None:
        spark = chunks.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            new = Stored(chunks)
            old = spark.read.schema(CHUNK).parquet(path)
            if block in old.columns:
                old = old.join(new.df.select(block, "mip").distinct(), [block, "mip"], "left_semi")
                kept = Stored(old.join(new.df.select("z", "mip").distinct(), ["z", "mip"], "left_anti"))
                stored, chunks = [new, kept], new.df.unionByName(kept.df)
            else:
                stored, chunks = [new], new.df
        chunks = chunks.repartition(block, "mip").sortWithinPartitions(block, "mip", "z", "ci", "cj")
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(block or "z", "mip").parquet(path)
    for t in stored:
        t.drop()


def read_volume(spark: SparkSession, path: str, z: list[int] | None = None, mip: int | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Chunks of a volume; sections (or their blocks) and level prune folders, a box (i0, i1, j0, j1) is pushed to the files."""
    df = spark.read.schema(CHUNK).parquet(path)
    block = block_of(df.columns)
    if z is not None:
        df = df.where(F.col("z").isin(z))
        if block is not None:
            df = df.where(F.col(block).isin(sorted({k // int(block.removeprefix(BLOCK)) for k in z})))
    if mip is not None:
        df = df.where(F.col("mip") == mip)
    if box is not None:
        i0, i1, j0, j1 = box
        df = df.where(((F.col("ci") + 1) * F.col("h") >= i0) & (F.col("ci") * F.col("h") < i1) & ((F.col("cj") + 1) * F.col("w") >= j0) & (F.col("cj") * F.col("w") < j1))
    return df if block is None else df.drop(block)


def points_table(df: DataFrame, manual_only: bool = True) -> DataFrame:
    """Correspondences in the form for review; ``filter`` is true for accepted rows."""
    rejected = F.coalesce(F.col("manual"), F.lit(False)) if manual_only and "manual" in df.columns else F.lit(False) if manual_only else F.col("rejected")
    return df.select(
        "corr_id", "src_z", "dst_z", F.col("pre_i").alias("pre_x"), F.col("pre_j").alias("pre_y"), F.col("src_z").cast("double").alias("pre_z"),
        (F.col("pre_i") + F.col("dv_i")).alias("post_x"), (F.col("pre_j") + F.col("dv_j")).alias("post_y"), F.col("dst_z").cast("double").alias("post_z"), (~rejected).alias("filter"),
    )


def write_points(df: DataFrame, path: str, manual_only: bool = True) -> None:
    """One folder of CSV files for each match, all matches in one job."""
    points_table(df, manual_only).write.mode("overwrite").option("header", True).partitionBy("src_z", "dst_z").csv(path)


def read_manual(df: DataFrame, path: str) -> DataFrame:
    """``df`` with ``manual`` set to the opposite of the accepted mark of the files; rows without one stay unmarked."""
    marks = df.sparkSession.read.schema(POINTS).option("header", True).csv(path).select("corr_id", (~F.col("filter")).alias("manual"))
    return df.drop("manual").join(marks, "corr_id", "left").withColumn("manual", F.coalesce("manual", F.lit(False)))


def save_set(meshes: DataFrame, matches: DataFrame, path: str) -> None:
    meshes.write.mode("overwrite").partitionBy("z").parquet(f"{path}/meshes")
    matches.write.mode("overwrite").partitionBy("src_z", "dst_z").parquet(f"{path}/matches")


def load_set(spark: SparkSession, path: str, z0: int, z1: int, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Meshes of a range of sections, the matches of given pairs (or between these sections), and the pairs that have none."""
    meshes = spark.read.parquet(f"{path}/meshes").where(F.col("z").between(z0, z1))
    matches = spark.read.parquet(f"{path}/matches")
    if pairs is None:
        return meshes, matches.where(F.col("src_z").between(z0, z1) & F.col("dst_z").between(z0, z1)), matches.select("src_z", "dst_z").limit(0)
    keys = ["src_z", "dst_z"]
    return meshes, matches.join(pairs, keys, "left_semi"), pairs.join(matches.select(*keys).distinct(), keys, "left_anti")


def load_params(text: str, defaults: dict | None = None) -> dict:
    """A parameter file over the defaults, nested keys merged."""

    def merged(a: dict, b: dict) -> dict:
        return a | {k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    return merged(defaults or DEFAULTS, json.loads(text))


#: Types of the parameters of ``DEFAULTS``, as a schema of the files.
PARAMS = "mesh struct<mesh_length:double>, match struct<block_r:int,search_r:int,depth:int,symmetric:boolean,bandpass_sigmas:array<double>>, solve struct<method:string,mesh_spring_coeff:double,match_spring_coeff:double,max_iters:int,ftol_cg:double,lambda:double>"


def with_params(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the column ``params``: each row's parameter file over the defaults. Keys that a file lacks or gives as
    null, and all keys of a text that is no JSON, have their defaults; keys that aren't known are left out."""
    raw = df.withColumn("_p", F.from_json(F.col(text), PARAMS))
    whole = F.from_json(F.lit(json.dumps(DEFAULTS)), PARAMS)
    merged = [F.struct(*(F.coalesce(F.col(f"_p.{a}.{b}"), whole[a][b]).alias(b) for b in keys)).alias(a) for a, keys in DEFAULTS.items()]
    return raw.withColumn("params", F.struct(*merged)).drop("_p")


def param(key: str) -> Column:
    """A parameter by its name alone, the first group that has it."""
    group = next((a for a, keys in DEFAULTS.items() if key in keys), None)
    if group is None:
        raise KeyError(key)
    return F.col(f"params.{group}.{key}")


#: Defaults of the parameters that operators read.
DEFAULTS = {
    "mesh": {"mesh_length": 160.0}, "match": {"block_r": 128, "search_r": 256, "depth": 2, "symmetric": False, "bandpass_sigmas": [0, 0]},
    "solve": {"method": "elastic", "mesh_spring_coeff": 1.0, "match_spring_coeff": 100.0, "max_iters": 4000, "ftol_cg": 1e-6, "lambda": 0.9},
}


def with_z_map(df: DataFrame, z_map: DataFrame | None, column: str = "z") -> DataFrame:
    """Sections renamed by the map (old_z, new_z); those that it lacks, and all without a map, stay."""
    if z_map is None:
        return df
    m = z_map.select(F.col("old_z").alias(column), F.col("new_z").alias("_new"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from text in any of the forms "117,118", "((0, 1),)" or "[(1,2),(3,4)]"."""
    from laminara.functions.names import parse_pairs

    return spark.read.text(path).select(F.explode(parse_pairs(F.col("value"))).alias("p")).select("p.*")


def read_tiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table of tiles."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
