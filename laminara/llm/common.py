"""Helpers shared by the operators of this subpackage: table access, shared storage, exact connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters, as a Java regular expression.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
#: Rows in one Arrow batch; texts can be long, so batches stay short.
ARROW_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Rows in one Arrow batch from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, so that a Python worker's memory follows a batch and not a partition."""
    arrow_rows(spark, ARROW_ROWS)


def trim() -> None:
    """In a task: give memory that Python has freed back to the system, where the C library can."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one set on the context.

    Where neither is set, a temporary folder of our own serves a local session; on a cluster it would be out of the
    executors' sight, so there this is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="laminara-"))
    return sc.getCheckpointDir()


class Stored:
    """A DataFrame written as Parquet to the shared folder; ``df`` reads it again, ``drop`` deletes it.

    ``there`` lists the tables not dropped yet, so that a caller can drop what an operator's lazy result was read from.
    """

    there: ClassVar[list[Stored]] = []

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/laminara-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        Stored.there.append(self)

    def drop(self) -> None:
        if self in Stored.there:
            Stored.there.remove(self)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def training_rows(labels: DataFrame, where: Column, limits: dict[int, int], label: str) -> DataFrame:
    """A bounded, repeatable sample of labelled ids: for each class the ``limits[class]`` rows of smallest hash.

    Null ids and null labels take no part; of repeated ids the largest label counts. The result has at most
    ``sum(limits.values())`` rows, so it may be broadcast.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & where)
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    parts = [
        rows.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in sorted(limits.items())
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Ids that are broadcast at most; a longer list is joined by a shuffle.
BROADCAST_IDS = 2_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined with the one column of ``ids``; no row of ``docs`` moves while the ids are few.

    The ids are counted first. Up to ``BROADCAST_IDS`` are broadcast, which bounds their memory; more are joined by
    sorting both sides.
    """
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), ids.columns[0], how)


def components(edges: DataFrame) -> Stored | None:
    """Connected components of an undirected graph of long node ids.

    ``edges`` has two long columns ``u`` and ``v``; loops and repeats are allowed. Returns a stored table
    (node, component) with component the smallest node that can be reached, for the nodes of at least one edge;
    None if there is no edge. In each round a node takes the smallest label among its neighbours, and so does the node
    that its label names; then labels are followed twice. So labels spread along paths in any order of ids, and rounds
    go on until nothing changes. No node, edge or label reaches the driver.
    """
    both = edges.where("u <> v").select("u", "v")
    sym = Stored(both.union(both.select(F.col("v"), F.col("u"))).distinct())
    if sym.df.isEmpty():
        sym.drop()
        return None
    labels = Stored(sym.df.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        old = labels.df.select("node", "component")
        seen = sym.df.join(old.select(F.col("node").alias("v"), F.col("component").alias("m")), "v")
        near = seen.groupBy("u").agg(F.min("m").alias("m"))
        near = near.join(old.select(F.col("node").alias("u"), "component"), "u")
        offers = near.select(F.col("u").alias("node"), "m").union(near.where("m < component").select("component", "m"))
        best = offers.groupBy("node").agg(F.min("m").alias("m"))
        new = old.join(best, "node").select("node", F.least("component", "m").alias("c1"), F.col("component").alias("was"))
        at = old.select(F.col("node").alias("c1"), F.col("component").alias("c2"))
        new = new.join(at, "c1").select("node", F.least("c1", "c2").alias("c2"), "was")
        at = old.select(F.col("node").alias("c2"), F.col("component").alias("c3"))
        new = new.join(at, "c2").select("node", F.least("c2", "c3").alias("component"), "was")
        step = Stored(new)
        moved = not step.df.where("component <> was").isEmpty()
        labels.drop()
        labels = step
        if not moved:
            labels.df = labels.df.drop("was")
            sym.drop()
            return labels
