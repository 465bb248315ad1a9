"""Tasks as files: a folder of JSON messages is a queue, and Structured Streaming works it off.

A message counts as done once its batch is committed to the checkpoint; a batch may run again after a failure, so
handlers overwrite what they write.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "task_id string, method string, src_z int, dst_z int, params string"
#: Handlers by method; nothing is looked up by evaluating text.
Handler = Callable[[DataFrame], None]


def pair_tasks(pairs: DataFrame, method: str, params: str) -> DataFrame:
    """One message for each pair, with the parameters copied."""
    return pairs.select(F.concat_ws("-", F.lit(method), "src_z", "dst_z").alias("task_id"), F.lit(method).alias("method"), "src_z", "dst_z", F.lit(params).alias("params"))


def chunk_tasks(spark: SparkSession, bounds: tuple[tuple[int, int], ...], size: tuple[int, int, int]) -> DataFrame:
    """(x0, x1, y0, y1, z0, z1) of all chunks within the bounds, cut off at their ends."""
    out = spark.range(1).select()
    for axis, (lo, hi), step in zip("xyz", bounds, size, strict=True):
        out = out.withColumn(f"{axis}0", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1), F.lit(step)))).withColumn(f"{axis}1", F.least(F.col(f"{axis}0") + step, F.lit(hi)))
    return out


def publish(tasks: DataFrame, folder: str) -> None:
    tasks.write.mode("append").json(folder)


def subscribe(spark: SparkSession, folder: str, checkpoint: str, handlers: dict[str, Handler], files_at_once: int | None = None, once: bool = True) -> StreamingQuery:
    """Send each batch's messages to the handler of their method; unknown methods go to ``handlers["*"]`` if there is one.

    ``once`` works off what is there and stops; otherwise the query waits for more.
    """
    reader = spark.readStream.schema(MESSAGE)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)

    def batch(df: DataFrame, _: int) -> None:
        known = [m for m in handlers if m != "*"]
        for method in known:
            part = df.where(F.col("method") == method)
            if not part.isEmpty():
                handlers[method](part)
        if "*" in handlers:
            rest = df.where(~F.col("method").isin(known) | F.col("method").isNull())
            if not rest.isEmpty():
                handlers["*"](rest)

    writer = reader.json(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def sections_of(tasks: DataFrame) -> DataFrame:
    """(z): every section that the messages name, once."""
    return tasks.select(F.explode(F.array("src_z", "dst_z")).alias("z")).where("z is not null").distinct()


def render_task(layers: dict[str, DataFrame], triangles: DataFrame, path: str, size: int, box: tuple[int, int, int, int], levels: int = 0, z_map: DataFrame | None = None) -> Handler:
    """Handler that renders the sections of its messages, stores them under their mapped numbers, and then their lower levels
    from what was stored. Sections and levels are overwritten whole, so that a message may be worked off again."""
    from laminara.operators import chunks as ch
    from laminara.operators.render import render
    from laminara.sources.storage import read_volume, with_z_map, write_volume

    def handle(tasks: DataFrame) -> None:
        wanted = F.broadcast(sections_of(tasks))  # numbers of the sections of one batch
        own = lambda df: df.join(wanted, "z", "left_semi")
        out = render(own(triangles), {k: own(v) for k, v in layers.items()}, size, box)
        write_volume(with_z_map(out, z_map), path)
        mapped = with_z_map(sections_of(tasks), z_map).distinct()
        for level in range(levels):
            last = read_volume(tasks.sparkSession, path, mip=level).join(F.broadcast(mapped), "z", "left_semi")
            write_volume(ch.halved(last, size), path)

    return handle


def match_task(layers: dict[str, DataFrame], nodes: DataFrame, path: str, size: int, extent: tuple[int, int], block_r: int, search_r: int, bandpass: tuple[float, float] = (0, 0)) -> Handler:
    """Handler that matches the pairs of its messages at all nodes and stores what it finds by pair, over earlier results."""
    from laminara.operators.matching import match_pairs, write_matches

    def handle(tasks: DataFrame) -> None:
        write_matches(match_pairs(tasks, nodes, layers, size, *extent, block_r, search_r, bandpass), path)

    return handle


def drain(spark: SparkSession, folder: str) -> DataFrame:
    """All messages of the folder as a table."""
    return spark.read.schema(MESSAGE).json(folder)


def event_counts(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Messages by event-time window; rows later than the delay are left out when this runs as a stream."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")
