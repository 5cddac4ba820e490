"""Structured Streaming forms of ingestion, deduplication and trends."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kithgraph.functions import scalars as S
from kithgraph.schemas import VELOCITY_WINDOW
from kithgraph.sources import frames


def table_stream(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 8) -> DataFrame:
    """A Parquet table of a folder as a stream, with bounded triggers."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parq*t")


def frame_stream(spark: SparkSession, folder: str, collections: list[str] = (), start: int | None = None, per_trigger: int = 100) -> DataFrame:
    """Events of JSON-lines files as they arrive, from the cursor `start` (microseconds) on.

    Unwanted collections and frames before the cursor are dropped before parsing.  A query's
    checkpoint is the cursor that it resumes from.
    """
    lines = frames.wanted(spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder), list(collections))
    if start is not None:
        lines = frames.heartbeat(lines).where(F.col("time_us") >= start).drop("time_us")
    return frames.parse(lines)


def sliced_stream(spark: SparkSession, folders: dict[str, list[str]], start: int | None = None, per_trigger: int = 100) -> DataFrame:
    """Events of several folders, each read for its own collections, with the folder in `slice`.

    A collection in two slices would be read twice, so that is refused.
    """
    named = [c for own in folders.values() for c in own]
    if not folders or len(set(named)) < len(named) or not all(folders.values()):
        raise ValueError("each slice needs collections of its own")
    parts = [frame_stream(spark, f, own, start, per_trigger).withColumn("slice", F.lit(f)) for f, own in folders.items()]
    return reduce(DataFrame.unionByName, parts)


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrival of every interaction in bounded state: events later than the delay are dropped.

    tables.EdgeTable takes them all, however late.
    """
    at = events.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    return at.dropDuplicatesWithinWatermark(["user_id", "post_id", "signal"])


def windowed_velocity(edges: DataFrame, slide: str = "1 hour", delay: str = f"{VELOCITY_WINDOW} seconds") -> DataFrame:
    """Weighted interactions by post in sliding windows of VELOCITY_WINDOW, of edges up to `delay` late.

    tables.VelocityTable takes edges however late, with decay and social proof.
    """
    at = edges.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    win = F.window("event_time", f"{VELOCITY_WINDOW} seconds", slide)
    return at.groupBy(win, "post_id").agg(F.sum(S.weight(F.col("signal"))).alias("weight"), F.count("*").alias("n"))


def drained(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what there is, batch by batch, and returns when done."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
