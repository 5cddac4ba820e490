"""Retention, renumbering and memory estimates of a graph's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.operators.graph import distinct_edges
from kithgraph.schemas import Graph

#: Bytes of a value by type, for estimates.
WIDTHS = {"bigint": 8, "int": 4, "tinyint": 1, "boolean": 1, "double": 8, "string": 24, "timestamp": 8}


def prune(graph: Graph, cutoff: int) -> Graph:
    """Keeps edges by event time and metadata by creation time; topics of posts with either.

    Follows and blocks stay.
    """
    edges = graph.edges.where(F.col("ts") >= cutoff)
    meta = graph.meta.where(F.col("created_at") >= cutoff)
    alive = edges.select("post_id").union(meta.select("post_id")).distinct()
    return replace(graph, raw=graph.raw.where(F.col("ts") >= cutoff), edges=edges, meta=meta, topics=graph.topics.join(alive, "post_id", "left_semi"))


def undone(log: DataFrame, removals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a log with arrival order seq that no later removal of the same keys takes back.

    Removals are reduced to one row a key before they are joined.
    """
    gone = removals.groupBy(*keys).agg(F.max("seq").alias("__gone"))
    return log.join(gone, keys, "left").where("__gone is null or seq > __gone").drop("__gone")


def without_interactions(graph: Graph, removals: DataFrame) -> Graph:
    """graph after removals (user_id, post_id, signal, seq); a later interaction makes the edge anew."""
    raw = undone(graph.raw, removals, ["user_id", "post_id", "signal"])
    return replace(graph, raw=raw, edges=distinct_edges(raw))


def referenced(graph: Graph) -> DataFrame:
    """Every number that a table refers to, as `id`; users and posts share one space."""
    columns = [(graph.edges, "user_id"), (graph.edges, "post_id"), (graph.meta, "post_id"), (graph.meta, "author_id"), (graph.meta, "root_id"), (graph.meta, "parent_id"), (graph.follows, "follower_id"), (graph.follows, "followed_id"), (graph.blocks, "blocker_id"), (graph.blocks, "blocked_id"), (graph.impressions, "viewer_id"), (graph.impressions, "post_id")]
    out = None
    for df, c in columns:
        own = df.select(F.col(c).cast("long").alias("id"))
        out = own if out is None else out.union(own)
    return out.where("id is not null").distinct()


def id_map(ids: DataFrame) -> DataFrame:
    """old -> new numbers, dense inside each of 64 shards (the old number's low bits)."""
    shard = F.col("id") % 64
    local = F.row_number().over(Window.partitionBy(shard).orderBy("id")) - 1
    return ids.select(F.col("id").alias("old"), (local.cast("long") * 64 + shard).alias("new"))


def renumber(df: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns mapped; rows whose number isn't mapped keep null there."""
    names = df.columns
    for c in columns:
        df = df.join(mapping.select(F.col("old").alias(c), F.col("new").alias("__new")), c, "left").drop(c).withColumnRenamed("__new", c)
    return df.select(*names)


def compact(graph: Graph) -> Graph:
    m = id_map(referenced(graph))
    return replace(
        graph, raw=renumber(graph.raw, m, ["user_id", "post_id"]), edges=renumber(graph.edges, m, ["user_id", "post_id"]), meta=renumber(graph.meta, m, ["post_id", "author_id", "root_id", "parent_id"]),
        topics=renumber(graph.topics, m, ["post_id"]), users=renumber(graph.users, m, ["user_id"]), follows=renumber(graph.follows, m, ["follower_id", "followed_id"]),
        blocks=renumber(graph.blocks, m, ["blocker_id", "blocked_id"]), impressions=renumber(graph.impressions, m, ["viewer_id", "post_id"]),
    )


def estimated_bytes(df: DataFrame) -> DataFrame:
    """Rows times the width of the schema, one row: an estimate of a table's payload."""
    width = sum(WIDTHS.get(kind, 16) for _, kind in df.dtypes)
    return df.agg(F.count("*").alias("rows")).withColumn("bytes", F.col("rows") * width)
