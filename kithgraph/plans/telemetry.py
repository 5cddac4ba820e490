"""Activity, progress and latency figures."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.graph import user_posts
from kithgraph.operators.maintenance import estimated_bytes
from kithgraph.schemas import Graph

#: Windows of active users, seconds.
ACTIVE = (60, 300, 900)


def active_users(seen: DataFrame, now: int) -> DataFrame:
    """seen (user_id, ts): users last seen in each window up to now, and all users."""
    last = seen.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return last.agg(*(F.count_if(F.col("ts") >= now - w).alias(f"active_{w}s") for w in ACTIVE), F.count("*").alias("tracked"))


def progress(rows: DataFrame) -> DataFrame:
    """rows (start, target, cursor, elapsed, lag): pct, live, speedup, eta.

    Without a target beyond the start there is nothing to catch up with.
    """
    s, g, c = F.col("start"), F.col("target"), F.col("cursor")
    none = g.isNull() | (g <= s)
    pct = F.when(none, 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * (c - s) / F.nullif(g - s, F.lit(0)))))
    speed = F.when(none, 1.0).otherwise((c - s) / F.greatest(F.col("elapsed"), F.lit(1)).cast("double"))
    live = none | (F.col("lag") <= 60) | (c >= g)
    out = rows.withColumns({"pct": pct, "speedup": speed, "live": live})
    eta = F.when(none, F.lit(None).cast("double")).when(F.col("live"), 0.0).when(F.col("speedup") > 0.1, (g - c) / F.when(F.col("speedup") > 0.1, F.col("speedup")))
    return out.withColumn("eta", eta)


def low_watermark(cursors: DataFrame, slices: int) -> DataFrame:
    """cursors (slice, cursor): the least cursor, 0 until all slices have started."""
    per = cursors.groupBy("slice").agg(F.max("cursor").alias("c")).where("c > 0")
    return per.agg(F.when(F.count("*") == slices, F.min("c")).otherwise(0).alias("watermark"))


def percentiles(df: DataFrame, column: str) -> DataFrame:
    at = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    return df.agg(*(F.percentile(column, p).alias(n) for n, p in at.items()))


def store_counts(graph: Graph) -> DataFrame:
    """(store, keys, rows) of each table; keys are those with rows."""
    tables = {"users": (graph.edges, "user_id"), "posts": (graph.edges, "post_id"), "bitmaps": (user_posts(graph.edges), "user_id"), "follows": (graph.follows, "follower_id"), "blocks": (graph.blocks, "blocker_id"), "metadata": (graph.meta, "post_id"), "impressions": (graph.impressions, "viewer_id")}
    out = None
    for name, (df, key) in tables.items():
        # Rows are summed by key first, so no distinct set is held in one task.
        own = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit(name).alias("store"), "keys", "rows")
        out = own if out is None else out.unionByName(own)
    return out


def impression_counts(state: DataFrame) -> DataFrame:
    """(viewer_id, posts, viewers): distinct posts shown to each viewer, and viewers tracked."""
    per = state.groupBy("viewer_id").agg(F.count("*").alias("posts"))
    return per.crossJoin(F.broadcast(per.agg(F.count("*").alias("viewers"))))


def store_bytes(graph: Graph) -> DataFrame:
    """(store, rows, bytes) of each table, bytes estimated from its schema."""
    out = None
    for f in fields(Graph):
        own = estimated_bytes(getattr(graph, f.name)).select(F.lit(f.name).alias("store"), "rows", "bytes")
        out = own if out is None else out.unionByName(own)
    return out
