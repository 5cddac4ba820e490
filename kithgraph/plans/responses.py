"""JSON bodies of answers, one row for each viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.scalars import choose


def _listed(order: str, item: Column) -> Column:
    """Items of a viewer's bounded page in their order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))), lambda x: x["i"])


def skeletons(page: DataFrame) -> DataFrame:
    """(viewer_id, body) from a page (viewer_id, post_id, pos, next_cursor): posts with feedContext where
    the page has `explain`, and the cursor where more follow."""
    item = [F.col("post_id").cast("string").alias("post")] + ([F.col("explain").alias("feedContext")] if "explain" in page.columns else [])
    per = page.groupBy("viewer_id").agg(_listed("pos", F.struct(*item)).alias("feed"), F.max("next_cursor").alias("cursor"))
    return per.select("viewer_id", F.to_json(F.struct("feed", "cursor")).alias("body"))


def twins(near: DataFrame) -> DataFrame:
    """(viewer_id, body) from like-minded users (u, v, shared, rank)."""
    item = F.struct(F.col("v").cast("string").alias("user"), F.col("shared").alias("sharedCount"))
    per = near.groupBy(F.col("u").alias("viewer_id")).agg(_listed("rank", item).alias("twins"))
    return per.select("viewer_id", F.to_json(F.struct(F.col("viewer_id").cast("string").alias("viewer"), "twins")).alias("body"))


def proofs(rows: DataFrame) -> DataFrame:
    """(viewer_id, post_id, body) from explain(): steps in order and the summary."""
    return rows.select("viewer_id", "post_id", F.to_json(F.struct("steps", "summary")).alias("body"))


def _fixed(value: Column) -> Column:
    """A figure of an answer to six places."""
    return F.round(value.cast("double"), 6)


def previews(rows: DataFrame, latency_us: int = 0) -> DataFrame:
    """(viewer_id, body) from preview_tiers() with proofs: each post with its score's parts and its proof, in order.

    total_candidates counts the rows of a viewer.
    """
    names = {1: "Tier 1: 3-Step Interaction Walk", 2: "Tier 2: Follow Walk", 3: "Tier 3: Velocity Pool"}
    parts = F.struct(_fixed(F.col("time_decay")).alias("time_decay"), _fixed(F.col("taste_similarity")).alias("taste_similarity"), _fixed(F.col("topic_boost")).alias("topic_boost"), _fixed(F.col("mult")).alias("fatigue_penalty"), _fixed(F.col("score")).alias("final_score"))
    proof = F.struct("steps", "summary") if "steps" in rows.columns else F.lit(None)
    item = F.struct(F.col("post_id").cast("string").alias("uri"), F.col("author_id").cast("string").alias("author_did"), "topic", choose(F.col("tier"), names).alias("tier"), parts.alias("score_breakdown"), proof.alias("proof_chain"))
    per = rows.groupBy("viewer_id").agg(_listed("pos", item).alias("items"), F.count("*").alias("total_candidates"))
    return per.select("viewer_id", F.to_json(F.struct(F.col("viewer_id").cast("string").alias("viewer_did"), "items", "total_candidates", F.lit(latency_us).cast("long").alias("query_latency_us"))).alias("body"))


def telemetry(graph: DataFrame, active: DataFrame, stores: DataFrame, ingestion: dict | None = None, snapshot: dict | None = None) -> DataFrame:
    """(body) of one row: counts of the graph, users active by window, rows and estimated bytes of each
    store, and what the event store and the snapshots report of themselves."""
    listed = F.array_sort(F.collect_list(F.struct("store", "rows", "bytes"))).alias("stores")
    row = graph.crossJoin(active).crossJoin(stores.agg(listed, F.sum("bytes").alias("estimated_bytes")))
    own = {"ingestion": ingestion or {}, "snapshot": snapshot or {}}
    told = [F.map_from_arrays(F.array(*(F.lit(k) for k in d)), F.array(*(F.lit(str(v)) for v in d.values()))).alias(n) for n, d in own.items() if d]
    return row.select(F.to_json(F.struct(F.lit("ok").alias("status"), F.struct(*graph.columns).alias("graph"), F.struct(*active.columns).alias("active_users"), F.struct("estimated_bytes", "stores").alias("memory"), *told)).alias("body"))
