"""Filters and list operators on ranked candidates (viewer_id, post_id, score)."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.functions import scalars as S
from kithgraph.operators.graph import degree, mutual_blocks, user_posts
from kithgraph.plans.dials import Dials
from kithgraph.schemas import PER_AUTHOR, Graph


def with_facts(candidates: DataFrame, graph: Graph) -> DataFrame:
    """Adds degree, metadata and topic; without metadata a post has an author of its own and is no reply."""
    c = candidates.join(degree(graph.edges), "post_id", "left").join(graph.meta, "post_id", "left").join(graph.topics, "post_id", "left")
    own = F.lit(0xFFFFFFFF).bitwiseXOR(F.col("post_id"))
    return c.withColumns({"degree": F.coalesce("degree", F.lit(0)), "author_id": F.coalesce("author_id", own), "is_nsfw": F.coalesce("is_nsfw", F.lit(False)), "topic": F.coalesce("topic", F.lit("general"))})


def drop_seen(c: DataFrame, graph: Graph) -> DataFrame:
    return c.join(user_posts(graph.edges).withColumnRenamed("user_id", "viewer_id"), ["viewer_id", "post_id"], "left_anti")


def drop_own_and_blocked(c: DataFrame, graph: Graph) -> DataFrame:
    barred = mutual_blocks(graph.blocks).select(F.col("a").alias("viewer_id"), F.col("b").alias("author_id"))
    return c.where("author_id <> viewer_id").join(barred, ["viewer_id", "author_id"], "left_anti")


def allowed(dials: Dials) -> Column:
    """Engagement floor, replies and NSFW by the dials, on facts of with_facts."""
    ok = F.lit(True)
    if dials.min_likes > 0:
        ok = ok & (F.col("degree") >= dials.min_likes)
    if not dials.include_replies:
        ok = ok & ~S.is_reply(F.col("parent_id"))
    if dials.no_nsfw:
        ok = ok & ~F.col("is_nsfw")
    return ok


def filtered(c: DataFrame, graph: Graph, dials: Dials) -> DataFrame:
    """All filters; the row-local ones come first, before any join."""
    return drop_own_and_blocked(drop_seen(c.where(allowed(dials)), graph), graph)


def positions(c: DataFrame, score: str = "score", per: str = "viewer_id") -> DataFrame:
    return c.withColumn("pos", F.row_number().over(Window.partitionBy(per).orderBy(F.col(score).desc(), "post_id")))


def thread_cap(c: DataFrame, score: str = "score", per: str = "viewer_id") -> DataFrame:
    """One post of each conversation: the best, earliest among equals, at the place of the first."""
    root = F.coalesce("root_id", "post_id")
    own = Window.partitionBy(per, "__root")
    c = c.withColumn("__root", root).withColumn("__w", F.row_number().over(own.orderBy(F.col(score).desc(), "pos"))).withColumn("__p", F.min("pos").over(own))
    return c.where("__w = 1").drop("pos", "__w", "__root").withColumnRenamed("__p", "pos")


def author_cap(c: DataFrame, most: int = PER_AUTHOR, per: str = "viewer_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(per, "author_id").orderBy("pos"))
    return c.withColumn("__a", rank).where(F.col("__a") <= most).drop("__a")


def dense_positions(c: DataFrame, per: str = "viewer_id") -> DataFrame:
    return c.withColumn("pos", F.row_number().over(Window.partitionBy(per).orderBy("pos")))


def listed(c: DataFrame) -> DataFrame:
    """dense_positions(author_cap(thread_cap(positions(c)))): in the order of scores the place of a conversation
    is that of its best post, so no row needs a position before the caps."""
    best = [F.col("score").desc(), "post_id"]
    first = F.row_number().over(Window.partitionBy("viewer_id", "__root").orderBy(*best))
    c = c.withColumn("__root", F.coalesce("root_id", "post_id")).withColumn("__w", first).where("__w = 1").drop("__w", "__root")
    rank = F.row_number().over(Window.partitionBy("viewer_id", "author_id").orderBy(*best))
    return positions(c.withColumn("__a", rank).where(F.col("__a") <= PER_AUTHOR).drop("__a"))


def interleave(c: DataFrame, per: str | None = None) -> DataFrame:
    """Positions that deal topics in rounds, best of each bucket first; input positions in pos."""
    keys = [per] if per else []
    c = c.withColumn("__b", S.topic_bucket(F.col("topic")))
    c = c.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("pos")))
    return c.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("__r", "__b"))).drop("__b", "__r")


def serendipity(c: DataFrame, ratio: float, per: str = "viewer_id") -> DataFrame:
    """Relabels the source of the last round(n * ratio) rows of a list, order unchanged."""
    n = F.count("*").over(Window.partitionBy(per))
    take = F.round(n * F.lit(ratio)).cast("int")
    tail = (n > 2) & (take > 0) & (take < n) & (F.col("pos") > n - take) & F.lit(ratio > 0)
    return c.withColumn("source", F.when(tail, "exploration_serendipity").otherwise(F.col("source")))


def start_of(cursor: str | None) -> int:
    """Offset of a decimal cursor, or of one in URL-safe base64; 0 for others."""
    if cursor is None:
        return 0
    for text in (cursor, None):
        try:
            if text is None:
                text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
            if text.removeprefix("+").isascii() and text.removeprefix("+").isdigit():
                return int(text)
        except ValueError:
            continue
    return 0


def page(c: DataFrame, limit: int, cursor: str | None = None, per: str = "viewer_id") -> DataFrame:
    """Rows of one page by pos, with next_cursor where more rows follow."""
    start, size = start_of(cursor), limit or 30
    n = F.count("*").over(Window.partitionBy(per))
    c = c.withColumn("next_cursor", F.when(n > start + size, F.lit(str(start + size))))
    return c.where(F.col("pos").between(start + 1, start + size))
