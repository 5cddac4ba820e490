"""Like-minded users of every viewer, what they share, and what they like."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.operators.graph import neighbours, user_posts
from kithgraph.schemas import EPOCH, TOPICS, Graph


def taste_twins(graph: Graph, limit: int = 10, viewers: DataFrame | None = None) -> DataFrame:
    limit = min(max(limit, 1), 50)
    return neighbours(graph, viewers, scanned=None, kept=limit, by_shared=True, seeded=False)


def shared_posts(graph: Graph, twins: DataFrame, most: int = 5) -> DataFrame:
    """The `most` lowest-numbered posts that each pair has in common."""
    posts = user_posts(graph.edges)
    both = twins.select("u", "v").join(posts.select(F.col("user_id").alias("u"), "post_id"), "u").join(posts.select(F.col("user_id").alias("v"), "post_id"), ["v", "post_id"])
    both = both.withColumn("n", F.row_number().over(Window.partitionBy("u", "v").orderBy("post_id"))).where(F.col("n") <= most)
    out = both.join(graph.meta.select("post_id", "author_id", "created_at"), "post_id", "left").join(graph.topics, "post_id", "left")
    return out.select("u", "v", "post_id", "n", "author_id", F.coalesce("created_at", F.lit(EPOCH).cast("long")).alias("created_at"), F.coalesce("topic", F.lit("general")).alias("topic"))


def interests(graph: Graph, twins: DataFrame, most: int = 3) -> DataFrame:
    """(u, v, interests): the commonest topics of shared_posts and of v's 20 lowest-numbered posts.

    Ties go to the earlier topic.  A user's own sample is counted once for all pairs it is in.
    """
    index = F.array_position(F.array(*(F.lit(t) for t in TOPICS)), F.col("topic"))
    own = user_posts(graph.edges).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("post_id"))).where("n <= 20")
    sample = own.join(graph.topics, "post_id", "left").groupBy(F.col("user_id").alias("v"), F.coalesce("topic", F.lit("general")).alias("topic")).agg(F.count("*").alias("c"))
    both = twins.select("u", "v").join(sample, "v").unionByName(shared_posts(graph, twins).groupBy("u", "v", "topic").agg(F.count("*").alias("c")))
    counts = both.groupBy("u", "v", "topic").agg(F.sum("c").alias("c"))
    ranked = counts.withColumn("n", F.row_number().over(Window.partitionBy("u", "v").orderBy(F.col("c").desc(), index))).where(F.col("n") <= most)
    return ranked.groupBy("u", "v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "topic"))), lambda x: x["topic"]), ",").alias("interests"))
