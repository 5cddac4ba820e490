"""Graphs over the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions.scalars import choose
from kithgraph.operators.graph import distinct_edges
from kithgraph.schemas import TOPICS, Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it has fewer splits, as a small file has before heavy parsing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def _derived(raw: DataFrame, users: DataFrame, n_users: Column, posts: DataFrame, authors: int, impressions: DataFrame) -> Graph:
    p = F.col("post_id")
    root = F.when(p % 5 != 0, p - p % 5)
    meta = posts.select(p, (p % authors).alias("author_id"), root.alias("root_id"), F.when(p % 5 == 4, root).alias("parent_id"), F.lit(1_700_000_000).cast("long").alias("created_at"), (p % 11 == 0).alias("is_nsfw"))
    topics = posts.select(p, choose((p % 6).cast("int"), dict(enumerate(TOPICS))).alias("topic"))
    u = F.col("user_id")
    numbered = users.crossJoin(F.broadcast(n_users)) if isinstance(n_users, DataFrame) else users.withColumn("n", n_users)
    follows = numbered.select(u.alias("follower_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("f"), "n").select("follower_id", ((F.col("follower_id") + 100 * F.col("f")) % F.col("n")).alias("followed_id"), F.col("f").cast("long").alias("seq"))
    follows = follows.groupBy("follower_id", "followed_id").agg(F.min("seq").alias("seq"))
    blocks = numbered.where(u % 17 == 3).select(u.alias("blocker_id"), F.explode(F.array((u + 7) % F.col("n"), u % 40)).alias("blocked_id")).distinct()
    return Graph(raw, distinct_edges(raw), meta, topics, users, follows, blocks, impressions)


def dense(spark: SparkSession, sf_dir: str) -> Graph:
    """Users and the numbers in props of `events`; views are impressions, other kinds are signals."""
    events = read(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("post_id"), "event_type", seconds("ts").alias("ts"), "event_id")
    signal = choose(F.col("event_type"), {"click": 1, "signup": 2, "purchase": 3})
    raw = events.where(F.col("event_type").isin("click", "signup", "purchase")).select("user_id", "post_id", signal.alias("signal"), "ts", (F.col("event_id") * 4 + signal).alias("seq"))
    seen = events.where("event_type = 'view'").select(F.col("user_id").alias("viewer_id"), "post_id", F.col("ts").alias("served_at"), F.col("event_id").alias("seq"))
    users = events.select("user_id").distinct()
    n = users.agg((F.max("user_id") + 1).alias("n"))
    return _derived(raw, users, n, events.select("post_id").distinct(), 15, seen)


def sparse(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and the parts of all their order lines; a calendar day is compressed to a minute."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    signal = choose(F.col("l_returnflag"), {"N": 1, "A": 2, "R": 3})
    seq = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 4 + signal
    raw = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("post_id"), signal.alias("signal"),
        (F.lit(1_700_000_000) + 60 * F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1995-01-01")))).cast("long").alias("ts"), seq.alias("seq"),
    )
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    n = users.agg((F.max("user_id") + 1).alias("n"))
    posts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("post_id"))
    graph = _derived(raw, users, n, posts, 40, raw.select("user_id", "post_id", "ts", "seq"))
    from pyspark.sql import Window

    latest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("seq").desc()))
    now = graph.edges.agg(F.max("ts").alias("now"))
    last = graph.edges.withColumn("rn", latest).where("rn <= 20").crossJoin(F.broadcast(now)).crossJoin(F.broadcast(n))
    graph.impressions = last.select(((F.col("user_id") - 1 + F.col("n")) % F.col("n")).alias("viewer_id"), "post_id", (F.col("now") - 600 * F.col("rn")).alias("served_at"), (-F.col("rn")).cast("long").alias("seq"))
    return graph
