"""Impression history and the fatigue that follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.functions import scalars as S
from kithgraph.schemas import CEILING, FATIGUE_WINDOW, IMPRESSION_COUNT, IMPRESSION_ENTRIES


def state(log: DataFrame) -> DataFrame:
    """(viewer_id, post_id, last_served, count) from an append-only log.

    Only a viewer's newest IMPRESSION_ENTRIES entries count.  A gap of FATIGUE_WINDOW and more
    starts a new run; count is the length of the last run, at most IMPRESSION_COUNT.
    """
    newest = F.row_number().over(Window.partitionBy("viewer_id").orderBy(F.col("seq").desc()))
    log = log.withColumn("__r", newest).where(F.col("__r") <= IMPRESSION_ENTRIES)
    pair = Window.partitionBy("viewer_id", "post_id").orderBy("seq")
    before = F.lag("served_at").over(pair)
    fresh = (before.isNull() | (F.abs(F.col("served_at") - before) >= FATIGUE_WINDOW)).cast("int")
    runs = log.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    by_run = runs.groupBy("viewer_id", "post_id", "run").agg(F.count("*").alias("c"), F.max(F.struct("seq", "served_at")).alias("l"))
    last = by_run.groupBy("viewer_id", "post_id").agg(F.max(F.struct("run", "c", "l")).alias("x"))
    return last.select("viewer_id", "post_id", F.col("x.l.served_at").alias("last_served"), F.least(F.col("x.c"), F.lit(IMPRESSION_COUNT)).alias("count"))


def damped(candidates: DataFrame, history: DataFrame, now: int) -> DataFrame:
    """candidates (viewer_id, post_id, score) with mult, scale and damped score.

    mult is the compounded fatigue, 1 for unseen posts.  Seen posts are scaled further where the
    best of them would reach CEILING of the least positive unseen score; both extrema are
    aggregates over a viewer's whole list.
    """
    h = history.select("viewer_id", "post_id", "last_served", F.col("count").alias("served"))
    return scaled(candidates.join(h, ["viewer_id", "post_id"], "left"), now)


def scaled(c: DataFrame, now: int) -> DataFrame:
    """damped() of candidates that bring last_served and served, how often, along."""
    c = c.withColumn("mult", F.coalesce(S.compounded_fatigue(F.lit(now) - F.col("last_served"), F.col("served")), F.lit(1.0))).drop("last_served", "served")
    whole = Window.partitionBy("viewer_id")
    least = F.min(F.when((F.col("mult") >= 1) & (F.col("score") > 0), F.col("score"))).over(whole)
    most = F.max(F.when(F.col("mult") < 1, F.col("score") * F.col("mult"))).over(whole)
    c = c.withColumns({"__u": least, "__f": most})
    scale = F.when((F.col("__f") >= CEILING * F.col("__u")) & (F.col("__f") > 0), CEILING * F.col("__u") / F.col("__f")).otherwise(1.0)
    c = c.withColumn("scale", scale)
    return c.withColumn("damped", F.when(F.col("mult") < 1, F.col("score") * F.col("mult") * F.col("scale")).otherwise(F.col("score"))).drop("__u", "__f")


def live(history: DataFrame, now: int) -> DataFrame:
    """State without posts last served FATIGUE_WINDOW and more before now, which weigh nothing any more."""
    return history.where(F.col("last_served") > now - FATIGUE_WINDOW)
