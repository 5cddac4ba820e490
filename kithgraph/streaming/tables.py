"""Streamed tables of the graph: distinct edges in buckets, velocity from partial sums, and the impression log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions import scalars as S
from kithgraph.operators.graph import distinct_edges, ranked_pool
from kithgraph.schemas import POOL, VELOCITY_WINDOW
from kithgraph.streaming.deltas import DeltaTable

#: Folders that edges and impressions are dealt to, and deltas from which a batch compacts its table.
BUCKETS, DELTAS = 256, 32
#: Fixed value: seconds for which a pool is used again.
POOL_TTL = 10
KEYS = ["user_id", "post_id", "signal"]
DAY = 86_400


class EdgeTable(DeltaTable):
    """Edges of which the first by seq counts; what a batch brings is compared with the buckets of its own keys alone.

    n is 1 for an edge that came, and -1 for one that gave way to an earlier one, so that sums
    over a table's rows, or over a batch's, are those of distinct edges.
    """

    def __init__(self, spark: SparkSession, root: str, ids: str = "long", buckets: int = BUCKETS):
        super().__init__(spark, root, f"user_id {ids}, post_id {ids}, signal int, ts long, seq long, n int, bucket int", ["bucket"])
        self.buckets = buckets

    def _dealt(self, edges: DataFrame) -> DataFrame:
        return edges.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)).cast("int"))

    @staticmethod
    def _first(rows: DataFrame) -> DataFrame:
        first = F.min(F.when(F.col("n") > 0, F.struct("seq", "ts"))).alias("f")
        return rows.groupBy("bucket", *KEYS).agg(first).where("f IS NOT NULL").select("bucket", *KEYS, F.col("f.ts").alias("ts"), F.col("f.seq").alias("seq"))

    def edges(self) -> DataFrame:
        """(KEYS, ts, seq), each key once."""
        return self._first(self.rows()).select(*KEYS, "ts", "seq")

    def changes(self, batch: DataFrame, names: list[str]) -> DataFrame:
        """Rows for a batch's edges that the folders of `names` don't hold or hold only later by seq.

        The list of buckets that is looked into has `buckets` entries at most.
        """
        fresh = self._dealt(distinct_edges(batch))
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
        held = self._first(self.rows(names=names).where(F.col("bucket").isin(touched))).withColumnsRenamed({"ts": "__ts", "seq": "__seq"})
        better = fresh.join(held, ["bucket", *KEYS], "left").where("__seq IS NULL OR seq < __seq")
        both = F.array(F.struct("ts", "seq", F.lit(1).alias("n")), F.when(F.col("__seq").isNotNull(), F.struct(F.col("__ts").alias("ts"), F.col("__seq").alias("seq"), F.lit(-1).alias("n"))))
        return better.select(*KEYS, F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x"), "bucket").select(*KEYS, "x.ts", "x.seq", "x.n", "bucket")

    def add(self, batch: DataFrame, query: str, n: int) -> bool:
        """Adds a batch's edges (KEYS, ts, seq), whatever their time; False if the batch was added before."""
        while not self.applied(query, n):
            names = self.state()["data"]
            added = self.append(self.changes(batch, names), query, n, onto=names)
            if added is not None:
                return added
        return False

    def compact(self) -> bool:
        """Rewrites the deltas so far as one folder for each bucket, without edges that gave way."""
        names = self.state()["data"]
        return len(names) > 1 and self.swap(names, self._first(self.rows(names=names)).select(*KEYS, "ts", "seq", F.lit(1).alias("n"), "bucket"))


class VelocityTable(DeltaTable):
    """Weights and counts of edges by post and second, for pools at times around the newest edge.

    Compaction leaves a post's count of all seconds more than two windows old as one row, so the
    table is as large as the posts and two windows' seconds.
    """

    def __init__(self, spark: SparkSession, root: str, ids: str = "long"):
        super().__init__(spark, root, f"post_id {ids}, ts long, weight double, n long, day long", ["day"])

    def now(self) -> int:
        """High-water mark of event time."""
        return self.state().get("now", 0)

    def add(self, changes: DataFrame, query: str, n: int) -> bool:
        """Adds edges (post_id, signal, ts, n) as EdgeTable has them; they may be late."""
        newest = changes.agg(F.max("ts")).first()[0] or 0
        sums = changes.groupBy("post_id", "ts").agg(F.sum(S.weight(F.col("signal")) * F.col("n")).alias("weight"), F.sum("n").alias("n"))
        return self.append(sums.withColumn("day", F.floor(F.col("ts") / DAY)), query, n, lambda state: {"now": max(state.get("now", 0), newest)})

    def pool(self, now: int | None = None, limit: int = POOL) -> DataFrame:
        """(post_id, score, rank) as graph.velocity() gives them at `now`.

        Only the window's days are read for weights; counts of the posts there, for their social
        proof, come from two columns of the rest.
        """
        now = self.now() if now is None else now
        rows, start = self.rows(), now - VELOCITY_WINDOW
        inside = rows.where(F.col("day").between(start // DAY, now // DAY) & F.col("ts").between(start, now))
        decayed = inside.groupBy("post_id", "ts").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).where("n > 0")
        decayed = decayed.groupBy("post_id").agg(F.sum(F.col("weight") * F.exp((F.col("ts") - now) / float(VELOCITY_WINDOW))).alias("d"))
        degree = rows.join(decayed.select("post_id"), "post_id", "left_semi").groupBy("post_id").agg(F.sum("n").alias("degree"))
        scored = decayed.join(degree, "post_id").select("post_id", F.round(F.col("d") * S.social_proof(F.col("degree")), 6).alias("score"))
        return ranked_pool(scored, limit)

    def compact(self) -> bool:
        """Adds equal seconds up, and of each post all seconds that no later window reaches."""
        names, start = self.state()["data"], self.now() - 2 * VELOCITY_WINDOW
        inside = F.col("ts") >= start
        kept = self.rows(names=names).select("post_id", F.when(inside, F.col("ts")).alias("ts"), F.when(inside, F.col("weight")).otherwise(0.0).alias("weight"), "n")
        sums = kept.groupBy("post_id", "ts").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).where("n <> 0")
        return len(names) > 1 and self.swap(names, sums.withColumn("day", F.coalesce(F.floor(F.col("ts") / DAY), F.lit(-1))))


class PoolMemo:
    """The last pool, used again for POOL_TTL seconds; a clock before it, or an empty pool, isn't."""

    def __init__(self, table: VelocityTable, ttl: int = POOL_TTL):
        self.table, self.ttl, self.at, self.held = table, ttl, 0, []

    def get(self, now: int) -> list[tuple]:
        """Rows (post_id, score, rank) of the pool at `now`: a fixed number of them."""
        if not (self.held and 0 <= now - self.at < self.ttl):
            found = [tuple(r) for r in self.table.pool(now).orderBy("rank").collect()]
            if not found:
                return []
            self.at, self.held = now, found
        return self.held


def velocity_batches(edges: EdgeTable, velocity: VelocityTable, checkpoint: str, sink: Callable[[int, DataFrame], None], compact_after: int = DELTAS, clock: Callable[[], int] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: new edges, then their sums, then sink(batch, pool).

    The pool is that of clock(), by default of the newest edge that has come, which never goes back.
    A batch that is run again, from whichever step on, adds nothing twice.
    """

    def apply(batch: DataFrame, n: int) -> None:
        query = edges.query_of(checkpoint)
        edges.add(batch, query, n)
        velocity.add(edges.last(query), query, n)
        sink(n, velocity.pool(clock() if clock else None))
        for table in (edges, velocity):
            if len(table.state()["data"]) > compact_after:
                table.compact()

    return apply


def impression_seq(served_at: Column, request: Column, pos: Column) -> Column:
    """Arrival order of an impression by time, request and position, without a look at others."""
    return F.shiftleft(served_at.cast("long"), 20) + F.pmod(F.xxhash64(request), F.lit(1024)) * 1024 + pos.cast("long")


class ImpressionLog(DeltaTable):
    """Append-only impressions; a request that is recorded again counts once."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        super().__init__(spark, root, "request string, viewer_id long, post_id long, served_at long, pos int, bucket int", ["bucket"])
        self.buckets = buckets

    def record(self, rows: DataFrame) -> None:
        """Appends rows (request, viewer_id, post_id, served_at, pos) of one request or many."""
        name = self._written(rows.select("request", "viewer_id", "post_id", F.col("served_at").cast("long"), F.col("pos").cast("int")).withColumn("bucket", F.pmod(F.xxhash64("viewer_id"), F.lit(self.buckets)).cast("int")))
        self._commit(lambda state: state | {"data": [*state["data"], name]})

    def once(self) -> DataFrame:
        """The rows with each post of a viewer's request once, as it was recorded first."""
        first = F.min(F.struct("served_at", "pos")).alias("f")
        return self.rows().groupBy("bucket", "viewer_id", "request", "post_id").agg(first).select("request", "viewer_id", "post_id", "f.served_at", "f.pos", "bucket")

    def impressions(self) -> DataFrame:
        """(viewer_id, post_id, served_at, seq) for a graph's history."""
        return self.once().select("viewer_id", "post_id", "served_at", impression_seq(F.col("served_at"), F.col("request"), F.col("pos")).alias("seq"))

    def compact(self) -> bool:
        names = self.state()["data"]
        return len(names) > 1 and self.swap(names, self.once())
