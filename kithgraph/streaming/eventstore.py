"""The graph's tables over a stream of frames: a merge-on-read store of events.

A batch appends its events as one delta, dealt to folders by kind and bucket, and commits it with
the slices' cursors in one step.  Tables are folded from the base and the deltas when they are
read, so events may come in any order; compaction folds what can no longer change.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kithgraph.schemas import EVENT_SCHEMA
from kithgraph.sources import frames
from kithgraph.streaming.deltas import DeltaTable
from kithgraph.streaming.streams import drained

#: Folders that the events of a kind are dealt to, and deltas from which a batch compacts the store.
BUCKETS, DELTAS = 64, 32
#: Fixed value: hours before now from which a replay starts at the earliest.
REPLAY_HOURS = 12
_COLUMNS = [c.split()[0] for c in EVENT_SCHEMA.split(", ")] + ["seq"]
#: Kinds whose last event counts; of the others it is the first.
_LAST = ("post", "delete")


def bucket(buckets: int) -> Column:
    """Folder of an event: by its post, or by its user where it has none."""
    return F.pmod(F.xxhash64(F.coalesce("post", "user")), F.lit(buckets)).cast("int")


def start_cursor(saved: int | None, now_us: int, hours: int = REPLAY_HOURS) -> int | None:
    """Cursor that a replay starts from: the saved one, but not more than `hours` ago; None is the live end."""
    oldest = max(0, now_us - hours * 3_600_000_000)
    if saved:
        return max(saved, oldest)
    return oldest if hours else None


class EventStore(DeltaTable):
    """Events below a folder.  `slices` names the streams that the low watermark waits for."""

    def __init__(self, spark: SparkSession, root: str, slices: Iterable[str] = (), buckets: int = BUCKETS):
        super().__init__(spark, root, f"{EVENT_SCHEMA}, seq long, bucket int", ["kind", "bucket"])
        self.slices, self.buckets = sorted(slices), buckets

    def state(self) -> dict:
        """As of any such table, with cursors (by slice) and watermark."""
        return {"cursors": {}, "watermark": 0, **super().state()}

    def watermark(self) -> int:
        """The low watermark: the least cursor of all slices, 0 until each has begun; it never falls."""
        return self.state()["watermark"]

    def start(self, now_us: int, hours: int = REPLAY_HOURS) -> int | None:
        return start_cursor(self.watermark(), now_us, hours)

    def _dealt(self, events: DataFrame) -> DataFrame:
        return events.select(*_COLUMNS).withColumn("bucket", bucket(self.buckets))

    def add(self, events: DataFrame, query: str, batch: int, cursors: dict[str, int] | None = None) -> bool:
        """Adds events (EVENT_SCHEMA, seq) and moves the slices' cursors; False if the batch was added before."""

        def moved(state: dict) -> dict:
            held = dict(state["cursors"])
            for s, c in (cursors or {}).items():
                held[s] = max(held.get(s, 0), c)
            low = min((held.get(s, 0) for s in self.slices or held), default=0)
            return {"cursors": held, "watermark": max(state["watermark"], low)}

        return self.append(self._dealt(events), query, batch, moved)

    def ingest(self, lines: DataFrame, checkpoint: str, seq: Column | None = None, compact_after: int = DELTAS) -> StreamingQuery:
        """Runs a stream of frames (value, and slice where there are several) into the store, and returns when done.

        Every frame moves its slice's cursor, also one without events.  seq orders events; by default
        it is time_us, and the part within a frame.  The query goes on from its checkpoint; a batch that
        is run again changes nothing.
        """
        order = F.col("time_us") * 2 + F.col("part") if seq is None else seq

        def apply(batch: DataFrame, n: int) -> None:
            named = batch if "slice" in batch.columns else batch.withColumn("slice", F.lit(""))
            seen = frames.heartbeat(named).groupBy("slice").agg(F.max("time_us").alias("cursor")).where("cursor > 0").collect()
            self.add(frames.parse(named).withColumn("seq", order), self.query_of(checkpoint), n, {r["slice"]: r["cursor"] for r in seen})
            if len(self.state()["data"]) > compact_after:
                self.compact(self.watermark() * 2 - 1 if seq is None else None)

        return drained(lines, apply, checkpoint)

    def tables(self) -> dict[str, DataFrame]:
        """edges, meta, follows and blocks as frames.folded() gives them for all events so far."""
        return frames.folded(self.rows())

    def of_posts(self, posts: list[str]) -> DataFrame:
        """Edges and metadata events of some posts, read from their buckets alone."""
        at = self.spark.createDataFrame([(p, None) for p in posts], "post string, user string").select("post", bucket(self.buckets).alias("bucket"))
        held = sorted({r["bucket"] for r in at.collect()})
        return self.rows().where(F.col("bucket").isin(held) & F.col("post").isin(*posts))

    def compact(self, settled: int | None = None) -> bool:
        """Rewrites the deltas so far as one base; those that come meanwhile stay.

        What a deletion has removed goes, and only the last deletion of a post stays; of equal follows
        and blocks the first one stays.  `settled`: no event with a seq up to this one is still to
        come; then a later deletion removes all such interactions with a post or none, so only the first
        of equal ones is kept, the last metadata, and no deletion.
        """
        names = self.state()["data"]
        if len(names) < 2 and settled is None:
            return False
        rows = self.rows(names=names)
        gone = rows.where((F.col("kind") == "delete") & F.col("post").contains(f"/{frames.POST}/")).groupBy(F.col("post").alias("__p")).agg(F.max("seq").alias("__gone"))
        acts = F.col("kind").isin("interaction", "post")
        held = rows.where(acts).join(gone, F.col("post") == F.col("__p"), "left").where(F.col("__gone").isNull() | (F.col("seq") > F.col("__gone"))).drop("__p", "__gone").unionByName(rows.where(~acts))
        last, open_ = F.col("kind").isin(*_LAST), acts & (F.col("seq") > (-1 if settled is None else settled))
        keys = {"user": F.when(~last, F.col("user")), "post": F.col("post"), "other": F.col("other"), "signal": F.col("signal"), "seq": F.when(open_, F.col("seq"))}
        first = F.struct(F.when(last, -F.col("seq")).otherwise(F.col("seq")).alias("order"), *_COLUMNS)
        kept = held.groupBy(F.col("kind").alias("__kind"), *(v.alias(f"__k_{k}") for k, v in keys.items())).agg(F.min(first).alias("row")).select("row.*")
        if settled is not None:
            kept = kept.where((F.col("kind") != "delete") | (F.col("seq") > settled))
        return self.swap(names, self._dealt(kept))


def united(lines: dict[str, DataFrame]) -> DataFrame:
    """Streams of frames as one, with their names in `slice`."""
    return reduce(DataFrame.unionByName, (df.withColumn("slice", F.lit(name)) for name, df in lines.items()))
