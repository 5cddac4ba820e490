"""Saved dials of users as an append-only table of changes."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.plans.dials import Dials, from_row, saved_after, to_row
from kithgraph.streaming.deltas import DeltaTable

SCHEMA = "user_id long, half_life_s double, explore double, art double, tech double, science double, news double, culture double, include_replies boolean, no_nsfw boolean, min_likes int, deleted boolean, seq long, bucket int"


class DialStore(DeltaTable):
    """Each user's last change counts.  One user's dials are read from one bucket."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        super().__init__(spark, root, SCHEMA, ["bucket"])
        self.buckets = buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col("user_id").cast("long")), F.lit(self.buckets)).cast("int")

    def record(self, changes: DataFrame) -> None:
        """Appends changes (SCHEMA without bucket) of many users; invalid ones never count."""
        name = self._written(changes.select(*[c.split()[0] for c in SCHEMA.split(", ")[:-1]]).withColumn("bucket", self._bucket()))
        self._commit(lambda state: state | {"data": [*state["data"], name]})

    def _one(self, row: dict, deleted: bool) -> None:
        full = row | {"deleted": deleted, "seq": time.time_ns()}
        plain = SCHEMA.rsplit(", ", 1)[0]
        self.record(self.spark.createDataFrame([tuple(full[c.split()[0]] for c in plain.split(", "))], plain))

    def set(self, user_id: int, dials: Dials) -> None:
        """Saves dials; ValueError where they can't be saved."""
        self._one(to_row(user_id, dials), False)

    def delete(self, user_id: int) -> bool:
        """Forgets a user's dials; whether there were any."""
        known = self.get(user_id) is not None
        if known:
            self._one(to_row(user_id, Dials()), True)
        return known

    def get(self, user_id: int) -> Dials | None:
        at = self.spark.range(1).select(F.lit(user_id).alias("user_id")).select(self._bucket()).first()[0]
        found = saved_after(self.rows().where((F.col("bucket") == at) & (F.col("user_id") == user_id)).drop("bucket")).first()
        return from_row(found.asDict()) if found else None

    def get_or_default(self, user_id: int) -> Dials:
        return self.get(user_id) or Dials()

    def saved(self) -> DataFrame:
        """(user_id and its dials) of all users that have any."""
        return saved_after(self.rows().drop("bucket"))

    def count(self) -> int:
        return self.saved().count()

    def clear(self) -> None:
        self._commit(lambda state: state | {"data": []})

    def compact(self) -> bool:
        """Leaves the last valid change of each user that isn't a deletion."""
        names = self.state()["data"]
        last = saved_after(self.rows(names=names).drop("bucket").withColumn("at", F.col("seq")))
        return len(names) > 1 and self.swap(names, last.withColumns({"deleted": F.lit(False), "seq": F.col("at"), "bucket": self._bucket()}).select(*[c.split()[0] for c in SCHEMA.split(", ")]))
