"""Tables that grow by committed deltas: each batch of a query counts once, readers see whole versions."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from kithgraph.sources.commits import Conflict, Log

#: Versions whose entries vacuum() leaves.
KEPT_VERSIONS = 50


class DeltaTable:
    """Parquet folders below `root`, of which the newest version of a commit log names those that count.

    `schema` includes the partition columns, by which a delta's rows are dealt to folders.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, partition: Iterable[str] = ()):
        self.spark, self.root, self.log = spark, root.rstrip("/"), Log(spark, root)
        self.schema, self.partition = schema, list(partition)

    def state(self) -> dict:
        """The newest version: data (folders), applied and last (the last batch of each query and its
        folder), and what a table adds."""
        version, entry = self.log.latest()
        return {"data": [], "applied": {}, "last": {}, **entry, "version": version}

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Commits change(state) on top of the newest version, again if another writer was faster.

        change returns None where there is nothing to do.
        """
        while True:
            state = self.state()
            new = change(dict(state))
            if new is None:
                return False
            new |= {"version": state["version"] + 1, "at": time.time()}
            try:
                self.log.commit(new["version"], new)
            except Conflict:
                continue
            return True

    def _written(self, rows: DataFrame) -> str:
        """A new folder with the rows; the rebalancing hint lets the engine split a folder that one key fills."""
        name = f"data/delta={uuid.uuid4().hex}"
        dealt = rows.hint("rebalance", *self.partition) if self.partition else rows
        dealt.write.partitionBy(*self.partition).parquet(f"{self.root}/{name}")
        return name

    def applied(self, query: str, batch: int) -> bool:
        return self.state()["applied"].get(query, -1) >= batch

    def append(self, rows: DataFrame, query: str, batch: int, more: Callable[[dict], dict] | None = None, onto: list[str] | None = None) -> bool | None:
        """Adds rows as batch number `batch` of a query; False if it was added before.

        more(state) gives further entries of the version.  Rows made from a version's folders name
        them in `onto`; None is returned, and nothing added, if other folders count by now.
        """
        if self.applied(query, batch):
            return False
        name, stale = self._written(rows), []

        def change(state: dict) -> dict | None:
            stale[:] = [True] if onto is not None and state["data"] != onto else []
            if stale or state["applied"].get(query, -1) >= batch:
                return None
            return state | {"data": [*state["data"], name], "applied": state["applied"] | {query: batch}, "last": state["last"] | {query: name}} | (more(state) if more else {})

        added = self._commit(change)
        return None if stale else added

    def rows(self, version: int | None = None, names: list[str] | None = None) -> DataFrame:
        """All rows of a version, the newest by default, or of some folders."""
        if names is None:
            names = self.state()["data"] if version is None else self.log.read(version)["data"]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        own = self.spark.read.schema(f"{self.schema}, delta string").option("basePath", f"{self.root}/data")
        return own.parquet(*(f"{self.root}/{n}" for n in names)).drop("delta")

    def last(self, query: str) -> DataFrame:
        """Rows of a query's last batch."""
        return self.rows(names=[self.state()["last"][query]])

    def swap(self, names: list[str], rows: DataFrame) -> bool:
        """Puts rows in the place of some folders; folders that come meanwhile stay."""
        name = self._written(rows)

        def change(state: dict) -> dict | None:
            if not set(names) <= set(state["data"]):
                return None
            return state | {"data": [name, *(n for n in state["data"] if n not in set(names))]}

        return self._commit(change)

    def vacuum(self) -> list[str]:
        """Deletes folders that the newest version doesn't name, and entries of old versions.

        No other writer may be at work, as its folder isn't named before it commits.
        """
        state = self.state()
        held = {n.split("/")[1] for n in [*state["data"], *state["last"].values()]}
        old = [n for n in self.log.files.names(f"{self.root}/data") if n not in held]
        for n in old:
            self.log.files.delete(f"{self.root}/data/{n}")
        for v in self.log.versions()[:-KEPT_VERSIONS]:
            self.log.files.delete(f"{self.log.folder}/{v:020d}.json")
        return old

    def query_of(self, checkpoint: str) -> str:
        """The id of the streaming query that a checkpoint belongs to, the same after a restart."""
        return json.loads(self.log.files.read(f"{checkpoint}/metadata"))["id"]
