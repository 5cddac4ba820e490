"""Versioned Parquet snapshots of a graph; a version counts once its entry is in the commit log."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.schemas import Graph
from kithgraph.sources.commits import Conflict, Log


#: Fixed value: seconds between two saves of a service.
INTERVAL = 14_400


class DamagedSnapshot(Exception):
    """A table's rows or checksum differ from the manifest."""


def scratch(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or the session's checkpoint folder; a temporary one only for a local session."""
    found, given = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and given.isDefined():
        found = given.get()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    return (found or tempfile.mkdtemp(prefix="graph-")).rstrip("/")


#: Shuffle files of a query are removed when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df, computed once into a table of the shared folder; nothing of what it took stays on disk."""
    spark, path = df.sparkSession, f"{scratch(df.sparkSession)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


def shared(graph: Graph, impressions: bool = True) -> Graph:
    """graph with its edges, and impressions if asked for, written once, for plans that read them many times."""
    return replace(graph, edges=written(graph.edges), **({"impressions": written(graph.impressions)} if impressions else {}))


def _facts(df: DataFrame, name: str) -> DataFrame:
    """Name, rows and an order-independent checksum."""
    h = F.xxhash64(*(F.col(c).cast("string") for c in sorted(df.columns)), F.lit(1))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)).alias("checksum")).select(F.lit(name).alias("name"), "rows", "checksum")


def save(graph: Graph, root: str, cursor: int = 0, sections: dict[str, DataFrame] | None = None, onto: int | None = None) -> int:
    """Writes all tables, then commits the version with the stream cursor; returns the version.

    `sections` are further tables of the version, such as a dictionary or saved dials.  `onto` is the
    version that the graph was made from, by default the newest at the start: if another one is
    committed meanwhile, that one stays and Conflict is raised, whose writer may load and try again.
    """
    spark, began = graph.edges.sparkSession, time.time()
    tables = {f.name: getattr(graph, f.name) for f in fields(Graph)}
    if clash := tables.keys() & (sections or {}).keys():
        raise ValueError(f"{sorted(clash)} are tables of the graph")
    log = Log(spark, root)
    onto = log.latest()[0] if onto is None else onto
    folder, facts = f"data/{uuid.uuid4().hex}", None
    for name, df in {**tables, **(sections or {})}.items():
        path = f"{root}/{folder}/{name}"
        df.write.parquet(path)
        own = _facts(spark.read.parquet(path), name)
        facts = own if facts is None else facts.unionByName(own)
    known = {r["name"]: {"rows": r["rows"], "checksum": r["checksum"]} for r in facts.collect()}
    entry = {"folder": folder, "tables": known, "cursor": cursor, "saved_at": time.time(), "save_seconds": time.time() - began, "bytes": log.files.size(f"{root}/{folder}")}
    if log.latest()[0] != onto:
        raise Conflict(f"{root} has a version above {onto}")
    return log.commit(onto + 1, entry)


def status(spark: SparkSession, root: str) -> DataFrame:
    """One row for each version: when, with which cursor, how large, and in how long it was saved."""
    log = Log(spark, root)
    rows = [(v, e["cursor"], e["saved_at"], sum(t["rows"] for t in e["tables"].values()), e["bytes"], float(e["save_seconds"])) for v in log.versions() for e in [log.read(v)]]
    out = spark.createDataFrame(rows, "version long, cursor long, at double, rows long, bytes long, save_seconds double")
    return out.select("version", "cursor", F.timestamp_seconds("at").alias("saved_at"), "rows", "bytes", "save_seconds")


def _checked(spark: SparkSession, root: str, version: int | None, names: list[str]) -> tuple[dict[str, DataFrame], int]:
    """Tables of a version, the latest by default, that agree with its entry, and its cursor."""
    log = Log(spark, root)
    entry = log.read(version) if version else log.latest()[1]
    known, tables = entry.get("tables", {}), {}
    for name in names:
        if name not in known:
            raise DamagedSnapshot(f"version {version or 'the newest'} has no {name}")
        tables[name] = spark.read.option("mergeSchema", "true").parquet(f"{root}/{entry['folder']}/{name}")
        found = _facts(tables[name], name).first()
        if (found["rows"], found["checksum"]) != (known[name]["rows"], known[name]["checksum"]):
            raise DamagedSnapshot(f"{name} of version {version or 'the newest'}")
    return tables, entry["cursor"]


def load(spark: SparkSession, root: str, version: int | None = None) -> tuple[Graph, int]:
    """The graph and cursor of a version; columns that an older version lacks are null."""
    tables, cursor = _checked(spark, root, version, [f.name for f in fields(Graph)])
    return Graph(**tables), cursor


def section(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A further table of a version."""
    return _checked(spark, root, version, [name])[0][name]


class Snapshots:
    """The snapshots below a folder with what a service reports of them.

    state is "clean" where there is none, "persisted" where there is one or after a save,
    "hydrated" after a load, and "error: ..." after a save or load that failed.
    """

    def __init__(self, spark: SparkSession, root: str, interval: int = INTERVAL):
        self.spark, self.root, self.interval = spark, root, interval
        self.state = "persisted" if Log(spark, root).versions() else "clean"
        self.load_seconds = self.save_seconds = 0.0
        self.used_at = 0.0

    def _noted(self, state: str, run: Callable[[], object]) -> tuple[object, float]:
        began = time.time()
        try:
            out = run()
        except Exception as e:
            self.state = f"error: {e}"
            raise
        self.state, self.used_at = state, time.time()
        return out, self.used_at - began

    def save(self, graph: Graph, cursor: int = 0, sections: dict[str, DataFrame] | None = None, onto: int | None = None) -> int:
        version, self.save_seconds = self._noted("persisted", lambda: save(graph, self.root, cursor, sections, onto))
        return version

    def load(self, version: int | None = None) -> tuple[Graph, int]:
        found, self.load_seconds = self._noted("hydrated", lambda: load(self.spark, self.root, version))
        return found

    def status(self) -> dict:
        """State, seconds since the last save or load of this process, durations, size and version."""
        version, entry = Log(self.spark, self.root).latest()
        ago = int(time.time() - self.used_at) if self.used_at else 0
        return {
            "status": self.state, "last_saved_secs": int(self.used_at), "last_saved_ago_secs": ago, "last_load_duration_ms": 1000 * self.load_seconds, "last_save_duration_ms": 1000 * self.save_seconds,
            "interval_secs": self.interval, "file_path": self.root, "file_size_bytes": entry.get("bytes", 0), "format_version": version,
        }
