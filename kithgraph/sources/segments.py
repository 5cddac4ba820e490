"""A data source of landed frames: segments by slice and time, read in batches or as a stream with cursors for offsets.

A slice is a folder; a segment is a file of JSON lines in order of time_us, named by the first and
last of them.  A stream's offset is one cursor for each slice, so a query can begin at any time
and goes on where it stopped, each frame once; a frame's slice is a column.  Every trigger reads a
slice in one task, and as many slices at once as there are.  All nodes must be able to open the folder.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "value string, time_us long, slice string"
NAME = re.compile(r"^(\d+)-(\d+)-\w+\.jsonl$")


def local(path: str) -> str:
    """A path that open() takes; other stores than a mounted folder are refused."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"segments need a folder that all nodes have mounted, not {path}")
    return unquote(parts.path) if parts.scheme else path


def cursor_of(line: str) -> int | None:
    """time_us of a frame, also of one without events; None for what is no frame."""
    try:
        found = json.loads(line)
        return int(found["time_us"]) if isinstance(found, dict) else None
    except (ValueError, KeyError, TypeError):
        return None


@dataclass
class Span(InputPartition):
    """Segments of one slice and the cursors between which their frames are wanted: above low, up to high."""

    slice: str
    files: list[str]
    low: int
    high: int


class Segments:
    """Names of the segments below a folder."""

    def __init__(self, options: dict):
        self.root = local(options["path"])
        wanted = [s for s in options.get("slices", "").split(",") if s]
        self.wanted, self.start = wanted, int(options.get("start", 0))

    def slices(self) -> list[str]:
        found = sorted(n for n in os.listdir(self.root) if not n.startswith((".", "_"))) if os.path.isdir(self.root) else []
        return self.wanted or found

    def files(self, name: str) -> list[tuple[int, int, str]]:
        """(first, last, file) of a slice's segments by their last cursor."""
        folder = f"{self.root}/{name}"
        found = [(m, n) for n in (os.listdir(folder) if os.path.isdir(folder) else []) if (m := NAME.match(n))]
        return sorted((int(m[1]), int(m[2]), f"{folder}/{n}") for m, n in found)

    def span(self, name: str, low: int, high: int) -> Span:
        return Span(name, [f for first, last, f in self.files(name) if last > low and first <= high], low, high)

    @staticmethod
    def read(part: Span) -> Iterator[tuple[str, int, str]]:
        """Frames of a span; lines without a time_us come with that of the frame before them."""
        for file in part.files:
            at = None
            with open(file, encoding="utf-8") as f:
                for line in f:
                    line = line.rstrip("\n")
                    own = cursor_of(line)
                    at = own if own is not None else at
                    if line and at is not None and part.low < at <= part.high:
                        yield line, at, part.slice


class Reader(Segments, DataSourceReader):
    """All frames of the slices from the cursor `start` on."""

    def partitions(self) -> list[Span]:
        return [self.span(s, self.start - 1, 1 << 62) for s in self.slices()]


class StreamReader(Segments, DataSourceStreamReader):
    """Frames by cursor.

    The source isn't told where a restarted query stands, so an offset is only what the segments' names
    say; the newest segment of a slice must stay, and segments of a slice must land in order of time.
    """

    def initialOffset(self) -> dict:
        return {s: self.start - 1 for s in self.slices()}

    def latestOffset(self) -> dict:
        """The cursor of each slice's newest segment."""
        return {s: max([self.start - 1, *(last for _, last, _ in self.files(s))]) for s in self.slices()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        """One task for each slice that has moved."""
        lows = {s: start.get(s, self.start - 1) for s in end}
        return [self.span(s, lows[s], high) for s, high in sorted(end.items()) if high > lows[s]]

    def commit(self, end: dict) -> None:
        """Nothing is held back for a batch that is done."""


@dataclass
class Landed(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    """Lands rows (value, slice), in order of time within a task, as one segment for each slice and task.

    Segments are written under hidden names and get their own when all tasks are done.
    """

    def __init__(self, options: dict):
        self.root = local(options["path"])

    def write(self, iterator: Iterator) -> Landed:
        held: dict[str, list] = {}
        for row in iterator:
            at = cursor_of(row["value"])
            if row["slice"] not in held:
                folder = f"{self.root}/{row['slice']}"
                os.makedirs(folder, exist_ok=True)
                hidden = f"{folder}/.{uuid.uuid4().hex}"
                held[row["slice"]] = [folder, hidden, open(hidden, "w", encoding="utf-8"), None, None]  # noqa: SIM115
            own = held[row["slice"]]
            if at is not None:
                if own[4] is not None and at < own[4]:
                    raise ValueError(f"frames of slice {row['slice']} aren't in order of time")
                own[3:5] = own[3] if own[3] is not None else at, at
            own[2].write(row["value"].replace("\n", " ") + "\n")
        for own in held.values():
            own[2].close()
        return Landed([(hidden, f"{folder}/{first}-{last}-{os.path.basename(hidden)[1:]}.jsonl") for folder, hidden, _, first, last in held.values() if first is not None])

    def commit(self, messages: list[Landed | None]) -> None:
        """Segments appear in order of time, so a stream that looks meanwhile sees none before an earlier one."""
        files = [f for m in messages if m for f in m.files]
        for hidden, name in sorted(files, key=lambda f: int(NAME.match(os.path.basename(f[1]))[1])):
            os.rename(hidden, name)

    def abort(self, messages: list[Landed | None]) -> None:
        for hidden, _ in (f for m in messages if m for f in m.files):
            os.unlink(hidden)


class FrameSource(DataSource):
    """Format "frames": options path, slices (comma-separated), start (cursor)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def land(lines: DataFrame, path: str, tasks: int = 8) -> None:
    """Lands frames (value, slice) below a folder: each task takes a range of time, which a hot slice shares out too.

    Frames without a time_us are left out, as no cursor reaches them.
    """
    from kithgraph.sources.frames import heartbeat

    register(lines.sparkSession)
    timed = heartbeat(lines).where("time_us is not null")
    timed = timed.repartitionByRange(tasks, "slice", "time_us").sortWithinPartitions("slice", "time_us")
    timed.select("value", "time_us", "slice").write.format("frames").mode("append").option("path", path).save()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)


def landed_stream(spark: SparkSession, path: str, slices: list[str] = (), start: int | None = None) -> DataFrame:
    """A stream (value, time_us, slice) of landed frames from the cursor `start` on."""
    register(spark)
    options = {"path": path, "slices": ",".join(slices), "start": str(start or 0)}
    return spark.readStream.format("frames").options(**options).load()
