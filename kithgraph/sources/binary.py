"""A data source of binary snapshot files: a header of 64 bytes and up to nine sections, with two checksums.

Each section is a table, read by one task, which checks the header's and the payload's CRC32 first and
skips the sections before its own; memory is one record's, whatever the file's size.  The file must
be on a folder that all nodes have mounted.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kithgraph.functions.topics import shard
from kithgraph.schemas import EPOCH, TOPICS, Graph
from kithgraph.sources.segments import local
from kithgraph.sources.store import DamagedSnapshot

#: The file's first bytes, its header, and the versions that are read.
MAGIC, HEADER, VERSIONS = b"FYFD", struct.Struct("<4sHHQQIIIQIIIII"), range(1, 6)
#: The header's fields in order.
FIELDS = ("magic", "version", "header_length", "created_at", "cursor", "flags", "strings", "users", "edges", "followers", "metas", "payload_crc", "header_crc", "dials")
#: The sections in order, with the columns that their tables have here.
SECTIONS = {
    "strings": "place long, value string",
    "user_edges": "user_id long, place long, post_id long, signal int, ts long",
    "post_edges": "post_id long, place long, user_id long, signal int, ts long",
    "bitmaps": "user_id long, post_id long",
    "follows": "follower_id long, place long, followed_id long",
    "meta": "post_id long, author_id long, root_id long, parent_id long, created_at long, is_nsfw boolean, topic string",
    "recents": "post_id long, ts long",
    "dials": "user_id long, half_life_s double, explore double, art double, tech double, science double, news double, culture double, include_replies boolean, min_likes int, no_nsfw boolean, updated_at long",
    "impressions": "viewer_id long, place long, post_id long, served_at long, count long",
}
#: Fixed value: what dials of versions without one have.
LEAST_LIKES = 3
PIECE = 1 << 20


class Payload:
    """The payload of a file as a stream of numbers."""

    def __init__(self, file: BinaryIO, version: int):
        self.file, self.version = file, version

    def take(self, n: int) -> bytes:
        out = self.file.read(n)
        if len(out) < n:
            raise DamagedSnapshot("the file ends inside of a record")
        return out

    def of(self, form: str) -> tuple:
        form = f"<{form}"
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def number(self) -> int:
        return self.of("I")[0]

    def more(self) -> bool:
        at = self.file.tell()
        some = bool(self.file.read(1))
        self.file.seek(at)
        return some


def checked(file: BinaryIO, path: str) -> dict:
    """The header of a file whose checksums are right; the file is left at the payload."""
    raw = file.read(HEADER.size)
    if len(raw) < HEADER.size or raw[:4] != MAGIC:
        raise DamagedSnapshot(f"{path} is no snapshot")
    head = dict(zip(FIELDS, HEADER.unpack(raw), strict=True))
    if head["version"] not in VERSIONS:
        raise DamagedSnapshot(f"{path} has version {head['version']}")
    if zlib.crc32(raw[:56]) != head["header_crc"]:
        raise DamagedSnapshot(f"the header of {path} is damaged")
    crc = 0
    while piece := file.read(PIECE):
        crc = zlib.crc32(piece, crc)
    if crc != head["payload_crc"]:
        raise DamagedSnapshot(f"the payload of {path} is damaged")
    file.seek(HEADER.size)
    return head


def bits(raw: bytes) -> Iterator[int]:
    """Members of a roaring bitmap in its portable form."""
    cookie, at = struct.unpack_from("<I", raw)[0], 4
    many, runs = (cookie >> 16) + 1, b""
    if cookie & 0xFFFF == 12347:
        runs = raw[at : at + (many + 7) // 8]
        at += len(runs)
    elif cookie == 12346:
        many, at = struct.unpack_from("<I", raw, at)[0], at + 4
    else:
        raise DamagedSnapshot("unknown bitmap")
    heads = [struct.unpack_from("<HH", raw, at + 4 * k) for k in range(many)]
    at += 4 * many + (4 * many if not runs or many >= 4 else 0)
    for k, (high, less) in enumerate(heads):
        base = high << 16
        if runs and runs[k >> 3] >> (k & 7) & 1:
            n = struct.unpack_from("<H", raw, at)[0]
            for first, length in (struct.unpack_from("<HH", raw, at + 2 + 4 * j) for j in range(n)):
                yield from range(base + first, base + first + length + 1)
            at += 2 + 4 * n
        elif less + 1 > 4096:
            for word, value in enumerate(struct.unpack_from("<1024Q", raw, at)):
                yield from (base + 64 * word + b for b in range(64) if value >> b & 1)
            at += 8192
        else:
            yield from (base + x for x in struct.unpack_from(f"<{less + 1}H", raw, at))
            at += 2 * (less + 1)


def _strings(p: Payload) -> Iterator[tuple]:
    for k in range(p.number()):
        yield k, p.take(p.number()).decode()


def _edges(p: Payload) -> Iterator[tuple]:
    """Targets with 29 bits of seconds since EPOCH and 3 of the signal; `place` counts a whole section's edges."""
    place = 0
    for _ in range(p.number()):
        node, many = p.of("II")
        for _ in range(many):
            target, packed = p.of("II")
            yield node, place, target, packed & 7 if 1 <= packed & 7 <= 3 else 1, (packed >> 3) + EPOCH
            place += 1


def _bitmaps(p: Payload) -> Iterator[tuple]:
    for _ in range(p.number()):
        user, size = p.of("II")
        yield from ((user, post) for post in bits(p.take(size)))


def _follows(p: Payload) -> Iterator[tuple]:
    for _ in range(p.number()):
        user, many = p.of("II")
        for place in range(many):
            yield user, place, p.number()


def _meta(p: Payload) -> Iterator[tuple]:
    for _ in range(p.number()):
        post, author, has_root, root, has_parent, parent, created = p.of("IIBIBIQ")
        flags = p.of("B")[0] if p.version >= 5 else 0
        code = (flags >> 1 & 7) - 1
        yield post, author, root if has_root else None, parent if has_parent else None, created, bool(flags & 1), TOPICS[code] if 0 <= code < len(TOPICS) else None


def _recents(p: Payload) -> Iterator[tuple]:
    for _ in range(p.number()):
        yield p.of("IQ")


def _dials(p: Payload) -> Iterator[tuple]:
    if p.version < 2 or not p.more():
        return
    for _ in range(p.number()):
        user, *figures = p.of("Ifffffff")
        replies = bool(p.of("B")[0]) if p.version >= 3 else False
        likes = p.number() if p.version >= 4 else LEAST_LIKES
        safe = bool(p.of("B")[0]) if p.version >= 5 else False
        yield user, *figures, replies, likes, safe, p.of("Q")[0]


def _impressions(p: Payload) -> Iterator[tuple]:
    if not p.more():
        return
    for _ in range(p.number()):
        viewer, many = p.of("II")
        for place in range(many):
            yield viewer, place, *p.of("IQI")


READ: dict[str, Callable[[Payload], Iterator[tuple]]] = dict(zip(SECTIONS, (_strings, _edges, _edges, _bitmaps, _follows, _meta, _recents, _dials, _impressions), strict=True))


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.section = local(options["path"]), options.get("section", "user_edges")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.section)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as file:
            payload = Payload(file, checked(file, self.path)["version"])
            for name, read in READ.items():
                rows = read(payload)
                if name == partition.value:
                    yield from rows
                    return
                for _ in rows:
                    pass


class SnapshotFile(DataSource):
    """Format "graph_snapshot": options path and section."""

    @classmethod
    def name(cls) -> str:
        return "graph_snapshot"

    def schema(self) -> str:
        name = self.options.get("section", "user_edges")
        if name not in SECTIONS:
            raise ValueError(f"no section {name}")
        return SECTIONS[name]

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def section(spark: SparkSession, path: str, name: str) -> DataFrame:
    spark.dataSource.register(SnapshotFile)
    return spark.read.format("graph_snapshot").option("section", name).load(path)


def header(path: str) -> dict:
    """The header's fields, after both checks."""
    with open(local(path), "rb") as file:
        return checked(file, path)


def numbered(strings: DataFrame) -> DataFrame:
    """(value, id) of section strings: numbers by shard in the order of the file, as they were given."""
    from pyspark.sql import Window

    own = strings.withColumn("shard", shard(F.col("value")))
    at = F.row_number().over(Window.partitionBy("shard").orderBy("place")) - 1
    return own.select("value", (at.cast("long") * 64 + F.col("shard")).alias("id"))


def graph_of(spark: SparkSession, path: str) -> tuple[Graph, int]:
    """The graph of a file and its stream cursor; blocks aren't in such files."""
    own = {n: section(spark, path, n) for n in ("user_edges", "follows", "meta", "impressions")}
    edges = own["user_edges"].select("user_id", "post_id", "signal", "ts", F.col("place").alias("seq"))
    meta = own["meta"]
    users = edges.select("user_id").union(own["follows"].select("follower_id")).distinct()
    return Graph(
        edges, edges, meta.drop("topic"), meta.where("topic is not null").select("post_id", "topic"), users, own["follows"].select("follower_id", "followed_id", F.col("place").alias("seq")),
        spark.createDataFrame([], "blocker_id long, blocked_id long"), own["impressions"].select("viewer_id", "post_id", "served_at", F.col("place").alias("seq")),
    ), header(path)["cursor"]
