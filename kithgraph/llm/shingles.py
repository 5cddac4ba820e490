"""Exact Jaccard join on word shingles: group counts as points in an R-tree, bounded by summed minima.

Shingles are 64-bit hashes; everything is exact but for their collisions.  Texts with equal sets
are one class.  Two linked classes share one of the rarest shingles of each (the prefix of a
fixed order), so classes meet in the bucket of such a shingle.  In a bucket, a tree over the
classes' group counts rules out pairs whose summed coordinate minima cannot reach the overlap
that a link takes.  Survivors connect candidates; inside a connected candidate group a tree again
rules out pairs, the sets themselves decide, and only pairs that are not connected yet are looked
at, so a group of mutual copies costs its size and not its square.

The order comes from counters that are shared by shingles and so never count too few: a prefix
shingle whose counter is below FLAG has a bucket of less than FLAG classes.  Classes with a prefix
shingle above it take new prefixes among themselves, from exact counts.  What is left in a
large bucket then has nearly all of its shingles in large buckets, as the variants of one text do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from kithgraph.llm.components import connected
from kithgraph.llm.rows import slices
from kithgraph.llm.shared import discard, matched, written

#: Words of a shingle, and the percentage of a link, LINK * |A or B| <= 100 * |A and B|, unless others are given.
WORDS = 4
LINK = 85
#: Groups that a point counts (a power of two); counts above a byte's range make the bound void.
GROUPS = 256
#: Counters of how many rows hold the shingles of a counter, in segments of SEGMENT counters: one for
#: LOAD bytes of text, and up to MOST_COUNTERS, a byte each when broadcast.  Beyond that more classes are flagged.
SEGMENT, LOAD, MOST_COUNTERS = 1 << 16, 96, 1 << 26
#: Marks of wanted ids, a bit each when broadcast: PER_ID for an id, and up to MOST_MARKS.  Beyond that more texts
#: that nobody wants are hashed, and dropped by an exact join.
PER_ID, MOST_MARKS = 32, 1 << 29
#: Binary magnitude from which a counter flags its shingles: a task's counters stop at 255.
FLAG = 8
#: Members of a bucket that are compared without a tree.
FEW = 12
#: Classes of an exactly counted bucket, and of a candidate group, that one task compares directly.
BUCKET, MEMBERS = 1024, 2048
#: Bytes of sets that one task of a candidate group is dealt, but for a single larger set.
MEMBER_BYTES = 1 << 26
#: Leaves of the tree.
LEAF = 32

#: Public constants of the golden-ratio and splitmix64 hash steps.
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _byte_values() -> np.ndarray:
    return np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hasher:
    """Sets of shingle hashes, from running sums over a text's bytes."""

    def __init__(self, words: int = WORDS):
        self.words, self.value = words, _byte_values()
        self.up = self.down = np.ones(1, np.uint64)
        self._grow(1 << 14)

    def _grow(self, size: int) -> None:
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _MULTIPLIER, np.uint64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _INVERSE, np.uint64)]))

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct hashes; of the whole word sequence if it has fewer than `words` words."""
        # Both methods of bytes know ASCII only: A-Z, and the six white-space bytes.
        joined = b" ".join(text.encode().lower().split())
        if not joined:
            return np.zeros(0, np.uint64)
        if len(joined) >= len(self.up):
            self._grow(2 * len(joined))
        raw = np.frombuffer(joined, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        if len(gaps) < self.words - 1:
            first, last = np.zeros(1, np.int64), np.full(1, len(raw))
        else:
            first = np.concatenate([[0], gaps[: len(gaps) + 1 - self.words] + 1])
            last = np.concatenate([gaps[self.words - 1 :], [len(raw)]])
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.up[: len(raw)], out=sums[1:])
        return np.unique(mixed((sums[last] - sums[first]) * self.down[first]))


def mixed(h: np.ndarray) -> np.ndarray:
    # The public multipliers of a 64-bit finaliser.
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def digest(own: np.ndarray) -> int:
    """Class of a set: a signed 64-bit hash of its members and size."""
    total = mixed(mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)[None] + np.uint64(len(own)))
    return int(total.view(np.int64)[0])


def point(own: np.ndarray) -> bytes:
    """Counts of the set's members by group; empty if a count exceeds a byte."""
    counts = np.bincount((own >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def prefix_size(n: int, link: int = LINK) -> int:
    """Members of a set of n, first by any fixed order, among which a linked set has one of its own."""
    return n - -(-link * n // 100) + 1


def reach(n: int, link: int = LINK) -> np.ndarray:
    """For each place in the prefix of a set of n, members of the largest set that may link with it if
    the first shingle that both hold, in the fixed order, is at that place."""
    return (100 + link) * (n - np.arange(prefix_size(n, link))) // link - n


def linked(common, a, b, link=LINK):
    return (100 + link) * common >= link * (a + b)


class PointTree:
    """An R-tree packed from points in order of size: leaves of LEAF points, bounded by coordinate maxima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, link: int = LINK):
        self.points, self.sizes, self.link = points.astype(np.int32), sizes, link
        self.points[(points == 255).all(axis=1)] = 1 << 24  # void points bound nothing
        ends = np.arange(0, len(sizes), LEAF)
        self.leaf_max = np.maximum.reduceat(self.points, ends, axis=0)
        self.leaf_low, self.leaf_high = np.minimum.reduceat(sizes, ends), np.maximum.reduceat(sizes, ends)
        top = np.arange(0, len(ends), LEAF)
        self.top_max = np.maximum.reduceat(self.leaf_max, top, axis=0)
        self.top_low, self.top_high = np.minimum.reduceat(self.leaf_low, top), np.maximum.reduceat(self.leaf_high, top)

    def _may(self, q: np.ndarray, size: int, maxima: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        near = (100 * high >= self.link * size) & (self.link * low <= 100 * size)
        return near & linked(np.minimum(maxima, q).sum(axis=1, dtype=np.int64), size, np.maximum(low, -(-self.link * size // 100)), self.link)

    def search(self, k: int) -> np.ndarray:
        """Points before k that may link with it."""
        q, size = self.points[k], int(self.sizes[k])
        tops = np.flatnonzero(self._may(q, size, self.top_max, self.top_low, self.top_high))
        leaves = (tops[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaves = leaves[leaves < len(self.leaf_low)]
        leaves = leaves[leaves * LEAF < k]
        leaves = leaves[self._may(q, size, self.leaf_max[leaves], self.leaf_low[leaves], self.leaf_high[leaves])]
        at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < k]
        return at[self._may(q, size, self.points[at], self.sizes[at], self.sizes[at])]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def candidate_pairs(points: np.ndarray, sizes: np.ndarray, link: int = LINK) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that the bound does not rule out."""
    forest, out = Forest(len(sizes)), []
    if len(sizes) <= FEW:
        common = np.minimum(points[:, None], points[None]).sum(axis=2, dtype=np.int64)
        void = (points == 255).all(axis=1)
        low, high = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
        may = (100 * low >= link * high) & (linked(common, low, high, link) | void[:, None] | void)
        return [(k, j) for k, j in np.argwhere(np.tril(may, -1)).tolist() if forest.join(k, j)]
    order = np.argsort(sizes, kind="stable")
    tree = PointTree(points[order], sizes[order], link)
    for k in range(1, len(order)):
        for j in tree.search(k).tolist():
            if forest.join(k, j):
                out.append((int(order[k]), int(order[j])))
    return out


def exact_pairs(sets: list[np.ndarray], points: np.ndarray, labels: list[int] | None = None, link: int = LINK) -> list[tuple[int, int]]:
    """A spanning forest of the links; rows with equal labels count as connected already."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    tree, forest, out = PointTree(points[order], sizes[order], link), Forest(len(sets)), []
    if labels is not None:
        first: dict[int, int] = {}
        for k, o in enumerate(order.tolist()):
            forest.join(k, first.setdefault(labels[o], k))
    for k in range(1, len(order)):
        own = sets[order[k]]
        for j in tree.search(k)[::-1].tolist():
            if forest.top(k) == forest.top(j):
                continue
            other = sets[order[j]]
            place = np.searchsorted(own, other)
            place[place == len(own)] = 0
            if linked(int((own[place] == other).sum()), len(own), len(other), link):
                forest.join(k, j)
                out.append((int(order[k]), int(order[j])))
    return out


# ---------------------------------------------------------------- passes over the texts

_FACTS = StructType([StructField("doc_id", LongType()), StructField("cls", LongType()), StructField("n", LongType()), StructField("point", BinaryType()), StructField("segment", LongType())])


def _counter(own: np.ndarray, counters: int) -> np.ndarray:
    return (own & np.uint64(counters - 1)).astype(np.int64)


def _codec() -> pa.Codec:
    """What segments of counters, mostly 0 and 1, are compressed with."""
    return pa.Codec("zstd", compression_level=1)


def counters_for(text_bytes: int) -> int:
    """A power of two in proportion to the input."""
    return min(MOST_COUNTERS, max(SEGMENT, 1 << (text_bytes // LOAD).bit_length()))


def _facts(docs: DataFrame, words: int, counters: int) -> DataFrame:
    """A row for each document (segment is null), and for each task the segments of its counters,
    compressed, in point; a task's counter stops at 255."""
    arrow = to_arrow_schema(_FACTS)

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, held, codec = Hasher(words), np.zeros(counters, np.uint8), _codec()
        for batch in batches:
            for start, texts in slices(batch, 1):
                sets = [hashed(t) for t in texts]
                ids = batch.column(0).slice(start, len(texts)).to_pylist()
                at, counts = np.unique(_counter(np.concatenate(sets), counters), return_counts=True)
                held[at] = np.minimum(held[at] + counts, 255).astype(np.uint8)
                yield batch_of([ids, [digest(s) if len(s) else None for s in sets], [len(s) for s in sets], [point(s) for s in sets], [None] * len(sets)])
        parts = held.reshape(-1, SEGMENT)
        for k in np.flatnonzero(parts.any(axis=1)).tolist():
            yield batch_of([[None], [None], [None], [codec.compress(parts[k].tobytes(), asbytes=True)], [k]])

    return docs.mapInArrow(run, _FACTS)


def _magnitudes(facts: DataFrame, counters: int) -> np.ndarray:
    """For each counter, the binary magnitude of its sum over all tasks: MOST_COUNTERS bytes at most."""
    schema = StructType([StructField("segment", LongType()), StructField("sums", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        codec = _codec()
        for batch in batches:
            for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k not in sums:
                    sums[k] = np.zeros(SEGMENT, np.uint64)
                sums[k] += np.frombuffer(codec.decompress(raw, SEGMENT), np.uint8)
        if sums:
            out = [np.ceil(np.log2(v + 1.0)).astype(np.uint8).tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(out, pa.binary())], names=["segment", "sums"])

    found = facts.where("segment is not null").select("segment", "point").repartition("segment").mapInArrow(run, schema).toLocalIterator()
    out = np.zeros((counters // SEGMENT, SEGMENT), np.uint8)
    for row in found:
        out[row["segment"]] = np.frombuffer(row["sums"], np.uint8)
    return out.ravel()


def _prefixes(docs: DataFrame, magnitudes: np.ndarray, words: int, link: int) -> DataFrame:
    """(shingle, cls, n, most, hot) of each class's rarest shingles: those of small counters first, by
    hash among equals.  Any fixed order gives the same links; this one keeps buckets small.  most is
    reach() there; hot is cls where the counter is flagged, else null.  A task gives the rows of a class once."""
    shared, counters = docs.sparkSession.sparkContext.broadcast(magnitudes), len(magnitudes)
    schema = StructType([StructField("shingle", LongType()), StructField("cls", LongType()), StructField("n", IntegerType()), StructField("most", IntegerType()), StructField("hot", LongType())])

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, magnitude, seen = Hasher(words), shared.value, set()
        for batch in batches:
            for _, texts in slices(batch, 1):
                shingle, cls, n, most, hot = [], [], [], [], []
                for own in map(hashed, texts):
                    if not len(own) or (name := digest(own)) in seen:
                        continue
                    seen.add(name)
                    take, sizes = prefix_size(len(own), link), magnitude[_counter(own, counters)]
                    order = np.argsort(sizes, kind="stable")[:take]
                    shingle.append(own[order].view(np.int64))
                    cls.append(np.full(take, name, np.int64))
                    hot.append(pa.array(cls[-1], mask=sizes[order] < FLAG))
                    n.append(np.full(take, len(own), np.int32))
                    most.append(reach(len(own), link).astype(np.int32))
                if shingle:
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in (shingle, cls, n, most)), pa.concat_arrays(hot)], schema=arrow)

    return docs.mapInArrow(run, schema)


def _marks(ids: DataFrame) -> np.ndarray:
    """Bits, eight to a byte, at the hashes of a written table of ids."""
    marks = min(MOST_MARKS, max(8 * SEGMENT, 1 << (PER_ID * ids.count()).bit_length()))
    schema = StructType([StructField("segment", LongType()), StructField("marks", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, at = (c.to_numpy() for c in batch.columns)
            for k in np.unique(segment).tolist():
                held.setdefault(k, np.zeros(8 * SEGMENT, bool))[at[segment == k]] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(v).tobytes() for v in held.values()], pa.binary())], names=["segment", "marks"])

    place = F.xxhash64(ids.columns[0]).bitwiseAND(F.lit(marks - 1))
    places = ids.select(F.floor(place / (8 * SEGMENT)).alias("segment"), (place % (8 * SEGMENT)).alias("at"))
    out = np.zeros((marks // (8 * SEGMENT), SEGMENT), np.uint8)
    for row in places.repartition("segment").mapInArrow(run, schema).toLocalIterator():
        out[row["segment"]] = np.frombuffer(row["marks"], np.uint8)
    return out.ravel()


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(cls, set) of each document with a marked id, its sorted hashes as bytes.

    The marks of `ids`, a written table, are broadcast, so no text moves.  A few other documents may
    share a mark: what must not be there the caller drops by class.
    """
    schema = StructType([StructField("cls", LongType()), StructField("set", BinaryType())])
    arrow, shared = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(_marks(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, marks = Hasher(words), shared.value
        for batch in batches:
            at = batch.column(2).to_numpy() & (8 * len(marks) - 1)
            batch = batch.filter(pa.array((marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            for _, texts in slices(batch, 1):
                sets = [s for s in map(hashed, texts) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=arrow)

    return docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id")).mapInArrow(run, schema)


# ---------------------------------------------------------------- comparisons

_EDGES = StructType([StructField("a", LongType()), StructField("b", LongType())])


def _points(raw: list[bytes]) -> np.ndarray:
    """Points as a matrix; a void one is 255 throughout."""
    return np.frombuffer(b"".join(p or b"\xff" * GROUPS for p in raw), np.uint8).reshape(-1, GROUPS)


def _edge_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _bucket_edges(rows: DataFrame, link: int) -> DataFrame:
    """Candidate edges from (shingle, cls, n, point) sorted by shingle; pairs in buckets of two are
    bounded together, larger buckets by a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None

        def compare(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            shingle, cls, n = (table.column(k).to_numpy() for k in range(3))
            points = _points(table.column(3).to_pylist())
            first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
            size = np.diff(np.concatenate([first, [len(shingle)]]))
            pair = first[size == 2]
            common = np.minimum(points[pair], points[pair + 1]).sum(axis=1, dtype=np.int64)
            low, high = np.minimum(n[pair], n[pair + 1]), np.maximum(n[pair], n[pair + 1])
            void = (points[pair] == 255).all(axis=1) | (points[pair + 1] == 255).all(axis=1)
            pair = pair[(100 * low >= link * high) & (void | linked(common, low.astype(np.int64), high, link))]
            a, b = cls[pair].tolist(), cls[pair + 1].tolist()
            for at, k in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                for x, y in candidate_pairs(points[at : at + k], n[at : at + k].astype(np.int64), link):
                    a.append(int(cls[at + x])), b.append(int(cls[at + y]))
            return _edge_batch(a, b)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if carried is not None:
                table = pa.concat_tables([carried, table])
            shingle = table.column(0).to_numpy()
            if not len(shingle):
                continue
            whole = int(np.searchsorted(shingle, shingle[-1]))  # the last bucket may go on
            carried = table.slice(whole)
            if whole:
                yield compare(table.slice(0, whole))
        if carried is not None and len(carried):
            yield compare(carried)

    return rows.mapInArrow(run, _EDGES)


def _group_edges(rows: DataFrame, link: int) -> DataFrame:
    """Exact edges from (grp, block, other, cls, label, set) sorted by grp, block and other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, a, b = None, {}, [], []

        def close() -> None:
            if len(held) > 1:
                names = list(held)
                sets = [np.frombuffer(held[c][1], np.uint64) for c in names]
                for x, y in exact_pairs(sets, _points([point(s) for s in sets]), [held[c][0] for c in names], link):
                    a.append(names[x]), b.append(names[y])

        for batch in batches:
            for *task, cls, label, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != key:
                    close()
                    key, held = task, {}
                held[cls] = (label, own)
            if a:
                yield _edge_batch(a, b)
                a, b = [], []
        close()
        if a:
            yield _edge_batch(a, b)

    return rows.mapInArrow(run, _EDGES)


def _resolved(groups: DataFrame, link: int) -> DataFrame:
    """Exact edges between the classes of (grp, cls, set).

    A group of up to MEMBERS classes and MEMBER_BYTES is one task.  A larger one is dealt to
    blocks of less than half of that, and first each block is compared by itself.  Two classes in the group's
    largest component then need no look, and of any other two one is outside of it: the classes
    outside are dealt to chunks, and every chunk meets every block and every other chunk in a task of its own.
    """
    half = F.lit(int(0.44 * MEMBERS))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("members"), F.sum(F.length("set")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("members") / half), F.ceil(F.col("bytes") / (0.44 * MEMBER_BYTES)))
    large = written(sizes.where((F.col("members") > MEMBERS) | (F.col("bytes") > MEMBER_BYTES)).select("grp", parts.cast("int").alias("blocks")))
    dealt = matched(groups, large, "grp", "cls", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumns({"block": F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"), "other": F.lit(-1)})
    columns = ["grp", "block", "other", "cls", "label", "set"]
    sort = lambda d: d.select(*columns).repartition("grp", "block", "other").sortWithinPartitions("grp", "block", "other")
    edges = written(_group_edges(sort(dealt.withColumn("label", F.col("cls"))), link))
    if large.isEmpty():
        return edges
    found = connected(edges)
    rest = dealt.where("blocks > 1").drop("other").join(found, F.col("cls") == F.col("node"), "left").withColumn("label", F.coalesce("component", "cls"))
    rest = written(rest.select("grp", "blocks", "block", "cls", "label", "set"))
    counts = rest.groupBy("grp", "label").agg(F.count("*").alias("c"), F.sum(F.length("set")).alias("bytes"))
    main = counts.groupBy("grp").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"), F.sum("bytes").alias("bytes"))
    chunks = F.greatest(F.ceil((F.col("all") - F.col("most")) / half), F.ceil(F.col("bytes") * (F.col("all") - F.col("most")) / F.col("all") / (0.44 * MEMBER_BYTES)))
    main = written(main.select("grp", "main", chunks.cast("int").alias("chunks")).where("chunks > 0"))
    rest = matched(rest, main, "grp", "cls", "inner")
    number = lambda n: F.sequence(F.lit(0), n - 1)
    inside = rest.where("label = main").withColumn("other", F.explode(number(F.col("chunks"))))
    outside = rest.where("label <> main").withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks")).cast("int"))
    to_blocks = outside.withColumn("block", F.explode(number(F.col("blocks")))).withColumn("other", F.col("chunk"))
    # Chunks meet each other in blocks numbered below zero.
    to_chunks = outside.withColumn("k", F.explode(number(F.col("chunks")))).withColumns({"block": -1 - F.least("chunk", "k"), "other": F.greatest("chunk", "k")})
    more = inside.select(*columns).unionByName(to_blocks.select(*columns)).unionByName(to_chunks.select(*columns))
    return edges.unionByName(written(_group_edges(sort(more), link)))


def _exact_prefixes(docs: DataFrame, flagged: DataFrame, words: int, link: int) -> DataFrame:
    """(shingle, cls, n, large) of the flagged classes, by exact counts among them: first the shingles
    of buckets up to BUCKET classes, by hash among equals."""
    rows = _sets(docs, flagged.select("first"), words).dropDuplicates(["cls"])
    rows = written(rows.join(flagged.select("cls").distinct(), "cls", "left_semi"))
    each = _members(rows)
    large = written(each.groupBy("shingle").agg(F.count("*").alias("met")).where(F.col("met") > BUCKET).select("shingle", F.lit(True).alias("large")))
    each = matched(each, large, "shingle", "cls", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("large", "shingle"))
    take = F.col("n") - F.ceil(F.lit(link) * F.col("n") / 100) + 1
    return each.withColumn("rank", rank).where(F.col("rank") <= take).select("shingle", "cls", "n", "large")


def _members(sets: DataFrame) -> DataFrame:
    """(shingle, cls, n) of every member of (cls, set)."""
    schema = StructType([StructField("shingle", LongType()), StructField("cls", LongType()), StructField("n", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), cls, np.int64)), pa.array(np.full(len(own), len(own), np.int32))], names=["shingle", "cls", "n"])

    return sets.select("cls", "set").mapInArrow(run, schema)


def _classes(df: DataFrame, id_col: str, text_col: str, words: int, link: int, one_id: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, n) of every row, and (cls, component_id); one_id: rows with the same id are linked."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counters = counters_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    facts = written(_facts(docs, words, counters))
    base = written(facts.where("segment is null").select("doc_id", "cls", "n"))
    sound = base.where("doc_id is not null and n > 0")
    magnitudes = _magnitudes(facts, counters)
    classes = written(facts.where("segment is null and doc_id is not null and n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("point").alias("point")))
    discard(facts)
    # Flagged shingles may be hot: each of their rows is a partition of its own here.  One exchange
    # serves the distinct rows and the buckets.  Rows without another one in reach go before they get their points.
    prefixes = _prefixes(docs.where("doc_id is not null"), magnitudes, words, link).repartition("shingle", "hot")
    prefixes = prefixes.groupBy("shingle", "hot", "cls").agg(F.first("n").alias("n"), F.first("most").alias("most"))
    bucket = Window.partitionBy("shingle", "hot").orderBy("n", "cls")
    smaller = F.max("most").over(bucket.rowsBetween(Window.unboundedPreceding, -1))
    prefixes = prefixes.withColumns({"smaller": smaller, "next": F.lead("n").over(bucket)})
    prefixes = written(prefixes.where("hot is not null or smaller >= n or most >= next").select("shingle", "cls", "n", "hot"))
    small = prefixes.where("hot is null").select("shingle", "cls", "n")
    flagged = written(prefixes.where("hot is not null").select("cls").distinct().join(classes.select("cls", "first"), "cls"))
    stars = None
    if not flagged.isEmpty():
        exact = written(_exact_prefixes(docs, flagged, words, link))
        met = F.count("*").over(Window.partitionBy("shingle"))
        small = small.unionByName(exact.where("not large").withColumn("met", met).where("met > 1").select("shingle", "cls", "n"))
        # What stays large connects all its classes as candidates; a tree looks at them in their group.
        hubs = written(exact.where("large").groupBy("shingle").agg(F.min("cls").alias("b")))
        stars = matched(exact.where("large").select("shingle", "cls"), hubs, "shingle", "cls", "inner").where("cls <> b").select(F.col("cls").alias("a"), "b")
    met = small.join(classes.select("cls", "point"), "cls").select("shingle", "cls", "n", "point")
    pairs = _bucket_edges(met.repartition("shingle").sortWithinPartitions("shingle"), link)
    pairs = written((pairs if stars is None else pairs.unionByName(stars)).distinct())
    groups = written(connected(pairs))
    discard(pairs, prefixes)
    wanted = written(groups.join(classes.select("cls", "first"), F.col("node") == F.col("cls")).select("first"))
    sets = written(_sets(docs, wanted, words).dropDuplicates(["cls"]).join(groups, F.col("cls") == F.col("node")).select(F.col("component").alias("grp"), "cls", "set"))
    edges = _resolved(sets, link)
    if one_id:
        same = sound.groupBy("doc_id").agg(F.min("cls").alias("b"), F.max("cls").alias("z")).where("b <> z")
        edges = edges.unionByName(sound.join(same.select("doc_id", "b"), "doc_id").where("cls <> b").select(F.col("cls").alias("a"), "b"))
    component = connected(edges)
    discard(sets, groups, wanted)
    known = classes.join(component, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("component", "cls").alias("component"))
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    return base, known.join(least, "component").select("cls", "component_id")


def link_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, link: int = LINK) -> DataFrame:
    """id, n_shingles, component_id of every row.

    A set holds the distinct shingles of `words` words of the whole text, with A-Z in lower case and words
    between ASCII white space; of fewer words, their sequence.  Documents link at a Jaccard
    similarity of link percent and more; component_id is the smallest id reachable.  Null, empty and
    blank texts have no shingles and link with nothing; rows with a null id have a null component
    and link with nothing.  Repeated rows give repeated results; an empty table gives no rows.  A very
    long text is read as a whole, in memory in proportion to its length.  Other columns are ignored.
    """
    base, known = _classes(df, id_col, text_col, words, link, False)
    out = base.join(known, "cls", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, link: int = LINK, also: DataFrame | None = None, lost: float = 0.25) -> DataFrame:
    """One row of df for each component of linked rows, with the smallest id (nulls last), then text digest.

    also: (id, text) of the rows' texts before a cleaning step.  A row that lost the share `lost`
    or more of its characters then is judged by that version too: two rows link if any version of
    one links with any of the other.  Rows without shingles
    in any version (null, empty, blank) stay.  Of rows that are equal in id and text one stays.
    """
    key = F.xxhash64(F.col(id_col), F.md5(F.col(text_col)))
    size = F.coalesce(F.char_length(text_col), F.lit(0))
    narrow = written(df.select(key.alias("__key"), F.col(id_col).alias("__id"), F.md5(F.col(text_col)).alias("__tie"), size.alias("__size")))
    texts = df.select(key.alias("__key"), F.col(text_col).alias("__text"))
    if also is not None:
        # Only ids and lengths are joined; the texts of the rows that lost enough are looked up then.
        shrunk = also.select(F.col(id_col).alias("__id"), size.alias("__was")).join(narrow, "__id").where((F.col("__was") > 0) & (F.col("__size") <= (1 - lost) * F.col("__was")))
        shrunk = written(shrunk.groupBy("__id").agg(F.min("__key").alias("__key")))
        texts = texts.unionByName(matched(also.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), shrunk, "__id", "__id", "inner").select("__key", "__text"))
    base, known = _classes(texts, "__key", "__text", words, link, also is not None)
    members = written(base.join(known, "cls").select(F.col("doc_id").alias("__key"), F.col("component_id").alias("component")).distinct())
    order = F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__tie"), F.col("__key"))
    stays = members.join(narrow, "__key").groupBy("component").agg(F.min(order).alias("o")).select("o.__key")
    gone = written(members.select("__key").join(stays, "__key", "left_anti"))
    repeated = written(narrow.groupBy("__key").agg(F.count("*").alias("rows")).where("rows > 1").select("__key"))
    kept = matched(df.withColumn("__key", key), gone, "__key", "__key", "left_anti")
    once = matched(kept, repeated, "__key", "__key", "left_semi").dropDuplicates(["__key"])
    return matched(kept, repeated, "__key", "__key", "left_anti").unionByName(once).select(*df.columns)
