"""Packing tokenized documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from kithgraph.llm.rows import slices
from kithgraph.llm.tokens import ByteTokenizer

#: Windows that are balanced against each other.
BLOCK_WINDOWS = 64
#: Share of a block that is set aside to be cut into the room that whole pieces leave.
FILLER = 0.12
#: Sequence ids of one partition.
ID_SPAN = 1 << 36


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Positions of `sizes` dealt to k parts with near-equal sums.

    A partial partition is its parts by descending sum.  The two with the largest spread are merged
    over and over, the largest part of one with the smallest of the other.
    """
    if k == 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    ticket = itertools.count()
    heap = [(-s, next(ticket), [(s, (i,))]) for i, s in enumerate(sizes)]  # parts that are empty aren't held
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        a = a + [(0, ())] * (k - len(a))
        b = b + [(0, ())] * (k - len(b))
        merged = [(x + y, (p, q) if p and q else p or q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)]
        merged.sort(key=lambda part: -part[0])
        low = merged[-1][0]
        while merged and not merged[-1][0] and not merged[-1][1]:
            merged.pop()
        heapq.heappush(heap, (low - merged[0][0], next(ticket), merged))
    parts = []
    for _, tree in heap[0][2]:
        stack, flat = [tree], []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                flat.append(node)
        parts.append(sorted(flat))
    return parts + [[] for _ in range(k - len(parts))]


def whole_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows for pieces that may not be cut: as few as the total asks for, and one more for as long
    as differencing leaves a window above capacity."""
    if sizes and max(sizes) > capacity:
        raise ValueError("a piece is larger than a window")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1


Piece = tuple[int, int, int]


def filled_windows(pieces: list[Piece], filler: list[Piece], capacity: int) -> tuple[list[list[Piece]], list[Piece]] | None:
    """Full windows of pieces (document, start, length), none of them cut, and filler; and what is left of the filler.

    Differencing deals the pieces to as few windows as their total asks for, and to one more for as
    long as it leaves a window above capacity.  The room of each window is filled with filler, cut
    where it must be.  None where the windows have more room than there is filler.
    """
    sizes = [p[2] for p in pieces]
    total, spare = sum(sizes), sum(p[2] for p in filler)
    k = max(1, -(-total // capacity))
    while k * capacity - total <= spare:
        parts = differencing(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            left, windows = filler[::-1], []
            for part in parts:
                own = [pieces[i] for i in part]
                windows.append(own + _taken(left, capacity - sum(p[2] for p in own)))
            return windows, left[::-1]
        k += 1
    return None


def _taken(left: list[Piece], room: int) -> list[Piece]:
    """`room` tokens from the end of the list of pieces, which loses them."""
    own = []
    while room:
        doc, start, length = left.pop()
        own.append((doc, start, min(length, room)))
        if length > room:
            left.append((doc, start + room, length - room))
        room -= min(length, room)
    return own


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Windows whose lengths are distinct powers of two, of all that is in pieces."""
    left, windows, pieces = sum(p[2] for p in pieces), [], pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        windows.append(_taken(pieces, size))
        left -= size
    return windows


class Packer:
    """Deals documents of one partition, in their order, to windows.

    A document of a window and more gives full windows of its own; its rest is a piece, and so is a
    shorter document.  Of a block of pieces, rests first and then the latest documents are set
    aside as filler; the others are packed whole, in as many windows as differencing needs.
    """

    def __init__(self, capacity: int, block_windows: int = BLOCK_WINDOWS):
        self.capacity, self.goal = capacity, capacity * block_windows
        self.pieces: list[Piece] = []
        self.held = 0
        self.shares: list[float] = []  # of each attempt at a block

    def add(self, doc: int, length: int) -> Iterator[list[Piece]]:
        start = 0
        while length - start >= self.capacity:
            yield [(doc, start, self.capacity)]
            start += self.capacity
        if length > start:
            self.pieces.append((doc, start, length - start))
            self.held += length - start
            if self.held >= self.goal:
                yield from self._block()

    def _block(self) -> list[list[Piece]]:
        """Full windows of the pieces; what doesn't fill one stays.

        Where the rising count asks for more room than there is filler, half as much again is set
        aside, so that fewer pieces are left to be whole; with all of them aside a window is always full.
        """
        order, share, found = sorted(self.pieces, key=lambda p: (p[1] == 0, -p[0])), FILLER, None
        while found is None:
            filler, whole, aside = [], [], 0
            for p in order:
                if aside < share * self.held:
                    filler.append(p)
                    aside += p[2]
                else:
                    whole.append(p)
            found = filled_windows(whole[::-1], filler, self.capacity)
            self.shares.append(share)
            share *= 1.5
        windows, self.pieces = found
        self.held = sum(p[2] for p in self.pieces)
        return windows

    def end(self) -> Iterator[list[Piece]]:
        """What is left: full windows, then one window for each power of two in the remainder."""
        while self.held >= self.capacity:
            yield from self._block()
        yield from powers(self.pieces)
        self.pieces, self.held = [], 0


def pack(df: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text (null: empty) and end_id, so that every row has at
    least one piece; repeated rows are packed as often as they occur, an empty table gives no rows, and
    other columns of df are ignored.  A text longer than a window is cut into full windows and a rest, however long it is.
    A partition packs its rows in their order and blocks of BLOCK_WINDOWS windows; no row
    moves and only one block of pieces is held.  A sequence is full, or is as long as a power of
    two, so nothing is padded.  sequence_id is unique within one run;
    it and the pieces follow the order of a partition's rows, so df should be a table or sorted, as
    a lost task could else be packed anew in another order.
    """
    narrow = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = StructType([narrow.schema[0], *(StructField(n, LongType()) for n in names)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = ByteTokenizer(path), Packer(capacity)
        sequence = TaskContext.get().partitionId() * ID_SPAN
        end = end_id.to_bytes(4, "little")
        docs: dict[int, tuple[object, bytes]] = {}  # those with pieces that are still held
        number, rows = 0, []

        def note(windows) -> None:
            nonlocal sequence
            for window in windows:
                at = 0
                for doc, start, length in window:
                    key, ids = docs[doc]
                    rows.append((key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, at))
                    at += length
                sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for start, texts in slices(batch, 1):
                keys = batch.column(0).slice(start, len(texts)).to_pylist()
                for key, ids in zip(keys, tokenizer.encode_all(texts), strict=True):
                    docs[number] = (key, ids + end)
                    note(packer.add(number, len(ids) // 4 + 1))
                    number += 1
                held = {p[0] for p in packer.pieces}
                docs = {k: v for k, v in docs.items() if k in held}
                if rows:
                    yield flush()
        note(packer.end())
        if rows:
            yield flush()

    return narrow.mapInArrow(run, out)
