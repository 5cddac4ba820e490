"""Near-duplicate vectors by spherical-cap filters from a random product code."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from kithgraph.llm.components import connected, labels
from kithgraph.llm.shared import discard, matched, written

#: Parts that a vector is cut into; a filter direction takes one code word of each.
PARTS = 4
#: Independent codes, each with a rotation of its own.
CODES = 2
#: Vectors of one filter that are compared in one task at most, against as many of another block.
BLOCK = 768
#: Rows that are decoded together.
DECODED = 1024
#: Rows of one vector from which it is joined by itself, and the most such vectors that are broadcast.
COMMON, COMMON_VECTORS = 4096, 20_000


class ProductCode:
    """Filter directions in `dimension` dimensions: all choices of one of `words` random unit vectors
    for each part of a randomly rotated vector.  A vector passes a filter if their inner product
    reaches `cap`, and decodes to the list of all filters it passes.  A vector that passes fewer than
    `least` has a lower cap of its own, at which it passes that many.

    The cap is set so that two vectors at the threshold share `shared` filters on average, with
    inner products taken as normal.  That gets less true as words are added, so `shared` and `least`
    grow with their logarithm, and `least` is larger in few dimensions.
    """

    def __init__(self, dimension: int, words: int, threshold: float, seed: int = 20):
        rng = np.random.default_rng([seed, dimension, words])
        shared = 1 + log2(words)
        self.parts, self.least = min(PARTS, dimension), ceil((5 * log2(words) - 5) * (1.5 if dimension < 16 else 1))
        self.words, self.width = words, ceil(dimension / self.parts)
        size = self.width * self.parts
        self.rotation = np.linalg.qr(rng.standard_normal((size, size)))[0][:dimension]
        code = rng.standard_normal((self.parts, words, self.width))
        self.code = code / np.linalg.norm(code, axis=2, keepdims=True) / sqrt(self.parts)
        self.cap = self._cap(words**self.parts, threshold, shared) / sqrt(size)

    @staticmethod
    def _cap(filters: int, rho: float, shared: float) -> float:
        """The largest standardised cap at which filters * P(both pass) reaches `shared`."""
        normal, x = NormalDist(), np.linspace(0, 9, 3601)
        density = np.exp(-x * x / 2) / sqrt(2 * np.pi) * (x[1] - x[0])
        low, high = 0.0, 8.0
        spread = sqrt(max(1e-12, 1 - rho * rho))
        for _ in range(40):
            mid = (low + high) / 2
            both = sum(d * (1 - normal.cdf((mid - rho * y) / spread)) for y, d in zip(x, density, strict=True) if y >= mid)
            low, high = (mid, high) if filters * both >= shared else (low, mid)
        return low

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each row of unit, DECODED rows at a time at most."""
        step = max(1, min(DECODED, (1 << 22) // max(1, self.words ** ceil(self.parts / 2))))
        return [f for at in range(0, len(unit), step) for f in self._decode(unit[at : at + step])]

    def _decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """As decode().

        Inner products of the two halves of a filter are kept apart; a half's product is extended
        only by those of the other half that lift it to the cap.
        """
        turned = (unit @ self.rotation).reshape(len(unit), self.parts, self.width)
        products = np.einsum("npw,pcw->npc", turned, self.code)
        first = products[:, 0]
        for k in range(1, max(1, self.parts // 2)):
            first = (first[:, :, None] + products[:, None, k]).reshape(len(unit), -1)
        second = np.zeros((len(unit), 1))
        for k in range(max(1, self.parts // 2), self.parts):
            second = (second[:, :, None] + products[:, None, k]).reshape(len(unit), -1)
        out, least = [], min(self.least, first.shape[1] * second.shape[1])
        for a, b in zip(first, second, strict=True):
            order = np.argsort(-b, kind="stable")
            falling = -b[order]
            # The `least` best sums lie among the `least` best of either half.
            best = np.sort(np.add.outer(np.sort(a)[-least:], -falling[:least]), axis=None)[-least:]
            cap = min(self.cap, best[0])
            heads = np.flatnonzero(a - falling[0] >= cap)
            many = np.searchsorted(falling, a[heads] - cap, side="right")
            tails = np.concatenate([order[:m] for m in many])
            out.append(np.sort(np.repeat(heads, many) * len(b) + tails).astype(np.int64))
        return out


def _matrix(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column as double vectors."""
    flat, ends = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _filters(vectors: DataFrame, words: int, threshold: float) -> DataFrame:
    """(cls, size, vec, filters) with cap filters: numbers are tagged with the dimension, as only
    vectors of equal length compare."""
    out = StructType([*vectors.schema.fields, StructField("filters", ArrayType(LongType()))])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[ProductCode]] = {}
        for batch in batches:
            rows = _matrix(batch.column(2))
            lists: list = [None] * len(rows)
            for d in {len(r) for r in rows}:
                if d not in codes:
                    codes[d] = [ProductCode(d, words, threshold, seed=20 + k) for k in range(CODES)]
                at = [k for k, r in enumerate(rows) if len(r) == d]
                unit = np.array([rows[k] for k in at])
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for k, *found in zip(at, *(c.decode(unit) for c in codes[d]), strict=True):
                    lists[k] = np.sort(np.concatenate([(f * CODES + n) * 4096 + d % 4096 for n, f in enumerate(found)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, arrow.field(3).type)], schema=arrow)

    return vectors.mapInArrow(run, out)


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n) from rows (filter, i, j, cls, size, vec, lower, block) sorted by the first three: b null:
    class a has links to n vectors of other classes; else a and b are connected.

    lower holds the vector's filters below this one.  A pair is counted only at the lowest filter
    that both pass, so each is counted once.
    """
    schema = "a long, b long, n long"
    names = ["a", "b", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, made = None, ([], [], [])

        def close() -> None:
            if len(held) < 2:
                return
            cls = np.array([h[0] for h in held])
            size = np.array([h[1] for h in held])
            block = np.array([h[4] for h in held])
            by_length: dict[int, list[int]] = {}
            for k, h in enumerate(held):
                by_length.setdefault(len(h[2]), []).append(k)
            for own in by_length.values():
                at = np.array(own)
                unit = np.array([held[k][2] for k in own])
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                link = unit @ unit.T >= threshold
                np.fill_diagonal(link, False)
                if key[1] != key[2]:
                    link &= block[at][:, None] != block[at][None, :]  # pairs inside a block have a task of their own
                if not link.any():
                    continue
                root = labels(link)
                moved = np.flatnonzero(root != np.arange(len(root)))
                for x, y in zip(cls[at][moved].tolist(), cls[at][root[moved]].tolist(), strict=True):
                    made[0].append(x), made[1].append(y), made[2].append(0)
                lower = [held[k][3] for k in own]
                common = np.unique(np.concatenate(lower), return_counts=True)
                common = common[0][common[1] > 1]
                if len(common):
                    passes = np.zeros((len(own), len(common)), np.float32)
                    for k, low in enumerate(lower):
                        place = np.searchsorted(common, low)
                        ok = place < len(common)
                        ok[ok] = common[place[ok]] == low[ok]
                        passes[k, place[ok]] = 1
                    link &= passes @ passes.T == 0
                n = link @ size[at]
                for k in np.flatnonzero(n).tolist():
                    made[0].append(int(cls[at][k])), made[1].append(None), made[2].append(int(n[k]))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=names)
            for c in made:
                c.clear()
            return out

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True))
            cls, size, block = (batch.column(k).to_pylist() for k in (3, 4, 7))
            vectors, lists = _matrix(batch.column(5)), batch.column(6)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, own in enumerate(keys):
                if own != key:
                    close()
                    held, key = [], own
                held.append((cls[k], size[k], vectors[k], flat[ends[k] : ends[k + 1]], block[k]))
            if made[0]:
                yield flush()
        close()
        if made[0]:
            yield flush()

    return rows.mapInArrow(run, schema)


def near_vectors(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", words: int | None = None) -> DataFrame:
    """id, n_links, component_id, kept of every row: links are cosines of at least `threshold`.

    Equal vectors are one class, compared once and counted as often as they occur.  Vectors that
    are null, empty, zero or hold null or non-finite components, and rows with a null id, link with
    nothing: they are components of their own.  Vectors of different lengths aren't compared.
    Filters with many vectors are dealt in blocks, each pair of blocks to a task of its own.
    An empty table gives no rows.  `words` defaults to the fourth root of the number of classes, so filters keep pace with it.
    """
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    base = df.select(F.col(id_col).alias("id"), F.when(sound, v).alias("vec"))
    classes = written(base.where(F.col("vec").isNotNull()).groupBy("vec").agg(F.min("id").alias("cls"), F.count("*").alias("size")).select("cls", "size", "vec"))
    if words is None:
        words = max(8, ceil(classes.count() ** 0.25))
    marked = written(_filters(classes, words, threshold))
    hot = marked.select(F.explode("filters").alias("filter")).groupBy("filter").count().where(F.col("count") > BLOCK)
    hot = written(hot.select("filter", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    each = marked.select("cls", "size", "vec", "filters", F.posexplode("filters").alias("lower", "filter"))
    dealt = matched(each, hot, "filter", "cls", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("filter", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cls", "size", "vec", F.slice("filters", F.lit(1), F.col("lower")).alias("lower"), "block")
    found = written(_verified(dealt.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j"), threshold))
    discard(marked, hot)
    degree = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    component = connected(found.where("b is not null"))
    facts = classes.join(degree, "cls", "left").join(component, F.col("cls") == F.col("node"), "left")
    facts = facts.select("vec", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    # A vector that many rows hold would be one task of the join.
    facts = written(facts)
    common = written(facts.where(F.col("size") >= COMMON).select("vec", F.lit(True).alias("common")))
    if not common.isEmpty():
        base = matched(base, common, "vec", "id", "left", COMMON_VECTORS)
        apart = matched(base.where("common").drop("common"), facts.where(F.col("size") >= COMMON), "vec", "id", "inner", COMMON_VECTORS)
        joined = base.where("common is null").drop("common").join(facts, "vec", "left").unionByName(apart)
    else:
        joined = base.join(facts, "vec", "left")
    out = joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
