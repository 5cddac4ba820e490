"""Compressing vectors to four bytes: codebooks by integer rounds of k-means, searched through a vector-approximation file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.shared import discard, matched, written

#: Parts of a vector, entries of a part's codebook, rounds of improvement, and integer steps in a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of an entry's coordinate in the approximation file.
BITS = 3
#: Integers up to this size keep every distance and sum exact in 64 bits.
LARGEST = 1 << 26
#: Components of candidate entries that are compared at once.
COMPARED = 1 << 22


class CellFile:
    """Entries of one codebook with each coordinate quantised to one of 2^BITS cells.

    Along a coordinate the cells hold equally many entries; a cell is known by its least and its
    greatest coordinate.  A query's distances to the ends of all cells are a lookup table, whose sums
    along an entry's cells bound the distance to that entry from below and above.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        many, width = self.entries.shape
        cells = min(1 << BITS, max(1, many))
        rank = np.argsort(np.argsort(self.entries, axis=0, kind="stable"), axis=0, kind="stable")
        cell = rank * cells // max(1, many)
        self.low, self.high = np.empty((width, cells)), np.empty((width, cells))
        for c in range(cells):
            inside = cell == c
            self.low[:, c] = np.where(inside, self.entries, np.inf).min(axis=0)
            self.high[:, c] = np.where(inside, self.entries, -np.inf).max(axis=0)
        one = np.arange(width)[:, None] * cells + cell.T
        self.choice = np.zeros((width * cells, many), np.float32)
        self.choice[one, np.arange(many)[None, :]] = 1
        # Bounds are summed in single precision; no sum of `width` terms errs by more than this share.
        self.slack = np.float32((width + 8) * 2.0**-23)
        self.step = max(1, COMPARED // max(1, many * max(1, width)))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the squared distances of each query to each entry."""
        q = queries.astype(np.float64)[:, :, None]
        below, above = self.low - q, q - self.high
        near = np.maximum(np.maximum(below, above), 0.0) ** 2
        far = np.maximum(-below, -above) ** 2
        lower, upper = ((t.reshape(len(queries), -1).astype(np.float32)) @ self.choice for t in (near, far))
        return lower * (1 - self.slack), upper * (1 + self.slack)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry, the lower index on ties.

        Only entries whose lower bound reaches below the least upper bound are measured, in integers.
        """
        index, distance = np.empty(len(queries), np.int64), np.empty(len(queries), np.int64)
        for at in range(0, len(queries), self.step):
            own = queries[at : at + self.step]
            lower, upper = self.bounds(own)
            row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
            apart = own[row] - self.entries[entry]
            exact = np.einsum("ij,ij->i", apart, apart)
            first = np.searchsorted(row, np.arange(len(own)))
            least = np.minimum.reduceat(exact, first)
            hit = np.flatnonzero(exact == least[row])
            where = hit[np.searchsorted(row[hit], np.arange(len(own)))]
            index[at : at + len(own)], distance[at : at + len(own)] = entry[where], least
        return index, distance


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    found = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
    if found.size and np.abs(found).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST} / {SCALE} are not supported")
    return found


def _split(rows: np.ndarray) -> list[np.ndarray]:
    return np.split(rows, PARTS, axis=1)


def _improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """books after one round: every entry is the floor of the mean of the parts that are nearest to it.

    A task adds its parts up by entry; what is shuffled and returned is at most one sum for each entry and task.
    """
    many, width = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [CellFile(b) for b in books]
        count, total = np.zeros((PARTS, many), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for p, part in enumerate(_split(_matrix(batch.column(0), width * PARTS))):
                index = files[p].nearest(part)[0]
                count[p] += np.bincount(index, minlength=many)
                np.add.at(total[p], index, part)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    sums = rows.select("q").mapInArrow(run, "part int, entry int, n long, total array<long>")
    new = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(width))).alias("total")).collect():
        new[r["part"], r["entry"]] = np.array(r["total"], np.int64) // r["n"]
    return new


def _coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of rows (id, label, q)."""
    width = books.shape[2]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, label string, code string, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: list[CellFile] = []
        for batch in batches:
            files = files or [CellFile(b) for b in books]
            found = [files[p].nearest(part) for p, part in enumerate(_split(_matrix(batch.column(2), width * PARTS)))]
            code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            text = [c.tobytes().hex() for c in code]
            error = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return rows.select("id", "label", "q").mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Rows (id, code, error, label_error) of the vectors, and the four codebooks (part, entry, position).

    Components become floor(SCALE x).  Vectors that are null or hold null or non-finite components
    are dropped; repeated rows stay.  A codebook starts as the parts of the ENTRIES rows with the
    smallest ids (nulls last, then by vector) and is improved ROUNDS times over all rows.
    label_error adds error up over equal labels; null labels are equal.  Vectors must be as long as
    the one with the smallest id, and that length a multiple of PARTS; others are in no codebook and
    have null code and errors.
    Components beyond LARGEST / SCALE raise an error, as sums would not be exact.  An empty table
    gives no rows and empty codebooks.  A codebook is 256 entries on the driver and in each task;
    equal labels are added up before they are joined, so a label of a third of all rows isn't gathered.
    """
    v = F.col(vector_col)
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("null"))
    rows = df.where(sound).select(F.col(id_col).alias("id"), label.alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("q"))
    rows = written(rows)
    order = (F.col("id").asc_nulls_last(), "q")
    head = rows.orderBy(*order).first()
    size = len(head["q"]) if head else 0
    if size % PARTS:
        raise ValueError(f"vectors of {size} components can't be cut into {PARTS} equal parts")
    fit, books = rows.where(F.size("q") == size), np.zeros((PARTS, 0, 0), np.int64)
    if head:
        books = np.stack(_split(np.array([r["q"] for r in fit.orderBy(*order).select("q").limit(ENTRIES).collect()], np.int64)))
        for _ in range(ROUNDS):
            books = _improved(fit, books)
    other = rows.where(F.size("q") != size).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = written(_coded(fit, books).unionByName(other))
    discard(rows)
    by_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    out = matched(coded, by_label, "label", "id", "left")
    return out.select(F.col("id").alias(id_col), "code", "error", F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error")), books


def compressed(df: DataFrame) -> DataFrame:
    """compress() of a table of embeddings, with the digest of the codebooks in each row."""
    rows, books = compress(df)
    return rows.withColumn("codebooks_sha256", F.lit(digest(books)))


def _sql() -> str:
    """Brute force: every part against every entry, with the sums as exact doubles."""
    near = lambda k: f"""a{k} AS (SELECT rid, p, any_value(x.v) AS v, min(CAST(list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v) AS BIGINT) * 256 + e) AS m
  FROM parts x JOIN b{k} b USING (p) GROUP BY rid, p)"""  # noqa: E731
    step = lambda k: f"""n{k} AS (SELECT p, e, list(f ORDER BY i) AS v FROM (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS DOUBLE) AS f FROM (SELECT p, m % 256 AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(n{k}.v, b{k}.v) AS v FROM b{k} LEFT JOIN n{k} USING (p, e))"""  # noqa: E731
    rounds = ",\n".join(f"{near(k)},\n{step(k)}" for k in range(ROUNDS))
    return f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, p, list_slice(q, p * len(q) // {PARTS} + 1, (p + 1) * len(q) // {PARTS}) AS v FROM kept, (SELECT unnest(range({PARTS})) AS p)),
b0 AS (SELECT p, rid - 1 AS e, v FROM parts WHERE rid <= {ENTRIES}),
{rounds},
{near(ROUNDS)},
coded AS (SELECT rid, string_agg(printf('%02x', CAST(m % 256 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid),
book AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM b{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), book"""


SQL = _sql()
