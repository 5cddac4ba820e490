"""Connected components by alternating star operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.shared import discard, written


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest id that it reaches.

    Every round links the larger neighbours of each node to its smallest neighbour, then the
    smaller ones; edges end as stars around component minima after a logarithmic number of rounds.
    No node's neighbours are gathered: minima are aggregates, joined back to the edges.  Edges
    with a null end are ignored.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = written(now.distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, written(small)
        discard(before)
        old, mark = mark, _mark(now)
        if mark == old:
            break
    return now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("x")).select("x.node", "x.component").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Rows, and sums of both halves of their 64-bit hashes."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftright(h, 32)).alias("high")).first()
    return row["n"], row["low"], row["high"]


def labels(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest row that it reaches."""
    own = np.arange(len(adjacent))
    reach = adjacent | np.eye(len(adjacent), dtype=bool)
    while True:
        new = np.where(reach, own, len(own)).min(axis=1, initial=len(own))
        new = new[new]
        if (new == own).all():
            return own
        own = new
