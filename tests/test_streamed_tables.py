"""Streamed tables over files whose rows are out of order: edges, velocity, impressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kithgraph.operators import graph as G
from kithgraph.operators import impressions as I
from kithgraph.plans import dials as D
from kithgraph.plans import feed as P
from kithgraph.schemas import VELOCITY_WINDOW
from kithgraph.streaming import streams
from kithgraph.streaming import tables as ST
from tests.test_graph import NOW, make

SCHEMA = "user_id long, post_id long, signal int, ts long, seq long"


def some_edges(n=400, seed=3, step=86_400):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), rng.randrange(9), rng.randrange(1, 4), 1_700_000_000 + step * k, k) for k in range(n)]
    rng.shuffle(rows)
    return rows


def in_files(spark, tmp_path, rows, files=4):
    for k in range(files):
        spark.createDataFrame(rows[k::files], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_late_edges_are_taken_once(spark, tmp_path):
    rows = some_edges()
    stream, table = in_files(spark, tmp_path, rows), ST.EdgeTable(spark, f"{tmp_path}/table", buckets=32)
    plans = []

    def add(batch, n):
        plans.append(table.changes(batch, table.state()["data"])._jdf.queryExecution().toString())
        assert table.add(batch, "q", n) and not table.add(batch, "q", n)

    streams.drained(stream, add, f"{tmp_path}/state")
    first = {}
    for r in rows:
        first[r[:3]] = min(first.get(r[:3], r), r, key=lambda x: x[4])
    got = [tuple(r) for r in table.edges().collect()]
    assert sorted(got) == sorted(first.values()) and table.state()["version"] == 4
    assert table.rows().where("n < 0").count() > 10 and table.rows().agg(F.sum("n")).first()[0] == len(got)
    assert all(re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET)", p) for p in plans[1:])
    spark.createDataFrame([(99, 1, 1, 5, 1), (*got[0][:3], 1, 9_999)], SCHEMA).write.parquet(f"{tmp_path}/in/late")
    streams.drained(stream, lambda batch, n: table.add(batch, "q", n), f"{tmp_path}/state")
    assert sorted(map(tuple, table.edges().collect())) == sorted([*got, (99, 1, 1, 5, 1)])
    assert table.compact() and table.rows().count() == len(got) + 1 and table.vacuum()
    assert sorted(map(tuple, table.edges().collect())) == sorted([*got, (99, 1, 1, 5, 1)])


def test_only_the_buckets_of_a_batch_are_read(spark, tmp_path):
    table = ST.EdgeTable(spark, f"{tmp_path}/table", buckets=32)
    table.add(spark.createDataFrame(some_edges(), SCHEMA), "q", 0)
    one = spark.createDataFrame([(1, 2, 3, 4, 5)], SCHEMA)
    held = [f for f in table.changes(one, table.state()["data"]).inputFiles() if "bucket=" in f]
    everything = {f.split("bucket=")[1].split("/")[0] for f in table.rows().inputFiles()}
    assert len(everything) > 20 and len({f.split("bucket=")[1].split("/")[0] for f in held}) <= len(everything)
    plan = table.changes(one, table.state()["data"])
    plan.collect()
    assert "bucket" in plan._jdf.queryExecution().executedPlan().toString()


def test_an_edge_table_whose_folders_changed_is_compared_again(spark, tmp_path, monkeypatch):
    """Another writer commits between the comparison and the commit: the edge is in the table once."""
    first, second = (ST.EdgeTable(spark, f"{tmp_path}/table", buckets=2) for _ in range(2))
    edge = spark.createDataFrame([(1, 2, 3, 4, 5)], SCHEMA)
    plain, raced = first.changes, []

    def changes(batch, names):
        out = plain(batch, names)
        if not raced:
            raced.append(second.add(edge, "other", 0))
        return out

    monkeypatch.setattr(first, "changes", changes)
    assert first.add(edge, "q", 0) and raced == [True]
    assert first.rows().count() == 1 and first.state()["version"] == 2


@pytest.mark.parametrize("step", [40, 900])
def test_each_trigger_gives_the_batch_pool(spark, tmp_path, step):
    """Of all rows that came so far, first ones by seq counting, also where a later one came before."""
    rows = some_edges(300, 5, step)
    stream, seen = in_files(spark, tmp_path, rows), []
    order = [0, 1, 2, 3]
    edges, velocity = ST.EdgeTable(spark, f"{tmp_path}/edges", buckets=4), ST.VelocityTable(spark, f"{tmp_path}/sums")

    def keep(n, pool):
        came = spark.createDataFrame([r for k in range(n + 1) for r in rows[order[k] :: 4]], SCHEMA)
        held, now = G.distinct_edges(came), velocity.now()
        assert G.now_of(held) <= now <= G.now_of(came) and sorted(edges.edges().collect()) == sorted(held.collect())
        seen.append(n)
        close = lambda df: {r["rank"]: (r["post_id"], r["score"]) for r in df.collect()}
        got, want = close(pool), close(G.velocity(held, now))
        assert want and got.keys() == want.keys()
        assert all(abs(got[k][1] - want[k][1]) < 1e-5 for k in want) and sorted(p for p, _ in got.values()) == sorted(p for p, _ in want.values())

    streams.drained(stream, ST.velocity_batches(edges, velocity, f"{tmp_path}/state", keep, 1), f"{tmp_path}/state")
    assert seen == [0, 1, 2, 3]
    old = velocity.rows().where(F.col("ts").isNull())
    if step == 900:
        assert old.count() > 0 and old.count() == old.select("post_id").distinct().count()
    assert velocity.rows().agg(F.sum("n")).first()[0] == edges.edges().count() == len({r[:3] for r in rows})
    last = [c for c in velocity.state()["applied"]]
    assert not velocity.add(edges.last(last[0]), last[0], 3)


def test_pool_memo(spark, tmp_path):
    velocity = ST.VelocityTable(spark, f"{tmp_path}/sums")
    memo = ST.PoolMemo(velocity)
    assert memo.get(1_000) == []
    came = lambda *row: spark.createDataFrame([row], f"{SCHEMA}, n int")
    velocity.add(came(1, 7, 1, 1_000, 1, 1), "q", 0)
    first = memo.get(1_000)
    assert [r[0] for r in first] == [7]
    velocity.add(came(1, 8, 3, 1_002, 2, 1), "q", 1)
    assert memo.get(1_009) is first
    assert [r[0] for r in memo.get(1_010)] == [8, 7]
    back = memo.get(1_001)
    assert [r[0] for r in back] == [7] and memo.get(1_001) is back
    assert memo.get(1_002 + VELOCITY_WINDOW + 50) == [] and memo.at == 1_001


def test_a_request_counts_once(spark, tmp_path):
    g, *_ = make(spark, 8)
    dials = D.Dials(min_likes=0, include_replies=True, limit=3)
    log = ST.ImpressionLog(spark, f"{tmp_path}/log", buckets=3)
    assert log.impressions().count() == 0
    first, rows = P.serve_page(g, 4, dials, NOW, request="r1", log=log)
    shown = {r["post_id"] for r in first.collect()}
    want = {tuple(r) for r in rows.collect()}
    assert {tuple(r) for r in log.impressions().collect()} == want and len(shown) == 3
    P.serve_page(g, 4, dials, NOW, request="r1", log=log)
    assert {tuple(r) for r in log.impressions().collect()} == want
    # Another page of the same second has numbers of its own, and the next page is damped by what was shown.
    P.serve_page(g, 4, D.Dials(min_likes=0, include_replies=True, limit=3, cursor="3"), NOW, request="r2", log=log)
    seqs = [r["seq"] for r in log.impressions().collect()]
    assert len(seqs) == len(set(seqs)) == 6
    g.impressions = g.impressions.unionByName(log.impressions())
    state = {r["post_id"]: r["count"] for r in I.state(log.impressions()).collect()}
    assert set(state.values()) == {1} and shown <= state.keys()
    later = P.feed(g, dials, NOW + 60, spark.createDataFrame([(4,)], "user_id long"))
    damped = {r["post_id"]: r["mult"] < 1 for r in later.collect()}
    assert shown & damped.keys() and {p for p, d in damped.items() if d} <= state.keys() and all(damped[p] for p in shown & damped.keys())
    assert log.compact() and log.rows().count() == 6 and len(log.state()["data"]) == 1
