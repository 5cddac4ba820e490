"""The walks against sets and dictionaries on small random graphs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kithgraph.operators import graph as G
from kithgraph.operators import impressions as I
from kithgraph.operators import ranking as R
from kithgraph.plans import feed as P
from kithgraph.plans.dials import Dials
from kithgraph.schemas import Graph
from kithgraph.sources import store

NOW = 1_700_100_000


def make(spark, seed, users=25, posts=30, edges=260):
    rng = random.Random(seed)
    raw = [(rng.randrange(users), rng.randrange(posts), rng.choice([1, 2, 3]), NOW - rng.randrange(90_000), k) for k in range(edges)]
    meta = [(p, 100 + p % 6, p - p % 3 if p % 3 else None, p - p % 3 if p % 9 == 1 else None, NOW, p % 10 == 0) for p in range(posts) if p % 7]
    blocks = [(1, 2), (3, 103)]
    df = spark.createDataFrame(raw, "user_id long, post_id long, signal int, ts long, seq long")
    g = Graph(df, G.distinct_edges(df), spark.createDataFrame(meta, "post_id long, author_id long, root_id long, parent_id long, created_at long, is_nsfw boolean"),
        spark.createDataFrame([(p, ("art", "tech", "general")[p % 3]) for p in range(posts)], "post_id long, topic string"), spark.createDataFrame([(u,) for u in range(users + 2)], "user_id long"),
        spark.createDataFrame([(u, (u + 1) % users, 1) for u in range(users)], "follower_id long, followed_id long, seq long"), spark.createDataFrame(blocks, "blocker_id long, blocked_id long"),
        spark.createDataFrame([(u, u % posts, NOW - 3000, 1) for u in range(users)], "viewer_id long, post_id long, served_at long, seq long"))
    return g, raw, meta, blocks


def dedup(raw):
    first = {}
    for u, p, s, t, q in raw:
        if (u, p, s) not in first or q < first[u, p, s][1]:
            first[u, p, s] = (t, q)
    return [(u, p, s, t, q) for (u, p, s), (t, q) in first.items()]


def proof(n):
    return (n + 1) / (n + 3) * (1 + 0.15 * math.log1p(min(n, 500))) / (1 + 0.1 * math.log1p(max(0, n - 500) / 500))


@pytest.mark.parametrize("seed,heavy", [(1, 500), (2, 3)])
def test_tier_1_equals_sets(spark, seed, heavy, monkeypatch):
    g, raw, meta, blocks = make(spark, seed)
    if heavy != 500:
        real = G.overlaps
        monkeypatch.setattr(G, "overlaps", lambda pairs, posts, own=None: real(pairs, posts, heavy, own))
    edges = dedup(raw)
    own = {}
    for u, p, *_ in edges:
        own.setdefault(u, set()).add(p)
    degree = {}
    for _, p, *_ in edges:
        degree[p] = degree.get(p, 0) + 1
    barred = {(a, b) for a, b in blocks} | {(b, a) for a, b in blocks}
    want = {}
    for u, mine in own.items():
        if len(mine) < 10:
            continue
        near = []
        for v, theirs in own.items():
            n = len(mine & theirs)
            if v != u and (u, v) not in barred and n >= 2:
                near.append((n / math.sqrt(len(mine) * len(theirs)) * n / (n + 3), v))
        score, curators = {}, {}
        for conf, v in sorted(near, key=lambda x: (-x[0], x[1]))[:100]:
            for w, p, s, t, _ in edges:
                if w == v:
                    score[p] = score.get(p, 0) + conf * s * math.exp(-max(0, NOW - t) / 43_200)
                    curators.setdefault(p, set()).add(v)
        for p, a in score.items():
            k = len(curators[p])
            want[u, p] = a * (1 + 0.45 * math.log(k) if k > 1 else 1) * proof(degree[p])
    got = {(r.viewer_id, r.post_id): r.score for r in P.tier1(g, Dials(), NOW).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_velocity_equals_sums(spark):
    g, raw, _, _ = make(spark, 3)
    edges = dedup(raw)
    want = {}
    for _, p, s, t, _ in edges:
        if NOW - 21_600 <= t <= NOW:
            want[p] = want.get(p, 0) + s * math.exp(-(NOW - t) / 21_600)
    want = {p: x * proof(sum(1 for e in edges if e[1] == p)) for p, x in want.items()}
    got = {r.post_id: r.score for r in G.velocity(g.edges, NOW).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-5 for p in want)


def test_feed_invariants(spark):
    g, raw, meta, _ = make(spark, 4)
    author = {m[0]: m[1] for m in meta}
    root = {m[0]: m[2] for m in meta}
    seen = {(u, p) for u, p, *_ in raw}
    rows = P.feed(g, Dials(min_likes=0, explain=True), NOW).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.pos):
        by.setdefault(r.viewer_id, []).append(r)
        assert (r.viewer_id, r.post_id) not in seen or r.tier == 0
        assert r.explain.startswith("source=") and r.parent_id is None
    for own in by.values():
        assert [r.pos for r in own] == list(range(1, len(own) + 1)) and len({r.tier for r in own}) == 1
        roots = [root.get(r.post_id) or r.post_id for r in own]
        assert len(roots) == len(set(roots))
        assert all(sum(1 for r in own if author.get(r.post_id) == a) <= 2 for a in set(author.values()))
        assert all(a.score >= b.score for a, b in zip(own, own[1:], strict=False))


def test_thread_cap_replaces_in_place(spark):
    rows = [(1, 10, 5.0, 1, 10), (1, 11, 4.0, 2, None), (1, 12, 9.0, 3, 10)]
    df = spark.createDataFrame(rows, "viewer_id long, post_id long, score double, pos int, root_id long")
    assert [(r.post_id, r.pos) for r in R.thread_cap(df).orderBy("pos").collect()] == [(12, 1), (11, 2)]


def test_impression_runs(spark):
    log = [(1, 5, 0, 0), (1, 5, 100, 1), (1, 5, 21_699, 2), (1, 5, 43_299, 3), (1, 6, 0, 4)] + [(2, 9, k * 60, 10 + k) for k in range(12)]
    got = {(r.viewer_id, r.post_id): (r.last_served, r["count"]) for r in I.state(spark.createDataFrame(log, "viewer_id long, post_id long, served_at long, seq long")).collect()}
    assert got == {(1, 5): (43_299, 1), (1, 6): (0, 1), (2, 9): (660, 8)}


def test_snapshot_detects_damage(spark, tmp_path):
    g, *_ = make(spark, 5, edges=20)
    version = store.save(g, str(tmp_path), 42)
    loaded, cursor = store.load(spark, str(tmp_path))
    assert cursor == 42 and loaded.edges.exceptAll(g.edges).isEmpty() and g.blocks.exceptAll(loaded.blocks).isEmpty()
    (folder,) = (tmp_path / "data").iterdir()
    assert version == 1
    g.blocks.limit(1).write.mode("overwrite").parquet(f"{folder}/blocks")
    with pytest.raises(store.DamagedSnapshot):
        store.load(spark, str(tmp_path))
