"""Walks and pairs whose rows stay in one task: what is shuffled grows with the edges, not with the walk; results against sets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kithgraph.operators import graph as G
from kithgraph.operators import impressions as I
from kithgraph.operators import ranking as R
from kithgraph.plans import explain as X
from kithgraph.plans import feed as P
from kithgraph.plans import twins
from kithgraph.plans.dials import Dials
from kithgraph.schemas import Graph
from kithgraph.sources import store
from tests.test_graph import NOW, dedup, make


def shuffled(spark, run) -> tuple[object, int]:
    """What run() gives, and the records that its shuffles wrote."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()

    def total():
        jsc.listenerBus().waitUntilEmpty(30_000)
        stages = jsc.statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    out = run()
    return out, total() - before


def sparse_graph(spark, users=1_000, posts=2_000, each=20):
    """Every user has `each` posts: a walk meets users * each * each * users / posts pairs, hardly any twice."""
    rng = random.Random(7)
    raw = [(u, p, 1 + (u + p) % 3, NOW - rng.randrange(90_000), u * each + k) for u in range(users) for k, p in enumerate(rng.sample(range(posts), each))]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = table(raw, "user_id long, post_id long, signal int, ts long, seq long")
    meta = table([(p, 100_000 + p % 40, None, None, NOW, False) for p in range(posts)], "post_id long, author_id long, root_id long, parent_id long, created_at long, is_nsfw boolean")
    return Graph(edges, edges, meta, table([(p, "art") for p in range(posts)], "post_id long, topic string"), table([(u,) for u in range(users)], "user_id long"),
        table([(u, (u + 10 * f) % users, f) for u in range(users) for f in range(1, 6)], "follower_id long, followed_id long, seq long"), table([(1, 2)], "blocker_id long, blocked_id long"),
        table([(u, u % posts, NOW - 3_000, 1) for u in range(users)], "viewer_id long, post_id long, served_at long, seq long"))


def taken(df):
    df.write.format("noop").mode("overwrite").save()


def test_no_pair_of_the_walk_is_shuffled(spark):
    """About 190,000 pairs are met, from 20,000 edges."""
    g = store.shared(sparse_graph(spark))
    _, n = shuffled(spark, lambda: taken(twins.taste_twins(g)))
    assert n < 190_000


def test_candidates_of_the_first_tier_are_not_shuffled(spark):
    """tier1: some 340,000 posts of neighbours, filtered, damped and capped without a shuffle of one of them."""
    g = store.shared(sparse_graph(spark))
    c = P.tier1(g, Dials(min_likes=0), NOW)
    rows = c.count()
    _, n = shuffled(spark, lambda: taken(c))
    assert rows > 250_000 > n
    _, n = shuffled(spark, lambda: taken(P.feed(g, Dials(min_likes=0), NOW)))
    assert n < 2 * rows
    _, n = shuffled(spark, lambda: taken(P.preview_twins(g, Dials(min_likes=0), NOW)))
    assert n < 2 * rows


def test_candidates_of_the_second_tier_are_not_shuffled(spark):
    """100,000 posts of followed users; the caps need no shuffle of their own."""
    g = store.shared(sparse_graph(spark))
    now, dials = NOW, Dials(min_likes=0)

    def placed():
        c = I.scaled(P.tier2(g, dials, now, passing=True, history=I.state(g.impressions)), now).withColumn("score", F.round("damped", 9))
        taken(R.author_cap(R.thread_cap(R.positions(c))))

    _, n = shuffled(spark, placed)
    assert n < 120_000


@pytest.mark.parametrize("wide,scanned", [(500, None), (500, 5), (4, None), (4, 5), (8, 7)])
def test_neighbours_equal_sets(spark, monkeypatch, wide, scanned):
    """Also where posts are wider than the bound and the walk is cut."""
    monkeypatch.setattr(G, "POST_EDGES", wide)
    g, raw, _, blocks = make(spark, wide + (scanned or 0))
    own, by_user, by_post = {}, {}, {}
    for u, p, s, t, q in sorted(dedup(raw), key=lambda e: -e[4]):
        own.setdefault(u, set()).add(p)
        by_user.setdefault(u, []).append(p)
        by_post.setdefault(p, []).append(u)
    barred = {(a, b) for a, b in blocks} | {(b, a) for a, b in blocks}
    want = {}
    for u, mine in by_user.items():
        first = {}
        for i, p in enumerate(mine[:50]):
            for j, v in enumerate(by_post[p][:wide]):
                if v != u and (u, v) not in barred:
                    first[v] = min(first.get(v, (0, 0)), (-i, -j)) if v in first else (-i, -j)
        met = sorted(first, key=lambda v: first[v])[:scanned]
        for v in met:
            n = len(own[u] & own[v])
            if n >= 2:
                want[u, v] = (n, n / math.sqrt(len(own[u]) * len(own[v])) * n / (n + 3), mine[-first[v][0]])
    got = {(r.u, r.v): (r.shared, r.conf, r.seed_post) for r in G.neighbours(g, scanned=scanned).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 and got[k][2] == want[k][2] for k in want)


@pytest.mark.parametrize("wide", [0, 6, 9, 500])
def test_similar_pairs_equal_sets(spark, monkeypatch, wide):
    """All posts wide, some, or none; users in several blocks."""
    monkeypatch.setattr(G, "POST_EDGES", wide)
    monkeypatch.setattr(G, "BLOCK", 7)
    g, raw, *_ = make(spark, 3, posts=90)
    own = {}
    for u, p, *_ in raw:
        own.setdefault(u, set()).add(p)
    want = {(u, v): (len(own[u] & own[v]), len(own[u]), len(own[v])) for u in own for v in own if u < v and own[u] & own[v]}
    rows = G.similar_pairs(g.edges).collect()
    assert {(r.u, r.v): (r.shared, r.n_u, r.n_v) for r in rows} == want and len(rows) == len(want)


def test_pairs_of_wide_posts_are_not_counted_post_by_post(spark, monkeypatch):
    """60 users with 300 posts in common: 1,770 pairs from 60 * 5 words, not 531,000 rows."""
    monkeypatch.setattr(G, "POST_EDGES", 50)
    edges = spark.range(60).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(299).cast("long"))).alias("post_id"))
    pairs = G.similar_pairs(edges)
    assert {(r.shared, r.n_u, r.n_v) for r in pairs.collect()} == {(300, 300, 300)} and pairs.count() == 60 * 59 // 2
    width = edges.groupBy("post_id").agg(F.count("*").alias("w"))
    assert G.bit_words(edges, width, 1).count() == 60 * 5


@pytest.mark.parametrize("wide", [5, 500])
def test_asked_pairs_equal_sets(spark, monkeypatch, wide):
    monkeypatch.setattr(X, "POST_EDGES", wide)
    g, raw, _, blocks = make(spark, 9)
    own = {}
    for u, p, *_ in raw:
        own.setdefault(u, set()).add(p)
    barred = {(a, b) for a, b in blocks} | {(b, a) for a, b in blocks}
    asked = {u: [v for v in range(25) if (u + v) % 3] for u in (1, 3, 4, 9, 26)}
    follows = {(u, (u + 1) % 25) for u in range(25)}
    none = set()
    want = {(u, v): (n, (u, v) in follows) for u, many in asked.items() for v in many if u != v and (u, v) not in barred for n in [len(own.get(u, none) & own.get(v, none))] if n >= 2 or (u, v) in follows}
    got = X.asked_pairs(g, spark.createDataFrame(list(asked.items()), "u long, v array<long>"))
    assert {(r.u, r.v): (r.shared, r.followed) for r in got.collect()} == want


def test_explained_pairs_are_counted_where_asked(spark):
    """Two requests by each of 1,000 viewers: no row for each of the 190,000 pairs with a post in common."""
    g = store.shared(sparse_graph(spark))
    asked = g.users.select(F.col("user_id").alias("viewer_id"), F.explode(F.array(F.col("user_id") * 2, F.lit(3).cast("long"))).alias("post_id"))
    _, n = shuffled(spark, lambda: taken(X.explain(g, asked)))
    assert n < 300_000


def test_listed_equals_the_caps_one_by_one(spark):
    rng = random.Random(5)
    rows = [(v, p, float(rng.randrange(30)), p % 7, rng.choice([None, p - p % 4])) for v in range(4) for p in rng.sample(range(200), 90)]
    df = spark.createDataFrame(rows, "viewer_id long, post_id long, score double, author_id long, root_id long")
    want = R.dense_positions(R.author_cap(R.thread_cap(R.positions(df)))).select("viewer_id", "post_id", "pos").collect()
    assert sorted(map(tuple, R.listed(df).select("viewer_id", "post_id", "pos").collect())) == sorted(map(tuple, want))


def test_written_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(store.CLEANUP, None)
    assert store.written(spark.range(5)).count() == 5 and spark.conf.get(store.CLEANUP, None) == before
