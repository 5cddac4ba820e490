"""Preview tiers, removals, saved dials, dictionary and JSON bodies on small tables."""

import json

import pytest
from pyspark.sql import functions as F
from test_graph import NOW, make

from kithgraph.functions import scalars as S
from kithgraph.operators import maintenance as M
from kithgraph.operators import ranking as R
from kithgraph.plans import dials as D
from kithgraph.plans import feed as P
from kithgraph.plans import responses, telemetry
from kithgraph.plans.explain import step_rows
from kithgraph.sources import frames, store


def test_preview_falls_to_the_next_tier(spark):
    """Users 25 and 26 have no edges: 25 follows user 4, 26 nobody."""
    g, *_ = make(spark, 5)
    g.follows = g.follows.union(spark.createDataFrame([(25, 4, 1)], "a long, b long, c long"))
    dials = D.Dials(min_likes=0, explain=True, include_replies=True)
    rows = P.preview_tiers(store.shared(g), dials, NOW).collect()
    tiers = {v: {r["tier"] for r in rows if r["viewer_id"] == v} for v in (25, 26)}
    assert tiers == {25: {2}, 26: {3}}
    assert all(r["chain"] == "follow" and r["followed_id"] == 4 and "this " in r["steps"][1]["description"] for r in rows if r["viewer_id"] == 25)
    assert all(r["chain"] == "trend" and r["time_decay"] == 1.0 for r in rows if r["viewer_id"] == 26)
    assert all(r["twin_id"] is not None and r["chain"] == "twin" for r in rows if r["tier"] == 1)
    own = P.preview(g, D.Dials(min_likes=0, include_replies=True), NOW).select("viewer_id", "post_id", "pos")
    assert {tuple(r) for r in own.collect()} == {(r["viewer_id"], r["post_id"], r["pos"]) for r in rows if r["tier"] == 1}


def test_steps_are_numbered(spark):
    g, *_ = make(spark, 6)
    steps = step_rows(P.preview_tiers(g, D.Dials(min_likes=0, explain=True), NOW))
    assert {r["n"] for r in steps.collect()} == {1, 2, 3}


def test_removed_edges_stay_gone_until_they_return(spark):
    g, *_ = make(spark, 7)
    g.raw = spark.createDataFrame([(1, 1, 1, 10, 1), (1, 1, 1, 30, 5), (1, 2, 1, 20, 2), (2, 2, 3, 20, 3), (2, 2, 1, 20, 4)], "user_id long, post_id long, signal int, ts long, seq long")
    undo = spark.createDataFrame([(1, 1, 1, 3), (1, 1, 1, 2), (2, 2, 3, 9), (9, 9, 1, 9)], "user_id long, post_id long, signal int, seq long")
    left = M.without_interactions(g, undo).edges.select("user_id", "post_id", "signal", "ts").collect()
    assert sorted(map(tuple, left)) == [(1, 1, 1, 30), (1, 2, 1, 20), (2, 2, 1, 20)]


def test_saved_dials(spark):
    good, other = D.Dials(tau=7200.0, explore=0.2), D.Dials(min_likes=9)
    bad = D.to_row(1, good) | {"explore": 0.9}
    log = [D.to_row(1, good) | {"deleted": False, "seq": 1}, bad | {"deleted": False, "seq": 2}, D.to_row(2, other) | {"deleted": False, "seq": 3}, D.to_row(2, other) | {"deleted": True, "seq": 4}]
    kept = D.saved_after(spark.createDataFrame(log, "user_id long, half_life_s double, explore double, art double, tech double, science double, news double, culture double, include_replies boolean, no_nsfw boolean, min_likes int, deleted boolean, seq long")).collect()
    assert [r["user_id"] for r in kept] == [1] and D.from_row(kept[0].asDict()) == good
    with pytest.raises(ValueError):
        D.to_row(1, D.Dials(explore=0.9))


def test_dictionary_both_ways(spark):
    known = frames.dictionary(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "value string"))
    ids = {r["value"]: r["id"] for r in known.collect()}
    assert set(ids) == {"a", "b"} and len(set(ids.values())) == 2
    asked = frames.looked_up(spark.createDataFrame([("a",), ("z",), (None,)], "s string"), known, "s", "id")
    assert {r["s"]: r["id"] for r in asked.collect()} == {"a": ids["a"], "z": None, None: None}
    back = frames.resolved(spark.createDataFrame([(ids["b"],), (-5,)], "n long"), known, "n", "s")
    assert {r["n"]: r["s"] for r in back.collect()} == {ids["b"]: "b", -5: None}


def test_topic_flags(spark):
    rows = spark.createDataFrame([("art",), ("general",), ("other",), (None,)], "t string").select("t", S.topic_flag(F.col("t")).alias("f")).withColumn("back", S.topic_of_flag(F.col("f")))
    assert {r["t"]: (r["f"], r["back"]) for r in rows.collect()} == {"art": (2, "art"), "general": (12, "general"), "other": (0, None), None: (0, None)}


def test_bodies(spark):
    page = R.page(spark.createDataFrame([(1, 7, 2), (1, 9, 1), (1, 8, 3), (2, 5, 1)], "viewer_id long, post_id long, pos int"), 2)
    got = {r["viewer_id"]: json.loads(r["body"]) for r in responses.skeletons(page).collect()}
    assert got == {1: {"feed": [{"post": "9"}, {"post": "7"}], "cursor": "2"}, 2: {"feed": [{"post": "5"}]}}
    g, *_ = make(spark, 8)
    proof = responses.proofs(P.preview_tiers(g, D.Dials(min_likes=0, explain=True), NOW)).first()["body"]
    assert set(json.loads(proof)) == {"steps", "summary"} and len(json.loads(proof)["steps"]) == 3


def test_counts(spark):
    g, *_ = make(spark, 9)
    counts = {r["store"]: (r["keys"], r["rows"]) for r in telemetry.store_counts(g).collect()}
    assert counts["follows"] == (25, 25) and counts["blocks"] == (2, 2) and counts["users"][1] == g.edges.count()
    per = telemetry.impression_counts(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "viewer_id long, post_id long")).collect()
    assert sorted(map(tuple, per)) == [(1, 2, 2), (2, 1, 2)]


def test_pages_of_a_session(spark):
    """Impressions of page 1 change the ranking, but not the pages of the session that began before."""
    g, *_ = make(spark, 8)
    dials, sessions = D.Dials(min_likes=0, include_replies=True, limit=3), D.Sessions()
    first, rows = P.serve_page(g, 4, dials, NOW, sessions)
    shown = [r["post_id"] for r in first.orderBy("pos").collect()]
    seqs = [r["seq"] for r in rows.collect()]
    assert sorted(r["post_id"] for r in rows.collect()) == sorted(shown) and min(seqs) > 1 and len(set(seqs)) == len(seqs)
    whole = [r["post_id"] for r in P.feed(g, dials, NOW, spark.createDataFrame([(4,)], "user_id long")).orderBy("pos").collect()]
    g.impressions = store.written(g.impressions.unionByName(rows))
    second, later = P.serve_page(g, 4, D.Dials(min_likes=0, include_replies=True, limit=3, cursor="3"), NOW + 5, sessions)
    assert shown + [r["post_id"] for r in second.orderBy("pos").collect()] == whole[:6]
    assert min(r["seq"] for r in later.collect()) > max(seqs)
    assert P.serve_page(g, 4, dials, NOW, sessions)[0].where("mult < 1").count() == 0 or len(whole) < 6


def test_sections_of_a_snapshot(spark, tmp_path):
    g, *_ = make(spark, 9)
    known = frames.dictionary(spark.createDataFrame([("a",), ("b",), (None,)], "value string"))
    saved = spark.createDataFrame([D.to_row(3, D.Dials(min_likes=7))])
    version = store.save(g, str(tmp_path), 5, {"dictionary": known, "dials": saved})
    assert {tuple(r) for r in store.section(spark, str(tmp_path), "dictionary", version).collect()} == {tuple(r) for r in known.collect()}
    assert D.from_row(store.section(spark, str(tmp_path), "dials").first().asDict()).min_likes == 7
    assert store.load(spark, str(tmp_path))[1] == 5
    status = store.status(spark, str(tmp_path)).first()
    assert (status["version"], status["cursor"]) == (version, 5)
    with pytest.raises(store.DamagedSnapshot):
        store.section(spark, str(tmp_path), "other")
    with pytest.raises(ValueError):
        store.save(g, str(tmp_path), 5, {"edges": known})


def test_preview_bodies(spark):
    """Posts in order with the parts of their scores and their proofs."""
    import json

    from kithgraph.plans import responses

    g, *_ = make(spark, 6)
    rows = store.written(P.preview_tiers(g, D.Dials(min_likes=0, explain=True), NOW))
    bodies = {r["viewer_id"]: json.loads(r["body"]) for r in responses.previews(rows, 12).collect()}
    for viewer, body in bodies.items():
        own = rows.where(F.col("viewer_id") == viewer).orderBy("pos").collect()
        assert body["viewer_did"] == str(viewer) and body["total_candidates"] == len(own) and body["query_latency_us"] == 12
        assert [i["uri"] for i in body["items"]] == [str(r["post_id"]) for r in own]
        assert all(i["score_breakdown"]["final_score"] == round(r["score"], 6) and i["tier"].startswith(f"Tier {r['tier']}") and i["proof_chain"]["steps"] for i, r in zip(body["items"], own, strict=True))
    assert bodies
