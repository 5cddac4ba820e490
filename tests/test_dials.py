import pytest

from kithgraph.operators.ranking import start_of
from kithgraph.plans.dials import Dials, Sessions, from_query, parse_discovery, parse_floor, parse_freshness, problem, resolve


@pytest.mark.parametrize("text,want", [("1+", 1), ("3+", 3), ("10+", 10), ("all", 0), ("0", 0), ("25", 25), ("25+", 25), ("x", 3), (None, 3), ("999", 100)])
def test_floor(text, want):
    assert parse_floor(text) == want


def test_presets():
    assert parse_freshness(" Realtime ") == 7200 and parse_freshness("100") == 3600 and parse_freshness("x") == 43_200 and parse_freshness("1e9") == 604_800
    assert parse_discovery("HIGH") == 0.35 and parse_discovery("2") == 1.0 and parse_discovery("2", most=0.5, normalise=False) == 0.5 and parse_discovery("HIGH", normalise=False) == 0.15


def test_precedence():
    saved = Dials(tau=7200.0, explore=0.3, min_likes=10, no_nsfw=True)
    d = resolve({"freshness": "bad", "replies": "all", "tech": 9.0, "limit": 500}, saved)
    assert (d.tau, d.explore, d.min_likes, d.no_nsfw, d.include_replies, d.weights["tech"], d.limit) == (7200.0, 0.3, 10, True, True, 5.0, 100)
    assert resolve({"safe_mode": "off"}, saved).no_nsfw is False and resolve({}).tau == 43_200
    assert from_query({"safe_mode": " ON ", "engagement_floor": "curated"}).min_likes == 10


def test_validation_and_sessions():
    assert problem(Dials()) is None and problem(Dials(tau=float("nan"))) == "freshness" and problem(Dials(explore=0.6)) == "discovery" and problem(Dials(min_likes=101)) == "min_likes"
    assert Dials(limit=5, cursor="9").fingerprint() == Dials().fingerprint() != Dials(min_likes=4).fingerprint()
    s = Sessions(most=1)
    s.put(1, Dials(), 100, "ranking")
    assert s.get(1, Dials(limit=7), 400) == "ranking" and s.get(1, Dials(), 401) is None and s.get(1, Dials(), 99) is None
    s.put(2, Dials(), 100, "other")
    assert s.get(1, Dials(), 100) is None


@pytest.mark.parametrize("cursor,want", [(None, 0), ("30", 30), ("MzA", 30), ("!!", 0), ("", 0), ("-3", 0)])
def test_cursor(cursor, want):
    assert start_of(cursor) == want
