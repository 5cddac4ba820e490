"""The graph of order lines is whole: no customer and no line is left out, in the queries and in their SQL."""

from pathlib import Path

import pytest

from kithgraph.plans import catalog
from kithgraph.sources.tables import sparse

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def database():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


def test_every_order_line_is_an_event(spark):
    lines = database().execute("SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchone()[0]
    g = sparse(spark, DATA)
    assert g.raw.count() == lines
    assert g.raw.where("user_id % 10 = 0").count() > 0


@pytest.mark.parametrize("name", ["post_degree", "user_cardinality", "graph_stats", "pair_bayesian", "taste_twins_topk", "tier2_candidates", "feed_all_viewers"])
def test_equals_duckdb_over_all_lines(spark, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), database().execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
