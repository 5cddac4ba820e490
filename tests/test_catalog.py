"""Registered queries against DuckDB on the smallest tables, and the entry without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from kithgraph.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
SAMPLE = ["edge_dedup", "graph_stats", "velocity_pool", "pair_bayesian", "twin_interests", "tier2_candidates", "tier3_interleaved", "impression_state", "unseen_ceiling", "topic_hash", "topic_content", "parse_frames", "apply_events", "orphan_meta", "compact_ids", "dial_precedence", "stream_impressions"]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_equals_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


CODE = "import __spark_entry__ as e; q = e.queries(); assert 'velocity_pool' in q and not any(x.startswith('op') for x in q) and 'pipeline' not in q; e.oracle_sql()"


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("leftover", [True, False])
def test_entry_imports_without_the_llm_folder(tmp_path, pipeline, leftover):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "kithgraph", tmp_path / "kithgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    if leftover:
        (tmp_path / "kithgraph/llm/__pycache__").mkdir(parents=True)
    assert subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, timeout=60).returncode == 0


def test_a_broken_llm_folder_is_an_error(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "kithgraph", tmp_path / "kithgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "kithgraph/llm").mkdir()
    (tmp_path / "kithgraph/llm/__init__.py").touch()
    (tmp_path / "kithgraph/llm/queries.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, timeout=60, stderr=subprocess.DEVNULL).returncode != 0
