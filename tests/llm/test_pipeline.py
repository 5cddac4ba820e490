from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
def test_stages_keep_columns_and_tokens(spark):
    import corpus_pipeline
    from kithgraph.llm import shingles

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == docs.columns, name
        seen.append(out.count())
        docs = out
    assert seen[0] > seen[1] == seen[2] > seen[3]
    comps = shingles.link_documents(docs).collect()
    assert all(r.component_id == r.doc_id for r in comps)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert packed.groupby("doc_id").length.sum().eq(packed.groupby("doc_id").doc_tokens.first()).all()
    sizes = packed.groupby("sequence_id").length.sum()
    assert ((sizes == 2048) | ((sizes & (sizes - 1)) == 0)).all()
    assert packed.doc_id.nunique() == seen[3]
