import numpy as np

from kithgraph.llm import quality


def junk(k):
    return " ".join(f"word{k}***" for _ in range(40)) if k % 2 else "BUY NOW!! " * 30


def prose(k):
    rng = np.random.default_rng(k)
    return ". ".join(" ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(9)).capitalize() for _ in range(6)) + "."


def test_votes_equal_brute_force():
    rng = np.random.default_rng(1)
    texts = [junk(k) if k % 3 == 0 else prose(k) for k in range(90)]
    shares = np.array([quality.terms(t) for t in texts])
    labels = np.array([0.0 if k % 3 == 0 else 1.0 for k in range(90)])
    model = quality.fit(shares, labels, dimensions=8, neighbours=5)
    got = model.score(shares)
    for k in rng.integers(0, 90, 20):
        near = np.round(model.vectors @ model.project(shares[k : k + 1])[0], 9)
        least = sorted(near)[-5]
        vote = [(max(s, 0) ** model.sharpness, y) for s, y in zip(near, labels, strict=True) if s >= least and s > 0]
        assert abs(got[k] - sum(w * y for w, y in vote) / sum(w for w, _ in vote)) < 1e-9
    assert ((got >= 0.3) == (labels > 0)).mean() > 0.95


def test_edge_cases(spark):
    rows = [(k, junk(k) if k % 3 == 0 else prose(k), "s") for k in range(60)] + [(60, "", "s"), (61, None, "s"), (None, prose(99), "s"), (5, prose(5), "s"), (62, "x" * 200_000, "s")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, score string")
    labels = spark.createDataFrame([(k, 0 if k % 3 == 0 else 1, 0) for k in range(60)] + [(1, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    empty = [r.score for r in out if r.doc_id in (60, 61)]
    assert empty == [model.prior, model.prior]
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
