import hashlib

import pytest
from pyspark.sql import functions as F

from kithgraph.llm import fingerprints as fp

A = "First line here, with a comma. And more.\nSecond line, different; text!\nThird"


def prints(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["f"] for r in fp.with_fingerprint(df, "t", "f").orderBy("k").collect()]


def test_sums_ignore_order_and_follow_insertion_and_deletion(spark):
    lines = A.split("\n")
    whole, turned, head, tail, empty, null = prints(spark, [A, "\n".join(lines[::-1]), "\n".join(lines[:2]), lines[2], "", None])
    assert whole == turned and len(whole) == fp.LANES + 1 and len(set(whole)) > fp.LANES // 2
    assert empty == null == [0] * (fp.LANES + 1)
    row = spark.createDataFrame([(whole, head, tail)], "w array<int>, h array<int>, t array<int>")
    assert row.select((fp.inserted(F.col("h"), F.col("t")) == F.col("w")) & (fp.deleted(F.col("w"), F.col("t")) == F.col("h"))).first()[0]


def brute(rows):
    """(id, edited text) by the rule, over rows with distinct (id, text)."""
    tie = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    out = set()
    for k, (i, t) in enumerate(rows):
        nxt, cut = rows[(k + 1) % len(rows)][1], len(t) // 3
        out.add((i, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bucket_rows", [2, 20_000])
def test_edits_follow_the_next_document(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(fp, "BUCKET_ROWS", bucket_rows)
    rows = [(k, f"text {k}, é漢😀 " * (k % 5)) for k in range(40)] + [(7, "other"), (7, "other"), (None, "n"), (3, None), (100, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").withColumn("n_chars", F.lit(9))
    got = fp.fingerprint_documents(df).collect()
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == brute(rows) and len(got) == len(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_empty_and_single(spark):
    schema = "doc_id long, text string"
    assert fp.fingerprint_documents(spark.createDataFrame([], schema)).count() == 0
    r = fp.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], schema)).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0


def test_likeness_follows_shared_paragraphs(spark):
    base = [f"Paragraph number {k} says thing {k * k}." for k in range(60)]
    df = spark.createDataFrame([(2, "\n".join(base)), (1, "\n".join(f"unlike {k} at all {k}" for k in range(60)))], "doc_id long, text string")
    r = fp.fingerprint_documents(df).where("doc_id = 2").first()
    assert 0.4 < r.near_edited < 0.95 and r.near_next < 0.4


def test_long_and_repetitive_texts_do_not_wrap(spark):
    own = [f"piece {k}" for k in range(40)]
    texts = ["\n".join(own + ["again"] * 473), "\n".join(own[:20] + ["again"] * 473), "\n".join(f"n{k}" for k in range(120_000))]
    f, g, many = prints(spark, texts)
    assert f[-1] == 513 and many[-1] == 120_000 and max(many) > 1 << 27
    row = spark.createDataFrame([(f, g, many)], "f array<bigint>, g array<bigint>, m array<bigint>")
    f, g, m = F.col("f"), F.col("g"), F.col("m")
    c = fp.centred
    near, far, same = row.select(fp.likeness(f, g, c(f), c(g)), fp.likeness(f, m, c(f), c(m)), fp.deleted(fp.inserted(m, f), f) == m).first()
    assert near > 0.98 and far < 0.5 and same  # the multisets' own cosines: 0.9999 and 0
    dev = row.select(c(m).alias("c")).first()["c"]
    assert 0.5 < sum(x * x for x in dev) / (64 * 120_000 * (4096**2 - 1) / 12) < 2


def test_narrow_form_keeps_large_sums(spark):
    sums = [(1 << 43) - 1, 0, 5, (1 << 31) - 1, 1 << 31]
    row = spark.createDataFrame([(sums, [1, 2, 3])], "a array<bigint>, b array<bigint>")
    a, b = (fp.narrow(F.col(x)) for x in "ab")
    got = row.select(fp.widened(a).alias("a"), fp.widened(b).alias("b"), b["high"].isNull().alias("n")).first()
    assert got["a"] == sums and got["b"] == [1, 2, 3] and got["n"]
