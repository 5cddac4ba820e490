import hashlib
import random
import re
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from kithgraph.llm import middles

SCHEMA = "doc_id long, text string, key string, n long, rolls int"


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text, text
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, len(tokens), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", text


def texts(n, seed):
    rng = random.Random(seed)
    out = [None, "", "a", "<", "<P", "<P>", "x<S>y", "<<M>", "<p>", "P>", "abc def", "1\n2\r\n", "<P<S<M", "é漢\U0001f600z", "<S", "ab<", "a" * 500, "<" * 90, "[" * 40 + "@`{"]
    return out + ["".join(rng.choice(["<", ">", "P", "S", "M", "a", "bc", " ", "é", "\n", "7", "\U0001f600"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("size,fan", [(1, 2), (2, 3), (3, 256), (7, 2), (32_768, 256)])
def test_rows_equal_brute_force(spark, monkeypatch, size, fan):
    """Chunks of a few code points cut through words and marks; blocks of a few chunks through their composition."""
    monkeypatch.setattr(middles, "FAN", fan)
    rows = [(k, t, "clash", -1, 4) for k, t in enumerate(texts(250, 7))] + [(None, "no id at all, two words", None, 0, 0)] * 2
    rows += [(3, "another text of the same id " * 4, None, 0, 0)] + [(40, "a copy of a long text " * 9, None, 0, 0)] * 5
    out = middles.fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(3), size=size)
    got = out.withColumn("again", middles.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((brute(i, t) for i, t, *_ in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_summaries_compose(spark):
    """Any cutting of a text gives the summary of the whole, for every state of entry."""
    rng = random.Random(8)
    rows, want = [], {}
    for k, t in enumerate(t for t in texts(80, 9) if t):
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t), 4)))
        parts = [t[a:b] for a, b in pairwise([0, *cuts, len(t)])]
        rows.append((k, [middles.Chunk(p).summary() for p in parts]))
        want[k] = middles.Chunk(t).summary()
    df = spark.createDataFrame(rows, "k int, parts array<struct<ends:array<long>,tokens:array<long>,marks:array<long>>>")
    got = df.select("k", middles.composed(F.col("parts")).alias("f")).collect()
    assert {r["k"]: (r["f"]["ends"], r["f"]["tokens"], r["f"]["marks"]) for r in got} == want


def test_empty_table(spark):
    out = middles.digests(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
