import math
import random

import numpy as np
import pytest

from kithgraph.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, q string"


def brute(rows, entries):
    """Rows of the contract by plain loops; rows are (id, vector, label) as given."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    first = [r for r in first if len(r[1]) == len(first[0][1])][:entries]
    width = len(first[0][1]) // 4 if first else 0
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in first] for p in range(4)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in book]
        return d.index(min(d)), min(d)

    whole = [r for r in kept if len(r[1]) == 4 * width]
    for _ in range(4):
        for p in range(4):
            own = [[] for _ in books[p]]
            for _, v, _ in whole:
                own[nearest(part(v, p), books[p])[0]].append(part(v, p))
            books[p] = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else b for g, b in zip(own, books[p], strict=True)]
    found = [[nearest(part(v, p), books[p]) for p in range(4)] for _, v, _ in whole]
    error = [sum(d for _, d in f) for f in found]
    total = {}
    for (_, _, lab), e in zip(whole, error, strict=True):
        total[lab] = total.get(lab, 0) + e
    out = [(i, "".join(f"{k:02x}" for k, _ in f), e, total[lab]) for (i, _, lab), f, e in zip(whole, found, error, strict=True)]
    out += [(i, None, None, None) for i, v, _ in kept if len(v) != 4 * width]
    return out, books


def rows(seed, many, width, spread):
    rng = random.Random(seed)
    out = [(k, [rng.gauss(0, spread) for _ in range(4 * width)], rng.choice([None, 1, 2]), "x", "y") for k in range(many)]
    out += [out[3], out[3], (out[5][0], out[6][1], 1, None, None), (None, out[9][1], None, None, None)]
    out += [(900, None, 1, "", ""), (901, [float("nan")] + [0.0] * (4 * width - 1), 1, "", ""), (902, [float("inf")] * 4 * width, 2, "", ""), (903, [None] + [1.0] * (4 * width - 1), 2, "", "")]
    out += [(904, [0.0] * 4 * width, None, "", ""), (905, [1.0] * (4 * width + 1), 2, "", ""), (906, [], 2, "", "")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,many,width,spread,entries", [(1, 60, 3, 0.2, 8), (2, 40, 2, 0.002, 16), (3, 30, 1, 30.0, 256), (4, 80, 5, 0.01, 5)])
def test_rows_equal_brute_force(spark, monkeypatch, seed, many, width, spread, entries):
    monkeypatch.setattr(codes, "ENTRIES", entries)
    given = rows(seed, many, width, spread)
    got, books = codes.compress(spark.createDataFrame(given, SCHEMA).repartition(5))
    want, want_books = brute(given, entries)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert books.tolist() == want_books


def test_empty_and_unusable_tables(spark):
    empty = codes.compressed(spark.createDataFrame([(1, None, 3, "", "")], SCHEMA))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    with pytest.raises(ValueError, match="parts"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 5, 3, "", "")], SCHEMA))
    with pytest.raises(Exception, match="not supported"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 4, 3, "", "")], SCHEMA))


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(5)
    for width, spread in ((16, 90), (3, 4), (64, 1 << 25)):
        entries, queries = (rng.integers(-spread, spread + 1, (n, width)) for n in (256, 400))
        file = codes.CellFile(entries)
        exact = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
        lower, upper = file.bounds(queries)
        assert (lower <= exact).all() and (exact <= upper).all()
        index, distance = file.nearest(queries)
        assert (index == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        if spread == 90:
            assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.6
