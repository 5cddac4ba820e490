import hashlib
import random

import public_tokenizers
import pytest

from kithgraph.llm import pieces
from tests.llm.test_tokens import texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Pieces(PATH)


def hard(own, seed):
    """Texts of pieces set side by side, where longest matches often fail, and of odd characters."""
    rng = random.Random(seed)
    known = sorted(own.rank)
    out = ["\x00a", "▁", "▁▁", "<0x41><unk><s>", "a" * 9_000, "ab" * 3_000, "=-" * 500, "漢字" * 300, "\n\n\n", "x²." * 20, ";\r\n", *(" " * k for k in range(1, 90)), *("a" + " " * k + "b" for k in range(1, 60))]
    return out + ["".join(rng.choice(known) for _ in range(rng.randint(1, 40))) for _ in range(1500)] + texts(300, seed)


def test_ids_and_text_equal_the_library(both):
    model, own = both
    for t in hard(own, 4):
        ids = model.encode(t)
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == model.decode(ids), repr(t)
        assert own.rows([t]) == [[len(ids)], [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()], [hashlib.sha256(model.decode(ids).encode()).hexdigest()]]


@pytest.mark.parametrize("unit", pieces.UNITS[1:])
def test_ids_do_not_depend_on_units(both, unit, monkeypatch):
    """Whole texts in one unit: backtracking alone gives the library's ids."""
    import re

    model, own = both
    monkeypatch.setattr(own, "unit", re.compile(unit))
    for t in hard(own, 6)[::3]:
        assert own.encode(t) == model.encode(t), repr(t)


def test_longest_matches_give_way(both):
    """Backtracking equals merging, also where the longest matches from the left don't."""
    _, own = both
    ways = 0
    for t in hard(own, 9)[:900]:
        for u in own.units(t):
            if len(u) > 200:
                continue
            greedy, at = [], 0
            while at < len(u):
                n = max((n for n in range(1, 17) if u[at : at + n] in own.rank), default=1)
                greedy.append(u[at : at + n])
                at += n
            found = [own.text_of(k) for k in own.backtracked(u)]
            assert found == own.merged(u), u
            ways += found != greedy
    assert ways > 100


def test_decodes_any_ids(both):
    model, own = both
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(260) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == model.decode(ids), ids


def test_rows_of_a_table(both, spark):
    model, _ = both
    rows = [(1, "some words here " * 300, 9), (1, "some words here " * 300, 9), (2, "", 9), (3, None, 9), (None, "a row without an id", 9), (4, "x" * 30_000, 9), (5, " two  spaces \t", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, pieces.encode_decode(df, PATH).collect()), key=str)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids := model.encode(t or "")), digest(",".join(map(str, ids))), digest(model.decode(ids))) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert pieces.encode_decode(df.where("false"), PATH).count() == 0
