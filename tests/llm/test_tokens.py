import random

import public_tokenizers
import pytest

from kithgraph.llm.tokens import ByteTokenizer, PieceCounter, WordTokenizer

POOL = "abcdefgh  \n\t\'sSÉéÀß漢字é ́ΣİǅΩ12345½!?.,*#|<>& ​ 　  \U0001f600\U0001f469‍\U0001f469\x1c\x85 "


def texts(n=300, seed=1):
    rng = random.Random(seed)
    out = ["", " ", "  \n\n ", "a", "don't I'll we've THEY'RE", "<|endoftext|> x<|startoftext|>y", "a" * 500, "é" * 300, "'s" * 200, "x  y\n\n z \n", "\n a", "a\n", "<s>x</s>"]
    out += ["".join(rng.choice(POOL) for _ in range(rng.randint(1, 200))) for _ in range(n)]
    out += ["".join(rng.choice("abcdeéß'12!.漢") for _ in range(rng.randint(100, 900))) for _ in range(n // 3)]
    return out


@pytest.mark.parametrize("leaf,half", [(4, 1024), (9, 7), (64, 1), (64, 50)])
def test_word_ids_equal_the_library(leaf, half, monkeypatch):
    from tokenizers import Tokenizer

    from kithgraph.llm import tokens

    monkeypatch.setattr(tokens, "HALF", half)
    monkeypatch.setattr(tokens, "WINDOW", 2)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), WordTokenizer(path, leaf)
    import hashlib

    for t in texts():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert own.ids(t) == ids, t
        assert own.rows([t])[2] == [hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()]
    assert own.joins > 0 or half == 1024


def test_byte_ids_equal_the_library():
    import numpy as np
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, own = Tokenizer.from_file(path), ByteTokenizer(path)
    for t in texts(600, 2):
        assert np.frombuffer(own.encode_all([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_counts_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), PieceCounter(path)
    for t in texts(600, 3) + [" " * 40, "a" + " " * 33 + "b", "\n\n\n", "▁x▁▁y", ";\r\n"]:
        assert own.rows([t], 4096)[1] == [len(model.encode(t))], repr(t)


AWKWARD = [(1, "some words here " * 300), (1, "some words here " * 300), (2, ""), (3, None), (None, "a row without an id"), (4, "x" * 30_000), (5, "<s>a</s> \x1c b")]


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in AWKWARD], "doc_id long, text string, n_tokens string, __text string")


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


def test_encoded_rows(awkward):
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer

    from kithgraph.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, want = Tokenizer.from_file(path), []
    for i, t in AWKWARD:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    out = tokens.encode_decode(awkward, path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert order(map(tuple, out.collect())) == order(want) and tokens.encode_decode(awkward.limit(0), path).count() == 0


def test_counted_rows(awkward):
    import sentencepiece

    from kithgraph.llm import tokens

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 1000) for i, t in AWKWARD]
    out = tokens.count_tokens(awkward, path, 1000)
    assert order(map(tuple, out.collect())) == order(want) and tokens.count_tokens(awkward.limit(0), path).count() == 0


def test_texts_of_the_tables_are_joined():
    from pathlib import Path

    import duckdb
    from tokenizers import Tokenizer

    data = "/root/testdata/sf0.001/documents.parquet"
    if not Path(data).exists():
        pytest.skip("needs the driver's tables")
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), WordTokenizer(path)
    for (t,) in duckdb.sql(f"SELECT text FROM '{data}'").fetchall():
        assert own.ids(t) == tok.encode(t, add_special_tokens=False).ids
    assert own.joins > 100


def test_a_worker_forgets():
    from kithgraph.llm import tokens

    own = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    own.table.held = tokens.TABLE_BYTES + 1
    own.rows(["a b"])
    assert set(own.table) == {"a", "b"} and own.table.held < 1000


def test_units_are_encoded_in_runs():
    """Also where the separator's own word stands among the units or inside of one."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), WordTokenizer(path)
    assert own.mark is not None
    word = own.between.strip()
    for text in [" ".join(f"unit{k}x" for k in range(950)), f"a {word} b", f"a {word}! \u200b {word}{word} b", f"{word}", f"a!{word} b <|endoftext|> c"]:
        assert own.ids(text) == tok.encode(text, add_special_tokens=False).ids
    assert own.ids("\u0301 x \xad y") == tok.encode("\u0301 x \xad y", add_special_tokens=False).ids
