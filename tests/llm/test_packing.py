from hypothesis import given, settings
from hypothesis import strategies as st

from kithgraph.llm.packing import FILLER, Packer, differencing, filled_windows, pack


@given(st.lists(st.integers(1, 300), max_size=60), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_differencing_deals_each_item_once(sizes, k):
    parts = differencing(sizes, k)
    assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(len(sizes)))


def test_differencing_is_near_equal():
    sizes = [(i * 7919) % 997 + 1 for i in range(400)]
    sums = [sum(sizes[i] for i in p) for p in differencing(sizes, 10)]
    assert max(sums) - min(sums) <= 10


def test_known_two_way_case():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_count_rises_when_capacity_is_exceeded():
    windows, left = filled_windows([(k, 0, 6) for k in range(3)], [(9, 0, 15)], 10)
    assert len(windows) == 3 and sorted(map(len, windows)) == [2, 2, 2] and left == [(9, 12, 3)]
    assert filled_windows([(k, 0, 6) for k in range(3)], [(9, 0, 11)], 10) is None  # two windows can't hold them whole
    assert filled_windows([], [(9, 0, 3)], 10) is None and filled_windows([], [(9, 0, 13)], 10) == ([[(9, 0, 10)]], [(9, 10, 3)])


def test_most_documents_stay_whole():
    packer, windows = Packer(2048, 64), []
    lengths = [(k * 7919) % 1500 + 20 for k in range(2000)]
    for doc, n in enumerate(lengths):
        windows += packer.add(doc, n)
    windows += packer.end()
    parts = [0] * len(lengths)
    for w in windows:
        for d, _, _ in w:
            parts[d] += 1
    assert sum(x > FILLER for x in packer.shares) <= 3 and sum(n == 1 for n in parts) > 0.8 * len(parts)


def test_count_rises_where_no_two_documents_fit():
    """Each window takes one whole document and filler: the count rises far above what the total asks for."""
    packer, windows = Packer(2048, 64), []
    lengths = [1100 + (k * 7919) % 401 for k in range(3000)]
    for doc, n in enumerate(lengths):
        windows += packer.add(doc, n)
    windows += packer.end()
    parts = [0] * len(lengths)
    for w in windows:
        for d, _, _ in w:
            parts[d] += 1
    full = [w for w in windows if sum(p[2] for p in w) == 2048]
    assert max(packer.shares) > FILLER and len(windows) - len(full) <= 11 and sum(map(sum, ([p[2] for p in w] for w in windows))) == sum(lengths)
    assert sum(n == 1 for n in parts) > 0.55 * len(parts)


@given(st.lists(st.integers(1, 9000), max_size=80))
@settings(max_examples=100, deadline=None)
def test_windows_hold_each_token_once_without_padding(lengths):
    packer, windows = Packer(256, 4), []
    for doc, n in enumerate(lengths):
        windows += packer.add(doc, n)
    windows += packer.end()
    seen = {d: [] for d in range(len(lengths))}
    for w in windows:
        total = sum(p[2] for p in w)
        assert total == 256 or total & (total - 1) == 0 and total < 256
        for d, start, length in w:
            seen[d].append((start, length))
    for d, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[d]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_rows_against_the_library(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = [f"Document {k} says {'some more words of its own ' * (k % 60)}" for k in range(200)] + ["", None, "many words " * 9000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, "no id")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, length string, offset int").repartition(2)
    got = pack(df, path).toPandas()
    whole = {}
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        whole.setdefault(-1 if i is None else i, []).append(ids)
    assert got.doc_id.nunique() == len(texts)
    for i, own in got.fillna({"doc_id": -1}).groupby("doc_id"):
        ids = whole[int(i)][0]
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == len(ids) * len(whole[int(i)])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
        if len(whole[int(i)]) == 1:
            spans = sorted(zip(own.start, own.length, strict=True))
            assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()]
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        total = own.length.sum()
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and (total == 2048 or total & (total - 1) == 0)
    assert pack(df.limit(0), path).count() == 0
