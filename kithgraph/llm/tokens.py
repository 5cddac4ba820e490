"""Byte-pair encoding, decoding and token counts over whole texts.

For encoding, a text is halved anywhere down to HALF code points; the parts are encoded and their encodings
joined upwards, each join through a window that is encoded again and grows until its tokens are those of both
sides.  The tokenizer always cuts at white space, so a part's ids come from those of its runs without it, which a
worker's bounded table remembers; runs longer than `leaf` code points are halved and joined as well.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame

from kithgraph.llm.rows import map_texts

#: The code points that \s matches in the tokenizers' regular expressions.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: White space for str.split() that those expressions don't count as such.
ODD = re.compile(r"[\x1c-\x1f]")
#: Fixed value: the word pattern of the byte-level vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of units, ids and names (about) that a worker remembers; then it starts again.
TABLE_BYTES = 100_000_000
#: Units that are encoded as one text, with a separator between them.
RUN = 100
#: Code points of a text's part that is encoded by itself, and of the first window around a join.
HALF, WINDOW = 2048, 24


class Table(dict):
    """A dict that counts the bytes of what is put in."""

    held = 0

    def put(self, unit: str, value: object, size: int) -> None:
        self[unit] = value
        self.held += 150 + 2 * len(unit) + size

    def trim(self) -> None:
        if self.held > TABLE_BYTES:
            self.clear()
            self.held = 0


# ---------------------------------------------------------------- tree concatenation


def _clean(tokens: list[tuple[int, int, int]], k: int) -> bool:
    """Whether no code point straddles the place before token k."""
    return k <= 0 or k >= len(tokens) or tokens[k - 1][2] <= tokens[k][1]


def _agreement(side: list, window: list, high: int, run: int, last: bool) -> tuple[int, int] | None:
    """(index in side, index in window) of a place amid `run` equal tokens that end within `high`.

    last: take the rightmost such place, else the leftmost.  Two tokens with a gap between them are
    enough, as the tokenizer always cuts at what lies there.
    """
    where = {(t, a, b): k for k, (t, a, b) in enumerate(side)}
    for need in (2, run):
        mid = need // 2
        order = range(len(window) - need, -1, -1) if last else range(len(window) - need + 1)
        for j in order:
            if need == 2 and window[j][2] >= window[j + 1][1]:
                continue
            i = where.get(window[j])
            if i is None or window[j + need - 1][2] > high:
                continue
            if side[i : i + need] == window[j : j + need] and _clean(side, i + mid) and _clean(window, j + mid):
                return i + mid, j + mid
    return None


def join_encoded(encode, text: str, left: list, right: list, low: int, at: int, high: int, start: int = 16, run: int = 4) -> list:
    """Tokens (id, first, end) of text[low:high] from those of its two parts, whose lists may be changed.

    A window around the join is encoded again and doubled until its tokens equal the left part's
    on the left and the right part's on the right; only what lies between is replaced.  Only the
    parts' tokens inside of the window are looked at, so a join costs its window.
    """
    width = start
    while True:
        a, b = max(low, at - width), min(high, at + width)
        window = [(t, x + a, y + a) for t, x, y in encode([text[a:b]])[0]]
        kept = bisect_left(left, a, key=itemgetter(1))
        begin = (-kept, 0) if a == low else _agreement(left[kept:], window, at, run, True)
        end = (len(right), len(window)) if b == high else _agreement(right[: bisect_left(right, b, key=itemgetter(1))], window, b, run, False)
        if begin and end and begin[1] <= end[1]:
            left[kept + begin[0] :] = window[begin[1] : end[1]]
            left.extend(right[end[0] :])
            return left
        if a == low and b == high:
            return window
        width *= 2


def encode_by_halves(encode, text: str, leaf: int) -> list[tuple[int, int, int]]:
    """Tokens of a text: its halves are halved on down to `leaf` code points, all
    leaves are encoded together (the library spreads a batch over its threads), and neighbours are
    joined upwards."""
    spans = [(0, len(text))]
    while spans[0][1] - spans[0][0] > leaf:
        spans = [part for a, b in spans for part in ((a, (a + b) // 2), ((a + b) // 2, b))]
    parts = [[(t, x + a, y + a) for t, x, y in tokens] for (a, _), tokens in zip(spans, encode([text[a:b] for a, b in spans]), strict=True)]
    while len(parts) > 1:
        joined = [join_encoded(encode, text, parts[k], parts[k + 1], spans[k][0], spans[k][1], spans[k + 1][1]) for k in range(0, len(parts), 2)]
        spans = [(spans[k][0], spans[k + 1][1]) for k in range(0, len(spans), 2)]
        parts = joined
    return parts[0]


# ---------------------------------------------------------------- word-level vocabulary


class WordTokenizer:
    """Ids and decoded text as the tokenizers library gives them for a vocabulary that drops white space."""

    def __init__(self, path: str, leaf: int = 64):
        from tokenizers import Tokenizer

        self.tok, self.leaf, self.table, self.joins = Tokenizer.from_file(path), leaf, Table(), 0
        self.tok.no_truncation()
        self.tok.no_padding()
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        # A window that holds a whole special token's name on either side of a cut.
        self.start = max([WINDOW, *(2 * len(t.content) for t in self.tok.get_added_tokens_decoder().values())])
        self.space, self.white = re.compile(f"[{WHITE}]+"), re.compile(f"[{WHITE}]")
        self.text_of = {k: t.encode() for t, k in self.tok.get_vocab(with_added_tokens=True).items()}
        self.between, self.mark = self._separator()

    def _triples(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        return [[(t, a, b) for t, (a, b) in zip(e.ids, e.offsets, strict=True)] for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _triple(self, text: str) -> list[tuple[int, int, int]]:
        """As _triples() for one short text, without the cost of a batch."""
        e = self.tok.encode(text, add_special_tokens=False)
        return [(t, a, b) for t, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def _learn(self, units: list[str]) -> None:
        short = [u for u in units if len(u) <= self.leaf]
        for at in range(0, len(short), 20 * RUN):
            runs = [short[k : k + RUN] for k in range(at, min(at + 20 * RUN, len(short)), RUN)]
            for run, e in zip(runs, self.tok.encode_batch_fast([self.between.join(r) for r in runs], add_special_tokens=False), strict=True):
                self._share(run, e.ids)
        for u in units:
            if len(u) > self.leaf:
                # A special token's name amid a text must not be cut; such units are rare.
                whole = self.special and self.special.search(u)
                self._keep(u, self.tok.encode(u, add_special_tokens=False).ids if whole else [t for t, _, _ in encode_by_halves(self._triples, u, self.leaf)])

    def _share(self, run: list[str], ids: list[int]) -> None:
        """Keeps the ids of each unit from those of a run of units with the separator's id between them."""
        own, put = np.array(ids, "<u4"), self.table.put
        cuts = np.flatnonzero(own == self.mark).tolist() if self.mark is not None else []
        if self.mark is None or len(cuts) != len(run) - 1:  # the separator's id also stands inside a unit
            for u in run:
                self._keep(u, self.tok.encode(u, add_special_tokens=False).ids)
            return
        raw, names = own.tobytes(), list(map(self.text_of.__getitem__, ids))
        for u, a, b in zip(run, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True):
            text = b" ".join(names[a:b])
            put(u, (raw[4 * a : 4 * b], text), 4 * (b - a) + len(text))

    def _separator(self) -> tuple[str, int | None]:
        """White space around a word that is one token, and its id: the latest such word of the vocabulary."""
        suffix = getattr(self.tok.model, "end_of_word_suffix", None) or ""
        for name, k in sorted(self.tok.get_vocab(with_added_tokens=False).items(), key=lambda x: -x[1]):
            word = name.removesuffix(suffix)
            if word.isalpha() and self.tok.encode(f" {word} ", add_special_tokens=False).ids == [k]:
                return f" {word} ", k
        return " ", None

    def _keep(self, unit: str, ids: list[int]) -> None:
        own = self._named(ids)
        self.table.put(unit, own, len(own[0]) + len(own[1]))

    def split(self, text: str) -> list[str]:
        return [u for u in self.space.split(text) if u] if ODD.search(text) else text.split()

    def leaves(self, text: str) -> tuple[list[int], list[list[str]]]:
        """Cuts that halve a text down to HALF code points, and the units of the parts between them."""
        cuts = [0, len(text)]
        while cuts[1] > HALF:
            cuts = [c for a, b in zip(cuts, cuts[1:], strict=False) for c in (a, (a + b) // 2)] + [len(text)]
        return cuts, [self.split(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def whole(self, text: str, cuts: list[int], parts: list[list[str]]) -> list[tuple]:
        """Encoded pieces (ids, names) of a text from its encoded leaves, joined upwards."""
        parts = [list(map(self.table.__getitem__, units)) for units in parts]
        while len(parts) > 1:
            parts = [self.join(text, parts[k], parts[k + 1], cuts[k], cuts[k + 1], cuts[k + 2]) for k in range(0, len(parts), 2)]
            cuts = cuts[::2]
        return parts[0]

    def join(self, text: str, left: list[tuple], right: list[tuple], low: int, at: int, high: int) -> list[tuple]:
        """Pieces of text[low:high] from those of its two parts.

        The tokens of a window around the join are compared with those of the left part's last units
        and the right part's first ones, from where the window begins to where it ends; it grows until
        both sides agree.  What was encoded anew is one piece, which counts its units.
        """
        if self.white.match(text, at) or self.white.match(text, at - 1):  # nothing straddles the cut
            left.extend(right)
            return left
        self.joins += 1
        width = self.start
        while True:
            a, b = max(low, at - width), min(high, at + width)
            head, tail = a, b
            while head > low and not self.white.match(text, head - 1):
                head -= 1
            while tail < high and not self.white.match(text, tail):
                tail += 1
            shifts = head, a, at
            lasts, window, firsts = ([(t, x + s, y + s) for t, x, y in own] for s, own in zip(shifts, map(self._triple, (text[head:at], text[a:b], text[at:tail])), strict=True))
            begin = (0, 0) if a == low else _agreement(lasts, window, at, 4, True)
            end = (len(firsts), len(window)) if b == high else _agreement(firsts, window, b, 4, False)
            if a == low and b == high:
                begin, end = (0, 0), (len(firsts), len(window))
            if begin and end and begin[1] <= end[1]:
                break
            width *= 2
        ids = [t for t, _, _ in lasts[: begin[0]] + window[begin[1] : end[1]] + firsts[end[0] :]]
        back, on = self._dropped(left[::-1], len(self.split(text[head:at]))), self._dropped(right, len(self.split(text[at:tail])))
        if back is None or on is None:  # a piece of an earlier join is cut
            return [(*self._named(self.tok.encode(text[low:high], add_special_tokens=False).ids), len(self.split(text[low:high])))]
        del left[len(left) - back :]
        left.append((*self._named(ids), len(self.split(text[head:tail]))))
        left.extend(right[on:])
        return left

    @staticmethod
    def _dropped(pieces: list[tuple], units: int) -> int | None:
        """How many pieces hold the first `units` units, None if the last of them holds more."""
        k = 0
        while units > 0:
            units -= pieces[k][2] if len(pieces[k]) > 2 else 1
            k += 1
        return k if units == 0 else None

    def _named(self, ids: list[int]) -> tuple[bytes, bytes]:
        return np.array(ids, "<u4").tobytes(), b" ".join(map(self.text_of.__getitem__, ids))

    def pieces(self, texts: list[str]) -> Iterator[list[tuple]]:
        halved = list(map(self.leaves, texts))
        self.table.trim()
        self._learn(list(set().union(*(units for _, parts in halved for units in parts)) - self.table.keys()))
        for text, (cuts, parts) in zip(texts, halved, strict=True):
            yield self.whole(text, cuts, parts)

    def rows(self, texts: list[str]) -> list[list]:
        """n_tokens, ids_sha256, decoded_sha256 of each text.

        The library decodes a vocabulary without a decoder to its tokens' names with spaces between.
        """
        n, ids_hex, text_hex = [], [], []
        for found in self.pieces(texts):
            ids = b"".join([x[0] for x in found])
            n.append(len(ids) // 4)
            ids_hex.append(hashlib.sha256(ids).hexdigest())
            text_hex.append(hashlib.sha256(b" ".join([x[1] for x in found if x[0]])).hexdigest())
        return [n, ids_hex, text_hex]

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(x[0] for x in next(self.pieces([text]))), "<u4").tolist()


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 64) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every whole text; one row for each input row.

    Null and empty texts have no tokens and the digests of empty strings.  A very long text is
    encoded in halves and takes memory in proportion to its length, with or without white space.
    Repeated rows give repeated results, an empty table no rows; other columns of df are ignored.
    `path` must exist on every node.
    """
    return map_texts(df, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: WordTokenizer(path, leaf).rows)


# ---------------------------------------------------------------- byte-level vocabulary


@lru_cache(1)
def _byte_names() -> dict[str, int]:
    """The printable stand-ins for the 256 byte values: printable Latin-1 stands for itself, the rest for U+0100 and on."""
    own = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokenizer:
    """Ids of a byte-level vocabulary given as a tokenizers .json file, as little-endian 32-bit strings."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        names = _byte_names()
        ranks = {bytes(names[c] for c in t): k for t, k in spec["model"]["vocab"].items() if t not in self.special}
        # A vocabulary whose ids ascend with its merges is also a table of ranks.
        self.fast = tiktoken.Encoding("vocabulary", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.table = Table()
        self.unit = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        plain = [not any(s in t for s in self.special) for t in texts]
        units = [self.unit.findall(t) if ok else [] for t, ok in zip(texts, plain, strict=True)]
        self.table.trim()
        table, fast = self.table, self.fast
        for u in set().union(*units) - table.keys():
            own = np.array(fast(u), "<u4").tobytes()
            table.put(u, own, len(own))
        get = table.__getitem__
        return [b"".join(map(get, own)) if ok else np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, ok, own in zip(texts, plain, units, strict=True)]


# ---------------------------------------------------------------- counts by merging


class PieceCounter:
    """Token counts of a sentencepiece byte-pair model with byte fallback.

    The lowest-rank adjacent pair is popped from a heap and merged in a linked list until none is
    left.  A symbol outside the vocabulary counts as its UTF-8 bytes from the start, so a count is
    the initial symbols less the merges.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        by_score = sorted(ids, key=lambda k: -model.get_score(k))
        self.rank = {model.id_to_piece(k): r for r, k in enumerate(by_score)}
        if any(model.is_unused(k) for k in ids):
            raise ValueError("a model with unused pieces is not supported")
        self.table = Table()
        # No piece holds a space mark after another character, so words never merge with each other.
        apart = not any("▁" in p.lstrip("▁") for p in self.rank)
        lines = not any("\n" in p for p in self.rank)
        self.unit = re.compile("▁+[^▁\n]*|[^▁\n]+|\n+" if lines else "▁+[^▁]*|[^▁]+") if apart else re.compile("(?s).+")

    def merge(self, unit: str) -> int:
        rank, size = self.rank, len(unit)
        count = sum(1 if c in rank else len(c.encode()) for c in unit)
        symbols: list[str | None] = list(unit)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, k, 2) for k in range(size - 1) if (r := rank.get(unit[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, length = heapq.heappop(heap)
            if symbols[k] is None:
                continue
            nxt = after[k]
            if nxt >= size or len(symbols[k]) + len(symbols[nxt]) != length:
                continue  # one of the two has merged since
            symbols[k] += symbols[nxt]
            symbols[nxt] = None
            count -= 1
            far = after[k] = after[nxt]
            if far < size:
                before[far] = k
                if (r := rank.get(symbols[k] + symbols[far])) is not None:
                    heapq.heappush(heap, (r, k, length + len(symbols[far])))
            prev = before[k]
            if prev >= 0 and (r := rank.get(symbols[prev] + symbols[k])) is not None:
                heapq.heappush(heap, (r, prev, len(symbols[prev]) + length))
        return count

    def rows(self, texts: list[str], limit: int) -> list[list]:
        units = [self.unit.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
        self.table.trim()
        for u in set().union(*units) - self.table.keys():
            self.table.put(u, self.merge(u), 0)
        n = [sum(map(self.table.__getitem__, own)) for own in units]
        return [[len(t.encode()) for t in texts], n, [x > limit for x in n]]


def count_tokens(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every whole text; one row for each input row.

    Null and empty texts have 0 bytes and 0 tokens.  A very long unsplit text takes time n log n and
    memory in proportion to its length.  Repeated rows give repeated results, an empty table no rows;
    other columns of df are ignored.
    """

    def make():
        counter = PieceCounter(path)
        return lambda texts: counter.rows(texts, limit)

    return map_texts(df, id_col, text_col, "n_bytes long, n_tokens long, over_limit boolean", make)
