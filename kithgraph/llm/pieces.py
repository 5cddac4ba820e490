"""Exact sentencepiece encoding of a byte-pair model by backtracking, and decoding.

A sequence of pieces is the encoding of a text exactly if each two neighbours are the encoding of
their concatenation: the first merge across a place between two of them would also happen in those two alone.
So a text is read from the left by longest matches of an Aho-Corasick automaton; a piece that
doesn't stand beside the one before it gives way to its next shorter prefix, and where none is
left, the piece before gives way.  The encoding up to a place is unique, so a place from which
that failed once has failed for good and is remembered in a bitfield.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

from pyspark.sql import DataFrame

from kithgraph.llm.rows import map_texts
from kithgraph.llm.tokens import Table

#: Fixed value: the stand-in for a space.
SPACE = "▁"
#: Letters, without numbers that count as such.
LETTER = r"[^\W\d_²³¹¼-¾⁰-↋]"
#: Ways to cut a text, the finest first; whether a place is cut depends only on the two characters beside it.
UNITS = (f"{SPACE}*{LETTER}+|{SPACE}*(?:(?!{LETTER})[^{SPACE}\n])+|{SPACE}+|\n+", f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", "(?s).+")
#: Pairs of pieces whose verdict a worker remembers; then it starts again.
PAIRS = 1_000_000
#: What a character without a piece is numbered from.
LONE = 1 << 20


class Pieces:
    """Ids and text of a sentencepiece byte-pair model with byte fallback and an identity normalizer."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.byte = {k: int(model.id_to_piece(k)[3:5], 16) for k in ids if model.is_byte(k)}
        self.byte_id = {b: k for k, b in self.byte.items()}
        self.silent, self.unknown = {k for k in ids if model.is_control(k)}, model.unk_id()
        own = [k for k in ids if not (k in self.byte or k in self.silent or k == self.unknown)]
        self._check(model, own)
        self.id_of = {model.id_to_piece(k): k for k in own}
        self.piece_of = {k: p for p, k in self.id_of.items()}
        order = {score: r for r, score in enumerate(sorted(set(map(model.get_score, own)), reverse=True))}
        self.rank = {model.id_to_piece(k): order[model.get_score(k)] for k in own}
        # A piece that merging never reaches can't be in an encoding.
        reached = {p: k for p, k in self.id_of.items() if len(p) == 1 or self.merged(p) == [p]}
        self.size = {k: len(p) for p, k in reached.items()}
        self.automaton = ahocorasick.Automaton()
        for p, k in reached.items():
            self.automaton.add_word(p, (len(p), k))
        self.automaton.make_automaton()
        self.shorter = {k: next(reached.get(p[:n], LONE + ord(p[0])) for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in reached) for p, k in reached.items() if len(p) > 1}
        self.decimal = {k: str(k) for k in ids}
        self.shown = {k: p.replace(SPACE, " ").encode() for p, k in self.id_of.items()} | dict.fromkeys(self.silent, b"") | {self.unknown: " ⁇ ".encode()}
        self.fits: dict[int, bool] = {}
        self.table = Table()
        # A text comes apart at each place that no piece goes across.
        self.unit = next(u for u in map(re.compile, UNITS) if all(u.fullmatch(p) and u.match(p).end() == len(p) for p in self.rank))

    @staticmethod
    def _check(model, own: list[int]) -> None:
        """Whether a model is of the kind that this class encodes."""
        probes = (" a  b ", "\tÁＡⅠ ", "　x\n\n", "ﬁ½")
        if any(model.is_unused(k) for k in own):
            raise ValueError("unused pieces are not supported")
        if any(model.normalize(p) != SPACE + p.replace(" ", SPACE) for p in probes) or sum(1 for k in range(model.get_piece_size()) if model.is_byte(k)) != 256:
            raise ValueError("only models with byte fallback whose normalizer keeps texts are supported")

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the best adjacent pair, the leftmost of equals, until none is left."""
        parts, get, none = list(text), self.rank.get, len(self.rank)
        ranks = [get(a + b, none) for a, b in pairwise(parts)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def text_of(self, k: int) -> str:
        return chr(k - LONE) if k >= LONE else self.piece_of[k]

    def beside(self, a: int, b: int) -> bool:
        """Whether merging the texts of a and b together gives a and b again."""
        left, right = self.text_of(a), self.text_of(b)
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        known = self.fits[a << 22 | b] = left + right not in self.rank and self.merged(left + right) == [left, right]
        return known

    def backtracked(self, unit: str) -> list[int]:
        """Pieces of a unit by id; a character without a piece stands for itself, as LONE and its code point."""
        # Of the matches from one place the automaton reports the longest last.
        longest = {end - n: k for end, (n, k) in self.automaton.iter(unit)}.get
        size, shorter, fits, failed = self.size.get, self.shorter.get, self.fits.get, None
        out, at, before, many = [], 0, -1, len(unit)
        piece = longest(-1, LONE + ord(unit[0]))
        while at < many:
            while piece is not None:
                end = at + size(piece, 1)
                if not failed or not failed[end >> 3] >> (end & 7) & 1:
                    known = before < 0 or fits(before << 22 | piece)
                    if known or known is None and self.beside(before, piece):
                        break
                piece = shorter(piece)
            if piece is None:
                failed = failed or bytearray((many >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = shorter(out.pop())
                at -= size(before, 1)
                before = out[-1] if out else -1
            else:
                out.append(piece)
                at, before = end, piece
                piece = longest(at - 1) or (LONE + ord(unit[at]) if at < many else None)
        return out

    def unit_ids(self, unit: str) -> list[int]:
        found = self.backtracked(unit)
        if max(found) < LONE:
            return found
        return [k for p in found for k in ([self.byte_id[b] for b in chr(p - LONE).encode()] if p >= LONE else [p])]

    def units(self, text: str) -> list[str]:
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [k for u in self.units(text) for k in self.unit_ids(u)]

    def surface(self, ids: list[int]) -> bytes:
        """UTF-8 of ids amid a text; a byte that is part of no character becomes U+FFFD."""
        out, run = [], bytearray()
        for k in [*ids, None]:
            if k in self.byte:
                run.append(self.byte[k])
                continue
            if run:
                out.append(characters(bytes(run)))
                run.clear()
            if k is not None:
                out.append(self.shown[k])
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that encoding puts before a text is taken away."""
        shown = next((k for k in ids if k not in self.silent), None)
        text = self.surface(ids).decode()
        return text[1:] if shown in self.piece_of and self.piece_of[shown].startswith(SPACE) else text

    def rows(self, texts: list[str]) -> list[list]:
        """n_tokens, ids_sha256, decoded_sha256 of each text."""
        units = list(map(self.units, texts))
        self.table.trim()
        for u in set().union(*units) - self.table.keys():
            ids = self.unit_ids(u)
            # Bytes of one character never lie in two units, so units decode by themselves.
            shown = self.surface(ids) if min(ids) in self.byte else b"".join([self.shown[k] for k in ids])
            own = ",".join([self.decimal[k] for k in ids]), shown
            self.table.put(u, own, len(own[0]) + len(shown))
        n, ids_hex, text_hex, get = [], [], [], self.table.__getitem__
        for own in units:
            texts_of_ids, shown = zip(*map(get, own), strict=True) if own else ((), ())
            joined = ",".join(texts_of_ids)
            n.append(joined.count(",") + 1 if joined else 0)
            ids_hex.append(hashlib.sha256(joined.encode()).hexdigest())
            # The first piece of a text always begins with the space that encoding put there.
            text_hex.append(hashlib.sha256(b"".join(shown)[1:]).hexdigest())
        return [n, ids_hex, text_hex]


def characters(run: bytes) -> bytes:
    """A run of bytes with each byte outside of a valid UTF-8 character replaced by U+FFFD."""
    out, at = [], 0
    while at < len(run):
        lead = run[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            run[at : at + n].decode()
        except UnicodeDecodeError:
            out.append("�".encode())
            at += 1
        else:
            out.append(run[at : at + n])
            at += n
    return b"".join(out)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every whole text; one row for each input row.

    Null and empty texts have no tokens and the digests of empty strings; an empty table gives no
    rows.  A very long text takes time and memory in proportion to its length, with or without
    white space.  Repeated rows give repeated results; other columns of df are ignored.  `path` must
    exist on every node.
    """
    return map_texts(df, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: Pieces(path).rows)
