"""Fill-in-middle transformation: prefix, suffix and middle of a text change places behind marks.

Texts are cut at tokens (a run of ASCII letters, or any other code point).  A four-state automaton
reads them: its state tells whether a word is open and how much of a mark has been read.  A chunk
is summarised for each state that it may be entered in: the state it is left in, the tokens that
begin in it, the marks that end in it.  Summaries compose associatively, so long texts are read in chunks by
many tasks at once, and a cut is looked for only in the chunk that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from kithgraph.llm.shared import discard, matched, written

#: Code points of a chunk, and chunks whose summaries are composed together first.
CHUNK, FAN = 32_768, 256
#: The marks.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the rolls of 100 from which a text stays plain, and below which its suffix comes first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20

#: States: outside of a word, in a word, after `<`, after `<` and a mark's letter.
OUT, WORD, OPEN, NAMED = range(4)
#: Classes: any other code point, a letter, a letter of a mark, `<`, `>`.
CLASS = np.array([3 if chr(c) == "<" else 4 if chr(c) == ">" else 2 if chr(c) in "PSM" else 1 if chr(c).isalpha() else 0 for c in range(128)] + [0], np.int8)
NEXT = np.array([[OUT, WORD, NAMED if s == OPEN else WORD, OPEN, OUT] for s in range(4)], np.int8)
BEGINS = np.array([[1, s in (OUT, OPEN), s in (OUT, OPEN), 1, 1] for s in range(4)], bool)
ENDS_MARK = np.array([[0, 0, 0, 0, s == NAMED] for s in range(4)], bool)
#: The state two code points after any other is known from these two: after the first, only an open mark matters.
AFTER = np.array([[NEXT[NEXT[OUT][a]][b] for b in range(5)] for a in range(5)], np.int8)


class Chunk:
    """A run of code points, read once for all states it may be entered in."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        self.kinds = CLASS[np.minimum(codes, 128)]
        # From the third code point on nothing depends on the state of entry.
        before = AFTER[self.kinds[:-2], self.kinds[1:-1]] if len(self.kinds) > 2 else self.kinds[:0]
        self.begins = BEGINS[before, self.kinds[2:]]
        self.marks = int(np.count_nonzero(ENDS_MARK[before, self.kinds[2:]]))

    def head(self, state: int) -> tuple[int, list[bool], int]:
        """State, token beginnings and marks of the first two code points."""
        begins, marks = [], 0
        for kind in self.kinds[:2].tolist():
            begins.append(bool(BEGINS[state][kind]))
            marks += int(ENDS_MARK[state][kind])
            state = int(NEXT[state][kind])
        return state, begins, marks

    def summary(self) -> tuple[list[int], list[int], list[int]]:
        """For each state of entry: the state at the end, tokens that begin, marks that end."""
        heads, rest = [self.head(s) for s in range(4)], int(np.count_nonzero(self.begins))
        last = int(AFTER[self.kinds[-2], self.kinds[-1]]) if len(self.kinds) > 2 else None
        return [h[0] if last is None else last for h in heads], [sum(h[1]) + rest for h in heads], [h[2] + self.marks for h in heads]

    def offset(self, state: int, token: int) -> int:
        """Where token number `token` begins, or the length if fewer do."""
        begins = self.head(state)[1]
        at = np.concatenate([np.flatnonzero(begins), 2 + np.flatnonzero(self.begins)])
        return int(at[token]) if token < len(at) else len(self.kinds)


def rolls(id_col: str) -> Column:
    """Four numbers from the hash of a row's id; a null id counts as an empty one."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def _cuts(n: int, rolled: list[int]) -> tuple[int, int]:
    a, b = rolled[0] % (n + 1), rolled[1] % (n + 1)
    return min(a, b), max(a, b)


def _read_short(rows: DataFrame) -> DataFrame:
    """rows (id, text, rolls) of one chunk each, with n, marks, first and last (offsets of the cuts)."""
    out = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in ("n", "marks", "first", "last"))])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int]] = [[], [], [], []]
            for text, rolled in zip(batch.column(1), batch.column(2), strict=True):
                chunk = Chunk(text.as_py())
                _, tokens, marks = chunk.summary()
                a, b = _cuts(tokens[OUT], rolled.as_py())
                for own, x in zip(found, (tokens[OUT], marks[OUT], chunk.offset(OUT, a), chunk.offset(OUT, b)), strict=True):
                    own.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in found)], schema=arrow)

    return rows.mapInArrow(run, out)


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """(key, rolls, k, part) of rows (key, text, rolls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                for k in range(0, len(text), size):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(2).slice(row, 1), pa.array([k // size], pa.int64()), pa.array([text[k : k + size]], pa.string())], names=["key", "rolls", "k", "part"])

    return rows.mapInArrow(run, "key string, rolls array<long>, k long, part string")


def _summaries(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Chunk(t.as_py()) for t in batch.column(3)]
            each = [c.summary() for c in found]
            lists = [pa.array([e[j] for e in each], pa.list_(pa.int64())) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([len(c.kinds) for c in found], pa.int64()), *lists], names=["key", "rolls", "k", "chars", "ends", "tokens", "marks"])

    return parts.mapInArrow(run, "key string, rolls array<long>, k long, chars long, ends array<long>, tokens array<long>, marks array<long>")


def _found(parts: DataFrame) -> DataFrame:
    """(key, which, at) of rows (part, state, k, key, asked): offsets in the whole text's chunk of each asked token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ks, which, at = [], [], [], []
            for part, state, k, key, asked in zip(*(batch.column(c) for c in range(5)), strict=True):
                chunk = Chunk(part.as_py())
                for number, token in enumerate(asked.as_py()):
                    if token is not None:
                        keys.append(key.as_py()), ks.append(k.as_py()), which.append(number), at.append(chunk.offset(state.as_py(), token))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ks, pa.int64()), pa.array(which, pa.int64()), pa.array(at, pa.int64())], names=["key", "k", "which", "at"])

    return parts.select("part", "state", "k", "key", "asked").mapInArrow(run, "key string, k long, which long, at long")


def composed(parts: Column) -> Column:
    """The summary of consecutive chunks from the array of their summaries, in order."""
    nothing = F.struct(F.array(*(F.lit(s).cast("long") for s in range(4))).alias("ends"), F.array(*[F.lit(0).cast("long")] * 4).alias("tokens"), F.array(*[F.lit(0).cast("long")] * 4).alias("marks"))

    def then(f: Column, g: Column) -> Column:
        follow = lambda name: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: f[name][s] + g[name][f["ends"][s].cast("int")])
        return F.struct(F.transform(f["ends"], lambda s: g["ends"][s.cast("int")]).alias("ends"), follow("tokens").alias("tokens"), follow("marks").alias("marks"))

    return F.aggregate(parts, nothing, then)


def _entered(parts: Column, state: Column, tokens: Column) -> Column:
    """State and tokens before each of consecutive summaries, where the first is entered in `state` after `tokens`."""
    start = F.struct(state.alias("state"), tokens.alias("tokens"), F.array().cast("array<struct<state:bigint,tokens:bigint>>").alias("held"))
    step = lambda a, g: F.struct(g["ends"][a["state"].cast("int")].alias("state"), (a["tokens"] + g["tokens"][a["state"].cast("int")]).alias("tokens"), F.array_append(a["held"], F.struct(a["state"], a["tokens"])).alias("held"))
    return F.aggregate(parts, start, step, lambda a: a["held"])


def _read_long(rows: DataFrame, size: int) -> DataFrame:
    """(key, n, marks, first, last) of each different text of rows (key, text, rolls) in chunks of `size`.

    Only summaries are gathered by text, FAN chunks and then FAN chunks' summaries at a time; the
    chunks themselves stay where they were written, and copies of a text are read as one.
    """
    parts = written(_chunks(rows, size))
    sums = written(_summaries(parts).groupBy("key", "k").agg(*(F.first(c).alias(c) for c in ("rolls", "chars", "ends", "tokens", "marks"))))
    zero = F.lit(0).cast("long")
    blocks = sums.groupBy("key", F.floor(F.col("k") / FAN).alias("block")).agg(F.first("rolls").alias("rolls"), F.sum("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("k", "ends", "tokens", "marks"))).alias("parts"))
    blocks = written(blocks.withColumn("whole", composed(F.col("parts"))))
    texts = blocks.groupBy("key").agg(F.first("rolls").alias("rolls"), F.sum("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("block", F.col("whole.ends").alias("ends"), F.col("whole.tokens").alias("tokens"), F.col("whole.marks").alias("marks")))).alias("blocks"))
    whole = composed(F.col("blocks"))
    texts = texts.select("key", "rolls", "chars", "blocks", whole["tokens"][OUT].alias("n"), whole["marks"][OUT].alias("marks"), _entered(F.col("blocks"), zero, zero).alias("entered"))
    a, b = (F.col("rolls")[k] % (F.col("n") + 1) for k in (0, 1))
    texts = written(texts.withColumns({"a": F.least(a, b), "b": F.greatest(a, b)}))
    at_block = texts.select("key", "a", "b", F.posexplode("entered").alias("place", "enter"), "blocks").select("key", "a", "b", "enter", F.col("blocks")[F.col("place")]["block"].alias("block"))
    each = at_block.join(blocks.select("key", "block", "parts"), ["key", "block"])
    each = each.select("key", "a", "b", "parts", F.posexplode(_entered(F.col("parts"), F.col("enter.state"), F.col("enter.tokens"))).alias("place", "enter"))
    own = F.col("parts")[F.col("place")]
    each = each.select("key", "a", "b", own["k"].alias("k"), "enter.state", F.col("enter.tokens").alias("before"), own["tokens"][F.col("enter.state").cast("int")].alias("count"))
    asked = lambda c: F.when((F.col(c) >= F.col("before")) & (F.col(c) < F.col("before") + F.col("count")), F.col(c) - F.col("before"))
    each = each.withColumn("asked", F.array(asked("a"), asked("b"))).where(F.exists("asked", lambda x: x.isNotNull()))
    wanted = written(each.select(F.concat("key", F.lit(" "), F.col("k").cast("string")).alias("place"), "state", "asked"))
    met = matched(parts.withColumn("place", F.concat("key", F.lit(" "), F.col("k").cast("string"))), wanted, "place", "place", "inner", 200_000)
    at = _found(met).groupBy("key").agg(*(F.min(F.when(F.col("which") == w, F.col("k") * size + F.col("at"))).alias(f"at{w}") for w in (0, 1)))
    out = written(texts.join(at, "key", "left").select("key", "n", "marks", F.coalesce("at0", "chars").alias("first"), F.coalesce("at1", "chars").alias("last")))
    discard(parts, sums, blocks, texts, wanted)
    return out


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output of every whole text; one row for each input row.

    A null text is an empty one, and empty texts are plain, with no tokens.  Texts that hold a mark
    are plain, so that restored() is exact.  The cuts and the form depend on the id and the
    number of tokens alone; rows with a null id have those of an empty id; repeated rows give
    repeated results.  Texts of more than `size` code points are read in chunks by tasks of their
    own; their summaries, 100 bytes a chunk, are all that is shuffled, and the cuts are joined back
    by a digest of id and text, in salted tasks where there are many.  Other columns of df are
    ignored.  A whole text must fit into one row, as in df.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), rolls(id_col).alias("rolls"))
    read = _read_short(rows.where(F.char_length("text") <= size))
    key = F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256)
    long = rows.where(F.char_length("text") > size).withColumn("key", key)
    facts = _read_long(long.select("key", "text", "rolls"), size)
    read = read.unionByName(matched(long, facts, "key", "id", "inner", 200_000).drop("key"))
    plain = (F.col("text") == "") | (F.col("marks") > 0) | (F.col("rolls")[2] % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("rolls")[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    a, b = F.col("first").cast("int"), F.col("last").cast("int")
    prefix, middle, suffix = F.col("text").substr(F.lit(1), a), F.col("text").substr(a + 1, b - a), F.expr("substring(text, CAST(last AS INT) + 1)")
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", put(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)).otherwise(put(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    formed = F.col("form") != "plain"
    read = read.withColumn("form", form)
    return read.select(F.col("id").alias(id_col), "n", "form", F.when(formed, F.col("first")).alias("prefix_chars"), F.when(formed, F.col("last") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form.  No part holds a mark, so each mark is found at its first place."""
    start = lambda mark: F.locate(mark, output)
    between = lambda mark, end: output.substr(start(mark) + 3, end - start(mark) - 3)
    middle = output.substr(start(MIDDLE) + 3, F.char_length(output))
    psm = F.concat(between(PREFIX, start(SUFFIX)), middle, between(SUFFIX, start(MIDDLE)))
    spm = F.concat(between(PREFIX, start(MIDDLE)), middle, between(SUFFIX, start(PREFIX)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(df: DataFrame) -> DataFrame:
    """fill_in_middle() of documents with digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(df)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens, {', '.join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b FROM t),
s AS (SELECT *, array_to_string(tokens[1:a], '') AS pre, array_to_string(tokens[a + 1:b], '') AS mid, array_to_string(tokens[b + 1:], '') AS suf,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM s"""
