"""Chat formatting that a deterministic parser reads back exactly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

START, MIDDLE, END = "### ", ": ", " </turn>\n"
#: Control strings in a text, with the backslashes before them.  "###" at a text's end would meet
#: the space that follows.
CONTROL = re.compile(r"\\*(?:### |###\Z|</turn>)")
ESCAPED = re.compile(r"\\(\\*(?:### |###\Z|</turn>))")
ROLE_CONTROL, ROLE_ESCAPED = re.compile(r"[\\:#<]"), re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:\\.|[^\\:])*): (.*?) (?<!\\)</turn>\n", re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in rendered text; ValueError if it is not a run of whole turns."""
    turns, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((ROLE_ESCAPED.sub(r"\1", m[1]), ESCAPED.sub(r"\1", m[2])))
        at = m.end()
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its body begins and how long it is.

    The body is escaped once more for as long as parsing does not give the turn back.
    """
    head, body = START + ROLE_CONTROL.sub(r"\\\g<0>", role) + MIDDLE, text
    for _ in range(3):
        out = head + body + END
        try:
            same = parse(out) == [(role, text)]
        except ValueError:
            same = False
        if same and (body != text or not CONTROL.search(text)):
            return out, len(head), len(body)
        body = CONTROL.sub(r"\\\g<0>", body)
    raise AssertionError("a turn can't be rendered")


def render_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_from: str = "assistant") -> DataFrame:
    """conv, turn, segment, loss_start, loss_chars for every input row; no row moves.

    The segments of a conversation by turn make up its formatted text.  The loss mask covers
    loss_chars code points of a segment from loss_start on: the (escaped) text of a row whose role
    is learn_from, nothing of others.  Null role or text: empty.  Repeated rows are repeated turns; an
    empty table gives no rows.  A very long text takes memory in proportion to its length.
    """
    narrow = df.select(F.col(conv_col), F.col(turn_col), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("__role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    out = StructType([narrow.schema[0], narrow.schema[1], StructField("segment", StringType()), StructField("loss_start", LongType()), StructField("loss_chars", LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            made = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            loss = [n if r == learn_from else 0 for r, (_, _, n) in zip(roles, made, strict=True)]
            columns = [[x[0] for x in made], [x[1] for x in made], loss]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, type=arrow.field(k + 2).type) for k, c in enumerate(columns))], schema=arrow)

    return narrow.mapInArrow(run, out)


def read_back(rendered: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row for each conversation with digests of what the parser reads in its segments.

    Segments are sorted by turn (nulls first; ties by segment) and stream through running digests,
    so memory does not grow with a conversation.  Rows with a null id are one conversation.
    """
    schema = StructType([rendered.schema[conv_col], *(StructField(n, StringType() if n.endswith("256") else LongType()) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))])
    arrow = to_arrow_schema(schema)
    moved = rendered.select(conv_col, turn_col, "segment", "loss_start", "loss_chars").repartition(F.col(conv_col)).sortWithinPartitions(conv_col, turn_col, "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
            done.clear()
            return out

        for batch in batches:
            for conv, _, segment, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = ESCAPED.sub(r"\1", segment[first : first + n])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(segment)
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    return moved.mapInArrow(run, schema)


#: DuckDB SQL for read_back(render_turns(conversations and conversation -7)).
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(4 + length(regexp_replace(role, '[\\:#<]', '\\\0', 'g')) + 2 + length(regexp_replace(text, '\\*(?:### |###\z|</turn>)', '\\\0', 'g')) + 9) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
