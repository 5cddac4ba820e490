"""Running Python over whole columns of a DataFrame in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Code points of text that one step holds as Python objects.
SLICE_CHARS = 4_000_000


def slices(batch: pa.RecordBatch, text_col: int, most_chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows that hold about most_chars together; null texts count as empty."""
    column, start, held, texts = batch.column(text_col), 0, 0, []
    for k in range(batch.num_rows):
        texts.append(column[k].as_py() or "")
        held += len(texts[-1])
        if held >= most_chars:
            yield start, texts
            start, held, texts = k + 1, 0, []
    if texts:
        yield start, texts


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[list[str]], list[list]]]) -> DataFrame:
    """The id column, then what make()(texts) returns as columns of `schema`.

    make runs once in each task; no row moves between partitions.
    """
    narrow = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    fields = _parse_datatype_string(schema)
    out = StructType([narrow.schema[0], *fields.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start, texts in slices(batch, 1):
                columns = work(texts)
                ids = batch.column(0).slice(start, len(texts)).cast(arrow.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, type=arrow.field(k + 1).type) for k, c in enumerate(columns))], schema=arrow)

    return narrow.mapInArrow(run, out)
