"""From raw documents to packed token windows, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  A stage's result is written and read again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import lines, packing, quality, shingles
from kithgraph.llm.queries import table, vocabulary
from kithgraph.llm.shared import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier rejects go.

    Learns from `labels` joined to docs.  A null or empty text has the score of the sample's share of
    good documents; equal rows get equal decisions; an empty table stays empty.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on many sites go; no document does.

    n_chars becomes the length of the new text, null for a null text.
    """
    cleaned = lines.remove_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: links at five words and a similarity of 0.8 and more.

    Two documents are also near copies if their texts in `documents` were so, before lines were
    removed.  Null and empty texts link only by those.
    """
    return shingles.one_of_each(docs, words=5, link=80, also=table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of all documents; a null or empty text is packed as its end token alone."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("jaccard", near_duplicate_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs


#: SQL can't express the classifier and the tokenizer.
ORACLE_SQL = None
