"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import chat, codes, fingerprints, html, lines, middles, packing, pieces, quality, shingles, tokens, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    return chat.read_back(chat.render_turns(own.select("conv_id", "turn", "role", "text").unionByName(hard)))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.remove_boilerplate(table(spark, sf_dir, "documents")))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.link_documents(table(spark, sf_dir, "documents"))


def op10_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middles.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_chat_format, op2_html_main_text, op3_quality_votes, op4_multiset_fingerprint, op5_bpe_encode_decode, op6_token_counts, op7_line_spread, op8_pack, op9_ngram_jaccard, op10_spherical_caps,
            op11_vector_codes, op12_sentencepiece, op13_fill_in_middle,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.SQL, "op7_line_spread": lines.SQL, "op11_vector_codes": codes.SQL, "op13_fill_in_middle": middles.SQL}
