"""The registered queries of this subpackage: one for each operator, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from floorledger.llm import bpe, graph_dedup, lexical, line_dedup, merkle, mixing, multi_index, ngram_join, pieces, quality, substrings, suffix_array, token_counts
from floorledger.llm.common import table


def op1_byte_bpe(spark: SparkSession, base: str) -> DataFrame:
    return bpe.digests(table(spark, base, "documents"), bpe.tokenizer_path("byte_bpe_50k.tiktoken"))


def op2_ngram_join(spark: SparkSession, base: str) -> DataFrame:
    return ngram_join.link(table(spark, base, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_substring_dedup(spark: SparkSession, base: str) -> DataFrame:
    return substrings.digests(table(spark, base, "documents"))


def op4_mix_sources(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix(table(spark, base, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, base: str) -> DataFrame:
    return token_counts.count(table(spark, base, "documents"), bpe.tokenizer_path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, base: str) -> DataFrame:
    return quality.classify(table(spark, base, "documents"), table(spark, base, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_multi_index(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "embeddings")
    return multi_index.search(rows, rows.where("vec_id % 100 = 0"))


def op8_embedding_dedup(spark: SparkSession, base: str) -> DataFrame:
    return graph_dedup.dedup(table(spark, base, "embeddings"))


def op9_suffix_array_dedup(spark: SparkSession, base: str) -> DataFrame:
    return suffix_array.digests(table(spark, base, "documents"))


def op10_line_dedup(spark: SparkSession, base: str) -> DataFrame:
    return line_dedup.decisions(table(spark, base, "documents"))


def op11_sentence_pieces(spark: SparkSession, base: str) -> DataFrame:
    return pieces.digests(table(spark, base, "documents"), bpe.tokenizer_path("piece_bpe_32k.model"))


def op12_lexical_search(spark: SparkSession, base: str) -> DataFrame:
    return lexical.search(table(spark, base, "documents"), table(spark, base, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, base: str) -> DataFrame:
    return merkle.document_manifest(table(spark, base, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_ngram_join": op2_ngram_join,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_mix_sources": op4_mix_sources,
        "op5_token_counts": op5_token_counts,
        "op6_quality": op6_quality,
        "op7_multi_index": op7_multi_index,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_line_dedup": op10_line_dedup,
        "op11_sentence_pieces": op11_sentence_pieces,
        "op12_lexical_search": op12_lexical_search,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": mixing.MIX_SQL, "op10_line_dedup": line_dedup.LINES_SQL, "op12_lexical_search": lexical.SEARCH_SQL, "op13_merkle_manifest": merkle.MANIFEST_SQL}
