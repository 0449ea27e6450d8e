"""The corpus pipeline: documents → the tokens of a cleaned, deduplicated and mixed corpus.

Each stage takes all that its predecessor kept, decides with one operator of ``floorledger.llm`` and passes on whole documents; the
last one returns tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floorledger.llm import bpe, line_dedup, mixing, ngram_join, quality
from floorledger.llm.common import staged, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines that match an earlier line go, and documents of which every line with words went."""
    return line_dedup.dedup(docs, drop_emptied=True)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of documents linked by near-equal shingle sets the smallest id stays."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mix takes it; a copy cut short stays whole when at least half of it is taken."""
    return mixing.mix_rows(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: doc_id, n_tokens, digests of the ids and of the bytes decoded from them, and the ids."""
    return bpe.digests(docs, bpe.tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: The classifier of the first stage is fitted; SQL cannot say it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs)
    return docs
