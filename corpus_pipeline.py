"""A training-data pipeline over the documents: good texts, one of each near copy, no benchmark items, no secrets, packed.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on; the last one returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.llm.common import read_table
from seqweave.llm.decontamination import drop_contaminated
from seqweave.llm.jaccard_join import one_of_each
from seqweave.llm.packing import pack
from seqweave.llm.quality import keep_good
from seqweave.llm.secret_scan import redact
from seqweave.session import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id."""
    return one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that are not widely copied examples masked and n_chars brought up to date."""
    masked = redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    path = public_tokenizers.path
    pieces = pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), capacity=2048)
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_near_copies),
    ("decontamination", no_benchmark),
    ("secrets", no_secrets),
    ("packing", packed),
]

#: The stages fit a model, hash and tokenise: SQL cannot express them. tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
