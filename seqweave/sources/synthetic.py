"""Seeded synthetic sequences, pairs and vectors of any size, generated in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave import constants as C
from seqweave.functions.seeded import hash_to_long, seeded_choice, seeded_hash, seeded_normal


def synthetic_sequences(
    spark: SparkSession, n: int, min_len: int = 20, max_len: int = 49, alphabet: str = C.AMINO_ACIDS, seed: int = 42
) -> DataFrame:
    """`(seq_ord, id, seq)` with lengths uniform in [min_len, max_len]."""
    span = max_len - min_len + 1
    length = (hash_to_long(seeded_hash(seed, "id", F.lit("len"))) % span + min_len).cast("int")
    letters = F.transform(F.sequence(F.lit(1), length), lambda i: seeded_choice(alphabet, seed, F.col("id"), i))
    return spark.range(n).select(
        F.col("id").alias("seq_ord"), F.concat(F.lit("S"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("_id"),
        F.array_join(letters, "").alias("seq"),
    ).withColumnRenamed("_id", "id")


def synthetic_pairs(spark: SparkSession, n: int, n_ids: int, label: int, seed: int = 42, prefix: str = "P") -> DataFrame:
    """Up to n distinct unordered pairs of different ids, smaller id first."""
    def pick(tag: str):
        return hash_to_long(seeded_hash(seed, "id", F.lit(f"{tag}{label}"))) % n_ids

    drawn = spark.range(n).select(pick("a").alias("a"), pick("b").alias("b")).filter(F.col("a") != F.col("b"))

    def name(c):
        return F.concat(F.lit(prefix), F.lpad(c.cast("string"), 9, "0"))

    return drawn.select(
        name(F.least("a", "b")).alias("p1"), name(F.greatest("a", "b")).alias("p2"), F.lit(label).cast("int").alias("label")
    ).distinct()


def synthetic_embeddings(spark: SparkSession, n: int, dim: int, seed: int = 42, prefix: str = "P") -> DataFrame:
    """`(key, vec)` of standard normal draws."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: seeded_normal(seed, "id", d).cast("float"))
    return spark.range(n).select(F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), 9, "0")).alias("key"), cells.alias("vec"))
