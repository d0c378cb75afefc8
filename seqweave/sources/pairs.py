"""Pair files `(p1, p2)`, one label per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.operators.splits import sample_exact

PAIR_SCHEMA = "p1 string, p2 string"


def parse_pair_lines(lines: DataFrame, label: int, column: str = "value") -> DataFrame:
    """Lenient parse: quotes removed, split at commas or else at tabs, trimmed, both fields required."""
    bare = F.regexp_replace(F.trim(column), '"', "")
    by_comma = F.split(bare, ",")
    fields = F.when(F.size(by_comma) >= 2, by_comma).otherwise(F.split(bare, "\t"))
    side = [F.regexp_replace(F.get(fields, F.lit(i)), r"^\s+|\s+$", "") for i in (0, 1)]
    parsed = lines.select(side[0].alias("p1"), side[1].alias("p2"), F.lit(label).cast("int").alias("label"))
    return parsed.filter((F.col("p1") != "") & (F.col("p2") != ""))


def read_pairs_lenient(
    spark: SparkSession, path: str, label: int, sample: int | None = None, seed: int = 42
) -> DataFrame:
    """Line-based reader for mixed comma / tab files; the optional sample is drawn from parsed pairs."""
    pairs = parse_pair_lines(spark.read.text(path), label)
    return pairs if sample is None else sample_exact(pairs, sample, ["p1", "p2"], seed)


def clean_pairs(raw: DataFrame, label: int) -> DataFrame:
    """Trim and drop rows with a missing side."""
    trimmed = raw.select(F.trim("p1").alias("p1"), F.trim("p2").alias("p2"), F.lit(label).cast("int").alias("label"))
    return trimmed.filter((F.col("p1") != "") & (F.col("p2") != ""))


def read_pairs_strict(
    spark: SparkSession, path: str, label: int, sep: str = ",", sample: int | None = None, seed: int = 42
) -> DataFrame:
    """CSV reader with two string columns and an explicit separator."""
    raw = spark.read.schema(PAIR_SCHEMA).option("sep", sep).option("header", "false").csv(path)
    pairs = clean_pairs(raw, label)
    return pairs if sample is None else sample_exact(pairs, sample, ["p1", "p2"], seed)
