"""FASTA records as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.text import header_id


def read_fasta(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    """`(seq_ord, id, header, seq)` from one or more FASTA files.

    The reader splits at line breaks followed by `>`, so each row is a whole record and large files are
    read in parallel splits. Blank lines, text before the first header and headers without an id or a
    sequence are dropped. `seq_ord` increases with the position inside a file; it is not dense.
    """
    chunks = (
        spark.read.option("lineSep", "\n>")
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
        .withColumn("seq_ord", F.monotonically_increasing_id())
    )
    marked = F.col("value").rlike(r"^\s*>")
    # at most one chunk per file: text that comes before the first header
    loose = (
        chunks.filter(F.col("_start") == 0)
        .groupBy("file")
        .agg(F.min_by(F.struct("seq_ord", marked.alias("marked")), "seq_ord").alias("_first"))
        .filter(~F.col("_first.marked"))
        .select(F.col("_first.seq_ord").alias("seq_ord"))
    )
    body = chunks.join(loose, "seq_ord", "left_anti")
    text = F.regexp_replace("value", r"^\s*>", "")
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    seq = F.upper(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), ""))
    records = body.select("seq_ord", "file", F.get(lines, F.lit(0)).alias("header"), seq.alias("seq"))
    kept = records.withColumn("id", header_id("header")).filter((F.length("seq") > 0) & F.col("id").isNotNull())
    return kept.select("seq_ord", "id", "header", "seq", *(["file"] if with_file else []))


def read_fasta_dir(spark: SparkSession, path: str, with_file: bool = True) -> DataFrame:
    """All `*.fasta` and `*.fa` files below a directory, or the one file given."""
    if path.endswith((".fasta", ".fa")):
        return read_fasta(spark, path, with_file)
    return read_fasta(spark, f"{path.rstrip('/')}/*.{{fasta,fa}}", with_file)


def count_bad_records(spark: SparkSession, path: str) -> DataFrame:
    """One row: records, and how many lack an id or a sequence."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", r"^\s*>", "")
    header = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    letters = F.length(F.regexp_replace(F.regexp_replace(text, r"^[^\r\n]*", ""), r"\s+", ""))
    bad = (letters == 0) | header_id(header).isNull()
    return raw.agg(F.count(F.lit(1)).alias("records"), F.count_if(bad).alias("bad_records"))


def write_fasta(seqs: DataFrame, path: str, width: int = 60) -> None:
    """`(id, seq)` as FASTA text, sequence lines of `width` letters."""
    wrapped = F.regexp_replace("seq", f"(?s)(.{{{width}}})(?=.)", "$1\n")
    record = F.concat(F.lit(">"), F.col("id"), F.lit("\n"), wrapped)
    seqs.select(record.alias("value")).write.mode("overwrite").text(path)
