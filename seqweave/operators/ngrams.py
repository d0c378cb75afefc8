"""Sequences to n-gram vocabularies and weighted transition edges.

A transition between consecutive n-grams is one (n+1)-gram, so edges are counted as (n+1)-grams and
split into source and target only after aggregation: the shuffle carries one short string per
distinct edge and map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.functions import text
from seqweave.operators.ordering import global_rank
from seqweave.session import materialise

CHUNK = 4096


def pad_sequences(
    seqs: DataFrame, mode: str = "first", seq: str = "seq", order: str = "seq_ord"
) -> DataFrame:
    """Replace `seq` by its padded form.

    `first`: trailing space on every record and a leading space on the first record of the table;
    `all`: both on every record; `none`: unchanged.
    """
    if mode == "none":
        return seqs
    if mode == "all":
        return seqs.withColumn(seq, F.concat(F.lit(" "), F.col(seq), F.lit(" ")))
    if mode != "first":
        raise ValueError(f"unknown padding mode {mode!r}")
    first = seqs.agg(F.min(order)).first()[0]  # one number, answered from column statistics or one scan
    if first is None:
        return seqs
    lead = F.when(F.col(order) == F.lit(first), " ").otherwise("")
    return seqs.withColumn(seq, F.concat(lead, F.col(seq), F.lit(" ")))


def _windows(seqs: DataFrame, width: int, seq: str, keep: list[str]) -> DataFrame:
    """(keep..., pos, gram) for all overlapping windows of `width` characters.

    Long sequences are first cut into overlapping chunks, so no single row ever holds an array as long
    as its sequence.
    """
    chunks = seqs.select(*keep, F.posexplode(text.overlapping_chunks(seq, CHUNK, width - 1)).alias("_c", "_chunk"))
    return chunks.select(
        *keep, "_c", F.posexplode(text.gram_array("_chunk", width)).alias("_i", "gram")
    ).select(*keep, (F.col("_c").cast("bigint") * CHUNK + F.col("_i")).alias("pos"), "gram")


def _window_values(seqs: DataFrame, width: int, seq: str, keep: list[str]) -> DataFrame:
    """As `_windows` without positions."""
    chunks = seqs.select(*keep, F.explode(text.overlapping_chunks(seq, CHUNK, width - 1)).alias("_chunk"))
    return chunks.select(*keep, F.explode(text.gram_array("_chunk", width)).alias("gram"))


def ngrams(seqs: DataFrame, n: int, key: str = "id", seq: str = "seq") -> DataFrame:
    """`(key, pos, ngram)`, positions from 0; sequences shorter than n give no rows."""
    return _windows(seqs, n, seq, [key]).withColumnRenamed("gram", "ngram")


def ngram_counts(seqs: DataFrame, n: int, key: str | None = None, seq: str = "seq") -> DataFrame:
    """Occurrences per n-gram, or per (key, n-gram)."""
    keep = [key] if key else []
    return (
        _window_values(seqs, n, seq, keep)
        .withColumnRenamed("gram", "ngram")
        .groupBy(*keep, "ngram")
        .agg(F.count(F.lit(1)).alias("n_occ"))
    )


def distinct_ngrams(seqs: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    return _window_values(seqs, n, seq, []).select(F.col("gram").alias("ngram")).distinct()


def assign_ids(grams: DataFrame, ngram: str = "ngram") -> DataFrame:
    """`(id, ngram)`: dense ids from 0 in sorted order of the (distinct) n-grams."""
    return global_rank(grams.select(ngram), [ngram], "id").select("id", ngram)


def transitions(seqs: DataFrame, n: int, key: str = "id", seq: str = "seq") -> DataFrame:
    """`(key, pos, src, dst)`: one row per pair of consecutive n-grams, `length - n` per sequence."""
    return _windows(seqs, n + 1, seq, [key]).select(
        key, "pos", F.substring("gram", 1, n).alias("src"), F.substring("gram", 2, n).alias("dst")
    )


def count_edges(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Weight = number of occurrences of each (src, dst)."""
    return pairs.groupBy(src, dst).agg(F.count(F.lit(1)).alias("w"))


def transition_counts(seqs: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """`(src, dst, w)` on n-gram names: `transitions` followed by `count_edges`, in one aggregation."""
    return ngram_counts(seqs, n + 1, seq=seq).select(
        F.substring("ngram", 1, n).alias("src"), F.substring("ngram", 2, n).alias("dst"), F.col("n_occ").alias("w")
    )


def encode_edges(edges: DataFrame, vocab: DataFrame) -> DataFrame:
    """Names to ids at both ends of counted edges; edges with an unknown n-gram are dropped.

    Joins run on distinct edges. The vocabulary is broadcast when Spark finds it below the automatic
    threshold and shuffled otherwise.
    """
    source = vocab.select(F.col("ngram").alias("src"), F.col("id").alias("_s"))
    target = vocab.select(F.col("ngram").alias("dst"), F.col("id").alias("_d"))
    return edges.join(source, "src").join(target, "dst").select(
        F.col("_s").alias("src"), F.col("_d").alias("dst"), "w"
    )


def level_counts(seqs: DataFrame, max_n: int, seq: str = "seq") -> DataFrame:
    """`(width, ngram, n_occ)` for all widths 1..max_n+1 from one pass over the text.

    Width n gives the vocabulary of level n, width n+1 its edges. The pass counts only the longest windows,
    where the last few starts of a sequence contribute the shorter text that is left. Every narrower window
    is the prefix of exactly one of those, so all other widths follow from the counted table.
    """
    longest = max_n + 1
    chunks = seqs.select(F.explode(text.overlapping_chunks(seq, CHUNK, max_n)).alias("_chunk"))
    # starts beyond CHUNK belong to the next chunk
    starts = F.slice(text.window_array("_chunk", longest), 1, CHUNK)
    counted = chunks.select(F.explode(starts).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n_occ"))
    width = F.explode(F.sequence(F.lit(1), F.length("ngram")))
    prefixes = counted.select(width.alias("width"), "ngram", "n_occ")
    return prefixes.groupBy("width", F.col("ngram").substr(F.lit(1), F.col("width")).alias("ngram")).agg(
        F.sum("n_occ").alias("n_occ")
    )


def build_levels(seqs: DataFrame, max_n: int, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Vocabulary `(n, id, ngram)` and encoded edges `(n, src, dst, w)` for every n in 1..max_n."""
    counts = materialise(level_counts(seqs, max_n, seq))  # small: distinct windows only
    vocab = materialise(level_vocabulary(counts, max_n))  # joined at both ends of every edge
    source = vocab.select("n", F.col("ngram").alias("_a"), F.col("id").alias("src"))
    target = vocab.select("n", F.col("ngram").alias("_b"), F.col("id").alias("dst"))
    edges = (
        level_edges(counts)
        .withColumnRenamed("src", "_a")
        .withColumnRenamed("dst", "_b")
        .join(source, ["n", "_a"])
        .join(target, ["n", "_b"])
        .select("n", "src", "dst", "w")
    )
    return vocab, edges


def level_vocabulary(counts: DataFrame, max_n: int) -> DataFrame:
    """Dense sorted ids per level from `level_counts`: one global sort, offset per level."""
    grams = counts.filter(F.col("width") <= max_n).select(F.col("width").alias("n"), "ngram")
    ranked = global_rank(grams, ["n", "ngram"], "_rank")
    firsts = ranked.groupBy("n").agg(F.min("_rank").alias("_first"))  # max_n rows
    return ranked.join(firsts, "n").select("n", (F.col("_rank") - F.col("_first")).alias("id"), "ngram")


def level_edges(counts: DataFrame) -> DataFrame:
    """Named edges `(n, src, dst, w)` from `level_counts`."""
    n = F.col("width") - 1
    return counts.filter(F.col("width") > 1).select(
        n.alias("n"),
        F.col("ngram").substr(F.lit(1), n).alias("src"),
        F.col("ngram").substr(F.lit(2), n).alias("dst"),
        F.col("n_occ").alias("w"),
    )


def graph_stats(nodes: DataFrame, edges: DataFrame, by: str | None = None) -> DataFrame:
    """Nodes, distinct edges and density `E / (N (N - 1))`, optionally per level."""
    keys = [by] if by else []
    tally = (
        nodes.select(*keys, F.lit(1).alias("_n"), F.lit(0).alias("_e"))
        .unionByName(edges.select(*keys, F.lit(0).alias("_n"), F.lit(1).alias("_e")))
        .groupBy(*keys)
        .agg(F.sum("_n").alias("n_nodes"), F.sum("_e").alias("n_edges"))
    )
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1)
    density = F.coalesce(F.try_divide(F.col("n_edges").cast("double"), possible.cast("double")), F.lit(0.0))
    return tally.withColumn("density", density)
