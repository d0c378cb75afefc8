"""Sequences to levelled n-gram graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave import constants as C
from seqweave.operators import graph, ngrams
from seqweave.session import materialise


@dataclass
class LevelGraph:
    """One level: nodes `(id, name)`, counted edges `(src, dst, w)`, matrices `(src, dst, w_out, w_in, w_und)`."""

    n: int
    nodes: DataFrame
    edges: DataFrame
    matrices: DataFrame


def build_graph(seqs: DataFrame, max_n: int = 3, padding: str = "first") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary `(n, id, ngram)`, edges `(n, src, dst, w)` and stats `(n, n_nodes, n_edges, density)`."""
    vocab, edges = ngrams.build_levels(ngrams.pad_sequences(seqs, padding), max_n)
    return vocab, edges, ngrams.graph_stats(vocab, edges, by="n")


def level_graph(vocab: DataFrame, edges: DataFrame, n: int, eps: float = C.PROPAGATION_EPSILON) -> LevelGraph:
    """Nodes, edges and the three propagation matrices of one level."""
    named = vocab.filter(F.col("n") == n).select("id", F.col("ngram").alias("name"))
    counted = edges.filter(F.col("n") == n).select("src", "dst", F.col("w").cast("double").alias("w"))
    nodes = materialise(graph.densify_nodes(named, counted))
    return LevelGraph(n, nodes, counted, materialise(graph.layer_matrices(counted, nodes, eps)))
