"""Level by level node embeddings and their pooling to record vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.operators import features, pooling
from seqweave.operators.features import DirectedLayer
from seqweave.plans.sequence_graph import level_graph
from seqweave.session import materialise

LONGEST = 1 << 24  # characters of a record that one task pools


def hierarchical_embed(
    vocab: DataFrame, edges: DataFrame, max_n: int, dims: list[int], seed: int = 42
) -> dict[int, DataFrame]:
    """`n -> (id, ngram, vec)`. Level 1 starts from random features, level n from its (n-1)-grams.

    Levels depend on each other and run in order; each is written once and parallel inside. `dims` are the
    layer widths, the first being the width of the random features.
    """
    levels: dict[int, DataFrame] = {}
    for n in range(1, max_n + 1):
        g = level_graph(vocab, edges, n)
        grams = g.nodes.select("id", F.col("name").alias("ngram"))
        if n == 1:
            x, width = features.random_features(g.nodes, dims[0], seed), dims[0]
        else:
            width = dims[-1]
            x = features.pool_prefix_suffix(grams, levels[n - 1].select("ngram", "vec"), width)
        widths = [width, *dims[1:]]
        layers = [DirectedLayer.seeded(widths[i], widths[i + 1], seed + 100 * n + 10 * i) for i in range(len(widths) - 1)]
        vectors = features.embed_nodes(g.matrices, materialise(x), layers)
        levels[n] = materialise(grams.join(vectors, "id").select("id", "ngram", "vec"))
    return levels


def embed_records(seqs: DataFrame, level: DataFrame, n: int, weighting: str = "distinct", id_map: DataFrame | None = None) -> DataFrame:
    """`(key, vec)` per record from the last level; pooling sees the unpadded sequences.

    Of several records with one id the last counts, before and after ids are mapped.
    """
    from seqweave.operators.ids import apply_id_map

    latest = pooling.latest_records(seqs)
    longest = seqs.agg(F.max(F.length("seq"))).first()[0] or 0
    pooled = pooling.pool_ngrams(latest, level.select("ngram", "vec"), n, weighting, together=longest <= LONGEST)
    named = pooled.join(latest.select("id", F.col("seq_ord").alias("ord")), "id").withColumnRenamed("id", "key")
    if id_map is None:
        return named.select("key", "vec")
    return apply_id_map(named, id_map).select("key", "vec")
