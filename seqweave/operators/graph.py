"""Weighted directed graphs as COO edge tables `(src, dst, w)` and node tables `(id, name)`.

Row sums and degrees are plain aggregations joined back, never windows: a hub that owns a third of all
edges is combined on the map side and its join partition is split by AQE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave import constants as C
from seqweave.operators.ordering import global_rank, group_rank


def densify_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`(id, name)` for every id from 0 to the largest id in use; unnamed ids get a placeholder."""
    spark = nodes.sparkSession
    ids = nodes.select("id").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("id")))
    top = ids.agg(F.max("id")).first()[0]
    full = spark.range(0, 0 if top is None else top + 1)
    known = nodes.filter(F.col("id") >= 0).select("id", "name")
    fallback = F.concat(F.lit(C.PLACEHOLDER_PREFIX), F.col("id").cast("string"), F.lit(C.PLACEHOLDER_SUFFIX))
    return full.join(known, "id", "left").select("id", F.coalesce("name", fallback).alias("name"))


def adjacency_out(edges: DataFrame) -> DataFrame:
    """Duplicate entries summed."""
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Transpose: a column swap."""
    swapped = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return edges.select(*[swapped.get(c, F.col(c)) for c in edges.columns])


def adjacency_in(edges: DataFrame) -> DataFrame:
    return reverse_edges(adjacency_out(edges))


def to_undirected(edges: DataFrame) -> DataFrame:
    """Distinct `(src, dst)` in both directions."""
    ends = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return edges.select(F.inline(ends)).distinct()


def add_self_loops(edges: DataFrame, nodes: DataFrame, dedupe: bool = False) -> DataFrame:
    """Append `(i, i)` for every node; loops already present stay as a second entry unless `dedupe`."""
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    base = edges.select("src", "dst")
    if dedupe:
        base = base.filter(F.col("src") != F.col("dst"))
    return base.unionByName(loops)


def degree(edges: DataFrame, end: str = "dst") -> DataFrame:
    return edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("deg"))


def sym_normalize(edges: DataFrame, nodes: DataFrame, dedupe: bool = False) -> DataFrame:
    """Symmetric degree normalisation of the unweighted, undirected graph with self-loops.

    Mirroring, de-duplication and loops are one aggregation: an entry is worth 1 for being an edge in
    either direction plus 1 for its self-loop (1 in total when `dedupe`).
    """
    ends = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    linked = edges.select(F.inline(ends)).select("src", "dst", F.lit(1).alias("_edge"), F.lit(0).alias("_loop"))
    loops = nodes.select(
        F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("_edge"), F.lit(1).alias("_loop")
    )
    worth = F.greatest(F.max("_edge"), F.max("_loop")) if dedupe else F.max("_edge") + F.max("_loop")
    entries = linked.unionByName(loops).groupBy("src", "dst").agg(worth.cast("double").alias("w"))
    return normalize_entries(entries)


def normalize_entries(entries: DataFrame) -> DataFrame:
    """`w / sqrt(d_src d_dst)` with `d` the column sums; zero sums give zero.

    `entries` is already coalesced: n equal entries of weight 1 count as one entry of weight n.
    """
    deg = entries.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("_d"))
    inv = deg.select("id", F.when(F.col("_d") > 0, 1.0 / F.sqrt("_d")).otherwise(0.0).alias("_inv"))
    row = inv.select(F.col("id").alias("src"), F.col("_inv").alias("_r"))
    col = inv.select(F.col("id").alias("dst"), F.col("_inv").alias("_c"))
    value = F.coalesce("_r", F.lit(0.0)) * F.col("w") * F.coalesce("_c", F.lit(0.0))
    return entries.join(row, "src", "left").join(col, "dst", "left").select("src", "dst", value.alias("w"))


def row_normalize(edges: DataFrame) -> DataFrame:
    """`w / row sum`; a row that sums to zero becomes zero."""
    sums = edges.groupBy("src").agg(F.sum("w").alias("_sum"))
    value = F.coalesce(F.try_divide(F.col("w").cast("double"), F.col("_sum").cast("double")), F.lit(0.0))
    return edges.join(sums, "src").select("src", "dst", value.alias("w"))


def sym_skew_energy(edges: DataFrame) -> DataFrame:
    """Sum of squares of the symmetric and skew parts of the row-normalised matrix.

    Both squares together equal half of `A*A` plus its transpose, so each entry is emitted to its own
    and its mirrored place and summed: one shuffle, neither part is built.
    """
    half = F.col("w") * F.col("w") * F.lit(0.5)
    places = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), half.alias("w")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), half.alias("w")),
    )
    return row_normalize(edges).select(F.inline(places)).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def identity_entries(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))


def _mirrored(edges: DataFrame, nodes: DataFrame, values: dict[str, object]) -> DataFrame:
    """Mirror per-edge values and add the diagonal in one aggregation.

    Gives per (src, dst): the sum of each value over both directions, `_edge` = 1 where an edge exists in
    either direction, `_loop` = 1 on the diagonal.
    """
    kept = [F.col(v) for v in values]
    places = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), *kept),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), *kept),
    )
    valued = edges.select("src", "dst", *[c.alias(v) for v, c in values.items()])
    linked = valued.select(F.inline(places)).withColumn("_edge", F.lit(1)).withColumn("_loop", F.lit(0))
    loops = nodes.select(
        F.col("id").alias("src"),
        F.col("id").alias("dst"),
        *[F.lit(0.0).alias(v) for v in values],
        F.lit(0).alias("_edge"),
        F.lit(1).alias("_loop"),
    )
    return linked.unionByName(loops).groupBy("src", "dst").agg(
        *[F.sum(v).alias(v) for v in values], F.max("_edge").alias("_edge"), F.max("_loop").alias("_loop")
    )


def _with_sums(edges: DataFrame, *ends: str) -> DataFrame:
    """Add `_sum_src` / `_sum_dst`: weight totals of the edge's row and column."""
    out = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    for end in ends:
        sums = edges.groupBy(end).agg(F.sum(F.col("w").cast("double")).alias(f"_sum_{end}"))
        out = out.join(sums, end)
    return out


def _half_square(end: str):
    share = F.coalesce(F.try_divide(F.col("w"), F.col(f"_sum_{end}")), F.lit(0.0))
    return share * share * F.lit(0.5)


def _propagation_value(energy: str, eps: float):
    return F.when(F.col("_edge") == 1, F.sqrt(F.col(energy) + F.lit(eps))).otherwise(0.0) + F.col("_loop")


def propagation_matrix(edges: DataFrame, nodes: DataFrame, eps: float = C.PROPAGATION_EPSILON) -> DataFrame:
    """`sqrt(energy + eps)` on the non-zeros plus the identity; a graph without edges stays empty."""
    diagonal = nodes.filter(edges.select(F.lit(1)).exists())
    entries = _mirrored(_with_sums(edges, "src"), diagonal, {"_out": _half_square("src")})
    return entries.select("src", "dst", _propagation_value("_out", eps).alias("w"))


def propagation_wide(edges: DataFrame, nodes: DataFrame, eps: float = C.PROPAGATION_EPSILON) -> DataFrame:
    """`(src, dst, w_out, w_in, _edge, _loop)`: propagation values of the graph and of its transpose.

    The transpose's row sums are the graph's column sums and both results have the same places, so one
    aggregation serves both. `edges` must hold each (src, dst) once.
    """
    diagonal = nodes.filter(edges.select(F.lit(1)).exists())
    shares = {"_out": _half_square("src"), "_in": _half_square("dst")}
    entries = _mirrored(_with_sums(edges, "src", "dst"), diagonal, shares)
    return entries.select(
        "src",
        "dst",
        _propagation_value("_out", eps).alias("w_out"),
        _propagation_value("_in", eps).alias("w_in"),
        "_edge",
        "_loop",
    )


def propagation_pair(edges: DataFrame, nodes: DataFrame, eps: float = C.PROPAGATION_EPSILON) -> DataFrame:
    """Propagation matrices of the graph and its transpose, tagged `matrix` = out / in."""
    tagged = F.array(
        F.struct(F.lit("out").alias("matrix"), F.col("w_out").alias("w")),
        F.struct(F.lit("in").alias("matrix"), F.col("w_in").alias("w")),
    )
    wide = propagation_wide(adjacency_out(edges), nodes, eps)
    return wide.select("src", "dst", F.inline(tagged)).select("matrix", "src", "dst", "w")


def layer_matrices(edges: DataFrame, nodes: DataFrame, eps: float = C.PROPAGATION_EPSILON) -> DataFrame:
    """`(src, dst, w_out, w_in, w_und)`: both propagation matrices and the normalised undirected one.

    All three share their places: the undirected entry is worth 1 per edge flag plus 1 per loop flag, so it
    needs no aggregation of its own beyond the degrees. `edges` must hold each (src, dst) once.
    """
    wide = propagation_wide(edges, nodes, eps).withColumn("w", (F.col("_edge") + F.col("_loop")).cast("double"))
    deg = wide.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("_d"))
    row = deg.select(F.col("id").alias("src"), (1.0 / F.sqrt("_d")).alias("_r"))
    col = deg.select(F.col("id").alias("dst"), (1.0 / F.sqrt("_d")).alias("_c"))
    return (
        wide.join(row, "src")
        .join(col, "dst")
        .select("src", "dst", "w_out", "w_in", (F.col("_r") * F.col("w") * F.col("_c")).alias("w_und"))
    )


def matrix_add(*matrices: DataFrame) -> DataFrame:
    stacked = reduce(DataFrame.unionByName, [m.select("src", "dst", F.col("w").cast("double")) for m in matrices])
    return stacked.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def undirected_projection(edges: DataFrame) -> DataFrame:
    """One row per unordered pair of a symmetric matrix."""
    return edges.filter(F.col("src") <= F.col("dst"))


def target_clusters(
    n_nodes: DataFrame,
    column: str = "n_nodes",
    per_cluster: int = C.TARGET_NODES_PER_CLUSTER,
    low: int = C.MIN_CLUSTERS,
    high: int = C.MAX_CLUSTERS,
    threshold: int = C.CLUSTER_THRESHOLD_NODES,
) -> DataFrame:
    """Add `n_clusters`: node count over the target size, clamped; null when clustering is not needed."""
    wanted = F.least(F.greatest(F.ceil(F.col(column) / F.lit(per_cluster)), F.lit(low)), F.lit(high))
    return n_nodes.withColumn("n_clusters", F.when(F.col(column) > threshold, wanted).cast("bigint"))


def modularity(edges: DataFrame, assign: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Newman modularity of `(id, cluster)` on a weighted undirected edge list (each edge once)."""
    a = assign.select(F.col("id").alias("src"), F.col("cluster").alias("_cs"))
    b = assign.select(F.col("id").alias("dst"), F.col("cluster").alias("_cd"))
    placed = edges.join(a, "src").join(b, "dst")
    ends = F.array(
        F.struct(
            F.col("_cs").alias("cluster"),
            F.col("w").cast("double").alias("_k"),
            F.when(F.col("_cs") == F.col("_cd"), F.col("w").cast("double")).otherwise(0.0).alias("_in"),
        ),
        F.struct(F.col("_cd").alias("cluster"), F.col("w").cast("double").alias("_k"), F.lit(0.0).alias("_in")),
    )
    per_cluster = (
        placed.select(F.inline(ends))
        .groupBy("cluster")
        .agg(F.sum("_k").alias("_k"), F.sum("_in").alias("_in"))
    )
    m2 = F.sum("_k")
    value = F.sum("_in") * 2.0 / m2 - F.lit(resolution) * F.sum(F.col("_k") * F.col("_k")) / (m2 * m2)
    return per_cluster.agg(F.coalesce(value, F.lit(0.0)).alias("modularity"))


def relabel_dense(assign: DataFrame) -> DataFrame:
    """Add `label`: sorted distinct clusters numbered from 0, and `n_classes`."""
    labels = global_rank(assign.select("cluster").distinct(), ["cluster"], "label")
    n_classes = labels.count()
    return assign.join(labels, "cluster").select(
        *assign.columns, "label", F.lit(n_classes).cast("bigint").alias("n_classes")
    )


def cluster_sizes(assign: DataFrame) -> DataFrame:
    return assign.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_members"), F.min("id").alias("first_member"))


def cluster_members(assign: DataFrame) -> DataFrame:
    """`(cluster, member_no, id)`: members numbered from 0 in id order, one row per member.

    Rows instead of one list per cluster, so a cluster of any size stays distributed.
    """
    return group_rank(assign.select("cluster", "id"), ["cluster"], ["id"], "member_no")


def induced_subgraphs(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Edges inside clusters, relabelled to local ids, original ids kept. Extra columns pass through."""
    local = cluster_members(assign)
    a = local.select(F.col("id").alias("src"), F.col("cluster").alias("_ca"), F.col("member_no").alias("_la"))
    b = local.select(F.col("id").alias("dst"), F.col("cluster").alias("_cb"), F.col("member_no").alias("_lb"))
    extra = [c for c in edges.columns if c not in ("src", "dst")]
    return (
        edges.join(a, "src")
        .join(b, "dst")
        .filter(F.col("_ca") == F.col("_cb"))
        .select(
            F.col("_ca").alias("cluster"),
            F.col("_la").alias("src"),
            F.col("_lb").alias("dst"),
            F.col("src").alias("original_src"),
            F.col("dst").alias("original_dst"),
            *extra,
        )
    )
