"""Node features and message passing: forward data flow of graph layers on `(id, vec)` tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave import constants as C
from seqweave.functions import vectors as V
from seqweave.functions.seeded import seeded_normal
from seqweave.operators.vector_agg import aggregate_vectors, lookup_join, vector_dim
from seqweave.session import materialise

Matrix = np.ndarray


def seeded_matrix(rows: int, cols: int, seed: int) -> Matrix:
    """Glorot-uniform weight matrix (rows = output dimensions)."""
    limit = float(np.sqrt(6.0 / (rows + cols)))
    return np.random.default_rng(seed).uniform(-limit, limit, size=(rows, cols))


def random_features(nodes: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """`(id, vec)` of standard normal draws that depend only on seed, id and dimension."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: seeded_normal(seed, "id", d))
    return nodes.select("id", cells.alias("vec"))


def pool_prefix_suffix(vocab: DataFrame, previous: DataFrame, dim: int | None = None) -> DataFrame:
    """`(id, vec)` for n-grams: mean of the (n-1)-gram vectors of prefix and suffix that exist, else zeros.

    `vocab` is `(id, ngram)`, `previous` is `(ngram, vec)`.
    """
    dim = dim if dim is not None else vector_dim(previous)
    n = F.length("ngram")
    keyed = vocab.select(
        "id",
        F.col("ngram").substr(F.lit(1), n - 1).alias("_prefix"),
        F.col("ngram").substr(F.lit(2), n - 1).alias("_suffix"),
    )
    prefix = previous.select(F.col("ngram").alias("_prefix"), V.as_double("vec").alias("_p"))
    suffix = previous.select(F.col("ngram").alias("_suffix"), V.as_double("vec").alias("_s"))
    both = F.zip_with("_p", "_s", lambda a, b: (a + b) / 2.0)
    pooled = F.coalesce(both, F.col("_p"), F.col("_s"), V.zeros(dim))
    return keyed.join(prefix, "_prefix", "left").join(suffix, "_suffix", "left").select("id", pooled.alias("vec"))


def add_positional(x: DataFrame, positions: Matrix, n: int) -> DataFrame:
    """Add position vector i to block i of vectors laid out as n blocks; other widths pass unchanged.

    Positions beyond the table leave their blocks as they are.
    """
    table = np.zeros((n, positions.shape[1]))
    used = min(n, positions.shape[0])
    table[:used] = positions[:used]
    offset = V.vector_literal(table.ravel())
    fits = F.size("vec") == F.lit(table.size)
    return x.withColumn("vec", F.when(fits, V.add("vec", offset)).otherwise(V.as_double("vec")))


def propagate(
    edges: DataFrame, x: DataFrame, nodes: DataFrame | None = None, dim: int | None = None, how: str = "sum"
) -> DataFrame:
    """`(id, vec)` with `y_dst = sum(w * x_src)` (or the mean); a missing weight counts as 1.

    With `nodes`, nodes that receive nothing get a zero vector.
    """
    dim = dim if dim is not None else vector_dim(x)
    weight = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    slim = edges.select("src", "dst", weight.alias("_weight"))
    sent = lookup_join(slim, x.select(F.col("id").alias("src"), "vec"), "src")  # widened in the sums
    received = sent.select(F.col("dst").alias("id"), "vec", "_weight")
    got = aggregate_vectors(received, ["id"], "vec", dim, how, "_weight")
    if nodes is None:
        return got
    return nodes.select("id").join(got, "id", "left").select("id", F.coalesce("vec", V.zeros(dim)).alias("vec"))


@dataclass
class DirectedLayer:
    """Weights of one gated directed layer; matrices have one row per output dimension."""

    w_in: Matrix
    w_out: Matrix
    w_und: Matrix
    w_shared: Matrix
    bias: dict[str, np.ndarray] = field(default_factory=dict)
    w_residual: Matrix | None = None
    bias_residual: np.ndarray | None = None

    @property
    def dim_out(self) -> int:
        return self.w_in.shape[0]

    @property
    def dim_in(self) -> int:
        return self.w_in.shape[1]

    def path(self, name: str) -> tuple[Matrix, np.ndarray]:
        """Main and shared transform act on the same aggregate, so they are added beforehand."""
        own = {"in": self.w_in, "out": self.w_out, "und": self.w_und}[name]
        bias = self.bias.get(name, np.zeros(self.dim_out)) + self.bias.get(f"shared_{name}", np.zeros(self.dim_out))
        return own + self.w_shared, bias

    @classmethod
    def seeded(cls, dim_in: int, dim_out: int, seed: int) -> DirectedLayer:
        w = [seeded_matrix(dim_out, dim_in, seed + i) for i in range(4)]
        residual = seeded_matrix(dim_out, dim_in, seed + 4) if dim_in != dim_out else None
        return cls(*w, w_residual=residual)


PATHS = ("in", "out", "und")
GATES = ("c_in", "c_out", "c_dir", "c_und", "c_all")
_JOINT_WIDTH = 96  # path sums of one node computed side by side up to this many numbers


def _transform_then_gather(matrices: DataFrame, x: DataFrame, layer: DirectedLayer) -> DataFrame:
    """`(id, in, out, und)`: transform once per node and send the narrower vectors over the edges."""
    d = layer.dim_out
    stacked = np.vstack([layer.path(p)[0] for p in PATHS])
    z = x.select(F.col("id").alias("src"), V.linear("vec", stacked).alias("_z"))
    sent = lookup_join(matrices, z, "src")
    if 3 * d <= _JOINT_WIDTH:
        def path_sum(k: int, p: str) -> Column:
            cells = [F.sum(F.col(f"w_{p}") * F.col("_z")[k * d + i]) for i in range(d)]
            return F.array(*cells).alias(p)

        return sent.groupBy(F.col("dst").alias("id")).agg(*[path_sum(k, p) for k, p in enumerate(PATHS)])
    blocks = F.array(
        *[
            F.struct(F.lit(p).alias("path"), F.col(f"w_{p}").alias("w"), F.slice("_z", k * d + 1, d).alias("vec"))
            for k, p in enumerate(PATHS)
        ]
    )
    long = sent.select(F.col("dst").alias("id"), F.inline(blocks))
    return _pivot_paths(aggregate_vectors(long, ["path", "id"], "vec", d, "sum", "w"))


def _gather_then_transform(matrices: DataFrame, x: DataFrame, layer: DirectedLayer) -> DataFrame:
    """`(id, in, out, und)`: sum raw vectors per path and transform the sums."""
    source = x.select(F.col("id").alias("src"), "vec")
    weights = F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"w_{p}").alias("w")) for p in PATHS])
    long = lookup_join(matrices, source, "src").select(F.col("dst").alias("id"), "vec", F.inline(weights))
    summed = _pivot_paths(aggregate_vectors(long, ["path", "id"], "vec", layer.dim_in, "sum", "w"))
    return summed.select("id", *[V.linear(p, layer.path(p)[0]).alias(p) for p in PATHS])


def _pivot_paths(long: DataFrame) -> DataFrame:
    """Three rows per node to one."""
    return long.groupBy("id").agg(*[F.max(F.when(F.col("path") == p, F.col("vec"))).alias(p) for p in PATHS])


def directed_layer(
    matrices: DataFrame, x: DataFrame, layer: DirectedLayer, gates: DataFrame | None = None
) -> DataFrame:
    """One gated layer over the in, out and undirected matrices.

    `matrices` is `(src, dst, w_out, w_in, w_und)` with every node on its diagonal. Per node:
    `c_all (c_und U + c_dir (c_in I + c_out O)) + constant`. Transform and aggregation commute, so the
    narrower of the two widths travels over the edges; all paths share one join and one aggregation.
    `gates` is `(id, c_in, c_out, c_dir, c_und, c_all[, constant])`; without it all gates are 1.
    """
    gather = _transform_then_gather if layer.dim_out <= layer.dim_in else _gather_then_transform
    sums = gather(matrices.select("src", "dst", "w_out", "w_in", "w_und"), x, layer)
    gate = {g: F.lit(1.0) for g in GATES}
    constant = None
    if gates is not None:
        sums = sums.join(gates, "id")
        gate = {g: F.col(g).cast("double") for g in GATES}
        constant = "constant" if "constant" in gates.columns else None
    directed = gate["c_all"] * gate["c_dir"]
    factor = {"in": directed * gate["c_in"], "out": directed * gate["c_out"], "und": gate["c_all"] * gate["c_und"]}

    def gated(p: str) -> Column:
        bias = V.vector_literal(layer.path(p)[1])
        return V.bind(factor[p], lambda g: V.scale(V.add(p, bias), g))

    out = V.add(V.add(gated("in"), gated("out")), gated("und"))
    return sums.select("id", (V.add(out, constant) if constant else out).alias("vec"))


def directed_stack(
    matrices: DataFrame,
    x: DataFrame,
    layers: list[DirectedLayer],
    gates: list[DataFrame | None] | None = None,
) -> DataFrame:
    """Layers with residual connection and leaky ReLU; each layer's result is written once."""
    h = x.select("id", V.as_double("vec").alias("vec"))
    for i, layer in enumerate(layers):
        gate = gates[i] if gates else None
        out = directed_layer(matrices, h, layer, gate).withColumnRenamed("vec", "_out")
        residual = (
            V.linear("vec", layer.w_residual, layer.bias_residual)
            if layer.w_residual is not None
            else V.as_double("vec")
        )
        joined = h.select("id", residual.alias("_res")).join(out, "id")
        h = joined.select("id", V.leaky_relu(V.add("_out", "_res")).alias("vec"))
        if i + 1 < len(layers):
            h = materialise(h)
    return h


def embed_nodes(
    matrices: DataFrame,
    x: DataFrame,
    layers: list[DirectedLayer],
    gates: list[DataFrame | None] | None = None,
    eps: float = C.L2_EPSILON,
) -> DataFrame:
    """Node embeddings: the layer stack followed by L2 normalisation."""
    stacked = directed_stack(matrices, x, layers, gates)
    return stacked.select("id", V.l2_normalize("vec", eps).alias("vec"))


def class_scores(
    x: DataFrame, w1: Matrix, b1: np.ndarray, w2: Matrix, b2: np.ndarray
) -> DataFrame:
    """Log class probabilities of a two-layer head (inference: no dropout)."""
    hidden = x.select("id", V.relu(V.linear("vec", w1, b1)).alias("vec"))
    return hidden.select("id", V.log_softmax(V.linear("vec", w2, b2)).alias("vec"))


def train_node_classifier(
    edges: DataFrame,
    nodes: DataFrame,
    x: DataFrame,
    labels: DataFrame,
    hops: int = 2,
    max_iter: int = 50,
    reg: float = 5e-4,
):
    """Multinomial logistic head on features propagated `hops` times with the normalised graph.

    Returns `(model, predictions)`; `labels` is `(id, label[, split])` and only `train` rows are fitted
    when a split is present.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from seqweave.operators import graph

    norm = materialise(graph.sym_normalize(edges, nodes))
    dim = vector_dim(x)
    h = x
    for _ in range(hops):
        h = materialise(propagate(norm, h, nodes, dim))
    data = materialise(
        h.join(labels, "id").withColumn("features", array_to_vector("vec")).withColumn("label", F.col("label").cast("double"))
    )
    train = data.filter(F.col("split") == "train") if "split" in labels.columns else data
    model = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg).fit(train)
    scored = model.transform(data).withColumn("proba", vector_to_array("probability"))
    keep = [c for c in ("id", "label", "split") if c in scored.columns]
    return model, scored.select(*keep, "prediction", "proba")
