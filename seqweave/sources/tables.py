"""Parquet and CSV tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.operators import graph
from seqweave.operators.splits import random_split

EDGE_SCHEMA = "src bigint, dst bigint"
WEIGHTED_EDGE_SCHEMA = "src bigint, dst bigint, w bigint"
ID_MAP_SCHEMA = "original string, mapped string"


# --- embeddings -------------------------------------------------------------


def storable_embeddings(emb: DataFrame) -> DataFrame:
    """Rows worth storing: vector present and not empty; `/` in a key becomes `_`."""
    return emb.filter(F.col("vec").isNotNull() & (F.size("vec") > 0)).withColumn("key", F.translate("key", "/", "_"))


def write_embeddings(emb: DataFrame, path: str, mode: str = "overwrite") -> None:
    storable_embeddings(emb).write.mode(mode).parquet(path)


def read_embeddings(spark: SparkSession, path: str, keys: DataFrame | list[str] | None = None) -> DataFrame:
    """Embedding table, optionally only some keys.

    A list becomes an `IN` filter that reaches the Parquet scan; a table of ids becomes a semi-join.
    """
    emb = spark.read.parquet(path)
    if keys is None:
        return emb
    if isinstance(keys, DataFrame):
        return emb.join(keys.select(F.col(keys.columns[0]).alias("key")), "key", "left_semi")
    return emb.filter(F.col("key").isin(list(keys)))


def write_node_embeddings(emb: DataFrame, path: str, model: str, dataset: str, variant: str = "") -> None:
    """Node vectors with their origin as columns, one folder per (dataset, model)."""
    tagged = emb.select(
        "*", F.size("vec").alias("dim"), F.lit(variant).alias("variant"), F.lit(dataset).alias("dataset"), F.lit(model).alias("model")
    )
    tagged.write.mode("append").partitionBy("dataset", "model").parquet(path)


# --- vocabulary, edges, graphs ----------------------------------------------


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select("id", "ngram").write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    return spark.read.parquet(path).select(*(columns or ["id", "ngram"]))


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst", "w").write.mode("overwrite").parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("src", "dst", "w")


def read_transition_text(spark: SparkSession, path: str) -> DataFrame:
    """Raw `src dst` lines, malformed ones skipped, counted to weighted edges."""
    rows = spark.read.schema(EDGE_SCHEMA).option("sep", " ").option("mode", "DROPMALFORMED").csv(path)
    return rows.dropna().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Snapshot of a levelled graph: `nodes/` and `edges/`, one folder per level n.

    Derived matrices are not stored; they are recomputed from the edges.
    """
    nodes.write.mode("overwrite").partitionBy("n").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("n").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; asking for one level reads only its folder."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if n is not None:
        nodes, edges = nodes.filter(F.col("n") == n), edges.filter(F.col("n") == n)
    return nodes, edges


def load_graph_table(
    nodes: DataFrame, edges: DataFrame, make_undirected: bool = False, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Benchmark graph from tables: nodes `(id, x, y, split)` and edges `(src, dst)`.

    Missing features become empty vectors, missing labels null; a split already present is kept, otherwise
    a seeded one is drawn.
    """
    if "x" not in nodes.columns:
        nodes = nodes.withColumn("x", F.array().cast("array<double>"))
    if "y" not in nodes.columns:
        nodes = nodes.withColumn("y", F.lit(None).cast("bigint"))
    split = nodes if "split" in nodes.columns else nodes.join(random_split(nodes.select("id"), seed), "id")
    filled = split.withColumn("x", F.coalesce("x", F.array().cast("array<double>")))
    pairs = graph.to_undirected(edges) if make_undirected else edges.select("src", "dst")
    return filled.select("id", "x", "y", "split"), pairs


# --- small text tables ------------------------------------------------------


def write_id_map(idmap: DataFrame, path: str) -> None:
    idmap.select("original", "mapped").write.mode("overwrite").option("sep", "\t").csv(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ID_MAP_SCHEMA).option("sep", "\t").csv(path)


def write_results_csv(results: DataFrame, path: str) -> None:
    """A report table (one row per model and dataset) as a single CSV file with header."""
    results.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def read_results_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def log_run_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    """Append numeric results of a run; NaN and nulls are left out."""
    numeric = metrics.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    numeric.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)
