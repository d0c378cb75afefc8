"""Point tables for two-dimensional views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.vectors import as_double
from seqweave.operators.reduction import pca
from seqweave.operators.splits import sample_exact


def flatten_labelled_sets(sets: DataFrame, key: str = "key") -> DataFrame:
    """`(key, row, vec)`: every vector of every keyed set, a plain vector counting as a set of one."""
    nested = dict(sets.dtypes)["vec"].startswith("array<array")
    if nested:
        return sets.select(key, F.posexplode("vec").alias("row", "vec"))
    return sets.select(key, F.lit(0).alias("row"), "vec")


def projection_sample(points: DataFrame, n: int, keys: tuple[str, ...] = ("key", "row"), seed: int = 42) -> DataFrame:
    """Seeded sample of n points (all if there are fewer), drawn on the keys before any vector moves.

    Of points that share their keys as many stay as the draw has taken of them.
    """
    names = list(keys)
    chosen = sample_exact(points.select(*keys), n, names, seed).groupBy(*keys).agg(F.count(F.lit(1)).alias("_drawn"))
    kept = points.join(chosen, names, "left_semi")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*[c for c in points.columns])))
    return kept.withColumn("_copy", rank).join(chosen, names).filter("_copy <= _drawn").select(*points.columns)


def project_2d(emb: DataFrame, key: str = "key") -> DataFrame:
    """`(key, x, y)`: two principal components per key."""
    flat = emb.select(key, as_double("vec").alias("vec"))
    result = pca(flat, 2, key)
    if result is None:
        return flat.sparkSession.createDataFrame([], f"{key} {dict(emb.dtypes)[key]}, x double, y double")
    v = F.col("vec")
    return result.vectors.select(key, F.get(v, F.lit(0)).alias("x"), F.coalesce(F.get(v, F.lit(1)), F.lit(0.0)).alias("y"))
