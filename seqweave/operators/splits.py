"""Seeded sampling, shuffles, folds and splits. All draws are exact and independent of partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave import constants as C
from seqweave.functions.seeded import seeded_hash
from seqweave.operators.ordering import seeded_rank


def stratified_kfold(
    df: DataFrame, k: int = C.N_FOLDS, seed: int = 42, keys: Sequence[str] = ("p1", "p2"), label: str = "label"
) -> DataFrame:
    """Add `fold` in 0..k-1; inside every label the fold sizes differ by at most one."""
    ranked = seeded_rank(df, keys, seed, by=[label], out="_rank")
    return ranked.select(*df.columns, (F.col("_rank") % k).cast("int").alias("fold"))


def stratified_split(
    df: DataFrame,
    test_fraction: float = C.HOLDOUT_FRACTION,
    seed: int = 42,
    keys: Sequence[str] = ("p1", "p2"),
    label: str = "label",
) -> DataFrame:
    """Add `split` (train/test) with `ceil(test_fraction * n)` test rows per label."""
    ranked = seeded_rank(df, keys, seed, by=[label], out="_rank")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.ceil(F.col("_n") * F.lit(float(test_fraction)))
    return ranked.join(sizes, label).select(
        *df.columns, F.when(F.col("_rank") < cut, "test").otherwise("train").alias("split")
    )


def random_split(
    df: DataFrame, seed: int = 42, keys: Sequence[str] = ("id",), ratios: dict[str, float] | None = None
) -> DataFrame:
    """Add `split` (train/val/test) with `int(r * N)` train and val rows, the rest test.

    A table that already has a `split` column is returned as it is.
    """
    if "split" in df.columns:
        return df
    ratios = ratios or C.SPLIT_RATIOS
    ranked = seeded_rank(df, keys, seed, out="_rank")
    n = df.count()
    n_train, n_val = int(ratios["train"] * n), int(ratios["val"] * n)
    return ranked.select(
        *df.columns,
        F.when(F.col("_rank") < n_train, "train")
        .when(F.col("_rank") < n_train + n_val, "val")
        .otherwise("test")
        .alias("split"),
    )


def sample_exact(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows without replacement (all rows when there are no more than n).

    Only digest buckets that can hold a winner are ranked; nothing is gathered in one task.
    """
    ranked = seeded_rank(df, keys, seed, out="_rank", keep_below=n)
    return ranked.filter(F.col("_rank") < n).select(*df.columns)


def balance_negatives(
    pairs: DataFrame,
    cap: int | None = None,
    seed: int = 42,
    keys: Sequence[str] = ("p1", "p2"),
    label: str = "label",
) -> DataFrame:
    """All positives plus a negative sample of `cap` rows, or as many as there are positives."""
    positives = pairs.filter(F.col(label) == 1)
    negatives = pairs.filter(F.col(label) == 0)
    if cap is None:
        cap = positives.count()
    return positives.unionByName(sample_exact(negatives, cap, keys, seed))


def shuffle(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in seeded random order (a distributed range sort on the digest)."""
    return df.orderBy(seeded_hash(seed, *keys), *keys)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """`total / (2 n_c)` per class; no rows when one of the two classes is missing."""
    both = F.when((F.col("_neg") > 0) & (F.col("_pos") > 0), F.col("_neg") + F.col("_pos"))
    counts = df.agg(
        F.coalesce(F.count_if(F.col(label) == 0), F.lit(0)).alias("_neg"),
        F.coalesce(F.count_if(F.col(label) == 1), F.lit(0)).alias("_pos"),
    )
    return (
        counts.filter(both.isNotNull())
        .select(
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("label"), (both / (F.lit(2.0) * F.col("_neg"))).alias("weight")),
                    F.struct(F.lit(1).alias("label"), (both / (F.lit(2.0) * F.col("_pos"))).alias("weight")),
                )
            ).alias("c")
        )
        .select("c.label", "c.weight")
    )


def class_distribution(folds: DataFrame, k: int = C.N_FOLDS, label: str = "label") -> DataFrame:
    """Rows per (fold, side, label): a row is validation in its own fold and training in all others."""
    own = folds.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n"))
    # (k * classes) rows from here on
    sided = own.select(
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_f"), F.col("fold").alias("_own"), label, "n"
    )
    side = F.when(F.col("_f") == F.col("_own"), "val").otherwise("train")
    return sided.groupBy(F.col("_f").alias("fold"), side.alias("side"), label).agg(F.sum("n").alias("n"))
