"""Sums, means and maxima of vectors per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions.vectors import as_double

# One aggregate per dimension keeps the shuffle at one compact row per key and map task; wider vectors
# are cut into slices of this many dimensions so that generated code stays within JVM method limits.
SLICE = 64

BROADCAST_BYTES = 1 << 27  # tables up to this size are repeated on every executor instead of moving the rows they are joined to


def vector_dim(df: DataFrame, vec: str = "vec") -> int:
    """Width of the non-empty vectors, 0 if there are none; vectors of several widths are an error."""
    least, most = df.filter(F.size(vec) > 0).agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if least != most:
        raise ValueError(f"vectors have widths from {least} to {most}; name the width that is meant")
    return int(most or 0)


def repeated_if_small(lookup: DataFrame, width: int = 0) -> DataFrame:
    """`lookup`, marked for a broadcast join if its rows of up to `width` numbers in an array take no more than `BROADCAST_BYTES`.

    A row that meets vectors in a shuffled join takes them along to the next one; beyond the bound that is the way.
    """
    most = BROADCAST_BYTES // (64 + 8 * width)
    return F.broadcast(lookup) if lookup.select(F.lit(1)).limit(most + 1).count() <= most else lookup


def _reduce(how: str, value: Column) -> Column:
    return {"sum": F.sum, "mean": F.avg, "max": F.max}[how](value)


def aggregate_vectors(
    df: DataFrame,
    keys: Sequence[str],
    vec: str = "vec",
    dim: int | None = None,
    how: str = "sum",
    weight: str | Column | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Elementwise `sum` / `mean` / `max` of `weight * vec` per key, plus optional scalar aggregates."""
    dim = dim if dim is not None else vector_dim(df, vec)
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    x = as_double(vec)
    extra = extra or {}
    scalars = [c.alias(name) for name, c in extra.items()]
    if dim <= SLICE:
        cells = [_reduce(how, x[i] * w if weight is not None else x[i]) for i in range(dim)]
        merged = F.array(*cells) if cells else F.array().cast("array<double>")
        return df.groupBy(*keys).agg(merged.alias(vec), *scalars)
    n_slices = -(-dim // SLICE)
    sliced = df.withColumn("_w", w).select(
        *[c for c in df.columns if c != vec],
        "_w",
        F.posexplode(F.array(*[F.slice(x, i * SLICE + 1, SLICE) for i in range(n_slices)])).alias("_s", "_v"),
    )
    cells = [_reduce(how, F.get(F.col("_v"), F.lit(i)) * F.col("_w")) for i in range(SLICE)]
    parts = sliced.groupBy(*keys, "_s").agg(F.array(*cells).alias("_v"), *scalars)
    # n_slices rows per key, a number fixed by the vector width
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_v"))), lambda s: s["_v"]))
    return parts.groupBy(*keys).agg(
        F.slice(whole, 1, dim).alias(vec), *[F.first(name).alias(name) for name in extra]
    )


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Many-to-one join. `lookup` has one row per key.

    Hot keys on the `rows` side are split at run time by AQE. Where AQE is off, `salts` (or the session
    setting `seqweave.join.salts`) deals every key out over that many partitions and repeats the lookup.
    """
    if salts is None:
        salts = int(rows.sparkSession.conf.get("seqweave.join.salts", "1"))
    if salts <= 1:
        return rows.join(lookup, key, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
