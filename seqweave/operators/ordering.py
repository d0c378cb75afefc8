"""Exact ranks and running totals over whole tables without a single-task window.

Three building blocks:

* `global_rank`  - dense position in a total order: one range sort, positions read off per partition.
* `running_totals` - cumulative sums in a total order, optionally restarted per group.
* `seeded_rank`  - position in md5 order: the digest prefix is a ready-made uniform bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.seeded import seeded_hash
from seqweave.session import materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the row-in-partition number in the low 33 bits


def _sorted_once(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-sort `df` and fix every row's (partition, row) place by writing it once."""
    placed = materialise(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_place", _ROW_BITS)).withColumn(
        "_row", F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )


def global_rank(df: DataFrame, order: Sequence[str | Column], out: str = "rank") -> DataFrame:
    """Add the 0-based position in `order` (which must be a total order) as BIGINT."""
    columns = df.columns
    placed = _sorted_once(df, order)
    # one row per sort partition: bounded by spark.sql.shuffle.partitions, hence safe to broadcast
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return placed.join(F.broadcast(starts), "_part").select(
        *columns, (F.col("_start") + F.col("_row")).alias(out)
    )


def group_rank(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: str = "rank") -> DataFrame:
    """0-based position inside each group; one large group is still spread over many tasks."""
    ranked = global_rank(df, [*by, *order], "_global")
    firsts = ranked.groupBy(*by).agg(F.min("_global").alias("_first"))
    return ranked.join(firsts, list(by)).select(
        *df.columns, (F.col("_global") - F.col("_first")).alias(out)
    )


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    totals: dict[str, str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Inclusive cumulative sums `out -> column`, in `order`, restarted per `by` group."""
    columns = df.columns
    placed = _sorted_once(df, [*by, *order])
    keys = [*by, "_part"]
    inside = Window.partitionBy(*keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        *columns, "_part", *[F.sum(c).over(inside).alias(f"_in_{o}") for o, c in totals.items()]
    )
    # one row per (group, sort partition): at most groups + partitions rows
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys)
        .agg(*[F.sum(c).alias(f"_s_{o}") for o, c in totals.items()])
        .select(
            *[F.col(k) for k in keys],
            *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_before_{o}") for o in totals],
        )
    )
    return local.join(starts, keys).select(
        *columns, *[(F.col(f"_before_{o}") + F.col(f"_in_{o}")).alias(o) for o in totals]
    )


def seeded_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    by: Sequence[str] = (),
    out: str = "rank",
    digits: int = 3,
    keep_below: int | None = None,
) -> DataFrame:
    """0-based position in the order of `md5(seed:keys)`, per `by` group.

    The first hex `digits` of the digest are a uniform bucket, so ranking needs bucket sizes (at most
    16^digits rows per group) and a window inside each bucket only. Equal rows are counted before the
    shuffle and expanded afterwards: a block of copies never meets in one task, and since copies are
    indistinguishable they simply take consecutive positions. `keep_below=n` drops whole buckets that
    start at or after n before ranking.
    """
    columns = df.columns
    distinct = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    hashed = distinct.withColumn("_hash", seeded_hash(seed, *keys)).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    bucket = [*by, "_bucket"]
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(*bucket)
        .agg(F.sum("_copies").alias("_size"))
        .select(*bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    if keep_below is not None:
        starts = starts.filter(F.col("_start") < keep_below)
    inside = Window.partitionBy(*bucket).orderBy("_hash", *[c for c in columns if c not in by])
    ranked = hashed.join(starts, bucket).withColumn(
        "_first",
        F.col("_start")
        + F.coalesce(F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    return _expand_copies(ranked, columns, out)


def _expand_copies(ranked: DataFrame, columns: list[str], out: str, block: int = 1 << 16) -> DataFrame:
    """One row per copy with consecutive positions; two generator levels keep every array short."""
    last_block = F.floor((F.col("_copies") - 1) / block).cast("bigint")
    blocks = ranked.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
    low = F.col("_block") * F.lit(block).cast("bigint")
    high = F.least(low + F.lit(block - 1), F.col("_copies") - 1)
    return blocks.withColumn("_copy", F.explode(F.sequence(low, high))).select(
        *columns, (F.col("_first") + F.col("_copy")).cast("bigint").alias(out)
    )
