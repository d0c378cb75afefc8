"""The two vectors of every pair, without moving pairs together with vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, FloatType, IntegerType, StructField, StructType
from pyspark.storagelevel import StorageLevel

from seqweave.operators.vector_agg import lookup_join, repeated_if_small
from seqweave.session import materialise

BLOCK_BYTES = 1 << 26  # vectors of one block; a task holds two blocks
LEAST_PAIRS = 1 << 17  # pairs of a part of a cell, where its vectors do not outweigh more of them
MOST_BLOCKS = 64  # beyond it copies of vectors would weigh more than vectors that travel with pairs


def dot_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot product per row, added up from the first number to the last as `functions.vectors.dot` does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def pair_values(
    pairs: DataFrame, emb: DataFrame, dim: int, name: str, kind: DataType, column: Callable[[Column, Column], Column], rows: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: bool = False
) -> DataFrame:
    """`pairs` with a value `name` (of type `kind`) of the two vectors; pairs with an unknown end are dropped.

    `emb` is `(key, vec)` with one row per key. `column` makes the value of two vector columns, `rows` the same of two
    matrices of doubles with a row per pair. Few vectors are repeated on every executor. More are dealt out in blocks:
    a cell is a pair of blocks and reads its vectors once, then its pairs batch by batch, so a pair is shuffled by its
    ends only and a vector twice per block. Where that makes too many copies, or all fits one block, pairs are shuffled
    with their vectors, as they are where a vector lacks numbers.

    With `keep` the result is read many times: the cells stay on disk, with the pairs' places among their vectors, and
    the values are made anew whenever they are read. Where there are no cells the values are written.
    """
    known = emb.select("key", "vec")
    lookup = known if keep else repeated_if_small(known, dim)
    if lookup is known:
        whole = (F.size("vec") == dim) & ~F.exists("vec", lambda v: v.isNull())
        n, n_whole, n_keys = known.agg(F.count(F.lit(1)), F.count_if(whole), F.count_distinct("key")).first()
        blocks = -(-n * (64 + 8 * dim) // BLOCK_BYTES)
        if n == n_whole and blocks <= MOST_BLOCKS and (n == n_keys > 0 if keep else blocks > 1):
            if keep:
                known, pairs = materialise(known), pairs if hasattr(pairs, "_scratch") else materialise(pairs)
                parts = -(-pairs.count() // (blocks * blocks * max(LEAST_PAIRS, n * dim // (4 * blocks)))) or 1
                return _by_cells(pairs, known, blocks, dim, name, kind, rows, parts, True)
            return _by_cells(pairs, known, blocks, dim, name, kind, rows)
        lookup = repeated_if_small(known, dim) if keep else lookup
    left = lookup.select(F.col("key").alias("p1"), F.col("vec").alias("_a"))
    right = lookup.select(F.col("key").alias("p2"), F.col("vec").alias("_b"))
    joined = lookup_join(lookup_join(pairs, left, "p1"), right, "p2")
    found = joined.select(*pairs.columns, column(F.col("_a"), F.col("_b")).alias(name))
    return materialise(found) if keep else found


def _by_cells(
    pairs: DataFrame, emb: DataFrame, blocks: int, dim: int, name: str, kind: DataType, rows: Callable[[np.ndarray, np.ndarray], np.ndarray], parts: int = 1, keep: bool = False
) -> DataFrame:
    """The pairs of two blocks are a cell, or `parts` of them, each with its own copy of the vectors."""
    columns = pairs.columns
    schema = StructType([*pairs.schema.fields, StructField(name, kind)])

    def block(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(blocks))

    def numbers(count: int) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))

    own, part = block("key"), F.pmod(F.xxhash64(F.lit(parts), "p1", "p2"), F.lit(parts))
    across = F.transform(numbers(blocks * parts), lambda j: own * (blocks * parts) + j)
    down = F.flatten(F.transform(F.filter(numbers(blocks), lambda i: i != own), lambda i: F.transform(numbers(parts), lambda p: (i * blocks + own) * parts + p)))
    held = emb.filter("key is not null").select(F.explode(F.concat(across, down)).alias("_cell"), F.lit(False).alias("_pair"), F.col("key").alias("_key"), F.col("vec").alias("_vec"))
    asked = pairs.filter("p1 is not null and p2 is not null").select(((block("p1") * blocks + block("p2")) * parts + part).alias("_cell"), F.lit(True).alias("_pair"), *columns)
    both = held.unionByName(asked, allowMissingColumns=True)
    dealt = both.repartitionByRange(blocks * blocks * parts, "_cell") if keep else both.repartition("_cell")
    dealt = dealt.sortWithinPartitions("_cell", "_pair")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
        """Rows of one cell and kind."""
        for batch in batches:
            cells = batch.column("_cell").to_numpy()
            asks = batch.column("_pair").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(cells * 2 + asks)) + 1).tolist(), len(cells)]
            for start, end in zip(cuts, cuts[1:]):
                if start < end:
                    yield int(cells[start]), bool(asks[start]), batch.slice(start, end - start)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The numbers of many vectors as a row without their keys, and of the pairs those that have both, with the places of these in the cell."""
        cell, keys, places = None, [], None
        for at, asks, part in runs(batches):
            if at != cell:
                cell, keys, places = at, [], None
            if not asks:
                keys.append(part.column("_key"))
                flat = part.column("_vec").flatten().to_numpy(zero_copy_only=False).astype(number)
                first = [part.slice(0, 1).column(c) for c in kept]
                none = pa.nulls(1, pa.int32())
                yield pa.RecordBatch.from_arrays([*first, pa.array([flat.tobytes()], pa.binary()), none, none], names=placed)
                continue
            if not keys:
                continue
            if places is None:
                places = pd.Index(pa.concat_arrays(keys).to_pandas())
            a, b = (places.get_indexer(part.column(c).to_pandas()) for c in ("p1", "p2"))
            met = np.flatnonzero((a >= 0) & (b >= 0))
            rest = part.select(kept).take(pa.array(met))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.nulls(len(met), pa.binary()), pa.array(a[met].astype("int32")), pa.array(b[met].astype("int32"))], names=placed)

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, vecs, matrix = None, [], None
        for at, asks, part in runs(batches):
            if at != cell:
                cell, vecs, matrix = at, [], None
            if not asks:
                vecs += part.column("_vec").to_pylist()
                continue
            if matrix is None:
                matrix = np.frombuffer(b"".join(vecs), number).reshape(-1, dim)
                vecs = []
            a, b = part.column("_a").to_numpy(), part.column("_b").to_numpy()
            value = rows(matrix[a].astype("float64"), matrix[b].astype("float64"))
            if value.ndim == 2:
                ends = np.arange(len(a) + 1, dtype="int32") * value.shape[1]
                value = pa.ListArray.from_arrays(pa.array(ends), pa.array(value.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(value) if isinstance(value, np.ndarray) else value], names=[*columns, name])

    number = "float32" if emb.schema["vec"].dataType.elementType == FloatType() else "float64"
    kept = [c for c in dealt.columns if c not in ("_key", "_vec")]
    placed = [*kept, "_vec", "_a", "_b"]
    if not keep:
        return dealt.mapInArrow(lambda batches: attach(place(batches)), schema)
    fields = [dealt.schema[c] for c in kept] + [StructField("_vec", BinaryType()), StructField("_a", IntegerType()), StructField("_b", IntegerType())]
    stay = dealt.mapInArrow(place, StructType([StructField(f.name, f.dataType) for f in fields])).persist(StorageLevel.DISK_ONLY)
    made = stay.mapInArrow(attach, schema)
    made._made = (stay, attach)
    return made
