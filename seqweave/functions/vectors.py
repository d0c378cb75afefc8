"""Elementwise vector expressions on `ARRAY<DOUBLE>` / `ARRAY<FLOAT>` columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqweave import constants as C

# Above this many multiply-adds per row a dense transform runs as a matrix product on Arrow batches.
EXPRESSION_LIMIT = 1024


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(vec: str | Column) -> Column:
    return _col(vec).cast("array<double>")


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def bind(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body`.

    Inside a lambda an outer expression would be evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


def total(vec: str | Column) -> Column:
    return F.aggregate(as_double(vec), F.lit(0.0), lambda acc, v: acc + v)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def add(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def scale(vec: str | Column, factor: Column | float) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(as_double(vec), lambda v: v * factor)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def l2_normalize(vec: str | Column, eps: float = C.L2_EPSILON) -> Column:
    """`v / (|v| + eps)`."""
    norm = F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda acc, v: acc + v * v)) + F.lit(eps)
    return bind(norm, lambda n: F.transform(as_double(vec), lambda v: v / n))


def log_softmax(vec: str | Column) -> Column:
    """`v - max - log(sum(exp(v - max)))`."""
    x = as_double(vec)

    def shifted(peak: Column) -> Column:
        norm = F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - peak)))
        return bind(peak + norm, lambda shift: F.transform(x, lambda v: v - shift))

    return bind(F.array_max(x), shifted)


def relu(vec: str | Column) -> Column:
    return F.transform(as_double(vec), lambda v: F.greatest(v, F.lit(0.0)))


def leaky_relu(vec: str | Column, slope: float = C.LEAKY_SLOPE) -> Column:
    return F.transform(as_double(vec), lambda v: F.when(v > 0, v).otherwise(v * F.lit(slope)))


def elu(vec: str | Column) -> Column:
    return F.transform(as_double(vec), lambda v: F.when(v > 0, v).otherwise(F.exp(v) - 1.0))


def argmax(vec: str | Column) -> Column:
    """0-based index of the first largest entry."""
    return (F.array_position(_col(vec), F.array_max(_col(vec))) - 1).cast("int")


def linear(vec: str | Column, weight: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """Dense transform `W x + b`; `weight` has one row per output dimension.

    Small matrices are a constant array inside a JVM expression; larger ones run as one matrix product per
    Arrow batch. The matrix is a model parameter (its size does not depend on the data).
    """
    w = np.asarray(weight, dtype=np.float64)
    b = np.zeros(w.shape[0]) if bias is None else np.asarray(bias, dtype=np.float64)
    if w.size <= EXPRESSION_LIMIT:
        rows = F.array(*[vector_literal(row) for row in w])
        offsets = vector_literal(b)
        return bind(
            as_double(vec),
            lambda x: F.when(
                x.isNotNull(), F.transform(rows, lambda row, j: F.get(offsets, j) + dot(row, x))
            ),
        )

    @F.pandas_udf("array<double>")
    def dense(batch: pd.Series) -> pd.Series:
        present = batch.notna().to_numpy()
        if not present.any():
            return pd.Series([None] * len(batch), dtype=object)
        result = iter(np.stack(batch[present].to_numpy()).astype(np.float64) @ w.T + b)
        return pd.Series([next(result) if p else None for p in present])

    return dense(as_double(vec))
