"""Skip-gram vectors with negative sampling, trained on counted contexts.

The loss depends on the sequences only through how often two tokens stand at a distance within the window. Spark counts
these pairs in one scan, and the expected loss (over window shrinking and negative draws) is minimised on the counts, so
the result depends neither on the partitions nor on the order of the rows. The counts have at most a row per two
different tokens, and the fit grows with the alphabet, not with the sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.operators.fold_models import _Search

NEGATIVE, NEGATIVE_POWER = 5, 0.75
EPOCH_STEPS = 100  # steps of the search that stand for a pass over the sequences
_PIECE = 1 << 20  # characters looked at together
_DENSE = 1 << 20  # pairs of an alphabet up to which a task counts into one array
_HELD = 1 << 20  # different pairs of a larger alphabet that a task holds before it passes them on
_CELLS = 1 << 22  # cells of the token-by-token matrix computed together


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Code points of several sequences at a time."""
    held, size = [], 0
    for batch in batches:
        for value in batch.column(0).cast(pa.binary()):
            codes = np.frombuffer(value.as_py().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            held.append(codes)
            size += len(codes)
            if size >= _PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0x110000, np.int64)
    for piece in _pieces(batches):
        total += np.bincount(np.concatenate(piece), minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, inverse, np.concatenate(counts))
    return distinct, total


def _count_pairs(codes: np.ndarray, window: int):
    """(pair, n): tokens a before b, as `a * size + b`; a distance d counts `window - d + 1` times."""
    size = len(codes)
    place = np.full(int(codes.max(initial=0)) + 2, -1, np.int64)
    place[codes] = np.arange(size)

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(size * size, np.int64) if size * size <= _DENSE else None
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for piece in _pieces(batches):
            kept = [k[k >= 0] for k in (place[np.minimum(codes_, len(place) - 1)] for codes_ in piece)]
            tokens = np.concatenate(kept)
            owner = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
            for start in range(0, len(tokens), _PIECE):
                for d in range(1, window + 1):
                    b = slice(start + d, start + d + _PIECE)
                    a = slice(start, start + len(tokens[b]))
                    pairs = (tokens[a] * size + tokens[b])[owner[a] == owner[b]]
                    if dense is not None:
                        dense += (window - d + 1) * np.bincount(pairs, minlength=len(dense))
                    else:
                        distinct, n = np.unique(pairs, return_counts=True)
                        keys.append(distinct)
                        counts.append((window - d + 1) * n)
                if sum(map(len, keys)) > _HELD:
                    yield rows(*_summed(keys, counts))
                    keys, counts = [], []
        if dense is not None:
            seen = np.flatnonzero(dense)
            yield rows(seen, dense[seen])
        elif keys:
            yield rows(*_summed(keys, counts))

    return run


def token_counts(seqs: DataFrame, seq: str | Column = "seq") -> DataFrame:
    """`(code, n)`: how often every character occurs, by its code point."""
    texts = seqs.select(F.col(seq).alias("_s") if isinstance(seq, str) else seq.alias("_s")).filter(F.length("_s") > 0)
    return texts.mapInArrow(_count_tokens, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def context_counts(seqs: DataFrame, codes: np.ndarray, window: int, seq: str = "seq") -> DataFrame:
    """`(pair, n)` of the tokens with the (ascending) `codes`; other characters are left out before contexts are formed."""
    texts = seqs.select(F.col(seq).alias("_s")).filter(F.length("_s") > 0)
    return texts.mapInArrow(_count_pairs(codes, window), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _loss_and_gradient(theta: np.ndarray, size: int, dim: int, a: np.ndarray, b: np.ndarray, seen: np.ndarray, missed: np.ndarray, noise: np.ndarray):
    """Expected loss per context: what was seen at `(a, b)` against `missed` draws per token from `noise`."""
    v, u = theta.reshape(2, size, dim)
    grad = np.zeros((2, size, dim))
    loss = 0.0
    step = max(1, _CELLS // size)
    for start in range(0, size, step):
        part = slice(start, start + step)
        z = v[part] @ u.T
        away = missed[part, None] * noise
        both = away.copy()
        lo, hi = np.searchsorted(a, [start, start + step])
        at = (a[lo:hi] - start, b[lo:hi])
        loss += float((away * np.logaddexp(0.0, z)).sum() + (seen[lo:hi] * np.logaddexp(0.0, -z[at])).sum())
        both[at] += seen[lo:hi]
        slope = both * (0.5 * (1.0 + np.tanh(0.5 * z)))
        slope[at] -= seen[lo:hi]
        grad[0, part] = slope @ u
        grad[1] += slope.T @ v[part]
    return loss, grad.ravel()


def fit_contexts(n: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, dim: int, steps: int, seed: int) -> np.ndarray:
    """Token vectors from token counts `n` and the counts of ordered pairs, given by ascending `(a, b)`, each once."""
    size = len(n)
    draws = np.random.default_rng(seed).uniform(-0.5, 0.5, (size, dim)) / dim
    theta = np.concatenate([draws.ravel(), np.zeros(size * dim)])
    if not len(weight):
        return draws
    seen = weight / weight.sum()
    missed = NEGATIVE * np.bincount(a, seen, size)
    noise = n**NEGATIVE_POWER / (n**NEGATIVE_POWER).sum()
    search = _Search(theta, steps, 1e-8)
    while not search.done:
        search.tell(*_loss_and_gradient(search.trial, size, dim, a, b, seen, missed, noise))
    return search.x[: size * dim].reshape(size, dim)


def train_tokens(seqs: DataFrame, dim: int, window: int, min_count: int, epochs: int, seed: int, seq: str) -> DataFrame:
    """`(token, vec)` of the characters that occur `min_count` times."""
    spark = seqs.sparkSession
    found = token_counts(seqs, seq).filter(F.col("n") >= min_count).orderBy("code").collect()  # one row a character
    codes, n = (np.array([r[c] for r in found], np.int64) for c in ("code", "n"))
    size = len(codes)
    kind = "token string, vec array<float>"
    if not size:
        return spark.createDataFrame([], kind)
    counted = context_counts(seqs, codes, window, seq)
    both = F.array(F.struct("pair", "n"), F.struct((F.col("pair") % size * size + F.floor(F.col("pair") / size)).alias("pair"), "n"))
    pairs = counted.select(F.inline(both)).groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    pair, weight = (pairs.column(c).to_numpy().astype(np.int64) for c in ("pair", "n"))
    vectors = fit_contexts(n.astype(float), pair // size, pair % size, weight.astype(float), dim, EPOCH_STEPS * epochs, seed)
    return spark.createDataFrame([(chr(c), v) for c, v in zip(codes.tolist(), vectors.astype(np.float32).tolist())], kind)
