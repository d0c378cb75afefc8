from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqweave.operators import pooling
from seqweave.operators import token_training as T

TEXTS = ["abcabca", "", "a", "zab\U0001f600b", "cab" * 9]


def _plain(texts, codes, window):
    out = Counter()
    for text in texts:
        kept = [codes.index(ord(c)) for c in text if ord(c) in codes]
        for i, a in enumerate(kept):
            for d in range(1, window + 1):
                if i + d < len(kept):
                    out[a * len(codes) + kept[i + d]] += window - d + 1
    return out


@pytest.mark.parametrize("dense", [1 << 20, 0])
@pytest.mark.parametrize("piece", [1 << 20, 3])
def test_contexts_are_counted_whole(monkeypatch, dense, piece):
    monkeypatch.setattr(T, "_DENSE", dense)
    monkeypatch.setattr(T, "_PIECE", piece)
    monkeypatch.setattr(T, "_HELD", 4)
    codes = sorted(ord(c) for c in "abc\U0001f600")
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["_s"])
    got = Counter()
    for part in T._count_pairs(np.array(codes), 3)(iter([batch])):
        for pair, n in zip(*(c.to_pylist() for c in part.columns)):
            got[pair] += n
    assert got == _plain(TEXTS, codes, 3)


def test_token_vectors_do_not_depend_on_partitions(spark):
    seqs = spark.createDataFrame([(t,) for t in TEXTS * 5], "seq string")
    one, many = (
        {r.token: r.vec for r in pooling.train_token_embeddings(seqs.repartition(p), dim=4, epochs=1).collect()} for p in (1, 7)
    )
    assert one == many and set(one) == set("".join(TEXTS))
    rare = pooling.train_token_embeddings(seqs, dim=4, epochs=1, min_count=6).collect()
    assert {r.token for r in rare} == set("abc")


def test_gradient_of_the_expected_loss():
    rng = np.random.default_rng(1)
    size, dim = 5, 3
    a, b = np.divmod(np.array([1, 3, 7, 12, 24]), size)
    seen = rng.random(5)
    missed, noise = rng.random(size), rng.random(size)
    theta = rng.normal(size=2 * size * dim)
    args = (size, dim, a, b, seen, missed, noise)
    _, grad = T._loss_and_gradient(theta, *args)
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        slope = (T._loss_and_gradient(theta + step, *args)[0] - T._loss_and_gradient(theta - step, *args)[0]) / 2e-6
        assert slope == pytest.approx(grad[i], abs=1e-6)
