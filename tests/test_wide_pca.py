"""Components of wide vectors against the Gram path and plain NumPy; exact signed ranks of many differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (functions travel by value)
from seqweave.operators import evaluation, reduction, wide_pca


def vectors(spark, x):
    return spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "key string, vec array<double>").repartition(4)


def test_wide_path_equals_the_gram_path(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6)) @ rng.normal(size=(6, 40)) + 0.3 * rng.normal(size=(150, 40))
    x[:, 7] = 2.5  # a constant dimension
    df = vectors(spark, x)
    a, b = reduction.pca(df, 5), reduction.pca(df, 5, wide=10)
    assert b.explained == pytest.approx(a.explained, abs=1e-9) and np.allclose(a.components, b.components, atol=1e-6)
    one, two = ({r.key: r.vec for r in p.vectors.collect()} for p in (a, b))
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-6) for k in one)
    c, d = reduction.global_pca(df, 3), reduction.global_pca(df, 3, wide=10)
    assert d.explained == pytest.approx(c.explained, abs=1e-9) and np.allclose(c.components, d.components, atol=1e-6)


def test_flat_spectrum_and_few_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 120))
    stats = reduction.fit_stats(vectors(spark, x))
    found, values = wide_pca.leading_components(vectors(spark, x), stats.mean, stats.std, 30, 6, extra=4, blocks=3)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.allclose(values, np.linalg.eigvalsh(np.cov(z.T))[::-1][:6], rtol=1e-6)
    assert np.allclose(found.T @ found, np.eye(6), atol=1e-8)
    few, more = wide_pca.leading_components(vectors(spark, x[:3]), x[:3].mean(axis=0), np.ones(120), 3, 3)
    assert more[2] == pytest.approx(0.0, abs=1e-9) and few.shape == (120, 3)


def test_exact_signed_ranks_of_many_differences(spark):
    """The exact and the approximate p-value agree; shares of the sign patterns are added, which cannot overflow."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v), 0.0) for v in rng.normal(0.03, 1.0, 250)], "a double, b double")
    exact, normal = (evaluation.wilcoxon_signed_rank(df, method=m).first() for m in ("exact", "normal"))
    assert exact.w == normal.w and 0 < exact.p_value < 1 and exact.p_value == pytest.approx(normal.p_value, abs=5e-3)


def test_wide_vectors_are_made_once(spark):
    """Whatever makes the vectors runs for their width and for the table, not once a product."""
    made = spark.sparkContext.accumulator(0)

    def vector(i):
        made.add(1)
        return [float((i * j) % 7) for j in range(1, 7)]

    rows = spark.createDataFrame([(str(i), i) for i in range(50)], "key string, i int")
    vectors = rows.select("key", F.udf(vector, "array<double>").asNondeterministic()("i").alias("vec"))
    assert reduction.pca(vectors, 2, wide=4).vectors.count() == 50
    assert made.value <= 150
