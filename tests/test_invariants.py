"""Properties of iterative and fitted operators."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.operators import community, convs, evaluation, features, graph, labels, pooling, projection, reduction, splits
from seqweave.plans.embed import embed_records, hierarchical_embed
from seqweave.plans.evaluate import cross_validate, report, sanity_eval
from seqweave.plans.sequence_graph import build_graph
from seqweave.session import materialise
from seqweave.sources import synthetic


@pytest.fixture(scope="module")
def two_cliques(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)] + [(0, 10, 1.0)]
    nodes = spark.createDataFrame([(i,) for i in [*range(6), *range(10, 16)]], "id bigint")
    return nodes, spark.createDataFrame(edges, "src bigint, dst bigint, w double")


def test_communities_find_cliques(two_cliques):
    nodes, edges = two_cliques
    found = community.communities(edges, nodes)
    got = {r.id: r.cluster for r in found.collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10]
    assert graph.modularity(edges, found).first()[0] == pytest.approx(30 / 31 - 0.5)
    parts = community.partition_nodes(edges, nodes, 3, found)
    assert max(r["count"] for r in parts.groupBy("part").count().collect()) <= 4
    assert parts.count() == 12


def test_community_labels_without_edges(spark):
    empty = spark.createDataFrame([], "src bigint, dst bigint, w double")
    got = labels.community_label(spark.range(4), empty).collect()
    assert {(r.label, r.n_classes) for r in got} == {(0, 1)}
    with pytest.raises(ValueError):
        labels.node_labels("unknown", spark.range(1), empty)


def test_row_sums_and_symmetry(two_cliques):
    nodes, edges = two_cliques
    sums = graph.row_normalize(edges).groupBy("src").agg(F.sum("w").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)
    m = {(r.src, r.dst): r.w for r in graph.propagation_matrix(edges, nodes).collect()}
    assert all(m[(b, a)] == pytest.approx(w) for (a, b), w in m.items())


def test_pca_properties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "key string, vec array<double>")
    result = reduction.pca(df, 3)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert result.explained == pytest.approx(values[:3].sum() / values.sum())
    assert np.allclose(result.components.T @ result.components, np.eye(3), atol=1e-8)
    got = np.array([r.vec for r in result.vectors.collect()])
    assert np.allclose(got.mean(axis=0), 0, atol=1e-8) and np.allclose(got.var(axis=0, ddof=1), values[:3])
    assert reduction.pca(df.filter("key = 'none'"), 2) is None
    with pytest.raises(ValueError):
        reduction.global_pca(df, 5)
    assert projection.project_2d(df).count() == 200


def test_token_vectors_and_inference(spark):
    seqs = synthetic.synthetic_sequences(spark, 60)
    vectors = pooling.train_token_embeddings(seqs, dim=8, epochs=1)
    assert vectors.count() == 20 and vectors.filter(F.size("vec") != 8).count() == 0
    assert pooling.token_embed_sequences(seqs, vectors, dim=8).count() == 60


def test_hierarchy_and_pair_evaluation(spark):
    seqs = synthetic.synthetic_sequences(spark, 40)
    vocab, edges, stats = build_graph(seqs, 2)
    assert stats.count() == 2
    levels = hierarchical_embed(vocab, edges, 2, [6, 4])
    norms = levels[2].select(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)).alias("n")).collect()
    assert all(r.n == pytest.approx(1.0) for r in norms)
    emb = embed_records(seqs, levels[2], 2)
    assert emb.count() == 40
    keys = [r.key for r in emb.orderBy("key").collect()]
    data = [(keys[i], keys[j], int((i + j) % 2 == 0)) for i in range(12) for j in range(i + 1, 12)]
    ps = spark.createDataFrame(data, "p1 string, p2 string, label int")
    folds = splits.stratified_kfold(ps, 2)
    assert folds.select("p1", "p2").distinct().count() == len(data)
    metrics, aggregated = cross_validate(ps, {"a": emb, "b": emb.withColumn("vec", F.transform("vec", lambda v: v * 2 + 1))}, k=2, max_iter=5)
    assert metrics.groupBy("model", "fold").count().count() == 4
    table, tests = report(aggregated, metrics, "a")
    assert table.count() == 2 and tests.count() == 1
    check = sanity_eval(ps, emb, max_iter=5).first()
    assert 0.0 <= check.auc <= 1.0
    one_class, _ = cross_validate(ps.withColumn("label", F.lit(1)), {"a": emb}, k=2)
    assert {r.value for r in one_class.filter("metric = 'auc'").collect()} == {0.5}


def test_models_and_node_classifier(spark, two_cliques):
    nodes, edges = two_cliques
    x = features.random_features(nodes, 4)
    for name in convs.MODELS:
        out = convs.run_model(convs.ZooModel(name, [4, 3, 2], heads=2), edges, nodes, x)
        assert out.count() == 12
        assert out.filter(F.size("vec") != 2).count() == 0
    truth = nodes.select("id", F.when(F.col("id") < 10, 0).otherwise(1).alias("label"))
    _, predicted = features.train_node_classifier(edges, nodes, x, truth, hops=2)
    assert predicted.filter(F.col("prediction") == F.col("label")).count() >= 10


def test_perceptron_classifier(spark):
    df = spark.createDataFrame([([float(i % 2), float(i % 3)], i % 2) for i in range(60)], "features array<double>, label int")
    model = evaluation.fit_pair_classifier(df, kind="mlp", hidden=(4,), max_iter=30)
    scored = evaluation.predict_proba(model, df.withColumn("k", F.lit(1)))
    assert scored.columns == ["label", "k", "score"]
    assert evaluation.roc_auc(scored).first().auc > 0.9


def test_communities_run_until_no_merge_gains(spark):
    """On a long path no merge of two linked clusters raises modularity."""
    path = [(i, i + 1, 1.0) for i in range(600)]
    edges = spark.createDataFrame(path, "src long, dst long, w double")
    found = {r["id"]: r["cluster"] for r in community.communities(edges).collect()}
    m2, tot = 2.0 * len(path), {}
    for a, b, w in path:
        for x in (a, b):
            tot[found[x]] = tot.get(found[x], 0.0) + w
    across = {(found[a], found[b]) for a, b, _ in path if found[a] != found[b]}
    assert all(1.0 - tot[a] * tot[b] / m2 <= 1e-9 for a, b in across)
    with pytest.raises(RuntimeError):
        community.communities(edges, max_rounds=1)


@pytest.mark.parametrize("block_links, most_tables", [(None, 8), (1_500, None)])
def test_nodes_of_a_dense_graph_settle_in_few_tables(spark, monkeypatch, block_links, most_tables):
    """Nodes move one after the other inside a block, so a graph without structure takes few turns; in the end no node gains."""
    draw, n = np.random.default_rng(5), 80
    rows = [(i, j, float(draw.integers(1, 4))) for i in range(n) for j in range(i + 1, n) if draw.random() < 0.5]
    tables, write = [], community.materialise
    monkeypatch.setattr(community, "materialise", lambda df: tables.append(1) or write(df))
    if block_links:
        monkeypatch.setattr(community, "_BLOCK_LINKS", block_links)
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    m2 = 2.0 * sum(w for _, _, w in rows)
    moved, before, after = community._local_moving(edges, m2, None, 42)
    assert most_tables is None or len(tables) <= most_tables
    found = {r["id"]: r["cluster"] for r in moved.collect()}
    own, to = np.array([found[i] for i in range(n)]), np.zeros((n, n))
    for a, b, w in rows:
        to[a, found[b]] += w
        to[b, found[a]] += w
    k = to.sum(axis=1)
    tot = np.bincount(own, k, n)
    here = to[np.arange(n), own]
    assert before < after == pytest.approx(here.sum() / m2 - ((tot / m2) ** 2).sum())
    rest = np.tile(tot, (n, 1))
    rest[np.arange(n), own] -= k
    gain = np.where(to > 0, to - k[:, None] * rest / m2, -np.inf)
    assert (gain.max(axis=1) <= here - k * rest[np.arange(n), own] / m2 + 1e-9).all()


def test_a_graph_of_several_blocks_is_searched_whole(spark, monkeypatch):
    """Up to `_WHOLE_LINKS` links few tables settle a graph that several blocks would share, as one block does."""
    draw, n = np.random.default_rng(5), 80
    rows = [(i, j, float(draw.integers(1, 4))) for i in range(n) for j in range(i, n) if draw.random() < 0.5]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    m2 = 2.0 * sum(w for _, _, w in rows)
    tables, write = [], community.materialise
    monkeypatch.setattr(community, "materialise", lambda df: tables.append(1) or write(df))
    monkeypatch.setattr(community, "_BLOCK_LINKS", 1_500)
    moved, before, after = community._local_moving(edges, m2, None, 42)
    assert len(tables) <= 8
    monkeypatch.setattr(community, "_WHOLE_LINKS", 0)
    monkeypatch.setattr(community, "_BLOCK_LINKS", 1 << 21)
    block, start, end = community._local_moving(edges, m2, None, 42)
    assert sorted(moved.collect()) == sorted(block.collect()) and (before, after) == pytest.approx((start, end))
    monkeypatch.setattr(community, "_BLOCK_LINKS", 1_500)
    _, start, end = community._local_moving(edges, m2, None, 42)
    assert before == pytest.approx(start) and end > start


def test_written_tables_leave_no_shuffle_files(spark):
    """Disk holds the table alone once it is written, and the session's own setting is as it was."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    known, before = shuffled(), spark.conf.get(setting)
    table = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    deadline = time.time() + 10  # files go in the background
    while shuffled() - known and time.time() < deadline:
        time.sleep(0.1)
    assert not shuffled() - known and spark.conf.get(setting) == before and table.count() == 7


def test_narrowed_features_travel_over_the_edges(spark, monkeypatch):
    """Convolutions that narrow the features send what the transform leaves of them, with the same results."""
    draw, n, d, out = np.random.default_rng(3), 7, 6, 2
    x, (w0, w1, w2, w3) = draw.normal(size=(n, d)), draw.normal(size=(4, out, d))
    pairs = [(0, 1), (1, 2), (2, 0), (3, 1), (4, 3), (5, 4)]  # nothing reaches 5 and 6
    a = np.zeros((n, n))
    for s, t in pairs:
        a[t, s] = 1.0
    edges = spark.createDataFrame([(s, t, 1.0, (s + t) % 2) for s, t in pairs], "src long, dst long, w double, rel int")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    xs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    widths, send, add = [], convs.propagate, convs.aggregate_vectors
    monkeypatch.setattr(convs, "propagate", lambda es, v, ns, dim, **k: widths.append(dim) or send(es, v, ns, dim, **k))
    monkeypatch.setattr(convs, "aggregate_vectors", lambda df, keys, vec, dim, *r, **k: widths.append(dim) or add(df, keys, vec, dim, *r, **k))
    mean = lambda m: m / np.maximum(m.sum(axis=1, keepdims=True), 1.0)
    deg = a.sum(axis=0)
    inv = np.where(deg > 0, 1 / np.sqrt(np.maximum(deg, 1)), 0.0)
    lap, odd = -inv[:, None] * a * inv[None, :], np.add.outer(np.arange(n), np.arange(n)) % 2
    t1 = lap @ x
    t2 = 2 * lap @ t1 - x
    b, top = np.array([0.5, -0.25]), np.eye(out)
    plain = edges.select("src", "dst", "w")
    cases = [
        (convs.sage_conv(plain, nodes, xs, w0, w1, b), mean(a) @ x @ w0.T + b + x @ w1.T),
        (convs.gin_conv(plain, nodes, xs, w0, b, top, np.zeros(out), 0.5), np.maximum((1.5 * x + a @ x) @ w0.T + b, 0)),
        (convs.cheb_conv(plain, nodes, xs, [w0, w1, w2], b), x @ w0.T + t1 @ w1.T + t2 @ w2.T + b),
        (convs.cheb_conv(plain, nodes, xs, [w0, w1, w2, w3]), x @ w0.T + t1 @ w1.T + t2 @ w2.T + (2 * lap @ t2 - t1) @ w3.T),
        (convs.rgcn_conv(edges, nodes, xs, [w0, w1], w2, b), mean(a * (odd == 0)) @ x @ w0.T + mean(a * (odd == 1)) @ x @ w1.T + x @ w2.T + b),
    ]
    for got, expected in cases:
        found = {r["id"]: r["vec"] for r in got.collect()}
        assert np.allclose([found[i] for i in range(n)], expected)
    assert set(widths) == {out}
