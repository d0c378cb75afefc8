"""Hand-computed expectations on literal tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.functions import text as T
from seqweave.functions import vectors as V
from seqweave.operators import convs, evaluation, features, graph, ids, labels, ngrams, ordering, pairs, pooling, projection, reduction, splits, vector_agg
from seqweave.session import scratch_path
from seqweave.sources import fasta, synthetic, tables
from seqweave.sources.pairs import read_pairs_lenient, read_pairs_strict
from seqweave.streaming import stream_pairs


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


SEQS = [(0, "seq1", "ACGTACT"), (1, "seq2", "TTACGTT"), (2, "seq3", "AGATAGA")]


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame(SEQS, "seq_ord bigint, id string, seq string")


def test_one_gram_transitions(three):
    expected = {("A", "C"): 3, ("C", "G"): 2, ("G", "T"): 2, ("T", "A"): 3, ("C", "T"): 1, ("T", "T"): 2,
                ("A", "G"): 2, ("G", "A"): 2, ("A", "T"): 1}
    got = {(r.src, r.dst): r.w for r in ngrams.transition_counts(three, 1).collect()}
    assert got == expected
    padded = {(r.src, r.dst): r.w for r in ngrams.transition_counts(ngrams.pad_sequences(three), 1).collect()}
    assert padded == {**expected, (" ", "A"): 1, ("T", " "): 2, ("A", " "): 1}


def brute_grams(seq, k):
    return [seq[i : i + k] for i in range(len(seq) - k + 1)]


def test_levels_against_brute_force_on_chunk_borders(spark):
    rng = random.Random(5)
    lengths = [0, 1, 2, 3, 4, 5, 4095, 4096, 4097, 4098, 4099, 4100, 8192, 8195, 9000]
    data = [(i, str(i), "".join(rng.choice("ACD") for _ in range(n))) for i, n in enumerate(lengths)]
    seqs = spark.createDataFrame(data, "seq_ord bigint, id string, seq string")
    expected = {}
    for _, _, s in data:
        for k in (1, 2, 3, 4):
            for g in brute_grams(s, k):
                expected[(k, g)] = expected.get((k, g), 0) + 1
    got = {(r.width, r.ngram): r.n_occ for r in ngrams.level_counts(seqs, 3).collect()}
    assert got == expected
    placed = {(r.id, r.pos): r.ngram for r in ngrams.ngrams(seqs, 3).collect()}
    assert placed == {(i, p): g for _, i, s in data for p, g in enumerate(brute_grams(s, 3))}
    assert ngrams.transitions(seqs, 3).count() == sum(max(0, n - 3) for n in lengths)


def test_unicode_windows(spark):
    seqs = spark.createDataFrame([(0, "a", "aé😀b")], "seq_ord bigint, id string, seq string")
    assert rows(ngrams.ngrams(seqs, 2), "pos", "ngram") == [(0, "aé"), (1, "é😀"), (2, "😀b")]


def test_vocabulary_is_dense_and_sorted(three):
    vocab = ngrams.assign_ids(ngrams.distinct_ngrams(three, 2)).orderBy("id").collect()
    assert [r.id for r in vocab] == list(range(len(vocab)))
    assert [r.ngram for r in vocab] == sorted({g for _, _, s in SEQS for g in brute_grams(s, 2)})


GRAPH = [(0, 1, 2.0), (1, 0, 1.0), (1, 2, 1.0), (2, 2, 3.0)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.range(3), spark.createDataFrame(GRAPH, "src bigint, dst bigint, w double")


def dense(df, n, value="w"):
    m = np.zeros((n, n))
    for r in df.collect():
        m[r["src"], r["dst"]] += r[value]
    return m


def reference_propagation(a, eps=1e-9):
    s = a.sum(axis=1, keepdims=True)
    an = np.divide(a, s, out=np.zeros_like(a), where=s != 0)
    sym, skew = (an + an.T) / 2, (an - an.T) / 2
    energy = sym**2 + skew**2
    return np.where((a + a.T) > 0, np.sqrt(energy + eps), 0) + np.eye(len(a))


def test_propagation_matrix(small):
    nodes, edges = small
    got = dense(graph.propagation_matrix(edges, nodes), 3)
    expected = np.array([[1, 0.790569, 0], [0.790569, 1, 0.353553], [0, 0.353553, 2]])
    assert np.allclose(got, expected, atol=1e-6)


def test_layer_matrices_match_dense_algebra(small):
    nodes, edges = small
    a = dense(edges, 3)
    wide = graph.layer_matrices(edges, nodes)
    assert np.allclose(dense(wide, 3, "w_out"), reference_propagation(a))
    assert np.allclose(dense(wide, 3, "w_in"), reference_propagation(a.T))
    und = ((a + a.T) > 0).astype(float) + np.eye(3)
    d = und.sum(axis=0)
    assert np.allclose(dense(wide, 3, "w_und"), und / np.sqrt(np.outer(d, d)))
    assert np.allclose(dense(graph.sym_normalize(edges, nodes), 3), und / np.sqrt(np.outer(d, d)))


def test_graph_without_edges_stays_empty(spark):
    edges = spark.createDataFrame([], "src bigint, dst bigint, w double")
    assert graph.propagation_matrix(edges, spark.range(3)).count() == 0


def test_pooling_modes(spark):
    seqs = spark.createDataFrame([(0, "s", "AAAC"), (1, "short", "")], "seq_ord bigint, id string, seq string")
    table = spark.createDataFrame([("A", [1.0]), ("C", [3.0])], "ngram string, vec array<double>")
    assert rows(pooling.pool_ngrams(seqs, table, 1, "occurrence"), "id", F.col("vec")[0]) == [("s", 1.5)]
    assert rows(pooling.pool_ngrams(seqs, table, 1, "distinct"), "id", F.col("vec")[0]) == [("s", 2.0)]


def test_pooling_wide_vectors_and_unknown_strategy(spark):
    data = [("a", 0, [float(i) for i in range(150)]), ("a", 1, [float(3 * i) for i in range(150)])]
    df = spark.createDataFrame(data, "key string, pos int, vec array<double>")
    assert pooling.pool_rows(df, "median").first().vec == [2.0 * i for i in range(150)]
    assert pooling.pool_rows(df, "max").first().vec == [3.0 * i for i in range(150)]


def test_ranking_metrics(spark):
    scored = spark.createDataFrame(
        [("a", "x", 1, 0.9), ("b", "x", 0, 0.8), ("c", "x", 1, 0.7), ("d", "x", 0, 0.6)],
        "p1 string, p2 string, label int, score double",
    )
    got = {r.k: r for r in evaluation.ranking_metrics(scored, (2, 10)).collect()}
    assert got[2].hits == 0.5 and got[2].ndcg == pytest.approx(0.613147, abs=1e-6)
    assert got[10].hits == 1.0
    negatives = scored.withColumn("label", F.lit(0))
    assert [(r.hits, r.ndcg) for r in evaluation.ranking_metrics(negatives, (2,)).collect()] == [(0.0, 0.0)]


def test_auc_with_ties_and_single_class(spark):
    data = [(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)]
    scored = spark.createDataFrame(data, "score double, label int")
    assert evaluation.roc_auc(scored).first().auc == 0.875
    assert evaluation.roc_auc(scored.filter("label = 1")).first().auc == 0.5
    flipped = scored.withColumn("score", 1 - F.col("score"))
    assert evaluation.roc_auc(flipped).first().auc == pytest.approx(0.125)


def test_wilcoxon(spark):
    df = spark.createDataFrame([("m", float(i), 0.0) for i in range(1, 6)], "g string, a double, b double")
    r = evaluation.wilcoxon_signed_rank(df, by=["g"]).first()
    assert (r.n, r.w) == (5, 0.0) and r.p_value == pytest.approx(0.0625)
    same = spark.createDataFrame([("m", 1.0, 1.0)], "g string, a double, b double")
    assert evaluation.wilcoxon_signed_rank(same, by=["g"]).first().p_value == 1.0


def brute_wilcoxon_p(diffs):
    order = sorted(abs(d) for d in diffs)
    mid = {v: np.mean([i + 1 for i, o in enumerate(order) if o == v]) for v in order}
    ranks = [mid[abs(d)] for d in diffs]
    plus = sum(r for r, d in zip(ranks, diffs) if d > 0)
    w = min(plus, sum(ranks) - plus)
    hits = sum(sum(r for k, r in enumerate(ranks) if m >> k & 1) <= w + 1e-9 for m in range(1 << len(diffs)))
    return w, min(1.0, 2 * hits / (1 << len(diffs)))


def test_wilcoxon_ties_against_enumeration_and_normal_tail(spark):
    diffs = [1.0, -1.0, 2.0, 2.0, -3.0, 4.0, 4.0, 5.0]
    df = spark.createDataFrame([(d, 0.0) for d in diffs], "a double, b double")
    r = evaluation.wilcoxon_signed_rank(df).first()
    w, p = brute_wilcoxon_p(diffs)
    assert r.w == w and r.p_value == pytest.approx(p)
    many = spark.createDataFrame([(float(i if i % 3 else -i), 0.0) for i in range(1, 41)], "a double, b double")
    big = evaluation.wilcoxon_signed_rank(many, method="normal").first()
    n = 40
    z = abs(big.w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert big.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)


def test_signed_ranks_of_millions_of_ties(spark):
    equal = spark.range(3_000_000).select(F.lit(2.0).alias("a"), F.lit(1.0).alias("b"))
    r = evaluation.wilcoxon_signed_rank(equal, method="normal").first()
    assert (r.n, r.w) == (3_000_000, 0.0) and r.p_value == pytest.approx(0.0)


def test_projection_sample_of_repeated_keys(spark):
    points = spark.createDataFrame([(k % 3, 0, [float(k)]) for k in range(30)], "key int, row int, vec array<double>")
    assert projection.projection_sample(points, 10).count() == 10
    assert projection.projection_sample(points, 99).count() == 30


def test_the_last_target_of_an_id_wins(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "id string")
    table = spark.createDataFrame([("a", "x", 1), ("a", "w", 2), ("b", "y", 1)], "`from` string, `to` string, ord int")
    assert rows(ids.map_ids_by_table(wanted, table), "original", "mapped") == [("a", "w"), ("b", "y")]


@pytest.mark.parametrize("width", [2, 64, 70])
def test_vectors_of_two_widths_are_an_error(spark, width):
    uneven = spark.createDataFrame([("a", [1.0] * width), ("a", [1.0] * (width + 1))], "key string, vec array<double>")
    with pytest.raises(ValueError):
        vector_agg.aggregate_vectors(uneven, ["key"])
    even = uneven.limit(1)
    assert vector_agg.aggregate_vectors(even, ["key"]).first().vec == [1.0] * width


def test_an_unknown_relation_is_an_error(spark):
    nodes = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, vec array<double>")
    edges = spark.createDataFrame([(0, 1, 5)], "src long, dst long, rel int")
    with pytest.raises(ValueError):
        convs.rgcn_conv(edges, nodes.select("id"), nodes, [np.eye(1)], np.eye(1))


def test_compare_models_verdicts(spark):
    data = []
    for fold in range(5):
        data += [("main", fold, 0.8 + fold / 100), ("same", fold, 0.8 + fold / 100), ("low", fold, 0.5 + fold / 50)]
    data += [("short", 0, 0.5)]
    got = {r.model: r for r in evaluation.compare_models(spark.createDataFrame(data, "model string, fold int, score double"), "main").collect()}
    assert got["same"].verdict == "same" and got["same"].p_value == 1.0
    assert got["low"].verdict == "not shown" and got["low"].p_value == pytest.approx(0.0625) and got["low"].r == pytest.approx(1.0)
    assert got["short"].verdict == "not comparable"


def test_fasta_edge_cases(spark):
    path = scratch_path(spark, "fasta-test").removeprefix("file:")
    import os

    os.makedirs(path)
    with open(f"{path}/a.fasta", "wb") as f:
        f.write(b"loose text\n\n>sp|P1|X first > one\r\nacgt\r\n\r\nAC\r\n>empty\n>\nAAA\n> \nCCC\n>x|| y\nGG\n>last z\nTT")
    with open(f"{path}/b.fa", "w") as f:
        f.write("\n>r1\nMK\nVL\n")
    with open(f"{path}/skip.txt", "w") as f:
        f.write(">no\nAA\n")
    got = rows(fasta.read_fasta_dir(spark, path, with_file=False), "id", "seq")
    assert got == [("P1", "ACGTAC"), ("last", "TT"), ("r1", "MKVL"), ("x||", "GG")]
    order = [r.id for r in fasta.read_fasta(spark, f"{path}/a.fasta").orderBy("seq_ord").collect()]
    assert order == ["P1", "x||", "last"]


def test_pair_readers_and_stream(spark):
    base = scratch_path(spark, "pairs-test")
    lines = ['"a","b"', " c\td ", "only", ",x", "e,f,g", ""]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{base}/in")
    expected = [("a", "b"), ("c", "d"), ("e", "f")]
    assert rows(read_pairs_lenient(spark, f"{base}/in", 1), "p1", "p2") == expected
    stream_pairs(spark, f"{base}/in", f"{base}/out", f"{base}/progress", 1)
    stream_pairs(spark, f"{base}/in", f"{base}/out", f"{base}/progress", 1)
    assert rows(spark.read.parquet(f"{base}/out"), "p1", "p2") == expected
    strict = [("a,b",), (" c , d ",), ("e,",), (",f",)]
    spark.createDataFrame(strict, "value string").write.text(f"{base}/csv")
    assert rows(read_pairs_strict(spark, f"{base}/csv", 0), "p1", "p2") == [("a", "b"), ("c", "d")]


def test_canonical_ids(spark):
    headers = ["sp|P12345|TEST_HUMAN x", "tr|A0A0A0|ANOTHER_TEST y", "UniRef50_Q9 z", "DUMMY_P0001", "q9y lower", ">sp|P12345|T"]
    df = spark.createDataFrame([(h,) for h in headers], "header string")
    got = [r[0] for r in df.select(T.canonical_id("header")).collect()]
    assert got == ["P12345", "A0A0A0", "Q9", "DUMMY", "q9y", "P12345"]
    assert df.select(T.header_id("header")).collect()[0][0] == "P12345"


def test_id_map_collisions_last_wins(spark):
    emb = spark.createDataFrame([("a", [1.0], 0), ("b", [2.0], 1), ("c", [3.0], 2)], "key string, vec array<double>, ord int")
    idmap = spark.createDataFrame([("a", "z"), ("b", "z")], "original string, mapped string")
    assert rows(ids.apply_id_map(emb, idmap), "key", F.col("vec")[0], "n_merged") == [("c", 3.0, 1), ("z", 2.0, 2)]
    with pytest.raises(ValueError):
        ids.id_map("other", emb)


def test_sanitize_and_tokens(spark):
    df = spark.createDataFrame([("muzob",), ("",)], "s string")
    got = df.select(T.sanitize_residues("s").alias("a"), T.tokenize("s").alias("t")).collect()
    assert got[0].a == "M X X X X" and got[0].t == list("muzob")
    assert got[1].a == "" and got[1].t == []


def test_seeded_rank_with_copies(spark):
    df = spark.createDataFrame([("a", 1)] * 70000 + [("b", 1), ("c", 0)], "p1 string, label int").repartition(4)
    ranked = ordering.seeded_rank(df, ["p1"], 7, by=["label"], out="r")
    assert ranked.count() == 70002
    ones = ranked.filter("label = 1").select(F.min("r"), F.max("r"), F.count_distinct("r")).first()
    assert tuple(ones) == (0, 70000, 70001)
    sizes = [r["count"] for r in splits.stratified_kfold(df, 3, keys=["p1"]).filter("label = 1").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_sample_sizes(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert splits.sample_exact(df, 137, ["k"]).distinct().count() == 137
    assert splits.sample_exact(df, 5000, ["k"]).count() == 1000
    assert splits.sample_exact(df, 0, ["k"]).count() == 0


def test_running_totals_and_group_rank(spark):
    data = [("g" if i % 3 else "h", i, i % 7) for i in range(500)]
    df = spark.createDataFrame(data, "g string, i int, v int").repartition(5)
    got = {(r.g, r.i): r.t for r in ordering.running_totals(df, ["i"], {"t": "v"}, ["g"]).collect()}
    expected, sums = {}, {}
    for g, i, v in data:
        sums[g] = sums.get(g, 0) + v
        expected[(g, i)] = sums[g]
    assert got == expected
    places = {(r.g, r.i): r["rank"] for r in ordering.group_rank(df.select("g", "i"), ["g"], ["i"]).collect()}
    seen = {}
    for g, i, _ in data:
        assert places[(g, i)] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1


def test_linear_both_ways(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 40))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "id int, vec array<double>")
    for d_out in (3, 60):
        w, b = rng.normal(size=(d_out, 40)), rng.normal(size=d_out)
        got = {r.id: r.y for r in df.select("id", V.linear("vec", w, b).alias("y")).collect()}
        assert got[99] is None
        assert np.allclose(np.array([got[i] for i in range(20)]), x @ w.T + b)


def numpy_layer(mats, x, layer):
    out = 0
    for p, m in mats.items():
        w, b = layer.path(p)
        out = out + (m.T @ x) @ w.T + b
    return out


@pytest.mark.parametrize("d_out", [3, 40, 7])
def test_directed_layer_against_numpy(spark, small, d_out):
    nodes, edges = small
    d_in = 6
    x = np.random.default_rng(2).normal(size=(3, d_in))
    feats = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    a = dense(edges, 3)
    und = ((a + a.T) > 0).astype(float) + np.eye(3)
    d = und.sum(axis=0)
    mats = {"out": reference_propagation(a), "in": reference_propagation(a.T), "und": und / np.sqrt(np.outer(d, d))}
    layer = features.DirectedLayer.seeded(d_in, d_out, 3)
    layer.bias = {"in": np.ones(d_out), "shared_und": np.full(d_out, 0.5)}
    got = {r.id: r.vec for r in features.directed_layer(graph.layer_matrices(edges, nodes), feats, layer).collect()}
    assert np.allclose(np.array([got[i] for i in range(3)]), numpy_layer(mats, x, layer))
    wide = features.DirectedLayer.seeded(d_in, 40, 3)
    both = [f(graph.layer_matrices(edges, nodes), feats, wide) for f in (features._transform_then_gather, features._gather_then_transform)]
    left, right = ({r.id: np.array([r["in"], r["out"], r["und"]]) for r in df.collect()} for df in both)
    assert all(np.allclose(left[i], right[i]) for i in range(3))


def test_attention_weights_sum_to_one(spark, small):
    nodes, edges = small
    ones = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(3)], "id bigint, vec array<double>")
    heads = [(np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([0.3, -0.2]), np.array([0.1, 0.4]))]
    got = [r.vec for r in convs.gat_conv(edges, nodes, ones, heads).collect()]
    assert all(np.allclose(v, [1.0, 2.0]) for v in got)


def test_closest_token_hops(spark):
    nodes = spark.createDataFrame([(0, "AA"), (1, "CC"), (2, "DD"), (3, "EE"), (4, "FF")], "id bigint, name string")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (2, 0, 1.0)], "src bigint, dst bigint, w double")
    names, out = {0: "AA", 1: "CC", 2: "DD", 3: "EE", 4: "FF"}, {0: [1], 1: [2], 2: [3, 0], 3: [4], 4: []}
    for r in labels.closest_token_label(nodes, edges, 3, "ACDEF", seed=11).collect():
        dist, frontier, seen = 0, {r.id}, {r.id}
        while dist <= 3 and not any(r.token in names[n] for n in frontier):
            frontier = {m for n in frontier for m in out[n]} - seen
            seen |= frontier
            dist += 1
            if not frontier:
                dist = 4
        assert (r.label, r.found) == (min(dist, 3), dist <= 3)


def test_standardize_constant_dimension_and_impute(spark):
    df = spark.createDataFrame([("a", [1.0, 5.0]), ("b", [3.0, 5.0]), ("c", [])], "key string, vec array<double>")
    assert rows(reduction.standardize(df), "key", "vec") == [("a", [-1.0, 0.0]), ("b", [1.0, 0.0])]
    nan = float("nan")
    holes = spark.createDataFrame([("a", [1.0, nan, nan]), ("b", [nan, nan, 4.0])], "key string, vec array<double>")
    assert rows(reduction.impute_mean(holes), "key", "vec") == [("a", [1.0, 4.0]), ("b", [1.0, 4.0])]


def test_pair_feature_methods_and_audit(spark):
    emb = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 5.0]), ("c", [1.0])], "key string, vec array<double>")
    ps = spark.createDataFrame([("a", "b", 1), ("a", "c", 0), ("a", "q", 0)], "p1 string, p2 string, label int")
    expected = {"concatenate": [1, 2, 3, 5], "average": [2, 3.5], "hadamard": [3, 10], "l1_distance": [2, 3], "l2_distance": [4, 9], "?": [1, 2, 3, 5]}
    for method, want in expected.items():
        got = pairs.pair_features(ps, emb, method, 2).collect()
        assert len(got) == 1 and got[0].features == want
        assert pairs.feature_dim(method, 2) == len(want)
    audit = pairs.pair_features_audit(ps, emb, 2).first()
    assert (audit.n_pairs, audit.n_missing, audit.n_mismatched, audit.n_usable) == (3, 1, 1, 1)


def test_synthetic_generators(spark):
    seqs = synthetic.synthetic_sequences(spark, 50)
    assert seqs.filter(~F.length("seq").between(20, 49)).count() == 0
    again = synthetic.synthetic_sequences(spark, 50).repartition(3)
    assert rows(seqs, "id", "seq") == rows(again, "id", "seq")
    assert synthetic.synthetic_pairs(spark, 100, 20, 1).filter("p1 >= p2").count() == 0
    assert synthetic.synthetic_embeddings(spark, 10, 8).filter(F.size("vec") != 8).count() == 0


def test_graph_snapshot_round_trip(spark, three):
    vocab, edges = ngrams.build_levels(three, 2)
    path = scratch_path(spark, "snapshot-test")
    tables.save_graph(vocab, edges, path)
    nodes2, edges2 = tables.load_graph(spark, path, 2)
    assert rows(nodes2, "id", "ngram") == rows(vocab.filter("n = 2"), "id", "ngram")
    assert rows(edges2, "src", "dst", "w") == rows(edges.filter("n = 2"), "src", "dst", "w")


def test_salted_join_matches_plain(spark):
    from seqweave.operators.vector_agg import lookup_join

    big = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    lookup = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, name string")
    assert rows(lookup_join(big, lookup, "k", salts=5), "k", "v", "name") == rows(big.join(lookup, "k"), "k", "v", "name")
