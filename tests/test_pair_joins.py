import numpy as np
from pyspark.sql.types import DoubleType

from seqweave.functions.vectors import dot
from seqweave.operators import evaluation as E
from seqweave.operators import pair_vectors
from seqweave.operators import pairs as P
from seqweave.operators import pooling, vector_agg
from seqweave.operators import splits as S
from seqweave.plans import evaluate


def _data(spark):
    emb = spark.createDataFrame([(str(i), [float(i), i / 3.0, -1.0]) for i in range(40)], "key string, vec array<float>")
    pairs = spark.createDataFrame([(str(i), str(j), 1) for i in range(40) for j in range(i)], "p1 string, p2 string, label int")
    return pairs, emb


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_pairs_stay_where_they_are_when_vectors_are_few(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs, emb = _data(spark)
        small = P.pair_features(pairs, emb, "hadamard")
        assert "SortMergeJoin" not in _plan(small)
        monkeypatch.setattr(vector_agg, "BROADCAST_BYTES", 64)
        large = P.pair_features(pairs, emb, "hadamard")
        assert "SortMergeJoin" in _plan(large)
        rows = [sorted(map(tuple, ((r.p1, r.p2, *r.features) for r in df.collect()))) for df in (small, large)]
        assert rows[0] == rows[1] and len(rows[0]) == 780
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_model_rows_stay_where_they_are(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(str(i), j, [1.0]) for i in range(9) for j in range(12)], "key string, pos long, vec array<float>")
        lengths = spark.createDataFrame([(str(i), i) for i in range(9)], "key string, length int")
        small = pooling.slice_model_rows(rows, lengths)
        assert "SortMergeJoin" not in _plan(small)
        monkeypatch.setattr(vector_agg, "BROADCAST_BYTES", 64)
        large = pooling.slice_model_rows(rows, lengths)
        assert "SortMergeJoin" in _plan(large)
        counts = [sorted(map(tuple, df.groupBy("key").count().collect())) for df in (small, large)]
        assert counts[0] == counts[1] == [(str(i), i) for i in range(1, 9)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_model_rows_meet_many_lengths_without_a_shuffle(spark, monkeypatch):
    """Beyond the lengths that are repeated as rows, hashes of the keys find them; keys that repeat are joined."""
    data = [(str(i) if i else None, j, [1.0, float(j)]) for i in range(9) for j in range(12)] + [("stranger", 1, [2.0, 2.0])]
    rows = spark.createDataFrame(data, "key string, pos long, vec array<float>")
    lengths = spark.createDataFrame([*((str(i), i) for i in range(1, 9)), (None, 3)], "key string, length int")
    twice = lengths.unionByName(lengths.filter("key = '2'"))
    taken = lambda found: sorted((r.key, r.pos, r.vec) for df in [found] for r in df.collect())
    for given in (lengths, twice, lengths.filter("length > 90")):
        for first in (True, False):
            monkeypatch.setattr(vector_agg, "BROADCAST_BYTES", 1 << 20)
            few = taken(pooling.slice_model_rows(rows, given, first))
            monkeypatch.setattr(vector_agg, "BROADCAST_BYTES", 20 * 8)
            many = pooling.slice_model_rows(rows, given, first)
            assert taken(many) == few
            assert given is not lengths or "Join" not in _plan(many)


def test_batches_of_a_model_give_a_row_per_token(spark):
    """Matrices of several widths and lengths, empty ones too, keep their rows in order."""
    model = lambda: lambda texts: [np.arange(n * w, dtype=float).reshape(n, w) for n, w in ((len(t.split()) - 1, 1 + len(t.split()) % 2) for t in texts)]
    seqs = spark.createDataFrame([("a", "A"), ("b", "ACD"), ("c", ""), (None, "ACDE"), ("b", "AC")], "id string, seq string").coalesce(1)
    found = pooling.batch_infer(seqs, model, batch_size=2)
    rows = [(r.id, r.pos, r.vec) for r in found.collect()]
    assert rows == [("b", 0, [0.0, 1.0]), ("b", 1, [2.0, 3.0]), (None, 0, [0.0]), (None, 1, [1.0]), (None, 2, [2.0]), ("b", 0, [0.0])]
    assert found.dtypes == [("id", "string"), ("pos", "bigint"), ("vec", "array<float>")]


def test_records_pooled_in_one_task_move_no_ngrams(spark):
    seqs = spark.createDataFrame([(str(i % 7), "ACDEFGHIK"[i % 5 :] * 3) for i in range(21)], "id string, seq string")
    vectors = spark.createDataFrame([(a + b, [float(i), float(j)]) for i, a in enumerate("ACDEFGHIK") for j, b in enumerate("ACDEFGHIK")], "ngram string, vec array<double>")
    for weighting in ("distinct", "occurrence"):
        apart = pooling.pool_ngrams(seqs, vectors, 2, weighting)
        whole = pooling.pool_ngrams(seqs, vectors, 2, weighting, together=True)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, apart.collect()))
        assert _plan(whole).count("Exchange hash") == 1


def test_pairs_do_not_travel_with_many_vectors(spark, monkeypatch):
    pairs, emb = _data(spark)
    strangers = spark.createDataFrame([("1", "none", 0), ("none", "2", 1), (None, "3", 1)], pairs.schema)
    asked = pairs.unionByName(strangers)
    joined = {m: P.pair_features(asked, emb, m) for m in P.METHODS}
    joined["dot"] = pair_vectors.pair_values(asked, emb, 3, "features", DoubleType(), dot, pair_vectors.dot_rows)
    monkeypatch.setattr(vector_agg, "BROADCAST_BYTES", 64)
    monkeypatch.setattr(pair_vectors, "BLOCK_BYTES", 700)
    dealt = {m: P.pair_features(asked, emb, m) for m in P.METHODS}
    dealt["dot"] = pair_vectors.pair_values(asked, emb, 3, "features", DoubleType(), dot, pair_vectors.dot_rows)
    for method, few in joined.items():
        many = dealt[method]
        assert "Join" not in _plan(many) and many.dtypes == few.dtypes
        rows = [sorted((r.p1, r.p2, r.label, r.features) for r in df.collect()) for df in (few, many)]
        assert rows[0] == rows[1] and len(rows[0]) == 780
    ragged = emb.unionByName(spark.createDataFrame([("99", [])], emb.schema))
    assert "SortMergeJoin" in _plan(pair_vectors.pair_values(asked, ragged, 3, "features", DoubleType(), dot, pair_vectors.dot_rows))


def test_kept_features_are_made_from_cells(spark, monkeypatch):
    """Pairs and vectors stay in cells of their own; what is read from them equals the joined features."""
    pairs, emb = _data(spark)
    strangers = spark.createDataFrame([("1", "none", 0), ("none", "2", 1), (None, "3", 1)], pairs.schema)
    asked = pairs.unionByName(strangers)
    monkeypatch.setattr(pair_vectors, "LEAST_PAIRS", 60)
    for block_bytes in (1 << 26, 700):
        monkeypatch.setattr(pair_vectors, "BLOCK_BYTES", block_bytes)
        for method in P.METHODS:
            kept = P.pair_features(asked, emb, method, keep=True)
            joined = P.pair_features(asked, emb, method)
            assert kept.dtypes == joined.dtypes
            rows = [sorted((r.p1, r.p2, r.label, r.features) for r in df.collect()) for df in (kept, joined)]
            assert rows[0] == rows[1] and len(rows[0]) == 780
            kept._made[0].unpersist()
    twice = emb.unionByName(emb.filter("key = '3'"))
    rows = [sorted((r.p1, r.p2, r.features) for r in df.collect()) for df in (P.pair_features(pairs, twice, "hadamard", keep=True), P.pair_features(pairs, twice, "hadamard"))]
    assert rows[0] == rows[1] and len(rows[0]) == 780 + 39
    assert P.pair_features(pairs, emb.limit(0), "hadamard", 3, keep=True).count() == 0
    assert P.pair_features(pairs.limit(0), emb, "hadamard", keep=True).count() == 0


def test_cross_validation_and_classifiers_write_no_features(spark, monkeypatch):
    draw = np.random.default_rng(3)
    emb = spark.createDataFrame([(str(i), draw.normal(size=4).tolist()) for i in range(60)], "key string, vec array<double>")
    pairs = spark.createDataFrame([(str(i), str(j), int((i + j) % 3 == 0)) for i in range(60) for j in range(i)], "p1 string, p2 string, label int")
    written = []
    for module in (pair_vectors, evaluate):
        monkeypatch.setattr(module, "materialise", lambda df, write=module.materialise: written.append(df.columns) or write(df))
    metrics, _ = evaluate.cross_validate(pairs, {"v": emb}, 3, "hadamard", max_iter=5)
    assert metrics.count() > 0 and written and not [c for c in written if "features" in c]
    data = P.pair_features(pairs, emb, "hadamard", keep=True)
    weights = S.class_weights(data)
    held = E.predict_proba(E.fit_pair_classifier(data, weights), data)
    monkeypatch.setattr(E, "_HELD_BYTES", 0)
    scanned = E.predict_proba(E.fit_pair_classifier(data, weights), data)
    assert held.dtypes == scanned.dtypes
    both = held.join(scanned.withColumnRenamed("score", "other"), ["p1", "p2", "label"])
    assert both.count() == 1770 and both.filter("abs(score - other) > 1e-3").isEmpty()
