"""Metrics of scored pairs, fold aggregation, model comparison and report tables.

Scored tables are `(label, score)` plus any grouping columns (`model`, `fold`); every metric takes `by` so
that all models and folds are evaluated in one plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave import constants as C
from seqweave.functions.seeded import seeded_hash
from seqweave.functions.vectors import argmax
from seqweave.operators.fold_models import FoldModels, fit_fold_classifiers, score_folds
from seqweave.operators.ordering import global_rank, running_totals
from seqweave.session import materialise

_HELD_BYTES = 1 << 30  # features of which MLlib may hold a copy

# --- models -----------------------------------------------------------------


def fit_pair_classifier(
    features: DataFrame,
    weights: DataFrame | None = None,
    kind: str = "logistic",
    hidden: Sequence[int] = C.HIDDEN_WIDTHS,
    max_iter: int = 100,
    reg: float = 1e-5,
    seed: int = 42,
):
    """Binary classifier on `(features ARRAY, label)`; `weights` is `(label, weight)` for class balance.

    `logistic` is MLlib's regression; `mlp` is a network with the given hidden widths. Both honour the weights. MLlib holds a
    copy of all features in memory and on disk, so beyond `_HELD_BYTES` of them the same loss is minimised by scans.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    # class weights are two rows
    by_class = {int(r["label"]): float(r["weight"]) for r in weights.collect()} if weights is not None else {}
    pair = (by_class[0], by_class[1]) if by_class and (kind == "mlp" or len(by_class) == 2) else (1.0, 1.0)
    if kind == "mlp":
        return fit_fold_classifiers(features, 1, hidden, class_weights=pair, max_iter=max_iter, reg=reg, seed=seed, folds=False)
    if kind != "logistic":
        raise ValueError(f"unknown classifier {kind!r}")
    n, width, unknown = features.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("features")), F.lit(0)), F.count_if(F.col("label").isNull())).first()
    if 8 * n * width > _HELD_BYTES and (not by_class or len(by_class) == 2):
        if unknown:
            raise ValueError(f"{unknown} labels are null")
        return fit_fold_classifiers(features, 1, (), class_weights=pair, max_iter=max_iter, reg=reg, seed=seed, folds=False)
    data = features.select(
        F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features")
    )
    if by_class:
        data = data.withColumn("weight", F.when(F.col("label") == 1, by_class[1]).otherwise(by_class[0]))
        return LogisticRegression(maxIter=max_iter, regParam=reg, weightCol="weight").fit(data)
    return LogisticRegression(maxIter=max_iter, regParam=reg).fit(data)


def predict_proba(model, features: DataFrame) -> DataFrame:
    """Input columns without the features, plus `score`: probability of label 1."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    kept = [c for c in features.columns if c != "features"]
    if isinstance(model, FoldModels):
        return score_folds(model, features.withColumn("_fold", F.lit(0)), "_fold").select(*kept, "score")
    scored = model.transform(features.withColumn("features", array_to_vector("features")))
    return scored.select(*kept, vector_to_array("probability")[1].alias("score"))


# --- thresholded metrics ----------------------------------------------------


def threshold(score: str | Column = "score", cut: float = 0.5) -> Column:
    """1 when the score is strictly above the cut."""
    c = F.col(score) if isinstance(score, str) else score
    return (c > F.lit(cut)).cast("int")


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def precision_recall_f1(scored: DataFrame, by: Sequence[str] = (), cut: float = 0.5) -> DataFrame:
    """Zero where a denominator is zero."""
    predicted = threshold("score", cut)
    tp, fp, fn = (F.col(c) for c in ("_tp", "_fp", "_fn"))
    counts = scored.groupBy(*by).agg(
        F.count_if((predicted == 1) & (F.col("label") == 1)).alias("_tp"),
        F.count_if((predicted == 1) & (F.col("label") == 0)).alias("_fp"),
        F.count_if((predicted == 0) & (F.col("label") == 1)).alias("_fn"),
    )
    return counts.select(
        *by,
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def accuracy(logits: DataFrame, vec: str = "vec", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose largest logit is at the label's index."""
    hit = (argmax(vec) == F.col(label)).cast("double")
    return logits.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def score_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score")
    )


def single_class_guard(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Default metrics for groups whose labels hold one class only."""
    return (
        scored.groupBy(*by)
        .agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
        .filter(F.col("_lo") == F.col("_hi"))
        .select(
            *by,
            F.lit(0.0).alias("precision"),
            F.lit(0.0).alias("recall"),
            F.lit(0.0).alias("f1"),
            F.lit(0.5).alias("auc"),
        )
    )


# --- curve metrics ----------------------------------------------------------


def _score_counts(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score: ties collapse on the map side."""
    return scored.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact tie-aware area: share of (positive, negative) pairs ranked rightly, ties one half.

    A group with one class has area 0.5.
    """
    counted = running_totals(_score_counts(scored, by), ["score"], {"_negs": "neg"}, by)
    won = F.col("pos").cast("double") * (F.col("_negs") - F.col("neg") * 0.5)
    sums = counted.groupBy(*by).agg(
        F.sum(won).alias("_won"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    )
    area = F.try_divide(F.col("_won"), F.col("_p").cast("double") * F.col("_n").cast("double"))
    return sums.select(*by, F.coalesce(area, F.lit(0.5)).alias("auc"))


def roc_curve(scored: DataFrame, by: Sequence[str] = (), drop_collinear: bool = False) -> DataFrame:
    """`(fpr, tpr, threshold)` from the strictest threshold down, starting at (0, 0, +inf).

    `drop_collinear` removes inner points whose step equals the following step; neighbours are found by
    position with equi-joins.
    """
    down = _score_counts(scored, by).withColumn("_key", -F.col("score"))
    cum = running_totals(down, ["_key"], {"_tp": "pos", "_fp": "neg"}, by)
    # the last point of a group holds its totals; `cum` reads an already written table
    totals = cum.groupBy(*by).agg(F.max("_tp").alias("_P"), F.max("_fp").alias("_N"))
    start = totals.select(
        *by,
        F.lit(0).cast("bigint").alias("_tp"),
        F.lit(0).cast("bigint").alias("_fp"),
        F.lit(float("inf")).alias("threshold"),
    )
    points = cum.select(*by, "_tp", "_fp", F.col("score").cast("double").alias("threshold")).unionByName(start)
    if drop_collinear:
        points = _drop_collinear(points, by)
    if by:
        points = points.join(totals, list(by))
    else:
        n_pos, n_neg = totals.first()  # two numbers
        points = points.withColumns({"_P": F.lit(n_pos), "_N": F.lit(n_neg)})
    return points.select(
        *by, _ratio(F.col("_fp"), F.col("_N")).alias("fpr"), _ratio(F.col("_tp"), F.col("_P")).alias("tpr"), "threshold"
    )


def _drop_collinear(points: DataFrame, by: Sequence[str]) -> DataFrame:
    placed = global_rank(points, [*by, F.col("threshold").desc()], "_i")
    keys = [*by, "_i"]
    before = placed.select(*by, (F.col("_i") + 1).alias("_i"), F.col("_tp").alias("_tp0"), F.col("_fp").alias("_fp0"))
    after = placed.select(*by, (F.col("_i") - 1).alias("_i"), F.col("_tp").alias("_tp2"), F.col("_fp").alias("_fp2"))
    around = placed.join(before, keys, "left").join(after, keys, "left")
    bend = (
        F.col("_tp0").isNull()
        | F.col("_tp2").isNull()
        | (F.col("_tp") - F.col("_tp0") != F.col("_tp2") - F.col("_tp"))
        | (F.col("_fp") - F.col("_fp0") != F.col("_fp2") - F.col("_fp"))
    )
    return around.filter(bend).select(*by, "_tp", "_fp", "threshold")


def ranking_metrics(
    scored: DataFrame,
    ks: Sequence[int] = C.RANKING_K,
    by: Sequence[str] = (),
    keys: Sequence[str] = ("p1", "p2"),
    seed: int = 42,
) -> DataFrame:
    """`(k, hits, ndcg)`: recall within the k best scores and normalised discounted gain; ties by digest.

    Only the best max(k) rows of a group leave each map task; totals come from an ordinary aggregation.
    """
    order = [F.col("score").desc(), seeded_hash(seed, *keys)]
    top_k = max(ks)
    if by:
        ranked = scored.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        top = ranked.filter(F.col("_r") <= top_k)
    else:
        best = scored.orderBy(*order).limit(top_k)
        top = best.withColumn("_r", F.row_number().over(Window.orderBy(*order)))  # at most max(k) rows
    gains = top.select(*by, "_r", F.col("label").cast("double").alias("_gain"))
    wanted = F.array(*[F.lit(int(k)) for k in ks])
    per_k = (
        gains.select(*by, "_r", "_gain", F.explode(wanted).alias("k"))
        .filter(F.col("_r") <= F.col("k"))
        .groupBy(*by, "k")
        .agg(F.sum("_gain").alias("_hits"), F.sum(F.col("_gain") / F.log2(F.col("_r") + 1.0)).alias("_dcg"))
    )
    totals = scored.groupBy(*by).agg(F.sum("label").alias("_pos")).select(*by, "_pos", F.explode(wanted).alias("k"))
    ideal_n = F.least(F.col("k").cast("bigint"), F.col("_pos").cast("bigint"))
    ideal = F.aggregate(
        F.when(ideal_n > 0, F.sequence(F.lit(1).cast("bigint"), ideal_n)).otherwise(F.array().cast("array<bigint>")),
        F.lit(0.0),
        lambda acc, i: acc + 1.0 / F.log2(i + 1.0),
    )
    return totals.join(per_k, [*by, "k"], "left").select(
        *by, "k", _ratio(F.coalesce("_hits", F.lit(0.0)), F.col("_pos")).alias("hits"),
        F.coalesce(F.try_divide(F.col("_dcg"), ideal), F.lit(0.0)).alias("ndcg"),
    )


def hits_at_k(scored: DataFrame, ks: Sequence[int] = C.RANKING_K, **kwargs) -> DataFrame:
    return ranking_metrics(scored, ks, **kwargs).drop("ndcg")


def ndcg_at_k(scored: DataFrame, ks: Sequence[int] = C.RANKING_K, **kwargs) -> DataFrame:
    return ranking_metrics(scored, ks, **kwargs).drop("hits")


def fold_metrics(
    scored: DataFrame, by: Sequence[str] = ("model", "fold"), ks: Sequence[int] = C.RANKING_K, seed: int = 42
) -> DataFrame:
    """Long `(by..., metric, value)` with precision, recall, f1, auc, hits@k and ndcg@k."""
    keys = list(by)
    scored = materialise(scored)  # four branches read it
    basic = precision_recall_f1(scored, by).join(roc_auc(scored, by), keys)
    flat = metrics_long(basic, keys, ["precision", "recall", "f1", "auc"])
    ranked = ranking_metrics(scored, ks, by, seed=seed)
    at_k = ranked.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("hits_at_"), F.col("k")).alias("metric"), F.col("hits").alias("value")),
                F.struct(F.concat(F.lit("ndcg_at_"), F.col("k")).alias("metric"), F.col("ndcg").alias("value")),
            )
        ),
    )
    return flat.unionByName(at_k)


# --- aggregation over folds and comparison ----------------------------------


def aggregate_folds(metrics: DataFrame, by: Sequence[str] = ("model", "metric"), value: str = "value") -> DataFrame:
    """Mean and population std over folds ignoring NaN, and the fold values in fold order.

    The list holds one entry per fold, a number set by the caller of the cross-validation.
    """
    valid = F.when(~F.isnan(value), F.col(value))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("fold", value))), lambda s: s[value])
    return metrics.groupBy(*by).agg(
        F.avg(valid).alias("mean"), F.stddev_pop(valid).alias("std"), listed.alias("fold_values")
    )


def wilcoxon_signed_rank(paired: DataFrame, a: str = "a", b: str = "b", by: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """`(by..., n, w, p_value)`: signed-rank test of paired samples, two-sided.

    Zero differences are dropped, ties share mid-ranks, `w` is the smaller rank sum. Differences are reduced
    to one row per distinct size first. `exact` counts sign patterns and lists a group's ranks in one row, which is
    for few differences a group; `normal` is the approximation with tie correction, for any number. No difference
    at all gives p = 1.
    """
    if method not in ("exact", "normal"):
        raise ValueError(f"unknown method {method!r}")
    d = F.col(a).cast("double") - F.col(b).cast("double")
    sizes = (
        paired.select(*by, d.alias("_d"))
        .groupBy(*by, F.abs("_d").alias("_abs"))
        .agg(F.count_if(F.col("_d") > 0).alias("_up"), F.count_if(F.col("_d") < 0).alias("_down"))
    )
    moved = sizes.filter(F.col("_abs") > 0).withColumn("_c", F.col("_up") + F.col("_down"))
    ranked = running_totals(moved, ["_abs"], {"_cum": "_c"}, by)
    mid = F.col("_cum") - (F.col("_c") - 1) / 2.0
    ranked = ranked.withColumn("_mid", mid)
    sums = ranked.groupBy(*by).agg(
        F.sum("_c").alias("n"),
        F.sum(F.col("_up") * F.col("_mid")).alias("_plus"),
        F.sum(F.col("_down") * F.col("_mid")).alias("_minus"),
        F.sum(F.pow(F.col("_c").cast("double"), 3.0) - F.col("_c")).alias("_ties"),
        F.collect_list(
            F.when(F.lit(method == "exact"), F.struct((F.col("_mid") * 2).cast("int").alias("r"), F.col("_c").cast("int").alias("c")))
        ).alias("_ranks"),
    )
    whole = paired.select(*by).distinct().join(sums, list(by), "left") if by else sums
    w = F.least("_plus", "_minus")
    one = F.array(F.lit(1.0))
    doubled = F.flatten(F.transform("_ranks", lambda s: F.array_repeat(s["r"], s["c"])))
    # share of the sign patterns per doubled positive-rank sum: each rank shifts a copy of one half (counts would overflow)
    patterns = F.aggregate(
        doubled,
        one,
        lambda acc, r: F.zip_with(
            F.concat(acc, F.array_repeat(F.lit(0.0), r)), F.concat(F.array_repeat(F.lit(0.0), r), acc), lambda x, y: 0.5 * (x + y)
        ),
    )
    below = F.aggregate(F.slice(patterns, F.lit(1), (w * 2).cast("int") + 1), F.lit(0.0), lambda acc, v: acc + v)
    exact = F.least(F.lit(1.0), below * 2.0)
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0
    z = F.abs(w - n * (n + 1) / 4.0) / F.sqrt(variance)
    p = F.when(F.col("n").isNull() | (F.col("n") == 0), 1.0).otherwise(exact if method == "exact" else _two_sided_normal(z))
    return whole.select(
        *by, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce(w, F.lit(0.0)).alias("w"), p.alias("p_value")
    )


def _two_sided_normal(z: Column) -> Column:
    """erfc(z / sqrt 2) by a continued rational approximation (relative error below 1.2e-7)."""
    x = z / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    # fixed values: the published coefficients of the approximation, constant term first
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        power = power * t + F.lit(c)
    return F.least(F.lit(1.0), t * F.exp(-x * x + power))


def pearson(paired: DataFrame, a: str = "a", b: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """Pearson r; NaN when either side is constant."""
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    r = F.when(constant, F.lit(float("nan"))).otherwise(F.coalesce(F.corr(a, b), F.lit(float("nan"))))
    return paired.groupBy(*by).agg(r.alias("r"))


def compare_models(scores: DataFrame, main: str, alpha: float = C.SIGNIFICANCE_LEVEL) -> DataFrame:
    """Main model against every other on `(model, fold, score)`: W, p, minimum attainable p, r and verdict.

    Verdicts: `not comparable` (folds differ or are fewer than two), `same` scores, `different` (p below alpha),
    `not shown` (no difference shown).
    """
    valid = scores.filter(~F.isnan("score") & F.col("score").isNotNull())
    base = valid.filter(F.col("model") == main).select("fold", F.col("score").alias("a"))
    n_main = base.agg(F.count(F.lit(1))).first()[0]
    others = valid.filter(F.col("model") != main).select("model", "fold", F.col("score").alias("b"))
    paired = others.join(base, "fold", "left")
    close = F.abs(F.col("a") - F.col("b")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs("b")
    shape = paired.groupBy("model").agg(
        F.count(F.lit(1)).alias("_n"), F.count("a").alias("_matched"), F.coalesce(F.bool_and(close), F.lit(False)).alias("_same")
    )
    matched = paired.filter(F.col("a").isNotNull())
    tested = wilcoxon_signed_rank(matched, "a", "b", ["model"])
    corr = pearson(matched, "a", "b", ["model"])
    usable = (F.col("_n") == n_main) & (F.col("_matched") == n_main) & (F.col("_n") > 1)
    p = F.when(F.col("_same"), 1.0).otherwise(F.col("p_value"))
    verdict = (
        F.when(~usable, "not comparable").when(F.col("_same"), "same").when(p < alpha, "different").otherwise("not shown")
    )
    return (
        shape.join(tested, "model", "left")
        .join(corr, "model", "left")
        .select(
            "model",
            F.when(usable, F.col("w")).alias("w"),
            F.when(usable, p).alias("p_value"),
            F.when(usable, F.least(F.lit(1.0), F.pow(F.lit(2.0), 1 - F.col("n")))).alias("min_p"),
            F.when(usable, F.col("r")).alias("r"),
            verdict.alias("verdict"),
        )
    )


# --- report tables ----------------------------------------------------------


def summary_table(aggregated: DataFrame, metrics: Sequence[str], std_for: Sequence[str] = ("auc", "f1")) -> DataFrame:
    """One row per model: mean of every metric and std of a few, rounded to 4 places; absent values are 0."""
    columns = [F.round(F.coalesce(F.max(F.when(F.col("metric") == m, F.col("mean"))), F.lit(0.0)), 4).alias(m) for m in metrics]
    stds = [
        F.round(F.coalesce(F.max(F.when(F.col("metric") == m, F.col("std"))), F.lit(0.0)), 4).alias(f"{m}_std") for m in std_for
    ]
    return aggregated.groupBy("model").agg(*columns, *stds)


def metrics_long(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Unpivot metric columns to `(ids..., metric, value)`."""
    cast = wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(list(ids), list(metrics), "metric", "value")


def best_epoch(history: DataFrame, run: str = "run") -> DataFrame:
    """Last epoch with the largest validation value per run, with its test value."""
    picked = F.max_by(F.struct("epoch", "val", "test"), F.struct("val", "epoch"))
    return history.groupBy(run).agg(picked.alias("_b")).select(run, "_b.epoch", "_b.val", "_b.test")


def benchmark_summary(*results: DataFrame, prefix: str | None = None) -> DataFrame:
    """Union of result tables with differing columns (failed runs carry `error`), optionally one dataset."""
    merged = results[0]
    for table in results[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    return merged.filter(F.col("dataset").startswith(prefix)) if prefix else merged
