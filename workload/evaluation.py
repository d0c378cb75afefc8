"""Metrics, fold aggregation, comparison and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import evaluation as E
from seqweave.operators.ordering import group_rank
from seqweave.plans.evaluate import cross_validate, sanity_eval
from seqweave.session import scratch_path
from seqweave.sources import tables
from seqweave.sources.fasta import count_bad_records, read_fasta, read_fasta_dir, write_fasta
from workload.pairs import _RANK as RANK
from workload.registry import edges, emb, fold_scores, nodes, pairs, query, rounded, scored, seqs, table

_MD5 = "md5(concat('42:', p1, ':', p2))"


@query("thresholded", "select p1, p2, cast(score > 0.5 as int) as predicted from scored")
def thresholded(spark, sf):
    return scored(spark, sf).select("p1", "p2", E.threshold("score").alias("predicted"))


_PRF = """select fold, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from (select fold,
    cast(count(*) filter (score > 0.1::double and label = 1) as double) as tp, cast(count(*) filter (score > 0.1::double and label = 0) as double) as fp,
    cast(count(*) filter (score <= 0.1::double and label = 1) as double) as fn from scored group by fold)"""


@query("precision_recall_f1", f"select fold, round(precision, 9) + 0.0 as precision, round(recall, 9) + 0.0 as recall, round(f1, 9) + 0.0 as f1 from ({_PRF})")
def precision_recall_f1(spark, sf):
    m = E.precision_recall_f1(scored(spark, sf), ["fold"], 0.1)
    return m.select("fold", *[rounded(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _auc_sql(by: str) -> str:
    return f"""select {by}, coalesce(won / nullif(p * n, 0), 0.5) as auc from (select {by}, sum(pos * (below + neg * 0.5::double)) as won,
    cast(sum(pos) as double) as p, cast(sum(neg) as double) as n from (select *, coalesce(sum(neg) over (partition by {by} order by score
    rows between unbounded preceding and 1 preceding), 0) as below from (select {by}, score, count(*) filter (label = 1) as pos,
    count(*) filter (label = 0) as neg from scored group by {by}, score)) group by {by})"""


@query("roc_auc_per_fold", f"select fold, round(auc, 9) + 0.0 as auc from ({_auc_sql('fold')})")
def roc_auc_per_fold(spark, sf):
    return E.roc_auc(scored(spark, sf), ["fold"]).select("fold", rounded("auc", 9).alias("auc"))


@query("roc_auc", f"select round(auc, 9) + 0.0 as auc from (select auc from ({_auc_sql('one').replace('from scored', 'from (select *, 1 as one from scored)')}))")
def roc_auc(spark, sf):
    return E.roc_auc(scored(spark, sf)).select(rounded("auc", 9).alias("auc"))


@query(
    "roc_curve",
    """with c as (select score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from scored group by 1),
    k as (select score, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp, sum(pos) over () as p, sum(neg) over () as n from c)
    select round(cast(fp as double) / n, 9) + 0.0 as fpr, round(cast(tp as double) / p, 9) + 0.0 as tpr, score as threshold from k
    union all select 0.0, 0.0, 'infinity'::double""",
)
def roc_curve(spark, sf):
    return E.roc_curve(scored(spark, sf)).select(rounded("fpr", 9).alias("fpr"), rounded("tpr", 9).alias("tpr"), "threshold")


@query(
    "roc_curve_bends",
    """with c as (select score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from scored group by 1),
    k as (select score, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp from c union all select 'infinity'::double, 0, 0),
    t as (select max(tp) as p, max(fp) as n from k),
    a as (select score, tp, fp, tp - lag(tp) over w as t1, lead(tp) over w - tp as t2, fp - lag(fp) over w as f1, lead(fp) over w - fp as f2 from k window w as (order by score desc))
    select round(cast(fp as double) / n, 9) + 0.0 as fpr, round(cast(tp as double) / p, 9) + 0.0 as tpr, score as threshold from a, t
    where t1 is null or t2 is null or t1 <> t2 or f1 <> f2""",
)
def roc_curve_bends(spark, sf):
    curve = E.roc_curve(scored(spark, sf), drop_collinear=True)
    return curve.select(rounded("fpr", 9).alias("fpr"), rounded("tpr", 9).alias("tpr"), "threshold")


def _rank_sql(by: str) -> str:
    return f"""with r as (select {by}, label, row_number() over (partition by {by} order by score desc, {_MD5}) as r from (select *, 1 as one from scored)),
    ks as (select unnest([50, 100]) as k), d as (select {by}, k, sum(label) filter (r <= k) as hits, sum(label / log2(r + 1)) filter (r <= k) as dcg, sum(label) as pos
      from r, ks group by 1, 2),
    i as (select {by}, k, (select sum(1 / log2(j + 1)) from unnest(range(1, cast(least(k, pos) + 1 as bigint))) t(j)) as idcg from d)
    select d.{by}, cast(d.k as int) as k, round(coalesce(hits / nullif(cast(pos as double), 0), 0), 9) + 0.0 as hits, round(coalesce(dcg / idcg, 0), 9) + 0.0 as ndcg
    from d join i on i.{by} = d.{by} and i.k = d.k"""


@query("ranking_metrics_per_fold", _rank_sql("fold"))
def ranking_metrics_per_fold(spark, sf):
    m = E.ranking_metrics(scored(spark, sf), (50, 100), ["fold"])
    return m.select("fold", "k", rounded("hits", 9).alias("hits"), rounded("ndcg", 9).alias("ndcg"))


@query("hits_at_k", f"select k, hits from ({_rank_sql('one')})")
def hits_at_k(spark, sf):
    return E.hits_at_k(scored(spark, sf)).select("k", rounded("hits", 9).alias("hits"))


@query("ndcg_at_k", f"select k, ndcg from ({_rank_sql('one')})")
def ndcg_at_k(spark, sf):
    return E.ndcg_at_k(scored(spark, sf)).select("k", rounded("ndcg", 9).alias("ndcg"))


@query(
    "argmax_accuracy",
    """select round(avg(case when list_position(embedding, list_max(embedding)) - 1 = label then 1.0::double else 0.0 end), 9) + 0.0 as accuracy from embeddings""",
)
def argmax_accuracy(spark, sf):
    return E.accuracy(emb(spark, sf)).select(rounded("accuracy", 9).alias("accuracy"))


@query(
    "score_summary",
    "select fold, min(score) as min_score, max(score) as max_score, round(avg(score), 9) + 0.0 as mean_score from scored group by fold",
)
def score_summary(spark, sf):
    s = E.score_summary(scored(spark, sf), ["fold"])
    return s.select("fold", "min_score", "max_score", rounded("mean_score", 9).alias("mean_score"))


@query(
    "single_class_groups",
    """select p1, cast(0 as double) as precision, cast(0 as double) as recall, cast(0 as double) as f1, cast(0.5 as double) as auc
    from pairs group by p1 having min(label) = max(label)""",
)
def single_class_groups(spark, sf):
    return E.single_class_guard(pairs(spark, sf), ["p1"])


@query(
    "fold_metrics",
    f"""with p as ({_PRF.replace('0.1::double', '0.5::double')}), a as ({_auc_sql('fold')}), r as ({_rank_sql('fold')}),
    l as (select fold, 'precision' as metric, precision as value from p union all select fold, 'recall', recall from p union all select fold, 'f1', f1 from p
    union all select fold, 'auc', auc from a union all select fold, concat('hits_at_', cast(k as varchar)), hits from r union all select fold, concat('ndcg_at_', cast(k as varchar)), ndcg from r)
    select 'dot' as model, fold, metric, round(value, 9) + 0.0 as value from l""",
)
def fold_metrics(spark, sf):
    s = scored(spark, sf).withColumn("model", F.lit("dot"))
    return E.fold_metrics(s).select("model", "fold", "metric", rounded("value", 9).alias("value"))


_WITH_NAN = "(select model, fold, case when fold = 3 and model = 'm2' then 'nan'::double else score end as value from fold_scores)"


@query(
    "aggregated_folds",
    f"""select model, round(avg(value) filter (not isnan(value)), 6) + 0.0 as mean, round(stddev_pop(value) filter (not isnan(value)), 6) + 0.0 as std,
    array_to_string(list(case when isnan(value) then 'NaN' else cast(cast(round(value * 1000) as bigint) as varchar) end order by fold), ',') as fold_values from {_WITH_NAN} group by model""",
)
def aggregated_folds(spark, sf):
    broken = F.when((F.col("fold") == 3) & (F.col("model") == "m2"), F.lit(float("nan"))).otherwise(F.col("score"))
    agg = E.aggregate_folds(fold_scores(spark, sf).select("model", "fold", broken.alias("value")), ["model"])
    listed = F.transform("fold_values", lambda v: F.when(F.isnan(v), "NaN").otherwise(F.round(v * 1000).cast("bigint").cast("string")))
    return agg.select("model", rounded("mean").alias("mean"), rounded("std").alias("std"), F.array_join(listed, ",").alias("fold_values"))


_PAIRED = "(select o_custkey as grp, round(o_totalprice / 1000) as a, round(o_totalprice / 1000) + (o_orderkey % 7) - 3 as b from orders)"
_RANKED = f"""with d as (select grp, a - b as d from {_PAIRED} where a <> b),
    t as (select grp, abs(d) as ad, d, rank() over (partition by grp order by abs(d)) + (count(*) over (partition by grp, abs(d)) - 1) / 2.0::double as r from d),
    g as (select grp, count(*) as n, sum(case when d > 0 then r else 0 end) as wp, sum(case when d < 0 then r else 0 end) as wm from t group by 1)"""


@query(
    "signed_rank_statistic",
    f"""{_RANKED} select p.grp, coalesce(n, 0) as n, round(coalesce(least(wp, wm), 0), 6) + 0.0 as w from (select distinct grp from {_PAIRED}) p left join g on g.grp = p.grp""",
)
def signed_rank_statistic(spark, sf):
    base = F.round(F.col("o_totalprice") / 1000)
    paired = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("grp"), base.alias("a"), (base + (F.col("o_orderkey") % 7) - 3).alias("b")
    )
    return E.wilcoxon_signed_rank(paired, by=["grp"], method="normal").select("grp", "n", rounded("w").alias("w"))


@query(
    "pearson_per_model",
    """select f.model, round(corr(m.score, f.score), 6) + 0.0 as r from fold_scores f join fold_scores m on m.fold = f.fold and m.model = 'm0' group by f.model""",
)
def pearson_per_model(spark, sf):
    s = fold_scores(spark, sf)
    main = s.filter(F.col("model") == "m0").select("fold", F.col("score").alias("a"))
    return E.pearson(s.join(main, "fold"), "a", "score", ["model"]).select("model", rounded("r").alias("r"))


@query(
    "model_comparison",
    """with p as (select f.model, m.score - f.score as d from fold_scores f join fold_scores m on m.fold = f.fold and m.model = 'm0' where f.model <> 'm0'),
    t as (select model, d, rank() over (partition by model order by abs(d)) as r from p where d <> 0),
    g as (select model, least(sum(case when d > 0 then r else 0 end), sum(case when d < 0 then r else 0 end)) as w, count(*) as n from t group by 1),
    bits as (select unnest(range(0, 32)) as m), sums as (select m, list_sum([case when (m >> (j - 1)) & 1 = 1 then j else 0 end for j in range(1, 6)]) as s from bits),
    c as (select f.model, corr(m.score, f.score) as r from fold_scores f join fold_scores m on m.fold = f.fold and m.model = 'm0' where f.model <> 'm0' group by 1)
    select g.model, round(cast(w as double), 6) + 0.0 as w, round(least(1.0, 2.0 * (select count(*) from sums where s <= w) / 32.0::double), 9) + 0.0 as p_value, 0.0625::double as min_p,
    round(c.r, 6) + 0.0 as r, 'not shown' as verdict from g join c on c.model = g.model""",
)
def model_comparison(spark, sf):
    c = E.compare_models(fold_scores(spark, sf), "m0")
    return c.select("model", rounded("w").alias("w"), rounded("p_value", 9).alias("p_value"), "min_p", rounded("r").alias("r"), "verdict")


_METRICS = "(select model, metric, avg(v) as mean, stddev_pop(v) as std from (select model, fold, unnest(['auc','f1','recall']) as metric, unnest([score / 100, score / 50, score / 25]) as v from fold_scores) group by 1, 2)"


def _wide(spark, sf):
    return fold_scores(spark, sf).select(
        "model", "fold", (F.col("score") / 100).alias("auc"), (F.col("score") / 50).alias("f1"), (F.col("score") / 25).alias("recall")
    )


@query(
    "summary_table",
    f"""select model, round(max(mean) filter (metric = 'auc'), 4) + 0.0 as auc, round(max(mean) filter (metric = 'f1'), 4) + 0.0 as f1, cast(0 as double) as precision,
    round(max(mean) filter (metric = 'recall'), 4) + 0.0 as recall, round(max(std) filter (metric = 'auc'), 4) + 0.0 as auc_std, round(max(std) filter (metric = 'f1'), 4) + 0.0 as f1_std from {_METRICS} group by 1""",
)
def summary_table(spark, sf):
    long = E.metrics_long(_wide(spark, sf), ["model", "fold"], ["auc", "f1", "recall"])
    return E.summary_table(E.aggregate_folds(long), ["auc", "f1", "precision", "recall"])


@query(
    "metrics_long",
    "select model, fold, unnest(['auc','f1','recall']) as metric, round(unnest([score / 100, score / 50, score / 25]), 6) + 0.0 as value from fold_scores",
)
def metrics_long(spark, sf):
    long = E.metrics_long(_wide(spark, sf), ["model", "fold"], ["auc", "f1", "recall"])
    return long.select("model", "fold", "metric", rounded("value").alias("value"))


@query("best_epoch", "select run, arg_max(epoch, (val, epoch)) as epoch, max(val) as val, arg_max(test, (val, epoch)) as test from history group by run")
def best_epoch(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    history = group_rank(events, ["user_id"], ["ts", "event_id"], "_r").select(
        F.col("user_id").alias("run"), (F.col("_r") + 1).alias("epoch"), F.col("value").alias("val"), (F.col("value") / 2).alias("test")
    )
    return E.best_epoch(history)


@query(
    "benchmark_summary",
    """select dataset, model, val, error from (select concat('c', cast(c_nationkey as varchar)) as dataset, cast(c_custkey as varchar) as model, c_acctbal as val, cast(null as varchar) as error from customer
    union all select concat('c', cast(s_nationkey as varchar)), cast(s_suppkey as varchar), null, 'failed' from supplier) where starts_with(dataset, 'c1')""",
)
def benchmark_summary(spark, sf):
    good = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("dataset"), F.col("c_custkey").cast("string").alias("model"), F.col("c_acctbal").alias("val")
    )
    failed = table(spark, sf, "supplier").select(
        F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("dataset"), F.col("s_suppkey").cast("string").alias("model"), F.lit("failed").alias("error")
    )
    return E.benchmark_summary(good, failed, prefix="c1")


# --- whole evaluations ------------------------------------------------------


@query("pair_classifier_scores")
def pair_classifier_scores(spark, sf):
    from seqweave.operators import pairs as P
    from seqweave.operators import splits as S

    data = P.pair_features(pairs(spark, sf), emb(spark, sf).select("key", "vec"), "hadamard", keep=True)
    model = E.fit_pair_classifier(data, S.class_weights(data))
    return E.predict_proba(model, data).select("p1", "p2", "label", rounded("score").alias("score"))


@query("cross_validation")
def cross_validation(spark, sf):
    e = emb(spark, sf).select("key", "vec")
    metrics, _ = cross_validate(pairs(spark, sf), {"vectors": e}, method="hadamard")
    return metrics.select("model", "fold", "metric", rounded("value").alias("value"))


@query(
    "fold_fits",
    f"""with f as (select label, cast(({RANK}) % 5 as int) as fold from pairs), k as (select unnest(range(5)) as fold),
    c as (select k.fold, count(*) as n_train, count(*) filter (label = 1) as pos from k join f on f.fold <> k.fold group by 1)
    select fold, n_train, round(n_train / (2.0 * (n_train - pos)), 9) + 0.0 as w_neg, round(n_train / (2.0 * pos), 9) + 0.0 as w_pos, true as flat, true as below_chance from c""",
)
def fold_fits(spark, sf):
    """The jointly fitted models of five folds: training rows, class weights, a gradient of zero, a loss below that of guessing."""
    from seqweave.operators import pairs as P
    from seqweave.operators import splits as S
    from seqweave.operators.fold_models import fit_fold_classifiers

    data = P.pair_features(S.stratified_kfold(pairs(spark, sf)), emb(spark, sf).select("key", "vec"), "hadamard", keep=True)
    models = fit_fold_classifiers(data, 5, tol=1e-5)
    fits = [(j, *models.class_weights[j], models.gradients[j] <= 1e-5, models.losses[j] < 0.69315) for j in range(5)]
    train = S.class_distribution(data).filter("side = 'train'").groupBy("fold").agg(F.sum("n").alias("n_train"))
    return spark.createDataFrame(fits, "fold int, w_neg double, w_pos double, flat boolean, below_chance boolean").join(train, "fold").select(
        "fold", "n_train", rounded("w_neg", 9).alias("w_neg"), rounded("w_pos", 9).alias("w_pos"), "flat", "below_chance"
    )


@query("single_split_check")
def single_split_check(spark, sf):
    return sanity_eval(pairs(spark, sf), emb(spark, sf).select("key", "vec"))


# --- files ------------------------------------------------------------------


@query("fasta_records", "select id, md5(seq) as digest, cast(length(seq) as bigint) as n from seqs where length(seq) > 0")
def fasta_records(spark, sf):
    path = scratch_path(spark, "fasta")
    write_fasta(seqs(spark, sf), path)
    records = read_fasta(spark, path)
    return records.select("id", F.md5("seq").alias("digest"), F.length("seq").cast("bigint").alias("n"))


@query("fasta_folder", "select id, cast(length(seq) as bigint) as n from seqs where length(seq) > 0")
def fasta_folder(spark, sf):
    path = scratch_path(spark, "fasta")
    write_fasta(seqs(spark, sf), f"{path}/part.fasta")
    return read_fasta_dir(spark, f"{path}/part.fasta").select("id", F.length("seq").cast("bigint").alias("n"))


@query("fasta_bad_records", "select count(*) as records, count(*) filter (length(seq) = 0) as bad_records from seqs")
def fasta_bad_records(spark, sf):
    path = scratch_path(spark, "fasta")
    write_fasta(seqs(spark, sf), path)
    return count_bad_records(spark, path)


@query("edge_table_round_trip", "select src, dst, w from edges")
def edge_table_round_trip(spark, sf):
    path = scratch_path(spark, "edges")
    tables.write_edges(edges(spark, sf), path)
    return tables.read_edges(spark, path)


@query(
    "transition_text",
    "select l_partkey as src, l_suppkey as dst, count(*) as w from lineitem where l_linenumber <> 4 group by 1, 2",
)
def transition_text(spark, sf):
    path = scratch_path(spark, "transitions")
    line = F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    broken = F.concat(F.lit("x"), line)
    raw = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 4, broken).otherwise(line).alias("value"))
    raw.write.text(path)
    return tables.read_transition_text(spark, path)


@query("vocabulary_names", "select distinct p_name as ngram from part")
def vocabulary_names(spark, sf):
    from seqweave.operators.ngrams import assign_ids

    path = scratch_path(spark, "vocabulary")
    tables.write_vocabulary(assign_ids(table(spark, sf, "part").select(F.col("p_name").alias("ngram")).distinct()), path)
    return tables.read_vocabulary(spark, path, ["ngram"])


@query("node_vector_folders", "select 'wide' as dataset, 'raw' as model, 'u' as variant, cast(64 as int) as dim, count(*) as n from nodes")
def node_vector_folders(spark, sf):
    path = scratch_path(spark, "node-vectors")
    vectors = nodes(spark, sf).join(emb(spark, sf).select(F.col("key").cast("bigint").alias("id"), "vec"), "id")
    tables.write_node_embeddings(vectors, path, "raw", "wide", "u")
    stored = spark.read.parquet(path)
    return stored.groupBy("dataset", "model", "variant", "dim").agg(F.count(F.lit(1)).alias("n"))


@query("results_csv", "select o_orderpriority as dataset, count(*) as n, round(avg(o_totalprice), 4) + 0.0 as val from orders group by 1")
def results_csv(spark, sf):
    path = scratch_path(spark, "results")
    summary = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("o_totalprice"), 4).alias("val")
    )
    tables.write_results_csv(summary, path)
    return tables.read_results_csv(spark, path, "dataset string, n bigint, val double")


@query("run_metrics_log", "select 'r1' as run_id, model, fold, round(score, 6) + 0.0 as value from fold_scores where fold <> 2")
def run_metrics_log(spark, sf):
    path = scratch_path(spark, "metrics")
    broken = F.when(F.col("fold") == 2, F.lit(float("nan"))).otherwise(F.col("score"))
    tables.log_run_metrics(fold_scores(spark, sf).select("model", "fold", broken.alias("value")), path, "r1")
    return spark.read.parquet(path).select("run_id", "model", "fold", rounded("value").alias("value"))
