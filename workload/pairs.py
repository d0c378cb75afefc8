"""Pair filtering, features, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import ids, pairs as P, splits as S
from seqweave.session import materialise, scratch_path
from seqweave.sources.tables import read_id_map, write_id_map
from seqweave.streaming import stream_pairs
from workload.registry import cells, emb, fold_scores, headers, nodes, pair_lines, pairs, query, rounded, table  # noqa: F401

_MD5 = "md5(concat('42:', p1, ':', p2))"
_RANK = f"row_number() over (partition by label order by {_MD5}, p1, p2) - 1"
# vectors exist for documents that carry a quality label
_KNOWN = "(select e.* from emb e where e.key in (select cast(doc_id as varchar) from labels))"


def _known(spark, sf):
    wanted = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id")).distinct()
    return P.restrict_embeddings(emb(spark, sf), wanted)


@query("restricted_embeddings", f"select key, label from {_KNOWN}")
def restricted_embeddings(spark, sf):
    return _known(spark, sf).select("key", "label")


@query("pairs_with_vectors", f"select p1, p2, label from pairs where p1 in (select key from {_KNOWN}) and p2 in (select key from {_KNOWN})")
def pairs_with_vectors(spark, sf):
    return P.filter_pairs(pairs(spark, sf), _known(spark, sf))


@query(
    "pairs_with_vectors_report",
    f"""select n_pairs, n_kept, n_pairs - n_kept as n_removed from (select count(*) as n_pairs,
    count(*) filter (p1 in (select key from {_KNOWN}) and p2 in (select key from {_KNOWN})) as n_kept from pairs)""",
)
def pairs_with_vectors_report(spark, sf):
    return P.filter_pairs_report(pairs(spark, sf), _known(spark, sf))


_COMBINED = {
    "average": "(cast(a.vec[i] as double) + b.vec[i]) / 2",
    "hadamard": "cast(a.vec[i] as double) * b.vec[i]",
    "l1_distance": "abs(cast(a.vec[i] as double) - b.vec[i])",
    "l2_distance": "pow(cast(a.vec[i] as double) - b.vec[i], 2)",
}


def _feature_sql(cell: str, width: int) -> str:
    """Every feature of every pair enters two weighted sums per pair."""
    return f"""select p1, p2, label, n, round(total, 6) + 0.0 as total, round(weighted, 6) + 0.0 as weighted from (
    select p1, p2, p.label, count(*) as n, sum({cell}) as total, sum(({cell}) * (i % 13)) as weighted
    from pairs p join emb a on a.key = p1 join emb b on b.key = p2, unnest(range(1, {width + 1})) t(i) group by 1, 2, 3)"""


def _features(spark, sf, method):
    made = P.pair_features(pairs(spark, sf), emb(spark, sf).select("key", "vec"), method)
    weighted = F.aggregate(
        F.transform("features", lambda v, i: v * ((i + 1) % 13)), F.lit(0.0), lambda acc, v: acc + v
    )
    return made.select(
        "p1", "p2", "label", F.size("features").cast("bigint").alias("n"),
        rounded(F.aggregate("features", F.lit(0.0), lambda acc, v: acc + v)).alias("total"), rounded(weighted).alias("weighted"),
    )


@query("pair_features_concatenate", _feature_sql("cast(case when i <= 64 then a.vec[i] else b.vec[i - 64] end as double)", 128))
def pair_features_concatenate(spark, sf):
    return _features(spark, sf, "concatenate")


@query("pair_features_average", _feature_sql(_COMBINED["average"], 64))
def pair_features_average(spark, sf):
    return _features(spark, sf, "average")


@query("pair_features_hadamard", _feature_sql(_COMBINED["hadamard"], 64))
def pair_features_hadamard(spark, sf):
    return _features(spark, sf, "hadamard")


@query("pair_features_l1_distance", _feature_sql(_COMBINED["l1_distance"], 64))
def pair_features_l1_distance(spark, sf):
    return _features(spark, sf, "l1_distance")


@query("pair_features_l2_distance", _feature_sql(_COMBINED["l2_distance"], 64))
def pair_features_l2_distance(spark, sf):
    return _features(spark, sf, "l2_distance")


@query(
    "pair_features_audit",
    f"""with w as (select key, case when label = 3 then 32 when label = 4 then 0 else 64 end as d from {_KNOWN})
    select count(*) as n_pairs, count(*) filter (coalesce(a.d,0) = 0 or coalesce(b.d,0) = 0) as n_missing,
    count(*) filter (a.d > 0 and b.d > 0 and (a.d <> 64 or b.d <> 64)) as n_mismatched,
    count(*) filter (a.d = 64 and b.d = 64) as n_usable from pairs left join w a on a.key = p1 left join w b on b.key = p2""",
)
def pair_features_audit(spark, sf):
    label = F.col("label")
    ragged = F.when(label == 3, F.slice("vec", 1, 32)).when(label == 4, F.array().cast("array<float>")).otherwise(F.col("vec"))
    return P.pair_features_audit(pairs(spark, sf), _known(spark, sf).select("key", ragged.alias("vec")), 64)


@query(
    "pair_feature_widths",
    """select key, cast(len(vec) * 2 as int) as concatenate, cast(len(vec) as int) as average, cast(len(vec) as int) as hadamard,
    cast(len(vec) as int) as l1_distance, cast(len(vec) as int) as l2_distance, cast(len(vec) * 2 as int) as other from emb""",
)
def pair_feature_widths(spark, sf):
    width = F.size("vec")
    return emb(spark, sf).select(
        "key", *[(width * P.feature_dim(m, 1)).alias(m) for m in (*P.METHODS, "other")]
    )


# --- sampling and splits ----------------------------------------------------


@query("stratified_folds", f"select p1, p2, label, cast(({_RANK}) % 5 as int) as fold from pairs")
def stratified_folds(spark, sf):
    return S.stratified_kfold(pairs(spark, sf), 5)


@query(
    "stratified_holdout",
    f"""select p1, p2, label, case when rk < ceil(n * 0.2::double) then 'test' else 'train' end as split from
    (select p1, p2, label, {_RANK} as rk, count(*) over (partition by label) as n from pairs)""",
)
def stratified_holdout(spark, sf):
    return S.stratified_split(pairs(spark, sf), 0.2)


@query(
    "random_split",
    """select doc_id, case when rk < floor(0.1 * n) then 'train' when rk < 2 * floor(0.1 * n) then 'val' else 'test' end as split
    from (select doc_id, row_number() over (order by md5(concat('42:', cast(doc_id as varchar))), doc_id) - 1 as rk, count(*) over () as n from documents)""",
)
def random_split(spark, sf):
    return S.random_split(table(spark, sf, "documents").select("doc_id"), keys=["doc_id"])


@query(
    "exact_sample",
    f"select p1, p2, label from (select *, row_number() over (order by {_MD5}, p1, p2) as rk from pairs) where rk <= 5000",
)
def exact_sample(spark, sf):
    return S.sample_exact(pairs(spark, sf), 5000, ["p1", "p2"])


@query(
    "sample_of_copied_rows",
    """with c as (select l_returnflag, l_linestatus, l_linenumber from lineitem),
    r as (select *, row_number() over (order by md5(concat('42:', l_returnflag, ':', l_linestatus, ':', cast(l_linenumber as varchar))), l_linenumber) as rk from c)
    select l_returnflag, l_linestatus, l_linenumber, count(*) as n from r where rk <= 20000 group by 1, 2, 3""",
)
def sample_of_copied_rows(spark, sf):
    columns = ["l_returnflag", "l_linestatus", "l_linenumber"]
    drawn = S.sample_exact(table(spark, sf, "lineitem").select(*columns), 20000, columns)
    return drawn.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "balanced_negatives",
    f"""select p1, p2, label from pairs where label = 1 union all select p1, p2, label from
    (select *, row_number() over (order by {_MD5}, p1, p2) as rk from pairs where label = 0)
    where rk <= (select count(*) from pairs where label = 1)""",
)
def balanced_negatives(spark, sf):
    return S.balance_negatives(pairs(spark, sf))


@query(
    "capped_negatives",
    f"""select p1, p2, label from pairs where label = 1 union all select p1, p2, label from
    (select *, row_number() over (order by {_MD5}, p1, p2) as rk from pairs where label = 0) where rk <= 10000""",
)
def capped_negatives(spark, sf):
    return S.balance_negatives(pairs(spark, sf), 10000)


@query("shuffled_pairs", f"select p1, p2, label, row_number() over (order by {_MD5}, p1, p2) - 1 as place from pairs")
def shuffled_pairs(spark, sf):
    from seqweave.operators.ordering import global_rank

    # rows are numbered as they stand in the shuffled table, so another order gives other places
    mixed = materialise(S.shuffle(pairs(spark, sf), ["p1", "p2"]).withColumn("_at", F.monotonically_increasing_id()))
    return global_rank(mixed, ["_at"], "place").select("p1", "p2", "label", "place")


@query("class_weights", "select label, round(sum(count(*)) over () / (2.0::double * count(*)), 9) + 0.0 as weight from pairs group by label")
def class_weights(spark, sf):
    return S.class_weights(pairs(spark, sf)).select("label", rounded("weight", 9).alias("weight"))


@query(
    "class_distribution",
    f"""with f as (select label, cast(({_RANK}) % 5 as int) as fold from pairs)
    select k as fold, case when f.fold = k then 'val' else 'train' end as side, label, count(*) as n
    from f, unnest([0, 1, 2, 3, 4]) t(k) group by 1, 2, 3""",
)
def class_distribution(spark, sf):
    return S.class_distribution(S.stratified_kfold(pairs(spark, sf), 5), 5)


# --- files ------------------------------------------------------------------

_FIELDS = (
    "select trim(f[1]) as p1, trim(f[2]) as p2 from (select case when len(string_split(bare,',')) >= 2 then "
    "string_split(bare,',') else string_split(bare, chr(9)) end as f from (select replace(trim(line),'\"','') as bare from pair_lines))"
)


@query("streamed_pairs", f"select p1, p2, cast(1 as int) as label from ({_FIELDS}) where p1 <> '' and p2 <> ''")
def streamed_pairs(spark, sf):
    base = scratch_path(spark, "stream")
    pair_lines(spark, sf).write.text(f"{base}/in")
    stream_pairs(spark, f"{base}/in", f"{base}/out", f"{base}/progress", 1, files_per_batch=2)
    return spark.read.schema("p1 string, p2 string, label int").parquet(f"{base}/out")


@query("id_map_round_trip", "select original, mapped from (select regexp_extract(header,'^\\s*(\\S+)',1) as original, ord from headers) join (select ord, concat('M', cast(ord as varchar)) as mapped from headers) using (ord)")
def id_map_round_trip(spark, sf):
    from seqweave.functions.text import first_word

    path = scratch_path(spark, "idmap")
    made = headers(spark, sf).select(first_word("header").alias("original"), F.concat(F.lit("M"), F.col("ord").cast("string")).alias("mapped"))
    write_id_map(made, path)
    return read_id_map(spark, path)
