"""Pooling, token vectors, reduction and quality checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqweave.functions import vectors as V
from seqweave.operators import ngrams, pooling, projection, reduction
from seqweave.operators.ordering import group_rank
from seqweave.session import materialise
from workload.registry import cells, emb, features, query, rounded, seqs, table

# a small vector per n-gram, made from its letters by rule
_GRAM_VEC = "((ascii({0}[1]) * (i + 1) + ascii({0}[2]) * (i + 2)) % 23) / 8.0"
_DIMS = "unnest(range(0, 8)) t(i)"


def _gram_vectors(grams):
    a, b = F.ascii(F.substring("ngram", 1, 1)), F.ascii(F.substring("ngram", 2, 1))
    return grams.select("ngram", F.array(*[((a * (i + 1) + b * (i + 2)) % 23) / 8.0 for i in range(8)]).alias("vec"))


def _rows(spark, sf):
    # position is irrelevant for pooling; the event id orders rows
    return table(spark, sf, "events").select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("pos"),
        F.array(F.col("value"), F.col("value") * F.col("value") / 100, (F.col("event_id") % 13).cast("double")).alias("vec"),
    )


def _pool_sql(fn: str) -> str:
    return f"""select key, cast(i as bigint) as i, round({fn}(vec[i]), 6) + 0.0 as val from
    (select user_id as key, [value, value*value/100, cast(event_id % 13 as double)] as vec from events), unnest(range(1,4)) t(i) group by 1, 2"""


@query("pooled_rows_mean", _pool_sql("avg"))
def pooled_rows_mean(spark, sf):
    return cells(pooling.pool_rows(_rows(spark, sf), "mean"), "key")


@query("pooled_rows_sum", _pool_sql("sum"))
def pooled_rows_sum(spark, sf):
    return cells(pooling.pool_rows(_rows(spark, sf), "sum"), "key")


@query("pooled_rows_max", _pool_sql("max"))
def pooled_rows_max(spark, sf):
    return cells(pooling.pool_rows(_rows(spark, sf), "max"), "key")


@query(
    "pooled_rows_with_empty_keys",
    f"""select k.key, k.i, coalesce(p.val, 0.0) as val from
    (select c_custkey as key, cast(unnest(range(1, 4)) as bigint) as i from customer) k
    left join ({_pool_sql('avg')}) p on p.key = k.key and p.i = k.i""",
)
def pooled_rows_with_empty_keys(spark, sf):
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return cells(pooling.pool_rows(_rows(spark, sf), "mean", keys, 3), "key")


@query(
    "pooled_ngrams_by_occurrence",
    f"""with c as (select id, g2, count(*) as n from grams where g2 is not null and g2[1] <> 'Q' group by 1, 2)
    select id, cast(i + 1 as bigint) as i, round(sum(n * {_GRAM_VEC.format('g2')}) / sum(n), 6) + 0.0 as val from c, {_DIMS} group by 1, 2""",
)
def pooled_ngrams_by_occurrence(spark, sf):
    records = seqs(spark, sf)
    known = ngrams.distinct_ngrams(records, 2).filter(~F.col("ngram").startswith("Q"))
    return cells(pooling.pool_ngrams(records, _gram_vectors(known), 2, "occurrence", dim=8), "id")


@query(
    "pooled_ngrams_distinct",
    f"""with c as (select distinct id, g2 from grams where g2 is not null)
    select id, cast(i + 1 as bigint) as i, round(avg({_GRAM_VEC.format('g2')}), 6) + 0.0 as val from c, {_DIMS} group by 1, 2""",
)
def pooled_ngrams_distinct(spark, sf):
    records = seqs(spark, sf)
    vectors = _gram_vectors(ngrams.distinct_ngrams(records, 2))
    return cells(pooling.pool_ngrams(pooling.latest_records(records), vectors, 2, "distinct", dim=8), "id")


def _token_table(spark, sf):
    """`(token, vec)` for the letters that occur, except two."""
    letters = ngrams.distinct_ngrams(seqs(spark, sf), 1).filter(~F.col("ngram").isin("J", "W"))
    code = F.ascii("ngram")
    return letters.select(F.col("ngram").alias("token"), F.array(*[(code * (i + 2)) % 19 / 4.0 for i in range(8)]).alias("vec"))


_TOKEN_VEC = "((ascii(c) * (i + 2)) % 19) / 4.0"


@query(
    "token_vector_rows",
    f"""select id, count(*) as n, cast(sum(pos) as bigint) as pos_sum, round(sum((pos % 7) * v), 6) + 0.0 as total from
    (select id, pos, list_sum([((ascii(c) * (i + 2)) % 19) / 4.0 for i in range(0, 8)]) as v from letters where c not in ('J','W')) group by 1""",
)
def token_vector_rows(spark, sf):
    rows = pooling.lookup_token_vectors(seqs(spark, sf), _token_table(spark, sf))
    return rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("pos").alias("pos_sum"),
        rounded(F.sum((F.col("pos") % 7) * V.total("vec"))).alias("total"),
    )


@query(
    "token_embedded_sequences",
    f"""select s.id, cast(t.i + 1 as bigint) as i, round(coalesce(m.v, 0.0), 6) + 0.0 as val from seqs s cross join unnest(range(0, 8)) t(i)
    left join (select id, i, avg({_TOKEN_VEC}) as v from letters, {_DIMS} where c not in ('J','W') group by 1, 2) m on m.id = s.id and m.i = t.i""",
)
def token_embedded_sequences(spark, sf):
    return cells(pooling.token_embed_sequences(seqs(spark, sf), _token_table(spark, sf), dim=8), "id")


@query(
    "model_rows_sliced",
    """with r as (select user_id as key, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, value from events),
    l as (select c_custkey as key, c_nationkey + 5 as length from customer)
    select key, pos - 1 as pos, round(value, 6) + 0.0 as val from r join l using (key) where pos >= 1 and pos < length + 1""",
)
def model_rows_sliced(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    rows = group_rank(events, ["user_id"], ["ts", "event_id"], "pos").select(
        F.col("user_id").alias("key"), "pos", F.array("value").alias("vec")
    )
    lengths = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") + 5).alias("length"))
    return pooling.slice_model_rows(rows, lengths).select("key", "pos", rounded(F.col("vec")[0]).alias("val"))


@query(
    "trained_token_set",
    "select c as token, cast(16 as bigint) as dim from letters group by c having count(*) >= 5",
)
def trained_token_set(spark, sf):
    """Tokens that are frequent enough have a vector of the width asked for."""
    trained = pooling.train_token_embeddings(seqs(spark, sf), dim=16, epochs=1, min_count=5)
    return trained.select("token", F.size("vec").cast("bigint").alias("dim"))


@query("trained_token_vectors")
def trained_token_vectors(spark, sf):
    return pooling.train_token_embeddings(seqs(spark, sf), dim=16, epochs=1)


def _composition_model():
    """Stand-in for a sequence model: one row per token plus a leading marker row, 3 numbers each."""

    def run(texts: list[str]) -> list[np.ndarray]:
        out = []
        for spaced in texts:
            codes = np.frombuffer(spaced.encode("utf-32-le"), dtype=np.uint32)[::2].astype(np.float32)
            rows = np.stack([codes % 5, codes % 7, codes % 11], axis=1)
            out.append(np.vstack([np.zeros((1, 3), dtype=np.float32), rows]))
        return out

    return run


@query(
    "batched_inference_pooled",
    """with x as (select id, ascii(translate(c,'UZOB','XXXX')) as a from letters)
    select id, cast(i as bigint) as i, round(avg([a % 5, a % 7, a % 11][i]), 6) + 0.0 as val from x, unnest(range(1, 4)) t(i) group by 1, 2""",
)
def batched_inference_pooled(spark, sf):
    records = seqs(spark, sf)
    rows = pooling.batch_infer(records, _composition_model, max_length=None)
    lengths = records.select("id", F.length("seq").alias("length"))
    kept = pooling.slice_model_rows(rows, lengths, skip_first=True, key="id")
    return cells(pooling.pool_rows(kept, "mean", dim=3, key="id"), "id")


# --- reduction --------------------------------------------------------------


@query(
    "standardized_vectors",
    """with s as (select i, avg(v) as m, stddev_pop(v) as sd from xl group by 1)
    select cast(id as varchar) as key, xl.i, round((v - m) / case when sd > 0 then sd else 1 end, 6) + 0.0 as val from xl join s on s.i = xl.i""",
)
def standardized_vectors(spark, sf):
    return cells(reduction.standardize(emb(spark, sf)), "key")


_SCALED = (
    "(select id, xl.i, (v - m) / case when sd > 0 then sd else 1 end as v from xl join "
    "(select i, avg(v) as m, stddev_pop(v) as sd from xl group by 1) s on s.i = xl.i)"
)


@query(
    "pca_keeps_lengths",
    f"select cast(id as varchar) as key, cast(64 as bigint) as dim, round(sum(v * v), 4) + 0.0 as squared from {_SCALED} group by id",
)
def pca_keeps_lengths(spark, sf):
    """A rotation to as many components as dimensions keeps every standardised vector's length."""
    turned = reduction.pca(emb(spark, sf), 64).vectors
    squared = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    return turned.select("key", F.size("vec").cast("bigint").alias("dim"), rounded(squared, 4).alias("squared"))


@query(
    "pca_components_uncorrelated",
    "select cast(i as bigint) as i, cast(j as bigint) as j, 0.0::double as covariance from unnest(range(1, 9)) a(i), unnest(range(1, 9)) b(j) where i < j",
)
def pca_components_uncorrelated(spark, sf):
    """Covariance of each two components of the scores, of mean zero."""
    scores = reduction.pca(emb(spark, sf), 8).vectors.select(F.posexplode("vec").alias("i", "v"), "key")
    a, b = (scores.select("key", F.col("i").alias(n), F.col("v").alias(f"v{n}")) for n in "ij")
    both = a.join(b, "key").filter("i < j").groupBy("i", "j").agg(F.avg(F.col("vi") * F.col("vj")).alias("c"))
    return both.select((F.col("i") + 1).cast("bigint").alias("i"), (F.col("j") + 1).cast("bigint").alias("j"), rounded("c", 5).alias("covariance"))


@query("pca_vectors")
def pca_vectors(spark, sf):
    return cells(reduction.pca(emb(spark, sf), 16).vectors, "key")


@query(
    "pca_of_wide_vectors",
    f"""with n as (select count(*) as rows from embeddings) select i, j, true as as_expected, round(4096 * rows / (rows - 1.0), 6) + 0.0 as total_variance
    from n, unnest(range(8)) a(i), unnest(range(8)) b(j) where i <= j""",
)
def pca_of_wide_vectors(spark, sf):
    """Eight components of the 4 096 products of two dimensions: scores have falling variances and no covariances,
    and their variances are the explained share of the total."""
    products = F.flatten(F.transform("vec", lambda a: F.transform(F.col("vec"), lambda b: (a * b).cast("double"))))
    found = reduction.pca(emb(spark, sf).select("key", products.alias("vec")), 8)
    scores = materialise(found.vectors)
    cells_ = [F.covar_samp(F.col("vec")[i], F.col("vec")[j]).alias(f"c{i}_{j}") for i in range(8) for j in range(i, 8)]
    c = scores.agg(F.count(F.lit(1)).alias("rows"), *cells_).first()  # one row
    total = 4096 * c["rows"] / (c["rows"] - 1.0)
    share = abs(sum(c[f"c{i}_{i}"] for i in range(8)) / total - found.explained) < 1e-6

    def right(i: int, j: int) -> bool:
        falling = i == 0 or c[f"c{i}_{i}"] <= c[f"c{i - 1}_{i - 1}"] + 1e-9
        return share and (falling and c[f"c{i}_{i}"] > 0 if i == j else abs(c[f"c{i}_{j}"]) < 1e-5 * c["c0_0"])

    rows = [(i, j, bool(right(i, j)), total) for i in range(8) for j in range(i, 8)]
    checked = spark.createDataFrame(rows, "i long, j long, as_expected boolean, total_variance double")
    return checked.withColumn("total_variance", rounded("total_variance"))


@query("pca_explained_variance")
def pca_explained_variance(spark, sf):
    result = reduction.pca(emb(spark, sf), 16)
    return result.vectors.limit(1).select(rounded(F.lit(reduction.explained_variance(result))).alias("explained"))


@query("pca_if_larger", "select key, cast(i as bigint) as i, round(cast(vec[i] as double), 6) + 0.0 as val from emb, unnest(range(1, 65)) t(i)")
def pca_if_larger(spark, sf):
    return cells(reduction.pca_if_larger(emb(spark, sf), 64), "key")


@query("pca_applied_if_larger", "select key, cast(16 as bigint) as dim from emb")
def pca_applied_if_larger(spark, sf):
    return reduction.pca_if_larger(emb(spark, sf), 16).select("key", F.size("vec").cast("bigint").alias("dim"))


_HOLES = "case when (id * 7 + i) % 11 = 0 then null else v end"


def _with_holes(spark, sf):
    x = features(spark, sf)
    nan = F.lit(float("nan"))
    return x.select(
        F.col("id").alias("key"),
        F.transform("vec", lambda v, i: F.when((F.col("id") * 7 + i + 1) % 11 == 0, nan).otherwise(v)).alias("vec"),
    )


@query(
    "imputed_vectors",
    f"""with h as (select id, i, {_HOLES} as v from xl), m as (select i, avg(v) as m from h group by 1)
    select id as key, h.i, round(coalesce(v, m), 6) + 0.0 as val from h join m on m.i = h.i""",
)
def imputed_vectors(spark, sf):
    return cells(reduction.impute_mean(_with_holes(spark, sf)), "key")


@query("global_pca_vectors")
def global_pca_vectors(spark, sf):
    return cells(reduction.global_pca(_with_holes(spark, sf), 8).vectors, "key")


@query(
    "vector_widths",
    """select conv_id as key, cast(sum(length(text)) % 5 + 1 as int) as dim, cast((select sum(length(text)) % 5 + 1 from conversations
    where conv_id = (select min(conv_id) from conversations)) as int) as expected,
    sum(length(text)) % 5 + 1 <> (select sum(length(text)) % 5 + 1 from conversations where conv_id = (select min(conv_id) from conversations)) as mismatch
    from conversations group by conv_id""",
)
def vector_widths(spark, sf):
    ragged = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("key")).agg((F.sum(F.length("text")) % 5 + 1).cast("int").alias("n"))
    nested = ragged.select("key", F.array(F.array_repeat(F.lit(1.0), F.col("n"))).alias("vec"))
    return reduction.flatten_and_check_dims(nested)


@query(
    "vector_quality_report",
    """with q as (select vec_id, case when label = 0 then 0 else 64 end as dim, label in (3, 4) as has_nan, label in (4, 5) as has_inf from embeddings)
    select cast(dim as int) as dim, count(*) as n, count(*) filter (has_nan) as n_nan, count(*) filter (has_inf) as n_inf,
    count(*) filter (dim = 0) as n_empty from q group by 1""",
)
def vector_quality_report(spark, sf):
    e = emb(spark, sf)
    broken = F.transform(
        V.as_double("vec"),
        lambda v, i: F.when(F.col("label").isin(3, 4) & (i == 2), F.lit(float("nan")))
        .when(F.col("label").isin(4, 5) & (i == 5), F.lit(float("-inf")))
        .otherwise(v),
    )
    tainted = e.select("key", F.when(F.col("label") == 0, F.array().cast("array<double>")).otherwise(broken).alias("vec"))
    return reduction.embedding_quality_report(tainted)


@query(
    "l2_normalized",
    """with n as (select id, sqrt(sum(v * v)) + 1e-12 as n from xl group by 1)
    select cast(xl.id as varchar) as key, i, round(v / n.n, 6) + 0.0 as val from xl join n on n.id = xl.id""",
)
def l2_normalized(spark, sf):
    return cells(emb(spark, sf).select("key", V.l2_normalize("vec").alias("vec")), "key")


@query(
    "log_softmax",
    """with m as (select id, max(v) as m from xl group by 1), s as (select xl.id, m, ln(sum(exp(v - m))) as l from xl join m on m.id = xl.id group by 1, 2)
    select cast(xl.id as varchar) as key, i, round(v - m - l, 6) + 0.0 as val from xl join s on s.id = xl.id""",
)
def log_softmax(spark, sf):
    return cells(emb(spark, sf).select("key", V.log_softmax("vec").alias("vec")), "key")


# --- projection -------------------------------------------------------------


@query(
    "labelled_point_rows",
    """select vec_id as key, cast((i - 1) // 8 as int) as row, cast((i - 1) % 8 + 1 as bigint) as i,
    round(cast(embedding[i] as double), 6) + 0.0 as val from embeddings, unnest(range(1, 65)) t(i)""",
)
def labelled_point_rows(spark, sf):
    eight = F.array(*[F.slice("embedding", 8 * r + 1, 8) for r in range(8)])
    sets = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), eight.alias("vec"))
    return cells(projection.flatten_labelled_sets(sets), "key", "row")


@query(
    "projection_sample",
    """select key, row, n from (select doc_id as key, cast(0 as int) as row, n_chars as n, row_number() over (order by
    md5(concat('42:', cast(doc_id as varchar), ':0')), doc_id) as rk from documents) where rk <= 100""",
)
def projection_sample(spark, sf):
    points = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.lit(0).alias("row"), F.col("n_chars").alias("n"))
    return projection.projection_sample(points, 100)


@query("projected_points")
def projected_points(spark, sf):
    return projection.project_2d(emb(spark, sf)).select("key", rounded("x").alias("x"), rounded("y").alias("y"))
