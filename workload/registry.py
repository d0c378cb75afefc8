"""Query registry and the shared views over the driver tables, in Spark and in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seqweave.functions.vectors import as_double, dot
from seqweave.operators.pair_vectors import dot_rows, pair_values
from seqweave.operators.vector_agg import repeated_if_small, vector_dim
from seqweave.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; views named in the SQL are added as common table expressions."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return add


# --- SQL views --------------------------------------------------------------

VIEWS = {
    "seqs": "select doc_id as seq_ord, cast(doc_id as varchar) as id, upper(replace(translate(text, ' ' || chr(9) || chr(10) || chr(13), '____'), 'ß', 'ss')) as seq from documents",
    "padded": "select seq_ord, id, case when seq_ord = (select min(seq_ord) from seqs) then ' ' else '' end || seq || ' ' as seq from seqs",
    "letters": "select id, unnest(string_split(seq,'')) as c, unnest(range(length(seq))) as pos from seqs where length(seq) > 0",
    "grams": "select id, pos, c as g1, c||lead(c,1) over w as g2, c||lead(c,1) over w||lead(c,2) over w as g3, c||lead(c,1) over w||lead(c,2) over w||lead(c,3) over w as g4 from letters window w as (partition by id order by pos)",
    "padded_letters": "select id, unnest(string_split(seq,'')) as c, unnest(range(length(seq))) as pos from padded",
    "padded_grams": "select id, pos, c as g1, c||lead(c,1) over w as g2, c||lead(c,1) over w||lead(c,2) over w as g3, c||lead(c,1) over w||lead(c,2) over w||lead(c,3) over w as g4 from padded_letters window w as (partition by id order by pos)",
    "widths": "select width, ngram, count(*) as n_occ from (select 1 as width, g1 as ngram from padded_grams union all select 2, g2 from padded_grams union all select 3, g3 from padded_grams union all select 4, g4 from padded_grams) where ngram is not null group by 1,2",
    "level_vocab": "select width as n, row_number() over (partition by width order by ngram) - 1 as id, ngram from widths where width <= 3",
    "level_edges": "select w.width-1 as n, a.id as src, b.id as dst, w.n_occ as w from widths w join level_vocab a on a.n = w.width-1 and a.ngram = substr(w.ngram,1,w.width-1) join level_vocab b on b.n = w.width-1 and b.ngram = substr(w.ngram,2,w.width-1) where w.width > 1",
    "n_vec": "select max(vec_id) + 1 as n from embeddings",
    "edges": "select l_partkey % (select n from n_vec) as src, (l_suppkey*7 + l_linenumber) % (select n from n_vec) as dst, cast(count(*) as double) as w from lineitem group by 1,2",
    "nodes": "select vec_id as id from embeddings",
    "pairs": "select cast(p.src as varchar) as p1, cast(p.dst as varchar) as p2, cast(case when a.label=b.label then 1 else 0 end as int) as label from (select distinct least(src, dst) as src, greatest(src, dst) as dst from edges where src <> dst) p join embeddings a on a.vec_id=p.src join embeddings b on b.vec_id=p.dst",
    "emb": "select cast(vec_id as varchar) as key, embedding as vec, label from embeddings",
    "xl": "select vec_id as id, cast(i as bigint) as i, cast(embedding[cast(i as int)] as double) as v from (select vec_id, embedding, unnest(range(1, len(embedding)+1)) as i from embeddings)",
    "headers": "select p_partkey as ord, case p_partkey % 4 when 0 then concat('sp|P',lpad(cast(p_partkey as varchar),5,'0'),'|X ',p_name) when 1 then concat('UniRef50_Q',lpad(cast(p_partkey as varchar),5,'0'),' ',p_name) when 2 then concat('Q',lpad(cast(p_partkey as varchar),5,'0'),' ',p_name) else concat('dummy_',cast(p_partkey as varchar)) end as header from part",
    "history": "select user_id as run, row_number() over (partition by user_id order by ts,event_id) as epoch, value as val, value/2 as test from events",
    "fold_scores": "select concat('m', cast(user_id % 4 as varchar)) as model, cast(event_id % 5 as int) as fold, avg(value) as score from events group by 1,2",
    "pair_lines": "select concat('\"',cast(l_partkey as varchar),'\"',case when l_linenumber % 2=0 then ',' else chr(9) end,' ',cast(l_suppkey as varchar),' ') as line from lineitem",
    "scored": "select p1, p2, pairs.label, cast(p1 as bigint) % 5 as fold, round(list_sum([cast(a.vec[i] as double)*b.vec[i] for i in range(1,len(a.vec)+1)]), 6) + 0.0 as score from pairs join emb a on a.key = p1 join emb b on b.key = p2",
}


def with_views(sql: str) -> str:
    """Prefix `sql` with the views it mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed and body is not text:
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ", ".join(f"{name} as ({VIEWS[name]})" for name in needed)
    stripped = sql.strip()
    if stripped.lower().startswith("with "):
        return f"with {views}, {stripped[5:]}"
    return f"with {views} {stripped}"


# --- Spark views ------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select(
        F.col("doc_id").alias("seq_ord"),
        F.col("doc_id").cast("string").alias("id"),
        # every character stays; white space is written as a letter of its own, since a blank is the padding symbol
        F.upper(F.replace(F.translate("text", " \t\n\r", "____"), F.lit("ß"), F.lit("ss"))).alias("seq"),
    )


def n_vectors(spark: SparkSession, sf: str) -> int:
    """Number of vector ids: one scalar, answered from Parquet footers."""
    return table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] + 1


def edge_ends(spark: SparkSession, sf: str) -> DataFrame:
    n = n_vectors(spark, sf)
    return table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % n).alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % n).alias("dst")
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return edge_ends(spark, sf).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), as_double("embedding").alias("vec"))


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vec"), "label"
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    labels = repeated_if_small(table(spark, sf, "embeddings").select("vec_id", "label"))
    a = labels.select(F.col("vec_id").alias("src"), F.col("label").alias("_a"))
    b = labels.select(F.col("vec_id").alias("dst"), F.col("label").alias("_b"))
    ends = edge_ends(spark, sf).filter("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    joined = ends.distinct().join(a, "src").join(b, "dst")
    return joined.select(
        F.col("src").cast("string").alias("p1"),
        F.col("dst").cast("string").alias("p2"),
        (F.col("_a") == F.col("_b")).cast("int").alias("label"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    e = emb(spark, sf)
    joined = pair_values(pairs(spark, sf), e, vector_dim(e), "_dot", DoubleType(), dot, dot_rows)
    return joined.select("p1", "p2", "label", (F.col("p1").cast("bigint") % 5).alias("fold"), (F.round("_dot", 6) + 0.0).alias("score"))


def headers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    padded = F.lpad(key.cast("string"), 5, "0")
    header = (
        F.when(key % 4 == 0, F.concat(F.lit("sp|P"), padded, F.lit("|X "), F.col("p_name")))
        .when(key % 4 == 1, F.concat(F.lit("UniRef50_Q"), padded, F.lit(" "), F.col("p_name")))
        .when(key % 4 == 2, F.concat(F.lit("Q"), padded, F.lit(" "), F.col("p_name")))
        .otherwise(F.concat(F.lit("dummy_"), key.cast("string")))
    )
    return table(spark, sf, "part").select(key.alias("ord"), header.alias("header"))


def fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(
            F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"),
            (F.col("event_id") % 5).cast("int").alias("fold"),
        )
        .agg(F.avg("value").alias("score"))
    )


def pair_lines(spark: SparkSession, sf: str) -> DataFrame:
    sep = F.when(F.col("l_linenumber") % 2 == 0, ",").otherwise("\t")
    return table(spark, sf, "lineitem").select(
        F.concat(
            F.lit('"'), F.col("l_partkey").cast("string"), F.lit('"'), sep, F.lit(" "), F.col("l_suppkey").cast("string"), F.lit(" ")
        ).alias("value")
    )


def cells(df: DataFrame, *keys: str, vec: str = "vec", places: int = 6) -> DataFrame:
    """Vectors as comparable rows `(keys..., i, val)`, i from 1."""
    return df.select(*keys, F.posexplode(as_double(vec)).alias("_i", "_v")).select(
        *keys, (F.col("_i") + 1).cast("bigint").alias("i"), rounded("_v", places).alias("val")
    )


def rounded(c, places: int = 6):
    """Rounded value without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places) + F.lit(0.0)
