"""Identifiers, headers, pair lines and token expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.functions import text as T
from seqweave.operators import ids
from seqweave.session import scratch_path
from seqweave.sources.pairs import clean_pairs, parse_pair_lines
from seqweave.sources.tables import read_embeddings, storable_embeddings
from workload.registry import cells, emb, headers, pair_lines, query, seqs, table

_HEADER_ID = (
    "case when string_split(header,'|')[2] <> '' then string_split(header,'|')[2] "
    r"else regexp_extract(header,'^\s*(\S+)',1) end"
)
_SWISS = r"regexp_extract(header,'(?i)^(?:sp|tr)\|([OPQ]?[A-Z0-9]{5,9}(?:-\d+)?)\|',1)"
_UNIREF = r"regexp_extract(header,'(?i)^(UniRef\d{2,3})_([A-Z0-9]+)',2)"
_WORD = r"regexp_extract(header,'^\s*(\S+)',1)"
_PLAIN = rf"regexp_extract({_WORD},'^([OPQ]?[A-Z0-9]{{5,9}}(?:-\d+)?)',1)"
_CANONICAL = f"coalesce(nullif({_SWISS},''), nullif({_UNIREF},''), nullif({_PLAIN},''), {_WORD})"
_TYPE = (
    f"case when {_SWISS} <> '' then 'UniProt' when {_UNIREF} <> '' then 'UniProt (from UniRef)' "
    f"when {_PLAIN} <> '' then 'UniProt (assumed)' else 'Unknown' end"
)
_ID_MAP = (
    f"select original, arg_max(mapped, ord) as mapped from (select {_WORD} as original, {_CANONICAL} as mapped, ord "
    "from headers) where mapped <> original group by original"
)


@query("header_ids", f"select ord, {_HEADER_ID} as id from headers")
def header_ids(spark, sf):
    return headers(spark, sf).select("ord", T.header_id("header").alias("id"))


@query("candidate_ids", f"select distinct trim({_HEADER_ID}) as id from headers")
def candidate_ids(spark, sf):
    return ids.candidate_ids(headers(spark, sf))


@query("canonical_ids", f"select ord, {_TYPE} as id_type, {_CANONICAL} as id from headers")
def canonical_ids(spark, sf):
    return headers(spark, sf).select(
        "ord", T.canonical_id_type("header").alias("id_type"), T.canonical_id("header").alias("id")
    )


@query("header_id_map", _ID_MAP)
def header_id_map(spark, sf):
    return ids.id_map("regex", headers(spark, sf))


_KEYED = (
    f"select coalesce({_WORD}, cast(e.vec_id as varchar)) as key, e.embedding as vec, e.vec_id as ord "
    "from embeddings e left join headers h on h.ord = e.vec_id"
)


@query(
    "renamed_embeddings",
    f"""with keyed as ({_KEYED}), m as ({_ID_MAP}),
    named as (select coalesce(m.mapped, k.key) as key, k.vec, k.ord from keyed k left join m on m.original = k.key),
    kept as (select key, arg_max(vec, ord) as vec, count(*) as n_merged from named group by key)
    select key, n_merged, cast(i as bigint) as i, round(cast(vec[i] as double), 6) + 0.0 as val
    from kept, unnest(range(1, 65)) t(i)""",
)
def renamed_embeddings(spark, sf):
    named = headers(spark, sf)
    keyed = (
        table(spark, sf, "embeddings")
        .join(named, F.col("ord") == F.col("vec_id"), "left")
        .select(
            F.coalesce(T.first_word("header"), F.col("vec_id").cast("string")).alias("key"),
            F.col("embedding").alias("vec"),
            F.col("vec_id").alias("ord"),
        )
    )
    return cells(ids.apply_id_map(keyed, ids.build_id_map(named)), "key", "n_merged")


@query(
    "ids_by_lookup_table",
    f"select {_HEADER_ID} as original, arg_max(concat('A', cast(ord as varchar)), ord) as mapped from headers group by 1",
)
def ids_by_lookup_table(spark, sf):
    h = headers(spark, sf)
    plain = F.concat(F.lit("A"), F.col("ord").cast("string"))
    record = F.to_json(F.struct(plain.alias("primaryAccession"), F.lit("x").alias("note")))
    reference = h.select(
        T.header_id("header").alias("from"), F.when(F.col("ord") % 2 == 0, record).otherwise(plain).alias("to"), "ord"
    )
    return ids.id_map("table", h, reference)


_FIELDS = (
    "select trim(f[1]) as p1, trim(f[2]) as p2 from (select case when len(string_split(bare,',')) >= 2 then "
    "string_split(bare,',') else string_split(bare, chr(9)) end as f from "
    "(select replace(trim(line),'\"','') as bare from pair_lines))"
)


@query("pairs_from_lines", f"select p1, p2, cast(1 as int) as label from ({_FIELDS}) where p1 <> '' and p2 <> ''")
def pairs_from_lines(spark, sf):
    return parse_pair_lines(pair_lines(spark, sf), 1)


@query(
    "pairs_from_columns",
    """select p1, p2, cast(0 as int) as label from (select trim(case when l_linenumber % 7 = 0 then ' ' else
    concat(' ', cast(l_partkey as varchar)) end) as p1, case when l_linestatus = 'O' and l_linenumber = 1 then null
    else cast(l_suppkey as varchar) end as p2 from lineitem) where p1 <> '' and p2 <> ''""",
)
def pairs_from_columns(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") % 7 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("l_partkey").cast("string"))).alias("p1"),
        F.when(~((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)), F.col("l_suppkey").cast("string")).alias("p2"),
    )
    return clean_pairs(raw, 0)


@query("required_ids", f"select distinct unnest([p1, p2]) as id from ({_FIELDS})")
def required_ids(spark, sf):
    return ids.required_ids(parse_pair_lines(pair_lines(spark, sf), 1))


@query(
    "storable_embeddings",
    """select concat('k_', key) as key, cast(i as bigint) as i, round(cast(vec[i] as double), 6) + 0.0 as val
    from emb, unnest(range(1, 65)) t(i) where cast(key as bigint) % 10 > 1""",
)
def storable(spark, sf):
    # some vectors are missing and some are empty: they are not stored
    tenth = F.col("key").cast("bigint") % 10
    vec = F.when(tenth == 1, F.array().cast("array<float>")).when(tenth > 1, F.col("vec"))
    return cells(storable_embeddings(emb(spark, sf).select(F.concat(F.lit("k/"), "key").alias("key"), vec.alias("vec"))), "key")


@query(
    "embedding_lookup",
    """select key, cast(i as bigint) as i, round(cast(vec[i] as double), 6) + 0.0 as val from emb, unnest(range(1, 65)) t(i)
    where key in (select cast(doc_id as varchar) from labels)""",
)
def embedding_lookup(spark, sf):
    path = scratch_path(spark, "embeddings")
    emb(spark, sf).select("key", "vec").write.parquet(path)
    wanted = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key")).distinct()
    return cells(read_embeddings(spark, path, wanted), "key")


@query(
    "sanitized_residues",
    r"""select id, md5(rtrim(regexp_replace(translate(upper(seq),'UZOB','XXXX'),'(.)','\1 ','g'))) as digest,
    cast(greatest(2*length(seq)-1, 0) as bigint) as n from seqs""",
)
def sanitized_residues(spark, sf):
    spaced = seqs(spark, sf).select("id", T.sanitize_residues("seq").alias("s"))
    return spaced.select("id", F.md5("s").alias("digest"), F.length("s").cast("bigint").alias("n"))


@query(
    "token_arrays",
    """select id, cast(length(seq) as bigint) as n_tokens, md5(array_to_string(string_split(seq,''),'|')) as digest,
    md5(array_to_string(list_slice(string_split(seq,''),1,1024),'|')) as head_digest from seqs""",
)
def token_arrays(spark, sf):
    tokens = seqs(spark, sf).select("id", T.tokenize("seq").alias("t"))
    return tokens.select(
        "id",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("t", "|")).alias("digest"),
        F.md5(F.array_join(T.truncate_tokens("t", 1024), "|")).alias("head_digest"),
    )
