"""N-grams, transitions and levelled graphs of the document sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import features, labels, ngrams
from seqweave.plans.sequence_graph import build_graph, level_graph
from seqweave.session import scratch_path
from seqweave.streaming import counts
from workload.registry import query, rounded, seqs

_CODE3 = "ascii({0}[1])*10201 + ascii({0}[2])*101 + ascii({0}[3])"


def _code(column: str, width: int = 3):
    total = F.lit(0)
    for i in range(width):
        total = total + F.ascii(F.substring(column, i + 1, 1)) * F.lit(101 ** (width - 1 - i))
    return total.cast("bigint")


@query(
    "ngram_occurrences",
    f"""select id, count(*) as n, cast(sum(pos) as bigint) as pos_sum,
    cast(sum((pos + 1) * ({_CODE3.format('g3')})) as bigint) as fingerprint from grams where g3 is not null group by id""",
)
def ngram_occurrences(spark, sf):
    grams = ngrams.ngrams(seqs(spark, sf), 3)
    return grams.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("pos").alias("pos_sum"),
        F.sum((F.col("pos") + 1) * _code("ngram")).alias("fingerprint"),
    )


@query("ngram_counts_per_record", "select id, g2 as ngram, count(*) as n_occ from grams where g2 is not null group by 1, 2")
def ngram_counts_per_record(spark, sf):
    return ngrams.ngram_counts(seqs(spark, sf), 2, "id")


@query("distinct_ngrams", "select distinct g3 as ngram from grams where g3 is not null")
def distinct_ngrams(spark, sf):
    return ngrams.distinct_ngrams(seqs(spark, sf), 3)


@query(
    "ngram_vocabulary",
    "select row_number() over (order by ngram) - 1 as id, ngram from (select distinct g3 as ngram from grams where g3 is not null)",
)
def ngram_vocabulary(spark, sf):
    return ngrams.assign_ids(ngrams.distinct_ngrams(seqs(spark, sf), 3))


@query(
    "transitions",
    f"""select id, count(*) as n, cast(sum((pos + 1) * ({_CODE3.format("g4")} + 3 * ascii(g4[4]))) as bigint) as fingerprint
    from grams where g4 is not null group by id""",
)
def transitions(spark, sf):
    moves = ngrams.transitions(seqs(spark, sf), 3)
    code = _code("src") + F.ascii(F.substring("dst", 3, 1)) * 3
    return moves.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pos") + 1) * code).alias("fingerprint"))


@query(
    "transition_counts",
    "select substr(g4,1,3) as src, substr(g4,2,3) as dst, count(*) as w from grams where g4 is not null group by 1, 2",
)
def transition_counts(spark, sf):
    return ngrams.transition_counts(seqs(spark, sf), 3)


@query(
    "streamed_transition_counts",
    "select substr(g4,1,3) as src, substr(g4,2,3) as dst, count(*) as w from grams where g4 is not null group by 1, 2",
)
def streamed_transition_counts(spark, sf):
    """The same counts from a stream: files that arrive in two deliveries, a second run, and a repeated batch."""
    base = scratch_path(spark, "stream-counts")
    records = seqs(spark, sf).select("id", "seq")
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    for delivery in (half, ~half):
        records.filter(delivery).write.mode("append").parquet(f"{base}/in")
        counts.stream_transition_counts(spark, f"{base}/in", f"{base}/state", f"{base}/progress", 3)
    counts.batch_writer(f"{base}/state", 3)(records.filter(~half), 1)
    return counts.read_transition_counts(spark, f"{base}/state")


@query(
    "encoded_edges",
    """with v as (select row_number() over (order by ngram) - 1 as id, ngram from (select distinct g2 as ngram from grams
    where g2 is not null and substr(g2,1,1) <> 'Q'))
    select a.id as src, b.id as dst, count(*) as w from grams g join v a on a.ngram = substr(g.g3,1,2)
    join v b on b.ngram = substr(g.g3,2,2) group by 1, 2""",
)
def encoded_edges(spark, sf):
    records = seqs(spark, sf)
    known = ngrams.distinct_ngrams(records, 2).filter(~F.col("ngram").startswith("Q"))
    return ngrams.encode_edges(ngrams.transition_counts(records, 2), ngrams.assign_ids(known))


@query(
    "padded_sequences",
    "select id, cast(length(seq) as bigint) as n, md5(seq) as digest from padded",
)
def padded_sequences(spark, sf):
    padded = ngrams.pad_sequences(seqs(spark, sf), "first")
    return padded.select("id", F.length("seq").cast("bigint").alias("n"), F.md5("seq").alias("digest"))


@query("level_vocabulary", "select cast(n as int) as n, id, ngram from level_vocab")
def level_vocabulary(spark, sf):
    return build_graph(seqs(spark, sf), 3)[0]


@query("level_edges", "select cast(n as int) as n, src, dst, w from level_edges")
def level_edges(spark, sf):
    return build_graph(seqs(spark, sf), 3)[1]


@query(
    "level_stats",
    """select cast(n as int) as n, n_nodes, n_edges, round(n_edges / (cast(n_nodes as double) * (n_nodes - 1)), 9) + 0.0 as density
    from (select n, count(*) as n_nodes from level_vocab group by n) join
    (select n, count(*) as n_edges from level_edges group by n) using (n)""",
)
def level_stats(spark, sf):
    stats = build_graph(seqs(spark, sf), 3)[2]
    return stats.select("n", "n_nodes", "n_edges", rounded("density", 9).alias("density"))


_NAMED = "with e as (select src, dst, cast(w as double) as w from level_edges where n = 2), nd as (select id from level_vocab where n = 2)"


@query(
    "graph_matrices_of_level_2",
    f"""{_NAMED}, rev as (select dst as src, src as dst, w from e),
    an as (select 'out' as path, src, dst, w / sum(w) over (partition by src) as w from e union all
           select 'in', src, dst, w / sum(w) over (partition by src) from rev),
    sk as (select path, src, dst, sum(w) as w from (select path, src, dst, 0.5*w*w as w from an union all
           select path, dst, src, 0.5*w*w from an) group by 1,2,3),
    prop as (select path, src, dst, sum(w) as w from (select path, src, dst, sqrt(w + 1e-9) as w from sk union all
           select p, id, id, 1.0 from nd, (values ('in'),('out')) t(p)) group by 1,2,3),
    und as (select src, dst from e union select dst, src from e),
    loops as (select src, dst from und union all select id, id from nd),
    deg as (select dst as id, count(*) as d from loops group by 1),
    norm as (select 'und' as path, l.src, l.dst, sum(1.0/sqrt(a.d)/sqrt(b.d)) as w from loops l join deg a on a.id=l.src
           join deg b on b.id=l.dst group by 2,3)
    select path, src, dst, round(w, 6) + 0.0 as w from (select * from prop union all select * from norm)""",
)
def graph_matrices_of_level_2(spark, sf):
    vocab, edges, _ = build_graph(seqs(spark, sf), 3)
    g = level_graph(vocab, edges, 2)
    paths = F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"w_{p}").alias("w")) for p in ("out", "in", "und")])
    return g.matrices.select("src", "dst", F.inline(paths)).select("path", "src", "dst", rounded("w").alias("w"))


_TOKEN = (
    "substr('ACDEFGHIKLMNPQRSTVWY', cast(h % 20 as int) + 1, 1)"
)


@query(
    "closest_token_labels",
    f"""with nd as (select id, ngram, md5(concat('42:', cast(id as varchar))) as d from level_vocab where n = 3),
    hx as (select id, ngram, list_sum([cast((instr('0123456789abcdef', d[i]) - 1) * pow(16, 8 - i) as bigint) for i in range(1, 9)]) as h from nd),
    tk as (select id, ngram, {_TOKEN} as token from hx),
    e as (select src, dst from level_edges where n = 3),
    has as (select id, unnest(string_split('ACDEFGHIKLMNPQRSTVWY','')) as t, ngram from tk),
    r0 as (select id, t from has where contains(ngram, t)),
    r1 as (select distinct e.src as id, t from e join r0 on r0.id = e.dst),
    r2 as (select distinct e.src as id, t from e join r1 on r1.id = e.dst),
    r3 as (select distinct e.src as id, t from e join r2 on r2.id = e.dst),
    hops as (select id, t, min(h) as h from (select id, t, 0 as h from r0 union all select id, t, 1 from r1 union all
      select id, t, 2 from r2 union all select id, t, 3 from r3) group by 1, 2)
    select tk.id, tk.token, cast(coalesce(hops.h, 3) as int) as label, hops.h is not null as found
    from tk left join hops on hops.id = tk.id and hops.t = tk.token""",
)
def closest_token_labels(spark, sf):
    vocab, edges, _ = build_graph(seqs(spark, sf), 3)
    nodes = vocab.filter(F.col("n") == 3).select("id", F.col("ngram").alias("name"))
    return labels.closest_token_label(nodes, edges.filter(F.col("n") == 3).select("src", "dst", "w"), 3)


@query(
    "features_from_shorter_ngrams",
    """with v2 as (select id, ngram from level_vocab where n = 2), v3 as (select id, ngram from level_vocab where n = 3),
    base as (select ngram, i, (id * (i + 3)) % 17 / 4.0 as v from v2, unnest(range(0, 8)) t(i) where not contains(ngram, 'E'))
    select c.id, cast(c.i + 1 as bigint) as i, round(coalesce((p.v + s.v) / 2, p.v, s.v, 0.0), 6) + 0.0 as val
    from (select id, ngram, i from v3, unnest(range(0, 8)) t(i)) c
    left join base p on p.ngram = substr(c.ngram, 1, 2) and p.i = c.i
    left join base s on s.ngram = substr(c.ngram, 2, 2) and s.i = c.i""",
)
def features_from_shorter_ngrams(spark, sf):
    from workload.registry import cells

    vocab, _, _ = build_graph(seqs(spark, sf), 3)
    # some n-grams have no vector yet: the other end or zeros step in
    two = vocab.filter(F.col("n") == 2).filter(~F.col("ngram").contains("E"))
    vec = F.array(*[(F.col("id") * (i + 3)) % 17 / 4.0 for i in range(8)])
    previous = two.select("ngram", vec.alias("vec"))
    three = vocab.filter(F.col("n") == 3).select("id", "ngram")
    return cells(features.pool_prefix_suffix(three, previous, 8), "id")
