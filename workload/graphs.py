"""Graph matrices, labels and clusters on the supplier-part graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import community, graph, labels
from seqweave.sources.tables import load_graph, load_graph_table, save_graph
from seqweave.session import materialise, scratch_path
from workload.registry import cells, edges, n_vectors, nodes, query, rounded, table

_DUP = "(select src, dst, w from edges union all select src, dst, w from edges where w > 1)"
_SPLIT = """select id, case when rk < cast(floor(0.1 * n) as bigint) then 'train' when rk < 2 * cast(floor(0.1 * n) as bigint)
    then 'val' else 'test' end as split from (select id, row_number() over (order by md5(concat('42:', cast(id as varchar))), id) - 1 as rk,
    count(*) over () as n from nodes)"""
_ROWN = "select src, dst, w / sum(w) over (partition by src) as w from edges"
_ROWN_IN = "select src, dst, w / sum(w) over (partition by src) as w from (select dst as src, src as dst, w from edges)"


def _energy(rows: str) -> str:
    return f"select src, dst, sum(w) as w from (select src, dst, 0.5*w*w as w from ({rows}) union all select dst, src, 0.5*w*w from ({rows})) group by 1, 2"


def _prop(rows: str) -> str:
    return (
        f"select src, dst, sum(w) as w from (select src, dst, sqrt(w + 1e-9) as w from ({_energy(rows)}) "
        "union all select id, id, 1.0 from nodes) group by 1, 2"
    )


_SYM = """with u as (select src, dst from edges union select dst, src from edges),
    l as (select src, dst from u union all select id, id from nodes),
    d as (select dst as id, count(*) as d from l group by 1)
    select l.src, l.dst, round(sum(1.0/sqrt(a.d)/sqrt(b.d)), 6) + 0.0 as w from l join d a on a.id = l.src join d b on b.id = l.dst group by 1, 2"""


@query(
    "dense_nodes",
    """select i as id, coalesce(p_name, concat('__NODE_', cast(i as varchar), '__')) as name
    from (select unnest(range(0, (select greatest((select max(greatest(src, dst)) from edges), (select max(p_partkey) from part where p_size > 25)) + 1))) as i)
    left join (select * from part where p_size > 25) on p_partkey = i""",
)
def dense_nodes(spark, sf):
    named = table(spark, sf, "part").filter(F.col("p_size") > 25).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return graph.densify_nodes(named, edges(spark, sf))


@query("adjacency_out", f"select src, dst, sum(w) as w from {_DUP} group by 1, 2")
def adjacency_out(spark, sf):
    e = edges(spark, sf)
    return graph.adjacency_out(e.unionByName(e.filter(F.col("w") > 1)))


@query("adjacency_in", f"select dst as src, src as dst, sum(w) as w from {_DUP} group by 1, 2")
def adjacency_in(spark, sf):
    e = edges(spark, sf)
    return graph.adjacency_in(e.unionByName(e.filter(F.col("w") > 1)))


@query("undirected_edges", "select src, dst from edges union select dst, src from edges")
def undirected_edges(spark, sf):
    return graph.to_undirected(edges(spark, sf))


@query(
    "self_loops",
    "select src, dst, count(*) as n from (select src, dst from edges union all select id, id from nodes) group by 1, 2",
)
def self_loops(spark, sf):
    looped = graph.add_self_loops(edges(spark, sf), nodes(spark, sf))
    return looped.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(
    "self_loops_deduplicated",
    "select src, dst from edges where src <> dst union all select id, id from nodes",
)
def self_loops_deduplicated(spark, sf):
    return graph.add_self_loops(edges(spark, sf), nodes(spark, sf), dedupe=True)


@query("in_degrees", "select dst as id, count(*) as deg from edges group by 1")
def in_degrees(spark, sf):
    return graph.degree(edges(spark, sf))


@query("symmetric_normalized", _SYM)
def symmetric_normalized(spark, sf):
    return graph.sym_normalize(edges(spark, sf), nodes(spark, sf)).select("src", "dst", rounded("w").alias("w"))


@query("row_normalized", f"select src, dst, round(w, 9) + 0.0 as w from ({_ROWN})")
def row_normalized(spark, sf):
    return graph.row_normalize(edges(spark, sf)).select("src", "dst", rounded("w", 9).alias("w"))


@query("symmetric_skew_energy", f"select src, dst, round(w, 9) + 0.0 as w from ({_energy(_ROWN)})")
def symmetric_skew_energy(spark, sf):
    return graph.sym_skew_energy(edges(spark, sf)).select("src", "dst", rounded("w", 9).alias("w"))


@query("propagation_matrix", f"select src, dst, round(w, 6) + 0.0 as w from ({_prop(_ROWN)})")
def propagation_matrix(spark, sf):
    return graph.propagation_matrix(edges(spark, sf), nodes(spark, sf)).select("src", "dst", rounded("w").alias("w"))


@query(
    "propagation_pair",
    f"""select 'out' as matrix, src, dst, round(w, 6) + 0.0 as w from ({_prop(_ROWN)}) union all
    select 'in', src, dst, round(w, 6) + 0.0 from ({_prop(_ROWN_IN)})""",
)
def propagation_pair(spark, sf):
    return graph.propagation_pair(edges(spark, sf), nodes(spark, sf)).select("matrix", "src", "dst", rounded("w").alias("w"))


@query(
    "matrix_sum",
    "select src, dst, sum(w) as w from (select src, dst, w from edges union all select dst, src, w from edges) group by 1, 2",
)
def matrix_sum(spark, sf):
    e = edges(spark, sf)
    return graph.matrix_add(e, graph.reverse_edges(e))


@query(
    "undirected_projection",
    """select src, dst, sum(w) as w from (select src, dst, w from edges union all select dst, src, w from edges)
    where src <= dst group by 1, 2""",
)
def undirected_projection(spark, sf):
    e = edges(spark, sf)
    return graph.undirected_projection(graph.matrix_add(e, graph.reverse_edges(e)))


@query("reversed_edges", "select dst as src, src as dst, w from edges")
def reversed_edges(spark, sf):
    return graph.reverse_edges(edges(spark, sf))


@query(
    "target_clusters",
    """select o_custkey, n_nodes, case when n_nodes > 10000 then cast(least(greatest(ceil(n_nodes / 500.0), 2), 500) as bigint) end as n_clusters
    from (select o_custkey, count(*) * 1009 as n_nodes from orders group by 1)""",
)
def target_clusters(spark, sf):
    sizes = table(spark, sf, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) * 1009).alias("n_nodes"))
    return graph.target_clusters(sizes)


_MOD_EDGES = """select src, dst, sum(w) as w from (select src, dst, w from edges union all select dst, src, w from edges)
    where src <= dst group by 1, 2"""


def _undirected(spark, sf):
    return graph.undirected_projection(graph.matrix_add(edges(spark, sf), graph.reverse_edges(edges(spark, sf))))


_FOLLOWERS = f"""select n.id, coalesce(f.best, n.id) as cluster from nodes n left join (select id, arg_max(nbr, (w, -nbr)) as best from
    (select src as id, dst as nbr, w from ({_MOD_EDGES}) union all select dst, src, w from ({_MOD_EDGES})) where id <> nbr group by id) f on f.id = n.id"""


def _follows(undirected, ids):
    """Every node in the cluster of its heaviest neighbour: what any search for communities has to beat."""
    both = undirected.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr"), "w"), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr"), "w"))))
    best = both.filter("id <> nbr").groupBy("id").agg(F.max(F.struct("w", (-F.col("nbr")).alias("_n"))).alias("_b"))
    return ids.join(best, "id", "left").select("id", F.coalesce(-F.col("_b._n"), F.col("id")).alias("cluster"))


@query(
    "communities",
    f"""with e as ({_MOD_EDGES}), c as ({_FOLLOWERS}), p as (select a.cluster as ca, b.cluster as cb, w from e join c a on a.id = src join c b on b.id = dst),
    k as (select cluster, sum(w) as k from (select ca as cluster, w from p union all select cb, w from p) group by 1), t as (select sum(w) as m from p)
    select id, true as connected, round((select coalesce(sum(w), 0) from p where ca = cb) / m - (select sum(k * k) from k) / (4 * m * m), 9) + 0.0 as to_beat, true as beaten from nodes, t""",
)
def communities(spark, sf):
    """Every node's cluster is one connected piece, and the clusters beat those of the heaviest neighbours."""
    undirected, ids = _undirected(spark, sf), nodes(spark, sf)
    found = materialise(community.communities(undirected, ids))
    pieces = community.connected_pieces(undirected, found).groupBy("cluster").agg(F.min("id").alias("_any"))
    split = pieces.select(F.col("_any").alias("id")).join(found, "id").groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    reached = graph.modularity(undirected, found).select(F.col("modularity").alias("_reached"))
    to_beat = graph.modularity(undirected, _follows(undirected, ids)).select(F.col("modularity").alias("_base"))
    checked = found.join(split, "cluster").join(F.broadcast(reached)).join(F.broadcast(to_beat))  # one row each
    return checked.select("id", (F.col("_n") == 1).alias("connected"), rounded("_base", 9).alias("to_beat"), (F.col("_reached") > F.col("_base")).alias("beaten"))


@query(
    "modularity",
    f"""with e as ({_MOD_EDGES}), c as (select vec_id as id, label as cluster from embeddings),
    p as (select a.cluster as ca, b.cluster as cb, w from e join c a on a.id = src join c b on b.id = dst),
    k as (select cluster, sum(w) as k from (select ca as cluster, w from p union all select cb, w from p) group by 1),
    t as (select sum(w) as m from p)
    select round((select sum(w) from p where ca = cb) / m - (select sum(k * k) from k) / (4 * m * m), 9) + 0.0 as modularity from t""",
)
def modularity(spark, sf):
    undirected = graph.undirected_projection(graph.matrix_add(edges(spark, sf), graph.reverse_edges(edges(spark, sf))))
    assign = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return graph.modularity(undirected, assign).select(rounded("modularity", 9).alias("modularity"))


_ASSIGN = "select c_custkey as id, c_nationkey * 7 + 3 as cluster from customer"


def _assign(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 7 + 3).alias("cluster"))


@query(
    "dense_relabel",
    f"select id, cluster, dense_rank() over (order by cluster) - 1 as label, (select count(distinct cluster) from ({_ASSIGN})) as n_classes from ({_ASSIGN})",
)
def dense_relabel(spark, sf):
    return graph.relabel_dense(_assign(spark, sf))


@query(
    "cluster_sizes", f"select cluster, count(*) as n_members, min(id) as first_member from ({_ASSIGN}) group by 1"
)
def cluster_sizes(spark, sf):
    return graph.cluster_sizes(_assign(spark, sf))


@query(
    "cluster_members",
    f"select cluster, id, row_number() over (partition by cluster order by id) - 1 as member_no from ({_ASSIGN})",
)
def cluster_members(spark, sf):
    return graph.cluster_members(_assign(spark, sf))


@query(
    "node_partition",
    f"""with e as (select * from ({_MOD_EDGES}) where src <> dst), s as (select count(*) as n, (count(*) + 7) // 8 as capacity from nodes),
    c as (select vec_id as id, label, count(*) over (partition by label) as size from embeddings),
    l as (select id, (row_number() over (order by size desc, label, id) - 1) // (select capacity from s) as part from c)
    select n as n_nodes, capacity, true as fits, 8 as n_parts, (select sum(w) from e) as weight,
    (select sum(w) from e join l a on a.id = src join l b on b.id = dst where a.part <> b.part) as line_cut, true as below_line from s""",
)
def node_partition(spark, sf):
    """Eight parts, traded from a line of the labels: sizes, the line's cut, and whether the parts' cut is below it."""
    undirected, ids = _undirected(spark, sf), nodes(spark, sf)
    labelled = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    parts = materialise(community.partition_nodes(undirected, ids, 8, labelled))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_nodes"), F.max("n").alias("_most"), F.count(F.lit(1)).cast("int").alias("n_parts"))
    cut = community.edge_cut(undirected, parts)
    line = community.edge_cut(undirected, community.line_partition(labelled, 8)).select(F.col("cut").alias("line_cut"))
    capacity = F.ceil(F.col("n_nodes") / 8).cast("long")
    return sizes.join(F.broadcast(cut)).join(F.broadcast(line)).select(  # one row each
        "n_nodes", capacity.alias("capacity"), (F.col("_most") <= capacity).alias("fits"), "n_parts", "weight", "line_cut", (F.col("cut") < F.col("line_cut")).alias("below_line")
    )


@query(
    "induced_subgraphs",
    """with c as (select vec_id as id, label as cluster, row_number() over (partition by label order by vec_id) - 1 as m from embeddings)
    select a.cluster, a.m as src, b.m as dst, e.src as original_src, e.dst as original_dst, e.w
    from edges e join c a on a.id = e.src join c b on b.id = e.dst where a.cluster = b.cluster""",
)
def induced_subgraphs(spark, sf):
    assign = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return graph.induced_subgraphs(edges(spark, sf), assign)


@query(
    "next_node_labels",
    """select id, coalesce(best, id) as label from nodes left join
    (select src, arg_max(dst, (w, md5(concat('42:', cast(src as varchar), ':', cast(dst as varchar))))) as best from edges group by 1)
    on src = id""",
)
def next_node_labels(spark, sf):
    return labels.next_node_label(nodes(spark, sf), edges(spark, sf))


@query("community_labels", "select id, true as dense, true as named from nodes")
def community_labels(spark, sf):
    """Every node has one label; labels run from 0 to the number of classes less one and each is in use."""
    found = materialise(labels.community_label(nodes(spark, sf), edges(spark, sf)))
    used = found.select("label").distinct().agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    checked = found.join(F.broadcast(used))  # one row
    dense = (F.col("_low") == 0) & (F.col("_high") == F.col("_n") - 1) & (F.col("n_classes") == F.col("_n"))
    return checked.select("id", dense.alias("dense"), F.col("label").isNotNull().alias("named"))


@query(
    "benchmark_graph_nodes",
    f"""with s as ({_SPLIT}) select e.vec_id as id, e.label as y, s.split, cast(i as bigint) as i, round(cast(e.embedding[i] as double), 6) + 0.0 as val
    from embeddings e join s on s.id = e.vec_id, unnest(range(1, 65)) t(i)""",
)
def benchmark_graph_nodes(spark, sf):
    raw = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))
    loaded, _ = load_graph_table(raw, edges(spark, sf), make_undirected=True)
    return cells(loaded, "id", "y", "split", vec="x")


@query("benchmark_graph_edges", "select src, dst from edges union select dst, src from edges")
def benchmark_graph_edges(spark, sf):
    _, pairs = load_graph_table(nodes(spark, sf), edges(spark, sf), make_undirected=True)
    return pairs


@query("graph_snapshot", "select cast(w as int) as n, src, dst, w from edges")
def graph_snapshot(spark, sf):
    path = scratch_path(spark, "graph")
    levelled = edges(spark, sf).withColumn("n", F.col("w").cast("int"))
    named = nodes(spark, sf).withColumn("n", F.lit(2))
    save_graph(named, levelled, path)
    return load_graph(spark, path)[1].select("n", "src", "dst", "w")
