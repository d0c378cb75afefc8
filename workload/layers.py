"""Node features and graph layers over the whole embedding table, with weights given by a rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqweave.functions import vectors as V
from seqweave.operators import convs, features, graph
from seqweave.operators.features import DirectedLayer
from seqweave.plans.embed import embed_records, hierarchical_embed
from seqweave.plans.sequence_graph import build_graph
from seqweave.session import materialise
from workload.registry import cells, edges, nodes, query, seqs, table
from workload.registry import features as vectors

DIM = 64
OUT = 8


def rule_matrix(rows: int, cols: int, salt: int) -> np.ndarray:
    """Weight (j, i) = ((7i + 3j + salt) mod 11 - 5) / 10 with i, j counted from 1."""
    j, i = np.meshgrid(np.arange(1, rows + 1), np.arange(1, cols + 1), indexing="ij")
    return ((7 * i + 3 * j + salt) % 11 - 5) / 10.0


def rule_vector(size: int, salt: int) -> np.ndarray:
    return ((np.arange(1, size + 1) * 5 + salt) % 7 - 3) / 10.0


def _w(salt: int, i: str = "x.i", j: str = "j") -> str:
    return f"(((7*{i} + 3*{j} + {salt}) % 11 - 5) / 10.0::double)"


def _b(salt: int, j: str = "j") -> str:
    return f"((({j} * 5 + {salt}) % 7 - 3) / 10.0::double)"


def _lin(source: str, salt: int, bias: int | None = None, out: int = OUT) -> str:
    """Dense transform of long rows `(id, i, v)`."""
    b = f" + {_b(bias)}" if bias is not None else ""
    return f"select x.id, j as i, sum(x.v * {_w(salt)}){b} as v from {source} x, unnest(range(1, {out + 1})) t(j) group by 1, 2"


def _prop(entries: str, source: str, fn: str = "sum", weight: str = "e.w") -> str:
    return f"select e.dst as id, x.i, {fn}({weight} * x.v) as v from {entries} e join {source} x on x.id = e.src group by 1, 2"


def _all(part: str, width: int = DIM) -> str:
    """Zero rows for nodes that are absent from `part`."""
    return (
        f"select n.id, n.i, coalesce(p.v, 0.0) as v from (select id, unnest(range(1, {width + 1})) as i from nodes) n "
        f"left join {part} p on p.id = n.id and p.i = n.i"
    )


def _out(source: str) -> str:
    return f"select id, cast(i as bigint) as i, round(v, 6) + 0.0 as val from {source}"


# --- features ---------------------------------------------------------------


def _hash_long(expr: str) -> str:
    return (
        f"list_sum([cast((instr('0123456789abcdef', substr({expr}, cast(k as int), 1)) - 1) * pow(16, 8 - k) as bigint) for k in range(1, 9)])"
    )


@query(
    "random_features",
    f"""with d as (select id, i, md5(concat('42:', cast(id as varchar), ':', cast(i - 1 as varchar), ':r')) as h1,
    md5(concat('42:', cast(id as varchar), ':', cast(i - 1 as varchar), ':t')) as h2 from nodes, unnest(range(1, 17)) t(i)),
    u as (select id, i, ({_hash_long('h1')} + 0.5::double) / 4294967296.0::double as u1, ({_hash_long('h2')} + 0.5::double) / 4294967296.0::double as u2 from d)
    select id, cast(i as bigint) as i, round(sqrt(-2 * ln(u1)) * cos(2 * pi() * u2), 6) + 0.0 as val from u""",
)
def random_features(spark, sf):
    return cells(features.random_features(nodes(spark, sf), 16), "id")


@query(
    "positional_features",
    "select id, i, round(v + (((i - 1) // 16 + 1) * 3 + ((i - 1) % 16 + 1)) / 10.0::double, 6) + 0.0 as val from xl",
)
def positional_features(spark, sf):
    positions = (np.arange(1, 5)[:, None] * 3 + np.arange(1, 17)[None, :]) / 10.0
    return cells(features.add_positional(vectors(spark, sf), positions, 4), "id")


@query("dense_transform", f"with y as ({_lin('xl', 1, 2)}) {_out('y')}")
def dense_transform(spark, sf):
    x = vectors(spark, sf)
    return cells(x.select("id", V.linear("vec", rule_matrix(OUT, DIM, 1), rule_vector(OUT, 2)).alias("vec")), "id")


@query("dense_transform_wide", f"with y as ({_lin('xl', 4, 5, 64)}) {_out('y')}")
def dense_transform_wide(spark, sf):
    x = vectors(spark, sf)
    return cells(x.select("id", V.linear("vec", rule_matrix(64, DIM, 4), rule_vector(64, 5)).alias("vec")), "id")


@query("propagated_features", f"with p as ({_prop('edges', 'xl')}), y as ({_all('p')}) {_out('y')}")
def propagated_features(spark, sf):
    return cells(features.propagate(edges(spark, sf), vectors(spark, sf), nodes(spark, sf), DIM), "id")


# --- gated directed layer ---------------------------------------------------

_ROWN = "select src, dst, w / sum(w) over (partition by src) as w from edges"
_ROWN_IN = "select src, dst, w / sum(w) over (partition by src) as w from (select dst as src, src as dst, w from edges)"


def _prop_matrix(rows: str) -> str:
    return (
        "select src, dst, sum(w) as w from (select src, dst, sqrt(sum(w) + 1e-9) as w from "
        f"(select src, dst, 0.5*w*w as w from ({rows}) union all select dst, src, 0.5*w*w from ({rows})) group by 1, 2 "
        "union all select id, id, 1.0 from nodes) group by 1, 2"
    )


_LAYER_CTES = f"""m_out as ({_prop_matrix(_ROWN)}), m_in as ({_prop_matrix(_ROWN_IN)}),
    u as (select src, dst from edges union select dst, src from edges), l as (select src, dst from u union all select id, id from nodes),
    d as (select dst as id, count(*) as d from l group by 1),
    m_und as (select l.src, l.dst, sum(1.0/sqrt(a.d)/sqrt(b.d)) as w from l join d a on a.id = l.src join d b on b.id = l.dst group by 1, 2),
    g as (select id, (id % 3 + 1) / 2.0::double as c_in, (id % 5) / 4.0::double as c_out, 0.75::double as c_dir, (id % 2) + 0.5::double as c_und, 1.25::double as c_all from nodes)"""


def _path_linear(agg: str, salt: int, b1: int, b2: int) -> str:
    """(main + shared) transform plus both biases; the shared matrix has salt 9."""
    return (
        f"select x.id, j as i, sum(x.v * ({_w(salt)} + {_w(9)})) + {_b(b1)} + {_b(b2)} as v "
        f"from {agg} x, unnest(range(1, {OUT + 1})) t(j) group by 1, 2"
    )


_LAYER = f"""{_LAYER_CTES}, p_in as ({_prop('m_in', 'xl')}), p_out as ({_prop('m_out', 'xl')}), p_und as ({_prop('m_und', 'xl')}),
    y_in as ({_path_linear('p_in', 1, 1, 4)}), y_out as ({_path_linear('p_out', 2, 2, 5)}), y_und as ({_path_linear('p_und', 3, 3, 6)}),
    y as (select g.id, a.i, c_all * (c_und * c.v + c_dir * (c_in * a.v + c_out * b.v)) + ((g.id * 3 + a.i) % 5) / 10.0::double as v
      from g join y_in a on a.id = g.id join y_out b on b.id = g.id and b.i = a.i join y_und c on c.id = g.id and c.i = a.i)"""


def _layer() -> DirectedLayer:
    bias = {n: rule_vector(OUT, s) for n, s in zip(("in", "out", "und", "shared_in", "shared_out", "shared_und"), (1, 2, 3, 4, 5, 6))}
    return DirectedLayer(
        rule_matrix(OUT, DIM, 1), rule_matrix(OUT, DIM, 2), rule_matrix(OUT, DIM, 3), rule_matrix(OUT, DIM, 9), bias,
        rule_matrix(OUT, DIM, 6), rule_vector(OUT, 7),
    )


def _gates(spark, sf):
    i = F.col("id")
    return nodes(spark, sf).select(
        "id",
        ((i % 3 + 1) / 2.0).alias("c_in"),
        ((i % 5) / 4.0).alias("c_out"),
        F.lit(0.75).alias("c_dir"),
        ((i % 2) + 0.5).alias("c_und"),
        F.lit(1.25).alias("c_all"),
        F.array(*[((i * 3 + j) % 5) / 10.0 for j in range(1, OUT + 1)]).alias("constant"),
    )


def _matrices(spark, sf):
    return materialise(graph.layer_matrices(edges(spark, sf), nodes(spark, sf)))


@query("directed_layer", f"with {_LAYER} {_out('y')}")
def directed_layer(spark, sf):
    out = features.directed_layer(_matrices(spark, sf), vectors(spark, sf), _layer(), _gates(spark, sf))
    return cells(out, "id")


_STACK = f"""{_LAYER}, res as ({_lin('xl', 6, 7)}),
    s as (select y.id, y.i, case when y.v + res.v > 0 then y.v + res.v else 0.01 * (y.v + res.v) end as v from y join res on res.id = y.id and res.i = y.i)"""


@query("directed_stack", f"with {_STACK} {_out('s')}")
def directed_stack(spark, sf):
    out = features.directed_stack(_matrices(spark, sf), vectors(spark, sf), [_layer()], [_gates(spark, sf)])
    return cells(out, "id")


@query(
    "node_embeddings",
    f"with {_STACK}, nn as (select id, sqrt(sum(v*v)) + 1e-12 as n from s group by 1), z as (select s.id, i, v / nn.n as v from s join nn on nn.id = s.id) {_out('z')}",
)
def node_embeddings(spark, sf):
    out = features.embed_nodes(_matrices(spark, sf), vectors(spark, sf), [_layer()], [_gates(spark, sf)])
    return cells(out, "id")


@query(
    "class_scores",
    f"""with h as ({_lin('xl', 2, 3)}), hr as (select id, i, greatest(v, 0.0) as v from h), o as ({_lin('hr', 5, 1, 10)}),
    mx as (select id, max(v) as m from o group by 1), sm as (select o.id, m, ln(sum(exp(v - m))) as l from o join mx on mx.id = o.id group by 1, 2),
    y as (select o.id, o.i, v - m - l as v from o join sm on sm.id = o.id) {_out('y')}""",
)
def class_scores(spark, sf):
    out = features.class_scores(
        vectors(spark, sf), rule_matrix(OUT, DIM, 2), rule_vector(OUT, 3), rule_matrix(10, OUT, 5), rule_vector(10, 1)
    )
    return cells(out, "id")


@query("node_classifier")
def node_classifier(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    _, predictions = features.train_node_classifier(edges(spark, sf), nodes(spark, sf), vectors(spark, sf), labels, hops=1, max_iter=20)
    return predictions.select("id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


@query("record_vectors_from_levels")
def record_vectors_from_levels(spark, sf):
    records = seqs(spark, sf)
    vocab, es, _ = build_graph(records, 3)
    levels = hierarchical_embed(materialise(vocab), materialise(es), 3, [16, 8])
    return cells(embed_records(records, levels[3], 3), "key")


# --- convolutions -----------------------------------------------------------

_GCN_NORM = """e0 as (select src, dst, w from edges union all select id, id, 1.0 from nodes where id not in (select src from edges where src = dst)),
    dg as (select dst as id, sum(w) as d from e0 group by 1),
    gn as (select e0.src, e0.dst, w / sqrt(a.d) / sqrt(b.d) as w from e0 join dg a on a.id = e0.src join dg b on b.id = e0.dst)"""


@query(
    "gcn_convolution",
    f"with {_GCN_NORM}, p as ({_prop('gn', 'xl')}), y as ({_lin('p', 1, 2)}) {_out('y')}",
)
def gcn_convolution(spark, sf):
    return cells(convs.gcn_conv(edges(spark, sf), nodes(spark, sf), vectors(spark, sf), rule_matrix(OUT, DIM, 1), rule_vector(OUT, 2)), "id")


@query(
    "mean_neighbour_convolution",
    f"""with p as ({_prop('edges', 'xl', 'avg', '1.0')}), q as ({_all('p')}), a as ({_lin('q', 1, 2)}), b as ({_lin('xl', 3)}),
    y as (select a.id, a.i, a.v + b.v as v from a join b on b.id = a.id and b.i = a.i) {_out('y')}""",
)
def mean_neighbour_convolution(spark, sf):
    out = convs.sage_conv(
        edges(spark, sf), nodes(spark, sf), vectors(spark, sf), rule_matrix(OUT, DIM, 1), rule_matrix(OUT, DIM, 3), rule_vector(OUT, 2)
    )
    return cells(out, "id")


@query(
    "sum_mlp_convolution",
    f"""with p as ({_prop('edges', 'xl', 'sum', '1.0')}), q as ({_all('p')}),
    m as (select q.id, q.i, q.v + 1.5 * x.v as v from q join xl x on x.id = q.id and x.i = q.i),
    h as ({_lin('m', 1, 2)}), hr as (select id, i, greatest(v, 0.0) as v from h), y as ({_lin('hr', 3, 4, 5)}) {_out('y')}""",
)
def sum_mlp_convolution(spark, sf):
    out = convs.gin_conv(
        edges(spark, sf), nodes(spark, sf), vectors(spark, sf), rule_matrix(OUT, DIM, 1), rule_vector(OUT, 2),
        rule_matrix(5, OUT, 3), rule_vector(5, 4), eps=0.5,
    )
    return cells(out, "id")


@query(
    "chebyshev_convolution",
    f"""with pl as (select src, dst, w from edges where src <> dst), dg as (select src as id, sum(w) as d from pl group by 1),
    lp as (select pl.src, pl.dst, -w / sqrt(a.d) / sqrt(b.d) as w from pl join dg a on a.id = pl.src join dg b on b.id = pl.dst),
    p1 as ({_prop('lp', 'xl')}), t1 as ({_all('p1')}), p2 as ({_prop('lp', 't1')}), a2 as ({_all('p2')}),
    t2 as (select a2.id, a2.i, 2 * a2.v - x.v as v from a2 join xl x on x.id = a2.id and x.i = a2.i),
    y0 as ({_lin('xl', 1)}), y1 as ({_lin('t1', 2)}), y2 as ({_lin('t2', 3)}),
    y as (select y0.id, y0.i, y0.v + y1.v + y2.v + {_b(4, 'y0.i')} as v from y0 join y1 on y1.id = y0.id and y1.i = y0.i join y2 on y2.id = y0.id and y2.i = y0.i)
    {_out('y')}""",
)
def chebyshev_convolution(spark, sf):
    out = convs.cheb_conv(
        edges(spark, sf), nodes(spark, sf), vectors(spark, sf), [rule_matrix(OUT, DIM, s) for s in (1, 2, 3)], rule_vector(OUT, 4)
    )
    return cells(out, "id")


@query(
    "attention_convolution",
    f"""with lp as (select src, dst from edges where src <> dst union all select id, id from nodes),
    z as (select 0 as head, id, i, v from ({_lin('xl', 1, None, 4)}) union all select 1, id, i, v from ({_lin('xl', 2, None, 4)})),
    s as (select head, id, sum(v * case when head = 0 then {_b(3, 'i')} else {_b(5, 'i')} end) as s,
      sum(v * case when head = 0 then {_b(4, 'i')} else {_b(6, 'i')} end) as t from z group by 1, 2),
    sc as (select a.head, lp.src, lp.dst, case when a.s + b.t > 0 then a.s + b.t else 0.2 * (a.s + b.t) end as e
      from lp join s a on a.id = lp.src join s b on b.id = lp.dst and b.head = a.head),
    al as (select head, src, dst, exp(e - max(e) over (partition by head, dst)) as a from sc),
    nm as (select head, src, dst, a / sum(a) over (partition by head, dst) as a from al),
    y as (select nm.dst as id, nm.head * 4 + z.i as i, sum(a * z.v) + {_b(7, '(nm.head * 4 + z.i)')} as v from nm join z on z.id = nm.src and z.head = nm.head group by 1, nm.head, z.i)
    {_out('y')}""",
)
def attention_convolution(spark, sf):
    heads = [
        (rule_matrix(4, DIM, 1), rule_vector(4, 3), rule_vector(4, 4)),
        (rule_matrix(4, DIM, 2), rule_vector(4, 5), rule_vector(4, 6)),
    ]
    return cells(convs.gat_conv(edges(spark, sf), nodes(spark, sf), vectors(spark, sf), heads, rule_vector(8, 7)), "id")


@query(
    "relational_convolution",
    f"""with r as (select src, dst, cast((src + dst) % 2 as int) as rel from edges),
    mn as (select dst as id, rel, x.i, avg(x.v) as v from r join xl x on x.id = r.src group by 1, 2, 3),
    m0 as (select id, i, v from mn where rel = 0), m1 as (select id, i, v from mn where rel = 1),
    pt as ({_lin('xl', 3, 4)}), p0 as ({_lin('m0', 1)}), p1 as ({_lin('m1', 2)}),
    y as (select id, i, sum(v) as v from (select * from pt union all select * from p0 union all select * from p1) group by 1, 2) {_out('y')}""",
)
def relational_convolution(spark, sf):
    typed = edges(spark, sf).withColumn("rel", ((F.col("src") + F.col("dst")) % 2).cast("int"))
    out = convs.rgcn_conv(
        typed, nodes(spark, sf), vectors(spark, sf), [rule_matrix(OUT, DIM, 1), rule_matrix(OUT, DIM, 2)], rule_matrix(OUT, DIM, 3), rule_vector(OUT, 4)
    )
    return cells(out, "id")


@query(
    "bidirectional_convolution",
    f"""with {_GCN_NORM},
    b0 as (select dst as src, src as dst, w from edges union all select id, id, 1.0 from nodes where id not in (select src from edges where src = dst)),
    bd as (select dst as id, sum(w) as d from b0 group by 1),
    bn as (select b0.src, b0.dst, w / sqrt(a.d) / sqrt(b.d) as w from b0 join bd a on a.id = b0.src join bd b on b.id = b0.dst),
    pf as ({_prop('gn', 'xl')}), pb as ({_prop('bn', 'xl')}), f as ({_lin('pf', 1, 2)}), k as ({_lin('pb', 3, 4)}),
    c as (select id, i, v from f union all select id, i + {OUT}, v from k), y as ({_lin('c', 5, 6, 4)}) {_out('y')}""",
)
def bidirectional_convolution(spark, sf):
    out = convs.digcn_conv(
        edges(spark, sf), nodes(spark, sf), vectors(spark, sf),
        [(rule_matrix(OUT, DIM, 1), rule_vector(OUT, 2))], [(rule_matrix(OUT, DIM, 3), rule_vector(OUT, 4))],
        rule_matrix(4, 2 * OUT, 5), rule_vector(4, 6),
    )
    return cells(out, "id")


@query("convolution_models")
def convolution_models(spark, sf):
    es, ns, x = materialise(edges(spark, sf)), nodes(spark, sf), materialise(vectors(spark, sf))
    out = None
    for name in convs.MODELS:
        # one model at a time: in one plan the driver would hold the repeated tables of all of them
        h = materialise(convs.run_model(convs.ZooModel(name, [DIM, 8, 4], heads=2), es, ns, x))
        tagged = cells(h, "id").withColumn("model", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out
