"""Merkle manifest of a table with an inclusion proof for every row.

Rows are hashed where they are read; only digests move afterwards. The leaves of a tree are dealt to aligned runs of
`2 ** BLOCK_BITS` places. A task appends the leaves of one run in order: every open subtree carries the witnesses of
its leaves, and when a sibling subtree is complete, the witnesses of both are extended by the other's digest. The root
of a run is then one more append, on the level of runs, and so on until every tree has one node; the roots of the
trees are the leaves of a last tree. A row's witness is what its run, the run of its run and so on have attached.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators.ordering import global_rank
from seqweave.session import materialise

BLOCK_BITS = 9  # leaves of one appended run, as a power of two: what a task holds at once
#: how a node reaches its parent: its sibling's digest stands on the left, on the right, or there is none
LEFT, RIGHT, ALONE = "<", ">", "-"


def node_digest(*parts: bytes) -> bytes:
    """SHA-256 of hexadecimal digests laid side by side, as hexadecimal text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(columns: Sequence[str | Column]) -> Column:
    """SHA-256 of the values, each with its size in bytes before it, or `-` where it is null."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    sized = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*sized), 256)


class Frontier:
    """Open subtrees of a tree that grows by appending, smallest last, with the partial witnesses of all its leaves."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, int]] = []  # height, digest, first leaf
        self.paths: list[list[str]] = []
        self.witnesses: list[list[bytes]] = []

    def append(self, digest: bytes) -> None:
        self.open.append((0, digest, len(self.paths)))
        self.paths.append([])
        self.witnesses.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _join(self) -> None:
        height, right, middle = self.open.pop()
        _, left, first = self.open.pop()
        for i in range(first, middle):
            self.paths[i].append(RIGHT)
            self.witnesses[i].append(right)
        for i in range(middle, len(self.paths)):
            self.paths[i].append(LEFT)
            self.witnesses[i].append(left)
        self.open.append((height + 1, node_digest(left, right), first))

    def close(self, height: int) -> bytes:
        """The root at `height`; the last node of a level that has no sibling becomes its own parent's only child."""
        while len(self.open) > 1 or self.open[0][0] < height:
            low, digest, first = self.open[-1]
            if len(self.open) > 1 and self.open[-2][0] == low:
                self._join()
                continue
            for i in range(first, len(self.paths)):
                self.paths[i].append(ALONE)
            self.open[-1] = (low + 1, node_digest(digest), first)
        return self.open[0][1]


def _append_run(run: pa.Table) -> pa.Table:
    """Append one run: path and witness of every node, and the run's root beside its last one."""
    run = run.sort_by("_pos")
    frontier = Frontier()
    for digest in run["_digest"].to_pylist():
        frontier.append(digest.encode())
    whole, size = run["_size"][0].as_py(), 1 << BLOCK_BITS
    root = frontier.close(BLOCK_BITS if whole > size else (whole - 1).bit_length())
    run = run.append_column("_path", pa.array(["".join(p) for p in frontier.paths], pa.string()))
    run = run.append_column("_witness", pa.array([bytes.fromhex(b"".join(w).decode()) for w in frontier.witnesses], pa.binary()))
    return run.append_column("_root", pa.array([None] * (run.num_rows - 1) + [root.decode()], pa.string()))


def _with(df: DataFrame, more: str, without: Sequence[str] = ()) -> str:
    """The schema of `df` with more columns."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without), more])


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Append all nodes (_tree, _pos, _size, _digest, others) run by run and level by level.

    Returns the written levels and one row (_tree, _digest) for every tree. A level has 1 / 2 ** BLOCK_BITS of the
    rows of the one below, so there are two or three.
    """
    levels = []
    while True:
        runs = nodes.withColumn("_run", F.shiftright("_pos", BLOCK_BITS))
        level = materialise(runs.groupBy("_tree", "_run").applyInArrow(_append_run, _with(runs, "_path string, _witness binary, _root string")))
        levels.append(level)
        above = F.ceil(F.col("_size") / (1 << BLOCK_BITS)).cast("long").alias("_size")
        nodes = level.filter("_root is not null").select("_tree", F.col("_run").alias("_pos"), above, F.col("_root").alias("_digest"))
        if (nodes.agg(F.max("_size")).first()[0] or 0) <= 1:
            return levels, nodes.select("_tree", "_digest")


def _descend(levels: list[DataFrame], tops: DataFrame, facts: Sequence[str]) -> DataFrame:
    """Lengthen every node's path and witness by those of the runs above it; `tops` start with (_tree, _path, _witness)."""
    above = tops.withColumn("_pos", F.lit(0).cast("long"))
    for level in reversed(levels):
        upper = above.select("_tree", F.col("_pos").alias("_run"), F.col("_path").alias("_up"), F.col("_witness").alias("_on"), *facts)
        above = level.join(upper, ["_tree", "_run"]).withColumns({"_path": F.concat("_path", "_up"), "_witness": F.concat("_witness", "_on")})
    return above


def _placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add every leaf's place in its tree and the tree's size.

    One range sort over all trees, written once; the table joined back has a row for every tree in every sort
    partition, so that the leaves of a large tree are not gathered by its name.
    """
    sorted_once = materialise(leaves.orderBy("_tree", *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = sorted_once.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("_tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("_tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_n").over(tree).alias("_size"))
    return placed.join(starts, ["_tree", "_part"]).withColumn("_pos", F.col("_start") + F.col("_at") - F.col("_first"))


def manifest(rows: DataFrame, columns: Sequence[str], tree: str, order: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row (`order`, `carry`, leaf, subroot, root, path, witness, place) for every row of a table.

    The leaf is the digest of `columns`. The rows of each value of `tree` are the leaves of one tree in ascending
    `order`; the trees' roots, in bytewise order of the value (null first), are the leaves of the tree that gives
    `root`. `witness` holds the 32-byte digests of the siblings from the leaf upwards; `path` says for every level
    whether the sibling stands on the left or the right or is missing.

    Null values of `tree` make a tree of their own, rows with a null in `order` come first, a null value has a digest
    unlike that of any text. Rows that tie in `order` stand by their leaf digest; equal rows take places next to each
    other. A tree of one row has its leaf as root, an empty table gives an empty table. Other columns of the table,
    whatever their names, are left out; `carry` names expressions over them to be kept beside each row.
    """
    carry = carry or {}
    names = [order, *carry, "leaf"]
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("_tree")
    leaves = materialise(rows.select(order, *[c.alias(n) for n, c in carry.items()], leaf_digest(columns).alias("leaf"), key))
    nodes = _placed(leaves, [order, "leaf"]).select(*names, "_tree", "_pos", "_size", F.col("leaf").alias("_digest"))
    levels, subroots = _climb(nodes)
    subroots = materialise(subroots)  # one row a tree
    ranked = global_rank(subroots, ["_tree"], "_pos")
    size = F.lit(subroots.count()).cast("long").alias("_size")
    forest = ranked.select(F.lit("").alias("_tree"), "_pos", size, "_digest", F.col("_tree").alias("_of"), F.col("_digest").alias("subroot"))
    upper, root = _climb(forest)
    top = root.select("_tree", F.lit("").alias("_path"), F.lit(b"").alias("_witness"), F.col("_digest").alias("root"))
    tops = _descend(upper, top, ["root"]).select(F.col("_of").alias("_tree"), "_path", "_witness", "subroot", "root")
    found = _descend(levels, tops, ["subroot", "root"])
    return found.select(*names, "subroot", "root", F.col("_path").alias("path"), F.col("_witness").alias("witness"), F.col("_pos").alias("place"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        proofs, roots = [], []
        for leaf, path, witness in zip(*(rows[c].to_pylist() for c in ("_leaf", "path", "witness"))):
            digest, given, k = leaf.encode(), witness.hex().encode(), 0
            for step in path:
                if step == ALONE:
                    digest = node_digest(digest)
                    continue
                sibling, k = given[k : k + 64], k + 64
                digest = node_digest(sibling, digest) if step == LEFT else node_digest(digest, sibling)
            proofs.append(node_digest(given).decode())
            roots.append(digest.decode())
        kept = rows.drop_columns(["_leaf", "path", "witness"])
        yield kept.append_column("proof_sha256", pa.array(proofs, pa.string())).append_column("folded_root", pa.array(roots, pa.string()))


def fold_witnesses(proved: DataFrame, leaf: str | Column) -> DataFrame:
    """Recompute the root from `leaf` (never null) and each row's witness: adds `proof_sha256`, `folded_root`, `verified`.

    The proof's digest is taken over the siblings' digests in order, the digest of nothing where a row has none.
    """
    given = proved.withColumn("_leaf", leaf if isinstance(leaf, Column) else F.col(leaf))
    folded = given.mapInArrow(_fold, _with(given, "proof_sha256 string, folded_root string", ("_leaf", "path", "witness")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
