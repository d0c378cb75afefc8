"""Exact n-gram Jaccard join by PartEnum signatures.

Two sets of similar size with Jaccard similarity of at least T differ in at most k elements. The feature domain is
dealt into groups of partitions; some groups hold at most one of the k differences, so in those all but one
partition agree. A signature is what a set holds in all partitions of a group but one, for each choice of the one,
so similar sets share a signature. There are `slack` groups more than that argument needs; similar sets then share
more than `slack` signatures, and each set may leave out its `slack` poorest ones (fewest elements) in an order
common to all sets. That leaves out empty partitions and those that hold little but a widely shared passage.

Equal sets are found by their hash first and stand for each other from there on, so exact copies make no signatures.
Sets that share a signature are candidates. Each group of them is linked to one pivot; a parity bitmap bounds the
number of differing elements from below and drops most false candidates; the others are compared element by
element. Where a group falls into several components afterwards, the pairs across components are taken as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqweave.llm.common import whole_text
from seqweave.llm.components import connected_components
from seqweave.session import materialise, release

WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100
_RATIO = 1.5
_FILTER_BITS = 24
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TEXTS = 256  # texts taken from a batch at a time


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def _distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def _texts(batch: pa.RecordBatch, which: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A few rows at a time, those of `which`, with their texts, so that a batch is not held twice."""
    for at in range(0, batch.num_rows, _TEXTS):
        rows = batch.slice(at, _TEXTS)
        if which is not None:
            rows = rows.filter(pa.array(which[at : at + _TEXTS]))
        yield rows, rows.column("_text").cast(pa.binary()).to_pylist()


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles; a shorter text is one shingle, one without words has none."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    ids = np.frombuffer(b"".join(map(xxhash.xxh64_digest, tokens)), ">u8").astype(np.uint64)
    width = min(words, len(ids))
    n = len(ids) - width + 1
    h = np.full(n, width, np.uint64) * _M1
    for k in range(width):
        h = (h ^ ids[k : k + n]) * _M1
        h ^= h >> np.uint64(32)
    return _distinct(_mixed(h))


def bands(size: int, ratio: float = _RATIO) -> list[tuple[int, int]]:
    """Size bands (number, largest size) under which a set of this size looks for partners.

    A set is filed in its own band, and in the band below if a partner of four fifths of its size may be there.
    """
    number, low, before = 0, 1, 0
    while (high := max(low, int(low * ratio))) < size:
        number, low, before = number + 1, high + 1, high
    own = [(number, high)]
    if number and -(-size * NUMERATOR // DENOMINATOR) <= before:
        own.append((number - 1, before))
    return own


def most_differences(largest: int) -> int:
    """Of two similar sets, the smaller with at most `largest` elements."""
    other = largest * DENOMINATOR // NUMERATOR
    return (largest + other) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def layout(largest: int) -> tuple[int, int]:
    """(groups, slack) of a band: so many groups of partitions that more than `slack` of them hold at most one difference."""
    k = most_differences(largest)
    slack = k // 8 + 2 if k else 0
    return k // 2 + 1 + slack, slack


def signatures(elements: np.ndarray, n2: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(signatures, their elements' counts, slack) of a set in each of its bands."""
    for number, largest in bands(len(elements)):
        groups, slack = layout(largest)
        parts = groups * n2
        # the hash's top bits deal elements to partitions, so each partition is a run of the ascending hashes
        part = ((elements >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(elements ^ _M1))])
        content = (sums[edges[1:]] - sums[edges[:-1]]).reshape(groups, n2)
        count = (edges[1:] - edges[:-1]).reshape(groups, n2)
        place = np.arange(parts, dtype=np.uint64).reshape(groups, n2) + np.uint64((number + 1) << 32)
        kept = content.sum(axis=1, keepdims=True, dtype=np.uint64) - content
        size = count.sum(axis=1, keepdims=True) - count
        yield _mixed(kept + _mixed(place * _M1)).reshape(-1), size.reshape(-1), slack


def richest(elements: np.ndarray, n2: int) -> np.ndarray:
    """Signatures of all bands without the poorest `slack` of each."""
    kept = []
    for sig, size, slack in signatures(elements, n2):
        kept.append(sig[np.lexsort((sig, -size))[: len(sig) - slack]])
    return np.concatenate(kept)


def parity_bitmap(elements: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the elements dealt to i: two bitmaps differ in at most as many bits as their sets in elements.

    The number of bits is a power of two of at least twice the set's size; halves can be folded by XOR.
    """
    bits = max(64, 1 << int(2 * len(elements) - 1).bit_length())
    dealt = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((dealt & 1).astype(np.uint8), bitorder="little").view("<i8")


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, key and bitmap of each row's set."""
    for batch, texts in (part for whole in batches for part in _texts(whole)):
        n, keys, maps = [], [], []
        for text in texts:
            s = shingle_set(text)
            n.append(len(s))
            keys.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
            maps.append(parity_bitmap(s) if len(s) else np.empty(0, np.int64))
        arrays = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(maps, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "n_shingles", "set_key", "bitmap"])


def passes(nodes: np.ndarray, table: np.ndarray | None) -> np.ndarray:
    """Which nodes the bit table of `node_filter` lets through."""
    if table is None:
        return np.ones(len(nodes), bool)
    at = _mixed(nodes.view(np.uint64)) >> np.uint64(64 - _FILTER_BITS)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _wanted(batches: Iterator[pa.RecordBatch], table) -> Iterator[tuple[int, np.ndarray]]:
    """(node, set) of the rows whose node passes the filter."""
    bits = None if table is None else np.frombuffer(table.value, np.uint8)
    for batch in batches:
        for rows, texts in _texts(batch, passes(batch.column("node").to_numpy(), bits)):
            for node, text in zip(rows.column("node").to_pylist(), texts):
                s = shingle_set(text)
                if len(s):
                    yield node, s


def _close_pairs(node: np.ndarray, component: np.ndarray, size: np.ndarray, block: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """Pairs of a group in different components (and blocks, if there are two) that sizes and bitmaps do not exclude."""
    found, widths = [], np.fromiter(map(len, maps), np.int64, len(maps))
    two = bool((block != block[0]).any())

    def compare(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> None:
        words = of_a.shape[1]
        wide = max(1, _COMPARED_WORDS // words)
        for start in range(0, len(b), wide):
            cols, of_cols = b[start : start + wide], of_b[start : start + wide]
            tall = max(1, _COMPARED_WORDS // (words * len(cols)))
            for low in range(0, len(a), tall):
                rows = a[low : low + tall]
                apart = np.bitwise_count(of_a[low : low + tall, None, :] ^ of_cols[None, :, :]).sum(axis=2, dtype=np.int64)
                total = size[rows][:, None] + size[cols][None, :]
                apart = np.maximum(apart, np.abs(size[rows][:, None] - size[cols][None, :]))
                good = (component[rows][:, None] != component[cols][None, :]) & (apart * (DENOMINATOR + NUMERATOR) <= total * (DENOMINATOR - NUMERATOR))
                if two:
                    good &= block[rows][:, None] != block[cols][None, :]
                i, j = np.nonzero(good)
                found.append(np.stack([node[rows[i]], node[cols[j]]], axis=1))

    for width in np.unique(widths).tolist():
        a = np.flatnonzero(widths == width)
        of_a = np.stack([maps[i] for i in a])
        compare(a, a, of_a, of_a)
        # sets of similar size have bitmaps of the same width or of the double one, which is folded
        b = np.flatnonzero(widths == 2 * width)
        if len(b):
            of_b = np.stack([maps[i] for i in b])
            compare(a, b, of_a, of_b[:, :width] ^ of_b[:, width:])
    return np.concatenate(found)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Close pairs of each group, from rows in the order of the group's key (sig, low, high)."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("sig", "low", "high")], axis=1)
        node, component, size, block = (batch.column(c).to_numpy() for c in ("node", "component", "n_shingles", "block"))
        offsets = batch.column("bitmap").offsets.to_numpy()
        values = batch.column("bitmap").values.to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.empty(0, np.int64)
        out = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
            if key is not None and tuple(keys[a]) != key:
                out += _group_pairs(held)
                held = []
            key = tuple(keys[a])
            held.append((node[a:b], component[a:b], size[a:b], block[a:b], [values[offsets[i] : offsets[i + 1]] for i in range(a, b)]))
        if out:
            both = np.concatenate(out)
            yield _pair_batch(both[:, 0], both[:, 1])
    if held and (out := _group_pairs(held)):
        both = np.concatenate(out)
        yield _pair_batch(both[:, 0], both[:, 1])


def _group_pairs(held: list[tuple]) -> list[np.ndarray]:
    if sum(len(x[0]) for x in held) < 2:
        return []
    node, component, size, block = (np.concatenate([x[i] for x in held]) for i in range(4))
    if (component == component[0]).all():
        return []
    return [_close_pairs(node, component, size, block, [m for x in held for m in x[4]])]


def _pair_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0) if len(u) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])


_SIGNATURE_BLOCK = 1 << 19
_COMPARED_WORDS = 1 << 21
_SMALL_GROUP = 64
_BLOCK_NODES = 4096
_SIGNATURE_ROW = "sig long, node long, pivot long"


def _signature_rows(n2: int, table):
    """Rows (sig, node, null) of the nodes that pass the filter. A block keeps one node of each signature and links the others to it.

    Such links are rows (any hash, node, pivot). What a third of all rows share so leaves each block as one row.
    """

    def block(sigs: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        sig, node = np.concatenate(sigs), np.repeat(np.array(nodes, np.int64), [len(x) for x in sigs])
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        pivot = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
        tied = np.flatnonzero(~first & (node != pivot))
        edges = np.unique(np.stack([pivot[tied], node[tied]], axis=1), axis=0)
        spread = _mixed(edges[:, 0].view(np.uint64) ^ _mixed(edges[:, 1].copy().view(np.uint64))).view(np.int64)
        columns = (
            [pa.array(sig[first].view(np.int64)), pa.array(spread)],
            [pa.array(node[first]), pa.array(edges[:, 1])],
            [pa.nulls(int(first.sum()), pa.int64()), pa.array(edges[:, 0])],
        )
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["sig", "node", "pivot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, waiting = [], [], 0
        for node, s in _wanted(batches, table):
            sigs.append(richest(s, n2))
            nodes.append(node)
            waiting += len(sigs[-1])
            if waiting >= _SIGNATURE_BLOCK:
                yield block(sigs, nodes)
                sigs, nodes, waiting = [], [], 0
        if nodes:
            yield block(sigs, nodes)

    return run


def _feature_rows(table, features):
    """Rows (sig, node) of the nodes that pass the filter, one for each value of `features` of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, nodes, waiting = [], [], 0

        def block() -> pa.RecordBatch:
            node = np.repeat(np.array(nodes, np.int64), [len(x) for x in values])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64)), pa.array(node)], names=["sig", "node"])

        for node, s in _wanted(batches, table):
            values.append(features(s))
            nodes.append(node)
            waiting += len(values[-1])
            if waiting >= _SIGNATURE_BLOCK:
                yield block()
                values, nodes, waiting = [], [], 0
        if nodes:
            yield block()

    return run


def _star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of the signature: each node of a signature with the signature's first node, and the links."""
    last_sig = last_pivot = None
    for batch in batches:
        linked = pc.is_valid(batch.column("pivot"))
        links, rows = batch.filter(linked), batch.filter(pc.invert(linked))
        if links.num_rows:
            yield _pair_batch(links.column("pivot").to_numpy(), links.column("node").to_numpy())
        if not rows.num_rows:
            continue
        sig, node = rows.column("sig").to_numpy(), rows.column("node").to_numpy()
        first = np.concatenate([[last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]])
        starts, group = np.flatnonzero(first), np.cumsum(first) - 1
        pivot = np.full(len(node), 0 if last_pivot is None else last_pivot, np.int64)
        pivot[group >= 0] = node[starts[group[group >= 0]]]
        tied = pivot != node
        yield _pair_batch(pivot[tied], node[tied])
        last_sig, last_pivot = sig[-1], pivot[-1]


def _element_rows(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in block])]).astype(np.int32)
            values = np.concatenate([s for _, s in block]).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in block], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["node", "elements"]
            )

        held = 0
        for node, s in _wanted(batches, table):
            block.append((node, s))
            held += len(s)
            if held >= 1 << 18:
                yield rows()
                block.clear()
                held = 0
        if block:
            yield rows()

    return run


def node_filter(nodes: DataFrame):
    """A broadcast bit table of 2 ** 24 bits that every given node passes; its size does not depend on their number."""
    spark = nodes.sparkSession

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_mixed(batch.column("node").to_numpy().view(np.uint64)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.left_shift(np.int64(1), at & 31))], names=["word", "bit"])

    words = nodes.select("node").mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << (_FILTER_BITS - 5), np.uint32)
    for word, value in words.collect():
        table[word] = value
    return spark.sparkContext.broadcast(table.tobytes())


def differing_bits(a: Column, b: Column) -> Column:
    """Lower bound of the number of elements in which two sets differ; the longer bitmap is folded to the shorter one."""

    def folded(long: Column, short: Column) -> Column:
        n = F.size(short)
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(long) / n).cast("int") - 1), lambda j: F.slice(long, j * n + 1, n))
        return F.aggregate(blocks, F.array_repeat(F.lit(0).cast("long"), n), lambda acc, x: F.zip_with(acc, x, lambda p, q: p.bitwiseXOR(q)))

    def count(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, c: acc + c)

    return F.when(F.size(a) == F.size(b), count(a, b)).when(F.size(a) > F.size(b), count(folded(a, b), b)).otherwise(count(a, folded(b, a)))


def may_be_similar(n_a: Column, n_b: Column, differing: Column) -> Column:
    """No two sets of these sizes with so many differing elements are excluded wrongly."""
    return differing * (DENOMINATOR + NUMERATOR) <= (n_a + n_b) * (DENOMINATOR - NUMERATOR)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


class _Join:
    """The steps of one join; `rows` has _id, node and _text."""

    def __init__(self, rows: DataFrame, n2: int):
        self.n2, self.texts = n2, rows.select("node", "_text")
        kind = rows.schema["_id"].dataType.simpleString()
        measured = rows.mapInArrow(_set_rows, f"_id {kind}, node long, n_shingles long, set_key long, bitmap array<long>")
        self.members = materialise(measured)
        held = self.members.filter("n_shingles > 0")
        self.sets = held.select("node", "n_shingles", "bitmap")
        # equal sets are one: the smallest node of each stands for it, the others are linked to it
        firsts = held.groupBy("set_key").agg(F.min("node").alias("_first"), F.max("node").alias("_last"))
        self.heads = materialise(firsts.select(F.col("_first").alias("node")).distinct())
        shared = firsts.filter("_first != _last").select("set_key", F.col("_first").alias("u"))
        same = held.select("set_key", F.col("node").alias("v")).join(shared, "set_key").filter("u != v")
        self.equal = materialise(same.select("u", "v").distinct())

    def candidates(self) -> DataFrame:
        """(u, v) pairs: the nodes of each signature with its pivot."""
        rows = self.texts.mapInArrow(_signature_rows(self.n2, node_filter(self.heads)), _SIGNATURE_ROW)
        return rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_star_rows, "u long, v long").distinct()

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Pairs that the bitmaps do not exclude, with the lower bound of their difference."""
        a = self.sets.select(F.col("node").alias("u"), F.col("n_shingles").alias("_nu"), F.col("bitmap").alias("_bu"))
        b = self.sets.select(F.col("node").alias("v"), F.col("n_shingles").alias("_nv"), F.col("bitmap").alias("_bv"))
        joined = pairs.join(a, "u").join(b, "v").select("u", "v", "_nu", "_nv", differing_bits(F.col("_bu"), F.col("_bv")).alias("apart"))
        return joined.filter(may_be_similar(F.col("_nu"), F.col("_nv"), F.col("apart"))).groupBy("u", "v").agg(F.min("apart").alias("apart"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs of similar sets, element by element; only sets of nodes in `pairs` are built and moved."""
        elements = self.texts.mapInArrow(_element_rows(node_filter(_ends(pairs))), "node long, elements array<long>")
        a = elements.select(F.col("node").alias("u"), F.col("elements").alias("_eu"))
        b = elements.select(F.col("node").alias("v"), F.col("elements").alias("_ev"))
        joined = pairs.select("u", "v").join(a, "u").join(b, "v")
        common = joined.select("u", "v", F.size("_eu").alias("_nu"), F.size("_ev").alias("_nv"), F.size(F.array_intersect("_eu", "_ev")).alias("_common"))
        similar = F.col("_common") * DENOMINATOR >= (F.col("_nu") + F.col("_nv") - F.col("_common")) * NUMERATOR
        return materialise(common.filter(similar).select("u", "v").distinct())

    def components(self) -> DataFrame:
        """(node, component) of all nodes that are linked with another."""
        pairs = materialise(self.candidates())
        close = materialise(self.bounded(pairs))
        # first each node with the partner that looks most like it: most components come from these alone
        ends = close.select("u", "v", "apart").unionByName(close.select(F.col("v").alias("u"), F.col("u").alias("v"), "apart"))
        nearest = ends.groupBy("u").agg(F.min(F.struct("apart", "v")).alias("_m")).select("u", F.col("_m.v").alias("v"))
        nearest = materialise(nearest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        links = self.equal.unionByName(self.verified(nearest))
        labels = connected_components(links)
        # then the other candidates that would join two components
        rest = materialise(_across(close, labels).join(nearest, ["u", "v"], "left_anti"))
        if not rest.isEmpty():
            links, labels = self.grown(links, labels, rest)
        release(close, nearest, rest)
        # last the pairs of one signature's group that had no pivot among them
        mixed = self.mixed_groups(pairs, labels)
        if mixed is None:
            release(pairs)
            return labels
        while True:  # one node stands for its component, until that joins no more of them
            more = materialise(self.bounded(_renamed(mixed, labels).transform(_heads).join(pairs, ["u", "v"], "left_anti")))
            known, (links, labels) = labels, self.grown(links, labels, more)
            release(more)
            if labels is known:
                break
        # then node by node: in small groups directly, of large ones by the rarest features of their nodes
        placed = materialise(_renamed(mixed, labels))
        small = placed.filter(F.col("n") <= _SMALL_GROUP).select("sig", "node", "component", "n")
        crossing = self.crossing(small.unionByName(self.rarest_features(placed, labels)))
        more = materialise(crossing.join(pairs, ["u", "v"], "left_anti"))
        release(pairs, mixed, placed)
        if not more.isEmpty():
            links, labels = self.grown(links, labels, more)
        release(more)
        return labels

    def grown(self, links: DataFrame, labels: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links and labels with the similar ones of `pairs` added; the same objects if there are none."""
        found = self.verified(pairs)
        if found.isEmpty():
            return links, labels
        links = links.unionByName(found)
        wider = connected_components(links)
        release(labels)
        return links, wider

    def crossing(self, rows: DataFrame) -> DataFrame:
        """Pairs of nodes that share a signature, are in different components and are not excluded by size and bitmap.

        A group is compared in blocks of about `_BLOCK_NODES` nodes; one of more nodes is dealt to pairs of blocks.
        """
        blocks = F.ceil(F.col("n") / _BLOCK_NODES).cast("int")
        dealt = rows.join(self.sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        keyed = dealt.select(
            "sig", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "node", "component", "n_shingles", "block", "bitmap"
        )
        key = ["sig", "low", "high"]
        return keyed.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compared, "u long, v long").distinct()

    def mixed_groups(self, pairs: DataFrame, labels: DataFrame) -> DataFrame | None:
        """(sig, node, n) of signatures held by `n` nodes of several components; None if there are none.

        Only nodes of components that a candidate pair touches and does not join are looked at again.
        """
        apart = _across(pairs, labels).select(F.explode(F.array("_cu", "_cv")).alias("component")).distinct()
        named = _renamed(self.heads, labels)
        nodes = materialise(named.join(apart, "component", "left_semi"))
        if nodes.isEmpty():
            return None
        n2 = self.n2
        rows = self.texts.mapInArrow(_feature_rows(node_filter(nodes), lambda s: richest(s, n2)), "sig long, node long").join(nodes, "node")
        held = Window.partitionBy("sig")
        counted = rows.withColumns({"_a": F.min("component").over(held), "_b": F.max("component").over(held), "n": F.count(F.lit(1)).over(held)})
        return materialise(counted.filter("_a != _b").select("sig", "node", "n"))

    def rarest_features(self, placed: DataFrame, labels: DataFrame) -> DataFrame:
        """(sig, node, component) with single shingles as signatures, for the nodes of large mixed groups.

        Similar sets share four fifths of either, so among the rarest fifth and one more of each (in the order of
        holders and hash, the same for all) they share one. What a common passage adds is not among the rarest.
        """
        large = placed.filter(F.col("n") > _SMALL_GROUP)
        # a node counts only where another component holds the signature still
        held = Window.partitionBy("sig")
        apart = large.withColumns({"_a": F.min("component").over(held), "_b": F.max("component").over(held)}).filter("_a != _b")
        nodes = materialise(apart.select("node").distinct())
        rows = self.texts.mapInArrow(_feature_rows(node_filter(nodes), lambda s: s), "sig long, node long").join(nodes, "node", "left_semi")
        shared = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sig"))).filter("n > 1")
        sizes = self.sets.groupBy("node").agg(F.max("n_shingles").alias("_size"))
        first = Window.partitionBy("node").orderBy("n", "sig")
        ranked = shared.withColumns({"_at": F.row_number().over(first), "_shared": F.count(F.lit(1)).over(Window.partitionBy("node"))})
        prefix = F.col("_size") - F.ceil(F.col("_size") * NUMERATOR / DENOMINATOR) + 1
        kept = ranked.join(sizes, "node").filter(F.col("_at") <= prefix - (F.col("_size") - F.col("_shared")))
        return _renamed(kept.select("sig", "node", "n"), labels).select("sig", "node", "component", "n")


def _renamed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return _named(rows, "node", labels).withColumnRenamed("_cnode", "component")


def _heads(rows: DataFrame) -> DataFrame:
    """Pairs of the first component's smallest node in a signature's group with that of each other component."""
    heads = rows.groupBy("sig", "component").agg(F.min("node").alias("node"))
    firsts = heads.groupBy("sig").agg(F.min(F.struct("component", "node")).alias("_f"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    found = heads.join(firsts, "sig").filter("component != _f.component").select(F.col("_f.node").alias("_u"), F.col("node").alias("_v"))
    return found.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct()


def _named(rows: DataFrame, end: str, labels: DataFrame) -> DataFrame:
    """With the component of a node; a node without links is its own."""
    own = labels.select(F.col("node").alias(end), F.col("component").alias(f"_c{end}"))
    return rows.join(own, end, "left").withColumn(f"_c{end}", F.coalesce(f"_c{end}", end))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    return _named(_named(pairs, "u", labels), "v", labels).filter("_cu != _cv")


def _placed(docs: DataFrame, id_col: str, text_col: str, n2: int, carried: Column) -> DataFrame:
    """Per row `carried` as _id, node, n_shingles and the node's component _cnode."""
    kind, text = docs.schema[id_col].dataType, whole_text(text_col)
    known = F.col(id_col).cast("long") if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else F.xxhash64(F.col(id_col))
    node = F.when(F.col(id_col).isNull(), F.xxhash64(text).bitwiseOR(F.lit(-(1 << 63)))).otherwise(known)
    join = _Join(docs.select(carried.alias("_id"), node.alias("node"), text.alias("_text")), n2)
    return _named(join.members.select("_id", "node", "n_shingles"), "node", join.components())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n2: int = 2) -> DataFrame:
    """One row per input row: id, n_shingles and component_id, the smallest id that links lead to, itself included.

    Words end at ASCII white space, A-Z count as a-z; a set holds the distinct five-word shingles, the whole text as
    one if it has fewer words, nothing without words or text. Sets link from a Jaccard similarity of 80 / 100 on; an
    empty set links with nothing. Rows that share an id are one document, linked if any of its texts is; rows
    without an id are linked through their texts and take the smallest id they reach, or null; other columns are
    ignored; an empty table gives an empty result. Similarity is exact up to collisions of 64-bit hashes.
    """
    kind = docs.schema[id_col].dataType
    placed = _placed(docs, id_col, text_col, n2, F.col(id_col))
    # the smallest node is the smallest id already, but for other id types and rows without an id
    least = placed.groupBy("_cnode").agg(F.min("_id").alias("_least")).filter(~F.col("_least").cast("string").eqNullSafe(F.col("_cnode").cast("string")))
    own = F.when(F.col("_renamed"), F.col("_least")).otherwise(F.col("_cnode").cast(kind))
    out = placed.join(least.withColumn("_renamed", F.lit(True)), "_cnode", "left")
    return out.select(F.col("_id").alias(id_col), "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: of the rows of its smallest id, or of its rows if none has an id, one.

    Rows of that id with words come first, then the smallest hash of the text decides; of rows equal in both any one
    stays. Rows without an id and without words are partners of nothing and stay. Which rows stay is a narrow table
    of ids and hashes; texts move once, for the join with it, and again only where rows repeat.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("hash"))
    rows = _placed(docs, id_col, text_col, 2, key).select("_cnode", "_id.id", "_id.hash", (F.col("n_shingles") == 0).alias("bare"))
    lost = F.col("id").isNull() & F.col("bare")
    copies = rows.filter(~lost).groupBy("_cnode", "id", "bare", "hash").agg(F.count(F.lit(1)).alias("n"))
    first = copies.groupBy("_cnode").agg(F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "bare", "hash", "n")).alias("_f"))
    chosen = first.select("_f.id", "_f.hash", (F.col("_f.n") > 1).alias("_repeats"))
    chosen = chosen.unionByName(rows.filter(lost).select("id", "hash", F.lit(False).alias("_repeats")).distinct())
    kept = materialise(chosen.select(F.struct("id", "hash").alias("_kept"), "_repeats"))
    stay = docs.join(kept.filter("not _repeats"), key.eqNullSafe(F.col("_kept")), "left_semi")
    repeats = kept.filter("_repeats")
    if repeats.isEmpty():
        return stay
    held = docs.join(repeats, key.eqNullSafe(F.col("_kept"))).select("_kept", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return stay.unionByName(held.groupBy("_kept").agg(F.first("_row").alias("_row")).select("_row.*"))
