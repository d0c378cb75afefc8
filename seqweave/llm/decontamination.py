"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words; words at its open places are ignored. Hashes of the words at the other
places are looked up in those of the benchmark, so a substituted word hides only the seeds that look at it. Around
each hit text and benchmark item are laid side by side and the overlap is grown while it stays similar.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import per_worker, whole_text
from seqweave.llm.license_scan import words_of
from seqweave.operators.ordering import global_rank

#: Masks; at places marked 1 words must agree.
MASKS = ("11111111", "110110110111", "111010110011", "101100111011")
_FILTER_BITS = 22
_WORDS_KEPT = 1 << 18
_HOT_PAIRS = 1 << 16
_BLOCK_PLACES = 1 << 17
_WORD_COST = 96  # bytes of index a word: four hashes with item and place, the word's id
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordIds(dict):
    """64-bit ids of words; bounded, since a word's id follows from the word alone."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def ids_of(text: bytes, known: WordIds) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seed_hashes(ids: np.ndarray, places: Sequence[int]) -> np.ndarray:
    """One hash per position at which the mask fits."""
    n = len(ids) - places[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(len(places)), np.uint64)
    for p in places:
        h ^= ids[p : p + n]
        h *= _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def mask_places(masks: Sequence[str]) -> list[tuple[int, ...]]:
    return [tuple(i for i, c in enumerate(m) if c == "1") for m in masks]


class SeedIndex:
    """Hashes of a block of benchmark items in sorted arrays, with a small bit table in front of each."""

    def __init__(self, items: Sequence[tuple], masks: Sequence[str]):
        known = WordIds()
        self.keys = [k for k, _ in items]
        self.ids = [ids_of((t or "").encode(), known) for _, t in items]
        self.seeds = []
        shortest = min(map(len, masks))
        places = mask_places(masks)
        short = {len(x) for x in self.ids if 0 < len(x) < shortest}
        for mask in [*places, *[tuple(range(n)) for n in sorted(short)]]:
            solid_short = len(mask) < shortest and mask == tuple(range(len(mask)))
            held = [(i, seed_hashes(x, mask)) for i, x in enumerate(self.ids) if not solid_short or len(x) == len(mask)]
            hashes = np.concatenate([np.empty(0, np.uint64), *[h for _, h in held]])
            item = np.repeat(np.array([i for i, _ in held], np.int32), [len(h) for _, h in held])
            at = np.concatenate([np.empty(0, np.int32), *[np.arange(len(h), dtype=np.int32) for _, h in held]])
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            table = np.zeros(1 << _FILTER_BITS, bool)
            table[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.seeds.append((mask, hashes, item[order], at[order], table))

    def alignments(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """item -> ascending places of the item's first word in the text, one for each alignment with a seed hit."""
        found: list[np.ndarray] = [np.empty((0, 2), np.int64)]
        for mask, hashes, item, at, table in self.seeds:
            h = seed_hashes(ids, mask)
            p = np.flatnonzero(table[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            if not len(p) or not len(hashes):
                continue
            low, high = np.searchsorted(hashes, h[p], "left"), np.searchsorted(hashes, h[p], "right")
            hit = high > low
            p, low, n = p[hit], low[hit], (high - low)[hit]
            if not len(p):
                continue
            _, group, often = np.unique(low, return_inverse=True, return_counts=True)
            hot = often[group] * n > _HOT_PAIRS
            found += _laid_out(p[~hot], low[~hot], n[~hot], item, at)
            for g in np.unique(group[hot]).tolist():
                mine = np.flatnonzero(group == g)
                rows = slice(int(low[mine[0]]), int(low[mine[0]] + n[mine[0]]))
                items, first = np.unique(item[rows], return_index=True)
                for i, q in zip(items.tolist(), np.split(at[rows], first[1:])):
                    starts = differences(p[mine], q.astype(np.int64))
                    found.append(np.stack([np.full(len(starts), i), starts], axis=1))
        both = np.concatenate(found)
        if not len(both):
            return {}
        both = np.unique(both, axis=0)
        items, first = np.unique(both[:, 0], return_index=True)
        return dict(zip(items.tolist(), np.split(both[:, 1], first[1:])))


def _laid_out(p: np.ndarray, low: np.ndarray, n: np.ndarray, item: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """(item, place of its first word) of each hit at `p` with the index rows low .. low + n, in bounded pieces."""
    ends = np.cumsum(n)
    a = 0
    while a < len(p):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), "right")))
        many = n[a:b]
        rows = np.repeat(low[a:b] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        yield np.unique(np.stack([item[rows].astype(np.int64), np.repeat(p[a:b], many) - at[rows]], axis=1), axis=0)
        a = b


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Ascending distinct x - y for x of `p`, y of `q`; many pairs by a product of transforms, so a hot seed costs its places, not their pairs."""
    if len(p) * len(q) <= _HOT_PAIRS:
        return np.unique(p[:, None] - q[None, :])
    low, last = int(p.min()), int(q.max())
    n = int(p.max()) - low + last - int(q.min()) + 1
    size = 1 << n.bit_length()
    a, b = np.zeros(size), np.zeros(size)
    a[p - low] = 1
    b[last - q] = 1
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), size)[:n] > 0.5) + low - last


def best_overlaps(text: np.ndarray, item: np.ndarray, starts: np.ndarray, penalty: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word in the text, words, agreeing words) of the best stretch with the item's first word at each of `starts`.

    A stretch scores one for an agreeing word and loses `penalty` for a substituted one, so the best stretch holds
    at most one substitution in `penalty` + 1 words at either end. Words beyond either end of the text never agree.
    """
    at = starts[:, None] + np.arange(len(item))
    same = (at >= 0) & (at < len(text))
    same &= text[np.clip(at, 0, len(text) - 1)] == item
    none = np.zeros((len(starts), 1), np.int64)
    total = np.concatenate([none, np.cumsum(np.where(same, 1, -penalty), axis=1)], axis=1)
    end = np.argmax(total - np.minimum.accumulate(total, axis=1), axis=1)
    first = np.argmin(np.where(np.arange(total.shape[1]) <= end[:, None], total, np.iinfo(np.int64).max), axis=1)
    agreeing = np.concatenate([none, np.cumsum(same, axis=1)], axis=1)
    row = np.arange(len(starts))
    return starts + first, end - first, agreeing[row, end] - agreeing[row, first]


def overlaps(text: bytes, known: WordIds, seeds: SeedIndex, min_words: int) -> dict[int, tuple[int, int, int, int]]:
    """item -> (words of the text, first word, words, agreeing words) of the best overlap that is long enough.

    The best one has the most agreeing words, then the earliest place. Alignments are taken in the order of their
    place, in bounded blocks, until one holds all words of the item that the text has anywhere.
    """
    ids = ids_of(text, known)
    best: dict[int, tuple[int, int, int, int]] = {}
    for i, starts in seeds.alignments(ids).items():
        item = seeds.ids[i]
        most, least = int(np.isin(item, ids).sum()), min(min_words, len(item))
        step = max(1, _BLOCK_PLACES // len(item))
        for a in range(0, len(starts), step):
            first, n, agree = best_overlaps(ids, item, starts[a : a + step])
            long = np.flatnonzero(n >= least)
            if len(long):
                top = long[np.lexsort((first[long], -agree[long]))[0]]
                if i not in best or (agree[top], -first[top]) > (best[i][3], -best[i][1]):
                    best[i] = (len(ids), int(first[top]), int(n[top]), int(agree[top]))
            if i in best and best[i][3] == most:  # a later alignment cannot agree in more words and lies later
                break
    return best


def _searcher(index, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WordIds = per_worker("decontamination words", WordIds)
        seeds: SeedIndex = index.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_text").cast(pa.binary()).to_pylist()):
                rows += [(doc, seeds.keys[i], *best) for i, best in sorted(overlaps(text, known, seeds, min_words).items())]
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (batch.schema.field("_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["_id", "item_id", "n_words", "first_word", "overlap", "agreeing"])

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: Sequence[str] = MASKS,
    min_words: int = 10,
    block_bytes: int = 1 << 26,
) -> DataFrame:
    """One row per text and benchmark item that overlap: id, item_id, n_words, first_word, overlap, agreeing.

    Words are runs of letters, digits and anything beyond ASCII, A-Z in lower case, so punctuation and case do not
    matter. An overlap has `min_words` words or the whole item; the best one of each pair is returned. Null texts
    and items have no words and overlap with nothing; repeated items are found each, repeated rows are returned
    each; null ids stay null; other columns are ignored; empty tables give an empty result. The benchmark is a
    query set: it is taken in blocks of about `block_bytes` of index, each held by every worker while all texts
    pass, so its size sets the number of passes and never the memory (an item of more words is a block of its own).
    Items of one block are all that the driver sees. Repeated words cost no more than others: hits of a hot seed are
    combined by a transform, and alignments are compared in bounded blocks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = f"_id {kind}, item_id long, n_words long, first_word long, overlap long, agreeing long"
    parts = [rows.mapInArrow(_searcher(i, min_words), schema) for i in _indexes(benchmark, item_col, item_text_col, masks, block_bytes)]
    found = reduce(DataFrame.unionByName, parts)
    return found.select(F.col("_id").alias(id_col), "item_id", "n_words", "first_word", "overlap", "agreeing")


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, masks: Sequence[str], block_bytes: int) -> Iterator[Broadcast]:
    """The benchmark's seeds, one block of items at a time; equal items are dealt to different blocks."""
    items = benchmark.select(F.col(item_col).cast("long").alias("_item"), whole_text(text_col).alias("_text"))
    words = F.regexp_count("_text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(words)).first()[0] or 0
    n_blocks = -(-total * _WORD_COST // block_bytes) or 1
    if n_blocks > 1:
        items = global_rank(items, ["_item", "_text"], "_rank")
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.filter(F.col("_rank") % n_blocks == k)
        index = SeedIndex([(r["_item"], r["_text"]) for r in block.select("_item", "_text").orderBy("_item", "_text").collect()], masks)
        yield benchmark.sparkSession.sparkContext.broadcast(index)


def _keeper(index, place: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WordIds = per_worker("decontamination words", WordIds)
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not overlaps(t or b"", known, index.value, min_words) for t in texts], pa.bool_()))

    return run


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: Sequence[str] = MASKS,
    min_words: int = 10,
    block_bytes: int = 1 << 26,
) -> DataFrame:
    """`docs` without the rows whose text overlaps with an item, all columns as they are; null text stays.

    Rows are filtered where they are read, block by block of the benchmark: no text is shuffled.
    """
    for index in _indexes(benchmark, item_col, item_text_col, masks, block_bytes):
        docs = docs.mapInArrow(_keeper(index, docs.columns.index(text_col), min_words), docs.schema)
    return docs
