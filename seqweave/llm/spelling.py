"""Spelling variants of the corpus vocabulary, found with a bit-sliced position index.

Words one edit apart are alike either before or behind the edit. So every word is filed under its first half and under
its last half (cells); cells that hold too many words are filed again under a longer fixed part, which leaves a shorter
free one, until none is too large or the free part is a single letter. Cells are dealt to tasks by their key. A task
makes one bitset a (position, letter) over its words of two neighbouring lengths and runs the words of the shorter
length through it: the set that agrees so far and the sets that differ by one replaced or one additional letter
are carried from position to position, 64 words an operation.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import whole_text
from seqweave.session import materialise

RUN = "[A-Za-zÀ-ÿ]+"
LOWER = {i: i + 32 for i in range(65, 91)}
HELD_WORDS = 1 << 19  # different words that a counting task holds before it passes them on
CELL_WORDS = 4096  # words of a cell that is not split further
TASK_WORDS = 1 << 14  # rows of the cells that one task compares at a time
BITS_BYTES = 1 << 26  # bytes of one position index
STATE_BYTES = 1 << 22  # bytes of one set of all queries that run together


def damaged(doc_id: int | None, run: str, every: int = 97) -> str:
    """The lower-cased run, one letter removed where its checksum with the document's id says so."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def passed_on():
        found = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return found

    held: Counter[str] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["_text"].to_pylist()):
            for run, n in Counter(re.findall(RUN, text.translate(LOWER))).items():
                held[damaged(doc_id, run)] += n
            if len(held) >= HELD_WORDS:
                yield passed_on()
    yield passed_on()


def vocabulary(docs: DataFrame, text: str = "text", min_letters: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the words of at least `min_letters` code points that occur at least `min_count` times overall."""
    counted = docs.select("doc_id", whole_text(text).alias("_text")).mapInArrow(_count_batches, "word string, n long")
    return counted.filter(F.char_length("word") >= min_letters).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class PositionIndex:
    """One bitset of words a (position, letter); letters that no word has at a position, and positions beyond, are empty."""

    def __init__(self, letters: np.ndarray) -> None:
        """`letters`: code points, one row a word, 0 behind its end."""
        words, width = letters.shape
        self.words, self.width = words, width
        self.size = -(-words // 64)
        place = np.arange(words)
        self.known, self.sets = [], []
        for p in range(width):
            known, row = np.unique(letters[:, p], return_inverse=True)
            marks = np.zeros((len(known) + 1, self.size * 64), bool)
            marks[row, place] = True
            if known[0] == 0:
                marks[0] = False  # the end of a word is no letter
            self.known.append(known)
            self.sets.append(np.packbits(marks, axis=1, bitorder="little").view("<u8"))

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """The sets of words that have these letters at a position, one row a letter."""
        if position >= self.width:
            return np.zeros((len(letters), self.size), "<u8")
        known = self.known[position]
        k = np.searchsorted(known, letters)
        k[k == len(known)] = 0
        return self.sets[position][np.where(known[k] == letters, k, len(known))]

    def one_edit(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries of one length: the words with one letter replaced, and those with one more letter.

        `exact` agrees with every letter so far; `replaced` had one other letter; `longer` had one additional letter,
        so that it agrees one position further on.
        """
        exact = np.full((len(queries), self.size), ~np.uint64(0))
        replaced, longer = np.zeros_like(exact), np.zeros_like(exact)
        for p in range(queries.shape[1]):
            here, after = self.at(p, queries[:, p]), self.at(p + 1, queries[:, p])
            replaced = (replaced & here) | (exact & ~here)
            longer = (longer | exact) & after
            exact &= here
        return replaced, longer | exact


def _members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of all bits that are set."""
    row, word = np.nonzero(sets)
    bits = np.unpackbits(sets[row, word].view(np.uint8).reshape(len(row), 8), axis=1, bitorder="little")
    k, bit = np.nonzero(bits)
    return row[k], word[k] * 64 + bit


def _mask(chosen: np.ndarray, size: int) -> np.ndarray:
    marks = np.zeros(size * 64, bool)
    marks[: len(chosen)] = chosen
    return np.packbits(marks, bitorder="little").view("<u8")


def near_pairs(words: list[str], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of words one edit apart, a of `length` letters and b of as many or one more; `words` have either.

    A replaced letter gives both (a, b) and (b, a), an additional one the pair from the shorter word.
    """
    sizes = np.array([len(w) for w in words])
    queries = np.flatnonzero(sizes == length)
    if not len(queries) or len(words) < 2:
        return
    letters = np.zeros((len(words), length + 1), np.uint32)
    for k, w in enumerate(words):
        letters[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), "<u4")
    block = max(64, BITS_BYTES // (16 * (length + 1)) // 64 * 64)  # a position has few letters: some 16 bytes of bitsets a word
    for low in range(0, len(words), block):
        index = PositionIndex(letters[low : low + block])
        same, more = _mask(sizes[low : low + block] == length, index.size), _mask(sizes[low : low + block] > length, index.size)
        step = max(1, STATE_BYTES // (8 * index.size))
        for k in range(0, len(queries), step):
            asked = queries[k : k + step]
            replaced, longer = index.one_edit(letters[asked, :length])
            row, bit = _members((replaced & same) | (longer & more))
            yield asked[row], bit + low


def _compare_cells(group: pa.Table) -> pa.Table:
    """The near pairs of the words of one task, both ways round, each with the other word's count."""
    group = group.select(["length", "word", "n"])
    out: dict[str, list[np.ndarray]] = {"word": [], "near": [], "n": []}
    lengths = group["length"].to_numpy()
    for length in np.unique(lengths):
        part = group.filter(pa.array(lengths == length)).group_by("word").aggregate([("n", "max")])
        words, counts = part["word"].to_pylist(), part["n_max"].to_numpy()
        names = np.array(words, object)
        size = np.array([len(w) for w in words])
        for a, b in near_pairs(words, int(length)):
            back = size[b] > length
            out["word"] += [names[a], names[b[back]]]
            out["near"] += [names[b], names[a[back]]]
            out["n"] += [counts[b], counts[a[back]]]
    joined = {c: np.concatenate(v) if v else np.array([], object if c != "n" else np.int64) for c, v in out.items()}
    return pa.table([pa.array(joined["word"], pa.string()), pa.array(joined["near"], pa.string()), pa.array(joined["n"], pa.int64())], ["word", "near", "near_n"])


def _keyed(cells: DataFrame) -> DataFrame:
    """The key of a cell: its free part [lo, hi) of words of `length` letters, and the letters before and behind it."""
    fixed = [F.substring(F.col("word"), F.lit(1), F.col("lo")), F.right(F.col("word"), F.col("length") - F.col("hi"))]
    return cells.withColumn("key", F.xxhash64("length", "lo", "hi", *fixed))


def _halved(cells: DataFrame) -> DataFrame:
    """Every row under both halves of its free part: the edit is in one of them and leaves the other as it is."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return cells.withColumn("_half", F.explode(halves)).select("word", "n", "length", F.col("_half.lo").alias("lo"), F.col("_half.hi").alias("hi"))


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, near, near_n) for all pairs of `words` (word, n) one edit apart, both ways round, some more than once."""
    size = F.char_length("word")
    filed = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length")).filter("length > 0")
    cells = _keyed(_halved(filed.select("*", F.lit(0).alias("lo"), F.col("length").alias("hi"))))
    settled, rows = None, 0
    while True:
        cells = materialise(cells)
        counts = cells.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
        large = materialise(counts.filter(F.col("_n") > cell_words).select("key"))
        splits = not large.isEmpty()
        # a free part of one letter holds few words by its nature
        again = cells.join(large, "key", "left_semi").filter("hi - lo > 1") if splits else None
        done = cells
        if splits:
            marked = cells.join(large.withColumn("_large", F.lit(True)), "key", "left")
            done = marked.filter("_large is null or hi - lo <= 1").drop("_large")
        settled = done.select("key", "length", "word", "n") if settled is None else settled.unionByName(done.select("key", "length", "word", "n"))
        rows += cells.count()
        if not splits:
            break
        cells = _keyed(_halved(again))
    tasks = -(-max(rows, 1) // TASK_WORDS)
    dealt = settled.withColumn("_task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    return dealt.select("_task", "length", "word", "n").groupBy("_task").applyInArrow(_compare_cells, "word string, near string, near_n long")


def spelling_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of `words` (word, n), whose words differ.

    `n_near` counts the words one inserted, deleted or replaced code point away. `form` is the most frequent of them
    (of equal ones the first in code-point order) if it occurs at least `times` as often as the word, else null.
    `root` is where forms lead in the end, the word itself where it has none. As counts at least double from form to
    form, chains are short: they are followed by doubling until no root has a form. An empty table gives an empty one.
    """
    pairs = near_words(words).groupBy("word", "near").agg(F.max("near_n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = words.join(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "word", "left")
    taken = -F.col("best.less") >= times * F.col("n")
    forms = materialise(
        found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    )
    links = materialise(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialise(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        links = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            break
    return forms.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
