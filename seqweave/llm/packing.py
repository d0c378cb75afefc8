"""Bounded-space online packing of tokenised documents into sequences of a fixed capacity.

Each partition keeps a fixed number of open windows. A piece goes to the window that it fills best; if it fits in
none and no more may be opened, the fullest one is emitted. What is still open when the partition ends is merged
across partitions, a bounded number of windows at a time.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import per_worker, whole_text
from seqweave.session import materialise

END_ID = 1
#: Fixed value: pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BEYOND_LATIN = re.compile(rb"[\xca-\xff]")
_PART_BITS = 33
_BATCH_TOKENS = 1 << 20


class ByteTokens:
    """Token ids of a byte-level vocabulary.

    The ranks file holds the same vocabulary; its encoder gives the same ids several times faster. Texts beyond the
    Latin blocks, where two libraries' letter classes might differ by Unicode version, take the JSON file's encoder.
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = added
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or not text.isascii() and _BEYOND_LATIN.search(text.encode("utf-8", "surrogatepass")):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        return np.concatenate(
            [np.array([self.added[p]], dtype="<u4") if i % 2 else self.fast.encode_to_numpy(p).astype("<u4", copy=False) for i, p in enumerate(parts)]
        )


class OpenWindows:
    """A fixed number of windows that are being filled; `place` returns the window that had to be emitted, if any."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list] = {}
        self.opened = 0

    def fresh(self) -> int:
        self.opened += 1
        return self.opened - 1

    def place(self, size: int, piece) -> tuple[int, list] | None:
        emitted = None
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                _, fullest = self.free.pop(0)
                emitted = (fullest, self.held.pop(fullest))
            room, window = self.capacity, self.fresh()
            self.held[window] = []
        self.held[window].append((self.capacity - room, piece))
        if room - size:
            insort(self.free, (room - size, window))
            return emitted
        # full: it is emitted at once, after one that had to make room
        full = (window, self.held.pop(window))
        return full if emitted is None else (full[0], full[1], emitted)


def _emitted(result) -> list[tuple[int, list]]:
    if result is None:
        return []
    return [result] if len(result) == 2 else [result[2], result[:2]]


_FIELDS = (("_part", pa.int64()), ("_window", pa.int64()), ("_open", pa.bool_()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("offset", pa.int64()))
_SCHEMA = "_part long, _window long, _open boolean, start long, length long, ids binary, doc_tokens long, offset long"


def _packer(json_path: str, ranks_path: str | None, capacity: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(f"byte tokens {json_path} {ranks_path}", lambda: ByteTokens(json_path, ranks_path))
        part, windows = TaskContext.get().partitionId(), OpenWindows(capacity, limit)
        rows: list[tuple] = []
        id_type = None

        def emit(window: int, pieces: list, is_open: bool) -> None:
            for offset, (doc, start, ids, total) in pieces:
                rows.append((doc, part, window, is_open, start, len(ids), ids.tobytes(), total, offset))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 9
            arrays = [pa.array(columns[0], id_type), *[pa.array(c, t) for c, (_, t) in zip(columns[1:], _FIELDS)]]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["_id", *[n for n, _ in _FIELDS]])

        waiting = 0
        for batch in batches:
            id_type = batch.schema.field("_id").type
            for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                ids = np.append(encoder.ids(text), np.array([END_ID], dtype="<u4"))
                waiting += len(ids)
                for start in range(0, len(ids), capacity):
                    piece = (doc, start, ids[start : start + capacity], len(ids))
                    if len(piece[2]) == capacity:
                        emit(windows.fresh(), [(0, piece)], False)
                    else:
                        for window, pieces in _emitted(windows.place(len(piece[2]), piece)):
                            emit(window, pieces, False)
                if waiting >= _BATCH_TOKENS:
                    yield batch_of()
                    waiting = 0
        for window, pieces in windows.held.items():
            emit(window, pieces, True)
        if rows:
            yield batch_of()

    return run


def _merger(capacity: int):
    def run(left: pd.DataFrame) -> pd.DataFrame:
        """Best fit, largest first; a merged sequence takes the name of its first window."""
        left = left.sort_values(["fill", "_part", "_window"], ascending=[False, True, True])
        room: list[tuple[int, int]] = []
        names, out = [], []
        for part, window, fill in left[["_part", "_window", "fill"]].itertuples(index=False):
            at = bisect_left(room, (fill, -1))
            if at < len(room):
                free, k = room.pop(at)
            else:
                free, k = capacity, len(names)
                names.append((part, window))
            out.append((part, window, *names[k], capacity - free))
            insort(room, (free - fill, k))
        return pd.DataFrame(out, columns=["_part", "_window", "_to_part", "_to_window", "_shift"])

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    open_windows: int = 64,
    parts_per_merge: int = 64,
) -> DataFrame:
    """One row per piece: the id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids end with id 1. Every capacity-sized stretch of a document is a sequence of its own; the rest
    is one piece. Null text is empty (one piece, the end id); a null id stays null; repeated rows are packed each;
    other columns are ignored; an empty table gives an empty result. A task holds `open_windows` windows; a merge
    holds the open windows of `parts_per_merge` partitions. Pieces are written once in the shared folder: which
    window a piece went to must not be computed twice. No ids are shuffled but those of windows left open.
    """
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    pieces = materialise(rows.mapInArrow(_packer(tokenizer_path, ranks_path, capacity, open_windows), f"_id {kind}, {_SCHEMA}"))
    left = pieces.filter("_open")
    fills = left.groupBy("_part", "_window").agg(F.sum("length").alias("fill"), F.floor(F.col("_part") / parts_per_merge).alias("_group"))
    merged = fills.groupBy("_group").applyInPandas(_merger(capacity), "_part long, _window long, _to_part long, _to_window long, _shift long")
    name = lambda part, window: F.shiftleft(F.col(part), _PART_BITS) + F.col(window)
    columns = [F.col("_id").alias(id_col), "start", "length", "ids", "doc_tokens"]
    whole = pieces.filter("not _open").select(*columns, name("_part", "_window").alias("sequence_id"), "offset")
    moved = left.join(merged, ["_part", "_window"]).select(
        *columns, name("_to_part", "_to_window").alias("sequence_id"), (F.col("offset") + F.col("_shift")).alias("offset")
    )
    return whole.unionByName(moved)
