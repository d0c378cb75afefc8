"""Token counts of a word-end BPE vocabulary with a whole-token shortcut.

Most pre-tokens of running text are entries of the vocabulary. Which of those entries are encoded alone as one
token is proved once by encoding all of them; such pre-tokens count one. Only the others are merged, once per
distinct pre-token and worker.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import per_worker, whole_text

#: The vocabulary's pre-token pattern and the spelling of its byte alphabet.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
WORD_END = "</w>"
_CACHE_LIMIT = 1_000_000


def without_normalizer(path: str):
    """The vocabulary's encoder for text that is normalised already.

    NFC is not idempotent under lower-casing: a capital that falls apart when lower-cased frees marks that a second
    NFC would put in another order.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    return Tokenizer.from_str(json.dumps({**parts, "normalizer": None}))


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: Latin-1 letters and signs stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def normalise(text: str) -> str:
    """NFC and lower case letter by letter (a final sigma is no special case)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def proved_whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings that, as a normalised text of their own, are encoded as exactly that one token."""
    alphabet, words, ids = byte_alphabet(), [], []
    for entry, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if entry.endswith(WORD_END) and all(c in alphabet for c in entry[: -len(WORD_END)]):
            try:
                words.append(bytes(alphabet[c] for c in entry[: -len(WORD_END)]).decode("utf-8"))
                ids.append(i)
            except UnicodeDecodeError:
                continue
    pattern = regex.compile(PRE_TOKEN)
    encoded = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(
        w for w, i, e in zip(words, ids, encoded) if e.ids == [i] and normalise(w) == w and pattern.findall(w) == [w]
    )


class PreTokenCounter:
    """Counts tokens of texts; keeps the counts of merged pre-tokens between texts, up to a bound."""

    def __init__(self, path: str, whole: frozenset[str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = without_normalizer(path)
        self.pattern = regex.compile(PRE_TOKEN)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.whole = dict.fromkeys(whole, 1)
        self.counts = dict(self.whole)

    def _learn(self, words: set[str]) -> None:
        pending = iter(words)
        while part := list(islice(pending, 20_000)):
            for word, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                self.counts[word] = len(e.ids)

    def _plain(self, text: str) -> int:
        words = self.pattern.findall(normalise(text))
        if len(self.counts) > _CACHE_LIMIT:
            self.counts = dict(self.whole)
        if unknown := set(words).difference(self.counts):
            self._learn(unknown)
        return sum(map(self.counts.__getitem__, words))

    def count(self, text: str) -> int:
        """Special strings inside a text are one token each, as the library has it by default."""
        if self.special is None or "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def _counter(path: str, whole):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker(f"token counter {path}", lambda: PreTokenCounter(path, whole.value))
        for batch in batches:
            texts = batch.column("_text")
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            n_tokens = pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), n_bytes, n_tokens], names=["_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text is empty (0 bytes, 0 tokens); a null id stays null; repeated rows are counted each; other columns are
    ignored; an empty table gives an empty result. No text is cut. The proof runs once on the driver and what is
    sent to the executors is at most the vocabulary.
    """
    whole = docs.sparkSession.sparkContext.broadcast(proved_whole_tokens(without_normalizer(tokenizer_path)))
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    counted = rows.mapInArrow(_counter(tokenizer_path, whole), schema)
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
