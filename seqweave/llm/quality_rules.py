"""Line-first cleaning: rules judge every line, failed lines go, and a text that loses too much goes whole.

Patterns are applied to lines whose A-Z are lower-cased. They use only syntax that means the same in Python and RE2,
so that the query's SQL states the same rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import whole_text

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
#: punctuation: a line holds the end of a sentence (its last one may be cut), and marks do not outnumber a quarter of its words
SENTENCE_END = "[.!?:;…。！？؟।][\"'”’»)\\]]*([\\x20\\x09-\\x0D]|$)"
MARK_RUN = "[!?]{2,}|[#*$%&|<>]+"
MARK_SHARE = 4
#: navigation: a short line that opens with a menu word, or a row of entries between separators
MENU_WORDS = 10
MENU = (
    "^[^a-z]*(home|menu|login|log in|sign in|sign up|register|search|skip to|back to top|next|previous|read more|share|"
    "follow us|contact us|about us|sitemap|subscribe|toggle navigation)([^a-z]|$)"
)
SEPARATOR = "[|»›·•]"
SEPARATORS_LEAST = 3
#: boilerplate: legal and technical phrases, and the braces of program text
BOILERPLATE = (
    "[{}]|all rights reserved|privacy policy|cookie policy|terms of (use|service)|(use|uses|accept) (of )?cookies|"
    "enable javascript|javascript is disabled|lorem ipsum|subscribe to our newsletter|powered by wordpress|copyright (©|\\(c\\))"
)
LOWER = {i: i + 32 for i in range(65, 91)}
RULES = ("punctuation", "navigation", "boilerplate")


def line_faults(line: str, n_words: int) -> tuple[bool, bool, bool]:
    """Which of the RULES a line fails; one without words fails none."""
    if not n_words:
        return False, False, False
    low = line.translate(LOWER)
    marks, between = len(re.findall(MARK_RUN, low)), len(re.findall(SEPARATOR, low))
    punctuation = re.search(SENTENCE_END, low) is None or MARK_SHARE * marks > n_words
    navigation = (n_words <= MENU_WORDS and re.search(MENU, low) is not None) or (between >= SEPARATORS_LEAST and MARK_SHARE * between > n_words)
    return punctuation, navigation, re.search(BOILERPLATE, low) is not None


def repeated_words(words: list[str], window: int = 3) -> int:
    """Words inside windows that occur at least twice in the text; numbers stand for words, so windows are sorted as integers."""
    if len(words) <= window:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    places = len(words) - window + 1
    runs = ids[:places]
    for k in range(1, window):
        runs = np.unique(runs, return_inverse=True)[1].astype(np.int64) * len(number) + ids[k : k + places]
    _, which, counts = np.unique(runs, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + places] |= again
    return int(covered.sum())


def judge(text: str) -> dict:
    """All counts of one text, its cleaned lines and how many of its words' code points the removed ones held."""
    words: list[str] = []
    seen: set[str] = set()
    kept, faults = [], [0, 0, 0]
    duplicates = lost = lines = 0
    for line in text.split("\n"):
        here = re.findall(WORD, line)
        if here:
            lines += 1
            duplicates += line in seen
            seen.add(line)
        failed = line_faults(line, len(here))
        if any(failed):
            lost += sum(map(len, here))
            faults = [a + b for a, b in zip(faults, failed)]
        else:
            kept.append(line)
        words += here
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(SYMBOL, text)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated_words(words),
        "n_lines": lines,
        **{f"n_{rule}": n for rule, n in zip(RULES, faults)},
        "lost_chars": lost,
        "cleaned": "\n".join(kept),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", *(f"n_{r}" for r in RULES), "lost_chars")
_TYPES = {**{c: pa.int64() for c in COUNTS}, "cleaned": pa.string()}


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [judge(t) for t in batch["_text"].to_pylist()]
        more = [pa.array([f[c] for f in found], kind) for c, kind in _TYPES.items()]
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *more], [*names, *_TYPES])


def clean_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int = 50, max_repeat: int = 50, max_lost: int = 50) -> DataFrame:
    """One row per row of `docs`: `keep`, the counts, `cleaned`, `base_failed` and `kept`.

    `base_failed`: fewer than `min_words` words, or more than `max_repeat` in a hundred of them stand in repeated
    windows of three. `kept`: not so, and the lines that failed a rule held at most `max_lost` in a hundred of the
    words' code points. `cleaned` is the text without those lines.

    A null text counts as empty: no words, base failed. Blank lines fail no rule and are no duplicates. Repeated rows
    each have their row, an empty table gives an empty table, other columns are left out whatever their names.
    Texts are judged whole in the task that reads them; nothing is shuffled.
    """
    given = docs.select(*keep, whole_text(text).alias("_text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields if f.name != "_text")
    found = given.mapInArrow(_judge_batches, f"{kind}, {', '.join(f'{c} long' for c in COUNTS)}, cleaned string")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    enough = 100 * F.col("lost_chars") <= max_lost * F.col("word_chars")
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough)
