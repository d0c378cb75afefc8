"""Quality classifier as a sparse rule ensemble.

Statistics of each text are taken once. Paths of a small forest, fitted on labelled rows, become conjunctive rules
over the statistics; a lasso logistic regression keeps and weighs a few of them; the model is then one Spark column
expression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import whole_text
from seqweave.session import materialise

STATISTICS = (
    "log_chars",
    "log_words",
    "word_length",
    "upper_share",
    "digit_share",
    "mark_share",
    "sentence_mark_share",
    "space_share",
    "line_words",
    "repeated_line_share",
    "distinct_word_share",
    "top_word_share",
    "repeated_pair_share",
    "shouted_word_share",
    "marked_word_share",
    "bare_mark_share",
    "long_word_share",
    "short_word_share",
)

_SPACE, _UPPER, _LOWER, _DIGIT, _SENTENCE, _MARK, _BEYOND = range(7)
_CLASS = np.array(
    [
        _SPACE if b in b" \t\n\r\x0b\x0c" else _UPPER if 65 <= b <= 90 else _LOWER if 97 <= b <= 122 else _DIGIT if 48 <= b <= 57
        else _BEYOND if b >= 128 else _SENTENCE if b in b".,;:'\"-?()" else _MARK
        for b in range(256)
    ],
    np.uint8,
)
_ENDS_MARKED = re.compile(rb"[!-/:-@\[-`{-~]{2,}$")


def statistics_of(text: bytes) -> list[float]:
    """The statistics of one text; all of them are zero for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [math.log1p(n), *[0.0] * (len(STATISTICS) - 1)]
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7)
    letters = max(1, int(kinds[_UPPER] + kinds[_LOWER] + kinds[_BEYOND]))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    m = len(words)
    distinct = list(counts.items())
    return [
        math.log1p(n),
        math.log1p(m),
        float(lengths.mean()),
        kinds[_UPPER] / letters,
        kinds[_DIGIT] / n,
        kinds[_MARK] / n,
        kinds[_SENTENCE] / n,
        kinds[_SPACE] / n,
        m / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        len(counts) / m,
        max(counts.values()) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m,
        sum(c for w, c in distinct if len(w) > 1 and w.isupper()) / m,
        sum(c for w, c in distinct if _ENDS_MARKED.search(w)) / m,
        sum(c for w, c in distinct if len(w) == 1 and not w.isalnum()) / m,
        float((lengths > 20).mean()),
        float((lengths < 3).mean()),
    ]


def _measurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics_of(t) for t in batch.column("_text").cast(pa.binary()).to_pylist()]
        flat = pa.array(np.array(rows, np.float64).reshape(-1), pa.float64())
        stats = pa.FixedSizeListArray.from_arrays(flat, len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], stats], names=[*batch.schema.names[:-1], "_stats"])


Condition = tuple[int, str, float]


@dataclass(frozen=True)
class RuleModel:
    """Rules, each a conjunction of (statistic, "<=" or ">", threshold), with weights; `bias` is the constant."""

    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, stats: str = "_stats") -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule_column(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def rule_column(rule: Sequence[Condition], stats: str = "_stats") -> Column:
    value = lambda i: F.get(F.col(stats), F.lit(i))
    tests = [value(i) <= t if side == "<=" else value(i) > t for i, side, t in rule]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def tree_paths(description: str) -> list[tuple[Condition, ...]]:
    """Conjunctions from the root to every node below it, read from a printed tree."""
    paths, stack = [], []
    for line in description.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if m:
            depth = len(m[1])
            stack = [(d, c) for d, c in stack if d < depth]
            stack.append((depth, (int(m[2]), m[3], float(m[4]))))
            paths.append(simplified([c for _, c in stack]))
    return paths


def simplified(path: Sequence[Condition]) -> tuple[Condition, ...]:
    """The tightest bound of each statistic and side."""
    tight: dict[tuple[int, str], float] = {}
    for i, side, t in path:
        tight[i, side] = (min if side == "<=" else max)(tight.get((i, side), t), t)
    return tuple(sorted((i, side, t) for (i, side), t in tight.items()))


def fit_rules(training: DataFrame, trees: int = 24, depth: int = 3, lasso: float = 0.002, seed: int = 7) -> RuleModel:
    """Fit on rows (_stats, label 0 or 1).

    Without rows, and without two classes, there is nothing to separate: no rules, and the constant is the share of
    label 1 (one half without rows), kept off 0 and 1 by one row of either class.
    """
    rows = training.select(array_to_vector("_stats").alias("features"), "_stats", F.col("label").cast("double").alias("label"))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return RuleModel((), (), math.log(share / (1 - share)))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.6, featureSubsetStrategy="sqrt", maxBins=64, seed=seed)
    rules = list(dict.fromkeys(p for t in forest.fit(rows).trees for p in tree_paths(t.toDebugString)))
    if not rules:
        share = (ones + 1) / (n + 2)
        return RuleModel((), (), math.log(share / (1 - share)))
    as_rules = rows.select(array_to_vector(F.array(*[rule_column(r).cast("double") for r in rules])).alias("features"), "label")
    linear = LogisticRegression(regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=60).fit(as_rules)
    kept = [(r, float(w)) for r, w in zip(rules, linear.coefficients) if w]
    return RuleModel(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(linear.intercept))


def measure(docs: DataFrame, text_col: str, keep: dict[str, Column]) -> DataFrame:
    """The columns of `keep` and `_stats` per row of `docs`."""
    return_type = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*[c.alias(n) for n, c in keep.items()]).schema)
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], whole_text(text_col).alias("_text"))
    return rows.mapInArrow(_measurer, f"{return_type}, _stats array<double>")


def bounded_sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """All rows, or about `most` of them chosen by a hash of the id."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(20), F.col(id_col)), F.lit(1_000_000)) < int(most / n * 1_000_000))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 4,
    held_out_fold: int = 2,
    threshold: float = 0.7,
    max_training_rows: int = 20_000,
) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    Rows whose crc32(id as text) mod `folds` is `held_out_fold` are held out; labels are learned from the others,
    at most about `max_training_rows` of them, chosen by a hash of the id. Null text is empty; a null id has no label
    and is not held out; ids labelled more than once count each time, null labels never; repeated rows are scored
    each; other columns are ignored; empty tables give an empty result, and without usable labels every row has the
    score of `fit_rules` for them. Texts are read once; what follows works on the table of statistics. Only rule
    weights and tree nodes reach the driver.
    """
    scored = _scored(docs, labels, id_col, text_col, label_col, folds, held_out_fold, max_training_rows, {})
    return scored.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scored(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_out_fold: int, max_training_rows: int, keep: dict[str, Column]
) -> DataFrame:
    """_id, held_out, score and the columns of `keep` per row."""
    measured = materialise(measure(docs, text_col, {"_id": F.col(id_col), **keep}))
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % folds
    known = labels.select(F.col(id_col).alias("_labelled"), F.col(label_col).alias("label")).filter(F.col("label").isNotNull())
    training = measured.filter(fold != held_out_fold).join(known, F.col("_id") == F.col("_labelled")).select("_id", "_stats", "label")
    sample = materialise(bounded_sample(materialise(training), "_id", max_training_rows))
    model = fit_rules(sample)
    return measured.select("_id", *keep, F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"), model.score().alias("score"))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 4,
    held_out_fold: int = 2,
    threshold: float = 0.7,
    max_training_rows: int = 20_000,
) -> DataFrame:
    """`docs` without the rows that `score_quality` rejects, all columns as they are.

    Rows that repeat and rows without an id are kept or dropped each by their own text.
    """
    text = F.xxhash64(whole_text(text_col))
    scored = _scored(docs, labels, id_col, text_col, label_col, folds, held_out_fold, max_training_rows, {"_hash": text})
    kept = scored.filter(F.col("score") >= threshold).select(F.struct(F.col("_id").alias("id"), F.col("_hash").alias("text")).alias("_kept")).distinct()
    return docs.join(kept, F.struct(F.col(id_col).alias("id"), text.alias("text")).eqNullSafe(F.col("_kept")), "left_semi")
