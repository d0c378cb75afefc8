"""Licence scans by a positional index of rare licence words.

The rarest words of each licence template (by document frequency in the scanned corpus) are its anchors. A text's
anchor words give template postings; postings that agree on the relative position of text and template make a
candidate place, and a label is given only where the template's mandatory key phrases stand there.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import whole_text
from seqweave.session import materialise

#: Base phrases with their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public licence wording by label, in lower-case words, and the phrases that must be there.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "all-rights-reserved": ("all rights reserved", ("all rights reserved",)),
    "agpl-header": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
        ("under the terms of the gnu affero general public license",),
    ),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("may not use this file except in compliance with the license",),
    ),
    "bsd-clauses": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    "bsd-endorsement": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission",
        ("may be used to endorse or promote products derived from this software",),
    ),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "cc0-1.0": (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",),
    ),
    "epl-2.0": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is "
        "available at https www eclipse org legal epl 2 0",
        ("under the terms of the eclipse public license",),
    ),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "gpl-header": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version",
        ("redistribute it and or modify it under the terms of the gnu general public license",),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies the software is provided as is and the author "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ("for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    "lgpl-header": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
        "published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("under the terms of the gnu lesser general public license",),
    ),
    "mit-notice": ("released under the mit license", ("under the mit license",)),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at https mozilla org mpl 2 0",
        ("subject to the terms of the mozilla public license",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software released into the public domain",),
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
        "applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not "
        "be misrepresented you must not claim that you wrote the original software",
        ("alter it and redistribute it freely", "the origin of this software must not be misrepresented"),
    ),
}

#: Words too common in running text to be looked up.
COMMON = frozenset("a all an and any are as at be by can either in is it may met must of or org that the this to under use with you".split())

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SCAN = "_id {id}, n_words long, _words array<struct<pos:long,word:string>>, _phrases array<struct<pos:long,phrase:string>>"
_PLACED = pa.list_(pa.struct([("pos", pa.int64()), ("w", pa.string())]))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and anything beyond ASCII, A-Z in lower case."""
    return text.translate(_WORD_BYTES).split()


class PhraseFinder:
    """Places of given phrases, found from their longest uncommon word."""

    def __init__(self, phrases):
        self.by_word: dict[bytes, list[tuple[str, list[bytes], int]]] = defaultdict(list)
        for phrase in phrases:
            words = phrase.encode().split()
            at = max(range(len(words)), key=lambda i: (words[i].decode() not in COMMON, len(words[i])))
            self.by_word[words[at]].append((phrase, words, at))

    def find(self, words: list[bytes], places: list[int]) -> list[tuple[int, str]]:
        found = []
        for i in places:
            for phrase, wanted, at in self.by_word.get(words[i], ()):
                start = i - at
                if start >= 0 and words[start : start + len(wanted)] == wanted:
                    found.append((start, phrase))
        return sorted(found)


def licence_words(templates: Mapping[str, tuple[str, tuple[str, ...]]]) -> frozenset[str]:
    return frozenset(w for text, _ in templates.values() for w in text.split() if w not in COMMON and not w.isdigit())


def _scanner(templates, base):
    finder = PhraseFinder(sorted({*base, *(p for _, keys in templates.values() for p in keys)}))
    vocabulary = {w.encode() for w in licence_words(templates)}
    wanted = vocabulary | finder.by_word.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held, phrases = [], [], []
            for text in batch.column("_text").cast(pa.binary()).to_pylist():
                words = words_of(text)
                places = [i for i, w in enumerate(words) if w in wanted]
                n.append(len(words))
                held.append([(i, words[i].decode()) for i in places if words[i] in vocabulary])
                phrases.append(finder.find(words, places))
            rows = lambda lists, name: pa.array([[{"pos": i, name: w} for i, w in x] for x in lists], pa.list_(pa.struct([("pos", pa.int64()), (name, pa.string())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(n, pa.int64()), rows(held, "word"), rows(phrases, "phrase")],
                names=["_id", "n_words", "_words", "_phrases"],
            )

    return run


def anchors(templates, df: Mapping[str, int], n_docs: int, per_template: int) -> dict[str, list[tuple[str, int]]]:
    """word -> [(label, place in the template)] for the words of highest IDF of each template."""
    index: dict[str, list[tuple[str, int]]] = defaultdict(list)
    vocabulary = licence_words(templates)
    for label, (text, _) in templates.items():
        words = text.split()
        idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) for w in words if w in vocabulary}
        chosen = set(sorted(idf, key=lambda w: (-idf[w], w))[:per_template])
        for i, w in enumerate(words):
            if w in chosen:
                index[w].append((label, i))
    return dict(index)


def wanted_votes(templates, index) -> dict[str, int]:
    """How many anchors must agree on a place: two, but one where fewer than two stand outside the key phrases.

    Such a template is little more than its key phrases, which are verified in any case.
    """
    chosen: dict[str, set[str]] = defaultdict(set)
    for word, posts in index.items():
        for label, _ in posts:
            chosen[label].add(word)
    return {label: 2 if len(chosen[label] - {w for k in keys for w in k.split()}) > 1 else 1 for label, (_, keys) in templates.items()}


def judge(held, phrases, templates, index, slack: int, needed: Mapping[str, int] | None = None) -> list[tuple[str, int, float]]:
    """(label, start, coverage) of each verified template place, the best place of a label only (ties: the first)."""
    needed = wanted_votes(templates, index) if needed is None else needed
    votes: Counter = Counter()
    for pos, word in held:
        for label, at in index.get(word, ()):
            votes[label, pos - at] += 1
    at_place, best = dict(held), {}
    places: dict[str, list[int]] = defaultdict(list)
    for pos, phrase in sorted(phrases):
        places[phrase].append(pos)

    def stands(key: str, low: int, high: int) -> bool:
        i = bisect_left(places[key], low)
        return i < len(places[key]) and places[key][i] <= high

    for (label, start), n in votes.items():
        text, keys = templates[label]
        words = text.split()
        if n < needed[label] or not all(stands(key, start - slack, start + len(words) + slack) for key in keys):
            continue
        known = [(i, w) for i, w in enumerate(words) if w not in COMMON and not w.isdigit()]
        covered = sum(at_place.get(start + i) == w for i, w in known) / len(known)
        if label not in best or (covered, -start) > (best[label][1], -best[label][0]):
            best[label] = (start, covered)
    return [(label, *x) for label, x in sorted(best.items())]


def _judge_rows(templates, index, slack):
    needed = wanted_votes(templates, index)
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("_words").to_pylist(), batch.column("_phrases").to_pylist())
            found = [
                [dict(zip(("label", "start", "coverage"), x)) for x in judge([(w["pos"], w["word"]) for w in held], [(p["pos"], p["phrase"]) for p in phrases], templates, index, slack)]
                for held, phrases in pairs
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("n_words"), batch.column("_phrases"), pa.array(found, span)], names=["_id", "n_words", "_phrases", "places"]
            )

    return run


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, tuple[str, tuple[str, ...]]] = TEMPLATES,
    base: Mapping[str, str] = BASE_PHRASES,
    per_template: int = 6,
    slack: int = 8,
) -> DataFrame:
    """One row per input row: id, n_words, base (places of base phrases), places (label, start, coverage).

    Null text has no words; a null id stays null; repeated rows are judged each and count each for document
    frequencies; other columns are ignored; an empty table gives an empty result. The text is read once: what later
    steps need (places of licence words and key phrases) is written as a narrow table. The driver receives one
    count per licence word, which the templates bound.
    """
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    scanned = materialise(rows.mapInArrow(_scanner(dict(templates), dict(base)), _SCAN.format(id=kind)))
    n_docs = scanned.count()
    df = scanned.select(F.explode(F.array_distinct(F.col("_words.word"))).alias("word")).groupBy("word").count()
    index = anchors(templates, {r["word"]: r["count"] for r in df.collect()}, n_docs, per_template)
    schema = f"_id {kind}, n_words long, _phrases array<struct<pos:long,phrase:string>>, places array<struct<label:string,start:long,coverage:double>>"
    judged = scanned.mapInArrow(_judge_rows(dict(templates), index, slack), schema)
    is_base = F.filter("_phrases", lambda p: p["phrase"].isin(list(base)))
    return judged.select(F.col("_id").alias(id_col), "n_words", is_base.alias("base"), "places")
