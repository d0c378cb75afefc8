"""Plain single-process versions that the operators are compared with."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def shingles(text: str | None) -> frozenset[str]:
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def components(texts: dict[int, str | None]) -> dict[int, int]:
    """Smallest document that links of Jaccard similarity 0.8 lead to."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in holders[x])
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return {i: root(i) for i in sets}


ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_secrets(text: str | None) -> list[tuple[int, int, int, str]]:
    text, found = text or "", []
    for order, (kind, pattern, group, least) in enumerate((("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))):
        found += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def base_phrases(text: str | None, phrases: dict[str, str]) -> tuple[int, list[int], set[str]]:
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in phrases.items():
        wanted = phrase.split()
        for i in range(len(words) - len(wanted) + 1):
            if words[i : i + len(wanted)] == wanted:
                starts.append(i)
                labels.add(label)
    return len(words), starts, labels


def fold(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def fingerprint(text: str) -> tuple[int, ...]:
    """One-permutation MinHash of five-word shingles: low bits of 256 bins after densification."""
    import xxhash

    def chained(*values: bytes) -> int:
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v, h)
        return h

    words = re.split("[ \t\n\x0b\x0c\r]+", text.lower().strip(" \t\n\x0b\x0c\r"))
    bins: dict[int, int] = {}
    for i in range(max(1, len(words) - 4)):
        h = chained(*[w.encode() for w in words[i : i + 5]])
        bins[h >> 56] = min(h, bins.get(h >> 56, h))

    def donor(place: int) -> int:
        mixed = place * 40503
        start, step = (mixed & 0xFFFF) // 256, (mixed // 8) & 255 | 1
        return next(h for t in range(256) if (h := bins.get(((start + step * t & 255) - 128) % 256)) is not None)

    # bins stand in the order of signed numbers: place 0 is bin 128
    return tuple((bins[b] if (b := (place - 128) % 256) in bins else donor(place)) & 15 for place in range(256))


def kneser_ney(sequences: dict[int, list], order: int, discounts, base) -> "callable":
    """(context, symbol) -> log p(symbol | context, 1) - log p(symbol | context, 0) under plain recursive Kneser-Ney models.

    `discounts` maps order to what n-grams counted once, twice and more often lose; `base(symbol, label)` lies below.
    """
    counts = {}
    for label, of in sequences.items():
        grams = {}
        for seq in of:
            padded = [None] * (order - 1) + list(seq)
            for at in range(order - 1, len(padded)):
                gram = tuple(padded[at - order + 1 : at + 1])
                grams[gram] = grams.get(gram, 0) + 1
        counts[label, order] = grams
        for m in range(order - 1, 0, -1):
            kinds = {}
            for gram in counts[label, m + 1]:
                kinds[gram[1:]] = kinds.get(gram[1:], 0) + 1
            counts[label, m] = kinds
    followers = {}
    for (label, m), grams in counts.items():
        for gram, n in grams.items():
            followers.setdefault((label, gram[:-1]), []).append(n)

    def p(label, context, symbol):
        m = len(context) + 1
        below = p(label, context[1:], symbol) if context else base(symbol, label)
        of = followers.get((label, context))
        if not of:
            return below
        lost = lambda n: discounts[m][min(n, 3) - 1] if n else 0.0
        n = counts[label, m].get((*context, symbol), 0)
        return (n - lost(n)) / sum(of) + sum(map(lost, of)) / sum(of) * below

    return lambda context, symbol: math.log(p(1, context, symbol) / p(0, context, symbol))


def license_places(words: list[str], templates: dict, index: dict, slack: int) -> list[tuple[str, int, float]]:
    """Best verified place of each template, by trying every place of the text."""
    from seqweave.llm.license_scan import COMMON

    found = []
    for label, (text, keys) in sorted(templates.items()):
        own = text.split()
        anchors = {w for w, posts in index.items() if label in {x for x, _ in posts}}
        inside = {w for k in keys for w in k.split()}
        needed, best = 2 if len(anchors - inside) > 1 else 1, None
        known = [(i, w) for i, w in enumerate(own) if w not in COMMON and not w.isdigit()]
        for start in range(-len(own), len(words) + 1):
            votes = sum(w in anchors and 0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(own))
            near = range(max(0, start - slack), min(len(words), start + len(own) + slack + 1))
            if votes >= needed and all(any(words[p : p + len(k.split())] == k.split() for p in near) for k in keys):
                covered = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in known) / len(known)
                best = max(best or (-1.0, 0), (covered, -start))
        if best:
            found.append((label, -best[1], best[0]))
    return found


def best_alignment(text: list[str], item: list[str], masks, min_words: int) -> tuple[int, int, int] | None:
    """(first word, words, agreeing words) of the best overlap of all alignments at which a mask's open words agree."""
    best, shortest = None, min(map(len, masks))
    shapes = [[i for i, c in enumerate(m) if c == "1"] for m in masks] + ([list(range(len(item)))] if 0 < len(item) < shortest else [])
    for start in range(1 - len(item), len(text)):
        same = [0 <= start + q < len(text) and text[start + q] == w for q, w in enumerate(item)]
        if not any(all(same[q + p] for p in shape) for shape in shapes for q in range(len(item) - shape[-1])):
            continue
        top, run, a = (0, 0, 0), 0, 0
        for q, s in enumerate(same):
            run += 1 if s else -3
            if run < 0:
                run, a = 0, q + 1
            if run > top[0]:
                top = (run, a, q + 1)
        _, a, b = top
        agree = sum(same[a:b])
        if b - a >= min(min_words, len(item)) and (best is None or (agree, -(start + a)) > (best[2], -best[0])):
            best = (start + a, b - a, agree)
    return best
