"""Document fingerprints by one-permutation MinHash. DataFrame functions only.

Every shingle of five words is hashed once. The hash's top bits choose a bin and each bin keeps its least hash. An
empty bin takes the value of the first filled one along a probe order of its own, which depends on the bin number
only (optimal densification: two sets with the same filled bins take the same donors). The low bits of the bins are
stored, sixteen bins of four bits to a long. All of it is one column expression: no text and no shingle is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import whole_text

WORDS, BIN_BITS, LOW_BITS = 5, 8, 4
BINS, PER_LONG = 1 << BIN_BITS, 64 // LOW_BITS
_SPACE = " \t\n\x0b\x0c\r"
_ONES = 0x1111111111111111
_VALUE = (1 << (64 - BIN_BITS)) - 1
_EARLY_PROBES = 8


def shingle_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body's own lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _empty(h: Column) -> Column:
    """Whether a bin holds the mark that stands in it before any hash does."""
    return h.bitwiseAND(F.lit(_VALUE)) == _VALUE


def _bin_minima(hashes: Column) -> Column:
    """One value per bin, in the order of bins as signed numbers: its least hash, or a mark of all ones."""
    marks = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(_VALUE)))
    first = lambda a: F.filter(a, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(a, i - 1))))
    return _let(F.sort_array(F.concat(hashes, marks)), first)


def _probes(b: Column) -> tuple[Column, Column]:
    """Start and odd width of the steps in which bin `b` asks all bins in turn."""
    mixed = b * 40503
    return F.shiftright(mixed, 8).bitwiseAND(BINS - 1), F.shiftright(mixed, 3).bitwiseAND(BINS - 1).bitwiseOR(1)


def _densified(bins: Column) -> Column:
    places = F.sequence(F.lit(0), F.lit(BINS - 1))

    def dense(known: Column) -> Column:
        """`known` holds null in empty bins."""

        def donor(b: Column, filled: Column) -> Column:
            start, step = _probes(b)
            early = [F.get(known, (start + step * t).bitwiseAND(BINS - 1)) for t in range(_EARLY_PROBES)]
            inverse = (step * (2 - step * step)).bitwiseAND(BINS - 1)
            inverse = (inverse * (2 - step * inverse)).bitwiseAND(BINS - 1)

            def first(asks: Column) -> Column:
                # the step at which a filled bin is asked, and the bin
                turns = F.transform(filled, lambda j: ((j - asks["start"]) * asks["inverse"]).bitwiseAND(BINS - 1) * BINS + j)
                return F.get(known, F.array_min(turns).bitwiseAND(BINS - 1))

            return F.coalesce(*early, _let(F.struct(start.alias("start"), inverse.alias("inverse")), first))

        filled = F.filter(places, lambda i: F.get(known, i).isNotNull())
        return _let(filled, lambda f: F.transform(known, lambda h, i: F.coalesce(h, donor(i, f))))

    return _let(F.transform(bins, lambda h: F.when(~_empty(h), h)), dense)


def _packed(values: Column) -> Column:
    def longs(low: Column) -> Column:
        def one(j: Column) -> Column:
            bins = F.slice(low, j * PER_LONG + 1, PER_LONG)
            return F.aggregate(bins, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), one)

    return _let(F.transform(values, lambda h: h.bitwiseAND(F.lit((1 << LOW_BITS) - 1))), longs)


def as_hex(fingerprint: str | Column) -> Column:
    c = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str | Column, b: str | Column) -> Column:
    """Estimated share of common shingles: agreeing bins, less what `LOW_BITS` bits agree on by chance."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseAND(F.lit(_ONES)))

    n = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, x: acc + x)
    agree, chance = (BINS - n) / F.lit(float(BINS)), 2.0**-LOW_BITS
    return F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))


def fingerprint(text: str | Column) -> Column:
    """Packed fingerprint (16 longs) of a text.

    Shingles are five consecutive words of the lower-cased text (words end at ASCII white space); a text of fewer
    words is one shingle; a text without words, null included, has the fingerprint of one fixed value, so two such
    texts are alike and no other is like them.
    """
    words = F.split(F.btrim(F.lower(whole_text(text)), F.lit(_SPACE)), f"[{_SPACE}]+")
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0)))
    hashes = _let(words, lambda w: F.transform(starts(w), lambda i: shingle_hash(w, i)))
    return _packed(_densified(_bin_minima(hashes)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_cols: Sequence[str] = ("text",)) -> DataFrame:
    """One row per input row: the id and for each text column `<column>_fingerprint`.

    Equal texts have equal fingerprints whatever their row. Null ids stay, repeated rows are returned each, other
    columns are ignored, an empty table gives an empty result. A text's own words are all that meets in a row.
    """
    return docs.select(id_col, *[fingerprint(c).alias(f"{c}_fingerprint") for c in text_cols])
