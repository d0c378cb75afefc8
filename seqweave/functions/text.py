"""Identifier and sequence expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqweave import constants as C


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_word(c: str | Column) -> Column:
    """First whitespace-separated word; null for blank text."""
    return F.nullif(F.regexp_extract(_col(c), r"^\s*(\S+)", 1), F.lit(""))


def header_id(header: str | Column) -> Column:
    """Record id of a header: the second `|` field when filled, else the first word."""
    field = F.try_element_at(F.split(_col(header), r"\|"), F.lit(2))
    return F.coalesce(F.nullif(field, F.lit("")), first_word(header))


def _strip_marker(header: str | Column) -> Column:
    return F.regexp_replace(F.trim(_col(header)), r"^>+", "")


def canonical_id(header: str | Column) -> Column:
    """Accession hidden in a header (database style, cluster style, bare accession, else first word)."""
    h = _strip_marker(header)
    word = first_word(h)
    swiss = F.regexp_extract(h, "(?i)" + C.SWISSPROT_HEADER, 1)
    uniref = F.regexp_extract(h, "(?i)" + C.UNIREF_HEADER, 2)
    plain = F.regexp_extract(word, C.PLAIN_ACCESSION, 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (swiss, uniref, plain)], word)


def canonical_id_type(header: str | Column) -> Column:
    """Which of the header styles `canonical_id` recognised."""
    h = _strip_marker(header)
    return (
        F.when(h.rlike("(?i)" + C.SWISSPROT_HEADER), C.ID_TYPE_SWISSPROT)
        .when(h.rlike("(?i)" + C.UNIREF_HEADER), C.ID_TYPE_UNIREF)
        .when(first_word(h).rlike(C.PLAIN_ACCESSION), C.ID_TYPE_PLAIN)
        .otherwise(C.ID_TYPE_UNKNOWN)
    )


def sanitize_residues(seq: str | Column) -> Column:
    """Upper-case, rare residues replaced, letters separated by single spaces."""
    upper = F.translate(
        F.upper(_col(seq)), C.RARE_RESIDUES, C.RARE_RESIDUE_REPLACEMENT * len(C.RARE_RESIDUES)
    )
    return F.regexp_replace(upper, "(?s)(.)(?=.)", "$1 ")


def tokenize(seq: str | Column) -> Column:
    """Array of single characters, empty for empty text."""
    return F.filter(F.split(_col(seq), ""), lambda t: F.length(t) > 0)


def truncate_tokens(tokens: str | Column, max_len: int) -> Column:
    return F.slice(_col(tokens), 1, max_len)


def gram_array(text: str | Column, width: int) -> Column:
    """Every overlapping window of `width` characters, in order.

    One left-to-right regular-expression scan: a lookahead captures the window at each character and one
    character is consumed, so the cost is linear in the text and no per-character lambda is interpreted.
    """
    return F.regexp_extract_all(_col(text), F.lit(f"(?s)(?=(.{{{width}}}))."), F.lit(1))


def window_array(text: str | Column, width: int) -> Column:
    """As `gram_array`, but one window per character: the last ones are cut short by the end of the text."""
    return F.regexp_extract_all(_col(text), F.lit(f"(?s)(?=(.{{1,{width}}}))."), F.lit(1))


def overlapping_chunks(text: str | Column, step: int, overlap: int) -> Column:
    """Cut text into pieces that advance by `step` and carry `overlap` extra characters, in one scan."""
    return F.regexp_extract_all(
        _col(text), F.lit(f"(?s)(?=(.{{1,{step + overlap}}})).{{1,{step}}}"), F.lit(1)
    )
