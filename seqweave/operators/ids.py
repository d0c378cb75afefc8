"""Identifier tables: candidate ids, id maps and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.functions import text
from seqweave.operators.splits import sample_exact

MAPPING_MODES = ("none", "regex", "table")


def candidate_ids(headers: DataFrame, header: str = "header") -> DataFrame:
    """Distinct trimmed record ids found in headers."""
    found = F.trim(text.header_id(F.trim(F.regexp_replace(header, r"^>", ""))))
    return headers.select(found.alias("id")).filter(F.col("id") != "").distinct()


def build_id_map(headers: DataFrame, header: str = "header", order: str = "ord") -> DataFrame:
    """`original -> mapped` where the canonical id differs; the last header of an id wins."""
    return (
        headers.select(
            text.first_word(header).alias("original"),
            text.canonical_id(header).alias("mapped"),
            F.col(order).alias("_ord"),
        )
        .filter(F.col("mapped") != F.col("original"))
        .groupBy("original")
        .agg(F.max_by("mapped", "_ord").alias("mapped"))
    )


def apply_id_map(
    emb: DataFrame, idmap: DataFrame, key: str = "key", vec: str = "vec", order: str = "ord"
) -> DataFrame:
    """Rename keys; when two keys end up equal the later row's vector wins."""
    renamed = emb.join(idmap.withColumnRenamed("original", key), key, "left")
    return (
        renamed.groupBy(F.coalesce("mapped", key).alias("_new"))
        .agg(F.max_by(vec, order).alias(vec), F.count(F.lit(1)).alias("n_merged"))
        .withColumnRenamed("_new", key)
    )


def map_ids_by_table(
    ids: DataFrame, reference: DataFrame, sample: int | None = None, seed: int = 42
) -> DataFrame:
    """Look ids up in a `(from, to[, ord])` table whose target is a plain id or a JSON record.

    A JSON record contributes its `primaryAccession`. An id has one target, that of the last row by `ord` (without
    such a column the largest one).
    """
    if sample is not None:
        ids = sample_exact(ids, sample, keys=["id"], seed=seed)
    target = F.when(
        F.col("to").startswith("{"), F.get_json_object("to", "$.primaryAccession")
    ).otherwise(F.col("to"))
    last = F.col("ord") if "ord" in reference.columns else target
    lookup = reference.select(F.col("from").alias("id"), target.alias("mapped"), last.alias("_last")).filter(
        (F.col("id") != "") & (F.col("mapped") != "")
    )
    lookup = lookup.groupBy("id").agg(F.max_by("mapped", "_last").alias("mapped"))
    return ids.join(lookup, "id").select(F.col("id").alias("original"), "mapped")


def id_map(mode: str, headers: DataFrame, reference: DataFrame | None = None, **kwargs) -> DataFrame:
    """Id map by mode: `regex` reads it off the headers, `table` looks it up, `none` is empty."""
    if mode == "regex":
        return build_id_map(headers, **kwargs)
    if mode == "table":
        if reference is None:
            raise ValueError("mode 'table' needs a reference table")
        return map_ids_by_table(candidate_ids(headers), reference, **kwargs)
    if mode == "none":
        return headers.sparkSession.createDataFrame([], "original string, mapped string")
    raise ValueError(f"unknown mapping mode {mode!r}, expected one of {MAPPING_MODES}")


def required_ids(*pairs: DataFrame) -> DataFrame:
    """Distinct non-empty ids over both sides of any number of pair tables."""
    sides = None
    for table in pairs:
        both = table.select(F.explode(F.array("p1", "p2")).alias("id"))
        sides = both if sides is None else sides.unionByName(both)
    return sides.filter(F.col("id") != "").distinct()
