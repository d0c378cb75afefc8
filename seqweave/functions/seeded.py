"""Deterministic draws: md5 of `seed:key`, the same on every engine and on every retry of a task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, *keys: str | Column) -> Column:
    """32 hex digits that order rows reproducibly under `seed`."""
    parts = [F.lit(str(seed))]
    for key in keys:
        parts.append((F.col(key) if isinstance(key, str) else key).cast("string"))
    return F.md5(F.concat_ws(":", *parts))


def hash_to_long(digest: Column, digits: int = 8, start: int = 1) -> Column:
    """Leading hex digits of a digest as a non-negative BIGINT."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def seeded_uniform(seed: int, *keys: str | Column) -> Column:
    """Uniform draw in the open interval (0, 1)."""
    return (hash_to_long(seeded_hash(seed, *keys)).cast("double") + 0.5) / F.lit(float(16**8))


def seeded_choice(alphabet: str, seed: int, *keys: str | Column) -> Column:
    """One character of `alphabet` per row."""
    index = hash_to_long(seeded_hash(seed, *keys)) % F.lit(len(alphabet))
    return F.substring(F.lit(alphabet), (index + 1).cast("int"), F.lit(1))


def seeded_normal(seed: int, *keys: str | Column) -> Column:
    """Standard normal draw (Box-Muller on two digests)."""
    u1 = seeded_uniform(seed, *keys, F.lit("r"))
    u2 = seeded_uniform(seed, *keys, F.lit("t"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0) * F.pi() * u2)
