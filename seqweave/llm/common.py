"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(text: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """A value made once in each Python worker process and kept between tasks (a tokenizer, a word cache).

    Functions of this package travel by value, so module globals would be made anew in every task.
    """
    holder = sys.modules.setdefault("_per_worker_values", types.ModuleType("_per_worker_values"))
    values = holder.__dict__
    if name not in values:
        values[name] = make()
    return values[name]
