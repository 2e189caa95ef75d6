"""Ids that pass through Python whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mapped(rows: DataFrame, fn: Callable, schema: str, key: str = "doc_id") -> DataFrame:
    """``rows.mapInPandas`` with the key as text on both sides: pandas would turn a batch of longs with a null into doubles.

    ``schema`` names the columns that ``fn`` gives besides the key, which comes first.
    """
    kind = rows.schema[key].dataType
    out = rows.withColumn(key, F.col(key).cast("string")).mapInPandas(fn, f"{key} string, {schema}")
    return out.withColumn(key, F.col(key).cast(kind))
