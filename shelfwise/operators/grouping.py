"""Small group-wise operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    Plans as a row_number limit that is applied before the shuffle too, so a key with very many rows sends one row per
    map task.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", number).filter("_rn = 1").drop("_rn")


def mode_per_key(counts: DataFrame, key: str, value: str, weight: str, alias: str) -> DataFrame:
    """The most frequent ``value`` per ``key`` from (key, value, weight) rows; ties go to the smallest value, NULL first.

    ``counts`` may hold several rows per pair: they are summed here, before anything is ranked.
    """
    totals = counts.groupBy(key, value).agg(F.sum(weight).alias("_w"))
    return first_per_key(totals, [key], [F.col("_w").desc(), F.col(value)]).select(key, F.col(value).alias(alias))


def total_order(df: DataFrame, leading: Sequence[Column], skip: Sequence[str]) -> list[Column]:
    """``leading`` followed by every other column, so that ties are always broken the same way."""
    return [*leading, *[F.col(c) for c in df.columns if c not in skip]]
