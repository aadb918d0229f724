"""First- and last-wins choices by an explicit order, and duplicate tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each key, the first in ``order`` (which should be total)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the last by ``order``."""
    return first_wins(df, keys, [F.desc(order)])


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the smallest ``order`` and how many rows repeat the key; combined before shuffling."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_seen"), (F.count("*") - 1).alias("n_duplicates"))


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
