"""The relations that operators work on, from tables with repeated and late rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row of each key, that with the greatest version; among equals the greatest row, so not by chance."""
    others = [c for c in df.columns if c not in keys and c != version]
    best = F.max(F.struct(version, *others)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*[F.col(f"_best.{c}").alias(c) if c not in keys else F.col(c) for c in df.columns])


def one_of_each(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key whose deliveries agree."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in others]).select(*df.columns)


def distinct_blocks(df: DataFrame, payload: bool = True) -> DataFrame:
    """Blocks whose deliveries agree, each once; payload=False leaves the data out of scan and shuffle.

    All columns but the data are grouped by, so filters on any of them reach
    the scan, and consumers of different columns share one exchange.
    """
    slim = df.drop("data")
    if not payload or "data" not in df.columns:
        return slim.distinct()
    return df.groupBy(*slim.columns).agg(F.first("data").alias("data")).select(*df.columns)
