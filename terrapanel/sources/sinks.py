"""Result tables and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.functions.numeric import finite

RECORDS = 5_000_000  # at most so many rows in a file


def write_results(df: DataFrame, path: str, grain: Sequence[str], mode: str = "overwrite") -> None:
    """Parquet, one folder per value of the grain; rows of a folder are gathered first, so it holds few files.

    Partitions are rebalanced by size: a value with many rows is dealt to several tasks.
    """
    df.hint("rebalance", *[F.col(g) for g in grain]).sortWithinPartitions(*grain).write.option("maxRecordsPerFile", RECORDS).partitionBy(*grain).mode(mode).parquet(path)


def clean_numbers(df: DataFrame, places: dict[str, int] | None = None) -> DataFrame:
    """NaN and infinities to null; listed columns rounded half-even."""
    places = places or {}
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite(c)
            if f.name in places:
                c = F.bround(c, places[f.name])
        out.append(c.alias(f.name))
    return df.select(*out)


def write_json(df: DataFrame, path: str, places: dict[str, int] | None = None, mode: str = "overwrite") -> None:
    clean_numbers(df, places).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with quotes doubled inside quoted fields and empty text for null."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def headline(members: DataFrame, baseline: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, range and change against the baseline mean, in percentage points, per key."""
    m = members.groupBy(*keys, "model").agg(F.avg(value).alias("_v"))
    s = m.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    base = baseline.agg(F.avg(value)).scalar()
    return s.select(*keys, "mean", "min", "max", ((F.col("mean") - base) * 100.0).alias("delta_pp"))
