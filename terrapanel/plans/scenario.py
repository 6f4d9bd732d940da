"""Scenario runs: members joined to daily weather, treeline change, resumable member output."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.ecology import treeline_elevation
from terrapanel.operators.windows import season_indices


def treeline_shift(node_day: DataFrame, deltas: DataFrame, keys: Sequence[str], members: Sequence[str], z_ref: Column, gamma: Column,
                   series: Sequence[str] = ("node", "year")) -> DataFrame:
    """Treeline under each member minus the baseline treeline of the same node and year: (node, year, members..., shift).

    ``deltas`` holds the additive change ``dt`` per key and member; days are joined and reduced to the season mean
    in one pass per member.
    """
    base = season_indices(node_day, series).select(*series, treeline_elevation("gst", z_ref, gamma).alias("_base"))
    moved = node_day.join(deltas, list(keys)).withColumn("t_mean", F.col("t_mean") + F.col("dt"))
    m = season_indices(moved, [*series, *members])
    m = m.select(*series, *members, treeline_elevation("gst", z_ref, gamma).alias("_tl"))
    return m.join(base, list(series)).select(*series, *members, (F.col("_tl") - F.col("_base")).alias("shift"))


def finished_members(spark: SparkSession, path: str, factors: Sequence[str]) -> DataFrame | None:
    """Members whose completion is recorded beside the partitioned path; None when no run was completed yet."""
    try:
        return spark.read.parquet(f"{path}.done").select(*factors).distinct()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def run_members(spark: SparkSession, members: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, factors: Sequence[str]) -> DataFrame:
    """Run ``job`` on the members that aren't complete and write their output, one folder per member.

    A member's folder is replaced as a whole and its completion recorded afterwards, so what a broken run left is written
    anew, neither skipped nor doubled.

    ``job`` takes the table of missing members and returns rows that carry the factor columns. Raises when the
    written ensemble still misses a member, so a partial ensemble is never published.
    """
    done = finished_members(spark, path, factors)
    todo = members if done is None else members.join(done, list(factors), "left_anti")
    if not todo.isEmpty():
        made = job(todo).hint("rebalance", *[F.col(f) for f in factors])
        made.write.partitionBy(*factors).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        written = spark.read.parquet(path).select(*factors).distinct()
        todo.select(*factors).join(written, list(factors), "left_semi").write.mode("append").parquet(f"{path}.done")
    out = spark.read.parquet(path)
    missing = members.join(out.select(*factors).distinct(), list(factors), "left_anti").count()
    if missing:
        raise ValueError(f"{missing} member(s) have no output; refusing to publish a partial ensemble")
    return out
