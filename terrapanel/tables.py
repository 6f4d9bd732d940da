"""Sessions, checkpoints, size-checked broadcasts and NaN-free ingest."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.functions.numeric import finite

BROADCAST_ROWS = 200_000


def session(app: str = "terrapanel", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; cluster settings given by the caller win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a fresh temporary one only where none is set and Spark runs locally."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        if not (spark.conf.get("spark.checkpoint.dir", None) or sc.master.startswith("local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(
            prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write the rows to the reliable checkpoint folder, so a lost executor costs no recomputation of the loop."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting: above ``limit`` rows the table stays shuffled.

    Counting stops at ``limit + 1`` rows, so the check itself is bounded.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def by_keys(df: DataFrame, *keys: str, per_core: int = 8) -> DataFrame:
    """One side of a join with many matches per row: spread over ``per_core`` tasks a core by the join keys, and neither broadcast nor merged
    into fewer tasks. The sizes that Spark goes by are those of the inputs, which say nothing of the pairs."""
    return df.repartition(per_core * df.sparkSession.sparkContext.defaultParallelism, *keys).hint("merge")


def without_nan(df: DataFrame) -> DataFrame:
    """Every NaN or infinity in a floating column becomes null (NaN sorts above all numbers in Spark)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def one_value(df: DataFrame) -> Column:
    """The single value of an aggregate as a scalar subquery: no join, evaluated once per plan."""
    return df.scalar()


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Keep the rows and raise at run time when ``bad`` is true for any of them."""
    guard = F.when(bad, F.raise_error(F.lit(message))).otherwise(F.lit(True))
    return df.filter(guard.cast("boolean"))
