"""Train and test assignment tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.numeric import mix32
from terrapanel.operators.order_stats import dense_index, running_totals
from terrapanel.operators.spatial import within_distance


def block_ids(df: DataFrame, x: str, y: str, size: float, out: str = "block") -> DataFrame:
    """floor((x - min x) / size) * 100000 + floor((y - min y) / size)."""
    x0, y0 = df.agg(F.min(x)).scalar(), df.agg(F.min(y)).scalar()
    return df.withColumn(out, F.floor((F.col(x) - x0) / size) * 100000 + F.floor((F.col(y) - y0) / size))


def block_folds(df: DataFrame, x: str, y: str, size: float, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds block and fold. Blocks are shuffled by a hash and dealt to the folds in turn."""
    d = block_ids(df, x, y, size)
    b = d.select("block").distinct().withColumn("_h", mix32("block", seed=seed) * 1048576 + F.pmod(F.col("block"), F.lit(1048576)))
    order = dense_index(b, "_h", "_i").select("block", (F.col("_i") % k).alias("fold"))
    return d.join(order, "block")


def block_kfold(df: DataFrame, key: str, x: str, y: str, size: float, k: int = 5, buffer: float = 0.0, seed: int = 0) -> DataFrame:
    """Long assignment (fold, key, role): each row is a test row once and a training row in the other folds, except
    where it lies within ``buffer`` of a test row of that fold."""
    d = block_folds(df, x, y, size, k, seed).select(key, x, y, F.col("fold").alias("_own"))
    # k copies per row, k being the number of folds
    long = d.select(key, x, y, "_own", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")).alias("fold"))
    long = long.withColumn("role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train"))
    if buffer > 0:
        near = buffered(d.withColumnRenamed("_own", "fold"), key, x, y, buffer)
        drop = near.select(key, "fold").withColumn("role", F.lit("train"))
        long = long.join(drop, [key, "fold", "role"], "left_anti")
    return long.select("fold", key, "role")


def buffered(folded: DataFrame, key: str, x: str, y: str, buffer: float) -> DataFrame:
    """(key, fold) of every row within ``buffer`` of a row of another fold (that fold's test rows)."""
    from terrapanel.operators.spatial import pairs_within
    places = folded.select(x, y, "fold").distinct()
    near = pairs_within(folded.select(x, y).distinct(), places, buffer, (x, y))
    near = near.select(F.col(f"l_{x}").alias(x), F.col(f"l_{y}").alias(y), F.col("r_fold").alias("_f")).distinct()
    return folded.join(near, [x, y]).filter(F.col("fold") != F.col("_f")).select(key, F.col("_f").alias("fold"))


def buffer_exclusion(train: DataFrame, test: DataFrame, key: str, x: str, y: str, buffer: float) -> DataFrame:
    """Training rows farther than ``buffer`` from every test row."""
    return train.join(within_distance(train, test, buffer, key, (x, y)), key, "left_anti")


def forward_chaining(df: DataFrame, year: str, key: str, min_train: int, horizon: int = 1) -> DataFrame:
    """Rolling origin (fold, key, role): fold i trains on the first i years and tests on the next ``horizon``."""
    t = running_totals(df.select(year).distinct(), year, {"n": F.lit(1)}).select(
        F.col(year).alias("_y"), (F.col("n_before") + 1).alias("_r"), F.col("n_all").alias("_k"))
    d = df.select(key, year).join(t, F.col(year) == F.col("_y"))
    # folds run from min_train to k - horizon; a row of rank r tests in folds r-horizon..r-1 and trains from r on
    d = d.filter(F.col("_k") - horizon >= min_train)
    d = d.select(key, "_r", F.explode(F.sequence(F.lit(min_train).cast("bigint"), F.col("_k") - horizon)).alias("fold"))
    role = F.when(F.col("_r") <= F.col("fold"), "train").when(F.col("_r") <= F.col("fold") + horizon, "test")
    return d.withColumn("role", role).filter(F.col("role").isNotNull()).select("fold", key, "role")


def leave_group_out(df: DataFrame, group: str, key: str) -> DataFrame:
    """One fold per group (fold, key, role); the distinct groups are a dimension carried as one array."""
    groups = df.agg(F.sort_array(F.collect_set(group))).scalar()
    d = df.select(key, group, F.explode(groups).alias("fold"))
    return d.select("fold", key, F.when(F.col(group) == F.col("fold"), "test").otherwise("train").alias("role"))


def extreme_years(df: DataFrame, year: str, value: str, n: int = 1) -> DataFrame:
    """Rows with role test in the n years of the largest mean value, train otherwise."""
    means = df.groupBy(F.col(year).alias("_y")).agg(F.avg(value).alias("_m"))
    top = means.orderBy(F.desc("_m"), "_y").limit(n).select("_y", F.lit(True).alias("_t"))
    return df.join(top, F.col(year) == F.col("_y"), "left").withColumn("role", F.when(F.col("_t"), "test").otherwise("train")).drop("_y", "_t")


__all__: Sequence[str] = ("block_ids", "block_folds", "block_kfold", "buffered", "buffer_exclusion", "forward_chaining", "leave_group_out", "extreme_years")
