"""Group means as aggregate-and-join, so a group that holds a third of the rows never sits in one task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.tables import cut_lineage

SIDE = 256  # groups of the second set whose effects are solved for at once
MATRIX = 2**20  # counts held at a time


def with_group_mean(df: DataFrame, group: str, columns: Sequence[str], suffix: str = "_bar") -> DataFrame:
    """Adds the group's mean of every column. Partial averages are formed before the shuffle and the join splits skew."""
    m = df.groupBy(F.col(group).alias("_g")).agg(*[F.avg(c).alias(c + suffix) for c in columns])
    return df.join(m, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def mundlak(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Adds the group mean and the deviation from it."""
    d = with_group_mean(df, group, columns)
    return d.select("*", *[(F.col(c) - F.col(f"{c}_bar")).alias(f"{c}_dev") for c in columns])


def demean(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Columns replaced by their deviation from the group mean."""
    d = with_group_mean(df, group, columns, "__m")
    for c in columns:
        d = d.withColumn(c, F.col(c) - F.col(f"{c}__m"))
    return d.drop(*[f"{c}__m" for c in columns])


def demean_two_way(df: DataFrame, g1: str, g2: str, columns: Sequence[str], tol: float = 1e-10, max_iter: int = 500) -> DataFrame:
    """Means of two sets of groups removed.

    With at most ``SIDE`` groups in the second set the first set's effects are eliminated unit by unit, which leaves one small system
    that is added up in one pass and solved. Otherwise by alternating until no group's effect moves by ``tol``; raises if one still does.
    Both work on counts and sums per pair of groups. The rows are read once to make the sums and once at the end, when both effects
    are subtracted.
    """
    names = list(columns)
    cells = cut_lineage(df.groupBy(F.col(g1).alias("_g1"), F.col(g2).alias("_g2")).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in names], *[F.count(c).alias(f"_n_{c}") for c in names]))

    def effects(key: str, other: str, known: DataFrame | None) -> DataFrame:
        """Mean per group of ``key`` of what the effects of ``other`` leave."""
        d = cells
        if known is not None:
            k = known.select(F.col(other).alias("_o"), *[F.col(f"_e_{c}").alias(f"_k_{c}") for c in names])
            d = cells.join(k, F.col(other).eqNullSafe(F.col("_o")), "left")
        left = [F.sum(F.col(f"_s_{c}") - (F.lit(0.0) if known is None else F.col(f"_n_{c}") * F.coalesce(f"_k_{c}", F.lit(0.0)))) for c in names]
        return d.groupBy(key).agg(*[(s / F.nullif(F.sum(f"_n_{c}"), F.lit(0))).alias(f"_e_{c}") for c, s in zip(names, left, strict=True)])

    few = [x[0] for x in cells.select("_g2").distinct().limit(SIDE + 1).collect()]
    second, step = None, None
    if len(few) <= SIDE:
        second = _solved(cells, few, names)
        first = cut_lineage(effects("_g1", "_g2", second))
        max_iter = 0
    for _ in range(max_iter):
        first = cut_lineage(effects("_g1", "_g2", second))
        new = cut_lineage(effects("_g2", "_g1", first))
        if second is not None:
            old = second.select(F.col("_g2").alias("_o"), *[F.col(f"_e_{c}").alias(f"_k_{c}") for c in names])
            moved = [F.abs(F.coalesce(F.col(f"_e_{c}") - F.col(f"_k_{c}"), F.lit(0.0))) for c in names]
        else:
            old, moved = None, [F.abs(F.coalesce(f"_e_{c}", F.lit(0.0))) for c in names]
        both = new if old is None else new.join(old, F.col("_g2").eqNullSafe(F.col("_o")))
        step = both.agg(F.max(F.greatest(*moved, F.lit(0.0)))).first()[0]
        second = new
        if step is None or step < tol:
            break
    else:
        if len(few) > SIDE:
            raise RuntimeError(f"group effects still move by {step} after {max_iter} rounds")
    a = first.select("_g1", *[F.col(f"_e_{c}").alias(f"_a_{c}") for c in names])
    b = second.select("_g2", *[F.col(f"_e_{c}").alias(f"_b_{c}") for c in names])
    d = df.join(a, F.col(g1).eqNullSafe(F.col("_g1")), "left").join(b, F.col(g2).eqNullSafe(F.col("_g2")), "left")
    for c in names:
        d = d.withColumn(c, F.col(c) - F.col(f"_a_{c}") - F.col(f"_b_{c}"))
    return d.select(*df.columns)


def _solved(cells: DataFrame, groups: list, names: Sequence[str]) -> DataFrame:
    """(_g2, _e_c): the effects of a few groups after those of the many were eliminated: (D2 - N' D1^-1 N) e = s2 - N' D1^-1 s1."""
    spark, t, k = cells.sparkSession, len(groups), len(names)
    kind = cells.schema["_g2"].dataType.simpleString()
    numbers = spark.createDataFrame([(g, i) for i, g in enumerate(groups)], f"_o {kind}, _i int")
    at = cells.join(F.broadcast(numbers), F.col("_g2").eqNullSafe(F.col("_o")))
    entry = [F.collect_list(e).alias(n) for n, e in [("i", F.col("_i")), *[(f"s{x}", F.coalesce(f"_s_{c}", F.lit(0.0))) for x, c in enumerate(names)],
                                                     *[(f"n{x}", F.col(f"_n_{c}").cast("double")) for x, c in enumerate(names)]]]
    units = at.groupBy("_g1").agg(*entry).drop("_g1")

    def run(batches):
        left, right = np.zeros((k, t, t)), np.zeros((k, t))
        for batch in batches:
            for lo in range(0, batch.num_rows, max(1, MATRIX // max(t, 1))):
                part = batch.slice(lo, max(1, MATRIX // max(t, 1)))
                row = np.repeat(np.arange(len(part)), part.column("i").value_lengths().to_numpy())
                col = part.column("i").flatten().to_numpy()
                for x in range(k):
                    n, s = np.zeros((len(part), t)), np.zeros((len(part), t))
                    n[row, col], s[row, col] = part.column(f"n{x}").flatten().to_numpy(), part.column(f"s{x}").flatten().to_numpy()
                    held = np.maximum(n.sum(axis=1), 1.0)[:, None]
                    left[x] += np.diag(n.sum(axis=0)) - n.T @ (n / held)
                    right[x] += (s - n * (s.sum(axis=1)[:, None] / held)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["l", "r"])

    sums = units.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, "l binary, r binary").collect()  # one row per task
    left = sum((np.frombuffer(x["l"]).reshape(k, t, t) for x in sums), np.zeros((k, t, t)))
    right = sum((np.frombuffer(x["r"]).reshape(k, t) for x in sums), np.zeros((k, t)))
    effects = [np.linalg.lstsq(a, b, rcond=1e-10)[0] if t else b for a, b in zip(left, right)]
    rows = [(g, *[float(e[i]) for e in effects]) for i, g in enumerate(groups)]
    return spark.createDataFrame(rows, f"_g2 {kind}, " + ", ".join(f"`_e_{c}` double" for c in names))


def climate_anomaly(df: DataFrame, node: str, year: str, columns: Sequence[str]) -> DataFrame:
    """Adds ``<c>_anom``: value minus the node's mean over unique node-years, in units of the root mean square departure."""
    ny = df.groupBy(node, year).agg(*[F.first(c).alias(c) for c in columns])
    dev = demean(ny, node, columns)
    scale = dev.agg(F.struct(*[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(c) for c in columns]).alias("s")).scalar()
    bars = ny.groupBy(F.col(node).alias("_n")).agg(*[F.avg(c).alias(f"_bar_{c}") for c in columns])
    d = df.join(bars, F.col(node) == F.col("_n")).withColumn("_s", scale)
    for c in columns:
        sd = F.col(f"_s.{c}")
        d = d.withColumn(f"{c}_anom", F.when(sd > 0, (F.col(c) - F.col(f"_bar_{c}")) / sd).otherwise(0.0))
    return d.drop("_n", "_s", *[f"_bar_{c}" for c in columns])


__all__ = ["with_group_mean", "mundlak", "demean", "demean_two_way", "climate_anomaly"]
