"""Niche scores: Boyce index, thresholds, group support, rank validation, trait medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions.hydraulics import curve_slope
from terrapanel.operators.order_stats import average_ranks, exact_quantiles, with_average_rank
from terrapanel.tables import cut_lineage, small


def boyce_windows(scores: DataFrame, score: str, presence: str, by: Sequence[str] = (), n: int = 100, width: float = 0.1, count: str | None = None) -> DataFrame:
    """Predicted-to-expected ratio per sliding window (inclusive at both ends) of each group.

    A score lies in a contiguous run of windows: its first and last are found by arithmetic and checked against the
    window's own ends, and rows are counted per window before the shuffle. A row stands for ``count`` equal ones where that is given.
    The ends of the groups (a row each) are broadcast, so the scores of a few large groups are never moved or sorted.
    """
    by = list(by)
    c = F.lit(1) if count is None else F.col(count)
    present = F.sum(F.col(presence).cast("int") * c)
    ends = F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"), F.sum(c).alias("na"), present.alias("np")).alias("_e")
    if by:
        d = scores.join(small(cut_lineage(scores.groupBy(*by).agg(ends))), by)
    else:
        d = scores.withColumn("_e", scores.agg(ends).scalar())
    lo, span = F.col("_e.lo"), F.col("_e.hi") - F.col("_e.lo")
    d = d.filter(span > 0)
    step = span * (1.0 - width) / (n - 1)
    pos = (F.col(score) - lo) / step
    first = F.greatest(F.floor(pos - span * width / step) - 1, F.lit(0))
    last = F.least(F.ceil(pos) + 1, F.lit(n - 1))
    d = d.select("*", F.explode(F.sequence(first, last)).alias("w"))
    start = lo + F.col("w") * step
    d = d.filter((F.col(score) >= start) & (F.col(score) <= start + span * width))
    # numbers only: with a struct among them the aggregate would sort all copies of the rows
    g = d.groupBy(*by, "w").agg(present.alias("p"), F.sum(c).alias("a"), F.max("_e.np").alias("_np"), F.max("_e.na").alias("_na"))
    ratio = (F.col("p") / F.col("_np")) / (F.col("a") / F.col("_na"))
    return g.select(*by, "w", ratio.alias("ratio"))


def boyce_index(scores: DataFrame, score: str, presence: str, by: Sequence[str] = (), n: int = 100, width: float = 0.1, count: str | None = None) -> DataFrame:
    """Rank correlation of the ratio with the window position (at most ``n`` windows per group); null below three windows."""
    by = list(by)
    r = boyce_windows(scores, score, presence, by, n, width, count)
    part = by or [F.lit(0)]
    for c, o in (("w", "_rw"), ("ratio", "_rr")):
        ties = F.count(F.lit(1)).over(W.partitionBy(*part, c))
        r = r.withColumn(o, F.rank().over(W.partitionBy(*part).orderBy(c)) + (ties - 1) / 2.0)
    return r.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 3, F.corr("_rw", "_rr")).alias("boyce"), F.count(F.lit(1)).alias("n_windows"))


def presence_threshold(scores: DataFrame, score: str, presence: str, by: Sequence[str] = (), omission: float = 0.10) -> DataFrame:
    """Score below which the share ``omission`` of a species' own records falls."""
    return exact_quantiles(scores.filter(F.col(presence)), score, [omission], by).select(*by, F.col("q").alias("threshold"))


def group_support(support: DataFrame, passing: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True where any passing species of the group is suitable; null for a group without one.

    ``support`` (keys..., species, suitable), ``passing`` (species, grp), ``groups`` (keys..., grp) lists the wanted rows.
    """
    s = support.join(passing, "species").groupBy(*keys, "grp").agg(F.bool_or("suitable").alias("supported"))
    return groups.join(s, [*keys, "grp"], "left")


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks, for groups of any size."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = with_average_rank(with_average_rank(d, a, "_ra", by), b, "_rb", by)
    return d.groupBy(*by).agg(F.corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def trait_summary(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: median P50, median slope (only where P12 > P88), their sample SD (null below two) and counts."""
    d = records.join(groups, "species")
    slope = F.when(F.col("p12") > F.col("p88"), curve_slope("p12", "p88"))
    d = d.withColumn("slope", slope)
    base = d.groupBy("grp").agg(F.stddev_samp("p50").alias("p50_sd"), F.count("p50").alias("p50_n"),
                                F.stddev_samp("slope").alias("slope_sd"), F.count("slope").alias("slope_n"))
    for c in ("p50", "slope"):
        base = base.join(exact_quantiles(d, c, [0.5], ["grp"]).select("grp", F.col("q").alias(f"{c}_median")), "grp", "left")
    return base


__all__ = ["boyce_windows", "boyce_index", "presence_threshold", "group_support", "spearman", "trait_summary", "average_ranks"]
