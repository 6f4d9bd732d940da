"""Scenario ensembles: completeness, summaries, variance partition, Sobol indices, robust criteria."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.joins import factorial_levels
from terrapanel.operators.order_stats import quantile_columns
from terrapanel.tables import cut_lineage


def factorial_check(df: DataFrame, factors: Sequence[str], unit: str) -> DataFrame:
    """The table, unchanged; raises when a unit lacks a combination of the factor levels or holds one twice."""
    want = factorial_levels(df, factors).agg(F.count(F.lit(1))).scalar()
    bad = df.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*factors).alias("d"))
    worst = bad.agg(F.max(((F.col("n") != want) | (F.col("d") != want)).cast("int"))).scalar()
    return df.filter(F.when(worst == 1, F.raise_error(F.lit("the ensemble is not a full factorial")).cast("boolean")).otherwise(F.lit(True)))


def _effects(df: DataFrame, keys: Sequence[str], factors: Sequence[str], value: str) -> DataFrame:
    """Variance of the means over every factor and factor pair, and the total, per key.

    A key is a node with one row per member (the size of the factorial), so all its means are taken from one
    grouping-sets pass instead of a join per factor.
    """
    sets = [tuple(c) for r in (1, 2) for c in combinations(factors, r) if r < len(factors)]
    rows = [[*keys, *s] for s in sets]
    names = ["_x_".join(s) for s in sets]
    g = df.groupingSets([[F.col(c) for c in r] for r in rows], *[*keys, *factors]).agg(F.avg(value).alias("_m"), F.grouping_id().alias("_gid"))
    bits = len(keys) + len(factors)
    order = [*keys, *factors]

    def gid(s):
        return sum(0 if c in keys or c in s else 1 << (bits - 1 - i) for i, c in enumerate(order))

    out = g.groupBy(*keys).agg(*[F.var_pop(F.when(F.col("_gid") == gid(s), F.col("_m"))).alias(n) for s, n in zip(sets, names)])
    total = df.groupBy(*keys).agg(F.var_pop(value).alias("_total"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_all"))
    return out.join(total, list(keys)) if keys else out.withColumn("_total", df.agg(F.var_pop(value)).scalar())


def anova_fractions(df: DataFrame, keys: Sequence[str], factors: Sequence[str], value: str = "value", minimum: float = 1e-12) -> DataFrame:
    """Main-effect fractions and the interaction; null for units with a missing value or without variance."""
    e = _effects(df, keys, factors, value)
    used = (F.col("_total") >= minimum) & (F.col("_n") == F.col("_all"))
    fr = {f: F.when(used, F.col(f) / F.col("_total")) for f in factors}
    explained = sum(list(fr.values())[1:], list(fr.values())[0])
    return e.select(*keys, used.alias("used"), *[c.alias(f) for f, c in fr.items()], F.greatest(F.lit(0.0), F.lit(1.0) - explained).alias("interaction"))


def three_way_fractions(df: DataFrame, keys: Sequence[str], factors: Sequence[str], value: str = "value", minimum: float = 1e-12) -> DataFrame:
    """Three main effects, three two-way interactions (never negative) and the remainder."""
    e = _effects(df, keys, factors, value)
    used = (F.col("_total") >= minimum) & (F.col("_n") == F.col("_all"))
    t = F.col("_total")
    out = {f: F.col(f) / t for f in factors}
    for a, b in combinations(factors, 2):
        out[f"{a}_x_{b}"] = F.greatest(F.lit(0.0), F.col(f"{a}_x_{b}") - F.col(a) - F.col(b)) / t
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - sum(list(out.values())[1:], list(out.values())[0]))
    interaction = F.lit(1.0) - sum((out[f] for f in factors[1:]), out[factors[0]])
    return e.select(*keys, used.alias("used"), *[F.when(used, c).alias(n) for n, c in out.items()],
                    F.when(used, rest).alias("remainder"), F.when(used, interaction).alias("interaction"))


def partition_summary(fractions: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median and quartiles of every fraction over the nodes, long: (by..., fraction, median, q25, q75).

    The fractions are written once: they come out of sums of doubles, whose last bits follow the order of the rows, and the exact quantiles
    read their values more than once, so a value that differs between two readings could change its bucket and the rank.
    """
    fractions = cut_lineage(fractions.select(*by, *names))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("fraction"), F.col(n).alias("x")) for n in names])).alias("r")
    long = fractions.select(*by, rows).select(*by, F.col("r.fraction").alias("fraction"), F.col("r.x").alias("x"))
    return quantile_columns(long, "x", {"median": 0.5, "q25": 0.25, "q75": 0.75}, [*by, "fraction"])


def sobol(runs: DataFrame, by: str = "input", fa: str = "fa", fb: str = "fb", fab: str = "fab") -> DataFrame:
    """First-order and total indices per input from a run table (one row per sample and input)."""
    a, b, ab = F.col(fa), F.col(fb), F.col(fab)
    mean = (F.sum(a) + F.sum(b)) / (F.count(a) * 2)
    var = (F.sum(a * a) + F.sum(b * b)) / (F.count(a) * 2) - mean * mean
    return runs.groupBy(by).agg((F.avg(b * (ab - a)) / F.nullif(var, F.lit(0.0))).alias("s1"),
                                (F.avg(F.pow(a - ab, 2)) * 0.5 / F.nullif(var, F.lit(0.0))).alias("st"))


# ---- robust criteria ---------------------------------------------------------------------------------

def robust_cells(df: DataFrame, keys: Sequence[str], v: str = "v", v_star: float = 0.6, rho: float = 0.8,
                 buffer: DataFrame | None = None, aoa: DataFrame | None = None) -> DataFrame:
    """Viable in at least a share rho of the members and, where given, with a positive buffer and inside the area of applicability."""
    out = df.groupBy(*keys).agg(F.avg((F.col(v) >= v_star).cast("double")).alias("p_viable"))
    robust = F.col("p_viable") >= rho
    if buffer is not None:
        out = out.join(buffer, list(keys), "left")
        robust = robust & F.coalesce(F.col("buffer") > 0, F.lit(False))
    if aoa is not None:
        out = out.join(aoa, list(keys), "left")
        robust = robust & F.coalesce(F.col("inside"), F.lit(False))
    return out.withColumn("robust", robust)


def risk_averse_score(df: DataFrame, keys: Sequence[str], v: str = "v", lam: float = 0.5) -> DataFrame:
    """Median minus lam times the interquartile range. A key holds one row per member or draw, so the group is bounded."""
    q = F.percentile(F.col(v), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = df.groupBy(*keys).agg(q.alias("_q"))
    return d.select(*keys, (F.col("_q")[1] - (F.col("_q")[2] - F.col("_q")[0]) * lam).alias("score"))


def member_summary(df: DataFrame, keys: Sequence[str], v: str = "v", v_star: float = 0.6) -> DataFrame:
    """Mean, 10th and 90th percentile, share viable and population SD over the members of each key."""
    q = F.percentile(F.col(v), F.array(F.lit(0.1), F.lit(0.9)))
    d = df.groupBy(*keys).agg(F.avg(v).alias("mean"), q.alias("_q"), F.avg((F.col(v) >= v_star).cast("double")).alias("p_viable"), F.stddev_pop(v).alias("sd"))
    return d.select(*keys, "mean", F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p90"), "p_viable", "sd")


def by_path(df: DataFrame, model: str, path: Sequence[str], value: str) -> DataFrame:
    """Mean over nodes per model, then mean, range and count over the models of each path."""
    m = df.groupBy(model, *path).agg(F.avg(value).alias("_m"))
    return m.groupBy(*path).agg(F.avg("_m").alias("mean"), F.min("_m").alias("min"), F.max("_m").alias("max"), F.count(F.lit(1)).alias("n_models"))


def worst_share(df: DataFrame, keys: Sequence[str], v: str, share: float = 0.2) -> DataFrame:
    """Mean of the worst ``share`` of the scenario values per key (at least one); a key holds one row per scenario."""
    a = F.sort_array(F.collect_list(v))
    k = F.greatest(F.ceil(F.size("_a") * F.lit(share) - 1e-9), F.lit(1)).cast("int")
    d = df.groupBy(*keys).agg(a.alias("_a")).withColumn("_k", k)
    return d.select(*keys, (F.aggregate(F.slice("_a", F.lit(1), F.col("_k")), F.lit(0.0), lambda s, x: s + x) / F.col("_k")).alias("worst"))


__all__ = ["factorial_check", "anova_fractions", "three_way_fractions", "partition_summary", "sobol", "robust_cells", "risk_averse_score",
           "member_summary", "by_path", "worst_share", "Column"]
