"""Exact order statistics that never sort a whole table in one task.

A global rank, cumulative sum or exact quantile needs an order over all rows. A window without partition
keys (or the exact percentile aggregate on an unbounded group) would move everything into one task. Here the
values are first counted per distinct value (map-side combine, so a value held by a third of the rows costs
one row per task), the distinct values are split into buckets at approximate quantiles, each bucket is
accumulated on its own, and the bucket totals (a few dozen rows) supply the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions.numeric import col


def running_totals(df: DataFrame, value: str, sums: dict[str, Column], by: Sequence[str] = (),
                   buckets: int = 64) -> DataFrame:
    """Per group and distinct value: the sums of that value, ``<name>_before`` over all smaller values and
    ``<name>_all`` over the group."""
    by = list(by)
    agg = df.groupBy(*by, value).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    fractions = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cut = F.percentile_approx(F.col(value), fractions, 1000).alias("_cuts")
    if by:
        cuts = agg.groupBy(*[F.col(b).alias(f"_b_{b}") for b in by]).agg(cut)
        keys = [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by]
        agg = agg.join(cuts, keys, "left").drop(*[f"_b_{b}" for b in by])
    else:
        agg = agg.withColumn("_cuts", agg.agg(cut).scalar())
    # never null: a null test inferred from the join below would be pushed to the raw rows
    below = F.coalesce(F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(value))), F.lit(0))
    agg = agg.withColumn("_bucket", below).drop("_cuts")

    inside = W.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    agg = agg.select("*", *[F.coalesce(F.sum(n).over(inside), F.col(n) * 0).alias(f"_{n}_in") for n in sums])

    totals = agg.groupBy(*by, "_bucket").agg(*[F.sum(n).alias(f"_{n}_t") for n in sums])
    # at most ``buckets`` rows per group
    earlier = W.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*(by or [F.lit(0)]))
    offsets = totals.select(
        *[F.col(b).alias(f"_b_{b}") for b in by], F.col("_bucket").alias("_bk"),
        *[F.coalesce(F.sum(f"_{n}_t").over(earlier), F.col(f"_{n}_t") * 0).alias(f"_{n}_o") for n in sums],
        *[F.sum(f"_{n}_t").over(whole).alias(f"{n}_all") for n in sums],
    )
    if not by:
        # at most ``buckets`` entries: looked up in the row, which also keeps the bucket expression out of a join condition
        entries = F.map_from_entries(F.collect_list(F.struct("_bk", F.struct(*[c for c in offsets.columns if c != "_bk"]))))
        agg = agg.withColumn("_o", offsets.agg(entries).scalar()).withColumn("_o", F.element_at("_o", F.col("_bucket")))
        return agg.select(value, *sums, *[(F.col(f"_{n}_in") + F.col(f"_o._{n}_o")).alias(f"{n}_before") for n in sums],
                          *[F.col(f"_o.{n}_all").alias(f"{n}_all") for n in sums])
    keys = [F.col("_bucket") == F.col("_bk")] + [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by]
    return agg.join(offsets, keys).select(
        *by, value, *sums,
        *[(F.col(f"_{n}_in") + F.col(f"_{n}_o")).alias(f"{n}_before") for n in sums],
        *[F.col(f"{n}_all") for n in sums],
    )


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    buckets: int = 64) -> DataFrame:
    """Linear-interpolated quantiles, (by..., prob, q); rows with a null value are left out."""
    by = list(by)
    t = running_totals(df.filter(F.col(value).isNotNull()), value, {"n": F.lit(1)}, by, buckets)
    pos = F.array(*[F.struct(F.lit(float(p)).alias("prob"), ((F.col("n_all") - 1) * F.lit(float(p))).alias("h"))
                    for p in probs])
    lo, hi = F.col("n_before"), F.col("n_before") + F.col("n")
    # a distinct value matters only if it covers the rank below or above a wanted position
    hit = F.filter(pos, lambda s: ((F.floor(s["h"]) >= lo) & (F.floor(s["h"]) < hi)) |
                                  ((F.ceil(s["h"]) >= lo) & (F.ceil(s["h"]) < hi)))
    t = t.select(*by, value, lo.alias("_lo"), hi.alias("_hi"), F.explode(hit).alias("_p"))
    h = F.col("_p.h")
    covers = lambda r: (r >= F.col("_lo")) & (r < F.col("_hi"))
    t = t.groupBy(*by, F.col("_p.prob").alias("prob")).agg(
        F.max(F.when(covers(F.floor(h)), F.col(value))).alias("_a"),
        F.max(F.when(covers(F.ceil(h)), F.col(value))).alias("_b"),
        F.max(h - F.floor(h)).alias("_w"),
    )
    return t.select(*by, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("q"))


def quantile_columns(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
                     buckets: int = 64) -> DataFrame:
    """One row per group with a column for each named quantile."""
    q = exact_quantiles(df, value, sorted(set(probs.values())), by, buckets)
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == float(p), F.col("q"))).alias(n)
                                for n, p in probs.items()])


def quantile_array(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One row, one column ``q``: the quantiles in increasing order (for use as a scalar)."""
    q = exact_quantiles(df, value, probs)
    return q.agg(F.sort_array(F.collect_list("q")).alias("q"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """Per group and distinct value: the average rank (1-based) of its ties and the group size."""
    t = running_totals(df.filter(F.col(value).isNotNull()), value, {"n": F.lit(1)}, by, buckets)
    return t.select(*by, value, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("rank"),
                    F.col("n_all").alias("n"))


def with_average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """Rows with the average rank of ``value`` inside the group."""
    by = list(by)
    r = average_ranks(df, value, by, buckets).select(
        *[F.col(b).alias(f"_r_{b}") for b in by], F.col(value).alias("_rv"), F.col("rank").alias(out),
        F.col("n").alias(f"{out}_n"))
    keys = [F.col(value) == F.col("_rv")] + [F.col(b).eqNullSafe(F.col(f"_r_{b}")) for b in by]
    return df.join(r, keys, "left").drop("_rv", *[f"_r_{b}" for b in by])


def kth_smallest(df: DataFrame, value: str, k: Column, by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """The k-th smallest value of each group; ``k`` may use ``n_all``. No row for a group with k above its size."""
    t = running_totals(df.filter(F.col(value).isNotNull()), value, {"n": F.lit(1)}, by, buckets)
    hit = (k > F.col("n_before")) & (k <= F.col("n_before") + F.col("n"))
    return t.filter(hit).select(*by, F.col(value).alias("q"), F.col("n_all").alias("n"))


def dense_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """0-based position of each row in the order of a unique key, without a single-task sort."""
    t = running_totals(df, key, {"n": F.lit(1)}).select(F.col(key).alias("_k"), F.col("n_before").alias(out))
    return df.join(t, F.col(key) == F.col("_k")).drop("_k")


def bin_index(value, edges) -> Column:
    """0-based bin of a value among increasing edges: left-closed bins, ends clipped into the first and last bin."""
    e = col(edges)
    inner = F.slice(e, F.lit(2), F.greatest(F.size(e) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda x: x <= col(value)))
