"""Forecast scores, calibration, conformal quantiles and design-based estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions.numeric import clip
from terrapanel.operators.order_stats import bin_index, kth_smallest, quantile_array, running_totals


def brier(df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def brier_skill(df: DataFrame, p: str = "p", y: str = "y", reference: str | None = None) -> DataFrame:
    """1 - BS / BS_ref; the reference is the mean outcome (whose score is its variance) unless a column is given."""
    ref = F.var_pop(y) if reference is None else F.avg(F.pow(F.col(reference) - F.col(y), 2))
    return df.agg((F.lit(1.0) - F.avg(F.pow(F.col(p) - F.col(y), 2)) / F.nullif(ref, F.lit(0.0))).alias("skill"))


def log_loss(df: DataFrame, p: str = "p", y: str = "y", eps: float = 1e-12) -> DataFrame:
    q = clip(p, eps, 1 - eps)
    return df.agg((-F.avg(F.col(y) * F.ln(q) + (F.lit(1.0) - F.col(y)) * F.ln(F.lit(1.0) - q))).alias("log_loss"))


def quantile_bins(df: DataFrame, p: str, y: str, n_bins: int, open_ends: bool = False) -> DataFrame:
    """Rows per bin of unique quantile edges: (bin, n, mean p, mean y).

    With ``open_ends`` the outer edges are infinite, so a tie of the last inner edge with the maximum forms a bin of its own.
    """
    lo, hi = (1, n_bins) if open_ends else (0, n_bins + 1)
    edges = quantile_array(df, p, [i / n_bins for i in range(lo, hi)]).agg(F.max(F.array_distinct("q"))).scalar()
    if open_ends:
        edges = F.concat(F.array(F.lit(float("-inf"))), edges, F.array(F.lit(float("inf"))))
    d = df.withColumn("_e", edges).withColumn("bin", bin_index(p, "_e"))
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(y).alias("y"))


def murphy(df: DataFrame, p: str = "p", y: str = "y", n_bins: int = 10) -> DataFrame:
    """Binned Brier score with reliability, resolution and uncertainty; the identity BS = REL - RES + UNC holds."""
    b = quantile_bins(df, p, y, n_bins, open_ends=True)
    m = b.agg(F.struct(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("ybar")).alias("m")).scalar()
    b = b.withColumn("_m", m)
    n, ybar = F.max("_m.n"), F.max("_m.ybar")
    rel = F.sum(F.col("n") * F.pow(F.col("p") - F.col("y"), 2)) / n
    res = F.sum(F.col("n") * F.pow(F.col("y") - F.col("_m.ybar"), 2)) / n
    # for a 0/1 outcome the mean of (p_k - y)^2 in a bin is (p_k - y_k)^2 + y_k (1 - y_k)
    bs = F.sum(F.col("n") * (F.pow(F.col("p") - F.col("y"), 2) + F.col("y") * (F.lit(1.0) - F.col("y")))) / n
    return b.agg(bs.alias("brier_binned"), rel.alias("reliability"), res.alias("resolution"), (ybar * (F.lit(1.0) - ybar)).alias("uncertainty"))


def calibration_error(df: DataFrame, p: str = "p", y: str = "y", n_bins: int = 10) -> DataFrame:
    b = quantile_bins(df, p, y, n_bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def _label_totals(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return running_totals(df, p, {"pos": F.col(y).cast("bigint"), "n": F.lit(1)}, by)


def average_precision(df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times recall gained, tied scores taken together."""
    t = _label_totals(df, p, y, by)
    tp = F.col("pos_all") - F.col("pos_before")
    seen = F.col("n_all") - F.col("n_before")
    return t.groupBy(*by).agg((F.sum(F.col("pos") / F.nullif(F.col("pos_all"), F.lit(0)) * tp / seen)).alias("pr_auc"))


def auc(df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Rank AUC: negatives below each positive, ties counted one half."""
    t = _label_totals(df, p, y, by)
    below = F.col("n_before") - F.col("pos_before")
    tie = (F.col("n") - F.col("pos")) / 2.0
    pairs = F.max("pos_all") * (F.max("n_all") - F.max("pos_all"))
    return t.groupBy(*by).agg((F.sum(F.col("pos") * (below + tie)) / F.nullif(pairs, F.lit(0))).alias("auc"))


def regression_scores(df: DataFrame, pred: str, obs: str, train_mean: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R2 against the mean of the observations (or a training mean)."""
    e = F.col(pred) - F.col(obs)
    if train_mean is None:
        sst = F.var_pop(obs) * F.count(obs)
    else:
        sst = F.sum(F.pow(F.col(obs) - train_mean, 2))
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.lit(1.0) - F.sum(e * e) / F.nullif(sst, F.lit(0.0))).alias("r2"))


def interval_coverage(df: DataFrame, lo: Column, hi: Column, y: str) -> DataFrame:
    return df.agg(F.avg(((F.col(y) >= lo) & (F.col(y) <= hi)).cast("double")).alias("coverage"))


def pinball(df: DataFrame, pred: str, y: str, tau: float) -> DataFrame:
    d = F.col(y) - F.col(pred)
    return df.agg(F.avg(F.greatest(d * tau, d * (tau - 1.0))).alias("pinball"))


# ---- conformal -------------------------------------------------------------------------------------

def conformal_quantile(df: DataFrame, score: str, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score; infinite when there are too few."""
    k = F.ceil((F.col("n_all") + 1) * (1.0 - alpha))
    n = df.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n_cal"))
    q = kth_smallest(df, score, k, by).select(*by, "q")
    if by:
        return n.join(q, list(by), "left").select(*by, F.coalesce("q", F.lit(float("inf"))).alias("q"), "n_cal")
    one = q.agg(F.max("q")).scalar()
    return n.select(F.coalesce(one, F.lit(float("inf"))).alias("q"), "n_cal")


def conformal_interval(cal: DataFrame, new: DataFrame, pred: str, y: str, alpha: float = 0.1) -> DataFrame:
    """Prediction plus and minus the quantile of absolute calibration errors."""
    q = conformal_quantile(cal.withColumn("_s", F.abs(F.col(y) - F.col(pred))), "_s", alpha).select("q").scalar()
    return new.select("*", (F.col(pred) - q).alias("lo"), (F.col(pred) + q).alias("hi"))


def conformal_quantile_regression(cal: DataFrame, new: DataFrame, lo: str, hi: str, y: str, alpha: float = 0.1) -> DataFrame:
    s = F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi))
    q = conformal_quantile(cal.withColumn("_s", s), "_s", alpha).select("q").scalar()
    return new.select("*", (F.col(lo) - q).alias("cqr_lo"), (F.col(hi) + q).alias("cqr_hi"))


def weighted_conformal(cal: DataFrame, score: str, weight: str, new_weight: float, alpha: float = 0.1) -> DataFrame:
    """First score at which the cumulative weight reaches 1 - alpha with the new point's mass at infinity."""
    t = running_totals(cal.filter(F.col(score).isNotNull()), score, {"w": F.col(weight)})
    reached = (F.col("w_before") + F.col("w")) / (F.col("w_all") + new_weight) >= 1.0 - alpha
    return t.agg(F.coalesce(F.min(F.when(reached, F.col(score))), F.lit(float("inf"))).alias("q"))


# ---- stratified sample -------------------------------------------------------------------------------

def design_based(sample: DataFrame, areas: DataFrame, stratum: str = "stratum", cls: str = "cls", area: str = "area",
                 weight: Column | None = None) -> DataFrame:
    """Area share and area per reference class, with standard errors, and the overall accuracy (stratum equals class).

    ``sample`` has one row per sampled unit; counts per (stratum, class) form a small table.
    """
    n = sample.groupBy(stratum, cls).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))
    w = W.partitionBy(stratum)      # one row per class in a stratum
    n = n.withColumn("nh", F.sum("n").over(w))
    tot = areas.agg(F.sum(area)).scalar()
    n = n.join(areas.select(stratum, F.col(area).alias("_a")), stratum).withColumn("_w", F.col("_a") / tot).withColumn("_f", F.col("n") / F.col("nh"))
    var = F.col("_w") * F.col("_w") * F.col("_f") * (F.lit(1.0) - F.col("_f")) / F.nullif(F.col("nh") - 1, F.lit(0))
    hit = F.col(stratum) == F.col(cls)
    overall = n.agg(F.struct(F.sum(F.when(hit, F.col("_w") * F.col("_f"))).alias("oa"), F.sqrt(F.sum(F.when(hit, var))).alias("se")).alias("o")).scalar()
    out = n.groupBy(cls).agg(F.sum(F.col("_w") * F.col("_f")).alias("p_hat"), F.sqrt(F.sum(var)).alias("se_p"))
    return out.withColumn("_o", overall).select(
        cls, "p_hat", "se_p", (F.col("p_hat") * tot).alias("area_hat"), (F.col("se_p") * tot * 1.96).alias("area_ci95"),
        F.col("_o.oa").alias("overall_accuracy"), F.col("_o.se").alias("se_overall"))
