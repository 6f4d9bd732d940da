"""Ordered windows over bounded series: a series has one row per key and day, month or year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.constants import MONTH_DAYS
from terrapanel.functions.ecology import height_at_age
from terrapanel.functions.numeric import clip, finite
from terrapanel.functions.special import gamma, with_normal_quantile
from terrapanel.operators.order_stats import with_average_rank


def dense_series(df: DataFrame, key: str, time: str) -> DataFrame:
    """Every key with every time step between the first and last of the table; missing steps hold nulls."""
    lo, hi = df.agg(F.min(time)).scalar(), df.agg(F.max(time)).scalar()
    full = df.select(key).distinct().withColumn(time, F.explode(F.sequence(lo, hi)))
    return full.join(df, [key, time], "left")


# ---- daily series --------------------------------------------------------------------------------

def growing_degrees(t, base: float = 5.0) -> Column:
    return F.greatest(F.col(t) - base, F.lit(0.0))


def cumulative_gdd(df: DataFrame, keys: Sequence[str], t: str = "t_mean", day: str = "doy", base: float = 5.0) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("gdd_cum", F.sum(growing_degrees(t, base)).over(w))


def warmest_day(df: DataFrame, keys: Sequence[str], t: str = "t_mean", day: str = "doy", window: int = 15) -> DataFrame:
    """Day of the largest centred running mean (window shrinks at the ends, the first day wins a tie)."""
    if window < 1 or window % 2 == 0:
        raise ValueError("the window must be a positive odd number of days")
    half = window // 2
    w = W.partitionBy(*keys).orderBy(day).rowsBetween(-half, half)
    s = df.select(*keys, day, F.avg(t).over(w).alias("_m"))
    return s.groupBy(*keys).agg(F.max_by(day, F.struct(F.col("_m"), -F.col(day))).alias("warmest"), F.max("_m").alias("warmest_mean"))


def late_frost(df: DataFrame, keys: Sequence[str], budburst: Column, t: str = "t_mean", t_min: str = "t_min",
               day: str = "doy", crit: float = -2.0, spring_only: bool = True) -> DataFrame:
    """Days below ``crit`` after thermal budburst, up to the warmest day (or the end of the record)."""
    d = cumulative_gdd(df, keys, t, day)
    hit = (F.col("gdd_cum") >= budburst) & (F.col(t_min) < crit)
    if spring_only:
        d = d.join(warmest_day(df, keys, t, day), list(keys))
        hit = hit & (F.col(day) <= F.col("warmest"))
    return d.groupBy(*keys).agg(F.count_if(hit).alias("late_frost_days"))


def season_indices(df: DataFrame, keys: Sequence[str], t: str = "t_mean", t0: float = 0.9) -> DataFrame:
    """Growing degree days, season length and mean season temperature (null without a season)."""
    warm = F.col(t) >= t0
    return df.groupBy(*keys).agg(F.sum(growing_degrees(t)).alias("gdd"), F.count_if(warm).alias("gsl"),
                                 F.avg(F.when(warm, F.col(t))).alias("gst"))


# ---- monthly cycle to days -------------------------------------------------------------------------

MID_DOY = [sum(MONTH_DAYS[:m + 1]) - MONTH_DAYS[m] / 2.0 + 0.5 for m in range(12)]


def month_array(monthly: DataFrame, keys: Sequence[str], value: str, out: str = "m12") -> DataFrame:
    """The twelve values of each key in month order."""
    a = F.array_sort(F.collect_list(F.struct("month", F.col(value).alias("v"))))
    return monthly.groupBy(*keys).agg(F.transform(a, lambda s: s["v"]).alias(out))


def cyclic_value(m12: str, doy) -> Column:
    """Linear interpolation between mid-month days, December joined to January."""
    d = F.col(doy).cast("double")
    mids = F.array(*[F.lit(x) for x in MID_DOY])
    i = F.size(F.filter(mids, lambda x: x <= d))
    left = F.when(i == 0, F.lit(12)).otherwise(i)
    right = F.when(i == 12, F.lit(1)).otherwise(i + 1)
    x0 = F.element_at(mids, left) - F.when(i == 0, 365.0).otherwise(0.0)
    x1 = F.element_at(mids, right) + F.when(i == 12, 365.0).otherwise(0.0)
    a, b = F.element_at(F.col(m12), left), F.element_at(F.col(m12), right)
    return a + (b - a) * (d - x0) / (x1 - x0)


def seasonal_shape(monthly: DataFrame, keys: Sequence[str], value: str, days: int = 365) -> DataFrame:
    """Daily factor with mean one over the year, from twelve monthly values per key."""
    d = month_array(monthly, keys, value).withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(days))))
    d = d.withColumn("_x", cyclic_value("m12", "doy"))
    return d.select(*keys, "doy", (F.col("_x") / F.nullif(F.avg("_x").over(W.partitionBy(*keys)), F.lit(0.0))).alias("shape"))


def scenario_factor(monthly: DataFrame, keys: Sequence[str], base: str, member_base: str, member_future: str, days: int = 365) -> DataFrame:
    """Baseline shape times the interpolated future / baseline ratio (1 where the baseline is not positive)."""
    r = F.when(F.col(member_base) > 0, F.col(member_future) / F.nullif(F.col(member_base), F.lit(0.0))).otherwise(1.0)
    ratio = month_array(monthly.withColumn("_r", r), keys, "_r", "r12")
    s = seasonal_shape(monthly, keys, base, days).join(ratio, list(keys))
    return s.select(*keys, "doy", (F.col("shape") * cyclic_value("r12", "doy")).alias("factor"))


# ---- standardised indices ------------------------------------------------------------------------------

def spei(df: DataFrame, key: str, time: str, value: str, scale: int = 3, period: int = 12, reference: Column | None = None) -> DataFrame:
    """Standardised index of the rolling sum: log-logistic by probability-weighted moments per calendar month.

    ``reference`` marks the rows of the reference period (default all). Null in the first scale - 1 steps.
    """
    w = W.partitionBy(key).orderBy(time)
    d = df.withColumn("_i", F.row_number().over(w) - 1)
    full = F.count(value).over(w.rowsBetween(-(scale - 1), 0)) == scale
    d = d.withColumn("_acc", F.when(full, F.sum(value).over(w.rowsBetween(-(scale - 1), 0)))).withColumn("_m", F.col("_i") % period)
    d = d.withColumn("_in", (F.lit(True) if reference is None else F.coalesce(reference, F.lit(False))) & F.col("_acc").isNotNull())
    ref = d.filter("_in")
    place = F.row_number().over(W.partitionBy(key, "_m").orderBy("_acc", time))
    ref = ref.withColumn("_f", (place - 0.35) / F.count(F.lit(1)).over(W.partitionBy(key, "_m")))
    u = F.lit(1.0) - F.col("_f")
    p = ref.groupBy(key, "_m").agg(F.avg("_acc").alias("_w0"), F.avg(u * F.col("_acc")).alias("_w1"), F.avg(u * u * F.col("_acc")).alias("_w2"))
    beta = (F.col("_w1") * 2 - F.col("_w0")) / F.nullif(F.col("_w1") * 6 - F.col("_w0") - F.col("_w2") * 6, F.lit(0.0))
    p = p.withColumn("_b", beta)
    p = p.withColumn("_g", gamma(F.lit(1.0) + F.lit(1.0) / F.col("_b")) * gamma(F.lit(1.0) - F.lit(1.0) / F.col("_b")))
    p = p.withColumn("_a", (F.col("_w0") - F.col("_w1") * 2) * F.col("_b") / F.nullif(F.col("_g"), F.lit(0.0)))
    p = p.select(key, "_m", "_a", "_b", (F.col("_w0") - F.col("_a") * F.col("_g")).alias("_c"))
    d = d.join(p, [key, "_m"], "left")
    ratio = F.col("_a") / F.nullif(F.col("_acc") - F.col("_c"), F.lit(0.0))
    # a negative ratio has no real power: the value is undetermined
    cdf = finite(F.lit(1.0) / (F.pow(F.when(ratio >= 0, ratio), F.col("_b")) + 1.0))
    d = with_normal_quantile(d.withColumn("_cdf", clip(cdf, 1e-6, 1 - 1e-6)), "_cdf", "spei")
    return d.drop("_i", "_acc", "_m", "_in", "_a", "_b", "_c", "_cdf")


def quantile_delta_map(obs_hist: DataFrame, mod_hist: DataFrame, mod_proj: DataFrame, key: str, value: str = "x", order: str = "t",
                       kind: str = "additive", eps: float = 1e-6) -> DataFrame:
    """Model change at every quantile carried onto the observed distribution (one value per projected row).

    A series of one key is bounded by its record length; the two order statistics around each quantile come from an
    equi-join on (key, position).
    """
    if kind not in ("additive", "multiplicative"):
        raise ValueError("kind must be 'additive' or 'multiplicative'")

    def ordered(df, name):
        pos = F.row_number().over(W.partitionBy(key).orderBy(value, order)) - 1
        return df.select(key, pos.alias("_pos"), F.col(value).alias(name), F.count(F.lit(1)).over(W.partitionBy(key)).alias("_n"))

    n = F.count(F.lit(1)).over(W.partitionBy(key))
    r = F.row_number().over(W.partitionBy(key).orderBy(value, order))
    out = mod_proj.withColumn("_tau", (r - 0.5) / n)
    for df, name in ((obs_hist, "_qo"), (mod_hist, "_qm")):
        h = ordered(df, "_v")
        size = h.groupBy(key).agg(F.max("_n").alias("_n"))
        out = out.join(size, key).withColumn("_h", F.col("_tau") * (F.col("_n") - 1)).withColumn("_lo", F.floor("_h"))
        lo = h.select(key, F.col("_pos").alias("_lo"), F.col("_v").alias("_a"))
        hi = h.select(key, (F.col("_pos") - 1).alias("_lo"), F.col("_v").alias("_b2"))
        out = out.join(lo, [key, "_lo"]).join(hi, [key, "_lo"], "left")
        q = F.col("_a") + (F.coalesce("_b2", "_a") - F.col("_a")) * (F.col("_h") - F.col("_lo"))
        out = out.withColumn(name, q).drop("_n", "_h", "_lo", "_a", "_b2")
    moved = (F.col("_qo") + F.col(value) - F.col("_qm")) if kind == "additive" else (
        F.col("_qo") * (F.col(value) / F.greatest(F.col("_qm"), F.lit(eps))))
    return out.withColumn("adjusted", moved).drop("_tau", "_qo", "_qm")


# ---- annual series ---------------------------------------------------------------------------------------

def trailing_z(df: DataFrame, key: str, time: str, value: str = "x", window: int = 10, out: str = "z") -> DataFrame:
    """(x - median of the previous ``window`` steps) / their sample SD; null when any is missing or the SD is 0."""
    w = W.partitionBy(key).orderBy(time).rowsBetween(-window, -1)
    sd = F.when(F.count(value).over(w) == window, F.stddev_samp(value).over(w))
    return df.withColumn(out, F.when(sd > 0, (F.col(value) - F.percentile(F.col(value), F.lit(0.5)).over(w)) / sd))


def dieback(df: DataFrame, key: str, time: str, z: str = "z", nd: str | None = "nd", out: str = "event", onset: float = -2.0,
            recovery: float = -1.0, seasons: int = 2, lookback: int = 1, run_start: bool = True) -> DataFrame:
    """Onset of a persistent decline. The next ``seasons`` rows must exist; a missing z there is no recovery."""
    w = W.partitionBy(key).orderBy(time)
    below = F.coalesce(F.col(z) < onset, F.lit(False))
    d = df.withColumn("_on", below)
    ok = F.col("_on") & F.lead(F.lit(True), seasons).over(w).isNotNull()
    for s in range(1, seasons + 1):
        ok = ok & ~F.coalesce(F.lead(z, s).over(w) > recovery, F.lit(False))
    if run_start:
        ok = ok & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    if nd is not None:
        ok = ok & F.bool_and(F.coalesce(F.col(nd), F.lit(False))).over(w.rowsBetween(-lookback, 0))
    return d.withColumn(out, ok).drop("_on")


def recently_disturbed(df: DataFrame, key: str, time: str, nd: str = "nd", years: int = 10, out: str = "disturbed_recent") -> DataFrame:
    """Flagged in the year or in the ``years`` before it."""
    w = W.partitionBy(key).orderBy(time).rowsBetween(-years, 0)
    return df.withColumn(out, F.bool_or(~F.coalesce(F.col(nd), F.lit(False))).over(w))


def person_period(units: DataFrame, first: str, last: str, event: str, time: str = "year") -> DataFrame:
    """One row per unit and year up to the event or the end; nothing after the first event."""
    stop = F.least(F.col(last), F.coalesce(F.col(event), F.col(last)))
    years = F.when(F.col(first) <= stop, F.sequence(F.col(first), stop))
    d = units.withColumn(time, F.explode(years))
    return d.withColumn("event", F.coalesce(F.col(time) == F.col(event), F.lit(False)).cast("int"))


def lags(df: DataFrame, key: str, time: str, value: str, max_lag: int) -> DataFrame:
    """Lag columns 0..max_lag; rows without the full history are dropped."""
    w = W.partitionBy(key).orderBy(time)
    d = df.select("*", *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in range(max_lag + 1)], F.row_number().over(w).alias("_r"))
    return d.filter(F.col("_r") > max_lag).drop("_r")


def survival_curve(df: DataFrame, key: str, time: str, h: str = "h") -> DataFrame:
    w = W.partitionBy(key).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("survival", F.product(F.lit(1.0) - F.col(h)).over(w))


def physiological_age(df: DataFrame, key: str, time: str, phi: str = "phi", a0: float = 0.0, height: tuple | None = None) -> DataFrame:
    """Accumulated growth age and, with ``height = (asymptote, rate, shape)``, the height it gives."""
    w = W.partitionBy(key).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("age", F.sum(clip(phi, 0.0, 1.0)).over(w) + a0)
    return d if height is None else d.withColumn("height", height_at_age("age", *height))


def rank_within(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank01") -> DataFrame:
    """Average ranks scaled to [0, 1]; a constant group maps to 0.5."""
    by = list(by)
    d = with_average_rank(df, value, "_r", by)
    spread = df.groupBy(*by).agg((F.max(value) == F.min(value)).alias("_flat"))
    d = d.join(spread, by) if by else d.withColumn("_flat", df.agg(F.max(value) == F.min(value)).scalar())
    scaled = (F.col("_r") - 1) / F.nullif((F.col("_r_n") - 1).cast("double"), F.lit(0.0))
    return d.withColumn(out, F.when(F.col("_flat"), F.lit(0.5)).otherwise(scaled)).drop("_r", "_r_n", "_flat")
