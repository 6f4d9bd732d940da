"""Station fits, climatologies, change factors and cohort products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.ecology import age_at_height
from terrapanel.functions.numeric import clip


def monthly_slope(df: DataFrame, z: str, y: str | Column, month: str = "month", minimum: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope, R2 and count per month; null below ``minimum`` rows or with a single elevation."""
    v = F.col(y) if isinstance(y, str) else y
    d = df.withColumn("_y", v).filter(F.col("_y").isNotNull() & F.col(z).isNotNull())
    ok = (F.count(F.lit(1)) >= minimum) & (F.max(z) > F.min(z))
    return d.groupBy(*by, month).agg(
        F.when(ok, F.regr_slope("_y", z)).alias("slope"), F.when(ok, F.regr_intercept("_y", z)).alias("intercept"),
        F.when(ok, F.regr_r2("_y", z)).alias("r2"), F.count(F.lit(1)).alias("n"))


def lapse_rate(df: DataFrame, z: str = "z", t: str = "t", month: str = "month") -> DataFrame:
    return monthly_slope(df, z, t, month).select(month, F.col("slope").alias("gamma"), "n")


def precip_gradient(df: DataFrame, z: str = "z", p: str = "p", month: str = "month", eps: float = 1e-6) -> DataFrame:
    """Slope of log precipitation (floored at ``eps``) on elevation."""
    return monthly_slope(df, z, F.ln(F.greatest(F.col(p), F.lit(eps))), month).select(month, F.col("slope").alias("grad"), "n")


def station_days(obs: DataFrame, stations: DataFrame, element: str = "PRCP") -> DataFrame:
    """Observations of one element with the station's elevation."""
    return obs.filter(F.col("element") == element).join(stations.select("station", "elevation"), "station").select(
        "station", "date", F.month("date").alias("month"), "elevation", "value")


def climatology(monthly: DataFrame, keys: Sequence[str], first: int, last: int, value: str = "value") -> DataFrame:
    """Calendar-month mean over the years; raises for a key with an empty month."""
    d = monthly.filter(F.col("year").between(first, last)).groupBy(*keys, "month").agg(F.avg(value).alias(value))
    n = d.groupBy(*keys).agg(F.count(value).alias("_n")) if keys else None
    if n is None:
        return d
    full = n.withColumn("_n", F.when(F.col("_n") < 12, F.raise_error(F.lit("no data for a month of the window")).cast("bigint")).otherwise(F.col("_n")))
    return d.join(full, list(keys)).filter(F.col("_n") >= 12).drop("_n")


def monthly_means(daily: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    return daily.groupBy(*keys, F.year(date).alias("year"), F.month(date).alias("month")).agg(F.avg(value).alias(value))


def change_factors(base: DataFrame, future: DataFrame, keys: Sequence[str], t: str = "t", p: str = "p") -> DataFrame:
    """Temperature difference and precipitation ratio (1 where the baseline is at most 0.01)."""
    f = future.select(*keys, F.col(t).alias("_t"), F.col(p).alias("_p"))
    ratio = F.when(F.col(p) > 0.01, F.col("_p") / F.greatest(F.col(p), F.lit(0.01))).otherwise(1.0)
    return base.join(f, list(keys)).select(*keys, (F.col("_t") - F.col(t)).alias("dt"), ratio.alias("rp"))


# ---- cohort products -------------------------------------------------------------------------------

def competing_risk(df: DataFrame, keys: Sequence[str], h: str = "h") -> DataFrame:
    """Total hazard over the causes of each key."""
    return df.groupBy(*keys).agg((F.lit(1.0) - F.product(F.lit(1.0) - F.col(h))).alias("h_total"))


def viability(df: DataFrame, keys: Sequence[str], h: str = "h", p_height: Column | None = None) -> DataFrame:
    """Survival over all steps times the probability of the height."""
    v = F.product(F.lit(1.0) - F.col(h))
    return df.groupBy(*keys).agg((v if p_height is None else v * p_height).alias("viability"))


def cumulative_hazard(df: DataFrame, keys: Sequence[str], eta: str = "eta") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.exp(eta)).alias("cum_hazard"))


def reach_height(df: DataFrame, keys: Sequence[str], member: str, h_min: float, phi: str = "phi") -> DataFrame:
    """Share of members whose accumulated growth age reaches the height; h_star, k and shape are per member."""
    m = df.groupBy(*keys, member).agg(F.sum(clip(phi, 0.0, 1.0)).alias("_a"), F.first("h_star").alias("h_star"),
                                      F.first("k").alias("k"), F.first("shape").alias("shape"))
    ok = F.col("_a") >= age_at_height(F.lit(h_min), "h_star", "k", "shape")
    return m.groupBy(*keys).agg(F.avg(ok.cast("double")).alias("p_height"), F.count(F.lit(1)).alias("n_members"))


def exposure_composite(df: DataFrame, columns: Sequence[str], out: str = "exposure") -> DataFrame:
    """Mean of the columns standardised by their mean and population SD over the table."""
    stats = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).alias("s")).scalar()
    d = df.withColumn("_s", stats)
    z = [(F.col(c) - F.col(f"_s.m_{c}")) / F.nullif(F.col(f"_s.s_{c}"), F.lit(0.0)) for c in columns]
    total = z[0]
    for e in z[1:]:
        total = total + e
    return d.withColumn(out, total / len(columns)).drop("_s")


# ---- observation composites ---------------------------------------------------------------------------

def yearly_composite(scenes: DataFrame, keys: Sequence[str], date: str, value: str, months: Sequence[int] = (7, 8)) -> DataFrame:
    """Median and number of valid observations of the growing season per key and year.

    A key is one pixel, whose scenes of two months are few, so the exact median is held per pixel-year.
    """
    d = scenes.filter(F.month(date).isin(list(months)))
    return d.groupBy(*keys, F.year(date).alias("year")).agg(F.percentile(F.col(value), F.lit(0.5)).alias("median"), F.count(value).alias("valid_count"))


def no_disturbance(frame: DataFrame, loss: DataFrame, burned: DataFrame) -> DataFrame:
    """(pixel, year, nd): neither a loss in that year nor a burn; a missing record counts as none."""
    lost = loss.select("pixel", F.col("loss_year").alias("year"), F.lit(True).alias("_l")).distinct()
    b = burned.groupBy("pixel", "year").agg(F.bool_or("burned").alias("_b"))
    j = frame.join(lost, ["pixel", "year"], "left").join(b, ["pixel", "year"], "left")
    return j.select("pixel", "year", (~(F.coalesce("_l", F.lit(False)) | F.coalesce("_b", F.lit(False)))).alias("nd"))


def wind_mean(df: DataFrame, keys: Sequence[str], u: str = "u", v: str = "v") -> DataFrame:
    """Mean of the daily speeds, not the speed of the mean components."""
    return df.groupBy(*keys).agg(F.avg(F.hypot(u, v)).alias("wind"))


def snow_cover(df: DataFrame, keys: Sequence[str], ndsi: str = "ndsi", threshold: float = 40.0) -> DataFrame:
    on = F.col(ndsi) >= threshold
    return df.groupBy(*keys).agg(F.count_if(on).alias("snow_days"), F.avg(F.when(F.col(ndsi).isNotNull(), on.cast("double"))).alias("snow_share"))


def benchmark_climatology(df: DataFrame, scales: dict[str, float], keys: Sequence[str] = ("var", "month")) -> DataFrame:
    s = F.lit(1.0)
    for name, k in scales.items():
        s = F.when(F.col("var") == name, F.lit(float(k))).otherwise(s)
    return df.groupBy(*keys).agg(F.avg("value").alias("_m")).select(*keys, (F.col("_m") * s).alias("mean"))


def season_mean(df: DataFrame, keys: Sequence[str], date: str, value: str, months: Sequence[int] = (7, 8), first_year: int = 2001) -> DataFrame:
    d = df.filter(F.month(date).isin(list(months)) & (F.year(date) >= first_year))
    return d.groupBy(*keys).agg(F.avg(value).alias(value))


def footprint_height(df: DataFrame, keys: Sequence[str], height: str = "height") -> DataFrame:
    """Median and count of the footprints that pass the quality rules (quality 1, degrade 0, sensitivity above 0.9)."""
    d = df.filter((F.col("quality") == 1) & (F.col("degrade") == 0) & (F.col("sensitivity") > 0.9))
    return d.groupBy(*keys).agg(F.percentile(F.col(height), F.lit(0.5)).alias("height"), F.count(height).alias("n"))


def mean_min_valid(df: DataFrame, keys: Sequence[str], value: str, minimum: int = 5) -> DataFrame:
    return df.groupBy(*keys).agg(F.when(F.count(value) >= minimum, F.avg(value)).alias(value), F.count(value).alias("n_valid"))
