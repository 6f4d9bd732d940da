"""Pixel-year panels: year effect, onsets, person-years, event rate and the gate before a hazard fit."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.special import event_rate_interval, zero_event_bound
from terrapanel.operators.joins import pixel_climate
from terrapanel.operators.order_stats import bin_index, exact_quantiles, quantile_array
from terrapanel.operators.windows import dense_series, dieback, recently_disturbed, trailing_z


def remove_year_effect(df: DataFrame, pixel: str, year: str, value: str, out: str) -> DataFrame:
    """Adds the value minus the median over pixels, per year, of the deviation from the pixel's own mean.

    The median runs over all pixels of a year, so it uses the bucketed exact quantile.
    """
    bars = df.groupBy(pixel).agg(F.avg(value).alias("_bar"))
    d = df.join(bars, pixel).withColumn("_dev", F.col(value) - F.col("_bar"))
    effect = exact_quantiles(d, "_dev", [0.5], [year]).select(F.col(year).alias("_y"), F.col("q").alias("_eff"))
    j = df.join(effect, F.col(year) == F.col("_y"), "left")
    return j.withColumn(out, F.col(value) - F.coalesce("_eff", F.lit(0.0))).drop("_y", "_eff")


def onsets(series: DataFrame, pixel: str, year: str, value: str, nd: str | None, suffix: str = "") -> DataFrame:
    """Adds z, event and candidate (the rule without the disturbance flag) to a dense series."""
    d = trailing_z(series, pixel, year, value, out=f"z{suffix}")
    d = dieback(d, pixel, year, f"z{suffix}", nd, f"event{suffix}")
    return dieback(d, pixel, year, f"z{suffix}", None, f"candidate{suffix}")


def person_years(pixel_year: DataFrame, pixels: DataFrame, climate: DataFrame, first: Column, last: Column, pixel: str = "pixel",
                 year: str = "year", value: str = "x", nd: str = "nd") -> DataFrame:
    """One row per pixel and panel year with a value and climate: first onset, risk flags, z and the year-adjusted twins.

    All windows are over one pixel's own series; the first onsets come from one aggregate per pixel.
    """
    adj = remove_year_effect(pixel_year, pixel, year, value, "_adj")
    s = dense_series(adj, pixel, year)
    s = onsets(onsets(s, pixel, year, value, nd), pixel, year, "_adj", nd, "_adj")
    s = recently_disturbed(s, pixel, year, nd)
    inside = F.col(year).between(first, last)
    flags = ["event", "candidate", "event_adj", "candidate_adj"]
    firsts = s.filter(inside).groupBy(pixel).agg(*[F.min(F.when(F.col(c), F.col(year))).alias(f"_f_{c}") for c in flags])
    d = s.filter(inside & F.col(value).isNotNull()).join(firsts, pixel)
    for c in flags:
        d = d.withColumn(c, F.coalesce(F.col(year) == F.col(f"_f_{c}"), F.lit(False)))
        risk = {"event": "at_risk", "candidate": "candidate_at_risk", "event_adj": "at_risk_adj"}.get(c)
        if risk:
            d = d.withColumn(risk, F.col(f"_f_{c}").isNull() | (F.col(year) <= F.col(f"_f_{c}")))
    d = d.drop("_adj", *[f"_f_{c}" for c in flags]).join(pixels, pixel)
    return pixel_climate(d, climate, ("node", year))


def onset_counts(pixel_year: DataFrame, first: Column, last: Column, pixel: str = "pixel", year: str = "year", value: str = "x") -> DataFrame:
    """Pixels with an onset of decline, and of rise (the mirrored series), the flag ignored; complete series only."""
    steps = pixel_year.agg(F.max(year) - F.min(year) + 1).scalar()
    full = pixel_year.filter(F.col(value).isNotNull()).groupBy(pixel).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == steps)
    s = pixel_year.join(full.select(pixel), pixel, "left_semi")
    s = s.withColumn("_up", -F.col(value))
    d = dieback(trailing_z(s, pixel, year, value, out="_z"), pixel, year, "_z", None, "_down")
    d = dieback(trailing_z(d, pixel, year, "_up", out="_zu"), pixel, year, "_zu", None, "_rise")
    inside = F.col(year).between(first, last)
    per = d.groupBy(pixel).agg(F.max(inside & F.col("_down")).alias("_d"), F.max(inside & F.col("_rise")).alias("_r"))
    return per.agg(F.count_if("_d").alias("decline"), F.count_if("_r").alias("rise"), F.count(F.lit(1)).alias("n_full"))


def _rate_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Limits for a few rows of counts."""
    rows = [(*event_rate_interval(int(a), int(b)), zero_event_bound(int(b))) for a, b in zip(k, n)]
    return pd.DataFrame(rows, columns=["lo", "hi", "zero_bound"])


def event_rate(panel: DataFrame, event: str = "event", at_risk: str = "at_risk", by: Sequence[str] = ()) -> DataFrame:
    """Events, person-years, rate, exact interval and the bound for no events. The beta quantiles are taken on the counts."""
    d = panel.filter(F.col(at_risk)).groupBy(*by).agg(F.count_if(F.col(event)).alias("n_events"), F.count(F.lit(1)).alias("n_py"))
    limits = F.pandas_udf(_rate_interval, "struct<lo double, hi double, zero_bound double>")
    i = d.withColumn("_i", limits("n_events", "n_py"))
    return i.select(*by, "n_events", "n_py", (F.col("n_events") / F.col("n_py")).alias("rate"), F.col("_i.lo").alias("lo"), F.col("_i.hi").alias("hi"),
                    F.when(F.col("n_events") == 0, F.col("_i.zero_bound")).alias("zero_bound"))


def panel_gate(counts: DataFrame, n_columns: int, per_column: int = 10, min_ratio: float = 1.5) -> DataFrame:
    """Verdict from n_events, decline and rise: too few events, not distinguishable from noise, or fit."""
    ratio = F.col("decline") / F.nullif(F.col("rise"), F.lit(0))
    status = F.when(F.col("n_events") < n_columns * per_column, "too_few_events_for_a_hazard_fit").when(
        F.coalesce(ratio < min_ratio, F.lit(False)), "events_not_distinguishable_from_noise").otherwise("fit")
    return counts.select("*", ratio.alias("decline_to_rise"), status.alias("status"))


def response_bins(df: DataFrame, node: str, year: str, z: str, anomaly: str, n_bins: int = 5) -> DataFrame:
    """Node-year means of z by quantile bin of the anomaly, with the standard error."""
    ny = df.groupBy(node, year).agg(F.avg(z).alias("_z"), F.first(anomaly).alias("_a"))
    edges = quantile_array(ny, "_a", [i / n_bins for i in range(n_bins + 1)]).agg(F.max(F.array_distinct("q"))).scalar()
    d = ny.withColumn("_e", edges).withColumn("bin", bin_index("_a", "_e"))
    n = F.count(F.lit(1))
    return d.groupBy("bin").agg(F.avg("_a").alias("anomaly_mean"), F.avg("_z").alias("z_mean"),
                                F.when(n > 1, F.stddev_samp("_z") / F.sqrt(n)).alias("z_se"), n.alias("n"))
