"""Ordered daily scans: snow, soil bucket, closed spells and failure index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions.numeric import floor0
from terrapanel.functions.weather import potential_melt, snowfall
from terrapanel.tables import require


def snowpack(df: DataFrame, keys: Sequence[str], day: str = "doy", p: str = "p", t: str = "t_mean",
             ddf: float = 4.0, t_melt: float = 0.0, t_snow: float = 1.0, swe0: float = 0.0) -> DataFrame:
    """Degree-day snow: adds rain, snow, swe, melt, liquid.

    swe_d = max(0, swe_{d-1} + snow_d - potential melt_d) is a reflected sum, so with X the running sum of
    (snow - potential melt) the pack is X - min(0, running minimum of X): two window functions, no loop.
    """
    w = W.partitionBy(*keys).orderBy(day)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("snow", snowfall(p, t, t_snow)).withColumn("rain", F.col(p) - F.col("snow"))
    d = d.withColumn("_x", F.sum(F.col("snow") - potential_melt(t, ddf, t_melt)).over(run) + swe0)
    d = d.withColumn("swe", F.col("_x") - F.least(F.lit(0.0), F.min("_x").over(run)))
    before = F.coalesce(F.lag("swe").over(w), F.lit(float(swe0)))
    d = d.withColumn("melt", floor0(before + F.col("snow") - F.col("swe")))
    return d.withColumn("liquid", F.col("rain") + F.col("melt")).drop("_x")


def _fold_days(df: DataFrame, keys: Sequence[str], day: str, fields: Sequence[str], extra: dict):
    """One row per key with the ordered days as an array; a key is a node-year, so at most 366 elements."""
    days = F.array_sort(F.collect_list(F.struct(F.col(day).alias("_d"), *[F.col(c) for c in fields])))
    return _one_year(df.groupBy(*keys).agg(days.alias("_days"), *[e.alias(n) for n, e in extra.items()]))


def _one_year(g: DataFrame) -> DataFrame:
    """Raises where ``_days`` is longer than a year: the keys lack the year, or days repeat."""
    return require(g, F.size("_days") > 366, "a series has more than 366 days; is the year among its keys?")


def _bucket_step(w, pet, inflow, w_max, crit: float):
    """One day of the bucket: returns (end storage, relative water, actual evaporation, drainage)."""
    star = w + inflow
    drain = F.greatest(star - w_max, F.lit(0.0))
    star = F.least(star, w_max)
    rew = F.when(w_max > 0, star / F.nullif(w_max, F.lit(0.0))).otherwise(0.0)
    aet = F.least(star, pet * F.least(F.lit(1.0), rew / crit))
    return star - aet, rew, aet, drain


def soil_bucket_annual(df: DataFrame, keys: Sequence[str], day: str = "doy", pet: str = "pet", inflow: str = "liquid",
                       w_max: str = "w_max", crit: float = 0.4, w0_frac: float = 1.0,
                       carry: Sequence[str] = ()) -> DataFrame:
    """Annual sums of the daily bucket: cwd, wsi, aet, drainage, w_end, w_min and the closure error.

    The state is nonlinear in the storage, so the days are folded in order inside the row, on the JVM. Only one
    node-year (at most 366 days) is ever held as an array.
    """
    g = _fold_days(df, keys, day, [pet, inflow], {"_wmax": F.first(w_max), **{c: F.first(c) for c in carry}})
    wm = F.col("_wmax")
    zero = F.lit(0.0)
    start = F.struct((wm * w0_frac).alias("w"), (wm * w0_frac).alias("lo"), zero.alias("cwd"), zero.alias("wsi"),
                     zero.alias("aet"), zero.alias("dr"), zero.alias("inp"))

    def step(acc, d):
        w, rew, aet, dr = _bucket_step(acc["w"], d[pet], d[inflow], wm, crit)
        return F.struct(w.alias("w"), F.least(acc["lo"], w).alias("lo"), (acc["cwd"] + d[pet] - aet).alias("cwd"),
                        (acc["wsi"] + F.greatest(zero, (F.lit(crit) - rew) / crit)).alias("wsi"),
                        (acc["aet"] + aet).alias("aet"), (acc["dr"] + dr).alias("dr"), (acc["inp"] + d[inflow]).alias("inp"))

    g = g.withColumn("_a", F.aggregate("_days", start, step))
    a = F.col("_a")
    return g.select(*keys, *carry, a["cwd"].alias("cwd"), a["wsi"].alias("wsi"), a["aet"].alias("aet"),
                    a["dr"].alias("drainage"), a["w"].alias("w_end"), a["lo"].alias("w_min"),
                    (wm * w0_frac + a["inp"] - a["aet"] - a["dr"] - a["w"]).alias("balance_error"))


def soil_bucket_daily(df: DataFrame, keys: Sequence[str], day: str = "doy", pet: str = "pet", inflow: str = "liquid",
                      w_max: str = "w_max", crit: float = 0.4, w0_frac: float = 1.0,
                      carry: Sequence[str] = ()) -> DataFrame:
    """The daily series of the bucket: storage w, rew, aet, drainage, plus the ``carry`` columns of each day."""
    g = _fold_days(df, keys, day, [pet, inflow, *carry], {"_wmax": F.first(w_max)})
    wm = F.col("_wmax")
    one = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("rew"), F.lit(0.0).alias("aet"), F.lit(0.0).alias("drainage"))
    start = F.struct((wm * w0_frac).alias("w"), F.slice(F.array(one), 1, 0).alias("out"))

    def step(acc, d):
        w, rew, aet, dr = _bucket_step(acc["w"], d[pet], d[inflow], wm, crit)
        row = F.struct(w.alias("w"), rew.alias("rew"), aet.alias("aet"), dr.alias("drainage"))
        return F.struct(w.alias("w"), F.concat(acc["out"], F.array(row)).alias("out"))

    g = g.withColumn("_out", F.aggregate("_days", start, step)["out"])
    g = g.select(*keys, F.col("_wmax").alias(w_max), F.explode(F.arrays_zip("_days", "_out")).alias("_z"))
    return g.select(*keys, w_max, F.col("_z._days._d").alias(day),
                    *[F.col(f"_z._days.{c}").alias(c) for c in (pet, inflow, *carry)],
                    *[F.col(f"_z._out.{c}").alias(c) for c in ("w", "rew", "aet", "drainage")])


def islands(df: DataFrame, keys: Sequence[str], flag: str, day: str = "doy", out: str = "island") -> DataFrame:
    """Adds a number that is constant within each run of equal ``flag`` values."""
    w = W.partitionBy(*keys).orderBy(day)
    change = F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)
    return df.withColumn(out, F.sum(change).over(w.rowsBetween(W.unboundedPreceding, 0)))


def failure_index(df: DataFrame, keys: Sequence[str], loss: str = "loss", psi: str = "psi_soil",
                  psi_close: str = "psi_close", buffer: str = "buffer", day: str = "doy", refill: float = 1.0) -> DataFrame:
    """Adds closed, acc and hfi per day.

    An open day multiplies the deficit by (1 - refill). With full refill the deficit is the running loss inside a
    closed run, a window sum; otherwise the days of a node-year are folded in order.
    """
    d = df.withColumn("closed", F.col(psi) <= F.col(psi_close))
    if refill >= 1.0:
        d = islands(d, keys, "closed", day, "_run")
        w = W.partitionBy(*keys, "_run").orderBy(day).rowsBetween(W.unboundedPreceding, 0)
        d = d.withColumn("acc", F.when(F.col("closed"), F.sum(loss).over(w)).otherwise(0.0)).drop("_run")
    else:
        g = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
            F.col(day).alias("_d"), F.col("closed"), F.col(loss).alias("_l")))).alias("_days"))
        g = _one_year(g)
        empty = F.slice(F.array(F.lit(0.0)), 1, 0)
        start = F.struct(F.lit(0.0).alias("a"), empty.alias("out"))

        def step(acc, x):
            a = F.when(x["closed"], acc["a"] + x["_l"]).otherwise(acc["a"] * (1.0 - refill))
            return F.struct(a.alias("a"), F.concat(acc["out"], F.array(a)).alias("out"))

        g = g.select(*keys, F.explode(F.arrays_zip("_days", F.aggregate("_days", start, step)["out"].alias("_acc"))).alias("_z"))
        g = g.select(*keys, F.col("_z._days._d").alias(day), F.col("_z._acc").alias("acc"))
        d = d.join(g, [*keys, day])
    hfi = F.when(F.col(buffer) > 0, F.col("acc") / F.nullif(F.col(buffer), F.lit(0.0))).otherwise(
        F.when(F.col("closed"), F.lit(float("inf"))).otherwise(0.0))
    return d.withColumn("hfi", hfi)


def failure_summary(daily: DataFrame, keys: Sequence[str], day: str = "doy") -> DataFrame:
    """Largest index, first closed day and first failed day (null when none) per series."""
    return daily.groupBy(*keys).agg(
        F.max("hfi").alias("hfi_max"), F.min(F.when(F.col("closed"), F.col(day))).alias("first_closed"),
        F.min(F.when(F.col("hfi") >= 1.0, F.col(day))).alias("first_failure"))


def spell_summary(df: DataFrame, keys: Sequence[str], closed: str = "closed", vpd: str = "vpd24", t: str = "t_max",
                  day: str = "doy") -> DataFrame:
    """Longest closed run (the first among equals) with its mean VPD and temperature, and the closed days in all."""
    d = islands(df, keys, closed, day, "_run")
    runs = d.groupBy(*keys, "_run").agg(
        F.max(closed).alias("_c"), F.count(F.lit(1)).alias("_n"), F.min(day).alias("_s"),
        F.avg(vpd).alias("_v"), F.avg(t).alias("_t"))
    best = F.max_by(F.struct("_n", "_v", "_t"), F.when(F.col("_c"), F.struct(F.col("_n"), -F.col("_s"))))
    out = runs.groupBy(*keys).agg(best.alias("_b"), F.sum(F.when(F.col("_c"), F.col("_n")).otherwise(0)).alias("n_closed"))
    return out.select(*keys, F.coalesce("_b._n", F.lit(0)).alias("longest_spell"),
                      F.coalesce("_b._v", F.lit(0.0)).alias("spell_vpd"),
                      F.coalesce("_b._t", F.lit(0.0)).alias("spell_t"), "n_closed")


def threshold_curve(df: DataFrame, keys: Sequence[str], psi: str = "psi_soil", loss: str = "loss", day: str = "doy") -> DataFrame:
    """Step curve (t, m) per node-year: m is the largest loss accumulated in one run of days with psi <= t.

    With full refill a draw of traits changes only the closing threshold and the buffer, so this curve replaces one
    simulation per draw. At most 366 days and as many steps are held per row.
    """
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(day).alias("d"), F.col(psi).alias("p"), F.col(loss).alias("l")))).alias("_days"))
    g = _one_year(g)
    steps = F.array_sort(F.array_distinct(F.transform("_days", lambda x: x["p"])))

    def longest(t):
        start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("m"))

        def step(acc, x):
            a = F.when(x["p"] <= t, acc["a"] + x["l"]).otherwise(0.0)
            return F.struct(a.alias("a"), F.greatest(acc["m"], a).alias("m"))

        return F.aggregate("_days", start, step)["m"]

    return g.select(*keys, F.transform(steps, lambda t: F.struct(t.alias("t"), longest(t).alias("m"))).alias("curve"))
