"""The composed node job: weather, evaporation ensemble, snow, soil bucket, water potential and annual indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions import water as S
from terrapanel.operators import scans
from terrapanel.operators import windows as Wn
from terrapanel.plans.derive import derive_pet, derive_weather


def annual_water(node_day: DataFrame, keys: list[str], soil: DataFrame | None = None, pet_keys: tuple[str, ...] = ("pet_name",)) -> DataFrame:
    """Snow and bucket of a daily table with p, t_mean, pet and w_max, reduced to annual indices per key and formulation.

    With ``soil`` (theta_fc, theta_lim, theta_sat, psi_sat, b) the smallest soil potential of the year is added; it
    falls on the day of smallest storage because the retention curve rises with storage.
    """
    d = scans.snowpack(node_day, keys)
    out = scans.soil_bucket_annual(d, [*keys, *pet_keys] if "pet_name" in node_day.columns else keys, carry=("w_max",))
    if soil is not None:
        out = out.join(soil, "node")
        theta = S.theta_of_storage("w_min", "w_max", "theta_fc", "theta_lim")
        out = out.withColumn("psi_min", S.soil_potential(theta, "theta_sat", "psi_sat", "b")).drop(*[c for c in soil.columns if c != "node"])
    return out


def node_weather(node_day: DataFrame, node: DataFrame, months: DataFrame, factors: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The group-free weather stage. ``factors`` (node, doy, f_rn, f_wind, f_ea) scales radiation, wind and humidity
    of every year (day 366 takes the factor of day 365); None is the constant option. A node or day without a factor raises."""
    d = node_day
    if factors is not None:
        missing = F.raise_error(F.lit("a node or day has no seasonal factor")).cast("double")
        d = d.withColumn("_day", F.least("doy", F.lit(365))).join(factors.withColumnRenamed("doy", "_day"), ["node", "_day"], "left").drop("_day")
        for c, f in (("rn", "f_rn"), ("u2", "f_wind"), ("ea", "f_ea")):
            d = d.withColumn(c, F.col(c) * F.coalesce(F.col(f), missing))
        d = d.drop("f_rn", "f_wind", "f_ea")
    return derive_weather(d, node, months, keep=("rn", "u2", *keep))


def node_water_balance(weather: DataFrame, capacity: DataFrame, soil: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Annual water indices per (node, year, grp, pet_name).

    Snow depends on neither the group nor the formulation, so it is computed once per node and year; evaporation once per
    formulation; only the bucket runs per (node, year, grp, pet_name).
    """
    snow = scans.snowpack(weather, ["node", "year", *keep])
    pet = derive_pet(snow, keep=("liquid", *keep))
    d = pet.join(capacity.select("node", "grp", "w_max"), "node")
    out = scans.soil_bucket_annual(d, ["node", "year", *keep, "grp", "pet_name"], carry=("w_max",))
    out = out.join(soil, "node")
    theta = S.theta_of_storage("w_min", "w_max", "theta_fc", "theta_lim")
    return out.select("node", "year", *keep, "grp", "pet_name", "cwd", "wsi", "aet", "drainage", "balance_error",
                      S.soil_potential(theta, "theta_sat", "psi_sat", "b").alias("psi_min"))


def node_indices(weather: DataFrame, budburst: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Season indices, late frost and annual means of the weather stage, one row per node and year."""
    keys = ["node", "year", *keep]
    base = weather.groupBy(*keys).agg(F.avg("t_mean").alias("t_mean"), F.sum("p").alias("p_sum"))
    return (base.join(Wn.season_indices(weather, keys), keys).join(Wn.late_frost(weather, keys, budburst), keys))


def soil_potential_daily(daily: DataFrame, soil: DataFrame) -> DataFrame:
    """Daily soil water potential from the storage of ``scans.soil_bucket_daily``."""
    d = daily.join(soil, "node")
    theta = S.theta_of_storage("w", "w_max", "theta_fc", "theta_lim")
    return d.withColumn("psi_soil", S.soil_potential(theta, "theta_sat", "psi_sat", "b")).drop(*[c for c in soil.columns if c != "node"])
