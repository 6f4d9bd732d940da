"""Column-derivation jobs over the node, trait, point and cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions import ecology as E
from terrapanel.functions import hydraulics as H
from terrapanel.functions import water as S
from terrapanel.functions import weather as X


def derive_weather(node_day: DataFrame, node: DataFrame, month_params: DataFrame, exposure=1.0, k_cap: float = 1.0,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Reference weather of every node, year and day moved to the node: t_mean, t_max, t_min, p, ea, vpd_day, vpd_max, vpd24, pressure.

    ``node_day`` holds t_mean, t_max, t_min, p and ea at the reference elevation. The twelve monthly parameter rows
    are broadcast (their number is fixed); the node table joins by key.
    """
    d = node_day.join(F.broadcast(month_params), "month").join(node, "node")
    cap = X.cold_air("concavity", "calm", k_cap)
    d = d.select(
        "node", "year", "doy", "month", *keep, *[c for c in node.columns if c != "node"],
        X.t_at_elevation("t_mean", "z", "z_ref", "gamma").alias("t_mean"),
        X.t_at_elevation("t_max", "z", "z_ref", "gamma").alias("t_max"),
        X.t_at_elevation("t_min", "z", "z_ref", "gamma", cap).alias("t_min"),
        X.p_at_elevation("p", "z", "z_ref", "grad", exposure).alias("p"),
        X.vp_at_elevation("ea", "z_ref", "z").alias("ea"),
        X.pressure("z").alias("pressure"))
    return d.select("*", X.vpd_daytime("t_mean", "t_max", "ea").alias("vpd_day"), X.vpd_peak("t_max", "ea").alias("vpd_max"),
                    X.vpd_whole_day("t_max", "t_min", "ea").alias("vpd24"))


def derive_radiation(node_day: DataFrame, node: DataFrame) -> DataFrame:
    """Extraterrestrial terms and the sky view of each node and day."""
    d = node_day.select("node", "year", "doy").join(node.select("node", "lat", "slope", "aspect"), "node")
    return d.select("node", "year", "doy", X.declination("doy").alias("declination"), X.inverse_distance("doy").alias("dr"),
                    X.sunset_angle("lat", "doy").alias("sunset"), X.extraterrestrial("lat", "doy").alias("ra"),
                    X.sky_view_slope("slope").alias("sky_view"))


def slope_ratio(node_day: DataFrame, node: DataFrame, steps: int = 288, tau: float = 0.75) -> DataFrame:
    """Daily beam energy on the slope over that on flat ground; null when the sun does not rise.

    The ratio depends on place and day of the year alone, so it is made once per distinct (lat, slope, aspect, doy) and joined
    to the days of all years. One row per hour angle, summed again before any shuffle (each day's steps are made and
    combined in one task). The steps keep to generated code, which a fold over an array inside the row would not.
    """
    place = ["lat", "slope", "aspect", "doy"]
    days = node_day.select("node", "year", "doy").join(node.select("node", "lat", "slope", "aspect"), "node")
    d = days.select(*place).distinct()
    d = d.select("*", *[F.radians(c).alias(a) for c, a in (("lat", "_lat"), ("slope", "_b"), ("aspect", "_asp"))])
    d = d.select(*place, "_b", "_asp", X.sunset_angle("lat", "doy").alias("_ws"), F.sin("_lat").alias("_sl"), F.cos("_lat").alias("_cl"),
                 F.sin(X.declination("doy")).alias("_sd"), F.cos(X.declination("doy")).alias("_cd"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_i"))
    # each stage is a column of its own, so no expression is repeated inside the next one
    d = d.withColumn("_h", F.col("_ws") * (F.col("_i").cast("double") * (2.0 / (steps - 1)) - 1.0))
    d = d.withColumn("_raw", F.col("_sl") * F.col("_sd") + F.col("_cl") * F.col("_cd") * F.cos("_h"))
    d = d.withColumn("_cz", F.least(F.greatest("_raw", F.lit(-1.0)), F.lit(1.0)))
    d = d.withColumn("_sz", F.sqrt(F.greatest(F.lit(1.0) - F.col("_cz") * F.col("_cz"), F.lit(1e-12))))
    d = d.withColumn("_ca", (F.col("_sd") - F.col("_cz") * F.col("_sl")) / (F.col("_sz") * F.col("_cl")))
    d = d.withColumn("_az", F.acos(F.least(F.greatest("_ca", F.lit(-1.0)), F.lit(1.0))))
    d = d.withColumn("_turn", F.cos(F.when(F.col("_h") > 0, -F.col("_az")).otherwise(F.col("_az")) - F.col("_asp")))
    d = d.withColumn("_inc", F.cos("_b") * F.col("_cz") + F.sin("_b") * F.col("_sz") * F.col("_turn"))
    d = d.withColumn("_beam", F.when(F.col("_cz") > 0.02, F.pow(F.lit(tau), F.lit(1.0) / F.greatest("_cz", F.lit(0.02)))).otherwise(0.0))
    s = d.groupBy(*place).agg(F.sum(F.col("_beam") * F.greatest("_inc", F.lit(0.0))).alias("_s"),
                                     F.sum(F.col("_beam") * F.col("_cz")).alias("_f"), F.max("_ws").alias("_ws"))
    ratio = F.col("_s") / F.nullif(F.col("_f"), F.lit(0.0))
    s = s.select(*place, F.when(F.col("_ws") > 1e-6, ratio).alias("slope_ratio"))
    return days.join(s, place).select("node", "year", "doy", "slope_ratio")


def derive_pet(weather: DataFrame, g=0.0, g_a: Column | None = None, g_c: Column | None = None,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Long table of potential evaporation: one row per (node, year, day, pet_name).

    The canopy form appears only when both conductances are given. One pass over the weather rows: the names are an
    array column that is exploded, not one scan per formulation.
    """
    forms = {
        "pm_fao56": X.pet_reference("rn", g, "t_mean", "u2", "ea", "pressure"),
        "priestley_taylor": X.pet_priestley_taylor("rn", g, "t_mean", "pressure"),
        "energy_only": X.pet_energy("rn", g),
    }
    if g_a is not None and g_c is not None:
        forms["canopy_pm"] = X.pet_canopy("rn", g, "t_mean", "vpd_day", g_a, g_c, "pressure")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("pet_name"), e.alias("pet")) for n, e in forms.items()]))
    d = weather.select("node", "year", "doy", *keep, rows.alias("_p"))
    return d.select("node", "year", "doy", *keep, F.col("_p.pet_name").alias("pet_name"), F.col("_p.pet").alias("pet"))


def derive_soil(node: DataFrame) -> DataFrame:
    """Soil hydraulic parameters per node from sand, clay (percent) and soc (g/kg)."""
    par = S.pedotransfer("sand", "clay", "soc")
    return node.select("node", *[e.alias(n) for n, e in par.items()])


def group_capacity(soil: DataFrame, group_depth: DataFrame) -> DataFrame:
    """Bucket capacity of every node and group: the groups are one array, a scalar of the plan, and each node explodes it."""
    depths = group_depth.agg(F.collect_list(F.struct("grp", F.col("depth_mm").cast("double").alias("depth")))).scalar()
    s = soil.select("*", F.explode(depths).alias("_g"))
    return s.select(*soil.columns, F.col("_g.grp").alias("grp"),
                    S.bucket_capacity("theta_fc", "theta_lim", F.col("_g.depth")).alias("w_max"))


def derive_traits(traits: DataFrame) -> DataFrame:
    """psi_crit, buffer and the slope parameter of each trait row."""
    return traits.select("*", H.critical_potential("p50", "slope", "lethal").alias("psi_crit"),
                         H.water_buffer("capacitance", "psi_close", "p50", "slope", "lethal").alias("buffer"))


def derive_growth(node_year: DataFrame, params: dict) -> DataFrame:
    """The four growth modifiers and their product phi per node-year (cwd, gdd, frost_days, gst, lgs)."""
    d = node_year.select(
        "*", E.saturating_loss("cwd", params["cwd50"]).alias("f_water"), E.saturating_gain("gdd", params["gdd_ref"]).alias("f_heat"),
        E.saturating_loss("frost_days", params["frost50"]).alias("f_frost"),
        E.treeline_modifier("gst", "lgs", params["s_t"], params["s_l"]).alias("f_treeline"))
    return d.withColumn("phi", F.col("f_water") * F.col("f_heat") * F.col("f_frost") * F.col("f_treeline"))


def derive_niche(points: DataFrame, models: DataFrame, features: list[str], key: str) -> DataFrame:
    """Score of every point under every model of its group; ``models`` (species, intercept, coef ARRAY) is a
    dimension table of one row per species. A missing predictor gives a null score."""
    x = F.array(*[F.col(f) for f in features])
    z = F.aggregate(F.zip_with(x, F.col("coef"), lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v)
    return points.join(models, "species").select(key, "species", E.logistic(z).alias("score"))


def derive_hazard_links(pred: DataFrame, a: str, b: str, di: str, threshold: Column, kappa: float = 2.0) -> DataFrame:
    """Link, gate weight and blended hazard of statistical ``a`` and mechanistic ``b`` predictions."""
    w = E.gate_weight(di, threshold, kappa)
    return pred.select("*", E.cloglog(a).alias("link_stat"), w.alias("gate"), E.blend(a, b, w).alias("blended"))


def brackets(df: DataFrame, x_proj: str, xbar_hist: str, xbar_proj: str) -> DataFrame:
    """Within and between regressors of the no-adaptation and the full-acclimation readings."""
    return df.select("*", (F.col(x_proj) - F.col(xbar_hist)).alias("no_adapt_within"), F.col(xbar_hist).alias("no_adapt_between"),
                     (F.col(x_proj) - F.col(xbar_proj)).alias("accl_within"), F.col(xbar_proj).alias("accl_between"))


def leaf_area(df: DataFrame, lai: DataFrame, group: str = "grp") -> DataFrame:
    """Leaf area index of the group; raises unless every row of the lookup is labelled as a placeholder."""
    bad = F.coalesce(F.col("status") != "ILLUSTRATIVE_PLACEHOLDER", F.lit(True))
    checked = lai.withColumn("lai", F.when(bad, F.raise_error(F.lit("leaf area lookup is not labelled")).cast("double")).otherwise(F.col("lai")))
    return df.join(checked.select(group, "lai"), group, "left")


def decode_scaled(df: DataFrame, raw: str, scale: float, offset: float, nodata: float, out: str = "value") -> DataFrame:
    """nodata becomes null before scale and offset are applied."""
    return df.withColumn(out, F.when(F.col(raw) == nodata, F.lit(None).cast("double")).otherwise(F.col(raw) * scale + offset))


def map_coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.select("*", E.mercator_x(lon).alias("mx"), E.mercator_y(lat).alias("my"))


def lai_by_group(values: dict[str, float]) -> list[tuple[str, float, str]]:
    """Rows of a labelled leaf-area lookup."""
    return [(g, float(v), "ILLUSTRATIVE_PLACEHOLDER") for g, v in values.items()]


def soil_units(df: DataFrame) -> DataFrame:
    """Per-mille texture and carbon to percent and g/kg."""
    return df.select("*", *[S.texture_to_percent(c).alias(f"{c}_pct") for c in ("sand", "clay", "soc")])

