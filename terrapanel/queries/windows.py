"""Daily scans, window functions and the water-balance jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions import hydraulics as H
from terrapanel.functions import special
from terrapanel.functions import weather as X
from terrapanel.operators import draws as Dr
from terrapanel.operators import means as M
from terrapanel.operators import raster as R
from terrapanel.operators import scans
from terrapanel.operators import windows as Wn
from terrapanel.plans import derive as D
from terrapanel.plans import water_balance as WB
from terrapanel.queries import base as B
from terrapanel.queries import columns as C
from terrapanel.queries.base import bi, q6, query, rnd, with_sql

DAY = B.NODE_DAY
N, P_ = "node", "PARTITION BY node, year ORDER BY doy"
SERIES = ["node", "year"]

# ---- snow, bucket ---------------------------------------------------------------------------------

SNOW = ["""sx AS (SELECT *, CASE WHEN t_mean < 1.0 THEN p ELSE 0.0 END AS snow,
        sum(CASE WHEN t_mean < 1.0 THEN p ELSE 0.0 END - 4.0 * greatest(t_mean, 0.0)) OVER (PARTITION BY node, year ORDER BY doy) AS cx FROM node_day)""",
        "sm AS (SELECT *, cx - least(0.0, min(cx) OVER (PARTITION BY node, year ORDER BY doy)) AS swe FROM sx)",
        "sw AS (SELECT *, coalesce(lag(swe) OVER (PARTITION BY node, year ORDER BY doy), 0.0) + snow - swe AS melt FROM sm)",
        "snowpack AS (SELECT *, p - snow + greatest(melt, 0.0) AS liquid FROM sw)"]


@query("win_snowpack", with_sql(DAY + SNOW, f"SELECT node, year, {bi('doy')} AS doy, {q6('swe')} AS swe, {q6('greatest(melt, 0.0)')} AS melt, {q6('liquid')} AS liquid FROM snowpack"))
def win_snowpack(spark, sf):
    return rnd(scans.snowpack(B.node_day(spark, sf), SERIES).select("node", "year", "doy", "swe", "melt", "liquid"))


def bucket_sql(src: str, key: str) -> list[str]:
    """Recursive bucket over src(key..., rn, pet, liquid, w_max)."""
    step = """least({w} + s.liquid, s.w_max) AS star, greatest({w} + s.liquid - s.w_max, 0.0) AS dr, s.*"""
    keys = [k.strip() for k in key.split(",")]
    on = " AND ".join(f"b.{k} = s.{k}" for k in keys)
    aet = "least(star, pet * least(1.0, star / w_max / 0.4))"
    cols = f"{', '.join(keys)}, rn, w_max, pet, star / w_max AS rew, {aet} AS aet, dr, star - {aet} AS w"
    return [f"""bk AS (SELECT {cols} FROM (SELECT {step.format(w='s.w_max')} FROM {src} s WHERE s.rn = 1)
        UNION ALL SELECT {cols} FROM (SELECT {step.format(w='b.w')} FROM bk b JOIN {src} s ON {on} AND s.rn = b.rn + 1))"""]


BIN = ["bin0 AS (SELECT node, year, CAST(row_number() OVER (PARTITION BY node, year ORDER BY doy) AS BIGINT) AS rn, rn / 2.45 AS pet, liquid, w_max FROM snowpack JOIN nodes USING (node))"]
BIN = [BIN[0].replace("rn / 2.45 AS pet", "snowpack.rn / 2.45 AS pet")]


def bucket_in(spark, sf):
    d = scans.snowpack(B.node_day(spark, sf), SERIES).withColumn("pet", X.pet_energy("rn", 0.0))
    return d.join(B.nodes(spark, sf).select("node", "w_max"), "node")


@query("scan_soil_bucket", with_sql(DAY + B.NODES + SNOW + BIN + bucket_sql("bin0", "node, year"),
       f"SELECT node, year, rn AS doy, {q6('w')} AS w, {q6('rew')} AS rew, {q6('aet')} AS aet, {q6('dr')} AS drainage FROM bk"))
def scan_soil_bucket(spark, sf):
    return rnd(scans.soil_bucket_daily(bucket_in(spark, sf), SERIES).select("node", "year", F.col("doy").cast("bigint").alias("doy"), "w", "rew", "aet", "drainage"))


@query("annual_water_deficit", with_sql(DAY + B.NODES + SNOW + BIN + bucket_sql("bin0", "node, year"),
       f"SELECT node, year, {q6('sum(pet - aet)', 5)} AS cwd, {q6('sum(greatest(0.0, (0.4 - rew) / 0.4))', 5)} AS wsi, {q6('sum(aet)', 5)} AS aet, {q6('sum(dr)', 5)} AS drainage FROM bk GROUP BY node, year"))
def annual_water_deficit(spark, sf):
    """Flagship: events -> daily series -> snow -> bucket -> annual deficit per node and year."""
    return rnd(WB.annual_water(bucket_in(spark, sf), SERIES).select("node", "year", "cwd", "wsi", "aet", "drainage"), 5)


# full job: downscaled weather, three evaporation forms, three groups
WX = [f"""wx AS (SELECT node, year, doy, rn AS rnet, u2, t_mean + gamma * (z - z_ref) AS t_mean, t_max + gamma * (z - z_ref) AS t_max,
        t_min + gamma * (z - z_ref) - greatest(concavity, 0.0) * calm AS t_min, greatest(p * exp(grad * (z - z_ref)), 0.0) AS p,
        {C.es(f"{C.TD} - 0.002 * (z - z_ref)")} AS ea, {C.PRES} AS pres
        FROM node_day JOIN nodes USING (node) JOIN months USING (month))"""]
WSNOW = ["""wsx AS (SELECT *, CASE WHEN t_mean < 1.0 THEN p ELSE 0.0 END AS snow,
        sum(CASE WHEN t_mean < 1.0 THEN p ELSE 0.0 END - 4.0 * greatest(t_mean, 0.0)) OVER (PARTITION BY node, year ORDER BY doy) AS cx FROM wx)""",
         "wsm AS (SELECT *, cx - least(0.0, min(cx) OVER (PARTITION BY node, year ORDER BY doy)) AS swe FROM wsx)",
         "wsn AS (SELECT *, p - snow + greatest(coalesce(lag(swe) OVER (PARTITION BY node, year ORDER BY doy), 0.0) + snow - swe, 0.0) AS liquid FROM wsm)"]
SL = C.slope_es("t_mean")
WPET = [f"""wpet AS (SELECT node, year, doy, liquid, unnest(['pm_fao56', 'priestley_taylor', 'energy_only']) AS pet_name, unnest([
        (0.408 * {SL} * rnet + 0.000665 * pres * (900.0 / (t_mean + 273.0)) * u2 * ({C.es('t_mean')} - ea)) / ({SL} + 0.000665 * pres * (1.0 + 0.34 * u2)),
        1.26 * {SL} / ({SL} + 0.000665 * pres) * rnet / 2.45, rnet / 2.45]) AS pet FROM wsn)"""]
GRP = "(VALUES ('broadleaf', 120.0), ('oak', 150.0), ('pine', 90.0)) g(grp, depth)"
WIN = [f"""win0 AS (SELECT node, year, grp, pet_name, row_number() OVER (PARTITION BY node, year, grp, pet_name ORDER BY doy) AS rn, pet, liquid,
        (theta_fc - theta_lim) * depth AS w_max FROM wpet JOIN soilp USING (node), {GRP})"""]
JOB = DAY + B.NODES + B.MONTHS + C.SOIL + WX + WSNOW + WPET + WIN + bucket_sql("win0", "node, year, grp, pet_name")


def job_weather(spark, sf, factors=None):
    nd = B.node_day(spark, sf).withColumn("ea", X.vp_from_humidity("rh", "t_mean"))
    return WB.node_weather(nd, B.nodes(spark, sf), B.months(spark), factors)


def job_capacity(spark, sf):
    soil = D.derive_soil(B.nodes(spark, sf))
    groups = spark.createDataFrame([("broadleaf", 120.0), ("oak", 150.0), ("pine", 90.0)], "grp string, depth_mm double")
    return D.group_capacity(soil, groups), soil


@query("job_node_water_balance", with_sql(JOB, f"""SELECT node, year, grp, pet_name, {q6('sum(pet - aet)', 4)} AS cwd,
    {q6('sum(greatest(0.0, (0.4 - rew) / 0.4))', 4)} AS wsi, {q6('min(psi_sat * pow(greatest(theta_lim + (theta_fc - theta_lim) * w / w_max, 1e-6) / theta_sat, -b))', 4)} AS psi_min
    FROM bk JOIN soilp USING (node) GROUP BY node, year, grp, pet_name"""))
def job_node_water_balance(spark, sf):
    cap, soil = job_capacity(spark, sf)
    w = WB.node_water_balance(job_weather(spark, sf), cap, soil)
    return rnd(w.select("node", "year", "grp", "pet_name", "cwd", "wsi", "psi_min"), 4)


@query("agg_annual_water", with_sql(JOB, f"""SELECT grp, pet_name, {q6('avg(cwd)', 4)} AS cwd, {q6('avg(wsi)', 4)} AS wsi, {q6('max(abs(err))', 6)} AS balance_error, count(*) AS n FROM (
    SELECT node, year, grp, pet_name, sum(pet - aet) AS cwd, sum(greatest(0.0, (0.4 - rew) / 0.4)) AS wsi, 0.0 AS err FROM bk GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"""))
def agg_annual_water(spark, sf):
    """Annual indices averaged per group and formulation, with the largest closure error of the bucket."""
    cap, soil = job_capacity(spark, sf)
    w = WB.node_water_balance(job_weather(spark, sf), cap, soil)
    return rnd(w.groupBy("grp", "pet_name").agg(F.avg("cwd").alias("cwd"), F.avg("wsi").alias("wsi"),
               F.max(F.abs("balance_error")).alias("balance_error"), F.count(F.lit(1)).alias("n")), 4, balance_error=6)


# ---- season windows -----------------------------------------------------------------------------------

CUM = [f"cum AS (SELECT *, sum(greatest(t_mean - 5.0, 0.0)) OVER ({P_}) AS gdd_cum, avg(t_mean) OVER ({P_} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS rm FROM node_day)",
       "warm AS (SELECT node, year, min(doy) AS warmest, max(rm) AS warmest_mean FROM (SELECT node, year, doy, rm, max(rm) OVER (PARTITION BY node, year) AS mx FROM cum) WHERE rm = mx GROUP BY node, year)"]


@query("win_cum_gdd", with_sql(DAY + CUM, f"SELECT node, year, {bi('doy')} AS doy, {q6('gdd_cum')} AS gdd_cum FROM cum"))
def win_cum_gdd(spark, sf):
    return rnd(Wn.cumulative_gdd(B.node_day(spark, sf), SERIES).select("node", "year", "doy", "gdd_cum"))


@query("win_warmest_day", with_sql(DAY + CUM, f"SELECT node, year, {bi('warmest')} AS warmest, {q6('warmest_mean')} AS warmest_mean FROM warm"))
def win_warmest_day(spark, sf):
    """The warmest day of every year by its smoothed temperature."""
    return rnd(Wn.warmest_day(B.node_day(spark, sf), SERIES).select("node", "year", "warmest", "warmest_mean"))


@query("agg_gdd_gsl_gst", with_sql(DAY, f"""SELECT node, year, {q6('sum(greatest(t_mean - 5.0, 0.0))')} AS gdd, count(*) FILTER (WHERE t_mean >= 0.9) AS gsl,
    {q6('avg(t_mean) FILTER (WHERE t_mean >= 0.9)')} AS gst FROM node_day GROUP BY node, year"""))
def agg_gdd_gsl_gst(spark, sf):
    return rnd(Wn.season_indices(B.node_day(spark, sf), SERIES))


FROST = "count(*) FILTER (WHERE gdd_cum >= 20.0 AND t_min < -2.0 AND doy <= warmest)"


@query("agg_late_frost", with_sql(DAY + CUM, f"SELECT node, year, {FROST} AS late_frost_days FROM cum JOIN warm USING (node, year) GROUP BY node, year"))
def agg_late_frost(spark, sf):
    return rnd(Wn.late_frost(B.node_day(spark, sf), SERIES, F.lit(20.0)))


@query("agg_late_frost_audit", with_sql(DAY + CUM, f"""SELECT count(*) AS n, count(*) FILTER (WHERE stored = a) AS n_spring, count(*) FILTER (WHERE stored = b) AS n_full,
    count(*) FILTER (WHERE stored <> a AND stored <> b) AS n_bad FROM (SELECT a, b, CASE WHEN node % 2 = 0 THEN a ELSE b END AS stored FROM (
    SELECT node, {FROST} AS a, count(*) FILTER (WHERE gdd_cum >= 20.0 AND t_min < -2.0) AS b FROM cum JOIN warm USING (node, year) GROUP BY node, year))"""))
def agg_late_frost_audit(spark, sf):
    """Stored counts against the spring and the whole-record definition; raises when a count fits neither."""
    nd = B.node_day(spark, sf)
    a = Wn.late_frost(nd, SERIES, F.lit(20.0)).withColumnRenamed("late_frost_days", "a")
    b = Wn.late_frost(nd, SERIES, F.lit(20.0), spring_only=False).withColumnRenamed("late_frost_days", "b")
    s = a.join(b, SERIES).withColumn("stored", F.when(F.col("node") % 2 == 0, F.col("a")).otherwise(F.col("b")))
    bad = (F.col("stored") != F.col("a")) & (F.col("stored") != F.col("b"))
    out = s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stored") == F.col("a")).alias("n_spring"),
                F.count_if(F.col("stored") == F.col("b")).alias("n_full"), F.count_if(bad).alias("n_bad"))
    return out.withColumn("n_bad", F.when(F.col("n_bad") > 0, F.raise_error(F.lit("stored counts match neither definition")).cast("bigint")).otherwise(F.col("n_bad")))


@query("agg_sensitivity_sweep", with_sql(DAY + CUM + ["par AS (SELECT 'gdd_budburst' AS param, unnest([10.0, 20.0, 40.0]) AS val)"],
    f"SELECT param, {q6('val')} AS val, {q6('avg(f)')} AS late_frost_days FROM (SELECT param, val, node, year, count(*) FILTER (WHERE gdd_cum >= val AND t_min < -2.0 AND doy <= warmest) AS f FROM cum JOIN warm USING (node, year), par GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"))
def agg_sensitivity_sweep(spark, sf):
    """Late frost under a grid of budburst thresholds: the series is scanned once, the values ride along as an array."""
    values = [10.0, 20.0, 40.0]
    d = Wn.cumulative_gdd(B.node_day(spark, sf), SERIES)
    d = d.join(Wn.warmest_day(B.node_day(spark, sf), SERIES), SERIES)
    hits = [F.count_if((F.col("gdd_cum") >= v) & (F.col("t_min") < -2.0) & (F.col("doy") <= F.col("warmest"))).alias(f"v{i}") for i, v in enumerate(values)]
    per = d.groupBy(*SERIES).agg(*hits)
    rows = F.explode(F.array(*[F.struct(F.lit("gdd_budburst").alias("param"), F.lit(v).alias("val"), F.col(f"v{i}").alias("f")) for i, v in enumerate(values)]))
    per = per.select(rows.alias("r"))
    return rnd(per.groupBy("r.param", "r.val").agg(F.avg("r.f").alias("late_frost_days")))


# ---- the other half of the node job: seasonal factors, season indices, daily potential ------------------------

FACTORS = ["""fx AS (SELECT node, CASE WHEN doy > 365 THEN 365 ELSE doy END AS day, avg(rn) AS a, avg(u2) AS b, avg(rh) AS c FROM node_day GROUP BY 1, 2)""",
           """fm AS (SELECT node, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM fx GROUP BY 1)""",
           """fac AS (SELECT node, day, fx.a / fm.a AS f_rn, fx.b / fm.b AS f_wind, fx.c / fm.c AS f_ea FROM fx JOIN fm USING (node))"""]


def job_factors(spark, sf):
    """Mean radiation, wind and humidity of a node's calendar day over its mean of all days."""
    d = B.node_day(spark, sf).groupBy("node", F.least("doy", F.lit(365)).alias("doy")).agg(F.avg("rn").alias("a"), F.avg("u2").alias("b"), F.avg("rh").alias("c"))
    m = d.groupBy("node").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg("c").alias("mc"))
    return d.join(m, "node").select("node", "doy", (F.col("a") / F.col("ma")).alias("f_rn"), (F.col("b") / F.col("mb")).alias("f_wind"), (F.col("c") / F.col("mc")).alias("f_ea"))


FJOB = DAY + B.NODES + B.MONTHS + FACTORS + [
    f"""fnd AS (SELECT node, year, doy, month, t_mean, t_max, t_min, p, n, rn * f_rn AS rn, u2 * f_wind AS u2, {C.EA} * f_ea AS ea
        FROM node_day JOIN fac ON fac.node = node_day.node AND fac.day = least(doy, 365))""".replace("SELECT node,", "SELECT node_day.node,")]
FWX = [f"""wx AS (SELECT node, year, doy, rn AS rnet, u2, t_mean + gamma * (z - z_ref) AS t_mean, t_max + gamma * (z - z_ref) AS t_max,
        t_min + gamma * (z - z_ref) - greatest(concavity, 0.0) * calm AS t_min, greatest(p * exp(grad * (z - z_ref)), 0.0) AS p,
        {C.es(f"{C.TD.replace(C.EA, 'ea')} - 0.002 * (z - z_ref)")} AS ea, {C.PRES} AS pres
        FROM fnd JOIN nodes USING (node) JOIN months USING (month))"""]
FIDX = [f"wcum AS (SELECT *, sum(greatest(t_mean - 5.0, 0.0)) OVER ({P_}) AS gdd_cum, avg(t_mean) OVER ({P_} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS rm FROM wx)",
        "wwarm AS (SELECT node, year, min(doy) AS warmest FROM (SELECT node, year, doy, rm, max(rm) OVER (PARTITION BY node, year) AS mx FROM wcum) WHERE rm = mx GROUP BY node, year)"]
LAI = [("broadleaf", 4.5), ("oak", 3.5), ("pine", 3.0)]
LAI_SQL = "CASE node % 3 WHEN 0 THEN 4.5 WHEN 1 THEN 3.5 ELSE 3.0 END"
FVD = f"greatest({C.es('t_mean + 0.45 * (t_max - t_mean)')} - ea, 0.0)"
FGC = f"(0.006 * exp(-0.8 * {FVD}) * {LAI_SQL})"
FPET = [f"""wpet AS (SELECT node, year, doy, liquid, unnest(['pm_fao56', 'priestley_taylor', 'energy_only', 'canopy_pm']) AS pet_name, unnest([
        (0.408 * {SL} * rnet + 0.000665 * pres * (900.0 / (t_mean + 273.0)) * u2 * ({C.es('t_mean')} - ea)) / ({SL} + 0.000665 * pres * (1.0 + 0.34 * u2)),
        1.26 * {SL} / ({SL} + 0.000665 * pres) * rnet / 2.45, rnet / 2.45,
        ({SL} * rnet + pres / (1.01 * (t_mean + 273.0) * 0.287) * {C.d(1.013e-3 * 86400)} * {FVD} * 0.02) / ({SL} + 0.000665 * pres * (1.0 + 0.02 / {FGC})) / 2.45]) AS pet FROM wsn)""",
        """win0 AS (SELECT node, year, pet_name, doy, row_number() OVER (PARTITION BY node, year, pet_name ORDER BY doy) AS rn, pet, liquid,
        (theta_fc - theta_lim) * CASE node % 3 WHEN 0 THEN 120.0 WHEN 1 THEN 150.0 ELSE 90.0 END AS w_max FROM wpet JOIN soilp USING (node))"""]


@query("job_node_indices", with_sql(FJOB + FWX + FIDX, f"""SELECT node, year, {q6('avg(t_mean)')} AS t_mean, {q6('sum(p)')} AS p_sum, {q6('sum(greatest(t_mean - 5.0, 0.0))')} AS gdd, count(*) FILTER (WHERE t_mean >= 0.9) AS gsl,
    {q6('avg(t_mean) FILTER (WHERE t_mean >= 0.9)')} AS gst, count(*) FILTER (WHERE gdd_cum >= 20.0 AND t_min < -2.0 AND doy <= warmest) AS late_frost_days FROM wcum JOIN wwarm USING (node, year) GROUP BY node, year"""))
def job_node_indices(spark, sf):
    """Season, frost and annual means of the downscaled weather."""
    return rnd(WB.node_indices(job_weather(spark, sf, job_factors(spark, sf)), F.lit(20.0)))


@query("job_node_potential", with_sql(FJOB + C.SOIL + FWX + WSNOW + FPET + bucket_sql("win0", "node, year, pet_name"), f"""SELECT node, year, {bi('doy')} AS doy, pet_name, {q6('w', 4)} AS w,
    {q6('psi_sat * pow(greatest(theta_lim + (theta_fc - theta_lim) * w / bk.w_max, 1e-6) / theta_sat, -b)', 4)} AS psi_soil
    FROM bk JOIN win0 USING (node, year, pet_name, rn) JOIN soilp USING (node)"""))
def job_node_potential(spark, sf):
    """Daily soil water potential under seasonal factors and all four forms of evaporation; leaf area and depth follow a node's group."""
    cap, soil = job_capacity(spark, sf)
    kind = F.element_at(F.array(*[F.lit(g) for g, _ in LAI]), (F.col("node") % 3 + 1).cast("int"))
    snow = scans.snowpack(job_weather(spark, sf, job_factors(spark, sf)).withColumn("grp", kind), SERIES)
    lai = spark.createDataFrame(D.lai_by_group(dict(LAI)), "grp string, lai double, status string")
    g_c = X.canopy_conductance(F.lit(0.006), F.col("vpd_day"), F.col("lai"), 0.8)
    pet = D.derive_pet(D.leaf_area(snow, lai), 0.0, F.lit(0.02), g_c, keep=("liquid", "grp"))
    d = scans.soil_bucket_daily(pet.join(cap.select("node", "grp", "w_max"), ["node", "grp"]), [*SERIES, "pet_name"])
    return rnd(WB.soil_potential_daily(d, soil).select("node", "year", "doy", "pet_name", "w", "psi_soil"), 4)


# ---- failure index ---------------------------------------------------------------------------------------

FIN = [f"""fin AS (SELECT node, year, doy, t_max, -0.3 - CASE WHEN n = 0 THEN 2.0 ELSE 2.0 / n END + v / 400.0 AS psi_soil, 86400.0 * 3.0 * pow(1.2, (least(t_max, 38.0) - 25.0) / 10.0) * pow(4.8, greatest(t_max - 38.0, 0.0) / 10.0)
        * greatest(0.5 * ({C.es('t_max')} + {C.es('t_min')}) - {C.EA}, 0.0) / 90.0 AS loss,
        greatest(0.5 * ({C.es('t_max')} + {C.es('t_min')}) - {C.EA}, 0.0) AS vpd24 FROM node_day)""",
       "fcl AS (SELECT *, psi_soil <= -1.0 AS closed, row_number() OVER (PARTITION BY node, year ORDER BY doy) - row_number() OVER (PARTITION BY node, year, psi_soil <= -1.0 ORDER BY doy) AS isl FROM fin)",
       "fac AS (SELECT *, CASE WHEN closed THEN sum(loss) OVER (PARTITION BY node, year, closed, isl ORDER BY doy) ELSE 0.0 END AS acc FROM fcl)"]


def failure_in(spark, sf):
    d = B.node_day(spark, sf)
    psi = F.lit(-0.3) - F.when(F.col("n") == 0, 2.0).otherwise(F.lit(2.0) / F.nullif(F.col("n"), F.lit(0.0))) + F.col("v") / 400.0
    vpd = X.vpd_whole_day("t_max", "t_min", X.vp_from_humidity("rh", "t_mean"))
    return d.select("node", "year", "doy", "t_max", psi.alias("psi_soil"), vpd.alias("vpd24"), H.daily_loss("t_max", vpd, F.lit(90.0), F.lit(3.0), F.lit(38.0)).alias("loss"))


@query("scan_failure_index", with_sql(DAY + FIN, f"""SELECT node, year, {q6('max(acc / 20000.0)', 4)} AS hfi_max, {bi('min(doy) FILTER (WHERE closed)')} AS first_closed,
    {bi('min(doy) FILTER (WHERE acc / 20000.0 >= 1.0)')} AS first_failure FROM fac GROUP BY node, year"""))
def scan_failure_index(spark, sf):
    d = failure_in(spark, sf).withColumn("psi_close", F.lit(-1.0)).withColumn("buffer", F.lit(20000.0))
    return rnd(scans.failure_summary(scans.failure_index(d, SERIES), SERIES), 4)


@query("agg_spell_summary", with_sql(DAY + FIN + [
    "rn0 AS (SELECT node, year, isl, closed, count(*) AS n, min(doy) AS s, avg(vpd24) AS v, avg(t_max) AS t FROM fcl GROUP BY 1, 2, 3, 4)",
    "pk AS (SELECT *, row_number() OVER (PARTITION BY node, year ORDER BY closed DESC, n DESC, s) AS k FROM rn0)"],
    f"""SELECT node, year, CASE WHEN closed THEN n ELSE 0 END AS longest_spell, {q6('CASE WHEN closed THEN v ELSE 0.0 END')} AS spell_vpd, {q6('CASE WHEN closed THEN t ELSE 0.0 END')} AS spell_t,
    (SELECT coalesce({bi('sum(n)')}, 0) FROM rn0 r WHERE r.node = pk.node AND r.year = pk.year AND r.closed) AS n_closed FROM pk WHERE k = 1"""))
def agg_spell_summary(spark, sf):
    d = failure_in(spark, sf).withColumn("closed", F.col("psi_soil") <= -1.0)
    return rnd(scans.spell_summary(d, SERIES))


# ---- draws ---------------------------------------------------------------------------------------------------

NATS = ["nat AS (SELECT CAST(n_nationkey AS BIGINT) AS grp_id, n_name AS grp, -1.2 - (n_nationkey % 4) * 0.3 AS p50, CAST(40.0 + n_nationkey AS DOUBLE) AS slope, -0.9 AS psi_close, 9000.0 AS capacitance, 88.0 AS lethal, 0.3 AS p50_sd, 8.0 AS slope_sd FROM nation)"]


def nation_traits(spark, sf):
    k = F.col("n_nationkey")
    return B.table(spark, sf, "nation").select(
        k.cast("bigint").alias("grp_id"), F.col("n_name").alias("grp"), (F.lit(-1.2) - (k % 4) * 0.3).alias("p50"), (k + 40.0).alias("slope"),
        F.lit(-0.9).alias("psi_close"), F.lit(9000.0).alias("capacitance"), F.lit(88.0).alias("lethal"), F.lit(0.3).alias("p50_sd"), F.lit(8.0).alias("slope_sd"))


def nrm(keys, seed):
    return f"(sqrt(-2.0 * ln({B.uniform_sql(*keys, seed=2 * seed)})) * cos({2 * 3.141592653589793!r} * {B.uniform_sql(*keys, seed=2 * seed + 1)}))"


def draws_sql(outer, inner):
    return NATS + [
        f"dr0 AS (SELECT *, o AS outer_draw, i AS inner_draw FROM nat, range(0, {outer}) a(o), range(0, {inner}) c(i))",
        f"dr1 AS (SELECT *, p50 + {nrm(['grp_id', 'outer_draw'], 100)} * p50_sd AS hp, greatest(slope + {nrm(['grp_id', 'outer_draw'], 101)} * slope_sd, slope * 0.05) AS hs FROM dr0)",
        f"dr2 AS (SELECT *, greatest(psi_close, hp) AS hc, hp + {nrm(['grp_id', 'outer_draw', 'inner_draw'], 200)} * p50_sd * 0.5 AS vp, greatest(hs + {nrm(['grp_id', 'outer_draw', 'inner_draw'], 201)} * slope_sd * 0.5, hs * 0.05) AS vs FROM dr1)",
        "draws AS (SELECT grp, outer_draw, inner_draw, vp AS p50, vs AS slope, greatest(hc, vp) AS psi_close, greatest(capacitance * (greatest(hc, vp) - (vp + ln((100.0 - lethal) / lethal) / (vs / 25.0))), 0.0) AS buffer FROM dr2)"]


SUPS = ["nat AS (SELECT s_suppkey AS grp_id, s_name AS grp, -1.2 - (s_suppkey % 4) * 0.3 AS p50, CAST(40.0 + s_suppkey % 25 AS DOUBLE) AS slope, -0.9 AS psi_close, 9000.0 AS capacitance, 88.0 AS lethal, 0.3 AS p50_sd, 8.0 AS slope_sd FROM supplier)"]


@query("src_draw_table", with_sql(SUPS + draws_sql(50, 200)[1:], f"SELECT grp, CAST(outer_draw AS BIGINT) AS outer_draw, CAST(inner_draw AS BIGINT) AS inner_draw, {q6('p50')} AS p50, {q6('slope')} AS slope, {q6('psi_close')} AS psi_close, {q6('buffer', 3)} AS buffer FROM draws"))
def src_draw_table(spark, sf):
    """Fifty group draws of two hundred individuals each, for every trait set."""
    k = F.col("s_suppkey")
    t = B.table(spark, sf, "supplier").select(
        k.alias("grp_id"), F.col("s_name").alias("grp"), (F.lit(-1.2) - (k % 4) * 0.3).alias("p50"), (k % 25 + 40.0).alias("slope"),
        F.lit(-0.9).alias("psi_close"), F.lit(9000.0).alias("capacitance"), F.lit(88.0).alias("lethal"), F.lit(0.3).alias("p50_sd"), F.lit(8.0).alias("slope_sd"))
    d = Dr.trait_draws(spark, t, {"p50": "p50_sd", "slope": "slope_sd"})
    return rnd(d.select("grp", "outer_draw", "inner_draw", "p50", "slope", "psi_close", "buffer"), 6, buffer=3)


CURVE = ["th AS (SELECT DISTINCT node, year, psi_soil AS t FROM fin)",
         "tc AS (SELECT th.node, th.year, th.t, doy, loss, psi_soil <= th.t AS c, row_number() OVER (PARTITION BY th.node, th.year, th.t ORDER BY doy) - row_number() OVER (PARTITION BY th.node, th.year, th.t, psi_soil <= th.t ORDER BY doy) AS isl FROM th JOIN fin USING (node, year))",
         "cv AS (SELECT node, year, t, max(a) AS m FROM (SELECT node, year, t, sum(loss) AS a FROM tc WHERE c GROUP BY node, year, t, isl) GROUP BY node, year, t)",
         "ng AS (SELECT DISTINCT node, year, n_name AS grp FROM fin JOIN nation ON n_nationkey = node % 25)"]


def node_curves(spark, sf):
    """The step curve of every node and year, with the node's group."""
    grp = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("grp"))
    curves = scans.threshold_curve(failure_in(spark, sf), SERIES)
    return curves.join(grp, F.col("node") % 25 == F.col("_k")).drop("_k")


@query("jn_threshold_curve", with_sql(DAY + FIN + draws_sql(50, 1) + CURVE + ["nd AS (SELECT ng.node, ng.year, d.* FROM ng JOIN draws d USING (grp))"],
       f"""SELECT nd.node, nd.year, nd.grp, CAST(outer_draw AS BIGINT) AS outer_draw, {q6('psi_close')} AS psi_close, {q6('m', 3)} AS m
       FROM nd ASOF LEFT JOIN cv ON nd.node = cv.node AND nd.year = cv.year AND nd.psi_close >= cv.t"""))
def jn_threshold_curve(spark, sf):
    """Every node's step curve read at the closing thresholds of fifty draws of its group."""
    d = Dr.trait_draws(spark, nation_traits(spark, sf), {"p50": "p50_sd", "slope": "slope_sd"}, inner=1)
    got = Dr.threshold_asof(node_curves(spark, sf), d, SERIES)
    return rnd(got.select("node", "year", "grp", "outer_draw", "psi_close", "m"), 6, m=3)


@query("agg_failure_probability", with_sql(DAY + FIN + draws_sql(50, 200) + CURVE + [
    "nd AS (SELECT ng.node, ng.year, d.grp, outer_draw, psi_close, buffer FROM ng JOIN draws d USING (grp))",
    "byd AS (SELECT nd.node, nd.year, grp, outer_draw, avg(CASE WHEN m >= buffer THEN 1.0 ELSE 0.0 END) AS h FROM nd ASOF LEFT JOIN cv ON nd.node = cv.node AND nd.year = cv.year AND nd.psi_close >= cv.t GROUP BY 1, 2, 3, 4)"],
    f"SELECT node, year, grp, {q6('avg(h)')} AS h_mean, {q6('min(h)')} AS h_min, {q6('max(h)')} AS h_max, {q6('stddev_pop(h)')} AS h_sd FROM byd GROUP BY 1, 2, 3"))
def agg_failure_probability(spark, sf):
    """Yearly probability of failure of every node under its group's draws."""
    d = Dr.trait_draws(spark, nation_traits(spark, sf), {"p50": "p50_sd", "slope": "slope_sd"})
    return rnd(Dr.failure_probability(Dr.failure_by_draw(node_curves(spark, sf), d, SERIES), SERIES))


# ---- monthly cycle ---------------------------------------------------------------------------------------------

CYC = ["""cyc AS (SELECT CAST(c_nationkey AS BIGINT) AS node, month(o_orderdate) AS month, avg(o_totalprice) AS a, max(o_totalprice) AS b, sum(o_totalprice) / 10.0 AS c
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""",
       "mid AS (SELECT i AS m, [" + ", ".join(str(x) for x in Wn.MID_DOY) + "][i] AS mid FROM range(1, 13) r(i))",
       """axis AS (SELECT ((k + 11) % 12) + 1 AS m, mid + CASE WHEN k = 0 THEN -365.0 WHEN k = 13 THEN 365.0 ELSE 0.0 END AS x, k
        FROM range(0, 14) r(k) JOIN mid ON mid.m = ((k + 11) % 12) + 1)""",
       "seg AS (SELECT d AS doy, l.m AS ml, r.m AS mr, (d - l.x) / (r.x - l.x) AS w FROM range(1, 366) t(d) JOIN axis l ON l.x <= d JOIN axis r ON r.k = l.k + 1 AND r.x > d)"]


def cyc(spark, sf):
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").cast("bigint").alias("node"), F.month("o_orderdate").alias("month")).agg(
        F.avg("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"), (F.sum("o_totalprice") / 10.0).alias("c"))


@query("win_seasonal_shape", with_sql(CYC + ["v AS (SELECT l.node, doy, l.a + (r.a - l.a) * w AS x FROM seg JOIN cyc l ON l.month = ml JOIN cyc r ON r.month = mr AND r.node = l.node)"],
       f"SELECT node, doy, {q6('x / avg(x) OVER (PARTITION BY node)')} AS shape FROM v"))
def win_seasonal_shape(spark, sf):
    return rnd(Wn.seasonal_shape(cyc(spark, sf), [N], "a").withColumn("doy", F.col("doy").cast("bigint")))


@query("win_scenario_factor", with_sql(CYC + ["v AS (SELECT l.node, doy, l.a + (r.a - l.a) * w AS x, l.c / l.b + (r.c / r.b - l.c / l.b) * w AS f FROM seg JOIN cyc l ON l.month = ml JOIN cyc r ON r.month = mr AND r.node = l.node)"],
       f"SELECT node, doy, {q6('x / avg(x) OVER (PARTITION BY node) * f', 5)} AS factor FROM v"))
def win_scenario_factor(spark, sf):
    return rnd(Wn.scenario_factor(cyc(spark, sf), [N], "a", "b", "c").withColumn("doy", F.col("doy").cast("bigint")), 5)


# ---- standardised indices -----------------------------------------------------------------------------------------

def _horner(c, r):
    out = repr(c[-1])
    for a in reversed(c[:-1]):
        out = f"({out} * {r} + CAST({a!r} AS DOUBLE))"
    return out


def nq_sql(p: str) -> str:
    r = f"sqrt(-ln(least({p}, 1.0 - {p})))"
    cen = f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    rat = lambda pair, x: f"({_horner(pair[0], x)} / {_horner(pair[1], x)})"
    tail = f"CASE WHEN {r} <= 5.0 THEN {rat(special.PPND_SHOULDER, f'({r} - 1.6)')} ELSE {rat(special.PPND_TAIL, f'({r} - 5.0)')} END"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {rat(special.PPND_CENTRE, cen)} WHEN {p} < 0.5 THEN -({tail}) ELSE {tail} END"


@query("win_spei", with_sql(B.NODE_MONTH + [
    "sp1 AS (SELECT node, period, row_number() OVER w - 1 AS i, CASE WHEN count(cwd) OVER (w ROWS 2 PRECEDING) = 3 THEN sum(cwd - 250.0) OVER (w ROWS 2 PRECEDING) END AS acc FROM nm WINDOW w AS (PARTITION BY node ORDER BY period))",
    "sp2 AS (SELECT *, i % 12 AS m, 1.0 - (row_number() OVER (PARTITION BY node, i % 12 ORDER BY acc, period) - 0.35) / count(*) OVER (PARTITION BY node, i % 12) AS u FROM sp1 WHERE acc IS NOT NULL)",
    "sp3 AS (SELECT node, m, avg(acc) AS w0, avg(u * acc) AS w1, avg(u * u * acc) AS w2 FROM sp2 GROUP BY 1, 2)",
    "sp4 AS (SELECT *, (2 * w1 - w0) / (6 * w1 - w0 - 6 * w2) AS be FROM sp3)",
    "sp5 AS (SELECT *, gamma(1 + 1 / be) * gamma(1 - 1 / be) AS g FROM sp4)",
    "sp6 AS (SELECT node, m, be, (w0 - 2 * w1) * be / g AS al, w0 - (w0 - 2 * w1) * be AS ga FROM sp5)",
    "sp7 AS (SELECT s.node, s.period, al / nullif(acc - ga, 0.0) AS r, be FROM sp1 s LEFT JOIN sp6 p ON p.node = s.node AND p.m = s.i % 12)",
    "sp8 AS (SELECT node, period, CASE WHEN r >= 0 THEN greatest(least(1.0 / (1.0 + pow(r, be)), 1.0 - 1e-6), 1e-6) END AS c FROM sp7)"],
    f"SELECT node, period, {q6(nq_sql('c'), 4)} AS spei FROM sp8"))
def win_spei(spark, sf):
    d = B.node_month(spark, sf).select("node", "period", (F.col("cwd") - 250.0).alias("d"))
    return rnd(Wn.spei(d, "node", "period", "d").select("node", "period", "spei"), 4)


CUT = 23996  # period number that splits history and projection


@query("win_qdm", with_sql(B.NODE_MONTH + [
    f"oh AS (SELECT node, period AS t, cwd AS x FROM nm WHERE period < {CUT})", f"mh AS (SELECT node, period AS t, vpd AS x FROM nm WHERE period < {CUT})",
    f"mp AS (SELECT node, period AS t, vpd AS x, (row_number() OVER (PARTITION BY node ORDER BY vpd, period) - 0.5) / count(*) OVER (PARTITION BY node) AS tau FROM nm WHERE period >= {CUT})",
    "ol AS (SELECT node, list(x ORDER BY x) AS l FROM oh GROUP BY node)", "ml AS (SELECT node, list(x ORDER BY x) AS l FROM mh GROUP BY node)",
    "q AS (SELECT mp.*, (len(ol.l) - 1) * tau AS ho, ol.l AS lo, (len(ml.l) - 1) * tau AS hm, ml.l AS lm FROM mp JOIN ol USING (node) JOIN ml USING (node))"],
    f"""SELECT node, t, {q6('lo[floor(ho)::INT + 1] + (lo[ceil(ho)::INT + 1] - lo[floor(ho)::INT + 1]) * (ho - floor(ho)) + x - (lm[floor(hm)::INT + 1] + (lm[ceil(hm)::INT + 1] - lm[floor(hm)::INT + 1]) * (hm - floor(hm)))')} AS adjusted FROM q"""))
def win_qdm(spark, sf):
    m = B.node_month(spark, sf)
    pick = lambda c, cond: m.filter(cond).select("node", F.col("period").alias("t"), F.col(c).alias("x"))
    old, new = F.col("period") < CUT, F.col("period") >= CUT
    return rnd(Wn.quantile_delta_map(pick("cwd", old), pick("vpd", old), pick("vpd", new), "node").select("node", "t", "adjusted"))


# ---- pixel series ------------------------------------------------------------------------------------------------------

FULL = B.PIXEL_MONTH + ["pf AS (SELECT a.pixel, CAST(t.period AS BIGINT) AS period, x, valid_count, nd FROM (SELECT DISTINCT pixel FROM pm) a, (SELECT unnest(range(min(period), max(period) + 1)) AS period FROM pm) t LEFT JOIN pm ON pm.pixel = a.pixel AND pm.period = t.period)"]


def z_sql(src: str, x: str = "x", out: str = "pz") -> list[str]:
    w = "OVER (PARTITION BY pixel ORDER BY period ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
    return [f"""{out} AS (SELECT *, CASE WHEN count({x}) {w} = 10 AND stddev_samp({x}) {w} > 0
        THEN ({x} - quantile_cont({x}, 0.5) {w}) / stddev_samp({x}) {w} END AS z FROM {src})"""]


def event_sql(src: str, z: str = "z", nd: str = "nd", out: str = "pe", name: str = "event") -> list[str]:
    w = "OVER (PARTITION BY pixel ORDER BY period)"
    return [f"""{out} AS (SELECT *, coalesce({z} < -2.0, FALSE) AND lead(TRUE, 2) {w} IS NOT NULL AND NOT coalesce(lead({z}, 1) {w} > -1.0, FALSE)
        AND NOT coalesce(lead({z}, 2) {w} > -1.0, FALSE) AND NOT coalesce(lag({z}) {w} < -2.0, FALSE)
        AND coalesce({nd}, FALSE) AND coalesce(lag({nd}, 1, TRUE) {w}, FALSE) AS {name} FROM {src})"""]


def full_series(spark, sf):
    return Wn.dense_series(B.pixel_month(spark, sf), "pixel", "period")


@query("win_trailing_z", with_sql(FULL + z_sql("pf"), f"SELECT pixel, period, {q6('z')} AS z FROM pz"))
def win_trailing_z(spark, sf):
    return rnd(Wn.trailing_z(full_series(spark, sf), "pixel", "period").select("pixel", "period", "z"))


@query("win_dieback", with_sql(FULL + z_sql("pf") + event_sql("pz"), "SELECT pixel, period, event FROM pe"))
def win_dieback(spark, sf):
    d = Wn.dieback(Wn.trailing_z(full_series(spark, sf), "pixel", "period"), "pixel", "period")
    return d.select("pixel", "period", "event")


@query("win_person_period", """WITH u AS (SELECT c_custkey AS id, 2000 + c_custkey % 5 AS f, 2010 AS l, CASE WHEN c_acctbal < 3000 THEN 2003 + c_custkey % 9 END AS e FROM customer),
    y AS (SELECT id, f, e, unnest(range(f, least(l, coalesce(e, l)) + 1)) AS yr FROM u) SELECT id, CAST(yr AS BIGINT) AS year, CAST(coalesce(yr = e, FALSE) AS BIGINT) AS event FROM y""")
def win_person_period(spark, sf):
    k = F.col("c_custkey")
    u = B.table(spark, sf, "customer").select(k.alias("id"), (k % 5 + 2000).alias("f"), F.lit(2010).cast("bigint").alias("l"),
                                              F.when(F.col("c_acctbal") < 3000, k % 9 + 2003).alias("e"))
    return rnd(Wn.person_period(u, "f", "l", "e").select("id", "year", "event"))


@query("win_mundlak", with_sql(B.NODE_MONTH, f"SELECT node, period, {q6('avg(cwd) OVER (PARTITION BY node)')} AS cwd_bar, {q6('cwd - avg(cwd) OVER (PARTITION BY node)')} AS cwd_dev FROM nm"))
def win_mundlak(spark, sf):
    return rnd(M.mundlak(B.node_month(spark, sf), "node", ["cwd"]).select("node", "period", "cwd_bar", "cwd_dev"))


@query("win_demean", with_sql(B.PIXEL_MONTH, f"SELECT pixel, period, {q6('x - avg(x) OVER (PARTITION BY pixel)')} AS x FROM pm"))
def win_demean(spark, sf):
    return rnd(M.demean(B.pixel_month(spark, sf).select("pixel", "period", "x"), "pixel", ["x"]))


@query("win_demean_two_way", with_sql(["bal AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS yr, l_returnflag || l_linestatus AS g, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2)"],
       f"SELECT yr, g, {q6('x - avg(x) OVER (PARTITION BY yr) - avg(x) OVER (PARTITION BY g) + avg(x) OVER ()', 4)} AS x FROM bal"))
def win_demean_two_way(spark, sf):
    """Balanced year x flag table, where alternating demeaning has the closed form of the SQL."""
    li = B.table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").cast("bigint").alias("yr"), F.concat("l_returnflag", "l_linestatus").alias("g")).agg(F.sum("l_quantity").alias("x"))
    return rnd(M.demean_two_way(li, "yr", "g", ["x"], tol=1e-6), 4)


@query("win_climate_anomaly", with_sql(B.PIXEL_MONTH + B.PIXELS + B.NODE_MONTH + [
    "j AS (SELECT pm.pixel, pm.period, px.node, nm.cwd FROM pm JOIN pixels px USING (pixel) JOIN nm ON nm.node = px.node AND nm.period = pm.period)",
    "u AS (SELECT node, period, max(cwd) AS cwd FROM j GROUP BY 1, 2)", "d AS (SELECT node, period, cwd, cwd - avg(cwd) OVER (PARTITION BY node) AS dv, avg(cwd) OVER (PARTITION BY node) AS bar FROM u)",
    "b AS (SELECT node, max(bar) AS bar FROM d GROUP BY 1)"],
    f"SELECT pixel, period, {q6('(cwd - bar) / (SELECT sqrt(avg(dv * dv)) FROM d)')} AS cwd_anom FROM j JOIN b USING (node)"))
def win_climate_anomaly(spark, sf):
    j = B.pixel_month(spark, sf).join(B.pixels(spark, sf), "pixel").join(B.node_month(spark, sf), ["node", "period"])
    return rnd(M.climate_anomaly(j.select("pixel", "node", "period", "cwd"), "node", "period", ["cwd"]).select("pixel", "period", "cwd_anom"))


@query("win_lags", with_sql(B.NODE_MONTH + ["l AS (SELECT node, period, cwd AS lag_0, lag(cwd, 1) OVER w AS lag_1, lag(cwd, 2) OVER w AS lag_2, row_number() OVER w AS r FROM nm WINDOW w AS (PARTITION BY node ORDER BY period))"],
       f"SELECT node, period, {q6('lag_0', 9)} AS lag_0, {q6('lag_1', 9)} AS lag_1, {q6('lag_2', 9)} AS lag_2 FROM l WHERE r > 2"))
def win_lags(spark, sf):
    return rnd(Wn.lags(B.node_month(spark, sf), "node", "period", "cwd", 2).select("node", "period", "lag_0", "lag_1", "lag_2"), 9)


@query("win_survival_curve", with_sql(B.NODE_MONTH, f"SELECT node, period, {q6('exp(sum(ln(1.0 - tm / 20000.0)) OVER (PARTITION BY node ORDER BY period))')} AS survival FROM nm"))
def win_survival_curve(spark, sf):
    return rnd(Wn.survival_curve(B.node_month(spark, sf).withColumn("h", F.col("tm") / 20000.0), "node", "period").select("node", "period", "survival"))


@query("win_phys_age", with_sql(B.NODE_MONTH + ["a AS (SELECT node, period, sum(greatest(least(cwd / 300.0, 1.0), 0.0)) OVER (PARTITION BY node ORDER BY period) AS age FROM nm)"],
       f"SELECT node, period, {q6('age')} AS age, {q6('28.0 * pow(1.0 - exp(-0.04 * age), 1.5)')} AS height FROM a"))
def win_phys_age(spark, sf):
    d = B.node_month(spark, sf).withColumn("phi", F.col("cwd") / 300.0)
    return rnd(Wn.physiological_age(d, "node", "period", height=(F.lit(28.0), F.lit(0.04))).select("node", "period", "age", "height"))


@query("win_rank_within", with_sql(B.RASTER, f"""SELECT "row", "col", {q6("(rank() OVER (ORDER BY class) + (count(*) OVER (PARTITION BY class) - 1) / 2.0 - 1.0) / (count(*) OVER () - 1.0)")} AS rank01 FROM ras"""))
def win_rank_within(spark, sf):
    """Average ranks over the whole raster; twelve classes make for long ties."""
    return rnd(Wn.rank_within(B.raster(spark, sf), "class").select("row", "col", "rank01"))


@query("win_lattice_index", """SELECT c_custkey AS id, c_custkey % 40 AS li, (c_custkey * 3) % 50 AS lj FROM customer""")
def win_lattice_index(spark, sf):
    k = F.col("c_custkey")
    step_lat, step_lon, stride = 2.6 / 312, 3.3 / 396, 7
    t = B.table(spark, sf, "customer").select(k.alias("id"), (F.lit(41.4) - ((k % 40) * stride + 0.5) * step_lat).alias("lat"),
                                              (F.lit(43.4) + (((k * 3) % 50) * stride + 0.5) * step_lon).alias("lon"))
    return R.lattice_index(t, "lat", "lon", (43.4, 38.8, 46.7, 41.4), (312, 396), stride).select("id", "li", "lj")
