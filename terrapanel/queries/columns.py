"""Column-derivation queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terrapanel import constants as K
from terrapanel.functions import ecology as E
from terrapanel.functions import hydraulics as H
from terrapanel.functions import water as S
from terrapanel.functions import weather as X
from terrapanel.plans import derive as D
from terrapanel.queries import base as B
from terrapanel.queries.base import bi, q6, query, rnd, with_sql

DAY, NODE = B.NODE_DAY, B.NODES


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def es(t: str) -> str:
    return f"({d(0.6108)} * exp({d(17.27)} * ({t}) / (({t}) + {d(237.3)})))"


def slope_es(t: str) -> str:
    return f"(4098.0 * {es(t)} / pow(({t}) + {d(237.3)}, 2))"


EA = f"(rh * {es('t_mean')} / 100.0)"
PRES = "(101.3 * pow((293.0 - 0.0065 * z) / 293.0, 5.26))"


def _day(name: str, exprs: dict, sql: dict, joined: bool = False):
    """Register a query that adds columns to the daily series (optionally joined with the node table)."""
    src = "node_day JOIN nodes USING (node)" if joined else "node_day"
    text = with_sql(DAY + (NODE if joined else []),
                    f"SELECT node, year, {bi('doy')} AS doy, " + ", ".join(f"{q6(e)} AS {n}" for n, e in sql.items()) + f" FROM {src}")

    def fn(spark, sf):
        t = B.node_day(spark, sf)
        if joined:
            t = t.join(B.nodes(spark, sf), "node")
        return rnd(t.select("node", "year", "doy", *[e().alias(n) for n, e in exprs.items()]))

    query(name, text)(fn)


def ea():
    return X.vp_from_humidity("rh", "t_mean")


_day("col_svp", {"es": lambda: X.saturation_vp("t_mean")}, {"es": es("t_mean")})
_day("col_svp_slope", {"es_slope": lambda: X.saturation_vp_slope("t_mean")}, {"es_slope": slope_es("t_mean")})
_day("col_ea_from_rh", {"ea": ea}, {"ea": EA})
_day("col_dewpoint", {"td": lambda: X.dewpoint(ea())},
     {"td": f"237.3 * ln({EA} / {d(0.6108)}) / (17.27 - ln({EA} / {d(0.6108)}))"})
_day("col_tday", {"t_day": lambda: X.daytime_t("t_mean", "t_max")}, {"t_day": "t_mean + 0.45 * (t_max - t_mean)"})
_day("col_vpd_day", {"vpd_day": lambda: X.vpd_daytime("t_mean", "t_max", ea())},
     {"vpd_day": f"greatest({es('t_mean + 0.45 * (t_max - t_mean)')} - {EA}, 0.0)"})
_day("col_vpd_max", {"vpd_max": lambda: X.vpd_peak("t_max", ea())}, {"vpd_max": f"greatest({es('t_max')} - {EA}, 0.0)"})
_day("col_vpd_24h", {"vpd24": lambda: X.vpd_whole_day("t_max", "t_min", ea())},
     {"vpd24": f"greatest(0.5 * ({es('t_max')} + {es('t_min')}) - {EA}, 0.0)"})
_day("col_vpd_v1", {"vpd_v1": lambda: X.vpd_legacy("t_max", "rh")}, {"vpd_v1": f"{es('t_max')} * (1.0 - rh / 100.0)"})
TD = f"(237.3 * ln({EA} / {d(0.6108)}) / (17.27 - ln({EA} / {d(0.6108)})))"
_day("col_ea_downscaled", {"ea": lambda: X.vp_at_elevation(ea(), "z_ref", "z")}, {"ea": es(f"{TD} - 0.002 * (z - z_ref)")}, True)
_day("col_pressure", {"pressure": lambda: X.pressure("z")}, {"pressure": PRES}, True)
_day("col_psychrometric", {"gamma": lambda: X.psychrometric(X.pressure("z"))}, {"gamma": f"0.000665 * {PRES}"}, True)
_day("col_wind2m", {"wind": lambda: X.wind_at_2m("u2")}, {"wind": "u2 * 4.87 / ln(67.8 * 10.0 - 5.42)"})
_day("col_air_density", {"rho": lambda: X.air_density("t_mean", X.pressure("z"))},
     {"rho": f"{PRES} / (1.01 * (t_mean + 273.0) * 0.287)"}, True)
_day("col_cold_air", {"cap": lambda: X.cold_air("concavity", "calm")}, {"cap": "-1.0 * greatest(concavity, 0.0) * greatest(least(calm, 1.0), 0.0)"}, True)
_day("col_rn", {"rn_net": lambda: X.net_radiation(F.col("rn") * 2.0e6, F.col("rh") * 4.0e5, "t_mean")},
     {"rn_net": f"0.85 * (rn * 2.0e6 / 1.0e6) + rh * 4.0e5 / 1.0e6 - 0.97 * {d(4.903e-9)} * pow(t_mean + 273.15, 4)"})
DEC = f"({d(0.409)} * sin({d(2 * math.pi / 365.0)} * doy - 1.39))"
DR = f"(1.0 + 0.033 * cos({d(2 * math.pi / 365.0)} * doy))"
WS = f"acos(least(greatest(-tan(radians(lat)) * tan({DEC}), -1.0), 1.0))"
_day("col_declination", {"declination": lambda: X.declination("doy")}, {"declination": DEC})
_day("col_dr", {"dr": lambda: X.inverse_distance("doy")}, {"dr": DR})
_day("col_sunset", {"sunset": lambda: X.sunset_angle("lat", "doy")}, {"sunset": WS}, True)
_day("col_ra", {"ra": lambda: X.extraterrestrial("lat", "doy")},
     {"ra": f"{d(24 * 60 / math.pi * 0.082)} * {DR} * ({WS} * sin(radians(lat)) * sin({DEC}) + cos(radians(lat)) * cos({DEC}) * sin({WS}))"}, True)
_day("col_vpd_warming", {"vpd": lambda: X.vpd_under_warming("v", "t_mean", F.lit(2.5))},
     {"vpd": f"v * {es('t_mean + 2.5')} / {es('t_mean')}"})
_day("col_rain_snow", {"rain": lambda: F.col("p") - X.snowfall("p", "t_mean"), "snow": lambda: X.snowfall("p", "t_mean")},
     {"rain": "p - CASE WHEN t_mean < 1.0 THEN p ELSE 0.0 END", "snow": "CASE WHEN t_mean < 1.0 THEN p ELSE 0.0 END"})
PM = (f"((0.408 * {slope_es('t_mean')} * rn + 0.000665 * {PRES} * (900.0 / (t_mean + 273.0)) * u2 * ({es('t_mean')} - {EA})) / "
      f"({slope_es('t_mean')} + 0.000665 * {PRES} * (1.0 + 0.34 * u2)))")
PT = f"(1.26 * {slope_es('t_mean')} / ({slope_es('t_mean')} + 0.000665 * {PRES}) * rn / 2.45)"
_day("col_pet_pm", {"pet": lambda: X.pet_reference("rn", 0.0, "t_mean", "u2", ea(), X.pressure("z"))}, {"pet": PM}, True)
_day("col_pet_pt", {"pet": lambda: X.pet_priestley_taylor("rn", 0.0, "t_mean", X.pressure("z"))}, {"pet": PT}, True)
_day("col_pet_energy", {"pet": lambda: X.pet_energy("rn", 0.0)}, {"pet": "rn / 2.45"})
VDAY = f"greatest({es('t_mean + 0.45 * (t_max - t_mean)')} - {EA}, 0.0)"
GC = f"(0.006 * exp(-0.8 * {VDAY}) * (1.0 + n))"
_day("col_canopy_conductance", {"g_c": lambda: X.canopy_conductance(F.lit(0.006), X.vpd_daytime("t_mean", "t_max", ea()), F.col("n") + 1.0, 0.8)},
     {"g_c": GC})
_day("col_pet_canopy",
     {"pet": lambda: X.pet_canopy("rn", 0.0, "t_mean", X.vpd_daytime("t_mean", "t_max", ea()), 0.02,
                                  X.canopy_conductance(F.lit(0.006), X.vpd_daytime("t_mean", "t_max", ea()), F.col("n") + 1.0, 0.8), X.pressure("z"))},
     {"pet": f"({slope_es('t_mean')} * rn + {PRES} / (1.01 * (t_mean + 273.0) * 0.287) * {d(1.013e-3 * 86400)} * {VDAY} * 0.02) / "
             f"({slope_es('t_mean')} + 0.000665 * {PRES} * (1.0 + 0.02 / {GC})) / 2.45"}, True)


@query("col_t_downscaled", with_sql(DAY + NODE + B.MONTHS, f"""SELECT node, year, {bi('doy')} AS doy,
    {q6('t_mean + gamma * (z - z_ref)')} AS t_mean, {q6('t_max + gamma * (z - z_ref)')} AS t_max,
    {q6('t_min + gamma * (z - z_ref) - greatest(concavity, 0.0) * calm')} AS t_min
    FROM node_day JOIN nodes USING (node) JOIN months USING (month)"""))
def col_t_downscaled(spark, sf):
    nd = B.node_day(spark, sf).withColumn("ea", ea())
    return rnd(D.derive_weather(nd, B.nodes(spark, sf), B.months(spark)).select("node", "year", "doy", "t_mean", "t_max", "t_min"))


@query("col_p_downscaled", with_sql(DAY + NODE + B.MONTHS, f"""SELECT node, year, {bi('doy')} AS doy,
    {q6('greatest(p * exp(grad * (z - z_ref)), 0.0)')} AS p FROM node_day JOIN nodes USING (node) JOIN months USING (month)"""))
def col_p_downscaled(spark, sf):
    nd = B.node_day(spark, sf).withColumn("ea", ea())
    return rnd(D.derive_weather(nd, B.nodes(spark, sf), B.months(spark)).select("node", "year", "doy", "p"))


CI = "(cos(b) * cos(acos(cz)) + sin(b) * sin(acos(cz)) * cos(az - asp))"


@query("col_slope_ratio", with_sql(DAY + NODE + [
    f"g AS (SELECT node, year, doy, radians(lat) AS lat, radians(slope) AS b, radians(aspect) AS asp, {DEC} AS dec, {WS} AS ws FROM node_day JOIN nodes USING (node))",
    f"h AS (SELECT *, ws * (i * {d(2.0 / 287)} - 1.0) AS h FROM g, range(0, 288) r(i))",
    "c AS (SELECT *, least(greatest(sin(lat) * sin(dec) + cos(lat) * cos(dec) * cos(h), -1.0), 1.0) AS cz FROM h)",
    """a AS (SELECT *, CASE WHEN h > 0 THEN 2 * pi() - acos(least(greatest((sin(dec) - cz * sin(lat)) / (sqrt(greatest(1.0 - cz * cz, 1e-12)) * cos(lat)), -1.0), 1.0))
        ELSE acos(least(greatest((sin(dec) - cz * sin(lat)) / (sqrt(greatest(1.0 - cz * cz, 1e-12)) * cos(lat)), -1.0), 1.0)) END AS az FROM c)""",
], f"""SELECT node, year, {bi('doy')} AS doy, {q6(f'''sum(CASE WHEN cz > 0.02 THEN pow(0.75, 1.0 / greatest(cz, 0.02)) * greatest({CI}, 0.0) ELSE 0.0 END)
    / nullif(sum(CASE WHEN cz > 0.02 THEN pow(0.75, 1.0 / greatest(cz, 0.02)) * cz ELSE 0.0 END), 0.0)''', 5)} AS slope_ratio FROM a GROUP BY node, year, doy"""))
def col_slope_ratio(spark, sf):
    return rnd(D.slope_ratio(B.node_day(spark, sf), B.nodes(spark, sf)), 5)


@query("col_sky_view", with_sql(NODE, f"""SELECT node, {q6('0.5 * (1.0 + cos(radians(slope)))')} AS planar,
    {q6('avg(pow(cos(radians((slope * (i + 1)) % 45)), 2))')} AS horizon FROM nodes, range(0, 8) r(i) GROUP BY node, slope"""))
def col_sky_view(spark, sf):
    """Planar-slope factor, and the mean squared cosine over eight horizon directions (one row each)."""
    n = B.nodes(spark, sf)
    rows = n.select("node", "slope", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    h = F.radians((F.col("slope") * (F.col("i") + 1)) % 45)
    return rnd(rows.groupBy("node", "slope").agg(F.avg(F.pow(F.cos(h), 2)).alias("horizon"))
               .select("node", X.sky_view_slope("slope").alias("planar"), "horizon"))


def _sr(name):
    w, (c0, c1, c2) = K.SAXTON_RAWLS[name]
    t = f"({d(w[0])} + {d(w[1])}*s + {d(w[2])}*c + {d(w[3])}*om + {d(w[4])}*s*om + {d(w[5])}*c*om + {d(w[6])}*s*c)"
    return f"({d(c2)} * {t} * {t} + {d(c1)} * {t} + {d(c0)})"


SOIL = ["tex AS (SELECT node, sand / 100.0 AS s, clay / 100.0 AS c, soc / 1000.0 * 1.724 * 1.3 AS om FROM nodes)",
        f"sp0 AS (SELECT node, s, {_sr('theta_33')} AS theta_fc, {_sr('theta_1500')} AS theta_lim, {_sr('theta_s_33')} AS d FROM tex)",
        """soil AS (SELECT node, theta_fc, theta_lim, theta_fc + d - 0.097 * s + 0.043 AS theta_sat,
            (ln(1500.0) - ln(33.0)) / (ln(theta_fc) - ln(theta_lim)) AS b FROM sp0)""",
        "soilp AS (SELECT *, -(exp(ln(33.0) + b * ln(theta_fc)) * pow(theta_sat, -b)) / 1000.0 AS psi_sat FROM soil)"]


@query("col_soil_pedotransfer", with_sql(NODE + SOIL, "SELECT node, " + ", ".join(f"{q6(c)} AS {c}" for c in (
    "theta_sat", "theta_fc", "theta_lim", "psi_sat", "b")) + " FROM soilp"))
def col_soil_pedotransfer(spark, sf):
    return rnd(D.derive_soil(B.nodes(spark, sf)))


@query("col_soil_units", with_sql(NODE, f"SELECT node, {q6('sand * 7 / 10.0')} AS sand_pct, {q6('clay * 7 / 10.0')} AS clay_pct, {q6('soc * 7 / 10.0')} AS soc_pct FROM nodes"))
def col_soil_units(spark, sf):
    raw = B.nodes(spark, sf).select("node", *[(F.col(c) * 7).alias(c) for c in ("sand", "clay", "soc")])
    return rnd(D.soil_units(raw).select("node", "sand_pct", "clay_pct", "soc_pct"))


DEPTHS = [("broadleaf", 1200.0), ("oak", 1500.0), ("pine", 900.0)]


@query("col_wmax", with_sql(NODE + SOIL, f"""SELECT node, grp, {q6('(theta_fc - theta_lim) * depth')} AS w_max FROM soilp,
    (VALUES ('broadleaf', 1200.0), ('oak', 1500.0), ('pine', 900.0)) g(grp, depth)"""))
def col_wmax(spark, sf):
    groups = spark.createDataFrame(DEPTHS, "grp string, depth_mm double")
    return rnd(D.group_capacity(D.derive_soil(B.nodes(spark, sf)), groups).select("node", "grp", "w_max"))


TH = "(theta_lim + (theta_fc - theta_lim) * (n / 10.0))"


@query("col_theta", with_sql(DAY + NODE + SOIL, f"SELECT node, year, {bi('doy')} AS doy, {q6(TH)} AS theta FROM node_day JOIN soilp USING (node)"))
def col_theta(spark, sf):
    t = B.node_day(spark, sf).join(D.derive_soil(B.nodes(spark, sf)), "node")
    return rnd(t.select("node", "year", "doy", S.theta_of_storage("n", F.lit(10.0), "theta_fc", "theta_lim").alias("theta")))


@query("col_psi_soil", with_sql(DAY + NODE + SOIL, f"""SELECT node, year, {bi('doy')} AS doy,
    {q6(f'psi_sat * pow(greatest({TH}, 1e-6) / theta_sat, -b)')} AS psi FROM node_day JOIN soilp USING (node)"""))
def col_psi_soil(spark, sf):
    t = B.node_day(spark, sf).join(D.derive_soil(B.nodes(spark, sf)), "node")
    theta = S.theta_of_storage("n", F.lit(10.0), "theta_fc", "theta_lim")
    return rnd(t.select("node", "year", "doy", S.soil_potential(theta, "theta_sat", "psi_sat", "b").alias("psi")))


# ---- traits: one row per supplier as a trait set --------------------------------------------------

TRAITS = ["""tr AS (SELECT s_suppkey AS id, -1.0 - (s_suppkey % 40) / 10.0 AS p50, CAST(20.0 + s_suppkey % 60 AS DOUBLE) AS slope,
    CAST(-1.0 - (s_suppkey % 25) / 10.0 AS DOUBLE) AS psi_close, CAST(20000.0 + (s_suppkey % 11) * 1000 AS DOUBLE) AS capacitance,
    CAST(2.0 + (s_suppkey % 5) * 0.5 AS DOUBLE) AS g25, CAST(32.0 + s_suppkey % 9 AS DOUBLE) AS tp,
    CASE WHEN s_suppkey % 2 = 0 THEN 88.0 ELSE 50.0 END AS lethal, s_acctbal / 200.0 AS t FROM supplier)"""]


def traits(spark, sf):
    s, k = B.table(spark, sf, "supplier"), F.col("s_suppkey")
    dbl = lambda c: c.cast("double")
    return s.select(k.alias("id"), (F.lit(-1.0) - dbl(k % 40) / 10.0).alias("p50"), (dbl(k % 60) + 20.0).alias("slope"),
                    (F.lit(-1.0) - dbl(k % 25) / 10.0).alias("psi_close"), (dbl(k % 11) * 1000.0 + 20000.0).alias("capacitance"),
                    (dbl(k % 5) * 0.5 + 2.0).alias("g25"), (dbl(k % 9) + 32.0).alias("tp"),
                    F.when(k % 2 == 0, 88.0).otherwise(50.0).alias("lethal"), (F.col("s_acctbal") / 200.0).alias("t"))


def _trait(name: str, exprs: dict, sql: dict, places: int = 6):
    text = with_sql(TRAITS, "SELECT id, " + ", ".join(f"{q6(e, places)} AS {n}" for n, e in sql.items()) + " FROM tr")
    query(name, text)(lambda spark, sf: rnd(traits(spark, sf).select("id", *[e().alias(n) for n, e in exprs.items()]), places))


GMIN = "(CASE WHEN t <= tp THEN g25 * pow(1.2, (t - 25.0) / 10.0) ELSE g25 * pow(1.2, (tp - 25.0) / 10.0) * pow(4.8, (t - tp) / 10.0) END)"
CRIT = "(p50 + ln((100.0 - lethal) / lethal) / (slope / 25.0))"
BUF = f"greatest(capacitance * (psi_close - {CRIT}), 0.0)"
_trait("col_gmin", {"gmin": lambda: H.leaf_leakage("t", "g25", "tp")}, {"gmin": GMIN}, 4)
_trait("col_plc", {"plc": lambda: H.conductivity_loss("psi_close", "p50", "slope")}, {"plc": "100.0 / (1.0 + exp(slope / 25.0 * (psi_close - p50)))"})
_trait("col_psi_at_plc", {"psi": lambda: H.potential_at_loss("lethal", "p50", "slope")}, {"psi": CRIT})
_trait("col_slope_p12_p88", {"s": lambda: H.curve_slope(F.col("p50") + 1.0, F.col("p50") - F.col("g25"))},
       {"s": "25.0 * 2.0 * ln(88.0 / 12.0) / ((p50 + 1.0) - (p50 - g25))"})
_trait("col_stomatal", {"f": lambda: H.stomatal_opening("psi_close", "p50")}, {"f": "1.0 / (1.0 + exp(-4.0 * (psi_close - p50)))"})
_trait("col_psi_gs90", {"psi": lambda: H.closure_potential("psi_close")}, {"psi": "psi_close - ln(9.0) / 4.0"})
_trait("col_psi_crit", {"psi_crit": lambda: H.critical_potential("p50", "slope", "lethal")}, {"psi_crit": CRIT})
_trait("col_buffer", {"buffer": lambda: H.water_buffer("capacitance", "psi_close", "p50", "slope", "lethal")}, {"buffer": BUF}, 3)
_trait("col_tcrit", {"days": lambda: H.days_to_failure(H.water_buffer("capacitance", "psi_close", "p50", "slope", "lethal"), "t", F.lit(2.0), F.lit(90.0), "g25", "tp")},
       {"days": f"{BUF} / ({GMIN} * 2.0 / 90.0 * 86400.0)"}, 4)


# ---- niche, growth ----------------------------------------------------------------------------------

@query("col_niche_score", with_sql(B.OCCURRENCES, f"""SELECT rec, species, {q6("1.0 / (1.0 + exp(-(-0.5 + 0.3 * f0 + (-0.2) * f1 + 0.01 * f2)))")} AS score
    FROM (SELECT rec, species, f0, f1, CASE WHEN rec % 50 <> 0 THEN f2 END AS f2 FROM occ)"""))
def col_niche_score(spark, sf):
    """Every record scored under the model of its species (one coefficient row per species); a missing predictor gives null."""
    o = B.occurrences(spark, sf).withColumn("f2", F.when(F.col("rec") % 50 != 0, F.col("f2")))
    models = o.select("species").distinct().select(
        "species", F.lit(-0.5).alias("intercept"), F.array(F.lit(0.3), F.lit(-0.2), F.lit(0.01)).alias("coef"))
    return rnd(D.derive_niche(o, models, ["f0", "f1", "f2"], "rec"))


NY = ["ny AS (SELECT node, avg(v) AS cwd, sum(greatest(t_mean - 5.0, 0.0)) AS gdd, CAST(count(*) FILTER (WHERE t_min < -2.0) AS DOUBLE) AS frost_days, avg(t_mean) AS gst, CAST(count(*) FILTER (WHERE t_mean >= 0.9) * 10 AS DOUBLE) AS lgs FROM node_day GROUP BY node)"]
GROWTH = {"cwd50": 60.0, "gdd_ref": 50.0, "frost50": 10.0, "s_t": 1.5, "s_l": 20.0}


def node_year(spark, sf):
    return B.node_day(spark, sf).groupBy("node").agg(
        F.avg("v").alias("cwd"), F.sum(F.greatest(F.col("t_mean") - 5.0, F.lit(0.0))).alias("gdd"),
        F.count_if(F.col("t_min") < -2.0).cast("double").alias("frost_days"), F.avg("t_mean").alias("gst"),
        (F.count_if(F.col("t_mean") >= 0.9) * 10).cast("double").alias("lgs"))


@query("col_growth_modifiers", with_sql(DAY + NY, f"""SELECT node, {q6('1.0 / (1.0 + pow(cwd / 60.0, 3))')} AS f_water, {q6('gdd / (gdd + 50.0)')} AS f_heat,
    {q6('1.0 / (1.0 + pow(frost_days / 10.0, 3))')} AS f_frost,
    {q6('1.0 / (1.0 + exp(-(gst - 6.45) / 1.5)) / (1.0 + exp(-(lgs - 92.0) / 20.0))')} AS f_treeline FROM ny"""))
def col_growth_modifiers(spark, sf):
    return rnd(D.derive_growth(node_year(spark, sf), GROWTH).select("node", "f_water", "f_heat", "f_frost", "f_treeline"))


@query("col_treeline", with_sql(DAY + NY, f"SELECT node, {q6('800.0 + (6.45 - gst) / -0.0055')} AS treeline FROM ny"))
def col_treeline(spark, sf):
    return rnd(node_year(spark, sf).select("node", E.treeline_elevation("gst", F.lit(800.0), F.lit(-0.0055)).alias("treeline")))


_trait("col_chapman_richards", {"h": lambda: E.height_at_age("tp", "slope", F.col("g25") / 40.0)},
       {"h": "slope * pow(1.0 - exp(-(g25 / 40.0) * greatest(tp, 0.0)), 1.5)"})


@query("col_years_to_height", with_sql(TRAITS, f"""SELECT id, slope <= 30.0 AS never,
    {q6('CASE WHEN slope > 30.0 THEN -ln(1.0 - pow(30.0 / slope, 1.0 / 1.5)) / (g25 / 40.0) END')} AS years FROM tr"""))
def col_years_to_height(spark, sf):
    y = traits(spark, sf).select("id", E.age_at_height(F.lit(30.0), "slope", F.col("g25") / 40.0).alias("years"))
    return rnd(y.select("id", (F.col("years") == E.INF).alias("never"), F.when(F.col("years") < E.INF, F.col("years")).alias("years")))


_trait("col_height_error_var", {"v": lambda: E.height_error_variance("tp")}, {"v": "pow(0.5 + 0.05 * tp, 2)"})
_trait("col_height_fallback", {"h": lambda: E.height_water_limited("slope", "t", "tp")},
       {"h": "slope * (CASE WHEN tp > 0 THEN greatest(least(t / tp, 1.0), 0.0) ELSE 0.0 END)"})


# ---- hazard links over forecasts ----------------------------------------------------------------------

SC = B.SCORED


def cll(p: str) -> str:
    c = f"least(greatest({p}, 1e-12), 1.0 - 1e-12)"
    return f"ln(-ln(1.0 - {c}))"


def icll(e: str) -> str:
    return f"(1.0 - exp(-exp(least(greatest({e}, -30.0), 30.0))))"


def _score(name: str, exprs: dict, sql: dict):
    text = with_sql(SC, f"SELECT id, line, {q6('pred')} AS pred, " + ", ".join(f"{q6(e)} AS {n}" for n, e in sql.items()) + " FROM sc")
    query(name, text)(lambda spark, sf: rnd(B.scored(spark, sf).select("id", "line", "pred", *[e().alias(n) for n, e in exprs.items()])))


_score("col_cloglog", {"link": lambda: E.cloglog("p")}, {"link": cll("p")})
_score("col_cloglog_inv", {"h": lambda: E.cloglog_inverse(F.col("pred") - 50.0)}, {"h": icll("pred - 50.0")})
GATE = "exp(-2.0 * greatest(0.0, obs / 20.0 - 1.0))"
_score("col_gate_weight", {"gate": lambda: E.gate_weight("obs", F.lit(20.0))}, {"gate": GATE})
_score("col_blend", {"h": lambda: E.blend("p", F.col("width") + 0.01, E.gate_weight("obs", F.lit(20.0)))},
       {"h": icll(f"{GATE} * {cll('p')} + (1.0 - {GATE}) * {cll('width + 0.01')}")})
_score("col_recalibrated", {"h": lambda: E.recalibrated("p", F.when(F.col("part") == "O", 0.2).otherwise(-0.1), F.when(F.col("part") == "O", 0.9).otherwise(1.1))},
       {"h": icll(f"(CASE WHEN part = 'O' THEN 0.2 ELSE -0.1 END) + (CASE WHEN part = 'O' THEN 0.9 ELSE 1.1 END) * {cll('p')}")})
_score("col_misclass_corrected", {"h": lambda: E.misclassification_corrected("p", 0.83, 0.96)},
       {"h": "least(greatest((p - (1.0 - 0.96)) / (0.83 + 0.96 - 1.0), 0.0), 1.0)"})
_score("col_rare_event_weight", {"w": lambda: E.rare_event_weight(F.col("y") == 1.0, 0.2)}, {"w": "CASE WHEN y = 1.0 THEN 1.0 ELSE 1.0 / 0.2 END"})
_score("col_brackets", {"naw": lambda: F.col("pred") - F.col("obs"), "nab": lambda: F.col("obs"), "faw": lambda: F.col("pred") - F.col("width"), "fab": lambda: F.col("width")},
       {"naw": "pred - obs", "nab": "obs", "faw": "pred - width", "fab": "width"})
_score("col_establishment", {"h": lambda: E.cloglog_inverse(E.linear_predictor(F.lit(-2.0), {"p": 0.8, "width": -3.0}) + F.col("line") * 0.05)},
       {"h": icll("-2.0 + 0.8 * p - 3.0 * width + 0.05 * line")})
_score("col_unit_audit", {"ratio": lambda: F.col("width") / F.nullif(F.col("obs"), F.lit(0.0)), "ok": lambda: E.vpd_unit_ok("width", F.col("obs") / 20.0).cast("double")},
       {"ratio": "width / nullif(obs, 0.0)", "ok": "CASE WHEN width / nullif(obs / 20.0, 0.0) BETWEEN 0.03 AND 0.25 THEN 1.0 ELSE 0.0 END"})


# ---- grid ---------------------------------------------------------------------------------------------------

@query("col_cell_area_ha", with_sql(B.PIXELS, f"""SELECT pixel, {q6(f"{d(K.EARTH_RADIUS_KM ** 2 * math.radians(7 / 120) * 100)} * (sin(radians(lat + {d(7 / 240)})) - sin(radians(lat - {d(7 / 240)})))", 4)} AS ha FROM pixels"""))
def col_cell_area_ha(spark, sf):
    return rnd(B.pixels(spark, sf).select("pixel", E.cell_area_ha("lat", 7 / 120, 7 / 120).alias("ha")), 4)


@query("col_mercator", with_sql(B.PIXELS, f"""SELECT pixel, {q6('6378137.0 * radians(lon)', 3)} AS mx, {q6('6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2))', 3)} AS my,
    {q6('lon')} AS lon, {q6('lat')} AS lat FROM pixels"""))
def col_mercator(spark, sf):
    m = D.map_coordinates(B.pixels(spark, sf), "lat", "lon")
    return rnd(m.select("pixel", "mx", "my", E.mercator_lon("mx").alias("lon"), E.mercator_lat("my").alias("lat")), 6, mx=3, my=3)


SCENE = ["scene AS (SELECT p_partkey AS pixel, CAST(p_retailprice * 20 AS DOUBLE) AS nir, CAST(p_size * 100 + 7000 AS DOUBLE) AS red, p_partkey % 64 AS qa FROM part)"]


def scene(spark, sf):
    p = B.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("pixel"), (F.col("p_retailprice") * 20).alias("nir"),
                    (F.col("p_size") * 100 + 7000).cast("double").alias("red"), (F.col("p_partkey") % 64).alias("qa"))


def nd_sql(scale, off):
    n, r = f"(nir * {d(scale)} + {d(off)})", f"(red * {d(scale)} + {d(off)})"
    v = f"(({n} - {r}) / nullif({n} + {r}, 0.0))"
    return f"tanh({v} * {v})"


@query("col_kndvi", with_sql(SCENE, f"""SELECT pixel, {q6(f"CASE WHEN qa & 30 = 0 THEN {nd_sql(0.0001, 0.0)} END")} AS hls,
    {q6(f"CASE WHEN qa & 62 = 0 THEN {nd_sql(0.0000275, -0.2)} END")} AS landsat FROM scene"""))
def col_kndvi(spark, sf):
    s = scene(spark, sf)
    return rnd(s.select("pixel", E.kndvi("nir", "red", "qa", "hls").alias("hls"), E.kndvi("nir", "red", "qa", "landsat").alias("landsat")))
