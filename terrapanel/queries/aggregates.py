"""Climate, raster, niche and spatial aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions import ecology as E
from terrapanel.operators import climate as Cl
from terrapanel.operators import layers as L
from terrapanel.operators import niche as N
from terrapanel.operators import order_stats as O
from terrapanel.operators import raster as R
from terrapanel.operators import spatial as Sp
from terrapanel.operators.neighbours import knn
from terrapanel.queries import base as B
from terrapanel.queries import joins as QJ
from terrapanel.queries.base import bi, q6, query, rnd, with_sql

# ---- station fits -----------------------------------------------------------------------------------

STAT = ["st AS (SELECT month(o_orderdate) AS month, CAST((o_custkey * 31) % 2500 AS DOUBLE) AS z, 15.0 - 0.006 * ((o_custkey * 31) % 2500) + o_totalprice / 100000.0 AS t, o_totalprice / 10000.0 AS p FROM orders)"]


def station_obs(spark, sf):
    z = ((F.col("o_custkey") * 31) % 2500).cast("double")
    return B.table(spark, sf, "orders").select(F.month("o_orderdate").alias("month"), z.alias("z"),
                                               (F.lit(15.0) - z * 0.006 + F.col("o_totalprice") / 100000.0).alias("t"), (F.col("o_totalprice") / 10000.0).alias("p"))


@query("agg_lapse_rate", with_sql(STAT, f"SELECT {bi('month')} AS month, {q6('regr_slope(t, z)', 9)} AS gamma, count(*) AS n FROM st GROUP BY month"))
def agg_lapse_rate(spark, sf):
    return rnd(Cl.lapse_rate(station_obs(spark, sf)), 9)


@query("agg_precip_gradient", with_sql(STAT, f"SELECT {bi('month')} AS month, {q6('regr_slope(ln(greatest(p, 1e-6)), z)', 9)} AS grad, count(*) AS n FROM st GROUP BY month"))
def agg_precip_gradient(spark, sf):
    return rnd(Cl.precip_gradient(station_obs(spark, sf)), 9)


@query("agg_fit_r2", with_sql(STAT, f"SELECT {bi('month')} AS month, {q6('regr_r2(t, z)')} AS r2, {q6('regr_intercept(t, z)')} AS intercept FROM st GROUP BY month"))
def agg_fit_r2(spark, sf):
    return rnd(Cl.monthly_slope(station_obs(spark, sf), "z", "t").select("month", "r2", "intercept"))


@query("agg_station_arrays", "SELECT l_orderkey AS station, CAST(l_shipdate AS DATE) AS date, CAST(month(l_shipdate) AS BIGINT) AS month, c_acctbal AS elevation, l_quantity AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R'")
def agg_station_arrays(spark, sf):
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    st = o.select(F.col("o_orderkey").alias("station"), F.col("c_acctbal").alias("elevation"))
    obs = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("station"), F.to_date("l_shipdate").alias("date"),
                                                F.when(F.col("l_returnflag") == "R", "PRCP").otherwise("TMAX").alias("element"), F.col("l_quantity").alias("value"))
    return rnd(Cl.station_days(obs, st))


MON = ["mo AS (SELECT CAST(c_nationkey AS BIGINT) AS node, year(o_orderdate) AS year, month(o_orderdate) AS month, avg(o_totalprice) / 1000.0 AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"]


def monthly(spark, sf):
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("c_nationkey").cast("bigint").alias("node"), "o_orderdate", (F.col("o_totalprice") / 1000.0).alias("value"))
    return Cl.monthly_means(o, ["node"], "o_orderdate", "value")


@query("agg_monthly_means", with_sql(MON, f"SELECT node, {bi('year')} AS year, {bi('month')} AS month, {q6('value', 9)} AS value FROM mo"))
def agg_monthly_means(spark, sf):
    return rnd(monthly(spark, sf), 9)


@query("agg_climatology", with_sql(MON, f"SELECT node, {bi('month')} AS month, {q6('avg(value)', 8)} AS value FROM mo WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2"))
def agg_climatology(spark, sf):
    return rnd(Cl.climatology(monthly(spark, sf), ["node"], 1996, 2000), 8)


@query("agg_change_factors", with_sql(MON + ["cb AS (SELECT node, month, avg(value) AS v FROM mo WHERE year BETWEEN 1995 AND 1997 GROUP BY 1, 2)", "cf AS (SELECT node, month, avg(value) AS v FROM mo WHERE year BETWEEN 1998 AND 2000 GROUP BY 1, 2)"],
    f"SELECT node, {bi('month')} AS month, {q6('cf.v - cb.v', 7)} AS dt, {q6('CASE WHEN cb.v > 0.01 THEN cf.v / greatest(cb.v, 0.01) ELSE 1.0 END', 7)} AS rp FROM cb JOIN cf USING (node, month)"))
def agg_change_factors(spark, sf):
    m = monthly(spark, sf)
    two = lambda a, b: Cl.climatology(m, ["node"], a, b).select("node", "month", F.col("value").alias("t"), F.col("value").alias("p"))
    return rnd(Cl.change_factors(two(1995, 1997), two(1998, 2000), ["node", "month"]), 7)


# ---- cohort products ------------------------------------------------------------------------------------

HZ = ["hz AS (SELECT o_custkey AS id, CAST(year(o_orderdate) AS BIGINT) AS yr, o_totalprice / 5000000.0 AS h FROM orders)"]


def hazards(spark, sf):
    return B.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("bigint").alias("yr"), (F.col("o_totalprice") / 5000000.0).alias("h"))


@query("agg_competing_risk", with_sql(HZ, f"SELECT id, yr, {q6('1.0 - product(1.0 - h)')} AS h_total FROM hz GROUP BY 1, 2"))
def agg_competing_risk(spark, sf):
    return rnd(Cl.competing_risk(hazards(spark, sf), ["id", "yr"]))


@query("agg_viability", with_sql(HZ, f"SELECT id, {q6('product(1.0 - h) * (0.5 + (id % 50) / 100.0)')} AS viability FROM hz GROUP BY id"))
def agg_viability(spark, sf):
    return rnd(Cl.viability(hazards(spark, sf), ["id"], p_height=(F.col("id") % 50) / 100.0 + 0.5))


@query("agg_cum_hazard", with_sql(HZ, f"SELECT id, {q6('sum(exp(h * 10.0 - 3.0))')} AS cum_hazard FROM hz GROUP BY id"))
def agg_cum_hazard(spark, sf):
    return rnd(Cl.cumulative_hazard(hazards(spark, sf).withColumn("eta", F.col("h") * 10.0 - 3.0), ["id"]))


@query("agg_establishment_survival", with_sql(HZ, f"SELECT id, {q6('product(1.0 - h)')} AS viability FROM (SELECT id, 1.0 - exp(-exp(least(greatest(-2.0 + 4.0 * h, -30.0), 30.0))) AS h FROM hz) GROUP BY id"))
def agg_establishment_survival(spark, sf):
    d = hazards(spark, sf).withColumn("h", E.cloglog_inverse(E.linear_predictor(F.lit(-2.0), {"h": 4.0})))
    return rnd(Cl.viability(d, ["id"]))


@query("agg_reach_height", """WITH m AS (SELECT CAST(c_nationkey AS BIGINT) AS node, c_custkey AS member, sum(least(greatest(o_totalprice / 500000.0, 0.0), 1.0)) AS a, 8.0 + c_custkey % 12 AS hs, 0.05 + (c_custkey % 7) / 100.0 AS k
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT node, round(avg(CASE WHEN hs > 9.0 AND a >= -ln(1.0 - pow(least(9.0 / hs, 1.0), 1.0 / 1.5)) / k THEN 1.0 ELSE 0.0 END), 6) AS p_height, count(*) AS n_members FROM m GROUP BY node""")
def agg_reach_height(spark, sf):
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("c_custkey")
    o = o.select(F.col("c_nationkey").cast("bigint").alias("node"), k.alias("member"), (F.col("o_totalprice") / 500000.0).alias("phi"),
                 (k % 12 + 8.0).alias("h_star"), ((k % 7) / 100.0 + 0.05).alias("k"), F.lit(1.5).alias("shape"))
    return rnd(Cl.reach_height(o, ["node"], "member", 9.0))


@query("agg_exposure_composite", with_sql(B.POINTS, f"""SELECT point, {q6('((v - (SELECT avg(v) FROM pts)) / (SELECT stddev_pop(v) FROM pts) + (z - (SELECT avg(z) FROM pts)) / (SELECT stddev_pop(z) FROM pts)) / 2.0')} AS exposure FROM pts"""))
def agg_exposure_composite(spark, sf):
    return rnd(Cl.exposure_composite(B.points(spark, sf), ["v", "z"]).select("point", "exposure"))


# ---- raster windows -----------------------------------------------------------------------------------------

RG = B.RASTER + ["""rg AS (SELECT "row", "col", value FROM ras WHERE inside)""", """rb AS (SELECT min("row") AS r0, max("row") AS r1, min("col") AS c0, max("col") AS c1 FROM rg)"""]


def gappy(spark, sf):
    return B.raster(spark, sf).filter("inside").select("row", "col", "value")


@query("agg_buffer_index", with_sql(RG + ["off AS (SELECT unnest(range(-3, 4)) AS d)"], f"""SELECT g."row", g."col", {q6('(avg(n.value) - max(g.value)) / (SELECT stddev_pop(value) FROM rg)')} AS buffer
    FROM rg g, rb, off a, off b JOIN rg n ON n."row" = least(greatest(g."row" + a.d, r0), r1) AND n."col" = least(greatest(g."col" + b.d, c0), c1) GROUP BY 1, 2"""))
def agg_buffer_index(spark, sf):
    """Windows of radius three with repeated edges on a lattice with gaps."""
    return rnd(R.buffer_index(gappy(spark, sf), 3).select("row", "col", "buffer"))


@query("agg_concavity", with_sql(B.RASTER, f"""SELECT g."row", g."col", {q6('avg(n.value) - max(g.value)')} AS concavity FROM ras g JOIN ras n ON n."row" BETWEEN g."row" - 1 AND g."row" + 1 AND n."col" BETWEEN g."col" - 1 AND g."col" + 1
    AND NOT (n."row" = g."row" AND n."col" = g."col") GROUP BY 1, 2"""))
def agg_concavity(spark, sf):
    return rnd(R.concavity(B.raster(spark, sf).select("row", "col", "value")).select("row", "col", "concavity"))


@query("agg_coarse_reference", with_sql(RG, f"""SELECT g."row", g."col", {q6('avg(n.value)', 9)} AS z_ref FROM rg g JOIN rg n ON n."row" BETWEEN g."row" - 15 AND g."row" + 15 AND n."col" BETWEEN g."col" - 15 AND g."col" + 15 GROUP BY 1, 2"""))
def agg_coarse_reference(spark, sf):
    return rnd(R.window_mean(gappy(spark, sf), 15, "z_ref").select("row", "col", "z_ref"), 9)


GROUPS = {"broadleaf": [31], "oak": [32, 33, 34, 35], "pine": [36]}
GSQL = ", ".join(f"{{p}}avg(CASE WHEN n.class IN ({', '.join(map(str, c))}) THEN 1.0 ELSE 0.0 END){{s}} AS {g}" for g, c in GROUPS.items())


@query("agg_class_fractions", with_sql(B.RASTER, """SELECT g."row", g."col", """ + GSQL.format(p="round(", s=", 6)") + """ FROM ras g JOIN ras n ON n."row" BETWEEN g."row" - 2 AND g."row" + 2 AND n."col" BETWEEN g."col" - 2 AND g."col" + 2 GROUP BY 1, 2"""))
def agg_class_fractions(spark, sf):
    return rnd(R.class_fractions(B.raster(spark, sf), 2, GROUPS, "class"))


@query("agg_block_fractions", with_sql(B.RASTER, """SELECT n."row" // 10 AS "row", n."col" // 10 AS "col", """ + GSQL.format(p="round(", s=", 6)") + """, count(*) AS n FROM ras n GROUP BY 1, 2"""))
def agg_block_fractions(spark, sf):
    return rnd(R.block_class_fractions(B.raster(spark, sf).select("row", "col", F.col("class").alias("value")), 10, GROUPS))


@query("agg_block_downsample", with_sql(B.RASTER, f"""SELECT "row" // 3 AS "row", "col" // 3 AS "col", {q6("CASE WHEN count(value) FILTER (WHERE class < 38) >= 6.75 THEN avg(value) FILTER (WHERE class < 38) END")} AS mean, count(value) FILTER (WHERE class < 38) AS n_valid FROM ras GROUP BY 1, 2"""))
def agg_block_downsample(spark, sf):
    r = B.raster(spark, sf).select("row", "col", F.when(F.col("class") < 38, F.col("value")).alias("value"))
    return rnd(R.block_mean(r, 3, min_share=0.75))


@query("agg_mean_resample", with_sql(B.RASTER + ["""bm AS (SELECT "row" // 2 AS r, "col" // 2 AS c, avg(value) FILTER (WHERE class <> 30 AND "row" % 7 <> 0) AS m FROM ras GROUP BY 1, 2)""",
    "ok AS (SELECT * FROM bm WHERE m IS NOT NULL)",
    "nn AS (SELECT b.r, b.c, o.m, row_number() OVER (PARTITION BY b.r, b.c ORDER BY (b.r - o.r) * (b.r - o.r) + (b.c - o.c) * (b.c - o.c), o.r * 1000000 + o.c) AS k FROM bm b, ok o WHERE b.m IS NULL)"],
    f"""SELECT r AS "row", c AS "col", {q6('m')} AS value FROM ok UNION ALL SELECT r, c, {q6('m')} FROM nn WHERE k = 1"""))
def agg_mean_resample(spark, sf):
    """Block means; a block without a valid pixel takes the nearest valid block."""
    r = B.raster(spark, sf)
    valid = (F.col("class") != 30) & (F.col("row") % 7 != 0)
    b = R.block_mean(r.select("row", "col", F.when(valid, F.col("value")).alias("value")), 2)
    return rnd(L.fill_from_nearest(b, "mean").select("row", "col", F.col("mean").alias("value")))


@query("agg_zonal_land_shares", with_sql(B.RASTER + ["""cl AS (SELECT DISTINCT "row" // 7 AS i, "col" // 9 AS j FROM ras)"""], f"""SELECT i * 1000 + j AS cell, {q6("avg(n.open) FILTER (WHERE n.inside)", 9)} AS open, {q6("coalesce(avg(CASE WHEN n.inside THEN 1.0 ELSE 0.0 END), 0.0)", 9)} AS coverage
    FROM cl LEFT JOIN ras n ON n."row" BETWEEN i * 7 AND i * 7 + 8 AND n."col" BETWEEN j * 9 AND j * 9 + 11 GROUP BY 1"""))
def agg_zonal_land_shares(spark, sf):
    r = B.raster(spark, sf)
    c = r.select(F.floor(F.col("row") / 7).alias("i"), F.floor(F.col("col") / 9).alias("j")).distinct()
    c = c.select((F.col("i") * 1000 + F.col("j")).alias("cell"), (F.col("i") * 7).alias("r0"), (F.col("i") * 7 + 8).alias("r1"), (F.col("j") * 9).alias("c0"), (F.col("j") * 9 + 11).alias("c1"))
    return rnd(R.zonal_shares(c, r, ["open"], F.col("inside")), 9)


@query("agg_zone_area", with_sql(B.RASTER, f"""SELECT class AS region, {q6('sum(pow(0.5 * cos(radians(41.4 - ("row" + 0.5) * 0.002)), 2))')} AS km2, count(*) AS n FROM ras WHERE inside GROUP BY 1"""))
def agg_zone_area(spark, sf):
    r = B.raster(spark, sf).filter("inside")
    km2 = F.pow(F.cos(F.radians(F.lit(41.4) - (F.col("row") + 0.5) * 0.002)) * 0.5, 2)
    return rnd(L.zone_area(r, "class", km2).withColumnRenamed("class", "region"))


SUBR = B.RASTER + ["""sp AS (SELECT "row" // 3 AS pr, "col" // 3 AS pc, ("row" // 12) AS node, class, CASE WHEN value > 905 THEN value END AS value FROM ras)"""]


@query("agg_forest_candidates", with_sql(SUBR + [
    "pc AS (SELECT pr, pc, node, class, count(*) AS n, class BETWEEN 29 AND 37 AS f FROM sp GROUP BY 1, 2, 3, 4)",
    "px AS (SELECT pr, pc, node, sum(CASE WHEN f THEN n ELSE 0 END) / sum(n) AS share, arg_max(class, CASE WHEN f THEN n * 1000 - class ELSE NULL END) AS modal FROM pc GROUP BY 1, 2, 3)",
    "cn AS (SELECT *, count(*) OVER (PARTITION BY node) AS n_candidates FROM px WHERE share >= 1.0)"],
    "SELECT node, pr, pc, modal, n_candidates FROM cn WHERE n_candidates >= 5"))
def agg_forest_candidates(spark, sf):
    r = B.raster(spark, sf).select(F.floor(F.col("row") / 3).alias("pr"), F.floor(F.col("col") / 3).alias("pc"), F.floor(F.col("row") / 12).alias("node"), "class")
    return R.forest_candidates(r, range(29, 38), ["node", "pr", "pc"]).select("node", "pr", "pc", "modal", "n_candidates")


@query("agg_mean_min_valid", with_sql(SUBR, f"SELECT pr, pc, {q6('CASE WHEN count(value) >= 5 THEN avg(value) END')} AS value, count(value) AS n_valid FROM sp GROUP BY 1, 2"))
def agg_mean_min_valid(spark, sf):
    r = B.raster(spark, sf).select(F.floor(F.col("row") / 3).alias("pr"), F.floor(F.col("col") / 3).alias("pc"), F.when(F.col("value") > 905, F.col("value")).alias("value"))
    return rnd(Cl.mean_min_valid(r, ["pr", "pc"], "value"))


@query("agg_sample_per_node", with_sql(B.POINTS, f"SELECT point, grp FROM (SELECT point, grp, row_number() OVER (PARTITION BY grp ORDER BY {B.mix_sql('grp', 'point', seed=7)}, point) AS k FROM pts) WHERE k <= 25"))
def agg_sample_per_node(spark, sf):
    from terrapanel.functions.numeric import mix32
    return R.sample_per_node(B.points(spark, sf), 25, mix32("grp", "point", seed=7), "grp", "point").select("point", "grp")


# ---- observation composites ---------------------------------------------------------------------------------

@query("agg_yearly_composite", f"SELECT l_suppkey AS pixel, CAST(year(l_shipdate) AS BIGINT) AS year, {q6('quantile_cont(CASE WHEN l_linenumber < 7 THEN l_extendedprice END, 0.5)')} AS median, count(CASE WHEN l_linenumber < 7 THEN 1 END) AS valid_count FROM lineitem WHERE month(l_shipdate) IN (7, 8) GROUP BY 1, 2")
def agg_yearly_composite(spark, sf):
    li = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pixel"), "l_shipdate", F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice")).alias("k"))
    return rnd(Cl.yearly_composite(li, ["pixel"], "l_shipdate", "k"))


@query("agg_no_disturbance", """WITH fr AS (SELECT DISTINCT l_suppkey AS pixel, CAST(year(l_shipdate) AS BIGINT) AS year FROM lineitem) SELECT pixel, year,
    NOT (EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = pixel AND s_suppkey % 4 = 0 AND 1995 + s_suppkey % 7 = year) OR EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = pixel AND year(l_shipdate) = year AND l_discount >= 0.1 AND l_tax >= 0.08 AND l_quantity > 35)) AS nd FROM fr""".replace("l_discount >= 0.1 AND l_tax >= 0.08", "l_discount >= CAST(0.1 AS DOUBLE) AND l_tax >= CAST(0.08 AS DOUBLE)"))
def agg_no_disturbance(spark, sf):
    li = B.table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate").cast("bigint")).withColumnRenamed("l_suppkey", "pixel")
    s = B.table(spark, sf, "supplier").filter(F.col("s_suppkey") % 4 == 0)
    loss = s.select(F.col("s_suppkey").alias("pixel"), (F.col("s_suppkey") % 7 + 1995).alias("loss_year"))
    burned = li.select("pixel", "year", ((F.col("l_discount") >= 0.1) & (F.col("l_tax") >= 0.08) & (F.col("l_quantity") > 35)).alias("burned"))
    return Cl.no_disturbance(li.select("pixel", "year").distinct(), loss, burned)


@query("agg_soil_depth_mean", f"SELECT l_partkey AS id, {q6('avg(l_quantity)')} AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1")
def agg_soil_depth_mean(spark, sf):
    """Mean over the three depths (line numbers one to three) of each cell."""
    li = B.table(spark, sf, "lineitem").filter(F.col("l_linenumber") <= 3)
    return rnd(li.groupBy(F.col("l_partkey").alias("id")).agg(F.avg("l_quantity").alias("v")))


@query("agg_wind_mean", f"SELECT l_suppkey AS id, {q6('avg(sqrt(l_quantity * l_quantity + (l_discount * 100) * (l_discount * 100)))')} AS wind FROM lineitem GROUP BY 1")
def agg_wind_mean(spark, sf):
    li = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("u"), (F.col("l_discount") * 100).alias("v"))
    return rnd(Cl.wind_mean(li, ["id"]))


@query("agg_snow_cover", f"SELECT l_suppkey AS id, count(*) FILTER (WHERE l_quantity >= 40 AND l_linenumber < 7) AS snow_days, {q6('avg(CASE WHEN l_linenumber < 7 THEN CASE WHEN l_quantity >= 40 THEN 1.0 ELSE 0.0 END END)')} AS snow_share FROM lineitem GROUP BY 1")
def agg_snow_cover(spark, sf):
    li = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("ndsi"))
    return rnd(Cl.snow_cover(li, ["id"]))


@query("agg_benchmark_climatology", f"SELECT l_returnflag AS var, CAST(month(l_shipdate) AS BIGINT) AS month, {q6('avg(l_extendedprice) * CASE l_returnflag WHEN {0} THEN 0.1 WHEN {1} THEN 0.01 ELSE 1.0 END', 4)} AS mean FROM lineitem GROUP BY 1, 2".format("'A'", "'R'"))
def agg_benchmark_climatology(spark, sf):
    li = B.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("var"), F.month("l_shipdate").alias("month"), F.col("l_extendedprice").alias("value"))
    return rnd(Cl.benchmark_climatology(li, {"A": 0.1, "R": 0.01}), 4)


@query("agg_lai_season", f"SELECT l_suppkey AS id, {q6('avg(l_quantity)')} AS lai FROM lineitem WHERE month(l_shipdate) IN (7, 8) AND year(l_shipdate) >= 1998 GROUP BY 1")
def agg_lai_season(spark, sf):
    li = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), "l_shipdate", F.col("l_quantity").alias("lai"))
    return rnd(Cl.season_mean(li, ["id"], "l_shipdate", "lai", first_year=1998))


@query("agg_lidar_height", f"SELECT l_partkey AS id, {q6('quantile_cont(l_extendedprice, 0.5)')} AS height, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber <> 1 AND 1.0 - l_tax > 0.93 GROUP BY 1".replace("1.0 - l_tax > 0.93", "l_tax <= CAST(0.06 AS DOUBLE)"))
def agg_lidar_height(spark, sf):
    li = B.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("height"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("quality"),
                                               F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("degrade"), F.when(F.col("l_tax") <= 0.06, 0.95).otherwise(0.5).alias("sensitivity"))
    return rnd(Cl.footprint_height(li, ["id"]))


# ---- niche -----------------------------------------------------------------------------------------------------

NSC = B.OCCURRENCES + ["ns AS (SELECT rec, species, 1.0 / (1.0 + exp(-(-0.5 + 0.3 * f0 - 0.2 * f1 + 0.01 * f2))) AS score, rec % 5 = 0 OR f0 > 4 AS pres FROM occ)"]


def niche_scores(spark, sf):
    o = B.occurrences(spark, sf)
    return o.select("rec", "species", E.logistic(E.linear_predictor(F.lit(-0.5), {"f0": 0.3, "f1": -0.2, "f2": 0.01})).alias("score"), ((F.col("rec") % 5 == 0) | (F.col("f0") > 4)).alias("pres"))


@query("agg_boyce", with_sql(NSC + [
    "be AS (SELECT species, min(score) AS lo, max(score) - min(score) AS sp, count(*) AS na, count(*) FILTER (WHERE pres) AS np FROM ns GROUP BY 1)",
    "bw AS (SELECT species, w, lo + w * (sp * (1.0 - 0.1) / 99) AS s, sp * 0.1 AS wd, na, np FROM be, range(0, 100) r(w))",
    "br AS (SELECT b.species, w, (count(*) FILTER (WHERE pres) / any_value(np)) / (count(*) / any_value(na)) AS ratio FROM bw b JOIN ns ON ns.species = b.species AND score >= s AND score <= s + wd GROUP BY 1, 2)",
    "bk AS (SELECT species, w, rank() OVER (PARTITION BY species ORDER BY ratio) + (count(*) OVER (PARTITION BY species, ratio) - 1) / 2.0 AS rr FROM br)"],
    f"SELECT species, {q6('corr(w, rr)')} AS boyce, count(*) AS n_windows FROM bk GROUP BY 1"))
def agg_boyce(spark, sf):
    return rnd(N.boyce_index(niche_scores(spark, sf), "score", "pres", ["species"]))


@query("agg_presence_threshold", with_sql(NSC, f"SELECT species, {q6('quantile_cont(score, 0.1)')} AS threshold FROM ns WHERE pres GROUP BY 1"))
def agg_presence_threshold(spark, sf):
    return rnd(N.presence_threshold(niche_scores(spark, sf), "score", "pres", ["species"]))


@query("agg_group_support", with_sql(NSC, """SELECT g.node, g.grp, s.supported FROM (SELECT DISTINCT a.rec % 40 AS node, b.grp FROM ns a, (VALUES ('A'), ('B'), ('C')) b(grp)) g
    LEFT JOIN (SELECT rec % 40 AS node, CASE WHEN species IN ('ECONOMY', 'LARGE') THEN 'A' ELSE 'B' END AS grp, bool_or(score > 0.6) AS supported FROM ns WHERE species IN ('ECONOMY', 'LARGE', 'PROMO', 'SMALL') GROUP BY 1, 2) s USING (node, grp)"""))
def agg_group_support(spark, sf):
    s = niche_scores(spark, sf).select((F.col("rec") % 40).alias("node"), "species", (F.col("score") > 0.6).alias("suitable"))
    passing = spark.createDataFrame([("ECONOMY", "A"), ("LARGE", "A"), ("PROMO", "B"), ("SMALL", "B")], "species string, grp string")
    groups = s.select("node").distinct().withColumn("grp", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))))
    return N.group_support(s, passing, groups, ["node"])


@query("agg_spearman_validation", with_sql(B.SCORED + [
    "rk AS (SELECT part, rank() OVER (PARTITION BY part ORDER BY p) + (count(*) OVER (PARTITION BY part, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY part ORDER BY obs) + (count(*) OVER (PARTITION BY part, obs) - 1) / 2.0 AS b FROM sc)"],
    f"SELECT part, {q6('corr(a, b)')} AS rho, count(*) AS n FROM rk GROUP BY 1"))
def agg_spearman_validation(spark, sf):
    """Rank correlation of two groups that hold half the rows each; fifty distinct values make long ties."""
    return rnd(N.spearman(B.scored(spark, sf), "p", "obs", ["part"]))


@query("agg_trait_medians", """WITH r AS (SELECT l_orderkey % 9 AS sp, -l_quantity / 10.0 AS p50, CASE WHEN l_linenumber < 5 THEN -l_discount * 10 END AS p12, CASE WHEN l_linenumber > 1 THEN -l_quantity / 5.0 END AS p88 FROM lineitem),
    g AS (SELECT CASE WHEN sp < 4 THEN 'oak' WHEN sp < 7 THEN 'pine' ELSE 'beech' END AS grp, p50, CASE WHEN p12 > p88 THEN 25.0 * 2.0 * ln(88.0 / 12.0) / (p12 - p88) END AS slope FROM r)
    SELECT grp, round(stddev_samp(p50), 6) AS p50_sd, count(p50) AS p50_n, round(stddev_samp(slope), 5) AS slope_sd, count(slope) AS slope_n, round(quantile_cont(p50, 0.5), 6) AS p50_median, round(quantile_cont(slope, 0.5), 6) AS slope_median FROM g GROUP BY 1""")
def agg_trait_medians(spark, sf):
    k = F.col("l_linenumber")
    r = B.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 9).alias("species"), (-F.col("l_quantity") / 10.0).alias("p50"),
                                              F.when(k < 5, -F.col("l_discount") * 10).alias("p12"), F.when(k > 1, -F.col("l_quantity") / 5.0).alias("p88"))
    groups = r.select("species").distinct().select("species", F.when(F.col("species") < 4, "oak").when(F.col("species") < 7, "pine").otherwise("beech").alias("grp"))
    return rnd(N.trait_summary(r, groups), 6, slope_sd=5)


# ---- variogram, interpolation ---------------------------------------------------------------------------------

VG = ["""vp AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, (a.v - b.v) * (a.v - b.v) AS q FROM pts a JOIN pts b ON a.point < b.point)""",
      "vb AS (SELECT CAST(floor(d / 100.0) AS BIGINT) AS bin, count(*) AS n_pairs, 0.5 * sum(q) / count(*) AS semivariance FROM vp WHERE d < 1000.0 GROUP BY 1 HAVING count(*) >= 6)"]


@query("agg_variogram", with_sql(B.POINTS + VG, f"SELECT bin, {q6('(bin + 0.5) * 100.0')} AS lag, {bi('n_pairs')} AS n_pairs, {q6('semivariance', 2)} AS semivariance FROM vb"))
def agg_variogram(spark, sf):
    return rnd(Sp.variogram(B.points(spark, sf), "v", 1000.0, 10), 6, semivariance=2)


@query("agg_variogram_range", with_sql(B.POINTS + VG + [
    "vt AS (SELECT *, row_number() OVER (ORDER BY bin DESC) AS k, count(*) OVER () AS n FROM vb)", "si AS (SELECT quantile_cont(semivariance, 0.5) AS sill FROM vt WHERE k <= greatest(n // 3, 1))"],
    f"SELECT {q6('coalesce((SELECT min((bin + 0.5) * 100.0) FROM vb, si WHERE semivariance >= 0.95 * sill), (SELECT max((bin + 0.5) * 100.0) FROM vb))')} AS range"))
def agg_variogram_range(spark, sf):
    return rnd(L.variogram_range(Sp.variogram(B.points(spark, sf), "v", 1000.0, 10)))


@query("agg_nn_summary", with_sql(B.POINTS + B.STATIONS + [
    "a AS (SELECT point, min(sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y))) AS d FROM pts p, sts s GROUP BY 1)",
    "b AS (SELECT t.node, min(sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y))) AS d FROM sts t JOIN sts s ON s.node % 5 <> t.node % 5 GROUP BY 1)"],
    f"SELECT {q6('(SELECT quantile_cont(d, 0.5) FROM a)')} AS target_to_train, {q6('(SELECT quantile_cont(d, 0.5) FROM b)')} AS cv_test_to_train"))
def agg_nn_summary(spark, sf):
    s = B.stations(spark, sf).withColumn("fold", F.col("node") % 5)
    return rnd(L.nn_distance_summary(s, B.points(spark, sf), "node", "point", "fold"))


IDW = ["""iw AS (SELECT n.point, n.nn, n.dist, s.v, s.z AS sz, p.z AS pz, CASE WHEN n.dist < 1 THEN 1 ELSE 0 END AS e FROM nb n JOIN (SELECT node, z, CASE WHEN node % 11 <> 0 THEN v END AS v FROM sts) s USING (node) JOIN pts p USING (point))""",
       "ie AS (SELECT point, min(nn) FILTER (WHERE e = 1) AS k FROM iw GROUP BY 1)"]


def holed(spark, sf):
    return B.stations(spark, sf).select("node", F.col("z").alias("nz"), F.when(F.col("node") % 11 != 0, F.col("v")).alias("v"))


@query("mdl_idw", with_sql(B.POINTS + B.STATIONS + QJ.NB + IDW, f"SELECT point, {q6('CASE WHEN any_value(k) IS NOT NULL THEN max(v) FILTER (WHERE nn = k) ELSE sum(v / (dist * dist)) / sum(CASE WHEN v IS NOT NULL THEN 1.0 / (dist * dist) END) END', 5)} AS value FROM iw JOIN ie USING (point) GROUP BY point"))
def mdl_idw(spark, sf):
    nb = knn(B.stations(spark, sf), B.points(spark, sf), 8, "node", "point")
    return rnd(Sp.idw(nb, holed(spark, sf), "v", target_id="point"), 5)


@query("mdl_idw_elev", with_sql(B.POINTS + B.STATIONS + QJ.NB + IDW + ["sl AS (SELECT regr_slope(v, z) AS b FROM sts WHERE node % 11 <> 0)"],
    f"SELECT point, {q6('CASE WHEN any_value(k) IS NOT NULL THEN max(v + b * (pz - sz)) FILTER (WHERE nn = k) ELSE sum((v + b * (pz - sz)) / (dist * dist)) / sum(CASE WHEN v IS NOT NULL THEN 1.0 / (dist * dist) END) END', 5)} AS value FROM iw JOIN ie USING (point), sl GROUP BY point"))
def mdl_idw_elev(spark, sf):
    """Neighbours moved to the target's elevation along one global slope before averaging."""
    h = holed(spark, sf)
    nb = knn(B.stations(spark, sf), B.points(spark, sf), 8, "node", "point").join(B.points(spark, sf).select("point", F.col("z").alias("tz")), "point")
    return rnd(Sp.idw(nb, h, "v", target_id="point", elevation=("nz", "tz"), slope=L.elevation_slope(h, "v", "nz")), 5)


@query("agg_zone_weighted_mean", with_sql(B.POINTS + B.STATIONS + QJ.NB + IDW + ["sf AS (SELECT point, CASE WHEN any_value(k) IS NOT NULL THEN max(v) FILTER (WHERE nn = k) ELSE sum(v / (dist * dist)) / sum(CASE WHEN v IS NOT NULL THEN 1.0 / (dist * dist) END) END AS value FROM iw JOIN ie USING (point) GROUP BY point)"],
    f"SELECT grp, {q6('sum(value * (1.0 + z / 1000.0)) / sum(CASE WHEN value IS NOT NULL THEN 1.0 + z / 1000.0 END)', 5)} AS mean, {q6('sum(CASE WHEN value IS NOT NULL THEN 1.0 + z / 1000.0 END)', 5)} AS land FROM sf JOIN pts USING (point) GROUP BY grp"))
def agg_zone_weighted_mean(spark, sf):
    """Land-weighted mean of the interpolated surface per region."""
    nb = knn(B.stations(spark, sf), B.points(spark, sf), 8, "node", "point")
    s = Sp.idw(nb, holed(spark, sf), "v", target_id="point").join(B.points(spark, sf).select("point", "grp", "z"), "point")
    return rnd(L.weighted_zone_mean(s, "grp", "value", F.lit(1.0) + F.col("z") / 1000.0), 5)


@query("mdl_detrend", with_sql(B.POINTS, f"SELECT point, {q6('v - (SELECT regr_intercept(v, z) FROM pts) - (SELECT regr_slope(v, z) FROM pts) * z')} AS resid FROM pts"))
def mdl_detrend(spark, sf):
    return rnd(L.detrend(B.points(spark, sf), "v", "z").select("point", "resid"))


LOO = ["""lk AS (SELECT t.node, s.node AS o, s.v, s.z, t.z AS tz, sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y)) AS d, row_number() OVER (PARTITION BY t.node ORDER BY (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y), s.node) AS nn FROM sts t JOIN sts s ON s.node <> t.node)""",
       "ls AS (SELECT t.node, regr_slope(s.v, s.z) AS b FROM sts t JOIN sts s ON s.node <> t.node GROUP BY 1)",
       "lp AS (SELECT node, sum(v / (d * d)) / sum(1.0 / (d * d)) AS p0, sum((v + b * (tz - z)) / (d * d)) / sum(1.0 / (d * d)) AS p1 FROM lk JOIN ls USING (node) WHERE nn <= 8 GROUP BY 1)"]


@query("mdl_idw_loo", with_sql(B.STATIONS + LOO, f"""SELECT count(*) AS n, {q6('sqrt(avg((v - p0) * (v - p0)))', 4)} AS rmse, {q6('1 - sum((v - p0) * (v - p0)) / (SELECT var_pop(v) * count(*) FROM sts)')} AS r2,
    {q6('sqrt(avg((v - p1) * (v - p1)))', 4)} AS rmse_elev, {q6('1 - sum((v - p1) * (v - p1)) / (SELECT var_pop(v) * count(*) FROM sts)')} AS r2_elev FROM lp JOIN sts USING (node)"""))
def mdl_idw_loo(spark, sf):
    return rnd(L.leave_one_out(B.stations(spark, sf), "node", "v", "z"), 6, rmse=4, rmse_elev=4)


# ---- layers ------------------------------------------------------------------------------------------------------

@query("agg_layer_grid", with_sql(B.MEMBERS, f"SELECT node, {q6('avg(v) FILTER (WHERE ssp = {0})')} AS \"F\", {q6('avg(v) FILTER (WHERE ssp = {1})')} AS \"O\", {q6('avg(v) FILTER (WHERE ssp = {2})')} AS \"P\" FROM mem WHERE node % 6 <> 0 GROUP BY node".format("'F'", "'O'", "'P'")))
def agg_layer_grid(spark, sf):
    """Long results to one column per layer, foreign nodes dropped, ordered for export."""
    m = B.members(spark, sf).select("node", F.col("ssp").alias("layer"), F.col("v").alias("value"), (-F.col("node")).alias("lat"), F.col("node").alias("lon"))
    inside = m.select("node", (F.col("node") % 6 != 0).alias("inside")).distinct()
    return rnd(L.layer_grid(m, inside, ["F", "O", "P"], "node").drop("lat", "lon"))


@query("agg_layer_status", with_sql(B.MEMBERS, """SELECT c_mktsegment AS layer, c_mktsegment IN ('BUILDING', 'MACHINERY') AS baseline, EXISTS (SELECT 1 FROM mem WHERE gcm = '1-URGENT' AND s.c_mktsegment = 'BUILDING') AS scenario FROM (SELECT DISTINCT c_mktsegment FROM customer) s"""))
def agg_layer_status(spark, sf):
    """Planned layers against those that exist as baseline and as scenario results."""
    plan = B.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("layer")).distinct()
    base = plan.filter(F.col("layer").isin("BUILDING", "MACHINERY"))
    scen = B.members(spark, sf).filter(F.col("gcm") == "1-URGENT").select(F.lit("BUILDING").alias("layer"))
    return L.layer_status(plan, base, scen)


__all__ = ["O"]
