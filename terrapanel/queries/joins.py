"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel import constants as K
from terrapanel.operators import analogues as A
from terrapanel.operators import joins as J
from terrapanel.operators import order_stats as O
from terrapanel.operators import raster as R
from terrapanel.operators import scans
from terrapanel.operators import spatial as Sp
from terrapanel.operators.neighbours import knn
from terrapanel.operators import splits as Spl
from terrapanel.queries import base as B
from terrapanel.queries import windows as QW
from terrapanel.queries.base import bi, q6, query, rnd, with_sql


@query("jn_node_key", with_sql(B.PIXELS + B.STATIONS, f"""SELECT p.pixel, {q6('s.v')} AS v FROM pixels p LEFT JOIN
    (SELECT node, v, CAST((node * 7919) % 3300 AS DOUBLE) / 1000.0 + 43.4 AS lon, CAST((node * 104729) % 2600 AS DOUBLE) / 1000.0 + 38.8 AS lat FROM sts WHERE node % 3 <> 0) s
    ON round(p.lat, 6) = round(s.lat, 6) AND round(p.lon, 6) = round(s.lon, 6)"""))
def jn_node_key(spark, sf):
    """Two result tables joined on rounded positions; the second misses a third of the nodes and carries float noise."""
    k = F.col("node")
    s = B.stations(spark, sf).filter(k % 3 != 0).select(
        "v", (((k * 7919) % 3300).cast("double") / 1000.0 + 43.4 + 1e-9).alias("lon"), (((k * 104729) % 2600).cast("double") / 1000.0 + 38.8 - 1e-9).alias("lat"))
    return rnd(J.by_position(B.pixels(spark, sf).select("pixel", "lat", "lon"), s).select("pixel", "v"))


@query("jn_node_year", with_sql(B.PIXEL_MONTH + B.PIXELS + B.NODE_MONTH, f"SELECT pixel, period, x, {q6('cwd', 9)} AS cwd FROM pm JOIN pixels USING (pixel) JOIN nm USING (node, period)"))
def jn_node_year(spark, sf):
    px = B.pixel_month(spark, sf).join(B.pixels(spark, sf).select("pixel", "node"), "pixel")
    return rnd(J.pixel_climate(px, B.node_month(spark, sf), ("node", "period")).select("pixel", "period", "x", "cwd"), 9)


@query("jn_month_lookup", with_sql(B.MONTHS, f"SELECT o_orderkey AS id, {q6('gamma * 1000')} AS gamma FROM orders JOIN months ON month(o_orderdate) = months.month"))
def jn_month_lookup(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.month("o_orderdate").alias("month"))
    return rnd(o.join(F.broadcast(B.months(spark)), "month").select("id", (F.col("gamma") * 1000).alias("gamma")))  # twelve rows


DELTA = ["""del AS (SELECT c_nationkey AS nk, o_orderpriority AS gcm, o_orderstatus AS ssp, avg(o_totalprice) / 100000.0 AS d, max(o_totalprice) / 411111.0 AS r
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""]


@query("jn_member_delta", with_sql(B.NODE_DAY + DELTA, f"SELECT node, year, {bi('doy')} AS doy, gcm, ssp, {q6('t_mean + d', 3)} AS t_mean, {q6('p * r')} AS p FROM node_day JOIN del ON nk = node % 25"))
def jn_member_delta(spark, sf):
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = o.groupBy(F.col("c_nationkey").cast("bigint").alias("nk"), F.col("o_orderpriority").alias("gcm"), F.col("o_orderstatus").alias("ssp")).agg(
        (F.avg("o_totalprice") / 100000.0).alias("d_tas"), (F.max("o_totalprice") / 411111.0).alias("r_pr"))
    d = d.select("*", F.col("d_tas").alias("d_tasmax"), F.col("d_tas").alias("d_tasmin"))
    nd = B.node_day(spark, sf).withColumn("nk", F.col("node") % 25)
    return rnd(J.apply_member_delta(nd, d, ("nk",), ("gcm", "ssp")).select("node", "year", "doy", "gcm", "ssp", "t_mean", "p"), t_mean=3)


@query("jn_factorial_members", with_sql(B.MEMBERS, f"SELECT gcm, ssp, {bi('horizon')} AS horizon FROM (SELECT DISTINCT gcm FROM mem) a CROSS JOIN (SELECT DISTINCT ssp FROM mem) b CROSS JOIN (SELECT DISTINCT horizon FROM mem) c"))
def jn_factorial_members(spark, sf):
    return rnd(J.factorial_levels(B.members(spark, sf), ["gcm", "ssp", "horizon"]))


@query("jn_semi_anti_invalid", with_sql(B.MEMBERS, f"SELECT gcm, ssp, count(*) AS n_cells, {q6('avg(v)')} AS mean_v FROM mem WHERE node NOT IN (SELECT node FROM mem GROUP BY node HAVING max(v) > 0.75) GROUP BY gcm, ssp"))
def jn_semi_anti_invalid(spark, sf):
    """Members recomputed without the nodes rejected upstream."""
    m = B.members(spark, sf)
    bad = m.groupBy("node").agg(F.max("v").alias("mx")).filter(F.col("mx") > 0.75)
    return rnd(J.drop_invalid(m, bad, ["node"]).groupBy("gcm", "ssp").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("v").alias("mean_v")))


@query("jn_nearest_grid_cell", with_sql(B.PIXELS + ["ax AS (SELECT i, 38.75 + i * 0.5 AS la FROM range(0, 6) r(i))", "ay AS (SELECT i, 43.25 + i * 0.5 AS lo FROM range(0, 7) r(i))"],
    """SELECT pixel, (SELECT i FROM ax ORDER BY abs(la - lat), i LIMIT 1) AS "row", (SELECT i FROM ay ORDER BY abs(lo - lon), i LIMIT 1) AS "col" FROM pixels"""))
def jn_nearest_grid_cell(spark, sf):
    p = B.pixels(spark, sf)
    return p.select("pixel", R.nearest_index("lat", 38.75, 0.5, 6).cast("bigint").alias("row"), R.nearest_index("lon", 43.25, 0.5, 7).cast("bigint").alias("col"))


@query("jn_point_to_raster", with_sql(B.POINTS + B.RASTER, f"""SELECT point, coalesce({q6('value')}, -1.0) AS value FROM pts LEFT JOIN ras r
    ON r."row" = CAST(floor((9000.0 - y) / 200.0) AS BIGINT) AND r."col" = CAST(floor((x - 500.0) / 200.0) AS BIGINT)"""))
def jn_point_to_raster(spark, sf):
    return rnd(R.point_to_raster(B.points(spark, sf), B.raster(spark, sf), "x", "y", 500.0, 9000.0, 200.0, F.lit(-1.0)).select("point", "value"))


LAYERS = ["""lay AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'bio06' WHEN 1 THEN 'gdd5' ELSE 'vpd' END AS var, CASE WHEN l_returnflag = 'R' THEN 'historical' ELSE 'future' END AS scenario,
        l_suppkey % 20 AS "row", l_partkey % 25 AS "col", max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3, 4)"""]


def layers(spark, sf):
    li = B.table(spark, sf, "lineitem")
    m = F.col("l_linenumber") % 3
    return li.groupBy(F.when(m == 0, "bio06").when(m == 1, "gdd5").otherwise("vpd").alias("var"),
                      F.when(F.col("l_returnflag") == "R", "historical").otherwise("future").alias("scenario"),
                      (F.col("l_suppkey") % 20).alias("row"), (F.col("l_partkey") % 25).alias("col")).agg(F.max("l_extendedprice").alias("value"))


@query("jn_point_features", with_sql(B.OCCURRENCES + LAYERS + [
    "p AS (SELECT rec, CASE WHEN rec % 2 = 0 THEN 'historical' ELSE 'future' END AS scenario, CAST(floor((41.4 - lat) / 0.13) AS BIGINT) AS r, CAST(floor((lon - 43.4) / 0.13) AS BIGINT) AS c FROM occ WHERE lat IS NOT NULL)",
    "pc AS (SELECT rec, scenario, least(greatest(r, 0), 19) AS r, least(greatest(c, 0), 24) AS c FROM p)"],
    """SELECT rec, max(value) FILTER (WHERE var = 'bio06') AS bio06, max(value) FILTER (WHERE var = 'gdd5') AS gdd5, max(value) FILTER (WHERE var = 'vpd') AS vpd
    FROM pc LEFT JOIN lay ON lay."row" = r AND lay."col" = c AND lay.scenario = pc.scenario GROUP BY rec"""))
def jn_point_features(spark, sf):
    o = B.occurrences(spark, sf).filter(F.col("lat").isNotNull())
    scen = F.when(F.col("rec") % 2 == 0, "historical").otherwise("future")
    return J.point_layers(o, layers(spark, sf), ["bio06", "gdd5", "vpd"], "rec", 43.4, 41.4, 0.13, scen, (20, 25))


@query("jn_assemble_pixels", with_sql(B.PIXELS + B.PIXEL_MONTH, "SELECT pixel, node, lat IS NOT NULL AS ok, n_values, count(*) OVER (PARTITION BY node) AS n_in_node FROM pixels JOIN (SELECT pixel, count(*) AS n_values FROM pm GROUP BY pixel HAVING count(*) >= 83) USING (pixel)"))
def jn_assemble_pixels(spark, sf):
    """Pixels with a long enough record, their values and the static inputs of the nodes still in use."""
    px = B.pixels(spark, sf)
    got = B.pixel_month(spark, sf).groupBy("pixel").agg(F.count(F.lit(1)).alias("n_values")).filter(F.col("n_values") >= 83)
    a, nodes = J.assemble_pixels(px, got, px.select("node", F.lit(True).alias("ok")).distinct())
    n = a.groupBy("node").agg(F.count(F.lit(1)).alias("n_in_node"))
    return a.join(nodes, "node").join(n, "node").select("pixel", "node", "ok", "n_values", "n_in_node")


@query("jn_points_in_window", with_sql(B.POINTS + B.RASTER, f"""SELECT point, count(*) AS n, {q6('avg(CASE WHEN class IN (31, 32, 33) THEN 1.0 ELSE 0.0 END)')} AS share FROM pts JOIN ras r
    ON r."row" BETWEEN CAST(floor((9000.0 - y) / 200.0) AS BIGINT) - 2 AND CAST(floor((9000.0 - y) / 200.0) AS BIGINT) + 2
    AND r."col" BETWEEN CAST(floor(x / 200.0) AS BIGINT) - 2 AND CAST(floor(x / 200.0) AS BIGINT) + 2 GROUP BY point"""))
def jn_points_in_window(spark, sf):
    r, c = R.raster_index("x", "y", 0.0, 9000.0, 200.0)
    p = B.points(spark, sf).select("point", r.alias("row"), c.alias("col"))
    w = R.points_in_window(p, B.raster(spark, sf).select("row", "col", "class"), 2, 2, "point")
    return rnd(w.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("class").isin(31, 32, 33).cast("double")).alias("share")))


@query("jn_protected_flag", with_sql(B.RASTER, """SELECT c_custkey AS id, CAST(class > 35 AS DOUBLE) AS protected FROM customer JOIN ras ON "row" = (c_custkey % 100) // 50 AND "col" = c_custkey % 50"""))
def jn_protected_flag(spark, sf):
    k = F.col("c_custkey")
    p = B.table(spark, sf, "customer").select(k.alias("id"), ((k % 50) * 10.0 + 5.0).alias("x"), (F.lit(995.0) - F.floor((k % 100) / 50) * 10.0).alias("y"))
    flags = B.raster(spark, sf).select("row", "col", (F.col("class") > 35).cast("int").alias("value"))
    return J.protected_flag(p, flags, "x", "y", 0.0, 1000.0, 10.0).select("id", "protected")


@query("jn_subpoints_3x3", with_sql(B.RASTER + ["""mp AS (SELECT DISTINCT "row" // 3 AS mr, "col" // 3 AS mc FROM ras)"""],
    """SELECT mr AS "row", mc AS "col", CAST(i * 3 + j AS BIGINT) AS sub, class FROM mp, range(0, 3) a(i), range(0, 3) b(j) LEFT JOIN ras r ON r."row" = mr * 3 + i AND r."col" = mc * 3 + j"""))
def jn_subpoints_3x3(spark, sf):
    """The nine fine pixels under each coarse pixel; fine pixels have side 10, coarse ones 30."""
    r = B.raster(spark, sf)
    coarse = r.select(F.floor(F.col("row") / 3).alias("row"), F.floor(F.col("col") / 3).alias("col")).distinct()
    s = R.sub_points(coarse, 0.0, 100000.0, 30.0)
    fr, fc = R.raster_index("sx", "sy", 0.0, 100000.0, 10.0)
    s = s.withColumn("fr", fr).withColumn("fc", fc)
    fine = r.select(F.col("row").alias("fr"), F.col("col").alias("fc"), "class")
    return rnd(s.join(fine, ["fr", "fc"], "left").select("row", "col", "sub", "class"))


KNN = """SELECT point, node, dist, k AS nn FROM (SELECT point, s.node, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS dist,
    row_number() OVER (PARTITION BY point ORDER BY (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), s.node) AS k FROM pts p, sts s) WHERE k <= {k}"""
NB = [f"nb AS ({KNN.format(k=8)})"]


@query("jn_knn", with_sql(B.POINTS + B.STATIONS + NB, f"SELECT point, node, {q6('dist')} AS dist, nn FROM nb"))
def jn_knn(spark, sf):
    n = knn(B.stations(spark, sf), B.points(spark, sf), 8, "node", "point")
    return rnd(n.withColumn("nn", F.col("nn").cast("bigint")))


@query("jn_pairs", with_sql(B.POINTS, f"SELECT a.point AS i, b.point AS j, {q6('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))')} AS dist FROM pts a JOIN pts b ON a.point < b.point AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 400.0"))
def jn_pairs(spark, sf):
    """All pairs of points up to 400 units apart."""
    return rnd(Sp.own_pairs(B.points(spark, sf), "point", 400.0))


@query("jn_buffer_exclusion", with_sql(B.POINTS, "SELECT point FROM pts p WHERE grp <> 3 AND NOT EXISTS (SELECT 1 FROM pts q WHERE q.grp = 3 AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 500.0)"))
def jn_buffer_exclusion(spark, sf):
    p = B.points(spark, sf)
    return Spl.buffer_exclusion(p.filter(F.col("grp") != 3), p.filter(F.col("grp") == 3), "point", "x", "y", 500.0).select("point")


FEAT = ["""fe AS (SELECT point, grp, v / 1000.0 AS a, z / 500.0 AS b, x / 2000.0 AS c FROM pts)""",
        """fs AS (SELECT node, v / 1000.0 AS a, z / 500.0 AS b, x / 2000.0 AS c FROM sts)""",
        "cv AS (SELECT covar_samp(a, a) AS aa, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, b) AS bb, covar_samp(b, c) AS bc, covar_samp(c, c) AS cc FROM fs)",
        "dt AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM cv)",
        "iv AS (SELECT (bb * cc - bc * bc) / det AS iaa, (ac * bc - ab * cc) / det AS iab, (ab * bc - ac * bb) / det AS iac, (aa * cc - ac * ac) / det AS ibb, (ab * ac - aa * bc) / det AS ibc, (aa * bb - ab * ab) / det AS icc FROM dt)",
        """md AS (SELECT point, node, (f.a - s.a) * (f.a - s.a) * iaa + (f.b - s.b) * (f.b - s.b) * ibb + (f.c - s.c) * (f.c - s.c) * icc
        + 2 * ((f.a - s.a) * (f.b - s.b) * iab + (f.a - s.a) * (f.c - s.c) * iac + (f.b - s.b) * (f.c - s.c) * ibc) AS d2 FROM fe f, fs s, iv)"""]


def analogue(spark, sf):
    f = lambda t, key: t.select(key, (F.col("v") / 1000.0).alias("a"), (F.col("z") / 500.0).alias("b"), (F.col("x") / 2000.0).alias("c"))
    return A.nearest_analogue(f(B.points(spark, sf), "point"), f(B.stations(spark, sf), "node"), ["a", "b", "c"], "point", "node")


@query("jn_analogue", with_sql(B.POINTS + B.STATIONS + FEAT, f"SELECT point, {q6('sqrt(min(d2))')} AS dist FROM md GROUP BY point"))
def jn_analogue(spark, sf):
    return rnd(analogue(spark, sf).select("point", "dist"))


@query("top_best_analogue", with_sql(B.POINTS + B.STATIONS + FEAT, f"SELECT point, arg_min(node, d2) AS node, {q6('sqrt(min(d2))')} AS dist FROM md GROUP BY point"))
def top_best_analogue(spark, sf):
    return rnd(analogue(spark, sf).select("point", "node", "dist"))


@query("jn_analogue_own", with_sql(B.POINTS + B.STATIONS + FEAT[:2] + [
    """mo AS (SELECT point, node, (f.a - s.a) * (f.a - s.a) / (1.0 + node % 3) + (f.b - s.b) * (f.b - s.b) / (1.0 + node % 4) + (f.c - s.c) * (f.c - s.c) / (1.0 + node % 2) AS d2 FROM fe f, fs s)"""],
    f"SELECT point, arg_min(node, d2) AS node, {q6('sqrt(min(d2))')} AS dist FROM mo GROUP BY point"))
def jn_analogue_own(spark, sf):
    """The nearest analogue where every station has a spread of its own."""
    f = lambda t, key: t.select(key, (F.col("v") / 1000.0).alias("a"), (F.col("z") / 500.0).alias("b"), (F.col("x") / 2000.0).alias("c"))
    spread = [(F.col("node") % m + 1).cast("double") for m in (3, 4, 2)]
    diagonal = lambda e: F.array(*[e(spread[i]) if i == j else F.lit(0.0) for i in range(3) for j in range(3)])
    ref = f(B.stations(spark, sf), "node").select("*", diagonal(lambda v: v).alias("cov"), diagonal(lambda v: F.lit(1.0) / v).alias("inv"))
    return rnd(A.analogue_own_covariance(f(B.points(spark, sf), "point"), ref, ["a", "b", "c"], "point", "node").select("point", "node", "dist"))


@query("agg_novelty", with_sql(B.POINTS + B.STATIONS + FEAT + ["d AS (SELECT point, min(d2) AS d2 FROM md GROUP BY point)"],
    f"""SELECT point, {q6('CASE WHEN d2 <= 0 THEN 0.0 WHEN d2 > 120 THEN 1.0 ELSE list_sum(list_transform(range(0, 400), lambda n: exp((1.5 + n) * ln(d2 / 2.0) - d2 / 2.0 - lgamma(2.5 + n)))) END')} AS novelty FROM d"""))
def agg_novelty(spark, sf):
    """Chi-square percentile of the squared distance, with one degree of freedom per variable."""
    return rnd(A.novelty(analogue(spark, sf), "dist", 3, "novelty").select("point", "novelty"))


@query("jn_name_value_coalesce", """WITH ob AS (SELECT l_orderkey AS station, l_suppkey AS dt, CASE l_linenumber % 4 WHEN 0 THEN 'TAVG' WHEN 1 THEN 'TMAX' WHEN 2 THEN 'TMIN' ELSE 'PRCP' END AS e, l_quantity AS v FROM lineitem)
    SELECT station, dt AS date, coalesce(max(v) FILTER (WHERE e = 'TAVG'), (max(v) FILTER (WHERE e = 'TMAX') + max(v) FILTER (WHERE e = 'TMIN')) / 2.0) AS t FROM ob GROUP BY 1, 2""")
def jn_name_value_coalesce(spark, sf):
    m = F.col("l_linenumber") % 4
    o = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("station"), F.col("l_suppkey").alias("date"),
                                              F.when(m == 0, "TAVG").when(m == 1, "TMAX").when(m == 2, "TMIN").otherwise("PRCP").alias("element"), F.col("l_quantity").alias("value"))
    return J.element_mean(o).select("station", "date", "t")


@query("jn_niche_units", """SELECT s_suppkey AS u, p.p_type AS grp, coalesce(n.sup, FALSE) AS supported FROM supplier CROSS JOIN (SELECT DISTINCT p_type FROM part) p
    LEFT JOIN (SELECT l_suppkey, p_type, sum(l_quantity) > 2500 AS sup FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 10 <> 0 GROUP BY 1, 2) n ON n.l_suppkey = s_suppkey AND n.p_type = p.p_type""")
def jn_niche_units(spark, sf):
    part = B.table(spark, sf, "part")
    u = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("u")).withColumn("grp", F.explode(part.agg(F.sort_array(F.collect_set("p_type"))).scalar()))
    n = B.table(spark, sf, "lineitem").filter(F.col("l_suppkey") % 10 != 0).join(part, F.col("l_partkey") == F.col("p_partkey"))
    n = n.groupBy(F.col("l_suppkey").alias("u"), F.col("p_type").alias("grp")).agg((F.sum("l_quantity") > 2500).alias("supported"))
    return J.niche_units(u, n, ["u", "grp"])


@query("jn_cell_lookup", with_sql(B.OCCURRENCES + B.PIXELS, "SELECT rec, min(pixel) AS pixel FROM (SELECT * FROM occ WHERE lat IS NOT NULL) o LEFT JOIN pixels p ON abs(o.lat - p.lat) <= 0.15 AND abs(o.lon - p.lon) <= 0.2 GROUP BY rec"))
def jn_cell_lookup(spark, sf):
    o = B.occurrences(spark, sf).filter(F.col("lat").isNotNull())
    return J.cell_lookup(o, B.pixels(spark, sf), "rec", "pixel", 0.3, 0.4)


__all__ = ["K", "O", "scans", "QW"]
