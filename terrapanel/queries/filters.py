"""Filter, set and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.operators import filters as Fl
from terrapanel.operators import joins as J
from terrapanel.operators import splits as Sp
from terrapanel.operators import windows as Wn
from terrapanel.plans import derive as D
from terrapanel.queries import base as B
from terrapanel.queries import columns as C
from terrapanel.queries import windows as QW
from terrapanel.tables import by_keys
from terrapanel.queries.base import bi, q6, query, rnd, with_sql


@query("flt_complete_soil", with_sql(["s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS a, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS b FROM part)"],
       "SELECT id, a, b FROM s WHERE a IS NOT NULL AND b IS NOT NULL"))
def flt_complete_soil(spark, sf):
    """Missing values arrive as NaN (which Spark would rank above every number) and as null; both are incomplete."""
    k = F.col("p_partkey")
    d = B.table(spark, sf, "part").select(k.alias("id"), F.when(k % 11 != 0, F.col("p_retailprice")).otherwise(float("nan")).alias("a"),
                                          F.when(k % 7 != 0, F.col("p_size").cast("double")).alias("b"))
    return Fl.complete(d, ["a", "b"])


@query("flt_complete_era5", with_sql(B.NODE_DAY + ["s AS (SELECT node, sum(CASE WHEN n = 0 THEN NULL ELSE v END) AS w, min(CASE WHEN n = 0 THEN NULL ELSE rn END) AS r, CASE WHEN max(n) >= 5 THEN max(u2) END AS u FROM node_day GROUP BY node)"],
       f"SELECT node, {q6('w')} AS w, {q6('r')} AS r, {q6('u')} AS u FROM s WHERE w IS NOT NULL AND r IS NOT NULL AND u IS NOT NULL"))
def flt_complete_era5(spark, sf):
    seen = F.col("n") > 0
    d = B.node_day(spark, sf).groupBy("node").agg(F.sum(F.when(seen, F.col("v"))).alias("w"), F.min(F.when(seen, F.col("rn"))).alias("r"),
                                                  F.when(F.max("n") >= 5, F.max("u2")).alias("u"))
    return rnd(Fl.complete(d, ["w", "r", "u"]))


@query("flt_country_mask", with_sql(B.POINTS + B.RASTER, """SELECT point, coalesce(r.inside, FALSE) AS inside FROM pts LEFT JOIN ras r
    ON r."row" = CAST(floor((10000.0 - y) / 250.0) AS BIGINT) AND r."col" = CAST(floor(x / 250.0) AS BIGINT)"""))
def flt_country_mask(spark, sf):
    mask = B.raster(spark, sf).select("row", "col", F.col("inside").alias("value"))
    return Fl.country_mask(B.points(spark, sf), mask, "x", "y", 0.0, 10000.0, 250.0).select("point", "inside")


@query("flt_build_mask", with_sql(B.RASTER, f"""SELECT g."row", g."col", coalesce(r.class > 33, FALSE) AS inside,
    {q6('111.195 * (2.6 / 260.0) * 111.195 * cos(radians(41.4 - (g."row" + 0.5) * (2.6 / 260.0))) * (3.3 / 330.0)', 8)} AS km2 FROM ras g LEFT JOIN ras r
    ON r."row" = CAST(floor((CAST(41.4 AS DOUBLE) - (CAST(41.4 AS DOUBLE) - (g."row" + 0.5) * CAST(2.6 / 260.0 AS DOUBLE))) / CAST(0.0213 AS DOUBLE)) AS BIGINT)
    AND r."col" = CAST(floor(((CAST(43.4 AS DOUBLE) + (g."col" + 0.5) * CAST(3.3 / 330.0 AS DOUBLE)) - CAST(43.4 AS DOUBLE)) / CAST(0.0213 AS DOUBLE)) AS BIGINT)"""))
def flt_build_mask(spark, sf):
    r = B.raster(spark, sf)
    cls = r.select("row", "col", F.when(F.col("class") > 33, F.col("class")).otherwise(0).alias("value"))
    return rnd(Fl.build_mask(r.select("row", "col"), cls, (43.4, 38.8, 46.7, 41.4), (260, 330), 43.4, 41.4, 0.0213), 8)


@query("flt_in_cell", with_sql(B.OCCURRENCES + B.PIXELS, """SELECT rec, pixel FROM occ JOIN pixels p ON occ.lat >= p.lat - 0.0625 AND occ.lat < p.lat + 0.0625
    AND occ.lon >= p.lon - 0.0625 AND occ.lon < p.lon + 0.0625"""))
def flt_in_cell(spark, sf):
    """Records inside the square of each node, found through blocks as wide as the square."""
    half, w = 0.0625, 0.125
    o = B.occurrences(spark, sf).select("rec", "lat", "lon", F.floor(F.col("lat") / w).alias("i"), F.floor(F.col("lon") / w).alias("j"))
    p = B.pixels(spark, sf).select("pixel", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    p = p.select("*", F.explode(F.sequence(F.floor((F.col("lat0") - half) / w), F.floor((F.col("lat0") + half) / w))).alias("i"))
    p = p.select("*", F.explode(F.sequence(F.floor((F.col("lon0") - half) / w), F.floor((F.col("lon0") + half) / w))).alias("j"))
    return by_keys(o, "i", "j").join(by_keys(p, "i", "j"), ["i", "j"]).filter(Fl.in_cell("lat", "lon", "lat0", "lon0", half)).select("rec", "pixel")


@query("flt_reference_period", "SELECT o_orderkey AS id, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999".replace("year(o_orderdate) AS year", "CAST(year(o_orderdate) AS BIGINT) AS year"))
def flt_reference_period(spark, sf):
    return rnd(Fl.reference_period(B.table(spark, sf, "orders"), "o_orderdate", 1996, 1999).select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year")))


@query("flt_disturbed_recent", with_sql(QW.FULL, "SELECT pixel, period FROM (SELECT pixel, period, x, bool_or(NOT coalesce(nd, FALSE)) OVER (PARTITION BY pixel ORDER BY period ROWS 10 PRECEDING) AS d FROM pf) WHERE NOT d AND x IS NOT NULL"))
def flt_disturbed_recent(spark, sf):
    """Pixel-months with a value and no flag in the last ten steps."""
    d = Wn.recently_disturbed(QW.full_series(spark, sf), "pixel", "period")
    return d.filter(~F.col("disturbed_recent") & F.col("x").isNotNull()).select("pixel", "period")


@query("flt_quality_gate", with_sql(B.OCCURRENCES + ["m AS (SELECT rec AS model, CASE WHEN rec % 5 = 0 THEN 'skipped' ELSE 'fitted' END AS status, CASE WHEN rec % 3 <> 0 THEN f1 / 4.0 END AS boyce_mean FROM occ)"],
       f"SELECT model, {q6('boyce_mean')} AS boyce_mean FROM m WHERE status = 'fitted' AND boyce_mean >= 0.3"))
def flt_quality_gate(spark, sf):
    k = F.col("rec")
    m = B.occurrences(spark, sf).select(k.alias("model"), F.when(k % 5 == 0, "skipped").otherwise("fitted").alias("status"),
                                        F.when(k % 3 != 0, F.col("f1") / 4.0).otherwise(float("nan")).alias("boyce_mean"))
    return rnd(Fl.quality_gate(m).select("model", "boyce_mean"))


ELIG = ["""el AS (SELECT p_partkey AS unit, p_partkey % 9 <> 0 AS inside, CASE WHEN p_size % 10 = 0 THEN 1.0 ELSE 0.0 END AS protected, CASE WHEN p_partkey % 13 <> 0 THEN p_size / 60.0 END AS modified_share,
        0.05 AS water_share, CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey % 100) / 100.0 END AS forest, CASE WHEN p_partkey % 17 <> 0 THEN 0.1 END AS woodland, CASE WHEN p_partkey % 17 <> 0 THEN 0.02 END AS water FROM part)"""]


def eligibility_units(spark, sf):
    k = F.col("p_partkey")
    cov = lambda c: F.when(k % 17 != 0, c)
    return B.table(spark, sf, "part").select(
        k.alias("unit"), (k % 9 != 0).alias("inside"), F.when(F.col("p_size") % 10 == 0, 1.0).otherwise(0.0).alias("protected"),
        F.when(k % 13 != 0, F.col("p_size") / 60.0).alias("modified_share"), F.lit(0.05).alias("water_share"),
        cov((k % 100) / 100.0).alias("forest"), cov(F.lit(0.1)).alias("woodland"), cov(F.lit(0.02)).alias("water"))


@query("flt_eligibility", with_sql(ELIG + ["e2 AS (SELECT *, least(greatest(1.0 - coalesce(forest, 1.0) - coalesce(woodland, 1.0) - coalesce(water, 1.0), 0.0), 1.0) AS os FROM el)"],
       f"SELECT unit, {q6('os')} AS open_share, inside AND protected < 0.5 AND coalesce(modified_share + water_share, 0.0) <= 0.5 AND os >= 0.1 AS eligible FROM e2"))
def flt_eligibility(spark, sf):
    return rnd(Fl.eligibility(eligibility_units(spark, sf)).select("unit", "open_share", "eligible"))


@query("flt_mask_status", with_sql(["s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS a, p_size % 6 = 0 AS bad FROM part)"],
       "SELECT id, CASE WHEN a IS NULL THEN 'skipped_missing' WHEN bad THEN 'skipped_nonfinite' ELSE 'ok' END AS status FROM s"))
def flt_mask_status(spark, sf):
    k = F.col("p_partkey")
    d = B.table(spark, sf, "part").select(k.alias("id"), F.when(k % 11 != 0, F.col("p_retailprice")).alias("a"),
                                          F.when(F.col("p_size") % 6 == 0, float("nan")).otherwise(1.0).alias("b"))
    return Fl.mask_status(d, ["a"], ["b"]).select("id", "status")


@query("flt_disturbance_layer_check", with_sql(B.PIXEL_MONTH, f"SELECT {bi('period // 12')} AS year, {q6('avg(CASE WHEN nd THEN 1.0 ELSE 0.0 END)')} AS share FROM pm WHERE period // 12 BETWEEN 1996 AND 2001 GROUP BY 1"))
def flt_disturbance_layer_check(spark, sf):
    d = B.pixel_month(spark, sf).withColumn("year", F.floor(F.col("period") / 12))
    return rnd(Fl.disturbance_layer_check(d, first=1996, last=2001))


@query("flt_quantile_holdout", with_sql(B.SCORED, "SELECT id, line, p <= (SELECT quantile_cont(p, 0.7) FROM sc) AS train FROM sc"))
def flt_quantile_holdout(spark, sf):
    return Fl.quantile_holdout(B.scored(spark, sf), "p", 0.7).select("id", "line", "train")


@query("flt_coverage_guard", "SELECT p_partkey AS id FROM part WHERE p_partkey % 97 <> 0")
def flt_coverage_guard(spark, sf):
    d = B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return Fl.coverage_guard(d, F.col("id") % 97 == 0, 0.02)


@query("flt_treeline_above", with_sql(B.NODE_DAY + B.NODES + C.NY, f"SELECT node, z > 800.0 + (6.45 - gst) / -0.0055 AS above, {q6('800.0 + (6.45 - gst) / -0.0055 - z')} AS headroom FROM ny JOIN nodes USING (node)"))
def flt_treeline_above(spark, sf):
    from terrapanel.functions import ecology as E
    d = C.node_year(spark, sf).join(B.nodes(spark, sf).select("node", "z"), "node")
    d = d.withColumn("treeline", E.treeline_elevation("gst", F.lit(800.0), F.lit(-0.0055)))
    return rnd(Fl.treeline_above(d).select("node", "above", "headroom"))


# ---- sets ------------------------------------------------------------------------------------------

@query("set_merge_sensors", with_sql(C.SCENE, f"""SELECT pixel, 'hls' AS sensor, {q6(f"CASE WHEN qa & 30 = 0 THEN {C.nd_sql(0.0001, 0.0)} END")} AS kndvi FROM scene
    UNION ALL SELECT pixel, 'landsat', {q6(f"CASE WHEN qa & 62 = 0 THEN {C.nd_sql(0.0000275, -0.2)} END")} FROM scene"""))
def set_merge_sensors(spark, sf):
    from terrapanel.functions import ecology as E
    s = C.scene(spark, sf)
    parts = [s.select("pixel", F.lit(f).alias("sensor"), E.kndvi("nir", "red", "qa", f).alias("kndvi")) for f in ("hls", "landsat")]
    return rnd(parts[0].unionByName(parts[1]))


@query("set_presence_background", with_sql(B.OCCURRENCES, "SELECT rec, species, 1 AS y FROM occ WHERE lat IS NOT NULL UNION ALL SELECT rec, 'background', 0 FROM occ WHERE lat IS NOT NULL AND f2 >= 50".replace("1 AS y", "CAST(1 AS BIGINT) AS y")))
def set_presence_background(spark, sf):
    o = B.occurrences(spark, sf).filter(F.col("lat").isNotNull())
    pres = o.select("rec", "species", F.lit(1).alias("y"))
    back = o.filter(F.col("f2") >= 50).select("rec", F.lit("background").alias("species"), F.lit(0).alias("y"))
    return rnd(pres.unionByName(back))


@query("set_drop_difference", with_sql(B.NODE_MONTH, "SELECT DISTINCT node FROM nm EXCEPT SELECT DISTINCT node FROM nm WHERE gdd > 20"))
def set_drop_difference(spark, sf):
    """Nodes of one result that another result did not accept."""
    m = B.node_month(spark, sf)
    return m.select("node").distinct().join(m.filter(F.col("gdd") > 20).select("node").distinct(), "node", "left_anti")


FACT = "CROSS JOIN (SELECT DISTINCT ssp FROM mem) b CROSS JOIN (SELECT DISTINCT horizon FROM mem) c"


@query("set_member_missing", with_sql(B.MEMBERS, f"SELECT gcm, ssp, {bi('horizon')} AS horizon FROM (SELECT DISTINCT gcm FROM mem) a {FACT} EXCEPT SELECT gcm, ssp, {bi('horizon')} FROM mem WHERE value > 345"))
def set_member_missing(spark, sf):
    """Members of the full factorial that no node has finished (here: above a value)."""
    m = B.members(spark, sf)
    want = J.factorial_levels(m, ["gcm", "ssp", "horizon"])
    return rnd(want.join(m.filter(F.col("value") > 345).select("gcm", "ssp", "horizon").distinct(), ["gcm", "ssp", "horizon"], "left_anti"))


# ---- splits -------------------------------------------------------------------------------------------

BLK = ["bl AS (SELECT *, CAST(floor((x - (SELECT min(x) FROM pts)) / 900.0) * 100000 + floor((y - (SELECT min(y) FROM pts)) / 900.0) AS BIGINT) AS block FROM pts)"]
FOLD = BLK + [f"fo AS (SELECT block, (row_number() OVER (ORDER BY {B.mix_sql('block', seed=0)}, block) - 1) % 5 AS fold FROM (SELECT DISTINCT block FROM bl))",
              "fl AS (SELECT bl.*, fold FROM bl JOIN fo USING (block))"]


@query("spl_block_ids", with_sql(B.POINTS + BLK, "SELECT point, block FROM bl"))
def spl_block_ids(spark, sf):
    return Sp.block_ids(B.points(spark, sf), "x", "y", 900.0).select("point", "block")


@query("spl_block_kfold", with_sql(B.POINTS + FOLD, """SELECT f.fold, p.point, CASE WHEN p.fold = f.fold THEN 'test' ELSE 'train' END AS role FROM fl p, (SELECT unnest(range(0, 5)) AS fold) f
    WHERE p.fold = f.fold OR NOT EXISTS (SELECT 1 FROM fl q WHERE q.fold = f.fold AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 150.0)"""))
def spl_block_kfold(spark, sf):
    return Sp.block_kfold(B.points(spark, sf), "point", "x", "y", 900.0, 5, 150.0)


@query("spl_forward_chaining", """WITH y AS (SELECT o_orderkey AS id, dense_rank() OVER (ORDER BY year(o_orderdate)) AS r, (SELECT count(DISTINCT year(o_orderdate)) FROM orders) AS k FROM orders)
    SELECT fold, id, CASE WHEN r <= fold THEN 'train' ELSE 'test' END AS role FROM y, (SELECT unnest(range(3, 8)) AS fold) f WHERE fold <= k - 2 AND r <= fold + 2""")
def spl_forward_chaining(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    return Sp.forward_chaining(o, "year", "id", 3, 2)


@query("spl_leave_group", "SELECT f.o_orderpriority AS fold, o.o_orderkey AS id, CASE WHEN o.o_orderpriority = f.o_orderpriority THEN 'test' ELSE 'train' END AS role FROM orders o, (SELECT DISTINCT o_orderpriority FROM orders) f")
def spl_leave_group(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return Sp.leave_group_out(o, "o_orderpriority", "id")


@query("spl_extreme_year", "SELECT o_orderkey AS id, CASE WHEN year(o_orderdate) IN (SELECT year(o_orderdate) FROM orders GROUP BY 1 ORDER BY avg(o_totalprice) DESC LIMIT 2) THEN 'test' ELSE 'train' END AS role FROM orders")
def spl_extreme_year(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return Sp.extreme_years(o, "year", "o_totalprice", 2).select("id", "role")


__all__ = ["D"]
