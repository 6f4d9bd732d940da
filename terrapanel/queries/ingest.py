"""Source and sink queries."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from terrapanel.functions.numeric import mix32
from terrapanel.operators.order_stats import dense_index
from terrapanel.plans import derive as D
from terrapanel.plans import scenario as Sc
from terrapanel.queries import base as B
from terrapanel.queries import columns as C
from terrapanel.queries import decision as QD
from terrapanel.queries import windows as QW
from terrapanel.queries.base import bi, q6, query, rnd, with_sql
from terrapanel.sources import sinks, stations
from terrapanel.sources import tables as Tb
from terrapanel.operators import portfolio as Pf


def scratch(spark) -> str:
    """A new folder beside the checkpoints where the cluster names a shared folder, else a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid
        return f"{shared.rstrip('/')}/out-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/out"


# ---- station text built from line items: one record per supplier, month and element ----------------------

STX = ["sr AS (SELECT l_suppkey AS s, year(l_shipdate) AS y, month(l_shipdate) AS m, day(l_shipdate) AS d, CASE l_returnflag WHEN 'R' THEN 'PRCP' WHEN 'A' THEN 'TMAX' ELSE 'XXXX' END AS e, max(CAST(l_quantity AS INTEGER)) AS q, max(l_linenumber) AS f FROM lineitem GROUP BY 1, 2, 3, 4, 5)"]


def station_lines(spark, sf):
    li = B.table(spark, sf, "lineitem")
    e = F.when(F.col("l_returnflag") == "R", "PRCP").when(F.col("l_returnflag") == "A", "TMAX").otherwise("XXXX")
    r = li.groupBy(F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), F.dayofmonth("l_shipdate").alias("d"), e.alias("e")).agg(
        F.max("l_quantity").cast("int").alias("q"), F.max("l_linenumber").alias("f"))
    slot = F.concat(F.lpad(F.when(F.col("q") == 50, F.lit(-9999)).otherwise(F.col("q")).cast("string"), 5, " "), F.lit(" "), F.when(F.col("f") == 7, "X").otherwise(" "), F.lit(" "))
    g = r.groupBy("s", "y", "m", "e").agg(F.map_from_entries(F.collect_list(F.struct("d", slot.alias("v")))).alias("_s"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(31)), lambda k: F.coalesce(F.element_at("_s", k), F.lit("-9999   "))), "")
    head = F.concat(F.rpad(F.concat(F.lit("ST"), F.col("s").cast("string")), 11, " "), F.col("y").cast("string"), F.lpad(F.col("m").cast("string"), 2, "0"), F.col("e"))
    return g.select(F.concat(head, body).alias("value"))


@query("src_station_fixed_width", with_sql(STX, "SELECT 'ST' || s AS station, make_date(y, m, d) AS date, e AS element, CAST(q / 10.0 AS DOUBLE) AS value FROM sr WHERE e <> 'XXXX' AND q <> 50 AND f <> 7"))
def src_station_fixed_width(spark, sf):
    """Monthly fixed-width records, written as text and parsed back."""
    path = scratch(spark)
    station_lines(spark, sf).write.text(path)
    return stations.read_station_daily(spark, path)


@query("src_station_inventory", f"SELECT 'AM' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS station, {q6('38.0 + (s_suppkey % 300) / 100.0')} AS lat, {q6('43.0 + (s_suppkey % 370) / 100.0')} AS lon, CAST(s_suppkey % 3000 AS DOUBLE) AS elevation, s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0")
def src_station_inventory(spark, sf):
    k = F.col("s_suppkey")
    num = lambda c, n, p: F.lpad(F.format_number(c, p), n, " ")
    line = F.concat(F.when(k % 5 != 0, "AM").otherwise("GG"), F.lpad(k.cast("string"), 9, "0"), F.lit(" "), num((k % 300) / 100.0 + 38.0, 8, 4), F.lit(" "),
                    num((k % 370) / 100.0 + 43.0, 9, 4), F.lit(" "), F.lpad(F.concat((k % 3000).cast("string"), F.lit(".0")), 6, " "), F.lit("    "), F.rpad("s_name", 30, " "))
    return rnd(stations.parse_station_inventory(B.table(spark, sf, "supplier").select(line.alias("value")), prefix="AM"))


@query("src_scaled_raster", f"SELECT p_partkey AS id, {q6('CASE WHEN p_size <> 50 THEN p_size * 0.1 - 273.15 END')} AS value FROM part")
def src_scaled_raster(spark, sf):
    p = B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("raw"))
    return rnd(D.decode_scaled(p, "raw", 0.1, -273.15, 50).select("id", "value"))


@query("src_flux_to_depth", f"SELECT o_orderkey AS id, {q6('o_totalprice / 1e9 * 86400')} AS value, 'mm day-1' AS unit FROM orders")
def src_flux_to_depth(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e9).alias("value"), F.lit("kg m-2 s-1").alias("unit"))
    return rnd(Tb.flux_to_depth(o))


@query("src_vapour_from_rh", with_sql(B.NODE_DAY, f"SELECT node, year, {bi('doy')} AS doy, {q6('least(rh * 1.4, 100.0) / 100.0 * ' + C.es('t_mean'))} AS ea FROM node_day"))
def src_vapour_from_rh(spark, sf):
    d = B.node_day(spark, sf)
    return rnd(Tb.vapour_from_humidity(d.select("node", "year", "doy", (F.col("rh") * 1.4).alias("value")), d.select("node", "year", "doy", F.col("t_mean").alias("value")), ["node", "year", "doy"]))


BOX = (43.4, 38.8, 46.7, 41.4)
INBOX = "lon BETWEEN 43.4 AND 46.7 AND lat BETWEEN 38.8 AND 41.4"


@query("src_occurrence_bbox", with_sql(B.OCCURRENCES, f"SELECT rec, species FROM occ WHERE {INBOX}"))
def src_occurrence_bbox(spark, sf):
    return Tb.clean_occurrences(B.occurrences(spark, sf), BOX).select("rec", "species")


@query("src_target_group_background", with_sql(B.OCCURRENCES, f"SELECT rec, species FROM occ WHERE {INBOX} AND species NOT IN ('ECONOMY', 'PROMO') ORDER BY {B.mix_sql('rec', seed=3)}, rec LIMIT 300"))
def src_target_group_background(spark, sf):
    o = Tb.clean_occurrences(B.occurrences(spark, sf), BOX)
    targets = o.filter(F.col("species").isin("ECONOMY", "PROMO"))
    return Tb.target_group_background(o, targets, 300, mix32("rec", seed=3), "rec").select("rec", "species")


def years_of(df, date: str) -> list[int]:
    """All years from the first to the last of a table."""
    lo, hi = df.agg(F.min(F.year(date)), F.max(F.year(date))).first()
    return list(range(lo, hi + 1))


@query("src_scenario_wide_to_long", f"SELECT o_orderpriority AS scenario, CAST(year(o_orderdate) AS BIGINT) AS year, {q6('sum(o_totalprice) / 1e6', 4)} AS ppm FROM orders GROUP BY 1, 2")
def src_scenario_wide_to_long(spark, sf):
    """Pathways with one column per year, back to rows."""
    o = B.table(spark, sf, "orders")
    w = o.groupBy(F.col("o_orderpriority").alias("scenario")).agg(
        *[(F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))) / 1e6).alias(str(y)) for y in years_of(o, "o_orderdate")])
    return rnd(Tb.wide_years_to_long(w, ["scenario"], "ppm"), 4)


@query("src_bands_wide_to_long", "SELECT l_suppkey AS pixel, CAST(y AS BIGINT) AS year, sum(CASE WHEN year(l_shipdate) = y THEN l_quantity END) AS kndvi FROM lineitem, (SELECT unnest(generate_series(min(year(l_shipdate)), max(year(l_shipdate)))) AS y FROM lineitem) r GROUP BY 1, 2")
def src_bands_wide_to_long(spark, sf):
    li = B.table(spark, sf, "lineitem")
    years = years_of(li, "l_shipdate")
    w = li.groupBy(F.col("l_suppkey").alias("pixel")).agg(
        *[F.sum(F.when(F.year("l_shipdate") == y, F.col("l_quantity"))).alias(f"kndvi_{y}") for y in years])
    return rnd(Tb.bands_to_long(w, ["pixel"], "kndvi_{year}", years, "kndvi"))


@query("src_trait_table", with_sql(C.TRAITS, f"SELECT id AS grp, {q6('p50')} AS p50, {q6('CASE WHEN id % 4 <> 0 THEN 0.3 END')} AS p50_sd, CASE WHEN id % 4 <> 0 AND id % 6 <> 1 THEN 'ok' ELSE 'skipped_no_trait_variance' END AS status FROM tr"))
def src_trait_table(spark, sf):
    """Trait rows written as CSV with comment lines, read back and joined with their spread."""
    t = C.traits(spark, sf)
    path = scratch(spark)
    head = spark.createDataFrame([("# traits per group",), ("grp,p50",)], "value string")
    body = t.select(F.concat_ws(",", F.col("id").cast("string"), F.col("p50").cast("string")).alias("value"))
    head.unionByName(body).filter(F.col("value") != "grp,p50").write.text(path)
    spread = t.filter(F.col("id") % 4 != 0).select(F.col("id").alias("grp"), F.lit(0.3).alias("p50_sd"), F.when(F.col("id") % 6 != 1, 8.0).alias("slope_sd"))
    got = Tb.join_trait_spread(spark.read.csv(path, comment="#", schema="grp long, p50 double"), spread)
    return rnd(got.select("grp", "p50", "p50_sd", "status"))


PAIR = ["pr AS (SELECT node, year, row_number() OVER (ORDER BY node, year) - 1 AS i FROM (SELECT DISTINCT node, year FROM node_day))",
        "pt AS (SELECT o_orderkey AS point, node, year FROM orders JOIN pr ON i = o_custkey % (SELECT count(*) FROM pr))",
        "w AS (SELECT node, year, grp, sum(pet - aet) AS cwd FROM bk WHERE pet_name = 'pm_fao56' GROUP BY 1, 2, 3)"]


@query("src_point_forcing", with_sql(QW.JOB + PAIR, f"SELECT point, year, grp, {q6('cwd', 4)} AS cwd FROM pt JOIN w USING (node, year)"))
def src_point_forcing(spark, sf):
    """Points get the water deficit of their own cell and year, by key, for every group."""
    from terrapanel.plans import water_balance as WB
    cap, soil = QW.job_capacity(spark, sf)
    w = WB.node_water_balance(QW.job_weather(spark, sf), cap, soil).filter(F.col("pet_name") == "pm_fao56").select("node", "year", "grp", "cwd")
    series = B.node_day(spark, sf).select("node", "year").distinct().withColumn("_cell", F.col("node") * 10_000 + F.col("year"))
    cells = dense_index(series, "_cell", "_i").drop("_cell")
    p = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("point"), (F.col("o_custkey") % series.agg(F.count(F.lit(1))).scalar()).alias("_i"))
    p = p.join(cells, "_i").drop("_i")
    return rnd(Tb.point_series(p, w, "point", ["node", "year"]).select("point", "year", "grp", "cwd"), 4)


@query("src_node_lattice", with_sql(B.RASTER, f"""SELECT "row", "col", {q6('41.4 - ("row" + 0.5) * (2.6 / 312)')} AS lat, {q6('43.4 + ("col" + 0.5) * (3.3 / 396)')} AS lon FROM ras WHERE "row" % 7 = 0 AND "col" % 7 = 0 AND "row" < 312 AND "col" < 396 AND inside"""))
def src_node_lattice(spark, sf):
    return rnd(Tb.node_lattice(B.raster(spark, sf), (43.4, 38.8, 46.7, 41.4), (312, 396), 7))


@query("src_dataset_select", "SELECT o_custkey AS node, count(*) AS n FROM orders GROUP BY 1")
def src_dataset_select(spark, sf):
    """A dense table that covers too few nodes gives way to the complete one."""
    o = B.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    full = o.count()
    chosen, log = Tb.select_dataset({"dense": o.filter(F.col("node") % 3 == 0), "base": o}, full)
    assert [x[2] for x in log] == ["rejected: coverage below the minimum", "used"]
    return chosen


@query("src_manifest_audit", "SELECT s_suppkey % 3 AS k, CASE WHEN s_suppkey % 3 = 2 THEN 'changed' ELSE 'ok' END AS status, count(*) AS n FROM supplier WHERE s_suppkey % 3 < 3 GROUP BY 1, 2")
def src_manifest_audit(spark, sf):
    """The table files are hashed and compared with a manifest that holds a wrong sum for every third supplier entry."""
    s = B.table(spark, sf, "supplier").select((F.col("s_suppkey") % 3).alias("k"))
    have = Tb.audit_files(spark, spark.createDataFrame([("supplier.parquet", "")], "path string, checksum string"), sf, "supplier.parquet").select("path", "actual")
    m = s.withColumn("path", F.lit("supplier.parquet")).join(have, "path").select("k", "path", F.when(F.col("k") == 2, "0" * 64).otherwise(F.col("actual")).alias("checksum"))
    a = Tb.audit_files(spark, m, sf, "supplier.parquet")
    return a.groupBy("k", "status").agg(F.count(F.lit(1)).alias("n"))


# ---- sinks ---------------------------------------------------------------------------------------------------

@query("snk_partitioned", with_sql(B.MEMBERS, f"SELECT ssp, {bi('horizon')} AS horizon, count(*) AS n, {q6('sum(v)')} AS v FROM mem GROUP BY 1, 2"))
def snk_partitioned(spark, sf):
    path = scratch(spark)
    sinks.write_results(B.members(spark, sf), path, ["ssp", "horizon"])
    return rnd(spark.read.parquet(path).groupBy("ssp", "horizon").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")))


@query("snk_json_clean", with_sql(B.POINTS, f"SELECT point, {q6('CASE WHEN point % 9 NOT IN (0, 4) THEN v END', 2)} AS v FROM pts"))
def snk_json_clean(spark, sf):
    """NaN and infinities leave as null; the file is read back."""
    p = B.points(spark, sf).select("point", F.when(F.col("point") % 9 == 0, float("nan")).when(F.col("point") % 9 == 4, float("inf")).otherwise(F.col("v")).alias("v"))
    path = scratch(spark)
    sinks.write_json(p, path, {"v": 2})
    return rnd(spark.read.schema("point long, v double").json(path), 2)


@query("snk_csv_rows", with_sql(B.BENEFITS + B.OPTIONS + B.PIXELS + QD.PLAN, f"SELECT u, {q6('lat', 5)} AS latitude, 'Region \"' || node || '\", north' AS region, area AS area_ha, grp AS species_group, {q6('cost')} AS cost_per_ha_usd, CAST(round(cost * area) AS DOUBLE) AS cost_usd, {q6('CASE WHEN u % 3 <> 0 THEN lon / 100 END', 5)} AS viability_mean FROM plan JOIN pixels ON pixel = u"))
def snk_csv_rows(spark, sf):
    """Plan rows exported as CSV (region names hold quotes and commas) and read back."""
    px = B.pixels(spark, sf)
    plan = QD.simple_plan(spark, sf).withColumn("method", F.lit("planting"))
    cells = px.select(F.col("pixel").alias("u"), "lat", "lon")
    regions = px.select(F.col("pixel").alias("u"), F.concat(F.lit('Region "'), F.col("node").cast("string"), F.lit('", north')).alias("region"))
    scores = plan.select("u", "grp").join(cells, "u").select("u", "grp", F.when(F.col("u") % 3 != 0, F.col("lon") / 100).alias("viability_mean"), F.lit(0.5).alias("viability_worst20pct"))
    rows = Pf.plan_rows(plan, cells, regions, scores)
    path = scratch(spark)
    sinks.write_csv(rows, path)
    back = spark.read.option("header", True).option("escape", '"').schema(rows.schema).csv(path)
    return rnd(back.select("u", "latitude", "region", "area_ha", "species_group", "cost_per_ha_usd", "cost_usd", "viability_mean"), 6, latitude=5, viability_mean=5)


@query("snk_resumable_members", with_sql(B.MEMBERS, f"SELECT gcm, ssp, {bi('horizon')} AS horizon, count(*) AS n_nodes, {q6('avg(v)')} AS mean_v FROM mem GROUP BY 1, 2, 3"))
def snk_resumable_members(spark, sf):
    """A first run writes one path's members, the second only the missing ones; the whole ensemble is read back."""
    m = B.members(spark, sf)
    f = ["gcm", "ssp", "horizon"]
    want, path = m.select(*f).distinct(), scratch(spark)
    job = lambda todo: m.join(todo, f, "left_semi")
    Sc.run_members(spark, want.filter(F.col("ssp") == "F"), job, path, f)
    out = Sc.run_members(spark, want, job, path, f)
    return rnd(out.groupBy(*f).agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("v").alias("mean_v")))
