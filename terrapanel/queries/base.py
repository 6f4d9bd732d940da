"""Registry, stand-in tables and the SQL text of the same stand-ins.

The given tables hold no climate records, so each query binds an operator to a stand-in: events play the daily
node series, line items the pixel-by-month series, orders the node climate and the scenario members, parts the
raster, customers and suppliers the points. All maps from columns to stand-ins are plain arithmetic written on
both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.numeric import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under the operator's name."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rnd(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Round every double column (``special`` overrides the places per column); counts become bigint."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            out.append(rounded(F.col(f.name), special.get(f.name, places)).alias(f.name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def q6(expr: str, places: int = 6) -> str:
    """SQL text that rounds like ``rounded``."""
    e = f"CAST({expr} AS DOUBLE)"
    return f"(CASE WHEN abs({e}) < {0.5 * 10.0 ** -places!r} THEN 0.0 ELSE round({e}, {places}) END)"


def bi(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def with_sql(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


# ---- daily node series from events ------------------------------------------------------------

def node_day(spark: SparkSession, sf: str) -> DataFrame:
    """One row per node, year and day (days without events included).

    Days from the 16th of the record on are moved to the next year, so a node has the same days of the year twice.
    """
    e = table(spark, sf, "events").select(F.col("user_id").alias("node"), F.to_date("ts").alias("date"), "value")
    day = e.groupBy("node", "date").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    lo, hi = e.agg(F.min("date")).scalar(), e.agg(F.max("date")).scalar()
    full = e.select("node").distinct().withColumn("date", F.explode(F.sequence(lo, hi)))
    d = full.join(day, ["node", "date"], "left")
    moved = F.add_months(F.date_sub("date", 15), 12)
    d = d.withColumn("date", F.when(F.datediff("date", lo) >= 15, moved).otherwise(F.col("date")))
    n = F.coalesce("n", F.lit(0)).cast("double")
    v = F.coalesce("v", F.lit(0.0)) * 0.6
    d = d.select("node", "date", F.year("date").cast("bigint").alias("year"), F.dayofyear("date").alias("doy"), F.month("date").alias("month"), n.alias("n"), v.alias("v"))
    t = F.col("v") * 0.12 - 4.0
    d = d.withColumn("t_mean", t).withColumn("t_max", F.col("t_mean") + 3.0 + F.col("n"))
    d = d.withColumn("t_min", F.col("t_mean") - 3.0 - F.col("n") * 0.5)
    d = d.withColumn("p", F.when(F.col("n") >= 3, (F.col("n") - 2.0) * 4.0).otherwise(0.0))
    d = d.withColumn("rh", F.least(F.lit(40.0) + F.col("n") * 5.0, F.lit(95.0)))
    d = d.withColumn("u2", F.col("n") * 0.2 + 1.0).withColumn("rn", F.col("v") * 0.06 + 6.0)
    return d


NODE_DAY = [
    "ev AS (SELECT user_id AS node, CAST(ts AS DATE) AS date, count(*) AS n, max(value) AS v FROM events GROUP BY 1, 2)",
    "span AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events)",
    "users AS (SELECT DISTINCT user_id AS node FROM events)",
    "days AS (SELECT node, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM users, span)",
    """kept AS (SELECT node, CASE WHEN date - lo >= 15 THEN CAST(date - 15 + INTERVAL 1 YEAR AS DATE) ELSE date END AS date, n, v
        FROM days LEFT JOIN ev USING (node, date))""",
    """nd0 AS (SELECT node, date, year(date) AS year, dayofyear(date) AS doy, month(date) AS month,
        CAST(coalesce(n, 0) AS DOUBLE) AS n, coalesce(v, 0.0) * CAST(0.6 AS DOUBLE) AS v FROM kept)""",
    "nd1 AS (SELECT *, v * CAST(0.12 AS DOUBLE) - 4.0 AS t_mean FROM nd0)",
    """node_day AS (SELECT *, t_mean + 3.0 + n AS t_max, t_mean - 3.0 - n * CAST(0.5 AS DOUBLE) AS t_min,
        CASE WHEN n >= 3 THEN (n - 2.0) * 4.0 ELSE 0.0 END AS p, least(40.0 + n * 5.0, 95.0) AS rh,
        n * CAST(0.2 AS DOUBLE) + 1.0 AS u2, v * CAST(0.06 AS DOUBLE) + 6.0 AS rn FROM nd1)""",
]


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Static inputs of the nodes."""
    k = F.col("node")
    d = lambda e: e.cast("double")
    return table(spark, sf, "events").select(F.col("user_id").alias("node")).distinct().select(
        "node", (d((k * 37) % 2000) + 300.0).alias("z"), F.lit(800.0).alias("z_ref"),
        (d((k * 13) % 26) * 0.1 + 38.8).alias("lat"), (d((k * 7) % 33) * 0.1 + 43.4).alias("lon"),
        d((k * 11) % 40).alias("slope"), d((k * 29) % 360).alias("aspect"), (d(k % 7) - 2.0).alias("concavity"),
        F.lit(0.3).alias("calm"), (d((k * 17) % 50) + 20.0).alias("sand"), (d((k * 23) % 30) + 5.0).alias("clay"),
        (d((k * 3) % 30) + 5.0).alias("soc"), (d(k % 5) * 10.0 + 30.0).alias("w_max"))


NODES = [
    """nodes AS (SELECT node, CAST((node * 37) % 2000 AS DOUBLE) + 300.0 AS z, CAST(800.0 AS DOUBLE) AS z_ref,
        CAST((node * 13) % 26 AS DOUBLE) * CAST(0.1 AS DOUBLE) + CAST(38.8 AS DOUBLE) AS lat,
        CAST((node * 7) % 33 AS DOUBLE) * CAST(0.1 AS DOUBLE) + CAST(43.4 AS DOUBLE) AS lon,
        CAST((node * 11) % 40 AS DOUBLE) AS slope, CAST((node * 29) % 360 AS DOUBLE) AS aspect,
        CAST(node % 7 AS DOUBLE) - 2.0 AS concavity, CAST(0.3 AS DOUBLE) AS calm,
        CAST((node * 17) % 50 AS DOUBLE) + 20.0 AS sand, CAST((node * 23) % 30 AS DOUBLE) + 5.0 AS clay,
        CAST((node * 3) % 30 AS DOUBLE) + 5.0 AS soc, CAST(node % 5 AS DOUBLE) * 10.0 + 30.0 AS w_max
        FROM (SELECT DISTINCT user_id AS node FROM events))""",
]


def months(spark: SparkSession) -> DataFrame:
    """Twelve rows of monthly lapse rate and precipitation gradient."""
    m = F.col("id").cast("double")
    return spark.range(1, 13).select(F.col("id").cast("int").alias("month"), (m * 0.0001 - 0.0065).alias("gamma"),
                                     (m * 0.00001 + 0.0001).alias("grad"))


MONTHS = ["""months AS (SELECT CAST(m AS INTEGER) AS month, m * CAST(0.0001 AS DOUBLE) - CAST(0.0065 AS DOUBLE) AS gamma,
    m * CAST(0.00001 AS DOUBLE) + CAST(0.0001 AS DOUBLE) AS grad FROM range(1, 13) t(m))"""]


# ---- pixel series from line items -------------------------------------------------------------

def pixel_month(spark: SparkSession, sf: str) -> DataFrame:
    """(pixel, period) with value x, number of observations and the disturbance flag; months play the years."""
    li = table(spark, sf, "lineitem")
    period = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    return li.groupBy(F.col("l_suppkey").alias("pixel"), period.cast("bigint").alias("period")).agg(
        F.sum("l_quantity").alias("x"), F.count(F.lit(1)).alias("valid_count"),
        (~F.max((F.col("l_discount") >= 0.1) & (F.col("l_tax") >= 0.08))).alias("nd"))


PIXEL_MONTH = ["""pm AS (SELECT l_suppkey AS pixel, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS period,
    sum(l_quantity) AS x, count(*) AS valid_count,
    NOT bool_or(l_discount >= CAST(0.1 AS DOUBLE) AND l_tax >= CAST(0.08 AS DOUBLE)) AS nd FROM lineitem GROUP BY 1, 2)"""]


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    return s.select(k.alias("pixel"), F.col("s_nationkey").cast("bigint").alias("node"),
                    (((k * 7919) % 3300).cast("double") / 1000.0 + 43.4).alias("lon"),
                    (((k * 104729) % 2600).cast("double") / 1000.0 + 38.8).alias("lat"),
                    (k % 7 + 31).alias("forest_class"), ((k * 3) % 20 + 5).cast("double").alias("height"),
                    ((k * 31) % 2500).cast("double").alias("elevation"))


PIXELS = ["""pixels AS (SELECT s_suppkey AS pixel, CAST(s_nationkey AS BIGINT) AS node,
    CAST((s_suppkey * 7919) % 3300 AS DOUBLE) / 1000.0 + CAST(43.4 AS DOUBLE) AS lon,
    CAST((s_suppkey * 104729) % 2600 AS DOUBLE) / 1000.0 + CAST(38.8 AS DOUBLE) AS lat,
    s_suppkey % 7 + 31 AS forest_class, CAST((s_suppkey * 3) % 20 + 5 AS DOUBLE) AS height,
    CAST((s_suppkey * 31) % 2500 AS DOUBLE) AS elevation FROM supplier)"""]


def node_month(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly climate of a node: four numbers from the orders of a nation's customers."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    period = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("bigint")
    price = F.col("o_totalprice") / 1000.0
    return o.groupBy(F.col("c_nationkey").cast("bigint").alias("node"), period.alias("period")).agg(
        F.avg(price).alias("cwd"), F.max(price).alias("vpd"), F.count(F.lit(1)).cast("double").alias("gdd"),
        F.min(price).alias("tm"))


NODE_MONTH = ["""nm AS (SELECT CAST(c_nationkey AS BIGINT) AS node,
    CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS period, avg(o_totalprice / 1000.0) AS cwd,
    max(o_totalprice / 1000.0) AS vpd, CAST(count(*) AS DOUBLE) AS gdd, min(o_totalprice / 1000.0) AS tm
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""]


# ---- scenario members from orders --------------------------------------------------------------

def members(spark: SparkSession, sf: str) -> DataFrame:
    """(node, gcm, ssp, horizon, value, v): priority, status and period of the orders play the factors."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    horizon = F.when(F.year("o_orderdate") <= 1996, 2050).when(F.year("o_orderdate") <= 1998, 2080).otherwise(2100)
    m = o.groupBy(F.col("c_nationkey").cast("bigint").alias("node"), F.col("o_orderpriority").alias("gcm"),
                  F.col("o_orderstatus").alias("ssp"), horizon.alias("horizon")).agg(
        (F.avg("o_totalprice") / 1000.0).alias("value"))
    return m.withColumn("v", F.col("value") / 500.0)


MEMBERS = ["""mem AS (SELECT *, value / 500.0 AS v FROM (SELECT CAST(c_nationkey AS BIGINT) AS node, o_orderpriority AS gcm,
    o_orderstatus AS ssp, CASE WHEN year(o_orderdate) <= 1996 THEN 2050 WHEN year(o_orderdate) <= 1998 THEN 2080 ELSE 2100 END AS horizon,
    avg(o_totalprice) / 1000.0 AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4))"""]


# ---- points and raster ---------------------------------------------------------------------------

def points(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as points with projected coordinates x, y (whole units), a value and an elevation."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    return c.select(k.alias("point"), ((k * 7919) % 10007).cast("double").alias("x"), ((k * 104729) % 10009).cast("double").alias("y"),
                    F.col("c_acctbal").alias("v"), ((k * 31) % 2500).cast("double").alias("z"),
                    F.col("c_nationkey").cast("bigint").alias("grp"))


POINTS = ["""pts AS (SELECT c_custkey AS point, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x,
    CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y, c_acctbal AS v, CAST((c_custkey * 31) % 2500 AS DOUBLE) AS z,
    CAST(c_nationkey AS BIGINT) AS grp FROM customer)"""]


def stations(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as interpolation nodes on the same plane."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    return s.select(k.alias("node"), ((k * 7907) % 10007).cast("double").alias("x"), ((k * 104723) % 10009).cast("double").alias("y"),
                    F.col("s_acctbal").alias("v"), ((k * 37) % 2500).cast("double").alias("z"),
                    F.col("s_nationkey").cast("bigint").alias("grp"))


STATIONS = ["""sts AS (SELECT s_suppkey AS node, CAST((s_suppkey * 7907) % 10007 AS DOUBLE) AS x,
    CAST((s_suppkey * 104723) % 10009 AS DOUBLE) AS y, s_acctbal AS v, CAST((s_suppkey * 37) % 2500 AS DOUBLE) AS z,
    CAST(s_nationkey AS BIGINT) AS grp FROM supplier)"""]


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as a raster 50 columns wide: value, class and two fractions per pixel."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select(F.floor(k / 50).alias("row"), (k % 50).alias("col"), F.col("p_retailprice").alias("value"),
                    (F.col("p_size") % 12 + 28).cast("bigint").alias("class"),
                    (F.col("p_size") / 100.0).alias("open"), (k % 9 != 0).alias("inside"))


RASTER = ["""ras AS (SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS "row", p_partkey % 50 AS "col", p_retailprice AS value,
    CAST(p_size % 12 + 28 AS BIGINT) AS class, p_size / 100.0 AS open, p_partkey % 9 <> 0 AS inside FROM part)"""]


# ---- scored records --------------------------------------------------------------------------------

def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as forecasts p of a binary outcome y; p has many distinct values and some ties."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("line"),
                     (F.col("l_extendedprice") / 110000.0).alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("y"),
                     F.col("l_quantity").alias("obs"), (F.col("l_extendedprice") / 2100.0).alias("pred"),
                     F.col("l_discount").alias("width"), F.col("l_linestatus").alias("part"))


SCORED = ["""sc AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS line, l_extendedprice / 110000.0 AS p,
    CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, l_quantity AS obs, l_extendedprice / 2100.0 AS pred,
    l_discount AS width, l_linestatus AS part FROM lineitem)"""]


# ---- planting options ---------------------------------------------------------------------------------

def benefits(spark: SparkSession, sf: str) -> DataFrame:
    """(u, j, c, b): supplier x part type x ship year, benefit per hectare from quantities."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("l_suppkey").alias("u"), F.col("p_type").alias("j"), F.year("l_shipdate").cast("bigint").alias("c")).agg(
        (F.sum("l_quantity") / 100.0).alias("b"))


BENEFITS = ["""ben AS (SELECT l_suppkey AS u, p_type AS j, CAST(year(l_shipdate) AS BIGINT) AS c, sum(l_quantity) / 100.0 AS b
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""]


def options(spark: SparkSession, sf: str) -> DataFrame:
    """(u, j, area, cost, eligible, grp): one row per unit and option seen in the line items."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("l_suppkey").alias("u"), F.col("p_type").alias("j")).agg(
        (F.col("u") % 5 + 1).cast("double").alias("area"), (F.max("l_extendedprice") / 1000.0).alias("cost"),
        (F.max("l_discount") >= 0.1).alias("eligible"), F.substring("j", 1, 1).alias("grp"))


OPTIONS = ["""opt AS (SELECT l_suppkey AS u, p_type AS j, CAST(l_suppkey % 5 + 1 AS DOUBLE) AS area,
    max(l_extendedprice) / 1000.0 AS cost, max(l_discount) >= CAST(0.1 AS DOUBLE) AS eligible, substr(p_type, 1, 1) AS grp
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type)"""]


# ---- occurrence records -----------------------------------------------------------------------------------

def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as occurrence records of a species (type) with coordinates and four predictors."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select(k.alias("rec"), F.col("p_type").alias("species"),
                    (((k * 7919) % 3700).cast("double") / 1000.0 + 43.2).alias("lon"),
                    F.when(k % 97 != 0, ((k * 104729) % 3000).cast("double") / 1000.0 + 38.6).alias("lat"),
                    (F.col("p_size") / 10.0).alias("f0"), ((F.col("p_retailprice") - 900.0) / 25.0).alias("f1"),
                    ((k * 31) % 100).cast("double").alias("f2"), ((k * 17) % 50).cast("double").alias("f3"))


OCCURRENCES = ["""occ AS (SELECT p_partkey AS rec, p_type AS species,
    CAST((p_partkey * 7919) % 3700 AS DOUBLE) / 1000.0 + CAST(43.2 AS DOUBLE) AS lon,
    CASE WHEN p_partkey % 97 <> 0 THEN CAST((p_partkey * 104729) % 3000 AS DOUBLE) / 1000.0 + CAST(38.6 AS DOUBLE) END AS lat,
    p_size / 10.0 AS f0, (p_retailprice - 900.0) / 25.0 AS f1, CAST((p_partkey * 31) % 100 AS DOUBLE) AS f2,
    CAST((p_partkey * 17) % 50 AS DOUBLE) AS f3 FROM part)"""]


def mix_sql(*keys: str, seed: int = 0) -> str:
    """SQL text of the integer hash ``mix32``."""
    text = f"concat_ws('|', '{int(seed)}', " + ", ".join(f"CAST({k} AS BIGINT)" for k in keys) + ")"
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def uniform_sql(*keys: str, seed: int = 0) -> str:
    return f"((CAST({mix_sql(*keys, seed=seed)} AS DOUBLE) + 0.5) / 4294967296.0)"
