"""Scenario-ensemble queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions import ecology as E
from terrapanel.operators import ensemble as En
from terrapanel.queries import base as B
from terrapanel.queries import windows as QW
from terrapanel.queries.base import bi, q6, query, rnd, with_sql

MEM = B.MEMBERS
FACTORS = ["gcm", "ssp", "horizon"]
MAIN = ["tot AS (SELECT node, var_pop(value) AS t FROM mem GROUP BY 1)"] + [
    f"m_{f} AS (SELECT node, var_pop(m) AS v FROM (SELECT node, {f}, avg(value) AS m FROM mem GROUP BY 1, 2) GROUP BY 1)" for f in FACTORS] + [
    f"p_{a}_{b} AS (SELECT node, var_pop(m) AS v FROM (SELECT node, {a}, {b}, avg(value) AS m FROM mem GROUP BY 1, 2, 3) GROUP BY 1)"
    for a, b in (("gcm", "ssp"), ("gcm", "horizon"), ("ssp", "horizon"))] + [
    """fr AS (SELECT node, m_gcm.v / t AS gcm, m_ssp.v / t AS ssp, m_horizon.v / t AS horizon, greatest(0.0, p_gcm_ssp.v - m_gcm.v - m_ssp.v) / t AS gcm_x_ssp,
        greatest(0.0, p_gcm_horizon.v - m_gcm.v - m_horizon.v) / t AS gcm_x_horizon, greatest(0.0, p_ssp_horizon.v - m_ssp.v - m_horizon.v) / t AS ssp_x_horizon
        FROM tot JOIN m_gcm USING (node) JOIN m_ssp USING (node) JOIN m_horizon USING (node) JOIN p_gcm_ssp USING (node) JOIN p_gcm_horizon USING (node) JOIN p_ssp_horizon USING (node))""",
    "f3 AS (SELECT *, greatest(0.0, 1.0 - gcm - ssp - horizon - gcm_x_ssp - gcm_x_horizon - ssp_x_horizon) AS remainder, 1.0 - gcm - ssp - horizon AS interaction FROM fr)"]
TWO = ["gcm_x_ssp", "gcm_x_horizon", "ssp_x_horizon"]
ALL = FACTORS + TWO + ["remainder", "interaction"]


@query("agg_factorial_check", with_sql(MEM, f"SELECT gcm, count(*) AS n FROM mem GROUP BY gcm"))  # noqa: F541
def agg_factorial_check(spark, sf):
    """Rows per model of a checked ensemble; an incomplete factorial raises."""
    return En.factorial_check(B.members(spark, sf), FACTORS, "node").groupBy("gcm").agg(F.count(F.lit(1)).alias("n"))


@query("agg_anova_fractions", with_sql(MEM + MAIN, f"SELECT node, TRUE AS used, {q6('gcm')} AS gcm, {q6('ssp')} AS ssp, {q6('horizon')} AS horizon, {q6('greatest(0.0, interaction)')} AS interaction FROM f3"))
def agg_anova_fractions(spark, sf):
    return rnd(En.anova_fractions(B.members(spark, sf), ["node"], FACTORS))


@query("agg_three_way_fractions", with_sql(MEM + MAIN, "SELECT node, TRUE AS used, " + ", ".join(f"{q6(c)} AS {c}" for c in ALL) + " FROM f3"))
def agg_three_way_fractions(spark, sf):
    return rnd(En.three_way_fractions(B.members(spark, sf), ["node"], FACTORS))


@query("agg_partition_nodes", with_sql(MEM + ["ht AS (SELECT node, horizon, var_pop(value) AS t FROM mem GROUP BY 1, 2)",
    "hg AS (SELECT node, horizon, var_pop(m) AS v FROM (SELECT node, horizon, gcm, avg(value) AS m FROM mem GROUP BY 1, 2, 3) GROUP BY 1, 2)",
    "hs AS (SELECT node, horizon, var_pop(m) AS v FROM (SELECT node, horizon, ssp, avg(value) AS m FROM mem GROUP BY 1, 2, 3) GROUP BY 1, 2)"],
    f"SELECT node, {bi('horizon')} AS horizon, TRUE AS used, {q6('hg.v / t')} AS gcm, {q6('hs.v / t')} AS ssp, {q6('greatest(0.0, 1.0 - hg.v / t - hs.v / t)')} AS interaction FROM ht JOIN hg USING (node, horizon) JOIN hs USING (node, horizon)"))
def agg_partition_nodes(spark, sf):
    """The two-factor split at each horizon."""
    return rnd(En.anova_fractions(B.members(spark, sf), ["node", "horizon"], ["gcm", "ssp"]))


@query("agg_partition_summary", with_sql(MEM + MAIN, " UNION ALL ".join(
    f"SELECT '{c}' AS fraction, {q6(f'quantile_cont({c}, 0.5)')} AS median, {q6(f'quantile_cont({c}, 0.25)')} AS q25, {q6(f'quantile_cont({c}, 0.75)')} AS q75 FROM f3" for c in ALL)))
def agg_partition_summary(spark, sf):
    return rnd(En.partition_summary(En.three_way_fractions(B.members(spark, sf), ["node"], FACTORS), ALL))


@query("agg_sobol", """WITH r AS (SELECT l_linenumber AS i, l_quantity / 50.0 AS a, l_extendedprice / 105000.0 AS b, l_discount * 10 AS c FROM lineitem), s AS (SELECT CAST(i AS BIGINT) AS input, a, b, CASE WHEN i <= 3 THEN c ELSE a * 0.5 + c * 0.5 END AS ab FROM r),
    v AS (SELECT input, avg(b * (ab - a)) AS s1, 0.5 * avg((a - ab) * (a - ab)) AS st, (sum(a * a) + sum(b * b)) / (2 * count(*)) - pow((sum(a) + sum(b)) / (2 * count(*)), 2) AS v FROM s GROUP BY 1)
    SELECT input, round(s1 / v, 6) AS s1, round(st / v, 6) AS st FROM v""")
def agg_sobol(spark, sf):
    li = B.table(spark, sf, "lineitem")
    a, c = F.col("l_quantity") / 50.0, F.col("l_discount") * 10
    r = li.select(F.col("l_linenumber").alias("input"), a.alias("fa"), (F.col("l_extendedprice") / 105000.0).alias("fb"),
                  F.when(F.col("l_linenumber") <= 3, c).otherwise(a * 0.5 + c * 0.5).alias("fab"))
    return rnd(En.sobol(r))


@query("agg_robust_refugium", with_sql(MEM + ["r AS (SELECT node, avg(CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END) AS p FROM mem GROUP BY 1)"],
    f"SELECT node, {q6('p')} AS p_viable, p >= 0.6 AND node % 3 <> 0 AND (node - 4.0) > 0 AS robust FROM r"))
def agg_robust_refugium(spark, sf):
    """All three criteria: share of viable members, positive buffer index, inside the area of applicability."""
    m = B.members(spark, sf)
    n = m.select("node").distinct()
    buffer = n.select("node", F.when(F.col("node") > 2, F.col("node") - 4.0).alias("buffer"))
    aoa = n.filter(F.col("node") != 21).select("node", (F.col("node") % 3 != 0).alias("inside"))
    return rnd(En.robust_cells(m, ["node"], v_star=0.5, rho=0.6, buffer=buffer, aoa=aoa).select("node", "p_viable", "robust"))


@query("agg_refugium_score", with_sql(MEM, f"SELECT node, {q6('quantile_cont(v, 0.5) - 0.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))')} AS score FROM mem GROUP BY 1"))
def agg_refugium_score(spark, sf):
    return rnd(En.risk_averse_score(B.members(spark, sf), ["node"]))


@query("agg_member_summary", with_sql(MEM, f"SELECT node, {q6('avg(v)')} AS mean, {q6('quantile_cont(v, 0.1)')} AS p10, {q6('quantile_cont(v, 0.9)')} AS p90, {q6('avg(CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END)')} AS p_viable, {q6('stddev_pop(v)')} AS sd FROM mem GROUP BY 1"))
def agg_member_summary(spark, sf):
    return rnd(En.member_summary(B.members(spark, sf), ["node"], v_star=0.5))


@query("agg_ensemble_by_path", with_sql(MEM + ["a AS (SELECT gcm, ssp, horizon, avg(v) AS m FROM mem GROUP BY 1, 2, 3)"], f"SELECT ssp, {bi('horizon')} AS horizon, {q6('avg(m)')} AS mean, {q6('min(m)')} AS min, {q6('max(m)')} AS max, count(*) AS n_models FROM a GROUP BY 1, 2"))
def agg_ensemble_by_path(spark, sf):
    return rnd(En.by_path(B.members(spark, sf), "gcm", ["ssp", "horizon"], "v"))


@query("agg_worst20", with_sql(MEM, f"SELECT node, {q6('avg(v)')} AS worst FROM (SELECT node, v, row_number() OVER (PARTITION BY node ORDER BY v) AS k, count(*) OVER (PARTITION BY node) AS n FROM mem) WHERE k <= greatest(ceil(0.2 * n), 1) GROUP BY 1"))
def agg_worst20(spark, sf):
    return rnd(En.worst_share(B.members(spark, sf), ["node"], "v"))


@query("agg_treeline_shift", with_sql(B.NODE_DAY + ["dl AS (SELECT CAST(c_nationkey AS BIGINT) AS nk, o_orderpriority AS gcm, avg(o_totalprice) / 100000.0 AS dt FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
    "g0 AS (SELECT node, year, avg(t_mean) FILTER (WHERE t_mean >= 0.9) AS g FROM node_day GROUP BY 1, 2)",
    "g1 AS (SELECT node, year, gcm, avg(t_mean + dt) FILTER (WHERE t_mean + dt >= 0.9) AS g FROM node_day JOIN dl ON nk = node % 25 GROUP BY 1, 2, 3)"],
    f"SELECT node, year, gcm, {q6('(6.45 - g1.g) / -0.0055 - (6.45 - g0.g) / -0.0055', 5)} AS shift FROM g1 JOIN g0 USING (node, year)"))
def agg_treeline_shift(spark, sf):
    """Treeline of each member minus the baseline treeline, per node and year."""
    from terrapanel.plans.scenario import treeline_shift
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = o.groupBy(F.col("c_nationkey").cast("bigint").alias("nk"), F.col("o_orderpriority").alias("gcm")).agg((F.avg("o_totalprice") / 100000.0).alias("dt"))
    nd = B.node_day(spark, sf).select("node", "year", "doy", "t_mean", (F.col("node") % 25).alias("nk"))
    return rnd(treeline_shift(nd, d, ["nk"], ["gcm"], z_ref=F.lit(800.0), gamma=F.lit(-0.0055)), 5)


__all__ = ["E", "QW"]
