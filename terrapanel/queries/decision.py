"""Portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.operators import portfolio as Pf
from terrapanel.queries import base as B
from terrapanel.queries.base import q6, query, rnd, with_sql
from terrapanel.tables import cut_lineage

BO = B.BENEFITS + B.OPTIONS
PLAN = ["pl0 AS (SELECT u, j, round(sum(b), 4) AS s FROM ben GROUP BY 1, 2)", "plan AS (SELECT o.u, o.j, o.area, o.cost, o.grp FROM opt o JOIN (SELECT u, j, row_number() OVER (PARTITION BY u ORDER BY s DESC, j) AS k FROM pl0) p ON p.u = o.u AND p.j = o.j AND k = 1 WHERE eligible)"]


def simple_plan(spark, sf):
    """The option of the largest total benefit per unit, where it is eligible."""
    s = B.benefits(spark, sf).groupBy("u", "j").agg(F.round(F.sum("b"), 4).alias("s"))
    best = s.groupBy("u").agg(F.min(F.struct((-F.col("s")).alias("s"), "j")).alias("m")).select("u", F.col("m.j").alias("j"))
    return B.options(spark, sf).filter("eligible").join(best, ["u", "j"])


EVAL = PLAN + ["ev AS (SELECT c, coalesce(sum(b * area), 0.0) AS bc, 1.0 / count(*) OVER () AS w FROM (SELECT DISTINCT c FROM ben) s LEFT JOIN (SELECT ben.c, b, area FROM plan JOIN ben USING (u, j)) x USING (c) GROUP BY c)",
               "ec AS (SELECT *, sum(w) OVER (ORDER BY bc, c) - w AS before FROM ev)"]


@query("agg_portfolio_eval", with_sql(BO + EVAL, f"SELECT {q6('sum(w * bc)', 4)} AS expected, {q6('sum(CASE WHEN before < 1 - 0.6 - 1e-12 THEN w * bc END) / sum(CASE WHEN before < 1 - 0.6 - 1e-12 THEN w END)', 4)} AS cvar, {q6('min(bc)', 4)} AS worst, count(*) AS n_scenarios FROM ec"))
def agg_portfolio_eval(spark, sf):
    return rnd(Pf.evaluate_plan(simple_plan(spark, sf), B.benefits(spark, sf), alpha=0.6), 4)


@query("agg_extrapolation_footprint", with_sql(BO + PLAN + ["x AS (SELECT u, b * area / (SELECT count(DISTINCT c) FROM ben) AS v FROM plan JOIN ben USING (u, j))"],
    f"SELECT {q6('sum(v)', 4)} AS total, {q6('sum(CASE WHEN u % 4 = 0 OR u % 7 = 3 THEN v ELSE 0.0 END)', 4)} AS outside, {q6('sum(CASE WHEN u % 4 = 0 OR u % 7 = 3 THEN v ELSE 0.0 END) / sum(v)')} AS share FROM x"))
def agg_extrapolation_footprint(spark, sf):
    inside = B.stations(spark, sf).filter(F.col("node") % 7 != 3).select(F.col("node").alias("u"), (F.col("node") % 4 != 0).alias("inside"))
    return rnd(Pf.extrapolation_footprint(simple_plan(spark, sf), B.benefits(spark, sf), inside), 6, total=4, outside=4)


@query("agg_allocation", with_sql(BO + PLAN, f"""SELECT 'method' AS level, j AS name, count(*) AS units, {q6('sum(area)')} AS area_ha, {q6('sum(area * cost)')} AS cost_usd FROM plan GROUP BY j
    UNION ALL SELECT 'group', grp, count(*), {q6('sum(area)')}, {q6('sum(area * cost)')} FROM plan GROUP BY grp UNION ALL SELECT 'total', 'all', count(*), {q6('sum(area)')}, {q6('sum(area * cost)')} FROM plan"""))
def agg_allocation(spark, sf):
    return rnd(Pf.allocation(simple_plan(spark, sf).withColumn("method", F.col("j"))))


@query("agg_region_table", with_sql(BO + PLAN, "SELECT s_nationkey AS region, count(*) AS cells, sum(area) AS area_ha FROM plan JOIN supplier ON s_suppkey = u GROUP BY 1".replace("s_nationkey AS region", "CAST(s_nationkey AS BIGINT) AS region")))
def agg_region_table(spark, sf):
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("u"), F.col("s_nationkey").alias("region"))
    return rnd(Pf.region_table(simple_plan(spark, sf).join(s, "u")))


DO = ["d AS (SELECT o.u, o.j, o.area, o.cost * o.area AS cost, o.eligible, s.c, coalesce(b, 0.0) * o.area AS b FROM opt2 o CROSS JOIN (SELECT DISTINCT c FROM ben2) s LEFT JOIN ben2 x ON x.u = o.u AND x.j = o.j AND x.c = s.c)",
      "pr AS (SELECT a.j, b.j AS k, bool_and(CASE WHEN a.eligible THEN b.eligible AND b.cost <= a.cost AND b.b >= a.b END) AS covers, bool_and(CASE WHEN a.eligible THEN b.cost = a.cost AND b.b = a.b END) AS same, bool_and(a.eligible = b.eligible) AS elig FROM d a JOIN d b ON a.u = b.u AND a.c = b.c AND a.j <> b.j GROUP BY 1, 2)"]
TWIN = ["ben2 AS (SELECT * FROM ben UNION ALL SELECT u, j || '_TWIN', c, b FROM ben WHERE j IN ('ECONOMY', 'PROMO') UNION ALL SELECT u, j || '_WORSE', c, b * 0.5 FROM ben WHERE j = 'SMALL')",
        "opt2 AS (SELECT u, j, area, cost, TRUE AS eligible FROM opt UNION ALL SELECT u, j || '_TWIN', area, cost, TRUE FROM opt WHERE j IN ('ECONOMY', 'PROMO') UNION ALL SELECT u, j || '_WORSE', area, cost, TRUE FROM opt WHERE j = 'SMALL')"]


@query("top_dominance_prune", with_sql(BO + TWIN + DO, "SELECT j, min(k) AS by FROM pr WHERE coalesce(covers AND (NOT (same AND elig) OR k < j), covers IS NULL) GROUP BY 1"))
def top_dominance_prune(spark, sf):
    """Removed options and what replaces them: two exact twins and one worse copy are planted among the options."""
    b, o = B.benefits(spark, sf), B.options(spark, sf).withColumn("eligible", F.lit(True))
    twin = lambda d: d.filter(F.col("j").isin("ECONOMY", "PROMO")).withColumn("j", F.concat("j", F.lit("_TWIN")))
    worse = lambda d: d.filter(F.col("j") == "SMALL").withColumn("j", F.concat("j", F.lit("_WORSE")))
    b2 = b.unionByName(twin(b)).unionByName(worse(b).withColumn("b", F.col("b") * 0.5))
    return Pf.dominated(o.unionByName(twin(o)).unionByName(worse(o)), b2)


def portfolio(spark, sf):
    """The portfolio, and what the dearest eligible option of every unit would cost; budgets are shares of that."""
    options = cut_lineage(B.options(spark, sf))
    o = options.filter("eligible").groupBy("u").agg(F.max(F.col("area") * F.col("cost")).alias("c"))
    return Pf.Portfolio(options, B.benefits(spark, sf)), float(o.agg(F.sum("c")).first()[0] or 0.0)


COLS = ["budget", "lam", "share", "expected", "cvar", "bound", "gap", "units", "area", "cost"]
SCHEMA = "budget double, lam double, share double, expected double, cvar double, bound double, gap double, units long, area double, cost double"


def figures(spark, results):
    rows = [tuple(int(r[c]) if c == "units" else float(r[c]) for c in COLS) for r in results]
    return spark.createDataFrame(rows, SCHEMA)


@query("top_portfolio")
def top_portfolio(spark, sf):
    """Chosen option per unit at a third of the full cost (rows only: the exact optimum is not promised)."""
    p, full = portfolio(spark, sf)
    r = p.solve(full * 0.3)
    return rnd(r["plan"].select("u", "j", "grp", "area", "cost"))


@query("top_frontier")
def top_frontier(spark, sf):
    """Mean against tail at six settings, with the bound and gap of each plan."""
    p, full = portfolio(spark, sf)
    plans, _ = Pf.frontier(p, full * 0.3)
    return rnd(figures(spark, plans), 3)


@query("top_budget_sweep")
def top_budget_sweep(spark, sf):
    """Five budgets without a cap and one with a cap on the share of any group."""
    p, full = portfolio(spark, sf)
    r = Pf.budget_sweep(p, [full * s for s in (0.05, 0.1, 0.2, 0.3, 0.6)])
    return rnd(figures(spark, r + Pf.budget_sweep(p, [full * 0.3], (0.5,))), 3)
