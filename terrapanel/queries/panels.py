"""Pixel-panel queries: year effect, onsets, person-years, event rate, gate and response bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.operators import means as M
from terrapanel.operators import panel as P
from terrapanel.operators import windows as Wn
from terrapanel.queries import base as B
from terrapanel.queries import windows as QW
from terrapanel.queries.base import q6, query, rnd, with_sql
from terrapanel.tables import cut_lineage

FIRST, LAST = 23960, 24010

ADJ = B.PIXEL_MONTH + [
    "dv AS (SELECT *, x - avg(x) OVER (PARTITION BY pixel) AS d FROM pm)", "ye AS (SELECT period, quantile_cont(d, 0.5) AS e FROM dv GROUP BY 1)",
    "pa AS (SELECT pixel, period, x, valid_count, nd, x - e AS adj FROM dv JOIN ye USING (period))",
    "pf AS (SELECT a.pixel, CAST(t.period AS BIGINT) AS period, x, adj, valid_count, nd FROM (SELECT DISTINCT pixel FROM pa) a, (SELECT unnest(range(min(period), max(period) + 1)) AS period FROM pa) t LEFT JOIN pa ON pa.pixel = a.pixel AND pa.period = t.period)"]


def _rename_z(ctes, z):
    return [c.replace(" AS z FROM", f" AS {z} FROM") for c in ctes]


EV = (QW.z_sql("pf", "x", "q1") + _rename_z(QW.z_sql("q1", "adj", "q2"), "z_adj") + QW.event_sql("q2", "z", "nd", "q3", "event") + QW.event_sql("q3", "z", "TRUE", "q4x", "candidate")
      + QW.event_sql("q4x", "z_adj", "nd", "q5", "event_adj") + QW.event_sql("q5", "z_adj", "TRUE", "q6", "candidate_adj"))
EV = [c.replace("coalesce(TRUE, FALSE) AND coalesce(lag(TRUE, 1, TRUE) OVER (PARTITION BY pixel ORDER BY period), FALSE)", "TRUE") for c in EV]
EV += ["q7 AS (SELECT *, bool_or(NOT coalesce(nd, FALSE)) OVER (PARTITION BY pixel ORDER BY period ROWS 10 PRECEDING) AS disturbed_recent FROM q6)",
       f"""q8 AS (SELECT * REPLACE (period AS period), min(CASE WHEN event THEN period END) OVER w AS fe, min(CASE WHEN candidate THEN period END) OVER w AS fc,
        min(CASE WHEN event_adj THEN period END) OVER w AS fa, min(CASE WHEN candidate_adj THEN period END) OVER w AS fca FROM q7 WHERE period BETWEEN {FIRST} AND {LAST} WINDOW w AS (PARTITION BY pixel))""",
       """py AS (SELECT q8.pixel, q8.period, px.node, coalesce(q8.period = fe, FALSE) AS event, coalesce(q8.period = fc, FALSE) AS candidate, fe IS NULL OR q8.period <= fe AS at_risk,
        fc IS NULL OR q8.period <= fc AS candidate_at_risk, coalesce(q8.period = fa, FALSE) AS event_adj, coalesce(q8.period = fca, FALSE) AS candidate_adj, fa IS NULL OR q8.period <= fa AS at_risk_adj,
        z, z_adj, disturbed_recent, cwd, vpd, x, valid_count, height, forest_class FROM q8 JOIN pixels px USING (pixel) JOIN nm ON nm.node = px.node AND nm.period = q8.period WHERE x IS NOT NULL)"""]
PANEL = ADJ + B.PIXELS + B.NODE_MONTH + EV


def panel(spark, sf):
    px, clim = B.pixels(spark, sf), B.node_month(spark, sf).withColumnRenamed("period", "year")
    # the monthly table is far smaller than the line items and is read in several passes: written once
    pm = cut_lineage(B.pixel_month(spark, sf).withColumnRenamed("period", "year"))
    return P.person_years(pm, px, clim, F.lit(FIRST), F.lit(LAST)).withColumnRenamed("year", "period")


@query("agg_year_effect", with_sql(ADJ, f"SELECT pixel, period, {q6('adj')} AS adj FROM pa"))
def agg_year_effect(spark, sf):
    return rnd(P.remove_year_effect(cut_lineage(B.pixel_month(spark, sf)), "pixel", "period", "x", "adj").select("pixel", "period", "adj"))


COLS = ["event", "candidate", "at_risk", "candidate_at_risk", "event_adj", "candidate_adj", "at_risk_adj", "disturbed_recent"]


@query("win_person_years", with_sql(PANEL, f"SELECT pixel, period, {', '.join(COLS)}, {q6('z')} AS z, {q6('z_adj')} AS z_adj, {q6('cwd', 9)} AS cwd FROM py"))
def win_person_years(spark, sf):
    return rnd(panel(spark, sf).select("pixel", "period", *COLS, "z", "z_adj", "cwd"), 6, cwd=9)


MIRROR = (QW.z_sql("pf", "x", "q1") + QW.event_sql("q1", "z", "TRUE", "q2", "down") + ["qn AS (SELECT * REPLACE (-x AS x) FROM pf)"] + QW.z_sql("qn", "x", "q3") + QW.event_sql("q3", "z", "TRUE", "q4x", "up"))
MIRROR = [c.replace("coalesce(TRUE, FALSE) AND coalesce(lag(TRUE, 1, TRUE) OVER (PARTITION BY pixel ORDER BY period), FALSE)", "TRUE") for c in MIRROR]
MIRROR += ["fu AS (SELECT pixel FROM pm GROUP BY 1 HAVING count(*) = (SELECT max(period) - min(period) + 1 FROM pm))",
           f"oc AS (SELECT (SELECT count(DISTINCT pixel) FROM q2 WHERE down AND period BETWEEN {FIRST} AND {LAST} AND pixel IN (SELECT pixel FROM fu)) AS decline, (SELECT count(DISTINCT pixel) FROM q4x WHERE up AND period BETWEEN {FIRST} AND {LAST} AND pixel IN (SELECT pixel FROM fu)) AS rise, (SELECT count(*) FROM fu) AS n_full)"]


@query("agg_onset_counts", with_sql(QW.FULL + MIRROR, "SELECT decline, rise, n_full FROM oc"))
def agg_onset_counts(spark, sf):
    return P.onset_counts(B.pixel_month(spark, sf), F.lit(FIRST), F.lit(LAST), year="period")


PMF = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))"
RATE = ["er AS (SELECT node, count(*) FILTER (WHERE event) AS k, count(*) AS n FROM py WHERE at_risk GROUP BY 1)",
        # bisection on the binomial tails: P(X >= k) = 0.025 for the lower limit, P(X <= k) = 0.025 for the upper
        f"""bs AS (SELECT node, k, n, 0 AS it, CAST(0 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS d FROM er
        UNION ALL SELECT node, k, n, it + 1, CASE WHEN tl < 0.025 THEN ml ELSE a END, CASE WHEN tl < 0.025 THEN b ELSE ml END, CASE WHEN tu > 0.025 THEN mu ELSE c END, CASE WHEN tu > 0.025 THEN d ELSE mu END
        FROM (SELECT *, (a + b) / 2 AS ml, (c + d) / 2 AS mu, 1 - list_sum(list_transform(range(0, k), lambda i: {PMF.replace('ln(p)', 'ln((a + b) / 2)').replace('ln(1 - p)', 'ln(1 - (a + b) / 2)')})) AS tl,
        list_sum(list_transform(range(0, k + 1), lambda i: {PMF.replace('ln(p)', 'ln((c + d) / 2)').replace('ln(1 - p)', 'ln(1 - (c + d) / 2)')})) AS tu FROM bs WHERE it < 60))"""]


@query("agg_event_rate", with_sql(PANEL + RATE, f"SELECT node, k AS n_events, n AS n_py, {q6('k / n', 8)} AS rate, {q6('CASE WHEN k = 0 THEN 0.0 ELSE (a + b) / 2 END', 8)} AS lo, {q6('(c + d) / 2', 8)} AS hi, {q6('CASE WHEN k = 0 THEN 1.0 - pow(0.05, 1.0 / n) END', 8)} AS zero_bound FROM bs WHERE it = 60"))
def agg_event_rate(spark, sf):
    return rnd(P.event_rate(panel(spark, sf), by=["node"]), 8)


@query("agg_panel_gate", with_sql(PANEL + [c for c in QW.FULL if c.startswith("pf2")] + [c.replace("q1 AS", "m1 AS").replace("FROM q1", "FROM m1").replace("q2 AS", "m2 AS").replace("FROM q2", "FROM m2").replace("q3 AS", "m3 AS").replace("FROM q3", "FROM m3").replace("q4x AS", "m4 AS").replace("FROM q4x", "FROM m4") for c in MIRROR] +
    ["ct AS (SELECT (SELECT count(*) FROM py WHERE at_risk AND event) AS n_events, decline, rise FROM oc)"],
    f"""SELECT n_events, decline, rise, {q6('decline / nullif(rise, 0)')} AS decline_to_rise, CASE WHEN n_events < 30 THEN 'too_few_events_for_a_hazard_fit' WHEN decline / nullif(rise, 0) < 1.5 THEN 'events_not_distinguishable_from_noise' ELSE 'fit' END AS status FROM ct"""))
def agg_panel_gate(spark, sf):
    e = panel(spark, sf).filter("at_risk").agg(F.count_if("event")).scalar()
    c = P.onset_counts(cut_lineage(B.pixel_month(spark, sf)), F.lit(FIRST), F.lit(LAST), year="period").select(e.alias("n_events"), "decline", "rise")
    return rnd(P.panel_gate(c, 3))


ANOM = ["u AS (SELECT node, period, max(cwd) AS cwd FROM py GROUP BY 1, 2)", "ud AS (SELECT node, period, cwd - avg(cwd) OVER (PARTITION BY node) AS dv FROM u)",
        "us AS (SELECT sqrt(avg(dv * dv)) AS sd FROM ud)", "pan AS (SELECT py.*, dv / sd AS cwd_anom FROM py JOIN ud USING (node, period), us)"]
BINS = ["ny AS (SELECT node, period, avg(z) AS z, max(cwd_anom) AS a FROM pan WHERE NOT disturbed_recent AND z IS NOT NULL GROUP BY 1, 2)",
        "eg AS (SELECT list_sort(list_distinct(quantile_cont(a, [0, 0.2, 0.4, 0.6, 0.8, 1])))[2:-2] AS e FROM ny)"]


def anomalies(spark, sf):
    d = M.climate_anomaly(cut_lineage(panel(spark, sf)), "node", "period", ["cwd", "vpd"])
    return d.filter(~F.col("disturbed_recent") & F.col("z").isNotNull())


@query("agg_response_bins", with_sql(PANEL + ANOM + BINS, f"SELECT len(list_filter(e, lambda q: q <= a)) AS bin, {q6('avg(a)')} AS anomaly_mean, {q6('avg(z)')} AS z_mean, {q6('stddev_samp(z) / sqrt(count(*))')} AS z_se, count(*) AS n FROM ny, eg GROUP BY 1"))
def agg_response_bins(spark, sf):
    return rnd(P.response_bins(cut_lineage(anomalies(spark, sf).select("node", "period", "z", "cwd_anom")), "node", "period", "z", "cwd_anom"))


__all__ = ["Wn"]
