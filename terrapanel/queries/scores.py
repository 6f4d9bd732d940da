"""Score, conformal and design-based queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.operators import scores as S
from terrapanel.queries import base as B
from terrapanel.queries.base import q6, query, rnd, with_sql

SC = B.SCORED


@query("agg_brier", with_sql(SC, f"SELECT part, {q6('avg((p - y) * (p - y))')} AS brier, count(*) AS n FROM sc GROUP BY part"))
def agg_brier(spark, sf):
    return rnd(S.brier(B.scored(spark, sf), by=["part"]))


@query("agg_brier_skill", with_sql(SC, f"SELECT {q6('1.0 - avg((p - y) * (p - y)) / var_pop(y)')} AS skill FROM sc"))
def agg_brier_skill(spark, sf):
    return rnd(S.brier_skill(B.scored(spark, sf)))


@query("agg_log_loss", with_sql(SC, f"SELECT {q6('-avg(y * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1.0 - y) * ln(1.0 - least(greatest(p, 1e-12), 1 - 1e-12)))')} AS log_loss FROM sc"))
def agg_log_loss(spark, sf):
    return rnd(S.log_loss(B.scored(spark, sf)))


QB = ["ed AS (SELECT list_distinct(quantile_cont({x}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM sc)",
      "qb AS (SELECT len(list_filter(e, lambda a: a <= {x})) AS bin, count(*) AS n, avg({x}) AS pk, avg(y) AS yk, sum(y) AS sy FROM sc, ed GROUP BY 1)"]


def qb(x):
    return [t.replace("{x}", x) for t in QB]


@query("agg_murphy", with_sql(SC + qb("p"), f"""SELECT {q6('(SELECT avg((pk - y) * (pk - y)) FROM (SELECT y, len(list_filter(e, lambda a: a <= p)) AS bin FROM sc, ed) r JOIN qb USING (bin))')} AS brier_binned,
    {q6('sum(n * (pk - yk) * (pk - yk)) / sum(n)')} AS reliability, {q6('sum(n * (yk - (SELECT avg(y) FROM sc)) * (yk - (SELECT avg(y) FROM sc))) / sum(n)', 8)} AS resolution,
    {q6('(SELECT avg(y) * (1 - avg(y)) FROM sc)')} AS uncertainty FROM qb"""))
def agg_murphy(spark, sf):
    return rnd(S.murphy(B.scored(spark, sf)), 6, resolution=8)


@query("agg_ece", with_sql(SC + ["ed AS (SELECT list_sort(list_distinct(quantile_cont(width, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])))[2:-2] AS e FROM sc)"] + qb("width")[1:], f"SELECT {q6('sum(n * abs(pk - yk)) / sum(n)', 8)} AS ece FROM qb"))
def agg_ece(spark, sf):
    """Forecasts with eleven distinct values, so that quantile edges coincide."""
    return rnd(S.calibration_error(B.scored(spark, sf), "width"), 8)


CUMQ = ["pv AS (SELECT {x} AS v, sum(y) AS pos, count(*) AS n FROM sc GROUP BY 1)",
        "cu AS (SELECT *, sum(pos) OVER (ORDER BY v DESC) AS tp, sum(n) OVER (ORDER BY v DESC) AS seen, sum(pos) OVER () AS ap, sum(n) OVER () AS an, sum(n - pos) OVER (ORDER BY v) - (n - pos) AS nb FROM pv)"]


@query("agg_pr_auc", with_sql(SC + [t.replace("{x}", "p") for t in CUMQ], f"SELECT {q6('sum(pos / ap * tp / seen)')} AS pr_auc FROM cu"))
def agg_pr_auc(spark, sf):
    return rnd(S.average_precision(B.scored(spark, sf)))


@query("agg_auc", with_sql(SC + [t.replace("{x}", "obs") for t in CUMQ], f"SELECT {q6('sum(pos * (nb + (n - pos) / 2.0)) / (max(ap) * (max(an) - max(ap)))')} AS auc FROM cu"))
def agg_auc(spark, sf):
    """Fifty distinct scores: every value is a long tie."""
    return rnd(S.auc(B.scored(spark, sf), "obs"))


@query("agg_rmse_mae_r2", with_sql(SC, f"SELECT part, {q6('sqrt(avg((pred - obs) * (pred - obs)))')} AS rmse, {q6('avg(abs(pred - obs))')} AS mae, {q6('1 - sum((pred - obs) * (pred - obs)) / (var_pop(obs) * count(*))')} AS r2 FROM sc GROUP BY part"))
def agg_rmse_mae_r2(spark, sf):
    return rnd(S.regression_scores(B.scored(spark, sf), "pred", "obs", by=["part"]))


@query("agg_coverage", with_sql(SC, f"SELECT {q6('avg(CASE WHEN obs >= pred - width * 100 AND obs <= pred + width * 100 THEN 1.0 ELSE 0.0 END)')} AS coverage FROM sc"))
def agg_coverage(spark, sf):
    return rnd(S.interval_coverage(B.scored(spark, sf), F.col("pred") - F.col("width") * 100, F.col("pred") + F.col("width") * 100, "obs"))


@query("agg_pinball", with_sql(SC, f"SELECT {q6('avg(greatest(0.9 * (obs - pred), (0.9 - 1) * (obs - pred)))')} AS pinball FROM sc"))
def agg_pinball(spark, sf):
    return rnd(S.pinball(B.scored(spark, sf), "pred", "obs", 0.9))


KTH = "(SELECT {s} AS s, row_number() OVER (PARTITION BY part ORDER BY {s}) AS k, count(*) OVER (PARTITION BY part) AS n, part FROM sc)"


@query("agg_conformal_q", with_sql(SC, f"SELECT part, {q6('max(s)')} AS q, max(n) AS n_cal FROM {KTH.format(s='abs(obs - pred)')} WHERE k = ceil((n + 1) * (1 - 0.1)) GROUP BY part"))
def agg_conformal_q(spark, sf):
    return rnd(S.conformal_quantile(B.scored(spark, sf).withColumn("s", F.abs(F.col("obs") - F.col("pred"))), "s", 0.1, ["part"]))


HALF = ["cq AS (SELECT max(s) AS q FROM (SELECT {s} AS s, row_number() OVER (ORDER BY {s}) AS k, count(*) OVER () AS n FROM sc WHERE part = 'F') WHERE k = ceil((n + 1) * (1 - 0.1)))"]


@query("agg_conformal_interval", with_sql(SC + [HALF[0].replace("{s}", "abs(obs - pred)")], f"SELECT id, line, {q6('pred - q')} AS lo, {q6('pred + q')} AS hi FROM sc, cq WHERE part = 'O'"))
def agg_conformal_interval(spark, sf):
    d = B.scored(spark, sf)
    return rnd(S.conformal_interval(d.filter(F.col("part") == "F"), d.filter(F.col("part") == "O"), "pred", "obs").select("id", "line", "lo", "hi"))


@query("agg_cqr", with_sql(SC + [HALF[0].replace("{s}", "greatest(pred - 10 - obs, obs - (pred + 10))")], f"SELECT id, line, {q6('pred - 10 - q')} AS cqr_lo, {q6('pred + 10 + q')} AS cqr_hi FROM sc, cq WHERE part = 'O'"))
def agg_cqr(spark, sf):
    d = B.scored(spark, sf).select("id", "line", "part", "obs", (F.col("pred") - 10).alias("ql"), (F.col("pred") + 10).alias("qh"))
    out = S.conformal_quantile_regression(d.filter(F.col("part") == "F"), d.filter(F.col("part") == "O"), "ql", "qh", "obs")
    return rnd(out.select("id", "line", "cqr_lo", "cqr_hi"))


@query("agg_weighted_conformal", with_sql(SC + ["ws AS (SELECT abs(obs - pred) AS s, sum(1.0 + line) AS w FROM sc GROUP BY 1)", "wc AS (SELECT s, sum(w) OVER (ORDER BY s) AS c, sum(w) OVER () AS t FROM ws)"],
    f"SELECT {q6('min(s)')} AS q FROM wc WHERE c / (t + 5000.0) >= 1 - 0.1"))
def agg_weighted_conformal(spark, sf):
    d = B.scored(spark, sf).select(F.abs(F.col("obs") - F.col("pred")).alias("s"), (F.col("line") + 1.0).alias("w"))
    return rnd(S.weighted_conformal(d, "s", "w", 5000.0))


@query("agg_design_based", """WITH n AS (SELECT l_returnflag AS h, CASE WHEN l_quantity > 30 THEN 'A' WHEN l_quantity > 12 THEN 'N' ELSE 'R' END AS j, count(*) AS n FROM lineitem GROUP BY 1, 2),
    a AS (SELECT l_returnflag AS h, sum(l_extendedprice) / 1e6 AS a FROM lineitem GROUP BY 1), f AS (SELECT n.h, j, a, a / (SELECT sum(a) FROM a) AS w, n / sum(n) OVER (PARTITION BY n.h) AS f, sum(n) OVER (PARTITION BY n.h) AS nh FROM n JOIN a USING (h)),
    v AS (SELECT *, w * w * f * (1 - f) / (nh - 1) AS v FROM f)
    SELECT j AS cls, round(sum(w * f), 6) AS p_hat, round(sqrt(sum(v)), 8) AS se_p, round((SELECT sum(a) FROM a) * sum(w * f), 4) AS area_hat, round(1.96 * (SELECT sum(a) FROM a) * sqrt(sum(v)), 5) AS area_ci95,
    round((SELECT sum(w * f) FROM v WHERE h = j), 6) AS overall_accuracy, round((SELECT sqrt(sum(v)) FROM v WHERE h = j), 8) AS se_overall FROM v GROUP BY j""")
def agg_design_based(spark, sf):
    li, q = B.table(spark, sf, "lineitem"), F.col("l_quantity")
    s = li.select(F.col("l_returnflag").alias("stratum"), F.when(q > 30, "A").when(q > 12, "N").otherwise("R").alias("cls"))
    a = li.groupBy(F.col("l_returnflag").alias("stratum")).agg((F.sum("l_extendedprice") / 1e6).alias("area"))
    return rnd(S.design_based(s, a), 6, se_p=8, area_hat=4, area_ci95=5, se_overall=8)
