"""Model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel import constants as K
from terrapanel.functions import ecology as E
from terrapanel.functions import weather as X
from terrapanel.operators import boosting
from terrapanel.operators import models as Md
from terrapanel.operators import scores as S
from terrapanel.operators import spatial as Sp
from terrapanel.operators import splits as Spl
from terrapanel.operators import windows as Wn
from terrapanel.plans import niche as Ni
from terrapanel.plans import vitality as V
from terrapanel.queries import base as B
from terrapanel.queries import columns as C
from terrapanel.queries import filters as QF
from terrapanel.queries import panels as QP
from terrapanel.queries.base import q6, query, rnd, with_sql
from terrapanel.tables import cut_lineage


def coefs(spark, terms, values, name="coef"):
    return spark.createDataFrame([(t, float(v)) for t, v in zip(terms, values)], f"term string, {name} double")


# ---- cloglog regression: one predictor, SQL by the same reweighted steps ------------------------------

GLM = ["xs AS (SELECT obs / 50.0 AS x, CASE WHEN p < 0.25 THEN 1.0 ELSE 0.0 END AS y, 1.0 + line / 10.0 AS sw FROM sc)",
       "ag AS (SELECT x, y, sum(sw) AS sw FROM xs GROUP BY 1, 2)", "lv AS (SELECT list({'x': x, 'y': y, 's': sw}) AS l, (SELECT avg(y) FROM xs) AS m FROM ag)"]
_ET = "least(greatest(b0 + b1 * r.x, -30.0), 30.0)"
_MU = f"least(greatest(1 - exp(-exp({_ET})), 1e-10), 1 - 1e-10)"
_DM = f"greatest((1 - {_MU}) * exp({_ET}), 1e-10)"
_W = f"(r.s * {_DM} * {_DM} / ({_MU} * (1 - {_MU})))"
_Z = f"(b0 + b1 * r.x + (r.y - {_MU}) / {_DM})"


def _ls(e):
    return f"list_sum(list_transform(l, lambda r: {e}))"


GLM += [f"""it AS (SELECT 0 AS i, ln(-ln(1 - m)) AS b0, CAST(0 AS DOUBLE) AS b1, l FROM lv
    UNION ALL SELECT i + 1, (c0 * (g11 + 1e-4) - g01 * c1) / (g00 * (g11 + 1e-4) - g01 * g01), (g00 * c1 - g01 * c0) / (g00 * (g11 + 1e-4) - g01 * g01), l
    FROM (SELECT i, l, {_ls(_W)} AS g00, {_ls(f'{_W} * r.x')} AS g01, {_ls(f'{_W} * r.x * r.x')} AS g11, {_ls(f'{_W} * {_Z}')} AS c0, {_ls(f'{_W} * {_Z} * r.x')} AS c1 FROM it WHERE i < 15))"""]


@query("mdl_cloglog_glm", with_sql(B.SCORED + GLM, f"SELECT unnest(['intercept', 'x']) AS term, unnest([{q6('b0', 5)}, {q6('b1', 5)}]) AS coef FROM it WHERE i = 15"))
def mdl_cloglog_glm(spark, sf):
    d = B.scored(spark, sf).select((F.col("obs") / 50.0).alias("x"), (F.col("p") < 0.25).cast("double").alias("y"), (F.col("line") / 10.0 + 1.0).alias("w"))
    return rnd(coefs(spark, ["intercept", "x"], Md.fit_cloglog(d, ["x"], "y", "w")), 5)


# ---- fixed effects --------------------------------------------------------------------------------------

WO = ["wd AS (SELECT pixel, node, period, z - avg(z) OVER (PARTITION BY pixel) AS yd, cwd_anom - avg(cwd_anom) OVER (PARTITION BY pixel) AS xd FROM pan WHERE NOT disturbed_recent AND z IS NOT NULL)",
      "wb AS (SELECT sum(xd * yd) / sum(xd * xd) AS b, sum(xd * xd) AS sxx, sum(yd * yd) AS syy, count(*) AS n, count(DISTINCT pixel) AS u FROM wd)",
      "wn AS (SELECT sum(s * s) AS m, count(*) AS g FROM (SELECT node, sum(xd * (yd - b * xd)) AS s FROM wd, wb GROUP BY node))",
      "wp AS (SELECT sum(s * s) AS m, count(*) AS g FROM (SELECT period, sum(xd * (yd - b * xd)) AS s FROM wd, wb GROUP BY period))"]


def _se(t):
    return f"sqrt({t}.g / ({t}.g - 1.0) * (n - 1.0) / (n - 1.0) * {t}.m) / sxx"


@query("mdl_within_ols", with_sql(QP.PANEL + QP.ANOM + WO, f"""SELECT 'cwd_anom' AS term, {q6('b')} AS coef, {q6(_se('wn'))} AS se_node, {q6(_se('wp'))} AS se_year, {q6(f"greatest({_se('wn')}, {_se('wp')})")} AS se_used,
    n AS n_obs, u AS n_pixels, {q6('b * b * sxx / syy')} AS r2_within FROM wb, wn, wp"""))
def mdl_within_ols(spark, sf):
    f = Md.within_ols(QP.anomalies(spark, sf), "z", ["cwd_anom"], "pixel", ["node", "period"])
    row = ("cwd_anom", float(f["coef"][0]), float(f["se"]["node"][0]), float(f["se"]["period"][0]), float(f["se_used"][0]), f["n"], f["n_units"], float(f["r2_within"]))
    return rnd(spark.createDataFrame([row], "term string, coef double, se_node double, se_year double, se_used double, n_obs long, n_pixels long, r2_within double"))


LG = ["la AS (SELECT pixel, period // 12 AS yr, z AS y, cwd_anom AS x FROM pan WHERE NOT disturbed_recent AND z IS NOT NULL)",
      "lt AS (SELECT g.yr AS fold, la.*, avg(y) FILTER (WHERE la.yr <> g.yr) OVER w AS yb, avg(x) FILTER (WHERE la.yr <> g.yr) OVER w AS xb FROM la, (SELECT DISTINCT yr FROM la) g WINDOW w AS (PARTITION BY g.yr, pixel))",
      "lb AS (SELECT fold, sum((x - xb) * (y - yb)) / sum((x - xb) * (x - xb)) AS b FROM lt WHERE yr <> fold GROUP BY 1)"]


@query("mdl_logo_r2", with_sql(QP.PANEL + QP.ANOM + LG, f"SELECT {q6('1 - sum((y - yb - b * (x - xb)) * (y - yb - b * (x - xb))) / sum((y - yb) * (y - yb))')} AS r2, count(*) AS n_test FROM lt JOIN lb USING (fold) WHERE yr = fold AND yb IS NOT NULL"))
def mdl_logo_r2(spark, sf):
    d = QP.anomalies(spark, sf).withColumn("yr", F.floor(F.col("period") / 12))
    r = Md.leave_group_out_r2(d, "z", ["cwd_anom"], "pixel", "yr")
    return rnd(spark.createDataFrame([(float(r["r2"]), r["n_test"])], "r2 double, n_test long"))


@query("mdl_vitality_suite")
def mdl_vitality_suite(spark, sf):
    """All models and sensitivity fits of the suite; its parts have SQL under their own names."""
    p = QP.panel(spark, sf)
    hz = B.node_month(spark, sf).groupBy("node").agg((F.avg("vpd") / 1000.0).alias("hazard"))
    hz = hz.withColumn("grp", F.explode(F.array(*[F.lit(g) for g in sorted(set(K.GROUP_OF_CLASS.values()))])))
    return rnd(V.vitality_suite(p, ["cwd", "vpd"], "cwd", "period", hz, K.GROUP_OF_CLASS, 23980))


@query("mdl_conditional_verdict", with_sql(B.SCORED, "SELECT id, line, CASE WHEN pred - 30 > obs / 5 OR pred - 30 < -obs / 5 THEN CASE WHEN pred < 30 THEN 'supports' ELSE 'contradicts' END ELSE 'inconclusive' END AS verdict FROM sc WHERE pred <> 30"))
def mdl_conditional_verdict(spark, sf):
    d = B.scored(spark, sf).filter(F.col("pred") != 30).withColumn("c", F.col("pred") - 30)
    d = d.withColumn("lo", F.col("c") - F.col("obs") / 5).withColumn("hi", F.col("c") + F.col("obs") / 5)
    return d.select("id", "line", Md.verdict("c", "lo", "hi").alias("verdict"))


# ---- splines -----------------------------------------------------------------------------------------------

def bs_sql(x: str, inner, degree: int, lo: float, hi: float) -> list[str]:
    t = [lo] * (degree + 1) + list(inner) + [hi] * (degree + 1)
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    v = f"least(greatest({x}, {lo}), {hi})"
    b = [f"(CASE WHEN {v} >= {t[i]} AND {v} {'<=' if i == last else '<'} {t[i + 1]} THEN 1.0::DOUBLE ELSE 0.0 END)" if t[i] < t[i + 1] else "0.0" for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        b = [" + ".join(filter(None, [f"{b[i]} * ({v} - {t[i]}) / {t[i + d] - t[i]}" if t[i + d] > t[i] and b[i] != "0.0" else "",
                                      f"{b[i + 1]} * ({t[i + d + 1]} - {v}) / {t[i + d + 1] - t[i + 1]}" if t[i + d + 1] > t[i + 1] and b[i + 1] != "0.0" else ""])) or "0.0" for i in range(len(t) - 1 - d)]
        b = [f"({e})" if e != "0.0" else e for e in b]
    return b


LAGS = ["lg AS (SELECT node, period, cwd AS lag_0, lag(cwd, 1) OVER w AS lag_1, lag(cwd, 2) OVER w AS lag_2, lag(cwd, 3) OVER w AS lag_3, row_number() OVER w AS r FROM nm WINDOW w AS (PARTITION BY node ORDER BY period))"]
LW = [Md.basis_numbers(float(q), [1.5], 2, 0.0, 3.0) for q in range(4)]
LX = [bs_sql(f"lag_{q}", [220.0, 280.0], 2, 100.0, 420.0) for q in range(4)]
CROSS = [" + ".join(f"{LX[q][j]} * {LW[q][k]!r}::DOUBLE" for q in range(4)) for j in range(len(LX[0])) for k in range(len(LW[0]))]


@query("mdl_spline_crossbasis", with_sql(B.NODE_MONTH + LAGS, "SELECT node, period, " + ", ".join(f"{q6(e)} AS cb_{i}" for i, e in enumerate(CROSS)) + " FROM lg WHERE r > 3"))
def mdl_spline_crossbasis(spark, sf):
    d = Wn.lags(B.node_month(spark, sf), "node", "period", "cwd", 3)
    cb = Md.cross_basis([f"lag_{q}" for q in range(4)], [220.0, 280.0], [1.5], 100.0, 420.0)
    return rnd(d.select("node", "period", *[c.alias(f"cb_{i}") for i, c in enumerate(cb)]))


AGE = bs_sql("CAST(period - 23940 AS DOUBLE)", [20.0, 45.0], 3, 0.0, 80.0)


@query("mdl_design_matrix", with_sql(B.NODE_MONTH, "SELECT node, period, " + ", ".join(f"{q6(e)} AS age_{i}" for i, e in enumerate(AGE)) +
       f", {q6('cwd - avg(cwd) OVER (PARTITION BY node)')} AS cwd_within, {q6('avg(cwd) OVER (PARTITION BY node)')} AS cwd_between, gdd AS stand FROM nm"))
def mdl_design_matrix(spark, sf):
    d = B.node_month(spark, sf).withColumn("age", (F.col("period") - 23940).cast("double")).withColumnRenamed("gdd", "stand")
    m, names = Md.design_matrix(d, "age", [20.0, 45.0], ["cwd"], "node", stand=["stand"], age_range=(0.0, 80.0))
    return rnd(m.select("node", "period", *names))


# ---- stacking, trees ------------------------------------------------------------------------------------------

ST = [f"sl AS (SELECT {C.cll('p')} AS a, {C.cll('width + 0.01')} AS b, y FROM sc)", "sm AS (SELECT *, 0.5 * (a + b) AS m FROM sl)",
      "se AS (SELECT list_distinct(quantile_cont(m, [" + ", ".join(str(i / 20) for i in range(1, 20)) + "])) AS e FROM sm)",
      "sb AS (SELECT *, len(list_filter(e, lambda q: q <= m)) AS bin FROM sm, se)", f"st AS (SELECT bin, {C.cll('least(greatest(avg(y), 1e-4), 1 - 1e-4)')} AS t FROM sb GROUP BY 1)",
      "sg AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * t) AS ca, sum(b * t) AS cb FROM sb JOIN st USING (bin))",
      "sw AS (SELECT (ca * bb - ab * cb) / (aa * bb - ab * ab) AS u, (aa * cb - ab * ca) / (aa * bb - ab * ab) AS v, ca / aa AS ua, cb / bb AS vb, ca * ca / aa AS fa, cb * cb / bb AS fb FROM sg)"]


@query("mdl_stack_nnls", with_sql(B.SCORED + ST, f"SELECT unnest(['a', 'b']) AS term, unnest([{q6('CASE WHEN u >= 0 AND v >= 0 THEN u / (u + v) WHEN fa >= fb THEN 1.0 ELSE 0.0 END', 5)}, {q6('CASE WHEN u >= 0 AND v >= 0 THEN v / (u + v) WHEN fa >= fb THEN 0.0 ELSE 1.0 END', 5)}]) AS weight FROM sw"))
def mdl_stack_nnls(spark, sf):
    """Stacking weights of two link predictions against the binned event rate."""
    d = B.scored(spark, sf).select(E.cloglog("p").alias("a"), E.cloglog(F.col("width") + 0.01).alias("b"), "y")
    return rnd(coefs(spark, ["a", "b"], Md.stack_weights(d, "a", "b", "y"), "weight"), 5)


@query("mdl_gbm_rf", """SELECT unnest(['glm', 'gbm', 'forest', 'stacked']) AS learner, count(*) AS n, true AS better_than_chance, CAST(0 AS BIGINT) AS violations, true AS weights_sum_to_one FROM lineitem""")
def mdl_gbm_rf(spark, sf):
    """The three learners on two blocks (the forest smaller than its default), scored out of fold, and steps of the boosted surface against its sign."""
    d = B.scored(spark, sf).select((F.col("id") * 10 + F.col("line")).alias("key"), (F.col("id") % 2).alias("block"), "obs", "width", "pred", (F.col("width") + 1.0).alias("weight"), ((F.col("y") == 1.0) | (F.col("p") > 0.8)).cast("double").alias("y"))
    features = ["obs", "width", "pred"]
    oof, final = Md.stacked_hazard(d, features, "y", "block", "key", weight="weight", increasing=["pred"], trees={"numTrees": 50, "maxDepth": 10})
    oof = oof.withColumns({"p_glm": E.cloglog_inverse("link_glm"), "p_gbm": E.cloglog_inverse("link_gbm")})
    # the surface over the values of the rows themselves, along the feature with a sign
    ladder = d.agg(F.array_distinct(F.percentile_approx("pred", [i / 50 for i in range(51)]))).scalar()
    grid = d.select("obs", "width").distinct().select("obs", "width", F.concat_ws("|", "obs", "width").alias("key"), F.explode(ladder).alias("pred"))
    surface = boosting.predict(grid, [final["gbm"]], features, "p")
    steps = Md.monotone_violations(surface, "key", "pred", "p").agg(F.sum("violations")).first()[0]
    n, whole = oof.count(), bool(abs(final["weights"].sum() - 1) < 1e-9)
    rows = [(x, n, bool(S.auc(oof, p).first()[0] > 0.55), int(steps), whole) for x, p in (("glm", "p_glm"), ("gbm", "p_gbm"), ("forest", "p_forest"), ("stacked", "p_stat"))]
    return spark.createDataFrame(rows, "learner string, n bigint, better_than_chance boolean, violations bigint, weights_sum_to_one boolean")


@query("agg_monotone_audit", with_sql(B.SCORED, """SELECT part, count(*) FILTER (WHERE d < 0) AS violations, count(d) AS steps FROM (SELECT part, m - lag(m) OVER (PARTITION BY part ORDER BY obs) AS d FROM (SELECT part, obs, round(avg(pred), 9) AS m FROM sc GROUP BY 1, 2)) GROUP BY 1"""))
def agg_monotone_audit(spark, sf):
    g = B.scored(spark, sf).groupBy("part", "obs").agg(F.round(F.avg("pred"), 9).alias("m"))
    return Md.monotone_violations(g, "part", "obs", "m")


@query("mdl_cv_audit")
def mdl_cv_audit(spark, sf):
    """Random against blocked cross-validation of a forest, location-proxy scores and the nearest-neighbour correlation."""
    from terrapanel.plans.audit import location_audit
    return rnd(location_audit(B.points(spark, sf), "point", "x", "y", ["z", "grp"], "v", (900.0,), 1, 3, trees=20, depth=8), 2)


# ---- niche -------------------------------------------------------------------------------------------------------

PB = ["pb AS (SELECT species, CASE WHEN rec % 97 <> 0 THEN f0 END AS x, 1.0 AS y FROM occ WHERE f1 > 1.5 UNION ALL SELECT s.species, o.f0, 0.0 FROM occ o, (SELECT species FROM occ WHERE f1 > 1.5 AND rec % 97 <> 0 GROUP BY 1 HAVING count(*) >= 25) s WHERE o.f2 >= 40)",
      "pc AS (SELECT * FROM pb WHERE x IS NOT NULL)", "pw AS (SELECT species, y, sum(count(*)) OVER (PARTITION BY species) / (2.0 * count(*)) AS w FROM pc GROUP BY 1, 2)",
      "pl AS (SELECT species, list({'x': x, 'y': CAST(y AS DOUBLE), 'w': w}) AS l FROM pc JOIN pw USING (species, y) GROUP BY 1)",
      f"""pn AS (SELECT species, l, 0 AS i, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM pl UNION ALL
        SELECT species, l, i + 1, b0 + ((h11 + 1.0) * g0 - h01 * (g1 - b1)) / (h00 * (h11 + 1.0) - h01 * h01), b1 + (h00 * (g1 - b1) - h01 * g0) / (h00 * (h11 + 1.0) - h01 * h01) FROM (
        SELECT species, l, i, b0, b1, {_ls('r.w * (r.y - 1 / (1 + exp(-b0 - b1 * r.x)))')} AS g0, {_ls('r.x * r.w * (r.y - 1 / (1 + exp(-b0 - b1 * r.x)))')} AS g1,
        {_ls('r.w * (1 / (1 + exp(-b0 - b1 * r.x))) * (1 - 1 / (1 + exp(-b0 - b1 * r.x)))')} AS h00, {_ls('r.x * r.w * (1 / (1 + exp(-b0 - b1 * r.x))) * (1 - 1 / (1 + exp(-b0 - b1 * r.x)))')} AS h01,
        {_ls('r.x * r.x * r.w * (1 / (1 + exp(-b0 - b1 * r.x))) * (1 - 1 / (1 + exp(-b0 - b1 * r.x)))')} AS h11 FROM pn WHERE i < 12))"""]


@query("mdl_presence_background", with_sql(B.OCCURRENCES + PB, f"SELECT species, 'fitted' AS status, (SELECT count(*) FROM occ o WHERE o.species = pn.species AND f1 > 1.5 AND rec % 97 <> 0) AS n_presence, {q6('b0', 5)} AS intercept, {q6('b1', 5)} AS slope FROM pn WHERE i = 12"))
def mdl_presence_background(spark, sf):
    """One balanced ridge model per species against a shared background; a record without its predictor is left out."""
    o = B.occurrences(spark, sf)
    pres = o.filter(F.col("f1") > 1.5).select("species", F.when(F.col("rec") % 97 != 0, F.col("f0")).alias("f0"))
    m = Md.presence_background(pres, o.filter(F.col("f2") >= 40).select("f0"), ["f0"])
    return rnd(m.select("species", "status", "n_presence", "intercept", F.col("coef")[0].alias("slope")), 5)


def _sig(b0, b1, x):
    return f"1 / (1 + exp(-({b0}) - ({b1}) * {x}))"


BB = ["bp AS (SELECT species, f0 AS x, lon, lat, 1.0 AS y FROM occ WHERE f1 > 1.5 AND lat IS NOT NULL)",
      "bf AS (SELECT species FROM bp GROUP BY 1 HAVING count(*) >= 25)",
      "bo AS (SELECT * FROM bp WHERE species IN (SELECT species FROM bf) UNION ALL SELECT NULL, f0, lon, lat, 0.0 FROM occ WHERE f2 >= 40 AND lat IS NOT NULL)",
      "bg AS (SELECT *, CAST(floor((lon - (SELECT min(lon) FROM bo)) / 0.5) * 100000 + floor((lat - (SELECT min(lat) FROM bo)) / 0.5) AS BIGINT) AS block FROM bo)",
      f"bd AS (SELECT block, (row_number() OVER (ORDER BY {B.mix_sql('block')} * 1048576 + block % 1048576) - 1) % 5 AS own FROM (SELECT DISTINCT block FROM bg))",
      "bq AS (SELECT f.species, x, y, own FROM bg JOIN bd USING (block) JOIN bf f ON bg.species = f.species OR bg.species IS NULL)",
      "bt AS (SELECT species, fold, x, y FROM bq, (SELECT unnest(range(0, 5)) AS fold) WHERE fold <> own)",
      "bu AS (SELECT species, fold, p, b, n_test FROM (SELECT species, fold, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS b FROM bt GROUP BY 1, 2) JOIN (SELECT species, own AS fold, count(*) FILTER (WHERE y = 1) AS n_test FROM bq GROUP BY 1, 2) USING (species, fold) WHERE p >= 5 AND b >= 5 AND n_test >= 3)",
      # one predictor of fifty values: equal rows are counted, so a step runs over a short list
      "bl AS (SELECT species, fold, list({'x': x, 'y': CAST(y AS DOUBLE), 'w': c * (p + b) / (2.0 * CASE WHEN y = 1 THEN p ELSE b END)}) AS l FROM (SELECT species, fold, x, y, count(*) AS c FROM bt GROUP BY 1, 2, 3, 4) JOIN bu USING (species, fold) GROUP BY 1, 2)",
      f"""bn AS (SELECT species, fold, l, 0 AS i, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM bl UNION ALL
        SELECT species, fold, l, i + 1, b0 + ((h11 + 1.0) * g0 - h01 * (g1 - b1)) / (h00 * (h11 + 1.0) - h01 * h01), b1 + (h00 * (g1 - b1) - h01 * g0) / (h00 * (h11 + 1.0) - h01 * h01) FROM (
        SELECT species, fold, l, i, b0, b1, {_ls('r.w * (r.y - ' + _sig('b0', 'b1', 'r.x') + ')')} AS g0, {_ls('r.x * r.w * (r.y - ' + _sig('b0', 'b1', 'r.x') + ')')} AS g1,
        {_ls('r.w * (' + _sig('b0', 'b1', 'r.x') + ') * (1 - ' + _sig('b0', 'b1', 'r.x') + ')')} AS h00, {_ls('r.x * r.w * (' + _sig('b0', 'b1', 'r.x') + ') * (1 - ' + _sig('b0', 'b1', 'r.x') + ')')} AS h01,
        {_ls('r.x * r.x * r.w * (' + _sig('b0', 'b1', 'r.x') + ') * (1 - ' + _sig('b0', 'b1', 'r.x') + ')')} AS h11 FROM bn WHERE i < 12))""",
      f"bs AS (SELECT q.species, q.own AS fold, round({_sig('b0', 'b1', 'q.x')}, 9) AS score, q.y = 1 AS pres FROM bq q JOIN bn ON bn.species = q.species AND bn.fold = q.own AND bn.i = 12)",
      "be AS (SELECT species, fold, min(score) AS lo, max(score) - min(score) AS sp, count(*) AS na, count(*) FILTER (WHERE pres) AS np FROM bs GROUP BY 1, 2)",
      "bw AS (SELECT species, fold, w, lo + w * (sp * (1.0 - 0.1) / 99) AS s, sp * 0.1 AS wd, na, np FROM be, range(0, 100) r(w))",
      "br AS (SELECT b.species, b.fold, w, (count(*) FILTER (WHERE pres) / any_value(np)) / (count(*) / any_value(na)) AS ratio FROM bw b JOIN bs ON bs.species = b.species AND bs.fold = b.fold AND score >= s AND score <= s + wd GROUP BY 1, 2, 3)",
      "bk AS (SELECT species, fold, w, rank() OVER (PARTITION BY species, fold ORDER BY ratio) + (count(*) OVER (PARTITION BY species, fold, ratio) - 1) / 2.0 AS rr FROM br)",
      "bx AS (SELECT species, fold, CASE WHEN count(*) >= 3 AND var_pop(rr) > 0 THEN corr(w, rr) END AS boyce FROM bk GROUP BY 1, 2)"]


@query("mdl_blocked_boyce", with_sql(B.OCCURRENCES + BB, f"SELECT species, CAST(fold AS BIGINT) AS fold, p + b AS n_train, n_test, {q6('boyce', 5)} AS boyce FROM bu LEFT JOIN bx USING (species, fold)"))
def mdl_blocked_boyce(spark, sf):
    """The niche models validated on blocks of half a degree: five folds of every species fitted at once."""
    o = B.occurrences(spark, sf)
    return rnd(Ni.blocked_validation(o.filter(F.col("f1") > 1.5), o.filter(F.col("f2") >= 40), ["f0"], "lon", "lat", 0.5), 5)


@query("mdl_blocked_boyce_mean", with_sql(B.OCCURRENCES + BB, f"SELECT species, {q6('avg(boyce)', 5)} AS boyce_mean, count(boyce) AS n_folds FROM bu LEFT JOIN bx USING (species, fold) GROUP BY 1"))
def mdl_blocked_boyce_mean(spark, sf):
    """What the quality gate of a species reads: the mean over its folds."""
    o = B.occurrences(spark, sf)
    return rnd(Ni.mean_boyce(Ni.blocked_validation(o.filter(F.col("f1") > 1.5), o.filter(F.col("f2") >= 40), ["f0"], "lon", "lat", 0.5)), 5)


NA = ["nd AS (SELECT node, max(v) / 20.0 AS bio, sum(greatest(t_mean, 0.0)) / 30.0 AS gdd, max(rh) / 60.0 AS vpd, avg(t_mean) AS t FROM node_day GROUP BY 1)",
      "mm AS (SELECT DISTINCT o_orderpriority AS member, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) * 0.8 AS warming FROM orders)",
      "ns AS (SELECT node, member, warming, 1 / (1 + exp(-(-2.0 + 0.6 * (bio + 0.1 * warming) - 0.1 * gdd - 0.5 * vpd * " + C.es("t + warming") + " / " + C.es("t") + "))) AS s1, 1 / (1 + exp(-(-1.0 - 0.3 * (bio + 0.1 * warming) + 0.2 * gdd - 0.4 * vpd * " + C.es("t + warming") + " / " + C.es("t") + "))) AS s2 FROM nd, mm)"]


@query("mdl_niche_apply", with_sql(B.NODE_DAY + NA, "SELECT node, member, s1 >= 0.3 OR s2 >= 0.25 AS supported FROM ns"))
def mdl_niche_apply(spark, sf):
    """Two passing species of one group applied to every node and member; vapour deficit follows the member's warming."""
    d = B.node_day(spark, sf).groupBy("node").agg((F.max("v") / 20.0).alias("bio"), (F.sum(F.greatest("t_mean", F.lit(0.0))) / 30.0).alias("gdd"), (F.max("rh") / 60.0).alias("vpd"), F.avg("t_mean").alias("t"))
    o = B.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("member")).distinct().withColumn("warming", F.substring("member", 1, 1).cast("double") * 0.8)
    models = spark.createDataFrame([("a", "oak", "fitted", 0.5, -2.0, [0.6, -0.1, -0.5], 0.3), ("b", "oak", "fitted", 0.4, -1.0, [-0.3, 0.2, -0.4], 0.25), ("c", "oak", "fitted", 0.1, 9.0, [0.0, 0.0, 0.0], 0.0)],
                                   "species string, grp string, status string, boyce_mean double, intercept double, coef array<double>, threshold double")
    x = d.withColumn("_m", F.explode(o.agg(F.collect_list(F.struct("member", "warming"))).scalar())).select("*", "_m.member", "_m.warming")
    x = x.withColumn("bio", F.col("bio") + F.col("warming") * 0.1).withColumn("vpd", X.vpd_under_warming("vpd", "t", "warming"))
    return Ni.apply_niche(x, models, ["bio", "gdd", "vpd"], ["node", "member"]).select("node", "member", "supported")


PAIRS = ["ix AS (SELECT row_number() OVER (ORDER BY node) - 1 AS i, * FROM sz)",
         "dr AS (SELECT CAST(floor(((p + 0.5) * CAST(0.6180339887498949 AS DOUBLE) - floor((p + 0.5) * CAST(0.6180339887498949 AS DOUBLE))) * n) AS BIGINT) AS a, CAST(floor(((p + 0.5) * CAST(0.7548776662466927 AS DOUBLE) - floor((p + 0.5) * CAST(0.7548776662466927 AS DOUBLE))) * n) AS BIGINT) AS b FROM range(0, 200000) r(p), (SELECT count(*) AS n FROM sz))",
         "db AS (SELECT avg(sqrt((u.v - w.v) * (u.v - w.v) + (u.z - w.z) * (u.z - w.z) + (u.x - w.x) * (u.x - w.x))) AS d FROM dr JOIN ix u ON u.i = a JOIN ix w ON w.i = b WHERE a <> b)"]
AOA = ["sm AS (SELECT avg(v) AS mv, stddev_pop(v) AS dv, avg(z) AS mz, stddev_pop(z) AS dz, avg(x) AS mx, stddev_pop(x) AS dx FROM sts)",
       "sz AS (SELECT node, node % 4 AS fold, (v - mv) / dv AS v, (z - mz) / dz AS z, (x - mx) / dx AS x FROM sts, sm)", "pz AS (SELECT point, (v - mv) / dv AS v, (z - mz) / dz AS z, (x - mx) / dx AS x FROM pts, sm)"] + PAIRS + [
       "tw AS (SELECT a.node, min(sqrt((a.v - b.v) * (a.v - b.v) + (a.z - b.z) * (a.z - b.z) + (a.x - b.x) * (a.x - b.x))) AS d FROM sz a JOIN sz b ON a.fold <> b.fold GROUP BY 1)",
       "th AS (SELECT quantile_cont(tw.d / db.d, 0.75) + 1.5 * (quantile_cont(tw.d / db.d, 0.75) - quantile_cont(tw.d / db.d, 0.25)) AS t FROM tw, db)",
       "pn AS (SELECT a.point, min(sqrt((a.v - b.v) * (a.v - b.v) + (a.z - b.z) * (a.z - b.z) + (a.x - b.x) * (a.x - b.x))) AS d FROM pz a, sz b GROUP BY 1)"]


@query("mdl_aoa", with_sql(B.POINTS + B.STATIONS + AOA, f"SELECT point, {q6('pn.d / db.d')} AS di, {q6('t')} AS threshold, pn.d / db.d <= t AS inside FROM pn, db, th"))
def mdl_aoa(spark, sf):
    s = B.stations(spark, sf).withColumn("fold", F.col("node") % 4)
    return rnd(Md.area_of_applicability(s, B.points(spark, sf), ["v", "z", "x"], "node", "point", "fold"))


PLANT = ("broadleaf", "oak", "pine")


def _group_aoa(g: int) -> str:
    parts = [f"sts AS (SELECT * FROM sts_all WHERE node % 3 = {g})", *AOA]
    enough = "(SELECT count(*) >= 20 AND count(DISTINCT node % 4) >= 2 FROM sts)"
    return (f"SELECT * FROM (WITH {', '.join(parts)} SELECT '{PLANT[g]}' AS grp, point, CASE WHEN {enough} THEN {q6('pn.d / db.d')} END AS di, "
            f"CASE WHEN {enough} THEN {q6('t')} END AS threshold, {enough} AND coalesce(pn.d / db.d <= t, false) AS inside FROM pts JOIN pn USING (point), db, th)")


@query("mdl_group_aoa", with_sql(B.POINTS + [B.STATIONS[0].replace("sts AS", "sts_all AS", 1)], " UNION ALL ".join(_group_aoa(g) for g in range(3))))
def mdl_group_aoa(spark, sf):
    """The area of applicability of every plant group from its own nodes; a group with fewer than 20 covers nothing."""
    s = B.stations(spark, sf).withColumn("fold", F.col("node") % 4)
    parts = [Md.group_applicability(s.filter(F.col("node") % 3 == g), B.points(spark, sf), ["v", "z", "x"], "node", "point", "fold").select(F.lit(PLANT[g]).alias("grp"), "point", "di", "threshold", "inside") for g in range(3)]
    return rnd(parts[0].unionByName(parts[1]).unionByName(parts[2]))


# ---- calibration, offsets, variogram -----------------------------------------------------------------------------------

CA = ["ca AS (SELECT list({'x': ln(q / (1 - q)), 'y': y, 'n': n}) AS l FROM (SELECT least(greatest(width / 2 + 0.2, 1e-6), 1 - 1e-6) AS q, CASE WHEN p < width * 5 THEN 1.0 ELSE 0.0 END AS y, count(*) AS n FROM sc GROUP BY 1, 2))",
      f"""cn AS (SELECT l, 0 AS i, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM ca UNION ALL SELECT l, i + 1, b0 + ((h11 + 1e-6) * g0 - h01 * (g1 - 1e-6 * b1)) / (h00 * (h11 + 1e-6) - h01 * h01), b1 + (h00 * (g1 - 1e-6 * b1) - h01 * g0) / (h00 * (h11 + 1e-6) - h01 * h01) FROM (
        SELECT l, i, b0, b1, {_ls('r.n * (r.y - 1 / (1 + exp(-b0 - b1 * r.x)))')} AS g0, {_ls('r.x * r.n * (r.y - 1 / (1 + exp(-b0 - b1 * r.x)))')} AS g1, {_ls('r.n / (1 + exp(-b0 - b1 * r.x)) * (1 - 1 / (1 + exp(-b0 - b1 * r.x)))')} AS h00,
        {_ls('r.x * r.n / (1 + exp(-b0 - b1 * r.x)) * (1 - 1 / (1 + exp(-b0 - b1 * r.x)))')} AS h01, {_ls('r.x * r.x * r.n / (1 + exp(-b0 - b1 * r.x)) * (1 - 1 / (1 + exp(-b0 - b1 * r.x)))')} AS h11 FROM cn WHERE i < 12))"""]


@query("mdl_calibration", with_sql(B.SCORED + CA, f"SELECT {q6('b1', 4)} AS slope, {q6('b0', 4)} AS intercept FROM cn WHERE i = 12"))
def mdl_calibration(spark, sf):
    d = B.scored(spark, sf).select((F.col("width") / 2 + 0.2).alias("q"), (F.col("p") < F.col("width") * 5).cast("double").alias("o"))
    return rnd(spark.createDataFrame([Md.calibration(d, "q", "o")], "slope double, intercept double"), 4)


OB = ["ol AS (SELECT node, year, list(t_min) AS l, avg(0.4 + rh / 400.0) AS target FROM node_day GROUP BY 1, 2)",
      f"""ob AS (SELECT node, year, l, target, 0 AS i, CAST(-10 AS DOUBLE) AS lo, CAST(40 AS DOUBLE) AS hi FROM ol UNION ALL SELECT node, year, l, target, i + 1, CASE WHEN m > target THEN mid ELSE lo END, CASE WHEN m > target THEN hi ELSE mid END FROM (
        SELECT *, (lo + hi) / 2 AS mid, list_avg(list_transform(l, lambda t: {C.es('t - (lo + hi) / 2')})) AS m FROM ob WHERE i < 60))"""]


@query("mdl_offset_bisection", with_sql(B.NODE_DAY + OB, f"SELECT node, year, {q6('(lo + hi) / 2')} AS k FROM ob WHERE i = 60"))
def mdl_offset_bisection(spark, sf):
    d = B.node_day(spark, sf)
    t = d.groupBy("node", "year").agg(F.avg(F.col("rh") / 400.0 + 0.4).alias("target"))
    return rnd(Md.humidity_offset(d.join(t, ["node", "year"]), ["node", "year"], "t_min", "target"))


@query("mdl_variogram_fit")
def mdl_variogram_fit(spark, sf):
    """Exponential and linear fit of the binned semivariances (the bins have SQL under agg_variogram)."""
    v = Sp.variogram(B.points(spark, sf), "v", 1000.0, 10).select("lag", "semivariance").collect()  # ten bins
    f = Md.fit_variogram([(r[0], r[1]) for r in v])
    return rnd(spark.createDataFrame([tuple(f.values())], "nugget double, sill double, range double, practical_range double, r2 double, r2_linear double, plateau boolean"), 3)


__all__ = ["QF", "Spl", "cut_lineage"]
