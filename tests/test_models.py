"""Models and plans against NumPy and brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.functions.ecology import cloglog_inverse
from terrapanel.operators import means, models, portfolio, scores
from terrapanel.operators.panel import panel_gate
from terrapanel.plans import audit, vitality

RNG = np.random.default_rng(11)


def frame(spark, **cols):
    names = list(cols)
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in zip(*cols.values())]
    kinds = {k: "long" if np.asarray(c).dtype.kind in "iu" else "double" for k, c in cols.items()}
    return spark.createDataFrame(rows, ", ".join(f"{n} {kinds[n]}" for n in names))


def test_cloglog_recovers_parameters_and_lasso_drops_noise(spark):
    n = 4000
    x, z = RNG.normal(size=n), RNG.normal(size=n)
    y = (RNG.random(n) < 1 - np.exp(-np.exp(-1.5 + 0.8 * x))).astype(float)
    d = frame(spark, x=x, z=z, y=y)
    b = models.fit_cloglog(d, ["x", "z"], "y")
    assert b == pytest.approx([-1.5, 0.8, 0.0], abs=0.12)
    from pyspark.ml.regression import GeneralizedLinearRegression
    g = GeneralizedLinearRegression(family="binomial", link="cloglog", featuresCol="_features", labelCol="y", maxIter=50, tol=1e-10).fit(models.assembled(d, ["x", "z"]))
    assert b == pytest.approx([g.intercept, *g.coefficients], abs=1e-3)
    s = models.fit_cloglog(d, ["x", "z"], "y", l1=200.0)
    assert s[2] == 0.0 and 0 < s[1] < b[1]
    assert d.select(cloglog_inverse(models.cloglog_link(["x", "z"], b))).count() == n


def test_within_ols_matches_numpy(spark):
    pix, yr = np.repeat(np.arange(40), 10), np.tile(np.arange(10), 40)
    node = pix // 4
    x1, x2 = RNG.normal(size=400), RNG.normal(size=400)
    y = RNG.normal(size=40)[pix] * 3 - 0.5 * x1 + 0.2 * x2 + RNG.normal(0, 0.3, 400)
    d = frame(spark, pixel=pix, node=node, year=yr, y=y, x1=x1, x2=x2)
    f = models.within_ols(d, "y", ["x1", "x2"], "pixel", ["node", "year"])
    dm = lambda v: v - np.array([v[pix == p].mean() for p in range(40)])[pix]
    X, Y = np.column_stack([dm(x1), dm(x2)]), dm(y)
    b = np.linalg.solve(X.T @ X, X.T @ Y)
    e, bread = Y - X @ b, np.linalg.inv(X.T @ X)
    assert f["coef"] == pytest.approx(b)
    for name, c in (("node", node), ("year", yr)):
        s = np.array([(X[c == g] * e[c == g, None]).sum(0) for g in np.unique(c)])
        v = len(s) / (len(s) - 1) * 399 / 398 * bread @ (s.T @ s) @ bread
        assert f["se"][name] == pytest.approx(np.sqrt(np.diag(v)))
    sse = sn = 0.0
    for g in range(10):
        tr, te = yr != g, yr == g
        m = lambda v: np.array([v[tr & (pix == p)].mean() for p in range(40)])[pix]
        Xt, Yt = np.column_stack([x1 - m(x1), x2 - m(x2)]), y - m(y)
        bt = np.linalg.solve(Xt[tr].T @ Xt[tr], Xt[tr].T @ Yt[tr])
        sse, sn = sse + ((Yt[te] - Xt[te] @ bt) ** 2).sum(), sn + (Yt[te] ** 2).sum()
    assert models.leave_group_out_r2(d, "y", ["x1", "x2"], "pixel", "year")["r2"] == pytest.approx(1 - sse / sn)
    with pytest.raises(ValueError, match="collinear"):
        models.within_ols(d.withColumn("x3", F.col("x1") * 2), "y", ["x1", "x3"], "pixel", ["node"])


def test_two_way_demeaning_of_an_unbalanced_panel(spark):
    a, b = np.repeat(np.arange(8), 5), np.tile(np.arange(5), 8)
    keep = RNG.random(40) < 0.8
    a, b, v = a[keep], b[keep], RNG.normal(size=keep.sum())
    got = means.demean_two_way(frame(spark, a=a, b=b, v=v), "a", "b", ["v"])
    for g in ("a", "b"):
        assert got.groupBy(g).agg(F.abs(F.avg("v")).alias("m")).agg(F.max("m")).first()[0] < 1e-7


def test_splines_sum_to_one_and_nnls(spark):
    d = frame(spark, x=np.linspace(-1, 11, 40))
    s = d.select(sum(models.bspline_basis(F.col("x"), [3.0, 6.0], 3, 0.0, 10.0), F.lit(0.0)).alias("s"))
    assert [r["s"] for r in s.collect()] == pytest.approx([1.0] * 40)
    A, w = RNG.normal(size=(200, 2)), np.array([0.7, 0.3])
    assert models.nnls2(A.T @ A, A.T @ (A @ w)) == pytest.approx(w)
    assert models.nnls2(A.T @ A, A.T @ (A @ np.array([1.0, -0.5]))) == pytest.approx([1.0, 0.0])


def test_variogram_fit_finds_the_range():
    h = np.linspace(2, 150, 16)
    f = models.fit_variogram(list(zip(h, 2.0 + 8.0 * (1 - np.exp(-h / 20.0)))))
    assert (f["nugget"], f["sill"], f["range"]) == pytest.approx((2.0, 8.0, 20.0), rel=0.02) and f["plateau"]
    assert not models.fit_variogram(list(zip(h, 1.0 + 0.1 * h)))["plateau"]


def test_murphy_identity_and_auc(spark):
    p = RNG.random(3000).round(2)
    y = (RNG.random(3000) < p).astype(float)
    d = frame(spark, p=p, y=y)
    m = scores.murphy(d).first()
    assert m["brier_binned"] == pytest.approx(m["reliability"] - m["resolution"] + m["uncertainty"])
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert scores.auc(d).first()["auc"] == pytest.approx(want)


def small_problem(spark, seed, U=6, J=3, C=4):
    r = np.random.default_rng(seed)
    b, cost, area = r.uniform(0, 5, (U, J, C)), r.choice([1.0, 2.0, 5.0], (U, J)), r.uniform(1, 3, U)
    opt = spark.createDataFrame([(u, f"o{j}", f"g{j % 2}", float(area[u]), float(cost[u, j]), True) for u in range(U) for j in range(J)], "u long, j string, grp string, area double, cost double, eligible boolean")
    ben = spark.createDataFrame([(u, f"o{j}", c, float(b[u, j, c])) for u in range(U) for j in range(J) for c in range(C)], "u long, j string, c long, b double")
    return b, cost, area, opt, ben


@pytest.mark.parametrize("share", [1.0, 0.6])
def test_portfolio_is_feasible_and_bounded(spark, share):
    b, cost, area, opt, ben = small_problem(spark, 3)
    U, J, C = b.shape
    p = portfolio.Portfolio(opt, ben)
    budget = float((cost.max(1) * area).sum() * 0.5)
    r = p.solve(budget, 0.5, share=share)
    best = 0.0
    for pick in itertools.product(range(-1, J), repeat=U):
        c = sum(cost[u, j] * area[u] for u, j in enumerate(pick) if j >= 0)
        if c > budget:
            continue
        if share < 1:
            g = [sum(area[u] for u, j in enumerate(pick) if j >= 0 and j % 2 == k) for k in (0, 1)]
            if max(g) > share * sum(g) + 1e-9:
                continue
        bc = sum((b[u, j] * area[u] for u, j in enumerate(pick) if j >= 0), np.zeros(C))
        best = max(best, p.objective(bc, 0.5, 0.8))
    assert r["cost"] <= budget + 1e-6 and r["objective"] <= best + 1e-6 <= r["bound"] + 2e-6
    if share < 1 and r["units"]:
        a = {x["grp"]: x["a"] for x in r["plan"].groupBy("grp").agg(F.sum("area").alias("a")).collect()}
        assert max(a.values()) <= share * sum(a.values()) + 1e-6
    assert share < 1 or r["objective"] >= 0.85 * best


def test_dominance_keeps_the_best_of_every_unit(spark):
    b, cost, area, opt, ben = small_problem(spark, 5)
    twin = opt.filter("j = 'o1'").withColumn("j", F.lit("o9"))
    tb = ben.filter("j = 'o1'").withColumn("j", F.lit("o9"))
    gone = {r["j"]: r["by"] for r in portfolio.dominated(opt.unionByName(twin), ben.unionByName(tb)).collect()}
    assert gone.get("o9") == "o1" and "o1" not in gone


def test_vitality_suite_reads_the_drought_response(spark):
    pix, yr = np.repeat(np.arange(60), 12), np.tile(np.arange(12), 60)
    node = pix // 5
    cw = RNG.normal(size=(12, 12))[node, yr]
    t = RNG.normal(size=(12, 12))[node, yr]
    z = -0.6 * cw + RNG.normal(0, 0.5, 720)
    d = frame(spark, pixel=pix, node=node, year=yr, z=z, z_adj=z, cwd=cw, tm=t, height=(5.0 + pix % 9), forest_class=(31 + 0 * pix), valid_count=(6 + 0 * pix)).withColumn("disturbed_recent", F.lit(False))
    hz = frame(spark, node=np.arange(12), hazard=np.linspace(0, 1, 12)).withColumn("grp", F.lit("mesic_diffuse_porous_broadleaf"))
    out = {(r["model"], r["term"]): r for r in vitality.vitality_suite(d, ["cwd", "tm"], "cwd", "year", hz, {31: "mesic_diffuse_porous_broadleaf"}, 6).collect()}
    a = out[("A", "cwd_anom")]
    assert a["lo"] < -0.5 * np.sqrt(np.mean((cw - np.array([cw[node == k].mean() for k in range(12)])[node]) ** 2)) < 0 and a["hi"] < 0
    assert out[("A_leave_one_year_out", "r2_out_of_sample")]["coef"] > 0.2
    assert ("D_tercile_0", "cwd_anom") in out and out[("D", "drought_x_rank")]["status"] in ("inconclusive", "supports", "contradicts")


def test_gate_and_location_audit(spark):
    g = spark.createDataFrame([(5, 9, 3), (200, 9, 8), (200, 30, 8)], "n_events long, decline long, rise long")
    assert [r["status"] for r in panel_gate(g, 3).collect()] == ["too_few_events_for_a_hazard_fit", "events_not_distinguishable_from_noise", "fit"]
    x, y = RNG.uniform(0, 100, 300), RNG.uniform(0, 100, 300)
    d = frame(spark, key=np.arange(300), x=x, y=y, f=RNG.normal(size=300), v=np.sin(x / 10) + np.cos(y / 10))
    r = {(q["check"], q["subject"]): q["value"] for q in audit.location_audit(d, "key", "x", "y", ["f"], "v", (50.0,), k=2, trees=10, depth=5).collect()}
    assert r[("random_r2", "coordinates")] > r[("random_r2", "features")] and r[("nearest_neighbour_correlation", "v")] > 0.5
