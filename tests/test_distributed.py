"""Order statistics, neighbour searches, scans and raster windows against plain NumPy, with hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import analogues, neighbours, order_stats as O, raster, scans, spatial, splits

RNG = np.random.default_rng(7)


def test_order_statistics_with_a_hot_value(spark):
    v = np.concatenate([np.full(400, 3.25), RNG.normal(0, 5, 800).round(2)])
    g = np.arange(len(v)) % 3
    d = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["prob"]: r["q"] for r in O.exact_quantiles(d, "v", probs).collect()}
    assert [got[p] for p in probs] == pytest.approx(list(np.quantile(v, probs)))
    by = {(r["g"], r["prob"]): r["q"] for r in O.exact_quantiles(d, "v", probs, ["g"], buckets=5).collect()}
    for k in range(3):
        assert [by[(k, p)] for p in probs] == pytest.approx(list(np.quantile(v[g == k], probs)))
    r = {x["v"]: x["rank"] for x in O.average_ranks(d, "v").collect()}
    s = np.sort(v)
    for x in (3.25, s[0], s[-1]):
        assert r[x] == pytest.approx((np.searchsorted(s, x, "left") + 1 + np.searchsorted(s, x, "right")) / 2)
    assert O.kth_smallest(d, "v", F.lit(600)).first()["q"] == s[599]


def brute(nodes, targets, k, skip):
    out = {}
    for t, tx, ty, tf in targets:
        c = sorted(((tx - x) ** 2 + (ty - y) ** 2, n) for n, x, y, f in nodes if not skip(n, f, t, tf))
        out[t] = [(n, d ** 0.5) for d, n in c[:k]]
    return out


@pytest.mark.parametrize("mode", ["plain", "id", "fold"])
def test_knn_matches_brute_force(spark, mode):
    """A third of the nodes share one place, another third sits in a tight cluster; some targets lie far outside."""
    n = 240
    x = np.concatenate([np.full(80, 5.0), RNG.normal(900, 0.5, 80), RNG.uniform(0, 1000, 80)])
    y = np.concatenate([np.full(80, 5.0), RNG.normal(900, 0.5, 80), RNG.uniform(0, 1000, 80)])
    nodes = [(i, float(a), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y))]
    targets = nodes if mode != "plain" else [(i, float(a), float(b), 0) for i, (a, b) in enumerate(zip(RNG.uniform(-2000, 3000, 60), RNG.uniform(-10, 1100, 60)))] + [(99, 5.0, 5.0, 0), (100, 900.1, 900.0, 0)]
    nd = spark.createDataFrame(nodes, "node long, x double, y double, fold int")
    td = spark.createDataFrame(targets, "target long, x double, y double, fold int")
    ex = {"plain": None, "id": "id", "fold": "fold"}[mode]
    skip = {"plain": lambda *a: False, "id": lambda nn, f, t, tf: nn == t, "fold": lambda nn, f, t, tf: f == tf}[mode]
    want = brute(nodes, targets, 3, skip)
    got = {}
    for r in neighbours.knn(nd, td, 3, exclude=ex).orderBy("target", "nn").collect():
        got.setdefault(r["target"], []).append((r["node"], r["dist"]))
    assert set(got) == set(want)
    for t in want:
        assert [a for a, _ in got[t]] == [a for a, _ in want[t]]
        assert [b for _, b in got[t]] == pytest.approx([b for _, b in want[t]])
    assert n == len(nodes)


def test_knn_with_fewer_nodes_than_k(spark):
    nd = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "node long, x double, y double")
    td = spark.createDataFrame([(7, 0.0, 0.0)], "target long, x double, y double")
    assert [(r["node"], r["dist"]) for r in neighbours.knn(nd, td, 5).orderBy("nn").collect()] == [(1, 0.0), (2, 5.0)]


def test_variogram_from_place_moments(spark):
    x = np.concatenate([np.full(60, 10.0), RNG.uniform(0, 100, 120)])
    y = np.concatenate([np.full(60, 10.0), RNG.uniform(0, 100, 120)])
    v = RNG.normal(0, 1, 180)
    d = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, v)], "x double, y double, v double")
    got = {r["bin"]: (r["n_pairs"], r["semivariance"]) for r in spatial.variogram(d, "v", 50.0, 5).collect()}
    i, j = np.triu_indices(180, 1)
    h, q = np.hypot(x[i] - x[j], y[i] - y[j]), 0.5 * (v[i] - v[j]) ** 2
    for b in range(5):
        m = (h >= 10 * b) & (h < 10 * (b + 1))
        assert got[b][0] == m.sum() and got[b][1] == pytest.approx(q[m].mean())


def test_analogue_with_own_covariance(spark):
    k, m = 2, 30
    mu, tg = RNG.normal(0, 3, (m, k)), RNG.normal(0, 3, (12, k))
    cov = [np.diag(RNG.uniform(0.2, 4, k)) + 0.1 for _ in range(m)]
    ref = spark.createDataFrame([(i, float(a), float(b), [float(z) for z in c.ravel()], [float(z) for z in np.linalg.inv(c).ravel()]) for i, ((a, b), c) in enumerate(zip(mu, cov))],
                                "ref long, f double, g double, cov array<double>, inv array<double>")
    t = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(tg)], "t long, f double, g double")
    got = {r["t"]: (r["ref"], r["dist"]) for r in analogues.analogue_own_covariance(t, ref, ["f", "g"], "t", "ref").collect()}
    for i, p in enumerate(tg):
        d = [float(np.sqrt((p - u) @ np.linalg.inv(c) @ (p - u))) for u, c in zip(mu, cov)]
        assert got[i][0] == int(np.argmin(d)) and got[i][1] == pytest.approx(min(d))


def test_bucket_and_snow_against_loops(spark):
    days = 120
    p, t, pet = RNG.gamma(1, 4, days) * (RNG.random(days) < 0.4), RNG.normal(2, 6, days), RNG.uniform(0, 6, days)
    d = spark.createDataFrame([(1, i, float(a), float(b), float(c), 60.0) for i, (a, b, c) in enumerate(zip(p, t, pet))], "node int, doy int, p double, t_mean double, pet double, w_max double")
    s = scans.snowpack(d, ["node"])
    swe, w, cwd, err = 0.0, 60.0, 0.0, 0.0
    rows = {r["doy"]: r for r in scans.soil_bucket_daily(s, ["node"]).collect()}
    snow = {r["doy"]: r["swe"] for r in s.collect()}
    for i in range(days):
        fall = p[i] if t[i] < 1 else 0.0
        melt = min(swe + fall, 4 * max(t[i], 0))
        swe = swe + fall - melt
        star = min(w + p[i] - fall + melt, 60.0)
        aet = min(star, pet[i] * min(1.0, star / 60.0 / 0.4))
        w = star - aet
        cwd += pet[i] - aet
        assert snow[i] == pytest.approx(swe, abs=1e-9) and rows[i]["w"] == pytest.approx(w) and rows[i]["aet"] == pytest.approx(aet)
    a = scans.soil_bucket_annual(s, ["node"]).first()
    assert a["cwd"] == pytest.approx(cwd) and a["balance_error"] == pytest.approx(0.0, abs=1e-9) and err == 0.0


@pytest.mark.parametrize("refill", [1.0, 0.5])
def test_failure_index_and_threshold_curve(spark, refill):
    n = 80
    psi, loss = -RNG.uniform(0.2, 4, n).round(2), RNG.uniform(0, 300, n)
    d = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(psi, loss))], "node int, doy int, psi_soil double, loss double")

    def simulate(close, buf):
        acc, best = 0.0, 0.0
        for a, b in zip(psi, loss):
            acc = acc + b if a <= close else acc * (1 - refill)
            best = max(best, acc / buf)
        return best

    f = scans.failure_index(d.withColumn("psi_close", F.lit(-1.5)).withColumn("buffer", F.lit(700.0)), ["node"], refill=refill)
    assert scans.failure_summary(f, ["node"]).first()["hfi_max"] == pytest.approx(simulate(-1.5, 700.0))
    if refill == 1.0:
        curve = scans.threshold_curve(d, ["node"]).first()["curve"]
        for close in (-0.1, -1.234, -2.5, -3.9, -9.0):
            m = max([s["m"] for s in curve if s["t"] <= close], default=0.0)
            assert m / 700.0 == pytest.approx(simulate(close, 700.0))


def test_buffer_index_repeats_edges(spark):
    z = RNG.normal(0, 1, (7, 9))
    z[2, 3] = z[5, 5] = np.nan
    rows = [(i, j, float(z[i, j])) for i in range(7) for j in range(9) if np.isfinite(z[i, j])]
    got = {(r["row"], r["col"]): r["buffer"] for r in raster.buffer_index(spark.createDataFrame(rows, "row long, col long, value double"), 2).collect()}
    pad = np.pad(z, 2, mode="edge")
    for i, j, v in rows:
        assert got[(i, j)] == pytest.approx((np.nanmean(pad[i:i + 5, j:j + 5]) - v) / np.nanstd(z))


def test_block_folds_cover_every_row_once(spark):
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(RNG.uniform(0, 100, (200, 2)))], "id long, x double, y double")
    s = splits.block_kfold(d, "id", "x", "y", 20.0, 4).collect()
    tests = [r["id"] for r in s if r["role"] == "test"]
    assert sorted(tests) == list(range(200)) and len(s) == 800


def test_years_of_a_node_stay_apart(spark):
    """Two years with the same days: each is its own series, and a key without the year is refused."""
    rows = [(1, y, d, 5.0, 2.0 * (y - 2000), 1.0, 50.0) for y in (2001, 2002) for d in range(1, 366)]
    d = spark.createDataFrame(rows, "node long, year long, doy int, t_mean double, p double, pet double, w_max double")
    keys = ["node", "year"]
    got = {r["year"]: r for r in scans.soil_bucket_annual(scans.snowpack(d, keys), keys).collect()}
    alone = scans.soil_bucket_annual(scans.snowpack(d.filter("year = 2001"), keys), keys).first()
    assert set(got) == {2001, 2002} and got[2001]["aet"] == alone["aet"] and got[2002]["drainage"] > got[2001]["drainage"]
    with pytest.raises(Exception, match="more than 366 days"):
        scans.soil_bucket_annual(scans.snowpack(d, ["node"]), ["node"]).collect()
