"""Published values and the semantic traps of moving array code to Spark columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.functions import ecology as E
from terrapanel.functions import hydraulics as H
from terrapanel.functions import special as Sp
from terrapanel.functions import weather as X
from terrapanel.functions.numeric import rounded
from terrapanel.operators import filters, joins, raster, scores, windows
from terrapanel.operators.portfolio import tail_mean
from terrapanel.tables import without_nan


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_fao_examples(spark):
    r = one(spark, X.saturation_vp(F.lit(24.5)), X.saturation_vp(F.lit(15.0)), X.pressure(F.lit(1800.0)), X.psychrometric(F.lit(81.8)),
            X.wind_at_2m(F.lit(3.2)), X.extraterrestrial(F.lit(-20.0), F.lit(246)))
    assert r[0] == pytest.approx(3.075, abs=2e-3) and r[1] == pytest.approx(1.705, abs=2e-3)
    assert r[2] == pytest.approx(81.8, abs=0.1) and r[3] == pytest.approx(0.054, abs=1e-3)
    assert r[4] == pytest.approx(2.4, abs=0.05) and r[5] == pytest.approx(32.2, abs=0.15)


def test_inverse_relations(spark):
    r = one(spark, X.dewpoint(X.saturation_vp(F.lit(12.3))), E.cloglog_inverse(E.cloglog(F.lit(0.37))), E.mercator_lat(E.mercator_y(F.lit(40.2))),
            H.conductivity_loss(H.potential_at_loss(F.lit(88.0), F.lit(-3.0), F.lit(40.0)), F.lit(-3.0), F.lit(40.0)), E.blend(F.lit(0.2), F.lit(0.9), F.lit(1.0)))
    assert list(r) == pytest.approx([12.3, 0.37, 40.2, 88.0, 0.2])


def test_special_functions(spark):
    r = one(spark, Sp.gamma(F.lit(4.5)), Sp.gamma(F.lit(-0.5)), Sp.chi_square_cdf(F.lit(3.841458820694124), 1), Sp.chi_square_cdf(F.lit(9.487729036781154), 4))
    assert list(r) == pytest.approx([11.631728396567448, -3.5449077018110318, 0.95, 0.95], rel=1e-9)
    d = Sp.with_normal_quantile(spark.createDataFrame([(0.975,), (0.5,), (1e-6,), (1 - 1e-6,)], "p double"), "p", "z")
    assert [x["z"] for x in d.collect()] == pytest.approx([1.959963984540054, 0.0, -4.753424308822899, 4.753424308817087], abs=1e-9)
    assert Sp.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert 2 * Sp.t_tail(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    lo, hi = Sp.event_rate_interval(2, 50)
    assert (lo, hi) == pytest.approx((0.004881, 0.137138), abs=2e-5)
    assert Sp.event_rate_interval(0, 100)[1] == pytest.approx(1 - 0.025 ** 0.01)
    assert Sp.zero_event_bound(300) == pytest.approx(0.00994, abs=1e-4)


def test_nan_is_never_large(spark):
    """Spark ranks NaN above every number, so NaN >= 1 holds: it must leave at ingest."""
    d = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, None), (4, float("inf"))], "id int, h double")
    assert d.filter(F.col("h") >= 1).count() == 2
    assert without_nan(d).filter(F.col("h") >= 1).count() == 0
    assert [r["id"] for r in filters.complete(d, ["h"]).collect()] == [2]


def series(spark, x, nd=None):
    nd = nd or [True] * len(x)
    return spark.createDataFrame([(1, i, None if v is None else float(v), f) for i, (v, f) in enumerate(zip(x, nd))], "pixel int, year int, x double, nd boolean")


def test_trailing_window_needs_all_years(spark):
    rng = np.random.default_rng(0)
    x = list(rng.normal(0.5, 0.02, 25))
    x[5] = None
    z = {r["year"]: r["z"] for r in windows.trailing_z(series(spark, x), "pixel", "year").collect()}
    assert all(z[t] is None for t in range(16)) and z[16] is not None
    w = np.array(x[6:16], dtype=float)
    assert z[16] == pytest.approx((x[16] - np.median(w)) / np.std(w, ddof=1))


def test_dieback_rule(spark):
    base = [0.5 + 0.01 * (-1) ** i for i in range(12)]
    drop = base + [0.3] * 6
    ev = lambda x, nd=None: [r["year"] for r in windows.dieback(windows.trailing_z(series(spark, x, nd), "pixel", "year"), "pixel", "year").filter("event").collect()]
    assert ev(drop) == [12]
    assert ev(base + [0.3, 0.3]) == []                       # the two later years must exist
    assert ev(base + [0.3, 0.5, 0.5, 0.5]) == []             # recovery
    assert ev(base + [0.3, None, None, 0.5]) == [12]         # a missing later year is no recovery
    nd = [True] * 18
    nd[11] = False
    assert ev(drop, nd) == []                                # flag in the year before


def test_half_even_and_cells(spark):
    d = spark.createDataFrame([(1, 41.4 - 0.5 * 0.01, 43.4 + 7.5 * 0.01)], "id int, lat double, lon double")
    r = raster.lattice_index(d, "lat", "lon", (43.4, 40.4, 44.4, 41.4), (100, 100), 7).first()
    assert (r["li"], r["lj"]) == (0, 1)
    off = spark.createDataFrame([(1, 41.4 - 1.5 * 0.01, 43.405)], "id int, lat double, lon double")
    with pytest.raises(Exception, match="off the lattice"):
        raster.lattice_index(off, "lat", "lon", (43.4, 40.4, 44.4, 41.4), (100, 100), 7).collect()
    c = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5), (0.5, 1.0)], "lat double, lon double")
    assert [r[0] for r in c.select(filters.in_cell("lat", "lon", F.lit(0.5), F.lit(0.5), 0.5)).collect()] == [True, False, False]
    r = one(spark, raster.nearest_index(F.lit(0.5), 0.0, 1.0, 5), raster.nearest_index(F.lit(9.0), 0.0, 1.0, 5), rounded(F.lit(-1e-9)))
    assert list(r)[:2] == [0, 4] and math.copysign(1, r[2]) == 1


def test_two_tail_definitions():
    b = np.array([1.0, 2.0, 3.0, 4.0, 5.0])
    assert tail_mean(b, 0.8) == 1.0 and tail_mean(b, 0.5) == 2.0


def test_guards(spark):
    with pytest.raises(ValueError):
        E.misclassification_corrected(F.lit(0.1), 0.5, 0.5)
    m = spark.createDataFrame([(1, "a", "x", 1.0), (1, "b", "x", 2.0), (2, "a", "x", 1.0)], "node int, gcm string, ssp string, v double")
    from terrapanel.operators.ensemble import factorial_check
    with pytest.raises(Exception, match="full factorial"):
        factorial_check(m, ["gcm", "ssp"], "node").collect()
    with pytest.raises(Exception, match="protected-area"):
        p = spark.createDataFrame([(5.0, 5.0)], "x double, y double")
        joins.protected_flag(p, spark.createDataFrame([(9, 9, 1)], "row long, col long, value int"), "x", "y", 0.0, 10.0, 1.0).collect()
    s = spark.createDataFrame([(float(i),) for i in range(5)], "s double")
    assert scores.conformal_quantile(s, "s", 0.1).first()["q"] == math.inf


def test_chi_square_of_three_variables_at_any_distance(spark):
    xs = [0.0, 0.5, 1.0, 5.0, 12.0, 13.0, 27.0, 28.0, 30.0, 34.0, 60.0, 100.0, 700.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double").select("x", Sp.chi_square_cdf("x", 3).alias("p"), Sp.chi_square_cdf("x", 1).alias("q"))
    got = {r.x: (r.p, r.q) for r in d.collect()}
    for x in xs:
        tail = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        assert got[x] == pytest.approx((math.erf(math.sqrt(x / 2)) - tail, math.erf(math.sqrt(x / 2))), abs=1e-12)
