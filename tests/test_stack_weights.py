"""Stacking weights from one row of sums per bin."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import models as Md


def test_weights_from_bins_equal_those_from_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.normal(-1, 1, 800).round(2), rng.normal(-1, 1, 800).round(2)
    y = (rng.random(800) < 1 - np.exp(-np.exp(0.6 * a + 0.3 * b))).astype(float)
    d = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, y)], "a double, b double, y double")
    g, c, _ = Md.gram(Md.binned_link_target(d.withColumn("_mid", (F.col("a") + F.col("b")) * 0.5), "_mid", "y"), ["a", "b"], "target")
    monkeypatch.setattr(Md, "binned_link_target", lambda *x, **k: pytest.fail("rows are read again with their target"))
    assert list(Md.stack_weights(d, "a", "b", "y")) == pytest.approx(list(Md.nnls2(g, c)))
