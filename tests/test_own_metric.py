"""The nearest row under every row's own metric, found by cells."""

import numpy as np

from terrapanel.operators import analogues


def test_own_metric_by_cells(spark, monkeypatch):
    """Equal to brute force; ties go to the lower id, an incomplete row takes no part, the far target too finds its row."""
    rng = np.random.default_rng(4)
    x, t = rng.normal(0, 1, (3000, 3)), np.vstack([rng.normal(0, 1, (200, 3)), [[500.0, -40.0, 3.0]]])
    x[2000:] = x[1000:2000]
    spread = 1.0 + np.arange(3000)[:, None] % np.array([3, 4, 2])
    spread[2000:2500] = spread[1000:1500]
    schema = "ref bigint, f double, g double, h double, cov array<double>, inv array<double>"
    rows = [(i, *map(float, r), np.diag(s).ravel().tolist(), np.diag(1.0 / s).ravel().tolist()) for i, (r, s) in enumerate(zip(x, spread))]
    ref = spark.createDataFrame([*rows, (-1, None, 0.0, 0.0, [1.0] * 9, [0.0] * 9), (-2, 0.0, 0.0, 0.0, [1.0] * 9, None)], schema)
    targets = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(t)], "t bigint, f double, g double, h double")
    monkeypatch.setattr(analogues, "LEAF", 128)
    got = {r.t: (r.ref, r.dist) for r in analogues.analogue_own_covariance(targets, ref, ["f", "g", "h"], "t", "ref").collect()}
    d2 = ((t[:, None, :] - x[None, :, :]) ** 2 * (1.0 / spread)[None, :, :]).sum(axis=2)
    assert len(got) == len(t)
    for i in range(len(t)):
        assert got[i][0] == int(np.argmin(np.round(d2[i], 12))) and abs(got[i][1] - np.sqrt(d2[i].min())) < 1e-9
