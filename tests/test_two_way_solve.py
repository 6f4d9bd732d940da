"""Two sets of group effects are removed by one small system where one set is small."""

import numpy as np

from terrapanel.operators import means


def test_few_groups_are_solved_at_once(spark, monkeypatch):
    """Equal to least squares on an unbalanced, chained design that alternates for many rounds; one table of effects is written."""
    rng = np.random.default_rng(8)
    rows = [(u, t, float(rng.normal() + u - 3 * t)) for u in range(40) for t in (u // 2, u // 2 + 1)]
    written, real = [], means.cut_lineage
    monkeypatch.setattr(means, "cut_lineage", lambda df: written.append(1) or real(df))
    got = {(r.u, r.t): r.y for r in means.demean_two_way(spark.createDataFrame(rows, "u long, t long, y double"), "u", "t", ["y"]).collect()}
    assert len(written) == 2
    x = np.zeros((len(rows), 61))
    for i, (u, t, _) in enumerate(rows):
        x[i, u] = x[i, 40 + t] = 1.0
    y = np.array([r[2] for r in rows])
    left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert max(abs(got[u, t] - e) for (u, t, _), e in zip(rows, left)) < 1e-8
