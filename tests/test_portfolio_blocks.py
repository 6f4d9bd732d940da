"""Blocks of units choose as a loop over units does."""

import numpy as np

from terrapanel.operators import portfolio


def test_choices_of_blocks(spark):
    """Ties go to the earlier option; an option without a cost hides no other of its unit."""
    rng = np.random.default_rng(2)
    opt = [(u, f"m{j}", "ab"[j % 2], float(1 + u % 3), float(rng.integers(1, 9)), True) for u in range(700) for j in range(4) if rng.random() < 0.7]
    opt += [(900, "m0", "a", 1.0, None, True), (900, "m1", "b", 1.0, 2.0, True), (901, "m2", "a", 2.0, 3.0, True), (901, "m3", "b", 2.0, 3.0, True)]
    ben = [(u, j, c, float(rng.integers(1, 30))) for u, j, *_ in opt if u < 900 for c in (1, 2)] + [(u, j, c, 9.0) for u, j in ((900, "m0"), (900, "m1"), (901, "m2"), (901, "m3")) for c in (1, 2)]
    p = portfolio.Portfolio(spark.createDataFrame(opt, "u long, j string, grp string, area double, cost double, eligible boolean"), spark.createDataFrame(ben, "u long, j string, c long, b double"))
    value, nu, share = np.array([0.25, 0.75]), {"a": 0.5, "b": 0.25}, 0.5  # exact in binary, so ties are ties
    held = {(u, j, c): b for u, j, c, b in ben}
    for price in (0.0, 1.5, 4.0):
        best = {}
        for u, j, g, area, cost, _ in sorted(opt, key=lambda o: (o[0], o[1])):
            if cost is not None:
                s = sum(held.get((u, j, c), 0.0) * area * v for c, v in zip((1, 2), value)) - cost * area * price - area * (nu[g] - sum(nu.values()) * share)
                if u not in best or s > best[u][0]:
                    best[u] = (s, j, cost * area, area)
        got = {r.u: r for r in p._chosen(value, price, nu, share).collect()}
        assert {u: r.j for u, r in got.items()} == {u: b[1] for u, b in best.items()}
        taken = [b for b in best.values() if b[0] > 0]
        r = p._round(value, [price], nu, share)[0]
        assert abs(r["cost"] - sum(b[2] for b in taken)) < 1e-6 and abs(r["s"] - sum(b[0] for b in taken)) < 1e-6 and abs(r["area"].sum() - sum(b[3] for b in taken)) < 1e-6
