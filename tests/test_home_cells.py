"""Targets look into their home cell and the few cells within the bound found there."""

import numpy as np

from terrapanel.operators import neighbours


def test_places_meet_few_cells_beside_their_own(spark, monkeypatch):
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.uniform(0, 1, (4000, 3)))], "node bigint, a double, b double, c double")
    targets = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.uniform(0, 1, (600, 3)))], "target bigint, a double, b double, c double")
    rows, real = [], neighbours.met

    def counted(open_, *rest, **named):
        rows.append(open_.count())
        return real(open_, *rest, **named)

    monkeypatch.setattr(neighbours, "met", counted)
    got = neighbours.knn(nodes, targets, 1, "node", "target", ["a", "b", "c"], leaf=256)
    assert got.count() == 600
    assert len(rows) == 2 and rows[0] == 600 and rows[1] < 1800  # four cells each would be 2,400 for the bound alone
