"""Joins with many matches per row are dealt over many tasks by their keys, whatever the size of the files."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrapanel.operators import draws, joins, spatial


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_draws_of_one_group_are_many_tasks(spark):
    t = spark.range(1).select(F.col("id").alias("grp_id"), F.lit("a").alias("grp"), F.lit(-1.2).alias("p50"), F.lit(40.0).alias("slope"), F.lit(-0.9).alias("psi_close"),
                              F.lit(9000.0).alias("capacitance"), F.lit(88.0).alias("lethal"), F.lit(0.3).alias("p50_sd"), F.lit(8.0).alias("slope_sd")).coalesce(1)
    d = draws.trait_draws(spark, t, {"p50": "p50_sd", "slope": "slope_sd"}, outer=20, inner=5)
    used = d.select(F.spark_partition_id().alias("p"), "outer_draw").distinct().collect()
    assert d.count() == 100 and len({r["p"] for r in used}) > 4 and len(used) == 20


def test_cells_of_repeated_points(spark):
    """The lowest cell, from one lookup per place; copies of a point and cells at one place are no more work."""
    rng = np.random.default_rng(2)
    at = rng.uniform(0, 3, (40, 2)).round(2)
    cells = rng.uniform(0, 3, (60, 2)).round(1)
    p = spark.createDataFrame([(i, float(at[i % 40, 0]), float(at[i % 40, 1])) for i in range(400)] + [(400, None, 1.0)], "rec long, lat double, lon double")
    c = spark.createDataFrame([(i, float(cells[i % 60, 0]), float(cells[i % 60, 1])) for i in range(240)], "pixel long, lat double, lon double")
    d = joins.cell_lookup(p, c, "rec", "pixel", 0.3, 0.4)
    got = {r["rec"]: r["pixel"] for r in d.collect()}
    assert len(got) == 401 and got[400] is None
    for i in range(400):
        hit = [k for k in range(60) if abs(at[i % 40, 0] - cells[k, 0]) <= 0.15 and abs(at[i % 40, 1] - cells[k, 1]) <= 0.2]
        assert got[i] == (min(hit) if hit else None)
    assert "SortMergeJoin" in plan(d)


def test_records_in_squares_are_not_one_task(spark):
    d = entry.queries()["flt_in_cell"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in plan(d) and "SortMergeJoin" in plan(d)


def test_every_pair_once(spark):
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.uniform(-30, 30, (150, 2)), rng.normal(2, 0.5, (60, 2)), np.full((10, 2), 4.0), np.arange(20)[:, None] * [5.0, 0.0]])
    keys = rng.permutation(len(at))
    d = spatial.own_pairs(spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in zip(keys, at)], "point long, x double, y double"), "point", 10.0)
    i, j = np.triu_indices(len(at), 1)
    dist = np.sqrt((at[i, 0] - at[j, 0]) ** 2 + (at[i, 1] - at[j, 1]) ** 2)
    want = sorted((int(min(keys[a], keys[b])), int(max(keys[a], keys[b])), float(x)) for a, b, x in zip(i, j, dist) if x <= 10.0)
    assert sorted(map(tuple, d.collect())) == want
    assert "BroadcastHashJoin" not in plan(d)


def test_pairs_of_one_crowded_cell_are_many_tasks(spark, monkeypatch):
    """Pairs of a cell are its rows squared, so its rows are dealt; each pair comes once all the same."""
    monkeypatch.setattr(spatial, "TOGETHER", 20)
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.uniform(0, 4, (200, 2)), rng.uniform(-30, 30, (60, 2))])
    d = spatial.own_pairs(spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(at)], "point long, x double, y double"), "point", 10.0)
    i, j = np.triu_indices(len(at), 1)
    dist = np.sqrt(((at[i] - at[j]) ** 2).sum(axis=1))
    assert sorted((r["i"], r["j"]) for r in d.collect()) == [(a, b) for a, b, x in zip(i.tolist(), j.tolist(), dist) if x <= 10.0]
    crowd = d.filter("i < 200 and j < 200").groupBy(F.spark_partition_id()).count().collect()
    assert len(crowd) >= 4 and max(r["count"] for r in crowd) < 200 * 199 / 2 / 2
