"""Nearest neighbours by bounded cells: equal to NumPy, with bounded reads in five coordinates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import neighbours

FEATURES = [f"f{i}" for i in range(5)]


@pytest.fixture(scope="module")
def world(spark):
    """6,000 nodes with five unrelated features in spatial folds, a dense cluster, a place held by a sixth of the nodes and one far outlier."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (3999, 5)), rng.normal(3, 0.01, (1000, 5)), np.full((1000, 5), 0.5), [[1e7] * 5]])
    fold = np.where(x[:, 0] < -0.5, 0, np.where(x[:, 0] < 0.7, 1, 2))
    t = np.vstack([rng.normal(0, 1, (150, 5)), rng.normal(3, 0.02, (50, 5)), np.full((20, 5), 0.5), [[-50.0] * 5], [[2e7] * 5], x[-1:]])
    tfold = np.where(t[:, 0] < -0.5, 0, np.where(t[:, 0] < 0.7, 1, 2))
    rows = lambda a, f: [(i, *map(float, r), int(g)) for i, (r, g) in enumerate(zip(a, f))]
    schema = ", ".join(f"{c} double" for c in FEATURES) + ", fold int"
    nodes = spark.createDataFrame(rows(x, fold), "node bigint, " + schema).repartition(4).cache()
    return nodes, spark.createDataFrame(rows(t, tfold), "target bigint, " + schema).cache(), x, fold, t, tfold


def brute(x, fold, t, tfold, k, mode):
    d2 = np.zeros((len(t), len(x)))
    for i in range(x.shape[1]):
        d2 += (t[:, i, None] - x[None, :, i]) ** 2
    if mode == "fold":
        d2[tfold[:, None] == fold[None, :]] = np.inf
    if mode == "id":
        d2[np.arange(len(t)), np.arange(len(t))] = np.inf
    return [[(int(n), float(np.sqrt(d2[r, n]))) for n in np.lexsort((np.arange(len(x)), d2[r]))[:k] if np.isfinite(d2[r, n])] for r in range(len(t))]


@pytest.mark.parametrize("mode", ["plain", "fold", "id"])
@pytest.mark.parametrize("leaf", [64, 2048])
def test_five_features(world, mode, leaf):
    nodes, targets, x, fold, t, tfold = world
    if mode == "id":
        targets, t, tfold = nodes.where("node < 300").withColumnRenamed("node", "target"), x[:300], fold[:300]
    got = [[] for _ in t]
    rows = neighbours.knn(nodes, targets, 4, coords=FEATURES, exclude=None if mode == "plain" else mode, leaf=leaf).orderBy("target", "nn").collect()
    for r in rows:
        got[r.target].append((r.node, r.dist))
        assert r.nn == len(got[r.target])
    assert got == brute(x, fold, t, tfold, 4, mode)


def test_reads_are_bounded(world):
    """A target meets a small share of the nodes, whatever outliers and dense places there are; cells hold at most 64 places."""
    nodes, targets, *_ = world
    places = nodes.select("node", *FEATURES).dropDuplicates(FEATURES).select(F.col("node").alias("nid"), F.lit(0).cast("bigint").alias("fold"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(FEATURES)])
    made, rounds = neighbours.grow(places, 5, 64)
    sizes = [r["count"] for r in made.groupBy("cell").count().collect()]
    assert max(sizes) <= 64 and len(sizes) < 40 * len(FEATURES) * 5000 / 64 and rounds <= 6
    aims = targets.select(F.col("target").alias("pid"), F.lit(0).cast("bigint").alias("fold"), F.lit(None).cast("double").alias("bound"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(FEATURES)])
    open_ = neighbours.candidates(aims, made, 5, rounds, 1, False, "bigint")
    reads = open_.join(made.groupBy("cell").count(), "cell").groupBy("pid").agg(F.sum("count").alias("n")).collect()
    n = [r.n for r in reads]
    assert len(n) == targets.count() and np.mean(n) < 0.1 * 5000 and max(n) < 0.4 * 5000


def test_missing_values_and_text_keys(spark):
    nodes = spark.createDataFrame([("b", 0.0, 0.0, "u"), ("a", 0.0, 0.0, "u"), ("c", 1.0, 0.0, "v"), ("d", None, 0.0, "v"), ("e", 0.5, 0.0, None)], "node string, x double, y double, fold string")
    targets = spark.createDataFrame([(1, 0.0, 0.0, "u"), (2, float("nan"), 0.0, "u"), (3, 2.0, 0.0, None)], "target int, x double, y double, fold string")
    plain = [tuple(r) for r in neighbours.knn(nodes, targets, 3).orderBy("target", "nn").collect()]
    assert plain == [(1, "a", 0.0, 1), (1, "b", 0.0, 2), (1, "e", 0.5, 3), (3, "c", 1.0, 1), (3, "e", 1.5, 2), (3, "a", 2.0, 3)]
    assert [tuple(r) for r in neighbours.knn(nodes, targets, 3, exclude="fold").collect()] == [(1, "c", 1.0, 1)]
    assert neighbours.knn(nodes.limit(0), targets, 3).count() == 0 and neighbours.knn(nodes, targets.limit(0), 3).count() == 0
