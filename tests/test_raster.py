"""Moving windows over tiles against windows cut from a dense array."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import raster as R

ROWS, COLS, LOW = 150, 101, -37


def cells(spark, seed=3, gaps=0.3):
    """A lattice that starts below zero and spans several tiles, with missing cells, null values and whole numbers as values."""
    rng = np.random.default_rng(seed)
    v = rng.integers(-50, 50, (ROWS, COLS)).astype(float)
    v[rng.random((ROWS, COLS)) < gaps] = np.nan
    v[0, 0], v[-1, -1] = 1.0, 2.0
    rows = [(r + LOW, c + LOW, float(v[r, c])) for r in range(ROWS) for c in range(COLS) if not math.isnan(v[r, c])]
    return spark.createDataFrame([*rows, (LOW + 3, LOW + 5, None), (None, LOW, 7.0), (LOW, None, 7.0)], "row bigint, col bigint, value double"), v


def windows(v, r, edges):
    """Sum and count of every window."""
    ok = ~np.isnan(v)
    pad = (lambda a: np.pad(a, r, mode="edge")) if edges else (lambda a: np.pad(a, r))
    s, n = pad(np.where(ok, v, 0.0)), pad(ok.astype(float))
    box = lambda a: np.lib.stride_tricks.sliding_window_view(a, (2 * r + 1, 2 * r + 1)).sum((2, 3))
    return box(s), box(n)


@pytest.mark.parametrize("radius, edges", [(0, False), (1, False), (5, True), (5, False), (60, True)])
def test_windows_of_every_cell(spark, radius, edges):
    df, v = cells(spark)
    got = {(r["row"] - LOW, r["col"] - LOW): (r["s"], r["n"]) for r in R.box_sums(df, radius, {"s": F.coalesce("value", F.lit(0.0)), "n": F.when(F.col("value").isNotNull(), 1).otherwise(0)}, edges).collect()}
    s, n = windows(v, radius, edges)
    for i in range(ROWS):
        for j in range(COLS):
            if n[i, j]:
                assert got[i, j] == (s[i, j], n[i, j])
            else:
                assert (i, j) not in got or got[i, j][1] == 0
    assert all(0 <= i < ROWS and 0 <= j < COLS for i, j in got)


def test_a_huge_or_infinite_value_spoils_its_own_windows_only(spark):
    rows = [(r, c, 1.0) for r in range(40) for c in range(40)]
    rows[5 * 40 + 5] = (5, 5, 1e300)
    rows[20 * 40 + 20] = (20, 20, float("inf"))
    rows[33 * 40 + 7] = (33, 7, float("nan"))
    got = {(r["row"], r["col"]): r["s"] for r in R.box_sums(spark.createDataFrame(rows, "row int, col int, value double"), 2, {"s": F.col("value")}).collect()}
    for (r, c), s in got.items():
        near = [(a, b) for a, b in ((5, 5), (20, 20), (33, 7)) if abs(a - r) <= 2 and abs(b - c) <= 2]
        if not near:
            assert s == (min(r, 2) + min(39 - r, 2) + 1) * (min(c, 2) + min(39 - c, 2) + 1)
    assert got[20, 20] == float("inf") and math.isnan(got[33, 7]) and got[5, 5] >= 1e300


def test_rows_of_one_cell_add_up_and_an_empty_table_gives_nothing(spark):
    df = spark.createDataFrame([(0, 0, 1.0, "x"), (0, 0, 2.0, "y"), (0, 1, 4.0, "z")], "row int, col int, value double, _block string")
    assert sorted(map(tuple, R.box_sums(df, 1, {"s": F.col("value")}).collect())) == [(0, 0, 7.0), (0, 1, 7.0)]
    assert R.box_sums(df.limit(0), 3, {"s": F.col("value")}, True).count() == 0
    assert R.window_mean(df.limit(0), 3).count() == 0


def test_shuffles_do_not_grow_with_the_radius(spark):
    n = 400
    df = spark.range(n * n).select(F.floor(F.col("id") / n).alias("row"), (F.col("id") % n).alias("col"), F.lit(1.0).alias("value"))
    plans = []
    for radius in (2, 12):
        out = R.box_sums(df, radius, {"s": F.col("value")})
        plan = out._jdf.queryExecution().executedPlan().toString()
        plans.append(plan.count("Exchange hashpartitioning"))
    assert plans[0] == plans[1] == 2  # one for rows of the same cell, one for the tiles
