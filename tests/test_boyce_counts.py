"""Boyce index of counted rows, and blocked validation that grows with distinct records."""

import pytest
from pyspark.sql import functions as F

from terrapanel.operators import niche as N
from terrapanel.plans import niche as Pl


def scores(spark):
    return spark.range(400).select((F.col("id") % 2).alias("g"), ((F.col("id") * 37) % 101 / 100.0).alias("s"), (F.col("id") % 3 == 0).alias("pres"), (F.col("id") % 4 + 1).alias("c"))


def test_counted_rows_equal_their_copies(spark):
    d = scores(spark)
    copies = d.select("g", "s", "pres", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))))
    got = {r["g"]: r for r in N.boyce_index(d, "s", "pres", ["g"], count="c").collect()}
    want = {r["g"]: r for r in N.boyce_index(copies, "s", "pres", ["g"]).collect()}
    assert len(got) == 2
    for g in want:
        assert got[g]["boyce"] == pytest.approx(want[g]["boyce"]) and got[g]["n_windows"] == want[g]["n_windows"]


def test_windows_are_counted_without_a_sort(spark):
    """A sort of every row's dozen copies would take memory that grows with the rows."""
    plan = N.boyce_windows(scores(spark), "s", "pres", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "HashAggregate" in plan


def test_repeated_records_do_not_grow_the_training_rows(spark, monkeypatch):
    """Ten times the records at the same places: ten times the counts, the same number of training rows."""
    p = spark.range(600).select(F.lit("a").alias("species"), ((F.col("id") * 7) % 40 / 10.0).alias("f0"), ((F.col("id") * 13) % 30 / 10.0).alias("lon"), ((F.col("id") * 17) % 30 / 10.0).alias("lat"))
    b = spark.range(300).select(((F.col("id") * 11) % 50 / 10.0).alias("f0"), ((F.col("id") * 3) % 30 / 10.0).alias("lon"), ((F.col("id") * 19) % 30 / 10.0).alias("lat"))
    seen, fit = [], Pl.fit_logistic
    monkeypatch.setattr(Pl, "fit_logistic", lambda d, *a, **k: (seen.append(d.count()), fit(d, *a, **k))[1])
    tens = lambda d: d.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("_r")
    one = {r["fold"]: r for r in Pl.blocked_validation(p, b, ["f0"], "lon", "lat", 0.5).collect()}
    ten = {r["fold"]: r for r in Pl.blocked_validation(tens(p), tens(b), ["f0"], "lon", "lat", 0.5).collect()}
    assert one and set(one) == set(ten) and seen[0] == seen[1] < 4 * 900
    assert all(ten[f]["n_train"] == 10 * one[f]["n_train"] and ten[f]["n_test"] == 10 * one[f]["n_test"] for f in one)
