"""Quantiles of values that come out of sums of doubles, whose last bits depend on the order in which rows arrive."""

import random

import pytest
from pyspark.sql import functions as F

from terrapanel.operators import ensemble


def test_summary_reads_every_fraction_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def value(v):
        reads.add(1)
        return v + random.random() * 1e-9

    noisy = F.udf(value, "double").asNondeterministic()
    d = spark.range(25).select(noisy((F.col("id") * 7 % 25 / 25.0).cast("double")).alias("a"), noisy((F.col("id") * 3 % 25 / 50.0).cast("double")).alias("b"))
    got = {r["fraction"]: r for r in ensemble.partition_summary(d, ["a", "b"]).collect()}
    for name, top in (("a", 1.0), ("b", 0.5)):
        assert [got[name][c] for c in ("q25", "median", "q75")] == pytest.approx([top * k / 25 for k in (6, 12, 18)], abs=1e-6)
    assert reads.value == 50
