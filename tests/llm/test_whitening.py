"""Operator 11 against NumPy on the whole table, and on odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import whitening
from terrapanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def numpy_version(ids, vectors, k=8):
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(d) ** 2 for d in row) for row in n * x.astype(object) - s.astype(object)]
    c = x - s / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return n, dict(zip(ids, deviation, strict=True)), c @ w / np.sqrt(e), e / np.trace(v)


def compare(got, ids, vectors, k=8):
    n, deviation, z, explained = numpy_version(ids, vectors, k)
    rows = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(rows) == len(ids) * k
    assert all(r.n == n and r.deviation == deviation[i] for (i, _), r in rows.items())
    mine = np.array([[rows[i, c + 1].whitened for c in range(k)] for i in ids])
    assert np.abs(mine * np.sign((mine * z).sum(axis=0)) - z).max() < 1e-8
    assert np.allclose([rows[ids[0], c + 1].explained for c in range(k)], explained, rtol=1e-9)
    assert {r.identity_error for r in rows.values()} == {rows[ids[0], 1].identity_error} and 0 <= rows[ids[0], 1].identity_error < 1e-9
    assert np.abs(mine.T @ mine / n - np.eye(k)).max() < 1e-9


@pytest.mark.parametrize("entries", [whitening.ENTRIES, 64 * 30])
def test_whole_table(spark, monkeypatch, entries):
    """In one block, and in blocks of 30 rows that several tasks multiply."""
    monkeypatch.setattr(whitening, "ENTRIES", entries)
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(QUERIES["op11_whitening"](spark, SF), [r.vec_id for r in table], [r.embedding for r in table])


def test_columns_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "WIDTH", 16)
    monkeypatch.setattr(whitening, "ENTRIES", 16 * 100)
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    rows = table.collect()
    compare(whitening.whiten(table, components=40), [r.vec_id for r in rows], [r.embedding for r in rows], k=40)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(3)
    made = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(20)]
    bad = [(100, None), (101, [None, 1.0, 1.0]), (102, [inf, 1.0, 1.0]), (103, [1.0, nan, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [1.0] * 4)]
    schema = "vec_id bigint, embedding array<float>, index int, x string, v string, n int, component int"
    df = spark.createDataFrame([(*x, 1, "?", "?", 1, 1) for x in made + bad], schema)
    compare(whitening.whiten(df), [i for i, _ in made], [np.float32(v) for _, v in made], k=3)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id > 99 and vec_id < 105")).count() == 0
    assert whitening.whiten(df.limit(0)).columns == whitening.whiten(df).columns
    one = whitening.whiten(df.where("vec_id = 1")).collect()
    assert len(one) == 3 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    twice = df.where("vec_id < 20").union(df.where("vec_id = 3")).withColumn("vec_id", F.when(F.col("vec_id") != 5, F.col("vec_id")))
    got = whitening.whiten(twice)
    assert got.count() == 63 and got.where("vec_id is null").count() == 3 and got.where("vec_id = 3").count() == 6 and got.first().n == 21
    flat = df.where("vec_id < 20").withColumn("embedding", F.transform("embedding", lambda c, i: F.when(i == 2, F.lit(7.0)).otherwise(c).cast("float")))
    got = whitening.whiten(flat)
    assert got.where("component = 3 and whitened is null").count() == 20 and got.where("component < 3 and whitened is not null").count() == 40
    assert got.first().identity_error < 1e-9
    huge = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(huge).where("deviation is null").count() == 4
