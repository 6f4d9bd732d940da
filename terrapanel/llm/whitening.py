"""Operator 11: whitening of embeddings with MLlib's BlockMatrix.

Centred rows get consecutive numbers and become distributed blocks. The transposed blocks times the blocks give the scatter
(partial products per split of the rows, summed before they meet), whose eigenvectors are found on the driver: it is as wide
as the vectors, whatever the number of rows. The blocks times the whitening matrix are the projected rows.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import stored

ENTRIES = 2**18  # of a block: 2 MB
WIDTH = 1024  # columns of a block at most
TOGETHER = 8  # row blocks that one task multiplies
FAR = 2.0**62
LOW = 24  # bits of the lower part of a sum
SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def fixed_point(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * c) + offset of every entry as long; null if the vector is null, or an entry is null or not finite."""
    v = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * float(scale), F.lit(FAR)), F.lit(-FAR))) + offset)
    return F.when(~F.coalesce(bad, F.lit(True)), held)


def numbered(rows: DataFrame, column: str = "index") -> DataFrame:
    """``rows``, written once and numbered from 0: each file's first number is the count of the rows in those before it.

    The driver sees one count per task that wrote.
    """
    place = F.monotonically_increasing_id()
    kept = stored(rows.select("*", F.shiftright(place, 33).cast("int").alias("_part"), place.bitwiseAND(2**33 - 1).alias("_place")))
    counts = sorted(tuple(r) for r in kept.groupBy("_part").count().collect())
    first = itertools.accumulate((c for _, c in counts), initial=0)
    offsets = rows.sparkSession.createDataFrame([(p, f) for (p, _), f in zip(counts, first, strict=False)], "_part int, _first bigint")
    return kept.join(F.broadcast(offsets), "_part").withColumn(column, F.col("_first") + F.col("_place")).drop("_part", "_place", "_first")


def to_blocks(rows: DataFrame, n: int, width: int, block_width: int | None = None) -> BlockMatrix:
    """The BlockMatrix of (index, v): ``n`` rows of ``width`` doubles."""
    across = block_width or min(width, WIDTH)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(max(1, ENTRIES // across) if block_width is None else across, across)


def scatter(blocks: BlockMatrix, n: int) -> np.ndarray:
    """Transposed blocks times blocks over ``n``, added up per split of the rows first."""
    splits = max(1, blocks.numRowBlocks // TOGETHER)
    left, right = blocks.transpose(), blocks
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock).toLocalMatrix().toArray() / n


def project(blocks: BlockMatrix, matrix: np.ndarray, like: DataFrame) -> DataFrame:
    """(index, v): the rows times ``matrix``, which has as many rows as the blocks have columns."""
    spark = like.sparkSession
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(matrix)], "index bigint, v array<double>")
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("v")), "v")
    right = IndexedRowMatrix(vectors, *matrix.shape).toBlockMatrix(blocks.colsPerBlock, matrix.shape[1])
    product = blocks.multiply(right).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array(F.col("vector")).alias("v"))


def principal(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The greatest eigenvalues falling, their unit eigenvectors as columns, and the trace; 0 for a value that is rounding."""
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    return np.where(e > 4 * len(cov) * np.finfo(float).eps * max(e.max(initial=0.0), 0.0), e, 0.0), w, float(np.trace(cov))


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row and its first components.

    A row takes no part if its vector is null, empty, or holds null or non-finite entries; so does one whose length is not
    the most frequent (the longer of two equally frequent), for it has no entry in some dimension. Entries so large that
    scale * c leaves plus or minus 2^62 are held there. Repeated rows and rows without or with the same vec_id are rows of their own.
    A deviation beyond a long is null. A component without variance (rows that are all equal, fewer independent
    dimensions than components) has a null ``whitened`` and is left out of identity_error, which is null if none is left; so
    is ``explained`` if the trace is 0. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), fixed_point(F.col("embedding"), scale, offset).alias("x")).where("size(x) > 0")
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], "vec_id bigint, " + SCHEMA)
    d, n = usual
    rows = numbered(rows.where(F.size("x") == d))
    halves = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(
        F.sum(F.shiftright("x", LOW)).alias("high"), F.sum(F.col("x").bitwiseAND(2**LOW - 1)).alias("low"))
    total = {r.i: (r.high << LOW) + r.low for r in halves.collect()}  # one row per dimension
    whole, rest = zip(*(divmod(total[i], n) for i in range(d)), strict=True)
    mean, part = F.lit([*whole]).cast("array<bigint>"), F.lit([*rest]).cast("array<bigint>")
    centred = F.transform("x", lambda v, i: (v - mean[i]).cast("double") - part[i].cast("double") / float(n))
    apart = F.transform("x", lambda v, i: F.try_subtract(F.try_multiply(F.lit(n).cast("bigint"), v - mean[i]), part[i]))
    deviation = F.aggregate(apart, F.lit(0).cast("bigint"), lambda s, v: F.try_add(s, F.try_multiply(v, v)))

    blocks = to_blocks(rows.select("index", centred.alias("v")), n, d)
    e, w, trace = principal(scatter(blocks, n), components)
    factor = np.divide(1.0, np.sqrt(e), out=np.zeros_like(e), where=e > 0)
    projected = stored(project(blocks, w * factor, vectors))
    error = identity_error(projected, n, e > 0)

    named = F.transform("v", lambda z, i: F.struct((i + 1).alias("component"), F.when(F.lit([bool(x) for x in e > 0])[i], z).alias("whitened"),
                                                   F.lit([float(x / trace) if trace > 0 else None for x in e]).cast("array<double>")[i].alias("explained")))
    out = rows.select("index", "vec_id", deviation.alias("deviation")).join(projected, "index").select("vec_id", "deviation", F.explode(named).alias("c"))
    return out.select("vec_id", F.col("c.component").cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "c.whitened", "c.explained",
                      F.lit(error).cast("double").alias("identity_error"))


def identity_error(projected: DataFrame, n: int, kept: np.ndarray) -> float | None:
    """The largest absolute entry of the covariance of the kept columns of v (centred first) minus the identity."""
    k = int(kept.sum())
    if not k:
        return None
    means = projected.select(F.posexplode("v").alias("i", "z")).groupBy("i").agg(F.avg("z").alias("m")).collect()
    mean = F.lit([r.m for r in sorted(means)])
    rows = projected.select("index", F.transform("v", lambda z, i: z - mean[i]).alias("v"))
    cov = scatter(to_blocks(rows, n, len(kept)), n)
    return float(np.abs(cov[np.ix_(kept, kept)] - np.eye(k)).max())
