"""Climate analogues by Mahalanobis distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.numeric import all_finite
from terrapanel.functions.special import chi_square_cdf
from terrapanel.operators.neighbours import LEAF, knn, planted, search
from terrapanel.tables import cut_lineage


def covariance(df: DataFrame, features: Sequence[str], ddof: int = 1) -> np.ndarray:
    """k x k covariance from one distributed aggregate (k is the number of variables)."""
    f = F.covar_samp if ddof else F.covar_pop
    k = len(features)
    row = df.agg(*[f(features[i], features[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    c = np.empty((k, k))
    for i in range(k):
        for j in range(i, k):
            c[i, j] = c[j, i] = row[f"c{i}_{j}"]
    return c


def whitened(df: DataFrame, features: Sequence[str], inverse_root: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """Features turned so that Euclidean distance equals Mahalanobis distance."""
    cols = []
    for i in range(len(features)):
        e = F.lit(0.0)
        for j, f in enumerate(features):
            e = e + F.col(f) * float(inverse_root[i, j])
        cols.append(e.alias(f"w{i}"))
    return df.select(*keep, *cols)


def nearest_analogue(targets: DataFrame, reference: DataFrame, features: Sequence[str], target_id: str, ref_id: str,
                     cov: np.ndarray | None = None) -> DataFrame:
    """Nearest reference row of every target: (target, reference, dist); ties go to the lower reference id.

    With one shared covariance (default: that of the reference) the features are whitened, which turns the search
    into the bucketed nearest-neighbour join: no target meets every reference row.
    """
    cov = covariance(reference, features) if cov is None else np.asarray(cov, dtype=float)
    root = np.linalg.cholesky(np.linalg.inv(cov)).T
    names = [f"w{i}" for i in range(len(features))]
    t = whitened(targets, features, root, [target_id])
    r = whitened(reference, features, root, [ref_id])
    return knn(r, t, 1, ref_id, target_id, names).drop("nn")


def analogue_own_covariance(targets: DataFrame, reference: DataFrame, features: Sequence[str], target_id: str, ref_id: str) -> DataFrame:
    """As above with each reference row's own covariance (columns ``cov`` and ``inv``, flat k x k arrays).

    The metric differs per row, but d^2 >= |x - m|^2 / trace(cov). So the least Mahalanobis distance to the rows of a target's own cell
    bounds the search: only cells within bound * sqrt(largest trace) can hold a nearer row. Rows with a missing feature or metric take no part.
    """
    k, d = len(features), [f"c{i}" for i in range(len(features))]
    inverse = [f"i{i}" for i in range(k * k)]
    coords = [F.col(f).cast("double").alias(c) for f, c in zip(features, d)]
    trace = sum((F.col("cov")[i * k + i] for i in range(1, k)), F.col("cov")[0])
    ref = reference.select(F.col(ref_id).alias("nid"), F.lit(0).cast("bigint").alias("fold"), *coords, *[F.col("inv")[i].cast("double").alias(c) for i, c in enumerate(inverse)], trace.alias("_trace"))
    ref = cut_lineage(ref.where(all_finite([*d, *inverse, "_trace"])))
    widest = ref.agg(F.max("_trace")).first()[0]
    targets = targets.select(F.col(target_id).alias("tid"), *coords).where(all_finite(d))
    places = cut_lineage(targets.select(*d).distinct().select(F.monotonically_increasing_id().alias("pid"), F.lit(0).cast("bigint").alias("fold"), F.lit(None).cast("double").alias("bound"), *d))

    def squared(to, at, inv):
        step = [x[:, None] - y[None, :] for x, y in zip(to, at)]
        d2 = np.zeros(step[0].shape)
        for a in range(k):
            for b in range(k):
                if inv[a * k + b].any():
                    d2 += step[a] * step[b] * inv[a * k + b][None, :]
        return np.maximum(d2, 0.0)

    nodes, trees = planted(ref.drop("_trace"), k, LEAF)
    near = search(places, nodes, trees, k, 1, False, dict(nodes.dtypes)["nid"], squared, inverse, float(widest or 0.0) * (1 + 1e-9))
    best = targets.join(near.where(F.size("near") > 0), d).select("tid", F.col("near")[0].alias("b"))
    return best.select(F.col("tid").alias(target_id), F.col("b.nid").alias(ref_id), F.sqrt("b.d2").alias("dist"))


def novelty(df: DataFrame, dist: str, k: int, out: str = "novelty") -> DataFrame:
    """Chi-square percentile of the squared distance with k variables."""
    return df.withColumn(out, chi_square_cdf(F.col(dist) * F.col(dist), k))
