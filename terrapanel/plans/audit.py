"""Audit of a location-dependent target: random against blocked validation and location-proxy checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.numeric import mix32
from terrapanel.operators.models import assembled
from terrapanel.operators.neighbours import knn
from terrapanel.operators.scores import regression_scores
from terrapanel.operators.splits import block_folds
from terrapanel.tables import cut_lineage


def forest_out_of_fold(df: DataFrame, features: Sequence[str], y: str, fold: str, trees: int = 200, depth: int = 15, seed: int = 42) -> DataFrame:
    """Rows with the prediction of a forest fitted on the other folds (folds are a handful)."""
    # one small file would be one task in every pass of the forests
    d = cut_lineage(assembled(df.repartition(max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)), features))
    parts = []
    for f in sorted(r[0] for r in d.select(fold).distinct().collect()):
        rf = RandomForestRegressor(labelCol=y, featuresCol="_features", numTrees=trees, maxDepth=depth, seed=seed)
        model = rf.fit(d.filter(F.col(fold) != f))
        parts.append(model.transform(d.filter(F.col(fold) == f)).drop("_features"))
    return reduce(DataFrame.unionByName, parts)


def location_audit(df: DataFrame, key: str, x: str, y: str, features: Sequence[str], target: str, block_sizes: Sequence[float], seed: int = 0, k: int = 5, **forest: int) -> DataFrame:
    """Long table (check, subject, value): R2 and mean absolute error of the features and of the coordinates alone under random and blocked
    folds, R2 of predicting each coordinate from the features, and the correlation with the nearest neighbour."""
    d = cut_lineage(df.select(key, x, y, target, *[F.col(f).cast("double").alias(f) for f in features]))
    rows = []
    designs = [("random", d.withColumn("fold", F.pmod(mix32(key, seed=seed), F.lit(k))))]
    designs += [(f"block_{b:g}", block_folds(d, x, y, b, k, seed)) for b in block_sizes]
    for name, folded in designs:
        for label, cols in (("features", list(features)), ("coordinates", [x, y])):
            r = regression_scores(forest_out_of_fold(folded, cols, target, "fold", **forest), "prediction", target).first()
            rows += [(f"{name}_r2", label, r["r2"]), (f"{name}_mae", label, r["mae"])]
    for c in (x, y):
        r = regression_scores(forest_out_of_fold(designs[0][1], list(features), c, "fold", **forest), "prediction", c).first()
        rows.append(("features_predict_location_r2", c, r["r2"]))
    nn = knn(d.withColumnRenamed(key, "_n"), d.withColumnRenamed(key, "_t"), 1, "_n", "_t", (x, y), exclude="id")
    near = d.select(F.col(key).alias("_n"), *[F.col(c).alias(f"n_{c}") for c in (target, *features)])
    j = nn.join(near, "_n").join(d.withColumnRenamed(key, "_t"), "_t")
    c = j.agg(*[F.corr(v, f"n_{v}").alias(v) for v in (target, *features)]).first()
    rows += [("nearest_neighbour_correlation", v, c[v]) for v in (target, *features)]
    return df.sparkSession.createDataFrame([(a, b, None if v is None else float(v)) for a, b, v in rows], "check string, subject string, value double")
