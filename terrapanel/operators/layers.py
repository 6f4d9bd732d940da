"""Gap filling, zone means, interpolation checks and export grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.operators.order_stats import exact_quantiles
from terrapanel.operators.neighbours import knn
from terrapanel.operators.spatial import idw
from terrapanel.tables import cut_lineage


def fill_from_nearest(grid: DataFrame, value: str) -> DataFrame:
    """Cells (row, col) without a value take the nearest cell that has one; ties go to the lower row, then column."""
    span = grid.agg(F.struct(F.min("col").alias("lo"), (F.max("col") - F.min("col") + 1).alias("n"))).scalar()
    key = F.col("row") * span["n"] + F.col("col") - span["lo"]
    g = grid.withColumn("_k", key)
    have = g.filter(F.col(value).isNotNull())
    gaps = g.filter(F.col(value).isNull()).select(F.col("_k").alias("_t"), "row", "col")
    nn = knn(have.withColumnRenamed("_k", "_n"), gaps, 1, "_n", "_t", ("row", "col"))
    filled = nn.join(have.select(F.col("_k").alias("_n"), value), "_n").join(gaps, "_t").select("row", "col", value)
    return have.select("row", "col", value).unionByName(filled)


def zone_area(raster: DataFrame, region: str, km2: Column) -> DataFrame:
    """Ground area and pixels per region."""
    return raster.groupBy(region).agg(F.sum(km2).alias("km2"), F.count(F.lit(1)).alias("n"))


def weighted_zone_mean(df: DataFrame, zone: str, value: str, weight: Column) -> DataFrame:
    v, w = F.col(value), F.when(F.col(value).isNotNull(), weight)
    return df.groupBy(zone).agg((F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("mean"), F.sum(w).alias("land"))


def elevation_slope(df: DataFrame, value: str, z: str) -> Column:
    """Global slope of value on elevation as a scalar; 0 with fewer than three rows or one elevation."""
    ok = (F.count(F.when(F.col(value).isNotNull(), F.col(z))) >= 3)
    return df.agg(F.coalesce(F.when(ok, F.regr_slope(value, z)), F.lit(0.0))).scalar()


def detrend(df: DataFrame, value: str, z: str, out: str = "resid") -> DataFrame:
    fit = df.agg(F.struct(F.regr_slope(value, z).alias("b"), F.regr_intercept(value, z).alias("a")).alias("f")).scalar()
    return df.withColumn("_f", fit).withColumn(out, F.col(value) - F.col("_f.a") - F.col("_f.b") * F.col(z)).drop("_f")


def leave_one_out(nodes: DataFrame, node: str, value: str, z: str, k: int = 8, power: float = 2.0) -> DataFrame:
    """Each node predicted from its k nearest others, plainly and along a slope refitted without it.

    The slope without a node comes from the global sums minus the node's own terms, so nothing is refitted.
    """
    v, e = F.col(value), F.col(z)
    both = nodes.filter(v.isNotNull() & e.isNotNull())
    mean = both.agg(F.struct(F.avg(v).alias("v"), F.avg(e).alias("z")).alias("m")).scalar()
    s = both.withColumn("_m", mean).select((v - F.col("_m.v")).alias("a"), (e - F.col("_m.z")).alias("b"))
    sums = s.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("ab"),
                          F.sum(F.col("b") * F.col("b")).alias("bb")).alias("s")).scalar()
    t = nodes.withColumn("_m", mean).withColumn("_s", sums)
    a, b = v - F.col("_m.v"), e - F.col("_m.z")
    n = F.col("_s.n") - 1
    sa, sb = F.col("_s.a") - a, F.col("_s.b") - b
    sxy = F.col("_s.ab") - a * b - sa * sb / n
    sxx = F.col("_s.bb") - b * b - sb * sb / n
    t = t.select(node, F.col(value).alias("_v"), F.col(z).alias("_tz"), F.coalesce(F.when((n >= 3) & (sxx > 0), sxy / sxx), F.lit(0.0)).alias("_b"))
    nb = knn(nodes, nodes.withColumnRenamed(node, "_t"), k, node, "_t", exclude="id").join(t.withColumnRenamed(node, "_t"), "_t")
    vals = nodes.select(node, value, F.col(z).alias("_nz"))
    plain = idw(nb, vals, value, node, "_t", power).withColumnRenamed("value", "_p0")
    elev = idw(nb, vals, value, node, "_t", power, ("_nz", "_tz"), F.col("_b")).withColumnRenamed("value", "_p1")
    j = plain.join(elev, "_t").join(t.withColumnRenamed(node, "_t"), "_t").filter(F.col("_v").isNotNull() & F.col("_p0").isNotNull())
    err = lambda p: (F.col("_v") - F.col(p)) * (F.col("_v") - F.col(p))
    sst = F.var_pop("_v") * F.count("_v")
    return j.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(err("_p0"))).alias("rmse"), (F.lit(1.0) - F.sum(err("_p0")) / F.nullif(sst, F.lit(0.0))).alias("r2"),
                 F.sqrt(F.avg(err("_p1"))).alias("rmse_elev"), (F.lit(1.0) - F.sum(err("_p1")) / F.nullif(sst, F.lit(0.0))).alias("r2_elev"))


def variogram_range(bins: DataFrame, share: float = 0.95) -> DataFrame:
    """First lag that reaches the share of the plateau (median of the last third of the bins); null below four bins."""
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("bin"))     # at most a few dozen bins
    b = bins.select("lag", "semivariance", F.row_number().over(w).alias("_k"), F.count(F.lit(1)).over(W.partitionBy(F.lit(0))).alias("_n"))
    tail = F.when(F.col("_k") <= F.greatest(F.floor(F.col("_n") / 3), F.lit(1)), F.col("semivariance"))
    sill = b.agg(F.percentile(tail, F.lit(0.5))).scalar()
    hit = F.min(F.when(F.col("semivariance") >= sill * share, F.col("lag")))
    return b.agg(F.when(F.count(F.lit(1)) >= 4, F.coalesce(hit, F.max("lag"))).alias("range"))


def nn_distance_summary(train: DataFrame, target: DataFrame, train_id: str, target_id: str, fold: str) -> DataFrame:
    """Median distance from targets to training rows, and from test rows to the training rows of other folds."""
    a = cut_lineage(knn(train, target, 1, train_id, target_id).select("dist"))
    t = train.withColumnRenamed(train_id, "_t")
    b = cut_lineage(knn(train, t, 1, train_id, "_t", exclude=fold).select("dist"))
    med = lambda d: exact_quantiles(d, "dist", [0.5]).agg(F.max("q")).scalar()
    one = train.limit(1).select(F.lit(1).alias("_"))
    return one.select(med(a).alias("target_to_train"), med(b).alias("cv_test_to_train"))


def layer_grid(long: DataFrame, inside: DataFrame, layers: Sequence[str], node: str) -> DataFrame:
    """One row per node with a column per layer, foreign nodes dropped, ordered from the north-west."""
    keep = inside.filter("inside").select(node)
    d = long.join(keep, node, "left_semi")
    g = d.groupBy(node, "lat", "lon").agg(*[F.avg(F.when(F.col("layer") == n, F.col("value"))).alias(n) for n in layers])
    return g.orderBy(F.desc("lat"), "lon")


def layer_status(plan: DataFrame, baseline: DataFrame, scenario: DataFrame) -> DataFrame:
    """Planned layers with whether a baseline and a scenario result exist."""
    b = baseline.select("layer").distinct().withColumn("_b", F.lit(True))
    s = scenario.select("layer").distinct().withColumn("_s", F.lit(True))
    j = plan.join(b, "layer", "left").join(s, "layer", "left")
    return j.select(*plan.columns, F.coalesce("_b", F.lit(False)).alias("baseline"), F.coalesce("_s", F.lit(False)).alias("scenario"))
