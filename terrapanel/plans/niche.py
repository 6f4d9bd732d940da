"""Fitted niche models applied to nodes and scenario members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.ecology import logistic
from terrapanel.functions.numeric import all_finite
from terrapanel.operators.filters import quality_gate
from terrapanel.operators.models import fit_logistic
from terrapanel.operators.niche import boyce_index, group_support
from terrapanel.operators.splits import block_folds
from terrapanel.tables import cut_lineage, small


def apply_niche(nodes: DataFrame, models: DataFrame, features: Sequence[str], keys: Sequence[str], min_boyce: float = 0.30) -> DataFrame:
    """(keys..., grp, supported) for every node row and group: true where any passing species reaches its threshold,
    null for a group without a passing species.

    ``models`` (species, grp, status, boyce_mean, intercept, coef, threshold) has one row per species and is carried as
    one array per node row.
    """
    passing = quality_gate(models, min_boyce)
    packed = passing.agg(F.collect_list(F.struct("species", "intercept", "coef", "threshold"))).scalar()
    x = F.array(*[F.col(f) for f in features])
    d = nodes.select(*keys, x.alias("_x"), F.explode(packed).alias("_m"))
    z = F.aggregate(F.zip_with("_x", "_m.coef", lambda a, b: a * b), F.col("_m.intercept"), lambda s, v: s + v)
    s = d.select(*keys, F.col("_m.species").alias("species"), F.coalesce(logistic(z) >= F.col("_m.threshold"), F.lit(False)).alias("suitable"))
    groups = nodes.select(*keys, F.explode(models.agg(F.collect_set("grp")).scalar()).alias("grp"))
    return group_support(s, passing.select("species", "grp"), groups, keys)


def blocked_validation(occ: DataFrame, background: DataFrame, features: Sequence[str], x: str, y: str, size: float, species: str = "species", k: int = 5,
                       C: float = 1.0, minimum: int = 25, train_minimum: int = 5, test_minimum: int = 3, seed: int = 0) -> DataFrame:
    """Spatially blocked validation of the presence-background models: (species, fold, n_train, n_test, boyce).

    Presences and the shared background are cut into blocks of ``size`` degrees on one grid, so a fold is the same place for all species.
    Every (species, fold) is one group of one balanced ridge fit: all of them move together, one aggregate per round, and the driver
    sees their sums only. Equal records are counted before they are copied; one trains k - 1 folds and is scored by the fold it lies in; scores are rounded to nine places,
    so that no window of the index hangs on the last bit of a fit. A species with fewer than ``minimum`` complete records has no row, a fold
    with too few training records of a kind or too few presences to score has none either; an index of fewer than three windows is null.
    Records without a place or a predictor are left out.
    """
    whole = all_finite([*features, x, y])
    cols = [*features, x, y]
    pres = occ.filter(whole & F.col(species).isNotNull()).select(species, *cols)
    fit = pres.groupBy(species).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum).select(species)
    both = pres.join(fit, species, "left_semi").withColumn("_y", F.lit(1.0)).unionByName(
        background.filter(whole).select(F.lit(None).cast(dict(occ.dtypes)[species]).alias(species), *cols, F.lit(0.0).alias("_y")))
    placed = block_folds(both, x, y, size, k, seed).groupBy(species, *features, "_y", F.col("fold").alias("_own")).agg(F.count(F.lit(1)).alias("_c"))
    names = fit.agg(F.sort_array(F.collect_set(species))).scalar()
    # written once; its true size is known from here on, where an estimate from the files would broadcast the copies
    placed = cut_lineage(placed).withColumn(species, F.explode(F.when(F.col(species).isNull(), names).otherwise(F.array(species))))
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")).alias("fold")
    train = placed.select("*", folds).filter(F.col("fold") != F.col("_own")).drop("_own")
    size_of = train.groupBy(species, "fold").agg(F.sum(F.when(F.col("_y") == 1, F.col("_c")).otherwise(0)).alias("_p"), F.sum(F.when(F.col("_y") == 0, F.col("_c")).otherwise(0)).alias("_b"))
    test = placed.withColumnRenamed("_own", "fold")
    tested = test.groupBy(species, "fold").agg(F.sum(F.when(F.col("_y") == 1, F.col("_c")).otherwise(0)).alias("n_test"))
    use = cut_lineage(size_of.filter((F.col("_p") >= train_minimum) & (F.col("_b") >= train_minimum)).join(
        tested.filter(F.col("n_test") >= test_minimum), [species, "fold"]))
    name = F.to_json(F.struct(F.col(species), F.col("fold")))
    d = train.join(small(use), [species, "fold"]).withColumn("_m", name)
    weight = F.col("_c") * (F.col("_p") + F.col("_b")) / (F.when(F.col("_y") == 1, F.col("_p")).otherwise(F.col("_b")) * 2.0)
    beta = fit_logistic(d, features, "_y", "_m", weight, 1.0 / C)
    models = occ.sparkSession.createDataFrame([(g, [float(v) for v in b]) for g, b in beta.items()], "_m string, _coef array<double>")
    z = F.col("_coef")[0]
    for i, f in enumerate(features):
        z = z + F.col("_coef")[i + 1] * F.col(f)
    scored = test.withColumn("_m", name).join(small(models), "_m").select(species, "fold", F.round(logistic(z), 9).alias("_s"), (F.col("_y") == 1).alias("_pres"), "_c")
    b = boyce_index(scored, "_s", "_pres", [species, "fold"], count="_c")
    return use.join(b.select(species, "fold", "boyce"), [species, "fold"], "left").select(
        species, "fold", (F.col("_p") + F.col("_b")).alias("n_train"), "n_test", "boyce")


def mean_boyce(folds: DataFrame, species: str = "species") -> DataFrame:
    """Mean index per species over the folds that have one (null without any)."""
    return folds.groupBy(species).agg(F.avg("boyce").alias("boyce_mean"), F.count("boyce").alias("n_folds"))
