"""Row filters, masks, status columns and guards that refuse bad inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.numeric import all_finite, finite
from terrapanel.operators.order_stats import exact_quantiles
from terrapanel.operators.raster import point_to_raster


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose every listed input is a finite number."""
    return df.filter(all_finite(columns))


def mask_status(df: DataFrame, inputs: Sequence[str], derived: Sequence[str], out: str = "status") -> DataFrame:
    """skipped_missing: an input is null; skipped_nonfinite: a value is NaN or infinite, or a derived one is absent; else ok."""
    missing = F.lit(False)
    for c in inputs:
        missing = missing | F.col(c).isNull()
    return df.withColumn(out, F.when(missing, "skipped_missing").when(~all_finite([*inputs, *derived]), "skipped_nonfinite").otherwise("ok"))


def country_mask(points: DataFrame, mask: DataFrame, x: str, y: str, x0: float, y0: float, res: float, out: str = "inside") -> DataFrame:
    """Adds whether the point's mask cell is inside; a point off the grid is outside."""
    d = point_to_raster(points, mask, x, y, x0, y0, res)
    return d.withColumn(out, F.coalesce(F.col("value").cast("boolean"), F.lit(False))).drop("row", "col", "value")


def build_mask(cells: DataFrame, classes: DataFrame, bbox: tuple, shape: tuple, x0: float, y0: float, res: float) -> DataFrame:
    """Grid cells (row, col) with inside = the class under the cell centre is mapped (> 0), and the cell's area in km2."""
    lon0, lat0, lon1, lat1 = bbox
    rows, cols = shape
    dlat, dlon = (lat1 - lat0) / rows, (lon1 - lon0) / cols
    c = cells.select(F.col("row").alias("mrow"), F.col("col").alias("mcol"),
                     (F.lit(lat1) - (F.col("row") + 0.5) * dlat).alias("lat"), (F.lit(lon0) + (F.col("col") + 0.5) * dlon).alias("lon"))
    d = point_to_raster(c, classes, "lon", "lat", x0, y0, res)
    km2 = F.cos(F.radians("lat")) * (111.195 * dlat * 111.195 * dlon)
    return d.select(F.col("mrow").alias("row"), F.col("mcol").alias("col"), F.coalesce(F.col("value") > 0, F.lit(False)).alias("inside"), km2.alias("km2"))


def in_cell(lat, lon, lat0, lon0, half: float) -> Column:
    """Inside the square around a node: lower edges in, upper edges out."""
    a, b, c, d = (F.col(v) if isinstance(v, str) else v for v in (lat, lon, lat0, lon0))
    return (a >= c - half) & (a < c + half) & (b >= d - half) & (b < d + half)


def reference_period(df: DataFrame, date: str, first: int = 1991, last: int = 2020) -> DataFrame:
    """Rows of the reference years, as a date range so that the scan can use it."""
    c = F.col(date)
    return df.filter((c >= F.make_date(F.lit(first), F.lit(1), F.lit(1))) & (c < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1))))


def quality_gate(models: DataFrame, minimum: float = 0.30) -> DataFrame:
    """Models that were fitted and reach the mean Boyce index."""
    return models.filter((F.col("status") == "fitted") & (finite("boyce_mean") >= minimum))


def eligibility(units: DataFrame, min_open: float = 0.10) -> DataFrame:
    """eligible = inside, not protected, at most half human-modified or water (no map coverage counts as none), and enough open land."""
    modified = F.coalesce(F.col("modified_share") + F.col("water_share"), F.lit(0.0))
    covered = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    open_share = F.least(F.greatest(F.lit(1.0) - covered("forest") - covered("woodland") - covered("water"), F.lit(0.0)), F.lit(1.0))
    d = units.withColumn("open_share", open_share)
    site = F.col("inside") & (F.col("protected") < 0.5) & (modified <= 0.5)
    return d.withColumn("eligible", F.coalesce(site, F.lit(False)) & (F.col("open_share") >= min_open))


def disturbance_layer_check(pixel_year: DataFrame, year: str = "year", nd: str = "nd", first: int = 2001, last: int = 2023,
                            minimum: float = 0.5) -> DataFrame:
    """Share of undisturbed pixels per checked year; raises for a year below the minimum."""
    s = pixel_year.filter(F.col(year).between(first, last)).groupBy(year).agg(F.avg(F.col(nd).cast("double")).alias("share"))
    return s.withColumn("share", F.when(F.col("share") < minimum, F.raise_error(F.lit("implausible disturbance layer")).cast("double")).otherwise(F.col("share")))


def quantile_holdout(df: DataFrame, value: str, share: float = 0.7, out: str = "train") -> DataFrame:
    """Marks the rows up to the quantile as training, the rest as test."""
    cut = exact_quantiles(df, value, [share]).agg(F.max("q")).scalar()
    return df.withColumn(out, F.col(value) <= cut)


def coverage_guard(df: DataFrame, bad: Column, allowed: float, message: str = "too many rows were lost") -> DataFrame:
    """Rows that are not bad; raises when their lost share exceeds what is allowed."""
    lost = df.agg(F.avg(bad.cast("double"))).scalar()
    guard = F.when(lost > allowed, F.raise_error(F.lit(message)).cast("boolean")).otherwise(~bad)
    return df.filter(guard)


def treeline_above(cells: DataFrame, elevation: str = "z", treeline: str = "treeline") -> DataFrame:
    return cells.select("*", (F.col(elevation) > F.col(treeline)).alias("above"), (F.col(treeline) - F.col(elevation)).alias("headroom"))
