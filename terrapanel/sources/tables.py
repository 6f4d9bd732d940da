"""Ingest of layers, occurrences, traits, scenarios and manifests."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.numeric import clip
from terrapanel.functions.weather import vp_from_humidity
from terrapanel.operators.order_stats import kth_smallest


def flux_to_depth(df: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """Precipitation in mm per day; raises unless the table holds one of the two known units throughout."""
    units = df.agg(F.collect_set(unit)).scalar()
    known = F.col(unit).isin("kg m-2 s-1", "mm day-1") & (F.size(units) == 1)
    factor = F.when(F.col(unit) == "kg m-2 s-1", 86400.0).otherwise(1.0)
    bad = F.raise_error(F.lit("precipitation units are mixed or unknown")).cast("double")
    return df.withColumn(value, F.when(known, F.col(value) * factor).otherwise(bad)).withColumn(unit, F.lit("mm day-1"))


def vapour_from_humidity(hurs: DataFrame, tas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Same-day vapour pressure of two variables; raises when a day of either side has no partner."""
    ks = list(keys)
    j = hurs.select(*ks, F.col("value").alias("_h")).join(tas.select(*ks, F.col("value").alias("_t")), ks, "full")
    lone = F.col("_h").isNull() | F.col("_t").isNull()
    ea = vp_from_humidity(clip("_h", 0.0, 100.0), "_t")
    return j.select(*ks, F.when(lone, F.raise_error(F.lit("unmatched days between humidity and temperature")).cast("double")).otherwise(ea).alias("ea"))


def clean_occurrences(df: DataFrame, bbox: tuple) -> DataFrame:
    """Records with coordinates inside (lon_min, lat_min, lon_max, lat_max)."""
    lon0, lat0, lon1, lat1 = bbox
    return df.filter(F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1))


def target_group_background(occ: DataFrame, exclude: DataFrame, n: int, order: Column, tie: str) -> DataFrame:
    """The first n records, in hash order, of species that are not targets.

    The cut-off is the n-th smallest hash, found without sorting the table; ties at the cut are settled by ``tie``.
    """
    d = occ.join(exclude.select("species").distinct(), "species", "left_anti").withColumn("_h", order)
    cut = kth_smallest(d, "_h", F.least(F.lit(n).cast("bigint"), F.col("n_all"))).agg(F.max("q")).scalar()
    return d.filter(F.col("_h") <= cut).orderBy("_h", tie).limit(n).drop("_h")


def wide_years_to_long(df: DataFrame, ids: Sequence[str], value: str = "value") -> DataFrame:
    """Year columns to (ids..., year, value)."""
    years = [c for c in df.columns if c not in ids and c.isdigit()]
    long = df.unpivot(list(ids), years, "year", value)
    return long.withColumn("year", F.col("year").cast("int")).filter(F.col(value).isNotNull())


def bands_to_long(df: DataFrame, keys: Sequence[str], template: str, years: Sequence[int], value: str) -> DataFrame:
    """Yearly bands named by ``template`` (with ``{year}``) to (keys..., year, value); names the first missing band."""
    names = [template.format(year=y) for y in years]
    for n in names:
        if n not in df.columns:
            raise KeyError(f"band {n} not found")
    pre, post = template.split("{year}")
    long = df.unpivot(list(keys), names, "_band", value)
    number = F.regexp_extract("_band", f"^{pre}(\\d+){post}$", 1).cast("int")
    return long.select(*keys, number.alias("year"), value)


def join_trait_spread(traits: DataFrame, spread: DataFrame, key: str = "grp") -> DataFrame:
    """Traits with their group spread; a group without one is marked as skipped."""
    j = traits.join(spread, key, "left")
    ok = F.col("p50_sd").isNotNull() & F.col("slope_sd").isNotNull()
    return j.withColumn("status", F.when(ok, "ok").otherwise("skipped_no_trait_variance"))


def read_traits(spark: SparkSession, path: str, spread: DataFrame, schema: str) -> DataFrame:
    """Trait CSV with ``#`` comments."""
    return join_trait_spread(spark.read.csv(path, header=True, comment="#", schema=schema), spread)


def node_lattice(mask: DataFrame, bbox: tuple, shape: tuple, stride: int) -> DataFrame:
    """Every stride-th cell centre of the grid whose cell (row, col) is inside the mask table."""
    lon0, lat0, lon1, lat1 = bbox
    rows, cols = shape
    on = (F.col("row") % stride == 0) & (F.col("col") % stride == 0) & (F.col("row") < rows) & (F.col("col") < cols) & F.col("inside")
    return mask.filter(on).select("row", "col", (F.lit(lat1) - (F.col("row") + 0.5) * ((lat1 - lat0) / rows)).alias("lat"),
                                  (F.lit(lon0) + (F.col("col") + 0.5) * ((lon1 - lon0) / cols)).alias("lon"))


def point_series(points: DataFrame, cells: DataFrame, key: str, keys: Sequence[str]) -> DataFrame:
    """Each point with its own cell's values, joined by key; raises for a point whose cell is absent."""
    j = points.join(cells.withColumn("_hit", F.lit(True)), list(keys), "left")
    missing = F.raise_error(F.lit("a point has no cell in the series")).cast("boolean")
    return j.filter(F.coalesce("_hit", missing)).drop("_hit")


def choose_dataset(counts: dict[str, int], order: Sequence[str], full: int, minimum: float = 0.9, passes: dict[str, bool] | None = None) -> tuple[str | None, list[tuple]]:
    """First candidate that passes its gate and covers the share (the last one needs no coverage), with the reasons."""
    log, chosen = [], None
    for i, name in enumerate(order):
        n, ok = counts.get(name), (passes or {}).get(name, True)
        last = i == len(order) - 1
        if n is None:
            state = "absent"
        elif not ok:
            state = "withheld"
        elif chosen is not None:
            state = "not needed"
        elif last or n >= minimum * full:
            state, chosen = "used", name
        else:
            state = "rejected: coverage below the minimum"
        log.append((name, n, state))
    return chosen, log


def select_dataset(tables: dict[str, DataFrame], full: int, minimum: float = 0.9, gates: dict[str, bool] | None = None) -> tuple[DataFrame | None, list[tuple]]:
    counts = {n: t.count() for n, t in tables.items()}
    chosen, log = choose_dataset(counts, list(tables), full, minimum, gates)
    return (tables[chosen] if chosen else None), log


def audit_files(spark: SparkSession, manifest: DataFrame, directory: str, pattern: str = "*") -> DataFrame:
    """Manifest rows (path, checksum) with the recomputed sha256 and a status: ok, changed or missing.

    ``path`` is relative to ``directory``, so equal names in two folders stay apart.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    place = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", directory).rstrip("/") + "/"
    relative = F.col("path").substr(F.instr("path", place) + len(place), F.length("path"))
    f = files.select(relative.alias("path"), F.sha2("content", 256).alias("actual"), F.col("length").alias("bytes"))
    j = manifest.join(f, "path", "left")
    return j.withColumn("status", F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("checksum"), "ok").otherwise("changed"))
