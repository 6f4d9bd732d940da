"""Key, lookup and position joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.tables import by_keys
from terrapanel.functions.numeric import col
from terrapanel.operators.raster import raster_index


def by_position(left: DataFrame, right: DataFrame, places: int = 6, how: str = "left") -> DataFrame:
    """Join on (lat, lon) rounded half-even; an unmatched left row keeps nulls."""
    key = lambda d, p: d.select("*", F.bround("lat", places).alias(f"_{p}a"), F.bround("lon", places).alias(f"_{p}o"))
    r = key(right, "r").drop("lat", "lon")
    j = key(left, "l").join(r, (F.col("_la") == F.col("_ra")) & (F.col("_lo") == F.col("_ro")), how)
    return j.drop("_la", "_lo", "_ra", "_ro")


def pixel_climate(pixel_year: DataFrame, climate: DataFrame, keys: Sequence[str] = ("node", "year")) -> DataFrame:
    """Pixel-years with their node's climate; unmatched ones are dropped. Adaptive execution broadcasts a small climate table."""
    return pixel_year.join(climate, list(keys))


def apply_member_delta(node_day: DataFrame, deltas: DataFrame, keys: Sequence[str] = ("node", "month"), members: Sequence[str] = ("gcm", "ssp", "horizon")) -> DataFrame:
    """Daily weather of every member: temperature plus the monthly change, precipitation times the ratio."""
    j = node_day.join(deltas, list(keys))
    shift = [(F.col(t) + F.col(d)).alias(t) for t, d in (("t_mean", "d_tas"), ("t_max", "d_tasmax"), ("t_min", "d_tasmin"))]
    rest = [c for c in node_day.columns if c not in ("t_mean", "t_max", "t_min", "p")]
    return j.select(*rest, *members, *shift, (F.col("p") * F.col("r_pr")).alias("p"))


def factorial_levels(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """All combinations of the factor levels found in the table: one row per combination.

    The level lists are scalars (a handful of names each) that are exploded one after another, so no join is made.
    """
    lists = df.agg(F.struct(*[F.sort_array(F.collect_set(f)).alias(f) for f in factors]).alias("l"))
    out = lists
    for f in factors:
        done = [c for c in out.columns if c != "l"]
        out = out.select(*done, "l", F.explode(F.col(f"l.{f}")).alias(f))
    return out.drop("l")


def drop_invalid(results: DataFrame, invalid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results without the nodes rejected upstream."""
    return results.join(invalid.select(*keys).distinct(), list(keys), "left_anti")


def point_layers(points: DataFrame, layers: DataFrame, variables: Sequence[str], key: str, x0: float, y0: float, res: float,
                 scenario: Column | None = None, shape: tuple | None = None) -> DataFrame:
    """One predictor row per point from a long layer table (var, scenario, row, col, value).

    ``scenario`` is the layer key wanted for the point; ``shape`` clips indices to the grid.
    """
    r, c = raster_index("lon", "lat", x0, y0, res)
    if shape is not None:
        r, c = (F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)) for i, n in zip((r, c), shape))
    p = points.select(key, r.alias("row"), c.alias("col"), (F.lit("historical") if scenario is None else scenario).alias("scenario"))
    j = p.join(layers.filter(F.col("var").isin(list(variables))), ["row", "col", "scenario"], "left")
    return j.groupBy(key).agg(*[F.max(F.when(F.col("var") == v, F.col("value"))).alias(v) for v in variables])


def assemble_pixels(frame: DataFrame, extracted: DataFrame, node_inputs: DataFrame, key: str = "pixel") -> tuple[DataFrame, DataFrame]:
    """Pixels of the finished nodes with their values, and the static inputs of the nodes still in use."""
    px = frame.join(extracted, key)
    return px, node_inputs.join(px.select("node").distinct(), "node", "left_semi")


def protected_flag(points: DataFrame, flags: DataFrame, x: str, y: str, x0: float, y0: float, res: float) -> DataFrame:
    """Adds the protected flag of the point's pixel; raises for a point the layer does not cover (absence is not assumed)."""
    r, c = raster_index(x, y, x0, y0, res)
    j = points.withColumn("_r", r).withColumn("_c", c).join(
        flags.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("protected")), ["_r", "_c"], "left")
    none = F.raise_error(F.lit("protected-area layer missing at a point")).cast("double")
    return j.withColumn("protected", F.coalesce(F.col("protected").cast("double"), none)).drop("_r", "_c")


def element_mean(obs: DataFrame, keys: Sequence[str] = ("station", "date")) -> DataFrame:
    """Daily mean temperature of a station: the average element, else the middle of the extremes."""
    pick = lambda e: F.max(F.when(F.col("element") == e, F.col("value")))
    d = obs.groupBy(*keys).agg(pick("TAVG").alias("tavg"), pick("TMAX").alias("tmax"), pick("TMIN").alias("tmin"))
    return d.withColumn("t", F.coalesce("tavg", (F.col("tmax") + F.col("tmin")) / 2.0))


def niche_units(units: DataFrame, niche: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units with their niche support; a unit the niche table does not cover is unsupported."""
    return units.join(niche, list(keys), "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def cell_lookup(points: DataFrame, cells: DataFrame, point_id: str, cell_id: str, dlat: float, dlon: float) -> DataFrame:
    """Lowest-numbered cell whose closed rectangle (centred on the cell's lat, lon) holds the point; null when none does.

    Points and cells are reduced to places first (the lowest cell of a place). Both are keyed by blocks of the cell size; a place reads the
    3 x 3 blocks its cell's centre can lie in.
    """
    blk = lambda a, b: (F.floor(col(a) / dlat), F.floor(col(b) / dlon))
    ci, cj = blk("lat", "lon")
    c = cells.groupBy("lat", "lon").agg(F.min(cell_id).alias("_cell")).select("_cell", F.col("lat").alias("_a"), F.col("lon").alias("_o"), ci.alias("_i"), cj.alias("_j"))
    around = F.explode(F.array(*[F.struct((ci + i).alias("i"), (cj + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_b")
    p = points.select("lat", "lon").distinct().select("lat", "lon", around).select("lat", "lon", F.col("_b.i").alias("_i"), F.col("_b.j").alias("_j"))
    hit = (F.abs(F.col("lat") - F.col("_a")) <= dlat / 2) & (F.abs(F.col("lon") - F.col("_o")) <= dlon / 2)
    best = by_keys(p, "_i", "_j").join(by_keys(c, "_i", "_j"), ["_i", "_j"]).filter(hit).groupBy("lat", "lon").agg(F.min("_cell").alias(cell_id))
    return points.select(point_id, "lat", "lon").join(best, ["lat", "lon"], "left").select(point_id, cell_id)
