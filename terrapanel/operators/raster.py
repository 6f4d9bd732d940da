"""Raster tables (row, col, value): point lookup, moving windows, block and zone summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions.numeric import col


def raster_index(x, y, x0: float, y0: float, res: float) -> tuple[Column, Column]:
    """(row, col) of a north-up raster with its upper-left corner at (x0, y0)."""
    return F.floor((F.lit(y0) - col(y)) / res), F.floor((col(x) - x0) / res)


def point_to_raster(points: DataFrame, raster: DataFrame, x: str, y: str, x0: float, y0: float, res: float,
                    fill: Column | None = None) -> DataFrame:
    """Points with the value of the pixel they fall in; ``fill`` (default null) outside the raster."""
    r, c = raster_index(x, y, x0, y0, res)
    out = points.withColumn("row", r).withColumn("col", c).join(raster.select("row", "col", "value"), ["row", "col"], "left")
    return out if fill is None else out.withColumn("value", F.coalesce("value", fill))


def sub_points(pixels: DataFrame, x0: float, y0: float, res: float, n: int = 3) -> DataFrame:
    """The n x n sub-point coordinates of every pixel (row, col): columns sub, sx, sy."""
    step = res / n
    offsets = F.explode(F.array(*[
        F.struct(F.lit(i * n + j).alias("sub"), F.lit((j + 0.5) * step).alias("ox"), F.lit((i + 0.5) * step).alias("oy"))
        for i in range(n) for j in range(n)])).alias("_o")
    return pixels.select("*", offsets).select(
        *pixels.columns, F.col("_o.sub").alias("sub"),
        (F.col("col") * res + x0 + F.col("_o.ox")).alias("sx"),
        (F.lit(y0) - F.col("row") * res - F.col("_o.oy")).alias("sy"))


def _line_sums(tiles: DataFrame, axis: str, other: str, radius: int, sums: Sequence[str], first: Column, last: Column) -> DataFrame:
    """Sums over the 2r+1 positions around every position of ``axis`` from ``first`` to ``last``, inside the tiles of ``box_sums``.

    A window of 2r+1 positions is the end of one aligned block of that length and the start of the next, so two running
    sums per block give every window with one addition and nothing is ever subtracted: a huge, infinite or NaN value
    spoils the windows that hold it and no others.
    """
    width = 2 * radius + 1
    a, begin = F.col(axis), F.col("_block") * width
    block = W.partitionBy("_tr", "_tc", other, "_block")
    up, down = block.orderBy(axis), block.orderBy(F.desc(axis))
    runs = tiles.withColumn("_block", F.floor(a / width)).select(
        "_tr", "_tc", other, axis, "_block",
        (F.coalesce(F.lead(axis).over(up), begin + width) - 1).alias("_until"), (F.coalesce(F.lag(axis).over(up) + 1, begin)).alias("_since"),
        *[F.sum(c).over(up.rowsBetween(W.unboundedPreceding, 0)).alias(f"_up_{c}") for c in sums],
        *[F.sum(c).over(down.rowsBetween(W.unboundedPreceding, 0)).alias(f"_down_{c}") for c in sums])

    def part(kind, lo, hi):
        return F.struct(lo.alias("lo"), hi.alias("hi"), *[F.col(f"_{kind}_{c}").alias(c) for c in sums])

    # the start of a block up to p is the right part of the window around p - r; its end from p on the left part of that around
    # p + r, except from the first position on, where the whole block is the window and the other half has it already
    halves = F.array(part("up", a - radius, F.col("_until") - radius),
                     part("down", F.greatest(F.col("_since"), begin + 1) + radius, a + radius))
    h = runs.select("_tr", "_tc", other, F.explode(halves).alias("_h"), first.alias("_first"), last.alias("_last"))
    lo, hi = F.greatest("_h.lo", "_first"), F.least("_h.hi", "_last")
    h = h.select("_tr", "_tc", other, F.explode(F.when(lo <= hi, F.sequence(lo, hi))).alias(axis), *[F.col(f"_h.{c}").alias(c) for c in sums])
    return h.groupBy("_tr", "_tc", axis, other).agg(*[F.sum(c).alias(c) for c in sums])


def box_sums(raster: DataFrame, radius: int, sums: dict[str, Column], repeat_edges: bool = False) -> DataFrame:
    """Sums over the (2r+1) x (2r+1) window of every cell of the lattice that has a cell in its window.

    Cells are dealt to square tiles of 16 r cells a side (64 at least) with a halo of r, about 1.27 copies of a cell at most; rows and
    then columns are summed inside the tile, so tiles cost one shuffle whatever the radius. Without ``repeat_edges`` the
    window is truncated at the edges; with it the first and last lines also stand in for the r lines outside. Rows of
    one cell add up; a cell without row or column is left out; an empty table gives none.
    """
    names, side = list(sums), max(16 * radius, 64)
    raster = raster.filter(F.col("row").isNotNull() & F.col("col").isNotNull())
    base = raster.groupBy(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col")).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    # the lattice spans every row and column of the table, with or without a value
    ends = {c: (raster.agg(F.min(c).cast("bigint")).scalar(), raster.agg(F.max(c).cast("bigint")).scalar()) for c in ("row", "col")}
    if repeat_edges:
        for c, (lo, hi) in ends.items():
            x = F.col(c)
            reach = F.sequence(F.when(x == lo, x - radius).otherwise(x), F.when(x == hi, x + radius).otherwise(x))
            base = base.withColumn(c, F.explode(reach))
    for c, t in (("row", "_tr"), ("col", "_tc")):
        lo, hi = ends[c]
        near = F.sequence(F.greatest(F.floor((F.col(c) - radius) / side), F.floor(lo / side)), F.least(F.floor((F.col(c) + radius) / side), F.floor(hi / side)))
        base = base.withColumn(t, F.explode(near))
    out = base.repartition("_tr", "_tc")
    for axis, other, t in (("row", "col", "_tr"), ("col", "row", "_tc")):
        lo, hi = ends[axis]
        out = _line_sums(out, axis, other, radius, names, F.greatest(lo, F.col(t) * side), F.least(hi, F.col(t) * side + side - 1))
    return out.select("row", "col", *names)


def window_mean(raster: DataFrame, radius: int, out: str = "mean", value: str = "value",
                repeat_edges: bool = False, keep: bool = True) -> DataFrame:
    """Cells with the null-skipping mean of their window."""
    v = F.col(value)
    b = box_sums(raster, radius, {"_s": v, "_n": F.when(v.isNotNull(), 1).otherwise(0)}, repeat_edges)
    m = b.select("row", "col", (F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).alias(out))
    return raster.join(m, ["row", "col"], "left") if keep else m


def concavity(raster: DataFrame, radius: int = 1) -> DataFrame:
    """Mean of the window without its centre, minus the centre; windows are truncated at the edges."""
    b = box_sums(raster, radius, {"_s": F.col("value"), "_n": F.lit(1)})
    return raster.join(b, ["row", "col"]).select(
        "row", "col", "value",
        ((F.col("_s") - F.col("value")) / F.nullif(F.col("_n") - 1, F.lit(0)) - F.col("value")).alias("concavity"))


def buffer_index(raster: DataFrame, radius: int = 25) -> DataFrame:
    """(window mean - value) / population SD of all values; edges repeated, missing cells skipped."""
    m = window_mean(raster, radius, "_reg", repeat_edges=True)
    sd = raster.agg(F.stddev_pop("value")).scalar()
    return m.select("row", "col", "value", ((F.col("_reg") - F.col("value")) / F.nullif(sd, F.lit(0.0))).alias("buffer"))


def class_fractions(raster: DataFrame, radius: int, groups: dict[str, Sequence[int]], value: str = "value") -> DataFrame:
    """Share of the window's pixels in each set of classes, per cell."""
    sums = {g: F.when(F.col(value).isin(list(c)), 1).otherwise(0) for g, c in groups.items()}
    b = box_sums(raster, radius, {**sums, "_n": F.lit(1)})
    return b.select("row", "col", *[(F.col(g) / F.col("_n")).alias(g) for g in groups])


def points_in_window(points: DataFrame, raster: DataFrame, half_rows: int, half_cols: int, key: str) -> DataFrame:
    """(key, value) of every raster pixel within the window of a point that carries row and col.

    The points, not the raster, are copied: one row per pixel of the window, then an equi-join.
    """
    rows = F.explode(F.sequence(F.col("row") - half_rows, F.col("row") + half_rows))
    cols = F.explode(F.sequence(F.col("col") - half_cols, F.col("col") + half_cols))
    p = points.select(key, rows.alias("row"), "col").select(key, "row", cols.alias("col"))
    return p.join(raster, ["row", "col"]).drop("row", "col")


def block_mean(raster: DataFrame, size: int, out: str = "mean", min_share: float | None = None) -> DataFrame:
    """Mean per block of ``size`` x ``size`` pixels; blank below the share of valid pixels."""
    v = F.col("value")
    valid = F.count(v)
    mean = F.avg(v) if min_share is None else F.when(valid >= min_share * size * size, F.avg(v))
    return raster.groupBy(F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col")).agg(
        mean.alias(out), valid.alias("n_valid"))


def block_class_fractions(raster: DataFrame, size: int, groups: dict[str, Sequence[int]]) -> DataFrame:
    return raster.groupBy(F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col")).agg(
        *[F.avg(F.when(F.col("value").isin(list(c)), 1.0).otherwise(0.0)).alias(g) for g, c in groups.items()],
        F.count(F.lit(1)).alias("n"))


def zonal_shares(cells: DataFrame, raster: DataFrame, layers: Sequence[str], inside: Column, key: str = "cell") -> DataFrame:
    """Mean of each layer over the in-zone pixels of a cell's pixel rectangle, and the share of the rectangle that is in zone.

    ``cells`` holds r0, r1, c0, c1 (inclusive). Large rectangles are exploded by line, then by pixel.
    """
    p = cells.select(key, F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1")
    p = p.select(key, "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    j = p.join(raster.select("row", "col", inside.alias("_in"), *layers), ["row", "col"])
    out = j.groupBy(key).agg(*[F.avg(F.when(F.col("_in"), F.col(n))).alias(n) for n in layers],
                             F.avg(F.col("_in").cast("double")).alias("coverage"))
    return cells.select(key).join(out, key, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def forest_candidates(sub: DataFrame, forest: Sequence[int], keys: Sequence[str], min_per_node: int = 5,
                      node: str = "node") -> DataFrame:
    """Pixels whose sub-points are all forest, with the most frequent class (ties to the lower code).

    ``sub`` has one row per sub-point (keys..., class). Nodes with too few candidates are dropped.
    """
    is_forest = F.coalesce(F.col("class").isin(list(forest)), F.lit(False))
    per_class = sub.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("n"), F.max(is_forest).alias("f"))
    px = per_class.groupBy(*keys).agg(
        (F.sum(F.when(F.col("f"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"),
        F.coalesce(F.max_by("class", F.when(F.col("f"), F.struct(F.col("n"), -F.col("class")))), F.lit(0)).alias("modal"))
    cand = px.filter(F.col("share") >= 1.0)
    n = cand.groupBy(node).agg(F.count(F.lit(1)).alias("n_candidates"))
    return cand.join(n.filter(F.col("n_candidates") >= min_per_node), node)


def sample_per_node(df: DataFrame, k: int, order: Column, node: str = "node", tie: str = "pixel") -> DataFrame:
    """Up to k rows per node in the order of a hash: reproducible and independent of the other nodes.

    The rank filter is pushed below the shuffle as a per-task group limit, so a crowded node ships k rows per task.
    """
    w = W.partitionBy(node).orderBy("_h", tie)
    return (df.withColumn("_h", order).withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= k).drop("_h", "_r"))


def nearest_index(value, start: float, step: float, n: int) -> Column:
    """Index of the nearest of n regular axis positions; a tie goes to the lower index."""
    i = F.ceil((col(value) - start) / step - 0.5)
    return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))


def lattice_index(df: DataFrame, lat: str, lon: str, bbox: tuple, shape: tuple, stride: int) -> DataFrame:
    """Lattice row and column of nodes on every ``stride``-th pixel centre; raises for a node off the lattice."""
    lon0, lat0, lon1, lat1 = bbox
    rows, cols = shape
    r = F.bround((F.lit(lat1) - F.col(lat)) / ((lat1 - lat0) / rows) - 0.5).cast("bigint")
    c = F.bround((F.col(lon) - lon0) / ((lon1 - lon0) / cols) - 0.5).cast("bigint")
    off = (F.pmod(r, F.lit(stride)) != 0) | (F.pmod(c, F.lit(stride)) != 0)
    ok = F.when(off, F.raise_error(F.lit("node off the lattice")).cast("bigint"))
    return df.withColumn("li", F.coalesce(ok, F.floor(r / stride))).withColumn("lj", F.floor(c / stride))
