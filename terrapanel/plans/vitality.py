"""The vitality-response suite: drought response of a pixel-year panel under fixed effects."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.numeric import all_finite
from terrapanel.operators import models as Md
from terrapanel.operators.means import climate_anomaly
from terrapanel.operators.order_stats import quantile_columns
from terrapanel.operators.windows import rank_within
from terrapanel.tables import cut_lineage

SCHEMA = "model string, grp string, term string, coef double, se_used double, lo double, hi double, p double, n_obs long, n_pixels long, r2_within double, status string"


def _rows(model: str, grp: str | None, fit: dict, status: str = "ok") -> list[tuple]:
    return [(model, grp, t, float(fit["coef"][i]), float(fit["se_used"][i]), float(fit["lo"][i]), float(fit["hi"][i]), float(fit["p"][i]),
             int(fit["n"]), int(fit["n_units"]), float(fit["r2_within"]), status) for i, t in enumerate(fit["terms"])]


def _none(model: str, grp: str | None, status: str) -> list[tuple]:
    return [(model, grp, None, None, None, None, None, None, None, None, None, status)]


def _verdict(lo: float, hi: float, coef: float, expected: int = -1) -> str:
    if not all(map(math.isfinite, (lo, hi, coef))) or lo <= 0 <= hi:
        return "inconclusive"
    return "supports" if (coef > 0) == (expected > 0) else "contradicts"


def vitality_suite(panel: DataFrame, climate: Sequence[str], drought: str, year: str = "year", hazard: DataFrame | None = None,
                   group_of_class: dict[int, str] | None = None, late_years: int | None = None, min_nodes: int = 8, min_pixels: int = 30) -> DataFrame:
    """Long table of the fitted terms of models A (drought), B (all climate), C (drought x height), D (drought x hazard
    rank per group, with terciles) and the sensitivity fits.

    ``panel`` has pixel, node, year, z, z_adj, height, forest_class, valid_count, disturbed_recent and the climate columns;
    ``hazard`` (grp, node, hazard) is optional. Every fit is a handful of aggregates over the prepared rows, written once.
    """
    spark, anom = panel.sparkSession, [f"{c}_anom" for c in climate]
    main = f"{drought}_anom"
    panel = cut_lineage(panel)  # the anomalies read it several times
    hazard = None if hazard is None else cut_lineage(hazard)
    full = climate_anomaly(panel, "node", year, list(climate))
    d = cut_lineage(full.filter(~F.col("disturbed_recent") & all_finite(["z", *anom])))
    cl = ["node", year]
    out: list[tuple] = []

    def size(df):
        r = df.agg(F.count_distinct("pixel").alias("p"), F.count_distinct("node").alias("n")).first()
        return r["p"], r["n"]

    def fit(model, df, x, y="z", second=None, grp=None):
        f = Md.within_ols(df, y, x, "pixel", cl, second)
        out.extend(_rows(model, grp, f))
        return f

    fit("A", d, [main])
    r2 = [("A_leave_one_year_out", Md.leave_group_out_r2(d, "z", [main], "pixel", year))]
    try:
        fit("B", d, anom)
        r2.append(("B_leave_one_year_out", Md.leave_group_out_r2(d, "z", anom, "pixel", year)))
    except ValueError:
        out.extend(_none("B", None, "collinear"))
    out.extend((m, None, "r2_out_of_sample", v["r2"], None, None, None, None, v["n_test"], None, None, "ok") for m, v in r2)

    variants = [("two_way_effects", d, "z", year), ("valid_count_5", d.filter(F.col("valid_count") >= 5), "z", None), ("year_effect_removed", d.filter(all_finite(["z_adj"])), "z_adj", None)]
    if late_years is not None:
        variants.append(("late_years", d.filter(F.col(year) >= late_years), "z", None))
    for name, sub, y, second in variants:
        p, n = size(sub)
        if p < 30 or n < 8:
            out.extend(_none(name, None, "too_few_pixels_or_cells"))
        else:
            fit(name, sub, [main], y, second)

    px = d.select("pixel", "height").distinct()
    h = px.agg(F.avg("height").alias("m"), F.stddev_pop("height").alias("s")).first()
    if h["s"] and size(d.filter(all_finite(["height"])))[0] > 50:
        tall = d.filter(all_finite(["height"])).withColumn("drought_x_height", F.col(main) * (F.col("height") - h["m"]) / h["s"])
        fit("C", tall, [main, "drought_x_height"])
    else:
        out.extend(_none("C", None, "no_height_spread"))

    if hazard is not None and group_of_class:
        label = F.coalesce(*[F.when(F.col("forest_class") == k, F.lit(g)) for k, g in group_of_class.items()])
        g_all = d.withColumn("grp", label)
        for g in sorted(set(group_of_class.values())):
            sub = g_all.filter(F.col("grp") == g)
            p, n = size(sub)
            if p < min_pixels or n < min_nodes:
                out.extend(_none("D", g, "too_few_pixels_or_cells"))
                continue
            nodes = sub.select("node").distinct().join(hazard.filter(F.col("grp") == g).select("node", "hazard"), "node").filter(all_finite(["hazard"]))
            spread = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hazard").alias("d")).first()
            if spread["n"] < min_nodes or spread["d"] < 3:
                out.extend(_none("D", g, "no_spread_in_hazard"))
                continue
            ranked = rank_within(nodes, "hazard", (), "rank")
            cuts = quantile_columns(nodes, "hazard", {"a": 1 / 3, "b": 2 / 3}).first()
            ranked = ranked.withColumn("tercile", F.when(F.col("hazard") >= cuts["b"], 2).when(F.col("hazard") >= cuts["a"], 1).otherwise(0))
            sub = cut_lineage(sub.join(ranked, "node").withColumn("drought_x_rank", F.col(main) * F.col("rank")))
            f = Md.within_ols(sub, "z", [main, "drought_x_rank"], "pixel", cl)
            out.extend(_rows("D", g, f, _verdict(f["lo"][1], f["hi"][1], f["coef"][1])))
            for t in range(3):
                st = sub.filter(F.col("tercile") == t)
                p, n = size(st)
                if n >= 3 and p >= 10:
                    fit(f"D_tercile_{t}", st, [main], grp=g)
    return spark.createDataFrame(out, SCHEMA)
