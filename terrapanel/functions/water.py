"""Soil texture, storage and water-potential columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapanel import constants as K
from terrapanel.functions.numeric import col


def _texture_regression(name: str, sand: Column, clay: Column, om: Column) -> Column:
    weights, poly = K.SAXTON_RAWLS[name]
    terms = [sand, clay, om, sand * om, clay * om, sand * clay]
    first = F.lit(weights[0])
    for w, t in zip(weights[1:], terms):
        first = first + t * w
    return first * first * poly[2] + first * poly[1] + poly[0]


def pedotransfer(sand_pct, clay_pct, soc_g_kg) -> dict[str, Column]:
    """Soil hydraulic parameters from texture in percent and organic carbon in g/kg (Saxton and Rawls 2006)."""
    sand, clay = col(sand_pct) / 100.0, col(clay_pct) / 100.0
    om = col(soc_g_kg) / 1000.0 * K.VAN_BEMMELEN * K.BULK_DENSITY_MG_M3
    dry = _texture_regression("theta_1500", sand, clay, om)
    fc = _texture_regression("theta_33", sand, clay, om)
    sat = fc + _texture_regression("theta_s_33", sand, clay, om) + sand * K.SATURATION_SAND + K.SATURATION_SHIFT
    b = F.lit(math.log(1500.0) - math.log(33.0)) / (F.ln(fc) - F.ln(dry))
    tension_kpa = F.exp(F.lit(math.log(33.0)) + b * F.ln(fc)) * F.pow(sat, -b)
    return {"theta_sat": sat, "theta_fc": fc, "theta_lim": dry, "psi_sat": -tension_kpa / 1000.0, "b": b}


def texture_to_percent(per_mille) -> Column:
    return col(per_mille) / 10.0


def bucket_capacity(theta_fc, theta_lim, depth_mm) -> Column:
    """Water held between field capacity and the extraction limit over the rooting depth, mm."""
    return (col(theta_fc) - col(theta_lim)) * col(depth_mm)


def theta_of_storage(w, w_max, theta_fc, theta_lim) -> Column:
    return col(theta_lim) + (col(theta_fc) - col(theta_lim)) * (col(w) / F.nullif(col(w_max), F.lit(0.0)))


def soil_potential(theta, theta_sat, psi_sat, b) -> Column:
    """Soil water potential in MPa from a power-law retention curve."""
    return col(psi_sat) * F.pow(F.greatest(col(theta), F.lit(1e-6)) / col(theta_sat), -col(b))
