"""Growth, niche, hazard-link and grid columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapanel import constants as K
from terrapanel.functions.numeric import clip, col, ratio

INF = float("inf")


# ---- hazard links ------------------------------------------------------------------------------

def cloglog(p) -> Column:
    return F.ln(-F.log1p(-clip(p, 1e-12, 1.0 - 1e-12)))


def cloglog_inverse(eta) -> Column:
    return -F.expm1(-F.exp(clip(eta, -30.0, 30.0)))


def gate_weight(di, threshold, kappa: float = 2.0) -> Column:
    """1 inside the area of applicability, decaying outside."""
    return F.exp(F.greatest(F.lit(0.0), col(di) / col(threshold) - 1.0) * -kappa)


def blend(h_stat, h_mech, w) -> Column:
    """Two hazards mixed on the link scale."""
    return cloglog_inverse(col(w) * cloglog(h_stat) + (F.lit(1.0) - col(w)) * cloglog(h_mech))


def recalibrated(h, a, b) -> Column:
    return cloglog_inverse(col(a) + col(b) * cloglog(h))


def misclassification_corrected(h_obs, se: float, sp: float) -> Column:
    if se + sp <= 1.0:
        raise ValueError("sensitivity plus specificity must exceed 1")
    return clip((col(h_obs) - (1.0 - sp)) / (se + sp - 1.0), 0.0, 1.0)


def rare_event_weight(event, pi0: float) -> Column:
    if not 0.0 < pi0 <= 1.0:
        raise ValueError("the sampling fraction of non-events must lie in (0, 1]")
    return F.when(col(event), F.lit(1.0)).otherwise(1.0 / pi0)


def linear_predictor(intercept, terms: dict) -> Column:
    eta = col(intercept)
    for name, beta in terms.items():
        eta = eta + col(name) * col(beta)
    return eta


def logistic(z) -> Column:
    return F.lit(1.0) / (F.exp(-col(z)) + 1.0)


# ---- growth ------------------------------------------------------------------------------------

def height_at_age(age, h_star, k, p=1.5) -> Column:
    return col(h_star) * F.pow(F.lit(1.0) - F.exp(-col(k) * F.greatest(col(age), F.lit(0.0))), col(p))


def age_at_height(target, h_star, k, p=1.5) -> Column:
    """Age at which the height is reached; infinite at or above the asymptote."""
    share = F.pow(F.least(col(target) / col(h_star), F.lit(1.0)), F.lit(1.0) / col(p))
    return F.when(col(target) >= col(h_star), F.lit(INF)).otherwise(-F.ln(F.lit(1.0) - share) / col(k))


def saturating_loss(x, half, m: float = 3.0) -> Column:
    """1 at x = 0, one half at ``half``, falling to 0: used for water deficit and for frost days."""
    return F.lit(1.0) / (F.pow(col(x) / col(half), F.lit(m)) + 1.0)


def saturating_gain(x, half) -> Column:
    return col(x) / F.nullif(col(x) + col(half), F.lit(0.0))


def treeline_modifier(gst, lgs, s_t: float, s_l: float) -> Column:
    return logistic((col(gst) - K.TREELINE_GST_C) / s_t) * logistic((col(lgs) - K.TREELINE_LGS_DAYS) / s_l)


def treeline_elevation(gst, z_ref, gamma, t_tl: float = K.TREELINE_GST_C) -> Column:
    return col(z_ref) + (F.lit(t_tl) - col(gst)) / F.nullif(col(gamma), F.lit(0.0))


def height_error_variance(h, a: float = 0.5, b: float = 0.05) -> Column:
    return F.pow(col(h) * b + a, 2)


def height_water_limited(h_ref, aet, pet) -> Column:
    share = F.when(col(pet) > 0, clip(ratio(aet, pet), 0.0, 1.0)).otherwise(0.0)
    return col(h_ref) * share


# ---- grid --------------------------------------------------------------------------------------

def cell_area_ha(lat, dlat: float, dlon: float) -> Column:
    """Area of a longitude-latitude rectangle on the sphere."""
    band = F.sin(F.radians(col(lat) + dlat / 2.0)) - F.sin(F.radians(col(lat) - dlat / 2.0))
    return band * (K.EARTH_RADIUS_KM ** 2 * math.radians(dlon) * 100.0)


def mercator_x(lon, radius: float = K.MERCATOR_RADIUS_M) -> Column:
    return F.radians(col(lon)) * radius


def mercator_y(lat, radius: float = K.MERCATOR_RADIUS_M) -> Column:
    return F.ln(F.tan(F.radians(col(lat)) / 2.0 + math.pi / 4.0)) * radius


def mercator_lon(x, radius: float = K.MERCATOR_RADIUS_M) -> Column:
    return F.degrees(col(x) / radius)


def mercator_lat(y, radius: float = K.MERCATOR_RADIUS_M) -> Column:
    return F.degrees(F.atan(F.exp(col(y) / radius)) * 2.0 - math.pi / 2.0)


def haversine_km(lat1, lon1, lat2, lon2, radius: float = 6371.0) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dl = F.radians(col(lon2)) - F.radians(col(lon1))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2.0 * radius)


def kndvi(nir_dn, red_dn, qa, family: str) -> Column:
    """tanh(NDVI^2) of scaled reflectance, null where a quality bit is set."""
    scale, offset = K.REFLECTANCE_SCALE[family]
    mask = sum(1 << b for b in K.QA_BITS[family])
    nir, red = col(nir_dn) * scale + offset, col(red_dn) * scale + offset
    ndvi = (nir - red) / F.nullif(nir + red, F.lit(0.0))
    return F.when(col(qa).bitwiseAND(mask) == 0, F.tanh(ndvi * ndvi))


def vpd_unit_ok(d_vpd, d_tmax, lo: float = 0.03, hi: float = 0.25) -> Column:
    """Does the ratio of the two changes lie in the physically possible range?"""
    r = ratio(d_vpd, d_tmax)
    return F.coalesce(r.between(lo, hi), F.lit(False))
