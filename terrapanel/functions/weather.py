"""Vapour pressure, radiation, evaporation and downscaling columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapanel import constants as K
from terrapanel.functions.numeric import clip, col, floor0


# ---- vapour pressure ---------------------------------------------------------------------------

def saturation_vp(t) -> Column:
    """Saturation vapour pressure in kPa (FAO-56 eq. 11)."""
    t = col(t)
    return F.exp(t * 17.27 / (t + 237.3)) * 0.6108


def saturation_vp_slope(t) -> Column:
    """Slope of the saturation curve in kPa per K (FAO-56 eq. 13)."""
    return saturation_vp(t) * 4098.0 / F.pow(col(t) + 237.3, 2)


def dewpoint(ea) -> Column:
    """Temperature at which the saturation vapour pressure equals ea."""
    g = F.ln(col(ea) / 0.6108)
    return g * 237.3 / (F.lit(17.27) - g)


def vp_from_humidity(rh, t) -> Column:
    """Actual vapour pressure from relative humidity (percent) and the temperature it belongs to."""
    return col(rh) * saturation_vp(t) / 100.0


def daytime_t(t_mean, t_max) -> Column:
    """Mean temperature of the daylight hours."""
    return col(t_mean) + (col(t_max) - col(t_mean)) * 0.45


def vpd_daytime(t_mean, t_max, ea) -> Column:
    return floor0(saturation_vp(daytime_t(t_mean, t_max)) - col(ea))


def vpd_peak(t_max, ea) -> Column:
    return floor0(saturation_vp(t_max) - col(ea))


def vpd_whole_day(t_max, t_min, ea) -> Column:
    return floor0((saturation_vp(t_max) + saturation_vp(t_min)) * 0.5 - col(ea))


def vpd_legacy(t_max, rh_mean) -> Column:
    """Mixes mean humidity with maximum temperature; kept to measure its bias."""
    return saturation_vp(t_max) * (F.lit(1.0) - col(rh_mean) / 100.0)


def vp_at_elevation(ea, z_from, z_to, lapse: float = -0.002) -> Column:
    """Vapour pressure carried to another elevation through the dew point."""
    return saturation_vp(dewpoint(ea) + (col(z_to) - col(z_from)) * lapse)


def vpd_under_warming(vpd, t, warming) -> Column:
    """VPD after a warming at constant relative humidity."""
    return col(vpd) * saturation_vp(col(t) + col(warming)) / saturation_vp(t)


def pressure(z) -> Column:
    """Air pressure in kPa from elevation (FAO-56 eq. 7)."""
    return F.pow((F.lit(293.0) - col(z) * 0.0065) / 293.0, 5.26) * 101.3


def psychrometric(p) -> Column:
    return col(p) * 0.000665


def wind_at_2m(u, z: float = 10.0) -> Column:
    """Wind speed moved to 2 m by the logarithmic profile (FAO-56 eq. 47)."""
    return col(u) * 4.87 / math.log(67.8 * z - 5.42)


def air_density(t, p) -> Column:
    return col(p) / ((col(t) + 273.0) * 1.01 * K.R_SPECIFIC_AIR)


# ---- downscaling -------------------------------------------------------------------------------

def cold_air(concavity, calm_fraction, k: float = 1.0) -> Column:
    """Cold-air pooling term in K, never positive."""
    return floor0(concavity) * clip(calm_fraction, 0.0, 1.0) * -abs(k)


def t_at_elevation(t_ref, z, z_ref, gamma, shift=0.0) -> Column:
    return col(t_ref) + col(gamma) * (col(z) - col(z_ref)) + col(shift)


def p_at_elevation(p_ref, z, z_ref, gradient, exposure=1.0) -> Column:
    return floor0(col(p_ref) * F.exp(col(gradient) * (col(z) - col(z_ref))) * col(exposure))


# ---- radiation ---------------------------------------------------------------------------------

def declination(doy) -> Column:
    return F.sin(col(doy) * (2.0 * math.pi / 365.0) - 1.39) * 0.409


def inverse_distance(doy) -> Column:
    return F.cos(col(doy) * (2.0 * math.pi / 365.0)) * 0.033 + 1.0


def sunset_angle(lat_deg, doy) -> Column:
    return F.acos(clip(-F.tan(F.radians(col(lat_deg))) * F.tan(declination(doy)), -1.0, 1.0))


def extraterrestrial(lat_deg, doy) -> Column:
    """Daily radiation on a horizontal surface outside the atmosphere, MJ m-2 (FAO-56 eq. 21)."""
    lat, dec, ws = F.radians(col(lat_deg)), declination(doy), sunset_angle(lat_deg, doy)
    geometry = ws * F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.sin(ws)
    return inverse_distance(doy) * geometry * (24.0 * 60.0 / math.pi * K.GSC_MJ_M2_MIN)


def net_radiation(rs_j, rl_j, t, albedo: float = 0.15, emissivity: float = 0.97) -> Column:
    """Net radiation in MJ m-2 day-1 from downward short- and longwave in J m-2."""
    emitted = F.pow(col(t) + 273.15, 4) * (emissivity * K.STEFAN_BOLTZMANN)
    return col(rs_j) / 1.0e6 * (1.0 - albedo) + col(rl_j) / 1.0e6 - emitted


def sky_view_slope(slope_deg) -> Column:
    """Isotropic sky view of an open planar slope."""
    return (F.cos(F.radians(col(slope_deg))) + 1.0) * 0.5


# ---- potential evaporation ---------------------------------------------------------------------

def pet_reference(rn, g, t, u2, ea, p) -> Column:
    """FAO-56 Penman-Monteith, mm per day."""
    d, gam = saturation_vp_slope(t), psychrometric(p)
    aero = gam * (F.lit(900.0) / (col(t) + 273.0)) * col(u2) * (saturation_vp(t) - col(ea))
    return (d * (col(rn) - col(g)) * 0.408 + aero) / (d + gam * (col(u2) * 0.34 + 1.0))


def pet_priestley_taylor(rn, g, t, p, alpha: float = 1.26) -> Column:
    d, gam = saturation_vp_slope(t), psychrometric(p)
    return d / (d + gam) * (col(rn) - col(g)) * alpha / K.LATENT_HEAT_MJ_KG


def pet_energy(rn, g) -> Column:
    return (col(rn) - col(g)) / K.LATENT_HEAT_MJ_KG


def pet_canopy(rn, g, t, vpd, g_a, g_c, p) -> Column:
    """Penman-Monteith with explicit conductances (m s-1); null when a conductance is missing."""
    d, gam = saturation_vp_slope(t), psychrometric(p)
    aero = air_density(t, p) * col(vpd) * col(g_a) * (K.CP_MJ_KG_K * K.SECONDS_PER_DAY)
    return (d * (col(rn) - col(g)) + aero) / (d + gam * (col(g_a) / col(g_c) + 1.0)) / K.LATENT_HEAT_MJ_KG


def canopy_conductance(gs_max, vpd, lai, k_vpd) -> Column:
    return col(gs_max) * F.exp(-col(k_vpd) * col(vpd)) * col(lai)


# ---- snow --------------------------------------------------------------------------------------

def snowfall(p, t, t_snow: float = 1.0) -> Column:
    return F.when(col(t) < t_snow, col(p)).otherwise(0.0)


def potential_melt(t, ddf: float = 4.0, t_melt: float = 0.0) -> Column:
    return floor0(col(t) - t_melt) * ddf
