"""Plant hydraulic columns on trait tables."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapanel import constants as K
from terrapanel.functions.numeric import col, floor0


def leaf_leakage(t, g25, tp, q10_below: float = 1.2, q10_above: float = 4.8) -> Column:
    """Residual leaf conductance with a phase change at ``tp``."""
    t, tp = col(t), col(tp)
    low = F.pow(F.lit(q10_below), (F.least(t, tp) - 25.0) / 10.0)
    high = F.pow(F.lit(q10_above), floor0(t - tp) / 10.0)
    return col(g25) * low * high


def conductivity_loss(psi, p50, slope) -> Column:
    """Percent loss of conductivity at a water potential."""
    return F.lit(100.0) / (F.exp(col(slope) / 25.0 * (col(psi) - col(p50))) + 1.0)


def potential_at_loss(percent, p50, slope) -> Column:
    return col(p50) + F.ln((F.lit(100.0) - col(percent)) / col(percent)) * 25.0 / col(slope)


def curve_slope(p12, p88) -> Column:
    """Slope at P50 from the potentials at 12 and 88 percent loss."""
    return F.lit(50.0 * math.log(88.0 / 12.0)) / (col(p12) - col(p88))


def stomatal_opening(psi, psi50, slope: float = 4.0) -> Column:
    return F.lit(1.0) / (F.exp((col(psi) - col(psi50)) * -slope) + 1.0)


def closure_potential(psi50, slope: float = 4.0) -> Column:
    """Potential with stomata 90 percent closed."""
    return col(psi50) - math.log(9.0) / slope


def critical_potential(p50, slope, lethal) -> Column:
    return potential_at_loss(lethal, p50, slope)


def water_buffer(capacitance, psi_close, p50, slope, lethal) -> Column:
    """Water available between closure and the lethal potential, never negative."""
    return floor0(col(capacitance) * (col(psi_close) - critical_potential(p50, slope, lethal)))


def daily_loss(t, vpd, p, g25, tp) -> Column:
    """Water lost through closed leaves in a day, mmol m-2."""
    return leaf_leakage(t, g25, tp) * col(vpd) / col(p) * K.SECONDS_PER_DAY


def days_to_failure(buffer, t, vpd, p, g25, tp) -> Column:
    return col(buffer) / F.nullif(daily_loss(t, vpd, p, g25, tp), F.lit(0.0))
