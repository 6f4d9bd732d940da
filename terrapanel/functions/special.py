"""Special functions: columns for gamma, normal quantile and chi-square; small driver routines for t and beta."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.numeric import col

# Lanczos coefficients (g = 7, nine terms).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]

# Wichura (1988) AS 241, numerator and denominator of the centre, the shoulder and the tail.
PPND_CENTRE = ([3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457,
                67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
               [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610,
                28729.085735721942674, 5226.4952788528545610])
PPND_SHOULDER = ([1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258,
                  0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4],
                 [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
                  0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
PPND_TAIL = ([6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930,
              0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
             [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4,
              1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])


def gamma(x) -> Column:
    """Gamma function of a column that is not a non-positive integer."""
    x = col(x)

    def right(z: Column) -> Column:
        z = z - 1.0
        s = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:], 1):
            s = s + F.lit(c) / (z + float(i))
        t = z + 7.5
        return F.pow(t, z + 0.5) * F.exp(-t) * s * math.sqrt(2.0 * math.pi)

    return F.when(x < 0.5, F.lit(math.pi) / (F.sin(x * math.pi) * right(F.lit(1.0) - x))).otherwise(right(x))


def _rational(r: Column, pair) -> Column:
    def horner(c):
        out = F.lit(c[-1])
        for a in reversed(c[:-1]):
            out = out * r + a
        return out
    return horner(pair[0]) / horner(pair[1])


def with_normal_quantile(df: DataFrame, p: str, out: str) -> DataFrame:
    """Adds the standard normal quantile of a column in (0, 1) (AS 241, about 16 digits).

    The inner arguments are columns of their own, so the rational functions do not repeat them.
    """
    q, r = F.col(p) - 0.5, F.col("_nq_r")
    d = df.withColumn("_nq_r", F.sqrt(-F.ln(F.least(F.col(p), F.lit(1.0) - F.col(p))))).withColumn("_nq_c", F.lit(0.180625) - q * q)
    tail = F.when(r <= 5.0, _rational(r - 1.6, PPND_SHOULDER)).otherwise(_rational(r - 5.0, PPND_TAIL))
    value = F.when(F.abs(q) <= 0.425, q * _rational(F.col("_nq_c"), PPND_CENTRE)).otherwise(F.when(q < 0, -tail).otherwise(tail))
    return d.withColumn(out, value).drop("_nq_r", "_nq_c")


def chi_square_cdf(x, k: int) -> Column:
    """Chi-square distribution function with integer k, by finite sums: exponential terms, and for odd k the normal tail too."""
    h = col(x) / 2.0
    if k % 2 == 0:
        s, term = F.lit(1.0), F.lit(1.0)
        for i in range(1, k // 2):
            term = term * h / float(i)
            s = s + term
        return F.lit(1.0) - F.exp(-h) * s
    # P(chi2_k > x) = erfc(sqrt(h)) + exp(-h) * sum of h^(j - 1/2) / gamma(j + 1/2) for j = 1 .. (k - 1) / 2
    tail = erfc(F.sqrt(h))
    for j in range(1, (k - 1) // 2 + 1):
        tail = tail + F.exp(-h) * F.pow(h, F.lit(j - 0.5)) / math.gamma(j + 0.5)
    return F.lit(1.0) - tail


def erfc(x) -> Column:
    """Complementary error function of a column that is not negative: Maclaurin series up to 2.5, a continued fraction beyond."""
    x = col(x)
    near = F.least(x, F.lit(2.5))
    square, total = near * near, F.lit(0.0)
    for n in range(60, -1, -1):  # Horner over (-x^2)^n / (n! (2 n + 1)) as nested ratios
        total = F.lit(1.0 / (2 * n + 1)) - total * square / float(n + 1) if n < 60 else F.lit(1.0 / (2 * n + 1))
    far, fraction = F.greatest(x, F.lit(2.5)), F.greatest(x, F.lit(2.5))
    for n in range(60, 0, -1):
        fraction = far + F.lit(n / 2.0) / fraction
    low = F.lit(1.0) - near * total * (2.0 / math.sqrt(math.pi))
    return F.when(x <= 2.5, low).otherwise(F.exp(-far * far) / (fraction * math.sqrt(math.pi)))


# ---- driver routines: a handful of numbers, never rows ------------------------------------------

def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    f = d
    for m in range(1, 10000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + num * d) or tiny)
            c = (1.0 + num / c) or tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * f


def _solve(cdf, target: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if cdf(mid) < target else (lo, mid)
    return 0.5 * (lo + hi)


def beta_quantile(p: float, a: float, b: float) -> float:
    return _solve(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def t_tail(t: float, dof: float) -> float:
    """P(T > t) of Student's t."""
    half = 0.5 * beta_cdf(dof / (dof + t * t), dof / 2.0, 0.5)
    return half if t >= 0 else 1.0 - half


def t_quantile(p: float, dof: float) -> float:
    return _solve(lambda x: 1.0 - t_tail(x, dof), p, -1e4, 1e4)


def event_rate_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact two-sided interval of a rate k / n."""
    if n <= 0 or not 0 <= k <= n:
        raise ValueError("need 0 <= events <= person-years and at least one person-year")
    a = (1.0 - level) / 2.0
    lo = 0.0 if k == 0 else beta_quantile(a, k, n - k + 1)
    hi = 1.0 if k == n else beta_quantile(1.0 - a, k + 1, n - k)
    return lo, hi


def zero_event_bound(n: int, level: float = 0.95) -> float:
    if n <= 0:
        raise ValueError("need at least one person-year")
    return 1.0 - (1.0 - level) ** (1.0 / n)
