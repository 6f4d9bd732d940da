"""Models fitted from distributed aggregates: the driver only ever sees k x k sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terrapanel.functions.ecology import cloglog, cloglog_inverse
from terrapanel.functions.numeric import all_finite, clip
from terrapanel.functions.special import t_quantile, t_tail
from terrapanel.operators import boosting as boost
from terrapanel.operators import forests
from terrapanel.operators.means import demean, demean_two_way
from terrapanel.operators.neighbours import knn
from terrapanel.operators.order_stats import bin_index, dense_index, exact_quantiles, quantile_array
from terrapanel.tables import cut_lineage


def gram(df: DataFrame, columns: Sequence[str], target: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """X'WX, X'Wy and y'Wy in one aggregate."""
    w = F.lit(1.0) if weight is None else weight
    k = len(columns)
    cells = [F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    cells += [F.sum(w * F.col(c) * F.col(target)).alias(f"c{i}") for i, c in enumerate(columns)]
    row = df.agg(*cells, F.sum(w * F.col(target) * F.col(target)).alias("yy")).first()
    g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    return g, np.array([row[f"c{i}"] for i in range(k)], dtype=float), float(row["yy"])


def dot(columns: Sequence[str], beta: Sequence[float]) -> Column:
    """Linear predictor with fixed coefficients."""
    return reduce(lambda a, b: a + b, [F.col(c) * float(b) for c, b in zip(columns, beta)])


# ---- cloglog regression ----------------------------------------------------------------------------

def _penalised(g: np.ndarray, c: np.ndarray, l1: float, l2: float, start: np.ndarray, free: int, sweeps: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Minimises b'Gb - 2c'b + l2 |b|^2 + l1 |b|_1 with the first ``free`` coefficients unpenalised."""
    pen = np.full(len(c), l2)
    pen[:free] = 0.0
    if l1 == 0.0:
        return np.linalg.solve(g + np.diag(pen), c)
    b = start.copy()
    for _ in range(sweeps):
        old = b.copy()
        for j in range(len(b)):
            rho = c[j] - g[j] @ b + g[j, j] * b[j]
            shrink = rho if j < free else math.copysign(max(abs(rho) - l1 / 2.0, 0.0), rho)
            b[j] = shrink / (g[j, j] + pen[j]) if g[j, j] + pen[j] > 0 else 0.0
        if np.max(np.abs(b - old)) < tol:
            break
    return b


def fit_cloglog(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, offset: str | None = None, l1: float = 0.0,
                l2: float = 1e-4, max_iter: int = 100, tol: float = 1e-8) -> np.ndarray:
    """Intercept and coefficients of a binomial model with complementary log-log link, by reweighted least squares.

    Each round is one aggregate of (k + 1)^2 sums over the rows, which are written once before the loop.
    """
    cols = ["_one", *features]
    off = F.lit(0.0) if offset is None else F.col(offset)
    d = cut_lineage(df.select(F.lit(1.0).alias("_one"), *features, F.col(y).cast("double").alias("_y"), off.alias("_off"),
                              (F.lit(1.0) if weight is None else F.col(weight)).alias("_w")))
    mean = min(max(d.agg(F.avg("_y")).first()[0], 1e-4), 1 - 1e-4)
    beta = np.zeros(len(cols))
    beta[0] = math.log(-math.log1p(-mean))
    for _ in range(max_iter):
        s = d.withColumn("_lin", dot(cols, beta))
        s = s.withColumn("_e", F.exp(clip(F.col("_lin") + F.col("_off"), -30.0, 30.0)))
        s = s.withColumn("_mu", clip(-F.expm1(-F.col("_e")), 1e-10, 1 - 1e-10))
        s = s.withColumn("_dmu", F.greatest((F.lit(1.0) - F.col("_mu")) * F.col("_e"), F.lit(1e-10)))
        s = s.withColumn("_z", F.col("_lin") + (F.col("_y") - F.col("_mu")) / F.col("_dmu"))
        wt = F.col("_w") * F.col("_dmu") * F.col("_dmu") / (F.col("_mu") * (F.lit(1.0) - F.col("_mu")))
        g, c, _ = gram(s.withColumn("_wt", wt), cols, "_z", F.col("_wt"))
        new = _penalised(g, c, l1, l2, beta, 1)
        moved = np.max(np.abs(new - beta))
        beta = new
        if moved < tol:
            break
    return beta


ROWS = "x binary, y binary, w binary, off binary, fold binary"


def fit_cloglog_folds(df: DataFrame, features: Sequence[str], y: str, fold: str, folds: int, weight: str | None = None, offset: str | None = None, l1: float = 0.0,
                      l2: float = 1e-4, max_iter: int = 100, tol: float = 1e-8) -> list[np.ndarray]:
    """The models of ``fit_cloglog`` without the rows of each fold, and one of all rows, together.

    Rows are packed into blocks once. A round is one pass over the blocks, which gives (k + 1)^2 sums for every model that still moves.
    """
    k, schema = len(features) + 1, to_arrow_schema(T.StructType.fromDDL(ROWS))
    columns = [*features, y, F.lit(1.0) if weight is None else F.col(weight), F.lit(0.0) if offset is None else F.col(offset)]

    def pack(batches):
        for b in batches:
            *x, target, w, off = (np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns[:-1])
            parts = [np.column_stack([np.ones(b.num_rows), *x]), target, w, off, np.asarray(b.columns[-1], np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], schema=schema)

    blocks = cut_lineage(df.select(*[F.col(c).cast("double").alias(f"_{i}") if isinstance(c, str) else c.cast("double").alias(f"_{i}") for i, c in enumerate(columns)], F.col(fold).cast("int").alias("_f")).mapInArrow(pack, ROWS))
    opened = lambda row: (np.frombuffer(row[0]).reshape(-1, k), *map(np.frombuffer, row[1:4]), np.frombuffer(row[4], np.int32))

    def added(part, make, shape):
        total = np.zeros(shape)
        for row in part:
            total += make(*opened(row))
        return [total]

    def over(make, shape):
        return blocks.rdd.mapPartitions(lambda part: added(part, make, shape)).treeReduce(np.add)

    n, events = over(lambda x, target, w, off, f: np.stack([np.bincount(f, v, folds)[:folds] for v in (None, target)]), (2, folds))
    betas = [np.zeros(k) for _ in range(folds + 1)]
    for m, b in enumerate(betas):
        own = np.arange(folds) != m
        mean = min(max(events[own].sum() / max(n[own].sum(), 1.0), 1e-4), 1 - 1e-4)
        b[0] = math.log(-math.log1p(-mean))
    moving = set(range(folds + 1))
    for _ in range(max_iter):
        sent = {m: betas[m] for m in sorted(moving)}

        def sums(x, target, w, off, f):
            out = np.empty((len(sent), k, k + 1))  # noqa: B023
            for i, (m, beta) in enumerate(sent.items()):  # noqa: B023
                own = slice(None) if m == folds else f != m
                u, t, v = x[own], target[own], w[own]
                lin = u @ beta
                e = np.exp(np.clip(lin + off[own], -30.0, 30.0))
                mu = np.clip(-np.expm1(-e), 1e-10, 1 - 1e-10)
                dmu = np.maximum((1.0 - mu) * e, 1e-10)
                wx = u * (v * dmu * dmu / (mu * (1.0 - mu)))[:, None]
                out[i, :, :k], out[i, :, k] = wx.T @ u, wx.T @ (lin + (t - mu) / dmu)
            return out

        for m, table in zip(sent, over(sums, (len(sent), k, k + 1))):
            new = _penalised(table[:, :k], table[:, k], l1, l2, betas[m], 1)
            if np.max(np.abs(new - betas[m])) < tol:
                moving.discard(m)
            betas[m] = new
        if not moving:
            break
    return betas


def cloglog_link(features: Sequence[str], beta: np.ndarray, offset: str | None = None) -> Column:
    eta = F.lit(float(beta[0])) + dot(features, beta[1:])
    return eta if offset is None else eta + F.col(offset)


# ---- fixed effects -----------------------------------------------------------------------------------

def within_ols(df: DataFrame, y: str, x: Sequence[str], unit: str, clusters: Sequence[str], second: str | None = None) -> dict:
    """Fixed-effects regression with CR1 errors per clustering; the larger error decides.

    Deviations from unit means come from an aggregate and a join; the sums, the scores per cluster and their outer
    products are aggregates. Incomplete rows are dropped; collinear regressors are refused.
    """
    d = df.filter(all_finite([y, *x])).select(y, *x, *dict.fromkeys([unit, *clusters, *([second] if second else [])]))
    d = demean(d, unit, [y, *x]) if second is None else demean_two_way(d, unit, second, [y, *x])
    d = cut_lineage(d)
    g, c, yy = gram(d, x, y)
    if np.linalg.cond(g) > 1e10:
        raise ValueError("the regressors are collinear after removing the unit means")
    bread = np.linalg.inv(g)
    beta = bread @ c
    r = d.withColumn("_r", F.col(y) - dot(x, beta))
    info = r.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(unit).alias("u"), F.sum(F.col("_r") * F.col("_r")).alias("rss")).first()
    n, k = info["n"], len(x)
    se, n_clusters = {}, {}
    for cl in clusters:
        s = r.groupBy(cl).agg(*[F.sum(F.col(v) * F.col("_r")).alias(f"s{i}") for i, v in enumerate(x)])
        row = s.agg(F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
        meat = np.array([[row[f"m{i}_{j}"] for j in range(k)] for i in range(k)], dtype=float)
        groups = row["g"]
        scale = groups / (groups - 1.0) * (n - 1.0) / (n - k) if groups > 1 else math.nan
        se[cl] = np.sqrt(np.diag(scale * bread @ meat @ bread))
        n_clusters[cl] = groups
    used = np.nanmax(np.vstack(list(se.values())), axis=0)
    dof = max(1, min(n_clusters.values()) - 1)
    t = t_quantile(0.975, dof)
    return {"terms": list(x), "coef": beta, "se": se, "se_used": used, "n_clusters": n_clusters, "dof": dof, "lo": beta - t * used, "hi": beta + t * used,
            "p": [2.0 * t_tail(abs(b / s), dof) for b, s in zip(beta, used)], "n": n, "n_units": info["u"], "r2_within": 1.0 - info["rss"] / yy if yy > 0 else math.nan}


def leave_group_out_r2(df: DataFrame, y: str, x: Sequence[str], unit: str, group: str) -> dict:
    """Out-of-sample R2 when each group is held out: unit means and slopes are fitted on the other groups.

    All folds come from one table of sums per (unit, group). The sums of a fold are the totals less the held-out
    part, so no fold refits on rows and no row is copied per fold.
    """
    names = [y, *x]
    d = df.filter(all_finite(names))
    mean = d.agg(*[F.avg(v).alias(v) for v in names]).first()
    d = d.select(unit, group, *[(F.col(v) - float(mean[v])).alias(v) for v in names])
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.count(F.lit(1)).cast("double").alias("n")] + [F.sum(v).alias(f"s{i}") for i, v in enumerate(names)] + [
        F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in pairs]
    pg = d.groupBy(unit, group).agg(*sums)
    fields = ["n", *[f"s{i}" for i in range(k)], *[f"q{i}_{j}" for i, j in pairs]]
    tot = pg.groupBy(unit).agg(*[F.sum(f).alias(f"t_{f}") for f in fields])
    j = cut_lineage(pg.join(tot, unit))
    for f in fields:
        j = j.withColumn(f"r_{f}", F.col(f"t_{f}") - F.col(f))

    def inside(p, a, b):
        q = F.col(f"{p}q{a}_{b}") - F.col(f"{p}s{a}") * F.col(f"{p}s{b}") / F.nullif(F.col(f"{p}n"), F.lit(0.0))
        return F.coalesce(F.when(F.col(f"{p}n") > 0, q), F.lit(0.0))

    whole = tot.agg(*[F.sum(inside("t_", a, b)).alias(f"w{a}_{b}") for a, b in pairs]).first()
    parts = j.groupBy(group).agg(*[F.sum(inside("r_", a, b) - inside("t_", a, b)).alias(f"w{a}_{b}") for a, b in pairs]).collect()  # one row per group
    slopes = {}
    for row in parts:
        w = {p: whole[f"w{p[0]}_{p[1]}"] + row[f"w{p[0]}_{p[1]}"] for p in pairs}
        g = np.array([[w[(min(a, b), max(a, b))] for b in range(1, k)] for a in range(1, k)])
        slopes[row[group]] = np.linalg.solve(g, np.array([w[(0, a)] for a in range(1, k)]))
    rows = [(g, [1.0, *[-float(b) for b in v]]) for g, v in slopes.items()]
    coef = df.sparkSession.createDataFrame(rows, f"`{group}` {dict(df.dtypes)[group]}, _b array<double>")
    m = [F.col(f"r_s{a}") / F.nullif(F.col("r_n"), F.lit(0.0)) for a in range(k)]

    def about(a, b):
        a, b = min(a, b), max(a, b)
        return F.col(f"q{a}_{b}") - m[a] * F.col(f"s{b}") - m[b] * F.col(f"s{a}") + F.col("n") * m[a] * m[b]

    sse = reduce(lambda p, q: p + q, [F.col("_b")[a] * F.col("_b")[b] * about(a, b) for a in range(k) for b in range(k)])
    out = j.filter(F.col("r_n") > 0).join(F.broadcast(coef), group).agg(F.sum(sse).alias("m"), F.sum(about(0, 0)).alias("z"), F.sum("n").alias("n")).first()
    return {"r2": 1.0 - out["m"] / out["z"] if out["z"] else math.nan, "n_test": int(out["n"])}


def verdict(coef: str, lo: str, hi: str, expected: int = -1) -> Column:
    """supports / contradicts when the interval lies on one side of zero, else inconclusive."""
    side = F.when((F.col(lo) > 0) | (F.col(hi) < 0), F.when(F.signum(coef) == float(np.sign(expected)), "supports").otherwise("contradicts"))
    return F.when(all_finite([coef, lo, hi]), F.coalesce(side, F.lit("inconclusive"))).otherwise("inconclusive")


# ---- splines --------------------------------------------------------------------------------------------

def bspline_basis(x, inner: Sequence[float], degree: int, lo: float, hi: float) -> list[Column]:
    """B-spline basis columns by the Cox-de Boor recursion; x is clipped to [lo, hi], the last interval is closed."""
    t = [lo] * (degree + 1) + [float(v) for v in inner] + [hi] * (degree + 1)
    v = clip(x, lo, hi)
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    base = [F.when((v >= t[i]) & ((v < t[i + 1]) | F.lit(i == last)), 1.0).otherwise(0.0) if t[i] < t[i + 1] else None for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        nxt = []
        for i in range(len(t) - 1 - d):
            parts = []
            if base[i] is not None and t[i + d] > t[i]:
                parts.append(base[i] * (v - t[i]) / (t[i + d] - t[i]))
            if base[i + 1] is not None and t[i + d + 1] > t[i + 1]:
                parts.append(base[i + 1] * (F.lit(t[i + d + 1]) - v) / (t[i + d + 1] - t[i + 1]))
            nxt.append(reduce(lambda a, b: a + b, parts) if parts else None)
        base = nxt
    return [b if b is not None else F.lit(0.0) for b in base]


def basis_numbers(x: float, inner: Sequence[float], degree: int, lo: float, hi: float) -> list[float]:
    """The same basis at one number (used for the few lag positions)."""
    t = [lo] * (degree + 1) + list(inner) + [hi] * (degree + 1)
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    b = [1.0 if t[i] < t[i + 1] and t[i] <= x and (x < t[i + 1] or i == last) else 0.0 for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        b = [(b[i] * (x - t[i]) / (t[i + d] - t[i]) if t[i + d] > t[i] else 0.0) + (
            b[i + 1] * (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) if t[i + d + 1] > t[i + 1] else 0.0) for i in range(len(t) - 1 - d)]
    return b


def cross_basis(lags: Sequence[str], x_knots: Sequence[float], lag_knots: Sequence[float], lo: float, hi: float, degree_x: int = 2, degree_lag: int = 2) -> list[Column]:
    """sum over lags of b_j(x at the lag) c_k(lag), in the order of (j, k)."""
    n = len(lags)
    weights = [basis_numbers(float(q), lag_knots, degree_lag, 0.0, float(n - 1)) for q in range(n)]
    per_lag = [bspline_basis(F.col(c), x_knots, degree_x, lo, hi) for c in lags]
    return [reduce(lambda a, b: a + b, [per_lag[q][j] * weights[q][k] for q in range(n)])
            for j in range(len(per_lag[0])) for k in range(len(weights[0]))]


def design_matrix(df: DataFrame, age: str, age_knots: Sequence[float], climate: Sequence[str], place: str, lagged: dict | None = None,
                  stand: Sequence[str] = (), age_range: tuple[float, float] | None = None) -> tuple[DataFrame, list[str]]:
    """Age spline, within and between climate terms, drought-legacy cross-basis and stand terms as named columns."""
    from terrapanel.operators.means import mundlak
    if age_range is None:
        r = df.agg(F.min(age), F.max(age)).first()
        age_range = (float(r[0]), float(r[1]))
    d = mundlak(df, place, climate)
    names = []
    for i, c in enumerate(bspline_basis(F.col(age), age_knots, 3, *age_range)):
        names.append(f"age_{i}")
        d = d.withColumn(names[-1], c)
    for c in climate:
        d = d.withColumnsRenamed({f"{c}_dev": f"{c}_within", f"{c}_bar": f"{c}_between"})
        names += [f"{c}_within", f"{c}_between"]
    for z, (cols, xk, lk, lo, hi) in (lagged or {}).items():
        for i, c in enumerate(cross_basis(cols, xk, lk, lo, hi)):
            names.append(f"{z}_lag_{i}")
            d = d.withColumn(names[-1], c)
    return d, [*names, *stand]


# ---- stacking ----------------------------------------------------------------------------------------------

def nnls2(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Two non-negative weights that minimise b'Gb - 2c'b, scaled to sum one (equal when both vanish)."""
    best, arg = 0.0, np.zeros(2)
    both = np.linalg.solve(g, c) if abs(np.linalg.det(g)) > 1e-300 else np.array([-1.0, -1.0])
    for b in (both, np.array([c[0] / g[0, 0], 0.0]), np.array([0.0, c[1] / g[1, 1]])):
        if np.all(b >= 0) and b @ g @ b - 2 * c @ b < best:
            best, arg = b @ g @ b - 2 * c @ b, b
    return arg / arg.sum() if arg.sum() > 0 else np.full(2, 0.5)


def binned_link_target(df: DataFrame, link: str, y: str, n_bins: int = 20, out: str = "target") -> DataFrame:
    """Adds the link of the event rate in the row's quantile bin of ``link``."""
    edges = quantile_array(df, link, [i / n_bins for i in range(1, n_bins)]).agg(F.max(F.array_distinct("q"))).scalar()
    ends = F.concat(F.array(F.lit(float("-inf"))), edges, F.array(F.lit(float("inf"))))
    d = df.withColumn("_e", ends).withColumn("_bin", bin_index(link, "_e"))
    rate = d.groupBy("_bin").agg(cloglog(clip(F.avg(y), 1e-4, 1 - 1e-4)).alias(out))
    return d.join(F.broadcast(rate), "_bin").drop("_e", "_bin")  # n_bins rows


def stack_weights(df: DataFrame, a: str, b: str, y: str, n_bins: int = 20) -> np.ndarray:
    """Non-negative weights of two out-of-fold link predictions against the link of the event rate in the bins of their mean.

    The target is one number per bin, so after the quantiles one pass gives a row of sums per bin; rows are not read again with their target.
    """
    d = df.withColumn("_mid", (F.col(a) + F.col(b)) * 0.5)
    edges = sorted(set(quantile_array(d, "_mid", [i / n_bins for i in range(1, n_bins)]).first()["q"]))  # n_bins numbers
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e <= F.col("_mid")))
    x, z = F.col(a), F.col(b)
    rows = d.groupBy(at.alias("_bin")).agg(cloglog(clip(F.avg(y), 1e-4, 1 - 1e-4)).alias("t"), F.sum(x * x).alias("aa"), F.sum(x * z).alias("ab"),
                                           F.sum(z * z).alias("bb"), F.sum(x).alias("a"), F.sum(z).alias("b")).collect()  # n_bins rows
    total = lambda f: float(sum(f(r) for r in rows if r["t"] is not None and r["a"] is not None and r["b"] is not None))
    ab = total(lambda r: r["ab"])
    g = np.array([[total(lambda r: r["aa"]), ab], [ab, total(lambda r: r["bb"])]])
    return nnls2(g, np.array([total(lambda r: r["t"] * r["a"]), total(lambda r: r["t"] * r["b"])]))


def monotone_violations(grid: DataFrame, key: str, x: str, pred: str, sign: int = 1, tol: float = 1e-12) -> DataFrame:
    """Steps along a feature grid that move against the declared sign, per key (a key holds one grid)."""
    from pyspark.sql import Window as W
    step = F.col(pred) - F.lag(pred).over(W.partitionBy(key).orderBy(x))
    d = grid.withColumn("_s", step * float(sign))
    return d.groupBy(key).agg(F.count_if(F.col("_s") < -tol).alias("violations"), F.count("_s").alias("steps"))


# ---- area of applicability -------------------------------------------------------------------------------------

def sampled_pairs(df: DataFrame, key: str, features: Sequence[str], max_pairs: int = 200_000) -> DataFrame:
    """Feature pairs (a_*, b_*) of rows drawn with replacement, equal draws left out.

    The draw numbers follow two irrational rotations of the row position, so they are the same on every run.
    """
    idx = dense_index(df.select(key, *features), key, "_i")
    n = idx.agg(F.count(F.lit(1))).scalar()
    p = F.col("id").cast("double")
    frac = lambda c: c - F.floor(c)
    draws = df.sparkSession.range(max_pairs).select(
        F.floor(frac((p + 0.5) * 0.6180339887498949) * n).alias("_a"), F.floor(frac((p + 0.5) * 0.7548776662466927) * n).alias("_b"))
    side = lambda pre: idx.select(F.col("_i").alias(f"_{pre}"), *[F.col(f).alias(f"{pre}_{f}") for f in features])
    return draws.filter(F.col("_a") != F.col("_b")).join(side("a"), "_a").join(side("b"), "_b").drop("_a", "_b")


def mean_pair_distance(df: DataFrame, key: str, features: Sequence[str], max_pairs: int = 200_000) -> Column:
    s = sampled_pairs(df, key, features, max_pairs)
    d = reduce(lambda a, b: a + b, [F.pow(F.col(f"a_{f}") - F.col(f"b_{f}"), 2) for f in features])
    return s.agg(F.avg(F.sqrt(d))).scalar()


def area_of_applicability(train: DataFrame, new: DataFrame, features: Sequence[str], train_id: str, new_id: str, fold: str,
                          weights: dict[str, float] | None = None, max_pairs: int = 200_000) -> DataFrame:
    """(new id, di, threshold, inside): distance to the nearest training row over the mean pair distance.

    The threshold is Q3 + 1.5 IQR of the training rows' own index against rows of other folds. Neighbours come from the
    bucketed search, quantiles from the bucketed exact quantile.
    """
    names = list(features)
    stat = train.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in names], *[(F.stddev_pop(c) + 1e-12).alias(f"s_{c}") for c in names]).alias("s")).scalar()

    def scaled(df, *keep):
        d = df.withColumn("_s", stat)
        return d.select(*keep, *[((F.col(c) - F.col(f"_s.m_{c}")) / F.col(f"_s.s_{c}") * float((weights or {}).get(c, 1.0))).alias(c) for c in names])

    tr = cut_lineage(scaled(train, train_id, fold))
    dbar = cut_lineage(tr.sparkSession.range(1).select(mean_pair_distance(tr, train_id, names, max_pairs).alias("d"))).select("d").scalar()
    own = knn(tr, tr.withColumnRenamed(train_id, "_t"), 1, train_id, "_t", names, exclude=fold).select((F.col("dist") / dbar).alias("di"))
    q = exact_quantiles(cut_lineage(own), "di", [0.25, 0.75])
    iqr = q.agg(F.struct(F.min("q").alias("q1"), F.max("q").alias("q3")).alias("q"))
    limit = iqr.select(F.col("q.q3") + (F.col("q.q3") - F.col("q.q1")) * 1.5).scalar()
    out = knn(tr.drop(fold), scaled(new, new_id), 1, train_id, new_id, names)
    return out.select(new_id, (F.col("dist") / dbar).alias("di"), limit.alias("threshold")).withColumn("inside", F.col("di") <= F.col("threshold"))


def group_applicability(train: DataFrame, new: DataFrame, features: Sequence[str], train_id: str, new_id: str, block: str, minimum: int = 20) -> DataFrame:
    """As above for one group; without enough complete training rows or two blocks nothing is inside."""
    ok = train.filter(all_finite(features))
    n = ok.agg(F.count(F.lit(1)).alias("n"), (F.max(block) > F.min(block)).alias("b")).first()
    if n["n"] < minimum or not n["b"]:
        return new.select(new_id, F.lit(None).cast("double").alias("di"), F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("inside"))
    complete = new.filter(all_finite(features))
    out = area_of_applicability(ok, complete, features, train_id, new_id, block)
    return new.select(new_id).join(out, new_id, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


__all__ = ["gram", "dot", "fit_cloglog", "fit_cloglog_folds", "cloglog_link", "within_ols", "leave_group_out_r2", "verdict", "bspline_basis", "cross_basis", "design_matrix",
           "nnls2", "binned_link_target", "stack_weights", "monotone_violations", "sampled_pairs", "mean_pair_distance", "area_of_applicability",
           "group_applicability", "cloglog_inverse"]


# ---- logistic regression per group ---------------------------------------------------------------------------------

def fit_logistic(df: DataFrame, features: Sequence[str], y: str, by: str | None = None, weight: Column | None = None, l2: float = 1.0,
                 max_iter: int = 50, tol: float = 1e-10) -> dict:
    """Penalised logistic regression (intercept free) for every group at once, by Newton steps.

    A round is one aggregate of k^2 sums per group; the groups are a dimension (species), so the sums fit the driver.
    Returns group -> coefficients with the intercept first. ``l2`` multiplies half the squared slopes, as 1 / C does.
    """
    cols, k = ["_one", *features], len(features) + 1
    d = cut_lineage(df.select((F.lit("all") if by is None else F.col(by)).alias("_g"), F.lit(1.0).alias("_one"), *features,
                              F.col(y).cast("double").alias("_y"), (F.lit(1.0) if weight is None else weight).alias("_w")))
    groups = [r[0] for r in d.select("_g").distinct().collect()]
    beta = {g: np.zeros(k) for g in groups}
    pen = np.diag([0.0] + [l2] * (k - 1))
    for _ in range(max_iter):
        rows = [(g, [float(v) for v in b]) for g, b in beta.items()]
        b = df.sparkSession.createDataFrame(rows, f"_g {dict(d.dtypes)['_g']}, _b array<double>")
        s = d.join(F.broadcast(b), "_g")  # one row per group
        s = s.withColumn("_p", F.lit(1.0) / (F.exp(-reduce(lambda p, q: p + q, [F.col(c) * F.col("_b")[i] for i, c in enumerate(cols)])) + 1.0))
        h = F.col("_w") * F.col("_p") * (F.lit(1.0) - F.col("_p"))
        s = s.withColumn("_h", h).withColumn("_r", F.col("_w") * (F.col("_y") - F.col("_p")))
        sums = s.groupBy("_g").agg(*[F.sum(F.col("_r") * F.col(c)).alias(f"g{i}") for i, c in enumerate(cols)],
                                   *[F.sum(F.col("_h") * F.col(cols[i]) * F.col(cols[j])).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).collect()
        moved = 0.0
        for r in sums:
            hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + pen
            step = np.linalg.solve(hess, np.array([r[f"g{i}"] for i in range(k)]) - pen @ beta[r["_g"]])
            beta[r["_g"]] = beta[r["_g"]] + step
            moved = max(moved, float(np.max(np.abs(step))))
        if moved < tol * max([1.0, *(float(np.max(np.abs(b))) for b in beta.values())]):
            return beta
    raise RuntimeError(f"no logistic fit within {max_iter} rounds: the last step was {moved:.2g}")


def presence_background(occ: DataFrame, background: DataFrame, features: Sequence[str], species: str = "species", C: float = 1.0, minimum: int = 25) -> DataFrame:
    """One balanced ridge model per species with enough complete records: (species, status, n, intercept, coef).

    The background is shared, so it is copied once per species; species are a handful.
    """
    pres = occ.filter(all_finite(features)).select(species, *features, F.lit(1.0).alias("_y"))
    n = pres.groupBy(species).agg(F.count(F.lit(1)).alias("n_presence"))
    fit = n.filter(F.col("n_presence") >= minimum)
    names = fit.agg(F.sort_array(F.collect_set(species))).scalar()
    back = background.filter(all_finite(features)).select(F.explode(names).alias(species), *features, F.lit(0.0).alias("_y"))
    both = pres.join(fit.select(species), species, "left_semi").unionByName(back)
    size = both.groupBy(species, "_y").agg(F.count(F.lit(1)).alias("_c"))
    total = size.groupBy(species).agg(F.sum("_c").alias("_t"))
    size = size.join(total, species).select(species, "_y", (F.col("_t") / (F.col("_c") * 2.0)).alias("_wt"))
    d = both.join(F.broadcast(size), [species, "_y"])  # two rows per species
    beta = fit_logistic(d, features, "_y", species, F.col("_wt"), 1.0 / C)
    rows = [(g, float(b[0]), [float(v) for v in b[1:]]) for g, b in beta.items()]
    m = occ.sparkSession.createDataFrame(rows, f"{species} string, intercept double, coef array<double>")
    return n.join(m, species, "left").withColumn("status", F.when(F.col("coef").isNull(), "skipped_insufficient_data").otherwise("fitted"))


def calibration(df: DataFrame, p: str, y: str, eps: float = 1e-6) -> tuple[float, float]:
    """Slope and intercept of the outcome on the logit of the forecast."""
    q = clip(p, eps, 1 - eps)
    b = fit_logistic(df.select(F.ln(q / (F.lit(1.0) - q)).alias("_x"), F.col(y).alias("_yy")), ["_x"], "_yy", l2=1e-6)["all"]
    return float(b[1]), float(b[0])


def humidity_offset(days: DataFrame, keys: Sequence[str], t_min: str, target: str, steps: int = 60) -> DataFrame:
    """Offset k per series with mean saturation vapour pressure of (t_min - k) equal to the target, by bisection.

    A series holds one year of days, folded inside the row.
    """
    from terrapanel.functions.weather import saturation_vp
    g = days.groupBy(*keys).agg(F.collect_list(t_min).alias("_t"), F.first(target).alias("_target"))
    start = F.struct(F.lit(-10.0).alias("lo"), F.lit(40.0).alias("hi"))

    def step(acc, _):
        mid = (acc["lo"] + acc["hi"]) * 0.5
        mean = F.aggregate("_t", F.lit(0.0), lambda s, t: s + saturation_vp(t - mid)) / F.size("_t")
        high = mean > F.col("_target")
        return F.struct(F.when(high, mid).otherwise(acc["lo"]).alias("lo"), F.when(high, acc["hi"]).otherwise(mid).alias("hi"))

    f = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return g.select(*keys, f.alias("_f")).select(*keys, ((F.col("_f.lo") + F.col("_f.hi")) * 0.5).alias("k"))


def fit_variogram(bins: Sequence[tuple[float, float]]) -> dict:
    """Exponential and straight-line fits of at most a few dozen (lag, semivariance) bins.

    For a fixed range the exponential model is linear in nugget and sill, so the range is found by a refined grid.
    The plateau is called visible when the exponential R2 exceeds the linear one by 0.03.
    """
    h = np.array([b[0] for b in bins], dtype=float)
    g = np.array([b[1] for b in bins], dtype=float)
    sst = float(((g - g.mean()) ** 2).sum()) or 1.0

    def at(r):
        u = 1.0 - np.exp(-h / r)
        best = None
        options = [np.linalg.lstsq(np.column_stack([np.ones_like(u), u]), g, rcond=None)[0], np.array([0.0, max((u @ g) / (u @ u), 0.0)])]
        for nug, sill in options:
            nug, sill = min(max(nug, 0.0), g.max()), min(max(sill, 0.0), 2 * g.max())
            sse = float(((g - nug - sill * u) ** 2).sum())
            best = min(best, (sse, nug, sill)) if best else (sse, nug, sill)
        return best

    lo, hi = 1.0, 1000.0
    for _ in range(6):
        grid = np.geomspace(lo, hi, 60)
        i = int(np.argmin([at(r)[0] for r in grid]))
        lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, 59)]
    r = float(0.5 * (lo + hi))
    sse, nug, sill = at(r)
    slope, icpt = np.polyfit(h, g, 1)
    r2_lin = 1.0 - float(((g - slope * h - icpt) ** 2).sum()) / sst
    r2 = 1.0 - sse / sst
    return {"nugget": float(nug), "sill": float(sill), "range": r, "practical_range": 3 * r, "r2": r2, "r2_linear": r2_lin, "plateau": bool(r2 - r2_lin >= 0.03)}


FOREST = {"numTrees": 500, "maxDepth": 15, "maxMemoryInMB": 1024, "minInstancesPerNode": 1}  # names and depth of Spark's forests


def forest(train: DataFrame, features: Sequence[str], y: str, weight: str | None = None, seed: int = 0, **settings):
    """Random forest classifier on an assembled feature column."""
    from pyspark.ml.classification import RandomForestClassifier
    d = assembled(train, features).withColumn("_label", F.col(y).cast("double"))
    rf = RandomForestClassifier(labelCol="_label", featuresCol="_features", seed=seed, **{**FOREST, **settings})
    return (rf if weight is None else rf.setWeightCol(weight)).fit(d)


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("_features", array_to_vector(F.array(*[F.col(f).cast("double") for f in features])))


def scored_by(model, df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """Adds the model's probability of the event."""
    if isinstance(model, forests.Forest):
        return forests.predict(df, model, features, out)
    from pyspark.ml.functions import vector_to_array
    d = model.transform(assembled(df, features))
    return d.withColumn(out, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def stacked_hazard(df: DataFrame, features: Sequence[str], y: str, block: str, key: str, l2: float = 1e-4, seed: int = 0, weight: str | None = None, offset: str | None = None,
                   increasing: Sequence[str] = (), decreasing: Sequence[str] = (), boosting: dict | None = None, trees: dict | None = None) -> tuple[DataFrame, dict]:
    """Out-of-fold predictions of three learners per block, and the models fitted on all rows with the stacking weights.

    Blocks are folds (a handful). The models of all folds and of the final fit are made together: the cloglog model (which alone takes the
    offset, on the link scale) in one pass per round, the trees from one table of rows that are counted by equal bins. Where that table is too
    long for a task, boosting goes by passes and the forest is Spark's, one fit per fold. Incomplete rows are dropped.
    """
    keep = dict.fromkeys([key, block, y, *features, *([weight] if weight else []), *([offset] if offset else [])])
    d = df.select(*keep).where(all_finite([y, *features]))
    # one small file would be one task in every pass of the learners
    d = cut_lineage(d.repartition(max(d.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism), key))
    blocks = sorted(r[0] for r in d.select(block).distinct().collect())
    number = reduce(lambda e, b: e.when(F.col(block) == F.lit(b[1]), F.lit(b[0])), enumerate(blocks), F.when(F.lit(False), F.lit(-1)))
    d = d.withColumn("_fold", number)
    settings = {**FOREST, **(trees or {})}
    cuts = boost.quantile_cuts(d, features, (boosting or {}).get("bins", 255))
    distinct = cut_lineage(boost.distinct_rows(d, features, y, weight, "_fold", cuts))
    gbm = boost.fit(d, features, y, "_fold", len(blocks), weight, increasing, decreasing, **{**(boosting or {}), "cuts": cuts, "distinct": distinct})
    glm = fit_cloglog_folds(d, features, y, "_fold", len(blocks), weight, offset, l2=l2)
    link = reduce(lambda e, b: e.when(F.col("_fold") == b[0], cloglog_link(features, b[1], offset)), enumerate(glm[:-1]), F.when(F.lit(False), F.lit(0.0)))
    if settings.keys() == FOREST.keys() and distinct.count() <= boost.WHOLE:
        rf = forests.fit(distinct, cuts, len(blocks), settings["numTrees"], settings["maxDepth"], settings["minInstancesPerNode"], seed)
        oof = boost.predict_counted(d.withColumn("link_glm", link), distinct, {"_pg": gbm, "p_forest": rf}, features, "_fold")
    else:
        rf = [forest(tr, features, y, weight, seed, **(trees or {})) for tr in [*[d.filter(F.col("_fold") != i) for i in range(len(blocks))], d]]
        parts = [scored_by(m, d.filter(F.col("_fold") == i), features, "p_forest") for i, m in enumerate(rf[:-1])]
        oof = boost.predict(reduce(DataFrame.unionByName, parts).withColumn("link_glm", link), gbm, features, "_pg", "_fold")
    oof = cut_lineage(oof.select(key, block, y, "link_glm", cloglog(clip("_pg", 1e-10, 1 - 1e-10)).alias("link_gbm"), "p_forest"))
    w = stack_weights(oof, "link_glm", "link_gbm", y)
    link = F.col("link_glm") * float(w[0]) + F.col("link_gbm") * float(w[1])
    return oof.withColumn("link_stat", link).withColumn("p_stat", cloglog_inverse(link)), {"weights": w, "glm": glm[-1], "gbm": gbm[-1], "forest": rf[-1]}
