"""Restoration plans: dominance, evaluation, footprint, allocation and the priced portfolio with a bound."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from terrapanel.operators.order_stats import running_totals
from terrapanel.tables import cut_lineage

BLOCK = 256  # units of a block
PER_CORE = 2  # tasks a core that units are dealt over


def benefit_maps(benefits: DataFrame) -> DataFrame:
    """(u, j, _b): benefit per hectare by scenario."""
    return benefits.groupBy("u", "j").agg(F.map_from_entries(F.collect_list(F.struct("c", "b"))).alias("_b"))


def packed_units(options: DataFrame, benefits: DataFrame, scenarios: Sequence) -> DataFrame:
    """(u, opts): every unit with its options as one array of (j, grp, eligible, area, cost, b[]), totals per unit.

    ``options`` (u, j, grp, area, cost per hectare, eligible), ``benefits`` (u, j, c, b per hectare); a missing
    benefit is 0. The number of options and of scenarios is fixed by the study, not by the data.
    """
    return _packed(options, benefit_maps(benefits), scenarios)


def _packed(options: DataFrame, maps: DataFrame, scenarios: Sequence) -> DataFrame:
    order = F.array(*[F.lit(c) for c in scenarios])
    o = options.join(maps, ["u", "j"], "left")
    value = lambda c: F.coalesce(F.element_at("_b", c), F.lit(0.0)) * F.col("area")
    o = o.withColumn("_v", F.when(F.col("_b").isNull(), F.transform(order, lambda c: F.lit(0.0))).otherwise(F.transform(order, value)))
    s = F.struct("j", "grp", "eligible", "area", (F.col("cost") * F.col("area")).alias("cost"), F.col("_v").alias("b"))
    return o.groupBy("u").agg(F.array_sort(F.collect_list(s)).alias("opts"))


def dominated(options: DataFrame, benefits: DataFrame, capped: bool = False) -> DataFrame:
    """(j, by): options that another option beats or ties in every unit and scenario, with the lowest such option.

    Option k makes j unnecessary when, wherever j is allowed, k is allowed, costs no more and gives at least as much in
    every scenario; of two identical options the lower stays. With a group cap k must share j's group and areas. Pairs of
    options are compared inside the unit's row and combined per pair in the same task: J^2 sums leave it. Dominance with
    this tie rule is transitive, so removing all dominated options at once keeps an undominated one for each.
    """
    scenarios = sorted(r[0] for r in benefits.select("c").distinct().collect())  # scenario dimension
    p = packed_units(options, benefits, scenarios)
    names = options.agg(F.sort_array(F.collect_set("j"))).scalar()
    d = p.withColumn("_o", F.map_from_entries(F.transform("opts", lambda o: F.struct(o["j"], o)))).withColumn("_j", F.explode(names))
    d = d.withColumn("j", F.element_at("_o", F.col("_j"))).withColumn("_k", F.explode(names)).filter(F.col("_j") != F.col("_k"))
    d = d.withColumn("k", F.element_at("_o", F.col("_k")))
    je, ke = F.coalesce("j.eligible", F.lit(False)), F.coalesce("k.eligible", F.lit(False))
    diff = F.zip_with("k.b", "j.b", lambda a, b: a - b)
    covers = ke & (F.col("k.cost") <= F.col("j.cost")) & F.forall(diff, lambda x: x >= 0)
    if capped:
        covers = covers & (F.col("k.grp") == F.col("j.grp")) & (F.col("k.area") == F.col("j.area"))
    same = (F.col("k.cost") == F.col("j.cost")) & F.forall(diff, lambda x: x == 0)
    g = d.groupBy("_j", "_k").agg(F.bool_and(F.when(je, F.coalesce(covers, F.lit(False)))).alias("covers"),
                                  F.bool_and(F.when(je, F.coalesce(same, F.lit(False)))).alias("same"), F.bool_and(je == ke).alias("elig"))
    wins = F.col("covers") & (~(F.col("same") & F.col("elig")) | (F.col("_k") < F.col("_j")))
    never = F.col("covers").isNull()    # allowed nowhere
    return g.filter(F.coalesce(wins, never)).groupBy(F.col("_j").alias("j")).agg(F.min("_k").alias("by"))


def prune_dominated(options: DataFrame, benefits: DataFrame, capped: bool = False) -> DataFrame:
    return options.join(dominated(options, benefits, capped).select("j"), "j", "left_anti")


# ---- reading a plan ------------------------------------------------------------------------------------

def scenario_benefit(plan: DataFrame, benefits: DataFrame) -> DataFrame:
    """(c, benefit): total benefit of the planted options (plan: u, j, area) per scenario."""
    all_c = benefits.select("c").distinct()
    b = plan.select("u", "j", "area").join(benefits, ["u", "j"]).groupBy("c").agg(F.sum(F.col("b") * F.col("area")).alias("benefit"))
    return all_c.join(b, "c", "left").withColumn("benefit", F.coalesce("benefit", F.lit(0.0)))


def evaluate_plan(plan: DataFrame, benefits: DataFrame, weights: DataFrame | None = None, alpha: float = 0.8) -> DataFrame:
    """Expected benefit and lower tail of a fixed plan: scenarios from the worst up to the first cumulative weight of
    1 - alpha, averaged by weight. The scenario table is a dimension of a few dozen rows."""
    from pyspark.sql import Window as W
    s = scenario_benefit(plan, benefits)
    s = s.withColumn("w", F.lit(1.0)) if weights is None else s.join(weights, "c")
    one = W.partitionBy(F.lit(0))
    s = s.withColumn("w", F.col("w") / F.sum("w").over(one))
    before = F.coalesce(F.sum("w").over(one.orderBy("benefit", "c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    tail = F.when(before < 1.0 - alpha - 1e-12, F.col("w"))
    s = s.withColumn("_t", tail)
    return s.agg(F.sum(F.col("w") * F.col("benefit")).alias("expected"), (F.sum(F.col("_t") * F.col("benefit")) / F.sum("_t")).alias("cvar"),
                 F.min("benefit").alias("worst"), F.count(F.lit(1)).alias("n_scenarios"))


def extrapolation_footprint(plan: DataFrame, benefits: DataFrame, inside: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Expected benefit in all and outside the area of applicability (inside: u, inside; an absent unit is outside)."""
    b = benefits.withColumn("w", F.lit(1.0)) if weights is None else benefits.join(weights, "c")
    total = (benefits.select("c").distinct().withColumn("w", F.lit(1.0)) if weights is None else weights).agg(F.sum("w")).scalar()
    d = plan.select("u", "j", "area").join(b, ["u", "j"]).join(inside, "u", "left")
    v = F.col("b") * F.col("w") / total * F.col("area")
    out = F.sum(F.when(F.coalesce("inside", F.lit(False)), 0.0).otherwise(v))
    return d.agg(F.sum(v).alias("total"), out.alias("outside")).withColumn(
        "share", F.when(F.col("total") > 0, F.col("outside") / F.nullif(F.col("total"), F.lit(0.0))).otherwise(0.0))


def allocation(plan: DataFrame) -> DataFrame:
    """Units, hectares and cost by method, by group and in all: one pass over grouping sets."""
    g = plan.groupingSets([["method"], ["grp"], []], "method", "grp").agg(
        F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("units"), F.sum("area").alias("area_ha"), F.sum(F.col("area") * F.col("cost")).alias("cost_usd"))
    level = F.when(F.col("_id") == 1, "method").when(F.col("_id") == 2, "group").otherwise("total")
    return g.select(level.alias("level"), F.coalesce("method", "grp", F.lit("all")).alias("name"), "units", "area_ha", "cost_usd")


def region_table(plan: DataFrame, region: str = "region") -> DataFrame:
    return plan.groupBy(region).agg(F.count(F.lit(1)).alias("cells"), F.sum("area").alias("area_ha")).orderBy(F.desc("area_ha"), region)


def plan_rows(plan: DataFrame, cells: DataFrame, regions: DataFrame, scores: DataFrame) -> DataFrame:
    """One export row per treated cell with position, region, area, group, method, cost and viability."""
    d = plan.join(cells, "u").join(regions, "u", "left").join(scores, ["u", "grp"], "left")
    return d.select("u", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "region", F.col("area").alias("area_ha"), F.col("grp").alias("species_group"),
                    "method", F.col("cost").alias("cost_per_ha_usd"), F.round(F.col("cost") * F.col("area")).alias("cost_usd"), "viability_mean", "viability_worst20pct")


# ---- priced portfolio -------------------------------------------------------------------------------------

def tail_mean(b: np.ndarray, alpha: float) -> float:
    """Unweighted mean of the worst ceil((1 - alpha) C) scenarios (the figure reported with a solved plan)."""
    k = max(math.ceil((1 - alpha) * len(b) - 1e-12), 1)
    return float(np.sort(b)[:k].mean())


def _envelope(b: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    """Scenario weights of the worst case: mass w / (1 - alpha) from the worst scenario up, one in all."""
    q, left = np.zeros(len(b)), 1.0
    for i in np.argsort(b, kind="stable"):
        q[i] = min(w[i] / (1.0 - alpha), left)
        left -= q[i]
    return q


class Portfolio:
    """One option per unit under a budget, mean and lower tail traded by ``lam``, with prices instead of a solver.

    For a price on cost, prices on group shares and scenario weights inside the tail's envelope, every unit takes its
    best option on its own, so a round is one pass over the units without a shuffle of them; a whole grid of cost
    prices is tried in the same pass. Any such choice gives an upper bound, any affordable choice a plan. The result
    states both and the gap; it does not claim the optimum. Units lie in blocks, whose options are matrices (the method
    and group as a place in the study's lists); an option without name, cost or area is never taken.
    """

    def __init__(self, options: DataFrame, benefits: DataFrame, weights: dict | None = None):
        maps = cut_lineage(benefit_maps(benefits))
        self.scenarios = sorted(r[0] for r in maps.select(F.explode(F.map_keys("_b")).alias("c")).distinct().collect())
        w = np.array([1.0 if weights is None else float(weights[c]) for c in self.scenarios])
        self.w = w / w.sum()
        named = options.groupBy("j", "grp", "eligible").agg(F.count(F.lit(1)).alias("n")).collect()  # the study's lists
        self.groups = sorted({r["grp"] for r in named})
        self.methods = sorted({r["j"] for r in named if r["eligible"] and r["j"] is not None})
        units = _packed(options.filter("eligible AND j IS NOT NULL"), maps, self.scenarios)
        tasks = PER_CORE * options.sparkSession.sparkContext.defaultParallelism
        self.unit = units.schema["u"].dataType
        self.blocks = cut_lineage(units.repartition(tasks, "u").mapInArrow(self._block(), f"u array<{self.unit.simpleString()}>, starts binary, j binary, grp binary, area binary, cost binary, b binary, top double"))
        self.top_price = float(self.blocks.agg(F.max("top")).first()[0] or 0.0) * 1.01 + 1e-9

    def _block(self):
        """Rows of units to rows of blocks: the units, where each one's options start, and the options' columns one after the other."""
        methods, groups, n, kind = pa.array(self.methods, pa.string()), pa.array(self.groups, pa.string()), len(self.scenarios), self.unit

        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_type
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(lo, BLOCK)
                    o, opts = part.column("opts").flatten(), part.column("opts")
                    count = opts.value_lengths().to_numpy()
                    number = lambda f: o.field(f).to_numpy(zero_copy_only=False).astype(float)
                    cost, area = number(4), number(3)
                    b = o.field(5).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(cost), n)
                    per = b.max(axis=1, initial=-np.inf) / np.where(cost == 0, np.nan, cost)
                    top = float(np.nanmax(per)) if np.isfinite(per).any() else None
                    place = lambda f, names: o.field(f).dictionary_encode().cast(pa.string()).to_pandas().map({v: i for i, v in enumerate(names.to_pylist())}).to_numpy().astype(np.int32)
                    row = [np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), place(0, methods), place(1, groups), area, cost, np.ascontiguousarray(b.T)]
                    units = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("u").cast(to_arrow_type(kind)))
                    yield pa.RecordBatch.from_arrays([units, *[pa.array([x.tobytes()], pa.binary()) for x in row], pa.array([top], pa.float64())],
                                                     names=["u", "starts", "j", "grp", "area", "cost", "b", "top"])

        return run

    def _choose(self, value: np.ndarray, nu: dict, share: float):
        """A function of a block that gives its columns, gains and, for a price, the place and score of every unit's best option."""
        cap, n = np.array([float(nu.get(g, 0.0)) for g in self.groups]), len(self.scenarios)
        free = sum(nu.values()) * share if nu else 0.0

        def columns(batch, i):
            read = lambda c, t: np.frombuffer(batch.column(c)[i].as_py(), dtype=t)
            starts, grp, area, cost = read("starts", np.int64), read("grp", np.int32), read("area", float), read("cost", float)
            b = read("b", float).reshape(n, len(cost))
            gain = np.zeros(len(cost))
            for x, v in zip(b, value):
                gain = gain + x * float(v)
            held, charge = np.diff(np.append(starts, len(cost))), area * (cap[grp] - free)

            def best(price):
                s = gain - cost * price - charge
                s = np.where(np.isnan(s), -np.inf, s)
                top = np.maximum.reduceat(s, starts)
                # a tie goes to the earlier option
                first = np.where(s == np.repeat(top, held), np.arange(len(s)), len(s))
                return np.minimum.reduceat(first, starts), top

            return grp, area, cost, b, gain, best

        return columns

    def _round(self, value: np.ndarray, prices: Sequence[float], nu: dict, share: float) -> list:
        columns, n, k = self._choose(value, nu, share), len(self.scenarios), len(self.groups)
        prices = [float(p) for p in prices]
        names = ["s", "cost", *[f"b{i}" for i in range(n)], *[f"a{i}" for i in range(k)]]

        def run(batches):
            total = np.zeros((len(prices), len(names)))
            for batch in batches:
                for r in range(batch.num_rows):
                    grp, area, cost, b, gain, best = columns(batch, r)
                    for i, p in enumerate(prices):
                        at, top = best(p)
                        at, top = at[top > 0], top[top > 0]
                        total[i, 0] += top.sum()
                        total[i, 1] += cost[at].sum()
                        total[i, 2 : 2 + n] += b[:, at].sum(axis=1)
                        total[i, 2 + n :] += np.bincount(grp[at], area[at], k)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(prices)), pa.int32()), *[pa.array(c) for c in total.T]], names=["i", *names])

        d = self.blocks.select("starts", "grp", "area", "cost", "b").mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
        rows = {r["i"]: r for r in d.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()}
        out = []
        for i, p in enumerate(prices):
            r = rows.get(i) or dict.fromkeys(names, 0.0)
            out.append({"price": p, "s": r["s"], "cost": r["cost"], "b": np.array([r[f"b{x}"] for x in range(n)]), "area": np.array([r[f"a{x}"] for x in range(k)])})
        return out

    def _chosen(self, value: np.ndarray, price: float, nu: dict, share: float) -> DataFrame:
        """(u, s, j, grp, area, cost, b, gain): every unit's best option at the given prices."""
        columns, methods, groups, n = self._choose(value, nu, share), pa.array(self.methods, pa.string()), pa.array(self.groups, pa.string()), len(self.scenarios)
        d = self.blocks.sparkSession.createDataFrame([], f"u {self.unit.simpleString()}, s double, j string, grp string, area double, cost double, b array<double>, gain double")
        out, schema = to_arrow_schema(d.schema), d.schema

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    grp, area, cost, b, gain, best = columns(batch, r)
                    at, top = best(float(price))
                    j = np.frombuffer(batch.column("j")[r].as_py(), dtype=np.int32)
                    units = batch.column("u").slice(r, 1).flatten()
                    many = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(b[:, at].T).ravel()))
                    cols = [units, pa.array(top), methods.take(pa.array(j[at])), groups.take(pa.array(grp[at])), pa.array(area[at]), pa.array(cost[at]), many, pa.array(gain[at])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out)], schema=out)

        return self.blocks.mapInArrow(run, schema)

    def objective(self, b: np.ndarray, lam: float, alpha: float) -> float:
        return float((1 - lam) * self.w @ b + lam * _envelope(b, self.w, alpha) @ b)

    def solve(self, budget: float, lam: float = 0.5, alpha: float = 0.8, share: float = 1.0, tol: float = 1e-3, patience: int = 3, grid: int = 12) -> dict:
        """Plan table and figures for one budget; ``share`` below 1 caps every group's part of the planted area.

        Rounds end when the gap between the bound and the best plan is below ``tol``, or has not shrunk by that much in ``patience``
        rounds (so there are at most patience / tol of them).
        """
        q, nu, bound, best = self.w.copy(), {g: 0.0 for g in self.groups} if share < 1.0 else {}, math.inf, None
        least, still = math.inf, 0
        for t in itertools.count():
            value = (1 - lam) * self.w + lam * q
            lo, hi = 0.0, self.top_price
            pick = None
            for _ in range(2):
                res = self._round(value, np.linspace(lo, hi, grid), nu, share)
                bound = min(bound, min(r["s"] + r["price"] * budget for r in res))
                ok = [i for i, r in enumerate(res) if r["cost"] <= budget + 1e-9]
                if not ok:
                    break
                pick = res[ok[0]]
                if ok[0] == 0:
                    break
                lo, hi = res[ok[0] - 1]["price"], pick["price"]
            if pick is None:
                break
            over = self._excess(pick["area"], share)
            score = self.objective(pick["b"], lam, alpha)
            if over <= 1e-9 and (best is None or score > best[0]):
                best = (score, value.copy(), pick["price"], dict(nu))
            elif best is None or best[0] == -math.inf:
                best = (-math.inf, value.copy(), pick["price"], dict(nu))
            gap = (bound - best[0]) / bound if bound > 0 and math.isfinite(best[0]) else math.inf
            least, still = (gap, 0) if gap < least - tol else (least, still + 1)
            if gap <= tol or still >= patience:
                break
            step = 2.0 / (t + 3.0)
            q = (1 - step) * q + step * _envelope(pick["b"], self.w, alpha)
            if nu:
                total = max(pick["area"].sum(), 1e-9)
                scale = max(abs(score), 1.0) / total
                for g, a in zip(self.groups, pick["area"]):
                    nu[g] = max(0.0, nu[g] + step * scale * (a / total - share))
        plan = self._plan(best, budget, share) if best else None
        return self._report(plan, budget, lam, alpha, bound, share)

    def _excess(self, area: np.ndarray, share: float) -> float:
        total = area.sum()
        return 0.0 if share >= 1.0 or total <= 0 else float((area - share * total).max())

    def _plan(self, best: tuple, budget: float, share: float) -> DataFrame:
        """The affordable choice at the final prices, trimmed to the caps, then filled by value for money."""
        _, value, price, nu = best
        d = cut_lineage(self._chosen(value, price, nu, share))
        take = d.filter(F.col("s") > 0).drop("s")
        if share < 1.0:
            return self._trim(take, share)
        left = budget - float(take.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0])
        rest = d.filter(F.col("s") <= 0).drop("s").filter((F.col("cost") <= left) & (F.col("gain") > 0))
        rest = rest.withColumn("_e", -F.col("gain") / F.greatest(F.col("cost"), F.lit(1e-12)))
        upto = running_totals(rest, "_e", {"c": F.col("cost")}).filter(F.col("c_before") + F.col("c") <= left).select("_e")
        return cut_lineage(take.unionByName(rest.join(upto, "_e", "left_semi").drop("_e")))

    def _trim(self, take: DataFrame, share: float) -> DataFrame:
        """Drops the least valuable units of a group above its share until every group fits."""
        for _ in range(2 * len(self.groups) + 2):
            a = {r["grp"]: r["a"] for r in take.groupBy("grp").agg(F.sum("area").alias("a")).collect()}
            total = sum(a.values())
            over = {g: share / (1 - share) * (total - v) for g, v in a.items() if v > share * total * (1 + 1e-12)}
            if not over:
                return take
            g, room = max(over.items(), key=lambda x: a[x[0]] - x[1])
            part = take.filter(F.col("grp") == g).withColumn("_e", -F.col("gain") / F.greatest(F.col("area"), F.lit(1e-12)))
            keep = running_totals(part, "_e", {"s": F.col("area")}).filter(F.col("s_before") + F.col("s") <= room).select("_e")
            take = cut_lineage(take.filter(F.col("grp") != g).unionByName(part.join(keep, "_e", "left_semi").drop("_e")))
        raise RuntimeError("no plan within the share of a group was found")

    def _report(self, plan: DataFrame | None, budget: float, lam: float, alpha: float, bound: float, share: float) -> dict:
        n = len(self.scenarios)
        if plan is None:
            b, cost, units, area = np.zeros(n), 0.0, 0, 0.0
        else:
            r = plan.agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("c"), F.sum("area").alias("a"), *[F.sum(F.col("b")[i]).alias(f"b{i}") for i in range(n)]).first()
            units, cost, area = r["n"], float(r["c"] or 0.0), float(r["a"] or 0.0)
            b = np.array([float(r[f"b{i}"] or 0.0) for i in range(n)])
        value = self.objective(b, lam, alpha)
        bound = max(bound, value) if math.isfinite(bound) else value
        return {"plan": plan, "budget": budget, "lam": lam, "share": share, "expected": float(self.w @ b), "cvar": tail_mean(b, alpha), "objective": value,
                "bound": bound, "gap": (bound - value) / bound if bound > 0 else 0.0, "units": units, "area": area, "cost": cost}


def frontier(p: Portfolio, budget: float, lambdas: Sequence[float] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), **kw) -> tuple[list[dict], float]:
    """A plan per lambda and the expected benefit given up between the ends."""
    plans = [p.solve(budget, lam, **kw) for lam in lambdas]
    return plans, plans[0]["expected"] - plans[-1]["expected"]


def budget_sweep(p: Portfolio, budgets: Sequence[float], shares: Sequence[float] = (1.0,), lam: float = 0.5, **kw) -> list[dict]:
    return [p.solve(b, lam, share=s, **kw) for s in shares for b in budgets]
