"""Exact nearest neighbours by cells of bounded size over all coordinates.

Nodes are cut into cells round by round: a cell with too many nodes is split at medians of its widest coordinates, taken from a
sample, so far outliers and dense places only move the cuts. A cell knows its box, its number of nodes and its most frequent
fold. A target descends the cuts to its home cell, whose nodes bound the distance sought, and then meets the other cells within
its bound, which are found box against box for all targets of a cell. Targets that find too few nodes at home descend the boxes on
their own: into a few near cells for a bound, then into all within it. Targets meet the nodes of a cell in matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terrapanel.functions.numeric import all_finite
from terrapanel.tables import cut_lineage, small

LEAF = 2048  # nodes of a cell
BITS = 4  # a round splits a cell into 2^BITS at most
SAMPLE = 2000  # nodes of a cell that the cuts are taken from
BEAM = 4  # cells in which a target's first bound is sought
TOGETHER = 4096  # targets that meet a cell in one task
MATRIX = 2**18  # distances held at a time
PER_CORE = 8  # tasks a core that cells are dealt over; Spark would go by bytes and take a few
SLACK = 1 + 1e-9


def _fold(c: str, kind: str) -> Column:
    """A fold as a number that Arrow passes without copies."""
    return F.col(c).cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(c).isNotNull(), F.xxhash64(c))


def _tree(rows: np.ndarray) -> tuple[list[int], list[float]]:
    """Axis and cut of the 2^BITS - 1 inner nodes of a balanced tree over sampled rows: the median of the widest axis, or the least
    value above the lowest where the median is the lowest. A node that can't be split sends everything left."""
    axis, cut, held = [0] * (1 << BITS), [float("inf")] * (1 << BITS), {1: rows}
    for i in range(1, 1 << BITS):
        x = held.pop(i)
        if len(x) > 1:
            a = int(np.argmax(np.subtract(*np.percentile(x, [95, 5], axis=0)) + 1e-9 * np.ptp(x, axis=0)))
            low, middle = x[:, a].min(), np.median(x[:, a])
            if x[:, a].max() > low:
                axis[i], cut[i] = a, float(middle if middle > low else x[x[:, a] > low, a].min())
        left = x[:, axis[i]] < cut[i]
        held[2 * i], held[2 * i + 1] = x[left], x[~left]
    return axis, cut


def grow(nodes: DataFrame, d: int, leaf: int) -> tuple[DataFrame, int]:
    """Nodes with their cell, and the number of rounds; cells of round r are the first r * BITS bits."""
    n, trees = planted(nodes, d, leaf)
    return n, len(trees)


def down(df: DataFrame, trees: DataFrame, d: int) -> DataFrame:
    """Rows one round further down: their cell becomes the one that its tree sends them to."""
    coords = F.array(*[f"c{i}" for i in range(d)])
    child = F.aggregate(F.sequence(F.lit(1), F.lit(BITS)), F.lit(1), lambda i, _: i * 2 + F.when(coords[F.col("axis")[i]] >= F.col("cut")[i], 1).otherwise(0)) - (1 << BITS)
    below = df.join(small(trees), "cell", "left").withColumn("child", F.when(F.col("axis").isNotNull(), child).otherwise(0))
    return below.select(*[c for c in df.columns if c != "cell"], (F.shiftleft("cell", BITS) + F.col("child")).alias("cell"))


def planted(nodes: DataFrame, d: int, leaf: int) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes with their cell, and the trees of every round.

    A round counts the cells, draws about ``SAMPLE`` rows of each that is too large (by a hash of the id), makes a
    tree of 2^BITS cells of every sample and sends the cell's nodes down. A cell whose nodes share one place stays as it is.
    """
    names = [f"c{i}" for i in range(d)]
    n, planted_trees = nodes.withColumn("cell", F.lit(0).cast("bigint")), []

    def plant(key, table):
        axis, cut = _tree(np.column_stack([table.column(c).to_numpy() for c in names]))
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "axis": pa.array([axis], pa.list_(pa.int32())), "cut": pa.array([cut], pa.list_(pa.float64()))})

    while True:
        wide = [F.max(c) > F.min(c) for c in names]
        apart = wide[0]
        for w in wide[1:]:
            apart = apart | w
        large = cut_lineage(n.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), apart.alias("apart")).where((F.col("n") > leaf) & F.col("apart")))
        if large.isEmpty():
            return n, planted_trees
        drawn = F.pmod(F.xxhash64("nid", F.lit(len(planted_trees))), F.lit(2**30)) < F.lit(2.0**30) * SAMPLE / F.col("n")
        sample = n.join(small(large), "cell").where(drawn).select("cell", *names)
        # the ends of every axis go with the sample, so it can always be split
        place = F.struct(*names)
        ends = n.join(small(large), "cell").groupBy("cell").agg(F.array(*[f(place, c) for c in names for f in (F.min_by, F.max_by)]).alias("e"))
        sample = sample.unionByName(ends.select("cell", F.explode("e").alias("e")).select("cell", "e.*"))
        trees = cut_lineage(sample.groupBy("cell").applyInArrow(plant, "cell bigint, axis array<int>, cut array<double>"))
        n = cut_lineage(down(n, trees, d))
        planted_trees.append(trees)


def boxes(nodes: DataFrame, d: int, rounds: int) -> list[DataFrame]:
    """One table per round: parent, cell, n, lo, hi, and the most frequent fold with its count."""
    corner = [*[F.min(f"c{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"c{i}").alias(f"hi{i}") for i in range(d)]]
    by_fold = cut_lineage(nodes.groupBy("cell", "fold").agg(F.count(F.lit(1)).alias("m"), *corner))
    corner = [*[F.min(f"lo{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(d)]]
    out = []
    for r in range(rounds, 0, -1):
        at = by_fold.withColumn("cell", F.shiftright("cell", BITS * (rounds - r))).groupBy("cell", "fold").agg(F.sum("m").alias("m"), *corner)
        whole = at.groupBy("cell").agg(F.sum("m").alias("n"), F.max(F.struct("m", "fold")).alias("top"), *corner)
        out.append(whole.select(F.shiftright("cell", BITS).alias("parent"), "cell", "n", F.col("top.m").alias("most"), F.col("top.fold").alias("top"),
                                F.array(*[f"lo{i}" for i in range(d)]).alias("lo"), F.array(*[f"hi{i}" for i in range(d)]).alias("hi")))
    return out[::-1]


def probes(places: DataFrame, levels: list[DataFrame], d: int, need: int, folds: bool, beam: int | None = None) -> DataFrame:
    """(pid, fold, coordinates, cell): the cells that may hold one of the ``need`` nearest admissible nodes of each place.

    A place's ``bound`` (a squared distance that is not too small, or null) closes boxes from the start. With ``beam``, only that many
    of the nearest boxes are followed: cells to find a bound in.
    """
    own = ["pid", "fold", "bound", *[f"c{i}" for i in range(d)]]
    open_ = places.select(*own, F.lit(0).cast("bigint").alias("parent"))
    for level in levels:
        j = open_.join(small(level), "parent")
        gap = [F.greatest(F.col("lo")[i] - F.col(f"c{i}"), F.col(f"c{i}") - F.col("hi")[i], F.lit(0.0)) for i in range(d)]
        reach = [F.greatest(F.abs(F.col(f"c{i}") - F.col("lo")[i]), F.abs(F.col(f"c{i}") - F.col("hi")[i])) for i in range(d)]
        near, far = (sum((x * x for x in s[1:]), s[0] * s[0]) for s in (gap, reach))
        if folds:
            same = F.col("top").eqNullSafe(F.col("fold"))
            sure = F.when(same, F.col("n") - F.col("most")).otherwise(F.greatest("most", F.col("n") - F.col("most")))
            j = j.where(~(same & (F.col("n") == F.col("most"))))
        else:
            sure = F.col("n")
        seen = j.groupBy("pid").agg(*[F.first(c).alias(c) for c in own[1:]], F.sort_array(F.collect_list(F.struct(far.alias("far"), sure.alias("sure"), near.alias("near"), "cell"))).alias("b"))
        if beam:
            by_near = F.sort_array(F.transform("b", lambda b: F.struct(b["near"], b["far"], b["cell"])))
            kept = F.transform(F.slice(by_near, 1, beam), lambda b: b["cell"])
        else:
            start = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(float("inf")).alias("bound"))
            bound = F.aggregate("b", start, lambda s, b: F.struct((s["held"] + b["sure"]).alias("held"), F.when((s["bound"] == float("inf")) & (s["held"] + b["sure"] >= need), b["far"]).otherwise(s["bound"]).alias("bound")))["bound"]
            seen = seen.withColumn("bound", F.least("bound", bound))
            kept = F.transform(F.filter("b", lambda b: b["near"] <= F.col("bound") * SLACK), lambda b: b["cell"])
        open_ = seen.select(*own, F.explode(kept).alias("parent"))
    return open_.withColumnRenamed("parent", "cell")


def nearest(d2: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``need`` smallest finite entries of each row, ties to the lower column."""
    n = d2.shape[1]
    top = np.finfo(float).max
    limit = np.minimum(d2.min(axis=1) if need == 1 else np.partition(d2, need - 1, axis=1)[:, need - 1], top) if n >= need else np.full(len(d2), top)
    row, col = np.nonzero(d2 <= limit[:, None])
    order = np.lexsort((col, d2[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(d2)))
    keep = np.arange(len(row)) - first[row] < need
    return row[keep], col[keep]


def euclidean(to: list[np.ndarray], at: list[np.ndarray], _: list[np.ndarray]) -> np.ndarray:
    """Squared distances of targets (rows) to nodes (columns), coordinate by coordinate."""
    d2 = np.zeros((len(to[0]), len(at[0])))
    for x, y in zip(to, at):
        step = x[:, None] - y[None, :]
        step *= step
        d2 += step
    return d2


def met(open_: DataFrame, nodes: DataFrame, d: int, need: int, folds: bool, measure: Callable = euclidean, extra: Sequence[str] = ()) -> DataFrame:
    """Rows of ``open_`` (pid, fold, bound, coordinates, cell) with ``near``: the ``need`` nearest (d2, nid) of the cell's nodes, none beyond the bound.

    ``measure`` makes squared distances from the targets' coordinates, the nodes' and the nodes' ``extra`` columns.
    """
    own = ["pid", "fold", "bound", *[f"c{i}" for i in range(d)], "cell"]
    tasks = PER_CORE * nodes.sparkSession.sparkContext.defaultParallelism
    open_ = cut_lineage(open_.select(*own))
    parts = cut_lineage(open_.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("bigint").alias("parts")))
    left = open_.join(small(parts), "cell").withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts"))).select(*own, "part")
    packed = nodes.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("nid", "fold", *[f"c{i}" for i in range(d)], *extra))).alias("nodes"))
    right = packed.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "nodes")
    schema = T.StructType([*[open_.schema[c] for c in own], T.StructField("near", T.ArrayType(T.StructType([T.StructField("d2", T.DoubleType()), T.StructField("nid", nodes.schema["nid"].dataType)])))])
    out = to_arrow_schema(schema)
    near_type = out.field("near").type

    def run(a, b):
        if not a.num_rows:
            return out.empty_table()
        row, found = [np.zeros(0, dtype=np.int64)], [pa.array([], near_type.value_type)]
        if b.num_rows:
            rows = b.column("nodes").combine_chunks().flatten()
            ids, held = rows.field(0), rows.field(1).to_numpy(zero_copy_only=False)
            at = [rows.field(2 + i).to_numpy(zero_copy_only=False) for i in range(d)]
            more = [rows.field(2 + d + i).to_numpy(zero_copy_only=False) for i in range(len(extra))]
            fold, to = a.column("fold").to_numpy(), [a.column(f"c{i}").to_numpy() for i in range(d)]
            bound = a.column("bound").to_numpy()  # missing is NaN
            bound = np.where(np.isnan(bound.astype(float)), np.inf, bound.astype(float))
            step = max(1, MATRIX // len(ids))
            for lo in range(0, a.num_rows, step):
                d2 = measure([x[lo : lo + step] for x in to], at, more)
                if folds:
                    f = fold[lo : lo + step, None]
                    d2[~(f != held[None, :]) | np.isnan(f.astype(float)) | np.isnan(held.astype(float))[None, :]] = np.inf
                r, c = nearest(d2, need)
                inside = d2[r, c] <= bound[lo + r]
                r, c = r[inside], c[inside]
                row.append(lo + r)
                found.append(pa.StructArray.from_arrays([pa.array(d2[r, c]), ids.take(pa.array(c))], fields=list(near_type.value_type)))
        ends = np.searchsorted(np.concatenate(row), np.arange(a.num_rows + 1)).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(found)).cast(near_type)
        return pa.table([*[a.column(c) for c in own], near], schema=out)

    keys = ["cell", "part"]
    return left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, schema)


def meet(open_: DataFrame, nodes: DataFrame, d: int, need: int, folds: bool, kind: str) -> DataFrame:
    """(pid, near): the ``need`` nearest (d2, nid) of every place over its cells."""
    got = met(open_.withColumn("bound", F.lit(None).cast("double")), nodes, d, need, folds).where(F.size("near") > 0)
    return got.groupBy("pid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, need).alias("near"))


def others(home: DataFrame, levels: list[DataFrame], d: int, folds: bool) -> DataFrame:
    """(pid, fold, bound, coordinates, cell): the cells besides its own within each place's bound.

    The places of a cell, apart by the magnitude of their bounds, descend the boxes as one box; a place then looks at the boxes kept for it.
    """
    home = home.withColumn("reach", F.floor(F.log2(F.greatest("bound", F.lit(1e-300))) / 4))
    corner = [F.array(*[f(f"c{i}") for i in range(d)]).alias(n) for n, f in (("from", F.min), ("to", F.max))]
    open_ = cut_lineage(home.groupBy(F.col("cell").alias("home"), "reach").agg(F.max("bound").alias("widest"), *corner)).withColumn("parent", F.lit(0).cast("bigint"))
    squared = lambda gap: sum((x * x for x in gap[1:]), gap[0] * gap[0])
    for level in levels:
        gap = [F.greatest(F.col("lo")[i] - F.col("to")[i], F.col("from")[i] - F.col("hi")[i], F.lit(0.0)) for i in range(d)]
        within = open_.drop("cell", "n", "most", "top", "lo", "hi").join(small(level), "parent").where(squared(gap) <= F.col("widest") * SLACK)
        open_ = cut_lineage(within.withColumn("parent", F.col("cell")))
    around = cut_lineage(open_.where(F.col("cell") != F.col("home")).select("home", "reach", F.col("cell").alias("other"), F.col("n") == F.col("most"), "top",
                                                                            *[F.col(e)[i].alias(f"{e}{i}") for e in ("lo", "hi") for i in range(d)]).toDF(
        "home", "reach", "other", "pure", "top", *[f"{e}{i}" for e in ("lo", "hi") for i in range(d)]))
    gap = [F.greatest(F.col(f"lo{i}") - F.col(f"c{i}"), F.col(f"c{i}") - F.col(f"hi{i}"), F.lit(0.0)) for i in range(d)]
    j = home.withColumnRenamed("cell", "home").join(small(around), ["home", "reach"]).where(squared(gap) <= F.col("bound") * SLACK)
    if folds:
        j = j.where(~(F.col("pure") & F.col("top").eqNullSafe(F.col("fold"))))
    return j.select("pid", "fold", "bound", *[f"c{i}" for i in range(d)], F.col("other").alias("cell"))


def search(places: DataFrame, nodes: DataFrame, trees: list[DataFrame], d: int, need: int, folds: bool, kind: str, measure: Callable = euclidean,
           extra: Sequence[str] = (), stretch: float = 1.0) -> DataFrame:
    """(pid, fold, coordinates, near): the ``need`` nearest (d2, nid) of every place.

    With a ``measure`` of its own, a node at a squared distance of d2 is at most ``stretch`` * d2 away in squared coordinates; that takes no
    folds and one neighbour.
    """
    rounds, names = len(trees), [f"c{i}" for i in range(d)]
    at = places.withColumn("cell", F.lit(0).cast("bigint"))
    for t in trees:
        at = down(at, t, d)
    how = (d, need, folds, measure, extra)
    home = met(at, nodes, *how)
    if not rounds:
        return home
    home, levels = cut_lineage(home), [cut_lineage(x) for x in boxes(nodes, d, rounds)]
    short, late = home.where(F.size("near") < need), None
    if not short.isEmpty():
        if measure is euclidean:
            late = short.drop("near").join(meet(candidates(short, nodes, d, rounds, need, folds, kind), nodes, d, need, folds, kind), "pid")
        else:  # an empty cell: the nearest box instead
            late = met(probes(short, levels, d, need, folds, 1), nodes, *how)
    full = home.where(F.size("near") >= need)
    if late is not None and measure is not euclidean:
        full, late = cut_lineage(full.unionByName(late)), None
    known = full.withColumn("bound", F.element_at("near", need)["d2"] * float(stretch))
    open_ = others(known.drop("near"), levels, d, folds)
    if measure is not euclidean:
        open_ = open_.withColumn("bound", F.lit(None).cast("double"))  # it is one of squared coordinates
    beyond = met(open_, nodes, *how).where(F.size("near") > 0).groupBy("pid").agg(F.flatten(F.collect_list("near")).alias("more"))
    both = full.join(beyond, "pid", "left")
    best = F.when(F.col("more").isNull(), F.col("near")).otherwise(F.slice(F.sort_array(F.concat("near", "more")), 1, need))
    both = both.select("pid", "fold", *names, best.alias("near"))
    return both if late is None else both.unionByName(late.select("pid", "fold", *names, "near"))


def candidates(places: DataFrame, nodes: DataFrame, d: int, rounds: int, need: int, folds: bool, kind: str) -> DataFrame:
    """The cells of each place: a bound from the nodes of a few near cells, then all cells within it."""
    levels = [cut_lineage(x) for x in boxes(nodes, d, rounds)]
    first = meet(probes(places, levels, d, need, folds, BEAM), nodes, d, need, folds, kind)
    bound = first.where(F.size("near") >= need).select("pid", F.element_at("near", need)["d2"].alias("found"))
    known = cut_lineage(places.join(bound, "pid", "left").withColumn("bound", F.col("found")).drop("found"))
    return probes(known, levels, d, need, folds)


def knn(nodes: DataFrame, targets: DataFrame, k: int, node_id: str = "node", target_id: str = "target", coords: Sequence[str] = ("x", "y"),
        exclude: str | None = None, leaf: int | None = None) -> DataFrame:
    """The k nearest nodes of every target, ties to the lower node id: (target, node, dist, nn) with nn = 1..k.

    Exact for any number of coordinates and any density; rows with a missing coordinate take no part. Nodes at one
    place (of one fold) are cut to the lowest ids that can be among the nearest, targets at one place search once.

    ``exclude``: ``"id"`` drops the node with the target's own id (leave one out); the name of a column present
    on both sides drops nodes of the target's own group (fold), and rows without one take no part.
    """
    d, leaf = len(coords), leaf or LEAF
    fold = exclude if exclude not in (None, "id") else None
    need = k + 1 if exclude == "id" else k
    own = lambda df: _fold(fold, dict(df.dtypes)[fold]) if fold else F.lit(0).cast("bigint")
    cs = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(coords)]
    names = [f"c{i}" for i in range(d)]
    n = nodes.select(F.col(node_id).alias("nid"), own(nodes).alias("fold"), *cs).where(all_finite(names) & F.col("fold").isNotNull())
    t = targets.select(F.col(target_id).alias("tid"), own(targets).alias("fold"), *cs).where(all_finite(names) & F.col("fold").isNotNull())
    kind = dict(n.dtypes)["nid"]
    lowest = F.slice(F.sort_array(F.collect_set("nid")), 1, need)
    per_task = n.groupBy(*names, "fold", F.pmod(F.xxhash64("nid"), F.lit(64)).alias("s")).agg(lowest.alias("ids"))  # a frequent place is 64 groups
    n = per_task.groupBy(*names, "fold").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, need).alias("ids")).select(F.explode("ids").alias("nid"), "fold", *names)
    n, trees = planted(cut_lineage(n), d, leaf)
    places = cut_lineage(t.select("fold", *names).distinct().withColumn("pid", F.monotonically_increasing_id()).withColumn("bound", F.lit(None).cast("double")))
    near = search(places, n, trees, d, need, fold is not None, kind)
    found = t.join(near, ["fold", *names])
    chosen = F.slice(F.filter("near", lambda x: x["nid"] != F.col("tid")), 1, k) if exclude == "id" else F.col("near")
    out = found.select("tid", F.posexplode(chosen).alias("i", "x"))
    return out.select(F.col("tid").alias(target_id), F.col("x.nid").alias(node_id), F.sqrt("x.d2").alias("dist"), (F.col("i") + 1).alias("nn"))
