"""What the operators share: tables, the shared folder, text slices inside tasks, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where none is set and Spark runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_sample(rows: DataFrame, key: str, n: int, size: int) -> DataFrame:
    """At most ``size`` of ``n`` rows: those with the smallest values of ``key``, a 64-bit hash.

    Rows far beyond the expected place are left out first, so tasks send about twice ``size`` rows in all, not that many each.
    """
    if n > 2 * size:
        rows = rows.where(F.shiftrightunsigned(key, 1) < int(2 * size / n * 2**63))
    return rows.orderBy(F.shiftrightunsigned(key, 1), key).limit(size)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def slices(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``chars`` characters each (one row at least)."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def map_texts(df: DataFrame, schema: str, fn: Callable[..., dict], chars: int = 2_000_000) -> DataFrame:
    """Map rows whose last column is a text: ``fn`` gets the columns as lists for slices of bounded size and returns lists.

    Memory in a task is bounded by one Arrow batch and one slice (or one document, where that is longer).
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in slices(texts, chars):
                part = [batch.column(k).slice(lo, hi - lo).to_pylist() for k in range(batch.num_columns - 1)]
                out = fn(*part, texts[lo:hi])
                yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in arrow}, schema=arrow)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the least node of its component.

    Each round hooks every node on its least smaller neighbour, follows the hooks to their ends by doubling and rewrites the
    edges between the roots found; edges inside a tree vanish, so the table shrinks. No group is ever collected.
    """
    work = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    work = stored(work)
    label = stored(work.select(F.col("a").alias("node")).union(work.select("b")).distinct().select("node", F.col("node").alias("root")))
    while not work.isEmpty():
        hook, jumped = stored(work.groupBy("a").agg(F.min("b").alias("p"))), True
        while jumped:
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            both = stored(hook.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            hook, jumped = both.select("a", "p"), not both.where("moved").isEmpty()
        ra, rb = (hook.select(F.col("a").alias(k), F.col("p").alias(f"p{k}")) for k in "ab")
        moved = work.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        new = hook.select(F.col("a").alias("root"), F.col("p").alias("next"))
        label = stored(label.join(new, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        work = stored(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return label
