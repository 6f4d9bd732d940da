"""Operator 3: exact top-k search by inner product.

Vectors are packed into shards (rows of one matrix each) and queries into blocks. A task multiplies a block with a shard,
keeps the k best per query, and the short lists are merged in a tree of fixed width. Every query meets every shard; the
work is the product of the two, as an exact search needs, and what moves is a block per shard, not a row per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import stored

SHARD = 2048
BLOCK = 1024
WIDTH = 16
EXACT = 2.0**53


def scaled(vector: Column) -> Column:
    """floor(256 * x) of every component as double; null if the vector or a component is null or not finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(v, lambda x: F.floor(x * 256.0)))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(n, part, ids, vectors): rows of vectors with n components, about ``size`` to a pack, dealt by a hash of the id."""
    count = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    packs = count.select("n", F.ceil(F.col("rows") / size).cast("int").alias("packs"))
    dealt = rows.join(F.broadcast(packs), "n") if packs.limit(1001).count() <= 1000 else rows.join(packs, "n")
    dealt = dealt.select("n", F.pmod(F.xxhash64("vec_id"), F.col("packs")).cast("int").alias("part"), "vec_id", "v")

    def pack(key, table):
        n = key[0].as_py()
        v = np.asarray(table.column("v").combine_chunks().flatten(), np.int64).reshape(-1, n)
        v = v.astype(np.min_scalar_type(int(min(v.min(), -1 - v.max()))))  # the narrowest signed integer that holds them
        ids = np.asarray(table.column("vec_id"), np.int64)
        order = np.argsort(ids, kind="stable")
        return pa.table({"n": pa.array([n], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
                         "ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([v[order].tobytes()], pa.binary())})

    return dealt.groupBy("n", "part").applyInArrow(pack, "n int, part int, ids binary, vectors binary")


def _unpacked(data: bytes, rows: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (rows * n)}").reshape(rows, n)


def best(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of each query's k best in one shard (``v_ids`` ascending), its own id left out."""
    size = max(1.0, float(np.abs(q.astype("float64")).max(initial=0))) * max(1.0, float(np.abs(v.astype("float64")).max(initial=0))) * v.shape[1]
    if size < EXACT:
        score = (q.astype("float64") @ v.T.astype("float64")).astype(np.int64)
    else:  # numbers of any size, then held within 64 bits
        wide = q.astype(object) @ v.T.astype(object)
        score = np.array([[min(max(int(x), -(2**63) + 1), 2**63 - 1) for x in row] for row in wide], np.int64).reshape(wide.shape)
    own = q_ids[:, None] == v_ids[None, :]
    floor = np.iinfo(np.int64).min
    score[own] = floor
    m = len(v_ids)
    if m > k:
        # the k-th best score of a query, then what is above it and the first of what equals it: ids ascend along a row
        least = np.partition(score, m - k, axis=1)[:, m - k]
        above, equal = score > least[:, None], score == least[:, None]
        room = k - above.sum(axis=1)
        chosen = above | (equal & (np.cumsum(equal, axis=1) <= room[:, None]))
    else:
        chosen = np.ones_like(own)
    a, b = np.nonzero(chosen & ~own)
    return q_ids[a], v_ids[b], score[a, b]


def _merged(lists: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of all rows with equal ``by``: each partial list holds few rows."""
    top = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return lists.groupBy(*by).agg(top.alias("top")).select(*by, F.explode("top").alias("t")).select(
        *by, (-F.col("t.s")).alias("score"), F.col("t.vec_id").alias("vec_id"))


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest integer inner product for each query row.

    ``vectors`` has vec_id and embedding. Ties go to the smaller vec_id. Rows with a null vec_id or a vector that is null,
    empty or holds null or non-finite components take no part; vectors only meet vectors of their own length. Equal rows
    count once; rows that share an id but differ are candidates each, and none of them for a query of that id. Components and
    scores beyond 64 bits are held at its ends. An empty table gives no rows.
    """
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled(F.col("embedding")).alias("v"))
    rows = rows.where("size(v) > 0").select("vec_id", "v", F.size("v").alias("n")).distinct()
    rows = stored(rows)
    shards = stored(_packed(rows, SHARD))
    blocks = stored(_packed(rows.where(is_query), BLOCK))
    parts = shards.select("n", "part")
    sent = blocks.select("n", F.col("ids").alias("q_ids"), F.col("vectors").alias("q")).join(parts, "n")
    met = shards.join(sent, ["n", "part"])

    def multiply(batches):
        schema = pa.schema([("query_id", pa.int64()), ("part", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for batch in batches:
            for n, part, ids, v, q_ids, q in zip(*(batch.column(c).to_pylist() for c in ("n", "part", "ids", "vectors", "q_ids", "q")), strict=True):
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                a, b, s = best(_unpacked(q, len(q_ids), n), q_ids, _unpacked(v, len(ids), n), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.full(len(a), part, np.int32)), pa.array(b), pa.array(s)], schema=schema)

    lists = met.select("n", "part", "ids", "vectors", "q_ids", "q").mapInArrow(multiply, "query_id bigint, part int, vec_id bigint, score bigint")
    many = parts.agg(F.max("part")).first()[0] or 0
    while many >= WIDTH:
        lists = lists.withColumn("part", F.floor(F.col("part") / WIDTH).cast("int"))
        lists = _merged(lists, k, "query_id", "part")
        many //= WIDTH
    last = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    ranked = lists.groupBy("query_id").agg(last.alias("top")).select("query_id", F.posexplode("top").alias("i", "t"))
    return ranked.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))
