"""Operator 1: near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is a run of five lower-case words. Its weight is (1 + ln tf) * idf, where

    idf = (SMOOTH + ln min(n / df, RARE)) / (SMOOTH + ln RARE),

df counts the texts that hold it and n all texts with words; a shingle in less than one in RARE texts weighs 1. So the table of
shingles whose idf is below 1 has at most RARE times the mean number of shingles of a text, at any size of the corpus. Weights
are whole multiples of 1/4096, and the similarity of two texts is the sum of the smaller weights over that of the larger ones.

Equal texts are one node. A node's signature holds HASHES samples, each a shingle drawn with a chance in proportion to its weight,
alike for two texts with a chance of their similarity. BANDS bands of ROWS samples make buckets; every member of a bucket
meets the bucket's two leaders (the least node of either half of a hash), pairs with too few equal samples fall away, and the
weighted similarity decides on the rest. Where members of a bucket are still in different groups then, all such pairs of them meet,
in blocks. Groups are the connected components of what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm import words
from terrapanel.llm.common import components, map_texts, slices, stored

WIDTH = 5
SIMILAR = 0.8
HASHES, ROWS = 56, 4
BANDS = HASHES // ROWS
LEAST_EQUAL = 33  # of 56; a pair of similarity 0.8 has fewer with a chance of 1 in 20,000
RARE, SMOOTH = 1000.0, 3 * float(np.log(1000.0))
UNIT = 4096
BUCKET = 500_000  # shingles counted in one task
SLICE = 4_000_000
BLOCK = 500  # members of a bucket that meet another block of it in one task
_48 = np.uint64((1 << 48) - 1)


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, tf): the distinct shingles of every text in ascending order, as 48-bit hashes."""
    doc, h = words.shingles(words.read(texts, lower=True), WIDTH)
    key, tf = np.unique((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)), return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & _48, tf


def _few(texts: list, chars: int):
    """Slices of at most 65,536 texts, for their numbers take 16 bits."""
    for lo, hi in slices(texts, chars):
        for a in range(lo, hi, 65_536):
            yield a, min(hi, a + 65_536)


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, np.ndarray]]:
    """(texts with words, frequent shingles and their document frequencies): those in at least one in RARE texts.

    All shingles of all texts are counted. Tasks send sorted, counted blocks, dealt by ranges of the hash that hold about
    BUCKET shingles each; differences of neighbours take four bytes, or eight where a block has a large one.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-int(chars) // (6 * BUCKET)))
    n = docs.where(F.col("text").rlike(r"\S")).count()
    least = max(2, -(-n // int(RARE)))

    def block(batches):
        schema = pa.schema([("bucket", pa.int32()), ("first", pa.int64()), ("step", pa.binary()), ("count", pa.binary())])
        edges = np.array([(i << 48) // buckets for i in range(1, buckets)], np.uint64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in _few(texts, SLICE):
                _, h, _ = counted(texts[lo:hi])
                h, many = np.unique(h, return_counts=True)
                cuts = np.r_[0, np.searchsorted(h, edges), len(h)]
                rows = {"bucket": [], "first": [], "step": [], "count": []}
                for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if i < j:
                        steps = np.diff(h[i:j])
                        rows["bucket"].append(b)
                        rows["first"].append(int(h[i]))
                        rows["step"].append(steps.astype("<u8" if (steps >> np.uint64(32)).any() else "<u4").tobytes())
                        rows["count"].append(many[i:j].astype("<u4").tobytes())
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    def total(key, table):
        hashes, counts = [], []
        for first, step, count in zip(*(table.column(c).to_pylist() for c in ("first", "step", "count")), strict=True):
            counts.append(np.frombuffer(count, "<u4").astype(np.int64))
            width = len(step) // max(1, len(counts[-1]) - 1) or 4
            hashes.append(np.cumsum(np.r_[np.uint64(first), np.frombuffer(step, f"<u{width}").astype(np.uint64)], dtype=np.uint64))
        h, c = np.concatenate(hashes), np.concatenate(counts)
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        df = np.add.reduceat(c, start)
        keep = df >= least
        return pa.table({"h": pa.array(h[start][keep].astype(np.int64)), "df": pa.array(df[keep])})

    parts = docs.select("text").where("text is not null").mapInArrow(block, "bucket int, first bigint, step binary, count binary")
    rows = parts.groupBy("bucket").applyInArrow(total, "h bigint, df bigint").toPandas().sort_values("h")
    return n, {"h": rows["h"].to_numpy("uint64"), "df": rows["df"].to_numpy("float64")}


def weights(h: np.ndarray, tf: np.ndarray, n: int, frequent: dict[str, np.ndarray]) -> np.ndarray:
    """Weights in multiples of 1/UNIT (1 at least)."""
    idf = np.full(len(h), (SMOOTH + np.log(min(max(n, 1.0), RARE))) / (SMOOTH + np.log(RARE)))
    if len(frequent["h"]):
        at = np.minimum(np.searchsorted(frequent["h"], h), len(frequent["h"]) - 1)
        hit = frequent["h"][at] == h
        idf[hit] = (SMOOTH + np.log(np.minimum(np.maximum(n / frequent["df"][at[hit]], 1.0), RARE))) / (SMOOTH + np.log(RARE))
    return np.maximum(1, np.rint((1 + np.log(tf)) * idf * UNIT)).astype(np.uint32)


class Sampler:
    """Improved consistent weighted sampling with draws from fixed tables.

    For a shingle of weight s and each hash: r and c are Gamma(2, 1), b is uniform; t = floor(ln s / r + b), and the shingle
    with the least ln c - r (t - b + 1) is the sample, together with its t.
    """

    SIZE = 1 << 16

    def __init__(self):
        rng = np.random.default_rng(20)
        self.r = rng.gamma(2, 1, self.SIZE).astype("float32")
        self.b = rng.random(self.SIZE).astype("float32")
        self.c = np.log(rng.gamma(2, 1, self.SIZE)).astype("float32")
        self.odd = rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, h: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
        """One row of 32-bit samples per text; ``start``: where each text's shingles begin."""
        log = np.log(w / np.float32(UNIT)).astype("float32")
        ids = words.mixed(h)
        low = ids & np.uint64(0xFFFFFFFF)
        out = np.empty((len(start), HASHES), np.uint32)
        for j in range(HASHES):
            at = ((ids * self.odd[j]) >> np.uint64(48)).astype(np.int32)
            r, b = self.r[at], self.b[at]
            t = np.floor(log / r + b)
            a = self.c[at] - r * (t - b + np.float32(1))
            bits = a.view(np.int32).astype(np.int64)
            rank = np.where(bits < 0, ~bits & 0xFFFFFFFF, bits | 0x80000000).astype(np.uint64)  # in the order of a
            best = np.minimum.reduceat((rank << np.uint64(32)) | low, start)
            out[:, j] = (words.mixed(best + np.uint64(j)) >> np.uint64(32)).astype(np.uint32)
        return out


_SAMPLER: list[Sampler] = []


def sampler() -> Sampler:
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per text and band, the band's number mixed in."""
    key = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        key = words.mixed(key + signature[:, r::ROWS][:, :BANDS].astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))
    return key.view(np.int64)


def _node(docs: DataFrame) -> DataFrame:
    """(node, doc_id, text): equal texts have one node."""
    return docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")


def signed(docs: DataFrame, n: int, frequent: dict[str, np.ndarray]) -> DataFrame:
    """(node, doc_id, keys, bits): band keys and the last byte of every sample, for each text with words."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # at most RARE times a text's mean number of shingles

    def sign(nodes: list, ids: list, texts: list) -> dict:
        out = {"node": [], "doc_id": [], "keys": [], "bits": []}
        for lo, hi in _few(texts, SLICE):
            doc, h, tf = counted(texts[lo:hi])
            if len(doc):
                start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                s = sampler().signatures(h, weights(h, tf, n, sent.value), start)
                keys, bits = band_keys(s), (s & np.uint32(255)).astype(np.uint8)
                for k, d in enumerate(doc[start].tolist()):
                    out["node"].append(nodes[lo + d])
                    out["doc_id"].append(ids[lo + d])
                    out["keys"].append(keys[k])
                    out["bits"].append(bits[k].tobytes())
        return out

    return map_texts(_node(docs), "node binary, doc_id bigint, keys array<bigint>, bits binary", sign)


def buckets(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, leaders, many) of the buckets with two members or more, and (key, node) of all entries; nodes are (node, keys, bits)."""
    entries = nodes.select("node", F.explode("keys").alias("key"))
    half = F.pmod(F.xxhash64("node"), F.lit(2))
    led = entries.groupBy("key").agg(F.min(F.when(half == 0, F.col("node"))).alias("even"), F.min(F.when(half == 1, F.col("node"))).alias("odd"),
                                     F.max("node").alias("last"), F.count(F.lit(1)).alias("many"))
    led = led.withColumn("leaders", F.array_compact(F.array("even", "odd"))).where((F.size("leaders") > 1) | (F.col("leaders")[0] < F.col("last")))
    return stored(led.select("key", "leaders", "many")), entries


def candidates(nodes: DataFrame, led: DataFrame, entries: DataFrame) -> DataFrame:
    """(a, b): members and leaders of a bucket that share enough samples."""
    pairs = entries.join(led.select("key", "leaders"), "key").select("node", F.explode("leaders").alias("leader")).where("node <> leader")
    pairs = stored(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    side = nodes.select("node", "bits")
    both = pairs.join(side.select(F.col("node").alias("a"), F.col("bits").alias("x")), "a").join(side.select(F.col("node").alias("b"), F.col("bits").alias("y")), "b")

    def alike(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LEAST_EQUAL))

    return both.select("a", "b", "x", "y").mapInArrow(alike, "a binary, b binary")


def weighed(rows: DataFrame, n: int, frequent: dict[str, np.ndarray]) -> DataFrame:
    """(node, h, w): a text's shingles, ascending, as 64-bit numbers, and 32-bit weights, in bytes."""
    sent = rows.sparkSession.sparkContext.broadcast(frequent)

    def weigh(nodes: list, texts: list) -> dict:
        out = {"node": [], "h": [], "w": []}
        for lo, hi in _few(texts, SLICE):
            doc, h, tf = counted(texts[lo:hi])
            w = weights(h, tf, n, sent.value)
            cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
            for k in range(hi - lo):
                own = slice(cuts[k], cuts[k + 1])
                out["node"].append(nodes[lo + k])
                out["h"].append(h[own].astype("<u8").tobytes())
                out["w"].append(w[own].astype("<u4").tobytes())
        return out

    return map_texts(rows.select("node", "text"), "node binary, h binary, w binary", weigh)


def similarity(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """The weighted Jaccard similarity of two texts; 0 if both are without shingles."""
    at = np.searchsorted(h2, h1)
    at[at == len(h2)] = 0
    hit = h2[at] == h1 if len(h2) else np.zeros(len(h1), bool)
    shared = int(np.minimum(w1[hit], w2[at[hit]]).sum(dtype=np.int64)) if len(h2) else 0
    every = int(w1.sum(dtype=np.int64)) + int(w2.sum(dtype=np.int64)) - shared
    return shared / every if every else 0.0


def verified(pairs: DataFrame, vectors: DataFrame, similar: float) -> DataFrame:
    """(a, b, similarity) of the pairs at or above ``similar``."""
    one = vectors.select(F.col("node").alias("a"), F.col("h").alias("h1"), F.col("w").alias("w1"))
    two = vectors.select(F.col("node").alias("b"), F.col("h").alias("h2"), F.col("w").alias("w2"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "h1", "w1", "h2", "w2")

    def check(batches):
        for batch in batches:
            s = [similarity(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u4"), np.frombuffer(x, "<u8"), np.frombuffer(y, "<u4"))
                 for p, q, x, y in zip(*(batch.column(c).to_pylist() for c in ("h1", "w1", "h2", "w2")), strict=True)]
            got = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s, pa.float64())], ["a", "b", "similarity"])
            yield got.filter(pa.array([x >= similar for x in s], pa.bool_()))

    return both.mapInArrow(check, "a binary, b binary, similarity double")


def similarities(h: np.ndarray, w: np.ndarray, hs: list[np.ndarray], ws: list[np.ndarray]) -> np.ndarray:
    """The similarity of one text with each of several; all have shingles."""
    start = np.cumsum([0, *map(len, hs)])[:-1]
    h2, w2 = np.concatenate(hs), np.concatenate(ws)
    at = np.searchsorted(h, h2)
    at[at == len(h)] = 0
    shared = np.add.reduceat(np.where(h[at] == h2, np.minimum(w[at], w2), 0).astype(np.int64), start)
    return shared / (int(w.sum(dtype=np.int64)) + np.add.reduceat(w2.astype(np.int64), start) - shared)


def _meetings(key, table: pa.Table):
    """(i, partners j > i): the pairs of two blocks of a bucket that are in different groups, share enough samples and no earlier bucket."""
    bucket, x, y = (k.as_py() for k in key)
    own = table.column("own").to_numpy()
    root = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(-1, HASHES)
    keys = np.array(table.column("keys").to_pylist(), np.int64)
    for i in range(len(own) - 1):
        j = np.flatnonzero(((bits[i + 1 :] == bits[i]).sum(axis=1) >= LEAST_EQUAL) & (root[i + 1 :] != root[i])) + i + 1
        if x != y:
            j = j[own[j] != own[i]]
        if len(j):
            j = j[keys[i, (keys[j] == keys[i]).argmax(axis=1)] == bucket]
        if len(j):
            yield i, j


def crowded(nodes: DataFrame, led: DataFrame, entries: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, x, y, own, node, root, keys, bits): blocks x and y of buckets and the members that have a partner in them.

    Members are those other than leaders, which have met everyone; partners are in different groups of ``joined`` (node, root).
    """
    rest = entries.join(led.where(F.col("many") - F.size("leaders") > 1).select("key", "leaders"), "key").where(~F.array_contains("leaders", F.col("node")))
    rest = stored(rest.select("key", "node").join(joined, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    split = rest.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("many")).where("least < most")
    split = stored(split.select("key", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = rest.join(split, "key").select("key", "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root")

    def partners(key, table):
        hit = np.zeros(table.num_rows, bool)
        for i, j in _meetings(key, table):
            hit[i] = hit[j] = True
        return table.filter(pa.array(hit))

    rows = placed.join(nodes.select("node", "keys", "bits"), "node").select("key", "x", "y", "own", "node", "root", "keys", "bits")
    return rows.groupBy("key", "x", "y").applyInArrow(partners, rows.schema)


def met(blocks: DataFrame, vectors: DataFrame, similar: float) -> DataFrame:
    """(a, b, similarity): of the pairs in ``blocks`` at or above ``similar``, those that join two groups inside a block."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def check(key, table):
        node, group = (table.column(c).to_pylist() for c in ("node", "root"))
        h = [np.frombuffer(v, "<u8") for v in table.column("h").to_pylist()]
        w = [np.frombuffer(v, "<u4") for v in table.column("w").to_pylist()]
        total = np.array([v.sum(dtype=np.int64) for v in w])
        up = {r: r for r in group}

        def top(r):
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        out = []
        for i, j in _meetings(key, table):
            j = j[np.minimum(total[j], total[i]) >= similar * np.maximum(total[j], total[i])]
            j = [k for k in j.tolist() if top(group[k]) != top(group[i])]
            if j:
                s = similarities(h[i], w[i], [h[k] for k in j], [w[k] for k in j])
                for k, value in zip(j, s.tolist(), strict=True):
                    p, q = top(group[i]), top(group[k])
                    if value >= similar and p != q:
                        up[p] = q
                        out.append({"a": min(node[i], node[k]), "b": max(node[i], node[k]), "similarity": value})
        return pa.Table.from_pylist(out, schema)

    return blocks.join(vectors, "node").groupBy("key", "x", "y").applyInArrow(check, "a binary, b binary, similarity double")


def links(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(a, b, similarity): links between different texts that join the groups; a and b are the MD5 of the texts."""
    n, frequent = document_frequencies(docs)
    nodes = stored(signed(docs, n, frequent))
    nodes = stored(nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("bits").alias("bits")))
    place = F.xxhash64("node", "doc_id").alias("place")  # so that copies of one text lie apart

    def vectors(wanted):
        wanted = stored(wanted.join(nodes.select("node", "doc_id"), "node").select("node", place))
        texts = _node(docs).select("node", place, "text").join(wanted.hint("merge"), ["node", "place"]).dropDuplicates(["node", "place"])
        return stored(weighed(texts, n, frequent))

    led, entries = buckets(nodes)
    pairs = stored(candidates(nodes, led, entries))
    found = stored(verified(pairs, vectors(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), similar))
    blocks = stored(crowded(nodes, led, entries, components(found.select("a", "b"))))
    if blocks.isEmpty():
        return found
    return found.unionByName(met(blocks, vectors(blocks.select("node").distinct()), similar))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(node, root): the group of every text that has a link."""
    return components(stored(links(docs, similar).select("a", "b")))


def group(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, class_size and first for every row: class_id is the least doc_id of the texts linked with this one.

    Equal texts are in one class, and texts without words are in no other; a null text is a class of its own with a null
    class_id and size 1. ``first`` marks the row of every class with the least id. Null ids stay null and rank before all
    others; repeated rows are all members. Texts of fewer than five words are one shingle. Other columns are ignored.
    """
    member, size = _members(docs, similar)
    both = member.join(size, "class", "left")
    return both.select("doc_id", F.col("first.doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
                       F.coalesce((F.col("node") == F.col("first.node")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")), F.lit(True)).alias("first"))


def _members(docs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(class, node, doc_id) of every row and (class, class_size, first) of every class."""
    root = stored(classes(docs, similar))
    rows = stored(docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), F.col("doc_id").cast("bigint").alias("doc_id")))
    member = stored(rows.join(root, "node", "left").select(F.coalesce("root", "node").alias("class"), "node", "doc_id"))
    size = member.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct("doc_id", "node")).alias("first"))
    return member, stored(size)


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that are first in their class, and all with a null text; rows that agree in id and text are kept once."""
    _, size = _members(docs, similar)
    first = size.select(F.col("first.node").alias("node"), F.xxhash64("first.node", "first.doc_id").alias("place"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("node", F.unhex(F.md5(F.col("row.text").cast("binary"))))
    rows = rows.withColumn("place", F.xxhash64("node", F.col("row.doc_id").cast("bigint")))
    kept = rows.join(first, ["node", "place"]).dropDuplicates(["node", "place"]).select("row")
    kept = kept.unionByName(rows.where("row.text is null").select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
