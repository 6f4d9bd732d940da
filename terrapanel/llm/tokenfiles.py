"""Operator 13: token ids of documents in ORC files.

Documents are dealt by ranges of doc_id, so file k holds smaller ids than file k + 1 and rows ascend in a file. ORC stores the
ids with its integer run-length encoding; min-max row indexes and Bloom filters on doc_id let a lookup skip stripes and row
groups. Every row says how many ids come before it in its file, so stripes can be read by different tasks in any order.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm.common import slices

SCHEMA = "part int, first bigint, doc_id bigint, n_tokens bigint, ids array<int>"
SLICE = 500_000  # characters encoded at a time
CACHED = 16_000_000  # characters of pre-tokens that a worker keeps
CONTROLS = "\x1c\x1d\x1e\x1f"
LONG = 64  # longer pre-tokens are not kept
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(2**26), "compression": "lz4"}


def unsettled() -> re.Pattern:
    """Characters that two regular expression engines may class differently: those beyond the first plane or not assigned in Unicode 3.2
    (newer tables differ between versions), numbers that aren't digits, and four control characters that only some take as spaces."""
    unsure = {"Cn", "Nl", "No"}
    new = [c for c in range(0x10000) if {unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))} & unsure or 0x1C <= c < 0x20]
    ranges = []
    for c in new:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "\U00010000-\U0010ffff]")


#: The classes of the split pattern as Python's own engine names them, equal for settled characters.
CLASSES = {r" ?[^\s\p{L}\p{N}]+": r" ?(?:[^\s\w]|_)+", r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d"}


class Encoder:
    """One worker's tokenizer. Pre-tokens are encoded by the library once each and remembered; a text that holds an added
    token or an unsettled character, and every text under a tokenizer of another kind, is encoded whole by the library."""

    def __init__(self, definition: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        made = json.loads(definition)
        before = made.get("pre_tokenizer") or {}
        self.split = (before.get("type"), before.get("use_regex", True), before.get("add_prefix_space")) == ("ByteLevel", True, False) and not any(
            made.get(k) for k in ("normalizer", "truncation", "padding"))
        for theirs, ours in CLASSES.items():
            pattern = pattern.replace(theirs, ours)
        self.find = re.compile(pattern).findall
        self.odd = unsettled()
        self.added = [x["content"] for x in made.get("added_tokens") or []]
        self.known: dict[str, bytes] = {}  # of two generations, the older is given up when the newer is full
        self.older: dict[str, bytes] = {}
        self.size = 0

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens by the library. Words with a space in front stay apart when they are put together, so they are one call."""
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        made = self.tokenizer.encode("".join(words), add_special_tokens=False)
        ids, word = array("I", made.ids).tobytes(), np.asarray(made.word_ids, np.int32)
        ends = [0, *(np.flatnonzero(word[1:] != word[:-1]) + 1).tolist(), len(word)] if words else [0]
        coded = {w: ids[4 * a : 4 * b] for w, a, b in zip(words, ends[:-1], ends[1:], strict=True)}
        others = [p for p in pieces if p not in coded]
        coded.update((p, array("I", e.ids).tobytes()) for p, e in zip(others, self.tokenizer.encode_batch(others, add_special_tokens=False), strict=True))
        return coded

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        unsure = any(c in text for c in CONTROLS) if text.isascii() else self.odd.search(text)
        if not self.split or unsure or any(a in text for a in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = self.find(text)
        out = list(map(self.known.get, parts))
        if None in out:
            at = [i for i, c in enumerate(out) if c is None]
            new = {parts[i] for i in at}
            coded = {p: self.older[p] for p in new if p in self.older}
            coded.update(self.learn([p for p in new if p not in coded]))
            for i in at:
                out[i] = coded[parts[i]]
            keep = {p: c for p, c in coded.items() if len(p) <= LONG}
            size = sum(map(len, keep))
            if self.size + size > CACHED // 2:
                self.older, self.known, self.size = self.known, {}, 0
            if size <= CACHED // 2:
                self.known.update(keep)
                self.size += size
        return b"".join(out)


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str, pattern: str) -> Encoder:
    """The worker's encoder for a definition, made once."""
    key = hash((definition, pattern))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition, pattern)
    return _ENCODERS[key]


def write(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int) -> None:
    """Encode every whole text, append ``end_id`` and write the ids to ORC files under ``path`` in ascending doc_id order.

    A null text counts as empty (the end id alone). Null ids come first. Rows with the same doc_id are written each, in order of a
    hash of their text; a doc_id that many rows share is dealt over several files. Texts of any length are encoded whole; memory in a task
    is bounded by one Arrow batch and one slice (or one document, where that is longer). An empty table gives files without
    rows. Other columns are ignored. The vocabulary is read on the driver and sent to the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        made = docs.sparkSession.sparkContext.broadcast(f.read())  # 1 to 2 MB: the vocabulary's size, not the data's
    end = np.asarray([end_id], "<u4").tobytes()
    names = ["part", "first", "doc_id", "n_tokens", "ids"]

    def encode(batches):
        own, part, before = encoder(made.value, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE):
                coded = [own.encode(t or "") + end for t in texts[lo:hi]]
                sizes = np.asarray([len(c) // 4 for c in coded], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, part, np.int32)), pa.array(before + offsets[:-1]), batch.column(0).slice(lo, hi - lo), pa.array(sizes), ids], names=names)
                before += int(offsets[-1])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("salt"))
    keys = [F.col("doc_id").asc_nulls_first(), "tie", "salt"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    dealt.mapInArrow(encode, SCHEMA).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids from the files of ``write``.

    ``where`` on doc_id reaches the scan, which skips stripes by their least and greatest id and row groups by Bloom filter. The driver
    sees one number per file, from a scan of two columns.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    sizes = sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum("n_tokens")).collect())
    first = accumulate((n for _, n in sizes), initial=0)
    offsets = spark.createDataFrame([(p, f) for (p, _), f in zip(sizes, first, strict=False)], "part int, before bigint")
    kept = rows if where is None else rows.where(where)
    return kept.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """The rows of ``read`` for a few ids."""
    return read(spark, path, F.col("doc_id").isin([*doc_ids]))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of the rows of ``read``."""

    def crc(batches):
        for batch in batches:
            ids = batch.column(2)
            offsets, values = np.asarray(ids.offsets), np.asarray(ids.values, "<i4")
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
