"""Operator 10: toxicity grades by cumulative-link ordinal regression.

Labels say toxic or not. Word beginnings that labelled toxic texts have, or have often, and others don't are the evidence; a toxic text's grade
(1 to 3) follows from its share of evident words, cut at the thirds of all toxic texts, and other texts have grade 0. The
model has one weight per feature and ordered thresholds: P(grade <= g) = 1 / (1 + exp(w x - t_g)).
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import hashed_sample, map_texts, stored

BUCKETS = 1 << 20
FEATURES = 512  # beginnings kept as evidence
SAMPLE = 30_000  # labelled ids the model is fitted on, those with the smallest hashes
GRADES = 3
OFTEN = 0.007  # share of a text's words from which a beginning counts as frequent there, a feature of its own
SHARES = [0.0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05]  # levels of the share of evident words
SCHEMA = "doc_id bigint, severity double, p_toxic double, toxic boolean"
_WORD = re.compile(r"[^\W\d_]+")
KNOWN = 400_000  # words a worker remembers


def beginnings(word: str) -> list[int]:
    """Buckets of the first 4, 5 and 6 characters of a word with an end mark."""
    marked = word + "$"
    return [zlib.crc32(marked[:n].encode()) % BUCKETS for n in (4, 5, 6) if n <= len(marked)] or [zlib.crc32(marked.encode()) % BUCKETS]


@dataclass(frozen=True)
class Model:
    """``place``: feature numbers by 2 * bucket, plus 1 for a frequent beginning; ``weights`` of features and share levels; ascending ``thresholds``."""

    place: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray


class Reader:
    """Finds the evident words of texts; remembers words without evidence."""

    def __init__(self, place: dict[int, int]):
        self.place, self.plain, self.evident = place, set(), {}
        self.buckets = {k // 2 for k in place}

    def read(self, text: str | None) -> tuple[set[int], float]:
        """(features present, share of words that are evidence)."""
        words = _WORD.findall((text or "").lower())
        new = {*words} - self.plain
        if not new:
            return set(), 0.0
        if len(self.plain) > KNOWN:
            self.plain.clear()
        here: dict[str, list[int]] = {}
        for w in new:
            at = self.evident.get(w)
            if at is None:
                at = [b for b in beginnings(w) if b in self.buckets]
                if not at:
                    self.plain.add(w)
                    continue
                if len(self.evident) > KNOWN:
                    self.evident.clear()
                self.evident[w] = at
            here[w] = at
        if not here:
            return set(), 0.0
        told = Counter(w for w in words if w in here)
        count: Counter = Counter()
        for w, c in told.items():
            for b in here[w]:
                count[b] += c
        active = {2 * b for b in count} | {2 * b + 1 for b, c in count.items() if c >= OFTEN * len(words)}
        found = {self.place[k]: k // 2 for k in active if k in self.place}
        buckets = {*found.values()}
        return {*found}, sum(c for w, c in told.items() if not buckets.isdisjoint(here[w])) / len(words)


_READERS: dict[str, Reader] = {}


def reader(key: str, place: dict[int, int]) -> Reader:
    """The worker's reader for a model, made once."""
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(place)
    return _READERS[key]


def _columns(found: set[int], share: float, n: int) -> list[int]:
    return [*found, *(n + k for k, s in enumerate(SHARES) if share > s)]


def evidence(labelled: DataFrame) -> dict[int, int]:
    """The features that mark toxic texts, most telling first."""
    def count(toxic: list, texts: list) -> dict:
        total = np.zeros((2, 2 * BUCKETS), np.int32)
        for y, t in zip(toxic, texts, strict=True):
            words = _WORD.findall((t or "").lower())
            own: Counter = Counter()
            for w, c in Counter(words).items():
                for b in beginnings(w):
                    own[b] += c
            total[int(y), [2 * b for b in own]] += 1
            total[int(y), [2 * b + 1 for b, c in own.items() if c >= OFTEN * len(words)]] += 1
        at = np.flatnonzero(total.any(axis=0))
        return {"bucket": at.astype("int32"), "clean": total[0, at], "toxic": total[1, at]}

    rows = map_texts(labelled.select("toxic", "text"), "bucket int, clean int, toxic int", count)
    n = labelled.agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).first()
    clean, toxic = n[0] or 0, n[1] or 0
    if not clean or not toxic:
        return {}
    sums = stored(rows.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    # far more often in toxic texts, and in so many of them that chance hardly leaves one such feature among all
    least = np.log(10 * max(1, sums.count())) / np.log((toxic + clean) / toxic)
    telling = sums.withColumn("odds", odds).where((F.col("odds") > float(np.log(8.0))) & (F.col("toxic") >= float(least)))
    best = telling.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "bucket").limit(FEATURES).collect()
    return {r.bucket: k for k, r in enumerate(best)}


def _fit(rows: list[list[int]], grade: np.ndarray, n: int, rounds: int = 400, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean log-likelihood; thresholds are a start and positive steps."""
    x = np.zeros((len(rows), n), "float32")
    for i, r in enumerate(rows):
        x[i, r] = 1
    kinds, which = np.unique(np.c_[x, grade], axis=0, return_counts=True)  # equal texts weigh together
    x, grade, many = kinds[:, :-1].astype("float64"), kinds[:, -1].astype(int), which / which.sum()
    z = np.r_[np.zeros(n), 1.0, np.zeros(GRADES - 1)]
    first, second = np.zeros_like(z), np.zeros_like(z)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for step in range(1, rounds + 1):
        w, t = z[:n], np.cumsum(np.r_[z[n], np.exp(z[n + 1 :])])
        below = np.c_[np.zeros(len(x)), sigmoid(t[None, :] - (x @ w)[:, None]), np.ones(len(x))]
        slope = below * (1 - below)
        i = np.arange(len(x))
        p = np.maximum(below[i, grade + 1] - below[i, grade], 1e-12)
        hi, lo = many * slope[i, grade + 1] / p, many * slope[i, grade] / p
        dt = np.zeros(GRADES)
        np.add.at(dt, np.minimum(grade, GRADES - 1), np.where(grade < GRADES, hi, 0))
        np.add.at(dt, np.maximum(grade - 1, 0), np.where(grade > 0, -lo, 0))
        gradient = np.r_[-(hi - lo) @ x - l2 * w, dt.sum(), np.cumsum(dt[::-1])[::-1][1:] * np.exp(z[n + 1 :])]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        z = z + rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return z[:n], np.cumsum(np.r_[z[n], np.exp(z[n + 1 :])])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the texts of at most ``SAMPLE`` labelled ids. Without both kinds of labels: all severities 0."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("key", F.xxhash64("doc_id", F.lit(7)))
    sample = hashed_sample(known, "key", known.count(), SAMPLE).drop("key")
    labelled = stored(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text"))
    place = evidence(labelled)
    if not place:
        return Model({}, np.zeros(len(SHARES)), np.full(GRADES, 40.0))
    sent = docs.sparkSession.sparkContext.broadcast(place)  # at most FEATURES entries

    def read(ids: list, toxic: list, texts: list) -> dict:
        own = Reader(sent.value)
        got = [own.read(t) for t in texts]
        return {"doc_id": ids, "toxic": toxic, "found": [sorted(f) for f, _ in got], "share": [s for _, s in got]}

    sample = map_texts(labelled, "doc_id bigint, toxic int, found array<int>, share double", read).orderBy("doc_id", "share").collect()
    share, toxic = np.array([r.share for r in sample]), np.array([r.toxic for r in sample])
    evident = share[(toxic == 1) & (share > 0)]
    cuts = np.quantile(evident, [i / GRADES for i in range(1, GRADES)]) if len(evident) else np.zeros(GRADES - 1)
    grade = np.where(toxic == 1, 1 + (share[:, None] > cuts[None, :]).sum(axis=1), 0)
    n = len(place)
    weights, thresholds = _fit([_columns(set(r.found), r.share, n) for r in sample], grade, n + len(SHARES))
    return Model(place, weights, thresholds)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic (of grade 1 or more) and toxic (p_toxic of 0.5 or more) of every row.

    Null and empty texts and texts without letters have no evidence. Null ids stay null; repeated rows are graded each;
    other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES entries
    n, key = len(model.place), uuid.uuid4().hex

    def judge(ids: list, texts: list) -> dict:
        m = sent.value
        own, out = reader(key, m.place), []
        for t in texts:
            found, share = own.read(t)
            out.append(m.weights[_columns(found, share, n)].sum())
        above = 1 / (1 + np.exp(np.clip(m.thresholds[None, :] - np.array(out).reshape(-1, 1), -40, 40)))
        return {"doc_id": ids, "severity": above.sum(axis=1), "p_toxic": above[:, 0], "toxic": above[:, 0] >= 0.5}

    return map_texts(docs.select("doc_id", "text"), SCHEMA, judge)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled texts and grade all rows. A document is learned as toxic if one of its labels says so."""
    return grade(docs, fit(docs, labels))
