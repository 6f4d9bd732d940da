"""Operator 8: quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of vote patterns of all
documents estimates how often each labeller is right in either class; the posterior of its votes is a text's soft label. A
linear scorer on hashed features (shapes of words, and repetition) learns from soft labels and scores every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm import words
from terrapanel.llm.common import hashed_sample, map_texts, slices, stored

BUCKETS = 4096
SAMPLE = 20_000  # texts the scorer is fitted on, those with the smallest hashes of id and text; the labellers' accuracies use all
WORDS = 8  # texts with fewer words get no vote
SCHEMA = "doc_id bigint, score double, keep boolean"
GOOD, BAD, NONE = 1, 0, 2
#: Measure, good up to, bad from: between the two there is no vote.
LABELLERS = [
    ("marks", 0.02, 0.08), ("capitals", 0.25, 0.5), ("repeats", 0.02, 0.15), ("known_trigrams", 0.3, 0.6),
    ("mark_runs", 0.02, 0.2), ("bare_marks", 0.05, 0.2), ("top_word", 0.2, 0.4),
]


#: Classes of characters: white space, letters, digits and plain punctuation; every other mark is 8 to 15 by its code.
SPACE, LOWER, UPPER, DIGIT, STOP, CALL, PLAIN, FIRST_MARK = 0, 1, 2, 3, 4, 5, 6, 8
_CLASSES = np.zeros(0, np.uint8)


def classes() -> np.ndarray:
    """The class of every code point."""
    global _CLASSES
    if not len(_CLASSES):
        def of(c: str) -> int:
            if c.isspace():
                return SPACE
            if c.isalpha():
                return UPPER if c.isupper() else LOWER
            if c.isdigit():
                return DIGIT
            return STOP if c in ".," else CALL if c in "!?" else PLAIN if c in ";:'\"()-" else FIRST_MARK + ord(c) % 8
        _CLASSES = np.fromiter((of(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)
    return _CLASSES


def _per_doc(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, value, n)


def _pairs(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, most frequent key's count) per document."""
    mixed_key = (doc.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20))
    kinds, count = np.unique(mixed_key, return_counts=True)
    of = (kinds >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, of, count)
    return np.bincount(of, minlength=n), top


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(votes per text, words per text, then text, bucket and value of every feature); values of a text have unit length.

    A word's shape is the set of its character classes with its first and last; measures are shares of words or characters.
    """
    n = len(texts)
    w = words.read(texts)
    size = np.bincount(w.doc, minlength=n)
    if not len(w.doc):
        none = np.zeros(0, np.int64)
        return np.full((n, len(LABELLERS)), NONE), size, none, none, np.zeros(0)
    cls = classes()[w.codes]
    inside = cls > 0
    kept, per_word = cls[inside], w.end - w.start
    first = np.cumsum(per_word) - per_word
    mask = np.bitwise_or.reduceat(np.uint16(1) << kept.astype(np.uint16), first)
    of = lambda what: _per_doc(w.doc, np.add.reduceat(what.astype(np.int64), first), n)
    capitals, letters, marks = of(kept == UPPER), of((kept == LOWER) | (kept == UPPER)), of(kept >= FIRST_MARK)
    last, before = cls[w.end - 1], np.where(per_word > 1, cls[w.end - 2], LOWER)
    run = (last > DIGIT) & (before > DIGIT)
    bare = (mask & 0b1110) == 0
    same = np.r_[False, (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])]
    _, top = _pairs(w.doc, w.hash, n)
    three = words.mixed((w.hash[:-2] * np.uint64(3) + w.hash[1:-1]) * np.uint64(5) + w.hash[2:])
    whole = w.doc[:-2] == w.doc[2:]
    kinds, _ = _pairs(w.doc[:-2][whole], three[whole], n)
    count, characters = np.maximum(size, 1), np.maximum(_per_doc(w.doc, per_word, n), 1)
    m = {
        "marks": marks / characters, "capitals": capitals / np.maximum(letters, 1), "repeats": _per_doc(w.doc, same, n) / np.maximum(size - 1, 1),
        "known_trigrams": np.where(size > 2, 1 - kinds / np.maximum(size - 2, 1), 0), "mark_runs": _per_doc(w.doc, run, n) / count,
        "bare_marks": _per_doc(w.doc, bare, n) / count, "top_word": top / count,
    }
    votes = np.stack([np.where(m[k] <= good, GOOD, np.where(m[k] >= bad, BAD, NONE)) for k, good, bad in LABELLERS], axis=1)
    enough = size >= WORDS
    votes[~enough] = NONE
    look = (mask.astype(np.uint64) * np.uint64(256) + cls[w.start] * np.uint64(16) + last) * np.uint64(4) + np.minimum(per_word, 3).astype(np.uint64)
    bucket = (words.mixed(look) % np.uint64(BUCKETS)).astype(np.int64)
    key, c = np.unique(w.doc * BUCKETS + bucket, return_counts=True)
    doc, bucket = key // BUCKETS, key % BUCKETS
    value = np.sqrt(c / size[doc])
    held = np.flatnonzero(enough)
    for k, name in enumerate(("repeats", "known_trigrams", "top_word")):
        level = np.minimum(m[name][held] * 10, 9).astype(np.uint64) + np.uint64(100 * k + 10**9)
        doc, bucket = np.r_[doc, held], np.r_[bucket, (words.mixed(level) % np.uint64(BUCKETS)).astype(np.int64)]
        value = np.r_[value, np.ones(len(held))]
    norm = np.sqrt(np.bincount(doc, value**2, n))
    order = np.argsort(doc, kind="stable")
    return votes, size, doc[order], bucket[order], (value / norm[doc])[order]


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(share of good texts, P(vote | class) as labeller x class x vote) by expectation-maximisation, smoothed by one vote each.

    It starts from the majority of a pattern's votes, so class 1 stays the class for which the votes say good.
    """
    good = ((patterns == GOOD).sum(axis=1) + 1.0) / ((patterns != NONE).sum(axis=1) + 2.0)
    prior, table = 0.5, np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        for c, p in ((0, 1 - good), (1, good)):
            for j in range(patterns.shape[1]):
                table[j, c] = np.bincount(patterns[:, j], counts * p, 3) + 1
        table /= table.sum(axis=2, keepdims=True)
        prior = min(max(float((counts * good).sum() / counts.sum()), 1e-3), 1 - 1e-3)
        new = posterior(patterns, prior, table)
        moved, good = np.abs(new - good).max(), new
        if moved < 1e-9:
            break
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """P(good | votes), the labellers taken as independent; a labeller that is often wrong counts for little."""
    j = np.arange(patterns.shape[1])
    log = np.log(table[j, 1, patterns]) - np.log(table[j, 0, patterns])
    return 1 / (1 + np.exp(-np.clip(log.sum(axis=1) + np.log(prior / (1 - prior)), -30, 30)))


def _fit(rows: list, target: np.ndarray, rounds: int = 300, rate: float = 0.5, l2: float = 1e-6) -> np.ndarray:
    """Weights and, last, the intercept of a logistic scorer, by Adam; the two classes weigh alike."""
    doc = np.repeat(np.arange(len(rows)), [len(r.buckets) for r in rows])
    col = np.fromiter((b for r in rows for b in r.buckets), np.int64)
    val = np.fromiter((v for r in rows for v in r.values), np.float64)
    good = target.sum()
    weight = target / max(good, 1e-9) + (1 - target) / max(len(rows) - good, 1e-9)
    w, first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, rounds + 1):
        margin = np.bincount(doc, val * w[col], len(rows)) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target)
        g = np.r_[np.bincount(col, val * error[doc], BUCKETS), error.sum()] + l2 * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def fit(docs: DataFrame) -> np.ndarray:
    """The scorer's weights; all zero with a positive intercept if no text has a vote."""
    def describe_all(key: list, texts: list) -> dict:
        votes, _, doc, bucket, value = describe(texts)
        cuts = np.searchsorted(doc, np.arange(1, len(texts)))
        return {"key": key, "votes": ["".join(map(str, v)) for v in votes], "buckets": np.split(bucket.astype("int32"), cuts),
                "values": np.split(value.astype("float32"), cuts)}

    rows = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("key"), "text")
    rows = stored(map_texts(rows, "key bigint, votes string, buckets array<int>, values array<float>", describe_all))
    silent = str(NONE) * len(LABELLERS)
    patterns = rows.where(F.col("votes") != silent).groupBy("votes").count().collect()  # at most 3 to the number of labellers
    if not patterns:
        return np.r_[np.zeros(BUCKETS), 1.0]
    codes = np.array([[int(c) for c in r.votes] for r in patterns])
    prior, table = accuracies(codes, np.array([r["count"] for r in patterns], float))
    label = dict(zip((r.votes for r in patterns), posterior(codes, prior, table).tolist(), strict=True))
    voted = sum(r["count"] for r in patterns)
    sample = sorted(hashed_sample(rows.where(F.col("votes") != silent), "key", voted, SAMPLE).collect(), key=lambda r: (r.key, r.votes))
    return _fit(sample, np.array([label[r.votes] for r in sample]))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (0 to 1) and keep (a score of 0.5 or more) of every row.

    Texts of fewer than 8 words and null texts have too little to be judged and are kept with score 0.5. Null ids stay
    null; repeated rows are scored each; other columns are ignored.
    """
    return map_texts(docs.select("doc_id", "text"), SCHEMA, _scorer(docs, weights))


def _scorer(docs: DataFrame, weights: np.ndarray):
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 4,097 numbers

    def judge(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "score": (s := scores(texts, sent.value)), "keep": s >= 0.5}

    return judge


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    _, size, doc, bucket, value = describe(texts)
    margin = np.bincount(doc, value * weights[bucket], len(texts)) + weights[-1]
    return np.where(size < WORDS, 0.5, 1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def classify(docs: DataFrame) -> DataFrame:
    """Fit on the texts themselves and score every row."""
    return score(docs, fit(docs))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text the scorer keeps, unchanged."""
    weights = fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def select(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for lo, hi in slices(texts, 2_000_000):
                yield batch.slice(lo, hi - lo).filter(pa.array(scores(texts[lo:hi], sent.value) >= 0.5))

    return docs.mapInArrow(select, docs.schema)
