"""Operator 2: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, seeded by its code point. A 3-gram binds its letters: the elementwise
product of their vectors, the earlier ones rotated further. A text bundles (adds) its 3-gram vectors, a language bundles
its texts, and a text belongs to the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import held_out, map_texts, slices

DIMENSIONS = 512
UNDETERMINED = "und"
LANGUAGES = 10_000  # a guard: more distinct labels than this are no language labels
SLICE = 1_000_000
_SPACE = 32


@dataclass(frozen=True)
class Prototypes:
    """Languages in ascending order and a unit vector for each."""

    languages: list[str]
    vectors: np.ndarray


_LETTER = np.zeros(0, bool)
_VECTORS: dict[int, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def letter_vector(code: int) -> np.ndarray:
    """+1 and -1, drawn from a generator seeded by the code point."""
    if code not in _VECTORS:
        _VECTORS[code] = np.random.default_rng(code).integers(0, 2, DIMENSIONS).astype("float32") * 2 - 1
    return _VECTORS[code]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 3-gram number, letters): the 3-grams over lower-case letters, runs of others being one space.

    ``letters`` are the code points; a 3-gram number is (i * n + j) * n + k for their positions i, j, k and their count n.
    """
    joined = [f" {(t or '').lower()} " for t in texts]
    sizes = np.fromiter((len(t) for t in joined), np.int64, len(joined))
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(joined), dtype=np.int64), sizes)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters
    keep[np.r_[0, np.cumsum(sizes)[:-1]]] = True
    codes, doc = np.where(letter, codes, _SPACE)[keep], doc[keep]
    present = np.zeros(0x110000, bool)
    present[codes] = True
    letters = np.flatnonzero(present)
    place = np.zeros(0x110000, np.int64)
    place[letters] = np.arange(len(letters))
    x, n = place[codes], len(letters)
    gram = (x[:-2] * n + x[1:-1]) * n + x[2:]
    inside = doc[:-2] == doc[2:]
    return doc[:-2][inside], gram[inside], letters


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The bound vectors of 3-gram numbers."""
    table = np.stack([letter_vector(int(c)) for c in letters])
    n = len(letters)
    first, second = np.roll(table, 2, axis=1), np.roll(table, 1, axis=1)
    return first[grams // (n * n)] * second[grams // n % n] * table[grams % n]


def bundles(texts: list[str | None]) -> np.ndarray:
    """The summed 3-gram vectors of every text."""
    doc, gram, letters = trigrams(texts)
    if not len(gram):
        return np.zeros((len(texts), DIMENSIONS), "float32")
    size = len(letters) ** 3
    key, count = np.unique(doc * size + gram, return_counts=True)
    kinds, column = np.unique(key % size, return_inverse=True)
    counts = np.zeros((len(texts), len(kinds)), "float32")
    counts[key // size, column] = count
    return counts @ gram_vectors(kinds, letters)


def fit(docs: DataFrame) -> Prototypes:
    """Prototypes from all rows with text, lang and doc_id that are not held out; every task sends one vector per language.

    Texts add up as they are, so a long text weighs more than a short one.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE):
                doc, gram, letters = trigrams(texts[lo:hi])
                names, which = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                size = len(letters) ** 3
                key, count = _counted(which[doc] * size + gram, len(names) * size)
                vectors = gram_vectors(key % size, letters) * count[:, None]
                for k, name in enumerate(names):
                    own = vectors[key // size == k].sum(axis=0, dtype="float64")
                    sums[name] = sums.get(name, 0) + own
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "at": [list(range(DIMENSIONS))] * len(sums), "v": [v.tolist() for v in sums.values()]},
                                             schema=pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))]))

    parts = known.select("lang", "text").mapInArrow(bundle, "lang string, at array<int>, v array<double>")
    sums = parts.select("lang", F.explode(F.arrays_zip("at", "v")).alias("x")).groupBy("lang", "x.at").agg(F.sum("x.v").alias("v"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("x")).limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} distinct values of lang")
    rows.sort(key=lambda r: r.lang)
    vectors = np.array([[x.v for x in r.x] for r in rows]).reshape(len(rows), DIMENSIONS)
    return Prototypes([r.lang for r in rows], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12))


def _counted(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below ``size`` and their counts."""
    if size <= 16_000_000:
        count = np.bincount(keys, minlength=1)
        found = np.flatnonzero(count)
        return found, count[found]
    return np.unique(keys, return_counts=True)


def predict(docs: DataFrame, prototypes: Prototypes) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, at least 0) of every row.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was learned; a text
    shorter than one 3-gram still has its letters between spaces. Ties go to the first language in ascending order. A null
    doc_id is not held out. Repeated rows are judged each; other columns are ignored.
    """
    made = docs.sparkSession.sparkContext.broadcast((prototypes.languages, prototypes.vectors.astype("float32")))  # languages x 512

    def judge(ids: list, held: list, texts: list) -> dict:
        languages, vectors = made.value
        sums = bundles(texts)
        norm = np.linalg.norm(sums, axis=1)
        letter = [bool(t) and any(c.isalpha() for c in t) for t in texts]
        if not languages:
            return {"doc_id": ids, "held_out": held, "lang_pred": [UNDETERMINED] * len(ids), "score": [0.0] * len(ids)}
        cosine = (sums @ vectors.T) / np.maximum(norm, 1e-12)[:, None]
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(ids)), best], 0, 1)
        return {"doc_id": ids, "held_out": held, "lang_pred": [languages[b] if ok else UNDETERMINED for b, ok in zip(best, letter, strict=True)],
                "score": [float(s) if ok else 0.0 for s, ok in zip(score, letter, strict=True)]}

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text")
    return map_texts(rows, "doc_id bigint, held_out boolean, lang_pred string, score double", judge, chars=SLICE)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and judge all rows."""
    return predict(docs, fit(docs))
