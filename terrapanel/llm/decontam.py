"""Operator 9: benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from its copy by k = m * share edits. Cut into k + 1 pieces, one piece at least must occur
unchanged in any such copy: an automaton over all pieces finds those places in one pass over a text. A place is then held
against the item: first by halves of the neighbouring pieces, one of which must be there too, then by the number of shared 6-grams that k edits must leave, then by Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import map_texts, stored

SHARE = 0.1  # edits per character of an item
SHORTEST = 20  # normalised characters; shorter items say too little to be looked for
BLOCK_CHARS = 1_000_000  # characters of items in one automaton; more items take more passes over the documents
SCHEMA = "doc_id bigint, item_id bigint, distance int, start int, end int"

_WORD = re.compile(r"[^\W_]+")
GRAM = 6  # characters of the grams that are counted before a distance is computed; budgets leave some of them


def normalise(text: str | None) -> str:
    """Lower case, one space for every run of other characters than letters and digits."""
    return " ".join(_WORD.findall((text or "").lower()))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into budget + 1 nearly equal parts."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def neighbours(parts: list[tuple[int, str]]) -> list[list[tuple[int, int, str]]]:
    """For each piece, halves of the pieces in its group and where each must be, relative to the piece.

    Pieces are grouped in twos, the last three together if their number is odd. As a copy has fewer errors than pieces, some group
    has fewer errors than pieces too, and holds an unspoiled piece; of the halves of its other pieces as many stay as it
    has other pieces, moved by less than the group has pieces.
    """
    count = len(parts)
    out = []
    for i, (offset, _) in enumerate(parts):
        g = min(i // 2, count // 2 - 1) if count > 1 else 0
        first, last = 2 * g, count if g == count // 2 - 1 else 2 * g + 2
        checks = []
        for j in range(first, last):
            if j != i:
                o, piece = parts[j]
                half = len(piece) // 2
                for at, text in ((o, piece[:half]), (o + half, piece[half:])):
                    lo = at - offset - (last - first - 1)
                    checks.append((lo, lo + len(text) + 2 * (last - first - 1), text))
        out.append(checks)
    return out


class Pattern:
    """One item: its budget, its grams and the bit masks of its characters."""

    def __init__(self, ids: list[int], text: str, share: float):
        self.ids, self.text, self.size, self.budget = ids, text, len(text), int(len(text) * share)
        self.grams = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
        self.least = self.size - GRAM + 1 - GRAM * self.budget
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def plausible(self, window: str) -> bool:
        """k edits spoil at most GRAM times k of the item's grams; the others are in the window."""
        if self.least <= 0:
            return True
        grams = self.grams
        return sum([window[i : i + GRAM] in grams for i in range(len(window) - GRAM + 1)]) >= self.least

    def nearest(self, window: str) -> tuple[int, int]:
        """(distance, end) of the first of the nearest substrings of the window."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score, masks = full, 0, self.size, self.masks
        best = (score, 0)
        for at, c in enumerate(window):
            eq = masks.get(c, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
            score += bool(up & top) - bool(down & top)
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (full & ~(vertical | up)), up & vertical
            if score < best[0]:
                best = (score, at + 1)
        return best


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[list[int], str]], share: float):
        import ahocorasick

        self.patterns = [Pattern(ids, text, share) for ids, text in items]
        where = defaultdict(list)
        for n, p in enumerate(self.patterns):
            parts = pieces(p.text, p.budget)
            for (offset, piece), checks in zip(parts, neighbours(parts), strict=True):
                where[piece].append((n, len(piece), offset, checks))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, at)
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best place of every item within its budget, in normalised characters."""
        starts: dict[int, set[int]] = defaultdict(set)
        for end, at in self.automaton.iter(text):
            for n, size, offset, checks in at:
                s = end + 1 - size
                left = len(checks) // 2
                for lo, hi, half in checks:
                    if left and text.find(half, max(0, s + lo), max(0, s + hi)) >= 0:
                        left -= 1
                if not left:
                    starts[n].add(s - offset)
        out = []
        for n, found in starts.items():
            p, best = self.patterns[n], None
            merged: list[list[int]] = []
            for s in sorted(found):
                lo, hi = max(0, s - p.budget), min(len(text), s + p.size + p.budget)
                if merged and lo <= merged[-1][1] - p.size // 2 and hi - merged[-1][0] < 4 * p.size:
                    merged[-1][1] = hi
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                window = text[lo:hi]
                if p.plausible(window):
                    distance, end = p.nearest(window)
                    if distance <= p.budget and (best is None or distance < best[0]):
                        best = (distance, max(0, lo + end - p.size), lo + end)
            if best:
                out += [(i, *best) for i in p.ids]
        return out


_MATCHERS: dict[str, Matcher] = {}


def matcher(key: str, items: list[tuple[list[int], str]], share: float) -> Matcher:
    """The worker's matcher for a block, made once."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, share)
    return _MATCHERS[key]


def _blocks(benchmark: DataFrame, share: float, shortest: int, block_chars: int, with_ids: bool = True) -> Iterator[Broadcast]:
    """Broadcasts of [(ids, normalised text)] with about ``block_chars`` characters each; a text that many rows hold is grouped in Spark first."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    ids = F.collect_set(F.col("item_id").cast("bigint")) if with_ids else F.array(F.min(F.col("item_id").cast("bigint")))
    items = stored(items.groupBy("text").agg(ids.alias("ids")).withColumn("size", F.length("text") + 8 * F.size("ids")))
    blocks = max(1, -(-(items.agg(F.sum("size")).first()[0] or 0) // block_chars))
    for b in range(blocks):
        own = defaultdict(set)
        for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect():
            own[normalise(r.text)].update(r.ids)
        yield benchmark.sparkSession.sparkContext.broadcast([(sorted(i), text) for text, i in sorted(own.items()) if len(text) >= max(1, shortest)])


def hits(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, end: every item that a text holds within its error budget, once per row of ``docs``.

    Texts are compared as lower-case letters and digits with single spaces; start and end are places in that form, start
    being the end less the item's length. Null and empty texts hold nothing; items that are null or shorter than
    ``shortest`` in that form, or have no id, are not looked for; equal items are found together. Null doc_ids stay null, repeated
    rows are searched each, other columns are ignored. The items are sent to the tasks in blocks of bounded size, with a
    pass over the documents for each.
    """
    out = None
    for sent in _blocks(benchmark, share, shortest, block_chars):

        def search(ids: list, texts: list, sent=sent, key=uuid.uuid4().hex) -> dict:
            own = matcher(key, sent.value, share)
            found = [(i, *hit) for i, t in zip(ids, texts, strict=True) if t and own.patterns for hit in own.find(normalise(t))]
            return dict(zip(("doc_id", "item_id", "distance", "start", "end"), zip(*found, strict=True) if found else [[]] * 5, strict=True))

        part = map_texts(docs.select("doc_id", "text"), SCHEMA, search)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item. Every row is judged by its own text, whatever its doc_id; null and empty texts stay."""
    schema = docs.schema
    place = schema.fieldNames().index("text")
    kept = docs
    for sent in _blocks(benchmark, share, SHORTEST, block_chars, with_ids=False):

        def keep(batches, sent=sent, key=uuid.uuid4().hex):
            for batch in batches:
                own = matcher(key, sent.value, share)
                texts = batch.column(place).to_pylist()
                yield batch.filter(pa.array([not (t and own.patterns and own.find(normalise(t))) for t in texts], pa.bool_()))

        kept = kept.mapInArrow(keep, schema)
    return kept
