"""Operator 6: line deduplication by prefix doubling over line numbers.

A text is a sequence of line ids. Level 0 names every line by a 128-bit hash; level k + 1 names 2^(k + 1) lines from a position on
by the names, at level k, of its two halves. Suffixes that share 2^k lines share a name: in the suffix array that sorts
by the names of all levels they form an interval with a longest common prefix of at least 2^k. Only names that occur twice go
on to the next level, so the table shrinks to the repeats. Names from the highest level down, one for each binary digit, make up
the length of a suffix's longest match with an earlier suffix, as a descent through the intervals does; the lines of a match are
deleted if they have enough words.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.llm.common import stored

MIN_WORDS = 10
LEVELS = 40  # 2^40 lines are more than a text holds


def _hashed(*cols: Column) -> list[Column]:
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(11), *cols).alias("h2")]


def _keys(docs: DataFrame) -> DataFrame:
    """The documents as (doc_id, tid, text): rows that agree in id and text are one document."""
    return docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("tid"), "text")


def _split(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, pos, h1, h2, words) of every line of every document, once each."""
    keys = _keys(docs)
    split = keys.select("doc_id", "tid", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = F.size(F.filter(F.split("line", r"\s+"), lambda w: w != ""))
    rows = split.select("doc_id", "tid", "pos", *_hashed(F.col("line")), words.cast("bigint").alias("words"))
    twice = keys.groupBy("doc_id", "tid").count().where("count > 1")
    return stored(rows if twice.isEmpty() else rows.dropDuplicates(["doc_id", "tid", "pos"]))


def _levels(lines: DataFrame) -> list[DataFrame]:
    """For each level (doc_id, tid, pos, h1, h2, words, first): the names that occur twice, with the first place of each."""
    document, place = Window.partitionBy("doc_id", "tid").orderBy("pos"), F.struct("doc_id", "tid", "pos")
    level, out, width = lines, [], 1
    for _ in range(LEVELS):
        seen = level.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
        alive = stored(level.join(stored(seen.select("h1", "h2", "first")), ["h1", "h2"]))
        if alive.isEmpty():
            break
        out.append(alive)
        # the next level: a block and the block that follows it, both repeated
        ahead = document.rangeBetween(width, width)
        pairs = alive.select("doc_id", "tid", "pos", "words", "h1", "h2", *[F.max(c).over(ahead).alias(f"{c}_") for c in ("h1", "h2", "words")])
        level = pairs.where("h1_ is not null").select("doc_id", "tid", "pos", *_hashed(*map(F.col, ("h1", "h2", "h1_", "h2_"))), (F.col("words") + F.col("words_")).alias("words"))
        width *= 2
    return out


def longest_matches(lines: DataFrame) -> DataFrame | None:
    """(doc_id, tid, pos, size, words): the length of the longest match of every suffix with an earlier one; None if there is none.

    A suffix starts with its highest name that has an earlier place. Suffixes with one name so far are a class, together with
    that name's first place, which has no match itself but may be the one they share more lines with. At each lower level
    a class is split by the names that follow: the first place of every part stays, for the shorter matches of others with
    it, and takes part in the new class as its first place; the others go on to the new class.
    """
    levels = _levels(lines)
    if not levels:
        return None
    place, state = F.struct("doc_id", "tid", "pos"), None
    copies = [t.where(~F.col("first").eqNullSafe(place)).select("doc_id", "tid", "pos", F.struct(F.lit(k).alias("k"), "h1", "h2", "words", "first").alias("top")) for k, t in enumerate(levels)]
    tops = copies[0]
    for more in copies[1:]:
        tops = tops.unionByName(more)
    tops = stored(tops.groupBy("doc_id", "tid", "pos").agg(F.max("top").alias("top")).select("doc_id", "tid", "pos", "top.*"))
    columns = ["doc_id", "tid", "pos", "size", "words", "c1", "c2", "own"]
    for k in range(len(levels) - 1, -1, -1):
        if state is not None:
            names = levels[k].select(F.col("doc_id").alias("d"), F.col("tid").alias("t"), F.col("pos").alias("p"), F.col("words").alias("more"), "h1", "h2")
            on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")) & (F.col("pos") + F.col("size") == F.col("p"))
            ahead = stored(state.join(names, on, "left").select(*columns, "more", "h1", "h2"))
            part = ["c1", "c2", "h1", "h2"]
            some = ahead.where("h1 is not null")
            firsts = stored(some.groupBy(*part).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select(*part, "first"))
            longer = some.join(firsts, part).withColumn("later", ~F.col("first").eqNullSafe(place))
            into = [h.alias(c) for h, c in zip(_hashed(*map(F.col, part)), ("c1", "c2"), strict=True)]
            grown = (F.col("size") + 2**k).alias("size")
            gone = stored(longer.select("doc_id", "tid", "pos", grown, (F.col("words") + F.col("more")).alias("words"), *into, "own", "later"))
            stay = ahead.join(longer.where("later").select("c1", "c2", F.col("doc_id").alias("d"), F.col("tid").alias("t"), F.col("pos").alias("p")).withColumnsRenamed({"c1": "x1", "c2": "x2"}),
                              (F.col("c1") == F.col("x1")) & (F.col("c2") == F.col("x2")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")) & (F.col("pos") == F.col("p")), "left_anti")
            state = stay.select(*columns).unionByName(gone.select(*columns[:-1], (F.col("own") & F.col("later")).alias("own")))
        new = tops.where(F.col("k") == k)
        size = F.lit(1 << k).cast("bigint").alias("size")
        enter = new.select("doc_id", "tid", "pos", size, "words", F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.lit(True).alias("own"))
        one = new.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.min("words").alias("words"))
        one = one.select("first.*", size, "words", F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.lit(False).alias("own"))
        enter = enter.unionByName(one)
        state = stored(enter if state is None else state.unionByName(enter))
    return state.where("own").select("doc_id", "tid", "pos", "size", "words")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tid, pos): the lines to delete."""
    lines = _split(docs)
    found = longest_matches(lines)
    if found is None:
        return lines.select("doc_id", "tid", "pos").limit(0)
    before = Window.partitionBy("doc_id", "tid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.where(F.col("words") >= min_words).select("doc_id", "tid", "pos", (F.col("pos") + F.col("size") - 1).cast("int").alias("hi"))
    ends = ends.withColumn("lo", F.greatest("pos", F.coalesce(F.max("hi").over(before) + 1, "pos"))).where("lo <= hi")
    return ends.select("doc_id", "tid", F.explode(F.sequence("lo", "hi")).alias("pos"))


def _joined(docs: DataFrame, columns: list[str], min_words: int) -> DataFrame:
    """The ``columns`` of ``docs`` and, last, the places of the lines to delete (null if none)."""
    gone = stored(later_copies(docs, min_words).groupBy("doc_id", "tid").agg(F.collect_list("pos").alias("gone")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tid"))
    gone = gone.select("doc_id", F.col("tid").alias("t"), "gone")
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("tid") == F.col("t")), "left")
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("gone").alias("".join(columns) + "gone"))


def rebuilt(text: str | None, gone: list[int] | None) -> tuple[str | None, int]:
    """(the text without the lines at ``gone``, how many lines it had)."""
    if text is None:
        return None, 0
    lines = text.split("\n")
    if gone:
        drop = {*gone}
        return "\n".join([x for i, x in enumerate(lines) if i not in drop]), len(lines)
    return text, len(lines)


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text, n_lines, n_deleted for every row: the text without the later copies of repeated line runs.

    A run counts if it has ``min_words`` words; the copy in the document with the least id (null first; then by a hash of its
    text), or first within a document, stays. Lines end at newlines; empty lines belong to runs but have no words. A null
    text stays null without lines. Rows that agree in id and text are one document and get the same result each; other
    columns are ignored.
    """
    def run(batches):
        for batch in batches:
            ids, texts, gone = batch.columns
            made = [rebuilt(t, g) for t, g in zip(texts.to_pylist(), gone.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64()), pc.cast(pc.fill_null(pc.list_value_length(gone), 0), pa.int64())],
                ["doc_id", "text", "n_lines", "n_deleted"])

    rows = _joined(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id", "text"], min_words)
    return rows.mapInArrow(run, "doc_id bigint, text string, n_lines bigint, n_deleted bigint")


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with their texts (and n_chars, if there) after deletion; a text of which no word is left goes."""
    columns = docs.columns
    at, count = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches):
        for batch in batches:
            *own, gone = batch.columns
            texts = [rebuilt(t, g)[0] for t, g in zip(own[at].to_pylist(), gone.to_pylist(), strict=True)]
            touched = [g is not None for g in gone.to_pylist()]
            if count is not None:
                sizes = [len(t) if hit else n for t, hit, n in zip(texts, touched, own[count].to_pylist(), strict=True)]
                own[count] = pa.array(sizes, own[count].type)
            own[at] = pa.array(texts, pa.string())
            keep = pa.array([not hit or bool(t.strip()) for t, hit in zip(texts, touched, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(own, columns).filter(keep)

    return _joined(docs, columns, min_words).mapInArrow(run, docs.schema)
