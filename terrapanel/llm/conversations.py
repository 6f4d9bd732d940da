"""Operator 12: repair of the structure of conversations.

A repaired conversation has the roles of (system? (user assistant)+)? The cheapest edits are a shortest path over four states
(nothing yet, after a system, user or assistant row), read row by row. Rows are sorted by range over the whole table and each
conversation is cut into chunks, so a conversation of any length is worked on by many tasks. Every chunk computes the costs at its
start from a speculative cost vector at its end; fix-up passes rerun the chunks whose follower found other costs, until vectors
differ only by constants. Chunks that still wait then (roles under which no choice is ever forgotten) are finished by min-plus
matrices and pointer doubling. With the stitched backward costs every chunk traces the least audit from each state it may be
entered in; the states are stitched from the front.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terrapanel.llm.common import stored

CHUNK_BITS = 14  # a chunk has 2^14 rows at most
PASSES = 4
INF = 2**40
SPACES = " \t\n\x0b\f\r"
S, U, A, OTHER = range(4)  # classes of a role's initial; a code is class + 4 * fault
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
END = [0, 4, 2, 0]  # costs after the last row, insertions included
INSERT = [2, 2, 3, 2]  # the state after an inserted row
KEEP = [[1, 2, None, None], [None, 2, None, None], [None, None, 3, None], [None, 2, None, None]]  # [state][class]
ROLE = {2: "user", 3: "assistant"}


def before(code: int, v: list[int]) -> list[int]:
    """Costs before a row from those after it, insertions in front of the row included."""
    kind, fault = code & 3, code >> 2
    a, b, c, d = v
    if fault in (BLANK, DUPLICATE):
        return [a + 3, b + 3, c + 3, d + 3]
    t = int(fault == TRUNCATED)
    a, b, c, d = min(a + 3, c + 2 + t), min(b + 3, c + 2 + t), min(c + 3, d + 2 + t), min(d + 3, c + 2 + t)
    if kind == S:
        a = min(a, v[1] + t)
    elif kind == U:
        a, b, d = min(a, v[2] + t), min(b, v[2] + t), min(d, v[2] + t)
    elif kind == A:
        c = min(c, v[3] + t)
    c, d = min(c, d + 2), min(d, c + 2)
    return [min(a, c + 2), min(b, c + 2), c, d]


def relative(v: list[int]) -> list[int]:
    low = min(v)
    return [min(x - low, INF) for x in v]


def start_costs(codes: list[int], v: list[int]) -> list[int]:
    for code in reversed(codes):
        v = before(code, v)
    return relative(v)


def redone(codes: list[int], old: list[int], new: list[int], found: list[int]) -> list[int]:
    """Costs at the start for another vector at the end; ends as soon as both runs differ only by a constant."""
    for code in reversed(codes):
        old, new = before(code, old), before(code, new)
        if len({x - y for x, y in zip(old, new, strict=True)}) == 1:
            return found
    return relative(new)


def trace(codes: list[int], end: list[int], state: int, last: bool) -> tuple[str, int, int]:
    """(audit, state after it, cost) of the least of the cheapest edits from ``state``, given the costs after the chunk."""
    costs = [end]
    for code in reversed(codes):
        costs.append(before(code, costs[-1]))
    costs.reverse()
    out, cost, i = [], 0, 0
    while i < len(codes):
        kind, fault = codes[i] & 3, codes[i] >> 2
        here, after, t = costs[i], costs[i + 1], int(fault == TRUNCATED)
        keep = KEEP[state][kind]
        if after[state] + 3 == here[state]:
            step, spent, to, i = "D", 3, state, i + 1
        elif here[INSERT[state]] + 2 == here[state]:
            step, spent, to = "I", 2, INSERT[state]
        elif keep is not None and after[keep] + t == here[state]:
            step, spent, to, i = "K", t, keep, i + 1
        else:
            step, spent, to, i = "R", 2 + t, INSERT[state], i + 1
        out.append(step)
        cost, state = cost + spent, to
    while last and state in (1, 2):
        out.append("I")
        cost, state = cost + 2, INSERT[state]
    return "".join(out), state, cost


def edits(codes: list[int], audit: str, state: int) -> Iterator[tuple[int, int, str, str | None]]:
    """(row, order within the row, edit, new role) of every edit; insertions at the very end belong to the last row."""
    i = order = 0
    for step in audit:
        if step == "I":
            state = INSERT[state]
            yield (i, order, step, ROLE[state]) if i < len(codes) else (len(codes) - 1, order + 1, step, ROLE[state])
            order += 1
            continue
        if step == "K":
            state = KEEP[state][codes[i] & 3]
        elif step == "R":
            state = INSERT[state]
        yield i, order, step, ROLE[state] if step == "R" else None
        i += 1
        order = 0 if i < len(codes) else order


def _map(df: DataFrame, schema: str, fn: Callable[..., Iterator[tuple]]) -> DataFrame:
    """``fn`` gets the values of a row and gives tuples of ``schema``."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            out = [x for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in fn(*row)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _product(a: str, b: str, wide: int) -> Column:
    """The min-plus product of a 4 x 4 matrix (rows after each other) with another or with a vector, relative to its least entry."""
    def cell(i, j):
        return F.least(*[F.col(a)[4 * i + k] + F.col(b)[wide * k + j] for k in range(4)])

    made = F.array(*[cell(i, j) for i in range(4) for j in range(wide)])
    return F.transform(made, lambda x: F.least(x - F.array_min(made), F.lit(INF)))


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos, and marks of the text): ``pos`` ascends by conversation and turn over the whole table.

    A null role or text is a space; null turns come first. Rows with the same turn go by role, first 200 characters and a hash of the text.
    Sorting is by range, so the turns of one conversation, and copies of one row, are dealt over many tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(" "))
    made = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"))
    made = made.select("*", F.substring("text", 1, 200).alias("head"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("salt"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "tie", "salt"]
    sorted_rows = made.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ends = F.rtrim(F.col("text"), F.lit(SPACES))
    return stored(sorted_rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"), F.unhex(F.sha2("text", 256)).alias("digest"),
                                     (ends == "").alias("blank"), (~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("open")))


def chunked(rows: DataFrame, bits: int) -> DataFrame:
    """(conv_id, first, codes, next, prev): the rows of a conversation in chunks, ``first`` being the position of the first row.

    A row is a duplicate if it is not the first of its conversation, role and text: first positions are unique, so joining
    them back meets no frequent key.
    """
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    firsts = rows.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("original"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("original").isNull(), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(SOUND)
    coded = rows.select("conv_id", "pos", kind.alias("kind"), "blank", "open").join(firsts, "pos", "left").select("conv_id", "pos", (F.col("kind") + 4 * fault).alias("code"))
    packs = coded.groupBy("conv_id", F.shiftright("pos", bits).alias("pack")).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("c"))
    chunks = stored(packs.select("conv_id", F.col("c")[0]["pos"].alias("first"), F.transform("c", lambda x: x["code"]).alias("codes")))
    line = "conv_id ORDER BY first"  # a row per chunk
    return stored(chunks.select("*", F.expr(f"lead(first) OVER (PARTITION BY {line})").alias("next"), F.expr(f"lag(first) OVER (PARTITION BY {line})").alias("prev")))


def end_costs(many: DataFrame) -> DataFrame:
    """(first, end): the costs after each chunk, up to a constant, of the conversations with several chunks."""
    schema = "first bigint, next bigint, codes array<int>, end array<bigint>, start array<bigint>"

    def speculate(first, link, codes):
        end = END if link is None else [0, 0, 0, 0]
        yield first, link, codes, end, start_costs(codes, end)

    state = stored(_map(many.select("first", "next", "codes"), schema, speculate))
    for _ in range(PASSES):
        follower = state.select(F.col("first").alias("next"), F.col("start").alias("new"))
        moved = stored(state.join(follower, "next").where("end <> new"))
        if moved.isEmpty():
            return state.select("first", "end")
        again = _map(moved.select("first", "codes", "end", "new", "start"), "first bigint, e array<bigint>, s array<bigint>",
                     lambda first, codes, old, new, found: [(first, new, redone(codes, old, new, found))])
        state = stored(state.join(again, "first", "left").select("first", "next", "codes", F.coalesce("e", "end").alias("end"), F.coalesce("s", "start").alias("start")))

    def matrix(first, link, codes):
        columns = []
        for k in range(4):
            v = [INF] * 4
            v[k] = 0
            for code in reversed(codes):
                v = before(code, v)
            columns.append(v)
        low = min(map(min, columns))
        yield first, link, [min(columns[k][i] - low, INF) for i in range(4) for k in range(4)], start_costs(codes, END) if link is None else None

    nodes = stored(_map(state.select("first", "next", "codes"), "first bigint, link bigint, m array<bigint>, v array<bigint>", matrix))
    while not nodes.where("v is null").isEmpty():
        far = nodes.select(F.col("first").alias("link"), F.col("link").alias("on"), F.col("m").alias("m2"), F.col("v").alias("v2"))
        both = nodes.where("v is null").join(far, "link").select(
            "first", F.when(F.col("v2").isNull(), F.col("on")).alias("link"), F.when(F.col("v2").isNull(), _product("m", "m2", 4)).otherwise(F.col("m")).alias("m"),
            F.when(F.col("v2").isNotNull(), _product("m", "v2", 1)).alias("v"))
        nodes = stored(nodes.where("v is not null").unionByName(both))
    follower = nodes.select(F.col("first").alias("next"), F.col("v").alias("new"))
    return state.join(follower, "next", "left").select("first", F.coalesce("new", "end").alias("end"))


def entry_states(traces: DataFrame) -> DataFrame:
    """(first, entry): the state each chunk is entered in, from the exits of the chunk before it per entry (pointer doubling)."""
    exits = traces.select(F.col("first").alias("prev"), F.col("exits").alias("go"))
    nodes = traces.select("first", "prev").join(exits, "prev", "left")
    same = F.size(F.array_distinct("go")) == 1
    nodes = stored(nodes.select("first", F.when(~same, F.col("prev")).alias("link"), "go", F.when(F.col("prev").isNull(), 0).when(same, F.col("go")[0]).alias("entry")))
    while not nodes.where("entry is null").isEmpty():
        far = nodes.select(F.col("first").alias("link"), F.col("link").alias("on"), F.col("go").alias("go2"), F.col("entry").alias("entry2"))
        both = nodes.where("entry is null").join(far, "link").select(
            "first", F.when(F.col("entry2").isNull(), F.col("on")).alias("link"), F.when(F.col("entry2").isNull(), F.transform("go2", lambda s: F.col("go")[s])).otherwise(F.col("go")).alias("go"),
            F.when(F.col("entry2").isNotNull(), F.col("go")[F.col("entry2")]).alias("entry"))
        nodes = stored(nodes.where("entry is not null").unionByName(both))
    return nodes.select("first", "entry")


def repair(conversations: DataFrame, bits: int = CHUNK_BITS) -> tuple[DataFrame, DataFrame]:
    """The repaired rows and a summary per conversation of (conv_id, turn, role, text).

    Rows: conv_id, pos and sub (their order), edit (K keep, R new role, D delete, I insert), role, text; deleted rows are there
    with edit D. Summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    Null roles and texts are a space; rows with a null conv_id are one conversation; null turns come first and don't count for gaps. Rows with the same
    turn are ordered as ``ordered`` says; repeated rows are duplicates. Texts of any length are read whole. gaps is null where turns
    are farther apart than a long. An empty table gives no rows. Other columns are ignored. An audit is one string, so a
    conversation has fewer than 2^31 edits.
    """
    rows = ordered(conversations)
    chunks = chunked(rows, bits)
    alone = chunks.where("next is null and prev is null").withColumn("end", F.lit(END).cast("array<bigint>"))
    many = chunks.where("next is not null or prev is not null")
    ends = end_costs(many) if not many.isEmpty() else None
    ready = alone if ends is None else alone.unionByName(many.join(ends, "first"))

    def traced(conv, first, codes, link, back, end):
        found = [trace(codes, end, s, link is None) for s in ([0] if back is None else range(4))]
        kinds, faults = [c & 3 for c in codes], [c >> 2 for c in codes]
        illegal = sum((a, b) not in ((S, U), (U, A), (A, U)) for a, b in zip(kinds, kinds[1:]))
        yield (conv, first, codes, link, back, [x[0] for x in found], [x[1] for x in found], [x[2] for x in found], *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal)

    counts = ["blank", "duplicate", "truncated", "illegal"]
    schema = "conv_id bigint, first bigint, codes array<int>, next bigint, prev bigint, audits array<string>, exits array<int>, costs array<bigint>, " + ", ".join(f"{c} bigint" for c in counts)
    traces = stored(_map(ready.select("conv_id", "first", "codes", "next", "prev", "end"), schema, traced))
    joined = traces.where("prev is null").withColumn("entry", F.lit(0))
    if ends is not None:
        linked = traces.where("next is not null or prev is not null")
        last = linked.select(F.col("first").alias("prev"), (F.element_at("codes", -1) % 4).alias("kind"))
        pair = F.array("kind", F.col("codes")[0] % 4)
        apart = linked.join(last, "prev").select("first", (~F.coalesce(F.array_contains(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((S, U), (U, A), (A, U))]), pair), F.lit(False))).cast("bigint").alias("more"))
        later = traces.where("prev is not null").join(entry_states(linked), "first").join(apart, "first").withColumn("illegal", F.col("illegal") + F.col("more")).drop("more")
        joined = joined.unionByName(later)
    entry = F.col("entry")
    chosen = stored(joined.select("conv_id", "first", "codes", "entry", F.col("audits")[entry].alias("audit"), F.col("costs")[entry].alias("cost"), *counts))

    steps = _map(chosen.select("first", "codes", "audit", "entry"), "pos bigint, sub int, edit string, new string",
                 lambda first, codes, audit, state: ((first + i, k, e, r) for i, k, e, r in edits(codes, audit, state)))
    fixed = rows.select("conv_id", "pos", "role", "text").join(steps, "pos").select(
        "conv_id", "pos", "sub", "edit", F.coalesce("new", "role").alias("role"), F.when(F.col("edit") == "I", F.lit("")).otherwise(F.col("text")).alias("text"))

    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count("turn").alias("n"))
    turns = turns.select("conv_id", F.when(F.col("n") == 0, 0).otherwise(F.try_add(F.try_subtract("b", "a"), 1 - F.col("n"))).cast("bigint").alias("gaps"))
    parts = chosen.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in [*counts, "cost"]], F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    return fixed, together(turns, parts)


def together(*tables: DataFrame) -> DataFrame:
    """One row per conv_id, null included, of tables that each have a row per conv_id at most."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    return union.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in union.columns if c != "conv_id"])


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the digest of the ``role:text`` lines that are left, fed to it one after another.

    A digest is sequential, so a conversation is read by one task; only the running digest and one Arrow batch are held.
    """
    lines = repaired.where("edit <> 'D'").select("conv_id", "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def feed(batches):
        own, digest = None, None
        for batch in batches:
            ids, out = [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or conv != own:
                    if digest is not None:
                        ids.append(own)
                        out.append(digest.hexdigest())
                    own, digest = conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([digest.hexdigest()], pa.string())], schema=schema)

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub").select("conv_id", "line").mapInArrow(feed, "conv_id bigint, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with known faults by crc32(conv_id:turn) % 20: 0 dropped, 1 emptied, 2 without .!?, 3 repeated, 4 as user; nulls are a space."""
    def shown(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    made = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return made.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def audited(conversations: DataFrame) -> DataFrame:
    """Damage, repair and digest: a row per conv_id of the table; zeros and the digest of nothing where no row is left."""
    repaired, summary = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    whole = together(ids, summary, digests(repaired))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    zero = F.col("audit").isNull()
    return whole.select("conv_id", *[F.when(zero, F.lit(0)).otherwise(F.col(c)).cast("bigint").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
