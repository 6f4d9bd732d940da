"""Operator 12 against a search over all edits, with chunks of a few rows and of production size."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from terrapanel.llm import conversations
from terrapanel.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos string, codes string, audit string"
NOTHING = hashlib.sha256(b"").hexdigest()


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of rows (turn, role, text) in order."""
    seen, marks = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
        marks.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    grammar = re.compile(r"(s?(ua)+)?")
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, at, free):
        """Least (cost, audit, lines) from row i when the last kept initial is ``at``; ``free`` insertions in a row are still allowed."""
        found = []
        if i == len(rows):
            if at in ("", "a"):
                return 0, "", ()
        else:
            _, role, text = rows[i]
            options = [(3, "D", at, ())]
            if marks[i] in ("", "truncated"):
                t = int(marks[i] == "truncated")
                options += [(t, "K", role[:1], (f"{role}:{text}",))] if role[:1] in follow[at] and role[:1] else []
                options += [(2 + t, "R", r[0], (f"{r}:{text}",)) for r in ("user", "assistant") if r[0] in follow[at]]
            found += [(c + b[0], e + b[1], x + b[2]) for c, e, to, x in options for b in [best(i + 1, to, 3)] if b]
        if free:
            found += [(2 + b[0], "I" + b[1], (f"{r}:",) + b[2]) for r in ("user", "assistant") if r[0] in follow[at] for b in [best(i, r[0], free - 1)] if b]
        return min(found) if found else None

    cost, audit, lines = best(0, "", 3)
    assert grammar.fullmatch("".join(x[0] for x in lines))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(conv, turn, role, text):
    def shown(x):
        return " " if x is None else str(x)

    kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
    role, text = shown(role), shown(text)
    row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
    return [row] * (0 if kind == 0 else 2 if kind == 3 else 1)


def expected(table):
    convs = {}
    for conv, turn, role, text in table:
        convs.setdefault(conv, []).extend(damaged(conv, turn, role, text))
    order = {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())) for c, r in convs.items()}
    return {c: repaired(r) if r else (0, 0, 0, 0, 0, 0, "", NOTHING) for c, r in order.items()}


def as_dict(df):
    rows = df.collect()
    got = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_whole_table(spark):
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01")) == expected(table)


@pytest.mark.parametrize("bits", [1, 2])
def test_long_conversations_in_short_chunks(spark, monkeypatch, bits):
    """Any mix of roles and faults, in chunks of two and eight rows; a conversation of strange roles never forgets a choice."""
    monkeypatch.setattr(conversations.repair, "__defaults__", (bits,))
    rng, table = random.Random(bits), []
    for conv in range(20):
        roles = [["user", "assistant", "system", "tool", "", "user", "assistant"], ["tool"], ["user"], ["assistant", "assistant", "user"], ["user", "assistant"]][conv % 5]
        for turn in range(rng.choice([3, 9, 40])):
            table.append((conv, turn + 3 * (rng.random() < 0.1), roles[turn % len(roles)] if conv % 2 else rng.choice(roles), rng.choice(["yes.", "no", " ", f"so {turn}.", f"well {turn}", "a?\n"])))
    table = list(dict.fromkeys((c, t + 1000 * i, r, x) for i, (c, t, r, x) in enumerate(table)))  # turns differ
    got = as_dict(conversations.audited(spark.createDataFrame([(*r, "?", "?", "?") for r in table], SCHEMA).repartition(5)))
    want = expected(table)
    assert got == want and any("I" in w[6] for w in want.values()) and len({w[6][:1] for w in want.values()}) >= 3


def test_fixups_end_where_vectors_differ_by_a_constant():
    rng = random.Random(1)
    for _ in range(300):
        codes = [rng.randrange(16) for _ in range(rng.randrange(1, 12))]
        old, new = ([rng.randrange(4) for _ in range(4)] for _ in range(2))
        assert conversations.redone(codes, old, new, conversations.start_costs(codes, old)) == conversations.start_costs(codes, new)


def test_odd_rows(spark):
    long = "word " * 60_000
    table = [(1, None, "user", "Hi."), (1, 0, "assistant", long + "."), (2, 5, None, None), (None, 1, "user", "no id."), (None, None, "assistant", "none!"), (3, 0, "", "x"), (4, -(2**63), "user", "a."),
             (4, 2**63 - 1, "assistant", "b."), (5, None, None, ""), (6, 1, "user", "é　"), (6, 1, "user", "é　"), (6, 1, "user", "é　"), (7, 1, "system", "s."), (7, 2, "system", "s.")]
    got = as_dict(conversations.audited(spark.createDataFrame([(*r, "?", "?", "?") for r in table], SCHEMA).repartition(3)))
    want = expected(table)
    assert {k: v for k, v in got.items() if k != 4} == {k: v for k, v in want.items() if k != 4}
    assert got[4][0] is None and got[4][1:] == want[4][1:] or got[4] == want[4]
    assert conversations.audited(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert as_dict(conversations.audited(spark.createDataFrame([(dropped, 0, "user", "Hi.", "", "", "")], SCHEMA))) == {dropped: (0, 0, 0, 0, 0, 0, "", NOTHING)}


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi"), (2, 0, "user", " "), (3, 0, "system", "Be kind.")]
    fixed, summary = conversations.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {c: [(r.edit, r.role, r.text) for r in fixed.where(f"conv_id = {c}").orderBy("pos", "sub").collect()] for c in (1, 2, 3)}
    audits = {r.conv_id: r.audit for r in summary.collect()}
    assert audits == {c: "".join(e for e, _, _ in x) for c, x in got.items()} and audits[2] == "D" and audits[3] == "D"
    left = [(r, t) for e, r, t in got[1] if e != "D"]
    assert len(left) == 2 * len(left) // 2 and all(r == ("user", "assistant")[i % 2] for i, (r, _) in enumerate(left))
