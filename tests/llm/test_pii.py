"""Operator 4 against the contract's patterns, read by another engine."""

import hashlib
import re

from terrapanel.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")),
                    "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = pii.detect(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]
        assert set(spans) <= set(r.spans.split(",") if r.spans else [])


def test_wide_candidates_that_look_accepted_are_added(spark):
    rows = [(i, f"write to user{i}@mail{i}.example.com or call +1 (555) 123-4{i:03d} from 10.0.{i}.7, card 4111 1111 1111 1111") for i in range(200)]
    rows += [(200 + i, f"number {i}.{i}.999.{i} or 1234 5678 9012 3456 or 12345678") for i in range(200)]
    rows += [(1000, "write to jörg@büro.example.com please"), (1001, "a.b [at] mail.example.com"), (1002, "nothing here")]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].n_email == got[1].n_ip == got[1].n_card == got[1].n_phone == 1
    assert got[1000].spans == "email:9:30" and got[1000].n_email == 0 and got[1002].spans == ""
    assert not any(got[200 + i].spans for i in range(200))


def test_planted_obfuscated_spans(spark):
    """Spans no base rule accepts, written as people write them, among numbers and strings that are none: precision and recall of 0.9."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))

    def card():
        digits = [4, *(rng.randrange(10) for _ in range(14))]
        total = sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits))
        return "".join(map(str, [*digits, -total % 10]))

    def secret():
        return "".join(rng.choice("0123456789abcdef") for _ in range(40))

    rows, want = [], {}
    for i in range(600):
        c = card()
        rows.append((i, f"{prose(6)} mail {word()}.{i}@{word()}.com {prose(4)} card {c} {prose(3)} call +1 (555) 123-{i:04d} token = \"{secret()}\" {prose(5)}"))
    for i in range(600, 900):
        rows.append((i, f"{prose(5)} order {rng.randrange(10**7, 10**8)} of {rng.randrange(1990, 2030)} {rng.randrange(10**12, 10**13)} {prose(4)} {word() * 6}2 see section {i}.{i % 9}.{i % 7}"))
    for i in range(900, 1000):
        c = card()
        said = [f"mail {word()} [at] {word()} [dot] com", f"card {c[:4]}/{c[4:8]}/{c[8:12]}/{c[12:]}", f'set to "{secret()}"'][i % 3]
        head = prose(5) + " "
        rows.append((i, f"{head}{said} {prose(4)}"))
        want[i] = (len(head), len(head) + len(said))
    result = pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = {r.doc_id: [tuple(s.split(":")) for s in r.spans.split(",") if s] for r in result}
    found = sum(any(int(a) >= lo and int(b) <= hi for _, a, b in got[i]) for i, (lo, hi) in want.items())
    wrong = sum(r.n_added for r in result if 600 <= r.doc_id < 900)
    assert found >= 0.9 * len(want) and wrong <= 0.1 * found, (found, wrong)


def test_the_given_table_gains_spans_through_the_trees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = {r.doc_id: r.spans for r in pii.detect(docs.repartition(7)).collect()}
    rows = pii.detect(docs).collect()
    secrets = sum(len(re.findall('token = "[0-9a-f]{40}"', r.text or "")) for r in docs.select("text").collect())
    assert sum(r.n_added for r in rows) >= secrets > 10 and all(r.personal == (r.spans != "") for r in rows)
    assert {r.doc_id: r.spans for r in rows} == a
