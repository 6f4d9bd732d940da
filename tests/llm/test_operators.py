"""Operators against brute force, exact round trips or held-out labels."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import bpe, common, decontam, langid, lines, neardup, quality, toxicity, words
from terrapanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").orderBy("doc_id").collect()}


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots(edges, {x for e in edges if e[0] != e[1] for x in e})
    assert got == {n: want[n] for n in got} and len(got) == len({x for a, b in edges if a != b for x in (a, b)})


def test_near_duplicates(spark, texts):
    """All pairs that share a shingle, weighed exactly."""
    tf = {}
    for i, t in texts.items():
        w = t.lower().split()
        tf[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    df, n = Counter(s for c in tf.values() for s in c), sum(map(bool, tf.values()))
    top = neardup.SMOOTH + math.log(1000)
    weight = {i: {s: round((1 + math.log(k)) * (neardup.SMOOTH + math.log(min(n / df[s], 1000))) / top * 4096) for s, k in c.items()} for i, c in tf.items()}
    holders = defaultdict(list)
    for i, c in weight.items():
        for s in c:
            holders[s].append(i)
    pairs = {(a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k]}
    linked = []
    for a, b in pairs:
        shared = sum(min(weight[a][s], weight[b][s]) for s in weight[a].keys() & weight[b].keys())
        if shared >= 0.8 * (sum(weight[a].values()) + sum(weight[b].values()) - shared):
            linked.append((a, b))
    want = roots(linked, texts)
    got = {r.doc_id: r.class_id for r in QUERIES["op1_near_dedup"](spark, SF).collect()}
    assert len(linked) > 50 and got == want


def test_links_in_a_family_below_the_threshold(spark, monkeypatch):
    """300 texts with a shared template are about 0.7 alike; forty pairs of them are above 0.8, which no leader is to either."""
    monkeypatch.setattr(neardup, "BLOCK", 40)
    rows = []
    for i in range(300):
        pair, own = [f"p{i // 2}x{k}" for k in range(10)] if i < 80 else [f"o{i}y{k}" for k in range(10)], [f"o{i}x{k}" for k in range(10)]
        rows.append((i, " ".join([f"t{k}" for k in range(123)] + pair + own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    n, frequent = neardup.document_frequencies(docs)
    doc, h, tf = neardup.counted([t for _, t in rows])
    w, cuts = neardup.weights(h, tf, n, frequent), np.searchsorted(doc, np.arange(301))
    part = [slice(*cuts[i : i + 2]) for i in range(300)]
    alike = {(a, b) for b in range(300) for a in range(b) if neardup.similarity(h[part[a]], w[part[a]], h[part[b]], w[part[b]]) >= 0.8}
    assert alike == {(i, i + 1) for i in range(0, 80, 2)}
    assert 0.68 < neardup.similarity(h[part[80]], w[part[80]], h[part[81]], w[part[81]]) < 0.8
    got = {r.doc_id: r.class_id for r in neardup.group(docs).collect()}
    assert got == {i: i - i % 2 if i < 80 else i for i in range(300)}


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(5)
    h = np.sort(rng.integers(0, 1 << 48, 1200, np.uint64))
    w = rng.integers(3000, 9000, 1200).astype(np.uint32)
    a, b = np.arange(0, 1000), np.arange(200, 1200)
    s = neardup.sampler().signatures(np.r_[h[a], h[b]], np.r_[w[a], w[b]], np.array([0, 1000]))
    assert abs((s[0] == s[1]).mean() - neardup.similarity(h[a], w[a], h[b], w[b])) < 0.2


def test_line_runs(spark, texts):
    """Every run, of any length, that occurs before."""
    where, gone = defaultdict(list), defaultdict(set)
    split = [t.split("\n") for t in texts.values()]
    for d, own in enumerate(split):
        for p, line in enumerate(own):
            for e, q in where[line]:
                k = 0
                while p + k < len(own) and q + k < len(split[e]) and own[p + k] == split[e][q + k]:
                    k += 1
                if sum(len(x.split()) for x in own[p : p + k]) >= lines.MIN_WORDS:
                    gone[d].update(range(p, p + k))
            where[line].append((d, p))
    got = {r.doc_id: r for r in QUERIES["op6_line_dedup"](spark, SF).collect()}
    for d, (i, own) in enumerate(zip(texts, split, strict=True)):
        assert got[i].text == "\n".join(x for p, x in enumerate(own) if p not in gone[d]) and got[i].n_deleted == len(gone[d])
    assert sum(map(len, gone.values())) > 100


def test_long_runs_of_short_lines(spark):
    run = [f"w{i}" for i in range(37)]
    rows = [(1, "\n".join(["a b", *run, "c d"])), (2, "\n".join(["e f", *run, "g"])), (3, "\n".join(run[5:9])), (4, "\n".join(["w3", "x", "w4"]))]
    got = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "e f\ng", 3: rows[2][1], 4: rows[3][1]}


def test_runs_whose_blocks_begin_in_different_places(spark):
    """Random sequences of few short lines, against every run that occurs before; a row repeated whole is one document."""
    rows = [(1, "a a a a\nb b b b\ny"), (2, "z\na a a a\nb b b b\nc c c c\nw"), (3, "a a a a\nb b b b\nc c c c")]
    rng = random.Random(12)
    rows += [(k, "\n".join(rng.choice(("a", "b b", "c", "d d")) for _ in range(rng.randint(1, 60)))) for k in range(4, 60)]
    rows += [(None, "k k k k k k k k k k k\nm"), (60, "k k k k k k k k k k k\nn")]
    want, where = {}, defaultdict(list)
    for i, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        own, gone = text.split("\n"), set()
        for p, line in enumerate(own):
            for other, q in where[line]:
                k = 0
                while p + k < len(own) and q + k < len(other) and own[p + k] == other[q + k]:
                    k += 1
                if sum(len(x.split()) for x in own[p : p + k]) >= lines.MIN_WORDS:
                    gone.update(range(p, p + k))
            where[line].append((own, p))
        want[i] = "\n".join(x for p, x in enumerate(own) if p not in gone)
    docs = spark.createDataFrame([*rows, rows[1], rows[10]], "doc_id bigint, text string")
    got = lines.deduplicate(docs).collect()
    assert len(got) == len(rows) + 2 and {r.doc_id: r.text for r in got} == want
    assert want[3] == "" and want[60] == "n"


def distance(item, text):
    """The least edit distance between an item and a substring."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
        best = min(best, row[-1])
    return best


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(60):
        item, text = ("".join(rng.choice("ab c") for _ in range(n)) for n in (rng.randint(1, 80), rng.randint(0, 120)))
        assert decontam.Pattern([1], item, 0.1).nearest(text)[0] == distance(item, text)


def test_decontamination_misses_no_copy_within_its_budget(spark):
    """Items with as many edits as the budget allows, and one more where it must not be found."""
    rng = random.Random(7)
    items = [decontam.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(20).collect()]
    filler = "zu und dieus der einer wer nach dem tag kam und ging "
    rows = []
    for n, item in enumerate(items):
        for edits in (0, len(item) // 20, len(item) // 10):
            copy = list(item)
            for _ in range(edits):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "qa"])
            rows.append((n, filler + "".join(copy) + " " + filler))
    found = {(r.doc_id, r.item_id): r.distance for r in decontam.hits(
        spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id bigint, text string"),
        spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()}
    want = {}
    for k, (_, t) in enumerate(rows):
        for n, item in enumerate(items):
            d = distance(item, decontam.normalise(t)) if n == rows[k][0] else None
            if d is not None and d <= len(item) // 10:
                want[k, n] = d
    assert found == want and len(want) > 40


def test_language_held_out(spark, docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_held_out_rows_teach_nothing(spark, docs):
    a = langid.fit(docs)
    b = langid.fit(docs.withColumn("lang", F.when(common.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))))
    assert a.languages == b.languages and np.allclose(a.vectors, b.vectors)


def test_bpe_is_the_library_s(spark, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in QUERIES["op7_byte_bpe"](spark, SF).collect():
        ids = np.array(want.encode_ordinary(texts[r.doc_id]), "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_round_trip_of_odd_text():
    import tiktoken

    path, rng = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(1)
    own = bpe.codec(bpe.serialise_model(bpe.read_ranks(path)), public_tokenizers.PATTERN)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for _ in range(500):
        t = "".join(rng.choice("abc the 's\n\t\x1c\x85\u00a0\u3000éß中😀\u200b\x00!?.,-12") for _ in range(rng.randint(0, 60)))
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(t) and own.decode(ids).decode() == t


def test_quality_agrees_with_labels(spark, docs):
    known = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    got = quality.classify(docs).join(known, "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in got) / len(got) > 0.98
    assert all(r.keep for r in got if r.quality == 1)


def test_accuracies_are_recovered():
    rng = np.random.default_rng(8)
    y = rng.random(20_000) < 0.8
    votes = np.stack([np.where(rng.random(len(y)) < 0.2, 2, np.where(rng.random(len(y)) < p, y, ~y)) for p in (0.9, 0.85, 0.8, 0.7)], axis=1).astype(int)
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table = quality.accuracies(kinds, counts.astype(float))
    assert abs(prior - 0.8) < 0.05 and abs(table[0, 1, 1] - 0.72) < 0.05 and abs(table[0, 0, 0] - 0.72) < 0.08


def test_toxicity_held_out(spark):
    """Learned from two thirds of the labelled texts, judged on the others."""
    sf = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", F.col("toxic").alias("y"))
    teach = known.where("doc_id % 3 <> 0").select("doc_id", F.col("y").alias("toxic"))
    got = toxicity.predict(spark.read.parquet(f"{sf}/documents.parquet"), teach).join(known.where("doc_id % 3 = 0"), "doc_id").collect()
    caught = [r.toxic for r in got if r.y == 1]
    false = [r.toxic for r in got if r.y == 0]
    assert len(caught) > 100 and sum(caught) / len(caught) > 0.9 and sum(false) / len(false) < 0.01
    assert 1 < np.mean([r.severity for r in got if r.y == 1]) < 3


def test_words_and_shingles():
    texts = ["", None, "a b c d e f", " one  two\n", "x", "a b c d e f", "é" * 3000]
    w = words.read(texts)
    assert ["".join(map(chr, w.codes[a:b])) for a, b in zip(w.start, w.end, strict=True)] == " ".join(t or "" for t in texts).split()
    doc, h = words.shingles(w, 5)
    own = {d: sorted(h[doc == d].tolist()) for d in set(doc.tolist())}
    assert {d: len(x) for d, x in own.items()} == {2: 2, 3: 1, 4: 1, 5: 2, 6: 1} and own[2] == own[5]


def test_urls_held_out(spark):
    """Rules decide labelled URLs; trees learned from half of them decide the other half."""
    from terrapanel.llm import urls

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op5_url_filter"](spark, "/root/testdata/sf0.1").collect()}
    for r in pages.select("page_id", "url").collect():
        rest = r.url.split("://", 1)[1]
        host = rest.replace("?", "/").replace("#", "/").split("/")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fits = [x for x in urls.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host.lower(), path, best.text if best else None)
        assert g.verdict == best.verdict if best else g.verdict in ("allow", "block")
    half = [r for r in urls.RULES if r.host != "com"]
    both = urls.judge(pages, half).join(urls.judge(pages).select("page_id", F.col("verdict").alias("known"), F.col("rule").alias("fits")), "page_id")
    assert both.where("rule is null and fits is not null").count() > 100
