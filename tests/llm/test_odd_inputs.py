"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import bpe, decontam, langid, lines, neardup, pii, quality, topk, toxicity, urls

EMPTY = hashlib.sha256(b"").hexdigest()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def encode(docs):
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(None).cast("int").alias("quality"))


def benchmark(spark):
    return spark.createDataFrame([(1, "The cat sat on a mat, and the dog lay by the door!"), (2, None), (3, ""), (None, "x" * 50), (4, "cat")], "item_id bigint, text string")


def test_bpe(odd, none):
    got = encode(odd)
    assert got.count() == odd.count()
    r = by_id(got)
    assert r[3].n_tokens == 0 and r[3].ids_sha256 == r[4].ids_sha256 == r[3].decoded_sha256 == EMPTY
    assert r[6].decoded_sha256 == hashlib.sha256(b"x" * 150_000).hexdigest() and None in r
    assert encode(none).count() == 0


def test_language(odd, none):
    r = by_id(langid.identify(odd))
    assert len(r) == 13 and {r[3].lang_pred, r[4].lang_pred, r[5].lang_pred, r[8].lang_pred} == {"und"} and r[3].score == 0
    assert r[None].held_out is False and all(0 <= x.score <= 1 for x in r.values())
    assert langid.identify(none).count() == 0
    assert by_id(langid.predict(odd, langid.fit(none)))[1].lang_pred == "und"


def test_pii(odd, none):
    got = pii.detect(odd)
    assert got.count() == odd.count() and by_id(got)[3].base_sha256 == EMPTY and by_id(got)[1].spans == ""
    assert pii.detect(none).count() == 0


def test_quality(odd, none):
    r = by_id(quality.classify(odd))
    assert len(r) == 13 and r[3].keep and r[3].score == 0.5 and r[8].keep
    assert quality.classify(none).count() == 0
    assert quality.kept(odd).columns == odd.columns and quality.kept(none).count() == 0


def test_lines(odd, none):
    got = lines.deduplicate(odd, min_words=2)
    r = by_id(got)
    assert got.count() == odd.count() and r[3].text is None and r[3].n_lines == 0 and r[4].text == "" and r[9].text == "one\ntwo\n\none"
    assert {x.text for x in got.where("doc_id = 1").collect()} != {""} and r[11].text == "" and r[12].text == ""
    assert by_id(lines.deduplicate(odd, min_words=1))[9].text == "one\ntwo\n"
    assert lines.deduplicate(none).count() == 0
    cleaned = lines.cleaned(odd)
    assert cleaned.columns == odd.columns and {x.doc_id for x in cleaned.collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None}
    assert lines.cleaned(none).count() == 0


def test_near_duplicates(odd, none):
    got = neardup.group(odd)
    r = by_id(got)
    assert got.count() == odd.count()
    assert r[1].class_id == r[2].class_id == r[11].class_id == 1 and r[11].class_size == 4 and r[12].class_id == 7
    assert r[3].class_id is None and r[4].class_id == 4 and r[5].class_id == 5 and r[None].class_size == 1
    assert neardup.group(none).count() == 0
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(x.doc_id for x in kept.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert neardup.one_of_each(none).count() == 0


def test_decontamination(odd, none, spark):
    found = decontam.hits(odd, benchmark(spark))
    assert sorted((x.doc_id, x.item_id, x.distance) for x in found.collect()) == [(1, 1, 0), (1, 1, 0), (2, 1, 0), (11, 1, 0)]
    kept = decontam.clean(odd, benchmark(spark))
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert decontam.hits(none, benchmark(spark)).count() == 0 and decontam.hits(odd, benchmark(spark).limit(0)).count() == 0
    assert decontam.hits(odd, benchmark(spark), block_chars=20).count() == 4
    assert decontam.clean(odd, benchmark(spark), block_chars=20).count() == odd.count() - 4 and decontam.clean(none, benchmark(spark)).count() == 0
    # every row is judged by its own text: rows without an id, and rows that share one
    long = "the cat sat on a mat and the dog lay by the door"
    rows = spark.createDataFrame([(None, long), (5, long), (5, "another text that is clean"), (None, "clean"), (None, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in decontam.clean(rows, benchmark(spark)).collect()) == [(0, ""), (0, "clean"), (5, "another text that is clean")]
    many = spark.createDataFrame([(i, long + " at night") for i in range(500)], "item_id bigint, text string")
    assert decontam.clean(rows, many, block_chars=1000).count() == 5 and decontam.hits(rows.limit(2).withColumn("text", F.lit(long + " at night")), many).count() == 1000


def test_toxicity(odd, none):
    r = by_id(toxicity.predict(odd, labels(odd)))
    assert len(r) == 13 and all(0 <= x.severity <= 3 for x in r.values()) and r[3].severity == r[4].severity
    assert toxicity.predict(none, labels(odd)).count() == 0
    assert {x.toxic for x in toxicity.predict(odd, labels(none)).collect()} == {False}


def test_urls(spark):
    schema = "page_id bigint, url string, html string, host string, path string, rule string, fixed string, x_length string"
    made = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Example.ORG/es/x?y=1#z"), (None, "http://x.com/fr/"), (6, "http://org"), (7, "http://org/" + "a" * 50_000),
            (8, "http://x.com/de/1"), (8, "http://x.com/de/1"), (9, "a://b.net?q"), (10, "http://x.example.org/en/12")]
    df = spark.createDataFrame([(*x, *["?"] * 6) for x in made], schema)
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None) and got[3].host == got[4].host == ""
    assert (got[5].host, got[5].path, got[5].rule, got[5].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[None].rule == "com/fr/" and got[6].rule is None and got[7].rule == "org/" and (got[9].host, got[9].path) == ("b.net", "")
    assert got[8].verdict == got[10].verdict == "block" and {got[1].verdict, got[6].verdict} <= {"allow", "block"}
    assert urls.judge(df).count() == 12 and urls.judge(df.limit(0)).count() == 0
    assert urls.judge(df.where("page_id = 9")).count() == 1


def test_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int, n int, part int, v string"
    inf = float("inf")
    made = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [inf, 1.0]), (6, [float("nan"), 1.0]), (7, []),
            (8, [1.0]), (9, [2.0, 0.0]), (None, [3.0, 0.0]), (50, [0.5, 0.5]), (100, [3e38, 3e38]), (10, [-0.001, 0.0]), (11, [-1.0, 0.0]), (12, [-2.0, 0.0])]
    df = spark.createDataFrame([(*x, 1, 1, 1, "?") for x in made], schema)
    got = topk.search(df, F.col("vec_id") % 50 == 0)
    assert [(r["rank"], r.vec_id) for r in got.where("query_id = 0").orderBy("rank").collect()] == [(1, 100), (2, 9), (3, 1), (4, 2), (5, 50)]
    assert got.where("query_id = 0 and vec_id = 1").first().score == 65536
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(df.where("vec_id in (0, 9)"), F.col("vec_id") % 50 == 0).count() == 1


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a@b..c", "@x.y", "a@b", "+1 (988) 555-2485.", "+12", "4111 1111-1111 1111", "999.1.1.1", "000000000000000000001.1.1.1"])
def test_base_spans(spark, text):
    from test_pii import base

    got = pii.detect(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert got.base_sha256 == hashlib.sha256(",".join(base(text)).encode()).hexdigest()
