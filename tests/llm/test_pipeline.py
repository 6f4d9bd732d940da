"""The pipeline's stages on planted documents, each against brute force, and the part that can be left out."""

import subprocess
import sys

import corpus_pipeline
from terrapanel.llm import common


def test_stages_and_their_effects(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept, before = docs, docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        kept = common.stored(stage(spark, before, "/root/testdata/sf0.01"))
        counts.append((name, kept.count()))
        if name != "byte_bpe":
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
            assert kept.join(before, "doc_id", "left_anti").count() == 0
        before = kept
    numbers = [n for _, n in counts]
    assert numbers == sorted(numbers, reverse=True) and numbers[-1] == numbers[-2] and numbers[0] < 1000
    items = {common_text(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()}
    texts = [r.decoded for r in kept.select("decoded").collect()]
    assert not any(i in common_text(t) for t in texts for i in items)
    assert len(set(texts)) == len(texts)


def common_text(t):
    from terrapanel.llm.decontam import normalise

    return normalise(t)


def test_entry_without_the_part():
    code = "import sys; sys.modules['terrapanel.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 200; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_all_operators_are_registered():
    import re

    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
