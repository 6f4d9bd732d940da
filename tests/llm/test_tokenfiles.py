"""Operator 13 against the library on whole tables, the files' structure, and odd documents."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrapanel.llm import common, tokenfiles
from terrapanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module", autouse=True)
def small_files(spark):
    """Several files of a small table."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def written(spark, docs):
    path = common.fresh_path(spark)
    tokenfiles.write(docs, path, PATH, public_tokenizers.PATTERN, 2)
    return path


def expected(library, rows):
    out, start = {}, 0
    for i, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out[i] = (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_token_files"](spark, SF).collect()}
    assert got == expected(library, map(tuple, docs.collect()))


def test_pieces_are_the_librarys(library):
    """Every settled character splits as in the library, so pre-tokens can be encoded one by one."""
    own = tokenfiles.Encoder(open(PATH, encoding="utf-8").read(), public_tokenizers.PATTERN)
    assert own.split
    settled = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not own.odd.match(chr(c))]
    assert len(settled) > 40_000
    for ch in settled[::3]:
        text = f"a{ch}a1{ch}1!{ch}! {ch} {ch}"
        assert own.find(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(ord(ch))


def test_cache_is_bounded_by_characters(monkeypatch, library):
    monkeypatch.setattr(tokenfiles, "CACHED", 200)
    own = tokenfiles.Encoder(open(PATH, encoding="utf-8").read(), public_tokenizers.PATTERN)
    for i in range(300):
        text = f"word{i} and word{i + 1} 𝔘 <|endoftext|>"[: 16 + i % 24] + "y" * (i % 100 if i % 7 == 0 else 3 * i if i % 31 == 0 else 1)
        assert own.encode(text) == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.size == sum(map(len, own.known)) <= 100 and sum(map(len, own.older)) <= 100


def test_control_characters_and_lone_pieces(library):
    own = tokenfiles.Encoder(open(PATH, encoding="utf-8").read(), public_tokenizers.PATTERN)
    for text in ("", " ", "a\x1cb \x1f c", "\n\n", "!", " a", "a", "a  b\t\tc \u3000 d", "x" * 500, "it's\u2019s 12² ½"):
        assert own.encode(text) == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def kinds(spark, file):
    """Kinds of the streams in the first stripe's footer, and the encodings of its columns, as ORC's own reader sees them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    footer = reader.rows().readStripeFooter(reader.getStripes()[0])
    return {(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()}, [c.getKind().toString() for c in footer.getColumnsList()]


def test_files_have_indexes_filters_and_run_lengths(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = written(spark, docs)
    files = sorted(glob.glob(f"{path}/*.orc"))
    assert len(files) > 1 and sum(pyarrow.orc.ORCFile(f).nrows for f in files) == docs.count()
    streams, encodings = kinds(spark, files[0])
    doc = tokenfiles.SCHEMA.split(", ").index("doc_id bigint") + 1
    assert ("BLOOM_FILTER_UTF8", doc) in streams and ("ROW_INDEX", doc) in streams and not any(k.startswith("BLOOM") and c != doc for k, c in streams)
    assert encodings[doc] == encodings[-1] == "DIRECT_V2"


def test_lookups_skip_row_groups(spark):
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    path = written(spark, docs)
    for ids, want in (([100, 39_998], 2), ([101], 0), ([-5, 10**9], 0)):
        rows = spark.read.schema(tokenfiles.SCHEMA).orc(path).where(F.col("doc_id").isin(ids))
        rows.collect()
        read = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().get("numOutputRows").get().value()
        assert read <= 1000 * max(want, 1) + 1000 and tokenfiles.lookup(spark, path, ids).count() == want
    assert tokenfiles.lookup(spark, path, [100]).first().start == 50 * 3


def test_odd_documents(spark, odd, none, library):
    path = written(spark, odd)
    rows = [(r.doc_id, r.start, r.n_tokens, r.ids) for r in tokenfiles.read(spark, path).collect()]
    texts = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    assert len(rows) == len(texts)
    by_start = sorted(rows, key=lambda r: r[1])
    assert [r[0] for r in by_start] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(by_start, by_start[1:])) and by_start[0][1] == 0
    decoded = sorted((i is not None, i or 0, library.decode(ids[:-1], skip_special_tokens=False)) for i, _, _, ids in rows)
    assert decoded == sorted((i is not None, i or 0, t) for i, t in texts) and all(r[3][-1] == 2 and len(r[3]) == r[2] for r in rows)
    assert tokenfiles.digests(tokenfiles.read(spark, written(spark, none))).count() == 0
