"""The registered queries of the llm operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm import bpe, conversations, decontam, langid, lines, neardup, pii, quality, tokenfiles, topk, toxicity, urls, whitening
from terrapanel.llm.common import fresh_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.group(table(spark, sf, "documents"))


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents"))


def op3_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.detect(table(spark, sf, "documents"))


def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"))


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.deduplicate(table(spark, sf, "documents"))


def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.predict(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.audited(table(spark, sf, "conversations"))


def op13_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark)
    tokenfiles.write(table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return tokenfiles.digests(tokenfiles.read(spark, path))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_near_dedup, op2_language_id, op3_exact_topk, op4_pii, op5_url_filter, op6_line_dedup, op7_byte_bpe, op8_quality,
    op9_decontamination, op10_toxicity, op11_whitening, op12_conversation_repair, op13_token_files)}

ORACLES: dict[str, str] = {
    "op3_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c AS (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i, vec_id FROM v),
        s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(sum(q.x * r.x) AS BIGINT) AS score
            FROM c q JOIN c r ON q.i = r.i AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
