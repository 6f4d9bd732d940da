import pytest

EXTRA = ["node", "key", "row", "bucket", "score", "gone", "class", "a", "b", "tid", "place", "h1", "kind", "start", "toxic", "x", "first", "keep", "lines"]
PROSE = "the cat sat on a mat and the dog lay by the door while rain fell on the old town and nobody came to see it at all"


def rows():
    long_word = "x" * 150_000
    long_text = " ".join(f"word{i}" for i in range(20_000))
    return [(1, PROSE, "en"), (1, PROSE, "en"), (2, PROSE + " today", "en"), (3, None, "en"), (4, "", "de"), (5, " \n\n ", None), (None, "no id but words", "en"),
            (6, long_word, None), (7, long_text, "de"), (8, "***", "en"), (9, "one\ntwo\n\none", "de"), (10, "é ß 中文 \x00 tab\t", "fr"), (11, PROSE, None), (12, long_text, "de")]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and extra columns whose names the operators use."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)
    made = [(i, t, g, "s", None if t is None else len(t), *["?"] * len(EXTRA)) for i, t, g in rows()]
    return spark.createDataFrame(made, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
