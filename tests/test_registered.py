"""Every registered query with SQL against DuckDB on the smallest tables, so that no query is broken unseen."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
#: Their passes over the data take minutes at any size; tests of their operators are elsewhere.
LONG = {"mdl_gbm_rf"}
NAMES = sorted(n for n in entry.oracle_sql() if n.startswith(("src_", "snk_", "jn_", "mdl_", "job_", "agg_failure", "agg_treeline", "agg_nn", "spl_")) and n not in LONG)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def table(rows, columns):
    """Rows in a common order: by everything but fractions first, for these differ in the last place."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [[v if v is None or isinstance(v, (int, float, bool, str)) else str(v) for v in (r[i] for i in order)] for r in rows]
    return sorted(cells, key=lambda r: (str([v for v in r if not isinstance(v, float)]), [round(v, 3) for v in r if isinstance(v, float) and not math.isnan(v)]))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    mine, theirs = table(got.collect(), got.columns), table(want.fetchall(), columns)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, float) and (x == pytest.approx(y, rel=1e-9, abs=2.5e-6) or math.isnan(x) and math.isnan(y)), (a, b)
