"""Sources, sinks, resume and the registered entry points."""

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrapanel.plans.scenario import run_members
from terrapanel.sources import sinks, stations
from terrapanel.sources import tables as Tb

SF = "/root/testdata/sf0.001"


def record(station, year, month, element, values):
    return f"{station:<11}{year}{month:02d}{element}" + "".join(f"{v:>5}{f}" for v, f in values)


def test_station_records(spark, tmp_path):
    v = [(123, "   ")] * 31
    v[1], v[2] = (-9999, "   "), (50, " X ")
    lines = [record("AM001", 2019, 2, "TMAX", v), record("AM001", 2019, 2, "SNOW", v), record("AM001", 2019, 2, "WSFG", v), "short"]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    rows = stations.read_station_daily(spark, str(tmp_path / "a.txt")).collect()
    assert len(rows) == 2 * 26                                     # 28 days less a missing and a flagged one
    assert {(r["element"], r["value"]) for r in rows} == {("TMAX", 12.3), ("SNOW", 123.0)}
    assert max(r["date"].day for r in rows) == 28


def test_ingest_guards(spark):
    mixed = spark.createDataFrame([(1.0, "kg m-2 s-1"), (2.0, "mm day-1")], "value double, unit string")
    with pytest.raises(Exception, match="units"):
        Tb.flux_to_depth(mixed).collect()
    a, b = spark.createDataFrame([(1, 50.0), (2, 60.0)], "d int, value double"), spark.createDataFrame([(1, 10.0)], "d int, value double")
    with pytest.raises(Exception, match="unmatched"):
        Tb.vapour_from_humidity(a, b, ["d"]).collect()
    with pytest.raises(KeyError, match="kndvi_2001"):
        Tb.bands_to_long(spark.createDataFrame([(1, 0.5)], "p int, kndvi_2000 double"), ["p"], "kndvi_{year}", [2000, 2001], "v")
    assert Tb.choose_dataset({"dense": 80, "base": 10}, ["dense", "base"], 100)[0] == "base"
    assert Tb.choose_dataset({"dense": 95, "base": 10}, ["dense", "base"], 100)[0] == "dense"


def test_resume_skips_finished_and_refuses_partial(spark, tmp_path):
    m = spark.createDataFrame([(g, s) for g in "ab" for s in "xy"], "gcm string, ssp string")
    seen = []

    def job(todo):
        seen.append(todo.count())
        return todo.withColumn("v", F.lit(1.0))

    path = str(tmp_path / "out")
    run_members(spark, m.filter("gcm = 'a'"), job, path, ["gcm", "ssp"])
    assert run_members(spark, m, job, path, ["gcm", "ssp"]).count() == 4 and seen == [2, 2]
    run_members(spark, m, job, path, ["gcm", "ssp"])
    assert seen == [2, 2]
    with pytest.raises(ValueError, match="partial"):
        run_members(spark, m, lambda t: t.filter("ssp = 'x'").withColumn("v", F.lit(1.0)), str(tmp_path / "b"), ["gcm", "ssp"])


def test_exports_and_audit(spark, tmp_path):
    d = spark.createDataFrame([(1, float("nan"), 'a "b", c'), (2, 1.25, None)], "id int, v double, s string")
    sinks.write_json(d, str(tmp_path / "j"), {"v": 1})
    assert [r["v"] for r in spark.read.schema("id int, v double").json(str(tmp_path / "j")).orderBy("id").collect()] == [None, 1.2]
    sinks.write_csv(d.drop("v"), str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).orderBy("id").collect()
    assert back[0]["s"] == 'a "b", c' and back[1]["s"] is None
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    man = spark.createDataFrame([("x.bin", hashlib.sha256(b"abc").hexdigest()), ("y.bin", "0")], "path string, checksum string")
    assert {r["path"]: r["status"] for r in Tb.audit_files(spark, man, str(tmp_path / "f")).collect()} == {"x.bin": "ok", "y.bin": "missing"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["node", "year", "cwd", "wsi", "aet", "drainage"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 266


@pytest.mark.parametrize("name", ["annual_water_deficit", "win_dieback", "agg_auc", "agg_anova_fractions", "jn_knn", "agg_murphy", "top_dominance_prune"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier", "part", "events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(None if x is None else round(x, 4) + 0.0 if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())))
    cur = con.execute(entry.oracle_sql()[name])
    pos = [c[0] for c in cur.description]
    want = sorted(map(str, (tuple(None if r[pos.index(c)] is None else round(r[pos.index(c)], 4) + 0.0 if isinstance(r[pos.index(c)], float) else r[pos.index(c)] for c in cols) for r in cur.fetchall())))
    assert got == want and not math.isnan(len(got))
