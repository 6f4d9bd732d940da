"""Station records in fixed-width text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.constants import STATION_ELEMENTS, STATION_TENTHS


def parse_station_daily(lines: DataFrame, text: str = "value") -> DataFrame:
    """Monthly records (station, year, month, element, 31 slots of 8 characters) to one row per valid day.

    A slot holds a 5-character value and three flags. Dropped: other elements, -9999, a value with a quality flag, text
    that is no number, days that do not exist. Values stored in tenths are divided.
    """
    t = F.col(text)
    d = lines.filter((F.length(t) >= 269) & F.substring(t, 18, 4).isin(STATION_ELEMENTS))
    d = d.select(F.trim(F.substring(t, 1, 11)).alias("station"), F.substring(t, 12, 4).alias("_y"), F.substring(t, 16, 2).alias("_m"),
                 F.substring(t, 18, 4).alias("element"), t.alias("_t"), F.explode(F.sequence(F.lit(1), F.lit(31))).alias("_d"))
    at = F.col("_d") * 8 + 14
    raw = F.expr("try_cast(trim(substring(_t, _d * 8 + 14, 5)) AS INT)")
    flag = F.substring(F.col("_t"), at + 6, F.lit(1))
    d = d.withColumn("_v", raw).filter(F.col("_v").isNotNull() & (F.col("_v") != -9999) & (flag == " "))
    date = F.expr("try_to_date(concat(_y, '-', _m, '-', lpad(cast(_d AS STRING), 2, '0')), 'yyyy-MM-dd')")
    value = F.when(F.col("element").isin(STATION_TENTHS), F.col("_v") / 10.0).otherwise(F.col("_v").cast("double"))
    return d.select("station", date.alias("date"), "element", value.alias("value")).filter(F.col("date").isNotNull())


def read_station_daily(spark: SparkSession, path: str) -> DataFrame:
    return parse_station_daily(spark.read.text(path))


def parse_station_inventory(lines: DataFrame, text: str = "value", prefix: str = "") -> DataFrame:
    """Station list: id, latitude, longitude, elevation and name at fixed positions."""
    t = F.col(text)
    num = lambda a, n, name: F.trim(F.substring(t, a, n)).try_cast("double").alias(name)
    d = lines.filter(t.startswith(prefix)) if prefix else lines
    return d.select(F.trim(F.substring(t, 1, 11)).alias("station"), num(13, 8, "lat"), num(22, 9, "lon"), num(32, 6, "elevation"), F.trim(F.substring(t, 42, 30)).alias("name"))


def read_station_inventory(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    return parse_station_inventory(spark.read.text(path), prefix=prefix)
