"""The forests of the audit read their rows in as many tasks as there are cores, however few the input has."""

from pyspark.sql import functions as F

from terrapanel.plans import audit


def test_rows_of_one_file_are_spread(spark):
    d = spark.range(400).coalesce(1).select("id", (F.col("id") % 7).cast("double").alias("f"), (F.col("id") % 7 * 2.0).alias("y"), (F.col("id") % 2).alias("fold"))
    out = audit.forest_out_of_fold(d, ["f"], "y", "fold", trees=2, depth=3)
    assert out.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert out.count() == 400 and out.select("id").distinct().count() == 400 and out.columns == ["id", "f", "y", "fold", "prediction"]
