from pyspark.sql import functions as F

from graphloom import tables


def test_materialise_cuts_the_lineage_and_can_be_forgotten(spark, tmp_path):
    rows = tables.materialise(spark.range(5).withColumn("x", F.rand()), "numbers")
    assert rows.collect() == rows.collect() and "Range" not in rows._jdf.queryExecution().toString()
    assert rows.inputFiles()[0].startswith(tables.shared_dir(spark))
    tables.forget(spark)
    assert tables._WRITTEN == []


def test_small_is_broadcast_and_large_is_not(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    a, b = spark.range(100), spark.range(50).withColumnRenamed("id", "k")
    assert "broadcast" in plan(a.join(tables.small(b, 50), a["id"] == b["k"]))
    assert "broadcast" not in plan(a.join(tables.small(b, 49), a["id"] == b["k"]))
