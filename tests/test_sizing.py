"""Partitions of iterative fits."""

from pyspark.sql import functions as F

from postlens.operators import models


def test_a_fit_uses_the_cores_that_its_rows_are_worth(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(0, 20_000, 1, 1).withColumn("x", F.rand(3)).persist()
    sized, n = models._size_for_iterations(one)
    assert n == 20_000 and sized.rdd.getNumPartitions() == min(5, cores)
    assert sized.exceptAll(one).isEmpty() and sized.count() == n
    sized.unpersist()
    one.unpersist()


def test_small_and_spread_inputs_are_coalesced_without_a_shuffle(spark):
    rows = spark.range(0, 900, 1, 6).persist()
    sized, n = models._size_for_iterations(rows)
    assert (n, sized.rdd.getNumPartitions()) == (900, 1)
    assert "Coalesce" in sized._jdf.queryExecution().optimizedPlan().nodeName() or "Repartition" in sized._jdf.queryExecution().optimizedPlan().nodeName()
    assert not sized._jdf.queryExecution().optimizedPlan().shuffle()
    rows.unpersist()
