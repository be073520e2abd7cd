"""The order of units plans its input once, and permutations are not left to few tasks because their input is small."""

from pyspark.sql import functions as F

from undulate.operators import events as E


def latencies(spark):
    x = spark.range(4 * 6 * 7).select(F.expr("id % 4").alias("run_id"), F.expr("id div 4 % 6").alias("ev"), F.expr("id div 24").alias("unit"))
    return x.groupBy("run_id", "ev", "unit").agg(F.max((F.col("unit") * 7 + F.col("ev") * F.col("ev") * 5) % 11).cast("double").alias("lat"))


def test_latencies_are_planned_once(spark):
    w = E.kendall_w(latencies(spark), ["run_id"], "ev", "unit", "lat")
    assert "Range (" not in w._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.run_id, r.n, r.m) for r in w.collect()} == {(k, 7, 6) for k in range(4)}


def test_permutations_of_a_small_input_go_to_many_tasks(spark):
    e = latencies(spark).groupBy("run_id", "ev").agg(F.sort_array(F.collect_list("lat")).alias("x"))
    sums = E.permuted_sums(e, ["run_id"], "ev", ["x"], 3, lambda image, x: x[:, None, :].repeat(3, 1))
    assert sums.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(r.run_id, r.rep) for r in sums.collect()} == {(k, i) for k in range(4) for i in range(3)}
