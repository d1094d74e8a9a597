"""Components of small graphs run few tasks, whatever the number of shuffle partitions."""

from inkmesh.llm import common
from inkmesh.llm.common import components


def test_a_round_runs_as_many_tasks_as_the_edges_need(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (200, 200)], "a long, b long")
    wide = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        found = components(spark, edges)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, found.collect())) == [(i, 1) for i in range(1, 41)] + [(100, 100), (101, 100)]
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_rounds_over_edges_in_many_partitions_run_few_tasks_and_collections(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 300)], "a long, b long").repartition(64).localCheckpoint()
    freed, release = [], common.release
    monkeypatch.setattr(common, "release", lambda session: (freed.append(1), release(session)))
    wide = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in wide}
    context = spark.sparkContext
    context.setJobGroup("few-tasks", "")
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        found = components(spark, edges)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, found.collect())) == [(i, 1) for i in range(1, 301)]
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numCompletedTasks >= 64 for s in stages if s) == 1  # the count of the edges as they came
    assert 1 <= len(freed) <= 3  # one before the first step, one in ROUNDS after


def test_sizes_that_spark_plans_with_do_not_grow_with_the_rounds(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b").join(spark.range(200).toDF("a"), "a")  # a join: the product of two sizes
    found = components(spark, edges)
    assert found.count() == 201 and found.where("component = 0").count() == 201
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 20
