"""Plan sizes, budgets, splits and identity rules."""

import pytest
from pyspark.sql import functions as F

from restartlab.operators import planning as L

METHODS, LEVELS = ("COBYLA", "COBYQA", "SPSA"), (256, 1024, 4096)


def graphs(spark, n=96, cells=48):
    return spark.createDataFrame([(i, f"c{i % cells}", 2, "evaluation") for i in range(n)], "graph_id bigint, cell string, tier bigint, graph_split string")


@pytest.mark.parametrize("repetitions,total", [(5, 21024), (10, 41184), (20, 81504)])
def test_published_plan_sizes(spark, repetitions, total):
    starts = L.shot_starts(graphs(spark))
    plan = L.shot_plan(starts, repetitions, METHODS, LEVELS)
    assert plan.count() == total
    assert L.shot_budget(starts, repetitions, METHODS, LEVELS, 128, 8192).first()["tasks"] == total


def test_plan_ids_and_links(spark):
    plan = L.shot_plan(L.shot_starts(graphs(spark, 6, 3)), 3, METHODS, LEVELS).cache()
    assert plan.select("task_id").distinct().count() == plan.count()
    for link in ("exact_control_task_id", "fixed_control_task_id"):
        assert plan.where(F.col(link).isNotNull()).select(F.col(link).alias("task_id")).join(plan, "task_id", "left_anti").count() == 0


def test_without_compact_controls(spark):
    starts = L.shot_starts(graphs(spark, 4, 2))
    plan = L.shot_plan(starts, 3, METHODS, LEVELS, compact=False)
    assert plan.count() == L.shot_budget(starts, 3, METHODS, LEVELS, 128, 1, compact=False).first()["tasks"]


def test_largest_remainder_totals(spark):
    cells = spark.createDataFrame([(f"c{i}", k) for i, k in enumerate((7, 7, 7, 1, 30))], "cell string, capacity bigint")
    rows = L.allocate_counts(cells, 20, 3).collect()
    assert sum(r["allocated"] for r in rows) == 20 and all(0 <= r["allocated"] <= r["capacity"] for r in rows)
    assert sum(r["allocated"] for r in L.allocate_counts(cells, 99, 3).collect()) == 52


def test_split_counts_and_shortfall(spark):
    g = graphs(spark, 90, 9)
    rows = L.assign_splits(g, 30, 20, 1).groupBy("graph_split").count().collect()
    assert {r["graph_split"]: r["count"] for r in rows} == {"training": 20, "evaluation": 10, "not_applicable": 60}
    rows = L.assign_splits(g, 200, 100, 1).groupBy("graph_split").count().collect()  # 90 graphs only: ratio kept
    assert {r["graph_split"]: r["count"] for r in rows} == {"training": 45, "evaluation": 45}


def test_bundles_are_bounded_and_whole(spark):
    tasks = spark.range(500).select((F.col("id") % 2).alias("graph_id"), F.col("id").alias("task_id"), F.lit("x").alias("experiment_role"), F.lit(0).alias("restart_id"))
    b = L.work_bundles(tasks, 50)
    assert b.select(F.sum(F.size("tasks"))).first()[0] == 500 and b.count() > 2
