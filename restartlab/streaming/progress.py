"""Progress of a running study as Structured Streaming jobs over arriving attempt files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from restartlab.functions.scores import is_fault
from restartlab.operators.scoring import select_attempts


def attempt_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_incremental_selection(stream: DataFrame, changes: str, checkpoint: str) -> int:
    """Keep one selected attempt per task as state of the stream; returns the last batch's number, or -1.

    The selection is a minimum over a total order, so it is an aggregation by task whose
    state lives in the stream's state store: a micro-batch touches the tasks it
    brings and no others. What changed is written as one part of a change table; a
    replayed batch writes the same part again.
    """
    last = {"version": -1}

    def step(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/version={version}")
        last["version"] = version

    query = (select_attempts(stream).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return last["version"]


def current_selection(spark: SparkSession, changes: str, schema: str) -> DataFrame:
    """The selected attempt of every task: the last of its changes."""
    rows = spark.read.schema(f"{schema}, version bigint").parquet(changes)
    columns = [c for c in rows.columns if c not in ("task_id", "version")]
    return rows.groupBy("task_id").agg(F.max_by(F.struct(*columns), "version").alias("pick")).select("task_id", "pick.*")


def running_counts(stream: DataFrame, plan: DataFrame) -> DataFrame:
    """Attempt and fault counts per role, as a streaming aggregation over a static plan join."""
    joined = stream.join(plan.select("task_id", "experiment_role"), "task_id")
    return joined.groupBy("experiment_role").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(is_fault(F.col("stop_reason"))).alias("fault_attempts"),
        F.sum("objective_calls").alias("objective_calls"))


def run_to_table(counts: DataFrame, path: str, checkpoint: str) -> int:
    """Drive a streaming aggregation over the files at hand; each trigger's full result is one version."""
    last = {"version": -1}

    def step(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v{version}")
        last["version"] = version

    query = (counts.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return last["version"]


def throughput(rows: DataFrame, ts: str, workload: Column, window: str, lateness: str | None = None) -> DataFrame:
    """Completions per tumbling window and workload class, with the rate per second; batch or stream."""
    data = rows.withWatermark(ts, lateness) if lateness else rows
    agg = data.groupBy(F.window(ts, window).alias("w"), workload.alias("workload")).agg(F.count(F.lit(1)).alias("completed"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return agg.select(F.col("w.start").alias("window_start"), "workload", "completed", (F.col("completed") / seconds).alias("tasks_per_second"))


def eta(rates: DataFrame, planned: DataFrame) -> DataFrame:
    """Remaining seconds per workload from its latest positive window rate."""
    latest = rates.where("completed > 0").groupBy("workload").agg(
        F.max_by("tasks_per_second", "window_start").alias("rate"), F.sum("completed").alias("done"))
    left = F.greatest(F.lit(0), F.col("planned") - F.coalesce("done", F.lit(0)))
    return planned.join(latest, "workload", "left").select(
        "workload", "planned", F.coalesce("done", F.lit(0)).alias("done"), F.when(F.col("rate") > 0, left / F.col("rate")).alias("eta_seconds"))
