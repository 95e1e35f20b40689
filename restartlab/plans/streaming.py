"""Queries of the streaming family; streams drain the files at hand and end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from restartlab import schemas
from restartlab.plans.fixtures import Catalog
from restartlab.plans.query import Query
from restartlab.session import scratch_path
from restartlab.sources.library import write_once
from restartlab.streaming import progress as R

ATTEMPTS = schemas.ATTEMPT.replace("started string", "started timestamp")


def _arrivals(cat: Catalog) -> str:
    """Attempts as files in several arrival waves."""
    path = scratch_path(cat.spark, "arrivals")
    write_once(cat.attempts().select(*[c.split()[0] for c in ATTEMPTS.split(", ")]).repartition("task_id", "attempt_number"), path)
    return path


def _progress(cat: Catalog) -> DataFrame:
    stream = R.attempt_stream(cat.spark, _arrivals(cat), ATTEMPTS, 2)
    out = scratch_path(cat.spark, "progress")
    version = R.run_to_table(R.running_counts(stream, cat.tasks()), out, scratch_path(cat.spark, "progress-log"))
    return cat.spark.read.schema("experiment_role string, attempts bigint, fault_attempts bigint, objective_calls bigint").parquet(f"{out}/v{version}")


def _selection(cat: Catalog) -> DataFrame:
    stream = R.attempt_stream(cat.spark, _arrivals(cat), ATTEMPTS, 2)
    state = scratch_path(cat.spark, "selection")
    R.run_incremental_selection(stream, state, scratch_path(cat.spark, "selection-log"))
    return R.current_selection(cat.spark, state, ATTEMPTS).select(
        "task_id", "attempt_number", "stop_reason", "objective_calls", "best_seen")


def _throughput(cat: Catalog) -> DataFrame:
    rows = R.throughput(cat.table("events"), "ts", F.col("event_type"), "6 hours")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "workload", "completed", "tasks_per_second")


def _throughput_stream(cat: Catalog) -> DataFrame:
    """The same windows as a stream with a watermark; closed windows are appended to a table."""
    source = scratch_path(cat.spark, "event-files")
    write_once(cat.table("events").select("event_id", "ts", "event_type").repartitionByRange("ts"), source)
    stream = R.attempt_stream(cat.spark, source, "event_id bigint, ts timestamp, event_type string")
    out = scratch_path(cat.spark, "windows")
    rates = R.throughput(stream, "ts", F.col("event_type"), "6 hours", "1 hour")
    query = (rates.writeStream.outputMode("append").format("parquet").option("checkpointLocation", scratch_path(cat.spark, "windows-log"))
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    done = cat.spark.read.schema("window_start timestamp, workload string, completed bigint, tasks_per_second double").parquet(out)
    return done.agg(F.count(F.lit(1)).alias("closed_windows"), F.coalesce(F.sum("completed"), F.lit(0)).alias("completed"))


def _eta(cat: Catalog) -> DataFrame:
    rates = R.throughput(cat.table("events"), "ts", F.col("event_type"), "6 hours")
    planned = cat.table("events").groupBy(F.col("event_type").alias("workload")).agg((F.count(F.lit(1)) * 2).alias("planned"))
    return R.eta(rates, planned)


QUERIES = [
    Query("str1_streaming_progress", _progress, """
SELECT t.experiment_role, count(*) AS attempts, count(*) FILTER (a.stop_reason <> 'converged') AS fault_attempts, CAST(sum(a.objective_calls) AS BIGINT) AS objective_calls
FROM fx_attempts a JOIN fx_tasks t ON t.task_id = a.task_id GROUP BY 1"""),
    Query("str2_incremental_selection", _selection,
          "SELECT task_id, attempt_number, stop_reason, objective_calls, best_seen FROM fx_selected", "best_seen"),
    Query("str3_throughput_windows", _throughput, """
SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS workload, count(*) AS completed,
 count(*)/21600.0 AS tasks_per_second FROM events GROUP BY 1, 2""", "tasks_per_second", 9),
    Query("str3_throughput_stream", _throughput_stream, """
SELECT count(*) AS closed_windows, CAST(sum(k) AS BIGINT) AS completed FROM (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS w, event_type, count(*) AS k FROM events GROUP BY 1, 2)
WHERE w + INTERVAL '6 hours' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'"""),
    Query("str3_eta", _eta, """
WITH w AS (SELECT event_type AS workload, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS s, count(*) AS k FROM events GROUP BY 1, 2)
SELECT workload, CAST(sum(k)*2 AS BIGINT) AS planned, CAST(sum(k) AS BIGINT) AS done, sum(k)/(arg_max(k, s)/21600.0) AS eta_seconds FROM w GROUP BY 1""", "eta_seconds", 3),
]
