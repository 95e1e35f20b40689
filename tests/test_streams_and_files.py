"""Keyed stream state against a batch selection, also resumed; checksums of files beyond one array's size."""

import hashlib

from pyspark.sql import functions as F

from restartlab.operators.scoring import select_attempts
from restartlab.session import scratch_path
from restartlab.sources import library as B
from restartlab.streaming import progress as R

SCHEMA = "task_id bigint, attempt_number bigint, started timestamp, stop_reason string, best_seen double"


def attempts(spark, tasks, numbers):
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(tasks[0]), F.lit(tasks[1] - 1))).alias("task_id"))
    rows = rows.withColumn("attempt_number", F.explode(F.array(*[F.lit(n) for n in numbers])))
    bad = (F.col("task_id") + F.col("attempt_number")) % 3 == 0
    return rows.select(F.col("task_id").cast("bigint"), F.col("attempt_number").cast("bigint"), F.lit("2026-01-01").cast("timestamp").alias("started"),
                       F.when(bad, "numerical_error").otherwise("converged").alias("stop_reason"), (F.col("task_id") * 0.5 + F.col("attempt_number")).alias("best_seen"))


def test_selection_is_state_of_the_stream(spark):
    source, changes, log = (scratch_path(spark, n) for n in ("in", "changes", "log"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    waves = [attempts(spark, (0, 40), (2,)), attempts(spark, (10, 20), (1,)), attempts(spark, (15, 60), (3, 4))]
    seen, sizes = None, []
    for k, wave in enumerate(waves):  # each wave is a new run that goes on where the last one stopped
        wave.coalesce(1).write.parquet(f"{source}/wave={k}")
        stream = R.attempt_stream(spark, f"{source}/*", SCHEMA)
        R.run_incremental_selection(stream, changes, log)
        seen = wave if seen is None else seen.unionByName(wave)
        now = {tuple(r) for r in R.current_selection(spark, changes, SCHEMA).select("task_id", "attempt_number", "stop_reason").collect()}
        assert now == {tuple(r) for r in select_attempts(seen).select("task_id", "attempt_number", "stop_reason").collect()}
        sizes.append(spark.read.parquet(changes).count())
    assert sizes == [40, 50, 95]  # a batch writes the tasks it touches, not the whole state
    assert R.run_incremental_selection(R.attempt_stream(spark, f"{source}/*", SCHEMA), changes, log) == -1  # nothing new


def test_files_larger_than_an_array_are_hashed_in_pieces(spark, tmp_path):
    big = tmp_path / "big.bin"
    with open(big, "wb") as f:
        f.truncate(2_300_000_000)  # a sparse file, beyond what one binary value holds
    (tmp_path / "small.bin").write_bytes(b"abc" * 1000)
    (tmp_path / "empty.bin").write_bytes(b"")
    want = hashlib.sha256()
    for _ in range(230):
        want.update(bytes(10_000_000))
    got = {r["name"]: (r["length"], r["digest"]) for r in B.file_checksums(spark, str(tmp_path), "*.bin").collect()}
    assert got == {"big.bin": (2_300_000_000, want.hexdigest()), "small.bin": (3000, hashlib.sha256(b"abc" * 1000).hexdigest())}
