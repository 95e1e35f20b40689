"""Binding of batches: artifacts with content ids, who was made from what, and what no longer holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from restartlab.operators.models import stored_table
from restartlab.operators.quality import column_mismatches
from restartlab.sources.library import row_digest

KINDS = 8  # an artifact is at most this many steps away from what it was made from


def artifact_ids(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """batch, artifact, id of each artifact: a digest of its rows, whatever their order. ``rows`` have batch and artifact columns."""
    named = rows.select("batch", "artifact", F.col(key).cast("string").alias("name"), row_digest(list(columns)).alias("digest"))
    parts = named.groupBy("batch", "artifact", F.substring(F.sha2("name", 256), 1, 4).alias("part")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "name", "digest"))), "\n"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda s: F.concat_ws("|", s["part"], s["d"])), "\n"), 256)
    return parts.groupBy("batch", "artifact").agg(F.sum("n").alias("entries"), whole.alias("id"))


def binding_problems(manifest: DataFrame, inputs: DataFrame, now: DataFrame) -> DataFrame:
    """batch, artifact, problem, cause of every artifact that does not hold.

    ``manifest`` (batch, artifact, id) is what was recorded, ``inputs`` (batch, artifact,
    input_batch, input_artifact, input_id) what each was made from, and ``now`` the ids
    computed again from the stored rows. ``absent`` and ``changed`` artifacts are named;
    so is a binding to an id that its input was never recorded with (``other_input``), and
    everything made, in any number of steps, from one of these (``made_from``).
    """
    key = ["batch", "artifact"]
    seen = manifest.select(*key, "id").join(now.select(*key, F.col("id").alias("now_id")), key, "full")
    own = seen.select(*key, F.when(F.col("id").isNull(), "not_recorded").when(F.col("now_id").isNull(), "absent").when(F.col("id") != F.col("now_id"), "changed").alias("problem"))
    own = own.where("problem is not null").withColumn("cause", F.concat_ws("/", *key))
    known = manifest.select(F.col("batch").alias("input_batch"), F.col("artifact").alias("input_artifact"), "id")
    other = inputs.join(known, ["input_batch", "input_artifact"], "left").where("id is null or id <> input_id")
    bad = own.unionByName(other.select(*key, F.lit("other_input").alias("problem"), F.concat_ws("/", "input_batch", "input_artifact").alias("cause")))
    bad = stored_table(bad, "problems")
    every, front = bad, bad.select(*key, "cause").distinct()
    links = inputs.select(*key, F.col("input_batch").alias("b"), F.col("input_artifact").alias("a"))
    for _ in range(KINDS):
        reached = links.join(front.select(F.col("batch").alias("b"), F.col("artifact").alias("a"), "cause"), ["b", "a"]).select(*key, "cause").distinct()
        front = stored_table(reached, "reached")
        if not front.limit(1).count():
            return every.distinct()
        every = every.unionByName(front.withColumn("problem", F.lit("made_from")).select(*key, "problem", "cause"))
    raise ValueError("artifacts are bound in a circle")


def incompatible(settings: DataFrame, first: str, columns: Sequence[str]) -> DataFrame:
    """batch, column: settings of 2 to 5 batches that differ from those of batch ``first``."""
    base = settings.where(F.col("batch") == first).select(F.lit(1).alias("k"), *columns)
    found = None
    for (batch,) in sorted(settings.where(F.col("batch") != first).select("batch").distinct().limit(5).collect()):
        one = settings.where(F.col("batch") == batch).select(F.lit(1).alias("k"), *columns)
        part = column_mismatches(base, one, ["k"], list(columns)).select(F.lit(batch).alias("batch"), "column")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else base.select(F.lit("").alias("batch"), F.lit("").alias("column")).where("false")


def require_bound(problems: DataFrame, differences: DataFrame) -> int:
    """Stop before any score is read if an artifact does not hold or settings differ; the error names the first of each. Returns 0."""
    bad = [f"{r['batch']}/{r['artifact']}: {r['problem']}" for r in problems.orderBy("problem", "batch", "artifact").limit(5).collect()]
    bad += [f"{r['batch']}: {r['column']} differs" for r in differences.orderBy("batch", "column").limit(5).collect()]
    if bad:
        raise ValueError("; ".join(bad))
    return 0
