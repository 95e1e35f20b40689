"""Data-quality operators: every check yields rows that break it, or counts of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from restartlab.functions import angles as A
from restartlab.functions.scores import finite, is_fault


def coverage_guard(plan: DataFrame, data: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing, extra and repeated keys; both sides shrink to one row per key before they meet."""
    p = plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("__p"))
    d = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__d"))
    j = p.join(d, list(keys), "full")
    return j.agg(F.count("__p").alias("planned_keys"), F.count_if(F.col("__d").isNull()).alias("missing"),
                 F.count_if(F.col("__p").isNull()).alias("extra"), F.count_if(F.col("__d") > 1).alias("duplicates"),
                 F.count_if(F.col("__p") > 1).alias("duplicate_plan_keys"))


def key_set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, tagged with the side; empty when the sets are equal."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("only_in", F.lit("left")).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("only_in", F.lit("right")))


def column_mismatches(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], columns: Sequence[str],
                      tolerance: float | None = None) -> DataFrame:
    """One row per key and column whose stored value differs from the recomputed one."""
    r = recomputed.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    j = stored.select(*keys, *columns).join(r, list(keys), "full")

    def differs(c: str) -> Column:
        a, b = F.col(c), F.col(f"__{c}")
        if tolerance is None:
            return ~a.eqNullSafe(b)
        return (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))

    names = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in columns]))
    return j.select(*keys, F.explode(names).alias("column"))


def trace_facts(trace: DataFrame, keys: Sequence[str] = ("task_id", "attempt_number")) -> DataFrame:
    """What a trace says about its attempt, in one aggregation."""
    good, has = F.col("accepted") & F.col("valid"), finite(F.col("c"))
    return trace.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fact_calls"), F.min("call_id").alias("fact_first"), F.max("call_id").alias("fact_last"),
        F.max_by(F.when(good, F.col("c")), F.when(good, F.col("call_id"))).alias("fact_c_final"),
        F.max(F.when(has, F.col("c"))).alias("fact_best"),
        F.min_by("call_id", F.when(has, F.struct((-F.col("c")).alias("s"), F.col("call_id")))).alias("fact_best_call"),
        F.greatest(F.lit(0), F.count_if(good) - 1).alias("fact_iterations"))


def attempt_violations(claims: DataFrame, trace: DataFrame) -> DataFrame:
    """Claimed attempt columns that the trace contradicts, one row per violation."""
    j = claims.join(trace_facts(trace), ["task_id", "attempt_number"], "left")
    rules = {
        "no_trace": F.col("fact_calls").isNull(),
        "call_ids_not_contiguous": (F.col("fact_first") != 1) | (F.col("fact_last") != F.col("fact_calls")),
        "over_budget": F.col("fact_calls") > F.col("max_evaluations"),
        "objective_calls": ~F.col("objective_calls").eqNullSafe(F.col("fact_calls")),
        "final_point": ~F.col("c_final").eqNullSafe(F.col("fact_c_final")),
        "best_seen": ~F.col("best_seen").eqNullSafe(F.col("fact_best")),
    }
    names = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return j.select("task_id", "attempt_number", F.explode(names).alias("violation"))


def recoverable_counters(claims: DataFrame, trace: DataFrame) -> DataFrame:
    """Keep a raw counter only where the trace confirms it; otherwise null with a reason."""
    j = claims.join(trace_facts(trace), ["task_id", "attempt_number"], "left")
    pairs = {"objective_calls": "fact_calls", "gradient_requests": "fact_calls", "iterations": "fact_iterations"}
    cols = []
    for name, fact in pairs.items():
        same = F.coalesce(F.col(name) == F.col(fact), F.lit(False))
        cols += [F.when(same, F.col(name)).alias(name), F.when(~same, F.lit("not_verified_by_trace")).alias(f"{name}_reason")]
    return j.select("task_id", "attempt_number", *cols)


def receipt_problems(attempts: DataFrame, starts: DataFrame, io_times: DataFrame) -> DataFrame:
    """Attempts without a start, starts without an attempt (interrupted), save times without an attempt."""
    keys = ["task_id", "attempt_number"]
    a, s, o = (x.select(*keys).distinct() for x in (attempts, starts, io_times))
    parts = [a.join(s, keys, "left_anti").withColumn("problem", F.lit("attempt_without_start")),
             s.join(a, keys, "left_anti").withColumn("problem", F.lit("interrupted_work")),
             o.join(a, keys, "left_anti").withColumn("problem", F.lit("save_time_without_attempt"))]
    return reduce(DataFrame.unionByName, parts)


def feature_row_problems(types: DataFrame, sizes: DataFrame) -> DataFrame:
    """Joint-histogram identities: edge total, vertex total, impossible types."""
    a, b, t, k = F.col("a"), F.col("b"), F.col("t"), F.col("edges")
    agg = types.groupBy("graph_id").agg(
        F.sum(k).alias("total"), F.sum(k * (1 / (a + 1) + 1 / (b + 1))).alias("vertices"), F.max(a + b - t).alias("reach"),
        F.count_if((a == 0) & (b == 0) & (t == 0)).alias("lone"))
    j = sizes.join(agg, "graph_id")
    return j.select("graph_id", (F.col("total") != F.col("m")).alias("edge_total_differs"),
                    (F.abs(F.col("vertices") - F.col("n")) > 1e-10).alias("vertex_total_differs"),
                    ((F.col("reach") > F.col("n") - 2) | (F.col("lone") > 0)).alias("impossible_type"))


def design_issues(graphs: DataFrame, grid: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Differences between the design and a graph set: counts, missing and unexpected cells."""
    actual = graphs.agg(F.count(F.lit(1)).alias("graphs"), F.count_if(F.col("tier") == 2).alias("tier2"),
                        F.count_if(F.col("graph_split") == "training").alias("training"),
                        F.count_if(F.col("graph_split") == "evaluation").alias("evaluation"))
    rows = F.array(*[F.struct(F.lit("count").alias("issue"), F.lit(k).alias("item"), F.lit(v).cast("bigint").alias("expected"),
                              F.col(k).alias("actual")) for k, v in expected.items()])
    counts = actual.select(F.explode(rows).alias("r")).select("r.*").where("expected <> actual")
    present, wanted = graphs.select("cell").distinct(), grid.select("cell").distinct()

    def cells(df: DataFrame, issue: str) -> DataFrame:
        none = F.lit(None).cast("bigint")
        return df.select(F.lit(issue).alias("issue"), F.col("cell").alias("item"), none.alias("expected"), none.alias("actual"))

    return (counts.unionByName(cells(wanted.join(present, "cell", "left_anti"), "missing_cell"))
            .unionByName(cells(present.join(wanted, "cell", "left_anti"), "unexpected_cell")))


def shot_failure_flag() -> Column:
    return F.coalesce(F.col("error").isNotNull() | F.col("validation_error").isNotNull()
                      | F.col("exact_audit_error").isNotNull() | is_fault(F.col("stop_reason")), F.lit(False))


def record_matches(plan: DataFrame, records: DataFrame, identity: Sequence[str]) -> DataFrame:
    """A saved record counts only when every identity column equals the plan's."""
    r = records.select("task_id", *[F.col(c).alias(f"__{c}") for c in identity], F.lit(True).alias("__seen"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in identity])
    status = F.when(F.col("__seen").isNull(), "absent").when(same, "completed").otherwise("foreign")
    return plan.join(r, "task_id", "left").select("task_id", status.alias("status"))


def binding_mismatches(artifacts: DataFrame, bindings: DataFrame, key: str, recomputed: Column) -> DataFrame:
    """Artifacts whose recomputed id is not the one bound in the plan, and bound ones that are gone."""
    a = artifacts.select(key, recomputed.alias("actual_id"))
    return (bindings.join(a, key, "left").where(~F.col("bound_id").eqNullSafe(F.col("actual_id")))
            .select(key, F.when(F.col("actual_id").isNull(), "absent").otherwise("changed").alias("problem")))


def protocol_problems(rows: DataFrame) -> DataFrame:
    """Reference-study parameters: increasing prefixes, last one the pool size, even halves, declared old pool."""
    p = F.col("prefixes")
    rising = F.forall(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda x, y: x < y), lambda ok: ok)
    rules = {"prefixes_not_increasing": ~rising, "last_prefix_is_not_pool_size": F.element_at(p, -1) != F.col("pool_size"),
             "odd_pool": F.col("pool_size") % 2 != 0, "old_pool_size": F.col("old_pool") != F.col("declared_old_pool")}
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select("study", F.explode(names).alias("problem"))


def prediction_problems(rows: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Stored probability against the clipped raw output, and its legal ranges."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw_prediction")))
    rules = {"probability_is_not_clipped_raw": F.abs(F.col("success_probability") - clipped) > tolerance,
             "probability_out_of_range": ~F.col("success_probability").between(0.0, 1.0),
             "unseen_count_negative": F.col("unseen_type_count") < 0,
             "unseen_fraction_out_of_range": ~F.col("unseen_type_fraction").between(0.0, 1.0)}
    names = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    return rows.select("graph_id", F.explode(names).alias("problem"))


def witness_problems(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, c_star, cut of every graph whose stored side mask does not cut the stored number of edges."""
    bit = lambda v: F.call_function("shiftright", F.col("mask"), F.col(v).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
    cut = edges.join(stored.select("graph_id", "mask"), "graph_id").groupBy("graph_id").agg(F.sum((bit("u") != bit("v")).cast("bigint")).alias("cut"))
    j = stored.select("graph_id", "c_star").join(cut, "graph_id", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    return j.where(~F.col("c_star").eqNullSafe(F.col("cut")))


#: Features that may be undefined, and when they are.
UNDEFINED = {"transitivity": "wedges = 0", "degree_assortativity": "degree_assortativity_missing = 1"}


def null_problems(features: DataFrame) -> DataFrame:
    """graph_id, feature, problem: a null where the value is defined, or a value where it is not."""
    rules = [F.when(F.col(c).isNull() & ~F.expr(rule), F.struct(F.lit(c).alias("feature"), F.lit("null_without_reason").alias("problem")))
             .when(F.col(c).isNotNull() & F.expr(rule), F.struct(F.lit(c).alias("feature"), F.lit("value_where_undefined").alias("problem"))) for c, rule in UNDEFINED.items()]
    return features.select("graph_id", F.explode(F.array_compact(F.array(*rules))).alias("r")).select("graph_id", "r.*")


def angle_prediction_problems(rows: DataFrame, p: int, tolerance: float = 1e-9) -> DataFrame:
    """id, problem of angle predictions (id, raw, anchor, theta, fallback): theta must be what raw decodes to, in range, with the fallback flag."""
    told = rows.withColumn("__d", A.decode(F.col("raw"), F.col("anchor"), p))
    far = F.size("theta") != 2 * p
    apart = far | (A.quotient_distance(F.col("theta"), F.col("__d.theta"), p) > tolerance)
    outside = F.exists("theta", lambda x: ~finite(x)) | (F.array_max(F.transform("theta", lambda x, i: F.abs(x) - F.when(i < p, A.GAMMA_PERIOD / 2).otherwise(A.BETA_PERIOD / 2))) > tolerance)
    rules = [F.when(apart, F.lit("angle_is_not_decoded_raw")), F.when(outside, F.lit("angle_out_of_range")), F.when(F.col("fallback") != F.col("__d.fallback"), F.lit("fallback_differs"))]
    return told.select("id", F.explode(F.array_compact(F.array(*rules))).alias("problem"))
