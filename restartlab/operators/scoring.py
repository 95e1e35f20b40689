"""From attempts to scored restarts, pools and hit curves.

Rates always divide by planned rows: the plan is the left side of every join,
and a missing or faulted run stays in the denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from restartlab.functions.scores import finite, is_fault, threshold, wilson_lower, wilson_upper

# fixed values: adopted success rule and the historical one
DEFAULT_METRIC = ("normalized_gap", 0.01)
LEGACY_METRIC = ("absolute", 0.5)


def select_attempts(attempts: DataFrame) -> DataFrame:
    """First nonfault attempt per task, else the first fault; scores never choose.

    An aggregation rather than a window: it combines before the shuffle, so a
    task retried very often does not become one big sorted partition.
    """
    rest = [c for c in attempts.columns if c != "task_id"]
    order = F.struct(is_fault(F.col("stop_reason")).cast("int"), F.col("attempt_number"), F.col("started"))
    picked = attempts.groupBy("task_id").agg(F.min_by(F.struct(*rest), order).alias("pick"))
    return picked.select("task_id", "pick.*")


def pool_keys(tasks: DataFrame) -> list[str]:
    """Graph and depth name a pool; plans of a single depth may leave the depth out."""
    return ["graph_id", "p"] if "p" in tasks.columns else ["graph_id"]


def _candidates(tasks: DataFrame, selected: DataFrame, role: str) -> DataFrame:
    """Planned tasks of a role with their runs: the candidate score, and whether the run counts as valid.

    From depth two on a candidate is the best score seen. At depth one it is the
    grid's maximum; it is a candidate without, but valid only with, a passed
    refinement.
    """
    deep = "p" in tasks.columns
    grid = ["grid_c", "refinement_passed"] if deep and "grid_c" in selected.columns else []
    runs = selected.select("task_id", "attempt_number", "best_seen", "stop_reason", *grid)
    pool = tasks.where(F.col("experiment_role") == role).join(runs, "task_id", "left")
    ran = F.col("stop_reason").isNotNull() & ~is_fault(F.col("stop_reason"))
    score, ok = F.col("best_seen"), F.lit(True)
    if grid:
        one = F.col("p") == 1
        score, ok = F.when(one, F.col("grid_c")).otherwise(F.col("best_seen")), ~one | F.coalesce(F.col("refinement_passed"), F.lit(False))
    elif deep:  # without grids a depth-one run is no candidate
        score = F.when(F.col("p") > 1, F.col("best_seen"))
    candidate = F.coalesce(ran & finite(score), F.lit(False))
    return pool.withColumns({"__score": F.when(candidate, score), "__candidate": candidate, "__valid": candidate & ok})


def freeze_references(tasks: DataFrame, selected: DataFrame, role: str = "reference") -> DataFrame:
    """Best reference candidate per graph and depth; equal scores go to the lowest restart."""
    keys, pool = pool_keys(tasks), _candidates(tasks, selected, role)
    best = F.max_by(F.struct("task_id", "restart_id", "attempt_number"),
                    F.when(F.col("__candidate"), F.struct(F.col("__score"), (-F.col("restart_id")).alias("r"))))
    return (pool.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("planned"), F.count_if("__valid").alias("valid"),
                 F.max("__score").alias("c_ref"), best.alias("source"))
            .select(*keys, "planned", "valid", (F.col("valid") == F.col("planned")).alias("complete"), "c_ref",
                    F.col("source.task_id").alias("source_task_id"),
                    F.col("source.attempt_number").alias("source_attempt")))


def reference_members(tasks: DataFrame, selected: DataFrame, role: str = "reference") -> DataFrame:
    """Planned and valid task ids of every reference, one row each."""
    return _candidates(tasks, selected, role).select(*pool_keys(tasks), "task_id", "attempt_number", F.col("__valid").alias("is_valid"))


def with_metrics(df: DataFrame, metrics: Sequence[tuple[str, float]]) -> DataFrame:
    """One copy of every row per success rule (kind, tolerance)."""
    rules = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(t)).alias("tolerance")) for k, t in metrics])
    return (df.withColumn("__rule", F.explode(rules))
            .withColumns({"kind": F.col("__rule.kind"), "tolerance": F.col("__rule.tolerance")}).drop("__rule"))


def plan_left_outcome(tasks: DataFrame, selected: DataFrame) -> DataFrame:
    """Every planned task keeps a row; no attempt means missing."""
    runs = selected.drop("graph_id", "restart_id", "p").withColumn("__run", F.lit(True))
    valid = F.col("__run").isNotNull() & ~is_fault(F.col("stop_reason")) & finite(F.col("c_final"))
    return (tasks.join(runs, "task_id", "left")
            .withColumns({"missing": F.col("__run").isNull(),
                          "execution_valid": F.coalesce(valid, F.lit(False)),
                          "execution_fault": F.col("__run").isNotNull() & ~F.coalesce(valid, F.lit(False))})
            .drop("__run"))


def attach_reference(outcomes: DataFrame, references: DataFrame, cstar: DataFrame) -> DataFrame:
    """Equi joins on graph and depth; an incomplete reference leaves its score null.

    References and outcomes name their depth alike: if only one side has it, scores
    of different depths would meet, and the join is refused.
    """
    if ("p" in outcomes.columns) != ("p" in references.columns):
        raise ValueError("outcomes and references must both have a depth p, or neither")
    keys = pool_keys(outcomes)
    ready = F.coalesce(F.col("complete") & finite(F.col("c_ref")), F.lit(False))
    refs = references.select(*keys, "complete", "c_ref")
    return (outcomes.join(refs, keys, "left").join(cstar, "graph_id", "left")
            .withColumns({"reference_complete": ready, "c_ref": F.when(ready, F.col("c_ref"))}).drop("complete"))


def trace_scores(rows: DataFrame, trace: DataFrame) -> DataFrame:
    """First hit, reference exceedance and initial score of every thresholded attempt.

    ``rows`` carry task_id, attempt_number, threshold and c_ref (one row per
    success rule). Calls of unselected attempts are dropped by the join.
    """
    keys = ["task_id", "attempt_number", "kind", "tolerance"]
    wanted = rows.where(F.col("attempt_number").isNotNull()).select(*keys, "threshold", "c_ref")
    calls = trace.select("task_id", "attempt_number", "call_id", "c")
    ok = finite(F.col("c"))
    return (calls.join(wanted, ["task_id", "attempt_number"])
            .groupBy(*keys)
            .agg(F.min(F.when(ok & (F.col("c") >= F.col("threshold")), F.col("call_id"))).alias("first_hit"),
                 F.coalesce(F.max(ok & (F.col("c") > F.col("c_ref"))), F.lit(False)).alias("exceeded"),
                 F.max(F.when((F.col("call_id") == 1) & ok, F.col("c"))).alias("c_initial")))


def score_restarts(tasks: DataFrame, selected: DataFrame, references: DataFrame, cstar: DataFrame,
                   trace: DataFrame, metrics: Sequence[tuple[str, float]] = (DEFAULT_METRIC,)) -> DataFrame:
    """One row per planned task and success rule, with every outcome column."""
    rows = attach_reference(plan_left_outcome(tasks, selected), references, cstar)
    rows = with_metrics(rows, metrics).withColumn(
        "threshold", threshold(F.col("c_ref"), F.col("c_star"), F.col("kind"), F.col("tolerance")))
    hits = trace_scores(rows, trace)
    ran = F.col("reference_complete") & ~F.col("missing")
    success = F.col("execution_valid") & F.coalesce(F.col("c_final") >= F.col("threshold"), F.lit(False))
    return (rows.join(hits, ["task_id", "attempt_number", "kind", "tolerance"], "left")
            .withColumns({
                "epsilon": F.col("tolerance") * F.when(F.col("kind") == "normalized_gap", F.col("c_star")).otherwise(F.lit(1.0)),
                "first_hit": F.when(ran, F.col("first_hit")),
                "hit": F.when(ran, F.col("first_hit").isNotNull()),
                "terminal_success": F.when(ran, success),
                "reference_exceeded": F.when(ran, F.coalesce(F.col("exceeded"), F.lit(False))),
                "ratio_exact": F.col("c_final") / F.nullif(F.col("c_star"), F.lit(0.0)),
                "gap_ref": F.col("c_ref") - F.col("c_final"),
                "gap_ratio": (F.col("c_ref") - F.col("c_final")) / F.nullif(F.col("c_star"), F.lit(0.0)),
            }).drop("exceeded"))


def pool_statistics(scored: DataFrame, keys: Sequence[str], expected: int, scientific: int = 50) -> DataFrame:
    """Counts, flags, rates and Wilson interval of each pool, in one aggregation."""
    counts = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("planned"), F.count_if("execution_valid").alias("valid"),
        F.count_if("execution_fault").alias("execution_faults"), F.count_if("missing").alias("missing"),
        F.bool_and("reference_complete").alias("reference_complete"),
        F.count_if(F.coalesce(F.col("terminal_success"), F.lit(False))).alias("__s"))
    complete = (F.col("planned") > 0) & (F.col("valid") == F.col("planned"))
    configured = complete & (F.col("planned") == expected) & F.col("reference_complete")
    label = configured & (F.col("planned") == scientific)
    s = F.when(F.col("reference_complete"), F.col("__s"))
    return counts.select(
        *keys, "planned", "valid", "execution_faults", "missing", "reference_complete", s.alias("successes"),
        complete.alias("complete_execution"), configured.alias("configured_pool_complete"),
        label.alias("scientific_label_complete"), F.when(label, s / F.col("planned")).alias("success_rate_label"),
        (s / F.col("planned")).alias("fixed_budget_success_fraction"),
        wilson_lower(s, F.col("planned")).alias("wilson_low"), wilson_upper(s, F.col("planned")).alias("wilson_high"),
        (~label).alias("provisional"))


def hit_curve(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Empirical hit curve over all planned restarts, with its zero point.

    Hits are first reduced to (pool, call) counts; only those are ordered.
    """
    pools = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("planned"))
    events = (scored.where(F.col("first_hit").isNotNull())
              .groupBy(*keys, F.col("first_hit").alias("objective_calls")).agg(F.count(F.lit(1)).alias("k")))
    zero = pools.select(*keys, F.lit(0).cast("bigint").alias("objective_calls"), F.lit(0).cast("bigint").alias("k"))
    upto = W.partitionBy(*keys).orderBy("objective_calls").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (zero.unionByName(events).withColumn("hits", F.sum("k").over(upto)).drop("k")
            .join(pools, list(keys)).withColumn("fraction", F.col("hits") / F.col("planned")))


def hit_quantiles(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inverse-ECDF values at rank ceil(q * base); null when the pool never reaches the rank."""
    curve = hit_curve(scored, keys).where("objective_calls > 0 or hits = 0")
    total = W.partitionBy(*keys)
    curve = curve.withColumn("all_hits", F.max("hits").over(total))

    def at(q: float, base: str) -> Column:
        need = F.ceil(F.lit(q) * F.col(base))
        return F.min(F.when((F.col("hits") >= need) & (F.col("objective_calls") > 0), F.col("objective_calls")))

    return curve.groupBy(*keys).agg(
        F.max("planned").alias("planned"), F.max("hits").alias("hits"),
        at(0.5, "planned").alias("median"), at(0.9, "planned").alias("p90"),
        at(0.5, "all_hits").alias("hit_median"), at(0.9, "all_hits").alias("hit_p90"))


def weighted_hit_curve(scored: DataFrame, group: Sequence[str], graph: str = "graph_id") -> DataFrame:
    """Equal graph weights, then equal restart weights; null group when any reference is incomplete."""
    pools = scored.groupBy(*group, graph).agg(F.count(F.lit(1)).alias("planned"),
                                              F.bool_and("reference_complete").alias("ready"))
    totals = pools.groupBy(*group).agg(F.count(F.lit(1)).alias("graphs"), F.bool_and("ready").alias("ready"))
    ready = totals.where("ready")
    mass = (scored.where(F.col("first_hit").isNotNull())
            .groupBy(*group, graph, F.col("first_hit").alias("objective_calls")).agg(F.count(F.lit(1)).alias("k"))
            .join(pools.drop("ready"), [*group, graph]).join(ready, list(group))
            .groupBy(*group, "objective_calls")
            .agg(F.sum(F.col("k") / (F.col("graphs") * F.col("planned"))).alias("mass")))
    zero = ready.select(*group, F.lit(0).cast("bigint").alias("objective_calls"), F.lit(0.0).alias("mass"))
    upto = W.partitionBy(*group).orderBy("objective_calls").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (zero.unionByName(mass)
            .withColumn("fraction", F.least(F.lit(1.0), F.sum("mass").over(upto))).drop("mass"))


def weighted_hit_quantiles(curve: DataFrame, group: Sequence[str]) -> DataFrame:
    def at(q: float) -> Column:
        return F.min(F.when(F.col("fraction") >= q - 1e-12, F.col("objective_calls")))

    return curve.groupBy(*group).agg(at(0.5).alias("median"), at(0.9).alias("p90"))


def best_and_bias(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best valid best-seen score (ties: smallest task) and its distance to the reference."""
    ok = F.col("execution_valid") & finite(F.col("best_seen"))
    best = F.min_by(F.struct("best_seen", "task_id"), F.when(ok, F.struct((-F.col("best_seen")).alias("s"), F.col("task_id"))))
    return (scored.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("planned"), F.count_if(ok).alias("valid"), best.alias("b"),
                 F.max("c_ref").alias("c_ref"), F.max("c_star").alias("c_star"))
            .select(*keys, "planned", "valid", F.col("b.best_seen").alias("best_seen"),
                    F.col("b.task_id").alias("source_task_id"), (F.col("c_ref") - F.col("b.best_seen")).alias("bias"),
                    (F.col("b.best_seen") / F.nullif(F.col("c_star"), F.lit(0.0))).alias("ratio_exact")))


def project_events(trace: DataFrame, scored: DataFrame) -> DataFrame:
    """Keep the first call, the first hit of every rule and the best call of each attempt."""
    keys = ["task_id", "attempt_number"]
    best = (trace.where(finite(F.col("c"))).groupBy(*keys)
            .agg(F.min_by("call_id", F.struct((-F.col("c")).alias("s"), F.col("call_id"))).alias("call_id")))
    hits = scored.where(F.col("first_hit").isNotNull()).select(*keys, F.col("first_hit").alias("call_id"))
    first = trace.where("call_id = 1").select(*keys, "call_id")
    keep = (first.withColumn("reason", F.lit("first"))
            .unionByName(best.withColumn("reason", F.lit("best")))
            .unionByName(hits.withColumn("reason", F.lit("hit"))).distinct())
    marks = keep.groupBy(*keys, "call_id").agg(
        F.bool_or(F.col("reason") == "first").alias("is_first"), F.bool_or(F.col("reason") == "best").alias("is_best"),
        F.bool_or(F.col("reason") == "hit").alias("is_hit"))
    return trace.join(marks, [*keys, "call_id"])
