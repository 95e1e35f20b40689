"""Queries of the scoring family."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from restartlab.functions.scores import is_fault, known, resource_fault, threshold, wilson_lower, wilson_upper
from restartlab.operators import scoring as S
from restartlab.plans.fixtures import Catalog
from restartlab.plans.query import Query

GAP = ("normalized_gap", 0.3)


def selected(cat: Catalog) -> DataFrame:
    return S.select_attempts(cat.attempts())


def references(cat: Catalog) -> DataFrame:
    return S.freeze_references(cat.tasks(), selected(cat))


def scored(cat: Catalog, metrics=(GAP,), role: str = "evaluation") -> DataFrame:
    picks = selected(cat)
    refs = S.freeze_references(cat.tasks(), picks)
    plan = cat.tasks().where(F.col("experiment_role") == role)
    return S.score_restarts(plan, picks, refs, cat.cstar(), cat.trace(), metrics)


def flagship(cat: Catalog) -> DataFrame:
    """Reference-relative success by graph."""
    pools = S.pool_statistics(scored(cat), ["graph_id"], expected=4)
    return pools.select("graph_id", "planned", "valid", "execution_faults", "missing", "reference_complete",
                        "successes", "fixed_budget_success_fraction", "wilson_low", "wilson_high", "provisional")


def deep_references(cat: Catalog) -> DataFrame:
    return S.freeze_references(cat.deep_tasks(), cat.deep_selected(selected(cat)))


def deep_scored(cat: Catalog) -> DataFrame:
    """Evaluation restarts of depths two and three against the reference of their own depth."""
    picks = cat.deep_selected(selected(cat))
    refs = S.freeze_references(cat.deep_tasks(), picks)
    plan = cat.deep_tasks().where("experiment_role = 'evaluation'")
    return S.score_restarts(plan, picks, refs, cat.cstar(), cat.deepened(cat.trace(), ("c",)), (GAP,))


def _deep_flagship(cat: Catalog) -> DataFrame:
    """Reference-relative success by graph and depth."""
    pools = S.pool_statistics(deep_scored(cat), ["graph_id", "p"], expected=4)
    return pools.select("graph_id", "p", "planned", "valid", "execution_faults", "missing", "reference_complete", "successes", "fixed_budget_success_fraction")


def _deep_prefixes(cat: Catalog) -> DataFrame:
    """Best score of the first restarts and of the halves, per graph and depth."""
    runs = cat.deep_tasks().where("p > 1").join(cat.deep_selected(selected(cat)).select("task_id", "best_seen", "stop_reason"), "task_id", "left")
    score = F.when(~is_fault(F.col("stop_reason")), F.col("best_seen"))
    aggs = [F.max(F.when(F.col("restart_id") < n, score)).alias(f"best_{n}") for n in (1, 2, 4, 6)]
    halves = [F.max(F.when(F.col("restart_id") < 3, score)).alias("half_1"), F.max(F.when(F.col("restart_id") >= 3, score)).alias("half_2")]
    return runs.groupBy("graph_id", "p").agg(*aggs, *halves)


def _fault_flag(cat: Catalog) -> DataFrame:
    return cat.attempts().select("task_id", "attempt_number", "stop_reason", is_fault(F.col("stop_reason")).alias("fault"))


def _wilson(cat: Catalog) -> DataFrame:
    s, n = F.col("successes"), F.col("trials")
    return cat.labels().select("graph_id", "successes", "trials", wilson_lower(s, n).alias("low"), wilson_upper(s, n).alias("high"))


def _weighted(cat: Catalog) -> DataFrame:
    rows = scored(cat).withColumn("grp", F.col("graph_id") % 20)
    return S.weighted_hit_curve(rows, ["grp"])


def _weighted_quantiles(cat: Catalog) -> DataFrame:
    return S.weighted_hit_quantiles(_weighted(cat), ["grp"])


def _thresholds(cat: Catalog) -> DataFrame:
    rows = references(cat).where("complete").join(cat.cstar(), "graph_id")
    rows = S.with_metrics(rows, [S.LEGACY_METRIC, S.DEFAULT_METRIC, ("normalized_gap", 0.02)])
    return rows.select("graph_id", "kind", "tolerance", threshold(
        F.col("c_ref"), F.col("c_star"), F.col("kind"), F.col("tolerance")).alias("threshold"))


RESCORE = [("normalized_gap", t) for t in (0.005, 0.01, 0.02)] + [("absolute", 0.5)]


def _rescore(cat: Catalog) -> DataFrame:
    rows = scored(cat, RESCORE)
    return rows.groupBy("kind", "tolerance").agg(
        F.count(F.lit(1)).alias("planned"), F.count_if("terminal_success").alias("successes"),
        F.count("first_hit").alias("hits"), F.count("terminal_success").alias("resolved"))


def _event_projection(cat: Catalog) -> DataFrame:
    rows = scored(cat)
    return S.project_events(cat.trace(), rows).select(
        "task_id", "attempt_number", "call_id", "c", "is_first", "is_best", "is_hit")


def _prefix_best(cat: Catalog) -> DataFrame:
    """Best score over the first n restarts for n in (1, 2, 4, 6), nulls skipped."""
    runs = cat.tasks().join(selected(cat).select("task_id", "best_seen", "stop_reason"), "task_id", "left")
    score = F.when(~is_fault(F.col("stop_reason")), F.col("best_seen"))
    prefixes = [1, 2, 4, 6]
    aggs = [F.max(F.when(F.col("restart_id") < n, score)).alias(f"best_{n}") for n in prefixes]
    return runs.groupBy("graph_id").agg(*aggs)


def _half_best(cat: Catalog) -> DataFrame:
    runs = cat.tasks().join(selected(cat).select("task_id", "best_seen", "stop_reason"), "task_id", "left")
    score = F.when(~is_fault(F.col("stop_reason")), F.col("best_seen"))
    halves = runs.groupBy("graph_id").agg(F.max(F.when(F.col("restart_id") < 3, score)).alias("half_1"),
                                          F.max(F.when(F.col("restart_id") >= 3, score)).alias("half_2"))
    return halves.join(cat.cstar(), "graph_id").select(
        "graph_id", "half_1", "half_2", (F.abs(F.col("half_1") - F.col("half_2")) / F.col("c_star")).alias("half_gap"))


def _first_max(cat: Catalog) -> DataFrame:
    """First call that reaches the highest finite score."""
    return (cat.trace().where(known(F.col("c")).isNotNull()).groupBy("task_id", "attempt_number")
            .agg(F.max("c").alias("best_seen"),
                 F.min_by("call_id", F.struct((-F.col("c")).alias("s"), F.col("call_id"))).alias("best_call_id")))


def _contiguity(cat: Catalog) -> DataFrame:
    return (cat.trace().groupBy("task_id", "attempt_number")
            .agg(F.count(F.lit(1)).alias("calls"), F.min("call_id").alias("first_call"), F.max("call_id").alias("last_call"),
                 F.count_distinct("call_id").alias("distinct_calls"))
            .withColumn("contiguous", (F.col("first_call") == 1) & (F.col("last_call") == F.col("calls"))
                        & (F.col("distinct_calls") == F.col("calls"))))


def _running_best(cat: Catalog) -> DataFrame:
    """Best score so far, call by call; calls are first split by day to keep windows small."""
    t = cat.trace().withColumn("day", F.dayofmonth("ts"))
    keys = ["task_id", "attempt_number"]
    per_day = t.groupBy(*keys, "day").agg(F.max("c").alias("day_best"))
    before = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    carried = per_day.withColumn("carried", F.max("day_best").over(before)).drop("day_best")
    inside = W.partitionBy(*keys, "day").orderBy("call_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (t.join(carried, [*keys, "day"])
            .select(*keys, "call_id", F.greatest(F.max("c").over(inside), F.col("carried")).alias("best_so_far")))


def _resource_messages(cat: Catalog) -> DataFrame:
    """Documents stand in for error texts; whole texts are scanned."""
    return cat.table("documents").select("doc_id", resource_fault(
        F.concat(F.col("text"), F.when(F.col("doc_id") % 7 == 0, F.lit(" Out-Of Memory!")).otherwise(F.lit("")))).alias("resource_fault"))


def _finite_guard(cat: Catalog) -> DataFrame:
    raw = cat.attempts().withColumn("x", F.when(F.col("task_id") % 4 == 0, F.lit(float("nan")))
                                    .when(F.col("task_id") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("c_final")))
    return raw.select("task_id", "attempt_number", known(F.col("x")).alias("x"))


FAULT = "stop_reason IN ('numerical_error','evaluation_error','optimizer_failed','program_error')"

QUERIES = [
    Query("flagship_success_by_graph", flagship, """
SELECT graph_id, planned, valid, execution_faults, missing, reference_complete,
       CASE WHEN reference_complete THEN s END AS successes,
       CASE WHEN reference_complete THEN s / planned::DOUBLE END AS fixed_budget_success_fraction,
       CASE WHEN reference_complete THEN CASE WHEN s = 0 THEN 0 ELSE greatest(0, (ctr - hw)) END END AS wilson_low,
       CASE WHEN reference_complete THEN CASE WHEN s = planned THEN 1 ELSE least(1, (ctr + hw)) END END AS wilson_high,
       true AS provisional
FROM (SELECT *, (s/planned::DOUBLE + z*z/(2*planned)) / (1 + z*z/planned) AS ctr,
             z*sqrt((s/planned::DOUBLE)*(1-s/planned::DOUBLE)/planned + z*z/(4.0*planned*planned)) / (1 + z*z/planned) AS hw
      FROM (SELECT graph_id, count(*) AS planned, count(*) FILTER (execution_valid) AS valid,
                   count(*) FILTER (execution_fault) AS execution_faults, count(*) FILTER (missing) AS missing,
                   bool_and(coalesce(reference_complete, false)) AS reference_complete,
                   count(*) FILTER (terminal_success) AS s, 1.959963984540054::DOUBLE AS z
            FROM fx_scored GROUP BY graph_id))""", "fixed_budget_success_fraction wilson_low wilson_high"),
    Query("agg1_attempt_selection", lambda c: selected(c).select(
        "task_id", "graph_id", "attempt_number", "stop_reason", "objective_calls", "best_seen", "c_final"),
        "SELECT task_id, graph_id, attempt_number, stop_reason, objective_calls, best_seen, c_final FROM fx_selected",
        "best_seen c_final"),
    Query("win1_deterministic_row_pick", lambda c: selected(c).select(
        "task_id", "attempt_number", is_fault(F.col("stop_reason")).alias("fault")),
        f"SELECT task_id, attempt_number, {FAULT} AS fault FROM fx_selected"),
    Query("agg2_freeze_reference", lambda c: references(c).select(
        "graph_id", "planned", "valid", "complete", "c_ref", "source_task_id"), """
SELECT r.graph_id, r.planned, r.valid, r.complete, r.c_ref,
       (SELECT min(s.task_id) FROM fx_selected s JOIN fx_tasks t ON t.task_id = s.task_id
        WHERE t.graph_id = r.graph_id AND t.experiment_role = 'reference' AND s.stop_reason = 'converged'
          AND s.best_seen = r.c_ref) AS source_task_id
FROM fx_refs r""", "c_ref"),
    Query("flagship_success_by_graph_and_depth", _deep_flagship, """
SELECT graph_id, p, count(*) AS planned, count(*) FILTER (execution_valid) AS valid, count(*) FILTER (execution_fault) AS execution_faults, count(*) FILTER (missing) AS missing,
 bool_and(coalesce(reference_complete, false)) AS reference_complete,
 CASE WHEN bool_and(coalesce(reference_complete, false)) THEN count(*) FILTER (terminal_success) END AS successes,
 CASE WHEN bool_and(coalesce(reference_complete, false)) THEN count(*) FILTER (terminal_success)/count(*)::DOUBLE END AS fixed_budget_success_fraction
FROM fx_deep_scored GROUP BY 1, 2""", "fixed_budget_success_fraction"),
    Query("agg2_freeze_reference_by_depth", lambda c: deep_references(c).select("graph_id", "p", "planned", "valid", "complete", "c_ref", "source_task_id"),
          "SELECT graph_id, p, planned, valid, complete, c_ref, source_task_id FROM fx_deep_refs", "c_ref"),
    Query("agg2_reference_members_by_depth", lambda c: S.reference_members(c.deep_tasks(), c.deep_selected(selected(c))).select("graph_id", "p", "task_id", "is_valid"), """
SELECT t.graph_id, t.p, t.task_id, coalesce(s.stop_reason = 'converged' AND CASE WHEN t.p = 1 THEN s.grid_c IS NOT NULL AND s.passed ELSE s.best_seen IS NOT NULL END, false) AS is_valid
FROM fx_deep_tasks t LEFT JOIN fx_deep_selected s ON s.task_id = t.task_id WHERE t.experiment_role = 'reference'"""),
    Query("agg3_trace_score_by_depth", lambda c: deep_scored(c).select("task_id", "p", "first_hit", "terminal_success", "reference_exceeded"), """
SELECT task_id, p, first_hit, terminal_success, CASE WHEN reference_complete AND NOT missing THEN coalesce(top > c_ref, false) END AS reference_exceeded FROM fx_deep_scored"""),
    Query("agg10_best_and_bias_by_depth", lambda c: S.best_and_bias(deep_scored(c), ["graph_id", "p"]), """
SELECT graph_id, p, count(*) AS planned, count(best_seen) FILTER (execution_valid) AS valid, max(best_seen) FILTER (execution_valid) AS best_seen,
 arg_min(task_id, (-best_seen, task_id)) FILTER (execution_valid AND best_seen IS NOT NULL) AS source_task_id,
 max(c_ref) - max(best_seen) FILTER (execution_valid) AS bias, max(best_seen) FILTER (execution_valid)/max(c_star) AS ratio_exact
FROM fx_deep_scored GROUP BY 1, 2""", "best_seen bias ratio_exact"),
    Query("jn2_outcome_reference_by_depth", lambda c: S.attach_reference(
        S.plan_left_outcome(c.deep_tasks(), c.deep_selected(selected(c))), deep_references(c), c.cstar()).select("task_id", "p", "reference_complete", "c_ref", "c_star"), """
SELECT t.task_id, t.p, r.complete AS reference_complete, CASE WHEN r.complete THEN r.c_ref END AS c_ref, c.c_star
FROM fx_deep_tasks t LEFT JOIN fx_deep_refs r ON r.graph_id = t.graph_id AND r.p = t.p LEFT JOIN fx_cstar c ON c.graph_id = t.graph_id""", "c_ref c_star"),
    Query("win3_prefix_best_by_depth", _deep_prefixes, f"""
SELECT t.graph_id, t.p, {', '.join(f"max(s.best_seen) FILTER (t.restart_id < {n} AND NOT ({FAULT})) AS best_{n}" for n in (1, 2, 4, 6))},
 max(s.best_seen) FILTER (t.restart_id < 3 AND NOT ({FAULT})) AS half_1, max(s.best_seen) FILTER (t.restart_id >= 3 AND NOT ({FAULT})) AS half_2
FROM fx_deep_tasks t LEFT JOIN fx_deep_selected s ON s.task_id = t.task_id WHERE t.p > 1 GROUP BY 1, 2""", "best_1 best_2 best_4 best_6 half_1 half_2"),
    Query("agg2_reference_members", lambda c: S.reference_members(c.tasks(), selected(c)).select(
        "graph_id", "task_id", "is_valid"), """
SELECT t.graph_id, t.task_id, coalesce(s.stop_reason = 'converged' AND s.best_seen IS NOT NULL, false) AS is_valid
FROM fx_tasks t LEFT JOIN fx_selected s ON s.task_id = t.task_id WHERE t.experiment_role = 'reference'"""),
    Query("agg3_trace_score", lambda c: scored(c).select(
        "task_id", "first_hit", "hit", "terminal_success", "reference_exceeded"), """
SELECT s.task_id, s.first_hit, CASE WHEN s.reference_complete AND NOT s.missing THEN s.first_hit IS NOT NULL END AS hit,
       s.terminal_success,
       CASE WHEN s.reference_complete AND NOT s.missing THEN coalesce(x.m > s.c_ref, false) END AS reference_exceeded
FROM fx_scored s LEFT JOIN (SELECT task_id, attempt_number, max(c) AS m FROM fx_trace GROUP BY 1, 2) x
  ON x.task_id = s.task_id AND x.attempt_number = s.attempt_number"""),
    Query("agg4_success_threshold", _thresholds, """
SELECT r.graph_id, m.kind, m.tolerance,
       CASE WHEN m.kind = 'absolute' THEN r.c_ref - m.tolerance ELSE r.c_ref - m.tolerance*c.c_star END AS threshold
FROM fx_refs r JOIN fx_cstar c ON c.graph_id = r.graph_id
CROSS JOIN (VALUES ('absolute', 0.5::DOUBLE), ('normalized_gap', 0.01::DOUBLE), ('normalized_gap', 0.02::DOUBLE)) m(kind, tolerance)
WHERE r.complete""", "threshold tolerance"),
    Query("agg5_restart_row", lambda c: scored(c).select(
        "task_id", "graph_id", "missing", "execution_valid", "execution_fault", "threshold", "epsilon", "ratio_exact",
        "gap_ref", "gap_ratio"), """
SELECT task_id, graph_id, missing, execution_valid, execution_fault, threshold, 0.3::DOUBLE*c_star AS epsilon,
       c_final/c_star AS ratio_exact, c_ref - c_final AS gap_ref, (c_ref - c_final)/c_star AS gap_ratio
FROM fx_scored""", "threshold epsilon ratio_exact gap_ref gap_ratio"),
    Query("agg6_pool_statistics", lambda c: S.pool_statistics(scored(c), ["graph_id"], expected=4, scientific=4).select(
        "graph_id", "planned", "valid", "execution_faults", "missing", "successes", "complete_execution",
        "configured_pool_complete", "scientific_label_complete", "success_rate_label", "provisional"), """
SELECT graph_id, planned, valid, execution_faults, missing, CASE WHEN ready THEN s END AS successes,
       valid = planned AS complete_execution, valid = planned AND planned = 4 AND ready AS configured_pool_complete,
       valid = planned AND planned = 4 AND ready AS scientific_label_complete,
       CASE WHEN valid = planned AND planned = 4 AND ready THEN s/planned::DOUBLE END AS success_rate_label,
       NOT (valid = planned AND planned = 4 AND ready) AS provisional
FROM (SELECT graph_id, count(*) AS planned, count(*) FILTER (execution_valid) AS valid,
             count(*) FILTER (execution_fault) AS execution_faults, count(*) FILTER (missing) AS missing,
             bool_and(coalesce(reference_complete, false)) AS ready, count(*) FILTER (terminal_success) AS s
      FROM fx_scored GROUP BY graph_id)""", "success_rate_label"),
    Query("agg7_wilson_interval", _wilson, """
SELECT graph_id, successes, trials, CASE WHEN successes = 0 THEN 0 ELSE greatest(0, ctr - hw) END AS low,
       CASE WHEN successes = trials THEN 1 ELSE least(1, ctr + hw) END AS high
FROM (SELECT *, (r + z*z/(2*trials))/(1 + z*z/trials) AS ctr,
             z*sqrt(r*(1-r)/trials + z*z/(4.0*trials*trials))/(1 + z*z/trials) AS hw
      FROM (SELECT *, successes/trials::DOUBLE AS r, 1.959963984540054::DOUBLE AS z FROM fx_labels))""", "low high"),
    Query("agg8_hit_ecdf_curve", lambda c: S.hit_curve(scored(c).where("reference_complete"), ["graph_id"]), """
SELECT e.graph_id, e.objective_calls, e.hits, p.planned, e.hits/p.planned::DOUBLE AS fraction
FROM (SELECT graph_id, count(*) AS planned FROM fx_scored WHERE reference_complete GROUP BY 1) p
JOIN (SELECT graph_id, first_hit AS objective_calls,
             sum(count(*)) OVER (PARTITION BY graph_id ORDER BY first_hit) AS hits
      FROM fx_scored WHERE reference_complete AND first_hit IS NOT NULL GROUP BY 1, 2
      UNION ALL SELECT DISTINCT graph_id, 0, 0 FROM fx_scored WHERE reference_complete) e ON e.graph_id = p.graph_id""",
          "fraction"),
    Query("agg8_inverse_ecdf_quantiles", lambda c: S.hit_quantiles(scored(c).where("reference_complete"), ["graph_id"]), """
SELECT graph_id, planned, len(h) AS hits, h[ceil(0.5::DOUBLE*planned)::INT] AS median, h[ceil(0.9::DOUBLE*planned)::INT] AS p90,
       CASE WHEN len(h) > 0 THEN h[ceil(0.5::DOUBLE*len(h))::INT] END AS hit_median,
       CASE WHEN len(h) > 0 THEN h[ceil(0.9::DOUBLE*len(h))::INT] END AS hit_p90
FROM (SELECT graph_id, count(*) AS planned, coalesce(list_sort(list(first_hit) FILTER (first_hit IS NOT NULL)), []) AS h
      FROM fx_scored WHERE reference_complete GROUP BY 1)"""),
    Query("agg9_graph_weighted_hit_curve", _weighted, """
SELECT grp, objective_calls, least(1.0, sum(sum(mass)) OVER (PARTITION BY grp ORDER BY objective_calls)) AS fraction
FROM (SELECT s.grp, s.first_hit AS objective_calls, 1.0::DOUBLE/(g.graphs*p.planned) AS mass
      FROM (SELECT *, graph_id%20 AS grp FROM fx_scored) s
      JOIN (SELECT graph_id, count(*) AS planned FROM fx_scored GROUP BY 1) p ON p.graph_id = s.graph_id
      JOIN (SELECT graph_id%20 AS grp, count(DISTINCT graph_id) AS graphs FROM fx_scored GROUP BY 1
            HAVING bool_and(coalesce(reference_complete, false))) g ON g.grp = s.grp
      WHERE s.first_hit IS NOT NULL
      UNION ALL SELECT graph_id%20, 0, 0.0 FROM fx_scored GROUP BY 1 HAVING bool_and(coalesce(reference_complete, false)))
GROUP BY grp, objective_calls""", "fraction"),
    Query("agg9_graph_weighted_quantiles", _weighted_quantiles, """
SELECT grp, min(objective_calls) FILTER (fraction >= 0.5::DOUBLE - 1e-12) AS median,
       min(objective_calls) FILTER (fraction >= 0.9::DOUBLE - 1e-12) AS p90
FROM (SELECT grp, objective_calls, sum(sum(mass)) OVER (PARTITION BY grp ORDER BY objective_calls) AS fraction
      FROM (SELECT s.grp, s.first_hit AS objective_calls, 1.0::DOUBLE/(g.graphs*p.planned) AS mass
            FROM (SELECT *, graph_id%20 AS grp FROM fx_scored) s
            JOIN (SELECT graph_id, count(*) AS planned FROM fx_scored GROUP BY 1) p ON p.graph_id = s.graph_id
            JOIN (SELECT graph_id%20 AS grp, count(DISTINCT graph_id) AS graphs FROM fx_scored GROUP BY 1
                  HAVING bool_and(coalesce(reference_complete, false))) g ON g.grp = s.grp
            WHERE s.first_hit IS NOT NULL
            UNION ALL SELECT graph_id%20, 0, 0.0 FROM fx_scored GROUP BY 1 HAVING bool_and(coalesce(reference_complete, false)))
      GROUP BY grp, objective_calls) GROUP BY grp"""),
    Query("agg10_tier1_best_and_bias", lambda c: S.best_and_bias(scored(c), ["graph_id"]), """
SELECT graph_id, count(*) AS planned, count(best_seen) FILTER (execution_valid) AS valid,
       max(best_seen) FILTER (execution_valid) AS best_seen,
       arg_min(task_id, (-best_seen, task_id)) FILTER (execution_valid AND best_seen IS NOT NULL) AS source_task_id,
       max(c_ref) - max(best_seen) FILTER (execution_valid) AS bias,
       max(best_seen) FILTER (execution_valid) / max(c_star) AS ratio_exact
FROM fx_scored GROUP BY graph_id""", "best_seen bias ratio_exact"),
    Query("jn1_plan_left_outcome", lambda c: S.plan_left_outcome(c.tasks(), selected(c)).select(
        "task_id", "graph_id", "experiment_role", "missing", "execution_valid", "execution_fault", "c_final"), f"""
SELECT t.task_id, t.graph_id, t.experiment_role, s.task_id IS NULL AS missing,
       coalesce(NOT ({FAULT}) AND s.c_final IS NOT NULL, false) AS execution_valid,
       s.task_id IS NOT NULL AND NOT coalesce(NOT ({FAULT}) AND s.c_final IS NOT NULL, false) AS execution_fault, s.c_final
FROM fx_tasks t LEFT JOIN fx_selected s ON s.task_id = t.task_id""", "c_final"),
    Query("jn2_outcome_reference", lambda c: S.attach_reference(
        S.plan_left_outcome(c.tasks(), selected(c)), references(c), c.cstar()).select(
        "task_id", "reference_complete", "c_ref", "c_star"), """
SELECT t.task_id, r.complete AS reference_complete, CASE WHEN r.complete THEN r.c_ref END AS c_ref, c.c_star
FROM fx_tasks t LEFT JOIN fx_refs r ON r.graph_id = t.graph_id LEFT JOIN fx_cstar c ON c.graph_id = t.graph_id""", "c_ref c_star"),
    Query("cmp13_rescoring", _rescore, """
SELECT m.kind, m.tolerance, count(*) AS planned,
       count(*) FILTER (r.complete AND s.stop_reason = 'converged' AND s.c_final >= thr) AS successes,
       count(*) FILTER (r.complete AND EXISTS (SELECT 1 FROM fx_trace x WHERE x.task_id = s.task_id
                        AND x.attempt_number = s.attempt_number AND x.c >= thr)) AS hits,
       count(*) FILTER (r.complete AND s.task_id IS NOT NULL) AS resolved
FROM (SELECT t.task_id, t.graph_id, m.kind, m.tolerance,
             r.c_ref - m.tolerance*CASE WHEN m.kind = 'absolute' THEN 1 ELSE c.c_star END AS thr
      FROM fx_tasks t JOIN fx_cstar c ON c.graph_id = t.graph_id JOIN fx_refs r ON r.graph_id = t.graph_id
      CROSS JOIN (VALUES ('absolute', 0.5::DOUBLE), ('normalized_gap', 0.005::DOUBLE), ('normalized_gap', 0.01::DOUBLE),
                         ('normalized_gap', 0.02::DOUBLE)) m(kind, tolerance)
      WHERE t.experiment_role = 'evaluation') m
JOIN fx_refs r ON r.graph_id = m.graph_id LEFT JOIN fx_selected s ON s.task_id = m.task_id
GROUP BY 1, 2""", "tolerance"),
    Query("cmp15_event_projection", _event_projection, """
SELECT x.task_id, x.attempt_number, x.call_id, x.c, x.call_id = 1 AS is_first, coalesce(x.call_id = b.call_id, false) AS is_best,
       coalesce(x.call_id = s.first_hit, false) AS is_hit
FROM fx_trace x
LEFT JOIN (SELECT task_id, attempt_number, arg_min(call_id, (-c, call_id)) AS call_id FROM fx_trace WHERE c IS NOT NULL GROUP BY 1, 2) b
  ON b.task_id = x.task_id AND b.attempt_number = x.attempt_number
LEFT JOIN fx_scored s ON s.task_id = x.task_id AND s.attempt_number = x.attempt_number
WHERE x.call_id = 1 OR x.call_id = b.call_id OR x.call_id = s.first_hit""", "c"),
    Query("win2_first_max", _first_max, """
SELECT task_id, attempt_number, c AS best_seen, call_id AS best_call_id FROM (
 SELECT *, row_number() OVER (PARTITION BY task_id, attempt_number ORDER BY c DESC, call_id) AS k FROM fx_trace WHERE c IS NOT NULL)
WHERE k = 1""", "best_seen"),
    Query("win3_prefix_best", _prefix_best, f"""
SELECT t.graph_id, max(s.best_seen) FILTER (t.restart_id < 1 AND NOT ({FAULT})) AS best_1,
       max(s.best_seen) FILTER (t.restart_id < 2 AND NOT ({FAULT})) AS best_2,
       max(s.best_seen) FILTER (t.restart_id < 4 AND NOT ({FAULT})) AS best_4,
       max(s.best_seen) FILTER (t.restart_id < 6 AND NOT ({FAULT})) AS best_6
FROM fx_tasks t LEFT JOIN fx_selected s ON s.task_id = t.task_id GROUP BY 1""", "best_1 best_2 best_4 best_6"),
    Query("win3_running_best", _running_best, """
SELECT task_id, attempt_number, call_id,
       max(c) OVER (PARTITION BY task_id, attempt_number ORDER BY call_id) AS best_so_far FROM fx_trace""", "best_so_far"),
    Query("win4_half_pool_gap", _half_best, f"""
SELECT h.graph_id, half_1, half_2, abs(half_1 - half_2)/c_star AS half_gap FROM (
 SELECT t.graph_id, max(s.best_seen) FILTER (t.restart_id < 3 AND NOT ({FAULT})) AS half_1,
        max(s.best_seen) FILTER (t.restart_id >= 3 AND NOT ({FAULT})) AS half_2
 FROM fx_tasks t LEFT JOIN fx_selected s ON s.task_id = t.task_id GROUP BY 1) h JOIN fx_cstar c ON c.graph_id = h.graph_id""",
          "half_1 half_2 half_gap"),
    Query("win8_running_fraction", lambda c: S.hit_curve(scored(c), ["restart_id"]), """
SELECT e.restart_id, e.objective_calls, e.hits, p.planned, e.hits/p.planned::DOUBLE AS fraction
FROM (SELECT restart_id, count(*) AS planned FROM fx_scored GROUP BY 1) p
JOIN (SELECT restart_id, first_hit AS objective_calls,
             sum(count(*)) OVER (PARTITION BY restart_id ORDER BY first_hit) AS hits
      FROM fx_scored WHERE first_hit IS NOT NULL GROUP BY 1, 2
      UNION ALL SELECT DISTINCT restart_id, 0, 0 FROM fx_scored) e ON e.restart_id = p.restart_id""", "fraction"),
    Query("win9_contiguity_check", _contiguity, """
SELECT task_id, attempt_number, count(*) AS calls, min(call_id) AS first_call, max(call_id) AS last_call,
       count(DISTINCT call_id) AS distinct_calls,
       min(call_id) = 1 AND max(call_id) = count(*) AND count(DISTINCT call_id) = count(*) AS contiguous
FROM fx_trace GROUP BY 1, 2"""),
    Query("flt5_execution_fault", _fault_flag,
          f"SELECT task_id, attempt_number, stop_reason, {FAULT} AS fault FROM fx_attempts"),
    Query("scl1_resource_fault_text", _resource_messages, """
SELECT doc_id, regexp_matches(regexp_replace(lower(text || CASE WHEN doc_id%7 = 0 THEN ' Out-Of Memory!' ELSE '' END), '[^a-z0-9]', '', 'g'),
  'outofmemory|memoryallocation|allocfailed|badalloc|devicesarebusy|deviceisbusy') AS resource_fault FROM documents"""),
    Query("scl2_finite_guard", _finite_guard,
          "SELECT task_id, attempt_number, CASE WHEN task_id%4 < 2 THEN NULL ELSE c_final END AS x FROM fx_attempts", "x"),
]
