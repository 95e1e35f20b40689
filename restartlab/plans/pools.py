"""Queries of the pool family: energies, gradients, costs, warm pools, coverage, shot summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from restartlab.operators import pools as P, scoring as S
from restartlab.operators.quality import shot_failure_flag
from restartlab.plans.fixtures import FIXTURE_SQL, Catalog
from restartlab.plans.query import Query
from restartlab.plans.scoring import references, scored, selected


def costs(cat: Catalog) -> DataFrame:
    """Attempts with measured, unknown and unverified cost columns."""
    t, k = F.col("task_id"), F.col("objective_calls")
    grid = F.col("restart_id") == 0
    return cat.attempts().withColumns({
        "role": F.when(F.col("restart_id") < 2, "reference").otherwise("evaluation"),
        "gradient_requests": F.when(t % 9 != 0, k), "device_executions": k * 2,
        "device_derivatives": F.when(t % 23 == 0, F.lit(float("nan"))).otherwise(k.cast("double")),
        "device_vjps": F.lit(0), "iterations": F.col("restart_id") + 1, "elapsed_seconds": k * 0.25,
        "preparation_seconds": F.when(~((F.col("attempt_number") == 2) & (t % 5 == 0)), F.lit(0.5)),
        "kind": F.when(grid, "p1_grid").otherwise("optimization"),
        "analytic_evaluations": F.when(grid & (t % 3 > 0), k * 10), "analytic_points_requested": F.when(grid, k * 10),
        "cost_status": F.when(t % 31 == 0, "unverified_invalid_result").otherwise("verified"),
        "cost_unavailable": F.when(t % 17 == 0, F.array(F.lit("iterations"))).otherwise(F.array().cast("array<string>"))})


FIXTURE_SQL["fx_costs"] = """
SELECT a.*, CASE WHEN restart_id < 2 THEN 'reference' ELSE 'evaluation' END AS role,
       CASE WHEN task_id%9 <> 0 THEN objective_calls END AS gradient_requests, objective_calls*2 AS device_executions,
       CASE WHEN task_id%23 <> 0 THEN objective_calls END AS device_derivatives, 0 AS device_vjps, restart_id + 1 AS iterations,
       objective_calls*0.25 AS elapsed_seconds, CASE WHEN NOT (attempt_number = 2 AND task_id%5 = 0) THEN 0.5 END AS preparation_seconds,
       CASE WHEN restart_id = 0 THEN CASE WHEN task_id%3 > 0 THEN objective_calls*10 END ELSE 0 END AS analytic_evaluations,
       CASE WHEN restart_id = 0 THEN objective_calls*10 ELSE 0 END AS analytic_points_requested,
       task_id%31 = 0 AS unverified, task_id%17 = 0 AS no_iterations
FROM fx_attempts a"""
FIXTURE_SQL["fx_terms"] = "\nUNION ALL ".join(
    f"SELECT task_id, attempt_number, graph_id, role, '{m}' AS metric, CASE WHEN {bad} THEN NULL ELSE CAST({m} AS DOUBLE) END AS value FROM fx_costs"
    for m in P.COST_METRICS
    for bad in [("unverified" if m in P.COUNTERS else "false") + (" OR no_iterations" if m == "iterations" else "")])
FIXTURE_SQL["fx_shots"] = """
SELECT o_orderkey AS task_id, o_custkey AS graph_id, c_nationkey AS cell, o_orderpriority AS condition, o_orderkey%997 <> 0 AS completed,
       CASE WHEN o_orderkey%1009 = 0 THEN 'numerical_error' ELSE 'converged' END AS stop_reason,
       CASE WHEN o_orderkey%1013 = 0 THEN 'crash' END AS error, CASE WHEN o_orderkey%101 = 0 THEN 'shots' END AS validation_error,
       CASE WHEN o_orderkey%103 = 0 THEN 'audit' END AS exact_audit_error, o_totalprice*0.4 AS c_initial, o_totalprice AS c_final,
       600000.0::DOUBLE AS c_star, 300000.0::DOUBLE AS threshold, (o_orderkey%13)*0.5 AS seconds, o_orderkey%7 AS queries, (o_orderkey%11)*128 AS shots
FROM orders JOIN customer ON c_custkey = o_custkey"""
_TOTALS = """CASE WHEN count(value) = count(*) THEN sum(value) END AS total, coalesce(sum(value), 0) AS known_subtotal,
       count(*) - count(value) AS unknown_count, count(*) AS attempts"""


def shots(cat: Catalog) -> DataFrame:
    """Planned shot runs left-joined with their results; orders stand in for runs."""
    k = F.col("o_orderkey")
    return (cat.table("orders").join(cat.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
            .select(k.alias("task_id"), F.col("o_custkey").alias("graph_id"), F.col("c_nationkey").cast("bigint").alias("cell"),
                    F.col("o_orderpriority").alias("condition"), (k % 997 != 0).alias("completed"),
                    F.when(k % 1009 == 0, "numerical_error").otherwise("converged").alias("stop_reason"),
                    F.when(k % 1013 == 0, "crash").alias("error"), F.when(k % 101 == 0, "shots").alias("validation_error"),
                    F.when(k % 103 == 0, "audit").alias("exact_audit_error"), (F.col("o_totalprice") * 0.4).alias("c_initial"),
                    F.col("o_totalprice").alias("c_final"), F.lit(600000.0).alias("c_star"), F.lit(300000.0).alias("threshold"),
                    (k % 13 * 0.5).alias("seconds"),
                    F.create_map(F.lit("queries"), k % 7, F.lit("shots"), k % 11 * 128).alias("counts")))


def _shot_groups(cat: Catalog) -> DataFrame:
    graph = P.shot_graph_means(shots(cat), ["condition", "cell", "graph_id"])
    return P.shot_group_means(graph, ["condition", "cell"])


def _shot_failures(cat: Catalog) -> DataFrame:
    return P.shot_graph_means(shots(cat), ["condition"]).select(
        "condition", "planned", "completed", "optimization_failures", "validation_failures", "exact_audit_failures", "elapsed_seconds")


def _error_examples(cat: Catalog) -> DataFrame:
    failed = F.col("completed") & shot_failure_flag()
    return P.error_examples(shots(cat), ["condition"], failed).select("condition", F.col("example").cast("bigint").alias("example"),
                                                                      "task_id", "stop_reason")


def gradients(cat: Catalog) -> DataFrame:
    """Embedding slices as gradients of two populations; every 17th is invalid."""
    g = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    bad = F.array(F.lit(float("nan")), *[F.lit(0.0)] * 3)
    return cat.table("embeddings").select(
        F.col("label").cast("bigint").alias("graph_id"),
        F.when(F.col("vec_id") % 2 == 0, "uniform").otherwise("trajectory").alias("population"),
        (F.col("label") + 17).cast("bigint").alias("edge_count"), F.when(F.col("vec_id") % 17 == 0, bad).otherwise(g).alias("gradient"))


FIXTURE_SQL["fx_grad"] = """
SELECT label AS graph_id, CASE WHEN vec_id%2 = 0 THEN 'uniform' ELSE 'trajectory' END AS population, label + 17 AS edge_count, vec_id,
       vec_id%17 <> 0 AS ok, [CAST(e AS DOUBLE) FOR e IN embedding[1:4]] AS g FROM embeddings"""


def _energy(cat: Catalog) -> DataFrame:
    e = P.energy_distribution(scored(cat), ["graph_id"], 20)
    return e.withColumn("bin_counts", F.array_join(F.transform("bin_counts", lambda k: k.cast("string")), ","))


def _grouping_sets(cat: Catalog) -> DataFrame:
    return P.cost_grouping_sets(costs(cat), [["role"], ["attempt_number"], ["role", "attempt_number"]])


def _save_costs(cat: Catalog) -> DataFrame:
    a = cat.attempts()
    io = a.where(F.col("task_id") % 6 != 5).select("task_id", "attempt_number", (F.col("objective_calls") * 0.125).alias("save_seconds"))
    return P.save_costs(a, io)


def _unknown_ids(cat: Catalog) -> DataFrame:
    """Attempts behind every unknown total, one row each."""
    return P.unknown_costs(costs(cat), ["task_id", "attempt_number"])


def _shared(cat: Catalog) -> DataFrame:
    uses = cat.tasks().select("task_id", "graph_id").select("task_id", F.explode(F.array_compact(F.array(
        F.when(F.col("graph_id") % 2 == 0, F.lit("A")), F.when(F.col("graph_id") % 3 == 0, F.lit("B")),
        F.lit("C")))).alias("fit_id"))
    return P.shared_union_costs(costs(cat), uses)


def _warm(cat: Catalog) -> DataFrame:
    return P.warm_pool(scored(cat), ["graph_id"])


def _completion(cat: Catalog) -> DataFrame:
    return P.completion_report(S.plan_left_outcome(cat.tasks(), selected(cat)), ["experiment_role"])


def cell_grid(cat: Catalog) -> DataFrame:
    """All cells of the design: region names times two degree bands."""
    bands = F.explode(F.array(F.lit(3).cast("bigint"), F.lit(5).cast("bigint")))
    return (cat.table("region").select(F.col("r_name").alias("family"), bands.alias("degree_band"))
            .select(F.lit(12).cast("bigint").alias("n"), "family", "degree_band",
                    F.concat(F.lit("n12:"), "family", F.lit(":k"), F.col("degree_band").cast("string")).alias("cell")))


def attributions(cat: Catalog) -> DataFrame:
    """Embedding slices as additive contributions of ten models."""
    x = F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double"))
    total = F.aggregate(x, F.lit(0.25), lambda a, v: a + v)
    return cat.table("embeddings").select(
        F.col("label").cast("bigint").alias("fit_id"), "vec_id", x.alias("contributions"), F.lit(0.25).alias("bias"),
        (total + F.when(F.col("vec_id") % 50 == 0, 1e-4).otherwise(0.0)).alias("raw"))


FIXTURE_SQL["fx_attr"] = """
SELECT label AS fit_id, vec_id, c, 0.25 + list_sum(c) + CASE WHEN vec_id%50 = 0 THEN 1e-4 ELSE 0 END AS raw, 0.25 + list_sum(c) AS total
FROM (SELECT label, vec_id, [CAST(e AS DOUBLE) FOR e IN embedding[1:5]] AS c FROM embeddings)"""


def _attribution_models(cat: Catalog) -> DataFrame:
    rows = attributions(cat)
    planned = rows.groupBy("fit_id").agg(F.count(F.lit(1)).alias("planned"))
    return P.attribution_models(rows.where(F.col("fit_id") != 3), planned, "fit_id")


def _selection_roster(cat: Catalog) -> DataFrame:
    g = cat.graphs().where("graph_split <> 'training'")
    return g.groupBy("cell").agg(
        F.count(F.lit(1)).alias("available"), F.count_if(F.col("graph_split") == "evaluation").alias("inherited"),
        F.count_if(F.col("tier") == 1).alias("promoted"), F.count_if(F.col("m") % 4 == 0).alias("annotation_needed"))


def _partition_index(cat: Catalog) -> DataFrame:
    out = S.plan_left_outcome(cat.tasks(), selected(cat))
    return out.rollup("graph_id").agg(
        F.count(F.lit(1)).alias("planned_tasks"), F.count_if("execution_valid").alias("valid_tasks"),
        F.count_if((F.col("experiment_role") == "reference") & F.col("execution_valid")).alias("reference_tasks"))


def _counter_maps(cat: Catalog) -> DataFrame:
    return P.counter_sums(shots(cat).where("completed"), ["condition"])


_WARM_SQL = """
WITH w AS (SELECT *, c_initial/c_star AS ratio_initial_exact, c_final/c_star AS ratio_final_exact, c_ref - c_initial AS gap_initial_ref,
   c_ref - c_final AS gap_final_ref, (c_ref - c_initial)/c_star AS gap_initial_ratio, (c_ref - c_final)/c_star AS gap_final_ratio FROM fx_scored)
SELECT graph_id, count(*) AS planned, count(*) FILTER (execution_valid) AS valid, count(*) FILTER (missing) AS missing,
  count(*) FILTER (execution_fault) AS execution_faults, bool_and(coalesce(reference_complete, false)) AS reference_complete,
  CASE WHEN count(objective_calls) = count(*) THEN sum(objective_calls)/count(*)::DOUBLE END AS objective_calls,
  """ + ",\n  ".join(f"CASE WHEN count({m}) FILTER (execution_valid) = count(*) THEN avg({m}) FILTER (execution_valid) END AS {m}, "
                     f"avg({m}) FILTER (execution_valid) AS observed_{m}" for m in P.WARM_METRICS) + """,
  count(*) FILTER (execution_valid) = count(*) AND bool_and(coalesce(reference_complete, false)) AND count(c_initial) = count(*) AS complete,
  CASE WHEN bool_and(coalesce(reference_complete, false)) THEN count(*) FILTER (terminal_success)/count(*)::DOUBLE END AS terminal_success_fraction,
  CASE WHEN bool_and(coalesce(reference_complete, false)) THEN count(first_hit)/count(*)::DOUBLE END AS hit_fraction
FROM w GROUP BY graph_id"""

QUERIES = [
    Query("agg11_energy_distribution", _energy, """
WITH b AS (SELECT *, CASE WHEN execution_valid AND c_final BETWEEN 0 AND c_star THEN least(floor(c_final/c_star*20), 19)::INT END AS k FROM fx_scored),
h AS (SELECT graph_id, string_agg(n, ',' ORDER BY i) AS bin_counts, -sum(CASE WHEN n > 0 THEN n/t*ln(n/t) ELSE 0 END) AS entropy_nats, max(t) AS t
  FROM (SELECT g.graph_id, r.i, count(b.k) AS n, sum(count(b.k)) OVER (PARTITION BY g.graph_id)::DOUBLE AS t
        FROM (SELECT DISTINCT graph_id FROM fx_scored) g CROSS JOIN range(20) r(i)
        LEFT JOIN b ON b.graph_id = g.graph_id AND b.k = r.i GROUP BY 1, 2) GROUP BY 1)
SELECT b.graph_id, count(c_final) FILTER (execution_valid) AS count, avg(c_final) FILTER (execution_valid) AS mean,
  var_pop(c_final) FILTER (execution_valid) AS population_variance, min(c_final) FILTER (execution_valid) AS minimum,
  max(c_final) FILTER (execution_valid) AS maximum, max(c_star) AS c_star, count(*) FILTER (execution_valid AND k IS NULL) AS out_of_range,
  max(h.bin_counts) AS bin_counts, CASE WHEN max(h.t) > 0 THEN max(h.entropy_nats) END AS entropy_nats
FROM b JOIN h ON h.graph_id = b.graph_id GROUP BY 1""", "mean population_variance minimum maximum c_star entropy_nats"),
    Query("agg12_gradient_statistics", lambda c: P.gradient_statistics(gradients(c), ["graph_id", "population"], 4), """
SELECT graph_id, population, r.i, avg(g[r.i+1]) AS mean, var_pop(g[r.i+1]) AS population_variance,
       avg(g[r.i+1]/edge_count) AS mean_per_edge, var_pop(g[r.i+1]/edge_count) AS variance_per_edge
FROM fx_grad CROSS JOIN range(4) r(i) WHERE ok GROUP BY 1, 2, 3""", "mean population_variance mean_per_edge variance_per_edge", 8),
    Query("agg12_gradient_norms", lambda c: P.gradient_norms(gradients(c), ["graph_id", "population"], 4), """
SELECT graph_id, population, count(*) FILTER (ok) AS sample_count, count(*) FILTER (NOT ok) AS excluded_samples,
  avg(sqrt(g[1]*g[1]+g[2]*g[2]+g[3]*g[3]+g[4]*g[4])) FILTER (ok) AS mean_norm,
  avg(sqrt(g[1]*g[1]+g[2]*g[2]+g[3]*g[3]+g[4]*g[4])/edge_count) FILTER (ok) AS mean_norm_per_edge
FROM fx_grad GROUP BY 1, 2""", "mean_norm mean_norm_per_edge", 8),
    Query("agg13_cost_totals", lambda c: P.cost_totals(costs(c), ["graph_id"]),
          f"SELECT graph_id, metric, {_TOTALS} FROM fx_terms GROUP BY 1, 2", "total known_subtotal"),
    Query("agg13_unknown_attempts", _unknown_ids, "SELECT task_id, attempt_number, metric FROM fx_terms WHERE value IS NULL"),
    Query("agg14_attempt_save_costs", _save_costs, """
SELECT count(*) AS attempts, count(*) FILTER (stop_reason <> 'converged') AS execution_faults,
  CASE WHEN bool_and(task_id%6 <> 5) THEN sum(objective_calls*0.125) END AS record_save_seconds,
  sum(CASE WHEN task_id%6 <> 5 THEN objective_calls*0.125 ELSE 0 END) AS record_save_seconds_measured,
  count(*) FILTER (task_id%6 = 5) AS record_save_measurements_missing FROM fx_attempts""",
          "record_save_seconds record_save_seconds_measured"),
    Query("agg15_cost_grouping_sets", _grouping_sets, f"""
SELECT role, attempt_number, metric, {_TOTALS} FROM fx_terms
GROUP BY GROUPING SETS ((role, metric), (attempt_number, metric), (role, attempt_number, metric))""", "total known_subtotal"),
    Query("agg16_shared_union_costs", _shared, f"""
SELECT scope, metric, {_TOTALS} FROM (
  SELECT 'fit:A' AS scope, t.metric, t.value FROM fx_terms t JOIN fx_tasks k ON k.task_id = t.task_id WHERE k.graph_id%2 = 0
  UNION ALL SELECT 'fit:B', t.metric, t.value FROM fx_terms t JOIN fx_tasks k ON k.task_id = t.task_id WHERE k.graph_id%3 = 0
  UNION ALL SELECT 'fit:C', t.metric, t.value FROM fx_terms t JOIN fx_tasks k ON k.task_id = t.task_id
  UNION ALL SELECT 'shared_union', t.metric, t.value FROM fx_terms t JOIN fx_tasks k ON k.task_id = t.task_id) GROUP BY 1, 2""",
          "total known_subtotal"),
    Query("agg17_warm_pool", _warm, _WARM_SQL, "objective_calls terminal_success_fraction hit_fraction "
          + " ".join(f"{m} observed_{m}" for m in P.WARM_METRICS)),
    Query("agg18_completion_report", _completion, """
SELECT t.experiment_role, count(*) AS planned, count(s.task_id) AS completed,
  count(*) FILTER (s.stop_reason = 'converged' AND s.c_final IS NOT NULL) AS valid,
  count(*) FILTER (s.task_id IS NOT NULL AND NOT coalesce(s.stop_reason = 'converged' AND s.c_final IS NOT NULL, false)) AS unresolved_faults,
  count(*) FILTER (s.task_id IS NULL) AS missing
FROM fx_tasks t LEFT JOIN fx_selected s ON s.task_id = t.task_id GROUP BY 1"""),
    Query("agg19_design_counts", lambda c: P.design_counts(c.graphs(), (1, 2, 3), 5, 100, 50, 128), """
WITH k AS (SELECT count(*) AS g, count(*) FILTER (tier = 2) AS t FROM fx_graphs)
SELECT 'tier1' AS role, g*3*5 AS tasks FROM k UNION ALL SELECT 'reference_grid', t FROM k UNION ALL SELECT 'reference_optimization', t*2*100 FROM k
UNION ALL SELECT 'evaluation', t*3*50 FROM k UNION ALL SELECT 'gradient_diagnostic', t*3*128 FROM k"""),
    Query("agg20_coverage_tables", lambda c: P.coverage_tables(c.graphs(), cell_grid(c)), """
WITH cells AS (SELECT 12 AS n, r_name AS family, b AS degree_band, concat('n12:', r_name, ':k', b) AS cell FROM region CROSS JOIN (VALUES (3), (5)) v(b)),
j AS (SELECT c.*, g.graph_split, g.tier, g.graph_id FROM cells c LEFT JOIN fx_graphs g ON g.cell = c.cell),
u AS (SELECT 'by_n' AS dimension, n::VARCHAR AS value, j.* FROM j UNION ALL SELECT 'by_family', family, j.* FROM j
  UNION ALL SELECT 'by_degree_band', degree_band::VARCHAR, j.* FROM j UNION ALL SELECT 'by_cell', cell, j.* FROM j)
SELECT dimension, value, count(*) FILTER (graph_split = 'training') AS training, count(*) FILTER (graph_split = 'evaluation') AS evaluation,
  count(*) FILTER (graph_split = 'not_applicable') AS not_applicable, count(*) FILTER (tier = 2) AS tier2, count(graph_id) AS total FROM u GROUP BY 1, 2"""),
    Query("agg20_generation_groups", lambda c: P.coverage_tables(
        c.graphs(), cell_grid(c).withColumn("generation", F.when(F.col("family").isin("ASIA", "EUROPE"), "added").otherwise("original")), ("generation",)), """
WITH cells AS (SELECT CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'added' ELSE 'original' END AS generation, concat('n12:', r_name, ':k', b) AS cell FROM region CROSS JOIN (VALUES (3), (5)) v(b))
SELECT 'by_generation' AS dimension, generation AS value, count(*) FILTER (graph_split = 'training') AS training, count(*) FILTER (graph_split = 'evaluation') AS evaluation,
  count(*) FILTER (graph_split = 'not_applicable') AS not_applicable, count(*) FILTER (tier = 2) AS tier2, count(graph_id) AS total FROM cells c LEFT JOIN fx_graphs g ON g.cell = c.cell GROUP BY 2"""),
    Query("agg20_coverage_status", lambda c: P.coverage_status(P.coverage_tables(c.graphs(), cell_grid(c))), """
SELECT count(*) AS cells, count(*) FILTER (t = 0 OR e = 0) AS short_cells, count(*) FILTER (t = 0 OR e = 0) > 0 AS smoke_test FROM (
 SELECT c.cell, count(*) FILTER (g.graph_split = 'training') AS t, count(*) FILTER (g.graph_split = 'evaluation') AS e
 FROM (SELECT concat('n12:', r_name, ':k', b) AS cell FROM region CROSS JOIN (VALUES (3), (5)) v(b)) c
 LEFT JOIN fx_graphs g ON g.cell = c.cell GROUP BY 1)"""),
    Query("agg21_shot_summary", _shot_groups, """
WITH g AS (SELECT condition, cell, graph_id, count(*) AS planned, count(*) FILTER (completed) AS completed,
   count(*) FILTER (ok) = count(*) AS full_, avg(c_initial) AS c_initial, avg(c_final) AS c_final_exact, avg(c_final/c_star) AS quality,
   avg((c_final - c_initial)/c_star) AS quality_gain, avg(CASE WHEN c_final >= threshold THEN 1.0 ELSE 0.0 END) AS success
 FROM (SELECT *, completed AND error IS NULL AND stop_reason = 'converged' AS ok FROM fx_shots) GROUP BY 1, 2, 3)
SELECT condition, cell, count(*) AS graphs, CAST(sum(planned) AS BIGINT) AS planned, CAST(sum(completed) AS BIGINT) AS completed,
 CASE WHEN bool_and(full_) THEN avg(c_initial) END AS c_initial, CASE WHEN bool_and(full_) THEN avg(c_final_exact) END AS c_final_exact,
 CASE WHEN bool_and(full_) THEN avg(quality) END AS quality, CASE WHEN bool_and(full_) THEN avg(quality_gain) END AS quality_gain,
 CASE WHEN bool_and(full_) THEN avg(success) END AS success FROM g GROUP BY 1, 2""",
          "c_initial c_final_exact quality quality_gain success", 4),
    Query("agg21_phase_failures", _shot_failures, """
SELECT condition, count(*) AS planned, count(*) FILTER (completed) AS completed,
  count(*) FILTER (completed AND (error IS NOT NULL OR stop_reason <> 'converged')) AS optimization_failures,
  count(*) FILTER (completed AND validation_error IS NOT NULL) AS validation_failures,
  count(*) FILTER (completed AND exact_audit_error IS NOT NULL) AS exact_audit_failures,
  sum(CASE WHEN completed THEN seconds ELSE 0 END) AS elapsed_seconds FROM fx_shots GROUP BY 1""", "elapsed_seconds"),
    Query("agg21_error_examples", _error_examples, """
SELECT condition, example, task_id, stop_reason FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY task_id) AS example FROM fx_shots
 WHERE completed AND (error IS NOT NULL OR validation_error IS NOT NULL OR exact_audit_error IS NOT NULL OR stop_reason <> 'converged')) WHERE example <= 3"""),
    Query("scl3_counter_map_sums", _counter_maps, """
SELECT condition, 'queries' AS counter, CAST(sum(queries) AS BIGINT) AS amount FROM fx_shots WHERE completed GROUP BY 1
UNION ALL SELECT condition, 'shots', CAST(sum(shots) AS BIGINT) FROM fx_shots WHERE completed GROUP BY 1"""),
    Query("agg23_attribution_summary", lambda c: P.attribution_summary(attributions(c), "fit_id").withColumn("column", F.col("column").cast("bigint")), """
SELECT fit_id, r.i AS column, avg(abs(c[r.i+1])) AS mean_absolute, avg(c[r.i+1]) AS mean_signed, quantile_cont(c[r.i+1], 0.0) AS q0,
  quantile_cont(c[r.i+1], 0.25) AS q25, quantile_cont(c[r.i+1], 0.5) AS q50, quantile_cont(c[r.i+1], 0.75) AS q75, quantile_cont(c[r.i+1], 1.0) AS q100
FROM fx_attr CROSS JOIN range(5) r(i) GROUP BY 1, 2""", "mean_absolute mean_signed q0 q25 q50 q75 q100"),
    Query("agg23_attribution_models", _attribution_models, """
SELECT p.fit_id, p.planned, coalesce(o.observed, 0) AS observed, o.raw_min, o.raw_max, o.clipped, o.max_additivity_error,
  coalesce(o.observed, 0) = p.planned AS complete
FROM (SELECT fit_id, count(*) AS planned FROM fx_attr GROUP BY 1) p LEFT JOIN
 (SELECT fit_id, count(*) AS observed, min(raw) AS raw_min, max(raw) AS raw_max, count(*) FILTER (raw < 0 OR raw > 1) AS clipped,
   max(abs(total - raw)) AS max_additivity_error FROM fx_attr WHERE fit_id <> 3 GROUP BY 1) o ON o.fit_id = p.fit_id""",
          "raw_min raw_max max_additivity_error"),
    Query("agg25_selection_roster", _selection_roster, """
SELECT cell, count(*) AS available, count(*) FILTER (graph_split = 'evaluation') AS inherited, count(*) FILTER (tier = 1) AS promoted,
  count(*) FILTER (m%4 = 0) AS annotation_needed FROM fx_graphs WHERE graph_split <> 'training' GROUP BY 1"""),
    Query("agg26_partition_index", _partition_index, """
SELECT t.graph_id, count(*) AS planned_tasks, count(*) FILTER (s.stop_reason = 'converged' AND s.c_final IS NOT NULL) AS valid_tasks,
  count(*) FILTER (s.stop_reason = 'converged' AND s.c_final IS NOT NULL AND t.experiment_role = 'reference') AS reference_tasks
FROM fx_tasks t LEFT JOIN fx_selected s ON s.task_id = t.task_id GROUP BY ROLLUP (t.graph_id)"""),
]
