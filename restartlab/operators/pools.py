"""Pool-level aggregations: energies, gradients, costs, warm pools, coverage and shot summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from restartlab.functions.ranks import exact_quantiles
from restartlab.functions.scores import finite, is_fault, known, mean_if_all_known, sum_if_all_known

# fixed values: cost metrics in report order; the first six are counters, the last two belong to grid runs
COUNTERS = ("objective_calls", "gradient_requests", "device_executions", "device_derivatives", "device_vjps", "iterations")
COST_METRICS = (*COUNTERS, "elapsed_seconds", "preparation_seconds", "analytic_evaluations", "analytic_points_requested")
GRID_METRICS = COST_METRICS[-2:]
UNVERIFIED = "unverified_invalid_result"


def energy_distribution(rows: DataFrame, keys: Sequence[str], bins: int = 20) -> DataFrame:
    """Valid end scores on fixed bins of [0, c_star]; values outside are counted, not clipped."""
    ok = F.col("execution_valid") & finite(F.col("c_final"))
    inside = ok & (F.col("c_star") > 0) & F.col("c_final").between(F.lit(0.0), F.col("c_star"))
    place = F.least(F.floor(F.col("c_final") / F.col("c_star") * bins), F.lit(bins - 1))
    x = F.when(ok, F.col("c_final"))
    counted = rows.withColumn("__bin", F.when(inside, place))
    agg = counted.groupBy(*keys).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.var_pop(x).alias("population_variance"),
        F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.max("c_star").alias("c_star"),
        F.count_if(ok & ~inside).alias("out_of_range"), F.count_if(inside).alias("__n"),
        F.array(*[F.count_if(F.col("__bin") == i) for i in range(bins)]).alias("bin_counts"))
    terms = F.transform("bin_counts", lambda k: F.when(k > 0, k / F.col("__n") * F.ln(k / F.col("__n"))).otherwise(0.0))
    entropy = F.when(F.col("__n") > 0, -F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))
    return agg.withColumn("entropy_nats", entropy).drop("__n")


def gradient_statistics(samples: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Per-coordinate mean and population variance of valid gradients, raw and per edge.

    ``samples`` carry the keys, ``gradient`` and ``edge_count``.
    """
    valid = _valid_gradient(width)
    parts = samples.where(valid).select(*keys, "edge_count", F.posexplode("gradient").alias("i", "g"))
    g, per = F.col("g"), F.col("g") / F.nullif(F.col("edge_count"), F.lit(0))
    return parts.groupBy(*keys, F.col("i").cast("bigint").alias("i")).agg(
        F.avg(g).alias("mean"), F.var_pop(g).alias("population_variance"),
        F.avg(per).alias("mean_per_edge"), F.var_pop(per).alias("variance_per_edge"))


def gradient_norms(samples: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    valid = _valid_gradient(width)
    norm = F.sqrt(F.aggregate("gradient", F.lit(0.0), lambda a, g: a + g * g))
    return samples.groupBy(*keys).agg(
        F.count_if(valid).alias("sample_count"), F.count_if(~valid).alias("excluded_samples"),
        F.avg(F.when(valid, norm)).alias("mean_norm"),
        F.avg(F.when(valid, norm / F.nullif(F.col("edge_count"), F.lit(0)))).alias("mean_norm_per_edge"))


def _valid_gradient(width: int) -> Column:
    return F.coalesce((F.size("gradient") == width) & F.forall("gradient", finite), F.lit(False))


def _known_cost(name: str) -> Column:
    """Value of one metric, or null when unknown.

    Unknown: null, NaN, infinite, listed in ``cost_unavailable``, or a counter
    of an unverified record. Grid metrics are zero outside grid runs.
    """
    raw = F.col(name).cast("double")
    if name in GRID_METRICS:
        raw = F.when(F.col("kind") == "p1_grid", raw).otherwise(F.coalesce(raw, F.lit(0.0)))
    bad = F.coalesce(F.array_contains("cost_unavailable", name), F.lit(False))
    if name in COUNTERS:
        bad = bad | F.coalesce(F.col("cost_status") == UNVERIFIED, F.lit(False))
    return F.when(~bad, known(raw))


def unknown_costs(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The attempts behind every unknown total, one row per attempt and metric."""
    names = F.array_compact(F.array(*[F.when(_known_cost(m).isNull(), F.lit(m)) for m in COST_METRICS]))
    return attempts.select(*keys, F.explode(names).alias("metric"))


def _cost_columns(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attempts.select(*keys, *[_known_cost(m).alias(f"k_{m}") for m in COST_METRICS])


def _cost_aggregates() -> list[Column]:
    sums = [F.sum(f"k_{m}").alias(f"s_{m}") for m in COST_METRICS]
    return [F.count(F.lit(1)).alias("attempts"), *sums, *[F.count(f"k_{m}").alias(f"n_{m}") for m in COST_METRICS]]


def _cost_rows(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group and metric, after aggregation."""
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.col(f"n_{m}") == F.col("attempts"), F.col(f"s_{m}")).alias("total"),
                               F.coalesce(F.col(f"s_{m}"), F.lit(0.0)).alias("known_subtotal"),
                               (F.col("attempts") - F.col(f"n_{m}")).alias("unknown_count")) for m in COST_METRICS])
    return wide.select(*keys, "attempts", F.explode(items).alias("c")).select(*keys, "c.*", "attempts")


def cost_totals(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of all metrics per group: null if any term is unknown, with the known subtotal beside it."""
    return _cost_rows(_cost_columns(attempts, keys).groupBy(*keys).agg(*_cost_aggregates()), keys)


def cost_grouping_sets(attempts: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Cost totals for several groupings in one pass; unused columns are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    wide = _cost_columns(attempts, columns).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*_cost_aggregates())
    return _cost_rows(wide, columns)


def save_costs(attempts: DataFrame, io_times: DataFrame) -> DataFrame:
    """Record-save seconds over all retained attempts; one missing measurement leaves the total unknown."""
    j = attempts.join(io_times, ["task_id", "attempt_number"], "left")
    none = F.col("save_seconds").isNull()
    return j.agg(F.count(F.lit(1)).alias("attempts"), F.count_if(is_fault(F.col("stop_reason"))).alias("execution_faults"),
                 sum_if_all_known(F.col("save_seconds"), none).alias("record_save_seconds"),
                 F.coalesce(F.sum("save_seconds"), F.lit(0.0)).alias("record_save_seconds_measured"),
                 F.count_if(none).alias("record_save_measurements_missing"))


def shared_union_costs(attempts: DataFrame, uses: DataFrame) -> DataFrame:
    """Cost per fit, and of the union in which an attempt used by several fits is charged once."""
    ids = ["task_id", "attempt_number"]
    per_fit = attempts.join(uses, "task_id").withColumn("scope", F.concat(F.lit("fit:"), "fit_id"))
    once = attempts.join(uses.select("task_id").distinct(), "task_id", "left_semi").withColumn("scope", F.lit("shared_union"))
    rows = per_fit.drop("fit_id").unionByName(once)
    return cost_totals(rows.dropDuplicates([*ids, "scope"]), ["scope"])


WARM_METRICS = ("c_initial", "c_final", "ratio_initial_exact", "ratio_final_exact", "gap_initial_ref", "gap_final_ref",
                "gap_initial_ratio", "gap_final_ratio")


def warm_metrics(scored: DataFrame) -> DataFrame:
    """Initial and final score of each restart as value, exact ratio, reference gap and gap ratio."""
    star, ref = F.nullif(F.col("c_star"), F.lit(0.0)), F.col("c_ref")
    cols = {}
    for name in ("initial", "final"):
        c = F.col(f"c_{name}")
        cols |= {f"ratio_{name}_exact": c / star, f"gap_{name}_ref": ref - c, f"gap_{name}_ratio": (ref - c) / star}
    return scored.withColumns(cols)


def warm_pool(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metric means of a pool: null unless every planned restart gave a value; observed means stay beside."""
    rows = warm_metrics(scored)
    valid = F.col("execution_valid")
    aggs = [F.count(F.lit(1)).alias("planned"), F.count_if(valid).alias("valid"), F.count_if("missing").alias("missing"),
            F.count_if("execution_fault").alias("execution_faults"), F.bool_and("reference_complete").alias("reference_complete"),
            F.count("c_initial").alias("__initial"),
            F.count_if(F.coalesce(F.col("terminal_success"), F.lit(False))).alias("__s"), F.count("first_hit").alias("__h"),
            (sum_if_all_known(F.col("objective_calls"), F.col("objective_calls").isNull()) / F.count(F.lit(1))).alias("objective_calls")]
    for name in WARM_METRICS:
        x = F.when(valid, F.col(name))
        aggs += [mean_if_all_known(x).alias(name), F.avg(known(x)).alias(f"observed_{name}")]
    out = rows.groupBy(*keys).agg(*aggs)
    ready = F.col("reference_complete")
    complete = (F.col("valid") == F.col("planned")) & ready & (F.col("__initial") == F.col("planned"))
    return out.withColumns({"complete": complete, "terminal_success_fraction": F.when(ready, F.col("__s") / F.col("planned")),
                            "hit_fraction": F.when(ready, F.col("__h") / F.col("planned"))}).drop("__initial", "__s", "__h")


def completion_report(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(~F.col("missing")).alias("completed"),
        F.count_if("execution_valid").alias("valid"), F.count_if("execution_fault").alias("unresolved_faults"),
        F.count_if("missing").alias("missing"))


def design_counts(graphs: DataFrame, depths: Sequence[int], tier1: int, reference: int, evaluation: int, gradient: int) -> DataFrame:
    """Requested task counts by role, from graph counts alone."""
    agg = graphs.agg(F.count(F.lit(1)).alias("g"), F.count_if(F.col("tier") == 2).alias("t"))
    d, deep = len(depths), sum(p >= 2 for p in depths)
    g, t = F.col("g"), F.col("t")
    rows = [("tier1", g * d * tier1), ("reference_grid", t * int(1 in depths)), ("reference_optimization", t * deep * reference),
            ("evaluation", t * d * evaluation), ("gradient_diagnostic", t * d * gradient)]
    return agg.select(F.explode(F.array(*[F.struct(F.lit(k).alias("role"), v.cast("bigint").alias("tasks")) for k, v in rows])).alias("r")).select("r.*")


def coverage_tables(graphs: DataFrame, cells: DataFrame, dims: Sequence[str] = ("n", "family", "degree_band", "cell")) -> DataFrame:
    """Split counts by size, family, degree band, cell and any other column of ``cells``; cells without graphs stay as zeros."""
    counts = graphs.groupBy("cell").agg(
        *[F.count_if(F.col("graph_split") == s).alias(s) for s in ("training", "evaluation", "not_applicable")],
        F.count_if(F.col("tier") == 2).alias("tier2"), F.count(F.lit(1)).alias("total"))
    names = ("training", "evaluation", "not_applicable", "tier2", "total")
    j = cells.join(counts, "cell", "left").na.fill(0, list(names))
    sets = j.groupingSets([[F.col(c)] for c in dims], *[F.col(c) for c in dims]).agg(*[F.sum(c).alias(c) for c in names])
    dimension = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(f"by_{c}")) for c in dims])
    return sets.select(dimension.alias("dimension"), F.coalesce(*[F.col(c).cast("string") for c in dims]).alias("value"), *names)


def coverage_status(tables: DataFrame) -> DataFrame:
    short = (F.col("training") == 0) | (F.col("evaluation") == 0)
    return tables.where("dimension = 'by_cell'").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(short).alias("short_cells"), (F.count_if(short) > 0).alias("smoke_test"))


SHOT_METRICS = ("c_initial", "c_final_exact", "quality", "quality_gain", "success")


def shot_graph_means(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repetitions to graph means: null unless every planned repetition has an exact endpoint.

    ``runs``: plan left-joined with results, columns completed, stop_reason, error,
    validation_error, exact_audit_error, c_initial, c_final, c_star, threshold, seconds.
    """
    done = F.col("completed")
    opt = done & (F.col("error").isNotNull() | is_fault(F.col("stop_reason")))
    usable = done & ~F.coalesce(opt, F.lit(False)) & F.col("c_final").isNotNull()
    values = {"c_initial": F.col("c_initial"), "c_final_exact": F.col("c_final"), "quality": F.col("c_final") / F.col("c_star"),
              "quality_gain": (F.col("c_final") - F.col("c_initial")) / F.col("c_star"),
              "success": (F.col("c_final") >= F.col("threshold")).cast("double")}
    means = [F.when(F.count_if(usable) == F.count(F.lit(1)), F.sum(F.when(usable, v)) / F.count(F.lit(1))).alias(k)
             for k, v in values.items()]
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(done).alias("completed"), F.count_if(opt).alias("optimization_failures"),
        F.count_if(done & F.col("validation_error").isNotNull()).alias("validation_failures"),
        F.count_if(done & F.col("exact_audit_error").isNotNull()).alias("exact_audit_failures"),
        F.coalesce(F.sum(F.when(done, F.col("seconds"))), F.lit(0.0)).alias("elapsed_seconds"), *means)


def shot_group_means(graph_means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal graph weights; null as soon as one graph mean is null."""
    return graph_means.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("graphs"), F.sum("planned").alias("planned"), F.sum("completed").alias("completed"),
        *[mean_if_all_known(F.col(m)).alias(m) for m in SHOT_METRICS])


def error_examples(runs: DataFrame, keys: Sequence[str], failed: Column, limit: int = 3) -> DataFrame:
    """The first failures of each group by task id; Spark limits each group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("task_id"))
    return runs.where(failed).withColumn("example", rank).where(F.col("example") <= limit)


def counter_sums(runs: DataFrame, keys: Sequence[str], column: str = "counts") -> DataFrame:
    """Sums of map counters, one row per counter name."""
    return (runs.select(*keys, F.explode(column).alias("counter", "amount")).groupBy(*keys, "counter")
            .agg(F.sum("amount").alias("amount")))


def attribution_summary(rows: DataFrame, model: str) -> DataFrame:
    """Per model and column: mean absolute, mean signed and five exact quantiles of contributions."""
    parts = rows.select(model, F.posexplode("contributions").alias("column", "x"))
    base = parts.groupBy(model, "column").agg(F.avg(F.abs("x")).alias("mean_absolute"), F.avg("x").alias("mean_signed"))
    q = (exact_quantiles(parts, [model, "column"], "x", (0.0, 0.25, 0.5, 0.75, 1.0))
         .groupBy(model, "column").agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in
                                         ((0.0, "q0"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (1.0, "q100"))]))
    return base.join(q, [model, "column"])


def attribution_models(rows: DataFrame, planned: DataFrame, model: str) -> DataFrame:
    """Per model: coverage, raw range, clipped count and the largest additivity error."""
    total = F.aggregate("contributions", F.col("bias"), lambda a, x: a + x)
    seen = rows.groupBy(model).agg(
        F.count(F.lit(1)).alias("observed"), F.min("raw").alias("raw_min"), F.max("raw").alias("raw_max"),
        F.count_if((F.col("raw") < 0) | (F.col("raw") > 1)).alias("clipped"),
        F.max(F.abs(total - F.col("raw"))).alias("max_additivity_error"))
    return planned.join(seen, model, "left").withColumns(
        {"observed": F.coalesce("observed", F.lit(0)), "complete": F.coalesce("observed", F.lit(0)) == F.col("planned")})
