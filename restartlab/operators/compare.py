"""Paired comparisons of methods over graphs, with planned denominators and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from restartlab.functions.scores import finite, known, mean_if_all_known, wilson_lower, wilson_upper
from restartlab.operators.bootstrap import draw_sums, interval
from restartlab.session import cut_lineage


def metric_rows(pairs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form: one row per pair and metric with baseline and method value."""
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"baseline_{m}").alias("baseline_value"),
                               F.col(f"method_{m}").alias("method_value")) for m in metrics])
    return pairs.select(*keys, "complete", F.explode(parts).alias("m")).select(*keys, "complete", "m.*")


def paired_means(pairs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means of both arms and of their difference; unknown when one graph is unknown."""
    rows = metric_rows(pairs, keys, metrics)
    method, baseline = F.col("method_value"), F.col("baseline_value")
    delta = method - baseline
    both = F.count_if(~(finite(method) & finite(baseline))) == 0
    status = (F.when(~F.bool_and("complete"), "provisional").when(F.count(F.lit(1)) < 2, "fewer_than_two_graphs")
              .when(~both, "metric_unavailable").otherwise("available"))
    return rows.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("graphs"), F.bool_and("complete").alias("complete"), mean_if_all_known(baseline).alias("baseline_mean"),
        mean_if_all_known(method).alias("method_mean"), F.when(both, F.avg(delta)).alias("difference"), status.alias("ci_status"))


def paired_bootstrap(pairs: DataFrame, keys: Sequence[str], metrics: Sequence[str], draws: int = 2000, seed: int = 20260912) -> DataFrame:
    """Means plus a percentile interval of the mean difference, where the comparison supports one."""
    means = paired_means(pairs, keys, metrics)
    deltas = [F.coalesce(known(F.col(f"method_{m}") - F.col(f"baseline_{m}")), F.lit(0.0)).alias(m) for m in metrics]
    ready = pairs.groupBy(*keys).agg(F.bool_and("complete").alias("__c"), F.count(F.lit(1)).alias("__n")).where("__c and __n > 1")
    rows = (pairs.join(ready.select(*keys), list(keys), "left_semi") if keys else pairs).select(*keys, "graph_id", *deltas)
    sums = draw_sums(rows, keys, [], "graph_id", metrics, draws, seed)
    long = sums.select(*keys, "draw", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"sum_{m}") / F.col("size")).alias("x"))
                                                          for m in metrics])).alias("m")).select(*keys, "draw", "m.*")
    ci = interval(long, [*keys, "metric"], "x")
    ok = F.col("ci_status") == "available"
    return means.join(ci, [*keys, "metric"], "left").withColumns(
        {"ci_low": F.when(ok, F.col("ci_low")), "ci_high": F.when(ok, F.col("ci_high"))})


def pick_sums(pairs: DataFrame, keys: Sequence[str], draws: int = 2000, seed: int = 20260912) -> DataFrame:
    """What the draws of each comparison add up to: how many draws, and the fewest and most picks of one."""
    ones = draw_sums(pairs.select(*keys, "graph_id").withColumn("one", F.lit(1.0)), keys, [], "graph_id", ["one"], draws, seed)
    return ones.groupBy(*keys, F.col("size").alias("graphs")).agg(
        F.count(F.lit(1)).alias("draws"), F.min("sum_one").cast("bigint").alias("fewest_picks"), F.max("sum_one").cast("bigint").alias("most_picks"))


def with_intervals(pairs: DataFrame, keys: Sequence[str], metrics: Sequence[str], draws: int = 2000, seed: int = 20260912) -> DataFrame:
    """``paired_bootstrap`` for comparisons whose keys may be null: a null key names a comparison like any other."""
    named = [f"__{k}" for k in keys]
    safe = pairs.withColumns({f"__{k}": F.concat(F.when(F.col(k).isNull(), "0").otherwise("1"), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys})
    out = paired_bootstrap(safe, named, metrics, draws, seed)
    types = dict(pairs.select(*keys).dtypes)
    back = [F.when(F.substring(f"__{k}", 1, 1) == "1", F.substring(f"__{k}", F.lit(2), F.length(f"__{k}"))).cast(types[k]).alias(k) for k in keys]
    return out.select(*back, *[c for c in out.columns if c not in named])


def success_with_intervals(pairs: DataFrame, keys: Sequence[str], draws: int = 2000, seed: int = 20260912) -> DataFrame:
    """``success_intervals`` for comparisons whose keys may be null."""
    named = [f"__{k}" for k in keys]
    safe = pairs.withColumns({f"__{k}": F.concat(F.when(F.col(k).isNull(), "0").otherwise("1"), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys})
    out = success_intervals(safe, named, draws, seed)
    types = dict(pairs.select(*keys).dtypes)
    back = [F.when(F.substring(f"__{k}", 1, 1) == "1", F.substring(f"__{k}", F.lit(2), F.length(f"__{k}"))).cast(types[k]).alias(k) for k in keys]
    return out.select(*back, *[c for c in out.columns if c not in named])


def stratified_means(pairs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Graph-equal and cell-equal mean differences."""
    deltas = metric_rows(pairs, ["graph_id", "cell"], metrics).withColumn("x", F.col("method_value") - F.col("baseline_value"))
    cells = deltas.groupBy("metric", "cell").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("k"))
    both = cells.groupBy("metric").agg((F.sum("s") / F.sum("k")).alias("graph_equal"), F.avg(F.col("s") / F.col("k")).alias("cell_equal"),
                                       F.sum("k").alias("graphs"), F.count(F.lit(1)).alias("cells"))
    return both


def stratified_bootstrap(pairs: DataFrame, metrics: Sequence[str], draws: int = 2000, seed: int = 20261115) -> DataFrame:
    """Intervals of both weightings; picks stay inside a design cell."""
    rows = pairs.select("graph_id", "cell", *[(F.col(f"method_{m}") - F.col(f"baseline_{m}")).alias(m) for m in metrics])
    sums = draw_sums(rows, [], ["cell"], "graph_id", metrics, draws, seed)
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"sum_{m}").alias("s")) for m in metrics])
    per_draw = (sums.select("draw", "size", F.explode(parts).alias("m")).groupBy("m.metric", "draw")
                .agg((F.sum("m.s") / F.sum("size")).alias("graph_equal"), F.avg(F.col("m.s") / F.col("size")).alias("cell_equal")))
    out = stratified_means(pairs, metrics)
    for scheme in ("graph_equal", "cell_equal"):
        ci = interval(per_draw, ["metric"], scheme).withColumnsRenamed({"ci_low": f"{scheme}_low", "ci_high": f"{scheme}_high"})
        out = out.join(ci, "metric")
    return out


def success_intervals(pairs: DataFrame, keys: Sequence[str], draws: int = 2000, seed: int = 20260912) -> DataFrame:
    """Baseline fraction with a graph bootstrap; single-start method fraction with a nominal Wilson interval."""
    points = success_points(pairs, keys)
    ready = points.where("complete and graphs > 1").select(*keys)
    rows = pairs.join(ready, list(keys), "left_semi").select(*keys, "graph_id", F.coalesce("baseline_success", F.lit(0.0)).alias("x"))
    sums = draw_sums(rows, keys, [], "graph_id", ["x"], draws, seed)
    ci = interval(sums.withColumn("mean", F.col("sum_x") / F.col("size")), keys, "mean")
    return points.join(ci.withColumnsRenamed({"ci_low": "baseline_low", "ci_high": "baseline_high"}), list(keys), "left")


def success_points(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    agg = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("graphs"), F.bool_and("complete").alias("complete"), mean_if_all_known(F.col("baseline_success")).alias("baseline_fraction"),
        mean_if_all_known(F.col("method_success")).alias("method_fraction"), F.sum("method_success").alias("__s"),
        F.count("method_success").alias("__k"))
    s = F.when((F.col("__k") == F.col("graphs")) & F.col("complete"), F.col("__s"))
    return agg.withColumns({"method_low": wilson_lower(s, F.col("graphs")), "method_high": wilson_upper(s, F.col("graphs"))}).drop("__s", "__k")


def prediction_errors(rows: DataFrame) -> DataFrame:
    """Squared and absolute errors of a method and a baseline against the observed rate."""
    m, b = F.col("method") - F.col("observed"), F.col("baseline") - F.col("observed")
    return rows.withColumns({"m2": m * m, "b2": b * b, "m1": F.abs(m), "b1": F.abs(b)})


def prediction_comparison(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE and MAE of both, and their differences; null unless every graph has a label."""
    e = prediction_errors(rows)
    full = F.count("observed") == F.count(F.lit(1))

    def at(x: Column) -> Column:
        return F.when(full, x)

    rm, rb, am, ab = F.sqrt(F.avg("m2")), F.sqrt(F.avg("b2")), F.avg("m1"), F.avg("b1")
    return e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("graphs"), F.count("observed").alias("valid_labels"), full.alias("complete"),
        at(rm).alias("method_rmse"), at(rb).alias("baseline_rmse"), at(rm - rb).alias("rmse_difference"),
        at(am).alias("method_mae"), at(ab).alias("baseline_mae"), at(am - ab).alias("mae_difference"))


def prediction_bootstrap(rows: DataFrame, keys: Sequence[str], draws: int = 2000, seed: int = 20260912) -> DataFrame:
    """Intervals of RMSE and MAE differences; RMSE is recomputed inside every draw."""
    points = prediction_comparison(rows, keys)
    ready = points.where("complete and graphs > 1").select(*keys)
    e = prediction_errors(rows).join(ready, list(keys), "left_semi")
    sums = draw_sums(e, keys, [], "graph_id", ["m2", "b2", "m1", "b1"], draws, seed)
    n = F.col("size")
    stats = sums.withColumns({"rmse": F.sqrt(F.col("sum_m2") / n) - F.sqrt(F.col("sum_b2") / n), "mae": (F.col("sum_m1") - F.col("sum_b1")) / n})
    for name in ("rmse", "mae"):
        ci = interval(stats, keys, name).withColumnsRenamed({"ci_low": f"{name}_low", "ci_high": f"{name}_high"})
        points = points.join(ci, list(keys), "left")
    return points


def with_strata(pairs: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """One copy of each pair per descriptive dimension, and one for all graphs."""
    parts = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value"))]
    parts += [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    return pairs.withColumn("__s", F.explode(F.array(*parts))).select("*", "__s.dimension", "__s.value").drop("__s")


# fixed values: design of the adjusted family model
STRATA = tuple((n, band) for n in (12, 16, 20, 24) for band in (3, 5))
CONTRASTS = tuple((band, family) for band in (3, 5) for family in ("regular", "ba", "sbm"))
TERMS = (*(f"n{n}_band{b}" for n, b in STRATA), *(f"{f}_minus_er_band{b}" for b, f in CONTRASTS), "actual_degree_centered")


def family_design(rows: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """graph_id, the stratum, the degree ``d`` centred on its size and band, and the outcomes."""
    known_stratum = F.array_contains(F.array(*[F.lit(f"{n}:{b}") for n, b in STRATA]), F.concat_ws(":", "n", "degree_band"))
    rows = rows.withColumn("n", F.when(known_stratum, F.col("n")).otherwise(F.raise_error(F.lit("graph outside the design strata")).cast("bigint")))
    centres = rows.groupBy("n", "degree_band").agg(F.avg("mean_degree").alias("__centre"))
    j = rows.join(F.broadcast(centres), ["n", "degree_band"])  # eight strata at most
    return j.select("graph_id", "n", "family", "degree_band", (F.col("mean_degree") - F.col("__centre")).alias("d"), *outcomes)


def _moments(outcomes: Sequence[str], top: int) -> dict[str, Column]:
    """What the normal equations need of a graph: inside a stratum every design column is a constant or a power of ``d``."""
    power = [F.lit(1.0), F.col("d"), F.col("d") * F.col("d")]
    out = {f"d{p}": power[p // 2] * power[p - p // 2] for p in range(1, 2 * top + 1)}
    return out | {f"y{p}_{o}": power[p] * F.col(outcome) for p in range(top + 1) for o, outcome in enumerate(outcomes)}


def _normal_sums(strata: DataFrame, outcomes: Sequence[str], quadratic: bool) -> tuple[DataFrame, int, list[str]]:
    """Sums of products of design columns per draw, from the moments of its strata; width and terms of the design."""
    terms = list(TERMS)
    design = [(((F.col("n") == n) & (F.col("degree_band") == b)).cast("double"), 0) for n, b in STRATA]
    design += [(((F.col("family") == f) & (F.col("degree_band") == b)).cast("double"), 0) for b, f in CONTRASTS]
    design.append((F.lit(1.0), 1))
    if quadratic:
        design.append((F.lit(1.0), 2))
        terms.append("actual_degree_centered_squared")
    sums = []
    for i, (x, p) in enumerate(design):
        sums += [F.sum(x * z * F.col(f"sum_d{p + q}")).alias(f"g{i}_{i + k}") for k, (z, q) in enumerate(design[i:])]
        sums += [F.sum(x * F.col(f"sum_y{p}_{o}")).alias(f"h{i}_{o}") for o in range(len(outcomes))]
    return strata.withColumn("sum_d0", F.col("size").cast("double")).groupBy("draw").agg(*sums), len(design), terms


def _solve(width: int, terms: Sequence[str], outcomes: Sequence[str]):
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            gram, right = np.zeros((n, width, width)), np.zeros((n, width, len(outcomes)))
            for i in range(width):
                for k in range(i, width):
                    gram[:, i, k] = gram[:, k, i] = batch[f"g{i}_{k}"]
                for o in range(len(outcomes)):
                    right[:, i, o] = batch[f"h{i}_{o}"]
            if n and (np.linalg.matrix_rank(gram) < width).any():
                raise ValueError("rank-deficient family design")
            beta = np.linalg.solve(gram, right)
            for t, term in enumerate(terms):
                for o, outcome in enumerate(outcomes):
                    yield pd.DataFrame({"draw": batch["draw"], "term": term, "outcome": outcome, "estimate": beta[:, t, o]})

    return solve


def adjusted_family(rows: DataFrame, outcomes: Sequence[str], quadratic: bool = False, draws: int = 2000, seed: int = 20260930) -> DataFrame:
    """Least-squares family contrasts with stratified bootstrap intervals."""
    return adjusted_families(rows, outcomes, {"": quadratic}, draws, seed).drop("model")


def adjusted_families(rows: DataFrame, outcomes: Sequence[str], models: dict[str, bool], draws: int = 2000, seed: int = 20260930) -> DataFrame:
    """``adjusted_family`` of several models (name, whether quadratic) that see the same draws.

    Only moments of the centred degree and the outcomes are summed per stratum and
    draw; products of design columns follow from them, and the small normal
    equations of each draw are solved, many draws per task. A singular design
    is an error.
    """
    keys = ["n", "family", "degree_band"]
    moments = _moments(outcomes, 1 + any(models.values()))
    design = family_design(cut_lineage(rows.select("graph_id", *keys, "mean_degree", *outcomes)), outcomes).select(
        "graph_id", *keys, *[c.alias(name) for name, c in moments.items()])
    strata = design.groupBy(*keys).agg(F.lit(-1).cast("bigint").alias("draw"), *[F.sum(m).alias(f"sum_{m}") for m in moments], F.count(F.lit(1)).alias("size"))
    if draws:
        strata = strata.unionByName(draw_sums(design, [], keys, "graph_id", list(moments), draws, seed))
    strata = cut_lineage(strata)
    out = None
    for model, quadratic in models.items():
        sums, width, terms = _normal_sums(strata, outcomes, quadratic)
        solved = cut_lineage(sums.mapInPandas(_solve(width, terms, outcomes), "draw bigint, term string, outcome string, estimate double"))
        part = solved.where("draw < 0").select("term", "outcome", "estimate")
        if draws:
            part = part.join(interval(solved.where("draw >= 0"), ["term", "outcome"], "estimate"), ["term", "outcome"])
        part = part.withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return out


def stability_report(prefixes: DataFrame, halves: DataFrame, union: DataFrame, cstar: DataFrame, last: str, before: str,
                     tolerance: float) -> DataFrame:
    """Half gap and last prefix gain of a reference pool, normalised by the optimum, with the stability flag."""
    j = prefixes.join(halves.select("graph_id", "half_1", "half_2"), "graph_id").join(
        union.select("graph_id", "old_c_ref", "new_c_ref", "c_ref"), "graph_id").join(cstar, "graph_id")
    gap = F.abs(F.col("half_1") - F.col("half_2")) / F.col("c_star")
    gain = (F.col(last) - F.col(before)) / F.col("c_star")
    return j.withColumns({"half_gap": gap, "last_prefix_gain": gain, "union_gain_over_old": (F.col("c_ref") - F.col("old_c_ref")) / F.col("c_star"),
                          "stability_flag": F.greatest(gap, gain) > tolerance})
