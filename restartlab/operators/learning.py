"""Learning tables: folds, preprocessing, ridge and boosted fits, predictions and attributions.

A fit is named by ``fit``: one validation fold's marker, or the final fit.
Training rows are repeated once per fit they belong to (folds + 1 narrow
copies), so all fits of a model are estimated in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from restartlab.functions import angles as A
from restartlab.functions.ranks import bucketed_row_number, exact_quantiles
from restartlab.functions.scores import seed_rank

# fixed values: penalties, tie width, boosted grid
LAMBDAS = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0)
LOSS_TIE = 1e-12
BOOSTED_GRID = tuple((depth, rounds) for depth in (1, 2, 3) for rounds in (100, 300))
FINAL = "final-fit"
IMPUTED = "degree_assortativity"


def random_folds(rows: DataFrame, folds: int, seed: int) -> DataFrame:
    """Stratified folds: seeded rank inside the cell, modulo the fold count."""
    order = seed_rank(F.lit(f"fold-{seed}"), F.col("graph_id").cast("string"))
    ranked = bucketed_row_number(rows.withColumn("__o", order), ["cell"], F.substring("__o", 1, 3), [F.col("__o")], "__r")
    return ranked.withColumn("fold", F.concat(F.lit("random-"), ((F.col("__r") - 1) % folds).cast("string"))).drop("__o", "__r")


def family_folds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fold", F.col("family"))


def training_copies(rows: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Each row under every fit that trains on it."""
    fits = F.array(*map(F.lit, (*markers, FINAL)))
    return rows.withColumn("fit", F.explode(F.filter(fits, lambda f: f != F.col("fold"))))


def shuffled_features(rows: DataFrame, seed: int, scope: str) -> DataFrame:
    """Donor of every row: whole feature rows permuted inside the training set.

    Two seeded hash orders are ranked, each bucket by bucket, and matched by
    rank; no task sorts the whole set.
    """
    ids = rows.select("graph_id", F.lit(1).alias("__all"))

    def ranked(tag: str, name: str) -> DataFrame:
        order = seed_rank(F.lit(f"{tag}-{seed}"), F.lit(scope), F.col("graph_id").cast("string"))
        out = bucketed_row_number(ids.withColumn("__o", order), ["__all"], F.substring("__o", 1, 4), [F.col("__o")], "position")
        return out.select(F.col("graph_id").alias(name), "position")

    return ranked("row", "graph_id").join(ranked("donor", "donor_id"), "position").drop("position")


def shuffled_cases(rows: DataFrame, cases: Sequence[tuple[int, int, str, Column]]) -> DataFrame:
    """case, graph_id, donor_id: ``shuffled_features`` of many cases (number, seed, scope, condition on the rows) at once."""
    each = rows.select("graph_id", F.explode(F.array_compact(F.array(*[
        F.when(own, F.struct(F.lit(k).alias("case"), F.lit(seed).alias("seed"), F.lit(scope).alias("scope"))) for k, seed, scope, own in cases]))).alias("c"))

    def ranked(tag: str, name: str) -> DataFrame:
        order = F.unhex(seed_rank(F.concat(F.lit(f"{tag}-"), F.col("c.seed").cast("string")), F.col("c.scope"), F.col("graph_id").cast("string")))
        out = each.select(F.col("graph_id").alias(name), F.col("c.case").alias("case"), order.alias("__o"))
        return bucketed_row_number(out, ["case"], F.substring("__o", 1, 2), [F.col("__o")], "position").drop("__o")

    return ranked("row", "graph_id").join(ranked("donor", "donor_id"), ["case", "position"]).drop("position")


def preprocessing(copies: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per fit: assortativity median, then mean, population deviation and constancy of every column."""
    medians = exact_quantiles(copies, ["fit"], IMPUTED, (0.5,)).select("fit", F.col("quantile").alias("__median"))
    filled = impute(copies.join(F.broadcast(medians), "fit", "left"))  # one row per fit
    aggs = [F.max(F.coalesce("__median", F.lit(0.0))).alias("median"), F.count(F.lit(1)).alias("rows")]
    aggs += [F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in names]
    aggs += [F.stddev_pop(F.col(c).cast("double")).alias(f"std_{c}") for c in names]
    agg = filled.groupBy("fit").agg(*aggs)
    mean, std = F.array(*[F.col(f"mean_{c}") for c in names]), F.array(*[F.col(f"std_{c}") for c in names])
    constant = F.zip_with(mean, std, lambda m, s: s <= 1e-12 * F.greatest(F.lit(1.0), F.abs(m)))
    return agg.select("fit", "rows", "median", mean.alias("mean"), std.alias("std"), constant.alias("constant"))


def impute(rows: DataFrame, median: str = "__median") -> DataFrame:
    return rows.withColumn(IMPUTED, F.coalesce(IMPUTED, F.coalesce(F.col(median), F.lit(0.0))))


def standardised(rows: DataFrame, prep: DataFrame, names: Sequence[str], unknown: float | None = 0.0) -> DataFrame:
    """Rows with ``z``: imputed, centred, scaled; constant columns are zero, an undefined value is ``unknown``."""
    j = impute(rows.join(F.broadcast(prep), "fit"), "median")
    raw = F.array(*[F.col(c).cast("double") for c in names])
    scale = F.zip_with("std", "constant", lambda s, k: F.struct(s.alias("s"), k.alias("k")))
    scaled = F.zip_with(F.zip_with(raw, "mean", lambda x, m: x - m), scale,
                        lambda d, c: F.when(c["k"], F.lit(0.0)).otherwise(F.coalesce(d / c["s"], F.lit(unknown).cast("double"))))
    return j.withColumn("z", scaled).drop("mean", "std", "constant", "median", "rows")


def ridge_models(rows: DataFrame, width: int, outputs: int, lambdas: Sequence[float] = LAMBDAS) -> DataFrame:
    """Ridge coefficients of every fit and penalty from one pass over (fit, z, y).

    Tasks reduce their rows to partial Gram matrices; Spark adds them up and the
    small normal equations of each fit are solved once per penalty.
    Objective: mean squared error + penalty * |w|^2, free intercept.
    """
    side = width + outputs + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for fit, part in batch.groupby("fit"):
                block = np.column_stack([np.array(part["z"].tolist(), dtype=float).reshape(len(part), width),
                                         np.array(part["y"].tolist(), dtype=float).reshape(len(part), outputs), np.ones(len(part))])
                held[fit] = held.get(fit, 0.0) + block.T @ block
        for fit, gram in held.items():
            yield pd.DataFrame({"fit": fit, "at": np.arange(side * side), "v": gram.ravel()})

    grams = rows.select("fit", "z", "y").mapInPandas(partial, "fit string, at int, v double")
    whole = grams.groupBy("fit", "at").agg(F.sum("v").alias("v")).groupBy("fit").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("gram"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fit, flat in zip(batch["fit"], batch["gram"]):
                gram = np.array(flat, dtype=float).reshape(side, side)
                n = gram[-1, -1]
                mean_z, mean_y = gram[:width, -1] / n, gram[width:-1, -1] / n
                cov = gram[:width, :width] / n - np.outer(mean_z, mean_z)
                cross = gram[:width, width:-1] / n - np.outer(mean_z, mean_y)
                for penalty in lambdas:
                    coef = np.linalg.solve(cov + penalty * np.eye(width), cross)
                    yield pd.DataFrame({"fit": [fit], "choice": [float(penalty)], "intercept": [(mean_y - mean_z @ coef).tolist()],
                                        "coef": [coef.T.tolist()]})

    return whole.mapInPandas(solve, "fit string, choice double, intercept array<double>, coef array<array<double>>")


def linear_predictions(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Raw outputs of every row under each model of its fit; models are fits x penalties rows."""
    j = rows.join(F.broadcast(models), "fit")
    dot = lambda w: F.aggregate(F.zip_with(w, F.col("z"), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    raw = F.zip_with(F.transform("coef", dot), "intercept", lambda a, b: a + b)
    return j.withColumn("raw", raw).drop("coef", "intercept")


def success_loss(raw: Column, rate: Column) -> Column:
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return (clipped - rate) * (clipped - rate)


def choose_model(losses: DataFrame, order: str, last: bool) -> DataFrame:
    """Mean out-of-fold loss per choice and the selected one: last or first within the tie width."""
    scores = losses.groupBy(order).agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("graphs"))
    whole = W.partitionBy(F.lit(1))  # one row per choice: eight penalties or six candidates
    near = scores.withColumn("eligible", F.col("mean_loss") <= F.min("mean_loss").over(whole) + LOSS_TIE)
    candidate = F.when(F.col("eligible"), F.col(order))
    pick = F.max(candidate) if last else F.min(candidate)
    return near.withColumn("selected", F.col(order) == pick.over(whole)).select(order, "mean_loss", "graphs", "eligible", "selected")


def fold_anchors(rows: DataFrame, part: str, fits: dict[str, set], p: int) -> DataFrame:
    """fit, anchor: medoid of the training angles of every fit, a fit being the set of parts it learns from."""
    from restartlab.operators.angles import scoped_medoids

    return scoped_medoids(rows, "graph_id", part, fits, p).select(F.col("scope").alias("fit"), F.col("theta").alias("anchor"))


def angle_targets(points: DataFrame, anchors: DataFrame, p: int) -> DataFrame:
    """Encoded labels aligned to their fit's anchor."""
    j = points.join(F.broadcast(anchors), "fit")  # one row per fit
    return j.withColumn("y", A.encode(A.align_label(F.col("theta"), F.col("anchor"), F.col("parity"), p)["lift"], p))


def linear_attributions(rows: DataFrame, models: DataFrame, output: int = 0) -> DataFrame:
    """Exact additive contributions of a linear model: coefficient times standardised value, null where the value is."""
    j = rows.join(F.broadcast(models), "fit")
    parts = F.zip_with(F.col("coef")[output], F.col("z"), lambda a, b: a * b)
    return j.select("graph_id", F.col("intercept")[output].alias("bias"), F.posexplode(parts).alias("feature", "contribution"))


def unseen_types(types: DataFrame, training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Joint edge types of each target that no training graph shows: count and share of edges."""
    seen = types.join(training.select("graph_id"), "graph_id", "left_semi").select("type_index").distinct().withColumn("seen", F.lit(True))
    t = types.join(evaluation.select("graph_id"), "graph_id", "left_semi").join(F.broadcast(seen), "type_index", "left")  # at most 2300 types
    new = F.col("seen").isNull()
    return t.groupBy("graph_id").agg(F.count_if(new).alias("unseen_type_count"),
                                     (F.coalesce(F.sum(F.when(new, F.col("edges"))), F.lit(0)) / F.sum("edges")).alias("unseen_type_fraction"))


def range_novelty(features: DataFrame, training: DataFrame, evaluation: DataFrame, names: Sequence[str]) -> DataFrame:
    """Features of each target outside the training range, or never observed in training."""
    t = features.join(training.select("graph_id"), "graph_id", "left_semi")
    bounds = t.agg(*[F.min(c).alias(f"lo_{c}") for c in names], *[F.max(c).alias(f"hi_{c}") for c in names]).withColumn("k", F.lit(1))
    e = features.join(evaluation.select("graph_id"), "graph_id", "left_semi").withColumn("k", F.lit(1)).join(F.broadcast(bounds), "k")

    def outside(c: str) -> Column:
        x = F.col(c)
        return x.isNotNull() & (F.col(f"lo_{c}").isNull() | (x < F.col(f"lo_{c}")) | (x > F.col(f"hi_{c}")))

    flags = F.array_compact(F.array(*[F.when(outside(c), F.lit(c)) for c in names]))
    return e.select("graph_id", F.size(flags).cast("bigint").alias("out_of_range_count"), (F.size(flags) / len(names)).alias("out_of_range_fraction"),
                    F.array_join(flags, ",").alias("out_of_range_features"))


def missing_fits(specs: DataFrame, saved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned fits without a saved model; null keys match null keys."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
    return specs.withColumn("__key", key).join(saved.select(key.alias("__key")).distinct(), "__key", "left_anti").drop("__key")
