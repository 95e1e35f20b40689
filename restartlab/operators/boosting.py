"""Boosted regression trees grown from histograms that Spark adds up, for all folds and depths at once.

Training rows are binned once and packed into blocks that stay cached with their
running sums. A round grows one tree per (fit, depth); each of its levels is one
pass over the blocks for residual sums and row counts by (model, node, feature,
bin), smaller children only, as the other child is its parent less that one. The pass
of a root also adds the trees of the round before. Only
these sums reach the driver, which picks the splits. Residuals are summed as
integers, so a model does not depend on how the rows are dealt. 100 rounds are the
first 100 of 300.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from restartlab.operators.models import stored_table
from restartlab.session import checkpointed_rdd

# fixed values: rate, leaf penalty, least rows of a child, bins
RATE, PENALTY, LEAST, BINS = 0.05, 1.0, 5, 256
MISSING = 255  # bin of a missing value; each fit reads a value of its own instead
SCALE = float(2**32)  # residuals are summed in units of 2 ** -32
REPLAY = 20  # rounds between checkpoints of the running sums
FAN_IN = 16  # partial histograms that may go to the driver without being added first
LEAST_PART, MOST_PART = 2048, 500_000  # rows of a partition: below the first, tasks cost more than they do
BLOCK = "ids binary, fold binary, label binary, bins binary"
STATE = "ids array<string>, fold array<int>, label array<double>, raw binary"


@dataclass
class Plan:
    """What all tasks need: fits (held-out fold number, -1 for none), depths, start values and each fit's bins of missing values."""

    fits: list[int]
    depths: list[int]
    base: np.ndarray  # per fit
    fill: np.ndarray  # (fits, features)

    @property
    def models(self) -> list[tuple[int, int]]:
        return [(f, d) for f in range(len(self.fits)) for d in self.depths]


def feature_cuts(rows: DataFrame, names: Sequence[str], accuracy: int = 10_000) -> list[list[float]]:
    """At most BINS - 2 rising cut values per feature, from mergeable quantile sketches; a value's bin is the number of cuts below it."""
    probs = [(i + 1) / (BINS - 1) for i in range(BINS - 2)]
    sketch = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return [sorted(set(x or [])) for x in sketch]


def binned(rows: DataFrame, key: str, label: str, fold: Column, names: Sequence[str], cuts: list[list[float]], block: int = 5000) -> DataFrame:
    """Rows packed into blocks: keys, fold numbers, labels and one byte per feature. Null features get their own bin."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at:at + block]
                bins = np.full((len(part), len(names)), MISSING, np.uint8)
                for i, c in enumerate(names):
                    x = part[c].to_numpy(float)
                    known = ~np.isnan(x)
                    bins[known, i] = np.searchsorted(cuts[i], x[known], side="left")
                yield pd.DataFrame({"ids": [pickle.dumps(part["__key"].tolist())], "fold": [part["__fold"].to_numpy(np.int32).tobytes()],
                                    "label": [part["__label"].to_numpy(float).tobytes()], "bins": [bins.tobytes()]})

    flat = rows.select(F.col(key).cast("string").alias("__key"), fold.cast("int").alias("__fold"), F.col(label).cast("double").alias("__label"),
                       *[F.col(c).cast("double").alias(c) for c in names])
    return flat.where("__label is not null").mapInPandas(pack, BLOCK)


def _steps(plan: Plan, fit: int, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Next node by node and bin of one tree, missing values as the fit reads them; a node without a split keeps its rows."""
    node = np.arange(len(feature))[:, None]
    bins = np.repeat(np.arange(BINS)[None, :], len(feature), 0)
    bins[:, MISSING] = plan.fill[fit, np.maximum(feature, 0)]
    return np.where(feature[:, None] < 0, node, 2 * node + 1 + (bins > cut[:, None])).astype(np.intp)


def _place(bins: np.ndarray, plan: Plan, fit: int, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row (features, rows) in one tree after some levels."""
    count = bins.shape[1]
    if feature[0] < 0:
        return np.zeros(count, np.intp)
    steps = _steps(plan, fit, feature[:2**levels - 1], cut[:2**levels - 1])
    at = steps[0][bins[feature[0]]]
    flat, steps, start, row = bins.ravel(), steps.ravel(), np.maximum(feature, 0) * count, np.arange(count)
    for _ in range(1, levels):
        at = steps[at * BINS + flat[start[at] + row]]
    return at


def walk(bins: np.ndarray, plan: Plan, tree: tuple[np.ndarray, np.ndarray, np.ndarray], raw: np.ndarray) -> np.ndarray:
    """Add a round's trees (feature, cut, value by model and node) to the running sums (models, rows)."""
    feature, cut, value = tree
    wide = np.ascontiguousarray(bins.T)
    return np.stack([raw[m] + value[m][_place(wide, plan, f, feature[m], cut[m], d)] for m, (f, d) in enumerate(plan.models)])


def _opened(row, plan: Plan, features: int) -> tuple:
    """A block in memory: keys (packed), fold numbers, labels, bins and the running sums (models, rows), start values at first."""
    fold, label = np.frombuffer(row.fold, np.int32), np.frombuffer(row.label, float)
    start = np.repeat(plan.base, len(plan.depths))[:, None]
    return bytes(row.ids), fold, label, np.frombuffer(row.bins, np.uint8).reshape(-1, features), np.repeat(start, len(label), 1)


def _advanced(plan: Plan, tree: tuple):
    def run(block: tuple) -> tuple:
        ids, fold, label, bins, raw = block
        return ids, fold, label, bins, walk(bins, plan, tree, raw)

    return run


def _spots(bins: np.ndarray) -> np.ndarray:
    """Place of every value (rows, features) among features x bins: all features of a row are counted together."""
    return bins + np.arange(bins.shape[1], dtype=np.intp) * BINS


def _told(total: dict[int, np.ndarray], fits: Sequence[int], plan: Plan) -> Iterator[tuple]:
    """Sums by model or fit, with those of missing values in the bin that the fit reads for them."""
    for key, one in total.items():
        for i, bin_ in enumerate(plan.fill[fits[key]]):
            missing = one[..., i, MISSING].copy()
            one[..., i, MISSING] = 0
            one[..., i, bin_] += missing
        yield key, one


def _counts(plan: Plan, features: int):
    """Row counts of every fit by feature and bin: those of all root nodes, in every round."""

    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        total: dict[int, np.ndarray] = {}
        for _, fold, _, bins, _ in blocks:
            spots = _spots(bins)
            for f, left_out in enumerate(plan.fits):
                one = np.bincount(spots[fold != left_out].ravel(), minlength=features * BINS).reshape(features, BINS)
                total[f] = total.get(f, 0) + one
        yield from _told(total, range(len(plan.fits)), plan)

    return run


def _histogram(plan: Plan, features: int, now: tuple, level: int):
    """Partial sums of one level of the current trees, per model: (2, nodes, features, bins) of sums and counts of one child of each node; sums alone of the root.

    ``now`` has the features and cuts of the trees so far, and which child of a node it is (0 left, 1 right).
    """

    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        total: dict[int, np.ndarray] = {}
        nodes, many = 2**max(level - 1, 0), features * BINS
        fit_of = [f for f, _ in plan.models]
        deep = [m for m, (_, d) in enumerate(plan.models) if d > level]
        for _, fold, label, bins, raw in blocks:
            spots, weights = _spots(bins), np.empty((len(bins), features))
            wide = np.ascontiguousarray(bins.T) if level else None
            trained = [fold != left_out for left_out in plan.fits]
            for m in deep:
                f = fit_of[m]
                rest = np.rint((label - raw[m]) * SCALE)  # whole numbers: a block's sums are exact in double
                if m not in total:
                    total[m] = np.zeros((2 if level else 1, nodes, features, BINS), np.int64)
                if not level:
                    weights[:] = np.where(trained[f], rest, 0)[:, None]
                    total[m][0, 0] += np.bincount(spots.ravel(), weights.ravel(), many).astype(np.int64).reshape(features, BINS)
                    continue
                place, side = _place(wide, plan, f, now[0][m], now[1][m], level), now[2][m, nodes - 1:2 * nodes - 1]
                for node in range(nodes):
                    pick = np.flatnonzero((place == 2**level - 1 + 2 * node + side[node]) & trained[f])
                    if not len(pick):
                        continue
                    own, load = spots[pick].ravel(), weights[:len(pick)]
                    load[:] = rest[pick][:, None]
                    total[m][0, node] += np.bincount(own, load.ravel(), many).astype(np.int64).reshape(features, BINS)
                    total[m][1, node] += np.bincount(own, minlength=many).reshape(features, BINS)
        yield from _told(total, fit_of, plan)

    return run


def _summed(parts: RDD) -> dict[int, np.ndarray]:
    """Partial sums by key on the driver: models x nodes x features x bins numbers from at most FAN_IN tasks."""
    if parts.getNumPartitions() > FAN_IN:
        parts = parts.reduceByKey(np.add, FAN_IN)
    total: dict[int, np.ndarray] = {}
    for key, one in parts.collect():
        total[key] = total[key] + one if key in total else one
    return total


def best_splits(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none) and cut of every node from (nodes, features, bins) histograms, and left, right and own leaf values.

    Gain is the fall of the penalised squared error; the first feature and the
    lowest cut win ties. A child has LEAST rows at least.
    """
    left, n = np.cumsum(sums, 2) / SCALE, np.cumsum(counts, 2)
    all_sum, all_n = left[:, :, -1:], n[:, :, -1:]
    worth = lambda g, c: g * g / (c + PENALTY)
    gain = worth(left, n) + worth(all_sum - left, all_n - n) - worth(all_sum, all_n)
    gain = np.where((n >= LEAST) & (all_n - n >= LEAST), gain, -np.inf).reshape(len(sums), -1)
    top = gain.argmax(1)
    feature, cut = np.divmod(top, sums.shape[2])
    node = np.arange(len(sums))
    good = gain[node, top] > 1e-6
    value = lambda g, c: RATE * g / (c + PENALTY)
    g, c, total, rows = left[node, feature, cut], n[node, feature, cut], all_sum[:, 0, 0], all_n[:, 0, 0]
    return np.where(good, feature, -1), cut, value(g, c), value(total - g, rows - c), value(total, rows)


def grow(blocks: RDD, plan: Plan, features: int, rounds: int, states: Sequence[int], spark: SparkSession) -> tuple[list, dict[int, DataFrame]]:
    """Trees of every round, and the blocks with running sums after each round in ``states``.

    Blocks stay cached; a lost one comes back from the last checkpoint and the trees since.
    """
    data, before, done, kept, models = blocks.persist(StorageLevel.MEMORY_AND_DISK), None, [], {}, plan.models
    roots = _summed(data.mapPartitions(_counts(plan, features)))
    none = np.zeros((1, features, BINS), np.int64)
    for turn in range(1, rounds + 1):
        feature = np.full((len(models), 15), -1, np.int64)
        cut, value, cover = np.zeros((len(models), 15), np.int64), np.zeros((len(models), 15)), np.zeros((len(models), 15), np.int64)
        above: dict[int, np.ndarray] = {}  # histograms (2, nodes, features, bins) of the level above
        for level in range(max(plan.depths)):
            child = np.zeros((len(models), 15), np.int64)
            child[:, :7] = cover[:, 2:15:2] < cover[:, 1:15:2]
            found = _summed(data.mapPartitions(_histogram(plan, features, (feature, cut, child), level)))
            if before is not None:  # the pass of the root has made the blocks of this round
                before.unpersist()
                before = None
            here: dict[int, np.ndarray] = {}
            for m, (fit, depth) in enumerate(models):
                if depth <= level:
                    continue
                if not level:
                    here[m] = np.stack([found[m][0, 0][None], roots[fit][None]]) if m in found else np.stack([none, none])
                else:
                    parents = np.arange(2**(level - 1)) + 2**(level - 1) - 1
                    small = found[m] if m in found else np.zeros_like(above[m])
                    other = np.where((feature[m, parents] >= 0)[None, :, None, None], above[m] - small, 0)
                    right = (child[m, parents] == 1)[None, :, None, None]
                    here[m] = np.stack([np.where(right, other, small), np.where(right, small, other)], 2).reshape(2, 2**level, features, BINS)
                sums, counts = here[m]
                f, c, left, right, own = best_splits(sums, counts)
                nodes = np.arange(2**level) + 2**level - 1
                cover[m, nodes] = counts[:, 0].sum(1)
                live = cover[m, nodes] > 0
                f = np.where(live, f, -1)
                feature[m, nodes], cut[m, nodes] = f, c
                if level == 0:
                    value[m, 0] = own[0]
                for side, v in ((1, left), (2, right)):
                    value[m, 2 * nodes + side] = np.where(f >= 0, v, 0)
                n = np.cumsum(counts, 2)
                cover[m, 2 * nodes + 1] = np.where(f >= 0, n[np.arange(len(f)), np.maximum(f, 0), c], 0)
                cover[m, 2 * nodes + 2] = np.where(f >= 0, cover[m, nodes] - cover[m, 2 * nodes + 1], 0)
            above = here
        done.append((feature, cut, value, cover))
        before, data = data, data.map(_advanced(plan, (feature, cut, value)), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        if turn % REPLAY == 0 or turn in states:
            checkpointed_rdd(spark, data)
            before.unpersist()
            before = None
        if turn in states:
            kept[turn] = _stored(spark, data)
    data.unpersist()
    return done, kept


def _stored(spark: SparkSession, data: RDD) -> DataFrame:
    rows = data.map(lambda block: (pickle.loads(block[0]), block[1].tolist(), block[2].tolist(), np.ascontiguousarray(block[4]).tobytes()))
    return stored_table(spark.createDataFrame(rows, STATE, verifySchema=False), "boosting")


def raw_scores(state: DataFrame, plan: Plan, fit: int | None = None) -> DataFrame:
    """key, depth, label, raw of every row: under the fit that held its fold out, or under the given one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                fold = np.asarray(row.fold)
                raw = np.frombuffer(row.raw, float).reshape(len(plan.fits), len(plan.depths), -1)
                own = np.array([plan.fits.index(f) for f in fold]) if fit is None else np.full(len(fold), fit)
                for i, d in enumerate(plan.depths):
                    yield pd.DataFrame({"key": list(row.ids), "depth": d, "label": np.asarray(row.label, float), "raw": raw[own, i, np.arange(len(fold))]})

    return state.mapInPandas(run, "key string, depth int, label double, raw double")


NODES = "fit int, depth int, tree int, node int, feature int, threshold double, value double, rows bigint"


def fit_boosted(rows: DataFrame, key: str, label: str, fold: Column, folds: int, names: Sequence[str], missing: dict[str, dict[int, float]],
                depths: Sequence[int], rounds: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Model rows and scores of one model per held-out fold (0 to folds - 1) and of the final one (-1), for all depths.

    ``missing`` gives the value that a fit reads for a missing feature. Model rows
    are ``NODES``; tree -1 holds the start value of a fit. Scores are key, depth,
    rounds, label, held_out, raw: out of fold, and under the final fit. Rows
    without a label are left out.
    """
    cuts = feature_cuts(rows, names)
    whole = F.round(F.col(label).cast("double") * SCALE).cast("decimal(38,0)")
    sums = {r[0]: (int(r[1]), r[2]) for r in rows.where(F.col(label).isNotNull()).groupBy(fold.cast("int")).agg(F.sum(whole), F.count(F.lit(1))).collect()}
    fits = [*range(folds), -1]
    base = []
    for f in fits:
        own = [v for k, v in sums.items() if k != f]
        count = sum(n for _, n in own)
        base.append(sum(s for s, _ in own) / count / SCALE if count else 0.0)
    fill = np.zeros((len(fits), len(names)), np.int64)
    for i, c in enumerate(names):
        for j, f in enumerate(fits):
            if missing.get(c, {}).get(f) is not None:
                fill[j, i] = np.searchsorted(cuts[i], missing[c][f], side="left")
    plan = Plan(fits, list(depths), np.array(base), fill)
    spark, count, features = rows.sparkSession, sum(n for _, n in sums.values()), len(names)
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-count // LEAST_PART)), -(-count // MOST_PART))
    packed = stored_table(binned(rows.repartition(parts), key, label, fold, names, cuts), "blocks")
    blocks = packed.rdd.map(lambda row: _opened(row, plan, features))
    trees, states = grow(blocks, plan, features, max(rounds), rounds, spark)
    start = spark.createDataFrame([(f, d, -1, 0, None, None, float(b), None) for f, b in zip(fits, base) for d in depths], NODES)
    scores = None
    for turn, state in states.items():
        for held in (True, False):
            one = raw_scores(state, plan, None if held else fits.index(-1)).select("key", "depth", F.lit(turn).alias("rounds"), "label", F.lit(held).alias("held_out"), "raw")
            scores = one if scores is None else scores.unionByName(one)
    return start.unionByName(node_rows(spark, trees, plan, cuts)), scores


def node_rows(spark: SparkSession, trees: list, plan: Plan, cuts: list[list[float]]) -> DataFrame:
    """The model store's rows: one per node of every tree; ``feature`` is null at leaves, rows with values up to ``threshold`` go left (2 * node + 1)."""
    out = []
    for t, (feature, cut, value, cover) in enumerate(trees):
        for m, (f, d) in enumerate(plan.models):
            for node in np.flatnonzero(cover[m]):
                split = int(feature[m, node])
                limit = None if split < 0 else cuts[split][int(cut[m, node])]
                out.append((plan.fits[f], d, t, int(node), None if split < 0 else split, limit, float(value[m, node]), int(cover[m, node])))
    return spark.createDataFrame(out, NODES)  # plain rows: nulls of a pandas column become floats where Arrow is off


def path_attributions(rows: DataFrame, key: str, values: Column, nodes: DataFrame, base: Column) -> DataFrame:
    """key, bias, feature, contribution of every row under one model of the store.

    A row walks all trees inside its own task: a step from a node to its child
    moves the tree's value by the difference, which is the split feature's part. The
    model (at most rounds x 15 nodes) goes to every task; a row leaves with one row per feature on its paths.
    """
    trees: dict[int, list] = {}
    for r in nodes.collect():  # at most rounds x 15 nodes
        trees.setdefault(r["tree"], []).append((r["node"], r["feature"], r["threshold"], r["value"]))
    feature, cut, value = np.full((len(trees), 15), -1), np.zeros((len(trees), 15)), np.zeros((len(trees), 15))
    for t, (_, own) in enumerate(sorted(trees.items())):
        for node, f, c, v in own:
            feature[t, node], cut[t, node], value[t, node] = (-1 if f is None else f), (0.0 if c is None else c), v
    roots = reduce(lambda a, b: a + b, (float(v) for v in value[:, 0]), 0.0)
    width = int(feature.max(initial=-1)) + 1

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["__x"].tolist(), float).reshape(len(batch), -1)
            row = np.arange(len(x))
            part, seen = np.zeros((len(x), width)), np.zeros((len(x), width), bool)
            for t in range(len(feature)):
                at = np.zeros(len(x), np.int64)
                for _ in range(3):
                    f = feature[t, at]
                    go = np.flatnonzero(f >= 0)
                    if not len(go):
                        break
                    f, here = f[go], at[go]
                    there = 2 * here + 2 - (x[go, f] <= cut[t, here])
                    part[go, f] += value[t, there] - value[t, here]
                    seen[go, f] = True
                    at[go] = there
            plain = ~seen.any(1)  # rows that no tree splits keep one row without a feature
            i, f = np.nonzero(seen)
            ids = batch["__key"].to_numpy()
            yield pd.DataFrame({"__key": np.concatenate([ids[i], ids[row[plain]]]), "feature": pd.array([*f.tolist(), *[None] * int(plain.sum())], "Int32"),
                                "contribution": pd.array([*part[i, f].tolist(), *[None] * int(plain.sum())], "Float64")})

    kind = dict(rows.select(F.col(key).alias("__key")).dtypes)["__key"]
    out = rows.select(F.col(key).alias("__key"), values.alias("__x")).mapInPandas(told, f"__key {kind}, feature int, contribution double")
    return out.select(F.col("__key").alias(key), (base + F.lit(roots)).alias("bias"), "feature", "contribution")
