"""Boosting at scale: passes of a round, blocks without copies per fit, and the rows that are read for it."""

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from restartlab.operators import boosting as B, graphs as G
from restartlab.plans import learning as PL
from restartlab.plans.fixtures import Catalog


def test_a_round_is_one_pass_per_level(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(0, 9)), float(rng.normal()), float(rng.uniform()), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y double, fold int").repartition(2)
    counts, passes, count, summed = [], [], RDD.count, B._summed
    monkeypatch.setattr(B, "REPLAY", 4)
    monkeypatch.setattr(RDD, "count", lambda self: counts.append(1) or count(self))
    monkeypatch.setattr(B, "_summed", lambda parts: passes.append(1) or summed(parts))
    nodes, _ = B.fit_boosted(df, "id", "y", F.col("fold"), 2, ["a", "b"], {}, (1, 2, 3), (3, 6))
    assert len(counts) == 3  # checkpoints after rounds 3, 4 and 6; no other pass adds trees
    assert len(passes) == 1 + 6 * 3 and nodes.where("tree >= 0").count() > 0


@pytest.mark.parametrize("level", [1, 2])
def test_sums_of_the_smaller_child_with_missing_values(level):
    rng = np.random.default_rng(level)
    bins = rng.integers(0, 20, (300, 3)).astype(np.uint8)
    bins[rng.random((300, 3)) < 0.1] = B.MISSING
    plan = B.Plan([0, -1], [3], np.zeros(2), np.array([[3, 5, 7], [11, 2, 0]]))
    fold, label, raw = rng.integers(0, 2, 300), rng.uniform(size=300), rng.normal(size=(2, 300))
    feature, cut = np.full((2, 15), -1), np.zeros((2, 15), np.int64)
    feature[:, :3], cut[:, :3] = [[0, 1, 2], [2, -1, 0]], [[6, 9, 12], [4, 0, 8]]
    side = rng.integers(0, 2, (2, 15))
    (got,) = [dict(B._histogram(plan, 3, (feature, cut, side), level)(iter([(b"", fold, label, bins, raw)])))]
    for m, left_out in enumerate(plan.fits):
        x = np.where(bins == B.MISSING, plan.fill[m], bins)
        at = np.zeros(300, int)
        for i in range(300):
            for _ in range(level):
                if feature[m, at[i]] >= 0:
                    at[i] = 2 * at[i] + 1 + (x[i, feature[m, at[i]]] > cut[m, at[i]])
        want = np.zeros((2, 2**(level - 1), 3, B.BINS), np.int64)
        for node in range(2**(level - 1)):
            own = (at == 2**level - 1 + 2 * node + side[m, 2**(level - 1) - 1 + node]) & (fold != left_out)
            for f in range(3):
                np.add.at(want[0, node, f], x[own, f], np.rint((label - raw[m]) * B.SCALE).astype(np.int64)[own])
                np.add.at(want[1, node, f], x[own, f], 1)
        assert (got[m] == want).all() and want[1].sum() > 0


def test_features_of_training_graphs_only(spark, monkeypatch):
    cat, seen, plain = Catalog(spark, "/root/testdata/sf0.001"), [], G.graph_features
    monkeypatch.setattr(G, "graph_features", lambda lists, spectral=True: seen.append(lists) or plain(lists, spectral))
    rows = PL.learning_rows(cat)
    ids = {r[0] for r in rows.select("graph_id").collect()}
    assert len(seen) == 1 and {r[0] for r in seen[0].select("graph_id").collect()} == ids == {r[0] for r in PL.training(cat).select("graph_id").collect()}
