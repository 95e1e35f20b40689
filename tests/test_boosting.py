"""Histogram boosting against a plain recursive booster, prefixes of rounds, path attributions of a hand-made tree, the model store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from restartlab.operators import boosting as B
from restartlab.operators.models import ModelStore, content_id
from restartlab.session import scratch_path


def plain(x, y, train, depth, rounds, cuts):
    """Boosting by trying every cut of every feature on the rows themselves; returns running sums of all rows."""
    base = round(float(np.rint(y[train] * B.SCALE).sum())) / train.sum() / B.SCALE
    raw = np.full(len(y), base)

    def build(rows, members, rest, d, out):
        g, n = rest[rows].sum(), len(rows)
        out[members] = B.RATE * g / (n + 1)
        best = (1e-6, None)
        if d == depth:
            return
        for f in range(x.shape[1]):
            for c in cuts[f]:
                left = rows[x[rows, f] <= c]
                if len(left) < 5 or n - len(left) < 5:
                    continue
                gl, nl = rest[left].sum(), len(left)
                gain = gl**2 / (nl + 1) + (g - gl)**2 / (n - nl + 1) - g**2 / (n + 1)
                if gain > best[0] + 1e-15:
                    best = (gain, f, c)
        if best[1] is None:
            return
        _, f, c = best
        for side in (True, False):
            build(rows[(x[rows, f] <= c) == side], members[(x[members, f] <= c) == side], rest, d + 1, out)

    for _ in range(rounds):
        rest = np.rint((y - raw) * B.SCALE) / B.SCALE
        step = np.zeros(len(y))
        build(np.flatnonzero(train), np.arange(len(y)), rest, 0, step)
        raw = raw + step
    return raw


def table(n=90, seed=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n).round(2), np.full(n, 3.0)])
    y = np.clip(0.1 * x[:, 0] + 0.2 * (x[:, 1] > 0.3) + rng.normal(0, 0.05, n), 0, 1).round(4)
    return x, y, np.arange(n) % 3


@pytest.mark.parametrize("parts", [1, 5])
def test_models_equal_a_plain_booster(spark, monkeypatch, parts):
    monkeypatch.setattr(B, "REPLAY", 3)
    monkeypatch.setattr(B, "FAN_IN", 2)  # with five blocks, sums are added on the executors first
    x, y, fold = table()
    rows = [(i, *map(float, x[i]), float(y[i]), int(fold[i])) for i in range(len(y))]
    rows += [(1000, 1.0, None, 3.0, 0.5, 1), (1001, 1.0, 2.0, 3.0, None, 1)]  # a missing feature, and a row without a label
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, y double, fold int").repartition(parts)
    nodes, scores = B.fit_boosted(df, "id", "y", F.col("fold"), 3, ["a", "b", "c"], {"b": {f: 0.25 for f in (0, 1, 2, -1)}}, (1, 2, 3), (4, 7))
    x, y, fold = np.vstack([x, [1.0, 0.25, 3.0]]), np.append(y, 0.5), np.append(fold, 1)
    ids = [*range(90), 1000]
    cuts = B.feature_cuts(df, ["a", "b", "c"])
    assert cuts[2] == [3.0] and cuts[0] == sorted(set(x[:, 0]))
    got = {(int(r.key), r.depth, r.rounds, r.held_out): r.raw for r in scores.collect()}
    assert len(got) == len(ids) * 3 * 2 * 2
    for depth in (1, 2, 3):
        for rounds in (4, 7):
            whole = plain(x, y, np.ones(len(y), bool), depth, rounds, cuts)
            held = {f: plain(x, y, fold != f, depth, rounds, cuts) for f in range(3)}
            for i, key in enumerate(ids):
                assert abs(got[key, depth, rounds, False] - whole[i]) < 1e-9
                assert abs(got[key, depth, rounds, True] - held[fold[i]][i]) < 1e-9
    # the stored model alone gives the scores back, the shorter one as a prefix of the longer
    model = nodes.where("fit = -1 and depth = 3")
    start = model.where("tree = -1").first()["value"]
    values = F.array("a", F.coalesce("b", F.lit(0.25)), "c")
    for rounds in (4, 7):
        told = B.path_attributions(df.where("y is not null"), "id", values, model.where(f"tree between 0 and {rounds - 1}"), F.lit(start))
        sums = told.groupBy("id").agg((F.coalesce(F.sum("contribution"), F.lit(0.0)) + F.max("bias")).alias("raw"))
        assert all(abs(r.raw - got[r.id, 3, rounds, False]) < 1e-9 for r in sums.collect())
    assert nodes.where("feature is not null and rows < 10").count() == 0  # both children have five rows at least
    halves = nodes.where("feature is not null").select("fit", "depth", "tree", (2 * F.col("node") + 1).alias("node"), F.col("rows").alias("above"))
    left = halves.join(nodes, ["fit", "depth", "tree", "node"])
    assert left.where("rows >= above or rows < 5").count() == 0 and left.count() == halves.count()


def test_path_attributions_of_a_hand_made_tree(spark):
    nodes = spark.createDataFrame([
        (-1, 2, 0, 0, 0, 1.0, 0.5, 10), (-1, 2, 0, 1, None, None, 0.1, 4), (-1, 2, 0, 2, 1, 5.0, 0.8, 6), (-1, 2, 0, 5, None, None, 0.6, 3), (-1, 2, 0, 6, None, None, 1.0, 3),
        (-1, 2, 1, 0, None, None, 0.25, 10)], B.NODES)
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 9.0), (3, 2.0, 5.0), (4, 2.0, 6.0)], "id bigint, a double, b double")
    told = B.path_attributions(rows, "id", F.array("a", "b"), nodes, F.lit(2.0))
    got = {(r.id, r.feature): round(r.contribution, 9) for r in told.collect()}
    assert got == {(1, 0): -0.4, (2, 0): -0.4, (3, 0): 0.3, (3, 1): -0.2, (4, 0): 0.3, (4, 1): 0.2}
    assert {r.bias for r in told.collect()} == {2.75}


def test_store_fits_once_and_is_addressed_by_content(spark):
    store, calls = ModelStore(spark, scratch_path(spark, "models")), []
    rows = spark.createDataFrame([(1, 0.5), (2, None)], "id bigint, y double")

    def fit():
        calls.append(1)
        return rows

    name = content_id(rows, ["id", "y"], depth=1)
    assert name == content_id(rows.repartition(3), ["id", "y"], depth=1) != content_id(rows, ["id", "y"], depth=2)
    assert name != content_id(rows.where("id = 1"), ["id", "y"], depth=1)
    first, fitted = store.get(name, fit)
    again, refitted = store.get(name, fit)
    assert (fitted, refitted, len(calls)) == (True, False, 1) and first.count() == again.count() == 2
    assert store.load("nothing") is None
