"""Angle operators against plain NumPy on small fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from restartlab.functions import angles as A
from restartlab.operators import angles as O

PERIODS = np.array([2 * math.pi] * 2 + [math.pi / 2] * 2)


def points(spark, values, pool=1):
    return spark.createDataFrame([(pool, i, [float(x) for x in v]) for i, v in enumerate(values)], "pool bigint, item bigint, theta array<double>")


def wrap(x, periods=PERIODS):
    return (x + periods / 2) % periods - periods / 2


def quotient(a, b):
    return min(np.linalg.norm(wrap(a - b)), np.linalg.norm(wrap(a + b)))


def test_wrap_keeps_tiny_angles_and_maps_the_boundary(spark):
    df = spark.createDataFrame([(1e-300,), (math.pi,), (-math.pi,), (3 * math.pi,), (7.0,)], "x double")
    got = [r[0] for r in df.select(A.wrap(F.col("x"), 2 * math.pi)).collect()]
    assert got[0] == 1e-300 and got[1:4] == [-math.pi] * 3 and got[4] == pytest.approx(7 - 2 * math.pi)


def test_canonical_is_the_same_for_both_signs(spark):
    rng = np.random.default_rng(0)
    values = rng.uniform(-9, 9, (40, 4))
    left = points(spark, values).select(A.canonical(F.col("theta"), 2)).collect()
    right = points(spark, -values).select(A.canonical(F.col("theta"), 2)).collect()
    assert np.allclose([r[0] for r in left], [r[0] for r in right])


def test_medoid_with_blocks_and_copies(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.uniform(-3, 3, (37, 4)), np.repeat([[0.5, 0.4, 0.3, 0.2]], 30, axis=0)])
    sums = [sum(quotient(a, b) for b in values) for a in values]
    best = min(i for i, s in enumerate(sums) if s <= min(sums) + 1e-9)
    row = O.medoids(points(spark, values), ["pool"], "item", 2).first()
    assert row["item"] == best and row["distance_sum"] == pytest.approx(sums[best])
    canonical = points(spark, values).select("pool", "item", A.canonical(F.col("theta"), 2).alias("theta"), F.lit(1.0).alias("weight"))
    small = O.distance_sums(canonical, ["pool"], "item", 2, block=5).collect()
    assert {r["item"]: r["distance_sum"] for r in small} == pytest.approx(dict(enumerate(sums)))


def test_meetings_of_blocks_reach_tasks_a_few_at_a_time(spark, monkeypatch):
    """What a task holds does not grow with the pool: one block against another is one row, and a task gets about sixteen."""
    values, sizes, dealt = np.random.default_rng(7).uniform(-3, 3, (300, 4)), [], O._dealt

    def watched(rows, count, share=16):
        out = dealt(rows, count, share)
        sizes.append(max(out.rdd.glom().map(len).collect()))
        return out

    monkeypatch.setattr(O, "_dealt", watched)
    weighted = points(spark, values).withColumn("weight", F.lit(1.0))
    rows = {r["item"]: r["distance_sum"] for r in O.distance_sums(weighted, ["pool"], "item", 2, block=10).collect()}
    canonical = [sum(quotient(a, b) for b in values) for a in values]
    assert rows == pytest.approx(dict(enumerate(canonical)))
    assert sizes and max(sizes) <= 32


def brute_clusters(values, threshold, periods):
    d = np.array([[np.linalg.norm(np.minimum(np.abs(a - b) % periods, periods - np.abs(a - b) % periods)) for b in values] for a in values])
    groups = [[i] for i in range(len(values))]
    while len(groups) > 1:
        height, a, b = min((max(d[i, j] for i in x for j in y), k, l) for (k, x), (l, y) in itertools.combinations(enumerate(groups), 2))
        if height > threshold:
            break
        groups[a] += groups.pop(b)
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("threshold", [0.3, 0.9, 1.7])
def test_clusters_small_and_large_paths_match_brute_force(spark, threshold):
    rng = np.random.default_rng(2)
    centres = rng.uniform(0, 3, (6, 4))
    values = np.concatenate([c + rng.normal(0, 0.25, (9, 4)) for c in centres] + [centres[:2], centres[:2]])
    expected = brute_clusters(values, threshold, np.array([2 * math.pi] * 2 + [math.pi] * 2))
    for small in (2048, 0):  # task-local linkage, then distributed rounds
        rows = O.endpoint_clusters(points(spark, values), ["pool"], "item", 2, threshold, small=small).collect()
        groups = {}
        for r in rows:
            groups.setdefault(r["cluster_id"], []).append(r["item"])
        assert sorted(sorted(g) for g in groups.values()) == expected
        assert all(key == min(g) for key, g in groups.items())


def test_clusters_with_ties_and_distances_at_the_threshold(spark):
    """Points on a line in steps of a tenth: equal distances, some at the threshold, and the same result on both sides of ``small``."""
    order = np.random.default_rng(4).permutation(31)
    values = [[k / 10, 0.0, 0.0, 0.0] for k in order]
    for threshold in (0.1, 0.3):
        found = [{r["item"]: r["cluster_id"] for r in O.endpoint_clusters(points(spark, values), ["pool"], "item", 2, threshold, small=small).collect()}
                 for small in (len(values), len(values) - 1)]
        assert found[0] == found[1] and len(found[0]) == len(values)


def test_clusters_of_a_pool_in_many_blocks_keep_no_pairs(spark, monkeypatch):
    """Steps of growing limits over blocks that see each other's borders: the sequential result, and no pair is a row."""
    rng = np.random.default_rng(5)
    values, periods, threshold = rng.normal(0, 1.5, (700, 4)), np.array([2 * math.pi] * 2 + [math.pi] * 2), 0.7
    fold = np.abs(values[:, None] - values[None]) % periods
    d = np.sqrt((np.minimum(fold, periods - fold) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    expected = np.arange(len(values))
    while d.min() <= threshold:
        a, b = sorted(np.unravel_index(d.argmin(), d.shape))
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[b] = d[:, b] = d[a, a] = np.inf
        expected[expected == b] = a
    kept, cut = [], O.cut_lineage

    def counted(df):
        out = cut(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(O, "cut_lineage", counted)
    rows = O.endpoint_clusters(points(spark, values), ["pool"], "item", 2, threshold, small=100).collect()
    assert {r["item"]: r["cluster_id"] for r in rows} == dict(enumerate(expected))
    assert max(kept) <= len(values)  # no table of pairs


def test_label_tie_rule(spark):
    """Anchor zero, even parity: opposite lifts tie; the smaller coordinate wins."""
    df = points(spark, [[math.pi / 2, 0.0, 0.1, 0.0], [0.0, 0.0, 0.2, 0.0]])
    rows = df.select("item", A.align_label(F.col("theta"), F.array(*[F.lit(0.0)] * 4), F.lit("even"), 2).alias("x")).orderBy("item").collect()
    assert rows[0]["x"]["tie"] and rows[0]["x"]["lift"][0] == pytest.approx(-math.pi / 2)
    assert rows[1]["x"]["tie"] and rows[1]["x"]["lift"][2] == pytest.approx(-0.2)


def test_encode_decode_round_trip(spark):
    rng = np.random.default_rng(3)
    df = points(spark, rng.uniform(-0.7, 0.7, (20, 4)))
    anchor = F.array(*[F.lit(0.0)] * 4)
    out = df.select(A.canonical(F.col("theta"), 2).alias("a"), A.decode(A.encode(F.col("theta"), 2), anchor, 2)["theta"].alias("b")).collect()
    assert np.allclose([r["a"] for r in out], [r["b"] for r in out])
    tiny = df.limit(1).select(A.decode(F.array(*[F.lit(0.0)] * 2, *[F.lit(1.0)] * 6), anchor, 2).alias("x")).first()["x"]
    assert tiny["fallback"] and tiny["theta"] == [0.0] * 4


def test_loss_is_zero_on_the_orbit(spark):
    df = points(spark, np.random.default_rng(4).uniform(-1, 1, (10, 4)))
    for parity in ("even", "odd", "mixed"):
        o = df.select("theta", F.explode(A.orbit(F.col("theta"), F.lit(parity), 2)).alias("o"))
        assert o.count() == (20 if parity == "mixed" else 80)
        worst = o.select(F.max(A.angle_loss(F.col("o.theta"), F.col("theta"), F.lit(parity), 2))).first()[0]
        assert worst == pytest.approx(0, abs=1e-20)


def test_medoids_by_bounds_equal_brute_force(spark):
    """Small batches and blocks, so that bounds decide; copies, ties and several pools of different size."""
    rng = np.random.default_rng(6)
    rows, pools = [], {"wide": rng.uniform(-4, 4, (150, 4)), "dense": rng.normal(0, 0.3, (120, 4)), "ring": None, "one": rng.normal(0, 1, (1, 4)), "pair": rng.normal(0, 1, (2, 4))}
    turn = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    pools["ring"] = np.column_stack([np.cos(turn), np.sin(turn), 0 * turn, 0 * turn])
    for name, points in pools.items():
        points = np.concatenate([points, points[::3]])
        rows += [(name, int(i), [float(v) for v in t]) for i, t in zip(rng.permutation(len(points)), points)]
    df = spark.createDataFrame(rows, "pool string, id bigint, theta array<double>")
    got = {r.pool: r for r in O.medoids(df, ["pool"], "id", 2, batch=50, block=24).collect()}
    flat = df.select("pool", "id", A.canonical(F.col("theta"), 2).alias("t")).collect()
    metric = O._metric(2, A.BETA_PERIOD, True)
    for name in pools:
        own = sorted((r.id, r.t) for r in flat if r.pool == name)
        theta = np.array([t for _, t in own])
        sums = metric(theta, theta).sum(1)
        near = [i for (i, _), s in zip(own, sums) if s <= sums.min() + 1e-9]
        assert abs(got[name].distance_sum - sums.min()) < 1e-8 and got[name].id in near
        assert [t for i, t in own if i == got[name].id][0] == got[name].theta
    alone = O.medoids(df.where("pool = 'dense'").drop("pool"), [], "id", 2, batch=60, block=48).collect()
    assert [r.id for r in alone] == [got["dense"].id]
    assert O.medoids(df.where("false"), ["pool"], "id", 2).count() == 0
