"""Faults found on other sessions, odd rows and larger tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from restartlab.functions import angles as A
from restartlab.operators import angles as O, boosting as B, bootstrap as BS, compare as C, fits as FB, graphs as G, planning as L, synth as S
from restartlab.plans import compare as P, graphs as GP
from restartlab.plans.fixtures import Catalog
from tools.check import TABLES, compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("arrow", ["true", "false"])
def test_model_rows_do_not_depend_on_arrow(spark, arrow):
    name = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, arrow)
    try:
        feature, cover = np.full((1, 15), -1), np.zeros((1, 15), np.int64)
        feature[0, 0], cover[0, :3] = 1, (10, 4, 6)
        tree = (feature, np.zeros((1, 15), np.int64), np.ones((1, 15)), cover)
        rows = B.node_rows(spark, [tree], B.Plan([-1], [1], np.zeros(1), np.zeros((1, 2), np.int64)), [[0.5], [0.25]]).orderBy("node").collect()
    finally:
        spark.conf.set(name, before)
    assert [(r.node, r.feature, r.threshold, r.rows) for r in rows] == [(0, 1, 0.25, 10), (1, None, None, 4), (2, None, None, 6)]


def test_boosting_on_many_partitions_equals_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(0, 9)), None if i % 11 == 0 else round(float(rng.normal()), 2), round(float(rng.random()), 4), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y double, fold int").repartition(7)
    missing = {"b": {f: 0.25 for f in (0, 1, 2, -1)}}
    fitted = {}
    for part, fan in ((2048, 16), (16, 2)):
        monkeypatch.setattr(B, "LEAST_PART", part)
        monkeypatch.setattr(B, "FAN_IN", fan)
        monkeypatch.setattr(B, "REPLAY", 2)
        nodes, scores = B.fit_boosted(df, "id", "y", F.col("fold"), 3, ["a", "b"], missing, (1, 3), (3, 5))
        fitted[part] = sorted(map(str, nodes.collect())), sorted(map(str, scores.collect()))
    assert fitted[2048] == fitted[16] and len(fitted[16][1]) == 120 * 2 * 2 * 2


def test_overlay_leaves_out_labels_without_a_graph(spark, tmp_path):
    con = duckdb.connect()
    for name in TABLES:
        extra = ""
        if name == "lineitem":  # a supplier's quarter whose only row is no edge
            extra = (f" UNION ALL BY NAME SELECT * REPLACE (7 AS l_partkey, 7 AS l_orderkey, (SELECT max(l_suppkey) FROM '{SF}/lineitem.parquet') + 1 AS l_suppkey)"
                     f" FROM (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1)")
        con.execute(f"COPY (SELECT * FROM '{SF}/{name}.parquet'{extra}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    key = "jn12_overlay_replace"
    text, _, good = compare(spark, connect(tmp_path), key, entry.queries()[key], entry.oracle_sql()[key], str(tmp_path))
    assert good, text


@pytest.mark.parametrize("batch", [8, 500])
def test_medoids_of_overlapping_scopes_equal_those_of_each(spark, batch):
    rng = np.random.default_rng(3)
    theta = rng.normal(0, 0.4, (150, 4)).round(1)
    theta[100:] = theta[:50]  # copies, also across parts
    rows = spark.createDataFrame([(i, "abcd"[i * 7 % 4], t.tolist()) for i, t in enumerate(theta)], "id bigint, part string, theta array<double>")
    scopes = {"all": set("abcd"), "no a": set("bcd"), "no b": set("acd"), "only d": {"d"}, "none": {"x"}}
    got = {r.scope: r for r in O.scoped_medoids(rows, "id", "part", scopes, 2, batch=batch, block=20).collect()}
    assert got.keys() == scopes.keys() - {"none"}
    for name, own in scopes.items():
        for one in O.medoids(rows.where(F.col("part").isin(*own)).withColumn("k", F.lit(1)), ["k"], "id", 2).collect():
            assert got[name].id == one.id and got[name].theta == one.theta and abs(got[name].distance_sum - one.distance_sum) < 1e-9


@pytest.mark.parametrize("p", [1, 2])
def test_losses_in_numpy_equal_the_column_expressions(spark, p):
    rng = np.random.default_rng(p)
    raw, target, anchor = rng.normal(0, 1, (60, 4 * p)), rng.normal(0, 3, (60, 2 * p)), rng.normal(0, 1, 2 * p)
    raw[::7, :2] = 0.0  # an empty circle: the anchor speaks
    parity = np.array(["even", "odd", "mixed"])[np.arange(60) % 3]
    rows = spark.createDataFrame([(i, raw[i].tolist(), target[i].tolist(), str(parity[i])) for i in range(60)], "id int, raw array<double>, target array<double>, parity string")
    theta = A.decode(F.col("raw"), F.array(*map(F.lit, anchor.tolist())), p)["theta"]
    loss = [r.loss for r in rows.select("id", A.angle_loss(theta, F.col("target"), F.col("parity"), p).alias("loss")).orderBy("id").collect()]
    assert np.abs(FB.angle_losses(raw, anchor, target, parity, p) - loss).max() < 1e-12


@pytest.mark.parametrize("key", ["lrn11_linear_attributions", "lrn9_predict"])
def test_undefined_features_of_a_graph_without_wedges(spark, tmp_path, key):
    con = duckdb.connect()
    for name in TABLES:
        extra = ""
        if name == "lineitem":  # an evaluation graph of one edge: its transitivity is undefined
            extra = (f" UNION ALL BY NAME SELECT * REPLACE (7 AS l_partkey, 8 AS l_orderkey, 1 AS l_suppkey, TIMESTAMP '2002-01-02' AS l_shipdate)"
                     f" FROM (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1)")
        con.execute(f"COPY (SELECT * FROM '{SF}/{name}.parquet'{extra}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    text, _, good = compare(spark, connect(tmp_path), key, entry.queries()[key], entry.oracle_sql()[key], str(tmp_path))
    assert good, text


def test_draw_log_needs_no_graph_hashes(spark, monkeypatch):
    draws = spark.range(300).select(F.col("id").alias("graph_id"), F.col("id").alias("seed"), F.lit(5).cast("bigint").alias("n"), F.lit("er").alias("generator"),
                                    F.lit(3).cast("bigint").alias("k"), F.lit(0.5).alias("radius"), F.lit(0.3).alias("rewiring"), F.lit("c").alias("cell"))
    drawn = S.draw_graphs(draws).cache()
    good = drawn.where("status = 'connected'")
    edges = good.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.u", "e.v")
    classes = {r["graph_id"]: r["representative"] for r in G.isomorphism_classes(edges, good.select("graph_id", "n")).collect()}
    monkeypatch.setattr(G, "wl_hash", lambda lists, rounds=3: pytest.fail("hashes of every graph"))
    log = {r["graph_id"]: r for r in S.fill_quotas(drawn, 4).collect()}
    assert {g: r["representative"] for g, r in log.items() if r["representative"] is not None} == classes
    firsts = sorted(set(classes.values()))
    assert len(firsts) > 4 and [g for g in sorted(log) if log[g]["status"] == "accepted"] == firsts[:4]


def test_family_models_share_one_set_of_draws(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, n, b, f, float(b + rng.normal(0, 0.4)), float(rng.uniform())) for i, (n, b, f, _) in enumerate(
        (n, b, f, k) for n, b in C.STRATA for f in ("er", "regular", "ba", "sbm") for k in range(6))]
    df = spark.createDataFrame(rows, "graph_id bigint, n bigint, degree_band bigint, family string, mean_degree double, y double")
    alone = {m: sorted(map(tuple, C.adjusted_family(df, ["y"], q, 40).collect())) for m, q in (("a", False), ("b", True))}
    seen, plain = [], C.draw_sums
    monkeypatch.setattr(C, "draw_sums", lambda *args: seen.append(args[4]) or plain(*args))
    both = C.adjusted_families(df, ["y"], {"a": False, "b": True}, 40).collect()
    assert len(seen) == 1 and len(seen[0]) == 4 + 3  # moments, not products of design columns
    for m, want in alone.items():
        got = sorted(tuple(r)[:-1] for r in both if r["model"] == m)
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-9)


def test_rule_pairs_read_the_arms_once(spark, monkeypatch):
    cat, calls, arms = Catalog(spark, SF), [], Catalog.arms
    want = sorted(tuple(r) for arm, name in (("5-LOW", "B1"), ("2-HIGH", "B2:medoid"), ("3-MEDIUM", "B2:aligned_median")) for r in P.pairs(cat, "1-URGENT", arm).select(
        "graph_id", "method_quality", "baseline_quality", F.lit(name)).collect())
    monkeypatch.setattr(Catalog, "arms", lambda self: calls.append(1) or arms(self))
    got = P.rule_pairs(cat).where("regime = 'random'").select("graph_id", "method_quality", "baseline_quality", "baseline").collect()
    assert len(calls) == 1 and [r[::3] for r in sorted(map(tuple, got))] == [r[::3] for r in want] and len(want) > 50
    assert np.allclose([r[1:3] for r in sorted(map(tuple, got))], [r[1:3] for r in want])


def test_role_seeds_are_counted_in_parts_that_follow_the_starts(spark):
    starts = L.shot_starts(spark.range(60).select(F.col("id").alias("graph_id"), F.lit("c").alias("cell")))
    spread = L.spread_starts(starts.coalesce(1), 50)
    assert spread.rdd.getNumPartitions() == 5 and sorted(map(tuple, spread.collect())) == sorted(map(tuple, starts.collect()))
    plan = L.shot_plan(spread, 2, ("SPSA", "COBYLA"), (256, 1024)).withColumn("validation_seed", F.when(F.col("level") == 256, F.col("validation_seed")).otherwise("00"))
    roles = ("measurement", "validation", "perturbation")
    want = plan.groupBy("method").agg(F.count(F.lit(1)).alias("tasks"), *[F.count_distinct(f"{r}_seed").alias(r) for r in roles])
    assert sorted(map(tuple, L.seed_counts(plan).collect())) == sorted(map(tuple, want.collect()))


def test_joint_groups_read_edge_lists_once_and_group_no_types(spark, monkeypatch):
    cat, calls, lists = Catalog(spark, SF), [], GP.edge_lists
    want = sorted(tuple(r) for r in FB.sparse_rows(GP.features(cat, True), GP.types(cat)).select("graph_id", F.explode(F.arrays_zip("at", "x")).alias("e")).select(
        "graph_id", F.col("e.at"), F.round("e.x", 9)).where(f"at < {FB.ONE} and abs(e.x) > 1e-9").collect())
    monkeypatch.setattr(GP, "edge_lists", lambda c: calls.append(1) or lists(c))
    got = GP._joint_group(cat, "J+U+S").select("graph_id", "place", F.round("value", 9)).collect()
    kept = {int(p) for p in FB.group_columns("J+U+S")}
    assert len(calls) == 1 and sorted(map(tuple, got)) == [r for r in want if r[1] in kept]


def test_blocks_take_their_picks_without_a_binomial_per_row(spark, monkeypatch):
    plain = BS._generator

    class Guard:
        def __init__(self, *parts):
            self.rng = plain(*parts)

        def integers(self, *args, **kwargs):
            return self.rng.integers(*args, **kwargs)

        def multinomial(self, picks, chances, **kwargs):
            assert len(chances) <= BS.FAN, "a binomial number per row and draw"
            return self.rng.multinomial(picks, chances, **kwargs)

    df = spark.range(3000).select(F.col("id").alias("graph_id"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("one"))
    monkeypatch.setattr(BS, "_generator", Guard)
    rows = BS.draw_sums(df, [], [], "graph_id", ["x", "one"], 150, 3, block=1000).collect()
    assert sorted(r["draw"] for r in rows) == list(range(150)) and all(r["sum_one"] == r["size"] == 3000 for r in rows)
    means = np.array([r["sum_x"] / 3000 for r in rows])
    assert means.mean() == pytest.approx(1499.5, abs=8) and means.std() == pytest.approx(np.arange(3000).std() / 3000 ** 0.5, rel=0.2)


@pytest.mark.parametrize("room", [1, 40, 10 ** 6])
def test_picks_of_a_block_are_multinomial(monkeypatch, room):
    monkeypatch.setattr(BS, "PICKS", room)
    picks = np.array([0, 1, 60] + [60] * 4000)
    counts = BS.picked_sums(np.random.default_rng(4), picks, np.eye(6))
    assert counts.sum(axis=1).tolist() == picks.tolist() and (counts >= 0).all()
    spread = np.cov(counts[2:].T)
    assert np.allclose(counts[2:].mean(axis=0), 10, atol=0.25)
    assert np.allclose(spread, 60 * (np.eye(6) / 6 - 1 / 36), atol=0.7)
    many = np.arange(12.0).reshape(6, 2)
    assert np.allclose(BS.picked_sums(np.random.default_rng(4), picks, many), counts @ many)
