"""Ranks, quantiles, bootstrap, regressions and scores against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from restartlab.functions.ranks import bucketed_row_number, exact_quantiles
from restartlab.functions.scores import hex_mod, wilson_lower, wilson_upper
from restartlab.operators import compare as C, learning as L, pools as P, scoring as S
from restartlab.operators.bootstrap import draw_sums


def test_wilson_ends_and_middle(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (3, 10), (None, 4), (0, 0)], "s bigint, n bigint")
    rows = df.select(wilson_lower(F.col("s"), F.col("n")), wilson_upper(F.col("s"), F.col("n"))).collect()
    assert rows[0][0] == 0 and rows[1][1] == 1
    z, r = 1.959963984540054, 0.3
    den = 1 + z * z / 10
    half = z * math.sqrt(r * 0.7 / 10 + z * z / 400) / den
    assert rows[2][0] == pytest.approx((r + z * z / 20) / den - half) and rows[2][1] == pytest.approx((r + z * z / 20) / den + half)
    assert rows[3][0] is None and rows[3][1] is None and rows[4][0] is None
    with pytest.raises(Exception):
        spark.createDataFrame([(5, 4)], "s bigint, n bigint").select(wilson_lower(F.col("s"), F.col("n"))).collect()


def test_bucketed_row_number_equals_plain_rank(spark):
    rng = np.random.default_rng(0)
    values = rng.permutation(400)
    df = spark.createDataFrame([("hot" if i % 3 else "cold", int(v)) for i, v in enumerate(values)], "k string, v bigint")
    got = bucketed_row_number(df, ["k"], F.floor(F.col("v") / 17), [F.col("v")], "r").collect()
    for key in ("hot", "cold"):
        part = sorted((r["v"], r["r"]) for r in got if r["k"] == key)
        assert [r for _, r in part] == list(range(1, len(part) + 1))


@pytest.mark.parametrize("accuracy", [10000, 20])  # whole group in the bracket; narrow bracket over a sketch
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=3001), "b": np.round(rng.exponential(size=2500), 1), "c": np.array([1.0, 2, 4, 8])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k string, x double")
    probs = (0.0, 0.025, 0.25, 0.5, 0.9, 1.0)
    rows = exact_quantiles(df, ["k"], "x", probs, accuracy).collect()
    assert len(rows) == 18
    for r in rows:
        assert r["quantile"] == pytest.approx(np.quantile(data[r["k"]], r["prob"]), abs=1e-12)


def test_quantile_without_keys(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8)], "x double")
    rows = {r["prob"]: r["quantile"] for r in exact_quantiles(df, [], "x", (0.025, 0.5, 0.975)).collect()}
    assert rows == pytest.approx({0.025: 1.075, 0.5: 3.0, 0.975: 7.7})


def test_hex_residue(spark):
    ids = ["ff" * 32, "0123456789abcdef" * 4, "00"]
    rows = spark.createDataFrame([(i,) for i in ids], "h string").select("h", hex_mod(F.col("h"), 97).alias("m")).collect()
    assert {r["h"]: r["m"] for r in rows} == {i: int(i, 16) % 97 for i in ids}


def test_draw_sums_are_multinomial(spark):
    n, draws = 300, 400
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(n)], "graph_id bigint, x double, one double")
    for block in (10 ** 6, 32):
        rows = draw_sums(df, [], [], "graph_id", ["x", "one"], draws, 5, block=block).collect()
        assert len(rows) == draws and {r["draw"] for r in rows} == set(range(draws))
        assert all(r["sum_one"] == n for r in rows)  # every draw picks exactly n graphs
        means = np.array([r["sum_x"] / n for r in rows])
        assert means.mean() == pytest.approx((n - 1) / 2, abs=1.5)
        assert means.std() == pytest.approx(np.arange(n).std() / math.sqrt(n), rel=0.15)
    again = draw_sums(df.repartition(7), [], [], "graph_id", ["x", "one"], draws, 5, block=32).collect()
    assert {r["draw"]: r["sum_x"] for r in again} == pytest.approx({r["draw"]: r["sum_x"] for r in rows})


def test_stratified_draws_stay_inside_cells(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 3)) for i in range(90)], "graph_id bigint, cell bigint, x double")
    rows = draw_sums(df, [], ["cell"], "graph_id", ["x"], 50, 9).collect()
    assert len(rows) == 150 and all(r["sum_x"] == 30 * r["cell"] and r["size"] == 30 for r in rows)


def test_paired_interval_and_null_paths(spark):
    rng = np.random.default_rng(2)
    base, method = rng.normal(size=200), rng.normal(0.3, size=200)
    rows = [("ok", i, True, float(b), float(m)) for i, (b, m) in enumerate(zip(base, method))]
    rows += [("late", 1, False, 0.0, 1.0), ("late", 2, True, 0.0, 1.0), ("one", 1, True, 0.0, 1.0), ("gap", 1, True, None, 1.0), ("gap", 2, True, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, graph_id bigint, complete boolean, baseline_q double, method_q double")
    got = {r["k"]: r for r in C.paired_bootstrap(df, ["k"], ["q"], draws=800).collect()}
    delta = method - base
    draws = delta[np.random.default_rng(0).integers(200, size=(4000, 200))].mean(axis=1)
    assert got["ok"]["difference"] == pytest.approx(delta.mean())
    assert got["ok"]["ci_low"] == pytest.approx(np.quantile(draws, 0.025), abs=0.03)
    assert got["ok"]["ci_high"] == pytest.approx(np.quantile(draws, 0.975), abs=0.03)
    assert [got[k]["ci_status"] for k in ("late", "one", "gap")] == ["provisional", "fewer_than_two_graphs", "metric_unavailable"]
    assert all(got[k]["ci_low"] is None for k in ("late", "one", "gap")) and got["gap"]["baseline_mean"] is None


@pytest.mark.parametrize("quadratic", [False, True])
def test_adjusted_family_matches_least_squares(spark, quadratic):
    rng = np.random.default_rng(3)
    rows = []
    for n, b in C.STRATA:
        for f in ("er", "regular", "ba", "sbm"):
            for _ in range(6):
                rows.append((len(rows), n, b, f, float(b + rng.normal(0, 0.4)), float(rng.uniform()), float(rng.uniform())))
    df = spark.createDataFrame(rows, "graph_id bigint, n bigint, degree_band bigint, family string, mean_degree double, y1 double, y2 double")
    centre = {s: np.mean([r[4] for r in rows if (r[1], r[2]) == s]) for s in C.STRATA}
    x = np.array([[float((r[1], r[2]) == s) for s in C.STRATA] + [float(r[3] == f and r[2] == b) for b, f in C.CONTRASTS]
                  + [r[4] - centre[r[1], r[2]]] for r in rows])
    if quadratic:
        x = np.column_stack([x, x[:, -1] ** 2])
    beta = np.linalg.lstsq(x, np.array([r[5:] for r in rows]), rcond=None)[0]
    got = {(r["term"], r["outcome"]): r for r in C.adjusted_family(df, ["y1", "y2"], quadratic, draws=60).collect()}
    terms = [*C.TERMS, *(["actual_degree_centered_squared"] if quadratic else [])]
    assert len(got) == 2 * len(terms)
    for i, term in enumerate(terms):
        for k, outcome in enumerate(("y1", "y2")):
            r = got[term, outcome]
            assert r["estimate"] == pytest.approx(beta[i, k], abs=1e-8) and r["ci_low"] <= r["ci_high"]


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(4)
    z, y = rng.normal(size=(80, 3)), rng.normal(size=(80, 2))
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    df = spark.createDataFrame([("f", z[i].tolist(), y[i].tolist()) for i in range(80)], "fit string, z array<double>, y array<double>").repartition(3)
    for r in L.ridge_models(df, 3, 2, (0.01, 1.0)).collect():
        coef = np.linalg.solve(z.T @ z + 80 * r["choice"] * np.eye(3), z.T @ (y - y.mean(axis=0)))
        assert np.allclose(r["coef"], coef.T) and np.allclose(r["intercept"], y.mean(axis=0))


def test_preprocessing_imputes_and_masks(spark):
    rows = [(i, "random-0" if i % 2 else "random-1", float(i), None if i == 4 else float(i * i), 7.5) for i in range(10)]
    df = spark.createDataFrame(rows, "graph_id bigint, fold string, a double, degree_assortativity double, same double")
    names = ("a", "degree_assortativity", "same")
    prep = {r["fit"]: r for r in L.preprocessing(L.training_copies(df, ("random-0", "random-1")), names).collect()}
    values = [r[3] for r in rows if r[3] is not None]
    filled = [np.median(values) if r[3] is None else r[3] for r in rows]
    final = prep[L.FINAL]
    assert final["median"] == np.median(values) and final["constant"] == [False, False, True]
    assert final["mean"][1] == pytest.approx(np.mean(filled)) and final["std"][1] == pytest.approx(np.std(filled))
    assert prep["random-0"]["median"] == np.median([r[3] for r in rows if r[1] == "random-1" and r[3] is not None])


def test_choice_ties(spark):
    df = spark.createDataFrame([(g, c, l) for g in range(4) for c, l in ((0.1, 0.5), (1.0, 0.5), (10.0, 0.9))], "graph_id bigint, choice double, loss double")
    pick = lambda last: [r["choice"] for r in L.choose_model(df, "choice", last).collect() if r["selected"]]
    assert pick(True) == [1.0] and pick(False) == [0.1]


def test_inverse_ecdf_is_not_interpolated(spark):
    rows = [("p", h) for h in (3, 5, 9, None)] + [("q", None)] * 2 + [("r", 1)]
    df = spark.createDataFrame(rows, "pool string, first_hit bigint")
    got = {r["pool"]: r for r in S.hit_quantiles(df, ["pool"]).collect()}
    assert (got["p"]["median"], got["p"]["p90"], got["p"]["hit_median"], got["p"]["hit_p90"]) == (5, None, 5, 9)
    assert got["q"]["median"] is None and got["q"]["hit_median"] is None and got["r"]["p90"] == 1


def test_unknown_cost_is_not_zero(spark):
    rows = [("a", 1, 1.0, "ok", []), ("a", 2, None, "ok", []), ("b", 2, 2.0, "ok", []), ("c", 3, 2.0, P.UNVERIFIED, []), ("d", 4, 1.0, "ok", ["elapsed_seconds"])]
    df = spark.createDataFrame(rows, "k string, objective_calls bigint, elapsed_seconds double, cost_status string, cost_unavailable array<string>")
    rest = {m: F.lit(0) for m in P.COST_METRICS if m not in df.columns}
    got = {(r["k"], r["metric"]): r for r in P.cost_totals(df.withColumns({**rest, "kind": F.lit("optimization")}), ["k"]).collect()}
    assert got["a", "elapsed_seconds"]["total"] is None and got["a", "elapsed_seconds"]["known_subtotal"] == 1
    assert got["a", "objective_calls"]["total"] == 3 and got["b", "elapsed_seconds"]["total"] == 2
    assert got["c", "objective_calls"]["total"] is None and got["c", "elapsed_seconds"]["total"] == 2
    assert got["d", "elapsed_seconds"]["unknown_count"] == 1 and got["d", "objective_calls"]["total"] == 4


def test_attempt_choice_ignores_scores(spark):
    rows = [(1, 1, "numerical_error", 9.0, 1), (1, 2, "converged", 1.0, 2), (1, 3, "converged", 8.0, 3), (2, 2, "numerical_error", 5.0, 2), (2, 1, "program_error", 1.0, 1)]
    df = spark.createDataFrame(rows, "task_id bigint, attempt_number bigint, stop_reason string, best_seen double, started bigint")
    assert {r["task_id"]: r["attempt_number"] for r in S.select_attempts(df).collect()} == {1: 2, 2: 1}
