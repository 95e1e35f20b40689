"""Queries of the periodic-angle family."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from restartlab.functions import angles as A
from restartlab.functions.ranks import exact_quantiles
from restartlab.operators import angles as O
from restartlab.plans.fixtures import FIXTURE_SQL, Catalog
from restartlab.plans.query import Query

P = 2


def anchors(cat: Catalog) -> DataFrame:
    return O.medoids(cat.angles(), ["label"], "vec_id", P)


def parity_of(column: str = "vec_id"):
    return F.when(F.col(column) % 3 == 0, "even").when(F.col(column) % 3 == 1, "odd").otherwise("mixed")


def long_form(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("d", "angle")).withColumn("d", F.col("d").cast("bigint"))


def _torus(cat: Catalog) -> DataFrame:
    points = cat.angles().withColumn("weight", F.lit(1.0))
    return O.distance_sums(points, ["label"], "vec_id", P, math.pi, signed=False)


def _quotient(cat: Catalog) -> DataFrame:
    points = cat.angles().select("label", "vec_id", A.canonical(F.col("theta"), P).alias("theta"), F.lit(1.0).alias("weight"))
    return O.distance_sums(points, ["label"], "vec_id", P)


def _anchor_distance(cat: Catalog) -> DataFrame:
    a = anchors(cat).select("label", F.col("theta").alias("anchor"))
    return cat.angles().join(a, "label").select("vec_id", A.quotient_distance(F.col("theta"), F.col("anchor"), P).alias("distance"))


def _medoid(cat: Catalog) -> DataFrame:
    return anchors(cat).select("label", "vec_id", "distance_sum")


def _aligned(cat: Catalog) -> DataFrame:
    return long_form(O.aligned(cat.angles(), anchors(cat), ["label"], "vec_id", P), "lift", "vec_id")


def _median(cat: Catalog) -> DataFrame:
    return long_form(O.aligned_medians(cat.angles(), anchors(cat), ["label"], "vec_id", P), "theta", "label")


def _coordinate_median(cat: Catalog) -> DataFrame:
    parts = long_form(cat.angles(), "theta", "label")
    return exact_quantiles(parts, ["label", "d"], "angle", (0.5,)).select("label", "d", F.col("quantile").alias("median"))


def _price_quantiles(cat: Catalog) -> DataFrame:
    rows = cat.table("orders").select(F.col("o_orderpriority").alias("arm"), "o_totalprice")
    return exact_quantiles(rows, ["arm"], "o_totalprice", (0.025, 0.5, 0.975))


def _orbit(cat: Catalog) -> DataFrame:
    rows = cat.angles().select("vec_id", F.explode(A.orbit(F.col("theta"), parity_of(), P)).alias("o")).select("vec_id", "o.*")
    return long_form(rows, "theta", "vec_id", "mask", "sign")


def labels_aligned(cat: Catalog) -> DataFrame:
    a = anchors(cat).select("label", F.col("theta").alias("anchor"))
    return cat.angles().join(a, "label").select("vec_id", "label", "theta", "anchor", A.align_label(
        F.col("theta"), F.col("anchor"), parity_of(), P).alias("x"))


def _align_label(cat: Catalog) -> DataFrame:
    return labels_aligned(cat).select("vec_id", F.col("x.mask").alias("mask"), F.col("x.sign").alias("sign"),
                                      F.col("x.distance").alias("distance"), F.col("x.tie").alias("tie"))


def _encode(cat: Catalog) -> DataFrame:
    return long_form(cat.angles().withColumn("code", A.encode(F.col("theta"), P)), "code", "vec_id")


def _decode(cat: Catalog) -> DataFrame:
    """Decode slices of the embedding as model outputs; some circles are empty."""
    raw = F.transform(F.slice("embedding", 5, 8), lambda v, i: F.when((F.col("vec_id") % 9 == 0) & (i < 2), F.lit(0.0)).otherwise(v.cast("double")))
    a = F.array(F.lit(0.25), F.lit(-0.5), F.lit(0.125), F.lit(0.375))
    rows = cat.table("embeddings").select("vec_id", A.decode(raw, a, P).alias("x"))
    return rows.select("vec_id", F.col("x.fallback").alias("fallback"), F.array_min("x.rho").alias("rho_min"),
                       F.posexplode("x.theta").alias("d", "angle")).withColumn("d", F.col("d").cast("bigint"))


def _loss(cat: Catalog) -> DataFrame:
    target = F.transform(F.slice("embedding", 5, 4), lambda v: v.cast("double") * 12.0)
    rows = cat.angles().join(cat.table("embeddings").select("vec_id", target.alias("target")), "vec_id")
    return rows.select("vec_id", A.angle_loss(F.col("theta"), F.col("target"), parity_of(), P).alias("loss"))


def clusters(cat: Catalog, threshold: float = 0.9, beta_period: float = math.pi) -> DataFrame:
    return O.endpoint_clusters(cat.angles(), ["label"], "vec_id", P, threshold, beta_period)


def _cluster_rows(cat: Catalog) -> DataFrame:
    return clusters(cat).select("label", "vec_id", "cluster_id")


def _cluster_summary(cat: Catalog) -> DataFrame:
    rows = clusters(cat).withColumn("score", F.col("vec_id") % 97 / 97)
    return O.cluster_summary(rows, ["label"], "vec_id", "score")


def _cluster_sensitivity(cat: Catalog) -> DataFrame:
    """Cluster counts under other thresholds and the half beta period."""
    parts = []
    for name, threshold, period in (("half", 0.45, math.pi), ("double", 1.8, math.pi), ("beta_half", 0.9, math.pi / 2)):
        c = clusters(cat, threshold, period)
        parts.append(c.groupBy("label").agg(F.count_distinct("cluster_id").alias("cluster_count")).withColumn("variant", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# SQL text of the same geometry, for p = 2
PERIODS = ("(2*pi())", "(2*pi())", "(pi()/2)", "(pi()/2)")
TIE = "(32*2.220446049250313e-16*pi())"


def w(x: str, period: str) -> str:
    return f"(({x}) - {period}*floor((({x}) + {period}/2)/{period}))"


def wrapped(values: list[str]) -> list[str]:
    return [w(v, t) for v, t in zip(values, PERIODS)]


def length(values: list[str]) -> str:
    return "sqrt(" + " + ".join(f"pow({v}, 2)" for v in values) + ")"


def choose(left: list[str], right: list[str]) -> str:
    """True when the left lift wins."""
    gaps = [f"abs({a} - {b})" for a, b in zip(left, right)]
    top = f"greatest({', '.join(gaps)})"
    cases = " ".join(f"WHEN {g} >= {top} - {TIE} THEN {a} < {b}" for g, a, b in zip(gaps, left, right))
    return f"(CASE WHEN {top} <= {TIE} THEN ({', '.join(left)}) <= ({', '.join(right)}) {cases} END)"


T = [f"t{i}" for i in range(1, 5)]
FIXTURE_SQL["fx_flat"] = "\nSELECT vec_id, label, " + ", ".join(f"theta[{i}] AS t{i}" for i in range(1, 5)) + " FROM fx_angles"
FIXTURE_SQL["fx_lr"] = "\nSELECT *, " + ", ".join(f"{x} AS l{i}, {y} AS r{i}" for i, (x, y) in enumerate(
    zip(wrapped(T), wrapped([f"-{t}" for t in T])), 1)) + " FROM fx_flat"
_L, _R = [f"l{i}" for i in range(1, 5)], [f"r{i}" for i in range(1, 5)]
FIXTURE_SQL["fx_canon"] = "\nSELECT vec_id, label, " + ", ".join(
    f"CASE WHEN lw THEN l{i} ELSE r{i} END AS t{i}" for i in range(1, 5)) + f" FROM (SELECT *, {choose(_L, _R)} AS lw FROM fx_lr)"


def pair_distance(sign: str, periods=PERIODS) -> str:
    return length([w(f"a.t{i} {sign} b.t{i}", t) for i, t in enumerate(periods, 1)])


_QD = f"least({pair_distance('-')}, {pair_distance('+')})"
FIXTURE_SQL["fx_qsum"] = f"""
SELECT a.label, a.vec_id, sum({_QD}) AS distance_sum, max({_QD}) AS distance_max FROM fx_canon a JOIN fx_canon b ON b.label = a.label GROUP BY 1, 2"""
FIXTURE_SQL["fx_medoid"] = """
SELECT label, min(vec_id) AS vec_id, min(distance_sum) AS distance_sum FROM (SELECT *, min(distance_sum) OVER (PARTITION BY label) AS least FROM fx_qsum)
WHERE distance_sum <= least + 1e-12 GROUP BY 1"""
FIXTURE_SQL["fx_anchor"] = "\nSELECT m.label, " + ", ".join(f"c.t{i} AS a{i}" for i in range(1, 5)) + " FROM fx_medoid m JOIN fx_canon c ON c.vec_id = m.vec_id"
_AL = [f"a{i} + {w(f't{i} - a{i}', t)}" for i, t in enumerate(PERIODS, 1)]
_AR = [f"a{i} + {w(f'-t{i} - a{i}', t)}" for i, t in enumerate(PERIODS, 1)]
FIXTURE_SQL["fx_lift"] = f"""
SELECT vec_id, label, {', '.join(f'CASE WHEN pick THEN l{i} ELSE r{i} END AS t{i}' for i in range(1, 5))} FROM (
 SELECT *, CASE WHEN abs(dl - dr) <= 1e-12 THEN {choose(_L, _R)} ELSE dl < dr END AS pick FROM (
  SELECT *, {length([f'l{i} - a{i}' for i in range(1, 5)])} AS dl, {length([f'r{i} - a{i}' for i in range(1, 5)])} AS dr FROM (
   SELECT c.vec_id, c.label, {', '.join(f'n.a{i}' for i in range(1, 5))}, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_AL, 1))},
    {', '.join(f'{x} AS r{i}' for i, x in enumerate(_AR, 1))} FROM fx_canon c JOIN fx_anchor n ON n.label = c.label)))"""
_PAR = "CASE vec_id%3 WHEN 0 THEN 'even' WHEN 1 THEN 'odd' ELSE 'mixed' END"
# orbit of raw points: mask bits shift gammas; odd graphs flip betas once per set bit at or below their layer
FIXTURE_SQL["fx_orbit"] = f"""
SELECT vec_id, label, mask, sign, sign*(t1 + (mask & 1)*pi()) AS t1, sign*(t2 + ((mask >> 1) & 1)*pi()) AS t2,
 sign*t3*CASE WHEN par = 'odd' AND (mask & 1) = 1 THEN -1 ELSE 1 END AS t3,
 sign*t4*CASE WHEN par = 'odd' AND ((mask & 1) + ((mask >> 1) & 1))%2 = 1 THEN -1 ELSE 1 END AS t4
FROM (SELECT f.*, {_PAR} AS par, m.m AS mask, s.s AS sign FROM fx_flat f CROSS JOIN range(4) m(m) CROSS JOIN (VALUES (1), (-1)) s(s)) WHERE par <> 'mixed' OR mask = 0"""


def unpivot(source: str, keys: str, names: list[str] | None = None) -> str:
    names = names or T
    return " UNION ALL ".join(f"SELECT {keys}, {i} AS d, {c} AS angle FROM {source}" for i, c in enumerate(names))


_TOR = length([f"least(abs({x}), {t} - abs({x}))" for x, t in
               zip([w(f"a.t{i} - b.t{i}", t) for i, t in enumerate(("(2*pi())", "(2*pi())", "pi()", "pi()"), 1)], ("(2*pi())", "(2*pi())", "pi()", "pi()"))])
_LIFTS = ", ".join(f"a{i} + {w(f'o.t{i} - a{i}', t)} AS x{i}" for i, t in enumerate(PERIODS, 1))

QUERIES = [
    Query("ang1_wrap", lambda c: long_form(c.angles().withColumn("w", A.wrap_angles(F.col("theta"), P)), "w", "vec_id"), unpivot("fx_lr", "vec_id", _L), "angle"),
    Query("ang2_canonical", lambda c: long_form(c.angles().withColumn("c", A.canonical(F.col("theta"), P)), "c", "vec_id"), unpivot("fx_canon", "vec_id"), "angle"),
    Query("ang3_torus_distances", _torus, f"""
SELECT a.label, a.vec_id, sum({_TOR}) AS distance_sum, max({_TOR}) AS distance_max FROM fx_flat a JOIN fx_flat b ON b.label = a.label GROUP BY 1, 2""", "distance_sum distance_max"),
    Query("ang4_quotient_distances", _quotient, "SELECT label, vec_id, distance_sum, distance_max FROM fx_qsum", "distance_sum distance_max"),
    Query("ang4_distance_to_medoid", _anchor_distance, f"""
SELECT a.vec_id, {_QD} AS distance FROM fx_flat a JOIN fx_medoid m ON m.label = a.label JOIN fx_canon b ON b.vec_id = m.vec_id""", "distance"),
    Query("jn10_pool_distances", lambda c: _torus(c).groupBy("label").agg(F.sum("distance_sum").alias("total"), F.max("distance_max").alias("diameter")), f"""
SELECT a.label, sum({_TOR}) AS total, max({_TOR}) AS diameter FROM fx_flat a JOIN fx_flat b ON b.label = a.label GROUP BY 1""", "total diameter", 5),
    Query("ang5_medoid", _medoid, "SELECT label, vec_id, distance_sum FROM fx_medoid", "distance_sum"),
    Query("ang6_align_to_anchor", _aligned, unpivot("fx_lift", "vec_id"), "angle"),
    Query("ang7_aligned_median", _median, f"""
WITH med AS (SELECT label, {', '.join(f'quantile_cont(t{i}, 0.5) AS m{i}' for i in range(1, 5))} FROM fx_lift GROUP BY 1),
lr AS (SELECT label, {', '.join(f'{w(f"m{i}", t)} AS l{i}, {w(f"-m{i}", t)} AS r{i}' for i, t in enumerate(PERIODS, 1))} FROM med),
cn AS (SELECT label, {', '.join(f'CASE WHEN lw THEN l{i} ELSE r{i} END AS t{i}' for i in range(1, 5))} FROM (SELECT *, {choose(_L, _R)} AS lw FROM lr))
{unpivot('cn', 'label')}""", "angle"),
    Query("win10_even_count_median", _coordinate_median, """
SELECT label, r.i AS d, quantile_cont(theta[r.i + 1], 0.5) AS median FROM fx_angles CROSS JOIN range(4) r(i) GROUP BY 1, 2""", "median"),
    Query("win12_interpolated_quantile", _price_quantiles, """
SELECT o_orderpriority AS arm, p.p AS prob, CASE p.p WHEN 0.025 THEN quantile_cont(o_totalprice, 0.025) WHEN 0.5 THEN quantile_cont(o_totalprice, 0.5)
 ELSE quantile_cont(o_totalprice, 0.975) END AS quantile FROM orders CROSS JOIN (VALUES (0.025::DOUBLE), (0.5::DOUBLE), (0.975::DOUBLE)) p(p) GROUP BY 1, 2""", "prob quantile", 4),
    Query("ang8_symmetry_orbit", _orbit, unpivot("fx_orbit", "vec_id, mask, sign"), "angle"),
    Query("ang9_align_label", _align_label, f"""
WITH c AS (SELECT o.vec_id, o.mask, o.sign, {', '.join(f'a{i}' for i in range(1, 5))}, {_LIFTS} FROM fx_orbit o JOIN fx_anchor n ON n.label = o.label),
d AS (SELECT *, {length([f'x{i} - a{i}' for i in range(1, 5)])} AS distance FROM c),
k AS (SELECT *, min(distance) OVER (PARTITION BY vec_id) AS least FROM d)
SELECT vec_id, arg_min(mask, distance) AS mask, arg_min(sign, distance) AS sign, min(distance) AS distance, count(*) FILTER (distance <= least + 1e-12) > 1 AS tie FROM k GROUP BY 1""",
          "distance"),
    Query("ang10_encode", _encode, " UNION ALL ".join(
        f"SELECT vec_id, {2 * i} AS d, sin({k}t{i + 1}) AS angle FROM fx_flat UNION ALL SELECT vec_id, {2 * i + 1}, cos({k}t{i + 1}) FROM fx_flat"
        for i, k in enumerate(("", "", "4*", "4*"))), "angle"),
    Query("ang10_decode", _decode, f"""
WITH e AS (SELECT vec_id, {', '.join(f"CASE WHEN vec_id%9 = 0 AND {i} <= 2 THEN 0.0::DOUBLE ELSE embedding[{i + 4}]::DOUBLE END AS q{i}" for i in range(1, 9))} FROM embeddings),
r AS (SELECT *, {', '.join(f'sqrt(q{2*i-1}*q{2*i-1} + q{2*i}*q{2*i}) AS rho{i}' for i in range(1, 5))} FROM e),
f AS (SELECT *, least(rho1, rho2, rho3, rho4) AS rho_min, least(rho1, rho2, rho3, rho4) < 1e-8 AS fallback FROM r),
g AS (SELECT vec_id, rho_min, fallback, {', '.join(f"CASE WHEN fallback THEN {a}::DOUBLE ELSE atan2(q{2*i-1}, q{2*i})/{k} END AS t{i}" for i, a, k in ((1, 0.25, 1), (2, -0.5, 1), (3, 0.125, 4), (4, 0.375, 4)))} FROM f),
lr AS (SELECT *, {', '.join(f'{w(f"t{i}", t)} AS l{i}, {w(f"-t{i}", t)} AS r{i}' for i, t in enumerate(PERIODS, 1))} FROM g),
cn AS (SELECT vec_id, rho_min, fallback, {', '.join(f'CASE WHEN lw THEN l{i} ELSE r{i} END AS c{i}' for i in range(1, 5))} FROM (SELECT *, {choose(_L, _R)} AS lw FROM lr))
{unpivot('cn', 'vec_id, rho_min, fallback', [f'c{i}' for i in range(1, 5)])}""", "rho_min angle"),
    Query("ang11_quotient_loss", _loss, f"""
WITH t AS (SELECT vec_id, {', '.join(f'embedding[{i + 4}]::DOUBLE*12.0::DOUBLE AS g{i}' for i in range(1, 5))}, {_PAR} AS par FROM embeddings),
o AS (SELECT vec_id, sign*(g1 + (mask & 1)*pi()) AS g1, sign*(g2 + ((mask >> 1) & 1)*pi()) AS g2, sign*g3*CASE WHEN par = 'odd' AND (mask & 1) = 1 THEN -1 ELSE 1 END AS g3,
  sign*g4*CASE WHEN par = 'odd' AND ((mask & 1) + ((mask >> 1) & 1))%2 = 1 THEN -1 ELSE 1 END AS g4
  FROM (SELECT t.*, m.m AS mask, s.s AS sign FROM t CROSS JOIN range(4) m(m) CROSS JOIN (VALUES (1), (-1)) s(s)) WHERE par <> 'mixed' OR mask = 0)
SELECT f.vec_id, min(({' + '.join(f'pow({w(f"f.t{i} - o.g{i}", t)}, 2)' for i, t in enumerate(PERIODS, 1))})/4) AS loss FROM fx_flat f JOIN o ON o.vec_id = f.vec_id GROUP BY 1""", "loss"),
    Query("ang12_endpoint_clusters", _cluster_rows),
    Query("ang12_cluster_summary", _cluster_summary),
    Query("ang12_cluster_sensitivity", _cluster_sensitivity),
]
