"""Queries of the comparison family."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from restartlab.operators import binding as BD, compare as C, pools as P, scoring as S
from restartlab.operators.models import stored_table
from restartlab.plans.fixtures import FIXTURE_SQL, Catalog
from restartlab.plans.pools import _TOTALS, _WARM_SQL, attributions, costs
from restartlab.plans.quality import pool_references, union_references
from restartlab.plans.query import Query
from restartlab.plans.scoring import FAULT, _deep_prefixes, _half_best, _prefix_best, deep_scored, references, scored, selected

METRICS = ["quality", "success"]


def paired_arms(cat: Catalog, method: str, baselines: list[str]) -> DataFrame:
    """One row per graph and baseline ``arm`` with both arms, from one pass over the arms; every 400th graph is incomplete."""
    values = F.struct("quality", "success_fraction")
    is_method = F.col("arm") == method
    graphs = (cat.arms().where(F.col("arm").isin(method, *baselines) & F.col("cell").isNotNull()).groupBy("graph_id", "cell")
              .agg(F.max(F.when(is_method, values)).alias("m"), F.collect_list(F.when(F.col("arm").isin(*baselines), F.struct("arm", values.alias("v")))).alias("b")))
    rows = graphs.where("m is not null").select("graph_id", "cell", "m", F.explode("b").alias("b"))
    return rows.select("graph_id", "cell", F.col("m.quality").alias("method_quality"), F.col("m.success_fraction").alias("method_success"),
                       F.col("b.v.quality").alias("baseline_quality"), F.col("b.v.success_fraction").alias("baseline_success"),
                       (F.col("graph_id") % 400 != 0).alias("complete"), F.col("b.arm").alias("arm"))


def pairs(cat: Catalog, method: str = "1-URGENT", baseline: str = "5-LOW") -> DataFrame:
    """One row per graph with both arms."""
    return paired_arms(cat, method, [baseline]).drop("arm")


FIXTURE_SQL["fx_pairs"] = """
SELECT a.graph_id, a.cell, a.arm AS method, b.arm AS baseline, a.quality AS mq, b.quality AS bq, a.success_fraction AS ms, b.success_fraction AS bs,
 a.graph_id%400 <> 0 AS complete FROM fx_arms a JOIN fx_arms b ON b.graph_id = a.graph_id"""
_LONG = """(SELECT *, 'quality' AS metric, mq AS m, bq AS b FROM fx_pairs UNION ALL SELECT *, 'success', ms, bs FROM fx_pairs)"""
_POINTS = """count(*) AS graphs, bool_and(complete) AS complete, avg(b) AS baseline_mean, avg(m) AS method_mean, avg(m - b) AS difference,
 CASE WHEN NOT bool_and(complete) THEN 'provisional' WHEN count(*) < 2 THEN 'fewer_than_two_graphs' ELSE 'available' END AS ci_status"""
_UL = "method = '1-URGENT' AND baseline = '5-LOW'"
_FLOATS = "baseline_mean method_mean difference"


def scoped(df: DataFrame, cat: Catalog) -> DataFrame:
    """Random scope of all graphs and the hold-out scope of each graph's own family."""
    region = F.broadcast(cat.table("nation").join(cat.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_nationkey").cast("bigint").alias("cell"), F.col("r_name").alias("family")))  # 25 nations, a closed dimension
    scopes = F.array(F.struct(F.lit("random").alias("regime"), F.lit(None).cast("string").alias("fold")),
                     F.struct(F.lit("lofo").alias("regime"), F.col("family").alias("fold")))
    return df.join(region, "cell").withColumn("s", F.explode(scopes)).select("*", "s.regime", "s.fold").drop("s", "family")


def _grouped(cat: Catalog) -> DataFrame:
    return pairs(cat).withColumn("grp", F.col("cell") % 5)


def _single(cat: Catalog) -> DataFrame:
    """One start per graph on the method side: success is 0 or 1."""
    return _grouped(cat).withColumn("method_success", F.when(F.col("method_success") >= 0.5, 1.0).otherwise(0.0))


def _warm_pairs(cat: Catalog) -> DataFrame:
    """Baseline pool of two restarts against one warm start per graph."""
    rows, names = scored(cat), WARM_NAMES
    base, warm = P.warm_pool(rows.where("restart_id in (2, 3)"), ["graph_id"]), P.warm_pool(rows.where("restart_id = 4"), ["graph_id"])
    b = base.select("graph_id", F.col("complete").alias("cb"), *[F.col(n).alias(f"baseline_{n}") for n in names])
    m = warm.select("graph_id", F.col("complete").alias("cm"), *[F.col(n).alias(f"method_{n}") for n in names])
    return b.join(m, "graph_id").withColumns({"complete": F.col("cb") & F.col("cm"), "grp": F.col("graph_id") % 40})


WARM_NAMES = ["c_initial", "c_final", "gap_final_ref", "terminal_success_fraction", "hit_fraction", "objective_calls"]
FIXTURE_SQL["fx_wb"] = _WARM_SQL.replace("FROM fx_scored)", "FROM fx_scored WHERE restart_id IN (2, 3))")
FIXTURE_SQL["fx_wm"] = _WARM_SQL.replace("FROM fx_scored)", "FROM fx_scored WHERE restart_id = 4)")
_WARM_LONG = " UNION ALL ".join(
    f"SELECT b.graph_id, b.graph_id%40 AS grp, b.complete AND m.complete AS complete, '{n}' AS metric, b.{n} AS b, m.{n} AS m FROM fx_wb b JOIN fx_wm m ON m.graph_id = b.graph_id"
    for n in WARM_NAMES)


def rule_pairs(cat: Catalog) -> DataFrame:
    """Rule starts against the three baselines, in the random scope and every hold-out scope."""
    names = {"5-LOW": "B1", "2-HIGH": "B2:medoid", "3-MEDIUM": "B2:aligned_median"}
    rows = paired_arms(cat, "1-URGENT", list(names)).replace(names, subset=["arm"])
    return scoped(rows.withColumnRenamed("arm", "baseline"), cat)


RULE_KEYS = ["regime", "fold", "baseline"]
LEARNED_KEYS = ["regime", "fold", "baseline_method", "variant"]


def _rule_summary(cat: Catalog) -> DataFrame:
    return C.paired_means(rule_pairs(cat), RULE_KEYS, METRICS)


def binary(pairs_: DataFrame) -> DataFrame:
    """One start per graph on the method side: success is 0 or 1."""
    return pairs_.withColumn("method_success", F.when(F.col("method_success") >= 0.5, 1.0).otherwise(0.0))


def checked(out: DataFrame, keys: list[str]) -> DataFrame:
    """An interval where, and only where, the comparison supports one, with the mean difference between its ends or within one width of them."""
    wide = F.col("ci_high") - F.col("ci_low")
    near = (F.col("difference") >= F.col("ci_low") - wide) & (F.col("difference") <= F.col("ci_high") + wide)
    ready = F.col("ci_status") == "available"
    return out.select(*keys, "metric", "graphs", "complete", "baseline_mean", "method_mean", "difference", "ci_status",
                      F.when(ready, (F.col("ci_low") <= F.col("ci_high")) & near).otherwise(F.col("ci_low").isNull() & F.col("ci_high").isNull()).alias("interval_fits"))


def predictions(cat: Catalog) -> DataFrame:
    """Observed rates of one arm, predictions from another, and a constant baseline; some labels are missing."""
    p = pairs(cat, "4-NOT SPECIFIED", "5-LOW")
    return p.select("graph_id", (F.col("cell") % 5).alias("grp"), F.when(F.col("graph_id") % 300 != 7, F.col("baseline_success")).alias("observed"),
                    (F.col("method_success") * 0.5 + 0.25).alias("method"), F.lit(0.5).alias("baseline"))


FIXTURE_SQL["fx_pred"] = """
SELECT graph_id, cell%5 AS grp, cell, CASE WHEN graph_id%300 <> 7 THEN bs END AS observed, ms*0.5 + 0.25 AS pm, 0.5 AS pb FROM fx_pairs
WHERE method = '4-NOT SPECIFIED' AND baseline = '5-LOW'"""


def learned_pairs(cat: Catalog) -> DataFrame:
    """Learned method against every baseline and control arm, in all scopes."""
    specs = [("B1", None, "5-LOW"), ("B2", "medoid", "2-HIGH"), ("B2", "aligned_median", "3-MEDIUM"), ("B3", None, "1-URGENT")]
    rows = None
    for method, variant, arm in specs:
        part = scoped(pairs(cat, "4-NOT SPECIFIED", arm), cat).withColumns({"baseline_method": F.lit(method), "variant": F.lit(variant).cast("string")})
        rows = part if rows is None else rows.unionByName(part)
    return rows


def learned_comparisons(cat: Catalog) -> DataFrame:
    """The random-scope F case is primary."""
    return C.paired_means(learned_pairs(cat), LEARNED_KEYS, METRICS).withColumn("primary", F.col("regime") == "random")


def _feature_controls(cat: Catalog) -> DataFrame:
    """Feature-group and shuffled-row controls of the learned method, paired by graph."""
    kinds = [("feature_group", "U", "2-HIGH"), ("shuffled_control", "F:20260922", "3-MEDIUM"), ("shuffled_control", "F:20260923", "1-URGENT")]
    rows = None
    for kind, control, arm in kinds:
        part = pairs(cat, "4-NOT SPECIFIED", arm).withColumns({"comparison_kind": F.lit(kind), "control": F.lit(control)})
        rows = part if rows is None else rows.unionByName(part)
    return C.paired_means(rows, ["comparison_kind", "control"], METRICS)


def _boosted(cat: Catalog) -> DataFrame:
    """Boosted against the matched linear arm, with attribution coverage and range flags beside it."""
    means = C.paired_means(pairs(cat, "3-MEDIUM", "4-NOT SPECIFIED"), [], METRICS).withColumn("k", F.lit(1))
    attr = attributions(cat).agg(F.count(F.lit(1)).alias("explained"), F.count_if((F.col("raw") < 0) | (F.col("raw") > 1)).alias("clipped")).withColumn("k", F.lit(1))
    return means.join(attr, "k").drop("k")


def family_pairs(cat: Catalog) -> DataFrame:
    """Graph-level rates of two arms of the study graphs with their strata."""
    g = cat.graphs().where("graph_split <> 'training'")
    lab = cat.labels().select("graph_id", (F.col("successes") / F.col("trials")).alias("method_success"), (F.col("trials") % 5 / 5).alias("baseline_success"))
    return g.join(lab, "graph_id").withColumns({"n_band": F.col("m") % 4, "complete": F.col("graph_id") % 1000 != 0})


def _strata(cat: Catalog, dims) -> DataFrame:
    rows = C.with_strata(family_pairs(cat), dims)
    means = C.paired_means(rows, ["dimension", "value"], ["success"])
    degree = rows.groupBy("dimension", "value").agg(F.avg(2 * F.col("m") / F.col("n")).alias("mean_actual_degree"))
    return means.join(degree, ["dimension", "value"])


def _strata_sql(dims: dict[str, str]) -> str:
    base = """(SELECT g.*, l.successes/l.trials::DOUBLE AS ms, (l.trials%5)/5.0 AS bs, g.m%4 AS n_band, g.graph_id%1000 <> 0 AS ok
 FROM fx_graphs g JOIN fx_labels l ON l.graph_id = g.graph_id WHERE g.graph_split <> 'training')"""
    union = " UNION ALL ".join(f"SELECT '{name}' AS dimension, {expr} AS value, * FROM q" for name, expr in {"all": "'all'", **dims}.items())
    return f"""WITH q AS {base}, s AS ({union})
SELECT dimension, value, 'success' AS metric, count(*) AS graphs, bool_and(ok) AS complete, avg(bs) AS baseline_mean, avg(ms) AS method_mean, avg(ms - bs) AS difference,
 CASE WHEN NOT bool_and(ok) THEN 'provisional' WHEN count(*) < 2 THEN 'fewer_than_two_graphs' ELSE 'available' END AS ci_status, avg(2.0*m/n) AS mean_actual_degree
FROM s GROUP BY 1, 2"""


OUTCOMES = ["old_success", "rule_success", "learned_success", "quality", "half_gap", "calls"]


def family_rows(cat: Catalog) -> DataFrame:
    """Graph metrics for the adjusted family model: four sizes, two bands, four families."""
    size = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in (12, 16, 20, 24)]), (F.floor(F.col("graph_id") / 7) % 4 + 1).cast("int"))
    family = F.when(F.col("family") == "AMERICA", "regular").when(F.col("family") == "ASIA", "ba").when(F.col("family") == "EUROPE", "sbm").otherwise("er")
    rate = F.col("successes") / F.col("trials")
    lab = cat.labels().select("graph_id", rate.alias("old_success"), F.sqrt(rate).alias("rule_success"), (1 - rate).alias("learned_success"), (F.col("trials") / 40).alias("quality"),
                              (F.col("trials") % 7 / 7).alias("half_gap"), F.log1p("trials").alias("calls"))
    return cat.graphs().join(lab, "graph_id").select(
        "graph_id", size.alias("n"), "degree_band", family.alias("family"), (2 * F.col("m") / 12).alias("mean_degree"), *OUTCOMES)


def _adjusted(cat: Catalog) -> DataFrame:
    return C.adjusted_families(family_rows(cat), OUTCOMES, {"linear": False, "quadratic": True}, draws=2000)


def batch_summary(cat: Catalog) -> DataFrame:
    """One row per graph: pool, reference ratio, best restart, exceedances."""
    rows = scored(cat)
    pool = S.pool_statistics(rows, ["graph_id"], expected=4)
    best = S.best_and_bias(rows, ["graph_id"]).select("graph_id", "best_seen", "source_task_id", "bias")
    more = rows.groupBy("graph_id").agg(F.count_if(F.coalesce("reference_exceeded", F.lit(False))).alias("reference_exceeded_count"),
                                        F.max(F.col("c_ref") / F.col("c_star")).alias("reference_ratio_exact"))
    return pool.join(best, "graph_id").join(more, "graph_id").select(
        "graph_id", "planned", "valid", "successes", "fixed_budget_success_fraction", "best_seen", "source_task_id", "bias",
        "reference_exceeded_count", "reference_ratio_exact")


def _deep_summary(cat: Catalog) -> DataFrame:
    """The same row per graph and depth."""
    rows, keys = deep_scored(cat), ["graph_id", "p"]
    best = S.best_and_bias(rows, keys).select(*keys, "best_seen", "bias")
    more = rows.groupBy(*keys).agg(F.count_if(F.coalesce("reference_exceeded", F.lit(False))).alias("reference_exceeded_count"))
    return S.pool_statistics(rows, keys, expected=4).join(best, keys).join(more, keys).select(*keys, "planned", "valid", "successes", "best_seen", "bias", "reference_exceeded_count")


def _deep_stability(cat: Catalog) -> DataFrame:
    """Half gap and last prefix gain of every pool of a graph and depth."""
    j = _deep_prefixes(cat).join(cat.cstar(), "graph_id")
    gap, gain = F.abs(F.col("half_1") - F.col("half_2")) / F.col("c_star"), (F.col("best_6") - F.col("best_4")) / F.col("c_star")
    return j.select("graph_id", "p", gap.alias("half_gap"), gain.alias("last_prefix_gain"), (F.greatest(gap, gain) > 0.1).alias("stability_flag"))


def _stability(cat: Catalog) -> DataFrame:
    union = union_references(pool_references(cat, 0, 2), pool_references(cat, 2, 4))
    report = C.stability_report(_prefix_best(cat), _half_best(cat), union, cat.cstar(), "best_6", "best_4", 0.1)
    return report.select("graph_id", "half_gap", "last_prefix_gain", "union_gain_over_old", "stability_flag")


def _follow_up(cat: Catalog) -> DataFrame:
    """Stability flags counted, with the cost of all attempts."""
    flags = _stability(cat).agg(F.count(F.lit(1)).alias("graphs"), F.count_if("stability_flag").alias("flags")).withColumn("k", F.lit(1))
    cost = P.cost_totals(costs(cat).withColumn("k", F.lit(1)), ["k"]).where("metric in ('objective_calls', 'elapsed_seconds', 'device_vjps')")
    return flags.join(cost, "k").drop("k")


def _learning_costs(cat: Catalog) -> DataFrame:
    """Shared label and reference pools once, plus fit seconds; an unmeasured fit leaves its total null."""
    pools_ = P.cost_totals(costs(cat), ["role"]).where("metric in ('objective_calls', 'elapsed_seconds')").select(
        F.concat(F.lit("pool:"), "role").alias("item"), "metric", "total", "known_subtotal", "unknown_count")
    fits = cat.table("nation").select((F.col("n_nationkey") % 3).alias("f"), F.when(F.col("n_nationkey") != 7, F.col("n_regionkey") * 1.5 + 1).alias("s"))
    unknown = F.count_if(F.col("s").isNull())
    fit = fits.groupBy("f").agg(F.when(unknown == 0, F.sum("s")).alias("total"), F.sum("s").alias("known_subtotal"), unknown.alias("unknown_count")).select(
        F.concat(F.lit("fit:"), F.col("f").cast("string")).alias("item"), F.lit("fit_seconds").alias("metric"), "total", "known_subtotal", "unknown_count")
    return pools_.unionByName(fit)


def _batches(cat: Catalog) -> DataFrame:
    """Two batches of one study side by side: outcomes, costs and settings that differ."""
    rows = scored(cat).withColumn("batch", F.when(F.col("graph_id") % 2 == 0, "even").otherwise("odd"))
    out = rows.groupBy("batch").agg(
        F.count(F.lit(1)).alias("planned"), F.count_if("execution_valid").alias("valid"), F.count_if("missing").alias("missing"),
        F.count_if(F.coalesce("terminal_success", F.lit(False))).alias("known_successes"),
        F.bool_and("reference_complete").alias("reference_complete"))
    cost = costs(cat).withColumn("batch", F.when(F.col("graph_id") % 2 == 0, "even").otherwise("odd"))
    total = P.cost_totals(cost, ["batch"]).where("metric = 'elapsed_seconds'").select("batch", F.col("total").alias("elapsed_seconds"))
    return out.join(total, "batch")


def _interval_queries() -> list[Query]:
    """The five summaries with their intervals; each twin has the points and statuses, and that every interval fits them."""
    def twin(sql: str, more: str = "") -> str:
        return f"SELECT *{more}, true AS interval_fits FROM ({sql}) AS points"

    points = {q.key: q.sql for q in _SUMMARIES}
    strata = lambda dims: lambda c: checked(C.with_intervals(C.with_strata(family_pairs(c), dims), ["dimension", "value"], ["success"]), ["dimension", "value"])
    boosted = lambda c: checked(C.paired_bootstrap(pairs(c, "3-MEDIUM", "4-NOT SPECIFIED"), [], METRICS), [])
    return [
        Query("cmp6_rule_start_intervals", lambda c: checked(C.with_intervals(rule_pairs(c), RULE_KEYS, METRICS), RULE_KEYS), twin(points["cmp6_rule_start_summary"]), _FLOATS, 4),
        Query("cmp6_rule_start_success", lambda c: C.success_with_intervals(binary(rule_pairs(c)), RULE_KEYS).select(
            *RULE_KEYS, "graphs", "complete", F.round("method_fraction", 4).alias("method_fraction"),
            (F.coalesce((F.col("baseline_low") <= F.col("baseline_fraction")) & (F.col("baseline_fraction") <= F.col("baseline_high")), ~F.col("complete"))
             & F.coalesce((F.col("method_low") <= F.col("method_fraction")) & (F.col("method_fraction") <= F.col("method_high")), ~F.col("complete"))).alias("interval_fits")), """
WITH l AS (SELECT x.*, r.r_name AS family, CASE baseline WHEN '5-LOW' THEN 'B1' WHEN '2-HIGH' THEN 'B2:medoid' ELSE 'B2:aligned_median' END AS base FROM fx_pairs x
 JOIN nation n ON n.n_nationkey = x.cell JOIN region r ON r.r_regionkey = n.n_regionkey WHERE method = '1-URGENT' AND baseline IN ('5-LOW', '2-HIGH', '3-MEDIUM'))
SELECT 'random' AS regime, NULL AS fold, base AS baseline, count(*) AS graphs, bool_and(complete) AS complete, avg(CASE WHEN ms >= 0.5 THEN 1.0 ELSE 0.0 END) AS method_fraction, true AS interval_fits FROM l GROUP BY base
UNION ALL SELECT 'lofo', family, base, count(*), bool_and(complete), avg(CASE WHEN ms >= 0.5 THEN 1.0 ELSE 0.0 END), true FROM l GROUP BY family, base""", "method_fraction", 4),
        Query("cmp7_learned_intervals", lambda c: checked(C.with_intervals(learned_pairs(c), LEARNED_KEYS, METRICS), LEARNED_KEYS),
              twin(f"SELECT * EXCLUDE (\"primary\") FROM ({points['cmp7_learned_summary']})"), _FLOATS, 4),
        Query("cmp8_boosted_intervals", boosted, twin(f"SELECT * EXCLUDE (explained, clipped) FROM ({points['cmp8_boosted_summary']})"), _FLOATS, 4),
        Query("cmp9_stratified_intervals", strata(["n_band", "degree_band", "family"]),
              twin(f"SELECT * EXCLUDE (mean_actual_degree) FROM ({points['cmp9_stratified_descriptive']})"), _FLOATS),
        Query("cmp10_transfer_intervals", strata(["family", "n", "degree_band", "cell", "tier"]),
              twin(f"SELECT * EXCLUDE (mean_actual_degree) FROM ({points['cmp10_transfer_summary']})"), _FLOATS),
    ]


_SUMMARIES: list[Query] = []  # filled from QUERIES below
BATCHES = ("even", "odd")
#: What each artifact of a batch is made from; the graph library is shared.
MADE_FROM = (("plan", "shared", "library"), ("attempts", None, "plan"), ("references", None, "plan"), ("references", None, "attempts"), ("report", None, "references"), ("report", None, "attempts"))


def _artifact_rows(cat: Catalog) -> dict[str, tuple[DataFrame, str, list[str]]]:
    """Rows of every artifact of the two batches, with key and columns."""
    batch = F.when(F.col("graph_id") % 2 == 0, "even").otherwise("odd")
    report = S.pool_statistics(scored(cat), ["graph_id"], expected=4)
    made = {"library": (cat.graphs(), "graph_id", ["graph_id", "m", "family"]), "plan": (cat.tasks(), "task_id", ["task_id", "graph_id", "experiment_role"]),
            "attempts": (selected(cat), "task_id", ["task_id", "attempt_number", "stop_reason", "objective_calls"]),
            "references": (references(cat), "graph_id", ["graph_id", "planned", "valid", "source_task_id"]), "report": (report, "graph_id", ["graph_id", "planned", "valid", "missing", "successes"])}
    return {name: (df.withColumn("batch", F.lit("shared") if name == "library" else batch).withColumn("artifact", F.lit(name)), key, columns) for name, (df, key, columns) in made.items()}


def bound_batches(cat: Catalog, altered: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifest and problems of the two batches; one number in one artifact is changed after it was recorded, if ``altered`` names it."""
    ids = now = None
    for name, (rows, key, columns) in _artifact_rows(cat).items():
        rows = stored_table(rows.select("batch", "artifact", *columns), name)
        ids = BD.artifact_ids(rows, key, columns) if ids is None else ids.unionByName(BD.artifact_ids(rows, key, columns))
        if altered and altered[1] == name:
            first = rows.where(F.col("batch") == altered[0]).agg(F.min(key)).first()[0]
            rows = rows.withColumn(columns[-1], F.when((F.col("batch") == altered[0]) & (F.col(key) == first), F.lit(-1).cast(dict(rows.dtypes)[columns[-1]])).otherwise(F.col(columns[-1])))
        now = BD.artifact_ids(rows, key, columns) if now is None else now.unionByName(BD.artifact_ids(rows, key, columns))
    manifest = stored_table(ids, "manifest")
    edges = cat.spark.createDataFrame([(b, a, source or b, i) for b in BATCHES for a, source, i in MADE_FROM], "batch string, artifact string, input_batch string, input_artifact string")
    inputs = edges.join(manifest.select(F.col("batch").alias("input_batch"), F.col("artifact").alias("input_artifact"), F.col("id").alias("input_id")), ["input_batch", "input_artifact"])
    return manifest, BD.binding_problems(manifest, inputs, now)


def batch_settings(cat: Catalog) -> DataFrame:
    """What two batches must share: library, restarts per graph, and reference pool size."""
    tasks = cat.tasks().withColumn("batch", F.when(F.col("graph_id") % 2 == 0, "even").otherwise("odd"))
    per = tasks.groupBy("batch", "graph_id").agg(F.count(F.lit(1)).alias("restarts"), F.count_if(F.col("experiment_role") == "reference").alias("pool"))
    return per.groupBy("batch").agg(F.lit("shared/library").alias("library"), F.max("restarts").alias("restarts"), F.min("restarts").alias("fewest"), F.max("pool").alias("pool"))


def _bound_reports(cat: Catalog) -> DataFrame:
    """Reports of two batches, read only once every artifact holds and their settings agree."""
    manifest, problems = bound_batches(cat)
    BD.require_bound(problems, BD.incompatible(batch_settings(cat), "even", ["library", "restarts", "fewest", "pool"]))
    count = manifest.where("batch <> 'shared'").groupBy("batch").agg((F.count(F.lit(1)) + 1).alias("artifacts"), F.sum("entries").alias("entries"))
    return _batches(cat).join(F.broadcast(count), "batch")


def _altered_artifact(cat: Catalog) -> DataFrame:
    """One number in the attempts of a batch changes after recording: the artifact is named, all that was made from it is, and no report is read."""
    _, problems = bound_batches(cat, ("odd", "attempts"))
    try:
        BD.require_bound(problems, BD.incompatible(batch_settings(cat), "even", ["restarts", "pool"]))
        refused = ""
    except ValueError as error:
        refused = str(error).split(";")[0]
    return problems.withColumn("refused", F.lit(refused))


QUERIES = [
    Query("cmp1_paired_means", lambda c: C.paired_means(_grouped(c), ["grp"], METRICS),
          f"SELECT cell%5 AS grp, metric, {_POINTS} FROM {_LONG} WHERE {_UL} GROUP BY 1, 2", _FLOATS, 4),
    Query("cmp1_paired_bootstrap", lambda c: C.paired_bootstrap(_grouped(c), ["grp"], METRICS)),
    Query("cmp2_stratified_means", lambda c: C.stratified_means(pairs(c), METRICS), f"""
SELECT metric, sum(s)/sum(k) AS graph_equal, avg(s/k) AS cell_equal, CAST(sum(k) AS BIGINT) AS graphs, count(*) AS cells FROM (
 SELECT metric, cell, sum(m - b) AS s, count(*) AS k FROM {_LONG} WHERE {_UL} GROUP BY 1, 2) GROUP BY 1""", "graph_equal cell_equal", 4),
    Query("cmp2_stratified_bootstrap", lambda c: C.stratified_bootstrap(pairs(c), METRICS)),
    Query("cmp3_success_points", lambda c: C.success_points(_single(c), ["grp"]), """
SELECT grp, graphs, complete, bf AS baseline_fraction, s/graphs AS method_fraction,
 CASE WHEN complete THEN CASE WHEN s = 0 THEN 0 ELSE greatest(0, ctr - hw) END END AS method_low, CASE WHEN complete THEN CASE WHEN s = graphs THEN 1 ELSE least(1, ctr + hw) END END AS method_high
FROM (SELECT *, (s/graphs + z*z/(2*graphs))/(1 + z*z/graphs) AS ctr, z*sqrt((s/graphs)*(1 - s/graphs)/graphs + z*z/(4.0*graphs*graphs))/(1 + z*z/graphs) AS hw FROM (
 SELECT cell%5 AS grp, count(*) AS graphs, bool_and(complete) AS complete, avg(bs) AS bf, sum(CASE WHEN ms >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS s, 1.959963984540054::DOUBLE AS z
 FROM fx_pairs WHERE """ + _UL + " GROUP BY 1))", "baseline_fraction method_fraction method_low method_high"),
    Query("cmp3_success_intervals", lambda c: C.success_intervals(_single(c), ["grp"])),
    Query("cmp4_prediction_points", lambda c: C.prediction_comparison(predictions(c), ["grp"]), """
SELECT grp, count(*) AS graphs, count(observed) AS valid_labels, count(observed) = count(*) AS complete,
 CASE WHEN count(observed) = count(*) THEN sqrt(avg(pow(pm - observed, 2))) END AS method_rmse, CASE WHEN count(observed) = count(*) THEN sqrt(avg(pow(pb - observed, 2))) END AS baseline_rmse,
 CASE WHEN count(observed) = count(*) THEN sqrt(avg(pow(pm - observed, 2))) - sqrt(avg(pow(pb - observed, 2))) END AS rmse_difference,
 CASE WHEN count(observed) = count(*) THEN avg(abs(pm - observed)) END AS method_mae, CASE WHEN count(observed) = count(*) THEN avg(abs(pb - observed)) END AS baseline_mae,
 CASE WHEN count(observed) = count(*) THEN avg(abs(pm - observed)) - avg(abs(pb - observed)) END AS mae_difference FROM fx_pred GROUP BY 1""",
          "method_rmse baseline_rmse rmse_difference method_mae baseline_mae mae_difference"),
    Query("cmp4_prediction_bootstrap", lambda c: C.prediction_bootstrap(predictions(c), ["grp"])),
    Query("cmp5_warm_vs_baseline", lambda c: C.paired_means(_warm_pairs(c), ["grp"], WARM_NAMES), f"""
SELECT grp, metric, count(*) AS graphs, bool_and(complete) AS complete, CASE WHEN count(b) = count(*) THEN avg(b) END AS baseline_mean,
 CASE WHEN count(m) = count(*) THEN avg(m) END AS method_mean, CASE WHEN count(m - b) = count(*) THEN avg(m - b) END AS difference,
 CASE WHEN NOT bool_and(complete) THEN 'provisional' WHEN count(*) < 2 THEN 'fewer_than_two_graphs' WHEN count(m - b) < count(*) THEN 'metric_unavailable' ELSE 'available' END AS ci_status
FROM ({_WARM_LONG}) GROUP BY 1, 2""", _FLOATS),
    Query("cmp5_warm_bootstrap", lambda c: C.paired_bootstrap(_warm_pairs(c), ["grp"], WARM_NAMES, draws=2000)),
    Query("cmp6_rule_start_summary", _rule_summary, f"""
WITH l AS (SELECT x.*, r.r_name AS family, CASE baseline WHEN '5-LOW' THEN 'B1' WHEN '2-HIGH' THEN 'B2:medoid' ELSE 'B2:aligned_median' END AS base FROM {_LONG} x
 JOIN nation n ON n.n_nationkey = x.cell JOIN region r ON r.r_regionkey = n.n_regionkey WHERE method = '1-URGENT' AND baseline IN ('5-LOW', '2-HIGH', '3-MEDIUM'))
SELECT 'random' AS regime, NULL AS fold, base AS baseline, metric, {_POINTS} FROM l GROUP BY base, metric
UNION ALL SELECT 'lofo', family, base, metric, {_POINTS} FROM l GROUP BY family, base, metric""", _FLOATS, 4),
    Query("cmp7_learned_summary", learned_comparisons, f"""
WITH l AS (SELECT x.*, r.r_name AS family, CASE baseline WHEN '5-LOW' THEN 'B1' WHEN '1-URGENT' THEN 'B3' ELSE 'B2' END AS base,
  CASE baseline WHEN '2-HIGH' THEN 'medoid' WHEN '3-MEDIUM' THEN 'aligned_median' END AS variant FROM {_LONG} x
 JOIN nation n ON n.n_nationkey = x.cell JOIN region r ON r.r_regionkey = n.n_regionkey WHERE method = '4-NOT SPECIFIED' AND baseline <> method)
SELECT 'random' AS regime, NULL AS fold, base AS baseline_method, variant, metric, {_POINTS}, true AS primary FROM l GROUP BY base, variant, metric
UNION ALL SELECT 'lofo', family, base, variant, metric, {_POINTS}, false FROM l GROUP BY family, base, variant, metric""", _FLOATS, 4),
    Query("cmp7_control_comparisons", _feature_controls, f"""
SELECT CASE baseline WHEN '2-HIGH' THEN 'feature_group' ELSE 'shuffled_control' END AS comparison_kind,
 CASE baseline WHEN '2-HIGH' THEN 'U' WHEN '3-MEDIUM' THEN 'F:20260922' ELSE 'F:20260923' END AS control, metric, {_POINTS} FROM {_LONG}
WHERE method = '4-NOT SPECIFIED' AND baseline IN ('2-HIGH', '3-MEDIUM', '1-URGENT') GROUP BY 1, 2, 3""", _FLOATS, 4),
    Query("cmp8_boosted_summary", _boosted, f"""
SELECT metric, {_POINTS}, (SELECT count(*) FROM fx_attr) AS explained, (SELECT count(*) FROM fx_attr WHERE raw < 0 OR raw > 1) AS clipped
FROM {_LONG} WHERE method = '3-MEDIUM' AND baseline = '4-NOT SPECIFIED' GROUP BY metric""", _FLOATS, 4),
    Query("cmp9_stratified_descriptive", lambda c: _strata(c, ["n_band", "degree_band", "family"]),
          _strata_sql({"n_band": "n_band::VARCHAR", "degree_band": "degree_band::VARCHAR", "family": "family"}), f"{_FLOATS} mean_actual_degree"),
    Query("cmp10_transfer_summary", lambda c: _strata(c, ["family", "n", "degree_band", "cell", "tier"]),
          _strata_sql({"family": "family", "n": "n::VARCHAR", "degree_band": "degree_band::VARCHAR", "cell": "cell", "tier": "tier::VARCHAR"}), f"{_FLOATS} mean_actual_degree"),
    Query("cmp1_pick_sums", lambda c: C.pick_sums(rule_pairs(c).withColumn("fold", F.coalesce("fold", F.lit(""))), RULE_KEYS), """
WITH l AS (SELECT r.r_name AS family, CASE baseline WHEN '5-LOW' THEN 'B1' WHEN '2-HIGH' THEN 'B2:medoid' ELSE 'B2:aligned_median' END AS base FROM fx_pairs x
 JOIN nation n ON n.n_nationkey = x.cell JOIN region r ON r.r_regionkey = n.n_regionkey WHERE method = '1-URGENT' AND baseline IN ('5-LOW', '2-HIGH', '3-MEDIUM')),
s AS (SELECT 'random' AS regime, '' AS fold, base AS baseline, count(*) AS graphs FROM l GROUP BY 3 UNION ALL SELECT 'lofo', family, base, count(*) FROM l GROUP BY 2, 3)
SELECT *, 2000 AS draws, graphs AS fewest_picks, graphs AS most_picks FROM s"""),
    Query("cmp11_adjusted_family", _adjusted),
    Query("cmp12_batch_summary", batch_summary, """
SELECT s.graph_id, count(*) AS planned, count(*) FILTER (execution_valid) AS valid,
 CASE WHEN bool_and(coalesce(reference_complete, false)) THEN count(*) FILTER (terminal_success) END AS successes,
 CASE WHEN bool_and(coalesce(reference_complete, false)) THEN count(*) FILTER (terminal_success)/count(*)::DOUBLE END AS fixed_budget_success_fraction,
 max(best_seen) FILTER (execution_valid) AS best_seen, arg_min(s.task_id, (-best_seen, s.task_id)) FILTER (execution_valid AND best_seen IS NOT NULL) AS source_task_id,
 max(c_ref) - max(best_seen) FILTER (execution_valid) AS bias, count(*) FILTER (reference_complete AND x.m > c_ref) AS reference_exceeded_count,
 max(c_ref/c_star) AS reference_ratio_exact
FROM fx_scored s LEFT JOIN (SELECT task_id, attempt_number, max(c) AS m FROM fx_trace GROUP BY 1, 2) x ON x.task_id = s.task_id AND x.attempt_number = s.attempt_number
GROUP BY 1""", "fixed_budget_success_fraction best_seen bias reference_ratio_exact"),
    Query("cmp12_batch_summary_by_depth", _deep_summary, """
SELECT graph_id, p, count(*) AS planned, count(*) FILTER (execution_valid) AS valid,
 CASE WHEN bool_and(coalesce(reference_complete, false)) THEN count(*) FILTER (terminal_success) END AS successes, max(best_seen) FILTER (execution_valid) AS best_seen,
 max(c_ref) - max(best_seen) FILTER (execution_valid) AS bias, count(*) FILTER (reference_complete AND top > c_ref) AS reference_exceeded_count FROM fx_deep_scored GROUP BY 1, 2""", "best_seen bias"),
    Query("cmp14_reference_stability_by_depth", _deep_stability, f"""
WITH b AS (SELECT t.graph_id, t.p, t.restart_id, CASE WHEN NOT ({FAULT}) THEN s.best_seen END AS b FROM fx_deep_tasks t LEFT JOIN fx_deep_selected s ON s.task_id = t.task_id WHERE t.p > 1),
g AS (SELECT graph_id, p, max(b) FILTER (restart_id < 3) AS h1, max(b) FILTER (restart_id >= 3) AS h2, max(b) FILTER (restart_id < 4) AS b4, max(b) AS b6 FROM b GROUP BY 1, 2)
SELECT g.graph_id, g.p, abs(h1 - h2)/c_star AS half_gap, (b6 - b4)/c_star AS last_prefix_gain, greatest(abs(h1 - h2), b6 - b4)/c_star > 0.1 AS stability_flag
FROM g JOIN fx_cstar c ON c.graph_id = g.graph_id""", "half_gap last_prefix_gain"),
    Query("cmp14_reference_stability", _stability, f"""
WITH p AS (SELECT t.graph_id, t.restart_id, CASE WHEN NOT ({FAULT}) THEN s.best_seen END AS b FROM fx_tasks t LEFT JOIN fx_selected s ON s.task_id = t.task_id),
g AS (SELECT graph_id, max(b) FILTER (restart_id < 3) AS h1, max(b) FILTER (restart_id >= 3) AS h2, max(b) FILTER (restart_id < 4) AS b4, max(b) AS b6,
 max(b) FILTER (restart_id < 2) AS o FROM p GROUP BY 1)
SELECT g.graph_id, abs(h1 - h2)/c_star AS half_gap, (b6 - b4)/c_star AS last_prefix_gain, (b4 - o)/c_star AS union_gain_over_old,
 greatest(abs(h1 - h2), b6 - b4)/c_star > 0.1 AS stability_flag FROM g JOIN fx_cstar c ON c.graph_id = g.graph_id""", "half_gap last_prefix_gain union_gain_over_old"),
    Query("cmp16_learning_costs", _learning_costs, """
SELECT 'pool:' || role AS item, metric, CASE WHEN count(value) = count(*) THEN sum(value) END AS total, coalesce(sum(value), 0) AS known_subtotal, count(*) - count(value) AS unknown_count
FROM fx_terms WHERE metric IN ('objective_calls', 'elapsed_seconds') GROUP BY 1, 2
UNION ALL SELECT 'fit:' || n_nationkey%3, 'fit_seconds', CASE WHEN bool_and(n_nationkey <> 7) THEN sum(n_regionkey*1.5 + 1) END, sum(n_regionkey*1.5 + 1) FILTER (n_nationkey <> 7),
 count(*) FILTER (n_nationkey = 7) FROM nation GROUP BY 1""", "total known_subtotal"),
    Query("cmp17_batch_reports", _batches, """
WITH s AS (SELECT *, CASE WHEN graph_id%2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM fx_scored),
t AS (SELECT CASE WHEN graph_id%2 = 0 THEN 'even' ELSE 'odd' END AS batch, sum(value) AS elapsed_seconds FROM fx_terms WHERE metric = 'elapsed_seconds' GROUP BY 1)
SELECT s.batch, count(*) AS planned, count(*) FILTER (execution_valid) AS valid, count(*) FILTER (missing) AS missing,
 count(*) FILTER (terminal_success) AS known_successes, bool_and(coalesce(reference_complete, false)) AS reference_complete,
 max(t.elapsed_seconds) AS elapsed_seconds FROM s JOIN t ON t.batch = s.batch GROUP BY 1""", "elapsed_seconds"),
    Query("cmp17_bound_reports", _bound_reports, """
WITH s AS (SELECT *, CASE WHEN graph_id%2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM fx_scored),
t AS (SELECT CASE WHEN graph_id%2 = 0 THEN 'even' ELSE 'odd' END AS batch, sum(value) AS elapsed_seconds FROM fx_terms WHERE metric = 'elapsed_seconds' GROUP BY 1),
n AS (SELECT CASE WHEN graph_id%2 = 0 THEN 'even' ELSE 'odd' END AS batch, count(*) AS entries FROM (SELECT graph_id FROM fx_tasks UNION ALL SELECT graph_id FROM fx_selected
  UNION ALL SELECT graph_id FROM fx_refs UNION ALL SELECT DISTINCT graph_id FROM fx_scored) GROUP BY 1)
SELECT s.batch, count(*) AS planned, count(*) FILTER (execution_valid) AS valid, count(*) FILTER (missing) AS missing,
 count(*) FILTER (terminal_success) AS known_successes, bool_and(coalesce(reference_complete, false)) AS reference_complete,
 max(t.elapsed_seconds) AS elapsed_seconds, 5 AS artifacts, max(n.entries) AS entries FROM s JOIN t ON t.batch = s.batch JOIN n ON n.batch = s.batch GROUP BY 1""", "elapsed_seconds"),
    Query("cmp17_altered_artifact", _altered_artifact, """
SELECT 'odd' AS batch, a.artifact, CASE WHEN a.artifact = 'attempts' THEN 'changed' ELSE 'made_from' END AS problem, 'odd/attempts' AS cause, 'odd/attempts: changed' AS refused
FROM (VALUES ('attempts'), ('references'), ('report')) a(artifact) WHERE EXISTS (SELECT 1 FROM fx_selected WHERE graph_id%2 = 1)"""),
    Query("cmp18_follow_up_summary", _follow_up, f"""
WITH p AS (SELECT t.graph_id, t.restart_id, CASE WHEN NOT ({FAULT}) THEN s.best_seen END AS b FROM fx_tasks t LEFT JOIN fx_selected s ON s.task_id = t.task_id),
g AS (SELECT graph_id, max(b) FILTER (restart_id < 3) AS h1, max(b) FILTER (restart_id >= 3) AS h2, max(b) FILTER (restart_id < 4) AS b4, max(b) AS b6 FROM p GROUP BY 1),
f AS (SELECT count(*) AS graphs, count(*) FILTER (greatest(abs(h1 - h2), b6 - b4)/c_star > 0.1) AS flags FROM g JOIN fx_cstar c ON c.graph_id = g.graph_id)
SELECT f.graphs, f.flags, t.metric, {_TOTALS} FROM fx_terms t CROSS JOIN f WHERE metric IN ('objective_calls', 'elapsed_seconds', 'device_vjps') GROUP BY 1, 2, 3""", "total known_subtotal"),
]
_SUMMARIES += QUERIES
QUERIES += _interval_queries()
