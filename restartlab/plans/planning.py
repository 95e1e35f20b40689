"""Queries of the planning family."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from restartlab.functions.scores import content_id
from restartlab.operators import graphs as G, planning as L, synth as S
from restartlab.plans.fixtures import FIXTURE_SQL, Catalog
from restartlab.plans.graphs import edge_lists, sizes, types
from restartlab.plans.pools import cell_grid
from restartlab.plans.query import Query
from restartlab.plans.scoring import references
from restartlab.session import cut_lineage

METHODS = ("COBYLA", "COBYQA", "SPSA")
LEVELS = (256, 1024, 4096)


def capacities(cat: Catalog) -> DataFrame:
    return cat.graphs().groupBy("cell").agg(F.count(F.lit(1)).alias("capacity"))


def _members(cat: Catalog) -> DataFrame:
    return L.stratified_sample(cat.graphs(), 100, 7).select("graph_id", "cell")


def _splits(cat: Catalog) -> DataFrame:
    return L.assign_splits(cat.graphs(), 150, 90, 7).select("graph_id", "tier", "graph_split")


def _resplit(cat: Catalog) -> DataFrame:
    out = L.assign_splits(cat.graphs(), 150, 90, 42).select("graph_id", "tier", "graph_split")
    return out.groupBy("tier", "graph_split").agg(F.count(F.lit(1)).alias("graphs"), F.sum("graph_id").alias("id_sum"))


def _tasks(cat: Catalog) -> DataFrame:
    counts = {"tier1": 1, "reference": 3, "evaluation": 2, "gradient_diagnostic": 1}
    return L.expand_tasks(cat.graphs(), (1, 2), counts, "restartlab-v1", 20270003)


def _task_rows(cat: Catalog) -> DataFrame:
    t = _tasks(cat)
    return t.select("task_id", "graph_id", F.col("p").cast("bigint").alias("p"), "experiment_role", "kind", "method",
                    F.col("restart_id").cast("bigint").alias("restart_id"), "seed")


def _task_angles(cat: Catalog) -> DataFrame:
    return _tasks(cat).where("theta0 is not null").select("task_id", F.posexplode("theta0").alias("i", "angle")).select(
        "task_id", F.col("i").cast("bigint").alias("i"), "angle")


def _seed_guard(cat: Catalog) -> DataFrame:
    t = _tasks(cat)
    return t.agg(F.count(F.lit(1)).alias("tasks"), F.count_distinct("seed").alias("seeds"), F.count_distinct("task_id").alias("ids"))


def _warm(cat: Catalog) -> DataFrame:
    variants = F.array(*[F.struct(F.lit(p).cast("bigint").alias("p"), F.lit(v).alias("variant")) for p in (1, 2) for v in ("medoid", "aligned_median", "rule")])
    starts = cat.tasks().select("graph_id").distinct().select("graph_id", F.explode(variants).alias("v")).select("graph_id", "v.p", "v.variant")
    return L.warm_plan(starts, references(cat)).select("graph_id", "p", "variant", "bound")


def graph_references(cat: Catalog) -> DataFrame:
    """References of the study graphs at two depths; a quarter of them is incomplete."""
    lab = cat.labels().select("graph_id", F.col("successes").cast("double").alias("c_ref"), F.col("trials"))
    deep = lab.withColumn("p", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    return deep.select("graph_id", "p", (F.col("c_ref") + F.col("p")).alias("c_ref"), ((F.col("trials") + F.col("p")) % 4 != 0).alias("complete"))


def _learned_plan(cat: Catalog) -> DataFrame:
    """Warm starts from the stored angle models of the full group, one per evaluation graph and depth, bound to references of their depth."""
    from restartlab.plans.learning import angle_predictions

    told = L.learned_starts(angle_predictions(cat))
    return L.warm_plan(told, graph_references(cat)).select("graph_id", "p", "variant", "bound", F.col("reference_id").isNotNull().alias("has_reference"))


def _bound_freeze(cat: Catalog) -> DataFrame:
    refs = graph_references(cat).where("p = 2").drop("p")
    kinds = [r[0] for r in starts(cat).select("initialization").distinct().limit(20).collect()]
    return L.freeze_plan(starts(cat), refs, kinds).select("graph_id", "starts", "lacks", "reference_bound", "frozen", F.col("freeze_id").isNotNull().alias("has_id"))


def _transfer(cat: Catalog) -> DataFrame:
    base = cat.tasks().select("graph_id", F.concat_ws("-", "experiment_role", "restart_id").alias("spec"))
    warm = _warm(cat).select("graph_id", F.concat_ws("-", "variant", "p").alias("spec"))
    return L.equal_coverage(base.unionByName(warm), ["spec"])


def starts(cat: Catalog) -> DataFrame:
    return L.shot_starts(cat.graphs().where("graph_split = 'evaluation'"))


def _shot_plan(cat: Catalog, repetitions: int = 2) -> DataFrame:
    return L.shot_plan(starts(cat), repetitions, METHODS, LEVELS)


def _shot_rows(cat: Catalog) -> DataFrame:
    return _shot_plan(cat).select("graph_id", "initialization", "variant", F.col("repetition").cast("bigint").alias("repetition"),
                                  "method", "mode", "level", "task_id")


def _shot_schedule(cat: Catalog) -> DataFrame:
    """Sort key of the balanced schedule: repetition, condition turn, cell turn, cell."""
    turns = L.cell_turns(cat.graphs().where("graph_split = 'evaluation'")).select("graph_id", F.col("turn").alias("cell_turn"))
    plan = _shot_plan(cat).join(turns, "graph_id")
    return plan.groupBy(F.col("repetition").cast("bigint").alias("repetition"), F.col("turn").cast("bigint").alias("turn"), "cell").agg(
        F.count(F.lit(1)).alias("tasks"), F.max("cell_turn").alias("last_cell_turn"))


def _controls(cat: Catalog) -> DataFrame:
    """Sampled tasks per exact and fixed control, through the planned ids."""
    plan = _shot_plan(cat)
    ids = plan.select(F.col("task_id").alias("control_id"), F.col("repetition").cast("bigint").alias("control_repetition"))
    links = plan.select("initialization", "method", F.explode(F.array_compact(F.array(
        F.struct(F.lit("exact").alias("kind"), F.col("exact_control_task_id").alias("id")),
        F.struct(F.lit("fixed").alias("kind"), F.col("fixed_control_task_id").alias("id"))))).alias("c")).where("c.id is not null")
    return (links.select("initialization", "method", "c.kind", F.col("c.id").alias("control_id")).join(ids, "control_id", "left")
            .groupBy("initialization", "method", "kind", "control_repetition")
            .agg(F.count(F.lit(1)).alias("sampled"), F.count_distinct("control_id").alias("controls")))


def _seeds(cat: Catalog) -> DataFrame:
    """Role seeds: measurement and validation differ by level, the perturbation is shared across levels and modes."""
    plan = L.shot_plan(L.spread_starts(starts(cat)), 2, METHODS, LEVELS)
    return L.seed_counts(plan.where("method <> 'fixed'"))


def _budget(cat: Catalog) -> DataFrame:
    return L.shot_budget(starts(cat), 5, METHODS, LEVELS, 128, 8192)


def _budget_check(cat: Catalog) -> DataFrame:
    """Closed form and expanded plan must agree."""
    counted = _shot_plan(cat, 5).agg(F.count(F.lit(1)).alias("expanded"), F.count_if(F.col("method") == "fixed").alias("expanded_fixed"),
                                     F.count_if(F.col("mode") == "exact_control").alias("expanded_exact"))
    closed = _budget(cat).select("tasks", "fixed", "exact_control")
    one = F.lit(1).alias("k")
    return counted.withColumn("k", one).join(closed.withColumn("k", one), "k").drop("k")


def _freeze(cat: Catalog) -> DataFrame:
    """Frozen plan summary: graphs, starts by initialization, coverage, budget."""
    s = starts(cat)
    cover = s.groupBy("graph_id").agg(F.count_distinct("initialization").alias("kinds"), F.count(F.lit(1)).alias("starts"))
    return cover.agg(F.count(F.lit(1)).alias("graphs"), F.sum("starts").alias("starts"),
                     (F.min("kinds") == 3).alias("covered"), (F.sum("starts") * 5 * 3 * 3).alias("finite_tasks"))


def _replan(cat: Catalog) -> DataFrame:
    g = cat.graphs().where("graph_split = 'evaluation'")
    return L.top_per_cell(g, 4, 20261026, F.lit(True)).select("cell", "graph_id", F.col("rank").cast("bigint").alias("rank"))


def _topk(cat: Catalog) -> DataFrame:
    return L.top_per_cell(cat.graphs().where("graph_split <> 'training'"), 10, 20261026, F.col("graph_split") == "evaluation").select(
        "cell", "graph_id", F.col("rank").cast("bigint").alias("rank"))


def _study_plan(cat: Catalog) -> DataFrame:
    g = cat.graphs().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("graph_split") == "evaluation").alias("e"))
    rows = [("references", F.col("n") * (1 + 110 + 110)), ("b1", F.col("e") * 3 * 50), ("b2", F.col("e") * 3 * 2), ("b3", F.col("e") * 3),
            ("shots", F.col("e") * 3 * 5 * 11)]
    return g.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), v.alias("tasks")) for k, v in rows])).alias("r")).select("r.*")


def _reference_scope(cat: Catalog) -> DataFrame:
    """Requested reference-only graphs: accepted when tier-2 evaluation, otherwise rejected with the reason."""
    wanted = cat.table("supplier").select((F.col("s_suppkey") * 1000 + F.col("s_nationkey")).alias("graph_id"))
    j = wanted.join(cat.graphs().select("graph_id", "tier", "graph_split"), "graph_id", "left")
    status = (F.when(F.col("tier").isNull(), "unknown_graph").when((F.col("tier") == 2) & (F.col("graph_split") == "evaluation"), "accepted")
              .otherwise("not_an_evaluation_graph"))
    return j.select("graph_id", status.alias("status"))


def model_grid(families: DataFrame) -> DataFrame:
    """Model cases: (random + one per family) x feature group x depth x head, plus shuffle controls on random/F."""
    groups = F.array(*[F.struct(F.lit(g).alias("feature_group"), F.lit(s).cast("bigint").alias("shuffle_seed"))
                       for g, s in [("L", None), ("U", None), ("F", None), ("J+U", None), ("J+U+S", None)]])
    shuffles = F.array(*[F.struct(F.lit("F").alias("feature_group"), F.lit(s).cast("bigint").alias("shuffle_seed"))
                         for s in (20260922, 20260923, 20260924)])
    cases = families.select(F.lit("lofo").alias("regime"), F.col("family").alias("fold"), groups.alias("g")).unionByName(
        families.agg(F.count(F.lit(1))).select(F.lit("random").alias("regime"), F.lit(None).cast("string").alias("fold"), F.concat(groups, shuffles).alias("g")))
    return (cases.select("regime", "fold", F.explode("g").alias("g")).select("regime", "fold", "g.*", F.explode(F.array(F.lit(1), F.lit(2))).alias("p"))
            .select("*", F.explode(F.array(F.lit("angles"), F.lit("success"))).alias("head")).withColumn("p", F.col("p").cast("bigint")))


def _model_grid(cat: Catalog) -> DataFrame:
    return model_grid(cat.table("region").select(F.col("r_name").alias("family")))


def _boxes(cat: Catalog) -> DataFrame:
    rows = L.box_starts(cat.graphs().where("graph_split = 'evaluation'"), 3, 4, "box-v1")
    return (rows.select("graph_id", F.col("replica").cast("bigint").alias("replica"), "component", F.col("point_index").cast("bigint").alias("point_index"),
                        F.posexplode("theta0").alias("d", "angle")).withColumn("d", F.col("d").cast("bigint")))


def _study_selection(cat: Catalog) -> DataFrame:
    return L.select_study(cat.graphs(), 10, 20261026)


def _matched_quota(cat: Catalog) -> DataFrame:
    """Quota of every new-family cell, copied from the original cells of the same size."""
    original = cat.graphs().groupBy(F.col("m").alias("size")).agg(F.count(F.lit(1)).alias("quota"))
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("setting")) for a, b in
                                (("ws", "rewire-0.1"), ("ws", "rewire-0.5"), ("rgg", "target-degree-3"), ("rgg", "target-degree-5"))]))
    cells = cat.graphs().select(F.col("m").alias("size")).distinct().select("size", kinds.alias("k")).select("size", "k.*")
    return cells.join(original, "size").select(F.concat_ws(":", F.concat(F.lit("n"), "size"), "family", "setting").alias("cell"), "quota")


def _rule_table(cat: Catalog) -> DataFrame:
    lists = edge_lists(cat)
    hashes = G.topology_hash(lists).select("graph_id", "topology_hash")
    evaluation = cat.graphs().where("graph_split = 'evaluation'").select("graph_id")
    rows = G.rule_starts(types(cat), sizes(cat)).join(evaluation, "graph_id", "left_semi").join(hashes, "graph_id")
    return rows.select("graph_id", "p", "topology_hash", content_id("graph_id", "p", "topology_hash").alias("start_id"),
                       F.size("theta").cast("bigint").alias("angles"))


def _inherit(cat: Catalog) -> DataFrame:
    nation = cat.table("nation")
    key = F.col("n_nationkey").cast("bigint").alias("batch")
    parent = nation.select(key, F.create_map(F.lit("maxiter"), F.lit("80"), F.lit("ftol"), F.concat(F.lit("1e-"), F.col("n_regionkey").cast("string"))).alias("settings"))
    child = nation.select(key, F.when(F.col("n_nationkey") % 6 == 0, F.create_map(F.lit("maxiter"), F.lit("90"))).otherwise(
        F.create_map(F.lit("bootstrap"), F.lit("2000"))).alias("settings"))
    out = L.inherit_settings(parent, child, "batch")
    pairs = F.array_sort(F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select("batch", F.array_join(pairs, ";").alias("settings"), "overridden")


def _extension(cat: Catalog) -> DataFrame:
    return cell_grid(cat).select("cell", F.lit(40).cast("bigint").alias("quota"), F.lit(0).cast("bigint").alias("training"))


def _bundles(cat: Catalog) -> DataFrame:
    b = L.work_bundles(cat.tasks(), 4)
    return b.groupBy("graph_id").agg(F.sum(F.size("tasks")).alias("tasks"), F.min(F.element_at("tasks", 1)["task_id"]).alias("first_task"))


def synthetic_draws(cat: Catalog) -> DataFrame:
    """One draw per study graph: its id is the seed, its family picks the generator, its band the degree."""
    kinds = F.array(*map(F.lit, ("er", "sbm", "rgg", "regular", "ws", "ba")))
    pick = F.element_at(kinds, (F.col("graph_id") % 6 + 1).cast("int"))
    return cat.graphs().select("graph_id", F.col("graph_id").alias("seed"), "n", pick.alias("generator"), F.col("degree_band").alias("k"),
                               F.when(F.col("degree_band") == 3, 0.35).otherwise(0.5).alias("radius"), F.lit(0.3).alias("rewiring"),
                               F.concat_ws(":", F.lit("n12"), pick, F.col("degree_band").cast("string")).alias("cell")).withColumn(
        "k", F.when((F.col("generator") == "ws"), F.col("k") - 1 + F.col("k") % 2).otherwise(F.col("k")))


def _synthetic_log(cat: Catalog) -> DataFrame:
    return S.fill_quotas(cut_lineage(S.draw_graphs(synthetic_draws(cat))), 40)


def _pair_draws(cat: Catalog) -> DataFrame:
    """Edges of the three generators that decide pair by pair."""
    drawn = S.draw_graphs(synthetic_draws(cat).where("generator in ('er', 'sbm', 'rgg')"))
    return drawn.select("graph_id", "generator", F.explode("edges").alias("e")).select("graph_id", "generator", "e.u", "e.v")


def _synthetic_summary(cat: Catalog) -> DataFrame:
    """Log counts per cell; accepted plus shortfall is the quota."""
    log = _synthetic_log(cat)
    return log.groupBy("cell").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "accepted").alias("accepted"),
                                   F.count_if(F.col("status") == "duplicate").alias("duplicates"),
                                   F.count_if(F.col("status") == "rejected_disconnected").alias("rejected_disconnected"),
                                   F.count_if(F.col("status") == "generator_error").alias("generator_errors")).withColumn(
        "shortfall", F.lit(40) - F.col("accepted"))


FIXTURE_SQL["fx_alloc"] = """
SELECT cell, capacity, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, sha256('7:' || cell), cell) <= total - sum(base) OVER () THEN 1 ELSE 0 END AS allocated
FROM (SELECT *, total*capacity//size AS base, total*capacity%size AS rem FROM (
  SELECT cell, capacity, size, least(100, size) AS total FROM (SELECT cell, count(*) AS capacity, CAST(sum(count(*)) OVER () AS BIGINT) AS size FROM fx_graphs GROUP BY 1)))"""


def _split_sql(seed: int) -> str:
    """Two passes of largest remainder and seeded ranks."""
    def alloc(source: str, total: str, s: int) -> str:
        return f"""SELECT cell, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, sha256('{s}:' || cell), cell) <= total - sum(base) OVER () THEN 1 ELSE 0 END AS q
  FROM (SELECT *, total*capacity//size AS base, total*capacity%size AS rem FROM (SELECT *, least({total}, size) AS total FROM
   (SELECT cell, count(*) AS capacity, CAST(sum(count(*)) OVER () AS BIGINT) AS size FROM {source} GROUP BY 1)))"""
    def pick(source: str, quota: str, s: int) -> str:
        return f"""SELECT graph_id, s.cell FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sha256('member-{s}:' || graph_id)) AS k FROM {source}) s
  JOIN {quota} q ON q.cell = s.cell WHERE k <= q"""
    return f"""qa AS ({alloc('fx_graphs', '150', seed)}), t2 AS ({pick('fx_graphs', 'qa', seed)}),
qb AS ({alloc('t2', '(2*size*90 + 150)//300', seed + 1)}), tr AS ({pick('t2', 'qb', seed + 1)}),
sp AS (SELECT g.graph_id, CASE WHEN t2.graph_id IS NULL THEN 1 ELSE 2 END AS tier,
  CASE WHEN t2.graph_id IS NULL THEN 'not_applicable' WHEN tr.graph_id IS NULL THEN 'evaluation' ELSE 'training' END AS graph_split
  FROM fx_graphs g LEFT JOIN t2 ON t2.graph_id = g.graph_id LEFT JOIN tr ON tr.graph_id = g.graph_id)"""


FIXTURE_SQL["fx_plan"] = """
SELECT *, substr(sha256('{"experiment_role":"' || experiment_role || '","graph_id":' || graph_id || ',"master_seed":20270003,"namespace":"restartlab-v1","p":' || p || ',"restart_id":' || restart_id || '}'), 1, 32) AS seed
FROM (SELECT g.graph_id, p.p, r.role AS experiment_role, k.k AS restart_id,
        CASE WHEN r.role = 'reference' AND p.p = 1 THEN 'p1_grid' WHEN r.role = 'gradient_diagnostic' THEN 'gradient' ELSE 'optimization' END AS kind
      FROM fx_graphs g CROSS JOIN range(1, 3) p(p) CROSS JOIN (VALUES ('tier1', 1), ('reference', 3), ('evaluation', 2), ('gradient_diagnostic', 1)) r(role, c)
      CROSS JOIN range(3) k(k) WHERE k.k < CASE WHEN r.role = 'reference' AND p.p = 1 THEN 1 ELSE r.c END AND (g.tier = 2 OR r.role = 'tier1'))"""
FIXTURE_SQL["fx_planned"] = """
SELECT *, sha256('{"experiment_role":"' || experiment_role || '","graph_id":' || graph_id || ',"p":' || p || ',"restart_id":' || restart_id || ',"seed":"' || seed || '"}') AS task_id,
  CASE kind WHEN 'p1_grid' THEN 'analytic_grid' WHEN 'gradient' THEN 'uniform' ELSE 'B1' END AS method FROM fx_plan"""
FIXTURE_SQL["fx_starts"] = """
SELECT g.graph_id, g.cell, k.i AS initialization, k.v AS variant, sha256(g.graph_id || '|' || k.i || '|' || k.v) AS start_id
FROM fx_graphs g CROSS JOIN (VALUES ('B1', 'random'), ('B2', 'medoid'), ('B2', 'aligned_median'), ('B3', 'rule')) k(i, v) WHERE g.graph_split = 'evaluation'"""
FIXTURE_SQL["fx_shotplan"] = """
SELECT *, sha256(start_id || '|' || repetition || '|' || method || '|' || mode || '|' || coalesce(level::VARCHAR, '-')) AS task_id FROM (
  SELECT s.*, r.r AS repetition, m.m AS method, 'exact_control' AS mode, NULL::BIGINT AS level FROM fx_starts s CROSS JOIN range(2) r(r)
    CROSS JOIN (VALUES ('COBYLA'), ('COBYQA'), ('SPSA')) m(m) WHERE initialization = 'B1' OR m.m = 'SPSA' OR r.r = 0
  UNION ALL SELECT s.*, r.r, m.m, 'finite_shots', l.l FROM fx_starts s CROSS JOIN range(2) r(r) CROSS JOIN (VALUES ('COBYLA'), ('COBYQA'), ('SPSA')) m(m)
    CROSS JOIN (VALUES (256), (1024), (4096)) l(l)
  UNION ALL SELECT s.*, 0, 'fixed', 'finite_shots', NULL FROM fx_starts s WHERE initialization <> 'B1')"""

_UNIT = "('0x' || substr(sha256({}), 1, 13))::BIGINT/4503599627370496.0::DOUBLE"

QUERIES = [
    Query("win11_largest_remainder", lambda c: L.allocate_counts(capacities(c), 100, 7),
          "SELECT cell, capacity, CAST(allocated AS BIGINT) AS allocated FROM fx_alloc"),
    Query("win6_stratified_sample", _members, """
SELECT graph_id, g.cell FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sha256('member-7:' || graph_id)) AS k FROM fx_graphs) g
JOIN fx_alloc a ON a.cell = g.cell WHERE k <= allocated"""),
    Query("pln10_split_assignment", _splits, f"WITH {_split_sql(7)} SELECT * FROM sp"),
    Query("pln11_resplit", _resplit, f"WITH {_split_sql(42)} SELECT tier, graph_split, count(*) AS graphs, CAST(sum(graph_id) AS BIGINT) AS id_sum FROM sp GROUP BY 1, 2"),
    Query("pln1_base_task_plan", _task_rows,
          "SELECT task_id, graph_id, p, experiment_role, kind, method, restart_id, seed FROM fx_planned"),
    Query("pln1_seed_guard", _seed_guard, "SELECT count(*) AS tasks, count(DISTINCT seed) AS seeds, count(DISTINCT task_id) AS ids FROM fx_planned"),
    Query("pln12_random_starts", _task_angles, """
SELECT task_id, r.i, ('0x' || substr(sha256(seed || ':' || r.i), 1, 13))::BIGINT/4503599627370496.0::DOUBLE*CASE WHEN r.i < p THEN 2*pi() ELSE pi() END AS angle
FROM fx_planned CROSS JOIN range(4) r(i) WHERE r.i < 2*p AND kind <> 'p1_grid'""", "angle"),
    Query("pln2_warm_plan", _warm, """
SELECT u.graph_id, p.p, v.v AS variant, r.complete AS bound FROM (SELECT DISTINCT graph_id FROM fx_tasks) u CROSS JOIN range(1, 3) p(p)
CROSS JOIN (VALUES ('medoid'), ('aligned_median'), ('rule')) v(v) JOIN fx_refs r ON r.graph_id = u.graph_id"""),
    Query("pln2_learned_plan", _learned_plan, """
SELECT g.graph_id, p.p, 'learned' AS variant, (l.trials + p.p)%4 <> 0 AS bound, (l.trials + p.p)%4 <> 0 AS has_reference
FROM fx_graphs g JOIN fx_labels l ON l.graph_id = g.graph_id CROSS JOIN range(1, 3) p(p) WHERE g.tier = 2 AND g.graph_split = 'evaluation'"""),
    Query("pln5_bound_freeze", _bound_freeze, """
SELECT s.graph_id, count(*) AS starts, '' AS lacks, (max(l.trials) + 2)%4 <> 0 AS reference_bound, (max(l.trials) + 2)%4 <> 0 AS frozen, (max(l.trials) + 2)%4 <> 0 AS has_id
FROM fx_starts s JOIN fx_labels l ON l.graph_id = s.graph_id GROUP BY 1"""),
    Query("pln3_transfer_plan", _transfer, """
SELECT count(DISTINCT graph_id) AS graphs, 12 AS min_specs, 12 AS max_specs, count(DISTINCT graph_id)*12 AS tasks, true AS equal FROM fx_tasks"""),
    Query("pln4_shot_plan", _shot_rows, "SELECT graph_id, initialization, variant, repetition, method, mode, level, task_id FROM fx_shotplan"),
    Query("win7_round_robin_schedule", _shot_schedule, """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY start_id, repetition ORDER BY CASE method WHEN 'COBYLA' THEN 0 WHEN 'COBYQA' THEN 1 WHEN 'SPSA' THEN 2 ELSE 3 END,
   mode, level) - 1 AS turn FROM fx_shotplan),
g AS (SELECT graph_id, row_number() OVER (PARTITION BY cell ORDER BY graph_id) AS cell_turn FROM fx_graphs WHERE graph_split = 'evaluation')
SELECT repetition, turn, cell, count(*) AS tasks, max(cell_turn) AS last_cell_turn FROM o JOIN g ON g.graph_id = o.graph_id GROUP BY 1, 2, 3"""),
    Query("jn13_control_linkage", _controls, """
SELECT initialization, method, 'exact' AS kind, CASE WHEN initialization <> 'B1' AND method <> 'SPSA' THEN 0 ELSE repetition END AS control_repetition,
  count(*) AS sampled, count(DISTINCT start_id) AS controls FROM fx_shotplan WHERE mode = 'finite_shots' AND method <> 'fixed' GROUP BY 1, 2, 4
UNION ALL SELECT initialization, method, 'fixed', 0, count(*), count(DISTINCT start_id) FROM fx_shotplan
WHERE mode = 'finite_shots' AND method <> 'fixed' AND initialization <> 'B1' GROUP BY 1, 2"""),
    Query("pln20_role_seeds", _seeds, """
SELECT method, count(*) AS tasks, count(*) AS measurement, count(*) AS validation, count(DISTINCT start_id || '|' || repetition) AS perturbation
FROM fx_shotplan WHERE method <> 'fixed' GROUP BY 1"""),
    Query("agg22_budget_totals", _budget, """
SELECT *, fixed + finite_shots + exact_control AS tasks, (fixed + finite_shots + exact_control)*8192 AS validation_shots_cap FROM (
 SELECT count(*) AS starts, count(*) FILTER (initialization <> 'B1') AS warm, count(*) FILTER (initialization <> 'B1') AS fixed, count(*)*45 AS finite_shots,
  count(*)*15 - count(*) FILTER (initialization <> 'B1')*8 AS exact_control, count(*)*15*5376*128 AS optimization_shots_cap FROM fx_starts)"""),
    Query("agg22_budget_equals_plan", _budget_check, """
SELECT t AS tasks, w AS fixed, e AS exact_control, t AS expanded, w AS expanded_fixed, e AS expanded_exact FROM (
 SELECT w, n*15 - w*8 AS e, w + n*45 + n*15 - w*8 AS t FROM (SELECT count(*) AS n, count(*) FILTER (initialization <> 'B1') AS w FROM fx_starts))"""),
    Query("pln5_plan_freeze", _freeze, """
SELECT count(DISTINCT graph_id) AS graphs, count(*) AS starts, true AS covered, count(*)*45 AS finite_tasks FROM fx_starts"""),
    Query("pln6_replan_subset", _replan, """
SELECT cell, graph_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sha256('20261026:' || cell || ':' || graph_id)) AS rank
 FROM fx_graphs WHERE graph_split = 'evaluation') WHERE rank <= 4"""),
    Query("win5_top_k_per_cell", _topk, """
SELECT cell, graph_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN graph_split = 'evaluation' THEN 0 ELSE 1 END,
  sha256('20261026:' || cell || ':' || graph_id)) AS rank FROM fx_graphs WHERE graph_split <> 'training') WHERE rank <= 10"""),
    Query("pln7_study_plan", _study_plan, """
WITH k AS (SELECT count(*) AS n, count(*) FILTER (graph_split = 'evaluation') AS e FROM fx_graphs)
SELECT 'references' AS stage, n*221 AS tasks FROM k UNION ALL SELECT 'b1', e*150 FROM k UNION ALL SELECT 'b2', e*6 FROM k
UNION ALL SELECT 'b3', e*3 FROM k UNION ALL SELECT 'shots', e*165 FROM k"""),
    Query("pln8_reference_scope", _reference_scope, """
SELECT s_suppkey*1000 + s_nationkey AS graph_id, CASE WHEN g.graph_id IS NULL THEN 'unknown_graph' WHEN tier = 2 AND graph_split = 'evaluation' THEN 'accepted'
 ELSE 'not_an_evaluation_graph' END AS status FROM supplier LEFT JOIN fx_graphs g ON g.graph_id = s_suppkey*1000 + s_nationkey"""),
    Query("pln9_model_grid", _model_grid, """
SELECT regime, fold, g AS feature_group, s AS shuffle_seed, p.p, h.h AS head FROM (
  SELECT 'lofo' AS regime, r_name AS fold, g.g, NULL::BIGINT AS s FROM region CROSS JOIN (VALUES ('L'), ('U'), ('F'), ('J+U'), ('J+U+S')) g(g)
  UNION ALL SELECT 'random', NULL, g, s FROM (VALUES ('L', NULL), ('U', NULL), ('F', NULL), ('J+U', NULL), ('J+U+S', NULL), ('F', 20260922), ('F', 20260923), ('F', 20260924)) g(g, s))
CROSS JOIN range(1, 3) p(p) CROSS JOIN (VALUES ('angles'), ('success')) h(h)"""),
    Query("pln13_box_starts", _boxes, """
SELECT graph_id, replica, component, point_index, d, (x - floor(x))*pi()*CASE WHEN d < 3 THEN g ELSE b END AS angle FROM (
 SELECT e.graph_id, r.r AS replica, c.c AS component, i.i AS point_index, d.d, c.g, c.b,
  ('0x' || substr(sha256('box-v1:' || e.graph_id || ':' || r.r || ':' || c.c || ':' || d.d), 1, 13))::BIGINT/4503599627370496.0::DOUBLE
   + (i.i + 1)*pow(1/1.1127756842787055::DOUBLE, d.d + 1) AS x
 FROM fx_graphs e CROSS JOIN range(2) r(r) CROSS JOIN (VALUES ('global', 2.0, 0.5), ('low_angle', 0.5, 0.25)) c(c, g, b) CROSS JOIN range(4) i(i) CROSS JOIN range(6) d(d)
 WHERE e.graph_split = 'evaluation')""", "angle"),
    Query("pln14_study_selection", _study_selection, """
SELECT graph_id, cell, 'training' AS role, false AS promoted FROM fx_graphs WHERE graph_split = 'training'
UNION ALL SELECT graph_id, cell, 'evaluation', tier = 1 FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN graph_split = 'evaluation' THEN 0 ELSE 1 END,
  sha256('20261026:' || cell || ':' || graph_id)) AS k FROM fx_graphs WHERE graph_split <> 'training') WHERE k <= 10"""),
    Query("pln14_cell_shortfalls", lambda c: L.cell_shortfalls(c.graphs(), 400), """
SELECT cell, count(*) AS available, 400 - count(*) AS needed FROM fx_graphs GROUP BY 1 HAVING count(*) < 400"""),
    Query("pln15_matched_quota", _matched_quota, """
SELECT 'n' || m || ':' || f || ':' || s AS cell, count(*) AS quota FROM fx_graphs CROSS JOIN (VALUES ('ws', 'rewire-0.1'), ('ws', 'rewire-0.5'),
 ('rgg', 'target-degree-3'), ('rgg', 'target-degree-5')) k(f, s) GROUP BY m, f, s"""),
    Query("pln16_synthetic_graphs", _synthetic_log),
    Query("pln16_pairwise_draws", _pair_draws, f"""
WITH d AS (SELECT graph_id, graph_id%6 AS g, degree_band AS k, CASE WHEN degree_band = 3 THEN 0.35 ELSE 0.5 END AS radius FROM fx_graphs WHERE graph_id%6 < 3),
pt AS (SELECT graph_id, i.i, {_UNIT.format("graph_id || ':x:' || i.i")} AS x, {_UNIT.format("graph_id || ':y:' || i.i")} AS y FROM d CROSS JOIN range(12) i(i) WHERE g = 2),
pr AS (SELECT d.*, u.u, v.v FROM d CROSS JOIN range(12) u(u) CROSS JOIN range(12) v(v) WHERE u.u < v.v)
SELECT graph_id, 'er' AS generator, u, v FROM pr WHERE g = 0 AND {_UNIT.format("graph_id || ':er:' || u || ':' || v")} < k/11.0::DOUBLE
UNION ALL SELECT graph_id, 'sbm', u, v FROM pr WHERE g = 1 AND {_UNIT.format("graph_id || ':sbm:' || u || ':' || v")} < k/21.0::DOUBLE*CASE WHEN (u < 6) = (v < 6) THEN 3 ELSE 1 END
UNION ALL SELECT pr.graph_id, 'rgg', u, v FROM pr JOIN pt a ON a.graph_id = pr.graph_id AND a.i = u JOIN pt b ON b.graph_id = pr.graph_id AND b.i = v
WHERE g = 2 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < radius"""),
    Query("pln16_generation_summary", _synthetic_summary),
    Query("pln17_rule_start_table", _rule_table, """
WITH h AS (SELECT graph_id, sha256('12|' || string_agg(u || '-' || v, ',' ORDER BY u, v)) AS topology_hash FROM fx_edges GROUP BY 1)
SELECT g.graph_id, p.p, h.topology_hash, sha256('{"graph_id":' || g.graph_id || ',"p":' || p.p || ',"topology_hash":"' || h.topology_hash || '"}') AS start_id, 2*p.p AS angles
FROM fx_graphs g JOIN h ON h.graph_id = g.graph_id CROSS JOIN range(1, 6) p(p) WHERE g.graph_split = 'evaluation'"""),
    Query("pln18_inherit_settings", _inherit, """
SELECT n_nationkey AS batch, CASE WHEN n_nationkey%6 <> 0 THEN 'bootstrap=2000;ftol=1e-' || n_regionkey || ';maxiter=80' END AS settings,
 CASE WHEN n_nationkey%6 = 0 THEN 'maxiter' ELSE '' END AS overridden FROM nation"""),
    Query("pln19_extension_quota", _extension, """
SELECT concat('n12:', r_name, ':k', b) AS cell, 40 AS quota, 0 AS training FROM region CROSS JOIN (VALUES (3), (5)) v(b)"""),
    Query("pln21_work_bundles", _bundles, "SELECT graph_id, count(*) AS tasks, min(task_id) AS first_task FROM fx_tasks GROUP BY 1"),
]
