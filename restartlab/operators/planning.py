"""Plans: stratified splits, task expansion, budgets and start points.

Every expansion explodes arrays inside its own row, so plans need no cross join,
and every id, seed and random choice is a hash of its key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from restartlab.functions.ranks import bucketed_row_number
from restartlab.functions.scores import finite, content_id, seed_rank, unit_uniform
from restartlab.session import cut_lineage


def allocate_counts(capacities: DataFrame, total: int | Callable[[Column], Column], seed: int) -> DataFrame:
    """Largest-remainder share of ``total`` over cells (cell, capacity); seeded ranks break equal remainders.

    ``total`` may be a function of the summed capacity. Only the cell table,
    which the design fixes, meets in a window.
    """
    whole = W.partitionBy(F.lit(1))
    size = F.sum("capacity").over(whole)
    wanted = F.lit(total) if isinstance(total, int) else total(size)
    c = capacities.withColumn("size", size).withColumn("total", F.least(wanted, F.col("size")).cast("bigint"))
    c = c.withColumns({"base": F.floor(F.col("total") * F.col("capacity") / F.col("size")).cast("bigint"),
                       "remainder": F.col("total") * F.col("capacity") % F.col("size")})
    leftover = F.col("total") - F.sum("base").over(whole)
    rank = F.row_number().over(whole.orderBy(F.col("remainder").desc(), seed_rank(F.lit(str(seed)), "cell"), "cell"))
    return (c.withColumns({"leftover": leftover, "rank": rank})
            .select("cell", "capacity", (F.col("base") + (F.col("rank") <= F.col("leftover")).cast("bigint")).alias("allocated")))


def stratified_sample(records: DataFrame, total: int | Callable[[Column], Column], seed: int) -> DataFrame:
    """Seeded random members of each cell up to its allocation; a huge cell is ranked hash bucket by hash bucket."""
    cells = records.groupBy("cell").agg(F.count(F.lit(1)).alias("capacity"))
    quota = allocate_counts(cells, total, seed).select("cell", "allocated")
    order = seed_rank(F.lit(f"member-{seed}"), F.col("graph_id").cast("string"))
    ranked = bucketed_row_number(records.withColumn("__order", order), ["cell"], F.substring("__order", 1, 3),
                                 [F.col("__order")], "__rank")
    return ranked.join(quota, "cell").where(F.col("__rank") <= F.col("allocated")).drop("__order", "__rank", "allocated")


def assign_splits(records: DataFrame, tier2: int, training: int, seed: int) -> DataFrame:
    """Tier 2 by cell, then training inside it; a tier-2 shortfall keeps the requested ratio."""
    plain = records.drop("tier", "graph_split")
    # read three more times below
    second = cut_lineage(stratified_sample(plain, tier2, seed).select("graph_id", "cell"))
    train = stratified_sample(second, lambda size: F.floor((2 * size * training + tier2) / (2 * tier2)), seed + 1)
    marks = second.select("graph_id", F.lit(2).cast("bigint").alias("tier")).join(
        train.select("graph_id", F.lit("training").alias("graph_split")), "graph_id", "left")
    return plain.join(marks, "graph_id", "left").withColumns({
        "graph_split": F.when(F.col("tier").isNull(), "not_applicable").otherwise(F.coalesce("graph_split", F.lit("evaluation"))),
        "tier": F.coalesce("tier", F.lit(1).cast("bigint"))})


def split_selection(graphs: DataFrame, folds: Sequence[str]) -> DataFrame:
    """Tier-2 graphs of every (regime, fold, split).

    Leave-one-family-out drops multi-family graphs on both sides, trains on the
    other families and evaluates on the held-out one.
    """
    base = graphs.where((F.col("tier") == 2) & F.col("graph_split").isin("training", "evaluation"))
    names = F.array(*map(F.lit, folds))
    own = F.filter(names, lambda f: f == F.col("family"))
    others = F.filter(names, lambda f: f != F.col("family"))
    scopes = F.when(F.col("graph_split") == "evaluation", own).otherwise(others)
    random = base.select("graph_id", F.lit("random").alias("regime"), F.lit(None).cast("string").alias("fold"), "graph_split")
    lofo = base.where("family_count = 1").select("graph_id", F.lit("lofo").alias("regime"), F.explode(scopes).alias("fold"), "graph_split")
    return random.unionByName(lofo)


def random_theta(p: Column, *seed: Column | str) -> Column:
    """2p start angles: gamma in [0, 2 pi), beta in [0, pi)."""
    steps = F.sequence(F.lit(0), (2 * p - 1).cast("int"))
    return F.transform(steps, lambda i: unit_uniform(*seed, i.cast("string")) * F.when(i < p, 2 * F.pi()).otherwise(F.pi()))


def expand_tasks(graphs: DataFrame, depths: Sequence[int], counts: dict[str, int], namespace: str, master_seed: int) -> DataFrame:
    """Graph x depth x role x restart with content ids, 128-bit seeds as hex text and start angles.

    Tier-1 graphs only take the tier1 role; depth one has a single reference grid task.
    """
    roles = []
    for role, k in counts.items():
        n = F.when((F.col("p") == 1), F.lit(1)).otherwise(F.lit(k)) if role == "reference" else F.lit(k)
        kind = (F.when(F.col("p") == 1, "p1_grid").otherwise("optimization") if role == "reference"
                else F.lit("gradient" if role == "gradient_diagnostic" else "optimization"))
        roles.append(F.struct(F.lit(role).alias("role"), n.alias("k"), kind.alias("kind"),
                              ((F.col("tier") == 2) | F.lit(role == "tier1")).alias("on")))
    rows = (graphs.select("graph_id", "tier", "graph_split", F.explode(F.array(*map(F.lit, depths))).alias("p"))
            .select("*", F.explode(F.filter(F.array(*roles), lambda r: r["on"])).alias("r"))
            .select("graph_id", "graph_split", "p", F.col("r.role").alias("experiment_role"), F.col("r.kind").alias("kind"),
                    F.explode(F.sequence(F.lit(0), F.col("r.k") - 1)).alias("restart_id")))
    stream = content_id("experiment_role", "graph_id", F.lit(master_seed).alias("master_seed"), F.lit(namespace).alias("namespace"),
                        "p", "restart_id")
    rows = rows.withColumn("seed", F.substring(stream, 1, 32))
    theta = F.when(F.col("kind") != "p1_grid", random_theta(F.col("p"), F.col("seed")))
    method = F.when(F.col("kind") == "p1_grid", "analytic_grid").when(F.col("kind") == "gradient", "uniform").otherwise("B1")
    return rows.withColumns({"method": method, "theta0": theta,
                             "task_id": content_id("experiment_role", "graph_id", "p", "restart_id", "seed")})


def warm_plan(starts: DataFrame, references: DataFrame) -> DataFrame:
    """One task per start, bound to its frozen reference; a start without complete reference is not bound.

    References that name a depth are bound at their depth only.
    """
    keys = ["graph_id", "p"] if "p" in references.columns else ["graph_id"]
    refs = references.select(*keys, content_id("c_ref", *keys).alias("reference_id"), "complete")
    rows = starts.join(refs, keys, "left")
    ready = F.coalesce(F.col("complete"), F.lit(False))
    return rows.withColumns({"bound": ready, "reference_id": F.when(ready, F.col("reference_id"))}).withColumn(
        "task_id", content_id("graph_id", "p", "reference_id", "variant")).drop("complete")


def learned_starts(predictions: DataFrame) -> DataFrame:
    """graph_id, p, variant, theta0 of predicted angles (graph_id, p, theta); predictions that are not finite or of another depth start nothing."""
    good = (F.size("theta") == 2 * F.col("p")) & F.forall("theta", finite)
    return predictions.where(F.coalesce(good, F.lit(False))).select("graph_id", "p", F.lit("learned").alias("variant"), F.col("theta").alias("theta0"))


def freeze_plan(starts: DataFrame, references: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row per graph of a plan: its starts, which kinds it lacks, its reference, and the id that all of it is frozen under.

    A graph is frozen only with a complete reference and every kind of start; the
    id is a digest of the reference and of all start ids, so either cannot change unseen.
    """
    per = starts.groupBy("graph_id").agg(F.count(F.lit(1)).alias("starts"), F.collect_set("initialization").alias("has"), F.array_sort(F.collect_list("start_id")).alias("ids"))
    refs = references.select("graph_id", content_id("c_ref", "graph_id").alias("reference_id"), F.col("complete").alias("reference_bound"))
    j = per.join(refs, "graph_id", "left").withColumn("reference_bound", F.coalesce("reference_bound", F.lit(False)))
    lacks = F.array_sort(F.array_except(F.array(*map(F.lit, kinds)), F.col("has")))
    ok = F.col("reference_bound") & (F.size(lacks) == 0)
    return j.select("graph_id", "starts", F.array_join(lacks, ",").alias("lacks"), "reference_bound", ok.alias("frozen"),
                    F.when(ok, F.sha2(F.concat_ws("|", F.col("reference_id"), F.concat_ws(",", F.col("ids").cast("array<string>"))), 256)).alias("freeze_id"))


def equal_coverage(tasks: DataFrame, spec: Sequence[str]) -> DataFrame:
    """Distinct conditions per graph, and whether every graph has the same number."""
    per = tasks.groupBy("graph_id").agg(F.count_distinct(*spec).alias("specs"), F.count(F.lit(1)).alias("tasks"))
    return per.agg(F.count(F.lit(1)).alias("graphs"), F.min("specs").alias("min_specs"), F.max("specs").alias("max_specs"),
                   F.sum("tasks").alias("tasks"), (F.min("specs") == F.max("specs")).alias("equal"))


def shot_starts(graphs: DataFrame) -> DataFrame:
    """Random, two fixed and one rule start per evaluation graph."""
    kinds = F.array(*[F.struct(F.lit(a).alias("initialization"), F.lit(b).alias("variant")) for a, b in
                      (("B1", "random"), ("B2", "medoid"), ("B2", "aligned_median"), ("B3", "rule"))])
    rows = graphs.select("graph_id", "cell", F.explode(kinds).alias("k")).select("graph_id", "cell", "k.initialization", "k.variant")
    return rows.withColumn("start_id", F.sha2(F.concat_ws("|", F.col("graph_id"), "initialization", "variant"), 256))


def _shot_key(start: Column, repetition: Column, method: Column, mode: Column, level: Column) -> Column:
    return F.concat_ws("|", start, repetition.cast("string"), method, mode, F.coalesce(level.cast("string"), F.lit("-")))


def shot_plan(starts: DataFrame, repetitions: int, methods: Sequence[str], levels: Sequence[int],
              modes: Sequence[str] = ("finite_shots", "exact_control"), compact: bool = True) -> DataFrame:
    """Start x repetition x method x mode x level, with control links and role seeds.

    Exact controls: all repetitions unless compact, then only for random starts,
    SPSA, or repetition 0. Fixed controls: warm starts, repetition 0 when compact.
    """
    rep, warm = F.col("repetition"), F.col("initialization") != "B1"

    def condition(method: str, mode: str, level: int | None, keep: Column) -> Column:
        return F.struct(F.lit(method).alias("method"), F.lit(mode).alias("mode"), F.lit(level).cast("bigint").alias("level"),
                        keep.alias("keep"))

    items = []
    for method in methods:
        shared = F.lit(not compact) | ~warm | F.lit(method == "SPSA") | (rep == 0)
        if "exact_control" in modes:
            items.append(condition(method, "exact_control", None, shared))
        if "finite_shots" in modes:
            items += [condition(method, "finite_shots", level, F.lit(True)) for level in levels]
    items.append(condition("fixed", "finite_shots", None, warm & (F.lit(not compact) | (rep == 0))))
    kept = F.filter(F.array(*items), lambda c: c["keep"])
    rows = (starts.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
            .select("*", F.posexplode(kept).alias("turn", "c"))
            .select(*starts.columns, "repetition", "turn", F.col("c.method").alias("method"), F.col("c.mode").alias("mode"),
                    F.col("c.level").alias("level")))
    sampled = (F.col("mode") == "finite_shots") & (F.col("method") != "fixed")
    control_rep = F.when(F.lit(compact) & warm & (F.col("method") != "SPSA"), F.lit(0)).otherwise(rep)
    fixed_rep = F.lit(0) if compact else rep
    start, none = F.col("start_id"), F.lit(None).cast("bigint")
    key = _shot_key(start, rep, F.col("method"), F.col("mode"), F.col("level"))
    exact = _shot_key(start, control_rep, F.col("method"), F.lit("exact_control"), none)
    fixed = _shot_key(start, fixed_rep, F.lit("fixed"), F.lit("finite_shots"), none)
    return rows.withColumns({
        "task_id": F.sha2(key, 256),
        "exact_control_task_id": F.when(sampled & F.lit("exact_control" in modes), F.sha2(exact, 256)),
        "fixed_control_task_id": F.when(sampled & warm, F.sha2(fixed, 256)),
        "measurement_seed": F.substring(F.sha2(F.concat_ws("|", key, F.lit("measurement")), 256), 1, 32),
        "validation_seed": F.substring(F.sha2(F.concat_ws("|", key, F.lit("validation")), 256), 1, 32),
        "perturbation_seed": F.substring(F.sha2(F.concat_ws("|", start, rep.cast("string"), F.col("method"), F.lit("perturbation")), 256), 1, 32)})


def spread_starts(starts: DataFrame, share: int = 20_000) -> DataFrame:
    """Starts in parts of about ``share``: few bytes, but each becomes dozens of tasks, so bytes alone would put too many into one part."""
    stored = cut_lineage(starts)
    return stored.repartition(stored.count() // share + 1)


def seed_counts(plan: DataFrame) -> DataFrame:
    """Per method: tasks, and different seeds of every role; a seed is one short binary row, grouped once for all roles."""
    roles = ("measurement", "validation", "perturbation")
    seeds = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("role"), F.unhex(f"{role}_seed").alias("seed")) for i, role in enumerate(roles)])
    different = plan.select("method", F.explode(seeds).alias("s")).groupBy("method", "s.role", "s.seed").agg(F.count(F.lit(1)).alias("uses"))
    return different.groupBy("method").agg(F.sum(F.when(F.col("role") == 0, F.col("uses"))).alias("tasks"),
                                           *[F.count_if((F.col("role") == i) & F.col("seed").isNotNull()).alias(role) for i, role in enumerate(roles)])


def shot_budget(starts: DataFrame, repetitions: int, methods: Sequence[str], levels: Sequence[int], query_cap: int,
                validation_shots: int, compact: bool = True) -> DataFrame:
    """Task and shot caps in closed form, from start counts alone."""
    n, w = F.col("starts"), F.col("warm")
    exact = n * repetitions * len(methods)
    if compact:
        exact = exact - w * ((repetitions - 1) * sum(m != "SPSA" for m in methods))
    agg = starts.agg(F.count(F.lit(1)).alias("starts"), F.count_if(F.col("initialization") != "B1").alias("warm")).withColumns({
        "fixed": w * (1 if compact else repetitions), "finite_shots": n * (repetitions * len(methods) * len(levels)),
        "exact_control": exact, "optimization_shots_cap": n * (repetitions * len(methods) * sum(levels) * query_cap)})
    total = F.col("fixed") + F.col("finite_shots") + F.col("exact_control")
    return agg.withColumns({"tasks": total, "validation_shots_cap": total * validation_shots})


def cell_turns(graphs: DataFrame) -> DataFrame:
    """Round-robin turn of every graph inside its cell, for early coverage of all cells."""
    return bucketed_row_number(graphs.select("graph_id", "cell"), ["cell"], F.floor(F.col("graph_id") / 1000),
                               [F.col("graph_id")], "turn")


def top_per_cell(graphs: DataFrame, per_cell: int, seed: int, prefer: Column) -> DataFrame:
    """Preferred graphs first, then seeded hash order; Spark limits each cell before the shuffle."""
    order = seed_rank(F.lit(str(seed)), "cell", F.col("graph_id").cast("string"))
    rank = F.row_number().over(W.partitionBy("cell").orderBy((~prefer).cast("int"), order))
    return graphs.withColumn("rank", rank).where(F.col("rank") <= per_cell)


def select_study(graphs: DataFrame, per_cell: int, seed: int) -> DataFrame:
    """Training graphs stay; the best-ranked other graphs of each cell become tier-2 evaluation graphs."""
    training = graphs.where("graph_split = 'training'").select("graph_id", "cell", F.lit("training").alias("role"), F.lit(False).alias("promoted"))
    chosen = top_per_cell(graphs.where("graph_split <> 'training'"), per_cell, seed, F.col("graph_split") == "evaluation")
    return training.unionByName(chosen.select("graph_id", "cell", F.lit("evaluation").alias("role"), (F.col("tier") == 1).alias("promoted")))


def cell_shortfalls(graphs: DataFrame, per_cell: int) -> DataFrame:
    have = graphs.groupBy("cell").agg(F.count(F.lit(1)).alias("available"))
    return have.where(F.col("available") < per_cell).withColumn("needed", F.lit(per_cell) - F.col("available"))


# fixed value: growth rate whose powers give an evenly spread six-dimensional sequence (x^7 = x + 1)
SPREAD = 1.1127756842787055


def box_starts(graphs: DataFrame, depth: int, points: int, namespace: str) -> DataFrame:
    """Two replicas of a global and a low-angle box, each an evenly spread sequence with a hashed shift."""
    boxes = [("global", "2pi", 2.0, 0.5), ("low_angle", "pi/2", 0.5, 0.25)]
    parts = F.array(*[F.struct(F.lit(r).alias("replica"), F.lit(name).alias("component"), F.lit(g).alias("g"), F.lit(b).alias("b"))
                      for r in (0, 1) for name, _, g, b in boxes])
    rows = (graphs.select("graph_id", F.explode(parts).alias("box"))
            .select("graph_id", "box.*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point_index")))
    dims = F.sequence(F.lit(0), F.lit(2 * depth - 1))

    def coordinate(d: Column) -> Column:
        shift = unit_uniform(F.lit(namespace), F.col("graph_id").cast("string"), F.col("replica").cast("string"), "component", d.cast("string"))
        x = shift + (F.col("point_index") + 1) * F.pow(F.lit(1 / SPREAD), d + 1)
        return (x - F.floor(x)) * F.pi() * F.when(d < depth, F.col("g")).otherwise(F.col("b"))

    return rows.withColumn("theta0", F.transform(dims, coordinate)).drop("g", "b")


def work_bundles(tasks: DataFrame, size: int = 1000) -> DataFrame:
    """Task bundles per graph, at most ``size`` tasks each, so no graph's tasks meet in one row."""
    part = F.pmod(F.xxhash64("task_id"), F.greatest(F.lit(1), F.ceil(F.col("k") / size)))
    counts = tasks.groupBy("graph_id").agg(F.count(F.lit(1)).alias("k"))
    return (tasks.join(counts, "graph_id").withColumn("part", part)
            .groupBy("graph_id", "part").agg(F.array_sort(F.collect_list(F.struct("task_id", "experiment_role", "restart_id"))).alias("tasks")))


def inherit_settings(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Parent settings joined to the child's own; a key set on both sides is an error row."""
    j = parent.join(child.withColumnRenamed("settings", "own"), key)
    clash = F.array_intersect(F.map_keys("settings"), F.map_keys("own"))
    merged = F.when(F.size(clash) == 0, F.map_concat("settings", "own"))
    return j.select(key, merged.alias("settings"), F.array_join(F.array_sort(clash), ",").alias("overridden"))
