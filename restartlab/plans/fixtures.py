"""Study tables derived from the given parquet tables, in Spark and as SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from restartlab.functions.ranks import bucketed_row_number


class Catalog:
    """Tables of one data folder, and the study tables built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _graph_id(self):
        return (F.col("l_suppkey") * 1000 + (F.year("l_shipdate") - 1995) * 4
                + F.quarter("l_shipdate") - 1).cast("bigint")

    def edge_rows(self) -> DataFrame:
        """Edges with repeats; vertices are residues modulo 12."""
        a, b = F.col("l_partkey") % 12, F.col("l_orderkey") % 12
        return self.table("lineitem").where(a != b).select(
            self._graph_id().alias("graph_id"), F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))

    def edges(self) -> DataFrame:
        return self.edge_rows().distinct()

    def graphs(self, sizes: DataFrame | None = None) -> DataFrame:
        """The study graphs; ``sizes`` (graph_id, m) where the number of edges is known already."""
        sizes = self.edges().groupBy("graph_id").agg(F.count(F.lit(1)).alias("m")) if sizes is None else sizes
        # nation and region are closed dimension tables of the schema
        places = (self.table("supplier")
                  .join(F.broadcast(self.table("nation")), F.col("n_nationkey") == F.col("s_nationkey"))
                  .join(F.broadcast(self.table("region")), F.col("r_regionkey") == F.col("n_regionkey"))
                  .select("s_suppkey", F.col("r_name").alias("family")))
        band = F.when(F.col("m") < 18, 3).otherwise(5)
        tier = F.when(F.col("graph_id") % 3 == 0, 1).otherwise(2)
        split = (F.when(F.col("graph_id") % 3 == 0, "not_applicable")
                 .when(F.col("graph_id") % 5 < 3, "training").otherwise("evaluation"))
        return (sizes.withColumn("s_suppkey", F.floor(F.col("graph_id") / 1000).cast("bigint"))
                .join(places, "s_suppkey")
                .select("graph_id", F.lit(12).cast("bigint").alias("n"), "m", "family",
                        band.cast("bigint").alias("degree_band"),
                        F.concat(F.lit("n12:"), "family", F.lit(":k"), band.cast("string")).alias("cell"),
                        tier.cast("bigint").alias("tier"), split.alias("graph_split")))

    def _calls(self) -> DataFrame:
        block = F.floor((F.dayofmonth("ts") - 1) / 5).cast("bigint")
        return self.table("events").select(
            "event_id", "ts", F.col("user_id").alias("graph_id"), (F.col("user_id") * 10 + block).alias("task_id"),
            block.alias("restart_id"), F.when(F.hour("ts") < 12, 1).otherwise(2).cast("bigint").alias("attempt_number"),
            F.when(F.col("event_type") != "error", F.col("value")).alias("c"),
            (F.col("event_type") != "error").alias("valid"),
            F.col("event_type").isin("purchase", "signup").alias("accepted"))

    def trace(self) -> DataFrame:
        """One row per objective call; calls are numbered minute by minute."""
        return bucketed_row_number(self._calls(), ["task_id", "attempt_number"], F.date_trunc("minute", "ts"),
                                   [F.col("ts"), F.col("event_id")], "call_id")

    def attempts(self) -> DataFrame:
        """One row per attempt: a single aggregation, combined before the shuffle."""
        order = F.struct("ts", "event_id")
        good = F.col("valid") & F.col("accepted")
        return (self._calls().groupBy("task_id", "attempt_number")
                .agg(F.min("graph_id").alias("graph_id"), F.min("restart_id").alias("restart_id"),
                     F.min("ts").alias("started"), F.count(F.lit(1)).alias("objective_calls"),
                     F.max(F.when(F.col("valid"), F.col("c"))).alias("best_seen"),
                     F.max_by(F.when(good, F.col("c")), F.when(good, order)).alias("c_final"),
                     F.when(F.max_by("valid", order), "converged").otherwise("numerical_error").alias("stop_reason")))

    def tasks(self) -> DataFrame:
        """The plan: six restarts of every user, whether or not a run exists."""
        users = self.table("events").select(F.col("user_id").alias("graph_id")).distinct()
        return (users.select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("r"))
                .select("graph_id", F.col("r").cast("bigint").alias("restart_id"),
                        (F.col("graph_id") * 10 + F.col("r")).cast("bigint").alias("task_id"),
                        F.when(F.col("r") < 2, "reference").otherwise("evaluation").alias("experiment_role")))

    def deep_tasks(self) -> DataFrame:
        """The plan at three depths: restarts at depths two and three, one grid task per graph at depth one."""
        tasks = self.tasks()
        grid = tasks.where("restart_id = 0").withColumns({"experiment_role": F.lit("reference"), "task_id": F.col("task_id") + 2_000_000_000})
        return (tasks.withColumn("p", F.lit(2)).unionByName(tasks.withColumns({"p": F.lit(3), "task_id": F.col("task_id") + 1_000_000_000}))
                .unionByName(grid.withColumn("p", F.lit(1))).withColumn("p", F.col("p").cast("bigint")))

    @staticmethod
    def deepened(rows: DataFrame, scores: tuple[str, ...]) -> DataFrame:
        """Runs or calls of depth two, and those of depth three: other scores, and a seventh of the tasks never ran."""
        more = rows.where("task_id % 7 <> 0").withColumns({"task_id": F.col("task_id") + 1_000_000_000, **{c: F.col(c) * 1.25 - 10 for c in scores}})
        return rows.unionByName(more)

    def deep_selected(self, selected: DataFrame) -> DataFrame:
        """Selected runs at three depths; a depth-one run has a grid maximum and says whether its refinement passed."""
        runs = self.deepened(selected, ("best_seen", "c_final")).withColumns({"grid_c": F.lit(None).cast("double"), "refinement_passed": F.lit(None).cast("boolean")})
        grid = selected.where("restart_id = 0").withColumns({
            "task_id": F.col("task_id") + 2_000_000_000, "grid_c": F.col("best_seen") * 0.9, "refinement_passed": F.col("objective_calls") % 4 != 0})
        return runs.unionByName(grid)

    def cstar(self) -> DataFrame:
        return (self.table("events").groupBy(F.col("user_id").alias("graph_id"))
                .agg((F.max("value") * 1.05).alias("c_star")))

    def arms(self) -> DataFrame:
        return (self.table("orders").join(self.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
                .groupBy(F.col("o_custkey").alias("graph_id"), F.col("c_nationkey").cast("bigint").alias("cell"),
                         F.col("o_orderpriority").alias("arm"))
                .agg(F.avg("o_totalprice").alias("quality"), F.count(F.lit(1)).alias("runs"),
                     F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("success_fraction")))

    def labels(self) -> DataFrame:
        return (self.table("lineitem").groupBy(self._graph_id().alias("graph_id"))
                .agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("successes"),
                     F.count(F.lit(1)).alias("trials")))

    def angles(self) -> DataFrame:
        """Angle vectors with p=2: two gammas, then two betas."""
        return self.table("embeddings").select(
            "vec_id", F.col("label").cast("bigint").alias("label"),
            F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 12.0).alias("theta"))


# The same tables as SQL text. Order matters: later ones use earlier ones.
FIXTURE_SQL = {
    "fx_edges": """
SELECT DISTINCT l_suppkey*1000 + (year(l_shipdate)-1995)*4 + quarter(l_shipdate)-1 AS graph_id,
       least(l_partkey%12, l_orderkey%12) AS u, greatest(l_partkey%12, l_orderkey%12) AS v
FROM lineitem WHERE l_partkey%12 <> l_orderkey%12""",
    "fx_graphs": """
SELECT g.graph_id, CAST(12 AS BIGINT) AS n, g.m, r.r_name AS family,
       CAST(CASE WHEN g.m < 18 THEN 3 ELSE 5 END AS BIGINT) AS degree_band,
       concat('n12:', r.r_name, ':k', CASE WHEN g.m < 18 THEN '3' ELSE '5' END) AS cell,
       CAST(CASE WHEN g.graph_id%3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS tier,
       CASE WHEN g.graph_id%3 = 0 THEN 'not_applicable' WHEN g.graph_id%5 < 3 THEN 'training' ELSE 'evaluation' END AS graph_split
FROM (SELECT graph_id, count(*) AS m FROM fx_edges GROUP BY graph_id) g
JOIN supplier s ON s.s_suppkey = CAST(floor(g.graph_id/1000) AS BIGINT)
JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "fx_trace": """
SELECT x.*, row_number() OVER (PARTITION BY task_id, attempt_number ORDER BY ts, event_id) AS call_id
FROM (SELECT event_id, ts, user_id AS graph_id,
             user_id*10 + CAST(floor((day(ts)-1)/5) AS BIGINT) AS task_id,
             CAST(floor((day(ts)-1)/5) AS BIGINT) AS restart_id,
             CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END AS attempt_number,
             CASE WHEN event_type <> 'error' THEN value END AS c, event_type <> 'error' AS valid,
             event_type IN ('purchase','signup') AS accepted
      FROM events) x""",
    "fx_attempts": """
SELECT task_id, attempt_number, min(graph_id) AS graph_id, min(restart_id) AS restart_id,
       min(ts) AS started, count(*) AS objective_calls,
       max(CASE WHEN valid THEN c END) AS best_seen,
       max(CASE WHEN call_id = last_acc THEN c END) AS c_final,
       max(CASE WHEN call_id = k THEN CASE WHEN valid THEN 'converged' ELSE 'numerical_error' END END) AS stop_reason
FROM (SELECT t.*, count(*) OVER (PARTITION BY task_id, attempt_number) AS k,
             max(CASE WHEN valid AND accepted THEN call_id END) OVER (PARTITION BY task_id, attempt_number) AS last_acc
      FROM fx_trace t) y
GROUP BY task_id, attempt_number""",
    "fx_tasks": """
SELECT u.graph_id, b.r_regionkey + 0 AS restart_id, u.graph_id*10 + b.r_regionkey AS task_id,
       CASE WHEN b.r_regionkey < 2 THEN 'reference' ELSE 'evaluation' END AS experiment_role
FROM (SELECT DISTINCT user_id AS graph_id FROM events) u
CROSS JOIN (SELECT r_regionkey FROM region UNION ALL SELECT max(r_regionkey)+1 FROM region) b""",
    "fx_cstar": """
SELECT user_id AS graph_id, max(value)*1.05 AS c_star FROM events GROUP BY user_id""",
    "fx_arms": """
SELECT o_custkey AS graph_id, c_nationkey AS cell, o_orderpriority AS arm,
       avg(o_totalprice) AS quality, count(*) AS runs,
       avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success_fraction
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_nationkey, o_orderpriority""",
    "fx_labels": """
SELECT l_suppkey*1000 + (year(l_shipdate)-1995)*4 + quarter(l_shipdate)-1 AS graph_id,
       sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS successes, count(*) AS trials
FROM lineitem GROUP BY 1""",
    "fx_angles": """
SELECT vec_id, label, [CAST(e AS DOUBLE)*12.0::DOUBLE FOR e IN embedding[1:4]] AS theta FROM embeddings""",
    # one attempt per task: first nonfault, else first fault
    "fx_selected": """
SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY task_id ORDER BY
         CASE WHEN stop_reason IN ('numerical_error','evaluation_error','optimizer_failed','program_error') THEN 1 ELSE 0 END,
         attempt_number) AS pick FROM fx_attempts a) s WHERE pick = 1""",
    # frozen reference per graph
    "fx_refs": """
SELECT t.graph_id, count(*) AS planned, count(s.best_seen) FILTER (s.stop_reason <> 'numerical_error') AS valid,
       max(s.best_seen) FILTER (s.stop_reason <> 'numerical_error') AS c_ref,
       count(s.best_seen) FILTER (s.stop_reason <> 'numerical_error') = count(*) AS complete
FROM fx_tasks t LEFT JOIN fx_selected s ON s.task_id = t.task_id
WHERE t.experiment_role = 'reference' GROUP BY t.graph_id""",
    # one scored row per planned evaluation restart, tolerance 0.3 of c_star
    "fx_scored": """
SELECT t.graph_id, t.task_id, t.restart_id, s.attempt_number, s.task_id IS NULL AS missing,
       s.best_seen, s.c_final, s.objective_calls, s.stop_reason, c.c_star, r.complete AS reference_complete,
       CASE WHEN r.complete THEN r.c_ref END AS c_ref,
       CASE WHEN r.complete THEN r.c_ref - 0.3::DOUBLE*c.c_star END AS threshold,
       coalesce(s.stop_reason = 'converged' AND s.c_final IS NOT NULL, false) AS execution_valid,
       s.task_id IS NOT NULL AND NOT coalesce(s.stop_reason = 'converged' AND s.c_final IS NOT NULL, false) AS execution_fault,
       CASE WHEN r.complete AND s.task_id IS NOT NULL THEN
         coalesce(s.stop_reason = 'converged' AND s.c_final >= r.c_ref - 0.3::DOUBLE*c.c_star, false) END AS terminal_success,
       h.first_hit, h.c_initial
FROM fx_tasks t
JOIN fx_cstar c ON c.graph_id = t.graph_id
LEFT JOIN fx_selected s ON s.task_id = t.task_id
LEFT JOIN fx_refs r ON r.graph_id = t.graph_id
LEFT JOIN (SELECT x.task_id, x.attempt_number,
                  min(x.call_id) FILTER (x.c >= r2.c_ref - 0.3::DOUBLE*c2.c_star AND r2.complete) AS first_hit,
                  max(CASE WHEN x.call_id = 1 THEN x.c END) AS c_initial
           FROM fx_trace x JOIN fx_cstar c2 ON c2.graph_id = x.graph_id LEFT JOIN fx_refs r2 ON r2.graph_id = x.graph_id
           GROUP BY 1, 2) h ON h.task_id = s.task_id AND h.attempt_number = s.attempt_number
WHERE t.experiment_role = 'evaluation'""",
    # the same plan, runs and calls at three depths
    "fx_deep_tasks": """
SELECT graph_id, restart_id, task_id, experiment_role, 2 AS p FROM fx_tasks
UNION ALL SELECT graph_id, restart_id, task_id + 1000000000, experiment_role, 3 FROM fx_tasks
UNION ALL SELECT graph_id, restart_id, task_id + 2000000000, 'reference', 1 FROM fx_tasks WHERE restart_id = 0""",
    "fx_deep_selected": """
SELECT task_id, attempt_number, best_seen, c_final, stop_reason, NULL::DOUBLE AS grid_c, NULL::BOOLEAN AS passed FROM fx_selected
UNION ALL SELECT task_id + 1000000000, attempt_number, best_seen*1.25 - 10, c_final*1.25 - 10, stop_reason, NULL, NULL FROM fx_selected WHERE task_id%7 <> 0
UNION ALL SELECT task_id + 2000000000, attempt_number, best_seen, c_final, stop_reason, best_seen*0.9, objective_calls%4 <> 0 FROM fx_selected WHERE restart_id = 0""",
    "fx_deep_trace": """
SELECT task_id, attempt_number, call_id, c FROM fx_trace
UNION ALL SELECT task_id + 1000000000, attempt_number, call_id, c*1.25 - 10 FROM fx_trace WHERE task_id%7 <> 0""",
    "fx_deep_refs": """
SELECT graph_id, p, count(*) AS planned, count(*) FILTER (x IS NOT NULL AND ok) AS valid, max(x) AS c_ref,
       count(*) FILTER (x IS NOT NULL AND ok) = count(*) AS complete, arg_min(task_id, (-x, restart_id)) FILTER (x IS NOT NULL) AS source_task_id
FROM (SELECT t.*, CASE WHEN s.stop_reason <> 'numerical_error' THEN CASE WHEN t.p = 1 THEN s.grid_c ELSE s.best_seen END END AS x, t.p > 1 OR coalesce(s.passed, false) AS ok
      FROM fx_deep_tasks t LEFT JOIN fx_deep_selected s ON s.task_id = t.task_id WHERE t.experiment_role = 'reference')
GROUP BY 1, 2""",
    "fx_deep_scored": """
SELECT t.graph_id, t.p, t.task_id, t.restart_id, s.task_id IS NULL AS missing, s.best_seen, c.c_star, r.complete AS reference_complete,
       CASE WHEN r.complete THEN r.c_ref END AS c_ref, coalesce(s.stop_reason = 'converged' AND s.c_final IS NOT NULL, false) AS execution_valid,
       s.task_id IS NOT NULL AND NOT coalesce(s.stop_reason = 'converged' AND s.c_final IS NOT NULL, false) AS execution_fault,
       CASE WHEN r.complete AND s.task_id IS NOT NULL THEN coalesce(s.stop_reason = 'converged' AND s.c_final >= r.c_ref - 0.3::DOUBLE*c.c_star, false) END AS terminal_success,
       h.first_hit, h.top
FROM fx_deep_tasks t JOIN fx_cstar c ON c.graph_id = t.graph_id
LEFT JOIN fx_deep_selected s ON s.task_id = t.task_id LEFT JOIN fx_deep_refs r ON r.graph_id = t.graph_id AND r.p = t.p
LEFT JOIN (SELECT x.task_id, x.attempt_number, min(x.call_id) FILTER (x.c >= r2.c_ref - 0.3::DOUBLE*c2.c_star AND r2.complete) AS first_hit, max(x.c) AS top
           FROM fx_deep_trace x JOIN fx_deep_tasks t2 ON t2.task_id = x.task_id JOIN fx_cstar c2 ON c2.graph_id = t2.graph_id
           LEFT JOIN fx_deep_refs r2 ON r2.graph_id = t2.graph_id AND r2.p = t2.p GROUP BY 1, 2) h ON h.task_id = s.task_id AND h.attempt_number = s.attempt_number
WHERE t.experiment_role = 'evaluation'""",
    # degree of every vertex, and common neighbours of every edge
    "fx_deg": """
SELECT graph_id, x AS v, count(*) AS d FROM
 (SELECT graph_id, u AS x FROM fx_edges UNION ALL SELECT graph_id, v FROM fx_edges) e GROUP BY 1, 2""",
    "fx_adj": """
SELECT graph_id, u AS a, v AS b FROM fx_edges UNION ALL SELECT graph_id, v, u FROM fx_edges""",
    "fx_types": """
SELECT e.graph_id, e.u, e.v, least(du.d, dv.d)-1 AS a, greatest(du.d, dv.d)-1 AS b, coalesce(t.t, 0) AS t
FROM fx_edges e JOIN fx_deg du ON du.graph_id = e.graph_id AND du.v = e.u
JOIN fx_deg dv ON dv.graph_id = e.graph_id AND dv.v = e.v
LEFT JOIN (SELECT e.graph_id, e.u, e.v, count(*) AS t FROM fx_edges e
           JOIN fx_adj x ON x.graph_id = e.graph_id AND x.a = e.u
           JOIN fx_adj y ON y.graph_id = e.graph_id AND y.a = e.v AND y.b = x.b GROUP BY 1, 2, 3) t
  ON t.graph_id = e.graph_id AND t.u = e.u AND t.v = e.v""",
    "fx_features": """
SELECT d.graph_id, d.n, d.m, d.density, d.mean_degree, d.degree_min, d.degree_max, d.degree_variance, v.mean_clustering,
       CASE WHEN d.wedges > 0 THEN 3.0*v.triangles/d.wedges END AS transitivity, d.wedges, v.triangles,
       CASE WHEN NOT t.flat THEN (t.xy - t.x1*t.x1)/(t.x2 - t.x1*t.x1) END AS degree_assortativity,
       t.t1 AS triangle_edge_mean, t.t2 - t.t1*t.t1 AS triangle_edge_variance, t.x1 AS endpoint_excess_degree_mean,
       CASE WHEN t.flat THEN 0 ELSE t.x2 - t.x1*t.x1 END AS endpoint_excess_degree_variance,
       l.normalized_laplacian_mean, l.normalized_laplacian_variance, 2.0*d.m/12 AS adjacency_moment_2,
       6.0*v.triangles/12 AS adjacency_moment_3, w.closed/12.0 AS adjacency_moment_4,
       CASE WHEN t.flat THEN 1.0 ELSE 0.0 END AS degree_assortativity_missing
FROM (SELECT graph_id, 12 AS n, CAST(sum(d)/2 AS BIGINT) AS m, sum(d)/132.0 AS density, sum(d)/12.0 AS mean_degree,
             CASE WHEN count(*) < 12 THEN 0 ELSE min(d) END AS degree_min, max(d) AS degree_max,
             sum(d*d)/12.0 - (sum(d)/12.0)*(sum(d)/12.0) AS degree_variance, CAST(sum(d*(d-1)/2) AS BIGINT) AS wedges
      FROM fx_deg GROUP BY 1) d
JOIN (SELECT d.graph_id, CAST(sum(coalesce(k.k, 0))/6 AS BIGINT) AS triangles,
             sum(CASE WHEN d.d > 1 THEN coalesce(k.k, 0)/(d.d*(d.d-1.0)) ELSE 0 END)/12 AS mean_clustering
      FROM fx_deg d LEFT JOIN (SELECT x.graph_id, x.a AS v, count(*) AS k FROM fx_adj x
          JOIN fx_adj y ON y.graph_id = x.graph_id AND y.a = x.b
          JOIN fx_adj z ON z.graph_id = x.graph_id AND z.a = y.b AND z.b = x.a GROUP BY 1, 2) k
        ON k.graph_id = d.graph_id AND k.v = d.v GROUP BY 1) v ON v.graph_id = d.graph_id
JOIN (SELECT graph_id, avg(t) AS t1, avg(t*t) AS t2, (sum(a)+sum(b))/(2.0*count(*)) AS x1, (sum(a*a)+sum(b*b))/(2.0*count(*)) AS x2,
             avg(a*b) AS xy, max(b) = min(a) AS flat FROM fx_types GROUP BY 1) t ON t.graph_id = d.graph_id
JOIN (SELECT x.graph_id, count(DISTINCT x.a)/12.0 AS normalized_laplacian_mean,
             (count(DISTINCT x.a) + sum(1.0/(da.d*db.d)))/12.0 - (count(DISTINCT x.a)/12.0)*(count(DISTINCT x.a)/12.0) AS normalized_laplacian_variance
      FROM fx_adj x JOIN fx_deg da ON da.graph_id = x.graph_id AND da.v = x.a
      JOIN fx_deg db ON db.graph_id = x.graph_id AND db.v = x.b GROUP BY 1) l ON l.graph_id = d.graph_id
JOIN (SELECT graph_id, sum(k*k) AS closed FROM (SELECT x.graph_id, x.a, y.b, count(*) AS k FROM fx_adj x
          JOIN fx_adj y ON y.graph_id = x.graph_id AND y.a = x.b GROUP BY 1, 2, 3) GROUP BY 1) w ON w.graph_id = d.graph_id""",
    # small dense graphs on six vertices: every edge folded onto u%6, v%6
    "fx_fold": """
SELECT DISTINCT graph_id, least(u%6, v%6) AS u, greatest(u%6, v%6) AS v FROM fx_edges WHERE u%6 <> v%6""",
}


def with_fixtures(sql: str) -> str:
    """Prefix a statement with the study tables it names, directly or through others."""
    wanted, queue = set(), [sql]
    while queue:
        text = queue.pop()
        for name in FIXTURE_SQL:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                queue.append(FIXTURE_SQL[name])
    if not wanted:
        return sql
    ctes = ",\n".join(f"{name} AS ({FIXTURE_SQL[name]})" for name in FIXTURE_SQL if name in wanted)
    stripped = sql.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{sql}"
