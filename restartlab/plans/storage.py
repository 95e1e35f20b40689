"""Queries of the source and sink family; data go through the shared folder and are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.errors import AnalysisException

from restartlab import schemas
from restartlab.functions.scores import content_id
from restartlab.operators import scoring as S
from restartlab.plans.fixtures import Catalog
from restartlab.plans.graphs import edge_lists
from restartlab.plans.query import Query
from restartlab.plans.scoring import deep_references, references, selected
from restartlab.session import scratch_path
from restartlab.sources import library as B


def _library(cat: Catalog) -> DataFrame:
    return B.library_rows(cat.graphs(), edge_lists(cat))


def _stored_library(cat: Catalog) -> str:
    path = scratch_path(cat.spark, "library")
    B.write_library(_library(cat), path)
    return path


def _read_library(cat: Catalog) -> DataFrame:
    rows = B.read_library(cat.spark, _stored_library(cat))
    return rows.select("graph_id", "n", "tier", "graph_split", F.size("edges").cast("bigint").alias("m"),
                       F.element_at("provenance", 1)["family"].alias("family"), F.element_at("provenance", 1)["degree_band"].alias("degree_band"))


def _projected(cat: Catalog) -> DataFrame:
    """Two columns of a wide table; the scan reads only those."""
    return cat.table("documents").select("doc_id", "lang").where("doc_id >= 0").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))


def _json_lines(cat: Catalog) -> DataFrame:
    path = scratch_path(cat.spark, "tasks")
    B.write_once(cat.tasks(), path, fmt="json")
    return B.read_json_lines(cat.spark, path, schemas.TASK).select("task_id", "graph_id", "restart_id", "experiment_role")


def _attempt_files(cat: Catalog) -> DataFrame:
    path = scratch_path(cat.spark, "records")
    a = cat.attempts().withColumn("started", F.col("started").cast("string"))
    B.write_once(a, f"{path}/attempt", fmt="json")
    B.write_once(a.select("task_id", "attempt_number"), f"{path}/started", fmt="json")
    B.write_once(a.where("task_id % 2 = 0").select("task_id", "attempt_number"), f"{path}/io", fmt="json")
    rows = B.scan_attempt_files(cat.spark, path, schemas.ATTEMPT)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("records"), F.count("stop_reason").alias("with_result"), F.sum("task_id").alias("task_sum"))


def _group_scan(cat: Catalog) -> DataFrame:
    path = scratch_path(cat.spark, "attempts")
    a = cat.attempts().withColumn("started", F.col("started").cast("string")).withColumn(
        "experiment_role", F.when(F.col("restart_id") < 2, "reference").otherwise("evaluation"))
    B.write_once(B.bucketed(a).repartition("graph_bucket"), path, ["graph_bucket", "experiment_role"])
    wanted = cat.tasks().where("graph_id % 5 = 0").select("graph_id", F.lit("evaluation").alias("experiment_role")).distinct().unionByName(
        cat.table("nation").select((-F.col("n_nationkey") - 1).cast("bigint").alias("graph_id"), F.lit("evaluation").alias("experiment_role")))
    rows, unknown = B.read_groups(cat.spark, path, schemas.ATTEMPT, wanted)
    return (rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("attempts")).withColumn("status", F.lit("read"))
            .unionByName(unknown.select("graph_id", F.lit(0).cast("bigint").alias("attempts"), F.lit("unknown_group").alias("status"))))


def _metadata_only(cat: Catalog) -> DataFrame:
    """Attempts stored with nested calls; the scan leaves the calls unread."""
    path = scratch_path(cat.spark, "traced")
    part = F.floor((F.col("call_id") - 1) / 8)  # arrays of bounded length, however long an attempt is
    parts = cat.trace().groupBy("task_id", "attempt_number", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("call_id", "c", "accepted", "valid"))).alias("calls"))
    B.write_once(parts.join(cat.attempts().select("task_id", "attempt_number", "graph_id", "stop_reason"), ["task_id", "attempt_number"]), path)
    schema = f"task_id bigint, attempt_number bigint, part bigint, calls array<{schemas.CALL}>, graph_id bigint, stop_reason string"
    return cat.spark.read.schema(schema).parquet(path).drop("calls").select(
        "task_id", "attempt_number", "part", "graph_id", "stop_reason")


def _checksum_rows(cat: Catalog) -> DataFrame:
    docs = cat.table("documents").select("doc_id", "lang", "text")
    manifest = docs.where("doc_id % 43 <> 0").select("doc_id", B.row_digest(docs.columns).alias("digest"))
    now = docs.where("doc_id % 37 <> 0").withColumn("lang", F.when(F.col("doc_id") % 29 == 0, F.lit("xx")).otherwise(F.col("lang")))
    return B.checksum_audit(now, manifest, "doc_id", docs.columns)


def _file_checksums(cat: Catalog) -> DataFrame:
    """One file per language, written, hashed, and hashed again: digests, and whether the second look differs."""
    path = scratch_path(cat.spark, "files")
    lines = cat.table("documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), "doc_id", F.concat_ws(" ", "doc_id", F.md5(F.coalesce("text", F.lit("")))).alias("value"))
    lines.repartition("lang").sortWithinPartitions("lang", "doc_id").select("lang", "value").write.partitionBy("lang").text(path)
    first = B.file_checksums(cat.spark, path, "*.txt").select(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"), "path", "length", "digest")
    again = B.file_checksums(cat.spark, path, "*.txt", 1000).select("path", F.col("digest").alias("now"))
    return first.join(again, "path", "left").select("lang", "length", "digest", (~F.col("digest").eqNullSafe(F.col("now"))).alias("changed"))


def _content_ids(cat: Catalog) -> DataFrame:
    return cat.tasks().select("task_id", content_id("experiment_role", "graph_id", "restart_id", "task_id").alias("content_id"))


def _set_digest(cat: Catalog) -> DataFrame:
    files = cat.table("pages").select(F.col("url").alias("name"), F.sha2("html", 256).alias("digest"))
    return B.set_digest(files, "name", "digest")


def _create_only(cat: Catalog) -> DataFrame:
    """The second write to one path must fail and leave the first output as it was."""
    path = scratch_path(cat.spark, "frozen")
    B.write_once(references(cat), path)
    try:
        B.write_once(references(cat).limit(0), path)
        refused = False
    except AnalysisException:
        refused = True
    rows = cat.spark.read.schema(schemas.REFERENCE).parquet(path)
    return rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("second_write_refused", F.lit(refused))


def _library_manifest(cat: Catalog) -> DataFrame:
    return B.verify_library(cat.spark, _stored_library(cat))


def _summary_rows(cat: Catalog) -> DataFrame:
    refs = S.freeze_references(cat.tasks(), selected(cat))
    return refs.select("graph_id", F.struct("planned", "valid").alias("pool"), F.array("source_task_id").alias("sources"),
                       F.lpad(F.conv(F.substring(F.sha2(F.col("graph_id").cast("string"), 256), 1, 15), 16, 10), 20, "0").alias("seed"))


def _summary_write(cat: Catalog) -> DataFrame:
    path = scratch_path(cat.spark, "summary")
    flat = B.nested_to_json(_summary_rows(cat))
    B.write_once(flat, path)
    return cat.spark.read.schema(flat.schema).parquet(path)


def _partitioned_summary(cat: Catalog) -> DataFrame:
    path = scratch_path(cat.spark, "partitioned")
    B.write_summary(_summary_rows(cat), path)
    return cat.spark.read.schema("graph_bucket int, rows bigint, graphs bigint").parquet(f"{path}/index").agg(
        F.sum("rows").alias("rows"), F.sum("graphs").alias("graphs"))


def _reference_set(cat: Catalog) -> DataFrame:
    path = scratch_path(cat.spark, "references")
    B.write_references(references(cat), path)
    return cat.spark.read.schema(schemas.REFERENCE).parquet(path).select("graph_id", "planned", "valid", "complete", "c_ref")


def _deep_reference_set(cat: Catalog) -> DataFrame:
    """References of all depths in one set; a second version of a graph at one depth is refused."""
    path = scratch_path(cat.spark, "references")
    B.write_references(deep_references(cat), path)
    twice = deep_references(cat).where("p = 2").limit(1)
    try:
        B.write_references(deep_references(cat).unionByName(twice), scratch_path(cat.spark, "references"))
        refused = False
    except Exception as error:  # the guard's own message, whatever wraps it
        if "several reference versions" not in str(error):
            raise
        refused = True
    back = cat.spark.read.schema(schemas.DEEP_REFERENCE).parquet(path)
    return back.select("graph_id", "p", "planned", "valid", "complete", "c_ref", F.lit(refused).alias("second_version_refused"))


def _reference_set_id(cat: Catalog) -> DataFrame:
    ids = references(cat).where("complete").select("graph_id", content_id("graph_id", "planned", "source_task_id", "valid").alias("reference_id"))
    return B.set_digest(ids, "graph_id", "reference_id")


def _set_digest_sql(source: str) -> str:
    def level(inner: str, key: str, entry: str, count: str) -> str:
        return f"SELECT {key} AS key, sha256(string_agg({entry}, '' ORDER BY {entry})) AS d, CAST(sum({count}) AS BIGINT) AS k FROM ({inner}) GROUP BY 1"

    step = "key || '|' || d || chr(10)"
    leaves = level(source, "substr(sha256(name), 1, 5)", "name || '|' || digest || chr(10)", "1")
    root = level(level(leaves, "substr(key, 1, 3)", step, "k"), "''", step, "k")
    return f"SELECT k AS entries, d AS set_digest FROM ({root})"


QUERIES = [
    Query("src1_read_library", _read_library, "SELECT graph_id, n, tier, graph_split, m, family, degree_band FROM fx_graphs"),
    Query("src2_projected_read", _projected, "SELECT lang, count(*) AS documents FROM documents GROUP BY 1"),
    Query("src3_json_lines_scan", _json_lines, "SELECT task_id, graph_id, restart_id, experiment_role FROM fx_tasks"),
    Query("src4_attempt_file_scan", _attempt_files, """
SELECT 'attempt' AS kind, count(*) AS records, count(*) AS with_result, CAST(sum(task_id) AS BIGINT) AS task_sum FROM fx_attempts
UNION ALL SELECT 'started', count(*), 0, CAST(sum(task_id) AS BIGINT) FROM fx_attempts
UNION ALL SELECT 'io', count(*), 0, CAST(sum(task_id) AS BIGINT) FROM fx_attempts WHERE task_id%2 = 0"""),
    Query("src5_group_scoped_scan", _group_scan, """
SELECT graph_id, count(*) AS attempts, 'read' AS status FROM fx_attempts WHERE graph_id%5 = 0 AND restart_id >= 2 GROUP BY 1
UNION ALL SELECT -n_nationkey - 1, 0, 'unknown_group' FROM nation"""),
    Query("src6_metadata_only_scan", _metadata_only, """
SELECT x.task_id, x.attempt_number, (x.call_id - 1)//8 AS part, min(x.graph_id) AS graph_id, min(a.stop_reason) AS stop_reason FROM fx_trace x
JOIN fx_attempts a ON a.task_id = x.task_id AND a.attempt_number = x.attempt_number GROUP BY 1, 2, 3"""),
    Query("src7_checksum_audit", _checksum_rows, """
SELECT doc_id, CASE WHEN doc_id%43 = 0 THEN 'not_in_manifest' WHEN doc_id%37 = 0 THEN 'absent' ELSE 'changed' END AS problem FROM documents
WHERE (doc_id%43 = 0 AND doc_id%37 <> 0) OR (doc_id%43 <> 0 AND doc_id%37 = 0) OR (doc_id%43 <> 0 AND doc_id%37 <> 0 AND doc_id%29 = 0 AND lang <> 'xx')"""),
    Query("src7_file_checksums", _file_checksums, """
SELECT lang, length(t) AS length, sha256(t) AS digest, false AS changed FROM (
 SELECT coalesce(lang, 'none') AS lang, string_agg(doc_id || ' ' || md5(coalesce(text, '')) || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1)"""),
    Query("src8_content_id", _content_ids, """
SELECT task_id, sha256('{"experiment_role":"' || experiment_role || '","graph_id":' || graph_id || ',"restart_id":' || restart_id || ',"task_id":' || task_id || '}') AS content_id FROM fx_tasks"""),
    Query("src9_input_set_digest", _set_digest, _set_digest_sql("SELECT url AS name, sha256(html) AS digest FROM pages")),
    Query("snk1_create_only_write", _create_only, "SELECT count(*) AS rows, true AS second_write_refused FROM fx_refs"),
    Query("snk2_library_write", _library_manifest, """
SELECT count(*) AS entries, count(*) FILTER (tier = 2) AS tier2, count(*) FILTER (graph_split = 'training') AS training,
 count(*) FILTER (graph_split = 'evaluation') AS evaluation, true AS digest_equal, true AS split_equal FROM fx_graphs"""),
    Query("snk3_summary_write", _summary_write, """
SELECT r.graph_id, '{"planned":' || planned || ',"valid":' || valid || '}' AS pool_json, '[' || coalesce((SELECT arg_min(s.task_id, (-s.best_seen, t.restart_id))
   FROM fx_selected s JOIN fx_tasks t ON t.task_id = s.task_id WHERE t.graph_id = r.graph_id AND t.experiment_role = 'reference' AND s.stop_reason = 'converged'
   AND s.best_seen IS NOT NULL)::VARCHAR, 'null') || ']' AS sources_json,
 lpad(('0x' || substr(sha256(r.graph_id::VARCHAR), 1, 15))::BIGINT::VARCHAR, 20, '0') AS seed FROM fx_refs r"""),
    Query("snk4_partitioned_summary", _partitioned_summary, "SELECT count(*) AS rows, count(*) AS graphs FROM fx_refs"),
    Query("snk5_reference_set", _reference_set, "SELECT graph_id, planned, valid, complete, c_ref FROM fx_refs", "c_ref"),
    Query("snk5_reference_set_by_depth", _deep_reference_set, "SELECT graph_id, p, planned, valid, complete, c_ref, true AS second_version_refused FROM fx_deep_refs", "c_ref"),
    Query("snk5_reference_set_id", _reference_set_id, _set_digest_sql("""
SELECT r.graph_id::VARCHAR AS name, sha256('{"graph_id":' || r.graph_id || ',"planned":' || planned || ',"source_task_id":' || x.t || ',"valid":' || valid || '}') AS digest
FROM fx_refs r JOIN (SELECT t.graph_id, arg_min(s.task_id, (-s.best_seen, t.restart_id)) AS t FROM fx_selected s JOIN fx_tasks t ON t.task_id = s.task_id
  WHERE t.experiment_role = 'reference' AND s.stop_reason = 'converged' AND s.best_seen IS NOT NULL GROUP BY 1) x ON x.graph_id = r.graph_id WHERE r.complete""")),
]
