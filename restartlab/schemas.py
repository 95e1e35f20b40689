"""Explicit schemas of the stored study tables."""

from __future__ import annotations

EDGE = "struct<u:bigint,v:bigint>"
PROVENANCE = "array<struct<cell:string,family:string,degree_band:bigint>>"

LIBRARY = ("graph_id bigint, n bigint, edges array<" + EDGE + ">, cell string, tier bigint, graph_split string, "
           "provenance_json string, feature_missing_json string")
TASK = ("task_id bigint, graph_id bigint, restart_id bigint, experiment_role string")
ATTEMPT = ("task_id bigint, attempt_number bigint, graph_id bigint, restart_id bigint, started string, objective_calls bigint, "
           "best_seen double, c_final double, stop_reason string")
REFERENCE = "graph_id bigint, planned bigint, valid bigint, complete boolean, c_ref double, source_task_id bigint, source_attempt bigint"
DEEP_REFERENCE = REFERENCE.replace("graph_id bigint,", "graph_id bigint, p bigint,")
CALL = "struct<call_id:bigint,c:double,accepted:boolean,valid:boolean>"
