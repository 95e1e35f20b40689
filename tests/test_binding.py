"""The binding graph: every kind of problem is named, with all that was made from it."""

import pytest

from restartlab.operators import binding as BD

MANIFEST = "batch string, artifact string, id string"
INPUTS = "batch string, artifact string, input_batch string, input_artifact string, input_id string"


def test_problems_reach_everything_made_from_them(spark):
    manifest = spark.createDataFrame([("a", "plan", "p"), ("a", "fits", "f"), ("a", "starts", "s"), ("b", "plan", "q"), ("b", "report", "r"), ("c", "lone", "l")], MANIFEST)
    inputs = spark.createDataFrame([("a", "fits", "a", "plan", "p"), ("a", "starts", "a", "fits", "f"), ("b", "report", "a", "starts", "s"), ("b", "report", "b", "plan", "older")], INPUTS)
    good = BD.binding_problems(manifest, inputs.where("input_id <> 'older'"), manifest)
    assert good.count() == 0 and BD.require_bound(good, BD.incompatible(spark.createDataFrame([("a", 1), ("b", 1)], "batch string, budget bigint"), "a", ["budget"])) == 0
    now = spark.createDataFrame([("a", "plan", "x"), ("a", "fits", "f"), ("a", "starts", "s"), ("b", "plan", "q"), ("b", "report", "r"), ("b", "extra", "e")], MANIFEST)
    got = {tuple(r) for r in BD.binding_problems(manifest, inputs, now).select("batch", "artifact", "problem", "cause").collect()}
    assert got == {("a", "plan", "changed", "a/plan"), ("a", "fits", "made_from", "a/plan"), ("a", "starts", "made_from", "a/plan"), ("b", "report", "made_from", "a/plan"),
                   ("b", "report", "other_input", "b/plan"), ("c", "lone", "absent", "c/lone"), ("b", "extra", "not_recorded", "b/extra")}
    differ = BD.incompatible(spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 1, "x")], "batch string, budget bigint, source string"), "a", ["budget", "source"])
    assert {tuple(r) for r in differ.collect()} == {("b", "budget"), ("b", "source")}
    with pytest.raises(ValueError, match="b: budget differs"):
        BD.require_bound(good, differ)
    ring = spark.createDataFrame([("a", "plan", "a", "fits", "f"), ("a", "fits", "a", "plan", "older")], INPUTS)
    with pytest.raises(ValueError, match="circle"):
        BD.binding_problems(manifest, ring, manifest)


def test_ids_follow_the_rows_and_not_their_order(spark):
    rows = spark.createDataFrame([("a", "plan", i, i % 5) for i in range(300)], "batch string, artifact string, task bigint, kind bigint")
    one = {r["id"] for df in (rows, rows.repartition(5), rows.orderBy("kind")) for r in BD.artifact_ids(df, "task", ["task", "kind"]).collect()}
    other = BD.artifact_ids(rows.replace(4, 3, ["kind"]), "task", ["task", "kind"]).first()
    assert len(one) == 1 and other["id"] not in one and other["entries"] == 300
