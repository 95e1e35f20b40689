"""Reading, writing and checking stored study tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from restartlab import schemas
from restartlab.functions.scores import content_id


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Create-only write: an existing output is an error, never overwritten."""
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "parquet":
        writer = writer.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def nested_to_json(df: DataFrame) -> DataFrame:
    """Nested columns as ``<name>_json`` text, the flat form summaries are stored in."""
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(field.name).alias(f"{field.name}_json"))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


def library_rows(graphs: DataFrame, edge_lists: DataFrame) -> DataFrame:
    """Stored form of graph records: bounded edge lists, varying parts as JSON text."""
    provenance = F.to_json(F.array(F.struct("cell", "family", "degree_band")))
    rows = graphs.join(edge_lists.select("graph_id", "edges"), "graph_id")
    return rows.select("graph_id", "n", "edges", "cell", "tier", "graph_split", provenance.alias("provenance_json"),
                       F.lit("{}").alias("feature_missing_json"))


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of one row as compact JSON with sorted keys."""
    return content_id(*sorted(columns))


def set_digest(rows: DataFrame, name: str, digest: str) -> DataFrame:
    """One digest of many (name, digest) entries, independent of partitioning.

    Entries are digested in name order inside leaves (names whose hash shares
    five hex digits), leaves inside branches (three digits), branches at the
    root: a leaf sees a millionth of the entries, the root at most 4096 rows.
    """
    text = F.col(name).cast("string")
    line = F.concat(text, F.lit("|"), F.col(digest), F.lit("\n"))

    def level(df: DataFrame, key: Column, entry: Column, count: Column) -> DataFrame:
        return df.select(key.alias("key"), entry.alias("entry"), count.alias("k")).groupBy("key").agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), ""), 256).alias("d"), F.sum("k").alias("k"))

    step = F.concat("key", F.lit("|"), "d", F.lit("\n"))
    leaves = level(rows, F.substring(F.sha2(text, 256), 1, 5), line, F.lit(1))
    branches = level(leaves, F.substring("key", 1, 3), step, F.col("k"))
    return level(branches, F.lit(""), step, F.col("k")).select(F.col("k").alias("entries"), F.col("d").alias("set_digest"))


def write_library(rows: DataFrame, path: str) -> None:
    """Graph table plus a manifest with counts and the content digest; the manifest is written last."""
    write_once(rows, f"{path}/graphs")
    stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/graphs")
    digests = stored.select("graph_id", row_digest(rows.columns).alias("digest"))
    counts = stored.agg(F.count_if(F.col("tier") == 2).alias("tier2"), F.count_if(F.col("graph_split") == "training").alias("training"),
                        F.count_if(F.col("graph_split") == "evaluation").alias("evaluation"))
    one = F.lit(1).alias("k")
    manifest = set_digest(digests, "graph_id", "digest").withColumn("k", one).join(counts.withColumn("k", one), "k").drop("k")
    write_once(manifest.coalesce(1), f"{path}/manifest", fmt="json")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Stored graphs with decoded provenance; explicit schema, no inference."""
    raw = spark.read.schema(schemas.LIBRARY).parquet(f"{path}/graphs")
    return raw.withColumns({"provenance": F.from_json("provenance_json", schemas.PROVENANCE),
                            "feature_missing": F.from_json("feature_missing_json", "map<string,string>")}).drop(
        "provenance_json", "feature_missing_json")


def verify_library(spark: SparkSession, path: str) -> DataFrame:
    """Manifest against recomputed digest and split counts: one row."""
    raw = spark.read.schema(schemas.LIBRARY).parquet(f"{path}/graphs")
    manifest = spark.read.schema("entries bigint, set_digest string, tier2 bigint, training bigint, evaluation bigint").json(f"{path}/manifest")
    now = set_digest(raw.select("graph_id", row_digest(raw.columns).alias("digest")), "graph_id", "digest").select(
        F.col("entries").alias("now_entries"), F.col("set_digest").alias("now_digest"), F.lit(1).alias("k"))
    counts = raw.agg(F.count_if(F.col("graph_split") == "training").alias("now_training")).withColumn("k", F.lit(1))
    return manifest.withColumn("k", F.lit(1)).join(now, "k").join(counts, "k").select(
        "entries", "tier2", "training", "evaluation", (F.col("set_digest") == F.col("now_digest")).alias("digest_equal"),
        (F.col("training") == F.col("now_training")).alias("split_equal"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def scan_attempt_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON records below a folder, with their kind taken from the file path."""
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    place = F.col("_metadata.file_path")
    kind = F.when(place.contains("/started/"), "started").when(place.contains("/io/"), "io").otherwise("attempt")
    return raw.select("*", kind.alias("kind"))


def bucketed(df: DataFrame, buckets: int = 16) -> DataFrame:
    return df.withColumn("graph_bucket", F.pmod(F.xxhash64("graph_id"), F.lit(buckets)).cast("int"))


def read_groups(spark: SparkSession, path: str, schema: str, requests: DataFrame, buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """Attempts of the requested (graph_id, experiment_role) groups, and requests that match nothing.

    Buckets and roles are partition columns, so the semi join prunes folders.
    """
    stored = spark.read.schema(f"{schema}, graph_bucket int, experiment_role string").parquet(path)
    keys = ["graph_bucket", "experiment_role", "graph_id"]
    wanted = bucketed(requests, buckets)
    rows = stored.join(wanted.select(*keys).distinct(), keys, "left_semi")
    unknown = wanted.join(stored.select(*keys).distinct(), keys, "left_anti").select("graph_id", "experiment_role")
    return rows, unknown


def checksum_audit(rows: DataFrame, manifest: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose recomputed digest is not the manifest's, rows without entry, entries without row."""
    now = rows.select(key, row_digest(columns).alias("actual"))
    j = manifest.join(now, key, "full")
    problem = (F.when(F.col("digest").isNull(), "not_in_manifest").when(F.col("actual").isNull(), "absent")
               .when(F.col("digest") != F.col("actual"), "changed"))
    return j.select(key, problem.alias("problem")).where("problem is not null")


def _streamed(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            digests = []
            for uri in batch["path"]:
                where, inner = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))
                digest = hashlib.sha256()
                with where.open_input_stream(inner, compression=None, buffer_size=0) as stream:
                    while data := stream.read(chunk):
                        digest.update(data)
                digests.append(digest.hexdigest())
            yield batch.assign(digest=digests)

    return run


def file_checksums(spark: SparkSession, path: str, glob: str = "*", chunk: int = 8_000_000) -> DataFrame:
    """path, name, length and SHA-256 of every stored file, whatever its size.

    Spark lists the files without their content; each is then read in pieces of
    ``chunk`` bytes by the task that has it. Files are dealt by path. Empty files are
    not listed (Spark makes no split of them).
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")
    hashed = listed.repartition("path").mapInPandas(_streamed(chunk), "path string, length bigint, digest string")
    return hashed.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "digest")


def write_summary(rows: DataFrame, path: str, buckets: int = 8) -> None:
    """Partitioned summary with its index; the index appears only after the data."""
    flat = bucketed(nested_to_json(rows), buckets)
    write_once(flat, f"{path}/rows", ["graph_bucket"])
    stored = rows.sparkSession.read.schema(flat.schema).parquet(f"{path}/rows")
    index = stored.groupBy("graph_bucket").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("graph_id").alias("graphs"))
    write_once(index.coalesce(1), f"{path}/index")


def write_references(refs: DataFrame, path: str) -> None:
    """Reference set; a second version of a graph at one depth stops the write."""
    keys = ["graph_id", "p"] if "p" in refs.columns else ["graph_id"]
    guard = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("versions"))
    checked = refs.join(guard, keys).withColumn("graph_id", F.when(F.col("versions") == 1, F.col("graph_id")).otherwise(
        F.raise_error(F.lit("several reference versions for one graph and depth")).cast("bigint"))).drop("versions")
    write_once(checked, path)
