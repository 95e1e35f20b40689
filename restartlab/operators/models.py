"""A content-addressed store of fitted models, and tables written once below the shared folder."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from restartlab.session import scratch_path, shared_folder


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_id(rows: DataFrame, columns: Sequence[str], **parameters) -> str:
    """Digest of what a fit reads: the rows (in any order) and its parameters."""
    one = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(h) for h in halves]).first()
    text = json.dumps([[str(s) for s in sums], list(columns), parameters], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


class ModelStore:
    """Tables of model rows below one folder, one per content id; a table that exists is complete and never written again."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or f"{shared_folder(spark).rstrip('/')}/models").rstrip("/")

    def load(self, model_id: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{model_id}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def get(self, model_id: str, fit: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """The stored rows of a model, fitted and written if there are none, and whether that was so."""
        found = self.load(model_id)
        if found is not None:
            return found, False
        fit().write.mode("errorifexists").parquet(f"{self.folder}/{model_id}")
        return self.load(model_id), True
