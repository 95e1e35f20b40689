"""A registered query: the Spark callable and, where one exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from restartlab.plans.fixtures import Catalog, with_fixtures


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[Catalog], DataFrame]
    sql: str | None = None
    floats: str = ""
    digits: int = 6

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(self.build(Catalog(spark, sf_dir)), self.digits)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = with_fixtures(self.sql)
        if not self.floats:
            return body
        parts = ", ".join(f"round({c}, {self.digits}) + 0.0 AS {c}" for c in self.floats.split())
        return f"SELECT * REPLACE ({parts}) FROM (\n{body}\n) AS q"


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Sums of doubles depend on partition order in the last bits; results are given to fixed digits."""
    cols = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            col = (F.round(col.cast("double"), digits) + F.lit(0.0)).alias(field.name)
        cols.append(col)
    return df.select(*cols)
