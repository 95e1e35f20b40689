"""Shards along a Hilbert curve over document metadata, cut into runs of equal row counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

BITS = 5  # each dimension has 32 steps


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows, dimensions); neighbours on the curve are neighbours in space."""
    x = points.T.astype(np.int64).copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of all higher levels
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn = np.where((x[-1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def category(col: Column) -> Column:
    """A text value as one of 32 steps by its hash; null is step 0."""
    return F.coalesce(F.pmod(F.xxhash64(col), F.lit(2**BITS)), F.lit(0)).cast("int")


def magnitude(col: Column) -> Column:
    """A size as one of 32 steps, two for each doubling; null is step 0."""
    return F.least(F.greatest(F.floor(F.log2(F.greatest(col, F.lit(1))) * 2) - 4, F.lit(0)), F.lit(2**BITS - 1)).cast("int")


def along_curve(docs: DataFrame, dimensions: Sequence[Column], shards: int = 40, spread: int = 64) -> DataFrame:
    """``docs`` with __curve (index), shard and slot: rows in curve order, cut into ``shards`` runs whose counts differ by one at most.

    ``docs`` has doc_id and text_crc32. The order is curve index, leading bits of
    the checksum, one of ``spread`` hashes of the id, then checksum and id: a cell
    or a text that holds a third of all rows is ranked in many parts, and only
    counts of parts are summed. At most 32 ** dimensions cells exist, so their
    table is broadcast. Rows alike in all of this are interchangeable.
    """
    steps = [f"__step{i}" for i in range(len(dimensions))]
    if BITS * len(steps) > 15:
        raise ValueError("at most three dimensions: the table of cells is broadcast")

    def indexed(points: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack(points.to_list())))

    curve = F.pandas_udf(indexed, "bigint")
    part = F.shiftright("text_crc32", 26) * spread + F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    rows = docs.select("*", *[d.alias(s) for d, s in zip(dimensions, steps)]).withColumn("__part", part)
    counts = rows.groupBy(*steps, "__part").agg(F.count(F.lit(1)).alias("__k"))
    cells = counts.groupBy(*steps).agg(F.sum("__k").alias("__k")).withColumn("__curve", curve(F.array(*steps)))
    upto = Window.orderBy("__curve").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select(*steps, "__curve", F.coalesce(F.sum("__k").over(upto), F.lit(0)).alias("__cells_before"), F.sum("__k").over(whole).alias("__total"))
    inside = Window.partitionBy(*steps).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select(*steps, "__part", F.coalesce(F.sum("__k").over(inside), F.lit(0)).alias("__parts_before"))
    place = F.row_number().over(Window.partitionBy(*steps, "__part").orderBy("text_crc32", "doc_id"))
    ranked = (rows.join(parts, [*steps, "__part"]).join(F.broadcast(cells), steps)
              .withColumn("__rank", F.col("__cells_before") + F.col("__parts_before") + place - 1)
              .withColumn("shard", F.expr(f"int(__rank * {shards} div __total)"))
              .withColumn("slot", F.expr(f"__rank - (shard * __total + {shards - 1}) div {shards}")))
    return ranked.drop(*steps, "__part", "__cells_before", "__parts_before", "__total", "__rank")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, size (UTF-8 bytes plus 16) and text_crc32; a null text counts as empty."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", "lang", "source", (F.octet_length(data) + 16).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"))


def shards_of(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve of every row of ``docs`` (doc_id, text, lang, source).

    The curve runs over language, source and size, so a shard spans few values of
    each. Law ``rows``: counts differ by one at most. Nulls are steps of their own
    kind (step 0); repeated rows get slots of their own.
    """
    dims = [category(F.col("lang")), category(F.col("source")), magnitude(F.col("size"))]
    placed = along_curve(described(docs), dims, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("__curve").alias("curve"))


def footprints(docs: DataFrame, shards: int = 40) -> DataFrame:
    """What a reader needs to skip shards: row count, size range, languages and sources of each."""
    dims = [category(F.col("lang")), category(F.col("source")), magnitude(F.col("size"))]
    placed = along_curve(described(docs), dims, shards)
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
                                       F.approx_count_distinct("lang").alias("n_langs"), F.approx_count_distinct("source").alias("n_sources"))
