"""Exact ranks and quantiles that never put a whole hot group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bucketed_row_number(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                        name: str) -> DataFrame:
    """row_number() over (partition by keys order by order), in two levels.

    ``bucket`` must rise with the order. Rows are numbered inside (keys, bucket)
    and shifted by the number of rows in earlier buckets, so a key with a third
    of all rows is spread over its buckets. Only bucket counts meet in one task.
    """
    keys = list(keys)
    tagged = df.withColumn("__bucket", bucket)
    counts = tagged.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__k"))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    inside = W.partitionBy(*keys, "__bucket").orderBy(*order)
    return (tagged.join(offsets, [*keys, "__bucket"])
            .withColumn(name, (F.col("__before") + F.row_number().over(inside)).cast("bigint"))
            .drop("__bucket", "__before"))


def join_sized(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of their group, from a table with one row per group and its row count in ``size``.

    Groups with more than 1 / ``share`` of all rows are fewer than ``share``: they are
    broadcast, so the rows of a hot group stay where they are; the others are shuffled.
    """
    keys = list(keys)
    if not keys:
        return rows.crossJoin(F.broadcast(groups))  # a single row
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = F.broadcast(groups.where(F.col(size) > total // share))
    light = groups.where(F.col(size) <= total // share)
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    accuracy: int = 10000) -> DataFrame:
    """Linear-interpolated quantiles per key: one row per (keys, prob).

    A mergeable sketch brackets every wanted rank; its rank error is at most
    count/accuracy, so the exact order statistics lie inside the bracket. Rows
    below a bracket are only counted, rows inside it are first reduced to
    distinct values with counts. No group is ever collected. Below 10 * accuracy
    rows a rank margin can be less than one row, so there the bracket is the whole
    group; results are exact on both sides (tested with a small accuracy).
    """
    if not keys:
        return exact_quantiles(df.withColumn("__all", F.lit(1)), ["__all"], value, probs, accuracy).drop("__all")
    keys = list(keys)
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    margin = 4.0 / accuracy
    small = F.col("__n") < 10 * accuracy  # few rows: the bracket is the whole group
    wanted = [F.struct(F.lit(float(p)).alias("prob"), F.lit(max(0.0, p - margin)).alias("lo_p"),
                       F.lit(min(1.0, p + margin)).alias("hi_p")) for p in probs]
    lo = F.percentile_approx("__v", [max(0.0, p - margin) for p in probs], accuracy)
    hi = F.percentile_approx("__v", [min(1.0, p + margin) for p in probs], accuracy)
    brackets = (data.groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("__n"), lo.alias("__lo"), hi.alias("__hi"),
                     F.min("__v").alias("__min"), F.max("__v").alias("__max"))
                .select(*keys, "__n", "__min", "__max", F.posexplode(F.array(*wanted)).alias("__i", "__w"), "__lo", "__hi")
                .select(*keys, "__n", F.col("__w.prob").alias("prob"),
                        F.when(small | (F.col("__w.lo_p") <= 0), F.col("__min")).otherwise(F.col("__lo")[F.col("__i")]).alias("__lo"),
                        F.when(small | (F.col("__w.hi_p") >= 1), F.col("__max")).otherwise(F.col("__hi")[F.col("__i")]).alias("__hi")))
    joined = data.join(brackets, keys)
    group = [*keys, "prob"]
    counted = (joined.where(F.col("__v") <= F.col("__hi"))
               .withColumn("__x", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")))
               .groupBy(*group, "__n", "__x").agg(F.count(F.lit(1)).alias("__c")))
    upto = (W.partitionBy(*group).orderBy(F.col("__x").asc_nulls_first())
            .rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = (counted.withColumn("__cum", F.sum("__c").over(upto))
              .withColumn("__pos", F.col("prob") * (F.col("__n") - 1))
              .where(F.col("__x").isNotNull()))
    low = F.floor("__pos") + 1
    high = F.ceil("__pos") + 1
    return (ranked.groupBy(*group)
            .agg(F.min(F.when(F.col("__cum") >= low, F.col("__x"))).alias("__a"),
                 F.min(F.when(F.col("__cum") >= high, F.col("__x"))).alias("__b"),
                 F.max(F.col("__pos") - F.floor("__pos")).alias("__f"))
            .select(*group, (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")).alias("quantile")))
