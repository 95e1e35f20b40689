"""Bootstrap over graphs without a row per draw and graph.

A resample of n graphs with replacement gives each graph a multinomial count.
The counts come from a tree: a group's n picks are shared over super-blocks by
one multinomial, a super-block's over its blocks by the next. A block's task
takes its share pick by pick, each a uniform place among the block's graphs, and
counts them; a binomial number per graph and draw would cost several times more.
No row holds more than one level of one branch. Tasks emit one row of weighted
sums per block and draw, so data are shuffled once and only draws x blocks
partial sums move, whatever the number of graphs. The joint distribution is
exactly that of n independent picks, and every metric of a comparison sees the
same draws. Seeds are hashes of (seed, keys, place in the tree), so a recomputed
task repeats its numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from restartlab.functions.ranks import join_sized
from restartlab.session import cut_lineage

BLOCK = 16384
FAN = 512  # blocks of a super-block
CHUNK = 64
PICKS = 16384  # picks counted at a time, few enough for the processor's cache


def _generator(*parts: object) -> np.random.Generator:
    text = "|".join(map(str, parts))
    return np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:16], "little"))


def picked_sums(rng: np.random.Generator, picks: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Column sums of ``picks[i]`` independent uniform picks among the rows of ``values``, one row of sums per draw ``i``."""
    n = len(values)
    sums = np.empty((len(picks), values.shape[1]))
    step = max(1, PICKS // n)
    for start in range(0, len(picks), step):
        part = picks[start:start + step]
        places = rng.integers(n, size=part.sum())
        places += np.repeat(np.arange(len(part)) * n, part)
        counts = np.bincount(places, minlength=len(part) * n).reshape(len(part), n)
        sums[start:start + step] = counts.astype(float) @ values
    return sums


def draw_sums(rows: DataFrame, group: Sequence[str], stratum: Sequence[str], item: str, metrics: Sequence[str],
              draws: int, seed: int, block: int = BLOCK) -> DataFrame:
    """Resampled sums: one row per (group, stratum, draw) with ``size`` and one sum per metric.

    Picks stay inside a stratum. Metrics must be free of nulls.
    """
    alone = not (group or stratum)
    if alone:
        rows, group = rows.withColumn("__all", F.lit(1)), ["__all"]
    keys = [*group, *stratum]
    rows = cut_lineage(rows.select(*keys, item, *metrics))  # read several times below: written once
    sized = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    placed = join_sized(rows, sized, keys, "__n")
    placed = placed.withColumn("__block", F.pmod(F.xxhash64(item), F.greatest(F.lit(1), F.ceil(F.col("__n") / block))).cast("int"))
    over = F.floor(F.col("__block") / FAN).cast("int").alias("__super")
    blocks = (placed.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__k")).groupBy(*keys, over)
              .agg(F.sum("__k").alias("__n"), F.array_sort(F.collect_list(F.struct("__block", "__k"))).alias("__parts")))
    supers = blocks.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.array_sort(F.collect_list(F.struct(F.col("__super").alias("__block"), F.col("__n").alias("__k")))).alias("__parts"))
    types = dict(rows.select(*keys).dtypes)
    shape = "".join(f"{k} {types[k]}, " for k in keys)

    def share(level: str, above: Sequence[str], below: str):
        """Picks of one branch shared over its parts, CHUNK draws at a time."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    weight = np.array([b["__k"] for b in row["__parts"]], dtype=float)
                    rng = _generator(seed, level, *[row[k] for k in (*keys, *above)], row["__chunk"])
                    counts = rng.multinomial(np.asarray(row["__picks"], dtype=np.int64), weight / weight.sum())
                    out = pd.DataFrame({below: [b["__block"] for b in row["__parts"]], "__picks": counts.T.tolist()})
                    for k in (*keys, "__chunk"):
                        out[k] = row[k]
                    yield out[[*keys, below, "__chunk", "__picks"]]

        return run

    chunks = (draws - 1) // CHUNK + 1  # also the number of tasks: branches are small but costly
    numbers = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    width = F.least(F.lit(CHUNK), F.lit(draws) - F.col("__chunk") * CHUNK)
    first = supers.withColumn("__chunk", numbers).withColumn("__picks", F.transform(F.sequence(F.lit(1), width), lambda _: F.col("__n"))).drop("__n").repartition(chunks, *keys, "__chunk")
    given = first.mapInPandas(share("supers", (), "__super"), f"{shape}__super int, __chunk int, __picks array<bigint>")
    second = given.join(blocks.drop("__n"), [*keys, "__super"]).repartition(chunks, *keys, "__super", "__chunk")
    shares = second.mapInPandas(share("blocks", ("__super",), "__block"), f"{shape}__block int, __chunk int, __picks array<bigint>")

    def resample(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(item, kind="stable")
        values = left[list(metrics)].to_numpy(dtype=float)
        picks = np.concatenate([np.asarray(p, dtype=np.int64) for p in right.sort_values("__chunk")["__picks"]])
        head = [left[k].iloc[0] for k in keys]
        rng = _generator(seed, "rows", *head, left["__block"].iloc[0])
        out = pd.DataFrame(picked_sums(rng, picks, values), columns=[f"sum_{m}" for m in metrics])
        out.insert(0, "draw", np.arange(len(picks)))
        for k, value in zip(keys, head):
            out[k] = value
        return out[[*keys, "draw", *[f"sum_{m}" for m in metrics]]]

    schema = shape + "draw bigint, " + ", ".join(f"sum_{m} double" for m in metrics)
    parts = placed.groupBy(*keys, "__block").cogroup(shares.groupBy(*keys, "__block")).applyInPandas(resample, schema)
    summed = parts.groupBy(*keys, "draw").agg(*[F.sum(f"sum_{m}").alias(f"sum_{m}") for m in metrics])
    sized = sized.withColumnRenamed("__n", "size")
    return summed.join(sized, keys).drop("__all")


def interval(draws: DataFrame, keys: Sequence[str], statistic: str, level: float = 0.95) -> DataFrame:
    """Percentile interval over the draws of each group; a group has as many rows as there are draws."""
    tail = (1 - level) / 2
    q = F.percentile(statistic, [tail, 1 - tail])
    return draws.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
