"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from restartlab.llm.common import MIX, apart, components, hashed_words, let_go, lowered, mix64, parts, perhaps_in, stored

SLOTS = 5  # slots of a chunk; one of them may differ


def chunks_for(percent: int, miss: float = 1e-6) -> int:
    """Chunks needed so that a pair at the threshold has a chunk with at most one error, but for ``miss``."""
    j = percent / 100
    bad = 1 - j ** SLOTS - SLOTS * (1 - j) * j ** (SLOTS - 1)
    return max(1, math.ceil(math.log(miss) / math.log(bad))) if bad > 0 else 1


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of k-word shingles; fewer words: the whole sequence; none: empty."""
    out = []
    words, counts = hashed_words([lowered(t) for t in texts])
    for w in np.split(words, np.cumsum(counts)[:-1]):
        size = min(k, len(w))
        if not size:
            out.append(w)
            continue
        h = np.full(len(w) - size + 1, size, np.uint64)
        for i in range(size):
            h = mix64(h * MIX + w[i:len(w) - size + 1 + i])
        out.append(np.unique(h))
    return out


def _signed(k: int, chunks: int):
    slots = chunks * SLOTS
    turns = np.random.Generator(np.random.PCG64(20240531)).integers(1, 2**63, slots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    tags = np.arange(1, slots + 1, dtype=np.uint64) * MIX

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(batches, "text"):
            sets = shingle_sets(part["text"].tolist(), k)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys = [np.zeros(0, np.int64)] * len(sets)
            one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                one[full] = np.add.reduceat(mix64(every), starts)
                two[full] = np.add.reduceat(mix64(every ^ MIX), starts)
                low = np.empty((len(full), slots), np.uint64)
                turned = np.empty_like(every)
                for slot, t in enumerate(turns):
                    low[:, slot] = np.minimum.reduceat(np.multiply(every, t, out=turned), starts)
                bits = (mix64(low) >> np.uint64(48)).reshape(len(full), chunks, SLOTS)
                found = np.empty((len(full), chunks, SLOTS), np.uint64)
                for gone in range(SLOTS):
                    packed = np.zeros((len(full), chunks), np.uint64)
                    for s in range(SLOTS):
                        if s != gone:
                            packed = (packed << np.uint64(16)) | bits[:, :, s]
                    found[:, :, gone] = packed
                table = mix64(mix64(found.reshape(len(full), slots)) + tags).view(np.int64)
                for row, i in enumerate(full):
                    keys[i] = table[row]
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_shingles": sizes, "h1": one.view(np.int64), "h2": two.view(np.int64), "keys": keys})

    return run


def signatures(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """Per row: set size, 128-bit digest of the set, and the masked chunk keys of its signature.

    The signature has chunks x 5 slots of 16 bits. Two signatures that differ in
    at most 2 * chunks - 1 slots have a chunk with at most one error (pigeonhole),
    so they share one of the keys made by leaving out each slot of each chunk in turn.
    """
    return docs.select("doc_id", "text").mapInPandas(
        _signed(shingle, chunks_for(percent)), "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, keys array<bigint>")


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(batches, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(part["text"].tolist(), k)]
            yield pd.DataFrame({"doc_id": part["doc_id"], "family": part["family"], "blocks": part["blocks"], "grams": sets})

    return run


def _linked(percent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links of one pair of blocks, from full sets; a spanning forest of them is enough."""
        rows = rows.sort_values(["block", "doc_id"], kind="stable")
        ids, sets = rows["doc_id"].to_numpy(), [np.asarray(s, np.int64) for s in rows["grams"]]
        left = rows["block"].to_numpy() == key[1]
        sizes = np.array([len(s) for s in sets], np.int64)
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, column, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], column[shared]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
        a, b = (np.flatnonzero(left), np.flatnonzero(~left)) if key[1] != key[2] else (np.arange(len(ids)),) * 2
        common, grid = np.zeros((len(a), len(b)), np.float32), None
        width = 4096
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, (at, at + width))
            grid = np.zeros((len(ids), width), np.float32)
            grid[owner[lo:hi], column[lo:hi] - at] = 1
            common += grid[a] @ grid[b].T
        both = common.astype(np.int64)
        near = 100 * both >= percent * (sizes[a][:, None] + sizes[b][None, :] - both)
        found, root = [], list(range(len(ids)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(near)):
            x, y = top(a[i]), top(b[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((int(ids[a[i]]), int(ids[b[j]])))
        if len(every) > 100_000:
            del sets, every, owner, column, shared, order, grid, common, both, near
            let_go()
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, block: int = 256, block_grams: int = 400_000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    1. Every text gets a b-bit MinHash signature and masked chunk keys (``signatures``).
    2. Rows with one and the same shingle set form a class, named by its smallest id.
    3. Classes that share keys form families: each class meets the smallest class
       of each of its keys, and the stars are joined to components.
    4. Families are dealt into blocks, and pairs of blocks compare full sets in one
       product of incidence matrices. Links of a block pair leave it as a spanning
       forest, so a family of k classes never emits k * k pairs.
    5. Components of the links give the smallest reachable id.

    Null or wordless texts have an empty set and stay alone. Rows with a null id
    are returned unlinked (component null, kept). Rows that share an id count as
    one node. Ties do not arise: ids and set sizes decide everything.
    """
    signed = stored(signatures(docs, shingle, percent), "signatures")
    digest = ["h1", "h2", "n_shingles"]
    classes = stored(signed.where("n_shingles > 0 and doc_id is not null").groupBy(*digest)
                     .agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys")), "classes")
    keyed = classes.select("node", F.explode("keys").alias("key")).repartition("key")  # one shuffle for heads and stars
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").drop("last")
    stars = keyed.join(heads, "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    families = components(stars)
    families = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct())
    members = stored(families.join(classes.groupBy("node").agg(F.max("n_shingles").alias("n")), "node"), "families")
    plan = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_grams)).alias("blocks"))
    placed = members.join(plan, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("family"), "blocks")
    texts = docs.select("doc_id", "text").where(perhaps_in(members.select("node"), F.col("doc_id")))  # other texts are not shuffled
    sets = texts.join(placed, "doc_id").mapInPandas(_sets(shingle), "doc_id bigint, family bigint, blocks bigint, grams array<bigint>")
    dealt = (sets.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id", "block", "grams"))
    links = dealt.groupBy("family", "lo", "hi").applyInPandas(_linked(percent), "a bigint, b bigint")
    roots = components(links)
    named = classes.select(*digest, "node").join(roots, "node", "left").select(*digest, F.coalesce("root", "node").alias("component_id"))
    return (signed.drop("keys").join(named, digest, "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, one of each group of near-duplicates: the smallest id; of rows that share it, the first by digest of the text.

    All columns of ``docs`` are returned unchanged. Rows with a null id are kept as they are.
    Only rows whose id goes or repeats (and the few that a bit filter cannot tell from them) are shuffled.
    """
    ids = near_duplicates(docs, shingle, percent).where("doc_id is not null").groupBy("doc_id")
    doubtful = stored(ids.agg(F.bool_or("kept").alias("__keep"), F.count(F.lit(1)).alias("n")).where("n > 1 or not __keep")
                      .select(F.col("doc_id").alias("__id"), "__keep"), "doubtful")
    sure, rest = apart(docs, doubtful)
    rest = rest.withColumn("__id", F.col("__row.doc_id").cast("bigint")).join(doubtful, "__id", "left").where("coalesce(__keep, true)")
    first = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64("__row.text"), F.col("__row.text")))
    return sure.select("__row.*").unionByName(rest.withColumn("__first", first).where("__first = 1").select("__row.*"))
