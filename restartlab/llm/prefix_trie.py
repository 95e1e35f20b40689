"""Prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of a few turns. Conversations are grouped by the
digests of their successive blocks first; turn boundaries inside a block are
refined only where siblings diverge, and only on one row per distinct block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from restartlab.llm.common import split_join, stored

TURNS = 256  # turn numbers that share a bucket while turns are ranked
SUPER = 256  # blocks that share a bucket while digests and sums run along a conversation
IDS = 512  # ids packed into one row before a node's ids are hashed in order
NODE = ["depth", "k1", "k2"]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two 64-bit digests of role and text, and the text's code points; texts go no further than this."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("again"), text, role).alias("t2"), F.char_length(text).cast("bigint").alias("points"))


def borrowed(conv_id: Column, every: int = 100, most: int = 6) -> tuple[Column, Column]:
    """How many turns a conversation takes over (by crc32 of its id), and from which one: the first of its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % most, conv_id - conv_id % every


def sequences(turns: DataFrame, lend: tuple[Column, Column] | None, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Ranked turns (conv_id, p from 1, t1, t2, points, size) of every conversation, and one row (conv_id, size) for each.

    Turns are ranked inside buckets of turn numbers and shifted by the buckets
    before, so one conversation with a third of all rows is spread. With ``lend``
    (turns taken over, at most ``most``, and from whom) the first turns of
    another conversation replace as many of its own.
    """
    bucket = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(0)).alias("b"),
                      F.when(F.col("turn").isNull(), F.shiftright("t1", 58)).otherwise(F.lit(0)).alias("c"))
    turns = turns.withColumn("bucket", bucket)
    counts = turns.groupBy("conv_id", "bucket").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(W.partitionBy("conv_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    h, base = lend or (F.lit(0), F.col("conv_id"))
    totals = counts.groupBy("conv_id").agg(F.sum("k").alias("n"))
    plan = (totals.withColumn("h", h.cast("bigint")).withColumn("base", base)
            .join(totals.select(F.col("conv_id").alias("base"), F.col("n").alias("other")), "base", "left")
            .withColumn("lead", F.least("h", F.coalesce("other", F.lit(0))))
            .select("conv_id", "base", "h", "lead", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    plan = stored(plan, "conversations")
    shifts = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("k").join(plan.drop("base"), "conv_id")
    inside = W.partitionBy("conv_id", "bucket").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2", "points")
    ranked = (turns.join(shifts, ["conv_id", "bucket"]).withColumn("pos", F.col("before") + F.row_number().over(inside))
              .select("conv_id", "pos", "t1", "t2", "points", "h", "lead", "size"))
    if lend is None:
        return ranked.withColumnRenamed("pos", "p").drop("h", "lead"), plan.select("conv_id", "size")
    ranked = stored(ranked, "ranked")
    own = ranked.where("pos > h").withColumn("p", F.col("lead") + F.col("pos") - F.col("h"))
    heads = ranked.where(F.col("pos") <= most).select(F.col("conv_id").alias("base"), F.col("pos").alias("p"), "t1", "t2", "points")
    lent = plan.where("lead > 0").join(heads, "base").where("p <= lead")
    columns = ["conv_id", "p", "t1", "t2", "points", "size"]
    return own.select(columns).unionByName(lent.select(columns)), plan.select("conv_id", "size")


def block_rows(turns: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: turns, digests of all turns before it (p1, p2) and the node that it ends in.

    The digest before a block is the exclusive-or of the digests of the (full)
    blocks before, each hashed with its place, so it runs in two levels as well.
    """
    made = (turns.groupBy("conv_id", F.floor((F.col("p") - 1) / block).alias("j"))
            .agg(F.array_sort(F.collect_list(F.struct("p", "t1", "t2", "points"))).alias("turns"), F.max("size").alias("size"))
            .select("conv_id", "j", "size", F.col("turns.t1").alias("a1"), F.col("turns.t2").alias("a2"), F.col("turns.points").alias("points"))
            .withColumn("m", F.size("a1")).withColumn("s", F.floor(F.col("j") / SUPER))
            .withColumn("d1", F.when(F.col("m") == block, F.xxhash64("j", "a1", "a2"))).withColumn("d2", F.when(F.col("m") == block, F.xxhash64(F.lit(7), "a2", "j", "a1"))))
    up = W.partitionBy("conv_id").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    totals = made.groupBy("conv_id", "s").agg(F.bit_xor("d1").alias("x1"), F.bit_xor("d2").alias("x2"))
    prior = totals.select("conv_id", "s", F.bit_xor("x1").over(up).alias("x1"), F.bit_xor("x2").over(up).alias("x2")).where("s > 0")
    inside = W.partitionBy("conv_id", "s").orderBy("j").rowsBetween(W.unboundedPreceding, -1)
    made = made.join(prior, ["conv_id", "s"], "left")
    for i in "12":
        made = made.withColumn(f"p{i}", F.coalesce(f"x{i}", F.lit(0)).bitwiseXOR(F.coalesce(F.bit_xor(f"d{i}").over(inside), F.lit(0))))
    k1, k2 = _key(F.col("m"), block)
    return made.select("conv_id", "j", "s", "size", "m", "p1", "p2", "d1", "d2", "a1", "a2", "points",
                       (F.col("j") * block + F.col("m")).alias("depth"), k1.alias("k1"), k2.alias("k2"))


def _key(i: Column, block: int) -> tuple[Column, Column]:
    """Digests of the node after the i-th turn of a block row."""
    k1 = F.xxhash64("p1", "p2", "j", F.slice("a1", F.lit(1), i))
    k2 = F.xxhash64("p2", "p1", F.slice("a2", F.lit(1), i), "j")
    return (F.when(i == block, F.col("p1").bitwiseXOR(F.col("d1"))).otherwise(k1),
            F.when(i == block, F.col("p2").bitwiseXOR(F.col("d2"))).otherwise(k2))


def _turn_nodes(groups: DataFrame, block: int, upto: Column, keep: list[str]) -> DataFrame:
    """The nodes after each of the first ``upto`` turns of block rows, with their parents and the points of the last text."""
    def node(i: Column) -> Column:
        (k1, k2), (u1, u2) = _key(i, block), _key(i - 1, block)
        first = i == 1
        return F.struct((F.col("j") * block + i).alias("depth"), k1.alias("k1"), k2.alias("k2"), F.when(first, F.col("p1")).otherwise(u1).alias("u1"),
                        F.when(first, F.col("p2")).otherwise(u2).alias("u2"), F.element_at("points", i.cast("int")).alias("points"))
    steps = F.transform(F.sequence(F.lit(1), upto.cast("int")), node)
    return groups.select(*keep, F.explode(steps).alias("node")).select(*keep, "node.*")


def _ends(rows: DataFrame) -> DataFrame:
    """depth, k1, k2, sha256 of the ids that end in a node, ascending and joined by commas.

    Ids are packed before the shuffle that brings a node's rows together in
    order; there the hash runs over the stream and never holds the ids.
    """
    packed = (rows.groupBy(*NODE, F.floor(F.col("conv_id") / IDS).alias("part"))
              .agg(F.array_sort(F.collect_list("conv_id")).alias("ids")).select(*NODE, "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, digest, out = None, None, []
        for batch in batches:
            for *node, ids in zip(batch["depth"], batch["k1"], batch["k2"], batch["ids"]):
                if node == last:
                    digest.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, digest.hexdigest()))
                last, digest = node, hashlib.sha256(ids.encode())
            if out:
                yield pd.DataFrame(out, columns=[*NODE, "sha"])
                out = []
        if last is not None:
            yield pd.DataFrame([(*last, digest.hexdigest())], columns=[*NODE, "sha"])

    ordered = packed.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids")
    return ordered.mapInPandas(run, "depth bigint, k1 bigint, k2 bigint, sha string")


def prefix_trie(conversations: DataFrame, lend: tuple[Column, Column] | None = None, block: int = 4) -> DataFrame:
    """One row per distinct sequence of first turns of ``conversations`` (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256, as the root is the textless node of
    depth 0. ``lend`` (see ``borrowed``) rebuilds conversations first.

    1. Rows become digests; turns are ranked and gathered into blocks of ``block`` turns.
    2. Block rows are grouped by the digest of all turns to their end. A group
       without siblings (no other group starts where it starts) gives the nodes
       of its turns at once; groups with siblings are refined turn by turn.
    3. A node belongs to its smallest member. That conversation's nodes are a
       run to its end, summed along the run; what a run sums to reaches the
       nodes it shares with smaller conversations, again block by block.

    Rows with a null conv_id belong to no conversation and are left out; a null
    turn comes first, null role and text are empty. Turns with one number are
    ordered by digest, repeated rows are turns of their own. No rows: no root.
    Other columns are not read. Sequences are told apart by 128 bits.
    """
    turns, sizes = sequences(stored(turn_digests(conversations), "turns"), lend)
    blocks = stored(block_rows(turns, block), "blocks")
    shape = F.struct("j", "m", "p1", "p2", "d1", "d2", "a1", "a2", "points").alias("shape")
    groups = (blocks.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), F.any_value(shape).alias("shape"))
              .select(*NODE, "n", "conv", "shape.*"))
    groups = stored(groups, "groups")
    alone = (groups.groupBy("j", "p1", "p2").agg(F.count(F.lit(1)).alias("k"), *[F.min(c).alias(c) for c in NODE])
             .where("k = 1").select(*NODE, F.lit(True).alias("alone")))
    told = groups.join(alone, NODE, "left").drop(*NODE)
    columns = [*NODE, "u1", "u2", "points", "n", "conv"]
    even = _turn_nodes(told.where("alone"), block, F.col("m"), ["n", "conv"])
    split = (_turn_nodes(told.where("alone is null"), block, F.col("m"), ["n", "conv"]).groupBy(*NODE)
             .agg(F.max("u1").alias("u1"), F.max("u2").alias("u2"), F.max("points").alias("points"), F.sum("n").alias("n"), F.min("conv").alias("conv")))
    zero = F.lit(0).cast("bigint")
    root = (sizes.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")).where("n > 0")
            .select(*[zero.alias(c) for c in NODE], F.lit(None).cast("bigint").alias("u1"), F.lit(None).cast("bigint").alias("u2"), zero.alias("points"), "n", "conv"))
    nodes = stored(even.select(columns).unionByName(split.select(columns)).unionByName(root.select(columns)), "nodes")

    born = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"), F.lit(1).alias("child"))
    kept = [c for c in columns if c not in NODE]
    counted = (nodes.withColumn("child", F.lit(0)).unionByName(born, allowMissingColumns=True).groupBy(*NODE)
               .agg(*[F.max(c).alias(c) for c in kept], F.sum("child").alias("n_children")))
    counted = counted.withColumn("saved", (F.col("n") - 1) * F.col("points")).withColumn("leaf", (F.col("n_children") == 0).cast("bigint"))
    counted = stored(counted, "counted")

    # along the run of each smallest member, from its end; in two levels
    counted = counted.withColumn("u", F.floor(F.col("depth") / (block * SUPER)))
    runs = counted.groupBy("conv", "u").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    down = W.partitionBy("conv").orderBy(F.desc("u")).rowsBetween(W.unboundedPreceding, -1)
    later = runs.select("conv", "u", F.sum("saved").over(down).alias("more_saved"), F.sum("leaf").over(down).alias("more_leaf")).where("more_leaf is not null")
    inside = W.partitionBy("conv", "u").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = counted.join(later, ["conv", "u"], "left").select(
        *NODE, *kept, "n_children",
        (F.sum("saved").over(inside) + F.coalesce("more_saved", F.lit(0))).alias("saved"), (F.sum("leaf").over(inside) + F.coalesce("more_leaf", F.lit(0))).alias("leaf"))

    # what runs give to the nodes above their first own node
    owners = counted.groupBy("conv").agg(F.min("depth").alias("first"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    wide = (owners.where("first > 1").withColumn("s", F.explode(F.sequence(zero, F.floor((F.col("first") - 2) / (block * SUPER)))))
            .withColumnRenamed("conv", "conv_id"))
    shared = (blocks.join(wide, ["conv_id", "s"]).where(F.col("j") * block + 1 < F.col("first"))
              .withColumn("upto", F.least("m", F.col("first") - 1 - F.col("j") * block))
              .groupBy(*NODE, "upto").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.any_value(shape).alias("shape")).select("upto", "saved", "leaf", "shape.*"))
    shared = _turn_nodes(shared, block, F.col("upto"), ["saved", "leaf"]).select(*NODE, "saved", "leaf")
    above = owners.where("first > 0").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")).where("leaf is not null")
    above = above.select(*[zero.alias(c) for c in NODE], "saved", "leaf")

    last = blocks.where("depth = size").select(*NODE, "conv_id").unionByName(sizes.where("size = 0").select(*[zero.alias(c) for c in NODE], "conv_id"))
    facts = summed
    for more in (shared, above, _ends(last)):
        facts = facts.unionByName(more, allowMissingColumns=True)
    whole = facts.groupBy(*NODE).agg(*[F.max(c).alias(c) for c in (*kept, "n_children", "sha")], F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    whole = stored(whole.withColumn("parent_depth", F.col("depth") - 1), "trie")

    parents = counted.where("n_children > 0").select(F.col("depth").alias("parent_depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"),
                                                     F.col("conv").alias("parent_conv_id"), "n_children")
    below = split_join(whole.where("depth > 0"), parents.withColumnRenamed("n_children", "__rows"), ["parent_depth", "u1", "u2"], "__rows")
    every = below.unionByName(whole.where("depth = 0"), allowMissingColumns=True)
    none = hashlib.sha256(b"").hexdigest()
    return every.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("sha", F.lit(none)).alias("ends_sha256"))
