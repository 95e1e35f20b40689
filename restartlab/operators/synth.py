"""Seeded random graph tables: every draw is built inside its own row from hashes of its seed.

A draw has at most 24 vertices, so its pair grid, stub list and edge array are
bounded; no shuffle is needed before connectivity and quota checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from restartlab.functions.binding import let
from restartlab.functions.ranks import bucketed_row_number
from restartlab.functions.scores import unit_uniform
from restartlab.operators.graphs import class_representatives
from restartlab.session import cut_lineage

EDGE = "array<struct<u:bigint,v:bigint>>"
# fixed value: attachments per new vertex for each target degree of the growth family
ATTACHMENTS = {3: 2, 5: 3}
INSIDE_RATIO = 3  # block model: inside to outside edge probability


def _u(*parts: Column) -> Column:
    return unit_uniform(F.col("seed").cast("string"), *[p.cast("string") for p in parts])


def _edge(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).cast("bigint").alias("u"), F.greatest(a, b).cast("bigint").alias("v"))


def _pairs() -> Column:
    n = F.col("n")
    return F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 2), lambda u: F.transform(F.sequence(u + 1, n - 1), lambda v: _edge(u, v))))


def independent_pairs() -> Column:
    """Every pair with probability k / (n - 1)."""
    p = F.col("k") / (F.col("n") - 1)
    return F.filter(_pairs(), lambda e: _u(F.lit("er"), e["u"], e["v"]) < p)


def two_blocks() -> Column:
    """Two equal blocks; inside pairs are three times as likely as outside pairs."""
    out = F.col("k") / (2 * F.col("n") - 3)
    half = F.floor(F.col("n") / 2)
    return F.filter(_pairs(), lambda e: _u(F.lit("sbm"), e["u"], e["v"]) < F.when((e["u"] < half) == (e["v"] < half), INSIDE_RATIO * out).otherwise(out))


def near_points() -> Column:
    """Points in the unit square, joined below the cell's radius."""
    def within(points: Column) -> Column:
        return F.filter(_pairs(), lambda e: F.hypot(
            F.get(points, e["u"].cast("int"))["x"] - F.get(points, e["v"].cast("int"))["x"],
            F.get(points, e["u"].cast("int"))["y"] - F.get(points, e["v"].cast("int"))["y"]) < F.col("radius"))

    vertices = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)
    return let(F.transform(vertices, lambda v: F.struct(_u(F.lit("x"), v).alias("x"), _u(F.lit("y"), v).alias("y"))), within)


def paired_stubs() -> Column:
    """k stubs per vertex in hashed order, paired off; loops or repeats spoil the draw (null)."""
    stubs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") * F.col("k") - 1),
                        lambda s: F.struct(_u(F.lit("stub"), s).alias("h"), F.floor(s / F.col("k")).alias("v")))
    order = F.transform(F.array_sort(stubs), lambda s: s["v"])

    def pair_up(vs: Column) -> Column:
        return F.transform(F.sequence(F.lit(1).cast("bigint"), F.floor(F.size(vs) / 2).cast("bigint")),
                           lambda i: _edge(F.element_at(vs, (2 * i - 1).cast("int")), F.element_at(vs, (2 * i).cast("int"))))

    def checked(es: Column) -> Column:
        fine = (F.size(F.array_distinct(es)) == F.size(es)) & ~F.exists(es, lambda e: e["u"] == e["v"])
        return F.when(fine, es)

    return let(let(order, pair_up), checked)


def rewired_ring() -> Column:
    """Ring lattice with k neighbours; each edge moves its far end with the cell's probability.

    A move onto the vertex itself or onto an existing edge is not made.
    """
    n, half = F.col("n"), F.floor(F.col("k") / 2)
    ring = F.flatten(F.transform(F.sequence(F.lit(1).cast("bigint"), half), lambda j: F.transform(
        F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.struct(i.alias("i"), ((i + j) % n).alias("t")))))
    start = F.transform(ring, lambda r: _edge(r["i"], r["t"]))

    # the hashes of an edge are taken once, before the moves
    moves = F.transform(ring, lambda r: F.struct(r["i"].alias("i"), _edge(r["i"], r["t"]).alias("old"), _u(F.lit("rewire"), r["i"], r["t"]).alias("chance"),
                                                 F.floor(_u(F.lit("target"), r["i"], r["t"]) * n).alias("far")))

    def move(edges: Column, r: Column) -> Column:
        new = _edge(r["i"], r["far"])
        go = (r["chance"] < F.col("rewiring")) & (r["far"] != r["i"]) & ~F.array_contains(edges, new)
        return F.when(go, F.concat(F.array_remove(edges, r["old"]), F.array(new))).otherwise(edges)

    return F.aggregate(moves, start, move)


def growing() -> Column:
    """Star on m + 1 vertices, then each new vertex joins m distinct ones in proportion to their degree.

    Stubs in hashed order with repeats dropped give exactly such a choice.
    """
    m = (F.when(F.col("k") == 3, F.lit(ATTACHMENTS[3])).when(F.col("k") == 5, F.lit(ATTACHMENTS[5]))
         .otherwise(F.raise_error(F.concat(F.lit("no attachment number for degree "), F.col("k").cast("string"))).cast("int")).cast("bigint"))
    star = F.transform(F.sequence(F.lit(1).cast("bigint"), m), lambda v: _edge(F.lit(0).cast("bigint"), v))

    def join_vertex(edges: Column, v: Column) -> Column:
        stubs = F.flatten(F.transform(edges, lambda e: F.array(e["u"], e["v"])))
        keyed = F.array_sort(F.transform(stubs, lambda s, i: F.struct(_u(F.lit("grow"), v, i).alias("h"), s.alias("s"))))
        targets = F.slice(F.array_distinct(F.transform(keyed, lambda s: s["s"])), F.lit(1), m.cast("int"))
        return F.concat(edges, F.transform(targets, lambda t: _edge(t, v)))

    return F.aggregate(F.sequence(m + 1, F.col("n") - 1), star, join_vertex)


def connected(edges: Column) -> Column:
    """Whether all n vertices are reached from vertex 0, by bit masks inside the row."""
    def bit(x: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), x.cast("int"))

    def spread(mask: Column, _: Column) -> Column:
        return F.aggregate(edges, mask, lambda m, e: F.when(m.bitwiseAND(bit(e["u"]).bitwiseOR(bit(e["v"]))) != 0,
                                                           m.bitwiseOR(bit(e["u"])).bitwiseOR(bit(e["v"]))).otherwise(m))

    reach = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("n")), F.lit(1).cast("bigint"), spread)
    return reach == bit(F.col("n")) - 1


def draw_graphs(draws: DataFrame) -> DataFrame:
    """Edge array of every draw (seed, n, generator, k, radius, rewiring) and its status."""
    kinds = {"er": independent_pairs(), "sbm": two_blocks(), "rgg": near_points(), "regular": paired_stubs(),
             "ws": rewired_ring(), "ba": growing()}
    edges = None
    for name, build in kinds.items():
        hit = F.col("generator") == name
        edges = F.when(hit, build) if edges is None else edges.when(hit, build)
    drawn = draws.withColumn("edges", edges.cast(EDGE))
    status = (F.when(F.col("edges").isNull(), "generator_error").when(~connected(F.col("edges")), "rejected_disconnected")
              .otherwise("connected"))
    return drawn.withColumns({"status": status, "num_edges": F.size("edges").cast("bigint")})


def fill_quotas(drawn: DataFrame, quota: int) -> DataFrame:
    """Draw log: connected draws lose isomorphic copies of earlier ones, then each cell keeps its first ``quota``."""
    good = drawn.where("status = 'connected'")
    classes = cut_lineage(class_representatives(good.select("graph_id", "n", "edges")))
    owners = good.join(classes, "graph_id").where("graph_id = representative").select("graph_id", "cell")
    ranked = bucketed_row_number(owners, ["cell"], F.floor(F.col("graph_id") / 1000), [F.col("graph_id")], "rank").select("graph_id", "rank")
    log = drawn.join(classes, "graph_id", "left").join(ranked, "graph_id", "left")
    status = (F.when(F.col("status") != "connected", F.col("status")).when(F.col("rank").isNull(), "duplicate")
              .when(F.col("rank") <= quota, "accepted").otherwise("beyond_quota"))
    return log.select("graph_id", "cell", "generator", "num_edges", "representative", status.alias("status"))
