"""Pairwise matches consolidated into groups, by low-diameter decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import Scratch, filled, lookup

#: Rate of the exponential shifts. Their mean, its inverse, is well above GROWTH steps, so few edges end up between clusters.
RATE = 0.1
#: How far a cluster grows in one level, at the first level and at the later ones.
FIRST_GROWTH, GROWTH = 1, 2
#: Different words with the same 64-bit hash make the hashing start anew with another seed, at most so often.
SEEDS = 8


def _shift(vertex: Column, level: int) -> Column:
    """The head start of a vertex, exponentially distributed; the same whenever it is computed."""
    uniform = (F.shiftrightunsigned(F.xxhash64(vertex, F.lit(level)), 11).cast("double") + 1) * F.lit(2.0**-53)
    return -F.log(uniform) / F.lit(RATE)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("w")))


def _reach(messages: DataFrame, level: int, *more: Column) -> DataFrame:
    """First step of growth: each vertex joins the neighbour with the largest head start, one step later, or starts itself.

    Head starts are computed from ids, so no join is needed; combining before the shuffle leaves one row a vertex and task.
    """
    arrives = F.when(F.col("u") == F.col("w"), _shift(F.col("w"), level)).otherwise(_shift(F.col("w"), level) - 1)
    best = messages.withColumn("arrives", arrives).groupBy("u").agg(
        F.max_by("w", "arrives").alias("w"), F.max("arrives").alias("arrives"), F.count(F.lit(1)).alias("n"), *more
    )
    own = _shift(F.col("u"), level) >= F.col("arrives")
    return best.withColumn("own", F.when(own, F.col("u")).otherwise(F.col("w"))).drop("w", "arrives")


def _clusters(edges: DataFrame, n_edges: int, level: int, scratch: Scratch) -> DataFrame:
    """(u, own): the centre of each vertex's cluster after GROWTH steps."""
    ways = _both_ways(edges)
    near = scratch.write(_reach(ways, level), "near")
    for k in range(2, GROWTH + 1):
        arrives = _shift(F.col("own"), level) - F.when(F.col("own") == F.col("u"), 0).otherwise(k - 1)
        valued = near.withColumn("arrives", arrives)
        known = valued.select(F.col("u").alias("w"), "own", "arrives", "n")
        told = lookup(ways, known, "w", "n", 2 * n_edges).select("u", "own", (F.col("arrives") - 1).alias("arrives"))
        grown = told.unionByName(valued.select("u", "own", "arrives")).groupBy("u").agg(
            F.max_by("own", "arrives").alias("own"), F.count(F.lit(1)).alias("n")
        ).withColumn("n", F.col("n") - 1)
        further = scratch.write(grown, "near")
        scratch.drop(near)
        near = further
    return near


def _contract(edges: DataFrame, clusters: DataFrame, n_edges: int) -> DataFrame:
    """The distinct edges between clusters."""
    to = clusters.select("u", "own", "n")
    one = lookup(edges, to.select(F.col("u").alias("a"), F.col("own").alias("x"), "n"), "a", "n", n_edges)
    two = lookup(one, to.select(F.col("u").alias("b"), F.col("own").alias("y"), "n"), "b", "n", n_edges)
    return two.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def consolidate(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, group_id) for every row: the smallest key of all rows linked to it through shared words, directly or not.

    Low-diameter decomposition: every vertex (word) gets an exponentially distributed head start; clusters grow from the
    vertices with the largest ones over a bounded number of steps and every vertex falls to the cluster that reaches it first.
    Clusters contract to super-vertices, the distinct edges between different clusters are the next level's graph, and the
    assignments of all levels are composed from the last to the first. Hubs don't slow a task down: growth aggregates before its
    shuffle, and joins take vertices with more than one part in 256 of the edges by broadcast (at most 256 of them).

    Words are vertices by a 64-bit hash; a second hash shows any two different words that share the first, upon which the
    whole graph is hashed anew with another seed. Null and empty words link nothing; a row without any word is its own group;
    words paired with themselves and repeated rows change nothing. Keys are taken to be unique and not null. An empty table gives
    no rows. Other columns are ignored.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "components")
    a, b = F.col(left), F.col(right)
    words = pairs.select(F.col(key).alias("id"), F.when(filled(a), a).alias("wa"), F.when(filled(b), b).alias("wb"))

    for seed in range(SEEDS):

        def h(word: str, salt: int = 0, seed: int = seed) -> Column:
            return F.when(F.col(word).isNotNull(), F.xxhash64(F.lit(1000 * seed + salt), F.col(word)))

        rows = words.select("id", h("wa").alias("a"), h("wb").alias("b"))
        ends = words.select("id", h("wa").alias("a"), h("wb").alias("b"), h("wa", 1).alias("ga"), h("wb", 1).alias("gb"))
        sides = F.array(
            F.struct(F.col("a").alias("u"), F.coalesce("b", "a").alias("w"), F.col("ga").alias("g")),
            F.struct(F.col("b").alias("u"), F.coalesce("a", "b").alias("w"), F.col("gb").alias("g")),
        )
        messages = ends.select("id", F.explode(sides).alias("s")).select("id", "s.*").filter("u is not null")
        reach = _reach(messages, 0, F.min("id").alias("first"), F.min("g").alias("g0"), F.max("g").alias("g1"))
        zero = scratch.write(reach.withColumn("clash", F.col("g0") != F.col("g1")).drop("g0", "g1"), "zero")
        if zero.filter("clash").isEmpty():
            break
        scratch.drop(zero)
    else:
        raise RuntimeError("no seed without clashing hashes")
    zero = zero.drop("clash")

    n_rows = pairs.count()
    edges = scratch.write(_contract(rows.filter("a <> b").select("a", "b"), zero, n_rows), "edges")
    level, levels = 1, []
    while n_edges := edges.count():
        clusters = _clusters(edges, n_edges, level, scratch)
        following = scratch.write(_contract(edges, clusters, n_edges), "edges")
        scratch.drop(edges)
        levels.append(clusters.select("u", "own"))
        edges, level = following, level + 1

    roots = None
    for clusters in reversed(levels):
        if roots is not None:
            sizes = clusters.groupBy("own").agg(F.count(F.lit(1)).alias("n"))
            onward = sizes.join(roots.withColumnRenamed("u", "own"), "own", "left").select("own", F.coalesce("root", "own").alias("root"), "n")
            clusters = scratch.write(lookup(clusters, onward, "own", "n", clusters.count()).select("u", "root"), "roots")
        else:
            clusters = clusters.withColumnRenamed("own", "root")
        roots = clusters

    members = zero.groupBy("own").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    if roots is not None:
        members = members.join(roots.withColumnRenamed("u", "own"), "own", "left").withColumn("root", F.coalesce("root", "own"))
        members = scratch.write(members, "members")
        groups = members.groupBy("root").agg(F.min("first").alias("group_id"), F.count(F.lit(1)).alias("m"))
        members = lookup(members, groups, "root", "m", members.count()).select("own", "group_id", "n")
    else:
        members = members.withColumnRenamed("first", "group_id")
    n_vertices = zero.count()
    vertices = lookup(zero.select("u", "own", F.col("n").alias("w")), members, "own", "n", n_vertices).select("u", "group_id", F.col("w").alias("n"))
    vertices = scratch.write(vertices, "vertices")
    scratch.drop(zero)
    named = lookup(rows.select("id", F.coalesce("a", "b").alias("u")).filter("u is not null"), vertices, "u", "n", n_rows).select("id", "group_id")
    alone = rows.filter("a is null and b is null").select("id", F.col("id").alias("group_id"))
    return named.unionByName(alone).withColumnRenamed("id", key)
