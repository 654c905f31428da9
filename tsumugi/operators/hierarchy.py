"""Parent-child links to full hierarchies: paths, depths, roots, descendants and loops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import Scratch, filled, lookup


@dataclass
class Forest:
    """What the frontier joins leave behind, all of it written tables.

    edges: (node, up, n), one row a node; n is its number of child rows, null for a leaf.
    parents: (up, n), one row a parent. n_edges: the child rows in all. inner: (node, root, path, depth) of the nodes that have children; path is an array from the root
    down to the node. depth is -1 on a loop and -2 below one, with an empty path.
    """

    edges: DataFrame
    parents: DataFrame
    inner: DataFrame
    n_edges: int


def _step(open_: DataFrame, total: int, table: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Every open node, of ``total``, takes over where its jump target points to; also gives the targets, for the next step."""
    width = open_.groupBy("jump").agg(F.count(F.lit(1)).alias("n"))
    target = scratch.write(width.join(table.withColumnsRenamed({"jump": "jump2", "node": "jump"}), "jump"), "targets")
    to = target.select("jump", "jump2", F.col("seg").alias("seg2"), F.col("done").alias("done2"), "n")
    new = lookup(open_, to, "jump", "n", total).select("node", F.col("jump2").alias("jump"), F.concat("seg2", "seg").alias("seg"), F.col("done2").alias("done"))
    return scratch.write(new, "state"), target


def _split(state: DataFrame) -> tuple[int, int]:
    """How many nodes are done and how many open."""
    n = {r["done"]: r["count"] for r in state.groupBy("done").count().collect()}
    return n.get(True, 0), n.get(False, 0)


def _table(jump_first: DataFrame) -> DataFrame:
    return jump_first.select(F.col("jump").alias("node"), F.col("jump2").alias("jump"), "seg", "done")


def grow(rows: DataFrame, child: str, parent: str) -> Forest:
    """Frontier joins from the roots, over the nodes that have children.

    Leaves, most of all nodes, wait outside and take their parent's path once at the end. A round's frontier is all nodes
    whose path upward first meets a finished node; nodes still unreached meanwhile point twice as far up as the round before,
    so a round extends the frontier over a band of levels (1, 1, 2, 4, ... of them) and chains of any length take
    logarithmically many rounds. Of the finished nodes a round keeps only those that were pointed to and those it finished: no
    other can be pointed to later. A round that reaches nobody shows that whatever is left runs into a loop; those on it are what
    is still pointed to once pointing farther no longer shrinks the set.

    Rows with a null or empty child or parent are left out. Repeated rows count once; a child with several parents keeps the
    smallest. A row whose child is its own parent is a loop.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "forest")
    valid = rows.select(F.col(child).alias("node"), F.col(parent).alias("up")).filter(filled("node") & filled("up"))
    parents = scratch.write(valid.groupBy("up").agg(F.count(F.lit(1)).alias("n")), "parents")
    n_edges = parents.agg(F.sum("n")).first()[0] or 0
    single = valid.groupBy("node").agg(F.min("up").alias("up"))
    edges = scratch.write(single.join(parents.select(F.col("up").alias("node"), "n"), "node", "left"), "edges")

    inner = edges.filter("n is not null").select("node", "up")
    below_root = inner.select("up").distinct().join(inner.select(F.col("node").alias("up")), "up", "left_anti")
    root_flag = below_root.select("up", F.lit(True).alias("done"))
    state = scratch.write(
        inner.join(root_flag, "up", "left").select("node", F.col("up").alias("jump"), F.array("node").alias("seg"), F.coalesce("done", F.lit(False)).alias("done")), "state"
    )
    finished, open_, table = [state.filter("done")], state.filter("not done"), state
    _, left = _split(state)
    while left:
        new, targets = _step(open_, left, table, scratch)
        open_ = new.filter("not done")
        reached, left = _split(new)
        if not reached:
            break
        finished.append(new.filter("done"))
        table = new.unionByName(_table(targets.filter("done")))
    result = None
    for f in finished:
        part = f.select("node", F.col("jump").alias("root"), F.concat(F.array("jump"), "seg").alias("path"), F.size("seg").alias("depth"))
        result = part if result is None else result.unionByName(part)
    if left:
        nothing = F.array().cast("array<string>")
        open_ = open_.select("node", "jump", nothing.alias("seg"), "done")
        wide = open_.select("jump").distinct().count()
        while True:
            open_, _ = _step(open_, left, open_, scratch)
            narrow = open_.select("jump").distinct().count()
            if narrow == wide:
                break
            wide = narrow
        on = open_.select(F.col("jump").alias("node")).distinct().withColumn("on", F.lit(True))
        loops = open_.select("node").join(on, "node", "left")
        result = result.unionByName(loops.select("node", F.lit("").alias("root"), nothing.alias("path"), F.when(F.col("on"), -1).otherwise(-2).alias("depth")))
    return Forest(edges, parents, scratch.write(result, "inner"), n_edges)


def hierarchy(rows: DataFrame, child: str, parent: str, separator: str = ">") -> DataFrame:
    """(node, root_node, node_depth, full_path) for every child; see :func:`grow` for what is left out.

    The path joins the words from the root, which is no child itself, down to the node. Nodes on a loop have depth -1, nodes
    that lead into one -2, both with empty root and path. An empty table gives no rows.
    """
    return paths(grow(rows, child, parent), separator)


def paths(f: Forest, separator: str = ">") -> DataFrame:
    """What :func:`hierarchy` gives, of a forest."""
    inner = f.inner.select("node", F.col("root").alias("root_node"), F.col("depth").alias("node_depth"), F.array_join("path", separator).alias("full_path"))
    above = f.parents.join(inner.withColumnRenamed("node", "up"), "up", "left").select(
        "up",
        "n",
        F.coalesce("root_node", F.col("up")).alias("root_node"),
        F.coalesce("node_depth", F.lit(0)).alias("above"),
        F.coalesce("full_path", F.col("up")).alias("path"),
    )
    looped = F.col("above") < 0
    leaves = lookup(f.edges.filter("n is null").select("node", "up"), above, "up", "n", f.n_edges, apart=True).select(
        "node",
        "root_node",
        F.when(looped, F.lit(-2)).otherwise(F.col("above") + 1).alias("node_depth"),
        F.when(looped, F.lit("")).otherwise(F.concat_ws(separator, "path", "node")).alias("full_path"),
    )
    return inner.unionByName(leaves)


def ancestor_pairs(rows: DataFrame, child: str, parent: str) -> DataFrame:
    """All pairs (ancestor, node, distance) of nodes outside loops: every node's descendants."""
    f = grow(rows, child, parent)
    inner = f.inner.filter("depth > 0").select("node", "path")
    above = f.parents.join(f.inner.select(F.col("node").alias("up"), "path", "depth"), "up", "left").filter(F.coalesce("depth", F.lit(0)) >= 0)
    above = above.select("up", "n", F.coalesce("path", F.array("up")).alias("above"))
    leaves = lookup(f.edges.filter("n is null").select("node", "up"), above, "up", "n", f.n_edges, apart=True).select("node", F.concat("above", F.array("node")).alias("path"))
    both = inner.unionByName(leaves)
    return both.select("node", F.size("path").alias("size"), F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor")).select(
        "ancestor", "node", (F.col("size") - 1 - F.col("at")).alias("distance")
    )


def descendant_counts(rows: DataFrame, child: str, parent: str) -> DataFrame:
    """(ancestor, n_descendants, height) for every word that has descendants and is on or below no loop.

    Leaves are counted at their parent first, so ancestor pairs are made of inner nodes only.
    """
    return below(grow(rows, child, parent))


def below(f: Forest) -> DataFrame:
    """What :func:`descendant_counts` gives, of a forest."""
    leaves = f.edges.filter("n is null").groupBy("up").agg(F.count(F.lit(1)).alias("leaves"))
    held = (
        f.parents.join(f.inner.select(F.col("node").alias("up"), "path", "depth"), "up", "left")
        .filter(F.coalesce("depth", F.lit(0)) >= 0)
        .join(leaves, "up", "left")
        .select(F.coalesce("path", F.array("up")).alias("path"), F.coalesce("leaves", F.lit(0).cast("long")).alias("leaves"))
    )
    pairs = held.select("leaves", F.size("path").alias("size"), F.posexplode("path").alias("at", "ancestor")).select(
        "ancestor",
        (F.col("leaves") + F.when(F.col("at") < F.col("size") - 1, 1).otherwise(0)).alias("n"),
        (F.col("size") - 1 - F.col("at") + F.when(F.col("leaves") > 0, 1).otherwise(0)).alias("height"),
    )
    return pairs.groupBy("ancestor").agg(F.sum("n").alias("n_descendants"), F.max("height").alias("height")).filter("n_descendants > 0")
