"""Operations on the forest of is-a edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import filled, lookup
from ..functions.strings import base_of
from .hierarchy import ancestor_pairs, below, descendant_counts, grow, hierarchy, paths


def load_edges(isa: DataFrame) -> DataFrame:
    """(child, parent) of words without sense numbers; nothing is its own parent."""
    e = isa.filter(filled("hypo") & filled("hyper")).select(base_of(F.col("hypo")).alias("child"), base_of(F.col("hyper")).alias("parent"))
    return e.filter("child <> parent").distinct()


def without_words(edges: DataFrame, words: DataFrame) -> DataFrame:
    """Edges of which neither end is one of the words."""
    w = words.select("word").distinct()
    return edges.join(w.toDF("child"), "child", "left_anti").join(w.toDF("parent"), "parent", "left_anti").select("child", "parent")


def two_cycles(edges: DataFrame) -> DataFrame:
    """Words that are parent and child of one another."""
    back = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return edges.join(back, ["child", "parent"], "left_semi").select(F.col("child").alias("word")).distinct()


def without_two_cycles(edges: DataFrame) -> DataFrame:
    return without_words(edges, two_cycles(edges))


def too_frequent(edges: DataFrame, df: DataFrame, most: int, keep: DataFrame | None = None, only_roots: bool = False, small: int | None = None) -> DataFrame:
    """Words above a document frequency, except those to keep, those with a parent or those with few descendants, where asked for. df: (word, df)."""
    words = edges.select(F.explode(F.array("child", "parent")).alias("word")).distinct()
    cut = words.join(df, "word").filter(F.col("df") > most).select("word")
    if keep is not None:
        cut = cut.join(keep.select("word").distinct(), "word", "left_anti")
    if only_roots:
        cut = cut.join(edges.select(F.col("child").alias("word")).distinct(), "word", "left_anti")
    if small is not None:
        many = descendant_counts(edges, "child", "parent").filter(F.col("n_descendants") > small).select(F.col("ancestor").alias("word"))
        cut = cut.join(many, "word", "left_semi")
    return cut


def without_ambiguous_parents(edges: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Edges without those that lead up from ambiguous words."""
    return edges.join(ambiguous.select(F.col("word").alias("child")).distinct(), "child", "left_anti").select("child", "parent")


def subtrees(edges: DataFrame) -> DataFrame:
    """(word, n_words, height): the size of the tree below each word that has children, itself included."""
    return descendant_counts(edges, "child", "parent").select(F.col("ancestor").alias("word"), (F.col("n_descendants") + 1).alias("n_words"), "height")


def relatives(edges: DataFrame) -> DataFrame:
    """All (ancestor, node, distance)."""
    return ancestor_pairs(edges, "child", "parent")


def coordinate_counts(edges: DataFrame) -> DataFrame:
    """(word, n_coordinate): how many words of its tree are neither above nor below a word, and not the word itself.

    From sizes, never from pairs: in a tree of any size, the words above are as many as the word's depth.
    """
    forest = grow(edges, "child", "parent")
    h = paths(forest).filter("node_depth > 0").select("node", "root_node", "node_depth")
    counts = below(forest).select("ancestor", "n_descendants")
    size = counts.select(F.col("ancestor").alias("root_node"), (F.col("n_descendants") + 1).alias("size"), F.col("n_descendants").alias("weight"))
    own = counts.select(F.col("ancestor").alias("node"), "n_descendants")
    j = lookup(h, size, "root_node", "weight", forest.n_edges).join(own, "node", "left")
    n = F.col("size") - 1 - F.col("node_depth") - F.coalesce("n_descendants", F.lit(0))
    return j.select(F.col("node").alias("word"), n.cast("long").alias("n_coordinate")).filter("n_coordinate > 0")


def coordinates(edges: DataFrame, words: DataFrame) -> DataFrame:
    """(word, other): the coordinate terms of stated words. words: (word)."""
    h = hierarchy(edges, "child", "parent").filter("node_depth > 0").select("node", "root_node")
    asked = words.select(F.col("word").alias("node")).distinct().join(h, "node").select(F.col("node").alias("word"), "root_node")
    pairs = asked.join(h.withColumnRenamed("node", "other"), "root_node").filter("word <> other").select("word", "other")
    near = relatives(edges).select(F.col("ancestor").alias("word"), F.col("node").alias("other"))
    both = near.unionByName(near.select(F.col("other").alias("word"), F.col("word").alias("other")))
    return pairs.join(both, ["word", "other"], "left_anti")


def tree_lines(edges: DataFrame) -> DataFrame:
    """(root, path, line): each word indented by its depth, roots with the number of their children; in the order of path this draws the trees."""
    h = hierarchy(edges, "child", "parent").filter("node_depth > 0")
    n = edges.groupBy("parent").agg(F.countDistinct("child").alias("n"))
    roots = h.select("root_node").distinct().join(n, F.col("root_node") == F.col("parent"))
    top = roots.select(F.col("root_node").alias("root"), F.col("root_node").alias("path"), F.concat("root_node", F.lit("["), F.col("n").cast("string"), F.lit("]")).alias("line"))
    return top.unionByName(h.select(F.col("root_node").alias("root"), F.col("full_path").alias("path"), F.concat(F.repeat(F.lit("  "), F.col("node_depth")), "node").alias("line")))


def root_categories(edges: DataFrame, categories: DataFrame) -> DataFrame:
    """(root, category): the categories of each root, joined by ``;``, 無 for none. categories: (word, category)."""
    roots = edges.select(F.col("parent").alias("root")).distinct().join(edges.select(F.col("child").alias("root")).distinct(), "root", "left_anti")
    c = categories.filter(filled("category")).groupBy(F.col("word").alias("root")).agg(F.array_join(F.array_sort(F.collect_set("category")), ";").alias("category"))
    return roots.join(c, "root", "left").select("root", F.coalesce("category", F.lit("無")).alias("category"))
