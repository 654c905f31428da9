"""The two forms of a sentence graph and the way between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("kanou", "sonnkei", "ukemi", "shieki", "negation")
NODE = (
    "id string, score double, weight double, fuzoku string, case string, kanou boolean, sonnkei boolean, ukemi boolean, shieki boolean, negation boolean, "
    "relation boolean, antonym boolean, hypo_num int, wnum string, not_synnode boolean, matchbp array<int>, childbp array<int>, log string"
)
NODES = f"sid string, bp int, {NODE}"
PHRASE = "sid string, bp int, midasi string, kakari_type string, level string, parentbp int, fstring string"
COLUMNS = [c.split(" ")[0] for c in NODE.split(", ")]


def with_defaults(nodes: DataFrame) -> DataFrame:
    """A table of nodes with every column of the schema; what is missing is false, empty or null."""
    kinds = dict(c.split(" ", 1) for c in NODE.split(", "))
    out = nodes
    for name, kind in kinds.items():
        if name not in nodes.columns:
            fill = {"boolean": F.lit(False), "array<int>": F.array().cast("array<int>"), "double": F.lit(1.0)}.get(kind, F.lit(None).cast(kind))
            out = out.withColumn(name, fill)
        elif kind == "boolean":
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return out.select(*[c for c in nodes.columns if c not in kinds], *kinds)


def nested(nodes: DataFrame) -> DataFrame:
    """(sid, graph): one row a sentence, graph an array of (bp, nodes) in order."""
    per = nodes.groupBy("sid", "bp").agg(F.sort_array(F.collect_list(F.struct(*COLUMNS))).alias("nodes"))
    return per.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("bp", "nodes"))).alias("graph"))


def exploded(graphs: DataFrame) -> DataFrame:
    """The nodes of nested graphs, one row each."""
    return graphs.select("sid", F.explode("graph").alias("p")).select("sid", "p.bp", F.explode("p.nodes").alias("n")).select("sid", "bp", "n.*")
