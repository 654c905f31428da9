"""Writers: key-value tables, head index, graphs, annotated text, inverted index, shards and dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.annotate import line_of


def write_table(df: DataFrame, path: str, key: str | None = None, files: int | None = None) -> None:
    """A table as Parquet, laid out by its key so that lookups read few row groups."""
    out = df
    if key:
        out = (df.repartitionByRange(files, key) if files else df.repartitionByRange(key)).sortWithinPartitions(key)
    out.write.mode("overwrite").parquet(path)


def append_graphs(graphs: DataFrame, path: str) -> None:
    """Adds sentence graphs to a store."""
    graphs.write.mode("append").parquet(path)


def head_index_text(heads: DataFrame) -> DataFrame:
    """(node_id, entries): ``member%children`` joined by ``|``, as the exchange format has it. heads: (node_id, child_num, mid)."""
    g = heads.groupBy("node_id").agg(F.sort_array(F.collect_set(F.struct("child_num", "mid"))).alias("x"))
    return g.select("node_id", F.array_join(F.transform("x", lambda e: F.concat(e["mid"], F.lit("%"), e["child_num"].cast("string"))), "|").alias("entries"))


def parent_text(parents: DataFrame) -> DataFrame:
    """(synid, entries): ``parent,count`` joined by ``|``."""
    g = parents.groupBy("synid").agg(F.sort_array(F.collect_set(F.struct("parent", "hypo_num"))).alias("x"))
    return g.select("synid", F.array_join(F.transform("x", lambda e: F.concat_ws(",", e["parent"], e["hypo_num"].cast("string"))), "|").alias("entries"))


def posting_text(index: DataFrame) -> DataFrame:
    """(id, postings): ``text:score`` joined by ``|``, best first, four decimals."""
    g = index.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d")))).alias("x"))
    return g.select("id", F.array_join(F.transform("x", lambda e: F.concat(e["d"].cast("string"), F.lit(":"), F.format_string("%.4f", -e["s"]))), "|").alias("postings"))


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """An inverted index as Parquet, in folders by a hash of the node so that a probe reads one of them."""
    out = index.select("id", "doc_id", F.round("score", 4).alias("score")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    out.repartition(buckets, "bucket").sortWithinPartitions("id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def merge_indexes(parts: list[DataFrame]) -> DataFrame:
    """Several indexes as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_shards(df: DataFrame, path: str, rows: int = 1000) -> None:
    """Text files of at most so many rows. df has one text column."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).text(path)


def annotated_blocks(nodes: DataFrame, phrases: DataFrame) -> DataFrame:
    """(sid, bp, ord, line): the annotated text of sentences, a ``!!`` line for each set of phrases and a ``!`` line for each of its nodes.

    phrases: (sid, bp, parentbp, dpndtype, midasi, case). Sets come by their first phrase, last first, as do a set's nodes in order of score; a
    set's parents are all sets with the parent phrase that don't overlap it, joined by ``/``.
    """
    numbers = F.array_sort(F.array_append("matchbp", F.col("bp")))
    cover = F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")
    n = nodes.withColumns({"numbers": numbers, "cover": cover})
    sets = n.select("sid", "bp", "cover", "numbers").distinct()
    over = sets.select("sid", F.explode("numbers").alias("parentbp"), F.col("cover").alias("p_cover"), F.col("numbers").alias("p_numbers")).distinct()
    own = sets.join(phrases, ["sid", "bp"])
    up = own.join(over, ["sid", "parentbp"], "left").filter(F.col("p_numbers").isNull() | ~F.arrays_overlap("numbers", "p_numbers"))
    parents = up.groupBy("sid", "bp", "cover").agg(F.array_join(F.array_sort(F.collect_set("p_cover")), "/").alias("parents"))
    head = own.join(parents, ["sid", "bp", "cover"], "left")
    name = F.coalesce(F.when(F.col("parentbp") < 0, F.col("parentbp").cast("string")), "parents", F.lit(""))
    case = F.when(F.coalesce("case", F.lit("")) != "", F.concat(F.lit("<格解析結果:"), "case", F.lit("格>"))).otherwise("")
    midasi = F.when(F.coalesce("midasi", F.lit("")) != "", F.concat(F.lit(" <見出し:"), "midasi", F.lit(">"))).otherwise(F.when(case != "", " ").otherwise(""))
    first = (-F.element_at("numbers", 1)).alias("first")
    tops = head.select("sid", "bp", first, "cover", F.lit(0).alias("kind"), F.lit(0.0).alias("s"), F.concat(F.lit("!! "), "cover", F.lit(" "), name, "dpndtype", midasi, case).alias("line"))
    marked = n.select("sid", "bp", first, "cover", F.lit(1).alias("kind"), (-F.col("score")).alias("s"), line_of().alias("line"))
    w = Window.partitionBy("sid", "bp").orderBy("first", "cover", "kind", "s", "line")
    return tops.unionByName(marked).select("sid", "bp", F.row_number().over(w).alias("ord"), "line")


def inline_features(nodes: DataFrame) -> DataFrame:
    """(sid, bp, features): the ids of each phrase as features, ``<SYNID:id/score>``, best first."""
    g = nodes.groupBy("sid", "bp").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("x"))
    return g.select("sid", "bp", F.array_join(F.transform("x", lambda e: F.concat(F.lit("<SYNID:"), e["id"], F.lit("/"), F.round(-e["s"], 6).cast("string"), F.lit(">"))), "").alias("features"))


def dump(nodes: DataFrame) -> DataFrame:
    """(sid, line): the ids of each phrase joined by ``|``, phrases by a blank."""
    g = nodes.groupBy("sid", "bp").agg(F.array_join(F.array_sort(F.collect_set("id")), "|").alias("ids"))
    s = g.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("bp", "ids"))).alias("x"))
    return s.select("sid", F.array_join(F.transform("x", lambda e: e["ids"]), " ").alias("line"))


def task_lines(files: DataFrame, command: str) -> DataFrame:
    """(line): one shell line for each shard, where work is spread outside of Spark. files: (file)."""
    return files.select(F.concat(F.lit(command + " "), "file").alias("line")).orderBy("line")
