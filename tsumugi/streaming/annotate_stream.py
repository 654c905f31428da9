"""The same annotation on streams.

Annotation of a sentence needs nothing but the sentence and the lexicon, so a stream is annotated micro-batch by micro-batch with the batch
operators and no state. Where a buffer over an article's sentences is needed, they are grouped by event time with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.config import ANTONYM, HYPERNYM, SYNONYM, NodeOptions
from ..operators.analyzer import chain_trees
from ..operators.annotate import Lexicon, attach


def annotate_stream(sentences: DataFrame, sid: str, tokens: Column, lexicon: Lexicon, sink: Callable[[DataFrame, int], None], checkpoint: str, options: NodeOptions | None = None) -> StreamingQuery:
    """Starts annotating a stream of sentences; every micro-batch's nodes go to ``sink`` with the batch's number, so a sink can be exactly-once.

    Members may have any number of words. Ends after what is there now; start it again for more.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(attach(chain_trees(batch, sid, tokens), lexicon, options), number)

    return sentences.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def word_nodes(sentences: DataFrame, sid: str, tokens: Column, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """A stateless stream of nodes (sid, bp, id, score, relation, antonym) of single words, by joins with the static lexicon."""
    basic = sentences.select(F.col(sid).alias("sid"), F.posexplode(tokens).alias("bp", "id")).select("sid", "bp", "id")
    one = lexicon.members.filter(F.size("words") == 1).select(F.element_at("words", 1).alias("word"), "synid")
    own = one.select("word", F.col("synid").alias("to"), F.lit(SYNONYM).alias("cost"), F.lit(False).alias("relation"), F.lit(False).alias("antonym"))
    up = lexicon.parents.select(F.col("synid").alias("k"), F.col("parent").alias("to"), F.lit(HYPERNYM).alias("cost"), F.lit(True).alias("relation"), F.lit(False).alias("antonym"))
    across = lexicon.antonyms.select(F.col("synid").alias("k"), F.col("other").alias("to"), F.lit(ANTONYM).alias("cost"), F.lit(False).alias("relation"), F.lit(True).alias("antonym"))
    edges = up.unionByName(across)
    via = one.withColumnRenamed("synid", "k").join(edges, "k").select("word", "to", (F.col("cost") * SYNONYM).alias("cost"), "relation", "antonym")
    reach = own.unionByName(edges.withColumnRenamed("k", "word")).unionByName(via).filter(F.col("cost") >= threshold)
    self_ = reach.select("word").unionByName(one.select("word")).distinct()
    table = reach.groupBy("word").agg(F.collect_set(F.struct("to", "cost", "relation", "antonym")).alias("n")).join(self_, "word")
    joined = basic.join(table.withColumnRenamed("word", "id"), "id", "left")
    itself = F.array(F.struct(F.col("id").alias("to"), F.lit(1.0).alias("cost"), F.lit(False).alias("relation"), F.lit(False).alias("antonym")))
    every = F.concat(itself, F.coalesce("n", F.slice(itself, 1, 0)))
    return joined.select("sid", "bp", F.explode(every).alias("x")).select("sid", "bp", F.col("x.to").alias("id"), F.col("x.cost").alias("score"), "x.relation", "x.antonym")


def windowed_counts(nodes: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(window, id, n): how often each node occurs in windows of event time; what is later than the watermark is dropped."""
    return nodes.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "id").agg(F.count(F.lit(1)).alias("n"))
