"""Retrieval of texts by the concepts in them: term weights, postings, rough and exact ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import B, K1, QUERY_WEIGHT
from ..functions.runtime import Scratch, lookup, meet, shuffled
from .coverage import chain_coverage, exact_scores, first_places


def term_nodes(docs: DataFrame, doc: str, terms: Column) -> DataFrame:
    """(doc_id, bp, id, score, weight): the words of texts as nodes of score 1."""
    return docs.select(F.col(doc).alias("doc_id"), F.posexplode(terms).alias("bp", "id")).select("doc_id", "bp", "id", F.lit(1.0).alias("score"), F.lit(1.0).alias("weight"))


def term_frequencies(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, tf): the sum of node scores; a text's own counts are complete before the shuffle."""
    return nodes.groupBy("doc_id", "id").agg(F.sum("score").alias("tf"))


def node_frequencies(tf: DataFrame) -> DataFrame:
    """(id, df)."""
    return tf.groupBy("id").agg(F.count(F.lit(1)).alias("df"))


def lengths(nodes: DataFrame) -> DataFrame:
    """(doc_id, dl): nodes of score 1 in each text."""
    return nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dl"))


def bm25(tf: Column, df: Column, dl: Column, mean: Column, n: Column) -> Column:
    """The weight of an occurrence of a term, never below 0."""
    saturated = (K1 + 1) / (K1 * ((1 - B) + B * dl / mean) + tf)
    return F.greatest(saturated * F.log((n - df + 0.5) / (df + 0.5)), F.lit(0.0))


def weighted_terms(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, tf, weight) for every term of every text. Texts without terms have no rows and don't count for the mean length."""
    tf, dl = term_frequencies(nodes), lengths(nodes)
    stats = dl.agg(F.avg("dl").alias("mean"), F.count(F.lit(1)).alias("n"))  # one row
    w = lookup(tf.join(dl, "doc_id"), node_frequencies(tf).withColumn("rows", F.col("df")), "id", "rows").crossJoin(F.broadcast(stats))
    return w.select("doc_id", "id", "tf", bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("mean"), F.col("n")).alias("weight"))


def postings(nodes: DataFrame) -> DataFrame:
    """(id, doc_id, score): what each text has of each node; only what is above 0."""
    return weighted_terms(nodes).select("id", "doc_id", (F.col("tf") * F.col("weight")).alias("score")).filter("score > 0")


def rough_scores(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, doc_id, score): of each query phrase the best node, summed over phrases. queries: (query, bp, id, score, weight)."""
    q = queries.select("query", "bp", "id", (F.col("score") * F.col("weight")).alias("q"))
    best = meet(index, q, "id").groupBy("query", "doc_id", "bp").agg(F.max(F.col("q") * F.col("score")).alias("s"))
    return best.filter("s > 0").groupBy("query", "doc_id").agg(F.sum("s").alias("score"))


def topic_scores(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(topic, doc_id, score): rough scores of a topic's query sentences by the weight of their type. queries also have topic and type."""
    kinds = queries.select("query", "topic", "type").distinct()
    weight = F.when(F.col("type") == "DESCRIPTION", QUERY_WEIGHT["DESCRIPTION"]).otherwise(QUERY_WEIGHT["OTHER"])
    return rough_scores(queries, index).join(kinds, "query").groupBy("topic", "doc_id").agg(F.sum(F.col("score") * weight).alias("score"))


def top(scores: DataFrame, per: str, item: str, most: int, digits: int = 6) -> DataFrame:
    """The best so many rows of each query with their rank; equal scores by id."""
    k = F.row_number().over(Window.partitionBy(per).orderBy(F.desc("score"), item))
    return scores.withColumn("score", F.round("score", digits)).withColumn("rank", k).filter(F.col("rank") <= most)


def roll_up(scores: DataFrame, sentence: str) -> DataFrame:
    """(query, doc_id, score): sentence scores summed by the text before the comma of the sentence id."""
    return scores.groupBy("query", F.split_part(F.col(sentence).cast("string"), F.lit(","), F.lit(1)).alias("doc_id")).agg(F.sum("score").alias("score"))


def _candidates(scores: DataFrame, most: int) -> DataFrame:
    return top(scores, "query", "doc_id", most).select(F.col("query").alias("a"), F.col("doc_id").alias("b"))


def search(queries: DataFrame, docs: DataFrame, most: int = 100, least: float = 0.00001) -> DataFrame:
    """(query, doc_id, score, rank): rough candidates, at most so many a query, ranked again exactly; those below ``least`` are left out.

    queries: (query, words), docs: (doc_id, words), as word chains. Queries and texts without words find nothing. Repeated ids are one text of all their words.
    """
    scratch = Scratch(queries.sparkSession, "search")
    q = queries.filter(F.size("words") > 0).select("query", F.posexplode("words").alias("bp", "id"))
    t = docs.filter(F.size("words") > 0).select("doc_id", F.posexplode("words").alias("bp", "id"))
    one = {"score": F.lit(1.0), "weight": F.lit(1.0)}
    pairs = scratch.write(_candidates(rough_scores(q.withColumns(one), postings(t.withColumns(one))), most), "pairs")
    texts = t.join(pairs.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi")
    asked, told = q.withColumnRenamed("query", "a"), texts.withColumnRenamed("doc_id", "b")
    there = chain_coverage(pairs, asked, first_places(told)).withColumnRenamed("score", "there")
    swapped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    back = chain_coverage(swapped, told.withColumnRenamed("b", "a"), first_places(asked.withColumnRenamed("a", "b"))).select(F.col("a").alias("doc_id"), F.col("b").alias("query"), "score")
    both = there.select(F.col("a").alias("query"), F.col("b").alias("doc_id"), "there").join(back, ["query", "doc_id"])
    scored = both.select("query", "doc_id", (F.col("there") * F.col("score")).alias("score")).filter(F.col("score") >= least)
    return top(scored, "query", "doc_id", most)


def search_graphs(queries: DataFrame, targets: DataFrame, most: int = 100, least: float = 0.00001, clauses: DataFrame | None = None) -> DataFrame:
    """(query, doc_id, score, why, rank): :func:`search` over the nodes of annotated sentences, with the explanation of every match.

    queries, targets: nodes. A sentence isn't its own result. clauses: (sid, bp) of phrases that are clauses of their own.
    """
    scratch = Scratch(queries.sparkSession, "search")
    asked = queries.select(F.col("sid").alias("query"), "bp", "id", "score", "weight")
    index = postings(targets.select(F.col("sid").alias("doc_id"), "id", "score", "weight"))
    pairs = scratch.write(_candidates(rough_scores(asked, index), most), "pairs").filter("not a <=> b")
    near = targets.join(pairs.select(F.col("b").alias("sid")).distinct(), "sid", "left_semi")
    scored = exact_scores(pairs, queries, near, clauses).filter(F.col("score") >= least)
    return top(scored.select(F.col("a").alias("query"), F.col("b").alias("doc_id"), "score", "why"), "query", "doc_id", most)


def topic_search(queries: DataFrame, sentences: DataFrame, candidates: int = 1000, most: int = 300) -> DataFrame:
    """(topic, doc_id, score, rank): evaluation of topics: rough candidates of a topic, ranked again by how their sentences cover its queries.

    queries: (query, topic, type, words); sentences: (doc_id, sid, words), as word chains, sid unique. A matched word counts its term weight in the text times how often the
    sentence has it, and a kept dependency what its two words weigh. A text's score is the sum over its sentences and the topic's
    queries by the weight of their type; scores aren't normalised. Topics without matches have no rows.
    """
    scratch = Scratch(queries.sparkSession, "topics")
    one = {"score": F.lit(1.0), "weight": F.lit(1.0)}
    q = queries.filter(F.size("words") > 0).select("query", "topic", "type", F.posexplode("words").alias("bp", "id"))
    s = sentences.filter(F.size("words") > 0).select("doc_id", "sid", F.posexplode("words").alias("bp", "id"))
    weights = scratch.write(weighted_terms(s.withColumns(one)), "weights")
    index = weights.select("id", "doc_id", (F.col("tf") * F.col("weight")).alias("score")).filter("score > 0")
    found = scratch.write(top(topic_scores(q.withColumns(one), index), "topic", "doc_id", candidates).select("topic", "doc_id"), "found")
    kinds = q.select("query", "topic", "type").distinct()
    near = s.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = found.join(kinds, "topic").join(near.select("doc_id", "sid").distinct(), "doc_id").select(F.col("query").alias("a"), F.col("sid").alias("b")).distinct()
    owner = near.select("sid", "doc_id").distinct()
    places = first_places(near.select(F.col("sid").alias("b"), "bp", "id")).join(owner.withColumnRenamed("sid", "b"), "b")
    places = places.join(weights.select("doc_id", "id", F.col("weight").alias("boost")), ["doc_id", "id"]).drop("doc_id")
    scored = chain_coverage(pairs, q.select(F.col("query").alias("a"), "bp", "id"), places, evaluation=True).filter("score > 0")
    weight = F.when(F.col("type") == "DESCRIPTION", QUERY_WEIGHT["DESCRIPTION"]).otherwise(QUERY_WEIGHT["OTHER"])
    of = scored.withColumnsRenamed({"a": "query", "b": "sid"}).join(kinds, "query").join(owner, "sid")
    return top(of.groupBy("topic", "doc_id").agg(F.sum(F.col("score") * weight).alias("score")), "topic", "doc_id", most)


def distributional_similarity(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(w1, w2, score): the mean of overlap coefficient and Jaccard index of two words' features of positive association.

    features: (word, feature, n). A feature counts for a word if they occur together more often than by chance. Shared features are met
    by join and counted, so a word may have any number.
    """
    scratch = Scratch(pairs.sparkSession, "similarity")
    f = features.groupBy("word", "feature").agg(F.sum("n").alias("n"))
    of_word, of_feature = f.groupBy("word").agg(F.sum("n").alias("nw")), f.groupBy("feature").agg(F.sum("n").alias("nf"))
    total = f.agg(F.sum("n").alias("total"))  # one row
    strong = scratch.write(f.join(of_word, "word").join(of_feature, "feature").crossJoin(F.broadcast(total)).filter("n * total > nw * nf").select("word", "feature"), "strong")
    size = strong.groupBy("word").agg(F.count(F.lit(1)).alias("size"))
    # pairs are sent on only as far as both words have features: once by each word, and what is left to be counted
    one = scratch.write(pairs.select("w1", "w2").repartition("w1").distinct().join(shuffled(size.toDF("w1", "s1")), "w1", "left"), "pairs")
    two = scratch.write(one.filter("s1 is not null").join(shuffled(size.toDF("w2", "s2")), "w2", "left"), "pairs")
    both = two.filter("s2 is not null")
    met = shuffled(both).join(strong.withColumnRenamed("word", "w1"), "w1").join(shuffled(strong.withColumnRenamed("word", "w2")), ["w2", "feature"])
    shared = met.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("k"))
    score = F.when(F.col("k") > 0, (F.col("k") / F.least("s1", "s2") + F.col("k") / (F.col("s1") + F.col("s2") - F.col("k"))) / 2).otherwise(0.0)
    scored = both.join(shuffled(shared), ["w1", "w2"], "left").select("w1", "w2", score.alias("score"))
    without = one.filter("s1 is null").select("w1", "w2").unionByName(two.filter("s2 is null").select("w1", "w2"))
    return scored.unionByName(without.withColumn("score", F.lit(0.0)))
