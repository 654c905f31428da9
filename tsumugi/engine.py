"""The engine as one object: a lexicon, options, and what can be done with sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from .functions.config import EngineConfig
from .operators import annotate, retrieval, similarity
from .operators.analyzer import chain_trees
from .operators.annotate import Lexicon, Prefilters
from .sources.writers import annotated_blocks, write_table


class SynonymEngine:
    """Annotates, compares and retrieves sentences by a lexicon.

    An analyser is anything that gives phrase trees (sid, bp, id, parentbp, childbp): :func:`analyzer.keywords` over parser output, or
    word chains as here.
    """

    def __init__(self, spark: SparkSession, lexicon: Lexicon, config: EngineConfig | None = None):
        self.spark, self.lexicon, self.config = spark, lexicon, config or EngineConfig()

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: EngineConfig | None = None) -> SynonymEngine:
        """Opens a saved lexicon; tables are read when they are used."""
        return cls(spark, Lexicon(*(spark.read.parquet(f"{path}/{n}") for n in ("members", "parents", "antonyms"))), config)

    def save(self, path: str) -> None:
        for name, key in (("members", "synid"), ("parents", "synid"), ("antonyms", "synid")):
            write_table(getattr(self.lexicon, name), f"{path}/{name}", key)

    def trees(self, rows: DataFrame, sid: str, tokens: Column) -> DataFrame:
        return chain_trees(rows, sid, tokens)

    def annotate(self, trees: DataFrame, filters: Prefilters | None = None, stop_words: list[str] | None = None) -> DataFrame:
        """Nodes of phrase trees; members may have any number of words."""
        return annotate.attach(trees, self.lexicon, self.config.nodes, filters, stop_words)

    def match(self, pairs: DataFrame, nodes: DataFrame, keep: list[str]) -> DataFrame:
        return similarity.match_pairs(pairs, nodes, keep, self.config.match)

    def relation(self, pairs: DataFrame, nodes: DataFrame, keep: list[str]) -> DataFrame:
        return similarity.two_expression_relation(pairs, nodes, keep, self.config.build.compat)

    def hypernym(self, nodes: DataFrame) -> DataFrame:
        return annotate.only_hypernym(nodes)

    def memory(self, nodes: DataFrame, trees: DataFrame, memory: DataFrame, target: str | None = None) -> DataFrame:
        return annotate.memory_matches(nodes, trees, memory, self.config.max_patterns, target)

    def search(self, queries: DataFrame, docs: DataFrame, most: int = 100) -> DataFrame:
        return retrieval.search(queries, docs, most)

    def search_graphs(self, queries: DataFrame, targets: DataFrame, most: int = 100, clauses: DataFrame | None = None) -> DataFrame:
        return retrieval.search_graphs(queries, targets, most, clauses=clauses)

    def text(self, nodes: DataFrame, phrases: DataFrame) -> DataFrame:
        return annotated_blocks(nodes, phrases)
