"""Queries of these operators, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.runtime import table
from .collapse import collapse_records, hidden_duplicates
from .components import consolidate
from .encode import encode
from .leakage import find_leaks
from .lookalike import look_alike_pairs
from .reading import reading_levels


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate(table(spark, d, "synonym_web_news", "pair_id", "word1", "word2"), "pair_id", "word1", "word2")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hidden_duplicates(table(spark, d, "synonym_web_news", "pair_id", "word1", "word2"), "pair_id", "word1", "word2")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return collapse_records(table(spark, d, "synonym_web_news", "pair_id", "word1", "word2"), "pair_id", "word1", "word2")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(
        [
            ("word1", table(spark, d, "synonym_web_news", "pair_id", "word1")),
            ("midasi", table(spark, d, "definition", "def_id", "midasi")),
            ("def", table(spark, d, "definition", "def_id", "def")),
        ]
    )


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items", "item_id", "text"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "reading_labels", "doc_id", "grade"), "grade")


_BARE = r"lower(regexp_replace({}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}\p{{P}}$+<=>^`|~＄＋＜＝＞＾｀｜～]+', '', 'g'))"
_RECORDS = f"""
WITH k AS (SELECT pair_id, {_BARE.format("word1")} AS a, {_BARE.format("word2")} AS b FROM synonym_web_news WHERE word1 <> '' AND word2 <> '')
SELECT min(pair_id) AS first_id, count(*) AS n_copies FROM k GROUP BY least(a, b), greatest(a, b)
"""

SQL = {
    "p1_found": """
WITH RECURSIVE ends AS (SELECT pair_id, word1 AS w FROM synonym_web_news WHERE word1 <> '' UNION ALL SELECT pair_id, word2 FROM synonym_web_news WHERE word2 <> ''),
edges AS (SELECT word1 AS a, word2 AS b FROM synonym_web_news WHERE word1 <> '' AND word2 <> '' UNION SELECT word2, word1 FROM synonym_web_news WHERE word1 <> '' AND word2 <> ''),
cc(w, label) USING KEY (w) AS (
  SELECT w, min(pair_id) FROM ends GROUP BY w
  UNION
  SELECT e.b, min(c.label) FROM cc c JOIN edges e ON e.a = c.w JOIN recurring.cc r ON r.w = e.b WHERE c.label < r.label GROUP BY e.b)
SELECT pair_id, coalesce(x.label, y.label, pair_id) AS group_id FROM synonym_web_news p LEFT JOIN cc x ON x.w = p.word1 LEFT JOIN cc y ON y.w = p.word2
""",
    "p5_found": _RECORDS + "HAVING count(*) > 1",
    "p5_records": _RECORDS,
}

QUERIES = {f.__name__: f for f in (p1_found, p5_found, p5_records, p7_found, p8_ids, p9_found, p10_found)}
