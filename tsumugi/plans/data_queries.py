"""Queries of the general data operators, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.runtime import table
from ..operators.hierarchy import ancestor_pairs, descendant_counts, hierarchy
from ..operators.skew import key_statistics
from ..operators.strict_load import load_valid, rejected
from ..operators.unpack import PAIRS, STRAIGHT, infer_delimiters, unpack


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "isa", "hyponym", "hypernym"), "hyponym", "hypernym")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendant_counts(table(spark, d, "isa", "hyponym", "hypernym"), "hyponym", "hypernym")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ancestor_pairs(table(spark, d, "isa", "hyponym", "hypernym"), "hyponym", "hypernym")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack(table(spark, d, "synonym", "line_no", "syn_list", "tag"), "line_no", "syn_list", "tag").toDF("line_no", "pos", "word")


def p3_delimiters(spark: SparkSession, d: str) -> DataFrame:
    return infer_delimiters(table(spark, d, "synonym", "syn_list", "tag"), "tag", "syn_list")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(table(spark, d, "aimai_synonym_isa", "line_no", "raw_line"), "line_no", "raw_line").toDF("line_no", "reason")


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_valid(table(spark, d, "aimai_synonym_isa", "line_no", "raw_line"), "line_no", "raw_line").withColumnRenamed("offset", "line_no")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "isa", "hypernym", "hyponym", "num")
    return key_statistics(df, "hypernym", "hyponym", "num").toDF("hypernym", "n_rows", "n_hyponyms", "num_sum", "num_median")


_TREE = """
edges AS (SELECT hyponym AS node, min(hypernym) AS up FROM isa
  WHERE hyponym <> '' AND hypernym <> '' GROUP BY hyponym),
tree AS (
  SELECT node, up AS root, 1 AS depth, [up, node] AS path FROM edges WHERE up NOT IN (SELECT node FROM edges)
  UNION ALL
  SELECT e.node, t.root, t.depth + 1, list_append(t.path, e.node) FROM tree t JOIN edges e ON e.up = t.node)
"""

_FIELD = r'(?:"(?:[^"]|"")*"|[^\t"]*)'
_GOOD = f"^({_FIELD})\\t({_FIELD})\\t({_FIELD})$"

_FIELDS = f"""
raw AS (SELECT line_no, raw_line AS raw,
  regexp_full_match(raw_line, '(?s){_FIELD}(?:\\t{_FIELD})*') AS line_ok,
  coalesce(regexp_full_match(raw_line, '(?s){_FIELD}\\t{_FIELD}\\t{_FIELD}'), false) AS three FROM aimai_synonym_isa),
cut AS (SELECT *, CASE WHEN three THEN regexp_extract(raw, '(?s){_GOOD}', 1) END AS r1,
  CASE WHEN three THEN regexp_extract(raw, '(?s){_GOOD}', 2) END AS r2, CASE WHEN three THEN regexp_extract(raw, '(?s){_GOOD}', 3) END AS r3 FROM raw),
fields AS (SELECT line_no, raw, line_ok, three,
  CASE WHEN r1[1] = '"' THEN replace(r1[2:-2], '""', '"') ELSE r1 END AS word_id,
  CASE WHEN r2[1] = '"' THEN replace(r2[2:-2], '""', '"') ELSE r2 END AS sense_text,
  CASE WHEN r3[1] = '"' THEN replace(r3[2:-2], '""', '"') ELSE r3 END AS sense_type FROM cut),
ids AS (SELECT *, regexp_full_match(word_id, '(?s).+:[0-9]+/[0-9]+') AS has_id,
  try_cast(regexp_extract(word_id, ':([0-9]+)/[0-9]+$', 1) AS HUGEINT) AS m, try_cast(regexp_extract(word_id, ':[0-9]+/([0-9]+)$', 1) AS HUGEINT) AS n FROM fields)
"""

_SEPARATORS = r"\s\x{1c}-\x{1f}\x{85}\p{Z},，、､﹐﹑;；﹔|｜¦￤"
_MARKED = "(?:" + "|".join([f"{q}[^{q}]*(?:{q}{q}[^{q}]*)*{q}" for q in STRAIGHT] + [f"{o}[^{c}]*{c}" for o, c in PAIRS]).replace("'", "''") + ")"
_SINGLE = "'" * 4

SQL = {
    "p3_found": f"""
WITH t AS (SELECT line_no, regexp_extract_all(syn_list, '(?s){_MARKED}(?:[{_SEPARATORS}]+|$)|[^{_SEPARATORS}]+') AS t FROM synonym),
u AS (SELECT line_no, list_transform(t, lambda x: regexp_replace(x, '[{_SEPARATORS}]+$', '')) AS t FROM t),
v AS (SELECT line_no, list_filter(list_transform(t, lambda x: CASE WHEN regexp_full_match(x, '(?s){_MARKED}') THEN
  CASE WHEN x[1] IN ('"', {_SINGLE}, '＂', '＇') THEN replace(x[2:-2], x[1] || x[1], x[1]) ELSE x[2:-2] END ELSE x END), lambda x: x <> '') AS t FROM u)
SELECT line_no, CAST(i AS INT) AS pos, t[i] AS word FROM (SELECT line_no, t, unnest(generate_series(1, len(t))) AS i FROM v)
""",
    "p2_found": f"""
WITH RECURSIVE {_TREE},
left_over AS (SELECT * FROM edges WHERE node NOT IN (SELECT node FROM tree)),
size AS (SELECT count(*) AS n FROM left_over),
walk AS (
  SELECT node, up AS here, 1 AS steps FROM left_over
  UNION ALL
  SELECT w.node, l.up, w.steps + 1 FROM walk w JOIN left_over l ON l.node = w.here WHERE w.here <> w.node AND w.steps <= (SELECT n FROM size))
SELECT node, root AS root_node, depth AS node_depth, array_to_string(path, '>') AS full_path FROM tree
UNION ALL
SELECT node, '', CASE WHEN bool_or(here = node) THEN -1 ELSE -2 END, '' FROM walk GROUP BY node
""",
    "p2_descendants": f"""
WITH RECURSIVE {_TREE},
pairs AS (SELECT node, depth, unnest(path[:-2]) AS ancestor, unnest(generate_series(1, depth)) AS k FROM tree)
SELECT ancestor, count(*) AS n_descendants, CAST(max(depth + 1 - k) AS INT) AS height FROM pairs GROUP BY ancestor
""",
    "p2_pairs": f"""
WITH RECURSIVE {_TREE}
SELECT unnest(path[:-2]) AS ancestor, node, CAST(depth + 1 - unnest(generate_series(1, depth)) AS INT) AS distance FROM tree
""",
    "p4_found": f"""
WITH {_FIELDS}, reasons AS (SELECT line_no, CASE WHEN NOT line_ok THEN 'quote' WHEN NOT three THEN 'columns' WHEN NOT has_id THEN 'word_id'
  WHEN m < 1 OR m > n THEN 'sense' WHEN sense_type NOT IN ('isa', 'synonym') THEN 'sense_type' WHEN sense_text = '' THEN 'empty' END AS reason FROM ids)
SELECT line_no, reason FROM reasons WHERE reason IS NOT NULL
""",
    "p4_loaded": f"""
WITH {_FIELDS} SELECT line_no, word_id, sense_text, sense_type FROM ids
WHERE line_ok AND three AND has_id AND m >= 1 AND m <= n AND sense_type IN ('isa', 'synonym') AND sense_text <> ''
""",
    "p6_found": """
WITH r AS (SELECT hypernym, hyponym, num, row_number() OVER (PARTITION BY hypernym, num IS NULL ORDER BY num) AS k,
    count(num) OVER (PARTITION BY hypernym) AS n FROM isa WHERE hypernym <> '')
SELECT hypernym, count(*) AS n_rows, count(DISTINCT CASE WHEN hyponym <> '' THEN hyponym END) AS n_hyponyms, CAST(sum(num) AS BIGINT) AS num_sum,
  CAST(min(CASE WHEN num IS NOT NULL AND 2 * k >= n THEN num END) AS BIGINT) AS num_median FROM r GROUP BY hypernym
""",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_descendants, p2_pairs, p3_found, p3_delimiters, p4_found, p4_loaded, p6_found)}
