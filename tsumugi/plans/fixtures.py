"""A small lexicon over the words of part names, as tables and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import table
from ..operators.analyzer import chain_trees
from ..operators.annotate import Lexicon

# Members (group, expression), edges up (child, parent, hyponyms) and opposites.
MEMBERS = [
    ("g1", "rod"), ("g1", "bolt"), ("g2", "ring"), ("g2", "gear"), ("g3", "large"), ("g3", "big"), ("g4", "gizmo"), ("g4", "small widget"), ("g5", "anvil"), ("g5", "old plate"), ("g6", "hot"), ("g6", "red"),
]
PARENTS = [("g1", "fastener", 2), ("g2", "wheel", 2), ("fastener", "item", 4), ("wheel", "item", 4), ("g4", "item", 4), ("g5", "item", 4), ("widget", "item", 4)]
ANTONYMS = [("g3", "small"), ("g6", "cold"), ("new", "old")]


def inline(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few rows as a table that the optimiser knows the size of."""
    listed = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({columns})")


def lexicon(spark: SparkSession) -> Lexicon:
    members = inline(spark, MEMBERS, "synid, expression").select("synid", F.split("expression", " ").alias("words"))
    both = [*ANTONYMS, *((b, a) for a, b in ANTONYMS)]
    return Lexicon(members, inline(spark, PARENTS, "synid, parent, hypo_num"), inline(spark, both, "synid, other"))


def part_trees(spark: SparkSession, d: str) -> DataFrame:
    return chain_trees(table(spark, d, "part", "p_partkey", "p_name"), "p_partkey", F.split("p_name", " "))


def name_trees(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part", "p_name").distinct()
    return chain_trees(names, "p_name", F.split("p_name", " "))


def values(rows: list[tuple], name: str, columns: str) -> str:
    listed = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {listed})"


def nodes_sql(source: str = "SELECT p_partkey AS sid, p_name AS name FROM part") -> str:
    """CTEs up to ``nodes`` (sid, bp, id, score, weight, relation, antonym, negation, hypo_num, first): all nodes of two-word names."""
    both = [*ANTONYMS, *((b, a) for a, b in ANTONYMS)]
    up = "SELECT sid, bp, p.parent, score * 0.7, weight, true, false, negation, p.hypo_num, first FROM {0} n JOIN par p ON p.synid = n.id WHERE NOT relation AND NOT antonym AND score * 0.7 >= 0.5"
    op = "SELECT sid, bp, a.other, score * 0.8, weight, false, true, NOT negation, NULL, first FROM {0} n JOIN ant a ON a.synid = n.id WHERE NOT relation AND NOT antonym AND score * 0.8 >= 0.5"
    return f"""WITH {values(MEMBERS, "mem", "synid, expression")}, {values(PARENTS, "par", "synid, parent, hypo_num")}, {values(both, "ant", "synid, other")},
sents AS ({source}),
basic AS (SELECT sid, i - 1 AS bp, string_split(name, ' ')[i] AS id, CAST(1 AS DOUBLE) AS score, CAST(1 AS DOUBLE) AS weight, false AS relation, false AS antonym, false AS negation, CAST(NULL AS INT) AS hypo_num, i - 1 AS first
  FROM sents, (VALUES (1), (2)) v(i)),
b1 AS (SELECT * FROM basic UNION ALL {up.format("basic")} UNION ALL {op.format("basic")}),
s1 AS (SELECT sid, bp, m.synid AS id, score * 0.99 AS score, weight, relation, antonym, negation, CAST(NULL AS INT) AS hypo_num, first FROM b1 JOIN mem m ON m.expression = b1.id WHERE score * 0.99 >= 0.5),
one AS (SELECT * FROM b1 UNION ALL SELECT * FROM s1 UNION ALL {up.format("s1")} UNION ALL {op.format("s1")}),
pairs AS (SELECT h.sid, m.synid, h.score AS hs, h.relation AS hr, h.antonym AS ha, h.negation AS hn, arg_max({{'s': c.score, 'r': c.relation, 'a': c.antonym, 'n': c.negation}}, (c.score, CASE WHEN c.negation THEN 0 ELSE 1 END)) AS c
  FROM mem m JOIN one h ON h.bp = 1 AND h.id = string_split(m.expression, ' ')[2] JOIN one c ON c.sid = h.sid AND c.bp = 0 AND c.id = string_split(m.expression, ' ')[1]
  WHERE contains(m.expression, ' ') GROUP BY ALL),
t1 AS (SELECT sid, 1 AS bp, synid AS id, (hs + c.s * CASE WHEN c.n THEN 0.3 ELSE 1 END) / 2 * 0.99 AS score, CAST(2 AS DOUBLE) AS weight, hr OR c.r AS relation, ha OR c.a AS antonym, hn AS negation, CAST(NULL AS INT) AS hypo_num, 0 AS first FROM pairs),
t2 AS (SELECT * FROM t1 WHERE score >= 0.5),
every AS (SELECT * FROM one UNION ALL SELECT * FROM t2 UNION ALL {up.format("t2")} UNION ALL {op.format("t2")}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sid, bp, id, weight, negation ORDER BY score DESC, relation, antonym, first DESC, hypo_num) AS k FROM every),
nodes AS (SELECT sid, bp, id, score, weight, relation, antonym, negation, hypo_num, first FROM ranked WHERE k = 1)"""


WHOLE = """, whole AS (SELECT *, CASE WHEN antonym THEN 'antonym' WHEN relation OR score < 0.99 THEN 'isa' ELSE 'syn' END AS type FROM nodes WHERE bp = 1 AND first = 0)"""
