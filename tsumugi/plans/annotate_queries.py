"""Queries of annotation and similarity, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import NodeOptions
from ..functions.runtime import filled, table
from ..functions.strings import base_of
from ..operators import annotate as A
from ..operators import similarity as M
from ..operators.analyzer import case_phrases, chain_trees, words
from .fixtures import ANTONYMS, MEMBERS, WHOLE, inline, lexicon, name_trees, nodes_sql, part_trees, values
from .lexicon_queries import _G, groups, isa, web

Q = {}
SQL = {}
NODES = nodes_sql()
NAMES = nodes_sql("SELECT DISTINCT p_name AS sid, p_name AS name FROM part")


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def shown(nodes: DataFrame, key: str = "p_partkey", *more: str) -> DataFrame:
    return nodes.select(F.col("sid").alias(key), "bp", F.col("id").alias("node_id"), F.round("score", 6).alias("score"), *more)


def part_nodes(s: SparkSession, d: str, options: NodeOptions | None = None) -> DataFrame:
    return A.attach(part_trees(s, d), lexicon(s), options)


def name_nodes(s: SparkSession, d: str) -> DataFrame:
    return A.attach(name_trees(s, d), lexicon(s))


@query(
    "q_basic_nodes",
    "SELECT p_partkey, CAST(i - 1 AS INT) AS bp, string_split(p_name, ' ')[i] AS node_id, CAST(1 AS DOUBLE) AS score, CAST(CASE WHEN i = 1 THEN 1 ELSE -1 END AS INT) AS parentbp, CAST(i - 1 AS INT) AS n_children FROM part, (VALUES (1), (2)) v(i)",
)
def _(s, d):
    t = part_trees(s, d)
    return A.basic_nodes(t).join(t.select("sid", "bp", "parentbp"), ["sid", "bp"]).select(F.col("sid").alias("p_partkey"), "bp", F.col("id").alias("node_id"), "score", "parentbp", F.size("childbp").alias("n_children"))


@query("q_attach_single", NODES + " SELECT sid AS p_partkey, CAST(bp AS INT) AS bp, id AS node_id, round(score, 6) AS score FROM nodes WHERE id LIKE 'g%' AND weight = 1 AND length(id) = 2")
def _(s, d):
    return shown(part_nodes(s, d).filter("id like 'g_' and weight = 1"))


@query("q_attach_two_phrase", NODES + " SELECT sid AS p_partkey, CAST(bp AS INT) AS bp, id AS node_id, round(score, 6) AS score, antonym, negation FROM nodes WHERE weight = 2 AND NOT relation")
def _(s, d):
    return shown(part_nodes(s, d).filter("weight = 2 and not relation"), "p_partkey", "antonym", "negation")


@query("q_hypernym_attach", NODES + " SELECT sid AS p_partkey, CAST(bp AS INT) AS bp, id AS node_id, round(score, 6) AS score, CAST(hypo_num AS INT) AS hypo_num FROM nodes WHERE relation AND hypo_num <= 2")
def _(s, d):
    return shown(part_nodes(s, d, NodeOptions(max_hyponyms=2)).filter("relation"), "p_partkey", "hypo_num")


@query("q_antonym_attach", NODES + " SELECT sid AS p_partkey, CAST(bp AS INT) AS bp, id AS node_id, round(score, 6) AS score, negation FROM nodes WHERE antonym")
def _(s, d):
    return shown(part_nodes(s, d).filter("antonym"), "p_partkey", "negation")


@query(
    "q_threshold_dedup",
    NODES + " SELECT sid AS p_partkey, CAST(bp AS INT) AS bp, id AS node_id, round(score, 6) AS score, weight, relation, antonym, negation, CAST(hypo_num AS INT) AS hypo_num, CAST(first AS INT) AS first FROM nodes",
)
def _(s, d):
    first = F.array_min(F.array_append("matchbp", F.col("bp"))).alias("first")
    return shown(part_nodes(s, d), "p_partkey", "weight", "relation", "antonym", "negation", "hypo_num", first)


@query("q_node_counts", NODES + " SELECT id AS node_id, count(*) AS n, round(avg(score), 6) AS mean_score FROM nodes GROUP BY id")
def _(s, d):
    return part_nodes(s, d).groupBy(F.col("id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


_UP = """, ups AS (SELECT sid, bp, id, score, weight, 0 AS up FROM nodes WHERE NOT relation AND NOT antonym),
rec AS (SELECT * FROM ups UNION ALL SELECT r.sid, r.bp, p.parent, r.score * 0.7, r.weight, r.up + 1 FROM rec r JOIN par p ON p.synid = r.id WHERE r.up < 9)
SELECT sid AS p_partkey, CAST(bp AS INT) AS bp, id AS node_id, round(max(score), 6) AS score FROM rec WHERE up > 0 GROUP BY ALL"""


@query("q_hypernym_recursive", NODES.replace("WITH ", "WITH RECURSIVE ", 1) + _UP)
def _(s, d):
    n = part_nodes(s, d, NodeOptions(recursive=True, antonyms=True)).filter("relation and not antonym")
    return n.groupBy(F.col("sid").alias("p_partkey"), "bp", F.col("id").alias("node_id")).agg(F.round(F.max("score"), 6).alias("score"))


@query(
    "q_full_cover_hypernym",
    NODES + WHOLE + ", h AS (SELECT sid, count(DISTINCT id) AS n, min(id) AS id FROM whole WHERE relation GROUP BY sid) SELECT p_partkey, CASE WHEN n = 1 THEN id ELSE '' END AS hypernym FROM part LEFT JOIN h ON h.sid = p_partkey",
)
def _(s, d):
    return A.only_hypernym(part_nodes(s, d)).withColumnRenamed("sid", "p_partkey")


@query("q_retrieve_sids", NODES + WHOLE + " SELECT sid AS p_partkey, type, string_agg(DISTINCT id, '|' ORDER BY id) AS ids FROM whole GROUP BY ALL")
def _(s, d):
    return A.ids_by_type(part_nodes(s, d)).withColumnRenamed("sid", "p_partkey")


@query("q_count_syn_nodes", NODES + " SELECT sid AS p_partkey, 2 AS n_phrases, count(*) FILTER (regexp_matches(id, '^[sg][0-9]')) AS n_group_nodes FROM nodes GROUP BY sid")
def _(s, d):
    return A.count_group_nodes(part_nodes(s, d)).withColumnRenamed("sid", "p_partkey")


@query("q_child_num_min", NODES + " SELECT sid AS p_partkey, CAST(min(CASE WHEN weight = 2 THEN 0 ELSE 1 END) AS INT) AS child_num FROM nodes WHERE bp = 1 GROUP BY sid")
def _(s, d):
    return A.least_children(part_nodes(s, d)).withColumnRenamed("sid", "p_partkey")


@query("q_head_index", f"WITH {values(MEMBERS, 'mem', 'synid, expression')} SELECT string_split(expression, ' ')[-1] AS node_id, CASE WHEN contains(expression, ' ') THEN 1 ELSE 0 END AS child_num, synid, expression FROM mem")
def _(s, d):
    return A.head_index(lexicon(s).members).select("node_id", "child_num", "synid", F.array_join("words", " ").alias("expression"))


@query(
    "q_format_lines",
    NODES
    + """ SELECT sid AS p_partkey, CAST(bp AS INT) AS bp, '! ' || CASE WHEN first < bp THEN '0,1' ELSE CAST(bp AS VARCHAR) END || ' <SYNID:' || id || '><スコア:' || regexp_replace(regexp_replace(printf('%.6f', score), '0+$', ''), '\\.$', '') || '>'
  || CASE WHEN antonym THEN '<反義語>' ELSE '' END || CASE WHEN relation THEN '<上位語>' ELSE '' END || coalesce('<下位語数:' || hypo_num || '>', '') || CASE WHEN negation THEN '<否定>' ELSE '' END AS line FROM nodes""",
)
def _(s, d):
    return A.node_lines(part_nodes(s, d)).withColumnRenamed("sid", "p_partkey")


def next_pairs(s, d):
    """Each part with the next one."""
    p = table(s, d, "part", "p_partkey", "p_name")
    return p.select("p_partkey", F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")


_NEXT = ", np AS (SELECT x.p_partkey, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"


@query(
    "q_match_pairs",
    NAMES
    + _NEXT
    + """, u AS (SELECT DISTINCT a, b FROM np),
cand AS (SELECT u.a, u.b, x.bp, x.score * y.score AS s, x.weight + y.weight AS w, (x.negation <> y.negation) AS diff, y.first AS first, x.first AS xfirst FROM u JOIN nodes x ON x.sid = u.a JOIN nodes y ON y.sid = u.b AND y.bp = x.bp AND y.id = x.id
  WHERE NOT (x.relation AND y.relation) AND NOT (x.antonym AND y.antonym)),
best AS (SELECT a, b, bp, arg_max({'s': s, 'diff': diff, 'first': first, 'xfirst': xfirst}, (s, w, CASE WHEN diff THEN 0 ELSE 1 END)) AS m FROM cand GROUP BY ALL),
sc AS (SELECT h.a, h.b, CASE WHEN h.m.first = 0 THEN h.m.s WHEN h.m.xfirst = 0 THEN NULL ELSE (h.m.s + c.m.s * CASE WHEN c.m.diff THEN 0.3 ELSE 1 END) / 2 END AS score FROM best h LEFT JOIN best c ON c.a = h.a AND c.b = h.b AND c.bp = 0 WHERE h.bp = 1)
SELECT p_partkey, round(score, 6) AS score FROM np LEFT JOIN sc USING (a, b)""",
)
def _(s, d):
    pairs = next_pairs(s, d)
    scored = M.match_pairs(pairs.select("a", "b").distinct(), A.attach(name_trees(s, d), lexicon(s)), ["a", "b"])
    return pairs.join(scored, ["a", "b"], "left").select("p_partkey", F.round("score", 6).alias("score"))


@query(
    "q_two_expression_relation",
    NAMES
    + WHOLE
    + _NEXT
    + """, r AS (SELECT np.p_partkey, min(CASE WHEN x.type = 'syn' AND y.type = 'syn' AND x.negation = y.negation THEN 1 WHEN (x.type = 'antonym') <> (y.type = 'antonym') OR x.negation <> y.negation THEN 2
  WHEN x.type = 'syn' AND y.type = 'isa' THEN 3 WHEN x.type = 'isa' AND y.type = 'syn' THEN 4 ELSE 5 END) AS k FROM np JOIN whole x ON x.sid = np.a JOIN whole y ON y.sid = np.b AND y.id = x.id GROUP BY 1)
SELECT p_partkey, coalesce((['syn', 'ant', 'isa_0', 'isa_1', 'none'])[k], 'none') AS relation FROM np LEFT JOIN r USING (p_partkey)""",
)
def _(s, d):
    pairs = next_pairs(s, d)
    related = M.two_expression_relation(pairs.select("a", "b").distinct(), A.attach(name_trees(s, d), lexicon(s)), ["a", "b"])
    return pairs.join(related, ["a", "b"]).select("p_partkey", "relation")


_SETS = values([(e, g) for g, e in MEMBERS if " " not in e], "sets", "word, set_id")
_ANT = values([*ANTONYMS, ("hot", "cold"), ("large", "small")], "opp", "w1, w2")


def plus_pairs(s, d):
    n = next_pairs(s, d)
    return n.select(F.regexp_replace("a", " ", "+").alias("w1"), F.regexp_replace("b", " ", "+").alias("w2")).distinct()


_POS = """, np AS (SELECT DISTINCT replace(x.p_name, ' ', '+') AS w1, replace(y.p_name, ' ', '+') AS w2 FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1),
pos AS (SELECT w1, w2, i, string_split(w1, '+')[i] AS p, string_split(w2, '+')[i] AS q FROM np, (VALUES (1), (2)) v(i)),
f AS (SELECT *, p = q OR EXISTS (SELECT 1 FROM sets a JOIN sets b USING (set_id) WHERE a.word = p AND b.word = q) AS same, EXISTS (SELECT 1 FROM opp WHERE opp.w1 = p AND opp.w2 = q OR opp.w1 = q AND opp.w2 = p) AS opposite FROM pos)"""


def small_sets(s):
    return inline(s, [(e, g) for g, e in MEMBERS if " " not in e], "word, set_id")


def no_pairs(s):
    return inline(s, [("", "")], "w1, w2").filter("w1 <> ''")


@query("q_is_synonym", f"WITH {_SETS}, {_ANT} {_POS} SELECT w1, w2, bool_and(same) AS synonym FROM f GROUP BY ALL")
def _(s, d):
    return M.is_synonym(plus_pairs(s, d), no_pairs(s), small_sets(s))


@query("q_is_antonym", f"WITH {_SETS}, {_ANT} {_POS} SELECT w1, w2, bool_and(same OR opposite) AND count(*) FILTER (opposite) % 2 = 1 AS antonym FROM f GROUP BY ALL")
def _(s, d):
    opposites = inline(s, [*ANTONYMS, ("hot", "cold"), ("large", "small")], "w1, w2")
    return M.is_antonym(plus_pairs(s, d), opposites, no_pairs(s), small_sets(s))


_BASE = r"regexp_replace({}, '(?::[0-9]+/[0-9]+)+$', '')"


def domain_nodes(s: SparkSession, d: str) -> DataFrame:
    """Headwords of definitions with the groups and hypernyms that the domain's own lists give them."""
    heads = table(s, d, "definition", "def_id", "midasi").filter(filled("midasi"))
    trees = chain_trees(heads, "def_id", F.array(base_of(F.col("midasi"))))
    members = groups(s, d).select(F.concat(F.lit("s"), "line_no").alias("synid"), F.array(base_of(F.col("word"))).alias("words")).distinct()
    up = isa(s, d).filter(filled("hypo") & filled("hyper")).groupBy(base_of(F.col("hypo")).alias("synid"), F.col("hyper").alias("parent")).agg(F.max("num").alias("hypo_num"))
    return A.attach(trees, A.Lexicon(members, up, no_pairs(s).toDF("synid", "other")))


@query(
    "q_annotate_headwords",
    _G
    + f""", b AS (SELECT def_id, {_BASE.format("midasi")} AS id FROM definition WHERE midasi <> ''), up AS (SELECT {_BASE.format("hyponym")} AS id, hypernym, max(num) AS num FROM isa WHERE hyponym <> '' AND hypernym <> '' GROUP BY ALL),
mem AS (SELECT DISTINCT 's' || line_no AS synid, {_BASE.format("word")} AS id FROM g),
one AS (SELECT def_id, id, 1.0 AS score, false AS relation, NULL AS hypo_num FROM b UNION ALL SELECT b.def_id, hypernym, 0.7, true, num FROM b JOIN up USING (id)),
two AS (SELECT * FROM one UNION ALL SELECT o.def_id, m.synid, score * 0.99, relation, NULL FROM one o JOIN mem m ON m.id = o.id)
SELECT def_id, id AS node_id, round(max(score), 6) AS score, bool_and(relation) AS relation FROM two GROUP BY ALL""",
)
def _(s, d):
    return domain_nodes(s, d).select(F.col("sid").alias("def_id"), F.col("id").alias("node_id"), F.round("score", 6).alias("score"), "relation")


@query("q_pair_store", "WITH p AS (SELECT DISTINCT hyponym AS w1, hypernym AS w2 FROM isa) SELECT w1, w2, EXISTS (SELECT 1 FROM synonym_web_news n WHERE n.word1 = w1 AND n.word2 = w2 OR n.word1 = w2 AND n.word2 = w1) AS listed FROM p")
def _(s, d):
    return M.pair_store_check(isa(s, d).select(F.col("hypo").alias("w1"), F.col("hyper").alias("w2")), web(s, d))


@query(
    "q_word_compatibility",
    f"""WITH p AS (SELECT pair_id, word1 AS a, word2 AS b, {_BASE.format("word1")} AS x, {_BASE.format("word2")} AS y FROM synonym_web_news WHERE word1 <> '' AND word2 <> '')
SELECT pair_id, (list_contains(list_concat([x], string_split(x, '/')), y) OR list_contains(list_concat([y], string_split(y, '/')), x)) AND (a[length(x) + 1:] = b[length(y) + 1:] OR a = x OR b = y) AS fits FROM p""",
)
def _(s, d):
    p = table(s, d, "synonym_web_news", "pair_id", "word1", "word2").filter(filled("word1") & filled("word2"))
    return p.select("pair_id", M.compatible(F.col("word1"), F.col("word2")).alias("fits"))


@query(
    "q_wsd_filter",
    NODES + " SELECT sid AS p_partkey, CAST(bp AS INT) AS bp, id AS node_id, round(score, 6) AS score FROM nodes WHERE NOT (bp = 1 AND (id = 'g2' AND sid % 2 = 0 OR id = 'g1' AND sid % 2 = 1))",
)
def _(s, d):
    n = part_nodes(s, d)
    resolved = n.filter("bp = 1").select("sid", "bp", F.lit("gear").alias("word"), F.when(F.col("sid") % 2 == 0, 1).otherwise(2).alias("m")).distinct()
    inventory = inline(s, [("gear", 1, "g1"), ("gear", 2, "g2")], "word, m, synid")
    return shown(A.without_other_senses(n, resolved, inventory))


@query("q_entry_containment", NODES + " SELECT sid AS p_partkey, CAST(bp AS INT) AS bp, id AS node_id, round(score, 6) AS score FROM nodes WHERE NOT (sid % 3 = 0 AND first = bp)")
def _(s, d):
    n = part_nodes(s, d)
    entries = n.filter("sid % 3 = 0").select("sid", F.lit(0).alias("first"), F.lit(1).alias("last")).distinct()
    return shown(A.outside_entries(n, entries))


@query(
    "q_flat_match",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+|[一-鿿々]+|[ァ-ヺー]+') AS t FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+|[一-鿿々]+|[ァ-ヺー]+') AS t FROM eval_items),
p AS (SELECT item_id, t[1] AS a, t[2] AS b, t[3] AS c FROM i WHERE len(t) >= 3), w AS (SELECT doc_id, t, unnest(generate_series(3, len(t))) AS k FROM t WHERE len(t) >= 3)
SELECT DISTINCT doc_id, CAST(k - 1 AS INT) AS bp, item_id FROM w JOIN p ON t[k] = c AND t[k - 1] = b AND t[k - 2] = a""",
)
def _(s, d):
    docs = table(s, d, "documents", "doc_id", "text").withColumn("t", words(F.col("text")))
    items = table(s, d, "eval_items", "item_id", "text").withColumn("t", words(F.col("text"))).filter(F.size("t") >= 3)
    phrases = items.select(F.col("item_id").alias("phrase"), F.slice("t", 1, 3).alias("words"))
    trees = chain_trees(docs, "doc_id", F.col("t")).select("sid", "bp", "id")
    return A.flat_matches(trees, phrases).toDF("doc_id", "bp", "item_id")


@query(
    "q_node_logs",
    NODES
    + """, plain AS (SELECT DISTINCT sid, bp, id AS f FROM nodes WHERE NOT relation AND NOT antonym), made AS (
  SELECT DISTINCT n.sid, n.bp, n.id, p.f || '=>' || n.id || '(上位)' AS log FROM nodes n JOIN plain p USING (sid, bp) JOIN par ON par.synid = p.f AND par.parent = n.id WHERE n.relation
  UNION SELECT n.sid, n.bp, n.id, p.f || '=>' || n.id || '(反義)' FROM nodes n JOIN plain p USING (sid, bp) JOIN ant ON ant.synid = p.f AND ant.other = n.id WHERE n.antonym
  UNION SELECT n.sid, n.bp, n.id, replace(m.expression, ' ', '+') || '=>' || n.id FROM nodes n JOIN mem m ON m.synid = n.id JOIN nodes h ON h.sid = n.sid AND h.bp = n.bp AND h.id = string_split(m.expression, ' ')[-1])
SELECT sid AS p_partkey, CAST(bp AS INT) AS bp, id AS node_id, log FROM made UNION SELECT sid, CAST(bp AS INT), id, id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.sid = n.sid AND m.bp = n.bp AND m.id = n.id)""",
)
def _(s, d):
    return A.node_logs(part_nodes(s, d), lexicon(s)).select(F.col("sid").alias("p_partkey"), "bp", F.col("id").alias("node_id"), "log")


@query(
    "q_group_inspector",
    _G
    + """, u AS (SELECT DISTINCT line_no, word FROM g), e AS (SELECT DISTINCT hyponym AS child, hypernym AS parent FROM isa WHERE hyponym <> '' AND hypernym <> ''),
up AS (SELECT line_no, string_agg(DISTINCT parent, '|' ORDER BY parent) AS parents FROM u JOIN e ON e.child = u.word GROUP BY line_no), dn AS (SELECT line_no, count(*) AS n FROM u JOIN e ON e.parent = u.word GROUP BY line_no),
m AS (SELECT line_no, string_agg(word, '|' ORDER BY word) AS members FROM u GROUP BY line_no)
SELECT line_no, members, coalesce(parents, '') AS parents, coalesce(n, 0) AS n_children FROM m LEFT JOIN up USING (line_no) LEFT JOIN dn USING (line_no)""",
)
def _(s, d):
    e = isa(s, d).filter(filled("hypo") & filled("hyper")).select(F.col("hypo").alias("child"), F.col("hyper").alias("parent"))
    return A.inspect_groups(groups(s, d), e)


@query(
    "q_case_phrases",
    """WITH x AS (SELECT def_id, regexp_extract_all(def, '([一-鿿々ァ-ヺーA-Za-zÀ-ÿ]+)(を|に|で|が|と)', 1) AS w, regexp_extract_all(def, '([一-鿿々ァ-ヺーA-Za-zÀ-ÿ]+)(を|に|で|が|と)', 2) AS c FROM definition),
y AS (SELECT def_id, w, c, unnest(generate_series(1, len(w))) AS i FROM x) SELECT def_id, CAST(i - 1 AS INT) AS pos, w[i] AS word, c[i] AS "case" FROM y""",
)
def _(s, d):
    return case_phrases(table(s, d, "definition", "def_id", "def"), "def_id", F.col("def"))


QUERIES = Q
