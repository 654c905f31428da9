"""Queries of retrieval and of the is-a forest, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import filled, table
from ..functions.strings import base_of, written
from ..operators import annotate as A
from ..operators import isa_tree as T
from ..operators import retrieval as R
from ..operators.analyzer import words
from ..operators.coverage import counterparts, covered, exact_scores
from .annotate_queries import NODES, name_nodes, next_pairs, part_nodes
from .fixtures import MEMBERS, lexicon, nodes_sql, part_trees, values
from .lexicon_queries import _BASE, _G, groups, isa, senses, web
from .lexicon_queries import E as L

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def doc_terms(s: SparkSession, d: str) -> DataFrame:
    return R.term_nodes(table(s, d, "documents", "doc_id", "text"), "doc_id", words(F.col("text")))


_WORDS = "'[a-zà-öø-ÿ]+|[一-鿿々]+|[ァ-ヺー]+'"
_ALL = f"""WITH RECURSIVE t AS (SELECT {{0}} AS doc_id, unnest(regexp_extract_all(lower({{1}}), {_WORDS})) AS id FROM {{2}}),
tf AS (SELECT doc_id, id, CAST(count(*) AS DOUBLE) AS tf FROM t GROUP BY ALL), df AS (SELECT id, count(*) AS df FROM tf GROUP BY id), dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id),
st AS (SELECT avg(dl) AS mean, count(*) AS n FROM dl),
w AS (SELECT doc_id, id, tf, greatest(3.0 / ((0.5 + 1.5 * dl / mean) + tf) * ln((n - df + 0.5) / (df + 0.5)), 0) AS weight FROM tf JOIN df USING (id) JOIN dl USING (doc_id), st),
post AS (SELECT id, doc_id, tf * weight AS score FROM w WHERE tf * weight > 0),
q AS (SELECT def_id AS query, def_id // 200 AS topic, CASE WHEN def_id % 40 = 0 THEN 'DESCRIPTION' ELSE 'TITLE' END AS type, unnest(list_transform(t, lambda x, i: {{{{'id': x, 'bp': i}}}})) AS p FROM
  (SELECT def_id, regexp_extract_all(lower(split_part({_BASE.format("midasi").replace("{", "{{").replace("}", "}}")}, '/', 1)), {_WORDS}) AS t FROM definition WHERE def_id % 20 = 0)),
best AS (SELECT query, topic, type, doc_id, p.bp, max(score) AS s FROM q JOIN post ON post.id = q.p.id GROUP BY ALL),
rough AS (SELECT query, topic, type, doc_id, sum(s) AS score FROM best GROUP BY ALL)"""
_INDEX = _ALL.format("doc_id", "text", "documents")
_DEFS = _ALL.format("def_id", "def", "definition")


def definition_terms(s: SparkSession, d: str) -> DataFrame:
    return R.term_nodes(table(s, d, "definition", "def_id", "def"), "def_id", words(F.col("def")))


def query_words(s: SparkSession, d: str) -> DataFrame:
    """The headwords of every twentieth definition, as queries."""
    q = table(s, d, "definition", "def_id", "midasi").filter("def_id % 20 = 0")
    kind = F.when(F.col("def_id") % 40 == 0, "DESCRIPTION").otherwise("TITLE")
    topic = F.floor(F.col("def_id") / 200)
    return q.select(F.col("def_id").alias("query"), topic.alias("topic"), kind.alias("type"), words(written(F.col("midasi"))).alias("words"))


def query_nodes(s: SparkSession, d: str) -> DataFrame:
    n = query_words(s, d).select("query", "topic", "type", F.posexplode("words").alias("bp", "id"))
    return n.withColumns({"score": F.lit(1.0), "weight": F.lit(1.0)})


@query("q_tf", _INDEX + " SELECT doc_id, id, tf FROM tf")
def _(s, d):
    return R.term_frequencies(doc_terms(s, d))


@query("q_node_df", _INDEX + " SELECT id, df FROM df")
def _(s, d):
    return R.node_frequencies(R.term_frequencies(doc_terms(s, d)))


@query("q_bm25_weight", _INDEX + " SELECT doc_id, id, round(weight, 6) AS weight FROM w")
def _(s, d):
    return R.weighted_terms(doc_terms(s, d)).select("doc_id", "id", F.round("weight", 6).alias("weight"))


@query("q_postings", _INDEX + " SELECT id, doc_id, round(score, 4) AS score FROM post")
def _(s, d):
    return R.postings(doc_terms(s, d)).select("id", "doc_id", F.round("score", 4).alias("score"))


@query(
    "q_rough_search",
    _DEFS + ", r AS (SELECT query, doc_id, round(score, 6) AS score FROM rough) SELECT query, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 100",
)
def _(s, d):
    return R.top(R.rough_scores(query_nodes(s, d), R.postings(definition_terms(s, d))), "query", "doc_id", 100)


@query(
    "q_rough_topic",
    _DEFS
    + """, r AS (SELECT topic, doc_id, round(sum(score * CASE WHEN type = 'DESCRIPTION' THEN 1.0 ELSE 0.5 END), 6) AS score FROM rough GROUP BY ALL)
SELECT topic, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 300""",
)
def _(s, d):
    return R.top(R.topic_scores(query_nodes(s, d), R.postings(definition_terms(s, d))), "topic", "doc_id", 300)


@query(
    "q_doc_rollup",
    _DEFS + " SELECT query, CAST(doc_id // 10 AS VARCHAR) AS doc_id, round(sum(score), 6) AS score FROM rough GROUP BY ALL",
)
def _(s, d):
    scores = R.rough_scores(query_nodes(s, d), R.postings(definition_terms(s, d)))
    named = scores.withColumn("sid", F.concat(F.floor(F.col("doc_id") / 10).cast("string"), F.lit(","), (F.col("doc_id") % 10).cast("string")))
    return R.roll_up(named.drop("doc_id"), "sid").withColumn("score", F.round("score", 6))


_CHAINS = f""", qw AS (SELECT query, bp, w AS id, n FROM (SELECT def_id AS query, t, len(t) AS n, unnest(generate_series(1, len(t))) AS bp, unnest(t) AS w FROM
  (SELECT def_id, regexp_extract_all(lower(split_part({_BASE.format("midasi")}, '/', 1)), {_WORDS}) AS t FROM definition WHERE def_id % 20 = 0))),
dw AS (SELECT doc_id, bp, w AS id, n FROM (SELECT def_id AS doc_id, len(t) AS n, unnest(generate_series(1, len(t))) AS bp, unnest(t) AS w FROM (SELECT def_id, regexp_extract_all(lower(def), {_WORDS}) AS t FROM definition))),
qf AS (SELECT query, id, min(bp) AS seat, count(*) AS often FROM qw GROUP BY ALL), dfp AS (SELECT doc_id, id, min(bp) AS seat, count(*) AS often FROM dw GROUP BY ALL)"""


@query(
    "q_exact_search",
    _DEFS
    + _CHAINS
    + """, cand AS (SELECT query, doc_id FROM (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc_id) AS rank FROM rough) WHERE rank <= 100),
fm AS (SELECT c.query, c.doc_id, qw.bp, qw.n, f.seat, lead(f.seat) OVER (PARTITION BY c.query, c.doc_id ORDER BY qw.bp) AS nxt FROM cand c JOIN qw USING (query) LEFT JOIN dfp f ON f.doc_id = c.doc_id AND f.id = qw.id),
bm AS (SELECT c.query, c.doc_id, dw.bp, dw.n, f.seat, lead(f.seat) OVER (PARTITION BY c.query, c.doc_id ORDER BY dw.bp) AS nxt FROM cand c JOIN dw USING (doc_id) LEFT JOIN qf f ON f.query = c.query AND f.id = dw.id),
fs AS (SELECT query, doc_id, (count(seat) + 0.5 * count(*) FILTER (seat + 1 = nxt)) / (any_value(n) + 0.5 * (any_value(n) - 1)) AS s FROM fm GROUP BY ALL),
bs AS (SELECT query, doc_id, (count(seat) + 0.5 * count(*) FILTER (seat + 1 = nxt)) / (any_value(n) + 0.5 * (any_value(n) - 1)) AS s FROM bm GROUP BY ALL),
r AS (SELECT query, doc_id, round(fs.s * bs.s, 6) AS score, fs.s * bs.s AS raw FROM fs JOIN bs USING (query, doc_id) WHERE fs.s * bs.s >= 0.00001)
SELECT query, doc_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INT) AS rank FROM r""",
)
def _(s, d):
    docs = table(s, d, "definition", "def_id", "def").select(F.col("def_id").alias("doc_id"), words(F.col("def")).alias("words"))
    return R.search(query_words(s, d).select("query", "words"), docs)


@query(
    "q_topic_search",
    _DEFS
    + _CHAINS
    + """, topics AS (SELECT DISTINCT query, topic, type FROM q), tsum AS (SELECT topic, doc_id, round(sum(score * CASE WHEN type = 'DESCRIPTION' THEN 1.0 ELSE 0.5 END), 6) AS score FROM rough GROUP BY ALL), tcand AS (SELECT topic, doc_id FROM (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS rank FROM tsum) WHERE rank <= 1000),
em AS (SELECT t.query, t.topic, t.type, c.doc_id, qw.bp, f.seat, f.often, w.weight AS v, lead(f.seat) OVER per AS nxt, lead(w.weight) OVER per AS beside FROM tcand c JOIN topics t USING (topic) JOIN qw ON qw.query = t.query
  LEFT JOIN dfp f ON f.doc_id = c.doc_id AND f.id = qw.id LEFT JOIN w ON w.doc_id = c.doc_id AND w.id = qw.id WINDOW per AS (PARTITION BY t.query, c.doc_id ORDER BY qw.bp)),
es AS (SELECT topic, doc_id, sum((coalesce(v * often, 0) + CASE WHEN seat + 1 = nxt THEN 0.5 * (v + beside) ELSE 0 END) * CASE WHEN type = 'DESCRIPTION' THEN 1.0 ELSE 0.5 END) AS s FROM em GROUP BY ALL),
r AS (SELECT topic, doc_id, round(s, 6) AS score FROM es WHERE s > 0)
SELECT topic, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 300""",
)
def _(s, d):
    docs = table(s, d, "definition", "def_id", "def").select(F.col("def_id").alias("doc_id"), F.col("def_id").alias("sid"), words(F.col("def")).alias("words"))
    return R.topic_search(query_words(s, d), docs)


_FEATURES = """CASE WHEN bp = 0 THEN ['', 'ガ', 'ヲ'][length(sid) % 3 + 1] ELSE '' END AS "case", bp = 1 AND length(sid) % 2 = 0 AS ukemi, bp = 0 AND length(sid) % 7 = 0 AS kanou, bp = 1 AND length(sid) % 5 = 0 AS shieki"""


def featured_nodes(s: SparkSession, d: str) -> DataFrame:
    """Nodes of part names whose phrases have case, voice and potential by the length of the name."""
    n, size = name_nodes(s, d), F.length("sid")
    case = F.when(F.col("bp") == 0, F.element_at(F.array(F.lit(""), F.lit("ガ"), F.lit("ヲ")), size % 3 + 1)).otherwise("")
    return n.withColumns({"case": case, "ukemi": (F.col("bp") == 1) & (size % 2 == 0), "kanou": (F.col("bp") == 0) & (size % 7 == 0), "shieki": (F.col("bp") == 1) & (size % 5 == 0)})


_EXACT_GRAPHS = f"""
, np AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1), dirs AS (SELECT a, b FROM np UNION SELECT b, a FROM np),
n AS (SELECT *, {_FEATURES} FROM nodes),
met AS (SELECT d.a, d.b, x.bp, x.id, x.score, x.weight, x.first, x.negation, x.relation, y.id IS NOT NULL AS met, coalesce(x.relation AND y.relation, false) AS sib, y.bp AS seat, y.first AS seat_first, y.relation AS yrel,
  CASE WHEN y.id IS NULL OR x.relation AND y.relation THEN 0 ELSE x.score * x.weight * y.score * CASE WHEN x.kanou <> y.kanou THEN 0.8 ELSE 1 END END AS kept,
  y.id IS NOT NULL AND NOT (x.relation AND y.relation) AND x."case" <> '' AND y."case" <> '' AND x."case" <> y."case" AS by_case, coalesce(NOT (x.relation AND y.relation) AND x.ukemi <> y.ukemi, false) AS by_passive, coalesce(NOT (x.relation AND y.relation) AND x.shieki <> y.shieki, false) AS by_causative,
  coalesce(NOT (x.relation AND y.relation) AND (CAST(x.negation AS INT) + CAST(y.negation AS INT) + CAST(x.antonym AS INT) + CAST(y.antonym AS INT)) % 2 = 1, false) AS by_sign
  FROM dirs d JOIN n x ON x.sid = d.a LEFT JOIN n y ON y.sid = d.b AND y.id = x.id),
m2 AS (SELECT *, kept * CASE WHEN by_case THEN 0.3 ELSE 1 END * CASE WHEN by_passive THEN 0.3 ELSE 1 END * CASE WHEN by_causative THEN 0.3 ELSE 1 END * CASE WHEN by_sign THEN 0.3 ELSE 1 END AS risked FROM met),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b, bp, id, weight, negation ORDER BY kept DESC, risked DESC, seat) AS k FROM m2) WHERE k = 1),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY kept DESC, score DESC, id, weight) AS j FROM own WHERE bp = 0) WHERE j = 1),
high0 AS (SELECT h.*, h.first = 1 AS kid, l.met AS lmet, l.sib AS lsib, l.seat AS lseat, l.weight AS lweight, length(h.a) % 4 = 0 AS clause, l.by_sign AS lsign,
  CASE WHEN length(h.a) % 4 = 0 AND l.by_sign THEN l.risked ELSE l.kept END AS lkept, CASE WHEN length(h.a) % 4 = 0 AND NOT l.by_sign THEN l.kept ELSE l.risked END AS lrisked, CAST(l.by_case AS INT) AS lcase
  FROM own h JOIN low l USING (a, b) WHERE h.bp = 1),
high1 AS (SELECT *, kept + CASE WHEN kid THEN lkept ELSE 0 END AS tk, risked + CASE WHEN kid THEN lrisked ELSE 0 END AS tr, CAST(by_case AS INT) + CASE WHEN kid THEN lcase ELSE 0 END AS cases,
  by_sign <> (kid AND NOT clause AND lsign) AS turned FROM high0),
high2 AS (SELECT *, CASE WHEN kid AND met AND (cases = 2 AND (by_sign OR by_passive) OR cases = 1 AND by_causative) THEN 0 ELSE cases END AS c2, CASE WHEN kid AND met AND cases = 2 AND by_sign THEN NOT turned ELSE turned END AS t2,
  CASE WHEN kid AND met AND cases = 2 AND NOT by_sign THEN false ELSE by_passive END AS p2 FROM high1),
top AS (SELECT *, t2 OR met AND (c2 > 0 OR p2) AS spoilt FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY tk DESC, score DESC, id, weight) AS j FROM high2) WHERE j = 1),
cov AS (SELECT a, b, CASE WHEN kid THEN weight + lweight + 0.5 * 1 ELSE weight END AS total,
  CASE WHEN kid AND lmet AND met AND NOT lsib AND seat = 1 AND seat_first = 1 AND lseat = 0 THEN CASE WHEN clause THEN NOT lsign ELSE NOT spoilt END ELSE false END AS hit, CASE WHEN spoilt THEN tr ELSE tk END AS v FROM top),
sc AS (SELECT a, b, (v + CASE WHEN hit THEN 0.5 ELSE 0 END) / total AS s FROM cov)
SELECT a, b, round(x.s * y.s, 6) AS score FROM np JOIN sc x USING (a, b) JOIN (SELECT a AS b, b AS a, s FROM sc) y USING (a, b) WHERE x.s > 0 AND y.s > 0"""


@query("q_exact_graphs", nodes_sql("SELECT DISTINCT p_name AS sid, p_name AS name FROM part") + _EXACT_GRAPHS)
def _(s, d):
    nodes = featured_nodes(s, d)
    clauses = nodes.filter((F.col("bp") == 0) & (F.length("sid") % 4 == 0)).select("sid", "bp")
    return exact_scores(next_pairs(s, d).select("a", "b"), nodes, nodes, clauses).select("a", "b", F.round("score", 6).alias("score"))


@query(
    "q_match_explanation",
    nodes_sql("SELECT DISTINCT p_name AS sid, p_name AS name FROM part")
    + """, np AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1),
met AS (SELECT a, b, x.bp, x.id, x.score, x.weight, x.first, y.bp AS seat, y.first AS seat_first, CASE WHEN y.id IS NULL OR x.relation AND y.relation THEN 0 ELSE x.score * x.weight * y.score END AS kept,
  CASE WHEN (CAST(x.negation AS INT) + CAST(y.negation AS INT) + CAST(x.antonym AS INT) + CAST(y.antonym AS INT)) % 2 = 1 THEN 1 ELSE 0 END AS off, CASE WHEN x.relation OR y.relation THEN 'isa' WHEN x.antonym OR y.antonym THEN 'antonym' ELSE 'syn' END AS kind, x.negation
  FROM np JOIN nodes x ON x.sid = a LEFT JOIN nodes y ON y.sid = b AND y.id = x.id),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b, bp, id, weight, negation ORDER BY kept DESC, off, seat) AS k FROM met) WHERE k = 1),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY kept DESC, score DESC, id, weight) AS j FROM own WHERE bp = 0) WHERE j = 1),
high AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY a, b ORDER BY h.kept + CASE WHEN h.first = 1 THEN l.kept ELSE 0 END DESC, h.score DESC, h.id, h.weight) AS j FROM own h JOIN low l USING (a, b) WHERE h.bp = 1) WHERE j = 1),
shown AS (SELECT a, b, 1 AS o, first, 1 AS bp, seat, seat_first, kind FROM high WHERE seat IS NOT NULL UNION ALL SELECT l.a, l.b, 0, 0, 0, l.seat, l.seat_first, l.kind FROM low l JOIN high h USING (a, b) WHERE h.first = 1 AND l.seat IS NOT NULL)
SELECT a, b, CASE WHEN first < bp THEN '0,1' ELSE CAST(bp AS VARCHAR) END AS one, CASE WHEN seat_first < seat THEN '0,1' ELSE CAST(seat AS VARCHAR) END AS two, kind FROM shown""",
)
def _(s, d):
    nodes = name_nodes(s, d)
    why = covered(next_pairs(s, d).select("a", "b").distinct(), nodes, counterparts(nodes)).select("a", "b", F.explode("why").alias("w"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return why.select("a", "b", text(F.col("w.one")).alias("one"), text(F.col("w.two")).alias("two"), "w.kind")


_EDGES = f"""WITH RECURSIVE e0 AS (SELECT DISTINCT {_BASE.format("hyponym")} AS child, {_BASE.format("hypernym")} AS parent FROM isa WHERE hyponym <> '' AND hypernym <> ''),
e1 AS (SELECT * FROM e0 WHERE child <> parent), cyc AS (SELECT a.child AS word FROM e1 a JOIN e1 b ON a.child = b.parent AND a.parent = b.child),
e AS (SELECT child, parent FROM e1 WHERE child NOT IN (SELECT word FROM cyc) AND parent NOT IN (SELECT word FROM cyc)),
one AS (SELECT child, min(parent) AS parent FROM e GROUP BY child)"""
_TREE = (
    _EDGES
    + """, tree AS (SELECT child AS node, parent AS root, 1 AS depth, [parent, child] AS path FROM one WHERE parent NOT IN (SELECT child FROM one)
  UNION ALL SELECT o.child, t.root, t.depth + 1, list_append(t.path, o.child) FROM tree t JOIN one o ON o.parent = t.node),
anc AS (SELECT node, depth, unnest(path[:-2]) AS ancestor, unnest(generate_series(1, depth)) AS k FROM tree),
below AS (SELECT ancestor, count(*) AS n, max(depth + 1 - k) AS height FROM anc GROUP BY ancestor)"""
)


def edges(s: SparkSession, d: str) -> DataFrame:
    return T.without_two_cycles(T.load_edges(isa(s, d)))


@query("q_isa_two_cycle_cut", _EDGES + " SELECT child, parent FROM e")
def _(s, d):
    return edges(s, d)


@query("q_isa_subtree", _TREE + " SELECT ancestor AS word, n + 1 AS n_words, CAST(height AS INT) AS height FROM below")
def _(s, d):
    return T.subtrees(edges(s, d))


@query("q_isa_ancestors", _TREE + " SELECT ancestor, node, CAST(depth + 1 - k AS INT) AS distance FROM anc")
def _(s, d):
    return T.relatives(edges(s, d))


@query(
    "q_isa_coordinate",
    _TREE + ", c AS (SELECT t.node AS word, r.n + 1 - 1 - t.depth - coalesce(b.n, 0) AS n_coordinate FROM tree t JOIN below r ON r.ancestor = t.root LEFT JOIN below b ON b.ancestor = t.node) SELECT word, n_coordinate FROM c WHERE n_coordinate > 0",
)
def _(s, d):
    return T.coordinate_counts(edges(s, d))


@query(
    "q_isa_tree_lines",
    _TREE
    + """, kids AS (SELECT parent, count(DISTINCT child) AS n FROM e GROUP BY parent)
SELECT root, root AS path, root || '[' || n || ']' AS line FROM (SELECT DISTINCT root FROM tree) JOIN kids ON parent = root
UNION ALL SELECT root, array_to_string(path, '>'), repeat('  ', depth) || node FROM tree""",
)
def _(s, d):
    return T.tree_lines(edges(s, d))


@query(
    "q_isa_frequency_cut",
    _EDGES + ", f AS (SELECT word1 AS w FROM synonym_web_news WHERE word1 <> '' GROUP BY 1 HAVING count(*) > 3), c AS (SELECT w FROM f WHERE w NOT IN (SELECT child FROM e)) SELECT child, parent FROM e WHERE child NOT IN (SELECT w FROM c) AND parent NOT IN (SELECT w FROM c)",
)
def _(s, d):
    e = edges(s, d)
    df = web(s, d).filter(filled("w1")).groupBy(F.col("w1").alias("word")).agg(F.count(F.lit(1)).alias("df"))
    return T.without_words(e, T.too_frequent(e, df, 3, only_roots=True))


@query(
    "q_isa_ambiguous_cut",
    _EDGES + r" SELECT child, parent FROM e WHERE child NOT IN (SELECT regexp_extract(word_id, '^(.+):[0-9]+/[0-9]+$', 1) FROM aimai_synonym_isa WHERE regexp_matches(word_id, '^.+:[0-9]{1,9}/[0-9]+$'))",
)
def _(s, d):
    return T.without_ambiguous_parents(edges(s, d), senses(s, d))


@query(
    "q_isa_categories",
    _EDGES
    + f""", c AS (SELECT {_BASE.format("hypernym")} AS word, string_agg(DISTINCT origin, ';' ORDER BY origin) AS category FROM isa WHERE hypernym <> '' AND origin <> '' GROUP BY 1)
SELECT root, coalesce(category, '無') AS category FROM (SELECT DISTINCT parent AS root FROM e WHERE parent NOT IN (SELECT child FROM e)) LEFT JOIN c ON c.word = root""",
)
def _(s, d):
    origins = table(s, d, "isa", "hypernym", "origin").filter(filled("hypernym")).select(base_of(F.col("hypernym")).alias("word"), F.col("origin").alias("category"))
    return T.root_categories(edges(s, d), origins)


@query(
    "q_tm_match",
    NODES
    + """, mm AS (SELECT 't:' || expression AS stid, expression FROM mem), x AS (SELECT sid, bp, stid, [bp] AS covered, max(score) AS score FROM nodes JOIN mm ON mm.expression = nodes.id WHERE weight = 1 GROUP BY ALL
  UNION ALL SELECT h.sid, 1, stid, [0, 1], (h.score + arg_max(c.score * CASE WHEN c.negation THEN 0.3 ELSE 1 END, (c.score, CASE WHEN c.negation THEN 0 ELSE 1 END))) / 2 FROM mm JOIN nodes h ON h.bp = 1 AND h.weight = 1 AND h.id = string_split(mm.expression, ' ')[2]
  JOIN nodes c ON c.sid = h.sid AND c.bp = 0 AND c.id = string_split(mm.expression, ' ')[1] WHERE contains(mm.expression, ' ') GROUP BY h.sid, stid, h.score, h.negation)
SELECT sid AS p_partkey, CAST(bp AS INT) AS bp, stid, array_to_string(covered, ',') AS covered, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sid, covered ORDER BY score DESC, stid) AS k FROM x) WHERE k <= 2""",
)
def _(s, d):
    memory = lexicon(s).members.select(F.concat(F.lit("t:"), F.array_join("words", " ")).alias("stid"), "words")
    found = A.memory_matches(part_nodes(s, d), part_trees(s, d), memory, most=2)
    return found.select(F.col("sid").alias("p_partkey"), "bp", "stid", F.array_join(F.transform("covered", lambda x: x.cast("string")), ",").alias("covered"), F.round("score", 6).alias("score"))


@query(
    "q_distributional_similarity",
    _G
    + """, ok AS (SELECT line_no FROM g GROUP BY line_no HAVING count(*) <= 40), u AS (SELECT DISTINCT line_no, word FROM g JOIN ok USING (line_no)),
p AS (SELECT DISTINCT a.word AS w1, b.word AS w2 FROM u a JOIN u b ON a.line_no = b.line_no AND a.word < b.word),
f AS (SELECT w, x, count(*) AS n FROM (SELECT word1 AS w, word2 AS x FROM synonym_web_news UNION ALL SELECT word2, word1 FROM synonym_web_news) WHERE w <> '' AND x <> '' GROUP BY ALL),
s AS (SELECT w, x FROM (SELECT w, x, n, sum(n) OVER (PARTITION BY w) AS nw, sum(n) OVER (PARTITION BY x) AS nf, sum(n) OVER () AS total FROM f) WHERE n * total > nw * nf),
c AS (SELECT w, count(*) AS n FROM s GROUP BY w), k AS (SELECT p.w1, p.w2, count(*) AS k FROM p JOIN s a ON a.w = p.w1 JOIN s b ON b.w = p.w2 AND b.x = a.x GROUP BY ALL)
SELECT p.w1, p.w2, round(coalesce((k / least(a.n, b.n) + k / (a.n + b.n - k)) / 2, 0), 6) AS score FROM p LEFT JOIN k USING (w1, w2) LEFT JOIN c a ON a.w = p.w1 LEFT JOIN c b ON b.w = p.w2""",
)
def _(s, d):
    w = web(s, d).filter(filled("w1") & filled("w2"))
    both = w.select(F.col("w1").alias("word"), F.col("w2").alias("feature")).unionByName(w.select(F.col("w2").alias("word"), F.col("w1").alias("feature")))
    pairs = L.group_pairs(groups(s, d)).select("w1", "w2")
    return R.distributional_similarity(pairs, both.withColumn("n", F.lit(1))).withColumn("score", F.round("score", 6))


_PARTS = r"list_filter(regexp_split_to_array({}, '[・]'), lambda x: x <> '')"


@query(
    "q_lexicon_fixpoint",
    _G
    + f""", m AS (SELECT DISTINCT 's' || line_no AS synid, {_PARTS.format(_BASE.format("word"))} AS words FROM g), k AS (SELECT synid, words, array_to_string(words, ' ') AS expression FROM m WHERE len(words) = 2),
b AS (SELECT DISTINCT synid, expression, i - 1 AS bp, words[i] AS id, 1.0 AS score FROM k, (VALUES (1), (2)) v(i)),
one AS (SELECT b.synid, b.expression, b.bp, m.synid AS id, 0.99 AS score FROM b JOIN m ON len(m.words) = 1 AND m.words[1] = b.id AND m.synid <> b.synid),
two AS (SELECT a.synid, a.expression, 1 AS bp, c.synid AS id, 0.99 AS score FROM k a JOIN k c ON a.expression = c.expression AND a.synid <> c.synid)
SELECT synid, expression, CAST(bp AS INT) AS bp, id, round(max(score), 6) AS score, count(*) AS n FROM (SELECT * FROM b UNION ALL SELECT DISTINCT * FROM one UNION ALL SELECT DISTINCT * FROM two) GROUP BY synid, expression, bp, id""",
)
def _(s, d):
    parts = F.filter(F.split(base_of(F.col("word")), "・"), lambda x: x != "")
    members = groups(s, d).select(F.concat(F.lit("s"), "line_no").alias("synid"), parts.alias("words")).filter("size(words) between 1 and 2").distinct()
    c = A.compile_members(members)
    return c.groupBy("synid", "expression", "bp", "id").agg(F.round(F.max("score"), 6).alias("score"), F.count(F.lit(1)).alias("n"))


@query(
    "q_compiled_heads",
    f"WITH {values(MEMBERS, 'mem', 'synid, expression')} SELECT string_split(expression, ' ')[2] AS node_id, 1 AS child_num, synid, expression FROM mem WHERE contains(expression, ' ')",
)
def _(s, d):
    return A.compiled_heads(A.compile_members(lexicon(s).members))


@query("q_expand_group", _G + " SELECT 's' || line_no AS synid, string_agg(DISTINCT word, '|' ORDER BY word) AS members, count(DISTINCT word) AS n FROM g GROUP BY line_no")
def _(s, d):
    g = groups(s, d).groupBy("line_no").agg(F.array_sort(F.collect_set("word")).alias("w"))
    return g.select(F.concat(F.lit("s"), "line_no").alias("synid"), F.array_join("w", "|").alias("members"), F.size("w").cast("long").alias("n"))


QUERIES = Q
