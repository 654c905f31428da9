"""Queries of the lexicon operators over the domain's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.runtime import filled, table
from ..operators import lexicon_etl as E


def groups(s: SparkSession, d: str) -> DataFrame:
    return E.read_groups(table(s, d, "synonym", "line_no", "syn_list"), "line_no", "syn_list")


def web(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "synonym_web_news", "word1", "word2").toDF("w1", "w2")


def isa(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "isa", "hyponym", "hypernym", "num").toDF("hypo", "hyper", "num")


def definitions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "definition", "def_id", "midasi", "def").toDF("def_id", "head", "def")


def senses(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "aimai_synonym_isa", "word_id", "sense_text").filter(F.col("word_id").rlike("^.+:[0-9]+/[0-9]+$"))
    return raw.select(
        F.regexp_extract("word_id", "^(.+):[0-9]+/[0-9]+$", 1).alias("word"), F.regexp_extract("word_id", ":([0-9]{1,9})/[0-9]+$", 1).try_cast("int").alias("m"), F.col("sense_text").alias("string")
    ).filter("m is not null")


Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_G = r"""WITH RECURSIVE g AS (SELECT line_no, w.i - 1 AS ord, w.x AS word FROM (SELECT line_no, unnest(list_transform(ws, lambda x, i: {'x': x, 'i': i})) AS w FROM
  (SELECT line_no, list_filter(regexp_split_to_array(syn_list, '[\s\x{1c}-\x{1f}\x{85}\p{Z},，、､﹐﹑;；﹔|｜¦￤]+'), lambda x: x <> '') AS ws FROM synonym)))"""
_BASE = r"regexp_replace({}, '(?::[0-9]+/[0-9]+)+$', '')"
_SENSE = r"regexp_extract({}, '((?::[0-9]+/[0-9]+)+)$', 1)"
_DEF = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '。$', ''), 'のこと$', ''), 'こと$', ''), 'い所$', 'い')"
_USABLE = r"NOT regexp_matches(regexp_replace({0}, '。$', ''), '物ごと|…') AND NOT regexp_matches(regexp_replace({0}, '。$', ''), 'の(?:一つ|一種)$')"
_SYM = "sym AS (SELECT DISTINCT w1, w2 FROM (SELECT word1 AS w1, word2 AS w2 FROM synonym_web_news UNION ALL SELECT word2, word1 FROM synonym_web_news) WHERE w1 <> '' AND w2 <> '' AND w1 <> w2)"
_CREATED = (
    _G
    + """, ok AS (SELECT line_no, count(*) AS n FROM g GROUP BY line_no HAVING count(*) <= 40),
named AS (SELECT g.line_no, 's' || row_number() OVER (ORDER BY g.line_no) || ':' || g.word AS synid FROM g JOIN ok USING (line_no) WHERE ord = 0),
members AS (SELECT n.line_no, n.synid, CAST(g.ord AS INT) AS ord, g.word FROM named n JOIN g USING (line_no))"""
)
_FIRSTS = f"""firsts AS (SELECT midasi AS head, {_DEF.format("arg_min(def, def_id)")} AS definition FROM definition WHERE midasi <> '' AND def <> '' AND {_USABLE.format("def")} GROUP BY midasi)"""


@query("q_group_members", _G + " SELECT line_no, CAST(ord AS INT) AS ord, word FROM g")
def _(s, d):
    return groups(s, d)


@query("q_group_size_sort", _G + " SELECT line_no, count(*) AS n_words FROM g GROUP BY line_no HAVING count(*) <= 40")
def _(s, d):
    return E.limit_groups(groups(s, d)).orderBy(F.desc("n_words"), "line_no")


@query("q_group_create", _CREATED + " SELECT line_no, synid, ord, word FROM members")
def _(s, d):
    return E.create_groups(groups(s, d))


@query("q_first_definitions", f"WITH {_FIRSTS} SELECT head, definition FROM firsts")
def _(s, d):
    return E.first_definitions(definitions(s, d))


@query(
    "q_definition_members",
    _CREATED
    + f""", {_FIRSTS}, used AS (SELECT synid, arg_min(head, ord) AS head, arg_min(definition, ord) AS definition FROM (SELECT m.synid, m.ord, f.head, f.definition FROM members m JOIN firsts f ON f.head = m.word) GROUP BY synid)
SELECT synid, definition AS word, '定義文' AS tag FROM used
UNION ALL SELECT 'd:' || head, head, 'DIC' FROM firsts WHERE head NOT IN (SELECT head FROM used)
UNION ALL SELECT 'd:' || head, definition, '定義文' FROM firsts WHERE head NOT IN (SELECT head FROM used)""",
)
def _(s, d):
    return E.definition_members(E.create_groups(groups(s, d)), definitions(s, d))


@query(
    "q_one_word_rename",
    _CREATED + " SELECT synid, min(word) AS new_id FROM members GROUP BY synid HAVING min(word) = max(word) AND contains(synid, '/')",
)
def _(s, d):
    return E.rename_singletons(E.create_groups(groups(s, d)))


@query(
    "q_get_synid",
    _CREATED
    + """, ids AS (SELECT word, min(synid) AS synid FROM members GROUP BY word), w AS (SELECT DISTINCT hypernym AS word FROM isa WHERE hypernym <> '')
SELECT w.word, coalesce(a.synid, b.synid, 'n:' || w.word) AS synid, coalesce(a.synid, b.synid) IS NOT NULL AS known FROM w LEFT JOIN ids a ON a.word = w.word LEFT JOIN ids b ON b.word = w.word || ':1/1:1/1'""",
)
def _(s, d):
    return E.get_ids(isa(s, d).select(F.col("hyper").alias("word")), E.create_groups(groups(s, d)))


@query(
    "q_contradiction",
    _G
    + f""", e AS (SELECT DISTINCT hyponym AS hypo, hypernym AS hyper FROM isa WHERE hyponym <> '' AND hypernym <> '')
SELECT hypo, hyper FROM e WHERE {_BASE.format("hypo")} = {_BASE.format("hyper")}
UNION SELECT e.hypo, e.hyper FROM e JOIN g a ON a.word = e.hypo JOIN g b ON b.word = e.hyper AND b.line_no = a.line_no""",
)
def _(s, d):
    return E.contradictions(isa(s, d), groups(s, d))


@query("q_isa_max", "SELECT hyponym AS hypo, hypernym AS hyper, max(num) AS num FROM isa WHERE hyponym <> '' AND hypernym <> '' GROUP BY ALL")
def _(s, d):
    return E.widest_edges(isa(s, d))


@query("q_isa_max_num", "SELECT hyponym AS hypo, hypernym AS hyper, num FROM isa WHERE num <= 1000 AND hyponym <> '' AND hypernym <> ''")
def _(s, d):
    return isa(s, d).filter(filled("hypo") & filled("hyper")).filter("num <= 1000")


@query("q_antonym_symmetric", f"WITH {_SYM} SELECT w1, w2 FROM sym")
def _(s, d):
    return E.symmetric(web(s, d))


@query(
    "q_pair_dedup",
    "WITH p AS (SELECT least(upper(word1), upper(word2)) AS w1, greatest(upper(word1), upper(word2)) AS w2 FROM synonym_web_news WHERE word1 <> '' AND word2 <> '') SELECT w1, w2, count(*) AS n FROM p WHERE w1 <> w2 GROUP BY ALL",
)
def _(s, d):
    return E.normalise_pairs(web(s, d))


@query(
    "q_all_pairs",
    _G + ", ok AS (SELECT line_no FROM g GROUP BY line_no HAVING count(*) <= 40), u AS (SELECT DISTINCT line_no, word FROM g JOIN ok USING (line_no)) SELECT a.line_no, a.word AS w1, b.word AS w2 FROM u a JOIN u b ON a.line_no = b.line_no AND a.word < b.word",
)
def _(s, d):
    return E.group_pairs(groups(s, d))


@query(
    "q_group_components",
    _G
    + f""", t AS (SELECT DISTINCT line_no, word FROM g WHERE {_SENSE.format("word")} <> ''),
e AS (SELECT DISTINCT a.line_no AS x, b.line_no AS y FROM t a JOIN t b USING (word)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS line_no, min(y) AS component FROM r GROUP BY x)
SELECT g.line_no, coalesce(any_value(c.component), g.line_no) AS component FROM g LEFT JOIN c USING (line_no) GROUP BY g.line_no""",
)
def _(s, d):
    return E.connected_groups(groups(s, d))


@query(
    "q_group_division",
    _G
    + """, u AS (SELECT DISTINCT line_no, word FROM g), n AS (SELECT line_no, count(*) AS n FROM u GROUP BY line_no),
p AS (SELECT a.line_no, b.line_no AS inside, count(*) AS k FROM u a JOIN u b ON a.word = b.word AND a.line_no <> b.line_no GROUP BY ALL)
SELECT p.line_no, min(p.inside) AS inside, count(*) AS n FROM p JOIN n x ON x.line_no = p.line_no JOIN n y ON y.line_no = p.inside WHERE p.k = x.n AND (y.n > x.n OR p.inside < p.line_no) GROUP BY p.line_no""",
)
def _(s, d):
    return E.containing_groups(groups(s, d))


@query(
    "q_near_clique_merge",
    _G
    + f""", ok AS (SELECT line_no FROM g GROUP BY line_no HAVING count(*) <= 40), u AS (SELECT DISTINCT line_no, word FROM g JOIN ok USING (line_no)), {_SYM},
share AS (SELECT DISTINCT a.line_no AS x, b.line_no AS y FROM u a JOIN u b ON a.word = b.word AND a.line_no <> b.line_no),
need AS (SELECT s.x, s.y, u.word FROM share s JOIN u ON u.line_no = s.x WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.line_no = s.y AND v.word = u.word)),
met AS (SELECT n.x, n.y, count(DISTINCT n.word) AS k FROM need n JOIN sym ON sym.w1 = n.word JOIN u b ON b.line_no = n.y AND b.word = sym.w2
  WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.line_no = n.x AND v.word = b.word) GROUP BY ALL),
total AS (SELECT x, y, count(*) AS k FROM need GROUP BY ALL)
SELECT x AS line_no, min(y) AS joins, count(*) AS n FROM met JOIN total USING (x, y, k) GROUP BY x""",
)
def _(s, d):
    return E.near_cliques(groups(s, d), web(s, d))


@query(
    "q_sense_numbering",
    _G
    + """, u AS (SELECT DISTINCT line_no, word FROM g), n AS (SELECT line_no, word, count(*) OVER (PARTITION BY word) AS n, row_number() OVER (PARTITION BY word ORDER BY line_no) AS i FROM u)
SELECT line_no, word, CASE WHEN n > 1 THEN word || ':' || i || '/' || n ELSE word END AS sensed FROM n""",
)
def _(s, d):
    return E.number_senses(groups(s, d))


_AMBIGUOUS = f"""SELECT reading, string_agg(form, '?' ORDER BY form) AS forms FROM (SELECT DISTINCT split_part({_BASE.format("w")}, '/', 2) AS reading, split_part({_BASE.format("w")}, '/', 1) AS form FROM
  (SELECT word1 AS w FROM synonym_web_news UNION ALL SELECT word2 FROM synonym_web_news UNION ALL SELECT midasi FROM definition) WHERE w <> '') WHERE reading <> '' GROUP BY reading HAVING count(*) > 1"""


def all_words(s, d):
    w = table(s, d, "synonym_web_news", "word1", "word2").select(F.explode(F.array("word1", "word2")).alias("word"))
    return w.unionByName(table(s, d, "definition", "midasi").toDF("word"))


@query("q_ambiguous_reading", _AMBIGUOUS)
def _(s, d):
    return E.ambiguous_readings(all_words(s, d))


@query(
    "q_kana_tokens",
    f"WITH a AS ({_AMBIGUOUS}), t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[ぁ-ん]+')) AS token FROM documents) SELECT token, forms FROM t JOIN a ON a.reading = t.token",
)
def _(s, d):
    tokens = table(s, d, "documents", "text").select(F.explode(F.regexp_extract_all("text", F.lit("[ぁ-ん]+"), F.lit(0))).alias("token"))
    return E.kana_of_words(tokens, all_words(s, d))


@query(
    "q_isa_expand_synonyms",
    _G
    + """, r AS (SELECT hyponym AS hypo, hypernym AS hyper, num FROM isa WHERE hyponym <> '' AND hypernym <> ''), u AS (SELECT DISTINCT line_no, word FROM g),
one AS (SELECT word, min(line_no) AS line_no FROM u GROUP BY word HAVING count(*) = 1)
SELECT hypo, hyper, num FROM r UNION ALL SELECT u.word, r.hyper, r.num FROM r JOIN one ON one.word = r.hypo JOIN u ON u.line_no = one.line_no AND u.word <> r.hypo""",
)
def _(s, d):
    return E.expand_isa(isa(s, d), groups(s, d))


@query(
    "q_isa_support",
    "WITH r AS (SELECT hyponym AS hypo, hypernym AS hyper FROM isa WHERE hyponym <> '' AND hypernym <> '') SELECT DISTINCT hypo, hyper, support FROM r JOIN (SELECT hyper, count(*) AS support FROM r GROUP BY hyper) USING (hyper)",
)
def _(s, d):
    return E.hypernym_support(isa(s, d))


@query(
    "q_isa_cleaning",
    f"""WITH r AS (SELECT hyponym AS hypo, hypernym AS hyper FROM isa WHERE hyponym <> '' AND hypernym <> '' AND num > 5), s AS (SELECT * FROM r WHERE {_SENSE.format("hypo")} = ''),
h AS (SELECT hyper AS w FROM s UNION SELECT split_part({_BASE.format("hyper")}, '/', 1) FROM s),
ok AS (SELECT * FROM r WHERE NOT ends_with(hyper, {_BASE.format("hypo")}) AND hypo NOT IN (SELECT w FROM h) AND hypo NOT IN (SELECT midasi FROM definition WHERE midasi <> '')
  AND NOT ends_with(split_part({_BASE.format("hypo")}, '/', 1), split_part({_BASE.format("hyper")}, '/', 1)))
SELECT DISTINCT hypo, hyper, support FROM ok JOIN (SELECT hyper, count(*) AS support FROM ok GROUP BY hyper) USING (hyper)""",
)
def _(s, d):
    return E.clean_isa(isa(s, d), table(s, d, "definition", "midasi").toDF("word"), same_head=True)


@query(
    "q_compound_isa",
    f"""WITH w AS (SELECT DISTINCT split_part({_BASE.format("w")}, '/', 1) AS w FROM (SELECT hyponym AS w FROM isa UNION ALL SELECT hypernym FROM isa) WHERE w <> ''),
p AS (SELECT list_filter(regexp_split_to_array(w, '[・ ]'), lambda x: x <> '') AS p FROM w), q AS (SELECT p, unnest(generate_series(1, len(p) - 1)) AS i FROM p WHERE len(p) > 1),
r AS (SELECT array_to_string(p[i:], '') AS hypo, array_to_string(p[i + 1:], '') AS hyper FROM q)
SELECT DISTINCT hypo, hyper FROM r WHERE NOT regexp_matches(hypo, '^[ァ-ヺー]{{2,5}}$') AND length(hyper) > 1""",
)
def _(s, d):
    i = isa(s, d)
    return E.compound_isa(i.select(F.explode(F.array("hypo", "hyper")).alias("word")))


@query(
    "q_middle_dot_split",
    f"""WITH h AS (SELECT DISTINCT split_part({_BASE.format("hypernym")}, '/', 1) AS w FROM isa WHERE hypernym <> ''), a AS (SELECT DISTINCT split_part({_BASE.format("hyponym")}, '/', 1) AS w FROM isa WHERE hyponym <> ''),
c AS (SELECT w AS word, string_split(w, '・') AS p FROM (SELECT w FROM h UNION SELECT w FROM a) WHERE contains(w, '・')), e AS (SELECT DISTINCT word, unnest(p) AS part FROM c),
k AS (SELECT word, bool_and(part IN (SELECT w FROM h)) AS held, count(DISTINCT right(part, 2)) AS tails FROM e GROUP BY word)
SELECT word, array_to_string(p, '|') AS parts FROM c JOIN k USING (word) WHERE held OR tails = 1""",
)
def _(s, d):
    i = isa(s, d)
    return E.split_middle_dots(i.select(F.explode(F.array("hypo", "hyper")).alias("word")), i.select(F.col("hyper").alias("word")))


@query("q_two_fields", "SELECT line_no, raw_line FROM aimai_synonym_isa WHERE len(string_split(raw_line, chr(9))) = 2")
def _(s, d):
    return E.two_fields(table(s, d, "aimai_synonym_isa", "line_no", "raw_line"), "raw_line")


@query("q_unreadable", "SELECT pair_id, word1, word2 FROM synonym_web_news WHERE NOT contains(coalesce(word1, ''), '?') AND NOT contains(coalesce(word2, ''), '?')")
def _(s, d):
    return E.without_unreadable(table(s, d, "synonym_web_news", "pair_id", "word1", "word2"), "word1", "word2")


@query(
    "q_pair_blacklist",
    _G
    + """, ok AS (SELECT line_no FROM g GROUP BY line_no HAVING count(*) <= 40), u AS (SELECT DISTINCT line_no, word FROM g JOIN ok USING (line_no)),
b AS (SELECT DISTINCT a.word AS w1, b.word AS w2 FROM u a JOIN u b ON a.line_no = b.line_no AND a.word < b.word)
SELECT pair_id, word1 AS w1, word2 AS w2 FROM synonym_web_news p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.w1 = least(p.word1, p.word2) AND b.w2 = greatest(p.word1, p.word2))""",
)
def _(s, d):
    pairs = table(s, d, "synonym_web_news", "pair_id", "word1", "word2").toDF("pair_id", "w1", "w2")
    return E.without_pairs(pairs, E.pairs_in_groups(pairs, groups(s, d)))


_SIMILAR = "sim AS (SELECT least(word1, word2) AS a, greatest(word1, word2) AS b, max(coalesce(freq, 0)) / 10.0 AS score FROM synonym_web_news WHERE word1 <> '' AND word2 <> '' GROUP BY ALL)"


def similar(s, d):
    p = table(s, d, "synonym_web_news", "word1", "word2", "freq").filter(filled("word1") & filled("word2"))
    return p.groupBy(F.least("word1", "word2").alias("w1"), F.greatest("word1", "word2").alias("w2")).agg((F.max(F.coalesce("freq", F.lit(0))) / 10.0).alias("score"))


@query(
    "q_known_pair_filter",
    f"""WITH k AS (SELECT DISTINCT midasi AS w FROM definition WHERE midasi <> ''), {_SIMILAR},
p AS (SELECT pair_id, word1 AS w1, word2 AS w2, word1 IN (SELECT w FROM k) AS k1, word2 IN (SELECT w FROM k) AS k2 FROM synonym_web_news WHERE word1 <> '' AND word2 <> '')
SELECT pair_id, w1, w2 FROM p JOIN sim ON a = least(w1, w2) AND b = greatest(w1, w2) WHERE NOT k1 AND NOT k2 OR k1 <> k2 AND score >= 0.3""",
)
def _(s, d):
    pairs = table(s, d, "synonym_web_news", "pair_id", "word1", "word2").toDF("pair_id", "w1", "w2")
    return E.known_pair_filter(pairs, table(s, d, "definition", "midasi").toDF("word"), similar(s, d))


@query(
    "q_frequent_phrases",
    f"""WITH {_FIRSTS}, c AS (SELECT {_DEF.format("def")} AS phrase, count(*) AS n FROM definition WHERE def <> '' GROUP BY 1)
SELECT head, definition AS phrase, n FROM firsts JOIN c ON phrase = definition WHERE n >= 2""",
)
def _(s, d):
    defs = definitions(s, d)
    counts = defs.filter(filled("def")).groupBy(S.trim_definition(F.col("def")).alias("phrase")).agg(F.count(F.lit(1)).alias("n"))
    return E.frequent_phrases(E.first_definitions(defs).withColumnRenamed("definition", "phrase"), counts, least=2).select("head", "phrase", "n")


def _wide(c: str) -> str:
    return "translate(" + c + ", '" + S.ASCII.replace("'", "''") + "', '" + S.WIDE + "')"




@query(
    "q_change_words",
    _G
    + f""", one AS (SELECT hyponym AS w FROM isa WHERE hyponym <> '' GROUP BY hyponym HAVING count(DISTINCT hypernym) = 1),
c AS (SELECT line_no, CAST(ord AS INT) AS ord, CASE WHEN contains(word, ':') THEN word WHEN regexp_matches(word, './.') THEN CASE WHEN word IN (SELECT w FROM one) THEN word || ':1/1:1/1' ELSE word END
  WHEN regexp_matches(word, '^[ぁ-ん]{{1,2}}$') THEN NULL ELSE {_wide('word')} END AS word FROM g)
SELECT line_no, ord, word FROM (SELECT *, count(*) OVER (PARTITION BY line_no) AS n FROM c WHERE word IS NOT NULL) WHERE n > 1""",
)
def _(s, d):
    one = isa(s, d).filter(filled("hypo")).groupBy("hypo").agg(F.countDistinct("hyper").alias("n")).filter("n = 1").select(F.col("hypo").alias("word"))
    return E.change_words(groups(s, d), one)


@query("q_day_exclusion", "SELECT pair_id, CAST(CAST(seen_at AS DATE) AS VARCHAR) AS day FROM synonym_web_news WHERE NOT coalesce(regexp_matches(CAST(CAST(seen_at AS DATE) AS VARCHAR), '^2010-(?:02-03|05-1[0-4])$'), false)")
def _(s, d):
    days = table(s, d, "synonym_web_news", "pair_id", "seen_at").select("pair_id", F.col("seen_at").cast("date").cast("string").alias("day"))
    return E.excluded_days(days, "day", "^2010-(?:02-03|05-1[0-4])$")


@query(
    "q_discarded_synonyms",
    _G
    + f""", {_SYM}, h AS (SELECT line_no, word AS head FROM g WHERE ord = 0), k AS (SELECT g.line_no, CAST(g.ord AS INT) AS ord, g.word FROM g JOIN h USING (line_no) WHERE NOT EXISTS (SELECT 1 FROM sym WHERE w1 = head AND w2 = word))
SELECT line_no, ord, word FROM (SELECT *, count(*) OVER (PARTITION BY line_no) AS n FROM k) WHERE n > 1""",
)
def _(s, d):
    return E.without_discarded(groups(s, d), E.symmetric(web(s, d)).toDF("head", "word"))


@query(
    "q_same_definition",
    f"""WITH x AS (SELECT DISTINCT {_DEF.format("def")} AS definition, midasi AS word FROM definition WHERE midasi <> '' AND def <> '')
SELECT definition, string_agg(word, ' ' ORDER BY word) AS words, count(*) AS n FROM x GROUP BY definition HAVING count(*) > 1""",
)
def _(s, d):
    return E.same_definition_groups(definitions(s, d))


_SENSES = r"senses AS (SELECT regexp_extract(word_id, '^(.+):[0-9]+/[0-9]+$', 1) AS word, try_cast(regexp_extract(word_id, ':([0-9]{1,9})/[0-9]+$', 1) AS INT) AS m, sense_text AS string FROM aimai_synonym_isa WHERE regexp_matches(word_id, '^.+:[0-9]+/[0-9]+$'))"


@query(
    "q_sense_assignment",
    _G
    + f""", {_SENSES}, u AS (SELECT DISTINCT line_no, word FROM g), x AS (SELECT u.line_no, u.word, t.m, sum(CASE WHEN v.word = t.string THEN 1.0 ELSE 0 END) AS s FROM u
  JOIN (SELECT DISTINCT word, m, string FROM senses WHERE m IS NOT NULL AND string <> '') t ON t.word = u.word JOIN u v ON v.line_no = u.line_no AND v.word <> u.word GROUP BY ALL)
SELECT line_no, word, CAST(CASE WHEN max(s) > 0 THEN arg_max(m, (s, -m)) ELSE 0 END AS INT) AS m FROM x GROUP BY line_no, word""",
)
def _(s, d):
    return E.assign_senses(groups(s, d), senses(s, d))


@query(
    "q_word_to_groups",
    _G + f", u AS (SELECT DISTINCT {_BASE.format('word')} AS word, line_no FROM g) SELECT word, string_agg(CAST(line_no AS VARCHAR), '|' ORDER BY line_no) AS lines FROM u GROUP BY word",
)
def _(s, d):
    return E.word_to_groups(groups(s, d))


@query(
    "q_sense_inventory",
    _G
    + f""", {_SENSES} SELECT DISTINCT a.word, a.m, a.line_no FROM (SELECT line_no, {_BASE.format("word")} AS word, try_cast(regexp_extract({_SENSE.format("word")}, '([0-9]+)/[0-9]+$', 1) AS INT) AS m FROM g) a JOIN senses b ON a.word = b.word AND a.m = b.m""",
)
def _(s, d):
    return E.sense_inventory(senses(s, d), groups(s, d))


@query(
    "q_pair_report",
    f"""WITH {_SYM}, ren AS (SELECT split_part(w, '/', 1) AS alias, min(w) AS name FROM (SELECT w1 AS w FROM sym) WHERE contains(w, '/') GROUP BY 1),
p AS (SELECT DISTINCT coalesce(a.name, w1) AS w1, coalesce(b.name, w2) AS w2 FROM sym LEFT JOIN ren a ON a.alias = w1 LEFT JOIN ren b ON b.alias = w2),
f AS (SELECT midasi AS w, count(*) AS n FROM definition WHERE midasi <> '' GROUP BY 1)
SELECT w1, w2, coalesce(x.n, 0) AS n1, coalesce(y.n, 0) AS n2 FROM p LEFT JOIN f x ON x.w = w1 LEFT JOIN f y ON y.w = w2 WHERE w1 < w2""",
)
def _(s, d):
    words = E.symmetric(web(s, d)).select(F.col("w1").alias("w")).filter(F.col("w").contains("/"))
    names = words.groupBy(F.split_part("w", F.lit("/"), F.lit(1)).alias("alias")).agg(F.min("w").alias("name"))
    counts = definitions(s, d).filter(filled("head")).groupBy(F.col("head").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return E.pair_report(web(s, d), counts, names)


@query(
    "q_provenance",
    "SELECT midasi AS head, string_agg('<' || coalesce(origin, 'none') || ':' || def_id || '>', '' ORDER BY coalesce(origin, 'none'), def_id) AS places FROM definition WHERE midasi <> '' GROUP BY midasi",
)
def _(s, d):
    rows = table(s, d, "definition", "midasi", "origin", "def_id").select(F.col("midasi").alias("head"), F.coalesce("origin", F.lit("none")).alias("file"), F.col("def_id").alias("line"))
    return E.provenance(rows)


@query(
    "q_manual_overlay",
    "WITH e AS (SELECT midasi AS head, def AS word FROM definition WHERE origin LIKE 'user%' AND midasi <> ''), b AS (SELECT midasi AS head, def AS word FROM definition WHERE (origin IS NULL OR origin NOT LIKE 'user%') AND midasi <> '') SELECT head, word FROM b WHERE head NOT IN (SELECT head FROM e) UNION ALL SELECT head, word FROM e",
)
def _(s, d):
    rows = table(s, d, "definition", "midasi", "def", "origin").filter(filled("midasi"))
    user = F.coalesce(F.col("origin").startswith("user"), F.lit(False))
    return E.overlay_edits(rows.filter(~user).select(F.col("midasi").alias("head"), F.col("def").alias("word")), rows.filter(user).select(F.col("midasi").alias("head"), F.col("def").alias("word")))


@query(
    "q_sense_scoring",
    """WITH m AS (SELECT word1 AS word, word2 AS sense, avg(coalesce(freq, 0) / 10.0) AS s FROM synonym_web_news WHERE word1 <> '' AND word2 <> '' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY s DESC, sense) AS k, lead(s) OVER (PARTITION BY word ORDER BY s DESC, sense) AS b FROM m)
SELECT word, sense FROM k WHERE k = 1 AND s >= 0.3 AND (b IS NULL OR s >= 3.0 * b)""",
)
def _(s, d):
    p = table(s, d, "synonym_web_news", "word1", "word2", "freq").filter(filled("word1") & filled("word2"))
    return E.score_senses(p.select(F.col("word1").alias("word"), F.col("word2").alias("sense"), (F.coalesce("freq", F.lit(0)) / 10.0).alias("score")))


@query("q_edit_table", f"WITH {_SYM} SELECT w1 AS word, count(*) AS n FROM sym GROUP BY w1")
def _(s, d):
    return E.edit_table(web(s, d)).orderBy(F.desc("n"), "word")


@query(
    "q_same_initial_reading",
    f"SELECT pair_id, word1 AS w1, word2 AS w2 FROM synonym_web_news WHERE split_part({_BASE.format('word1')}, '/', 2) <> '' AND substr(split_part({_BASE.format('word1')}, '/', 2), 1, 1) = substr(split_part({_BASE.format('word2')}, '/', 2), 1, 1)",
)
def _(s, d):
    return E.shared_initial_reading(table(s, d, "synonym_web_news", "pair_id", "word1", "word2").toDF("pair_id", "w1", "w2"))


@query(
    "q_synonym_chain",
    f"""WITH RECURSIVE {_SYM}, st AS (SELECT DISTINCT midasi AS w FROM definition WHERE def_id % 20 = 0 AND midasi <> ''),
c AS (SELECT w AS start, w AS word, 0 AS steps FROM st UNION SELECT c.start, sym.w2, c.steps + 1 FROM c JOIN sym ON sym.w1 = c.word WHERE c.steps < 2)
SELECT start, word, min(steps) AS steps FROM c GROUP BY ALL""",
)
def _(s, d):
    linked = table(s, d, "synonym_web_news", "pair_id", "word1").filter("pair_id % 20 = 0").select(F.col("word1").alias("word"))
    heads = table(s, d, "definition", "def_id", "midasi").filter("def_id % 20 = 0").select(F.col("midasi").alias("word"))
    return E.chains(web(s, d), linked.unionByName(heads))


@query("q_h2z_upper", f"SELECT p_partkey, {_wide('p_name')} AS wide, translate({_wide('p_name')}, '{S.WIDE_LOWER}', '{S.WIDE_UPPER}') AS upper_wide, {_wide('p_brand')} AS brand FROM part")
def _(s, d):
    wide = S.to_wide(F.col("p_name"))
    return table(s, d, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", wide.alias("wide"), S.wide_upper(wide).alias("upper_wide"), S.to_wide(F.col("p_brand")).alias("brand"))


@query("q_definition_trim", f"SELECT def_id, {_DEF.format('def')} AS trimmed, {_USABLE.format('def')} AS usable FROM definition WHERE def IS NOT NULL")
def _(s, d):
    c = F.col("def")
    return table(s, d, "definition", "def_id", "def").filter(c.isNotNull()).select("def_id", S.trim_definition(c).alias("trimmed"), S.usable_definition(c).alias("usable"))


@query("q_clean_query", f"SELECT item_id, {_wide("regexp_replace(text, '[?？!！．。]$', '')")} AS q FROM eval_items")
def _(s, d):
    return table(s, d, "eval_items", "item_id", "text").select("item_id", S.clean_query(F.col("text")).alias("q"))


@query(
    "q_graph_labels",
    """SELECT hypernym, '"' || hypernym || '(' || format('{:,}', count(*)) || ')"' AS label FROM isa WHERE hypernym <> '' GROUP BY hypernym""",
)
def _(s, d):
    n = isa(s, d).filter(filled("hyper")).groupBy(F.col("hyper").alias("hypernym")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("hypernym", S.graph_label(F.col("hypernym"), F.col("n")).alias("label"))


@query(
    "q_token_parts",
    f"SELECT DISTINCT midasi AS word, {_BASE.format('midasi')} AS base, {_SENSE.format('midasi')} AS sense, split_part({_BASE.format('midasi')}, '/', 1) AS written, split_part({_BASE.format('midasi')}, '/', 2) AS reading FROM definition WHERE midasi <> ''",
)
def _(s, d):
    w = F.col("word")
    return table(s, d, "definition", "midasi").toDF("word").filter(filled("word")).distinct().select("word", S.base_of(w).alias("base"), S.sense_of(w).alias("sense"), S.written(w).alias("written"), S.reading(w).alias("reading"))


@query(
    "q_acronym",
    """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS n FROM part), w AS (SELECT p_partkey, array_to_string(list_transform(n, lambda x: translate(upper(x[1]) || x[2:], 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ')), '') AS long FROM p)
SELECT p_partkey, long, regexp_replace(long, '[ａ-ｚ]', '', 'g') AS short, true AS acronym, p_partkey % 2 = 0 AS other FROM w""",
)
def _(s, d):
    long = S.to_wide(F.regexp_replace(F.initcap("p_name"), " ", ""))
    short = F.regexp_replace(long, "[ａ-ｚ]", "")
    parts = table(s, d, "part", "p_partkey", "p_name").select("p_partkey", long.alias("long"), short.alias("short"))
    wrong = F.when(F.col("p_partkey") % 2 == 0, F.col("short")).otherwise(F.reverse(F.concat("short", F.lit("Ｚ"))))
    return parts.select("p_partkey", "long", "short", S.is_acronym(F.col("long"), F.col("short")).alias("acronym"), S.is_acronym(F.col("long"), wrong).alias("other"))


@query(
    "q_common_subsequence",
    r"""WITH RECURSIVE p AS (SELECT DISTINCT p_name, p_type FROM part), w AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_name FROM p)
SELECT p_name, a, b, regexp_matches(p_name, '^' || array_to_string(string_split(a[1] || b, ''), '.*')) AND NOT contains(p_name, a[1] || b) AS spread, regexp_matches(a, '^' || array_to_string(string_split(b, ''), '.*')) AND NOT contains(a, b) AS inside FROM w""",
)
def _(s, d):
    w = table(s, d, "part", "p_name").distinct().select("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b"))
    key = F.concat(F.substring("a", 1, 1), F.col("b"))
    return w.select("p_name", "a", "b", S.has_subsequence(key, F.col("p_name")).alias("spread"), S.has_subsequence(F.col("b"), F.col("a")).alias("inside"))


@query(
    "q_common_tail",
    """WITH p AS (SELECT pair_id, word1 AS a, word2 AS b FROM synonym_web_news WHERE word1 <> '' AND word2 <> ''), k AS (SELECT pair_id, a, b, (SELECT coalesce(max(i), 0) FROM (SELECT unnest(generate_series(1, least(length(a), length(b)))) AS i) WHERE right(a, i) = right(b, i)) AS n FROM p)
SELECT pair_id, right(a, n) AS tail FROM k WHERE n > 1""",
)
def _(s, d):
    p = table(s, d, "synonym_web_news", "pair_id", "word1", "word2").filter(filled("word1") & filled("word2"))
    return p.select("pair_id", S.common_tail(F.col("word1"), F.col("word2")).alias("tail")).filter(F.length("tail") > 1)


@query(
    "q_edit_distance_norm",
    None,
)
def _(s, d):
    p = table(s, d, "synonym_web_news", "pair_id", "word1", "word2").filter(filled("word1") & filled("word2"))
    dist = p.select("pair_id", "word1", "word2", S.weighted_edit_distance(F.col("word1"), F.col("word2")).alias("distance"))
    return dist.select("pair_id", "distance", F.round(S.normalised_distance(F.col("distance"), F.col("word1"), F.col("word2")), 6).alias("normalised"))


@query(
    "q_edit_distance_unit",
    "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS DOUBLE) AS distance, round(levenshtein(p_name, p_type) / (ln(length(p_name)) + 1) / (ln(length(p_type)) + 1), 6) AS normalised FROM part",
)
def _(s, d):
    n = S.weighted_edit_distance(F.col("p_name"), F.col("p_type"), replace=1.0)
    parts = table(s, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", n.alias("distance"), "p_name", "p_type")
    return parts.select("p_partkey", "distance", F.round(S.normalised_distance(F.col("distance"), F.col("p_name"), F.col("p_type")), 6).alias("normalised"))


QUERIES = Q
