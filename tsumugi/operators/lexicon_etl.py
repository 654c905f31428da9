"""Cleaning, merging and sense handling of raw synonym, is-a and definition lists.

Tables: groups (line_no, ord, word), one row a member; pairs (w1, w2); isa (hypo, hyper, num); definitions (def_id, head, def). Null and
empty words are left out everywhere, repeated rows count once unless a count is the result, and every choice among
several is by an explicit order, so results don't depend on partitioning.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import MAX_GROUP
from ..functions.runtime import Scratch, filled, lookup, ship
from ..functions.strings import base_of, headword, reading, sense_of, to_wide, trim_definition, usable_definition, written
from .chain_search import PART, ROWS, SCHEMA, searched
from .unpack import ALL

#: Links of a component, each in both directions, that one worker searches.
LINKS = 1_000_000
#: Parts for each core that the starts of all components are dealt out to, each of which gets its component's links.
SHARES = 2


def read_groups(lines: DataFrame, key: str, packed: str) -> DataFrame:
    """Members of groups that stand on one line, in order; any separator cuts."""
    words = F.filter(F.split(packed, f"[{ALL}]+"), lambda w: w != "")
    return lines.filter(F.col(packed).isNotNull()).select(F.col(key).alias("line_no"), F.posexplode(words).alias("ord", "word"))


def number_rows(df: DataFrame, order: str, name: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of a unique column, without one task holding all rows.

    Rows are sorted into ranges, counted by range (one number a range comes to the driver) and numbered inside each.
    """
    ranged = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, order).withColumn("_range", F.spark_partition_id())
    ranged = Scratch(df.sparkSession, "numbered").write(ranged, "ranges")
    sizes = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    before, total = {}, 0
    for k, n in sizes:
        before[k] = total
        total += n
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn(name, (within + offset[F.col("_range")]).cast("long")).drop("_range")


def limit_groups(groups: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """Groups of at most so many members, with their size, for output by size."""
    n = groups.groupBy("line_no").agg(F.count(F.lit(1)).alias("n_words"))
    return n.filter(F.col("n_words") <= most)


def create_groups(groups: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """Members with their group's id, ``s<number>:<first word>``; numbers follow the lines, too large groups get none."""
    heads = limit_groups(groups, most).join(groups.filter("ord = 0"), "line_no").select("line_no", F.col("word").alias("head"))
    named = number_rows(heads, "line_no", "number").select("line_no", F.concat(F.lit("s"), "number", F.lit(":"), "head").alias("synid"))
    return named.join(groups, "line_no").select("line_no", "synid", "ord", "word")


def first_definitions(definitions: DataFrame) -> DataFrame:
    """The first usable definition of each head, trimmed."""
    ok = definitions.filter(filled("head") & filled("def")).filter(usable_definition(F.col("def")))
    return ok.groupBy("head").agg(F.min(F.struct("def_id", "def")).alias("d")).select("head", trim_definition(F.col("d.def")).alias("definition"))


def definition_members(members: DataFrame, definitions: DataFrame) -> DataFrame:
    """Groups get the definition of their first member that has one; definitions nobody used become groups of two.

    (synid, word, tag); ids of the new groups are ``d:<head>``.
    """
    firsts = first_definitions(definitions)
    joined = members.select("synid", "ord", F.col("word").alias("head")).join(firsts, "head")
    first = joined.groupBy("synid").agg(F.min(F.struct("ord", "head", "definition")).alias("m")).select("synid", F.col("m.head").alias("head"), F.col("m.definition").alias("definition"))
    rest = firsts.join(first.select("head").distinct(), "head", "left_anti")
    new = rest.select(F.concat(F.lit("d:"), "head").alias("synid"), F.explode(F.array(F.struct(F.col("head").alias("word"), F.lit("DIC").alias("tag")), F.struct(F.col("definition").alias("word"), F.lit("定義文").alias("tag")))).alias("m"))
    return first.select("synid", F.col("definition").alias("word"), F.lit("定義文").alias("tag")).unionByName(new.select("synid", "m.word", "m.tag"))


def rename_singletons(members: DataFrame) -> DataFrame:
    """(synid, new_id): groups of one distinct word with a reading are called by that word."""
    one = members.groupBy("synid").agg(F.min("word").alias("a"), F.max("word").alias("b")).filter("a = b")
    return one.filter(F.col("synid").contains("/")).select("synid", F.col("a").alias("new_id"))


def get_ids(words: DataFrame, members: DataFrame) -> DataFrame:
    """(word, synid, known) of distinct words: the group that has the word, else the one that has it as a single sense, else a new one."""
    distinct = words.filter(filled("word")).select("word").distinct()
    ids = members.groupBy("word").agg(F.min("synid").alias("synid"))
    tagged = ids.select(F.col("word").alias("tagged"), F.col("synid").alias("synid1"))
    joined = distinct.join(ids, "word", "left").join(tagged, F.concat(distinct["word"], F.lit(":1/1:1/1")) == F.col("tagged"), "left")
    found = F.coalesce("synid", "synid1")
    return joined.select("word", F.coalesce(found, F.concat(F.lit("n:"), "word")).alias("synid"), found.isNotNull().alias("known"))


def contradictions(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (hypo, hyper) whose two words share a group, or are one word but for the sense number."""
    pairs = edges.filter(filled("hypo") & filled("hyper")).select("hypo", "hyper").distinct()
    of = members.select("word", "line_no").distinct()
    left = pairs.join(of.withColumnRenamed("word", "hypo"), "hypo")
    shared = left.join(of.withColumnRenamed("word", "hyper"), ["hyper", "line_no"], "left_semi").select("hypo", "hyper")
    same = pairs.filter(base_of(F.col("hypo")) == base_of(F.col("hyper")))
    return shared.unionByName(same).distinct()


def widest_edges(isa: DataFrame) -> DataFrame:
    """(hypo, hyper, num): the largest count of each edge."""
    return isa.filter(filled("hypo") & filled("hyper")).groupBy("hypo", "hyper").agg(F.max("num").alias("num"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair, once; nothing is its own partner."""
    ok = pairs.filter(filled("w1") & filled("w2")).filter("w1 <> w2")
    return ok.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w1").alias("w2")))).alias("p")).select("p.w1", "p.w2").distinct()


def normalise_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs in upper case and in order, once each, with the number of records; a word isn't paired with itself."""
    a, b = F.upper("w1"), F.upper("w2")
    ok = pairs.filter(filled("w1") & filled("w2")).select(F.least(a, b).alias("w1"), F.greatest(a, b).alias("w2")).filter("w1 <> w2")
    return ok.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """Pairs of different members of each group, in order; groups may have any size."""
    words = groups.filter("line_no is not null").groupBy("line_no").agg(F.sort_array(F.collect_set("word")).alias("ws"))
    left = words.select("line_no", "ws", F.posexplode("ws").alias("i", "w1"))
    return left.select("line_no", "w1", F.explode(F.slice("ws", F.col("i") + 2, F.size("ws"))).alias("w2"))


def pairs_in_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(w1, w2), in order and once each: those of the pairs whose words stand in one group of any size.

    A pair goes to the groups of its rarer word and is looked for there, so groups aren't expanded.
    """
    once = groups.filter("line_no is not null").select("line_no", "word").distinct()
    n = once.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    stated = pairs.select(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).filter("w1 < w2").distinct()
    both = stated.join(n.toDF("w1", "n1"), "w1").join(n.toDF("w2", "n2"), "w2")
    rarer = F.col("n1") <= F.col("n2")
    sent = both.select("w1", "w2", F.when(rarer, F.col("w1")).otherwise(F.col("w2")).alias("word"), F.when(rarer, F.col("w2")).otherwise(F.col("w1")).alias("other"))
    met = sent.join(once, "word").join(once.withColumnRenamed("word", "other"), ["line_no", "other"], "left_semi")
    return met.select("w1", "w2").distinct()


def connected_groups(groups: DataFrame) -> DataFrame:
    """(line_no, component): groups that share a word with a sense number are one; a component's name is its smallest line.

    Labels travel along stars, group to word to group, and jump to the label of their label in each round, so chains take
    logarithmically many rounds. A word's groups meet in an aggregation, never as pairs.
    """
    scratch = Scratch(groups.sparkSession, "groups")
    tagged = groups.filter(sense_of(F.col("word")) != "").select("line_no", F.xxhash64("word").alias("w"), F.xxhash64(F.reverse("word")).alias("w2")).distinct()
    links = scratch.write(tagged.filter("line_no is not null"), "links")
    labels = scratch.write(links.select("line_no", F.col("line_no").alias("label")).distinct(), "labels")
    while True:
        seen = links.join(labels, "line_no")
        words = seen.groupBy("w", "w2").agg(F.min("label").alias("least"))
        near = links.join(words, ["w", "w2"]).groupBy("line_no").agg(F.min("least").alias("least"))
        hooked = labels.join(near, "line_no").select("line_no", "label", F.least("label", "least").alias("least"))
        roots = hooked.groupBy("label").agg(F.min("least").alias("root"))  # a label's own group follows it
        moved = hooked.join(roots, "label").select("line_no", "label", F.least("least", "root").alias("next"))
        new = scratch.write(moved, "labels")
        done = new.filter("next <> label").isEmpty()
        scratch.drop(labels)
        labels = new.select("line_no", F.col("next").alias("label"))
        if done:
            break
        labels._scratch_path = new._scratch_path
    rest = groups.select("line_no").distinct().join(labels, "line_no", "left")
    return rest.select("line_no", F.coalesce("label", "line_no").alias("component"))


def containing_groups(groups: DataFrame) -> DataFrame:
    """(line_no, inside, n): for each group contained in another one, the smallest such and their number.

    Relational division by the rarest word: a superset must hold it, so only its groups are compared. Equal groups contain each
    other; of those only the later counts as contained.
    """
    sets = groups.groupBy("line_no").agg(F.sort_array(F.collect_set("word")).alias("ws"))
    often = groups.select("line_no", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rare = groups.join(often, "word").groupBy("line_no").agg(F.min(F.struct("n", "word")).alias("r")).select("line_no", F.col("r.word").alias("word"))
    small = sets.join(rare, "line_no")
    large = sets.select(F.col("line_no").alias("inside"), F.col("ws").alias("big"), F.explode("ws").alias("word"))
    fits = (F.size(F.array_except("ws", "big")) == 0) & ((F.size("big") > F.size("ws")) | (F.col("inside") < F.col("line_no")))
    return small.join(large, "word").filter((F.col("inside") != F.col("line_no")) & fits).groupBy("line_no").agg(F.min("inside").alias("inside"), F.count(F.lit(1)).alias("n"))


def near_cliques(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(line_no, joins, n): groups that may join another one, the smallest such and their number; groups may have any size.

    They share a word, and every other word of the group is linked to a word of the other that isn't shared. Candidates are
    met on linked words, which are fewer than shared ones; links of words that stand in no group are dropped first. The order
    in which groups come makes no difference.
    """
    once = groups.filter("line_no is not null").select("line_no", "word").distinct()
    sets = once.groupBy("line_no").agg(F.sort_array(F.collect_list("word")).alias("ws"))
    known = once.select("word").distinct()
    linked = symmetric(links).join(known.toDF("w1"), "w1", "left_semi").join(known.toDF("w2"), "w2", "left_semi")
    met = linked.join(once.toDF("line_no", "w1"), "w1").join(once.toDF("joins", "w2"), "w2").filter("line_no <> joins")
    met = met.groupBy("line_no", "joins").agg(F.collect_list(F.struct("w1", "w2")).alias("links"))
    met = met.join(sets, "line_no").join(sets.toDF("joins", "big"), "joins").filter(F.arrays_overlap("ws", "big"))
    apart = F.filter("links", lambda x: ~F.array_contains(F.col("big"), x["w1"]) & ~F.array_contains(F.col("ws"), x["w2"]))
    k, needed = F.size(F.array_distinct(F.transform(apart, lambda x: x["w1"]))), F.size(F.array_except("ws", "big"))
    return met.filter((k > 0) & (k == needed)).groupBy("line_no").agg(F.min("joins").alias("joins"), F.count(F.lit(1)).alias("n"))


def number_senses(groups: DataFrame) -> DataFrame:
    """(line_no, word, sensed): a word in several groups is told apart as ``:i/n``, in the order of lines."""
    once = groups.select("line_no", "word").distinct()
    n = once.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    several = once.join(n.filter("n > 1"), "word")
    i = F.row_number().over(Window.partitionBy("word").orderBy("line_no"))
    named = several.select("line_no", "word", F.concat("word", F.lit(":"), i, F.lit("/"), "n").alias("sensed"))
    return named.unionByName(once.join(n.filter("n = 1"), "word").select("line_no", "word", F.col("word").alias("sensed")))


def ambiguous_readings(words: DataFrame) -> DataFrame:
    """(reading, forms): readings with several written forms, joined by ``?``."""
    w = F.col("word")
    ok = words.filter(filled("word")).select(reading(w).alias("reading"), written(w).alias("form")).filter("reading <> ''").distinct()
    return ok.groupBy("reading").agg(F.sort_array(F.collect_list("form")).alias("forms")).filter(F.size("forms") > 1).select("reading", F.array_join("forms", "?").alias("forms"))


def expand_isa(isa: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of is-a with those that the other members of an unambiguous hyponym's group inherit."""
    rows = isa.filter(filled("hypo") & filled("hyper")).select("hypo", "hyper", "num")
    once = groups.select("line_no", "word").distinct()
    single = once.groupBy("word").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("word").alias("hypo"), "line_no")
    mates = rows.join(single, "hypo").join(once, "line_no").filter("word <> hypo").select(F.col("word").alias("hypo"), "hyper", "num")
    return rows.unionByName(mates)


def hypernym_support(isa: DataFrame) -> DataFrame:
    """Edges with the number of rows their hypernym has."""
    return _with_support(isa.filter(filled("hypo") & filled("hyper")))


def _with_support(rows: DataFrame) -> DataFrame:
    """Distinct edges with the number of rows of their hypernym, of which a few have most rows."""
    n = rows.groupBy("hyper").agg(F.count(F.lit(1)).alias("support"))
    total = n.agg(F.sum("support")).first()[0] or 0
    return lookup(rows.select("hypo", "hyper").distinct(), n.withColumn("weight", F.col("support")), "hyper", "weight", total).select("hypo", "hyper", "support")


def clean_isa(isa: DataFrame, known: DataFrame, least: int = 5, same_head: bool = False) -> DataFrame:
    """Edges that add something, with the number of rows that survive for their hypernym.

    Out go rows with a count of at most ``least`` or none, hypernyms that end with the hyponym, hyponyms that are hypernyms
    themselves, words that ``known`` has already and, on demand, hyponyms that end with their hypernym's surface.
    """
    rows = isa.filter(filled("hypo") & filled("hyper")).filter(F.col("num") > least)
    hypers = rows.filter(sense_of(F.col("hypo")) == "").select(F.explode(F.array("hyper", written(F.col("hyper")))).alias("hypo")).distinct()
    ok = rows.filter(~F.endswith(F.col("hyper"), base_of(F.col("hypo")))).join(hypers, "hypo", "left_anti")
    if same_head:
        ok = ok.filter(~F.endswith(written(F.col("hypo")), written(F.col("hyper"))))
    ok = ok.join(known.filter(filled("word")).select(F.col("word").alias("hypo")).distinct(), "hypo", "left_anti")
    return _with_support(ok)


def _parts(c: Column) -> Column:
    return F.split(c, "[・ ]")


def compound_isa(words: DataFrame) -> DataFrame:
    """(hypo, hyper): each compound is a kind of what is left without its first part; short katakana stays whole, heads are longer than one."""
    w = words.filter(filled("word")).select(written(F.col("word")).alias("w")).distinct()
    w = w.withColumn("p", F.filter(_parts(F.col("w")), lambda x: x != "")).filter(F.size("p") > 1)
    step = w.select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i"))
    hypo = F.array_join(F.slice("p", F.col("i"), F.size("p") - F.col("i") + 1), "")
    hyper = F.array_join(F.slice("p", F.col("i") + 1, F.size("p") - F.col("i")), "")
    both = step.select(hypo.alias("hypo"), hyper.alias("hyper"))
    return both.filter(~F.col("hypo").rlike("^[ァ-ヺー]{2,5}$") & (F.length("hyper") > 1)).distinct()


def split_middle_dots(hypernyms: DataFrame, known: DataFrame) -> DataFrame:
    """(word, parts): words with a middle dot whose parts are all hypernyms, or all end with the same two characters."""
    w = hypernyms.filter(filled("word")).select(written(F.col("word")).alias("word")).distinct().filter(F.col("word").contains("・"))
    w = w.withColumn("parts", F.split("word", "・"))
    hypers = known.filter(filled("word")).select(written(F.col("word")).alias("part")).distinct()
    each = w.select("word", "parts", F.explode(F.array_distinct("parts")).alias("part"))
    held = each.join(hypers, "part", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    tails = F.array_distinct(F.transform("parts", lambda x: F.right(x, F.lit(2))))
    ok = w.join(held, "word", "left").filter((F.coalesce("held", F.lit(0)) == F.size(F.array_distinct("parts"))) | (F.size(tails) == 1))
    return ok.select("word", F.array_join("parts", "|").alias("parts"))


def two_fields(lines: DataFrame, line: str) -> DataFrame:
    """Lines of exactly two tab-separated fields."""
    return lines.filter(F.size(F.split(line, "\t")) == 2)


def without_unreadable(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without ``?``, which stands for a lost character."""
    ok = None
    for c in columns:
        one = ~F.coalesce(F.col(c), F.lit("")).contains("?")
        ok = one if ok is None else ok & one
    return df.filter(ok)


def without_pairs(pairs: DataFrame, banned: DataFrame) -> DataFrame:
    """Pairs that aren't banned in either direction."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_a": F.least("w1", "w2"), "_b": F.greatest("w1", "w2")})

    return keyed(pairs).join(keyed(banned).select("_a", "_b").distinct(), ["_a", "_b"], "left_anti").drop("_a", "_b")


def known_pair_filter(pairs: DataFrame, known: DataFrame, similar: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of which neither word is known, or one is and the two are similar enough; pairs of two known words are dropped.

    similar: (w1, w2, score) with w1 < w2.
    """
    k = known.filter(filled("word")).select("word").distinct()
    p = pairs.filter(filled("w1") & filled("w2"))
    p = p.join(k.select(F.col("word").alias("w1"), F.lit(True).alias("k1")), "w1", "left").join(k.select(F.col("word").alias("w2"), F.lit(True).alias("k2")), "w2", "left")
    p = p.withColumns({"_a": F.least("w1", "w2"), "_b": F.greatest("w1", "w2")}).join(similar.select(F.col("w1").alias("_a"), F.col("w2").alias("_b"), "score"), ["_a", "_b"], "left")
    one, two = F.coalesce("k1", F.lit(False)), F.coalesce("k2", F.lit(False))
    keep = (~one & ~two) | ((one != two) & (F.coalesce("score", F.lit(0.0)) >= least))
    return p.filter(keep).drop("_a", "_b", "score", "k1", "k2")


def frequent_phrases(phrases: DataFrame, counts: DataFrame, least: int = 100) -> DataFrame:
    """Phrases counted often enough; phrases without a count are dropped."""
    return phrases.join(counts.groupBy("phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrase")


def change_words(groups: DataFrame, single_sense: DataFrame) -> DataFrame:
    """Members as the dictionary has them; groups that shrink below two members are dropped.

    Words with a sense number stay; words with a reading get ``:1/1:1/1`` where they have one sense only; hiragana of up to two
    characters is deleted; all other words are written in full width.
    """
    w = F.col("word")
    joined = groups.join(single_sense.filter(filled("word")).select("word", F.lit(True).alias("single")).distinct(), "word", "left")
    new = (
        F.when(w.contains(":"), w)
        .when(w.rlike("./."), F.when(F.col("single"), F.concat(w, F.lit(":1/1:1/1"))).otherwise(w))
        .when(w.rlike("^[ぁ-ん]{1,2}$"), F.lit(None))
        .otherwise(to_wide(w))
    )
    changed = joined.select("line_no", "ord", new.alias("word")).filter("word is not null")
    n = changed.groupBy("line_no").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("line_no")
    return changed.join(n, "line_no", "left_semi")


def excluded_days(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose id isn't of the days a pattern names; null ids stay."""
    return df.filter(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def without_discarded(groups: DataFrame, discarded: DataFrame) -> DataFrame:
    """Members that weren't discarded for their group's head earlier; groups of fewer than two are dropped.

    discarded: (head, word).
    """
    heads = groups.filter("ord = 0").select("line_no", F.col("word").alias("head"))
    kept = groups.join(heads, "line_no").join(discarded.select("head", "word").distinct(), ["head", "word"], "left_anti")
    n = kept.groupBy("line_no").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("line_no")
    return kept.join(n, "line_no", "left_semi").select("line_no", "ord", "word")


def same_definition_groups(definitions: DataFrame) -> DataFrame:
    """(definition, words, n): words with the same trimmed definition, two or more."""
    d = definitions.filter(filled("head") & filled("def")).select(trim_definition(F.col("def")).alias("definition"), F.col("head").alias("word")).distinct()
    g = d.groupBy("definition").agg(F.sort_array(F.collect_list("word")).alias("words"))
    return g.filter(F.size("words") > 1).select("definition", F.array_join("words", " ").alias("words"), F.size("words").cast("long").alias("n"))


def assign_senses(groups: DataFrame, senses: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """(line_no, word, m): for each group with an ambiguous word, the sense most similar to its other members, 0 for a new one.

    senses: (word, m, string). A member equal to a sense's text counts 1, others by ``similar`` (w1, w2, score), w1 < w2.
    """
    once = groups.select("line_no", "word").distinct()
    met = once.join(senses.filter(filled("string")).select("word", "m", "string").distinct(), "word")
    mates = met.join(once.select("line_no", F.col("word").alias("mate")), "line_no").filter("mate <> word")
    score = F.when(F.col("mate") == F.col("string"), 1.0)
    if similar is not None:
        mates = mates.withColumns({"_a": F.least("mate", "string"), "_b": F.greatest("mate", "string")}).join(similar.select(F.col("w1").alias("_a"), F.col("w2").alias("_b"), "score"), ["_a", "_b"], "left")
        score = score.otherwise(F.coalesce("score", F.lit(0.0)))
    else:
        score = score.otherwise(0.0)
    sums = mates.groupBy("line_no", "word", "m").agg(F.sum(score).alias("s"))
    best = sums.groupBy("line_no", "word").agg(F.max(F.struct("s", (-F.col("m")).alias("neg"))).alias("b"))
    return best.select("line_no", "word", F.when(F.col("b.s") > 0, -F.col("b.neg")).otherwise(0).cast("int").alias("m"))


def word_to_groups(groups: DataFrame) -> DataFrame:
    """(word, lines): every group of each word without its sense number."""
    ok = groups.select(base_of(F.col("word")).alias("word"), "line_no").distinct()
    return ok.groupBy("word").agg(F.sort_array(F.collect_list("line_no")).alias("lines")).select("word", F.array_join(F.transform("lines", lambda x: x.cast("string")), "|").alias("lines"))


def sense_inventory(senses: DataFrame, groups: DataFrame) -> DataFrame:
    """(word, m, line_no): the groups that hold a word in one of its listed senses."""
    tagged = groups.select("line_no", base_of(F.col("word")).alias("word"), F.regexp_extract(sense_of(F.col("word")), "([0-9]+)/[0-9]+$", 1).alias("m")).filter("m <> ''")
    return tagged.withColumn("m", F.col("m").try_cast("int")).join(senses.select("word", "m").distinct(), ["word", "m"]).select("word", "m", "line_no").distinct()


def pair_report(pairs: DataFrame, frequencies: DataFrame, renames: DataFrame) -> DataFrame:
    """(w1, w2, n1, n2): distinct pairs under their representative names, with the frequency of both words.

    renames: (alias, name), one row an alias.
    """
    r1, r2 = renames.select(F.col("alias").alias("w1"), F.col("name").alias("r1")), renames.select(F.col("alias").alias("w2"), F.col("name").alias("r2"))
    p = symmetric(pairs).join(r1, "w1", "left").join(r2, "w2", "left")
    p = p.select(F.coalesce("r1", "w1").alias("w1"), F.coalesce("r2", "w2").alias("w2")).filter("w1 < w2").distinct()
    f = frequencies.select("word", "n")
    p = p.join(f.toDF("w1", "n1"), "w1", "left").join(f.toDF("w2", "n2"), "w2", "left")
    return p.select("w1", "w2", F.coalesce("n1", F.lit(0).cast("long")).alias("n1"), F.coalesce("n2", F.lit(0).cast("long")).alias("n2"))


def kana_of_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, forms): tokens that are only the reading of several written forms."""
    return tokens.filter(filled("token")).select(F.col("token").alias("reading")).distinct().join(ambiguous_readings(words), "reading").select(F.col("reading").alias("token"), "forms")


def provenance(rows: DataFrame) -> DataFrame:
    """(head, places): where each head comes from, as ``<file:line>`` one after another. rows: (head, file, line)."""
    place = F.concat(F.lit("<"), "file", F.lit(":"), F.col("line").cast("string"), F.lit(">"))
    g = rows.filter(filled("head")).groupBy("head").agg(F.sort_array(F.collect_list(F.struct("file", "line", place.alias("p")))).alias("x"))
    return g.select("head", F.array_join(F.transform("x", lambda s: s["p"]), "").alias("places"))


def overlay_edits(heads: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows (head, word) with the edited heads' rows in place of their own. edits: (head, word)."""
    return heads.join(edits.select("head").distinct(), "head", "left_anti").select("head", "word").unionByName(edits.select("head", "word"))


def score_senses(candidates: DataFrame, least: float = 0.3, ratio: float = 3.0) -> DataFrame:
    """(word, sense): the best sense by mean score, if it is good enough and clearly ahead. candidates: (word, sense, score)."""
    mean = candidates.groupBy("word", "sense").agg(F.avg("score").alias("s"))
    k = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("s"), "sense"))
    top = mean.withColumn("k", k).filter("k <= 2").groupBy("word").agg(
        F.max(F.when(F.col("k") == 1, F.struct("s", "sense"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("s"))).alias("b")
    )
    ok = (F.col("a.s") >= least) & (F.col("b").isNull() | (F.col("a.s") >= ratio * F.col("b")))
    return top.filter(ok).select("word", F.col("a.sense").alias("sense"))


def edit_table(pairs: DataFrame) -> DataFrame:
    """(word, n): words by how many partners they have, for editing in that order."""
    return symmetric(pairs).groupBy("w1").agg(F.count(F.lit(1)).alias("n")).select(F.col("w1").alias("word"), "n")


def shared_initial_reading(pairs: DataFrame) -> DataFrame:
    """Pairs of words whose readings begin with the same character."""
    a, b = reading(F.col("w1")), reading(F.col("w2"))
    return pairs.filter((a != "") & (F.substring(a, 1, 1) == F.substring(b, 1, 1)))


def connected_words(once: DataFrame) -> DataFrame:
    """(h, label): words as hashes, with the hash that stands for their component. once: links in one direction.

    In each round words become the smallest word they are linked to, so what is left shrinks by a factor and long chains take few rounds. Hashes that collide
    make one component of two, never two of one.
    """
    scratch = Scratch(once.sparkSession, "words")
    links = scratch.write(once.select(*_in_order(F.xxhash64("w1"), F.xxhash64("w2"), "h", "h2")), "links")
    rounds = []
    while not rounds or not links.isEmpty():
        ends = links.unionByName(links.select(F.col("h2").alias("h"), F.col("h").alias("h2")))
        rounds.append(scratch.write(ends.groupBy("h").agg(F.least("h", F.min("h2")).alias("to")), "least"))
        new = links.join(rounds[-1], "h").select(F.col("to").alias("a"), F.col("h2").alias("h")).join(rounds[-1], "h").filter("a <> to")
        old, links = links, scratch.write(new.select(*_in_order(F.col("a"), F.col("to"), "h", "h2")).distinct(), "links")
        scratch.drop(old)
    labels = rounds[-1].withColumnRenamed("to", "label")
    for least in rounds[-2::-1]:
        labels = least.join(labels.withColumnRenamed("h", "to"), "to", "left").select("h", F.coalesce("label", "to").alias("label"))
    labels = scratch.write(labels, "labels")
    scratch.drop(links, *rounds)
    return labels


def _in_order(a: Column, b: Column, *names: str) -> list[Column]:
    return [F.least(a, b).alias(names[0]), F.greatest(a, b).alias(names[1])]


def chains(links: DataFrame, starts: DataFrame, targets: DataFrame | None = None, most: int = LINKS) -> DataFrame:
    """(start, word, steps, path): how many links away words are from each start, and the words on the way, both ends included.

    Breadth first until nothing is new, however long the chains; of the shortest paths the one that sorts first is given. Components of up to ``most`` links (each
    counts for both directions) are searched as a whole by workers, a part of the starts at a time; larger ones by rounds of joins, one a step. With
    ``targets`` (start, word) only those words are looked for, by rounds, and a start is followed no further once it has met all of its own.

    Each part of a component's starts gets all of its links, so parts follow the component's share of all rows: together they are at most ``SHARES`` for each core,
    besides one for each component. What is sent then grows with the links, not with the rows found.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "chains")
    begin = starts.filter(filled("word")).select("word").distinct()
    if targets is not None:
        both = scratch.write(symmetric(links), "links")
        wanted = scratch.write(targets.filter(filled("start") & filled("word")).select("start", "word").distinct(), "wanted")
        reached = _chains_by_rounds(scratch, both, begin.join(wanted.select(F.col("start").alias("word")).distinct(), "word", "left_semi"), wanted)
        return reached.join(targets.select("start", "word").distinct(), ["start", "word"], "left_semi")
    ok = links.filter(filled("w1") & filled("w2")).filter("w1 <> w2")
    once = scratch.write(ok.select(*_in_order(F.col("w1"), F.col("w2"), "w1", "w2")).distinct(), "links")
    labels = connected_words(once)
    begin = scratch.write(begin.join(labels.withColumnRenamed("h", "_h"), F.xxhash64("word") == F.col("_h"), "left").select("word", "label"), "starts")
    tied = scratch.write(once.join(labels, F.xxhash64("w1") == F.col("h")).select("label", "w1", "w2"), "tied")
    scratch.drop(once)
    n = begin.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n_starts"))
    n = n.join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").join(tied.groupBy("label").agg((F.count(F.lit(1)) * 2).alias("n_links")), "label")
    n = scratch.write(n, "sizes")
    scratch.drop(labels)
    fits, cost = F.col("n_links") <= most, F.col("n") * F.col("n_starts")
    rows, large = n.agg(F.sum(F.when(fits, cost)), F.max("n_links") > most).first()
    shares = SHARES * spark.sparkContext.defaultParallelism
    small = n.filter(fits).withColumn("parts", F.ceil(F.least(cost / PART, cost / F.lit(rows or 1) * shares)).cast("int"))
    one = begin.filter("label is null").select(F.col("word").alias("start"), "word", F.lit(0).alias("steps"), F.array("word").alias("path"))
    all_parts = lookup(tied, small.select("label", "n_links", "n", "parts"), "label", "n_links").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    begun = lookup(begin, small.select("label", "n_starts", "n", "parts"), "label", "n_starts").withColumn("part", F.pmod(F.hash("word"), "parts"))
    every = all_parts.select("label", "part", "n", "w1", "w2").unionByName(begun.select("label", "part", "n", F.col("word").alias("w1"), F.lit(None).cast("string").alias("w2")))
    ship(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // ROWS))
    reached = one.unionByName(every.repartition(tasks, "label", "part").sortWithinPartitions("label", "part").mapInArrow(searched, SCHEMA))
    if large:
        both = tied.select("w1", "w2").unionByName(tied.select(F.col("w2").alias("w1"), F.col("w1").alias("w2")))
        reached = reached.unionByName(_chains_by_rounds(scratch, both, begin.join(n.filter(~fits), "label").select("word")))
    return reached


def _chains_by_rounds(scratch: Scratch, both: DataFrame, begin: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """:func:`chains` from the words of begin, a job for each step."""
    frontier = scratch.write(begin.select(F.col("word").alias("start"), "word", F.lit(0).alias("steps"), F.array("word").alias("path")), "frontier")
    rounds, near = [frontier], frontier.select("start", "word")
    for step in count(1):
        follow = frontier
        if wanted is not None:
            wanted = scratch.write(wanted.join(frontier, ["start", "word"], "left_anti"), "wanted")
            follow = frontier.join(wanted.select("start").distinct(), "start", "left_semi")
        met = follow.join(both, F.col("word") == F.col("w1")).groupBy("start", F.col("w2").alias("word")).agg(F.min("path").alias("path"))
        # links go both ways, so whatever was reached before is of this round or the last one
        met = met.join(near, ["start", "word"], "left_anti")
        new = scratch.write(met.select("start", "word", F.lit(step).alias("steps"), F.array_append("path", F.col("word")).alias("path")), "frontier")
        if new.isEmpty():
            break
        rounds.append(new)
        near, frontier = frontier.select("start", "word").unionByName(new.select("start", "word")), new
    return reduce(DataFrame.unionByName, rounds)


def surfaces(words: DataFrame) -> DataFrame:
    """(word, surface, n): surfaces and numbers of morphemes."""
    return words.filter(filled("word")).select("word").distinct().select("word", headword(F.col("word")).alias("surface"), F.size(F.split(base_of(F.col("word")), r"\+")).alias("n"))
