"""Decorating phrases with synonym groups, hypernyms and antonyms, by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.config import ANTONYM, HYPERNYM, PENALTY, SYNONYM, NodeOptions
from ..functions.runtime import Scratch, filled, shuffled
from ..functions.schema import FEATURES, with_defaults

#: What tells nodes of a phrase apart; of equal ones the best stays.
KEY = ["sid", "bp", "id", "kanou", "sonnkei", "ukemi", "shieki", "negation", "weight"]


@dataclass
class Lexicon:
    """Members of groups as word chains (synid, words), the last word being the head; edges up (synid, parent, hypo_num); opposites (synid, other)."""

    members: DataFrame
    parents: DataFrame
    antonyms: DataFrame


def head_index(members: DataFrame) -> DataFrame:
    """(node_id, child_num, synid, words): members by their head, with the least number of children a phrase must have."""
    return members.filter(F.size("words") > 0).select(
        F.element_at("words", -1).alias("node_id"), F.when(F.size("words") > 1, 1).otherwise(0).alias("child_num"), "synid", "words"
    )


def basic_nodes(trees: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Nodes whose id is the phrase's own word, at score 1. Stop words keep their node at weight 0."""
    weight = F.when(F.col("id").isin(stop_words), 0.0).otherwise(1.0) if stop_words else F.lit(1.0)
    return with_defaults(trees.filter(filled("id")).withColumns({"score": F.lit(1.0), "weight": weight}).drop("parentbp"))


def register(nodes: DataFrame, threshold: float | None) -> DataFrame:
    """One node for each key: the one of the highest score; of those, the one closest to the surface."""
    if threshold is not None:
        nodes = nodes.filter((F.col("score") >= threshold) | (F.col("weight") == 0))
    rest = [c for c in nodes.columns if c not in KEY and c != "score"]
    order = F.struct("score", (~F.col("relation")).alias("r"), (~F.col("antonym")).alias("a"), (-F.size("matchbp")).alias("m"), (-F.coalesce("hypo_num", F.lit(0))).alias("h"), F.struct(*rest).alias("x"))
    best = nodes.groupBy(*KEY).agg(F.max(order).alias("b"))
    return best.select(*KEY, "b.score", *[F.col(f"b.x.{c}").alias(c) for c in rest]).select(*nodes.columns)


def steps(lexicon: Lexicon, options: NodeOptions) -> DataFrame:
    """(id, steps): where each id leads: to its hypernyms, with how many hyponyms they have, and to its opposites."""
    up = lexicon.parents.select(F.col("synid").alias("id"), F.struct(F.lit(True).alias("up"), F.col("parent").alias("to"), F.col("hypo_num").cast("int").alias("n")).alias("s"))
    if options.max_hyponyms is not None:
        up = up.filter(F.col("s.n") <= options.max_hyponyms)
    over = lexicon.antonyms.select(F.col("synid").alias("id"), F.struct(F.lit(False).alias("up"), F.col("other").alias("to"), F.lit(None).cast("int").alias("n")).alias("s"))
    chosen = [t for t, wanted in ((up, options.hypernyms), (over, options.antonyms)) if wanted]
    every = chosen[0] if len(chosen) == 1 else up.unionByName(over) if chosen else up.limit(0)
    return every.filter("s.to is not null").groupBy("id").agg(F.collect_set("s").alias("steps"))


def expand(nodes: DataFrame, leads: DataFrame) -> DataFrame:
    """The nodes with their hypernyms and opposites, which lead no further. leads: by :func:`steps`."""
    kind = "struct<id:string,cost:double,relation:boolean,antonym:boolean,flip:boolean,hypo_num:int>"
    itself = F.struct("id", F.lit(1.0), "relation", "antonym", F.lit(False), "hypo_num").cast(kind)
    bound = F.col("relation") | F.col("antonym") | F.col("not_synnode")
    further = F.transform(
        F.when(bound | F.col("steps").isNull(), F.array().cast("array<struct<up:boolean,to:string,n:int>>")).otherwise(F.col("steps")),
        lambda s: F.struct(s["to"], F.when(s["up"], HYPERNYM).otherwise(ANTONYM), s["up"], ~s["up"], ~s["up"], s["n"]).cast(kind),
    )
    led = nodes.join(leads, "id", "left").withColumn("_to", F.explode(F.concat(F.array(itself), further)))
    new = {"id": F.col("_to.id"), "score": F.col("score") * F.col("_to.cost"), "relation": F.col("_to.relation"), "antonym": F.col("_to.antonym"), "negation": F.col("negation") != F.col("_to.flip"), "hypo_num": F.col("_to.hypo_num")}
    return led.select(*[new.get(c, F.col(c)).alias(c) for c in nodes.columns])


def ancestors(nodes: DataFrame, lexicon: Lexicon, options: NodeOptions) -> DataFrame:
    """Hypernyms at any distance of the nodes that aren't opposites, without a threshold; they stop at ids that the phrase has already."""
    up = lexicon.parents.select(F.col("synid").alias("id"), "parent", F.col("hypo_num").alias("n"))
    if options.max_hyponyms is not None:
        up = up.filter(F.col("n") <= options.max_hyponyms)
    scratch = Scratch(nodes.sparkSession, "hypernyms")
    out, frontier = nodes, nodes.filter("not antonym and not not_synnode")
    while True:
        above = frontier.join(up, "id").withColumns({"score": F.col("score") * HYPERNYM, "relation": F.lit(True), "hypo_num": F.col("n").cast("int"), "id": F.col("parent")}).select(*nodes.columns)
        have = out.select("sid", "bp", "id").distinct()
        frontier = scratch.write(register(above.join(shuffled(have), ["sid", "bp", "id"], "left_anti"), None), "above")
        if frontier.isEmpty():
            return out
        out = out.unionByName(frontier)


def _covered(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


@dataclass
class Prefilters:
    """What keeps groups from being attached. senses: (sid, bp, id) of groups that word senses rule out; entries: (sid, first, last) of phrases inside of which no group stands."""

    senses: DataFrame | None = None
    entries: DataFrame | None = None


def frames(trees: DataFrame) -> DataFrame:
    """(sid, frame): the children, first word, function word and weight of each phrase of a sentence, as a map."""
    have = lambda c, kind: F.col(c).cast(kind) if c in trees.columns else F.lit(None).cast(kind)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", have("fuzoku", "string").alias("fuzoku"), F.coalesce(have("weight", "double"), F.lit(1.0)).alias("weight"))).alias("f")
    per = trees.groupBy("sid", "bp").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("childbp")))).alias("kids"), first)
    entry = F.struct("bp", F.struct("kids", F.col("f.id").alias("word"), F.col("f.fuzoku").alias("fuzoku"), F.col("f.weight").alias("weight")))
    return per.groupBy("sid").agg(F.map_from_entries(F.collect_list(entry)).alias("frame"))


def _at(bp: Column | str) -> Column:
    return F.try_element_at(F.col("frame"), bp if isinstance(bp, Column) else F.col(bp))


def _flat() -> Column:
    """The first words of the phrases up to this one are the member's words one after another."""
    n = F.size("words")
    return F.slice("words", 1, n - 1) == F.transform(F.sequence(F.col("bp") - n + 1, F.col("bp") - 1), lambda k: _at(k)["word"])


def _particle() -> Column:
    """Some child has は, の, the member's function word, or none."""
    child = F.transform(_at("bp")["kids"], lambda k: F.coalesce(_at(k)["fuzoku"], F.lit("")))
    return F.exists(child, lambda c: c.isin("", "は", "の") | F.coalesce(c == F.col("member_fuzoku"), F.lit(False)))


def _not_own() -> Column:
    return F.col("synid") != F.split_part(F.col("sid").cast("string"), F.lit(","), F.lit(1))


def _of_one_word(fresh: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes of groups that have a member of the one word that a node stands for."""
    met = fresh.filter("weight > 0").withColumnRenamed("id", "node_id").join(heads, "node_id").filter(_not_own())
    return met.withColumns({"id": F.col("synid"), "score": F.col("score") * SYNONYM, "hypo_num": F.lit(None).cast("int")}).select(*fresh.columns)


def _of_several_words(nodes: DataFrame, frame: DataFrame, heads: DataFrame, longest: int) -> DataFrame:
    """Nodes of groups that have a member whose words are found one below the other along the dependencies, from its last word on.

    Of the children that fit to the end the first ones count, of a child's nodes the one of the highest score, then the largest weight, then the fewest differences.
    Features differing at the head stay the node's; below they cost. heads: (node_id, synid, words, tag, member_fuzoku).
    """
    n = nodes.filter("weight > 0 and size(childbp) > 0").withColumnRenamed("id", "node_id").join(heads, "node_id").filter(_not_own()).join(shuffled(frame), "sid")
    tag = F.coalesce("tag", F.lit(""))
    n = n.filter(F.when(tag.isin("Wikipedia", "Web"), (F.col("bp") - F.size("words") + 1 >= 0) & F.coalesce(_flat(), F.lit(False))).when(tag == "同義句", F.coalesce(_particle(), F.lit(False))).otherwise(True))
    own = F.struct(*[c for c in nodes.columns if c != "id"]).alias("own")
    state = n.select(
        "sid", "bp", "node_id", "synid", "words", own, F.col("childbp").alias("kids"), F.col("score").alias("total"), F.col("relation").alias("rel"), F.col("antonym").alias("ant"),
        _covered("matchbp", F.array("bp")).alias("cov"), F.array().cast("array<int>").alias("path"),
    )
    child = nodes.filter("weight > 0").select(
        "sid", F.col("bp").alias("c"), F.col("id").alias("wanted"), F.struct("score", "weight", "matchbp", "childbp", "relation", "antonym", "case", *FEATURES).alias("n"),
    )
    differs = [F.col(f"n.{f}") for f in FEATURES]
    fewest = -sum((x.cast("int") for x in differs), F.lit(0))
    cost = F.lit(1.0)
    for f, x in zip(FEATURES, differs):
        cost = cost * F.when(x, PENALTY[f]).otherwise(1.0)
    found = None
    for word in range(2, longest + 1):
        down = state.filter(F.size("words") >= word).withColumn("c", F.explode("kids")).withColumn("wanted", F.element_at("words", -word))
        met = down.join(shuffled(child), ["sid", "c", "wanted"])
        best = met.groupBy(*state.columns, "c").agg(F.max(F.struct(F.col("n.score").alias("s"), F.col("n.weight").alias("w"), fewest.alias("f"), cost.alias("cost"), "n")).alias("b"))
        state = best.select(
            "sid", "bp", "node_id", "synid", "words", "own", F.col("b.n.childbp").alias("kids"), (F.col("total") + F.col("b.s") * F.col("b.cost")).alias("total"), (F.col("rel") | F.col("b.n.relation")).alias("rel"),
            (F.col("ant") | F.col("b.n.antonym")).alias("ant"), _covered("cov", "b.n.matchbp", F.array("c")).alias("cov"), F.array_append("path", -F.col("c")).alias("path"),
        )
        done = state.filter(F.size("words") == word)
        found = done if found is None else found.unionByName(done)
    firsts = found.groupBy("sid", "bp", "node_id", "synid", "words", "own").agg(F.max(F.struct("path", "total", "rel", "ant", "cov")).alias("b")).join(shuffled(frame), "sid")
    below = F.flatten(F.transform("b.cov", lambda k: F.coalesce(_at(k)["kids"], F.array().cast("array<int>"))))
    made = {
        "id": F.col("synid"), "score": F.col("b.total") / F.size("words") * SYNONYM, "weight": F.aggregate("b.cov", F.lit(0.0), lambda s, k: s + F.coalesce(_at(k)["weight"], F.lit(0.0))), "relation": F.col("b.rel"), "antonym": F.col("b.ant"),
        "matchbp": F.array_except("b.cov", F.array("bp")), "childbp": F.array_sort(F.array_except(F.array_distinct(below), "b.cov")), "hypo_num": F.lit(None).cast("int"),
    }
    return firsts.select(*[(made[c] if c in made else F.col(c) if c in ("sid", "bp") else F.col(f"own.{c}")).alias(c) for c in nodes.columns])


def _member_table(members: DataFrame) -> DataFrame:
    """(node_id, synid, words, tag, member_fuzoku) by the members' last words, once each."""
    have = lambda c: F.col(c) if c in members.columns else F.lit(None).cast("string")
    m = members.filter(F.size("words") > 0).select(F.element_at("words", -1).alias("node_id"), "synid", "words", have("tag").alias("tag"), have("fuzoku").alias("member_fuzoku"))
    return m.dropDuplicates(["synid", "words", "tag", "member_fuzoku"])


def attach(trees: DataFrame, lexicon: Lexicon, options: NodeOptions | None = None, filters: Prefilters | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """All nodes of phrase trees: own words, groups that have a member standing there, of any number of words, hypernyms and antonyms.

    Rounds of joins over all sentences at once, each from what the last one found: new nodes of one phrase probe the head index, and
    sentences with new nodes that a longer member's word could meet are matched along their dependencies; rounds end when nothing is new or better.
    trees: (sid, bp, id, parentbp, childbp), with ``fuzoku`` where members are similar phrases. Members may have a ``tag``: those of Wikipedia and Web must stand
    in a row, similar phrases (同義句) must fit by a child's function word, the second last of their own being ``fuzoku``. Phrases without a word have no node;
    sentences whose id is a group's don't get that group. Equal nodes count once; repeated sentences are one.
    """
    options, filters = options or NodeOptions(), filters or Prefilters()
    threshold = None if options.recursive else options.threshold
    scratch = Scratch(trees.sparkSession, "attach")
    trees = trees.dropDuplicates(["sid", "bp", "id"])
    if stop_words:
        trees = trees.withColumn("weight", F.when(F.col("id").isin(stop_words), 0.0).otherwise(1.0))
    members = _member_table(lexicon.members)
    one, several = members.filter(F.size("words") == 1).select("node_id", "synid").distinct(), members.filter(F.size("words") > 1)
    longest = several.agg(F.max(F.size("words"))).first()[0] or 1
    leads = steps(lexicon, options)
    keys = one.select(F.col("node_id").alias("id"), F.lit(False).alias("many"))
    if longest > 1:
        frame = scratch.write(frames(trees), "frames")
        keys = keys.unionByName(several.select(F.explode("words").alias("id"), F.lit(True).alias("many")))
    keys = keys.groupBy("id").agg(F.max("many").alias("many"))

    def written(nodes: DataFrame) -> tuple[DataFrame, DataFrame, bool | None]:
        """The nodes as a table; of those that a member's word could meet the sentences with longer members, and whether there are any such (None if no member is met)."""
        seen = Observation()
        out = scratch.write(nodes.join(keys, "id", "left").observe(seen, F.max("many").alias("many")), "nodes")
        return out.drop("many"), out.filter("many").select("sid").distinct(), seen.get["many"]

    delta, touched, kind = written(register(expand(basic_nodes(trees.drop("weight"), stop_words), leads), threshold))
    every = delta
    while kind is not None:
        new = _of_one_word(delta, one)
        if kind:
            near = shuffled(touched)
            new = new.unionByName(_of_several_words(every.join(near, "sid", "left_semi"), frame.join(near, "sid", "left_semi"), several, longest))
        if filters.senses is not None:
            new = new.join(shuffled(filters.senses.select("sid", "bp", "id").distinct()), ["sid", "bp", "id"], "left_anti")
        if filters.entries is not None:
            new = outside_entries(new, filters.entries)
        new = register(expand(new, leads), threshold)
        had = every.groupBy(*KEY).agg(F.max("score").alias("was"))
        delta, touched, kind = written(new.join(shuffled(had), KEY, "left").filter("was is null or score > was + 1e-12").select(*every.columns))
        every = every.unionByName(delta)
    nodes = register(every, threshold)
    if options.recursive:
        nodes = register(ancestors(nodes.filter("not relation"), lexicon, options).unionByName(nodes.filter("relation")), None)
    return nodes


def without_other_senses(nodes: DataFrame, resolved: DataFrame, inventory: DataFrame) -> DataFrame:
    """Nodes without the groups of senses that were ruled out. resolved: (sid, bp, word, m); inventory: (word, m, synid)."""
    other = resolved.join(inventory.withColumnRenamed("m", "m2"), "word").filter("m2 <> m").select("sid", "bp", F.col("synid").alias("id")).distinct()
    return nodes.join(shuffled(other), ["sid", "bp", "id"], "left_anti")


def outside_entries(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes that don't lie inside a longer entry; one over exactly the entry's span stays. entries: (sid, first, last)."""
    span = nodes.withColumns({"_f": F.array_min(F.array_append("matchbp", F.col("bp"))), "_l": F.col("bp")})
    inside = (F.col("first") <= F.col("_f")) & (F.col("_l") <= F.col("last")) & ((F.col("first") != F.col("_f")) | (F.col("last") != F.col("_l")))
    return span.join(shuffled(entries), (span["sid"] == entries["sid"]) & inside, "left_anti").drop("_f", "_l")


def flat_matches(trees: DataFrame, phrases: DataFrame) -> DataFrame:
    """(sid, bp, phrase): where the words of a phrase stand one after another, up to its last word at bp. phrases: (phrase, words)."""
    sent = trees.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("bp", "id"))).alias("s")).select("sid", F.transform("s", lambda x: x["id"]).alias("ids"))
    at = trees.select("sid", "bp", F.col("id").alias("last")).join(phrases.select("phrase", "words", F.element_at("words", -1).alias("last")), "last").join(sent, "sid")
    n = F.size("words")
    ok = (F.col("bp") + 1 >= n) & (F.slice("ids", F.greatest(F.col("bp") + 2 - n, F.lit(1)), n) == F.col("words"))
    return at.filter(ok).select("sid", "bp", "phrase").distinct()


def full_cover(nodes: DataFrame) -> DataFrame:
    """Nodes of the last phrase that cover the whole sentence, with their type: syn, isa or antonym."""
    last = nodes.groupBy("sid").agg(F.max("bp").alias("last"))
    whole = nodes.join(shuffled(last), "sid").filter((F.col("bp") == F.col("last")) & (F.size("matchbp") == F.col("last")))
    kind = F.when(F.col("antonym"), "antonym").when(F.col("relation") | (F.col("score") < SYNONYM), "isa").otherwise("syn")
    return whole.withColumn("type", kind).drop("last")


def only_hypernym(nodes: DataFrame) -> DataFrame:
    """(sid, hypernym): of each sentence with exactly one hypernym over the whole of it, else an empty text."""
    h = full_cover(nodes).filter("relation").groupBy("sid").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    return nodes.select("sid").distinct().join(shuffled(h), "sid", "left").select("sid", F.when(F.col("n") == 1, F.col("id")).otherwise("").alias("hypernym"))


def ids_by_type(nodes: DataFrame) -> DataFrame:
    """(sid, type, ids): what the whole sentence is, by type."""
    g = full_cover(nodes).groupBy("sid", "type").agg(F.array_join(F.array_sort(F.collect_set("id")), "|").alias("ids"))
    return g.select("sid", "type", "ids")


def count_group_nodes(nodes: DataFrame, pattern: str = "^[sg][0-9]") -> DataFrame:
    """(sid, n_phrases, n_group_nodes)."""
    return nodes.groupBy("sid").agg((F.max("bp") + 1).alias("n_phrases"), F.sum(F.when(F.col("id").rlike(pattern), 1).otherwise(0)).alias("n_group_nodes"))


def least_children(nodes: DataFrame) -> DataFrame:
    """(sid, child_num): the smallest number of children over the nodes of the last phrase, 10 at most."""
    last = nodes.groupBy("sid").agg(F.max("bp").alias("last"))
    tail = nodes.join(shuffled(last), "sid").filter("bp = last")
    return tail.groupBy("sid").agg(F.least(F.lit(10), F.min(F.size("childbp"))).alias("child_num"))


def line_of() -> Column:
    """A node as a line of the annotated text."""
    cover = F.array_join(F.transform(F.array_sort(F.array_append("matchbp", F.col("bp"))), lambda x: x.cast("string")), ",")
    flags = [
        F.when(F.col("antonym"), "<反義語>").otherwise(""), F.when(F.col("relation"), "<上位語>").otherwise(""),
        F.when(F.coalesce("hypo_num", F.lit(0)) != 0, F.concat(F.lit("<下位語数:"), F.col("hypo_num").cast("string"), F.lit(">"))).otherwise(""),
        *[F.when(F.col(f), f"<{t}>").otherwise("") for f, t in (("negation", "否定"), ("kanou", "可能"), ("sonnkei", "尊敬"), ("ukemi", "受身"), ("shieki", "使役"))],
    ]
    score = F.regexp_replace(F.regexp_replace(F.format_number("score", 6), "0+$", ""), r"\.$", "")
    return F.concat(F.lit("! "), cover, F.lit(" <SYNID:"), "id", F.lit("><スコア:"), score, F.lit(">"), *flags)


def node_lines(nodes: DataFrame) -> DataFrame:
    """(sid, bp, line): each node as a line of the annotated text."""
    return nodes.select("sid", "bp", line_of().alias("line"))


def compile_members(members: DataFrame) -> DataFrame:
    """(synid, expression, bp, id, score): members of several words with all ids that the lexicon itself gives their phrases.

    The lexicon annotates its own members until nothing is new, without hypernyms and antonyms; a group is never put on its own members, and
    members of one word get nothing, as that would make all groups of a word one.
    """
    several = members.filter(F.size("words") > 1).select("synid", "words", F.array_join("words", " ").alias("expression")).dropDuplicates(["synid", "expression"])
    sid = F.concat("synid", F.lit(","), "expression")
    p = several.select(sid.alias("sid"), F.posexplode("words").alias("bp", "id"))
    none = F.array().cast("array<int>")
    trees = p.withColumns({"parentbp": F.lit(-1), "childbp": F.when(F.col("bp") > 0, F.array(F.col("bp") - 1)).otherwise(none)})
    empty = members.sparkSession.sql("SELECT '' AS synid, '' AS parent, 0 AS hypo_num, '' AS other").limit(0)
    nodes = attach(trees, Lexicon(members, empty.select("synid", "parent", "hypo_num"), empty.select("synid", "other")), NodeOptions(hypernyms=False, antonyms=False))
    return nodes.join(several.select(sid.alias("sid"), "synid", "expression"), "sid").select("synid", "expression", "bp", "id", "score", "childbp", "matchbp")


def compiled_heads(compiled: DataFrame) -> DataFrame:
    """(node_id, child_num, synid, expression): the head index over all ids of the members' last phrases."""
    last = compiled.groupBy("synid", "expression").agg(F.max("bp").alias("last"))
    tail = compiled.join(last, ["synid", "expression"]).filter("bp = last")
    n = tail.groupBy("synid", "expression").agg(F.least(F.lit(10), F.min(F.size("childbp"))).alias("child_num"))
    return tail.select("synid", "expression", F.col("id").alias("node_id")).distinct().join(n, ["synid", "expression"]).select("node_id", "child_num", "synid", "expression")


def memory_matches(nodes: DataFrame, trees: DataFrame, memory: DataFrame, most: int = 10, target: str | None = None) -> DataFrame:
    """(sid, bp, stid, covered, score): entries of a translation memory found in sentences, at most so many for each set of phrases they cover.

    memory: (stid, words, mvalue). With ``target`` only entries that have one of their values in it count. Nodes are taken as they are: what is
    found doesn't lead on.
    """
    m = memory
    if target is not None:
        m = m.filter(F.exists("mvalue", lambda v: F.contains(F.lit(target), v)))
    table = _member_table(m.select(F.col("stid").alias("synid"), "words"))
    longest = m.agg(F.max(F.size("words"))).first()[0] or 0
    found = _of_one_word(nodes, table.filter(F.size("words") == 1).select("node_id", "synid"))
    if longest > 1:
        found = found.unionByName(_of_several_words(nodes, frames(trees), table.filter(F.size("words") > 1), longest))
    best = found.groupBy("sid", "bp", F.col("id").alias("stid"), F.array_sort(F.array_append("matchbp", F.col("bp"))).alias("covered")).agg(F.max(F.col("score") / SYNONYM).alias("score"))
    k = F.row_number().over(Window.partitionBy("sid", "covered").orderBy(F.desc("score"), "stid"))
    return best.withColumn("k", k).filter(F.col("k") <= most).drop("k")


def phrase_case_filter(candidates: DataFrame) -> DataFrame:
    """Candidates of similar phrases that may match by case: some child has は, の, the phrase's own function word, or none.

    candidates: (..., child_fuzoku: array of the children's function words, fuzoku: the phrase's).
    """
    ok = F.exists("child_fuzoku", lambda c: c.isNull() | c.isin("", "は", "の") | (c == F.col("fuzoku")))
    return candidates.filter(F.coalesce(ok, F.lit(False)))


def node_logs(nodes: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(sid, bp, id, log): how each node came about, in words: ``word``, ``member=>group``, ``id=>hypernym(上位)``, ``id=>opposite(反義)``.

    A node may have several logs, one for each way it can be reached from the other nodes of its phrase. Members are named, whatever node
    stood for their words.
    """
    plain = nodes.filter("not relation and not antonym").select("sid", "bp", F.col("id").alias("from")).distinct()
    up = plain.join(lexicon.parents.select(F.col("synid").alias("from"), F.col("parent").alias("id")), "from").select("sid", "bp", "id", F.concat("from", F.lit("=>"), "id", F.lit("(上位)")).alias("log"))
    over = plain.join(lexicon.antonyms.select(F.col("synid").alias("from"), F.col("other").alias("id")), "from").select("sid", "bp", "id", F.concat("from", F.lit("=>"), "id", F.lit("(反義)")).alias("log"))
    head = nodes.select("sid", "bp", F.col("id").alias("node_id")).distinct().join(head_index(lexicon.members), "node_id")
    same = head.select("sid", "bp", F.col("synid").alias("id"), F.concat(F.array_join("words", "+"), F.lit("=>"), "synid").alias("log"))
    have = nodes.select("sid", "bp", "id", "relation", "antonym").distinct()
    kinds = have.select("sid", "bp", "id", "relation", "antonym")
    one = kinds.filter("relation").select("sid", "bp", "id").join(shuffled(up), ["sid", "bp", "id"])
    two = kinds.filter("antonym").select("sid", "bp", "id").join(shuffled(over), ["sid", "bp", "id"])
    three = kinds.select("sid", "bp", "id").distinct().join(shuffled(same), ["sid", "bp", "id"])
    made = one.unionByName(two).unionByName(three).distinct()
    bare = kinds.select("sid", "bp", "id").distinct().join(shuffled(made.select("sid", "bp", "id").distinct()), ["sid", "bp", "id"], "left_anti")
    return made.unionByName(bare.withColumn("log", F.col("id")))


def inspect_groups(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(line_no, members, parents, n_children): what a lexicon holds of each group. groups: (line_no, word); edges: (child, parent)."""
    g = groups.select("line_no", "word").distinct()
    up = g.join(edges.select(F.col("child").alias("word"), "parent").distinct(), "word").groupBy("line_no").agg(F.array_join(F.array_sort(F.collect_set("parent")), "|").alias("parents"))
    n = edges.distinct().groupBy(F.col("parent").alias("word")).agg(F.count(F.lit(1)).alias("k"))
    down = g.join(n, "word").groupBy("line_no").agg(F.sum("k").alias("n_children"))
    m = g.groupBy("line_no").agg(F.array_join(F.array_sort(F.collect_set("word")), "|").alias("members"))
    out = m.join(up, "line_no", "left").join(down, "line_no", "left")
    return out.select("line_no", "members", F.coalesce("parents", F.lit("")).alias("parents"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"))
