"""Whether and how two expressions mean the same."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import PENALTY, MatchOptions
from ..functions.runtime import ship
from ..functions.schema import FEATURES
from ..functions.strings import base_of
from .annotate import full_cover


#: Features that are compared; those a node doesn't have count as false.
COMPARED = ("fuzoku", "case", *FEATURES)
_CELL = "struct<to:int,at:int,kids:array<int>,wanted:array<int>,value:double,free:double,head:boolean,stays:boolean>"


def within(nodes: DataFrame, body: DataFrame) -> DataFrame:
    """The nodes that lie in the phrases ``body`` (sid, bp) of their sentence, without children outside; sentences that have no body have none."""
    inside = body.groupBy("sid").agg(F.collect_set("bp").alias("_body"))
    held = nodes.join(inside, "sid").filter(F.array_contains("_body", F.col("bp")) & (F.size(F.array_except("matchbp", "_body")) == 0))
    return held.withColumn("childbp", F.array_intersect("childbp", "_body")).drop("_body")


def _standing(pairs: DataFrame, ones: DataFrame, twos: DataFrame, options: MatchOptions) -> DataFrame:
    """(a, b, at, to, cell): for phrases that have an id in common the node pair of the highest score, then the largest weight, then the fewest differences."""
    fields = ["bp", "score", "weight", "childbp", "matchbp", "relation", "antonym", "hypo_num", *COMPARED]
    x = ones.select(F.col("sid").alias("a"), "id", F.struct(*fields).alias("x"))
    y = twos.select(F.col("sid").alias("b"), "id", F.struct(*fields).alias("y"))
    met = pairs.join(x, "a").join(y, ["b", "id"]).filter("not (x.antonym and y.antonym)")
    if not options.coordinate:
        met = met.filter("not (x.relation and y.relation)")
    if options.max_hyponyms is not None:
        met = met.filter(F.greatest(F.coalesce("x.hypo_num", F.lit(0)), F.coalesce("y.hypo_num", F.lit(0))) <= options.max_hyponyms)
    text = lambda side, f: F.coalesce(F.col(f"{side}.{f}"), F.lit(""))
    flag = lambda side, f: F.coalesce(F.col(f"{side}.{f}"), F.lit(False))
    differ = {f: (text if f in ("fuzoku", "case") else flag)("x", f) != (text if f in ("fuzoku", "case") else flag)("y", f) for f in COMPARED}
    fewest = -sum((d.cast("int") for d in differ.values()), F.lit(0))
    paid = differ | {"case": differ["case"] & (text("x", "case") != "") & (text("y", "case") != "")}
    value = F.col("x.score") * F.col("y.score")
    cost = value
    for f in COMPARED:
        cost = cost * F.when(paid[f], PENALTY[f]).otherwise(1.0)
    head = ~(differ["fuzoku"] & (text("y", "fuzoku") != ""))  # the target may lack a function word, not have another
    stays = ~differ["fuzoku"] if options.same_particles else F.lit(True)
    cell = F.struct(F.col("y.bp").alias("to"), F.col("x.bp").alias("at"), F.col("x.childbp").alias("kids"), F.col("y.childbp").alias("wanted"), cost.alias("value"), value.alias("free"), head.alias("head"), stays.alias("stays"))
    order = F.struct(value.alias("s"), (F.col("x.weight") + F.col("y.weight")).alias("w"), fewest.alias("f"), F.col("x.score").alias("first"), (-F.size("x.matchbp")).alias("m"), (-F.size("y.matchbp")).alias("n"), cell.cast(_CELL).alias("cell"))
    best = met.filter(value > 0).groupBy("a", "b", F.col("x.bp").alias("at"), F.col("y.bp").alias("to")).agg(F.max(order).alias("m"))
    return best.select("a", "b", "at", "to", "m.cell")


def _mean(cells: list[dict], head: tuple[int, int]) -> float | None:
    """The mean value of a tree's phrases where each child stands for another child, the first that fits, or None.

    Phrases are settled once a pair, dependents before heads, without recursion. Heads cost nothing, all others their differences.
    """
    at = {(c["at"], c["to"]): c for c in cells}
    if head not in at or not at[head]["head"]:
        return None
    chosen: dict[tuple[int, int], list | None] = {}
    todo = [head]
    while todo:
        here = todo[-1]
        if here in chosen:
            todo.pop()
            continue
        free, taken, waits = sorted(at[here]["kids"]), [], None
        fits = len(free) >= len(at[here]["wanted"])
        for c in sorted(at[here]["wanted"]) if fits else ():
            for k in free:
                below = (k, c)
                if below in at and below not in chosen and k < here[0]:
                    waits = below
                    break
                if chosen.get(below) is not None:
                    taken.append(below)
                    free.remove(k)
                    break
            else:
                fits = False
            if waits or not fits:
                break
        if waits:
            todo.append(waits)
        else:
            chosen[here] = taken if fits else None
            todo.pop()
    if chosen[head] is None:
        return None
    total, n, walk = at[head]["free"], 1, list(chosen[head])
    while walk:
        p = walk.pop()
        if not at[p]["stays"]:
            return None
        total, n = total + at[p]["value"], n + 1
        walk += chosen[p]
    return total / n


def match_pairs(pairs: DataFrame, nodes: DataFrame, keep: list[str], options: MatchOptions | None = None, others: DataFrame | None = None) -> DataFrame:
    """(keep..., score): how well sentence ``b`` of each pair as a whole is found at the head of ``a``; null where it isn't or where one has no nodes.

    Phrases are met by join on their ids; what is left for a pair is one pass that seats children. nodes are of both, or of ``a`` with ``others`` of ``b``.
    """
    ship(pairs.sparkSession)
    others = nodes if others is None else others
    once = pairs.select("a", "b").filter("a is not null and b is not null").distinct()
    last = lambda n, side, name: n.groupBy(F.col("sid").alias(side)).agg(F.max("bp").alias(name))
    cells = _standing(once, nodes, others, options or MatchOptions()).groupBy("a", "b").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    rows = cells.join(last(nodes, "a", "la"), "a").join(last(others, "b", "lb"), "b").select("a", "b", "la", "lb", "cells")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("a", "b")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [_mean(c, (x, y)) for x, y, c in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["a", "b", "score"])

    scored = rows.mapInArrow(work, f"a {kinds[0]}, b {kinds[1]}, score double")
    return pairs.join(scored, ["a", "b"], "left").select(*keep, "score")


def two_expression_relation(pairs: DataFrame, nodes: DataFrame, keep: list[str], compat: bool = False) -> DataFrame:
    """(keep..., relation): how ``a`` relates to ``b`` by the ids that stand for the whole of both.

    The first that applies of: ``syn`` (both sides by synonymy), ``ant`` (one side by an antonym, of the same polarity as the other),
    ``isa_0`` (a itself lies under b's hypernyms as theirs: a is syn, b is isa), ``isa_1`` (the other way round), else ``none``. With
    ``compat`` either side alone decides between the last two.
    """
    whole = full_cover(nodes).select("sid", "id", "type", "negation")
    one = whole.select(F.col("sid").alias("a"), "id", F.col("type").alias("ta"), F.col("negation").alias("na"))
    two = whole.select(F.col("sid").alias("b"), "id", F.col("type").alias("tb"), F.col("negation").alias("nb"))
    shared = pairs.join(one, "a").join(two, ["b", "id"])
    syn = (F.col("ta") == "syn") & (F.col("tb") == "syn") & (F.col("na") == F.col("nb"))
    ant = ((F.col("ta") == "antonym") != (F.col("tb") == "antonym")) | (F.col("na") != F.col("nb"))
    if compat:
        down, up = (F.col("ta") == "syn") | (F.col("tb") == "isa"), (F.col("ta") == "isa") | (F.col("tb") == "syn")
    else:
        down, up = (F.col("ta") == "syn") & (F.col("tb") == "isa"), (F.col("ta") == "isa") & (F.col("tb") == "syn")
    rank = F.when(syn, 1).when(ant, 2).when(down, 3).when(up, 4).otherwise(5)
    best = shared.groupBy(*keep).agg(F.min(rank).alias("rank"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("syn", "ant", "isa_0", "isa_1", "none")]), F.col("rank"))
    return pairs.select(*keep).distinct().join(best, keep, "left").select(*keep, F.coalesce(name, F.lit("none")).alias("relation"))


def _positions(pairs: DataFrame) -> DataFrame:
    """One row for each morpheme position of pairs of equally many morphemes."""
    a, b = F.split(base_of(F.col("w1")), r"\+"), F.split(base_of(F.col("w2")), r"\+")
    p = pairs.withColumns({"x": a, "y": b}).filter(F.size("x") == F.size("y"))
    zipped = F.arrays_zip("x", "y")
    return p.select("w1", "w2", F.size("x").alias("n"), F.posexplode(zipped).alias("i", "z")).select("w1", "w2", "n", "i", F.col("z.x").alias("p"), F.col("z.y").alias("q"))


def _held(df: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Adds whether (p, q) is in a pair table in either direction."""
    t = table.select(F.explode(F.array(F.struct(F.col("w1").alias("p"), F.col("w2").alias("q")), F.struct(F.col("w2").alias("p"), F.col("w1").alias("q")))).alias("z"))
    t = t.select("z.p", "z.q").filter("p is not null and q is not null").distinct().withColumn(name, F.lit(True))
    return df.join(t, ["p", "q"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _shared_sets(df: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds whether p and q have a synonym set in common. sets: (word, set_id)."""
    s = sets.groupBy("word").agg(F.collect_set("set_id").alias("s"))
    df = df.join(s.toDF("p", "sp"), "p", "left").join(s.toDF("q", "sq"), "q", "left")
    return df.withColumn("set", F.coalesce(F.arrays_overlap("sp", "sq"), F.lit(False))).drop("sp", "sq")


def is_synonym(pairs: DataFrame, synonyms: DataFrame, sets: DataFrame) -> DataFrame:
    """(w1, w2, synonym): morpheme by morpheme the same, listed as synonyms in either order, or in one synonym set."""
    each = _shared_sets(_held(_positions(pairs), synonyms, "syn"), sets)
    ok = (F.col("p") == F.col("q")) | F.col("syn") | F.col("set")
    g = each.groupBy("w1", "w2").agg(F.min(ok.cast("int")).alias("all"))
    return pairs.select("w1", "w2").distinct().join(g, ["w1", "w2"], "left").select("w1", "w2", (F.coalesce("all", F.lit(0)) == 1).alias("synonym"))


def is_antonym(pairs: DataFrame, antonyms: DataFrame, synonyms: DataFrame, sets: DataFrame) -> DataFrame:
    """(w1, w2, antonym): an odd number of positions are opposites and all others the same or synonyms; or one is 不 and the other."""
    each = _shared_sets(_held(_held(_positions(pairs), synonyms, "syn"), antonyms, "ant"), sets)
    same = (F.col("p") == F.col("q")) | F.col("syn") | F.col("set")
    g = each.groupBy("w1", "w2").agg(F.sum(F.col("ant").cast("int")).alias("n"), F.min((same | F.col("ant")).cast("int")).alias("all"))
    odd = (F.coalesce("all", F.lit(0)) == 1) & (F.coalesce("n", F.lit(0)) % 2 == 1)
    prefix = (F.col("w1") == F.concat(F.lit("不"), "w2")) | (F.col("w2") == F.concat(F.lit("不"), "w1"))
    return pairs.select("w1", "w2").distinct().join(g, ["w1", "w2"], "left").select("w1", "w2", (odd | prefix).alias("antonym"))


def pair_store_check(pairs: DataFrame, store: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """(w1, w2, listed): whether the pair is listed in either order and, if ``single`` is given, both words have one sense only."""
    p = _held(pairs.select(F.col("w1").alias("p"), F.col("w2").alias("q")).distinct(), store, "listed")
    if single is not None:
        one = single.select("word").distinct()
        p = p.join(one.select(F.col("word").alias("p"), F.lit(True).alias("a")), "p", "left").join(one.select(F.col("word").alias("q"), F.lit(True).alias("b")), "q", "left")
        p = p.withColumn("listed", F.col("listed") & F.coalesce("a", F.lit(False)) & F.coalesce("b", F.lit(False)))
    return p.select(F.col("p").alias("w1"), F.col("q").alias("w2"), "listed")


def compatible(a: Column, b: Column) -> Column:
    """Whether two words can be one: the same base, or one is the other's written form or reading; not with different sense numbers."""
    x, y = base_of(a), base_of(b)
    sx, sy = F.substr(a, F.length(x) + 1), F.substr(b, F.length(y) + 1)

    def forms(w: Column) -> Column:
        return F.array_union(F.array(w), F.split(w, "/"))

    alias = F.array_contains(forms(x), y) | F.array_contains(forms(y), x)
    return alias & ((sx == sy) | (sx == "") | (sy == ""))


def richer(a: Column, b: Column) -> Column:
    """Of two compatible words the richer spelling: with a reading and with a sense number from either."""
    x, y = base_of(a), base_of(b)
    base = F.when(y.contains("/") & ~x.contains("/"), y).otherwise(x)
    sense = F.greatest(F.substr(a, F.length(x) + 1), F.substr(b, F.length(y) + 1))
    return F.concat(base, sense)
