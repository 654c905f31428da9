"""How far one sentence's concepts are covered by another's: exact ranking, its evaluation mode, and the explanation of a match.

What a phrase can stand for in the other sentence is met by joins and weighed by columns: every node of a sentence keeps the one counterpart
that weighs most. What is left for a pair is one pass over its phrases, dependents before heads, on Arrow columns; nothing is
recursive, and a text of n words takes n steps. Plain word chains, which have nothing to settle, are scored by joins alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import DEPENDENCY_WEIGHT, PENALTY
from ..functions.runtime import ship

#: What decides how much a counterpart weighs; nodes of one sentence that agree in these and in their id are alike.
LOOK = ["score", "relation", "antonym", "case", "kanou", "sonnkei", "ukemi", "shieki", "negation"]
#: Differences that something else in the sentence can explain, and the columns that tell of them.
OPEN = {"case": "by_case", "ukemi": "by_passive", "shieki": "by_causative", "negation": "by_sign"}
STEP = (
    "struct<bp:int,rank:double,id:string,weight:double,clause:boolean,kids:array<int>,covers:array<int>,met:boolean,kept:double,risked:double,single:double,sibling:boolean,"
    "by_case:boolean,by_passive:boolean,by_causative:boolean,by_sign:boolean,kind:string,seat:int,seat_kids:array<int>,seat_covers:array<int>>"
)
WHY = "array<struct<one:array<int>,two:array<int>,kind:string>>"


def counterparts(nodes: DataFrame) -> DataFrame:
    """(sid, id, look, often, seat): what a sentence offers for an id; nodes alike are one, seated at the first phrase they stand at."""
    seat = F.min(F.struct("bp", "childbp", "matchbp")).alias("seat")
    alike = nodes.groupBy("sid", "id", F.struct(*LOOK).alias("look")).agg(F.count(F.lit(1)).alias("n"), seat)
    often = F.sum("n").over(Window.partitionBy("sid", "id"))
    return alike.select("sid", "id", "look", often.cast("double").alias("often"), "seat")


def _weighed(boost: Column | None) -> dict[str, Column]:
    """What the node ``own`` is worth with the counterpart ``look``, kept and at risk, and which differences put it at risk.

    Two hypernyms are siblings and worth nothing. Potential and honorific forms cost for good; case, voice and polarity cost unless
    something else in the sentence explains them.
    """
    a, b = lambda f: F.col(f"own.{f}"), lambda f: F.col(f"look.{f}")
    sibling = F.coalesce(a("relation") & b("relation"), F.lit(False))
    apart = {f: F.coalesce(~sibling & (a(f) != b(f)), F.lit(False)) for f in ("kanou", "sonnkei", "ukemi", "shieki")}
    apart["case"] = F.coalesce(~sibling & (a("case") != "") & (b("case") != "") & (a("case") != b("case")), F.lit(False))
    signs = sum((s.cast("int") for s in (a("negation"), b("negation"), a("antonym"), b("antonym"))), F.lit(0))
    apart["negation"] = F.coalesce(~sibling & (signs % 2 == 1), F.lit(False))

    def costs(value: Column, names: tuple | dict) -> Column:
        for n in names:
            value = value * F.when(apart[n], PENALTY[n]).otherwise(1.0)
        return value

    single = F.when(sibling, 0.0).otherwise(F.coalesce(a("score") * a("weight") * b("score") * (F.lit(1.0) if boost is None else boost), F.lit(0.0)))
    kept = costs(single if boost is None else single * F.coalesce("often", F.lit(0.0)), ("kanou", "sonnkei"))
    kind = F.when(a("relation") | b("relation"), "isa").when(a("antonym") | b("antonym"), "antonym").otherwise("syn")
    return {"met": F.col("seat").isNotNull(), "kept": kept, "risked": costs(kept, OPEN), "single": single, "sibling": sibling, **{c: apart[f] for f, c in OPEN.items()}, "kind": kind}


def matched_nodes(pairs: DataFrame, nodes: DataFrame, others: DataFrame, clauses: DataFrame | None = None) -> DataFrame:
    """(a, b, steps): the nodes of sentence ``a`` in the order of phrases, each with what it weighs in sentence ``b``.

    pairs: (a, b), once each; nodes are of ``a``; others, by :func:`counterparts`, of ``b``. With a column ``boost`` in others a counterpart's value is
    multiplied by it and by how often the sentence has the id. Of several counterparts the one that keeps most counts, then the one with
    least at risk, then the first. clauses: (sid, bp) of phrases that are clauses of their own.
    """
    own = nodes.filter("id is not null").select(F.col("sid").alias("a"), "bp", "id", F.struct(*LOOK, "weight", "childbp", "matchbp").alias("own"))
    if clauses is None:
        own = own.withColumn("clause", F.lit(False))
    else:
        marked = clauses.select(F.col("sid").alias("a"), "bp").distinct().withColumn("clause", F.lit(True))
        own = own.join(marked, ["a", "bp"], "left").withColumn("clause", F.coalesce("clause", F.lit(False)))
    met = pairs.join(own, "a").join(others.withColumnRenamed("sid", "b"), ["b", "id"], "left")
    worth = _weighed(F.col("boost") if "boost" in others.columns else None)
    met = met.select("a", "b", "bp", "id", "own", "clause", "seat", F.struct(*[c.alias(n) for n, c in worth.items()]).alias("w"))
    best = met.groupBy("a", "b", "bp", "id", "own", "clause").agg(F.max(F.struct("w.kept", "w.risked", (-F.col("seat.bp")).alias("early"), "w", "seat")).alias("m"))
    values = {n: F.col(f"m.w.{n}") for n in worth}
    step = {"bp": F.col("bp"), "rank": -F.col("own.score"), "id": F.col("id"), "weight": F.col("own.weight"), "clause": F.col("clause"), "kids": F.col("own.childbp"), "covers": F.col("own.matchbp")}
    step |= values | {"seat": F.coalesce("m.seat.bp", F.lit(-1)), "seat_kids": F.col("m.seat.childbp"), "seat_covers": F.col("m.seat.matchbp")}
    rows = best.select("a", "b", F.struct(*[c.alias(n) for n, c in step.items()]).cast(STEP).alias("s"))
    return rows.groupBy("a", "b").agg(F.sort_array(F.collect_list("s")).alias("steps"))


def _settled(s: dict[str, list], first: int, end: int) -> dict[int, tuple]:
    """Of each phrase among the steps first to end: (kept, risked, cases, turned, passive, step), all below it included.

    A clause of its own is settled before it counts above. Two case differences below explain a turned comparison or a passive, one
    explains a causative. Of a phrase's nodes the one that keeps most counts, then the one of the higher score.
    """
    done: dict[int, tuple] = {}
    clause_of = dict(zip(s["bp"][first:end], s["clause"][first:end]))
    for k in range(first, end):
        kept, risked, cases, turned = s["kept"][k], s["risked"][k], int(s["by_case"][k]), s["by_sign"][k]
        passive = s["by_passive"][k]
        below = [(c, done[c]) for c in s["kids"][k] or () if c in done and c != s["bp"][k]]
        for c, (keep, risk, n, sign, _, _) in below:
            cases += n
            if clause_of[c]:
                keep = risk = risk if sign else keep
            else:
                turned = turned != sign
            kept, risked = kept + keep, risked + risk
        if below and s["met"][k]:
            if cases == 2 and (s["by_sign"][k] or passive):
                cases = 0
                if s["by_sign"][k]:
                    turned = not turned
                else:
                    passive = False
            elif cases == 1 and s["by_causative"][k]:
                cases = 0
        bp = s["bp"][k]
        if bp not in done or kept > done[bp][0]:
            done[bp] = (kept, risked, cases, turned, passive, k)
    return done


def _score(s: dict[str, list], first: int, end: int, evaluation: bool) -> tuple[float, list]:
    """What a pair's steps come to from the head down, and why."""
    done = _settled(s, first, end)
    root = s["bp"][end - 1]
    kept, risked, cases, turned, passive, top = done[root]
    spoilt = turned or (s["met"][top] and (cases > 0 or passive))
    weight, dependencies, hits, why = 0.0, 0.0, 0.0, []
    # phrase, the step above it, and whether the clause it lies in keeps dependencies (True) or loses them (None); outside clauses (False) the head decides
    walk = [(root, None, False)]
    seen = set()
    while walk:
        bp, above, held = walk.pop()
        if bp in seen:
            continue
        seen.add(bp)
        k = done[bp][5]
        if above is not None and s["clause"][k]:
            held = None if done[bp][3] else True
        weight += s["weight"][k]
        if above is not None and s["weight"][k] and (s["weight"][above] or not s["met"][above]):
            dependencies += 1
            if s["met"][k] and s["met"][above] and not s["sibling"][k] and s["weight"][above] and s["seat"][k] in (s["seat_kids"][above] or ()):
                if held or (held is False and not spoilt):
                    hits += s["single"][k] + s["single"][above] if evaluation else 1.0
        if s["met"][k]:
            why.append({"one": sorted({bp, *(s["covers"][k] or ())}), "two": sorted({s["seat"][k], *(s["seat_covers"][k] or ())}), "kind": s["kind"][k]})
        walk += [(c, k, held) for c in s["kids"][k] or () if c in done]
    value = (risked if spoilt else kept) + DEPENDENCY_WEIGHT * hits
    total = 1.0 if evaluation else weight + DEPENDENCY_WEIGHT * dependencies
    return (value / total if total else 0.0), sorted(why, key=lambda w: w["one"])


def covered(pairs: DataFrame, nodes: DataFrame, others: DataFrame, clauses: DataFrame | None = None, evaluation: bool = False) -> DataFrame:
    """(a, b, score, why): how far sentence ``a`` is covered by ``b``; arguments as for :func:`matched_nodes`.

    With ``evaluation`` the score isn't normalised, and a dependency that is kept counts what its two ends do. why has, for each phrase that is matched, its
    phrases, those it stands for, and whether as ``syn``, ``isa`` or ``antonym``. Pairs whose ``a`` has no node have no row.
    """
    ship(pairs.sparkSession)
    steps = matched_nodes(pairs, nodes, others, clauses)
    kinds = [steps.schema[c].dataType.simpleString() for c in ("a", "b")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten(), lists.offsets.to_pylist()
            s = {f.name: flat.field(f.name).to_pylist() for f in flat.type}
            base, scores, why = ends[0], [], []
            for i in range(batch.num_rows):
                score, because = _score(s, ends[i] - base, ends[i + 1] - base, evaluation)
                scores.append(score)
                why.append(because)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(why, _WHY)], ["a", "b", "score", "why"])

    return steps.mapInArrow(work, f"a {kinds[0]}, b {kinds[1]}, score double, why {WHY}")


_WHY = pa.list_(pa.struct([("one", pa.list_(pa.int32())), ("two", pa.list_(pa.int32())), ("kind", pa.string())]))


def exact_scores(pairs: DataFrame, queries: DataFrame, targets: DataFrame, clauses: DataFrame | None = None) -> DataFrame:
    """(a, b, score, why): coverage of the query ``a`` by the target ``b`` times that of the target by the query.

    pairs: (a, b); queries and targets: nodes of annotated sentences. Repeated pairs count once. Pairs without a common concept, or with a sentence
    that has no nodes, score 0 and have no row.
    """
    once = pairs.select("a", "b").distinct()
    there = covered(once, queries, counterparts(targets), clauses).filter("score > 0")
    swapped = there.select(F.col("b").alias("a"), F.col("a").alias("b"))
    back = covered(swapped, targets, counterparts(queries), clauses).select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("score").alias("back"))
    return there.join(back, ["a", "b"]).filter("back > 0").select("a", "b", (F.col("score") * F.col("back")).alias("score"), "why")


def first_places(words: DataFrame) -> DataFrame:
    """(b, id, seat, often): where a chain's words stand first, and how often. words: (b, bp, id)."""
    return words.groupBy("b", "id").agg(F.min("bp").alias("seat"), F.count(F.lit(1)).cast("double").alias("often"))


def chain_coverage(pairs: DataFrame, words: DataFrame, places: DataFrame, evaluation: bool = False) -> DataFrame:
    """(a, b, score): :func:`covered` for word chains, of which each word depends on the next; by joins and one window.

    pairs: (a, b), once each; words: (a, bp, id); places: by :func:`first_places`, with a ``boost`` for ``evaluation``. Chains that
    share no word have a row of score 0.
    """
    met = pairs.join(words, "a").join(places, ["b", "id"], "left")
    per = Window.partitionBy("a", "b").orderBy("bp")
    worth = F.col("boost") if evaluation else F.lit(1.0)
    met = met.withColumn("value", F.when(F.col("seat").isNotNull(), worth).otherwise(0.0)).withColumns({"next": F.lead("seat").over(per), "beside": F.lead("value").over(per)})
    hit = F.when(F.col("seat") + 1 == F.col("next"), F.col("value") + F.col("beside") if evaluation else F.lit(1.0)).otherwise(0.0)
    many = F.coalesce("often", F.lit(0.0)) if evaluation else F.lit(1.0)
    total = met.groupBy("a", "b").agg(F.sum(F.col("value") * many).alias("kept"), F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    whole = F.lit(1.0) if evaluation else F.col("n") + DEPENDENCY_WEIGHT * (F.col("n") - 1)
    return total.select("a", "b", ((F.col("kept") + DEPENDENCY_WEIGHT * F.col("hits")) / whole).alias("score"))
