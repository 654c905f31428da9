"""From text or parser output to phrase trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import MAX_AMBIGUOUS
from ..functions.runtime import filled
from ..functions.strings import wide_upper

#: Words of a text: runs of Latin letters, of kanji or of katakana.
WORDS = "[a-zà-öø-ÿ]+|[一-鿿々]+|[ァ-ヺー]+"


def words(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def chain_trees(rows: DataFrame, sid: str, tokens: Column) -> DataFrame:
    """(sid, bp, id, parentbp, childbp) of head-final chains: each word depends on the next one, the last is the head.

    Null and empty texts have no phrases.
    """
    t = rows.select(F.col(sid).alias("sid"), tokens.alias("t")).filter(F.size("t") > 0)
    p = t.select("sid", F.size("t").alias("n"), F.posexplode("t").alias("bp", "id"))
    parent = F.when(F.col("bp") + 1 < F.col("n"), F.col("bp") + 1).otherwise(-1)
    none = F.array().cast("array<int>")
    return p.select("sid", "bp", "id", parent.alias("parentbp"), F.when(F.col("bp") > 0, F.array(F.col("bp") - 1)).otherwise(none).alias("childbp"))


def parse_records(lines: DataFrame) -> DataFrame:
    """Morphemes of parser output. lines: (record, text), one row a record up to its ``EOS``.

    Line kinds are taken from their first character: ``#`` a comment with the sentence id, ``*`` a clause, ``+`` a phrase with its parent and
    kind, all others morphemes. (sid, line, kind, bp, parentbp, dpndtype, text)
    """
    each = lines.select("record", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter("text <> '' AND text <> 'EOS'")
    kind = F.when(F.col("text").startswith("# "), "comment").when(F.col("text").rlike(r"^\* "), "clause").when(F.col("text").rlike(r"^\+ "), "phrase").otherwise("morpheme")
    w = Window.partitionBy("record").orderBy("line")
    df = each.withColumn("kind", kind).withColumn("bp", F.sum(F.when(F.col("kind") == "phrase", 1).otherwise(0)).over(w) - 1)
    sid = F.max(F.when(F.col("kind") == "comment", F.regexp_extract("text", r"S-ID:(\S+)", 1))).over(Window.partitionBy("record"))
    head = r"^\+ (-?[0-9]+)([A-Z])"
    phrase = F.col("kind") == "phrase"
    return df.select(
        F.coalesce(sid, F.col("record").cast("string")).alias("sid"), "line", "kind", F.col("bp").cast("int").alias("bp"),
        F.when(phrase, F.regexp_extract("text", head, 1).try_cast("int")).alias("parentbp"), F.when(phrase, F.regexp_extract("text", head, 2)).alias("dpndtype"), "text",
    )


def article_of(sid: Column) -> Column:
    """The article a sentence id belongs to."""
    return F.when(sid.rlike(r"-\d+$"), F.regexp_extract(sid, r"^(.+)-\d+$", 1)).otherwise(sid)


def lemma(features: Column, base: Column) -> Column:
    """A morpheme's name: of a potential verb, else of an honorific verb, else the representative, else the likely one, else the base form."""

    def value(name: str) -> Column:
        found = F.regexp_extract(features, f"<{name}:([^>]+)>", 1)
        return F.when(found != "", found)

    return F.coalesce(value("可能動詞"), value("尊敬動詞"), value("代表表記"), value("疑似代表表記"), wide_upper(base))


def keywords(parsed: DataFrame) -> DataFrame:
    """(sid, bp, id, parentbp, childbp, midasi, fuzoku, features...) of parsed records: content words, function words and flags of each phrase.

    Function words stand behind the content words; a phrase of none keeps an empty name. Only the first of several voices counts.
    """
    m = parsed.filter("kind = 'morpheme'").withColumn("f", F.split("text", " "))
    content = F.col("text").contains("<内容語>")
    m = m.select("sid", "bp", "line", F.element_at("f", 1).alias("surface"), F.element_at("f", 3).alias("base"), "text", content.alias("content"))
    m = m.withColumn("name", lemma(F.col("text"), F.col("base")))
    agg = m.groupBy("sid", "bp").agg(F.sort_array(F.collect_list(F.struct("line", "surface", "name", "content"))).alias("ms"))

    def joined(field: str, of: Column, sep: str) -> Column:
        return F.array_join(F.transform(of, lambda x: x[field]), sep)

    own, rest = F.filter("ms", lambda x: x["content"]), F.filter("ms", lambda x: ~x["content"])
    p = parsed.filter("kind = 'phrase'").select("sid", "bp", "parentbp", "dpndtype", "text")
    voice = F.regexp_extract("text", "<態:([^|>]+)", 1)
    flags = p.select(
        "sid", "bp", "parentbp", "dpndtype", F.col("text").contains("<可能表現>").alias("kanou"),
        F.col("text").contains("<敬語:尊敬表現>").alias("sonnkei"), (voice == "受動").alias("ukemi"), (voice == "使役").alias("shieki"), F.col("text").contains("<否定表現>").alias("negation"),
    )
    found = p.select("sid", F.explode(cases(F.col("text"))).alias("c")).groupBy("sid", F.col("c.childbp").alias("bp")).agg(F.min("c.case").alias("case"))
    flags = flags.join(found, ["sid", "bp"], "left")
    kids = p.filter("parentbp >= 0").groupBy("sid", F.col("parentbp").alias("bp")).agg(F.sort_array(F.collect_list(F.col("bp"))).alias("childbp"))
    named = agg.select("sid", "bp", joined("name", own, "+").alias("id"), joined("surface", F.col("ms"), "").alias("midasi"), joined("surface", rest, "").alias("fuzoku"))
    return flags.join(named, ["sid", "bp"], "left").join(kids, ["sid", "bp"], "left").withColumn("childbp", F.coalesce("childbp", F.array().cast("array<int>")))


def alternatives(options: Column) -> Column:
    """All names of a phrase from the readings of its morphemes (an array of arrays), joined by ``+``.

    A phrase with MAX_AMBIGUOUS or more ambiguous morphemes keeps the first reading of each.
    """
    ambiguous = F.size(F.filter(options, lambda o: F.size(o) > 1))
    first = F.transform(options, lambda o: F.slice(o, 1, 1))
    used = F.when(ambiguous < MAX_AMBIGUOUS, options).otherwise(first)
    start = F.array(F.lit("")).cast("array<string>")
    return F.aggregate(
        used, start, lambda done, o: F.flatten(F.transform(done, lambda d: F.transform(o, lambda x: F.when(d == "", x).otherwise(F.concat(d, F.lit("+"), x)))))
    )


def generalise_numbers(name: Column) -> Column:
    """A name with its numerals as ``<num>``."""
    return F.regexp_replace(name, "[0-9０-９〇一二三四五六七八九十百千万億]+(?:/[^+]*)?", "<num>")


def cases(parsed_phrase: Column) -> Column:
    """(case, child phrase) pairs of a case analysis ``<格解析結果:verb:frame:ガ/C/word/bp/...;ヲ/...>``; N is what the phrase itself modifies."""
    body = F.regexp_extract(parsed_phrase, "<格解析結果:[^:>]+:[^:>]+:([^>]+)>", 1)
    each = F.filter(F.split(body, ";"), lambda x: x.rlike("^[^/]+/[^UN/][^/]*/[^/]*/[0-9]+"))
    return F.transform(each, lambda x: F.struct(F.split_part(x, F.lit("/"), F.lit(1)).alias("case"), F.split_part(x, F.lit("/"), F.lit(4)).try_cast("int").alias("childbp")))


def virtual_edges(phrases: DataFrame) -> DataFrame:
    """Phrases with one more child: a nominalised verb of one morpheme right after a phrase in the case ノ takes that as its child."""
    w = Window.partitionBy("sid").orderBy("bp")
    before = F.lag("case").over(w)
    add = F.col("nominal") & (F.col("n_morphemes") == 1) & (before == "ノ")
    return phrases.withColumn("childbp", F.when(add, F.array_sort(F.array_union("childbp", F.array(F.col("bp") - 1)))).otherwise(F.col("childbp")))


def without_semi_content(morphemes: DataFrame) -> DataFrame:
    """(sid, bp, id, score): names of phrases, and those without their semi-content words at a lower score. morphemes: (sid, bp, i, name, semi)."""
    g = morphemes.filter(filled("name")).groupBy("sid", "bp").agg(F.sort_array(F.collect_list(F.struct("i", "name", "semi"))).alias("m"))
    full, short = (F.array_join(F.transform(F.filter("m", f), lambda x: x["name"]), "+") for f in (lambda x: F.lit(True), lambda x: ~x["semi"]))
    both = F.when((short != "") & (short != full), F.array(F.struct(full.alias("id"), F.lit(1.0).alias("score")), F.struct(short.alias("id"), F.lit(0.8).alias("score")))).otherwise(
        F.array(F.struct(full.alias("id"), F.lit(1.0).alias("score")))
    )
    return g.select("sid", "bp", F.explode(both).alias("x")).select("sid", "bp", "x.id", "x.score")


def listed_alternatives(features: Column, disambiguated: Column) -> Column:
    """Other lemmas a morpheme's features list: other readings (unless it was disambiguated), synonyms and what it derives from."""
    readings = F.transform(F.regexp_extract_all(features, F.lit("<ALT-([^-]+-[^-]+-[^-]+)-"), F.lit(1)), lambda x: F.concat(F.split_part(x, F.lit("-"), F.lit(3)), F.lit("/"), F.split_part(x, F.lit("-"), F.lit(2))))
    others = F.regexp_extract_all(features, F.lit("(?:同義|派生):(?:[^:>; ]+:)?([^:>; ]+)"), F.lit(1))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.when(disambiguated, none).otherwise(readings), others))


def adjective_stem(name: Column, kind: Column) -> Column:
    """The stem of an i-adjective as a name of its own, null for other words."""
    written, read = F.split_part(name, F.lit("/"), F.lit(1)), F.split_part(name, F.lit("/"), F.lit(2))
    stem = F.concat(F.regexp_replace(written, "い$", ""), F.lit("/"), F.regexp_replace(read, "い$", ""))
    return F.when(kind.startswith("イ形容詞") & name.rlike("い/.*い$"), stem)


def case_phrases(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, word, case): nouns with the case particle right behind them, in order."""
    pattern = "([一-鿿々ァ-ヺーA-Za-zÀ-ÿ]+)(を|に|で|が|と)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("word"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("case"))
    p = rows.filter(text.isNotNull()).select(F.col(key), F.posexplode(pairs).alias("pos", "z"))
    return p.select(key, "pos", F.col("z.word").alias("word"), F.col("z.case").alias("case"))
