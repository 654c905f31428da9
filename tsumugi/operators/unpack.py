"""Several values packed in one field, split with their position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import Scratch, lookup

#: The separators, by the name of the candidate, as bodies of character classes.
CANDIDATES = {
    "blank": r"\s\u001c-\u001f\u0085\p{Z}",
    "comma": r",，、､﹐﹑",
    "semicolon": r";；﹔",
    "bar": r"|｜¦￤",
}
ALL = "".join(CANDIDATES.values())
#: Opening and closing quotation marks.
STRAIGHT = "\"'＂＇"
PAIRS = ("“”", "‘’", "「」", "『』", "｢｣", "〝〟", "〝〞", "«»", "‹›", "„“", "《》")
_END = rf"(?=[{ALL}]|\z)"
_STRAIGHT = "|".join(rf"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}" for q in STRAIGHT)
_PAIRED = "|".join(rf"{o}[^{c}]*+{c}" for o, c in PAIRS)
QUOTED = rf"(?:{_STRAIGHT}|{_PAIRED})"
TOKEN = rf"(?s){QUOTED}{_END}|[^{ALL}]++"
ANY_QUOTE = "[" + STRAIGHT + "".join(sorted({c for p in PAIRS for c in p})) + "]"
#: What a regular piece looks like: one script and marks inside a word, an optional reading and an optional sense number.
REGULAR = r"\A(?:[\p{IsHan}々ー]+|[\p{IsHan}々\p{IsHiragana}\p{IsKatakana}ー・]+|[\p{IsLatin}\p{M}'’-]+)(?:/\p{IsHiragana}+)?(?::[0-9/:]+)?\z"


def infer_delimiters(df: DataFrame, source: str, packed: str) -> DataFrame:
    """For each source the candidate that separates it best: (source, delimiter, score). See :func:`profile_sources`."""
    return profile_sources(df, source, packed).filter("delimiter is not null").select("source", "delimiter", "score")


def profile_sources(df: DataFrame, source: str, packed: str) -> DataFrame:
    """(source, lines, delimiter, score): each source's number of lines and the candidate that separates it best, null if none does.

    A candidate's score is the product of the share of the source's lines it cuts, the consistency of the number of pieces
    among those lines (1 / (1 + deviation / mean)) and the share of pieces that look like one value. Counting combines before
    the shuffle, so a source may hold any share of the rows.
    """
    lines = df.filter(F.col(packed).isNotNull()).select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(packed).alias("line"))
    each = []
    for name, body in CANDIDATES.items():
        pieces = F.filter(F.split("line", f"[{body}]+"), lambda x: x != "")
        each.append(
            F.struct(
                F.lit(name).alias("delimiter"),
                F.size(pieces).cast("double").alias("n"),
                F.size(F.filter(pieces, lambda x: x.rlike(REGULAR))).cast("double").alias("regular"),
            )
        )
    per = lines.select("source", F.explode(F.array(*each)).alias("c")).select("source", "c.*")
    cut = F.col("n") > 1
    stats = per.groupBy("source", "delimiter").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.when(cut, 1).otherwise(0)).alias("cut"),
        F.avg(F.when(cut, F.col("n"))).alias("mean"),
        F.stddev_pop(F.when(cut, F.col("n"))).alias("dev"),
        F.sum(F.when(cut, F.col("n"))).alias("pieces"),
        F.sum(F.when(cut, F.col("regular"))).alias("regular"),
    )
    score = F.round(F.col("cut") / F.col("lines") / (1 + F.col("dev") / F.col("mean")) * F.col("regular") / F.col("pieces"), 6)
    best = F.min(F.when(F.col("cut") > 0, F.struct((-score).alias("minus"), "delimiter"))).alias("best")
    return stats.groupBy("source").agg(F.max("lines").alias("lines"), best).select("source", "lines", "best.delimiter", (-F.col("best.minus")).alias("score"))


def _unquoted(token: Column) -> Column:
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    out = F.when(token.rlike(rf"(?s)\A(?:{_PAIRED})\z"), inner)
    for q in STRAIGHT:
        out = out.when(token.rlike(rf"(?s)\A{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}\z"), F.replace(inner, F.lit(q + q), F.lit(q)))
    return out.otherwise(token)


def unpack(df: DataFrame, key: str, packed: str, source: str) -> DataFrame:
    """One row (key, pos, value) for each value of a packed field; pos counts from 1 without gaps.

    The delimiter of each source is inferred first. A line without quotation marks whose only separators are that delimiter
    and blanks around is cut at it; every other line goes through the full grammar: all separators cut, alone or together,
    and a value enclosed as a whole in quotation marks keeps separators inside. Both ways agree on the lines of the first
    kind. Null, empty and blank fields give no rows; an unclosed quotation mark, or one followed by more text, belongs to its
    word; very long fields are cut like short ones. Rows with the same key are cut each for itself.
    """
    best = Scratch(df.sparkSession, "sources").write(profile_sources(df, source, packed).select("source", "delimiter", "lines"), "sources")
    total = best.agg(F.sum("lines")).first()[0] or 0
    lines = df.filter(F.col(packed).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(packed).alias("line"))
    lines = lookup(lines, best, "source", "lines", total, apart=True)
    plain = F.when(F.col("line").rlike(ANY_QUOTE), F.lit(None))
    for name, body in CANDIDATES.items():
        others = "".join(b for n, b in CANDIDATES.items() if n not in (name, "blank"))
        if name == "blank":
            alone = ~F.col("line").rlike(f"[{others}]")
        else:  # blanks only beside the delimiter or at the ends
            b = CANDIDATES["blank"]
            alone = ~F.col("line").rlike(f"[{others}]") & ~F.col("line").rlike(rf"[^{b}{body}][{b}]+[^{b}{body}]")
        plain = plain.when((F.col("delimiter") == name) & alone, F.split("line", rf"[{body}{CANDIDATES['blank']}]+"))
    full = F.transform(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0)), _unquoted)
    values = F.filter(F.coalesce(plain, full), lambda x: x != "")
    return lines.select("key", F.posexplode(values).alias("pos", "value")).select("key", (F.col("pos") + 1).alias("pos"), "value")
