"""Loading of delimited lines with the bad ones set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field: enclosed as a whole in double quotes, doubled inside, or without any.
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^\t"]*+)'
LINE = rf"(?s)\A{FIELD}(?:\t{FIELD})*+\z"
EACH = rf"(?s)\t({FIELD})"
WORD_ID = r"(?s)\A.+:([0-9]+)/([0-9]+)\z"


def _fields() -> Column:
    """The fields of a well-formed line, null for any other. Lines without quotation marks are just cut."""

    def value(raw: Column) -> Column:
        return F.when(raw.startswith('"'), F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)

    raw = F.col("raw")
    quoted = F.when(raw.rlike(LINE), F.transform(F.regexp_extract_all(F.concat(F.lit("\t"), raw), F.lit(EACH), F.lit(1)), value))
    return F.when(raw.contains('"'), quoted).otherwise(F.split(raw, "\t"))


def _not_above(a: Column, b: Column) -> Column:
    """For digit strings of any length without leading zeros: a <= b."""
    return (F.length(a) < F.length(b)) | ((F.length(a) == F.length(b)) & (a <= b))


def _parsed(lines: DataFrame, offset: str, raw: str) -> DataFrame:
    df = lines.select(F.col(offset).alias("offset"), F.col(raw).alias("raw"))
    df = df.withColumn("fields", _fields()).withColumn("three", F.coalesce(F.size("fields") == 3, F.lit(False)))
    df = df.withColumns({n: F.when(F.col("three"), F.col("fields")[k]) for k, n in enumerate(("word_id", "sense_text", "sense_type"))})
    df = df.withColumn("has_id", F.col("word_id").rlike(WORD_ID))
    m, n = (F.when(F.col("has_id"), F.regexp_replace(F.regexp_extract("word_id", WORD_ID, k), "^0+", "")) for k in (1, 2))
    return df.withColumns({"m": m, "n": n})


def _sense_fits() -> Column:
    return (F.col("m") != "") & _not_above(F.col("m"), F.col("n"))


def load_valid(lines: DataFrame, offset: str, raw: str) -> DataFrame:
    """The strict load: only lines of three well-formed fields, as (offset, word_id, sense_text, sense_type)."""
    good = F.col("three") & F.col("has_id") & _sense_fits() & F.col("sense_type").isin("isa", "synonym") & (F.col("sense_text") != "")
    return _parsed(lines, offset, raw).filter(good).select("offset", "word_id", "sense_text", "sense_type")


def rejected(lines: DataFrame, offset: str, raw: str) -> DataFrame:
    """One row (offset, reason) for every line that the strict load doesn't take.

    Strict load plus anti-join: the offsets that loaded are subtracted from all offsets, and only the remainder is
    diagnosed. The first that applies of: quote, columns, word_id, sense, sense_type, empty. A null line has no fields, so
    it is ``columns``, as is an empty one. An offset that stands twice is taken to be one record; null
    offsets can't be subtracted, and their lines are diagnosed all the same. Nothing is lost: the
    offsets loaded and rejected together are all offsets.
    """
    good = load_valid(lines, offset, raw).select("offset")
    rest = lines.select(F.col(offset).alias("offset"), F.col(raw).alias("raw")).join(good, "offset", "left_anti")
    reason = (
        F.when(F.col("raw").isNotNull() & F.col("fields").isNull(), "quote")
        .when(~F.col("three"), "columns")
        .when(~F.col("has_id"), "word_id")
        .when(~_sense_fits(), "sense")
        .when(~F.col("sense_type").isin("isa", "synonym"), "sense_type")
        .when(F.col("sense_text") == "", "empty")
    )
    return _parsed(rest, "offset", "raw").select("offset", reason.alias("reason")).filter("reason is not null")
