"""Duplicates hidden by formatting differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import HOT_PARTS, filled

#: Blanks and punctuation: what is no letter of a record. Fixed values.
FORMATTING = r"[\s\u001c-\u001f\u0085\p{Z}\p{P}$+<=>^`|~＄＋＜＝＞＾｀｜～]+"
#: Buckets of the first count. Its result has at most so many rows.
BUCKETS = 65_536
#: Tasks among which a hot key's rows are spread.
SALTS = 64


def canonical(c: str | Column) -> Column:
    """A text without blanks and punctuation, in lower case. Null stays null."""
    return F.lower(F.regexp_replace(c, FORMATTING, ""))


def canonical_groups(rows: DataFrame, keys: list[str], identifier: str) -> DataFrame:
    """(keys..., first_id, n_copies) for every distinct key.

    Hot keys are found exactly by partial counts: records are counted by 65,536 hash buckets, then by key inside the
    buckets with more than one part in 256 of the records; only these can hold a key with as many. Hot keys, at most 256, are
    broadcast and their records aggregated in two levels, salted first; all others take a one-level shuffle.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    counted = [(r["bucket"], r["n"]) for r in rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()]  # at most BUCKETS rows
    total = sum(n for _, n in counted)
    full = [b for b, n in counted if n * HOT_PARTS > total]  # at most HOT_PARTS
    least_and_count = (F.min(identifier).alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    if not full:
        return rows.groupBy(*keys).agg(*least_and_count)
    suspects = rows.filter(bucket.isin(full)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(suspects.filter(F.col("n") * HOT_PARTS > total).drop("n"))
    salted = rows.join(hot, keys).groupBy(*keys, F.pmod(F.xxhash64(identifier), F.lit(SALTS)).alias("salt")).agg(*least_and_count)
    first = salted.groupBy(*keys).agg(F.min("first_id").alias("first_id"), F.sum("n_copies").alias("n_copies"))
    return rows.join(hot, keys, "left_anti").groupBy(*keys).agg(*least_and_count).unionByName(first)


def collapse_records(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(first_id, n_copies): one row for every record, whatever its writing, with the smallest key and the number of copies.

    Two rows are copies if their two fields agree, in this or the other order, apart from blanks, letter case and
    punctuation; the border between the fields counts. Rows with a null or empty field are left out. A field of nothing but
    blanks and punctuation agrees with another such field. An empty table gives no rows. Other columns are ignored.
    """
    a, b = canonical(left), canonical(right)
    rows = pairs.filter(filled(left) & filled(right)).select(F.col(key).alias("id"), F.least(a, b).alias("k1"), F.greatest(a, b).alias("k2"))
    return canonical_groups(rows, ["k1", "k2"], "id").select("first_id", "n_copies")


def hidden_duplicates(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """The records of :func:`collapse_records` with two or more copies."""
    return collapse_records(pairs, key, left, right).filter("n_copies > 1")
