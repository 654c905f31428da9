"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import filled


def key_statistics(df: DataFrame, key: str, member: str, number: str) -> DataFrame:
    """Rows, distinct members, sum and lower median of a number for every key, without any task holding a whole hot key.

    Eager aggregation through joins: the rows are first compacted into two states by the join key, (key, number) with its
    multiplicity and (key, member); sums and counts come from multiplicities (number x count), each state is rolled up to
    one row a key, and the rolled-up states are joined. Every aggregation combines before its shuffle, so what is moved for
    a hot key is its distinct values, spread over tasks by (key, value). The median is found by radix: the upper 16 bits of
    the values first, then the lower 16 bits inside the one bucket that holds it, so that no window is over more than 65,536
    rows a key.

    Null and empty keys give no row. Null numbers count as rows only; a key without numbers has null sum and median. Null
    and empty members don't count. An empty table gives no rows. Other columns of the input are ignored.
    """
    rows = df.select(F.col(key).alias("key"), F.col(member).alias("member"), F.col(number).cast("int").alias("num")).filter(filled("key"))
    values = rows.groupBy("key", "num").agg(F.count(F.lit(1)).alias("n"))
    totals = values.groupBy("key").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("num").isNotNull(), F.col("n"))).alias("n_values"),
        F.sum(F.col("num").cast("long") * F.col("n")).alias("num_sum"),
    )
    members = rows.filter(filled("member")).groupBy("key", "member").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count(F.lit(1)).alias("n_members"))

    known = values.filter(F.col("num").isNotNull()).withColumn("hi", F.shiftright("num", 16))
    upper = known.groupBy("key", "hi").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("key").orderBy("hi")
    seen = upper.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bucket = (
        seen.join(totals.select("key", "n_values"), "key")
        .filter((F.col("upto") * 2 >= F.col("n_values")) & ((F.col("upto") - F.col("n")) * 2 < F.col("n_values")))
        .select("key", "hi", "n_values", (F.col("upto") - F.col("n")).alias("below"))
    )
    low = Window.partitionBy("key").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    median = (
        known.join(bucket, ["key", "hi"])
        .withColumn("upto", F.col("below") + F.sum("n").over(low))
        .filter((F.col("upto") * 2 >= F.col("n_values")) & ((F.col("upto") - F.col("n")) * 2 < F.col("n_values")))
        .select("key", F.col("num").cast("long").alias("num_median"))
    )
    return (
        totals.join(members, "key", "left")
        .join(median, "key", "left")
        .select("key", "n_rows", F.coalesce("n_members", F.lit(0).cast("long")).alias("n_members"), "num_sum", "num_median")
    )
