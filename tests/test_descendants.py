from collections import Counter

import duckdb

import __spark_entry__


def test_descendants_by_name_and_their_counts(spark, data):
    rows = [tuple(r) for r in __spark_entry__.queries()["p2_pairs"](spark, data).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW isa AS SELECT * FROM '{data}/isa.parquet'")
    assert Counter(rows) == Counter(con.sql(__spark_entry__.oracle_sql()["p2_pairs"]).fetchall())
    n = Counter(r[0] for r in rows)
    assert {r["ancestor"]: r["n_descendants"] for r in __spark_entry__.queries()["p2_descendants"](spark, data).collect()} == n
