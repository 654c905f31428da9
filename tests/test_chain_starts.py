import duckdb

import __spark_entry__


def test_chains_start_from_headwords_too(spark, data):
    con = duckdb.connect()
    for t in ("definition", "synonym_web_news"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    near = set(con.sql(__spark_entry__.oracle_sql()["q_synonym_chain"]).fetchall())
    found = [tuple(r) for r in __spark_entry__.queries()["q_synonym_chain"](spark, data).select("start", "word", "steps").collect()]
    assert near and near <= set(found)
    linked = con.sql("SELECT DISTINCT word1 FROM synonym_web_news WHERE pair_id % 20 = 0 AND word1 <> ''").fetchall()
    assert {s for (s,) in linked} <= {s for s, _, _ in found}
    assert len({(s, w) for s, w, _ in found}) == len(found)
