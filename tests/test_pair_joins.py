"""Pairs of groups outgrow the bytes of the groups' lines: they are never broadcast."""

import re

import duckdb

import __spark_entry__
from tsumugi.functions.runtime import Scratch

QUERY = "q_distributional_similarity"


def test_distributional_similarity_sends_no_pairs_to_all(spark, data, monkeypatch):
    plans, write = [], Scratch.write

    def watched(self, df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", watched)
    out = __spark_entry__.queries()[QUERY](spark, data)
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert not re.search(r"Broadcast\w+Join \[[^]]*w[12]#", "\n".join(plans))
    con = duckdb.connect()
    for t in ("synonym", "synonym_web_news"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    whole = con.sql(__spark_entry__.oracle_sql()[QUERY].replace("HAVING count(*) <= 40", "")).fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(whole)
