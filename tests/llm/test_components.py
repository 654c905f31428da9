import random
from collections import defaultdict

from tsumugi.llm import components
from tsumugi.llm.components import consolidate


def by_union(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, a, b in rows:
        for w in (a, b):
            if w:
                up[find(("w", w))] = find(("r", i))
        find(("r", i))
    least = defaultdict(lambda: 1 << 62)
    for i, _, _ in rows:
        least[find(("r", i))] = min(least[find(("r", i))], i)
    return {i: least[find(("r", i))] for i, _, _ in rows}


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "id bigint, l string, r string")
    for name, value in more.items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    out = consolidate(df, "id", "l", "r").collect()
    assert len(out) == len(rows)
    return {x["id"]: x["group_id"] for x in out}


def test_chains_hubs_loops_and_holes(spark):
    rows = [(10 + k, f"c{k}", f"c{k + 1}") for k in range(60)]  # a long chain
    rows += [(200 + k, "hub", f"h{k}") for k in range(80)]
    rows += [(400, "x", "x"), (401, "x", None), (402, None, "y"), (403, "", "y"), (404, None, None), (405, "", ""), (406, "z", "z")]
    rows += [(500, "a", "b"), (501, "b", "a"), (502, "a", "b"), (3, "h7", "c9"), (600, "A", "q"), (601, "a ", "q2"), (602, " ", " "), (603, " ", "k" * 100_000)]
    assert run(spark, rows, u="clash", own=1, n=2, a=3) == by_union(rows)


def test_random_graphs(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        words = [None, "", *(f"w{k}" for k in range(400))]
        rows = [(k, r.choice(words), r.choice(words)) for k in r.sample(range(10_000), 380)]
        assert run(spark, rows) == by_union(rows)


def test_clashing_hashes_start_anew(spark, monkeypatch):
    calls = []
    real = components.F.xxhash64

    def weak(*cols):  # first seed: every word of one length clashes in the first hash
        h = real(*cols)
        name = str(cols[0])
        if name == "Column<'0'>":
            calls.append(1)
            return components.F.length(cols[1]).cast("long")
        return h

    monkeypatch.setattr(components.F, "xxhash64", weak)
    rows = [(1, "a", "b"), (2, "c", "d"), (3, "b", "e")]
    assert run(spark, rows) == {1: 1, 2: 2, 3: 1}
    assert calls


def test_empty(spark):
    assert run(spark, []) == {}


def test_table(spark, data):
    df = spark.read.parquet(f"{data}/synonym_web_news.parquet")
    rows = [tuple(x) for x in df.select("pair_id", "word1", "word2").collect()]
    assert {x["pair_id"]: x["group_id"] for x in consolidate(df, "pair_id", "word1", "word2").collect()} == by_union(rows)
