import unicodedata
from collections import defaultdict

from tsumugi.llm.collapse import collapse_records, hidden_duplicates


def bare(w):
    return "".join(c for c in w if not (c.isspace() or unicodedata.category(c)[0] in "PZ" or c in "$+<=>^`|~＄＋＜＝＞＾｀｜～")).lower()


def brute(rows):
    groups = defaultdict(list)
    for i, a, b in rows:
        if a and b:
            groups[tuple(sorted((bare(a), bare(b))))].append(i)
    return sorted((min(g), len(g)) for g in groups.values())


def run(spark, rows, f=collapse_records):
    df = spark.createDataFrame(rows, "id bigint, l string, r string").selectExpr("*", "1 AS k1", "2 AS salt", "3 AS n_copies")
    return sorted(tuple(x) for x in f(df, "id", "l", "r").collect())


ROWS = [
    (9, "Ab C", "d-e"), (4, "D.E", "abc"), (5, "ab", "cde"), (6, "abc ", "Ｄe"), (7, None, "x"), (8, "", "x"), (1, "カー", "b"), (2, "カ", "b"), (3, "カー。", "　B"),
    (10, "。", "z"), (11, " ", "Z!"), (12, "x y", "q"), (13, "y x", "q"), (14, "é", "q"), (15, "É", "q"), (16, "w" * 50_000, "v"), (17, "W" * 50_000 + "!", "V"),
]


def test_copies(spark):
    assert run(spark, ROWS) == brute(ROWS)
    assert run(spark, ROWS, hidden_duplicates) == [x for x in brute(ROWS) if x[1] > 1]


def test_a_hot_key_among_many(spark):
    rows = [(k, "Hot!" if k % 2 else " hot", "key") for k in range(100, 1100)] + [(k, f"w{k // 3}", "v") for k in range(2000, 5000)]
    assert run(spark, rows) == brute(rows)


def test_no_hot_key(spark):
    rows = [(k, f"w{k // 2}", "v") for k in range(3000)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
