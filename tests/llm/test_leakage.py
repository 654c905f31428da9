import random

from tsumugi.llm.leakage import ALPHABETIC, bare, build_index, find_leaks, scan, windows, without_leaks

R = random.Random(11)
JA = "".join(R.choice("言葉学校花鳥風月山川海空のはがをにと語句文章") for _ in range(160))
EN = " ".join("".join(R.choice("abcdefghilmnoprstu") for _ in range(R.randint(3, 9))) for _ in range(60))
NOISE = "".join(R.choice("あいうえお犬猫馬") for _ in range(400))
LEAD = "次の文を読んで問いに答えよ。"


def found(docs, items):
    index = build_index(list(enumerate(items)))
    return set(scan(list(range(len(docs))), docs, index))


def test_whole_and_partial():
    words = EN.split()
    changed = " ".join(w if k % 9 else "qqqqq" for k, w in enumerate(words))
    docs = [
        NOISE + JA + NOISE, NOISE + JA[:90] + NOISE, JA[:60] + NOISE, NOISE, JA[:45] + NOISE + JA[110:155] + NOISE, "\n".join(JA[k : k + 7] + "、" for k in range(0, 160, 7)),
        EN.upper(), EN.replace(" ", ",\n"), changed, " ".join(words[:20]) + NOISE, " ".join(words[:40]), "", "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in EN),
    ]
    assert found(docs, [JA, EN]) == {(0, 0), (1, 0), (4, 0), (5, 0), (6, 1), (7, 1), (8, 1), (10, 1), (12, 1)}


def test_shared_lead_in_is_no_case():
    items = [LEAD + JA, LEAD + JA[::-1]]
    assert found([LEAD + NOISE, LEAD + JA, JA[::-1][:100]], items) == {(1, 0), (2, 1)}


def test_windows_against_slices():
    a = bare("abcabcabd日本日本語語" * 7)
    for size, h in zip((1, 2, 5, 10, 25), windows(a, 1, 2, 5, 10, 25)):
        assert len(h) == len(a) - size + 1
        seen = {}
        for k in range(len(h)):
            assert seen.setdefault(h[k], a[k : k + size].tobytes()) == a[k : k + size].tobytes()
        assert len(seen) == len({a[k : k + size].tobytes() for k in range(len(h))})
    assert len(windows(a[:3], ALPHABETIC)[0]) == 0


def test_frames(spark):
    docs = spark.createDataFrame([(1, NOISE + JA, "k"), (2, None, "k"), (3, "", "k"), (4, NOISE, "k"), (5, NOISE + JA, "k"), (6, NOISE * 500 + EN, "k")], "doc_id bigint, text string, item string")
    items = spark.createDataFrame([(7, JA, 1), (8, None, 1), (9, "", 1), (10, "短い", 1), (11, JA, 1), (12, EN, 1)], "item_id bigint, text string, key int")
    got = sorted(tuple(x) for x in find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect())
    assert got == [(1, 7), (1, 11), (5, 7), (5, 11), (6, 12)]
    assert sorted(x["doc_id"] for x in without_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()) == [2, 3, 4]
    assert find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").collect() == []
    assert find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").collect() == []


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    from tsumugi.llm import leakage

    docs = spark.createDataFrame([(1, NOISE + JA), (2, EN)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, JA), (8, EN), (9, JA[:120])], "item_id bigint, text string")
    one = sorted(map(tuple, find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()))
    monkeypatch.setattr(leakage, "BLOCK", 100)
    assert sorted(map(tuple, find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect())) == one and len(one) == 3


def test_plain_search_agrees(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "eval_items"))
    got = {tuple(x) for x in find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    texts = [(x["doc_id"], bare(x["text"] or "").tobytes()) for x in docs.select("doc_id", "text").collect()]
    for item in items.collect():
        a = bare(item["text"])
        half = [a[k : k + len(a) * 6 // 10].tobytes() for k in range(0, len(a) * 4 // 10, max(1, len(a) // 40))]
        for doc, t in texts:
            if any(h in t for h in half):
                assert (doc, item["item_id"]) in got
