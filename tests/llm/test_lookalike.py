import random
from collections import defaultdict

import numpy as np
import pytest

from tsumugi.llm.lookalike import LOOK_ALIKE, Canonical, _alphabet, bigram_counts, look, look_alike_pairs, train

SAME = [
    ("ﾃﾞコ", "デコ"), ("デコ", "デコ"), ("Ｒｅ", "Re"), ("Наq", "Haq"), ("夜⾔村", "夜言村"), ("温‍面", "温面"), ("a b", "a b"), ("a　b", "a b"),
    ("対：x", "対:x"), ("ユ口ムモ卜", "ユロムモト"), ("デべ", "デベ"), ("é", "é"), ("ヘ", "へ"), ("物︀季", "物季"), ("類", "類"), ("１", "1"), ("ё", "ë"), ("｡", "。"),
]
NOT_SAME = [("a", "A"), ("é", "e"), ("a  b", "a b"), (" a", "a"), ("a.", "a"), ("ハ", "バ"), ("²", "2"), ("①", "1"), ("o", "0"), ("ハハ", "ハ"), ("x", "×"), ("カ゛", "ガ")]


def test_looks():
    for a, b in SAME:
        assert look(a) == look(b), (a, b)
    for a, b in NOT_SAME:
        assert look(a) != look(b), (a, b)


def test_viterbi_agrees_with_brute_force():
    r = np.random.RandomState(3)
    symbols, groups = _alphabet()
    scores = r.randn(len(symbols), len(symbols)).astype(np.float32)
    canonical = Canonical(scores)
    from itertools import product

    from tsumugi.llm.lookalike import script

    texts = ["oHeカ二", "x", "エ工口", "zq", "abc京oo", "ーー", "oooooo"]
    for text, got in zip(texts, canonical([look(t) for t in texts])):
        best = max(
            product(*(groups.get(c, (c,)) for c in look(text))),
            key=lambda p: sum(scores[i, j] for i, j in zip([0, *(symbols.get(c, symbols[script(c)]) for c in p)], (symbols.get(c, symbols[script(c)]) for c in p))),
        )
        assert got == "".join(best)


def test_forms_keep_to_one_script(spark):
    words = ["мускул", "москва", "cocoa", "house", "カロリ", "工場", "二人", "ニコニコ", "タカ", "八人", "hope", "peace"] * 20
    model = train(spark.createDataFrame([(w,) for w in words], "value string"))
    got = Canonical(model)([look(t) for t in ("mосква".replace("m", "м"), "соcоа", "カロリ", "二人", "ニコ", "hоре")])
    assert got == ["москва", "cocoa", "カロリ", "二人", "ニコ", "hope"]


def test_forms_never_merge_looks():
    r = random.Random(5)
    letters = "".join(LOOK_ALIKE) + "bgmäéガ漢 .1"
    texts = {"".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(3000)}
    symbols, _ = _alphabet()
    canonical = Canonical(np.random.RandomState(1).randn(len(symbols), len(symbols)).astype(np.float32))
    by_form, by_look = defaultdict(set), defaultdict(set)
    listed = sorted(texts)
    for t, form in zip(listed, canonical([look(t) for t in listed])):
        by_form[form].add(t)
        by_look[look(t)].add(t)
    assert sorted(map(sorted, by_form.values())) == sorted(map(sorted, by_look.values()))


def brute(rows):
    groups = defaultdict(list)
    for i, v in rows:
        if v:
            groups[look(v)].append((i, v))
    return sorted((min(i, j), max(i, j)) for g in groups.values() for k, (i, v) in enumerate(g) for j, w in g[k + 1 :] if v != w)


def run(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, value string")
    return sorted((x["id1"], x["id2"]) for x in look_alike_pairs([("f", df)]).collect())


def test_pairs(spark):
    rows = [(k, v) for k, v in enumerate([x for p in SAME + NOT_SAME for x in p] * 2)] + [(900, None), (901, ""), (902, "長" * 30_000), (903, "⾧" * 30_000)]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == len(set(got))


def test_a_hot_value(spark):
    rows = [(k, "ことば" if k % 3 else "other") for k in range(600)] + [(1000, "こと​ば"), (1001, "こと‍ば")]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("name,key,column", [("definition", "def_id", "midasi"), ("definition", "def_id", "def"), ("synonym_web_news", "pair_id", "word1")])
def test_table(spark, data, name, key, column):
    df = spark.read.parquet(f"{data}/{name}.parquet").select(key, column)
    rows = [tuple(x) for x in df.collect()]
    assert sorted((x["id1"], x["id2"]) for x in look_alike_pairs([(column, df)]).collect()) == brute(rows)


def test_counts_are_bounded(spark):
    df = spark.createDataFrame([("aо京",), ("",), (None,)], "value string")
    assert sum(r["n"] for r in bigram_counts(df).collect()) == 3
