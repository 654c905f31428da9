import random
import re

import numpy as np

from tsumugi.llm.reading import document_frequencies, features, reading_levels, words_of


def plain_words(text):
    return re.findall(r"[A-Za-zÀ-ɏ̀-ͯ'-]+|[一-鿿々]+|[゠-ヿ]+|[ぁ-ゖ]+|[0-9]+", text.lower())


def test_words_against_a_pattern():
    texts = ["", "あのね、リンゴを食べた。はい！", "The cat's well-known tail. Ok 12", "x", "。", "漢字かなカナ", "Ab ab AB"]
    doc, word, length, sentence, japanese = words_of(texts)
    for k, t in enumerate(texts):
        assert length[doc == k].tolist() == [len(w) for w in plain_words(t)]
    seen = {}
    for h, w in zip(word.tolist(), [w for t in texts for w in plain_words(t)]):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert japanese.tolist()[1] and not japanese.tolist()[2]
    assert len(set(sentence[doc == 1])) == 2 and len(set(sentence[doc == 2])) == 2


def test_frequencies(spark):
    texts = ["cat dog cat", "dog", None, "", "いぬ いぬ", "DOG"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = sorted(x["df"] for x in document_frequencies(df, "text").collect())
    assert got == [1, 1, 3]


def test_features_of_a_text_without_words():
    japanese, x = features(["。。", "a b. c"], {True: np.array([1]), False: np.array([], np.int64)})
    assert x[0, :-3].tolist() == [1] * 9 and x[1, -3] == 1.5


def corpus(n, seed):
    r = random.Random(seed)
    vocab = {g: [f"{'abcd'[g - 1]}{k}x".translate(str.maketrans("0123456789", "qrstuvwyzk")) for k in range(30)] for g in (1, 2, 3, 4)}
    rows = []
    for k in range(n):
        g = r.randint(1, 4)
        own = lambda: r.choice(vocab[g if r.random() < 0.8 else max(1, min(4, g + r.choice((-1, 1))))])
        rows.append((k, ". ".join(" ".join(own() for _ in range(3 * g + r.randint(0, 3))) for _ in range(12)) + ".", g))
    return rows


def test_grades_of_texts_not_seen(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([(k, t, "c") for k, t, _ in rows] + [(900, None, "c"), (901, " \n　", "c"), (902, "", "c"), (903, "?!", "c"), (904, "word " * 50_000, "c")], "doc_id bigint, text string, grade string")
    labels = spark.createDataFrame([(k, g, "r") for k, _, g in rows if k < 300] + [(5, None, "r"), (7777, 1, "r")], "doc_id bigint, grade int, rater string")
    got = {x["doc_id"]: x["grade"] for x in reading_levels(docs, "doc_id", "text", labels, "grade").collect()}
    assert set(got) == {k for k, _, _ in rows} | {903, 904}
    assert np.mean([got[k] == g for k, _, g in rows if k >= 300]) > 0.9


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, grade int")
    assert [tuple(x) for x in reading_levels(docs, "doc_id", "text", labels, "grade").collect()] == [(1, None)]
    assert reading_levels(docs.limit(0), "doc_id", "text", labels, "grade").collect() == []


def test_held_out_labels(spark, data):
    d = data.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    rest = {x["doc_id"]: x["grade"] for x in labels.filter("doc_id % 2 = 1").collect()}
    got = {x["doc_id"]: x["grade"] for x in reading_levels(docs, "doc_id", "text", half, "grade").collect()}
    assert np.mean([got[k] == g for k, g in rest.items() if k in got]) > 0.88
