import os
import random

import pytest

from tsumugi.llm.encode import DEFAULT_VOCABULARY, encode, encode_texts, vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def judge():
    import base64

    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("judge", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def same(texts, judge):
    ids, counts = encode_texts(texts, vocabulary(DEFAULT_VOCABULARY))
    at = 0
    for t, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == judge(t), repr(t)
        at += n
    assert at == len(ids)


CASES = [
    "", " ", "  ", "\n", " \n ", "a", " a", "  a", "a  ", "a\n\nb", "a \n b", "don't", "don'table", "we're we've we'll I'm I'd it's", "'s", " 's", "''s", "'re", "'r", "'l", "'ve'll", "x's'", "'S", "'sé",
    "a'll9", "'9", "99'd", "!'s", "1a2b", "日本語のテキスト。", "ＡＢＣ　１２", "é é", "👩‍👩‍👧 emoji", "<|endoftext|>", "a" * 3000, "ab" * 700, " " * 50 + "x", "\r\n\r\n", " a", "　a", "½ ² ٣",
    "tab\tx", "x​y", "'", "''", "a'", "'\n", "﻿x", "𠮷野家", "'t's", "’s", "  's", "\t's", "x 're",
]


def test_cases(judge):
    same(CASES, judge)
    same([c + d for c in CASES for d in CASES if len(c) + len(d) < 100], judge)


def test_random_texts(judge):
    r = random.Random(7)
    letters = ["a", "b", "the ", "ing", " ", "  ", "\n", "'", "s", "re", "ll", "1", "23", ".", ",", "日", "本", "の", "ース", "カ", "é", "👍", "-", "　", "ß", "д", "е"]
    same(["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)], judge)
    same(["".join(chr(r.choice((r.randint(32, 126), r.randint(0x80, 0x7FF), r.randint(0x3000, 0xD7FF), r.randint(0x10000, 0x1FFFF)))) for _ in range(30)) for _ in range(500)], judge)


def test_table(spark, data, judge):
    df = spark.read.parquet(f"{data}/documents.parquet")
    got = {x["doc_id"]: x["ids"] for x in encode(df, "doc_id", "text").collect()}
    for x in df.select("doc_id", "text").collect():
        assert got.pop(x["doc_id"]) == (judge(x["text"]) if x["text"] else [])
    assert not got


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "ab", "x"), (3, "ab", "x")], "key bigint, text string, ids string")
    got = sorted((x["key"], x["ids"]) for x in encode(df, "key", "text").collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and got[2][1]
    assert encode(df.limit(0), "key", "text").collect() == []
