"""Reading level of documents, by shares of unfamiliar words and sentence length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import Scratch, ship
from .encode import chunks

#: Sizes of the high-frequency lists, by document frequency; the largest is how many words a language's list has.
LISTS = (50, 100, 200, 300, 500, 800, 1200, 2000, 5000)
#: Labelled documents that the formula's weights are fitted on, at most; beyond it those with the smallest hash of their id.
MAX_LABELS = 20_000
#: A language with fewer labels than this shares one fit with the others.
MIN_LABELS = 30

_NONE, _LATIN, _HAN, _KATAKANA, _HIRAGANA, _DIGIT = range(6)
_BASE = 0x9E3779B97F4A7C15
_tables: tuple[np.ndarray, np.ndarray] | None = None


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of word characters, and whether a character ends a sentence, by code point."""
    global _tables
    if _tables is None:
        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        kind = np.zeros(0x110000, np.uint8)
        for code, pattern in ((_LATIN, r"[\p{Latin}\p{M}'-]+"), (_HAN, r"[\p{Han}々]+"), (_KATAKANA, r"[\p{Katakana}ー・]+"), (_HIRAGANA, r"\p{Hiragana}+"), (_DIGIT, r"\p{N}+")):
            for m in regex.finditer(pattern, text):
                kind[points[m.start() : m.end()]] = code
        end = np.zeros(0x110000, bool)
        end[[ord(c) for c in "。．！？!?\n\r"]] = True
        _tables = kind, end
    return _tables


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts: the text's index, a hash, the length and the number of its sentence; and which texts are Japanese.

    A word is a run of letters of one script in lower case. Runs of Latin letters may hold apostrophes and hyphens.
    """
    kinds, ends = _classes()
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(texts))
    points = np.frombuffer("\0".join(lowered).encode("utf-32-le"), "<u4")
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    kind = kinds[points]
    change = np.concatenate([[True], kind[1:] != kind[:-1]]) if len(kind) else np.empty(0, bool)
    begin = np.nonzero(change)[0]
    stop = np.concatenate([begin[1:], [len(kind)]]).astype(np.int64) if len(begin) else begin
    real = kind[begin] != _NONE
    begin, stop = begin[real], stop[real]
    with np.errstate(over="ignore"):
        power = np.full(len(points) + 1, _BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        inverse = np.full(len(points) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        np.cumprod(inverse, out=inverse)
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mixed * power[:-1], out=prefix[1:])
        hashed = (prefix[stop] - prefix[begin]) * inverse[begin]
        hashed ^= hashed >> np.uint64(31)
    doc = np.searchsorted(starts, begin, "right") - 1
    sentence_end = ends[points]
    dot = np.nonzero(points == 0x2E)[0]
    following = np.concatenate([points, [0]])[dot + 1]
    sentence_end[dot[(following == 0) | (following == 0x20) | (following == 0x0A) | (following == 0x0D)]] = True
    sentence = np.cumsum(sentence_end)[begin]
    japanese = np.bincount(doc, np.where(np.isin(kind[begin], (_HAN, _KATAKANA, _HIRAGANA)), stop - begin, 0), len(texts))
    latin = np.bincount(doc, np.where(kind[begin] == _LATIN, stop - begin, 0), len(texts))
    return doc, hashed.view(np.int64), stop - begin, sentence, japanese * 2 >= latin


def document_frequencies(documents: DataFrame, text: str) -> DataFrame:
    """(japanese, word, df) over whole texts. Every task counts before the shuffle."""
    ship(documents.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for _, texts in chunks(batch.column(0)):
                doc, word, _, _, japanese = words_of(texts)
                order = np.lexsort((word, doc))
                d, w = doc[order], word[order]
                new = np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]) if len(d) else np.empty(0, bool)
                held.append((w[new], japanese[d[new]]))
            words, flags = (np.concatenate([h[k] for h in held]) if held else np.empty(0, np.int64) for k in (0, 1))
            for flag in (True, False):
                u, n = np.unique(words[flags == flag], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), flag)), pa.array(u, pa.int64()), pa.array(n, pa.int64())], names=["japanese", "word", "df"])

    part = documents.select(text).filter(F.col(text).isNotNull()).mapInArrow(work, "japanese boolean, word bigint, df bigint")
    return part.groupBy("japanese", "word").agg(F.sum("df").alias("df"))


def high_frequency_lists(frequencies: DataFrame) -> dict[bool, np.ndarray]:
    """The words of each language's list, most frequent first; at most LISTS[-1] each."""
    out = {}
    for flag in (True, False):
        top = frequencies.filter(F.col("japanese") == flag).orderBy(F.desc("df"), "word").limit(LISTS[-1]).collect()
        out[flag] = np.array([r["word"] for r in top], np.int64)
    return out


def features(texts: list[str], lists: dict[bool, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are Japanese; and of each the share of words outside each list, words in a sentence, its logarithm, letters in a word."""
    doc, word, length, sentence, japanese = words_of(texts)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    rank = np.full(len(word), LISTS[-1] + 1, np.int64)
    for flag, words in lists.items():
        if len(words):
            order = np.argsort(words)
            mine = np.nonzero(japanese[doc] == flag)[0]
            at = np.minimum(np.searchsorted(words[order], word[mine]), len(words) - 1)
            hit = words[order][at] == word[mine]
            rank[mine[hit]] = order[at[hit]]
    some = np.maximum(count, 1)
    out = np.zeros((n, len(LISTS) + 3))
    for k, size in enumerate(LISTS):
        out[:, k] = np.where(count > 0, np.bincount(doc, rank >= size, n) / some, 1)
    new = np.concatenate([[True], (sentence[1:] != sentence[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.empty(0, bool)
    out[:, -3] = count / np.maximum(np.bincount(doc, new, n), 1)
    out[:, -2] = np.log1p(out[:, -3])
    out[:, -1] = np.bincount(doc, length, n) / some
    return japanese, out


def _terms(x: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([x, x[:, i] * x[:, j]], 1)


class Formula:
    """Weights of the features and their products for each grade, by logistic regression."""

    def __init__(self, x: np.ndarray, grade: np.ndarray, rounds: int = 500):
        self.grades = np.unique(grade)
        z = _terms(x)
        self.mean, self.dev = z.mean(0), z.std(0) + 1e-9
        a = np.concatenate([np.ones((len(z), 1)), (z - self.mean) / self.dev], 1)
        y = (grade[:, None] == self.grades).astype(float)
        self.weights = np.zeros((a.shape[1], len(self.grades)))
        m, v, decay = np.zeros_like(self.weights), np.zeros_like(self.weights), 3 / (len(a) + 1)
        for t in range(1, rounds + 1):
            s = a @ self.weights
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = a.T @ (p - y) / len(a) + decay * self.weights
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.weights -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a = np.concatenate([np.ones((len(x), 1)), (_terms(x) - self.mean) / self.dev], 1)
        return self.grades[(a @ self.weights).argmax(1)]


def reading_levels(documents: DataFrame, key: str, text: str, labels: DataFrame, label: str) -> DataFrame:
    """(key, grade) for every document whose text is neither null nor blank.

    Familiar-word formula: document frequencies of all words of all documents give a high-frequency list for Japanese texts
    and one for all others; a document's features are the shares of its words outside the first 50, 100, ... of its list, and the average
    length of sentences and words. The weights that turn these into grades are fitted on the labelled documents, at most
    MAX_LABELS of them; all documents are graded the same way. A text without words has no familiar ones. Without
    any label every grade is null. Repeated documents come out each for itself.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark, "reading")
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    lists = spark.sparkContext.broadcast(high_frequency_lists(scratch.write(document_frequencies(rows, "text"), "frequencies")))
    names = [f"f{k}" for k in range(len(LISTS) + 3)]
    kind = rows.schema["key"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                shown = np.array([k for k, t in enumerate(texts) if t.strip()], np.int64)
                if len(shown):
                    japanese, x = features([texts[k] for k in shown], lists.value)
                    keys = batch.column(0).slice(first, len(texts)).take(pa.array(shown))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(japanese), *(pa.array(c.astype(np.float32)) for c in x.T)], names=["key", "japanese", *names])

    measured = rows.filter(F.col("text").isNotNull()).mapInArrow(measure, f"key {kind}, japanese boolean, " + ", ".join(f"{n} float" for n in names))
    measured = scratch.write(measured, "features")
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("grade")).filter("grade is not null").groupBy("key").agg(F.min("grade").alias("grade"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(MAX_LABELS)
    sample = measured.dropDuplicates(["key"]).join(known, "key").toPandas().sort_values("key")
    fits: dict[bool, Formula | None] = {}
    for flag in (True, False):
        own = sample[sample.japanese == flag]
        own = own if len(own) >= MIN_LABELS else sample
        fits[flag] = Formula(own[names].to_numpy(float), own.grade.to_numpy()) if len(own) else None

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(names))], 1).astype(float)
            japanese = np.array(batch.column(1).to_pylist(), bool)
            out = np.zeros(len(x), np.int32)
            for flag, formula in fits.items():
                if formula is not None and (japanese == flag).any():
                    out[japanese == flag] = formula(x[japanese == flag])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32(), mask=out == 0)], names=["key", "grade"])

    return measured.mapInArrow(grade, f"key {kind}, grade int").toDF(key, "grade")
