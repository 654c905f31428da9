"""Evaluation texts that leaked into a corpus."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import ship
from .encode import _LETTER, _NUMBER, character_classes, chunks

#: Characters in a window, for items in letters of an alphabet and for all others; smaller ones check what lies around a hit.
ALPHABETIC, OTHER = 25, 10
SMALL_ALPHABETIC, SMALL_OTHER = 10, 5
#: The share of an item that a document must repeat.
SHARE = 0.5
#: How far a checked window may be from a hit: along the item, and off the hit's diagonal (a changed word is longer or shorter).
ALONG, OFF = 90, 12
#: Candidates are documents with hits at this share of the item's windows.
CANDIDATE = 0.08
#: Items are broadcast in blocks of at most so many characters.
BLOCK = 20_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 23


def bare(text: str) -> np.ndarray:
    """Letters and digits of a text, in one width and in lower case, as code points."""
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    kind = character_classes()[points]
    return points[(kind == _LETTER) | (kind == _NUMBER)]


def windows(points: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """The hash of the window of each size at each place; by doubling, so a size costs the logarithm of it."""
    with np.errstate(over="ignore"):
        x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        doubled, power, length = [x ^ (x >> np.uint64(32))], [_BASE], 1
        while 2 * length <= max(sizes):
            h, p = doubled[-1], power[-1]
            doubled.append(h[: max(0, len(h) - length)] * p + h[length:])
            power.append(p * p)
            length *= 2
        out = []
        for size in sizes:
            total, done = None, 0
            for k in reversed(range(len(doubled))):
                if size - done >= 1 << k:
                    part = doubled[k][done:]
                    if total is None:
                        total = part
                    else:
                        m = min(len(total), len(part))
                        total = total[:m] * power[k] + part[:m]
                    done += 1 << k
            n = max(0, len(points) - size + 1)
            out.append(total[:n])
        return out


@dataclass
class Index:
    """The windows of a block of items, ready to be broadcast: at most BLOCK of them."""

    ids: list
    texts: list[np.ndarray]
    sizes: np.ndarray  # of the window
    hashes: dict[int, np.ndarray]  # by size: sorted, with repetitions
    owners: dict[int, np.ndarray]
    places: dict[int, np.ndarray]
    filters: dict[int, np.ndarray]


def build_index(items: list[tuple]) -> Index:
    """items: (id, text). Items with fewer letters and digits than a window have none and are never found."""
    kept = [(i, bare(t)) for i, t in items if t]
    texts = [t for _, t in kept]
    sizes = np.array([ALPHABETIC if len(t) and (t < 0x250).mean() > 0.5 else OTHER for t in texts], np.int64)
    index = Index([i for i, _ in kept], texts, sizes, {}, {}, {}, {})
    for size in (ALPHABETIC, OTHER):
        own = [k for k in range(len(texts)) if sizes[k] == size and len(texts[k]) >= size]
        found = [windows(texts[k], size)[0] for k in own]
        h = np.concatenate([np.empty(0, np.uint64), *found])
        owner = np.repeat(np.array(own, np.int64), [len(f) for f in found])
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(f)) for f in found]])
        order = np.argsort(h, kind="stable")
        index.hashes[size], index.owners[size], index.places[size] = h[order], owner[order], place[order]
        index.filters[size] = np.zeros(1 << _BITS, bool)
        index.filters[size][(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return index


def repeated_share(text: np.ndarray, item: np.ndarray, size: int, hits: np.ndarray, places: np.ndarray) -> float:
    """The share of the item that the document repeats around its hits (places in the document and in the item).

    Hits are verified character by character. Around them smaller windows count where they lie along the item as the hit does,
    and what a single changed word leaves uncovered between two such windows counts as repeated.
    """
    ok = (text[hits[:, None] + np.arange(size)] == item[places[:, None] + np.arange(size)]).all(1)
    hits, places = hits[ok], places[ok]
    if not len(hits):
        return 0.0
    small = SMALL_ALPHABETIC if size == ALPHABETIC else SMALL_OTHER
    own = windows(item, small)[0]
    order = np.argsort(own, kind="stable")
    near = np.zeros(len(text) + 1, np.int64)
    np.add.at(near, np.maximum(hits - ALONG, 0), 1)
    np.add.at(near, np.minimum(hits + ALONG + size, len(text)), -1)
    inside = np.nonzero(np.cumsum(near)[: max(0, len(text) - small + 1)] > 0)[0]
    window = windows(text, small)[0][inside]
    low, high = np.searchsorted(own[order], window, "left"), np.searchsorted(own[order], window, "right")
    many = high - low
    at = np.repeat(inside, many)
    to = order[np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
    # compare with the hits, sorted by diagonal, in bounded blocks
    seeds = np.unique(np.stack([hits - places, places // 16], 1), axis=0)
    keep = np.zeros(len(at), bool)
    for k in range(0, len(seeds), 64):
        s = seeds[k : k + 64]
        keep |= ((np.abs((at - to)[:, None] - s[:, 0]) <= OFF) & (np.abs(to[:, None] - 16 * s[:, 1]) <= ALONG)).any(1)
    covered = np.zeros(len(item) + 1, np.int64)
    for start, width in ((places, size), (to[keep], small)):
        np.add.at(covered, start, 1)
        np.add.at(covered, start + width, -1)
    mask = np.cumsum(covered)[:-1] > 0
    gap_ends = np.nonzero(np.diff(np.concatenate([[0], (~mask).astype(np.int8), [0]])))[0].reshape(-1, 2)
    for start, end in gap_ends:
        if start > 0 and end < len(mask) and end - start <= OFF:
            mask[start:end] = True
    return float(mask.mean())


def scan(keys: list, texts: list[str], index: Index) -> list[tuple]:
    """(document, item) for the documents of a chunk."""
    parts = [bare(t) for t in texts]
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    joined = np.zeros(int((length + 1).sum()), np.uint32)
    for s, p in zip(starts, parts):
        joined[s : s + len(p)] = p
    joined[starts + length] = 0x110000  # stands in no item
    out = []
    for size, hashed in zip((ALPHABETIC, OTHER), windows(joined, ALPHABETIC, OTHER)):
        sorted_ = index.hashes[size]
        if not len(sorted_) or not len(hashed):
            continue
        at = np.nonzero(index.filters[size][(hashed >> np.uint64(64 - _BITS)).astype(np.int64)])[0]
        h = hashed[at]
        low, high = np.searchsorted(sorted_, h, "left"), np.searchsorted(sorted_, h, "right")
        many = high - low
        at = np.repeat(at, many)
        which = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        owner, place = index.owners[size][which], index.places[size][which]
        doc = np.searchsorted(starts, at, "right") - 1
        order = np.lexsort((owner, doc))
        doc, owner, at, place = doc[order], owner[order], at[order], place[order]
        edge = np.concatenate([[0], np.nonzero((np.diff(doc) != 0) | (np.diff(owner) != 0))[0] + 1, [len(doc)]])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if a == b:
                continue
            k = int(owner[a])
            item = index.texts[k]
            if len(np.unique(place[a:b])) < CANDIDATE * (len(item) - size + 1):
                continue
            d = int(doc[a])
            if repeated_share(parts[d], item, size, at[a:b] - starts[d], place[a:b]) >= SHARE:
                out.append((keys[d], index.ids[k]))
    return out


def find_leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item_key): the documents that repeat at least half of an item's text, in one piece or in several.

    Texts are compared by their letters and digits in one width and case, so layout and punctuation don't matter. The items'
    windows are broadcast as a hash set, in blocks of bounded size; all windows of all documents are looked up in it, the hits are verified
    against the characters, and the share of the item around them is measured, single changed words included. A document is
    worked on where it is read: nothing is shuffled. Null and empty texts have no leaks, on either side; items shorter than one window
    are never found. Repeated documents come out each for itself.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    tests = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("text")).filter("text <> ''")
    total = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = total // BLOCK + 1
    kinds = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    types = [f.dataType.simpleString() for f in rows.select("key").schema]
    result = None
    for block in range(blocks):
        part = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(build_index(sorted((r["id"], r["text"]) for r in part.collect())))

        def work(batches: Iterator[pa.RecordBatch], shared=shared, types=types) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for first, texts in chunks(batch.column(1)):
                    found = scan(keys[first : first + len(texts)], texts, index)
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d for d, _ in found], batch.column(0).type), pa.array([i for _, i in found])], names=["key", "item"]
                        )

        one = rows.mapInArrow(work, f"key {kinds[0]}, item {kinds[1]}")
        result = one if result is None else result.unionByName(one)
    return result.toDF(key, item_key)


def without_leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """The documents into which no item leaked, all columns kept."""
    leaked = find_leaks(documents, key, text, items, item_key, item_text).select(key).distinct()
    return documents.join(leaked, key, "left_anti")
