"""Encoding of a corpus by a byte-level pair vocabulary, in numpy."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import ship

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters that are worked on at once; a longer text is taken alone.
CHUNK = 1_000_000
#: Segments remembered between chunks by a worker; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Segments are merged in matrices of one width each, up to these.
WIDTHS = (4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384)

_LETTER, _NUMBER, _BLANK, _OTHER = 0, 1, 2, 3
_NONE = np.iinfo(np.int32).max
_classes: np.ndarray | None = None
_vocabularies: dict[str, Vocabulary] = {}


def character_classes() -> np.ndarray:
    """For each code point: letter, number, blank or other, as the pattern has them."""
    global _classes
    if _classes is None:
        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        out = np.full(0x110000, _OTHER, np.uint8)
        for code, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
            for m in regex.finditer(pattern, text):
                out[points[m.start() : m.end()]] = code
        _classes = out
    return _classes


class Vocabulary:
    """Ranks of byte strings, with what the matrices need: a hash table from id pairs to the merged id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.joined = np.zeros(65536, bool)  # bytes that stand side by side inside some token
        keys, merged = [], []
        for token, rank in ranks.items():
            for k in range(len(token) - 1):
                self.joined[token[k] * 256 + token[k + 1]] = True
                left, right = ranks.get(token[: k + 1]), ranks.get(token[k + 1 :])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    merged.append(rank)
        self.bits = 1
        while 1 << self.bits < 4 * len(keys):
            self.bits += 1
        size = 1 << self.bits
        self.slot_key, self.slot_id = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        self.probes = 1
        key, value = np.array(keys, np.int64), np.array(merged, np.int32)
        at, step = self._slot(key), 0
        left_over = np.arange(len(key))
        while len(left_over):  # open addressing, one probe for all in each turn
            slots = (at[left_over] + step) & (size - 1)
            free = np.nonzero(self.slot_key[slots] == -1)[0]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.slot_key[slots[placed]], self.slot_id[slots[placed]] = key[left_over[placed]], value[left_over[placed]]
            left_over = np.delete(left_over, placed)
            step += 1
        self.probes = step
        self.known: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, which is its rank; _NONE where it doesn't merge."""
        key = left.astype(np.int64) << 20 | right
        key[(left < 0) | (right < 0)] = -2
        slot, out = self._slot(key), np.full(key.shape, _NONE, np.int32)
        open_ = np.nonzero(key != -2)
        for step in range(self.probes):
            if not len(open_[0]):
                break
            s, k = (slot[open_] + step) & (len(self.slot_key) - 1), key[open_]
            held = self.slot_key[s]
            hit = held == k
            out[tuple(x[hit] for x in open_)] = self.slot_id[s[hit]]
            more = ~hit & (held != -1)
            open_ = tuple(x[more] for x in open_)
        return out

    def merge(self, segments: list[bytes]) -> list[np.ndarray]:
        """The ids of each segment. Length buckets make padded matrices; every round, every row merges its leftmost pair of least rank.

        Ranks are looked up again only beside the merge, the row's tail moves up by one, finished rows leave the matrix, and a
        matrix whose rows have become short is cut narrower.
        """
        out: list[np.ndarray] = [None] * len(segments)  # type: ignore[list-item]
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        low = 0
        for width in (*WIDTHS, int(lengths.max(initial=0))):
            rows = np.nonzero((lengths > low) & (lengths <= width))[0]
            low = max(low, width)
            most = max(1, 2_000_000 // width)
            for part in (rows[k : k + most] for k in range(0, len(rows), most)):
                self._merge(segments, part, lengths[part], out)
        return out

    def _merge(self, segments: list[bytes], rows: np.ndarray, n: np.ndarray, out: list[np.ndarray]) -> None:
        width = int(n.max())
        flat = np.frombuffer(b"".join(segments[k].ljust(width, b"\0") for k in rows), np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < n[:, None], self.byte[flat], -1).astype(np.int32)
        ranks = np.full(ids.shape, _NONE, np.int32)
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        rows, n = rows.copy(), n.copy()
        while len(rows):
            at = ranks.argmin(1)  # the leftmost of the least
            every = np.arange(len(rows))
            best = ranks[every, at]
            done = best == _NONE
            if done.any():
                for k in np.nonzero(done)[0]:
                    out[rows[k]] = ids[k, : n[k]].copy()
                keep = ~done
                rows, n, at, best = rows[keep], n[keep], at[keep], best[keep]
                width = int(n.max(initial=1))
                ids, ranks = ids[keep, :width], ranks[keep, :width]
                every = np.arange(len(rows))
                if not len(rows):
                    return
            column = np.arange(ids.shape[1])
            tail = column > at[:, None]
            ids[every, at] = best
            moved = np.where(tail[:, :-1], ids[:, 1:], ids[:, :-1])
            ids[:, :-1] = moved
            # position p takes over p+1's value where p lies behind the merge
            ranks[:, :-1] = np.where(tail[:, :-1], ranks[:, 1:], ranks[:, :-1])
            n -= 1
            ids[every, n] = -1
            ranks[every, n] = _NONE
            nxt = np.minimum(at + 1, ids.shape[1] - 1)
            right = np.where(at + 1 < n, ids[every, nxt], -1)
            ranks[every, at] = self.rank(best, right)
            before = np.maximum(at - 1, 0)
            left = np.where(at > 0, ids[every, before], -1)
            lower = self.rank(left, best)
            ranks[every, before] = np.where(at > 0, lower, ranks[every, before])


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def piece_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of the splitting pattern begin, as a mask over characters. starts: the texts' first characters.

    The pattern's alternatives, in their order: a contraction, letters, numbers or others with one space before, blanks not
    followed by anything else, blanks.
    """
    n = len(points)
    kind = character_classes()[points]
    text_start = np.zeros(n + 1, bool)
    text_start[starts] = True
    text_start[n] = True
    begin = np.zeros(n, bool)
    begin[0] = True
    begin[1:] = kind[1:] != kind[:-1]
    begin |= text_start[:n]
    # the last blank of a run that something follows stands alone, and a space goes with what follows
    last_blank = np.zeros(n, bool)
    last_blank[:-1] = (kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~text_start[1:n]
    begin |= last_blank
    space = last_blank & (points == 0x20)
    after = np.zeros(n, bool)
    after[1:] = space[:-1]
    begin &= ~after
    # contractions: an apostrophe that begins a piece and is followed by letters
    mark = np.nonzero((points[:-1] == 0x27) & begin[:-1] & begin[1:] & ~text_start[1:n])[0] if n > 1 else np.empty(0, np.int64)
    if len(mark):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[mark + 1], padded[mark + 2]
        second = ~text_start[np.minimum(mark + 2, n)]
        long_ = second & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        for which, size in ((long_, 3), (short, 2)):
            m = mark[which]
            begin[m + 1] = False
            end = m + size
            end = end[end < n]
            begin[end] = True
    return begin


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each text has."""
    counts = np.zeros(len(texts), np.int64)
    full = np.array([k for k, t in enumerate(texts) if t], np.int64)
    if not len(full):
        return np.empty(0, np.int32), counts
    joined = "".join(texts[k] for k in full)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    sizes = np.fromiter((len(texts[k]) for k in full), np.int64, len(full))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    begin = piece_starts(points, starts)
    raw = joined.encode()
    data = np.frombuffer(raw, np.uint8)
    offset = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), out=offset[1:])
    cut = np.zeros(len(data), bool)
    cut[offset[:-1][begin]] = True
    # no token holds these two bytes side by side, so no merge ever crosses here: both sides can be encoded apart
    cut[1:] |= ~vocab.joined[data[:-1].astype(np.int32) << 8 | data[1:]]
    edges = np.concatenate([np.nonzero(cut)[0], [len(data)]])
    known, ids = vocab.known, vocab.ids
    if len(known) > REMEMBERED:
        known.clear()
        ids.clear()
    bounds = edges.tolist()
    segments = [raw[i:j] for i, j in zip(bounds, bounds[1:])]
    new = [s for s in set(segments) if s not in known]
    if new:
        for s, out in zip(new, vocab.merge(new)):
            known[s] = len(ids)
            ids.append(out)
    which = np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, first = np.concatenate(ids), np.concatenate([[0], np.cumsum(length)[:-1]])
    per = length[which]
    ends = np.cumsum(per)
    index = np.arange(int(ends[-1])) + np.repeat(first[which] - (ends - per), per)
    before = np.concatenate([[0], ends])
    at = np.searchsorted(edges, np.concatenate([offset[starts], [len(data)]]))
    counts[full] = np.diff(before[at])
    return flat[index].astype(np.int32), counts


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Slices of a column of texts, with their first index, nulls as empty texts; each of at most so many bytes, or one text."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1])
    first, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if total + size > most and k > first:
            yield first, [t or "" for t in texts.slice(first, k - first).to_pylist()]
            first, total = k, 0
        total += size
    if first < len(texts):
        yield first, [t or "" for t in texts.slice(first).to_pylist()]


def encode(documents: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids) of every row by a byte-level vocabulary of ranks, without special tokens.

    Whole texts; an empty list for an empty or null text. Strings of special tokens are ordinary text. Texts are cut at the
    pattern's pieces and, inside them, between two bytes that no token of the vocabulary holds side by side; each different
    segment is merged once for a chunk (and remembered, in bounded memory) by :meth:`Vocabulary.merge`. Nothing is shuffled.
    A text of any length is worked on in memory proportional to it. Repeated rows come out repeated. Other columns are ignored.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    ship(documents.sparkSession)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for first, part in chunks(texts):
                ids, counts = encode_texts(part, vocab)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(part)), lists], names=["key", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
