"""Chains are searched in whole components: a job for each step took hundreds of jobs on chains of hundreds of links."""

from collections import defaultdict

import pytest

from tsumugi.functions.runtime import Scratch
from tsumugi.operators import chain_search
from tsumugi.operators import lexicon_etl as E

LONG = 150
LINKS = (
    [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(LONG)] + [("hub", f"leaf{k}") for k in range(40)] + [("leaf3", "é"), ("é", "z"), ("leaf4", "z"), ("leaf5", "Z"), ("Z", "z"), ("z", "𠮷"), ("ｚ", "𠮷")]
    + [(f"{x}{k}", f"{x}{(k + 1) % n}") for x, n in (("r", 9), ("s", 10)) for k in range(n)] + [("r0", "r0"), (None, "r1"), ("", "r2"), ("r1", "r0")]
)
STARTS = ["c000", "c077", "hub", "leaf7", "z", "𠮷", "r0", "r4", "s3", "alone", "", None, "hub"]


def by_hand():
    near, found = defaultdict(set), {}
    for a, b in LINKS:
        if a and b and a != b:
            near[a].add(b)
            near[b].add(a)
    for start in {s for s in STARTS if s}:
        level, seen = {start: [start]}, {start}
        while level:
            found.update({(start, w): p for w, p in level.items()})
            after = defaultdict(list)
            for x, p in level.items():
                for y in near[x] - seen:
                    after[y].append([*p, y])
            level = {y: min(ps, key=lambda p: [w.encode() for w in p]) for y, ps in after.items()}
            seen |= level.keys()
    return found


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(LINKS, "w1 string, w2 string"), spark.createDataFrame([(s,) for s in STARTS], "word string")


def rows_of(df):
    rows = df.collect()
    got = {(r["start"], r["word"]): r["path"] for r in rows}
    assert len(got) == len(rows) and all(r["steps"] == len(r["path"]) - 1 for r in rows)
    return got


def test_few_tables_for_long_chains(asked, monkeypatch):
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    assert rows_of(E.chains(*asked)) == by_hand()
    assert len(written) < 30


def test_large_components_by_rounds(asked):
    assert rows_of(E.chains(*asked, most=100)) == by_hand()


def test_pieces(monkeypatch):
    """Rows cut anywhere, and components whose starts are dealt out, give the same."""
    import pyarrow as pa

    monkeypatch.setattr(chain_search, "ROWS", 30)  # several pieces, and parts of a component
    monkeypatch.setattr(chain_search, "WORDS", 7)
    wanted, near = by_hand(), defaultdict(set)
    for a, b in LINKS:
        if a and b and a != b:
            near[a[0] if a[0] in "crs" else "x"] |= {(a, b), (b, a)}
    rows = []
    for label, name in enumerate("crsx"):
        for part in (0, 1):
            rows += [(label, part, 50, a, b) for a, b in sorted(near[name])]
            rows += [(label, part, 50, s, None) for k, s in enumerate(sorted({s for s in STARTS if s and s != "alone" and (s[0] if s[0] in "crs" else "x") == name})) if k % 2 == part]
    for size in (1, 17, 1000):
        cut = [pa.RecordBatch.from_pylist([dict(zip(("label", "part", "n", "w1", "w2"), r)) for r in rows[i : i + size]], pa.schema([("label", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("w1", pa.string()), ("w2", pa.string())])) for i in range(0, len(rows), size)]
        got = [r for b in chain_search.searched(iter(cut)) for r in b.to_pylist()]
        assert {(r["start"], r["word"]): r["path"] for r in got} == {k: v for k, v in wanted.items() if k[0] != "alone"} and len(got) == len(wanted) - 1
