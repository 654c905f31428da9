import random
import re
from collections import Counter, defaultdict

import pytest

from tsumugi.operators.hierarchy import ancestor_pairs, descendant_counts, hierarchy
from tsumugi.operators.skew import key_statistics
from tsumugi.operators.strict_load import load_valid, rejected
from tsumugi.operators.unpack import infer_delimiters, unpack


def walk(rows):
    up = {}
    for c, p in rows:
        if c and p:
            up[c] = min(p, up.get(c, p))
    out = {}
    for c in up:
        path, seen = [c], {c}
        while path[-1] in up and up[path[-1]] not in seen:
            path.append(up[path[-1]])
            seen.add(path[-1])
        if path[-1] not in up:
            out[c] = (path[-1], len(path) - 1, ">".join(reversed(path)))
        else:
            out[c] = ("", -1 if up[path[-1]] == c else -2, "")
    return out


def forest(seed):
    r = random.Random(seed)
    rows = [(f"n{k}", f"n{r.randint(max(0, k - 5), k - 1)}") for k in range(1, 150)]
    rows += [(f"chain{k}", f"chain{k - 1}") for k in range(1, 70)] + [(f"leaf{k}", "chain69") for k in range(40)]
    rows += [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("self", "self"), ("f", "self"), ("g", "f"), ("x", "y"), ("y", "x")]
    rows += [(f"tail{k}", f"tail{k - 1}") for k in range(1, 20)] + [("tail0", "x")]
    rows += [(None, "b"), ("z", None), ("", "b"), ("z", ""), ("n3", "n0"), ("n3", "n0"), ("w>w", "n1"), ("長" * 5000, "n2"), (None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy(spark, seed):
    rows = [*forest(seed), *[("n9", "n1")] * 3]
    df = spark.createDataFrame(rows, "node string, up string").selectExpr("*", "1 AS jump", "'x' AS path")
    got = hierarchy(df, "node", "up").collect()
    assert len(got) == len({x["node"] for x in got})
    expected = walk(rows)
    assert {x["node"]: (x["root_node"], x["node_depth"], x["full_path"]) for x in got} == expected
    pairs = Counter()
    high = defaultdict(int)
    for node, (_, depth, path) in expected.items():
        if depth > 0 and "w>w" not in path:
            words = path.split(">")
            for k, w in enumerate(words[:-1]):
                pairs[w] += 1
                high[w] = max(high[w], len(words) - 1 - k)
    pairs["n1"] += 1
    if (up := expected["n1"][0]) != "":
        pairs[up] += 1
    counts = {x["ancestor"]: (x["n_descendants"], x["height"]) for x in descendant_counts(df, "node", "up").collect()}
    assert counts == {w: (n, high[w]) for w, n in pairs.items()}
    listed = Counter(x["ancestor"] for x in ancestor_pairs(df, "node", "up").collect())
    assert listed == Counter({w: n for w, (n, _) in counts.items()})


@pytest.mark.parametrize("rows", [[], [("a", None)], [("a", "b")], [("a", "a")], [("a", "b"), ("b", "a")]])
def test_small_hierarchies(spark, rows):
    df = spark.createDataFrame(rows, "node string, up string")
    assert {x["node"]: (x["root_node"], x["node_depth"], x["full_path"]) for x in hierarchy(df, "node", "up").collect()} == walk(rows)
    descendant_counts(df, "node", "up").collect()
    ancestor_pairs(df, "node", "up").collect()


BLANK = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85 \xa0          　"
SEPARATORS = BLANK + ",，、､﹐﹑;；﹔|｜¦￤"
CLOSING = dict(["“”", "‘’", "「」", "『』", "｢｣", "«»", "‹›", "《》"])


def tokens(line):
    """A plain scanner, character by character."""
    out, k = [], 0
    while k < len(line):
        if line[k] in SEPARATORS:
            k += 1
            continue
        end = None
        if (q := line[k]) in "\"'＂＇":
            j, value = k + 1, ""
            while j < len(line):
                if line[j] == q and line[j + 1 : j + 2] == q:
                    value, j = value + q, j + 2
                elif line[j] == q:
                    end = j + 1
                    break
                else:
                    value, j = value + line[j], j + 1
        elif q in CLOSING and (j := line.find(CLOSING[q], k + 1)) >= 0:
            end, value = j + 1, line[k + 1 : j]
        if end is None or (end < len(line) and line[end] not in SEPARATORS):
            end = k
            while end < len(line) and line[end] not in SEPARATORS:
                end += 1
            value = line[k:end]
        if value:
            out.append(value)
        k = end
    return out


def test_packed_values(spark):
    r = random.Random(4)
    parts = [*"ab、，,;| \t\"\"''「」『』“”・/:｜；　", "語", "\"\"", "\"x, y\"", "「a b」", "''"]
    lines = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    lines += ["", "  ", "　", "a", "a,b,c", "a, b ,c ", "a b\tc", '"q ""r s"', '"a"""', '""""', '"open, x', "「a」b, c", "a/b:1/2・c", "x," * 30_000, '"' + "y " * 30_000 + '"', '"' + '""' * 20_000 + '"']
    rows = [(k, t, f"s{k % 4}" if k % 5 else None) for k, t in enumerate(lines)] + [(90_000, None, "s1")]
    df = spark.createDataFrame(rows, "key bigint, line string, source string").selectExpr("*", "1 AS delimiter", "2 AS pos")
    got = defaultdict(list)
    for x in sorted(unpack(df, "key", "line", "source").collect()):
        got[x["key"]].append((x["pos"], x["value"]))
    for k, t, _ in rows:
        assert got.pop(k, []) == list(enumerate(tokens(t or ""), 1)), repr(t)[:200]
    assert not got
    assert unpack(df.limit(0), "key", "line", "source").collect() == []


def test_inferred_delimiters(spark):
    rows = [("c", "犬,猫,馬"), ("c", "川,海,空"), ("c", "a b,鳥,魚"), ("b", "犬 猫 馬"), ("b", "川 海"), ("s", "犬；猫；馬"), ("v", "犬|猫"), ("n", "犬"), (None, "犬、猫"), ("c", None)]
    got = {x["source"]: x["delimiter"] for x in infer_delimiters(spark.createDataFrame(rows, "source string, line string"), "source", "line").collect()}
    assert got == {"c": "comma", "b": "blank", "s": "semicolon", "v": "bar", "": "comma"}


def diagnose(line):
    if line is None:
        return "columns"
    fields, k = [], 0
    while True:
        if line[k : k + 1] == '"':
            j, value = k + 1, ""
            while j < len(line) and not (line[j] == '"' and line[j + 1 : j + 2] != '"'):
                value, j = value + line[j], j + (2 if line[j] == '"' else 1)
            if j >= len(line) or line[j + 1 : j + 2] not in ("", "\t"):
                return "quote"
            k = j + 1
        else:
            j = line.find("\t", k)
            j = len(line) if j < 0 else j
            value = line[k:j]
            if '"' in value:
                return "quote"
            k = j
        fields.append(value)
        if k >= len(line):
            break
        k += 1
    if len(fields) != 3:
        return "columns"
    head, _, tail = fields[0].rpartition(":")
    if not head or not re.fullmatch("[0-9]+/[0-9]+", tail):
        return "word_id"
    m, n = map(int, tail.split("/"))
    if not 1 <= m <= n:
        return "sense"
    if fields[2] not in ("isa", "synonym"):
        return "sense_type"
    return "empty" if not fields[1] else None


def test_strict_load(spark):
    r = random.Random(9)
    parts = ["語", ":", "1", "2/3", ":1/2", "\t", "\t", '"', '""', "isa", "synonym", "\tisa", " ", "\n", "x"]
    lines = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(4000)]
    lines += [None, "", "\t\t", "a:1/2\tb\tisa", '"a:1/2"\t"b\tc"\t"isa"', "a:0/2\tb\tisa", "a:3/2\tb\tisa", "a:007/0010\tb\tisa", f"a:{'9' * 60}/{'9' * 61}\tb\tisa", f"a:{'9' * 61}/{'9' * 60}\tb\tisa",
              "a:1/2\t\tisa", 'a:1/2\t""\tisa', 'a:1/2\t"b"c\tisa', "a:1/2\tb\tIsa", "a:1/2\tb\tisa ", "a:1/2\tb\tisa\r", ":1/2\tb\tisa", "a:b:1/2\tb\tisa", "a:1/2:\tb\tisa", "a:１/2\tb\tisa", 'a"b:1/2\tb\tisa', "a:1/2\tb\tisa\t", "a:1/2\tb", "a:1/2\t" + "b" * 200_000 + "\tisa",
              'a:1/2\t"' + '""' * 20_000 + '"\tisa', "a:0/0\tb\tisa", "\n:1/1\t\n\tsynonym"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, raw string").selectExpr("*", "'x' AS offset", "1 AS three", "'y' AS word_id")
    got = {x["offset"]: x["reason"] for x in rejected(df, "line_no", "raw").collect()}
    assert got == {k: d for k, t in enumerate(lines) if (d := diagnose(t))}
    loaded = {x["offset"]: x for x in load_valid(df, "line_no", "raw").collect()}
    assert set(loaded) == set(range(len(lines))) - set(got)
    assert loaded[lines.index('"a:1/2"\t"b\tc"\t"isa"')]["sense_text"] == "b\tc"
    assert rejected(df.limit(0), "line_no", "raw").collect() == []


def test_key_statistics(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.6 else f"k{r.randint(0, 40)}", r.choice([None, "", *(f"m{k}" for k in range(30))]), r.choice([None, 0, -5, 2**31 - 1, -(2**31), 70_000, r.randint(-200_000, 200_000)])) for _ in range(4000)]
    rows += [(None, "m", 1), ("", "m", 1), ("nulls", None, None), ("長" * 10_000, "m", 3), ("ties", "a", 1), ("ties", "a", 1), ("ties", "b", 2), ("ties", "b", 2)]
    df = spark.createDataFrame(rows, "key string, member string, n int").selectExpr("*", "1 AS hi", "2 AS upto", "3 AS num")
    got = {x["key"]: tuple(x)[1:] for x in key_statistics(df, "key", "member", "n").collect()}
    by = defaultdict(list)
    for k, m, n in rows:
        if k:
            by[k].append((m, n))
    for k, x in by.items():
        nums = sorted(n for _, n in x if n is not None)
        median = nums[(len(nums) + 1) // 2 - 1] if nums else None
        assert got.pop(k) == (len(x), len({m for m, _ in x if m}), sum(nums) if nums else None, median), k[:20]
    assert not got
    assert key_statistics(df.limit(0), "key", "member", "n").collect() == []
