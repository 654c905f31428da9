"""Text functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The full-width forms of ASCII; most lie 0xFEE0 above, these don't.
_SPECIAL = {" ": "　", "\\": "￥", '"': "”", "'": "’", "`": "‘", "-": "−", "~": "〜"}
ASCII = "".join(map(chr, range(0x20, 0x7F)))
WIDE = "".join(_SPECIAL.get(c, chr(ord(c) + 0xFEE0)) for c in ASCII)
WIDE_UPPER = "".join(chr(k) for k in range(0xFF21, 0xFF3B))
WIDE_LOWER = "".join(chr(k) for k in range(0xFF41, 0xFF5B))


def to_wide(c: Column) -> Column:
    """ASCII in full width."""
    return F.translate(c, ASCII, WIDE)


def wide_upper(c: Column) -> Column:
    """Full-width Latin letters as capitals; nothing else changes."""
    return F.translate(c, WIDE_LOWER, WIDE_UPPER)


def wide_lower(c: Column) -> Column:
    return F.translate(c, WIDE_UPPER, WIDE_LOWER)


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def graph_label(word: Column, n: Column) -> Column:
    return F.concat(F.lit('"'), word, F.lit("("), with_commas(n), F.lit(')"'))


def clean_query(c: Column) -> Column:
    """A query in full width without one closing mark at its end."""
    return to_wide(F.regexp_replace(c, r"[?？!！．。]$", ""))


def usable_definition(c: Column) -> Column:
    """Whether a definition can stand for its headword: nothing vague in it, and no mere kind of something."""
    body = F.regexp_replace(c, "。$", "")
    return ~body.rlike("物ごと|…") & ~body.rlike("の(?:一つ|一種)$")


def trim_definition(c: Column) -> Column:
    """A definition without its full stop and the nominal endings, applied one after another."""
    for pattern, to in (("。$", ""), ("のこと$", ""), ("こと$", ""), ("い所$", "い")):
        c = F.regexp_replace(c, pattern, to)
    return c


def headword(word: Column) -> Column:
    """The surface of a word: the parts before ``/`` of its ``+``-joined morphemes, without sense numbers."""
    base = F.regexp_replace(word, ":[0-9].*$", "")
    return F.array_join(F.transform(F.split(base, r"\+"), lambda m: F.split_part(m, F.lit("/"), F.lit(1))), "")


def morphemes(word: Column) -> Column:
    return F.size(F.split(word, r"\+"))


def base_of(word: Column) -> Column:
    """A word without its sense number."""
    return F.regexp_replace(word, "(?::[0-9]+/[0-9]+)+$", "")


def sense_of(word: Column) -> Column:
    """The sense number of a word with its colon, or an empty text."""
    return F.regexp_extract(word, "((?::[0-9]+/[0-9]+)+)$", 1)


def written(word: Column) -> Column:
    return F.split_part(base_of(word), F.lit("/"), F.lit(1))


def reading(word: Column) -> Column:
    """What follows ``/`` in a word, or an empty text."""
    return F.split_part(base_of(word), F.lit("/"), F.lit(2))


def is_acronym(long: Column, short: Column) -> Column:
    """One-morpheme case: the shorter one is the full-width capitals of the longer one, each followed by small letters."""
    a = F.when(F.length(long) >= F.length(short), long).otherwise(short)
    b = F.when(F.length(long) >= F.length(short), short).otherwise(long)
    shape = a.rlike("^(?:[Ａ-Ｚ][ａ-ｚ]+)+$") & b.rlike("^[Ａ-Ｚ]{2,}$")
    return shape & (F.regexp_replace(a, "[ａ-ｚ]", "") == b)


def is_initials(one: Column, many: Column) -> Column:
    """Several-morpheme case: a one-morpheme word made of the first characters of the morphemes of the other."""
    first = F.array_join(F.transform(F.split(many, r"\+"), lambda m: F.substring(m, 1, 1)), "")
    head = F.split_part(one, F.lit("/"), F.lit(1))
    return (morphemes(one) == 1) & (morphemes(many) > 1) & head.rlike("^[Ａ-ｚ]+$") & (head == first)


def has_subsequence(short: Column, long: Column) -> Column:
    """The characters of short occur in long in order, from its first on, yet not in one piece."""
    state = F.aggregate(
        F.split(long, ""),
        F.lit(0),
        lambda at, c: F.when((at < F.length(short)) & (F.substring(short, at + 1, F.lit(1)) == c) & (c != ""), at + 1).otherwise(at),
    )
    return (F.substring(short, 1, 1) == F.substring(long, 1, 1)) & (state == F.length(short)) & ~F.contains(long, short)


def common_tail(a: Column, b: Column) -> Column:
    """The longest common ending of two texts."""
    ra, rb = F.reverse(a), F.reverse(b)
    n = F.least(F.length(a), F.length(b))
    size = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda k, i: F.when((k == i - 1) & (F.substring(ra, i, F.lit(1)) == F.substring(rb, i, F.lit(1))), i).otherwise(k),
    )
    return F.reverse(F.substring(ra, F.lit(1), size))


def weighted_edit_distance(a: Column, b: Column, delete: float = 1.0, insert: float = 1.0, replace: float = 1.5) -> Column:
    """Edit distance with weights, inside the JVM: a fold of the table's rows over the characters of a."""
    chars = F.filter(F.split(b, ""), lambda c: c != "")
    first = F.transform(F.sequence(F.lit(0), F.size(chars)), lambda k: k.cast("double") * insert)

    def row(previous: Column, c: Column) -> Column:
        start = F.array(F.element_at(previous, 1) + delete)

        def cell(done: Column, k: Column) -> Column:
            same = F.element_at(chars, k) == c
            across = F.element_at(previous, k) + F.when(same, 0.0).otherwise(replace)
            return F.concat(done, F.array(F.least(across, F.element_at(previous, k + 1) + delete, F.element_at(done, k) + insert)))

        return F.when(F.size(chars) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(chars), F.lit(1))), start, cell))

    last = F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), first, row)
    return F.element_at(last, -1)


def normalised_distance(distance: Column, a: Column, b: Column) -> Column:
    return distance / (F.log(F.length(a)) + 1) / (F.log(F.length(b)) + 1)
