"""Visually identical text with different characters, brought to one form."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import Scratch, filled, lookup, ship

# Groups of characters that look the same, after canonical decomposition.
LOOK_ALIKE = (
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "FϜ", "GԌ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚК", "MМΜϺ", "NΝ", "OОΟ", "PРΡ", "QԚ", "SЅ", "TТΤ", "VѴ", "WԜ", "XХΧ", "YҮΥ", "ZΖ",
    "aа", "cсϲ", "dԁ", "eе", "hһ", "iі", "jјϳ", "lӏ", "oоο", "pр", "qԛ", "sѕ", "vνѵ", "wԝ", "xх", "yу",
    "ニ二", "ハ八", "エ工", "カ力", "ロ口", "タ夕", "ト卜", "ヘへ", "ー一", "ノ丿",
)
#: Scripts as the n-gram model has them; look-alike characters stand for themselves, all others for their script.
SCRIPTS = ("^", "LATIN", "CYRILLIC", "GREEK", "KATAKANA", "HIRAGANA", "CJK", "DIGIT", "OTHER")
#: Kinds of compatibility mappings that leave the look as it is; superscripts, circled or squared characters change it.
SAME_LOOK = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>"}
#: Scores of a bigram are log((count + SMOOTH) / (row total + SMOOTH x symbols)).
SMOOTH = 0.5
#: Salts over which the rows of one value are spread when pairs are written.
SALTS = 16

_IGNORED = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


@lru_cache(1)
def _tables() -> tuple[dict[int, str | None], dict[int, str]]:
    """What stands for a character before composition; the first member of each look-alike group for the others."""
    first: dict[int, str | None] = {}
    for k in [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]:
        c = chr(k)
        category = unicodedata.category(c)
        if k in _IGNORED or category == "Cf" or (category == "Cc" and not c.isspace()):
            first[k] = None
        elif category in ("Zs", "Zl", "Zp") or c.isspace():
            if c != " ":
                first[k] = " "
        elif (d := unicodedata.decomposition(c)) and d[0] == "<" and d.split()[0] in SAME_LOOK:
            to = unicodedata.normalize("NFKC", c)
            if not to.startswith(" "):  # a mark that stands alone stays as it is
                first[k] = to
    first[0xFF9E], first[0xFF9F] = "゙", "゚"
    return first, {ord(c): g[0] for g in LOOK_ALIKE for c in g[1:]}


def script(c: str) -> str:
    name = unicodedata.name(c, "").split(" ")[0]
    if name == "KATAKANA-HIRAGANA":
        return "KATAKANA"
    return name if name in SCRIPTS else "DIGIT" if c.isdigit() else "OTHER"


@lru_cache(1)
def _alphabet() -> tuple[dict[str, int], dict[str, tuple[str, ...]]]:
    """Symbols of the model, and what a group's first member may stand for. Its size is fixed by the tables above."""
    symbols = {s: k for k, s in enumerate(SCRIPTS)}
    for g in LOOK_ALIKE:
        for c in g:
            symbols.setdefault(c, len(symbols))
    return symbols, {g[0]: tuple(dict.fromkeys(g)) for g in LOOK_ALIKE}


def plain(text: str) -> str:
    """Compatibility normalisation that keeps the look, without ignorable characters, composed."""
    if text.isascii() and text.isprintable():
        return text
    first, _ = _tables()
    return unicodedata.normalize("NFC", text.translate(first))


def look(text: str) -> str:
    """One text for all that look the same: look-alike letters are replaced by the first of their group.

    Two texts look the same if and only if this is the same for both.
    """
    if text.isascii() and text.isprintable():
        return text
    first, alike = _tables()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(first)).translate(alike))


def _symbol_ids(points: np.ndarray, known: dict[int, int]) -> np.ndarray:
    symbols, _ = _alphabet()
    unique, back = np.unique(points, return_inverse=True)
    for u in unique.tolist():
        if u not in known:
            c = chr(u)
            known[u] = symbols[c] if c in symbols else symbols[script(unicodedata.normalize("NFD", c)[0])]
    return np.array([known[u] for u in unique.tolist()], np.int32)[back]


def bigram_counts(values: DataFrame) -> DataFrame:
    """(a, b, n): how often symbol b follows a in the normalised texts of the column ``value``; a is 0 at a text's start.

    Texts are counted as they are written. At most (symbols)^2 rows, a bound set by the tables and not by the data.
    """
    ship(values.sparkSession)
    size = len(_alphabet()[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(size * size, np.int64), {}
        for batch in batches:
            texts = [plain(t) for t in batch.column(0).to_pylist() if t]
            for k in range(0, len(texts), 20_000):
                points = np.frombuffer("\0".join(["", *texts[k : k + 20_000]]).encode("utf-32-le"), "<u4")
                ids = _symbol_ids(points, known)
                ids[points == 0] = 0
                inner = ids[1:] != 0
                total += np.bincount(ids[:-1][inner].astype(np.int64) * size + ids[1:][inner], minlength=size * size)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(total[at])], names=["a", "b", "n"])

    part = values.select("value").mapInArrow(work, "a int, b int, n bigint")
    return part.groupBy("a", "b").agg(F.sum("n").alias("n"))


def train(values: DataFrame) -> np.ndarray:
    """Log scores [symbol, next symbol] of the script-consistent model; its size is fixed (see :func:`bigram_counts`)."""
    size = len(_alphabet()[0])
    n = np.zeros((size, size))
    for r in bigram_counts(values).collect():
        n[r["a"], r["b"]] = r["n"]
    return np.log((n + SMOOTH) / (n.sum(1, keepdims=True) + SMOOTH * size)).astype(np.float32)


class Canonical:
    """Canonical forms by a Viterbi search over look-alike lattices, in matrices of texts of similar length."""

    def __init__(self, scores: np.ndarray):
        symbols, groups = _alphabet()
        self.scores = scores
        self.wide = max(map(len, groups.values()))
        self.options = {ord(k): [ord(c) for c in g] for k, g in groups.items()}
        self.ids = {ord(c): symbols[c] for g in LOOK_ALIKE for c in g}
        self.known: dict[int, int] = {}
        self.letters = np.array(sorted(self.options), np.uint32)

    def __call__(self, texts: list[str]) -> list[str]:
        """The canonical forms of looks (see :func:`look`): a function of the look alone, and never the same for two looks."""
        decomposed = [unicodedata.normalize("NFD", t) for t in texts]
        out = list(texts)
        length = np.fromiter(map(len, decomposed), np.int64, len(texts))
        order = np.argsort(length, kind="stable")
        k = 0
        while k < len(order):
            most = max(1, min(len(order) - k, 400_000 // (int(length[order[min(len(order) - 1, k + 4000)]]) + 1)))
            rows = order[k : k + min(most, 4000)]
            k += len(rows)
            self._search([decomposed[r] for r in rows], rows, out)
        return out

    def _search(self, texts: list[str], rows: np.ndarray, out: list[str]) -> None:
        width = max(map(len, texts), default=0)
        if not width:
            return
        flat = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), "<u4").reshape(len(texts), width)
        lattice = np.isin(flat, self.letters).any(1)
        if not lattice.any():
            return
        flat, rows, texts = flat[lattice], rows[lattice], [t for t, has in zip(texts, lattice) if has]
        n, options = len(texts), self.wide
        points = np.repeat(flat[:, :, None], options, 2)
        allowed = np.zeros(points.shape, bool)
        allowed[:, :, 0] = True
        for letter, stand in self.options.items():
            where = np.nonzero(flat == letter)
            for j, c in enumerate(stand):
                points[where[0], where[1], j] = c
                allowed[where[0], where[1], j] = True
        ids = _symbol_ids(points.reshape(-1), self.known).reshape(points.shape)
        state = np.where(allowed[:, 0], self.scores[0][ids[:, 0]], -np.inf)
        back = np.zeros((width, n, options), np.int8)
        for p in range(1, width):
            live = flat[:, p] != 0
            total = state[:, :, None] + self.scores[ids[:, p - 1, :, None], ids[:, p, None, :]]
            best = total.argmax(1)
            value = np.where(allowed[:, p], np.take_along_axis(total, best[:, None, :], 1)[:, 0], -np.inf)
            back[p] = np.where(live[:, None], best, np.arange(options))
            state = np.where(live[:, None], value, state)
        at = state.argmax(1)
        every = np.arange(n)
        chosen = np.zeros(flat.shape, "<u4")
        for p in range(width - 1, -1, -1):
            chosen[:, p] = points[every, p, at]
            at = back[p, every, at]
        for k, r in enumerate(rows):
            out[r] = unicodedata.normalize("NFC", chosen[k, : len(texts[k])].tobytes().decode("utf-32-le"))


def canonical_forms(values: DataFrame, model: np.ndarray, keep: list[str]) -> DataFrame:
    """(keep..., value, form): the canonical form of ``value`` in every row. Null stays null, empty stays empty."""
    ship(values.sparkSession)
    rows = values.select(*keep, "value")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", form string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical(model)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            looks = [None if t is None else look(t) for t in texts]
            different = list({t for t in looks if t})
            form = dict(zip(different, canonical(different)))
            forms = pa.array([form.get(t, t) for t in looks], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, forms], names=[*keep, "value", "form"])

    return rows.mapInArrow(work, schema)


def look_alike_pairs(fields: list[tuple[str, DataFrame]]) -> DataFrame:
    """(field, id1, id2): all pairs of rows whose values in a field look the same but are not the same characters.

    fields: the name of each field with its rows (id, value). All values get their canonical form: compatibility
    normalisation, deletion of ignorable characters, then for each token's look-alike letters the best path through their lattice
    under a character n-gram model of all these values, whose letters keep to one script. Rows agree in look if and only if
    they agree in form. Forms with one spelling only are dropped by counts that combine before the shuffle. The others' spellings are
    paired as values, and each pair of spellings is written out against its rows, so pairs of rows with the same characters are never
    made; the rows of a spelling are spread by salt. The result is as large as the data has such pairs.

    Null and empty values and rows without an id don't count. Empty tables give no rows. Ids are taken to be unique in a field.
    """
    spark: SparkSession = fields[0][1].sparkSession
    scratch = Scratch(spark, "looks")
    all_rows = None
    for name, df in fields:
        part = df.toDF("id", "value").filter(filled("value") & F.col("id").isNotNull()).select(F.lit(name).alias("field"), F.col("id").cast("long").alias("id"), "value")
        all_rows = part if all_rows is None else all_rows.unionByName(part)
    model = train(all_rows)
    forms = canonical_forms(all_rows, model, ["field", "id"])
    hashed = forms.select("field", "id", F.xxhash64("field", "form").alias("f"), F.xxhash64("value").alias("v"), "value")
    rows = scratch.write(hashed, "forms")
    per = rows.groupBy("f").agg(F.min("v").alias("v0"), F.max("v").alias("v1"), F.count(F.lit(1)).alias("n"))
    several = per.filter("v0 <> v1").select("f", F.lit(True).alias("several"), "n")
    exact = scratch.write(lookup(rows, several, "f", "n", rows.count()).select("field", "id", "f", "value"), "several")
    scratch.drop(rows)
    spelled = exact.groupBy("field", "f", "value").agg(F.count(F.lit(1)).alias("n"))
    spelled = scratch.write(canonical_forms(spelled, model, ["field", "f", "n"]), "spellings")
    x, y = spelled.alias("x"), spelled.alias("y")
    larger = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.value") < F.col("y.value")))
    pairs = x.join(y, (F.col("x.field") == F.col("y.field")) & (F.col("x.form") == F.col("y.form")) & larger).select(
        F.col("x.field").alias("field"), F.col("x.value").alias("many"), F.col("y.value").alias("few")
    )
    # every spelling with the more frequent ones it pairs with: hot ones are known, whether they have any or not
    named = F.concat_ws("\x00", "field", "value").alias("key")
    over = pairs.groupBy("field", F.col("few").alias("value")).agg(F.collect_list("many").alias("over"))
    over = spelled.select("field", "value", "n").join(over, ["field", "value"], "left").select(named, "over", "n")
    ids = exact.select("field", "value", "id")
    one = lookup(ids.select("field", F.col("id").alias("i"), named), over, "key", "n", exact.count())
    one = one.select("field", "i", F.explode("over").alias("many")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    other = ids.select("field", F.col("value").alias("many"), F.col("id").alias("j"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    return one.join(other, ["field", "many", "salt"]).select("field", F.least("i", "j").alias("id1"), F.greatest("i", "j").alias("id2"))
