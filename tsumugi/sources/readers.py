"""Readers of the text formats: parser output, raw lines, dictionaries, phrase XML, logs and edit databases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.runtime import ship
from ..operators.analyzer import parse_records


def _decoded(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """(file, ord, value) of files that aren't UTF-8. A file is decoded as one record, as its bytes can't be cut before."""
    ship(spark)
    raw = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = content.decode(encoding).split("\n")
                lines = lines[:-1] if lines[-1] == "" else lines
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(lines), pa.string()), pa.array(lines, pa.string())], names=["file", "value"])

    return raw.mapInArrow(work, "file string, value string")


def _text(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", line_sep: str | None = None) -> DataFrame:
    """(file, line, value): lines of text files with their place. Line breaks of both kinds end a line."""
    if encoding.upper() not in ("UTF-8", "UTF8"):
        raw = _decoded(spark, path, encoding)
    else:
        raw = (spark.read.option("lineSep", line_sep) if line_sep else spark.read).text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return raw.select("file", F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_parsed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Morphemes and phrases of parser output, a record up to each ``EOS``; see :func:`parse_records`. Empty records are skipped."""
    records = _text(spark, path, line_sep="EOS\n").filter(F.trim("value") != "")
    return parse_records(records.select(F.concat_ws(":", "file", "line").alias("record"), F.col("value").alias("text")))


def read_sentences(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, line, sentence): one sentence a line, without blank lines."""
    return _text(spark, path, encoding).filter(F.trim("value") != "").withColumnRenamed("value", "sentence")


def read_groups(spark: SparkSession, path: str | list[str], delimiter: str = r"\s+", encoding: str = "UTF-8") -> DataFrame:
    """(file, line_no, ord, word): a group of synonyms on each line."""
    t = _text(spark, path, encoding)
    words = F.filter(F.split("value", delimiter), lambda w: w != "")
    return t.select("file", F.col("line").alias("line_no"), F.posexplode(words).alias("ord", "word"))


def _fields(df: DataFrame, names: list[str], delimiter: str, limit: int = -1) -> DataFrame:
    parts = F.split("value", delimiter, limit)
    return df.filter(F.trim("value") != "").select("file", "line", *[F.try_element_at(parts, F.lit(k + 1)).alias(n) for k, n in enumerate(names)])


def read_definitions(spark: SparkSession, path: str | list[str], delimiter: str = " ", encoding: str = "UTF-8") -> DataFrame:
    """(file, def_id, head, def): the headword up to the first delimiter, then its definition."""
    return _fields(_text(spark, path, encoding), ["head", "def"], delimiter, 2).withColumnRenamed("line", "def_id")


def read_isa(spark: SparkSession, path: str | list[str], delimiter: str = " ", encoding: str = "UTF-8") -> DataFrame:
    """(file, line, hypo, hyper, num); num is null where a file has none or no number."""
    return _fields(_text(spark, path, encoding), ["hypo", "hyper", "num"], delimiter).withColumn("num", F.col("num").try_cast("int"))


def read_antonyms(spark: SparkSession, path: str | list[str], delimiter: str = " ", encoding: str = "UTF-8") -> DataFrame:
    """(file, line, w1, w2)."""
    return _fields(_text(spark, path, encoding), ["w1", "w2"], delimiter)


def read_ambiguous(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, raw): lines of ambiguous words, for the strict load."""
    return _text(spark, path).withColumnRenamed("value", "raw")


#: Kinds of user dictionaries, as their file names begin.
USER_KINDS = ("definition", "synonym", "isa", "antonym", "similarphrase")


def read_user_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Lines of a folder of user dictionaries named ``<kind>_<user>.txt`` as (kind, user, line, fields), and the files of unknown kinds as (file)."""
    t = _text(spark, f"{folder.rstrip('/')}/*.txt")
    kind = F.regexp_extract("file", r"^([^_/]+)_.*\.txt$", 1)
    known = t.filter(kind.isin(*USER_KINDS)).filter(F.trim("value") != "")
    rows = known.select(kind.alias("kind"), F.regexp_extract("file", r"^[^_/]+_(.*)\.txt$", 1).alias("user"), "line", F.split("value", "\t").alias("fields"))
    return rows, t.filter(~kind.isin(*USER_KINDS)).select("file").distinct()


def read_analyser_dictionary(spark: SparkSession, path: str | list[str], part_of_speech: str | None = None, top_form: bool = False) -> DataFrame:
    """(word, relation, other): synonyms (同義) and antonyms (反義) in the features of dictionary entries, every such feature of an entry.

    The key is the representative, or the first written form if asked for; entries without one are skipped.
    """
    t = _text(spark, path).filter(F.col("value").rlike("同義:|反義:"))
    key = F.regexp_extract("value", r"\(見出し語 \(?([^ ()]+)", 1) if top_form else F.regexp_extract("value", r'代表表記:([^"\s)]+)', 1)
    t = t.select(key.alias("word"), F.regexp_extract("value", r"^\(([^ ()]+)", 1).alias("pos"), F.regexp_extract_all("value", F.lit(r'((?:同義|反義):[^"\s)]+)'), F.lit(1)).alias("fs")).filter("word <> ''")
    if part_of_speech:
        t = t.filter(F.col("pos") == part_of_speech)
    each = t.select("word", F.explode("fs").alias("f"))
    value = F.explode(F.split(F.substring("f", 4, 100_000), ";"))
    out = each.select("word", F.substring("f", 1, 2).alias("relation"), value.alias("v")).select("word", "relation", F.element_at(F.split("v", ":"), -1).alias("other"))
    return out.filter("other <> ''").distinct()


def read_phrase_xml(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """(sid, bp, org_bp, id, fuzoku, negation, childbp) of phrase XML (``<i_data>`` with phrases of words), one row a name of a phrase.

    Phrases bound to the one before are skipped and the rest numbered anew. A phrase has a name for each combination of its words' normal
    forms, and one with its numerals as ``<num>`` where it has any. Honorific prefixes are dropped, 非 and 不 negate. With ``compat`` the
    negation is lost.
    """
    word = "struct<_lem:string,_pos:string,_content_p:int,_read:string,_kanou_norm:string,_sonkei_norm:string>"
    schema = f"_id string, phrase array<struct<_dpnd:int,_bond:int,_org_pnum:int,word:array<{word}>>>"
    raw = spark.read.format("xml").option("rowTag", "i_data").schema(schema).load(path)
    sent = raw.withColumn("sid", F.coalesce("_id", F.monotonically_increasing_id().cast("string"))).filter(F.size("phrase") > 0)
    p = sent.select("sid", F.posexplode("phrase").alias("org", "p")).filter("coalesce(p._bond, 0) <> 1")
    p = p.withColumn("bp", F.row_number().over(Window.partitionBy("sid").orderBy("org")) - 1)

    def is_(w: Column, kind: str) -> Column:
        lem, pos, c = w["_lem"], F.coalesce(w["_pos"], F.lit("")), F.coalesce(w["_content_p"], F.lit(0))
        mark = pos.rlike(":(?:句点|読点)")
        honorific, un = (c == -1) & lem.isin("お", "ご", "御"), (c == -1) & lem.isin("非", "不")
        noun_like = pos.rlike("^接尾辞:名詞性(?:名詞|特殊)") | ((pos == "接尾辞:名詞性述語接尾辞") & (F.coalesce(w["_read"], F.lit("")) == "かた"))
        name = ~mark & ~honorific & ~un & ((c != 0) | (pos == "名詞:形式名詞") | noun_like)
        no = ~mark & (un | (~name & ((pos.startswith("接尾辞") & (lem == "ない")) | ((pos == "助動詞") & (lem == "ぬ")))))
        return {"name": name, "no": no, "fuzoku": ~mark & ~honorific & ~name & ~no, "number": name & (pos == "名詞:数詞") & ~lem.isin("何", "幾")}[kind]

    names = F.filter("p.word", lambda w: is_(w, "name"))
    options = F.transform(names, lambda w: F.when(w["_kanou_norm"].isNotNull(), F.array(w["_kanou_norm"])).when(w["_sonkei_norm"].isNotNull(), F.split(w["_sonkei_norm"], ":")).otherwise(F.array(w["_lem"])))
    start = F.array(F.lit("")).cast("array<string>")
    crossed = F.aggregate(options, start, lambda done, o: F.flatten(F.transform(done, lambda a: F.transform(o, lambda x: F.concat(a, x)))))
    numbered = F.array_join(F.transform(names, lambda w: F.when(is_(w, "number"), "<num>").otherwise(w["_lem"])), "")
    has_number = F.exists("p.word", lambda w: is_(w, "number"))
    all_names = F.array_distinct(F.when(has_number, F.array_append(crossed, numbered)).otherwise(crossed))
    fuzoku = F.when(F.col("p._dpnd") != -1, F.array_join(F.transform(F.filter("p.word", lambda w: is_(w, "fuzoku")), lambda w: w["_lem"]), "")).otherwise("")
    negation = F.lit(False) if compat else F.exists("p.word", lambda w: is_(w, "no"))
    place = p.select("sid", F.col("org").alias("parent"), F.col("bp").alias("parentbp"))
    kids = p.select("sid", F.col("p._dpnd").alias("parent"), F.col("bp").alias("kid")).join(place, ["sid", "parent"]).groupBy("sid", F.col("parentbp").alias("bp")).agg(F.sort_array(F.collect_set("kid")).alias("childbp"))
    out = p.select("sid", "bp", F.coalesce("p._org_pnum", "org").alias("org_bp"), F.explode(all_names).alias("id"), fuzoku.alias("fuzoku"), negation.alias("negation"))
    return out.join(kids, ["sid", "bp"], "left").withColumn("childbp", F.coalesce("childbp", F.array().cast("array<int>")))


def read_merge_log(spark: SparkSession, path: str) -> DataFrame:
    """(block, ord, kind, text) of merge logs: deleted groups, the details of how a word was found, and the change that ends a block.

    A file is read as one record, since a block goes over lines.
    """
    whole = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    pattern = r"^(?:★(delete)|！(detail)|☆(change|add)) <?([^>]*)>?$"
    kind = F.concat(*[F.regexp_extract("line", pattern, k) for k in (1, 2, 3)])
    rows = whole.filter(F.col("line").rlike(pattern)).select("file", "ord", kind.alias("kind"), F.regexp_extract("line", pattern, 4).alias("text"))
    ended = F.sum(F.when(F.col("kind").isin("change", "add"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("file", F.coalesce(ended, F.lit(0)).cast("long").alias("block"), "ord", "kind", "text")


def log_links(log: DataFrame) -> DataFrame:
    """(w1, w2): the words that stand in one group of a merge log, for :func:`lexicon_etl.chains`."""
    g = log.filter("kind <> 'detail'").select(F.split("text", " ").alias("ws"))
    return g.select("ws", F.explode("ws").alias("w1")).select("w1", F.explode("ws").alias("w2")).filter("w1 < w2").distinct()


def read_edits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Manual edits from JSON lines: (kind, word, definition) of what was kept or added, and (head, word) of pairs marked as not to be used.

    An entry without a sense number and without the mark of ambiguity gets ``1/1:1/1``; entries nobody edited are skipped.
    """
    schema = "rep string, username string, ambiguity string, elements array<struct<word:string,id:string,type:string,origtype:string,definition:string>>, add map<string,string>"
    e = spark.read.schema(schema).json(path).filter("username is not null")
    el = e.select("rep", F.explode("elements").alias("e"))
    used = el.filter("e.type <> 'nouse'")
    kind = F.when(F.col("e.origtype") == "definition", "definition").otherwise(F.col("e.type"))
    own = used.select(kind.alias("kind"), F.concat_ws(":", "e.word", "e.id").alias("word"), F.col("e.definition").alias("definition"))
    ids = F.filter(F.transform(F.coalesce("elements", F.array()), lambda x: x["id"]), lambda x: x.isNotNull())
    sense = F.coalesce(F.try_element_at(ids, F.lit(-1)), F.when(F.col("ambiguity").isNull(), "1/1:1/1"))
    added = e.select("rep", sense.alias("sense"), F.explode("add").alias("kind", "definition")).select("kind", F.concat_ws(":", "rep", "sense").alias("word"), "definition")
    return own.unionByName(added), el.filter("e.type = 'nouse'").select(F.col("rep").alias("head"), "e.word")


def by_ids(graphs: DataFrame, ids: DataFrame) -> DataFrame:
    """The graphs with exactly these sentence ids. ids: (sid)."""
    return graphs.join(ids.select("sid").distinct(), "sid", "left_semi")


def by_documents(graphs: DataFrame, ids: DataFrame) -> DataFrame:
    """All sentences of these documents: the id up to the comma. ids: (doc_id)."""
    return graphs.withColumn("_doc", F.split_part("sid", F.lit(","), F.lit(1))).join(ids.select(F.col("doc_id").alias("_doc")).distinct(), "_doc", "left_semi").drop("_doc")


def id_list(graphs: DataFrame) -> DataFrame:
    return graphs.select("sid").distinct().orderBy("sid")


def first_of(stores: list[DataFrame], key: str) -> DataFrame:
    """Of each key the row of the first store that has it."""
    ranked = None
    for k, s in enumerate(stores):
        part = s.withColumn("_store", F.lit(k))
        ranked = part if ranked is None else ranked.unionByName(part)
    rest = [c for c in ranked.columns if c not in (key, "_store")]
    return ranked.groupBy(key).agg(F.min(F.struct("_store", *rest)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])
