import pytest
from pyspark.sql import functions as F

from tsumugi.engine import SynonymEngine
from tsumugi.functions import strings as S
from tsumugi.functions.config import EngineConfig, NodeOptions
from tsumugi.functions.schema import exploded, nested
from tsumugi.operators import annotate as A
from tsumugi.operators import isa_tree as T
from tsumugi.operators import lexicon_etl as E
from tsumugi.operators import retrieval as R
from tsumugi.operators import similarity as M
from tsumugi.operators.analyzer import adjective_stem, alternatives, article_of, chain_trees, generalise_numbers, keywords, listed_alternatives, virtual_edges, without_semi_content
from tsumugi.operators.tree_match import LocalLexicon, Node, annotate, chain, similarity
from tsumugi.sources import readers, writers
from tsumugi.streaming.annotate_stream import annotate_stream, windowed_counts, word_nodes

RECORD = """# S-ID:article-1 SCORE:3
* 2D <体言>
+ 2D <体言><係:ニ格>
ホテル ほてる ホテル 名詞 6 普通名詞 1 * 0 * 0 "代表表記:ホテル/ほてる" <代表表記:ホテル/ほてる><内容語>
に に に 助詞 9 格助詞 1 * 0 * 0 NIL <付属>
* 2D <副詞>
+ 2D <副詞>
一番 いちばん 一番 副詞 8 * 0 * 0 * 0 "代表表記:一番/いちばん" <代表表記:一番/いちばん><内容語>
* 3D <用言:形>
+ 3D <用言:形><格解析結果:近い/ちかい:形9:ガ/N/駅/3/0/1;ニ/C/ホテル/0/0/1;ト/U/-/-/-/-;修飾/C/一番/1/0/1>
近い ちかい 近い 形容詞 3 * 0 イ形容詞アウオ段 18 基本形 2 "代表表記:近い/ちかい" <代表表記:近い/ちかい><内容語>
* -1D <体言>
+ -1D <体言><格解析結果:駅/えき:判0:ガ/U/-/-/-/->
駅 えき 駅 名詞 6 普通名詞 1 * 0 * 0 "代表表記:駅/えき" <代表表記:駅/えき><内容語>
"""

LINES = """!! 0 1,2/2D <見出し:ホテルに><格解析結果:ニ格>
! 0 <SYNID:ホテル/ほてる><スコア:1>
! 0 <SYNID:s1937:ホテル/ほてる><スコア:0.99>
! 0 <SYNID:s9230:宿泊施設><スコア:0.99>
! 0 <SYNID:s252:宿/やど><スコア:0.693><上位語><下位語数:1>
!! 1 2D <見出し:一番><格解析結果:修飾格>
! 1 <SYNID:一番/いちばん><スコア:1>
! 1 <SYNID:s582:トップ/とっぷ><スコア:0.99>
!! 2 3D <見出し:近い>
! 2 <SYNID:近い/ちかい><スコア:1>
! 2 <SYNID:s13:付近/ふきん><スコア:0.99>
! 2 <SYNID:s465:近い/ちかい><スコア:0.99>
!! 1,2 3D <見出し:近い>
! 1,2 <SYNID:s13:付近/ふきん><スコア:0.99>
!! 3 -1D <見出し:駅>
! 3 <SYNID:駅/えき><スコア:1>
! 3 <SYNID:s2332:停車場/ていしゃば><スコア:0.99>""".split("\n")


def lexicon(spark, members, parents=(), antonyms=()):
    m = spark.createDataFrame([(s, w.split(" ")) for s, w in members], "synid string, words array<string>")
    both = [*antonyms, *((b, a) for a, b in antonyms)]
    return A.Lexicon(m, spark.createDataFrame(list(parents), "synid string, parent string, hypo_num int"), spark.createDataFrame(both, "synid string, other string"))


def test_annotated_text_of_parser_output(spark, tmp_path):
    (tmp_path / "parsed.txt").write_text(RECORD + "EOS\n" + RECORD.replace("article-1", "article-2") + "EOS\n")
    words = keywords(readers.read_parsed(spark, str(tmp_path / "parsed.txt")))
    assert {x["sid"] for x in words.collect()} == {"article-1", "article-2"}
    lex = lexicon(
        spark,
        [("s1937:ホテル/ほてる", "ホテル/ほてる"), ("s9230:宿泊施設", "ホテル/ほてる"), ("s582:トップ/とっぷ", "一番/いちばん"), ("s465:近い/ちかい", "近い/ちかい"), ("s13:付近/ふきん", "近い/ちかい"),
         ("s13:付近/ふきん", "一番/いちばん 近い/ちかい"), ("s2332:停車場/ていしゃば", "駅/えき")],
        [("s1937:ホテル/ほてる", "s252:宿/やど", 1)],
    )
    nodes = A.attach(words.select("sid", "bp", "id", "parentbp", "childbp"), lex, NodeOptions(antonyms=False))
    phrases = words.select("sid", "bp", "parentbp", "dpndtype", "midasi", "case")
    got = writers.annotated_blocks(nodes, phrases).filter("sid = 'article-1'").orderBy("bp", "ord").collect()
    by_bp = {}
    for x in got:
        by_bp.setdefault(x["bp"], []).append(x["line"])
    assert sorted(x["line"] for x in got) == sorted(LINES)
    assert by_bp[0] == LINES[:5] and by_bp[3] == LINES[-3:] and by_bp[2][:4] == LINES[8:12]
    assert spark.createDataFrame([("article-12",), ("x",)], "s string").select(article_of(F.col("s")).alias("a")).collect()[0]["a"] == "article"


@pytest.fixture(scope="module")
def small(spark):
    from tsumugi.plans.fixtures import lexicon as fixture

    return fixture(spark)


EXPECTED = {
    ("large bolt", 0): {"large": 1, "g3": 0.99, "small": 0.792},
    ("large bolt", 1): {"bolt": 1, "g1": 0.99, "fastener": 0.693},
    ("old plate", 0): {"old": 1, "new": 0.8},
}


def named(nodes):
    out = {}
    for x in nodes.collect():
        out.setdefault((x["sid"], x["bp"]), {})[(x["id"], len(x["matchbp"]))] = round(x["score"], 6)
    return out


def test_nodes_of_a_small_lexicon(spark, small):
    rows = spark.createDataFrame([("large bolt",), ("small widget",), ("old plate",), ("",), (None,), ("x " * 300 + "bolt",), ("bolt",), ("bolt",)], "t string").withColumn("sid", F.col("t"))
    trees = chain_trees(rows, "sid", F.filter(F.split("t", " "), lambda w: w != ""))
    got = named(A.attach(trees, small))
    for key, nodes in EXPECTED.items():
        assert {i: s for (i, n), s in got[key].items()} == nodes
    assert got["small widget", 1] == {("widget", 0): 1, ("item", 0): 0.7, ("g4", 1): 0.99, ("item", 1): 0.693}
    assert got["old plate", 1] == {("plate", 0): 1, ("g5", 1): 0.99, ("item", 1): 0.693}
    engine = SynonymEngine(spark, small, EngineConfig())
    assert named(engine.annotate(trees, any_length=True)) == got
    assert named(A.attach(trees.limit(0), small)) == {}
    again = named(exploded(nested(A.attach(trees, small))))
    assert again == got


def test_more_entries_never_remove_nodes(spark, small):
    trees = chain_trees(spark.createDataFrame([("small widget",), ("new plate",)], "t string"), "t", F.split("t", " "))
    before = named(A.attach(trees, small))
    more = A.Lexicon(small.members.unionByName(spark.createDataFrame([("g7", ["widget"]), ("g8", ["g7"])], "synid string, words array<string>")), small.parents, small.antonyms)
    after = named(A.attach(trees, more))
    for key, nodes in before.items():
        assert nodes.items() <= after[key].items()
    assert after["small widget", 1]["g8", 0] == pytest.approx(0.9801)  # a group's id is a key itself


def test_trees_of_three_words():
    member = chain(["very", "old", "plate"])
    lex = LocalLexicon({"plate": [("g", member)]}, {"g": [("thing", 3)]}, {})
    out = annotate(chain(["a", "very", "old", "plate"]), lex, NodeOptions())
    ids = {(n.id, tuple(sorted(n.covers))): round(n.score, 4) for n in out[3]}
    assert ids == {("plate", ()): 1, ("g", (1, 2)): 0.99, ("thing", (1, 2)): 0.693}
    assert [n.children for n in out[3] if n.id == "g"] == [(0,)]
    assert "g" not in {n.id for n in annotate(chain(["very", "plate"]), lex, NodeOptions())[1]}


def test_features_at_the_head_and_below():
    def tree(head=None, child=None):
        t = chain(["a", "b"])
        t[1][0].traits, t[0][0].traits = head or {}, child or {}
        return t

    plain = tree()
    assert similarity(plain, tree()) == 1
    assert similarity(tree(child={"negation": True}), plain) == pytest.approx(0.65)
    assert similarity(tree(child={"negation": True, "ukemi": True}), plain) == pytest.approx((1 + 0.09) / 2)
    assert similarity(tree(child={"case": "ガ"}), plain) == 1  # a case on one side costs nothing
    assert similarity(tree(child={"case": "ガ"}), tree(child={"case": "ヲ"})) == pytest.approx(0.65)
    assert similarity(plain, tree(head={"fuzoku": "は"})) is None
    assert similarity(chain(["b"]), plain) is None and similarity(plain, chain(["b"])) == 1
    assert similarity([], plain) is None
    lex = LocalLexicon({"b": [("g", [[Node("b")]])]}, {}, {})
    negated = [[Node("b", traits={"negation": True})]]
    assert [bool(n.trait("negation")) for n in annotate(negated, lex, NodeOptions())[0]] == [True, True]


def test_negation_and_antonyms_cancel(spark):
    lex = LocalLexicon({"best": [("g1", [[Node("best")]])]}, {}, {"g1": ["worst"]})
    nodes = annotate([[Node("best")]], lex, NodeOptions())[0]
    worst = next(n for n in nodes if n.id == "worst")
    assert worst.antonym and worst.trait("negation") and round(worst.score, 4) == 0.792
    denied = annotate([[Node("best", traits={"negation": True})]], lex, NodeOptions())[0]
    assert not next(n for n in denied if n.id == "worst").trait("negation")


def test_recursive_hypernyms_and_cuts(spark):
    lex = lexicon(spark, [("g1", "rod")], [("g1", "fastener", 2), ("fastener", "item", 40), ("item", "fastener", 1)])
    trees = chain_trees(spark.createDataFrame([("rod",)], "t string"), "t", F.split("t", " "))
    ids = lambda o: {x["id"] for x in A.attach(trees, lex, o).collect()}
    assert ids(NodeOptions()) == {"rod", "g1", "fastener"}
    assert ids(NodeOptions(recursive=True)) == {"rod", "g1", "fastener", "item"}
    assert ids(NodeOptions(max_hyponyms=1)) == {"rod", "g1"}
    assert ids(NodeOptions(hypernyms=False)) == {"rod", "g1"}


def test_exact_retrieval():
    assert R.exact_score(chain(["a", "b"]), chain(["a", "b"])) == 1
    assert R.exact_score(chain(["b"]), chain(["c"])) == 0
    assert R.exact_score([], chain(["c"])) == 0
    one, two = R.exact_score(chain(["a", "b"]), chain(["x", "b"])), R.exact_score(chain(["a", "b"]), chain(["b"]))
    assert 0 < one < two < 1
    denied = chain(["a", "b"])
    denied[1][0].traits = {"negation": True}
    assert R.exact_score(denied, chain(["a", "b"])) < 0.8
    sibling = [[Node("b", relation=True)]]
    assert R.exact_score(sibling, [[Node("b", relation=True)]]) == 0
    compared, other = chain(["x"]), chain(["x"])
    for t, cs in ((compared, ("ガ", "ヲ")), (other, ("ヲ", "ガ"))):
        t[:] = [[Node("p", traits={"case": cs[0]})], [Node("q", traits={"case": cs[1]})], [Node("v", children=(0, 1), traits={"ukemi": True} if cs[0] == "ガ" else {})]]
    assert R.exact_score(compared, other) == 1  # two case differences explain a passive


def test_search(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["x"]), (4, []), (5, ["y"]), (6, ["a", "b"]), (7, ["w"])], "doc_id bigint, words array<string>")
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["nothing"])], "query bigint, words array<string>")
    got = [(x["query"], x["doc_id"], x["rank"]) for x in R.search(queries, docs).orderBy("rank").collect()]
    assert got[:2] == [(1, 1, 1), (1, 6, 2)] and {g[0] for g in got} == {1}


def one(spark, column, **values):
    names = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, S.to_wide(a), a="Ab 1\\\"'`-~") == "Ａｂ　１￥”’‘−〜"
    assert one(spark, S.wide_upper(a), a="ａＢc") == "ＡＢc"
    assert one(spark, S.wide_lower(a), a="ＡbＣ") == "ａbｃ"
    assert one(spark, S.graph_label(a, F.col("n")), a="駅", n=1234567) == '"駅(1,234,567)"'
    assert one(spark, S.clean_query(a), a="駅は?？") == "駅は？"
    for text, out in (("走ること。", "走る"), ("駅のこと。", "駅"), ("遠い所", "遠い"), ("こと", ""), ("", "")):
        assert one(spark, S.trim_definition(a), a=text) == out
    assert not one(spark, S.usable_definition(a), a="果物の一種。") and one(spark, S.usable_definition(a), a="果物。")
    assert one(spark, S.headword(a), a="停車/ていしゃ+場/じょう:1/1:1/2") == "停車場"
    assert one(spark, S.is_acronym(a, b), a="ＯｒａｃｌｅＡｐｉ", b="ＯＡ") and not one(spark, S.is_acronym(a, b), a="ＯｒａｃｌｅＡｐｉ", b="ＯＢ")
    assert one(spark, S.is_initials(a, b), a="ＯＡ", b="Ｏｆｆｉｃｅ+Ａｕｔｏ") and not one(spark, S.is_initials(a, b), a="ＯＡ", b="Ｏｆｆｉｃｅ")
    assert one(spark, S.has_subsequence(a, b), a="日銀", b="日本銀行") and not one(spark, S.has_subsequence(a, b), a="日本", b="日本銀行")
    assert one(spark, S.common_tail(a, b), a="国際空港", b="関西空港") == "空港" and one(spark, S.common_tail(a, b), a="", b="x") == ""
    assert one(spark, S.weighted_edit_distance(a, b), a="ＥＵ", b="ＥＣ") == 1.5
    assert one(spark, S.normalised_distance(S.weighted_edit_distance(a, b), a, b), a="ＥＵ", b="ＥＣ") == pytest.approx(0.523241082580591)
    for x, y, d in (("", "ab", 2), ("ab", "", 2), ("", "", 0), ("kitten", "sitting", 4)):
        assert one(spark, S.weighted_edit_distance(a, b), a=x, b=y) == d
    assert one(spark, generalise_numbers(a), a="３+人/にん") == "<num>+人/にん"
    options = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")), F.array(F.lit("d"), F.lit("e")))
    assert one(spark, alternatives(options), a="x") == ["a+c+d", "a+c+e", "b+c+d", "b+c+e"]


def test_lexicon_goldens(spark):
    g = [(1, "書籍/しょせき:1/1:1/1 本/ほん 書物/しょもつ 図書/としょ"), (2, "書物/しょもつ:1/1:1/1 本/ほん 書籍/しょせき"), (3, "犬 いぬ い"), (4, "い う"), (5, None), (6, "")]
    groups = E.read_groups(spark.createDataFrame(g, "k bigint, line string"), "k", "line")
    assert {x["line_no"]: x["n_words"] for x in E.limit_groups(groups).collect()} == {1: 4, 2: 3, 3: 3, 4: 2}
    ids = {x["line_no"]: x["synid"] for x in E.create_groups(groups).collect()}
    assert ids == {1: "s1:書籍/しょせき:1/1:1/1", 2: "s2:書物/しょもつ:1/1:1/1", 3: "s3:犬", 4: "s4:い"}
    none = spark.createDataFrame([], "word string")
    assert {x["line_no"] for x in E.change_words(groups, none).collect()} == {1, 2}  # short kana are deleted
    fits = spark.createDataFrame([("本/ほん", "本"), ("本/ほん:1/1:1/1", "本/ほん"), ("本/ほん:1/1:1/1", "本/ほん:1/1:1/2"), ("ほん", "本/ほん"), ("本", "水")], "a string, b string")
    assert [x["f"] for x in fits.select(M.compatible(F.col("a"), F.col("b")).alias("f")).collect()] == [True, True, False, True, False]
    assert fits.select(M.richer(F.col("a"), F.col("b")).alias("r")).first()["r"] == "本/ほん"
    words = spark.createDataFrame([("元・プロ・野球・選手",), ("イン・トン",), (None,)], "word string")
    got = {(x["hypo"], x["hyper"]) for x in E.compound_isa(words).collect()}
    assert got == {("元プロ野球選手", "プロ野球選手"), ("プロ野球選手", "野球選手"), ("野球選手", "選手")}


def test_synonyms_and_antonyms(spark):
    pairs = spark.createDataFrame([("a+x", "b+x"), ("a+x", "c+x"), ("平等", "不平等"), ("hot+x", "cold+x"), ("hot+hot", "cold+cold"), ("a", "a+b"), ("s1", "s2")], "w1 string, w2 string")
    syn, ant = spark.createDataFrame([("b", "a")], "w1 string, w2 string"), spark.createDataFrame([("cold", "hot")], "w1 string, w2 string")
    sets = spark.createDataFrame([("s1", "k"), ("s2", "k"), (None, "k")], "word string, set_id string")
    yes = {(x["w1"], x["w2"]) for x in M.is_synonym(pairs, syn, sets).collect() if x["synonym"]}
    assert yes == {("a+x", "b+x"), ("s1", "s2")}
    yes = {(x["w1"], x["w2"]) for x in M.is_antonym(pairs, ant, syn, sets).collect() if x["antonym"]}
    assert yes == {("平等", "不平等"), ("hot+x", "cold+x")}


def test_components_of_groups(spark):
    rows = [(k, 0, f"w{k}:1/1") for k in range(1, 41)] + [(k, 1, f"w{k + 1}:1/1") for k in range(1, 41)] + [(90, 0, "w1"), (91, 0, "q:1/1"), (95, 0, "q:1/1"), (95, 1, None)]
    got = {x["line_no"]: x["component"] for x in E.connected_groups(spark.createDataFrame(rows, "line_no bigint, ord int, word string").filter("word is not null")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 90: 90, 91: 91, 95: 91}


def test_pairs_of_large_groups(spark):
    words = [f"w{k:02d}" for k in range(41)]
    groups = spark.createDataFrame([(1, k, w) for k, w in enumerate(words)] + [(2, 0, "w00"), (2, 1, "x"), (2, 2, "x")], "line_no bigint, ord int, word string")
    wanted = {(1, a, b) for a in words for b in words if a < b} | {(2, "w00", "x")}
    got = [tuple(x) for x in E.group_pairs(groups).collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    pairs = spark.createDataFrame([(1, "w40", "w00"), (2, "w01", "x"), (3, "x", "w00"), (4, "w00", "w00"), (5, None, "w00"), (6, "w07", "zz")], "pair_id bigint, w1 string, w2 string")
    met = E.pairs_in_groups(pairs, groups)
    assert {tuple(x) for x in met.collect()} == {("w00", "w40"), ("w00", "x")}
    assert {x["pair_id"] for x in E.without_pairs(pairs, met).collect()} == {2, 4, 5, 6}


def test_near_cliques(spark):
    groups = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "c"), (3, 0, "a"), (3, 1, "d")], "line_no bigint, ord int, word string")
    got = {x["line_no"]: (x["joins"], x["n"]) for x in E.near_cliques(groups, spark.createDataFrame([("b", "c")], "w1 string, w2 string")).collect()}
    assert got == {1: (2, 1), 2: (1, 1)}


def test_near_cliques_of_large_groups(spark):
    large = [f"w{k:02d}" for k in range(41)]
    rows = [(1, k, w) for k, w in enumerate(large)] + [(2, 0, "w00"), (2, 1, "x"), (3, 0, "x"), (3, 1, "w00"), (3, 2, "y")]
    groups = spark.createDataFrame(rows, "line_no bigint, ord int, word string")
    links = [("x", "w05"), ("w06", "x"), ("x", "w00"), ("zz", "x")] + [(w, "y") for w in large[1:]]
    got = {x["line_no"]: (x["joins"], x["n"]) for x in E.near_cliques(groups, spark.createDataFrame(links, "w1 string, w2 string")).collect()}
    assert got == {1: (3, 1), 2: (1, 1), 3: (1, 1)}


def test_chains_of_any_length(spark):
    links = [(f"w{k:02d}", f"w{k + 1:02d}") for k in range(12)] + [("w00", "z"), ("z", "w02"), ("q", "r"), ("w05", "w05"), (None, "w01"), ("", "w02")]
    near = {}
    for a, b in links:
        if a and b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    wanted = {}
    for start in ("w00", "q", "lonely"):
        level = {start: [start]}
        while level:
            wanted.update({(start, w): p for w, p in level.items()})
            level = {w: min(p + [w] for x, p in level.items() if w in near.get(x, ())) for w in {y for x in level for y in near.get(x, ())} if (start, w) not in wanted}
    table, starts = spark.createDataFrame(links, "w1 string, w2 string"), spark.createDataFrame([("w00",), ("q",), ("lonely",), (None,), ("q",)], "word string")
    rows = E.chains(table, starts).collect()
    got = {(x["start"], x["word"]): x["path"] for x in rows}
    assert len(rows) == len(wanted) and got == wanted and all(x["steps"] == len(x["path"]) - 1 for x in rows)
    assert got["w00", "w12"] == [f"w{k:02d}" for k in range(13)]
    targets = spark.createDataFrame([("w00", "w07"), ("w00", "q"), ("q", "r"), ("lonely", "q")], "start string, word string")
    assert {(x["start"], x["word"]): x["path"] for x in E.chains(table, starts, targets).collect()} == {k: wanted[k] for k in (("w00", "w07"), ("q", "r"))}


def test_coordinates(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("e", "c"), ("x", "y"), ("y", "x")], "child string, parent string")
    cut = T.without_two_cycles(e)
    assert cut.count() == 4
    got = {(x["word"], x["other"]) for x in T.coordinates(cut, spark.createDataFrame([("b",), ("e",), ("zz",)], "word string")).collect()}
    assert got == {("b", "c"), ("b", "e"), ("e", "b"), ("e", "d")}
    assert {x["word"]: x["n_coordinate"] for x in T.coordinate_counts(cut).collect()} == {"b": 2, "c": 2, "d": 2, "e": 2}


def test_readers(spark, tmp_path):
    def put(name, text, encoding="utf-8"):
        (tmp_path / name).write_bytes(text.encode(encoding))
        return str(tmp_path / name)

    assert [x["sentence"] for x in readers.read_sentences(spark, put("s.txt", "駅です。\r\n\n 次\n")).collect()] == ["駅です。", " 次"]
    assert [x["sentence"] for x in readers.read_sentences(spark, put("e.txt", "駅です。\n", "euc_jp"), "EUC-JP").collect()] == ["駅です。"]
    assert [x["word"] for x in readers.read_groups(spark, put("g.txt", "犬 いぬ\n猫\tねこ\n")).orderBy("line_no", "ord").collect()] == ["犬", "いぬ", "猫", "ねこ"]
    assert [tuple(x)[2:] for x in readers.read_isa(spark, put("i.txt", "犬 動物 3\n猫 動物\n鳥 動物 x\n")).collect()] == [("犬", "動物", 3), ("猫", "動物", None), ("鳥", "動物", None)]
    assert [tuple(x)[2:] for x in readers.read_definitions(spark, put("d.txt", "犬 吠える もの。\n")).collect()] == [("犬", "吠える もの。")]
    assert [tuple(x)[2:] for x in readers.read_antonyms(spark, put("a.txt", "上 下\n")).collect()] == [("上", "下")]
    dictionary = '(名詞 (普通名詞 ((読み いい) (見出し語 最善) (意味情報 "代表表記:最善/さいぜん 反義:名詞:最悪/さいあく;名詞:最低/さいてい 同義:名詞:最良/さいりょう"))))\n'
    got = {(x["word"], x["relation"], x["other"]) for x in readers.read_analyser_dictionary(spark, put("j.dic", dictionary)).collect()}
    assert got == {("最善/さいぜん", "反義", "最悪/さいあく"), ("最善/さいぜん", "反義", "最低/さいてい"), ("最善/さいぜん", "同義", "最良/さいりょう")}
    log = readers.read_merge_log(spark, put("log.txt", "★delete <a b>\n！detail b→b:1/1\n☆change <a b c>\nx\n★delete <d e>\n☆add <d e a>\n"))
    assert [(x["block"], x["kind"]) for x in log.orderBy("ord").collect()] == [(0, "delete"), (0, "detail"), (0, "change"), (1, "delete"), (1, "add")]
    steps = {(x["start"], x["word"]): x["steps"] for x in E.chains(readers.log_links(log), spark.createDataFrame([("c",)], "word string")).collect()}
    assert steps["c", "a"] == 1 and steps["c", "e"] == 2
    (tmp_path / "user").mkdir()
    put("user/synonym_kim.txt", "犬\tいぬ\n")
    put("user/other_kim.txt", "x\n")
    rows, unknown = readers.read_user_folder(spark, str(tmp_path / "user"))
    assert [tuple(x) for x in rows.select("kind", "user", "fields").collect()] == [("synonym", "kim", ["犬", "いぬ"])]
    assert [x["file"] for x in unknown.collect()] == ["other_kim.txt"]
    edits = put("edits.json", '{"rep":"犬/いぬ","username":"kim","elements":[{"word":"狗","id":"1/1:1/2","type":"synonym"},{"word":"猫","type":"nouse"}],"add":{"isa":"動物"}}\n{"rep":"猫","elements":[]}\n{"rep":"鳥","username":"k","add":{"synonym":"とり"}}\n')
    kept, banned = readers.read_edits(spark, edits)
    assert {tuple(x) for x in kept.collect()} == {("synonym", "狗:1/1:1/2", None), ("isa", "犬/いぬ:1/1:1/2", "動物"), ("synonym", "鳥:1/1:1/1", "とり")}
    assert [tuple(x) for x in banned.collect()] == [("犬/いぬ", "猫")]


def test_phrase_xml(spark, tmp_path):
    xml = """<x><i_data id="t1"><phrase dpnd="2" org_pnum="5"><word lem="お" pos="接頭辞" content_p="-1"/><word lem="三" pos="名詞:数詞" content_p="1"/><word lem="人" pos="接尾辞:名詞性名詞" content_p="0"/><word lem="が" pos="助詞" content_p="0"/></phrase>
<phrase dpnd="2" bond="1"><word lem="z" pos="名詞" content_p="1"/></phrase>
<phrase dpnd="-1"><word lem="書ける" pos="動詞" content_p="1" kanou_norm="書く"/><word lem="ない" pos="接尾辞:形容詞性述語接尾辞" content_p="0"/><word lem="。" pos="特殊:句点" content_p="0"/></phrase></i_data></x>"""
    (tmp_path / "p.xml").write_text(xml)
    got = {(x["bp"], x["org_bp"], x["id"], x["fuzoku"], x["negation"], tuple(x["childbp"])) for x in readers.read_phrase_xml(spark, str(tmp_path / "p.xml")).collect()}
    assert got == {(0, 5, "三人", "が", False, ()), (0, 5, "<num>人", "が", False, ()), (1, 2, "書く", "", True, (0,))}


def test_stores_and_writers(spark, tmp_path, small):
    engine = SynonymEngine(spark, small)
    engine.save(str(tmp_path / "lex"))
    again = SynonymEngine.load(spark, str(tmp_path / "lex"))
    assert sorted(map(tuple, again.lexicon.parents.collect())) == sorted(map(tuple, small.parents.collect()))
    index = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 1.25), ("b", 1, 0.125)], "id string, doc_id bigint, score double")
    writers.write_index(writers.merge_indexes([index, index.limit(0)]), str(tmp_path / "index"))
    back = spark.read.parquet(str(tmp_path / "index")).select("id", "doc_id", "score")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, index.collect()))
    assert {x["id"]: x["postings"] for x in writers.posting_text(index).collect()} == {"a": "2:1.2500|1:0.5000", "b": "1:0.1250"}
    heads = spark.createDataFrame([("w", 1, "m2"), ("w", 0, "m1")], "node_id string, child_num int, mid string")
    assert writers.head_index_text(heads).first()["entries"] == "m1%0|m2%1"
    graphs = spark.createDataFrame([("d1,1", 1), ("d1,2", 2), ("d10,1", 3)], "sid string, x int")
    writers.append_graphs(graphs, str(tmp_path / "graphs"))
    writers.append_graphs(graphs.limit(0), str(tmp_path / "graphs"))
    stored = spark.read.parquet(str(tmp_path / "graphs"))
    assert readers.by_documents(stored, spark.createDataFrame([("d1",)], "doc_id string")).count() == 2
    assert readers.by_ids(stored, spark.createDataFrame([("d10,1",)], "sid string")).first()["x"] == 3
    assert [x["sid"] for x in readers.id_list(stored).collect()] == ["d1,1", "d1,2", "d10,1"]
    first = readers.first_of([spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")], "k")
    assert sorted(map(tuple, first.collect())) == [("a", 1), ("b", 3)]
    writers.write_shards(spark.range(2500).select(F.col("id").cast("string").alias("value")).coalesce(1), str(tmp_path / "shards"), 1000)
    assert len(list((tmp_path / "shards").glob("*.txt"))) == 3
    nodes = A.attach(chain_trees(spark.createDataFrame([("red bolt",)], "t string"), "t", F.split("t", " ")), small)
    assert writers.dump(nodes).first()["line"] == "cold|g6|red bolt|fastener|g1"
    assert writers.inline_features(nodes).filter("bp = 1").first()["features"].startswith("<SYNID:bolt/1.0><SYNID:g1/0.99>")


def test_streams(spark, tmp_path, small):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("1", "large bolt"), ("2", "small widget"), ("3", "")], "sid string, t string").write.parquet(folder)
    stream = spark.readStream.schema("sid string, t string").parquet(folder)
    got = []
    q = annotate_stream(stream, "sid", F.filter(F.split("t", " "), lambda w: w != ""), small, lambda df, k: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    batch = A.attach(chain_trees(spark.read.parquet(folder), "sid", F.filter(F.split("t", " "), lambda w: w != "")), small)
    key = lambda rows: sorted((x["sid"], x["bp"], x["id"], round(x["score"], 6)) for x in rows)
    assert key(got) == key(batch.collect())
    q = word_nodes(stream, "sid", F.split("t", " "), small).writeStream.format("memory").queryName("word_nodes").trigger(availableNow=True).start()
    q.awaitTermination(120)
    ids = {(x["id"], round(x["score"], 3)) for x in spark.sql("select * from word_nodes where sid = '1'").collect()}
    assert ids == {("large", 1.0), ("g3", 0.99), ("small", 0.792), ("bolt", 1.0), ("g1", 0.99), ("fastener", 0.693)}
    times = spark.createDataFrame([("2020-01-01 00:00:01", "a"), ("2020-01-01 00:00:02", "a"), ("2020-01-01 00:20:00", "b")], "at string, id string").select(F.col("at").cast("timestamp").alias("at"), "id")
    counts = {(x["id"], x["n"]) for x in windowed_counts(times, "at", "10 minutes", "1 hour").collect()}
    assert counts == {("a", 2), ("b", 1)}


def test_small_analysis_steps(spark):
    p = spark.createDataFrame([(1, 0, "ノ", False, 1, []), (1, 1, "ヲ", True, 1, []), (1, 2, "", True, 2, [1])], "sid int, bp int, case string, nominal boolean, n_morphemes int, childbp array<int>")
    assert [x["childbp"] for x in virtual_edges(p).orderBy("bp").collect()] == [[], [0], [1]]
    m = spark.createDataFrame([(1, 0, 0, "a", False), (1, 0, 1, "b", True), (1, 1, 0, "c", True)], "sid int, bp int, i int, name string, semi boolean")
    assert sorted((x["bp"], x["id"], x["score"]) for x in without_semi_content(m).collect()) == [(0, "a", 0.8), (0, "a+b", 1.0), (1, "c", 1.0)]


def test_more_of_the_analysis(spark):
    text = "<ALT-近い-ちかい-近い-3-0-18-2><同義:形容詞:親しい/したしい><派生:近さ/ちかさ>"
    assert one(spark, listed_alternatives(F.col("a"), F.lit(False)), a=text) == ["近い/ちかい", "親しい/したしい", "近さ/ちかさ"]
    assert one(spark, listed_alternatives(F.col("a"), F.lit(True)), a=text) == ["親しい/したしい", "近さ/ちかさ"]
    assert one(spark, adjective_stem(F.col("a"), F.col("b")), a="近い/ちかい", b="イ形容詞アウオ段") == "近/ちか"
    assert one(spark, adjective_stem(F.col("a"), F.col("b")), a="駅/えき", b="普通名詞") is None
    rows = spark.createDataFrame([(1, ["を", "に"], "を"), (2, ["に"], "を"), (3, ["の"], "を"), (4, [None], "を"), (5, [], "を"), (6, None, "を")], "id int, child_fuzoku array<string>, fuzoku string")
    assert sorted(x["id"] for x in A.phrase_case_filter(rows).collect()) == [1, 3, 4]
