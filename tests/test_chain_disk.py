"""The links of a component were sent again for each so many rows found, so what was sent grew with the cube of the largest component and filled the disk."""

from tsumugi.operators import lexicon_etl as E


def test_links_sent_follow_the_links(spark, monkeypatch):
    n, sent = 60, []
    links = spark.createDataFrame([("hub", f"w{k:02d}") for k in range(n)] + [(f"w{k:02d}", f"end{k:02d}") for k in range(n)] + [("end03", "w03"), ("x", "y"), ("y", "z")], "w1 string, w2 string")
    starts = spark.createDataFrame([(f"w{k:02d}",) for k in range(n)] + [("x",), ("alone",)], "word string")
    monkeypatch.setattr(E, "PART", 10)
    kind = type(links)
    run = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: sent.append(self.filter("w2 is not null").count()) or run(self, *a, **k))
    rows = [tuple(r) for r in E.chains(links, starts).collect()]
    found = {(a, b): path for a, b, _, path in rows}
    assert len(found) == len(rows) == n * (2 * n + 1) + 3 + 1
    assert found["w05", "end41"] == ["w05", "hub", "w41", "end41"] and found["w03", "end03"] == ["w03", "end03"] and found["x", "z"] == ["x", "y", "z"]
    parts = 2 * spark.sparkContext.defaultParallelism
    assert len(sent) == 1 and 2 * n + 2 <= sent[0] <= 2 * n * (parts + 1) + 2
