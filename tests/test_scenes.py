import pytest

from weftgraph.operators import dataset as D
from weftgraph.operators import frames as R
from weftgraph.sources import lvjson, text, xlsx
from weftgraph.streaming import counts


@pytest.fixture(scope="module")
def two(spark):
    rows = [(0, 0, "A", 0.0, 0.0, 0.0, 2.0, 350.0, "sphere"), (1, 0, "A", 10.0, 20.0, 0.0, 4.0, 10.0, "cube"), (1, 1, "B", 1.0, 1.0, 1.0, 3.0, 0.0, "torus")]
    return D.with_defaults(spark.createDataFrame(rows, "sheet_index int, row_ord int, label string, x double, y double, z double, size double, spin_x double, shape string"))


def test_midpoint_and_fade(two):
    rows = {r.label: r for r in R.frames(two, 4, "linear", at=2).collect()}
    assert (rows["A"].x, rows["A"].y, rows["A"].size, rows["A"].shape_id) == (5.0, 10.0, 3.0, 0)
    assert rows["A"].spin_x == pytest.approx(360.0) and rows["B"].size == pytest.approx(1.5)
    assert R.frames(two, 4).select("slice_index").distinct().count() == 4


def test_single_sheet_is_still(two):
    one = two.where("sheet_index = 0")
    rows = R.frames(one, 3).collect()
    assert len(rows) == 3 and {r.size for r in rows} == {2.0}


def test_validation_lists_every_failure(spark, two):
    from pyspark.sql import functions as F

    bad = two.where("sheet_index = 0").withColumns({"x": F.lit(float("nan")), "size": F.lit(0.0), "velocity": F.lit(0), "note": F.lit(128)})
    assert D.validate_rows(bad).count() == 4 and D.validate_rows(two).count() == 0
    edges = spark.createDataFrame([(0, 0, "A", "Z", 1.0)], D.EDGES)
    assert [r.message for r in D.validate_edges(edges, two).collect()] == ["to is not in the sheet"]


def test_ego(spark, two):
    nodes = D.with_defaults(spark.createDataFrame([(0, k, x) for k, x in enumerate("abcd")], "sheet_index int, row_ord int, label string"))
    edges = spark.createDataFrame([(0, 0, "a", "b", 1.0), (0, 1, "b", "c", 1.0), (0, 2, "a", "a", 1.0), (0, 3, "d", "b", 1.0)], D.EDGES)
    see = lambda **k: sorted(r.label for r in R.ego_visible(nodes, edges, "a", **k).collect())
    assert see() == ["a", "b"] and see(secondary=True) == ["a", "b", "c", "d"] and see(direction="incoming") == ["a"]
    assert see(secondary=True, shared=True) == ["a", "b"]
    assert sorted(r.edge_ord for r in R.ego_edges(nodes, edges, "a", secondary=True).collect()) == [0, 1, 2, 3]


def test_beats(spark, two):
    on = R.midi_events(two, 4, 2).where("kind = 'on'")
    assert sorted(r.slice_index for r in on.collect()) == [0, 2]
    assert R.midi_events(two, 4, 0).count() == 0


def test_files(spark, two, tmp_path):
    edges = spark.createDataFrame([(1, 0, "A", "B", 0.8), (1, 1, "B", "A", 0.3)], D.EDGES)
    sheets = spark.createDataFrame([(0, "one"), (1, "two & <2>")], "sheet_index int, name string")
    path = tmp_path / "d.xlsx"
    path.write_bytes(xlsx.dataset_workbook(two, edges, sheets))
    nodes, links = xlsx.read_xlsx(spark, f"file://{path}")
    assert sorted(map(tuple, nodes.drop("path").collect())) == sorted(map(tuple, two.collect()))
    assert sorted(map(tuple, links.drop("path").collect())) == sorted(map(tuple, edges.collect()))
    lvjson.write_json(two, edges, sheets, D.canonical_labels(two), f"file://{tmp_path}/j")
    back, links, names = lvjson.read_json(spark, f"file://{tmp_path}/j")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, two.collect())) and names.count() == 2


def test_text_sources(spark, tmp_path):
    for name in ("b.txt", "a.txt", "c.md"):
        (tmp_path / name).write_text(f"text of {name}")
    rows = text.numbered(text.text_sources(spark, f"file://{tmp_path}")).orderBy("source_ord").collect()
    assert [(r.label, r.text) for r in rows] == [("a", "text of a.txt"), ("b", "text of b.txt")]


def test_stream_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("hello world hello\n")
    stream = spark.readStream.text(f"file://{tmp_path}/in").withColumnRenamed("value", "text")
    query = counts.stream_unigrams(stream).writeStream.outputMode("complete").format("memory").queryName("unigrams").start()
    query.processAllAvailable()
    query.stop()
    assert {r.token: r.cnt for r in spark.sql("SELECT * FROM unigrams").collect()} == {"hello": 2, "world": 1}
