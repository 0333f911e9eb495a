import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import api
from weftgraph.functions.text import stop_words
from weftgraph.operators import alignment as A
from weftgraph.operators import dataset as D
from weftgraph.operators import embedding as E
from weftgraph.operators import playback as P
from weftgraph.sources import demo, lvjson, results, text, xlsx

NODES = [("s", 0, "a", 0.5, 1.0, 1.0, 0.0), ("s", 1, "b", 0.5, math.nan, 0.0, 0.0)]
PAIRS = [("s", 0, 1, 0.4, 0.4, 1.5, 3), ("s", 1, 0, 0.4, 0.4, 1.5, 3)]


@pytest.fixture(scope="module")
def documents(spark):
    return results.network_documents(spark.createDataFrame(NODES, results.NODE_COLUMNS), spark.createDataFrame(PAIRS, results.PAIR_COLUMNS))


def test_networks_go_round(spark, documents, tmp_path):
    results.write_networks(documents, f"file://{tmp_path}/n")
    own, pairs = results.read_network_files(spark, f"file://{tmp_path}/n")
    found = {r.token: r for r in own.collect()}
    assert (found["a"].distance, found["a"].degree) == (1.0, 0.5) and math.isnan(found["b"].distance)
    assert sorted(tuple(r) for r in pairs.collect()) == PAIRS


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda d: d.update(labels=["a"]), "1 labels"),
        (lambda d: d.update(ppmi_matrix=[0.0]), "ppmi_matrix has 1 values"),
        (lambda d: d["centrality"].update(degree=[0.0]), "centralities do not match"),
        (lambda d: d["similarity_matrix"].__setitem__(1, 1.2), "similarity_matrix is outside"),
        (lambda d: d["nppmi_matrix"].__setitem__(1, 0.1), "nppmi_matrix is not symmetric"),
        (lambda d: d["ppmi_matrix"].__setitem__(1, None), "ppmi_matrix is not finite"),
        (lambda d: d["centrality"]["distance"].__setitem__(0, math.inf), "distance is not finite"),
        (lambda d: d["centrality"]["closeness"].__setitem__(0, None), "closeness is not finite"),
    ],
)
def test_broken_networks(spark, documents, change, message):
    doc = json.loads(documents.first().value)
    assert results.network_failure(doc) is None
    change(doc)
    assert results.network_failure(doc).startswith(message)


def test_series(spark):
    rows = [("1", json.dumps({"labels": ["a"], "n": 1, "sim_to_dist": "linear"})), ("2", json.dumps({"labels": ["b"], "n": 1, "sim_to_dist": "linear"})), ("3", json.dumps({"labels": ["a"], "n": 1, "sim_to_dist": "info"}))]
    found = results.series_failures(spark.createDataFrame(rows, "slice_id string, value string")).collect()
    assert sorted(map(tuple, found)) == [("2", "labels differ"), ("3", "sim_to_dist differs")]


def test_network_workbook(documents):
    sheets = dict(xlsx.read_workbook(results.network_workbook(json.loads(documents.first().value))))
    assert list(sheets) == ["Vocabulary", "NPPMI Matrix", "PPMI Matrix", "Similarity Matrix", "Raw Counts"]
    assert sheets["Vocabulary"][2][:3] == ["b", "0.5", "N/A"] and sheets["Raw Counts"][1][2] == "3"


def test_space_sink(spark, tmp_path):
    nodes, edges, sheets = demo.demo_dataset(spark)
    nodes, edges, sheets = (x.where("sheet_index = 0") for x in (nodes, edges, sheets))
    places = spark.createDataFrame([(1, 0, [1.0, 2.0], 0.0), (1, 1, [3.0, 4.0], 0.0)], "step int, i int, coord array<double>, residual double")
    central = spark.createDataFrame([(1, 0, 0.5, math.nan, 0.0, 0.0), (1, 1, 0.5, 1.0, 1.0, 0.0)], "step int, i int, degree double, distance double, closeness double, betweenness double")
    names = spark.createDataFrame([(0, "a"), (1, "b")], "i int, label string")
    gaps = spark.createDataFrame([(1, i, j, float(i != j)) for i in (0, 1) for j in (0, 1)], "step int, i int, j int, d double")
    results.write_space(places, central, names, gaps, nodes, edges, sheets, f"file://{tmp_path}/out")
    document = json.loads((tmp_path / "out/as_result.json").read_text())
    assert document["coordinates"] == [{"labels": ["a", "b"], "dims": 2, "data": [1.0, 2.0, 3.0, 4.0]}] and document["centralities"][0]["distance"] == [None, 1.0]
    book = dict(xlsx.read_workbook((tmp_path / "out/Centralities.xlsx").read_bytes()))
    assert book["Step_1"][1][:3] == ["a", "0.5", "N/A"]
    assert zipfile.is_zipfile(tmp_path / "out/LV.xlsx") and len(xlsx.parse_dataset((tmp_path / "out/LV.xlsx").read_bytes())[0]) == 48


def test_demo(spark):
    nodes, edges, sheets = demo.demo_dataset(spark)
    assert (nodes.count(), edges.count(), sheets.count()) == (384, 317, 8)
    assert not D.validate_dataset(nodes, edges, D.canonical_labels(nodes)).collect()
    strength = {(r.sheet_index, r["from"], r["to"]): r.strength for r in edges.collect()}
    assert strength[0, "USA", "China"] == 0.8 and abs(strength[7, "USA", "China"] - 0.52) < 1e-12 and (6, "Germany", "Russia") not in strength
    uk = {r.sheet_index: r.x for r in nodes.where("label = 'UK'").collect()}
    assert abs(uk[7] - (0.5 - 0.15 * 7)) <= 0.08 and demo.noise("UK", 0, 1_000_003, 7) == demo.noise("UK", 0, 1_000_003, 7)


def test_broken_dataset_is_not_loaded(spark, tmp_path):
    nodes, edges, sheets = demo.demo_dataset(spark)
    path = f"file://{tmp_path}/d.json"
    lvjson.write_json(nodes.withColumn("note", F.when(F.col("label") == "Iraq", 200).otherwise(F.col("note"))), edges, sheets, D.canonical_labels(nodes), path)
    with pytest.raises(ValueError, match="note is above 127"):
        lvjson.load_dataset(spark, path)
    lvjson.write_json(nodes, edges, sheets, D.sorted_labels(nodes), path)
    assert lvjson.load_dataset(spark, path)[0].count() == 384
    with pytest.raises(Exception, match="too large"):
        lvjson.read_json(spark, path, max_bytes=100)


def test_sources_in_the_order_given(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, content in (("d/b.txt", "second"), ("d/a.txt", "first"), ("d/empty.txt", " "), ("d/x.md", "no"), ("z.log", "zeroth")):
        (tmp_path / name).write_text(content)
    found = text.mixed_sources(spark, [f"file://{tmp_path}/z.log", f"file://{tmp_path}/d"]).orderBy("source_ord").collect()
    assert [(r.source_ord, r.label, r.text) for r in found] == [(0, "z", "zeroth"), (1, "a", "first"), (2, "b", "second")]
    assert text.in_memory(spark, "x").first().text == "x"
    (tmp_path / "d/bad.txt").write_bytes(b"\xff\xfe bad")
    with pytest.raises(Exception, match="UTF-8|UTF8"):
        text.text_sources(spark, f"file://{tmp_path}/d").collect()


def test_stop_words_of_languages():
    assert "und" in stop_words("de-CH") and "les" in stop_words("French") and "pero" in stop_words("es")
    with pytest.warns(UserWarning, match="no stop words"):
        assert stop_words("qq-none") == ()


def test_timer_is_the_loop_that_carries_fractions(spark):
    rng = np.random.default_rng(0)
    rows = [(0, k, float(rng.integers(0, 32)) / 64) for k in range(200)]
    found = P.frame_ticks(spark.createDataFrame(rows, "s int, k int, dt double"), "s", "k", "dt", fps=24, speed=1.5).orderBy("k").collect()
    held = 0.0
    for r in found:
        held += r.dt * 24 * 1.5
        assert r.advance_slices == math.floor(held)
        held -= math.floor(held)


def test_frame_range_is_checked(spark):
    frames = spark.range(10).withColumnRenamed("id", "slice_index")
    assert P.frame_range(frames, 3, 99, 10).count() == 7
    with pytest.raises(ValueError, match="out of range"):
        P.frame_range(frames, 10, 12, 10)


def test_camera(spark):
    camera = P.Camera(distance=10.0, yaw=0.0, pitch=0.0)
    rows = [("centre", 0.0, 0.0, 0.0), ("right", 1.0, 0.0, 0.0), ("up", 0.0, 1.0, 0.0), ("behind", 0.0, 0.0, 20.0)]
    found = {r.label: (r.px, r.py) for r in P.project(spark.createDataFrame(rows, "label string, x double, y double, z double"), camera, 800, 400).collect()}
    assert found["centre"] == (400, 200) and found["right"][0] > 400 and found["up"][1] < 200 and "behind" not in found
    assert abs((found["right"][0] - 400) - (200 - found["up"][1])) < 1e-9


@pytest.mark.parametrize("scaling", [False, True])
@pytest.mark.parametrize("mode", ["none", "timeseries", "anchored", "optimal", "gpa"])
def test_alignment_from_moments_is_that_of_configurations(spark, mode, scaling):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(9, 3))
    configs = [(base + rng.normal(size=(9, 3)) * 0.1) @ np.linalg.qr(rng.normal(size=(3, 3)))[0] * (1 + k / 5) + k for k in range(5)]
    coords = spark.createDataFrame([(10 + k, i, [float(v) for v in x]) for k, c in enumerate(configs) for i, x in enumerate(c)], "step int, i int, coord array<double>")
    found = {(r.step, r.i): r for r in A.align(coords, mode, scaling).collect()}
    for k, fit in enumerate(A.align_series(configs, mode, scaling)):
        for i in range(9):
            assert np.allclose(found[10 + k, i].coord, fit.aligned[i], atol=1e-6)
        assert found[10 + k, 0].residual == pytest.approx(fit.residual, abs=1e-6)


@pytest.mark.parametrize("kernel", ["smacof", "landmark", "multilevel"])
def test_plane_points_are_placed_at_their_distances(kernel):
    points = np.random.default_rng(3).normal(size=(60, 2))
    dist = E.gaps(points)
    assert E.stress(dist, E.KERNELS[kernel](dist, 2)) < 0.01


def test_affinities_have_the_entropy_asked_for():
    dist = E.gaps(np.random.default_rng(4).normal(size=(40, 3)))
    p = E.affinities(dist, perplexity=10.0)
    assert np.allclose(p, p.T) and abs(p.sum() - 1) < 0.01
    w = E.fuzzy_graph(dist, 10)
    assert np.allclose(w, w.T) and ((w >= 0) & (w <= 1 + 1e-9)).all() and ((w > 0).sum(axis=1) >= 10).all()


def test_series_of_files_with_one_vocabulary(spark, tmp_path):
    for name, content in (("a.txt", "red green red blue green red"), ("b.txt", "red yellow red green"), ("c.txt", "x1")):
        (tmp_path / name).write_text(content)
    options = {"min_count": 1, "window": 2, "shared_vocabulary": True, "min_slice_tokens": 2}
    found = api.run_files(spark, [f"file://{tmp_path}"], **options)
    by = {}
    for r in found.vocabulary.collect():
        by.setdefault(r.slice_id, {})[r.token] = r.idx
    assert by == {k: {"blue": 0, "green": 1, "red": 2, "yellow": 3} for k in "ab"}
    assert {r.slice_id for r in found.counts.collect()} == {"a", "b"} and found.centrality.count() == 8
    counted = api.run_files(spark, [f"file://{tmp_path}"], similarity="count", **options)
    assert max(r.w for r in counted.edges.collect()) == 1.0
    assert api.run_files(spark, [f"file://{tmp_path}"], one_slice=True, min_count=1).vocabulary.count() == 5


def test_text_at_hand(spark):
    text = "one two three four five six " * 8
    low = api.run_text(spark, text, similarity="low_rank", min_count=1)
    assert all(0 < r.w <= 1 for r in low.edges.collect())
    batches = api.run_text(spark, text, min_count=1, batch_tokens=12)
    assert {r.slice_id for r in batches.vocabulary.collect()} == {f"batch-{k}" for k in range(4)}


def test_low_rank_falls_back(monkeypatch):
    def fails(*_, **__):
        raise np.linalg.LinAlgError

    assert (np.diag(E.svd_similarity(np.eye(3))) == 1).all()
    monkeypatch.setattr(np.linalg, "svd", fails)
    assert (E.svd_similarity(np.array([[0.0, 2.0], [1.0, 0.0]])) == [[0, 1], [0.5, 0]]).all()
