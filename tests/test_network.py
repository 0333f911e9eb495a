import math

import numpy as np
import pytest

from weftgraph import api
from weftgraph.operators import alignment as A
from weftgraph.operators import embedding as E
from weftgraph.operators import network as N
from weftgraph.operators import structure as S


def graph(spark, n, cells):
    return spark.createDataFrame([(0, i, j, float(w)) for i, j, w in cells], "step int, i int, j int, w double"), spark.createDataFrame([(0, i) for i in range(n)], "step int, i int")


def report(spark, n, cells, directed=False):
    return {r.i: r for r in N.centrality_report(*graph(spark, n, cells), directed).collect()}


def both(pairs):
    return [(i, j, 1.0) for a, b in pairs for i, j in ((a, b), (b, a))]


def test_complete_graph(spark):
    found = report(spark, 4, both([(i, j) for i in range(4) for j in range(i + 1, 4)]))
    assert all(r.degree == 1 and r.eigenvector == pytest.approx(1) and r.betweenness == 0 for r in found.values())


def test_path_and_star(spark):
    path = report(spark, 5, both([(k, k + 1) for k in range(4)]))
    assert max(path.values(), key=lambda r: r.betweenness).i == 2
    star = report(spark, 5, both([(0, k) for k in range(1, 5)]))
    assert max(star.values(), key=lambda r: r.pagerank).i == 0 and star[0].betweenness == pytest.approx(1)


def test_directed_path(spark):
    found = report(spark, 3, [(0, 1, 1), (1, 2, 1)], directed=True)
    assert [found[i].degree for i in range(3)] == [0.5, 0.5, 0.0]
    assert math.isnan(found[2].distance) and found[2].closeness == 0


def test_isolated_node(spark):
    found = report(spark, 3, both([(0, 1)]))
    assert math.isnan(found[2].distance) and found[2].closeness == 0 and found[2].harmonic == 0


def test_rounds_agree_with_kernel(spark):
    cells = [(0, 1, 1.0), (1, 2, 0.5), (2, 0, 0.25), (0, 2, 2.0)]
    a, b = N.pagerank_rounds(*graph(spark, 4, cells), rounds=30), N.pagerank(*graph(spark, 4, cells))
    x, y = ({r.i: r.pagerank for r in d.collect()} for d in (a, b))
    assert all(x[i] == pytest.approx(y[i], abs=1e-3) for i in range(4))


def test_equal_nodes_are_at_no_distance(spark):
    cells = both([(0, 2), (0, 3), (1, 2), (1, 3)])
    found = {(r.i, r.j): r.d for r in S.structural_equivalence(*graph(spark, 4, cells)).collect()}
    assert found[2, 3] < 1e-12 and found[0, 2] > 1


def test_correlation_against_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.uniform(0, 1, (5, 5))
    found = {(r.i, r.j): r.d for r in S.structural_correlation(*graph(spark, 5, [(i, j, m[i, j]) for i in range(5) for j in range(5)])).collect()}
    for (i, j), d in found.items():
        keep = [k for k in range(5) if k not in (i, j)]
        x, y = (np.concatenate([m[a, keep], m[keep, a]]) for a in (i, j))
        mx, my = x.sum() / 8, y.sum() / 8
        r = ((x * y).sum() / 8 - mx * my) / math.sqrt(((x * x).sum() / 8 - mx * mx) * ((y * y).sum() / 8 - my * my))
        assert d == pytest.approx(min(max(1 - r, 0), 2), abs=1e-9)


def test_validation(spark):
    bad = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, float("nan")), (0, 1, 0, -1.0), (0, 1, 1, 0.0)], "step int, i int, j int, d double")
    row = S.validate_distances(bad).first()
    assert (row.bad_values, row.negatives, row.bad_diagonal, row.asymmetric) == (1, 1, 1, 1)


def line(n):
    return np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(float)


@pytest.mark.parametrize("kernel", ["classical", "smacof", "landmark", "multilevel"])
def test_line_is_embedded(kernel):
    assert E.stress(line(12), E.KERNELS[kernel](line(12), 2)) < 1e-6


def test_triangle():
    d = np.ones((3, 3)) - np.eye(3)
    assert E.stress(d, E.classical(d, 2)) < 1e-6


@pytest.mark.parametrize("kernel", ["pivot", "force_directed", "tsne", "umap", "auto"])
def test_layouts_are_finite(kernel):
    rng = np.random.default_rng(1)
    d = E.gaps(rng.normal(size=(20, 3)))
    assert np.isfinite(E.KERNELS[kernel](d, 2)).all()


def test_layouts_keep_clusters():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(8, 0.1, (20, 3))])
    for y in (E.tsne(E.gaps(points), 2, perplexity=8), E.umap(E.gaps(points), 2, neighbours=8)):
        g = E.gaps(y)
        assert g[:20, :20].mean() < g[:20, 20:].mean()


def test_quarter_turn_is_undone():
    x = np.random.default_rng(4).uniform(1, 100, (6, 2))
    turned = x @ np.array([[0.0, 1.0], [-1.0, 0.0]]) * 2 + 3
    fit = A.procrustes(turned, x, scaling=True)
    assert fit.residual < 1e-9 and fit.scale == pytest.approx(0.5)
    assert np.allclose(fit.rotation @ fit.rotation.T, np.eye(2))
    assert A.procrustes(turned, x, scaling=True, compat=True).residual > 1


def test_gpa_of_turned_copies():
    x = np.random.default_rng(5).normal(size=(7, 2))
    aligned, mean = A.gpa([x, x @ np.array([[0.0, 1.0], [-1.0, 0.0]]), -x])
    assert all(np.abs(y - mean).max() < 1e-6 for y in aligned)
    assert A.gpa([])[0] == []


@pytest.mark.parametrize("mode", ["none", "timeseries", "anchored", "optimal", "gpa"])
def test_modes(mode):
    x = np.random.default_rng(6).normal(size=(5, 2))
    fits = A.align_series([x, x + 1, -x], mode)
    assert len(fits) == 3 and (mode == "none" or max(f.residual for f in fits) < 1e-9)


def test_a_large_step_leaves_small_ones_exact(spark):
    ring = [(step, k, (k + 1) % n, 1.0 + k % 3) for step, n in ((0, 1001), (1, 130)) for k in range(n)]
    adjacency = N.both_ways(spark.createDataFrame(ring, "step int, i int, j int, w double"))
    nodes = adjacency.select("step", "i").distinct()
    small = {r.i: r.betweenness for r in N.betweenness(*(x.where("step = 1") for x in (adjacency, nodes))).collect()}
    found = {r.i: r.betweenness for r in N.betweenness(adjacency, nodes, 100, exact_nodes=1000).where("step = 1").collect()}
    report = {r.i: r.betweenness for r in N.centrality_report(adjacency, nodes).where("step = 1").collect()}
    assert found == pytest.approx(small) and report == pytest.approx(small)


def test_text_network_has_exact_betweenness(spark):
    rng, letters = np.random.default_rng(5), "bcdfghklmnprstvz"
    known = [f"{a}a{b}o{c}u" for a in letters for b in letters for c in letters][:1020]
    text = " ".join(known[k] for _ in range(2) for k in rng.permutation(len(known)))
    found = api.run_mf(spark.createDataFrame([(1, "x", text)], "doc_id long, lang string, text string"), "lang", window=1, min_count=1)
    number = {r.token: r.idx for r in found.vocabulary.collect()}
    cells = spark.createDataFrame([(0, number[r.src], number[r.dst], r.w) for r in found.edges.collect()], "step int, i int, j int, w double")
    nodes = spark.createDataFrame([(0, i) for i in number.values()], "step int, i int")
    exact = {r.i: r.betweenness for r in N.betweenness(N.both_ways(cells), nodes).collect()}
    assert len(number) > N.EXACT_BETWEENNESS_NODES
    assert {number[r.token]: r.betweenness for r in found.centrality.collect()} == pytest.approx(exact)


def test_large_graphs_iterate_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(step, i, j, float(rng.random())) for step in (1, 2) for i in range(12) for j in range(12) if i != j and rng.random() < 0.4]
    adjacency = spark.createDataFrame(rows, "step int, i int, j int, w double")
    nodes = spark.createDataFrame([(step, i) for step in (1, 2) for i in range(13)], "step int, i int")
    small = [{(r.step, r.i): r[2] for r in f(adjacency, nodes).collect()} for f in (N.pagerank, N.eigenvector)]
    monkeypatch.setattr(N, "DENSE_NODES", 5)
    monkeypatch.setattr(N, "TOLERANCE", 1e-3)
    for f, expected in zip((N.pagerank, lambda a, n: N.eigenvector_rounds(a, n, tolerance=1e-3)), small, strict=True):
        found = {(r.step, r.i): r[2] for r in f(adjacency, nodes).collect()}
        assert found == pytest.approx(expected, abs=5e-3)
