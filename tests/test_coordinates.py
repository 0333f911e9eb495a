import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import api
from weftgraph.operators import corpus as C
from weftgraph.operators import embedding as E
from weftgraph.operators import structure as S
from weftgraph.plans import files


def similar(n, share, seed=5):
    rng = np.random.default_rng(seed)
    s = np.triu(np.where(rng.random((n, n)) < share, rng.random((n, n)), 0.0))
    return np.maximum(s, s.T)


@pytest.mark.parametrize(("n", "method"), [(300, "cosine"), (900, "cosine"), (900, "linear")])
def test_rows_place_points_as_the_whole_matrix_does(monkeypatch, n, method):
    s = similar(n, 0.02)
    dist = E._gap(s, method)
    np.fill_diagonal(dist, 0.0)
    i, j = np.nonzero(s)
    monkeypatch.setattr(E, "POINTS_AT_ONCE", 128)
    assert np.allclose(E.place_rows(i, j, s[i, j], n, n, method, 3), E.auto(dist, 3), atol=1e-6)
    held = (i == 0) | (i >= n - 60)
    few = E.place_rows(i[held], j[held], s[i, j][held], n, 60, method, 3)
    assert few is None or np.allclose(few, E.auto(dist, 3), atol=1e-6)


def test_coordinates_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(d, lang, " ".join(f"w{k}x" for k in rng.zipf(1.4, 60) if k < 60)) for lang in ("de", "en") for d in range(30)], "doc_id long, lang string, text string")
    found = api.run_mf_to_coordinates(docs, "lang").collect()
    words = C.document_tokens(docs, F.col("lang"))
    vocab = C.vocabulary(C.unigrams(words), 2)
    scored = C.association(C.cooccurrence(C.positions(words), vocab)).collect()
    for lang in ("de", "en"):
        tokens = sorted(r.token for r in vocab.where(F.col("slice_id") == lang).collect())
        at = {t: k for k, t in enumerate(tokens)}
        s = np.zeros((len(at), len(at)))
        for r in scored:
            if r.slice_id == lang:
                s[at[r.a], at[r.b]] = r.nppmi
        dist = E._gap(s, "cosine")
        np.fill_diagonal(dist, 0.0)
        placed = {r.token: r.coord for r in found if r.slice_id == lang}
        assert sorted(placed) == tokens
        own, expected = E.gaps(np.array([placed[t] for t in tokens])), E.gaps(E.auto(dist, 3))
        assert np.allclose(own / own.max(), expected / expected.max(), atol=1e-6)


@pytest.mark.parametrize("method", ["linear", "cosine", "info"])
def test_gaps_are_those_of_columns(spark, method):
    values = [0.0, 1e-9, 0.3, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "s double").select(S.similarity_to_distance(F.col("s"), method, F.lit(False)).alias("d")).collect()
    assert np.allclose(E._gap(np.array(values), method), [r.d for r in rows])


def test_all_words_are_placed():
    assert "min_count" not in inspect.getsource(files.run_mf_to_coordinates)
    assert inspect.signature(api.run_mf_to_coordinates).parameters["min_count"].default == 2
