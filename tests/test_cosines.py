import math

import numpy as np
import pytest

from weftgraph.operators import embedding as E


def vectors(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(k), [float(v) for v in np.float32(rng.normal(size=5))], int(rng.integers(0, 2))) for k in rng.permutation(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_cosines_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_VECTORS", 7)
    rows, table = vectors(spark, 60)
    found = {(r.i, r.j): r.cosine for r in E.cosines(table, "vec_id", "embedding", "label", 6).collect()}
    by = {k: (np.array(v, float), g) for k, v, g in rows}
    expected = {(i, j): round(float(x @ y / math.sqrt((x @ x) * (y @ y))), 6) for i, (x, g) in by.items() for j, (y, h) in by.items() if g == h and i < j}
    assert found == pytest.approx(expected, abs=1e-9) and len(expected) > 500


def test_cosines_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [2.0, 0.0], 0), (5, [1.0], 0), (6, [0.0, 0.0], 0), (7, [1.0, 0.0], None), (None, [1.0, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {(r.i, r.j): r.cosine for r in E.cosines(table, "vec_id", "embedding", "label", 6).collect()}
    assert len(found) == 15 and found[1, 4] == 1.0 and math.isnan(found[1, 6]) and all(found[x] is None for x in ((1, 2), (1, 3), (1, 5), (2, 3)))


def test_pairs_of_vectors_are_not_joined(spark):
    plan = E.cosines(vectors(spark, 10)[1], "vec_id", "embedding", "label", 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan
