import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["slice_id", "a", "b", "cnt", "nppmi", "rank"]


@pytest.mark.parametrize("name", ["vocabulary", "cooccurrence_per_document", "structural_equivalence", "shortest_paths", "lis_frames", "ego_visible"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = entry.queries()[name](spark, SF)
    expected = con.sql(entry.oracle_sql()[name])
    plain = lambda rows, at: sorted([tuple(round(float(r[k]), 5) if isinstance(r[k], float) else r[k] for k in at) for r in rows], key=str)
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    assert plain(found.collect(), names) == plain([dict(zip(expected.columns, r, strict=True)) for r in expected.fetchall()], names)
