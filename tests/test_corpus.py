import pytest
from pyspark.sql import functions as F

from weftgraph.functions.text import is_token, normalize_text, stop_words, tokens, words
from weftgraph.operators import corpus as C


def stream(spark, line, name="s"):
    return spark.createDataFrame([(name, 0, line.split())], "slice_id string, doc long, words array<string>")


def counts(spark, line, window, slide=1, least=1):
    words_ = stream(spark, line)
    found = C.cooccurrence(C.positions(words_), C.vocabulary(C.unigrams(words_), least), window, slide)
    return {(r.a, r.b): r.cnt for r in found.collect()}


def test_symmetric_counts(spark):
    assert counts(spark, "a b c a b", 2) == {("a", "b"): 6, ("b", "a"): 6, ("a", "c"): 4, ("c", "a"): 4, ("b", "c"): 4, ("c", "b"): 4}


def test_min_count_leaves_vocabulary(spark):
    found = C.vocabulary(C.unigrams(stream(spark, "hello world hello world rare")), 2)
    assert sorted((r.token, r.idx) for r in found.collect()) == [("hello", 0), ("world", 1)]


def test_slide_counts_centres_only(spark):
    found = counts(spark, "a b c d e f g h i j k l", 2, 2)
    assert found["g", "h"] == found["h", "g"] == 1


def test_windows_cross_blocks(spark, monkeypatch):
    line = " ".join("abc"[k % 3] for k in range(40))
    whole = counts(spark, line, 5)
    monkeypatch.setattr(C, "BLOCK_TOKENS", 7)
    assert counts(spark, line, 5) == whole


def test_association(spark):
    words_ = stream(spark, " ".join(["alpha beta"] * 2 + ["gamma delta"] * 2))
    words_ = stream(spark, "alpha beta gamma delta alpha beta gamma delta")
    scored = C.association(C.cooccurrence(C.positions(words_), C.vocabulary(C.unigrams(words_), 1), 2))
    rows = scored.collect()
    assert all(0 <= r.nppmi <= 1 and r.ppmi >= 0 for r in rows)
    cells = {(r.a, r.b): r.nppmi for r in rows}
    assert all(cells[b, a] == pytest.approx(v) for (a, b), v in cells.items())


def test_two_word_vocabulary_has_no_association(spark):
    words_ = stream(spark, "alpha beta")
    scored = C.association(C.cooccurrence(C.positions(words_), C.vocabulary(C.unigrams(words_), 1), 2))
    assert {r.nppmi for r in scored.collect()} == {0.0}


def test_global_positions_run_on(spark):
    docs = spark.createDataFrame([("s", d, ["x"] * n) for d, n in [(0, 3), (1, 0), (5000, 2), (9000, 1)]], "slice_id string, doc long, words array<string>")
    assert sorted((r.doc, r.pos) for r in C.positions(docs).collect()) == [(0, 0), (0, 1), (0, 2), (5000, 3), (5000, 4), (9000, 5)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("We have 42 apples, and 100 ORANGES!", ["we", "have", "apples", "and", "oranges"]), ("a b c hello world", ["hello", "world"]), ("hello 世界 world", ["hello", "world"]), ("", []), ("x2 22 ²³", ["x2"])],
)
def test_tokens(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0] == expected


def test_composition(spark):
    df = spark.createDataFrame([("Café",)], "t string")
    assert df.select(normalize_text(F.col("t"), True)).first()[0] == "café"
    assert df.select(words(normalize_text(F.col("t")))).first()[0][0] == "cafe"


def test_stop_words(spark):
    df = spark.createDataFrame([("the quick brown fox is a animal",)], "t string")
    found = df.select(tokens(F.col("t"), "en")).first()[0]
    assert "fox" in found and not {"the", "is"} & set(found)
    assert df.select(tokens(F.col("t"), "xx")).first()[0] == ["the", "quick", "brown", "fox", "is", "animal"]
    assert stop_words("xx") == () and is_token(F.lit("ab")) is not None
