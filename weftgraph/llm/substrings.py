"""Substring dedup: level-wise doubling of word windows that repeat across documents.

The first level looks at windows of half the length. Every full window names the smallest hash of
the half windows inside it, so that equal windows name equal halves and neighbouring windows
mostly the same one; only these are counted. Where a half is found in two different texts, the
windows around it are extended to twice the length and counted in turn, and `longest_repeats`
goes on doubling until no candidate survives. Equal texts are one class and are looked at once: of
a class all but the first document repeat it whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import join_counted, stage, text_key
from weftgraph.llm.wordhash import BASE, U64, Powers, mix, word_hashes

Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
def window_hashes(words: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """A hash for the window of `length` words from each word that has one."""
    if len(words) < length:
        return np.zeros(0, U64)
    up, down = powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(words * up[:-1])])
    return mix((sums[length:] - sums[:-length]) * down[: len(words) - length + 1] + U64(length))


def smallest_inside(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def window_names(words: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """For each window of `length` words the smallest hash of the windows of half the length inside it."""
    if len(words) < length:
        return np.zeros(0, U64)
    half = (length + 1) // 2
    return smallest_inside(window_hashes(words, half, powers), length - half + 1)


def _join(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(length: int) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            counts, digests, names = [], [], []
            for text in batch.column(3):
                words = text.as_py().split()
                counts.append(len(words))
                digests.append(_join(words))
                names.append(np.unique(window_names(word_hashes(text.as_py()), length, powers)).view(np.int64) if len(words) >= length else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(digests), pa.array(names, pa.list_(pa.int64()))], names=["_id", "_h1", "_h2", "n_words", "_digest", "_names"])

    return run


def _extend(length: int) -> Mapper:
    """Rows (_h1, _id, pos, w1, w2) for the windows that name a half which repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for k, (names, text) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                words = word_hashes(text.as_py())
                repeated = np.sort(names.values.to_numpy().view(U64))
                own = window_names(words, length, powers)
                at = np.minimum(np.searchsorted(repeated, own), len(repeated) - 1)
                pos = np.flatnonzero(repeated[at] == own)
                one = window_hashes(words, length, powers)[pos].view(np.int64)
                two = (window_hashes(mix(words ^ BASE), length, powers)[pos] >> U64(33)).astype(np.int32)
                head = [batch.column(c).take(pa.array(np.full(len(pos), k))) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(pos, pa.int32()), pa.array(one), pa.array(two)], names=["_h1", "_id", "pos", "w1", "w2"])

    return run


def _strike(length: int) -> Mapper:
    """(_h1, _id, n_removed, _kept) from the starts of repeated windows and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests = [], []
            for starts, text in zip(batch.column(2), batch.column(3), strict=True):
                words = text.as_py().split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = starts.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                left = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                removed.append(len(words) - len(left))
                digests.append(_join([words[x] for x in left]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(digests)], names=["_h1", "_id", "n_removed", "_kept"])

    return run


def repeated_windows(docs: DataFrame, length: int, text: str, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scanned rows, classes of equal texts, candidate texts and their windows with the smallest id that starts one alike.

    windows: (_h1, _id, pos, w1, w2, least, most) for every window found in two classes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(id_col).alias("_id"), *text_key(body), F.encode(body, "UTF-8").alias("_utf8"))
    kind = source.schema["_id"].dataType.simpleString()
    scanned = stage(source.mapInArrow(_scan(length), f"_id {kind}, _h1 long, _h2 long, n_words long, _digest string, _names array<long>"), "windows-scanned")
    classes = stage(scanned.groupBy("_h1", "_h2").agg(F.min("_id").alias("first"), F.first("_names").alias("_names")), "windows-classes")

    named = classes.where(F.col("first").isNotNull()).select("_h1", "first", F.explode("_names").alias("w"))
    twice = named.groupBy("w").agg(F.min("first").alias("a"), F.max("first").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("w", "n")
    found = join_counted(named, twice, ["w"], "n", "windows-halves", "left_semi").groupBy("_h1", "first").agg(F.collect_list("w").alias("_names"))
    home = source.select(F.col("_id").alias("first"), "_h1", "_utf8")
    texts = home.join(found, ["first", "_h1"]).dropDuplicates(["first", "_h1"]).select("_h1", F.col("first").alias("_id"), "_names", "_utf8")
    texts = stage(texts, "windows-texts")
    rows = stage(texts.mapInArrow(_extend(length), f"_h1 long, _id {kind}, pos int, w1 long, w2 int"), "windows-rows")
    return scanned, classes, texts, stage(repeated(rows, "windows-alike"), "windows-repeated")


def repeated(rows: DataFrame, name: str) -> DataFrame:
    """Those of the windows (_h1, _id, pos, w1, w2) that stand in two texts, with the smallest id that has one alike."""
    alike = rows.groupBy("w1", "w2").agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").drop("most")
    return join_counted(rows, alike, ["w1", "w2"], "n", name).select("_h1", "_id", "pos", "w1", "w2", "least")


def longest_levels(windows: DataFrame, length: int) -> DataFrame:
    """(_h1, _id, longest): for texts with a repeated window, the greatest of length, 2 length, 4 length, ... that still repeats.

    Each round joins the windows that survived with those one window further on, both of a repeated
    window of twice the length, and looks which of these repeat, until no candidate survives.
    """
    level, span, found = windows.select("_h1", "_id", "pos", "w1", "w2"), length, []
    while True:
        found.append(level.select("_h1", "_id").distinct().withColumn("longest", F.lit(span).cast("long")))
        further = level.select("_h1", "_id", (F.col("pos") - span).alias("pos"), F.col("w1").alias("v1"), F.col("w2").alias("v2"))
        joined = stage(level.join(further, ["_h1", "_id", "pos"]).select("_h1", "_id", "pos", F.xxhash64("w1", "v1", "v2").alias("w1"), F.hash("w2", "v2", "v1").alias("w2")), "windows-doubled")
        level, span = stage(repeated(joined, "windows-alike"), "windows-level").drop("least"), 2 * span
        if not level.limit(1).count():
            return reduce(DataFrame.union, found).groupBy("_h1", "_id").agg(F.max("longest").alias("longest"))


def dedup_substrings(docs: DataFrame, length: int = 50, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: id, n_words, n_removed, kept_sha256 and longest_repeat.

    A word is removed if a window of `length` words covers it whose words also start somewhere in a
    document with a smaller id; windows are judged on the input. kept_sha256 is of the words left,
    joined by a space. longest_repeat: the greatest of length, 2 length, 4 length, ... words that a
    window of the text repeats of a different text, 0 for none. A null text has no words; texts
    shorter than a window lose nothing; rows that repeat an id are not smaller than one another; rows
    without an id are compared with none and lose nothing; very long texts are taken whole; no rows give no rows.
    """
    scanned, classes, texts, windows = repeated_windows(docs, length, text, id_col)
    starts = windows.where("least < _id").groupBy("_h1", "_id").agg(F.collect_list("pos").alias("_starts"))
    kind = scanned.schema["_id"].dataType.simpleString()
    struck = starts.join(texts.select("_h1", "_id", "_utf8"), ["_h1", "_id"]).select("_h1", "_id", "_starts", "_utf8")
    cut = stage(struck.mapInArrow(_strike(length), f"_h1 long, _id {kind}, n_removed long, _kept string"), "windows-cut")
    longest = longest_levels(windows, length).withColumnRenamed("_id", "first")
    marked = classes.select("_h1", "_h2", "first").join(longest, ["_h1", "first"], "left")
    own = scanned.drop("_names").join(marked, ["_h1", "_h2"]).join(cut, ["_h1", "_id"], "left")
    copy = (F.col("_id") > F.col("first")) & (F.col("n_words") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    return own.select(
        F.col("_id").alias(id_col), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("_kept", "_digest")).alias("kept_sha256"),
        F.coalesce("longest", F.lit(0).cast("long")).alias("longest_repeat"),
    )
