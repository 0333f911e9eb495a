"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

A document is the set of its five-word shingles, each of weight one however often it stands there.
Every shingle sends arrivals of a Poisson process, at a rate of its weight, to random registers; a
register keeps the shingle that arrives first, and arrivals later than the slowest register are never
drawn. With even weights two registers are equal with a probability of the Jaccard similarity of the
sets, the measure that pairs are judged by. Documents that share a band are compared exactly on
the sets of their shingles, but only with the smallest of the band, and after that, across the
groups this made, where a band holds members of several: there the sets themselves meet, tile by tile,
and only pairs that join two groups become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bound_batches, components, join_counted, stage, text_key
from weftgraph.llm.wordhash import GOLDEN, U64, mix, word_hashes

BANDS, ROWS = 24, 6
#: Documents of a tile, and their shingles.
TILE, TILE_SHINGLES = 512, 1_000_000
def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of `width` words; of the whole where there are fewer words, none without words."""
    width = min(width, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    out = np.full(n, U64(width))
    for k in range(width):
        out = mix(out * GOLDEN + words[k : k + n])
    return out


def signature(ids: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The element that arrives first at each register. ids: distinct hashes, at least one."""
    first = np.full(registers, np.inf)
    found = np.zeros(registers, U64)
    clock, own, rate, step = np.zeros(len(ids)), ids, weights, 0
    while len(own):
        block = max(1, 4 * registers // max(64, 8 * len(own)))
        draws = mix(own[:, None] * U64(0xD6E8FEB86659FD93) + (np.arange(step + 1, step + block + 1, dtype=U64) * GOLDEN)[None, :])
        gaps = -np.log(((draws >> U64(11)).astype(float) + 0.5) / float(1 << 53)) / rate[:, None]
        times = clock[:, None] + np.cumsum(gaps, axis=1)
        at = (mix(draws ^ U64(0xA0761D6478BD642F)) % U64(registers)).astype(np.int64)
        flat, where = times.ravel(), at.ravel()
        early = np.flatnonzero(flat < first[where])
        early = early[np.argsort(-flat[early], kind="stable")]
        first[where[early]] = flat[early]  # of several for one register the last written is the earliest
        found[where[early]] = np.repeat(own, block)[early] if block > 1 else own[early]
        clock, step = times[:, -1], step + block
        running = clock < first.max()
        own, rate, clock = own[running], rate[running], clock[running]
    return found


def band_keys(found: np.ndarray, bands: int) -> list[int]:
    rows = found.reshape(bands, -1)
    out = mix(np.arange(1, bands + 1, dtype=U64))
    for k in range(rows.shape[1]):
        out = mix(out * GOLDEN + rows[:, k])
    return out.view(np.int64).tolist()


def add_bands(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """(_id, _h1, _h2, _size, _bands) of (_id, _text): the number of distinct shingles, and a key for each band."""
    source = docs.select("_id", *text_key(F.col("_text")), F.encode("_text", "UTF-8").alias("_utf8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for text in batch.column(3):
                ids = np.unique(shingles(word_hashes(text.as_py()), width))
                sizes.append(len(ids))
                found = signature(ids, np.ones(len(ids)), bands * rows) if len(ids) else None
                keys.append([] if found is None else band_keys(found, bands))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_h1", "_h2", "_size", "_bands"])

    kind = docs.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, _h1 long, _h2 long, _size int, _bands array<long>")


def _compare(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, U64)
        for batch in batches:
            out = []
            for rep, a, b in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if rep != last:
                    last, own = rep, np.unique(shingles(word_hashes(a.as_py()), width))
                other = np.unique(shingles(word_hashes(b.as_py()), width))
                both = len(np.intersect1d(own, other, assume_unique=True))
                out.append(both / max(1, len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return run


def similarities(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b): exact Jaccard of the shingle sets. texts: (c, _utf8)."""
    right = pairs.join(texts.select(F.col("c").alias("b"), F.col("_utf8").alias("_b")), "b")
    both = right.join(texts.select(F.col("c").alias("a"), F.col("_utf8").alias("_a")), "a").sortWithinPartitions("a")
    return both.select("a", "b", "_a", "_b").mapInArrow(_compare(width), "a long, b long, similarity double")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(c, _set) of (c, _utf8): the distinct shingles in order, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(word_hashes(x.as_py()), width)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["c", "_set"])

    return texts.select("c", "_utf8").mapInArrow(run, "c long, _set binary")


def _crossing(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Pairs of a tile that join its groups: sets compared exactly, except where the lead or an earlier band has compared them."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("c", kind="stable").reset_index(drop=True)
        side, c = tile["side"].to_numpy(), tile["c"].to_numpy()
        group = np.unique(tile["g"].to_numpy(), return_inverse=True)[1]
        sets = [np.frombuffer(x, U64) for x in tile["_set"]]
        n = np.array([len(x) for x in sets])
        known, ranks = np.unique(np.concatenate(sets), return_inverse=True)
        sets, own = np.split(ranks, np.cumsum(n)[:-1]), np.zeros(len(known), bool)
        band, lead = int(tile["band"].iloc[0]), tile["lead"].iloc[0]
        earlier = np.array(tile["_bands"].tolist(), np.int64)[:, :band]
        left = np.flatnonzero((side == 0) & (c != lead))
        right = left if (side == 0).all() else np.flatnonzero((side == 1) & (c != lead))
        a, b = [], []
        for x in left:
            fit = right[(n[right] > 0) & (group[right] != group[x]) & (np.minimum(n[right], n[x]) >= threshold * np.maximum(n[right], n[x]) - 1e-9)]
            fit = fit[fit > x] if right is left else fit
            fit = fit[~(earlier[fit] == earlier[x]).any(axis=1)]
            if not len(fit):
                continue
            own[sets[x]] = True
            both = np.add.reduceat(own[np.concatenate([sets[y] for y in fit])].astype(np.int64), np.cumsum(n[fit]) - n[fit])
            own[sets[x]] = False
            for y in fit[both / (n[fit] + n[x] - both) >= threshold]:
                if group[y] != group[x]:
                    group[group == group[y]] = group[x]
                    a.append(x)
                    b.append(y)
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        return pd.DataFrame({"a": np.minimum(c[x], c[y]), "b": np.maximum(c[x], c[y])})

    return run


def _grouped(docs: DataFrame, threshold: float, bands: int, rows: int, width: int, text: str, id_col: str) -> DataFrame:
    """(_id, _h1, _h2, group, class_id) for each row with an id: its text's hash, the number of its group and the group's smallest id."""
    bound_batches(docs.sparkSession)
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    signed = stage(add_bands(source, bands, rows, width), "near-bands")
    texts_of = signed.groupBy("_h1", "_h2").agg(F.min("_id").alias("first"), F.first("_size").alias("n"), F.first("_bands").alias("_bands"))
    classes = stage(texts_of.withColumn("c", F.monotonically_increasing_id()), "near-classes")  # numbered once, as it is written
    members = stage(classes.select("c", "n", F.posexplode("_bands").alias("band", "k")), "near-members")
    shared = members.groupBy("k").agg(F.min("c").alias("lead"), F.min(F.struct("c", "n"))["n"].alias("lead_n"), F.count(F.lit(1)).alias("_m")).where("_m > 1")
    banded = stage(join_counted(members, shared, ["k"], "_m", "near-leads"), "near-shared")
    sizes_fit = lambda x, y: F.least(x, y) >= F.greatest(x, y) * threshold - 1e-9
    stars = stage(banded.where((F.col("c") != F.col("lead")) & sizes_fit(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("a"), F.col("c").alias("b")).distinct(), "near-pairs")
    needed = classes.join(banded.select("c").distinct(), "c", "left_semi").select(F.col("first").alias("_id"), "_h1", "_h2", "c")
    home = source.select("_id", *text_key(F.col("_text")), F.encode("_text", "UTF-8").alias("_utf8"))
    texts = stage(home.join(needed, ["_id", "_h1", "_h2"]).select("c", "_utf8").dropDuplicates(["c"]), "near-texts")
    judged = stage(similarities(stars, texts, width), "near-judged")
    links = judged.where(F.col("similarity") >= threshold).select("a", "b")
    labels = components(links, "a", "b", "near")

    # bands whose members are in several groups by now: compare across the groups what the stars did not
    named = lambda c, g: labels.select(F.col("id").alias(c), F.col("component").alias(g))
    grouped = stage(banded.join(named("c", "g"), "c", "left").select("k", "band", "c", "n", "lead", F.coalesce("g", "c").alias("g")), "near-grouped")
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).cast("int")
    mixed = grouped.groupBy("k").agg((F.min("g") != F.max("g")).alias("_mixed"), F.count(F.lit(1)).alias("_m"), tiles.alias("tiles")).where("_mixed").drop("_mixed")
    open_ = stage(join_counted(grouped, mixed, ["k"], "_m", "near-mixed"), "near-open")
    sets = shingle_sets(texts.join(open_.select("c").distinct(), "c", "left_semi"), width)
    placed = open_.join(classes.select("c", "_bands"), "c").join(sets, "c").withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("t0"), F.greatest(t, F.col("tile")).alias("t1"), (t < F.col("tile")).cast("int").alias("side")))
    tiled = placed.select("k", "band", "c", "g", "lead", "_bands", "_set", F.explode(meets).alias("p")).select("*", "p.*").drop("p")
    more = stage(tiled.groupBy("k", "t0", "t1").applyInPandas(_crossing(threshold), "a long, b long").distinct(), "near-more")
    if more.limit(1).count():
        labels = components(links.union(more), "a", "b", "near")
    own = classes.select("_h1", "_h2", "first", "c").join(named("c", "group"), "c", "left").withColumn("group", F.coalesce("group", "c"))
    least = own.groupBy("group").agg(F.min("first").alias("class_id"))
    return signed.select("_id", "_h1", "_h2").join(own.join(least, "group").select("_h1", "_h2", "group", "class_id"), ["_h1", "_h2"])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, width: int = 5, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, class_id) for each row: the smallest id of its group of copies and near copies.

    Two texts are linked if they are equal, or if they share a band and the Jaccard similarity of
    their sets of `width`-word shingles is at least `threshold`; groups are the connected components. A
    pair at the threshold shares no band with a probability of 7 in 10,000. Words stand between ASCII
    white space; a text of fewer words is one shingle; texts without words, null among them, go together
    only if they are equal, null and empty alike. Rows that repeat an id are judged each by its own text:
    with different texts they may be in different groups. No rows give no rows. Rows without an
    id are in no group: their class_id is null.
    """
    found = _grouped(docs, threshold, bands, rows, width, text, id_col).select(F.col("_id").alias(id_col), "class_id")
    return found.union(docs.where(F.col(id_col).isNull()).select(id_col, F.col(id_col).alias("class_id")))


def keep_one(docs: DataFrame, threshold: float = 0.8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` with one row for each group of `near_duplicates`: one whose id names the group. Rows without an id belong to no group and stay."""
    found = _grouped(docs, threshold, BANDS, ROWS, 5, text, id_col)
    heads = found.where("_id = class_id").groupBy("group").agg(F.min(F.struct("_id", "_h1", "_h2")).alias("h")).select("h.*")
    packed = docs.where(F.col(id_col).isNotNull()).select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), *text_key(F.coalesce(F.col(text), F.lit(""))))
    kept = packed.join(heads, ["_id", "_h1", "_h2"], "left_semi").dropDuplicates(["_id", "_h1", "_h2"]).select("_row.*")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
