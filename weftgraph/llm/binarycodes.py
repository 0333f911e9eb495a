"""Near-duplicate embeddings by randomly rotated binary codes.

Vectors of length one are rotated at random and stored as packed bits: the signs of their coordinates,
and the coordinates themselves rounded at random to four bits. With them go the code's correction
factors: the inner product of the vector with its signs, and the step of the rounding. Signs of one
vector against four-bit coordinates of the other, counted on the packed bits, give an unbiased
estimate of the inner product and its error. Runs of bits from further rotations bucket the
vectors, so that only vectors of one bucket are estimated; there are as many runs as make a pair at the
threshold meet with a probability of at least 1 - MISS. What moves to the buckets is codes alone:
the vectors themselves are fetched only for members of a bucket with a pair whose bound reaches
the threshold, and such pairs are computed again in double precision. Large buckets are worked
through in tiles that are dealt to different tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import components, stage, without

#: Probability that no run of bits brings a pair at the threshold together.
MISS = 1e-4
#: Vectors that a bucket should hold, rows of a tile, and pairs that are computed exactly at a time.
BUCKET, TILE, CHUNK = 64, 1024, 32_768
#: Rows of codes, and of vectors, that a task should work through at once.
CODE_ROWS, VECTOR_ROWS = 20_000, 5_000
#: Standard deviations of the estimate's error that the bound leaves room for.
SURE = 5.0
#: Rotated coordinates are at least so many; rounded ones lie in -LEVEL..LEVEL steps, in four bits.
LEAST_WIDTH, LEVEL, PLANES = 128, 7, 4


def code_width(dims: int) -> int:
    """Coordinates of a rotated vector: words of 64 bits, shorter vectors being filled up with zeros before."""
    return max(LEAST_WIDTH, -(-dims // 64) * 64)


@cache
def rotation(dims: int, width: int, seed: int) -> np.ndarray:
    """The first `dims` rows of a random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return (q * np.sign(np.diag(r)))[:dims]


def runs_needed(threshold: float, bits: int) -> int:
    """Runs of `bits` signs after which a pair at the threshold has met but for MISS."""
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(MISS) / math.log1p(-alike)))


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64)


def encode(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits (row, signs and PLANES planes, word), inner product with the signs' code, and step of the rounding."""
    width = code_width(unit.shape[1])
    turned = unit @ rotation(unit.shape[1], width, seed)
    step = np.abs(turned).max(axis=1) / LEVEL
    raised = np.random.default_rng(seed ^ 0x5EED).random(width)  # what is added before rounding down
    level = np.clip(np.floor(turned / step[:, None] + raised) + LEVEL, 0, 2 * LEVEL + 1).astype(np.uint8)
    planes = [_packed(turned >= 0), *(_packed((level >> k) & 1) for k in range(PLANES))]
    return np.stack(planes, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(width), step


def estimate(a: np.ndarray, factor: np.ndarray, b: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of all rows of `a`, by their signs, with all rows of `b`, by their planes."""
    words = a.shape[2]
    width = 64 * words
    total = np.zeros((len(a), len(b)), np.int32)
    for k in range(PLANES):
        both = np.zeros((len(a), len(b)), np.int32)
        for w in range(words):
            both += np.bitwise_count(a[:, None, 0, w] & b[None, :, 1 + k, w])
        total += (2 * both - np.bitwise_count(b[:, 1 + k]).sum(axis=1, dtype=np.int32)) << k
    total -= LEVEL * (2 * np.bitwise_count(a[:, 0]).sum(axis=1, dtype=np.int32) - width)[:, None]
    return total * step / (math.sqrt(width) * factor[:, None])


def deviation(factor: np.ndarray, step: np.ndarray, width: int, cosine: float) -> np.ndarray:
    """Standard deviation of the estimates of pairs with an inner product of `cosine`, no less than it is.

    Of the other vector only the part at right angles to the coded one is seen through the signs' error.
    """
    signs = np.sqrt(np.maximum(1 - factor**2, 0) * (1 - cosine**2) / max(1, width - 1))
    return np.hypot(signs[:, None], step[None, :] / 2) / factor[:, None]


def bucket_keys(unit: np.ndarray, bits: int, runs: int, seed: int) -> np.ndarray:
    """A key of `bits` signs for each row and run."""
    dims = unit.shape[1]
    turns = np.hstack([rotation(dims, dims, seed + 1 + k) for k in range(-(-bits * runs // dims))])[:, : bits * runs]
    signs = (unit @ turns >= 0).reshape(len(unit), runs, bits)
    return (signs * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _units(column: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(x, dtype=np.float64) for x in column])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """A vector without null, NaN or infinite components that is not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


CODE = "keys array<long>, code binary, factor double, step double"


def coder(bits: int, runs: int, seed: int) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, codes = [None] * len(batch), [b""] * len(batch)
            factors, steps = np.zeros(len(batch)), np.zeros(len(batch))
            lengths = batch.map(len).to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                unit = _units(batch.iloc[at])
                packed, factors[at], steps[at] = encode(unit, seed)
                for k, own, key in zip(at, packed, bucket_keys(unit, bits, runs, seed), strict=True):
                    codes[k], keys[k] = own.tobytes(), key
            yield pd.DataFrame({"keys": keys, "code": codes, "factor": factors, "step": steps})

    return run


TILE_KEY = ["dims", "run", "key", "t0", "t1"]


def _tiles(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, tile in rows.sort_values("c", kind="stable").groupby(TILE_KEY, sort=False):
        if len(tile) > 1:
            yield tile


def _open_pairs(tile: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in the tile of pairs whose estimate and error leave the threshold within reach."""
    side = tile["side"].to_numpy()
    left = np.flatnonzero(side == 0)
    right = left if len(left) == len(side) else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return left[:0], right[:0]
    bits = np.frombuffer(b"".join(tile["code"]), np.uint64).reshape(len(tile), 1 + PLANES, -1)
    factor, step = tile["factor"].to_numpy(), tile["step"].to_numpy()
    guess = estimate(bits[left], factor[left], bits[right], step[right])
    near = guess + SURE * deviation(factor[left], step[right], 64 * bits.shape[2], threshold) >= threshold
    x, y = np.nonzero(np.triu(near, 1) if right is left else near)
    return left[x], right[y]


def _find_open(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The members of each tile that have a pair to be computed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tile in _tiles(rows):
            x, y = _open_pairs(tile, threshold)
            out.append(tile.iloc[np.union1d(x, y)][["c", "side", *TILE_KEY]])
        return pd.concat(out) if out else rows.iloc[:0][["c", "side", *TILE_KEY]]

    return run


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (x, y)."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        np.minimum.at(after, root, after)
        after = after[after]
        if (after == root).all():
            break
        root = after
    return root


def _compute(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links of the open pairs from the vectors, without pairs that an earlier run has in one bucket."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tile in _tiles(rows):
            x, y = _open_pairs(tile, threshold)
            keys = np.stack(tile["keys"].to_numpy())
            for k in range(int(tile["run"].iloc[0])):
                apart = keys[x, k] != keys[y, k]
                x, y = x[apart], y[apart]
            if not len(x):
                continue
            unit = _units(tile["v"])
            linked = np.zeros(len(x), bool)
            for k in range(0, len(x), CHUNK):
                part = slice(k, k + CHUNK)
                linked[part] = np.einsum("ij,ij->i", unit[x[part]], unit[y[part]]) >= threshold
            x, y, n, copies = x[linked], y[linked], len(tile), tile["copies"].to_numpy()
            links = np.bincount(x, weights=copies[y], minlength=n) + np.bincount(y, weights=copies[x], minlength=n)
            told, c = np.flatnonzero(links), tile["c"].to_numpy()
            out.append(pd.DataFrame({"c": c[told], "links": links[told].astype(np.int64), "root": c[_roots(n, x, y)[told]]}))
        return pd.concat(out) if out else pd.DataFrame({"c": [], "links": [], "root": []})

    return run


def _cells(rows: DataFrame, n: int) -> DataFrame:
    """Many tiles to a task's share of rows."""
    return rows.withColumn("cell", F.pmod(F.xxhash64(*TILE_KEY), F.lit(max(1, n))))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, seed: int = 29, id_col: str = "vec_id", vector: str = "embedding", bucket: int = BUCKET) -> DataFrame:
    """`vectors` without the vector column, with n_links, component_id and kept for each row.

    n_links: other rows with a cosine of at least `threshold` to this one; component_id: the smallest
    id reachable by links; kept: whether that is its own. A pair under the threshold is never linked;
    one at it is missed with a probability of about MISS, one above with a smaller one. Equal vectors
    are compared once and counted as often as they stand. Vectors that are null, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths with one another.
    Rows that repeat an id are counted each and told apart by their vectors. A row with a null id gets no
    component and links with nothing. No rows give no rows; input columns named as an added one are replaced.
    """
    keep = [x for x in without(vectors, ["n_links", "component_id", "kept"]) if x != vector]
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"  # kept as they are, to move half the bytes
    double = F.col(vector) if single else F.col(vector).cast("array<double>")
    good = usable(double) & F.col(id_col).isNotNull()
    marked = vectors.select(F.struct(*keep).alias("_row"), F.col(id_col).alias("_id"), F.when(good, double).alias("v"), *(F.when(good, k).alias(f"k{i}") for i, k in enumerate((F.xxhash64(double), F.xxhash64(double, F.lit(1)), F.size(double)))))
    grouped = marked.where(F.col("k0").isNotNull()).groupBy("k0", "k1", "k2").agg(F.min("_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = stage(grouped.withColumn("c", F.monotonically_increasing_id()), "vector-classes")

    count, largest = classes.agg(F.count(F.lit(1)), F.coalesce(F.max("k2"), F.lit(1))).first()
    bits = max(4, min(largest * 4, 60, math.ceil(math.log2(max(2, count) / bucket))))
    runs = runs_needed(threshold, bits)
    code = F.pandas_udf(coder(bits, runs, seed), CODE)
    coded = stage(classes.withColumn("x", code("v")).select("c", "id", "copies", "v", "k0", "k1", F.col("k2").alias("dims"), "x.*"), "vector-codes")

    dealt = coded.select("c", "dims", "code", "factor", "step", F.posexplode("keys").alias("run", "key"))
    sizes = stage(dealt.groupBy("dims", "run", "key").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").withColumn("tiles", F.ceil(F.col("_m") / TILE).cast("int")), "vector-buckets")
    moved = sizes.agg(F.sum(F.col("_m") * F.col("tiles"))).first()[0] or 0
    placed = dealt.join(sizes.drop("_m"), ["dims", "run", "key"]).withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("t0"), F.greatest(t, F.col("tile")).alias("t1"), (t < F.col("tile")).cast("int").alias("side")))
    spread = placed.select("c", "code", "factor", "step", "dims", "run", "key", F.explode(pairs).alias("p")).select("*", "p.t0", "p.t1", "p.side").drop("p")
    found = _cells(spread, -(-moved // CODE_ROWS)).groupBy("cell").applyInPandas(_find_open(threshold), "c long, side int, dims int, run int, key long, t0 int, t1 int")
    open_ = stage(found, "vector-open")
    full = open_.join(coded.select("c", "copies", "v", "keys", "code", "factor", "step"), "c")
    links = stage(_cells(full, -(-open_.count() // VECTOR_ROWS)).groupBy("cell").applyInPandas(_compute(threshold), "c long, links long, root long"), "vector-links")

    reached = components(links.select("c", "root"), "c", "root", "vector").withColumnRenamed("id", "c")
    least = reached.join(coded.select("c", "id"), "c").groupBy("component").agg(F.min("id").alias("component_id"))
    counted = links.groupBy("c").agg(F.sum("links").alias("_links"))
    named = coded.select("c", "id", "copies", "k0", "k1", F.col("dims").alias("k2")).join(counted, "c", "left").join(reached.join(least, "component"), "c", "left")
    told = named.select("k0", "k1", "k2", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    joined = marked.drop("v").join(told, ["k0", "k1", "k2"], "left")
    own = F.coalesce("component_id", "_id")
    return joined.select("_row.*", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("_id") == own).alias("kept"))
