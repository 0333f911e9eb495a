"""Embeddings of distance matrices: dense kernels that run one step to a task.

Every kernel takes a symmetric distance matrix and gives an n x dims array. Rotation and sign are
free, so results are compared by their distances and their stress.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.structure import FAR, FLOOR

AUTO_EXACT_NODES, COARSEST = 800, 30
#: Vectors of a block, and of a block those that are held against another one at once.
BLOCK_VECTORS, VECTORS_AT_ONCE = 4096, 128
#: Points whose distances to the pivots are dense at once, and last points whose rows are fetched as pivots.
POINTS_AT_ONCE, ROWS_AHEAD = 1 << 14, 1024


def gaps(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    y = x if y is None else y
    return np.sqrt(np.maximum(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2), 0))


def stress(dist: np.ndarray, coords: np.ndarray) -> float:
    at = np.triu_indices(len(dist), 1)
    whole = (dist[at] ** 2).sum()
    return float(np.sqrt(((gaps(coords)[at] - dist[at]) ** 2).sum() / whole)) if whole >= 1e-15 else 0.0


def centered(m: np.ndarray) -> np.ndarray:
    return m - m.mean(axis=0, keepdims=True) - m.mean(axis=1, keepdims=True) + m.mean()


def classical(dist: np.ndarray, dims: int) -> np.ndarray:
    """Leading eigenvectors of the double-centred squares, each scaled by the root of its value; largest entries positive."""
    values, vectors = np.linalg.eigh(-0.5 * centered(dist**2))
    order = np.argsort(-values, kind="stable")[:dims]
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(axis=0), order] + 1e-300)
    out = np.zeros((len(dist), dims))
    out[:, : len(order)] = vectors * np.sqrt(np.maximum(values[order], 0))
    return out


def lcg_start(n: int, dims: int, seed: int) -> np.ndarray:
    """Coordinates of a 64-bit linear congruential generator."""
    state, out = seed & 0xFFFFFFFFFFFFFFFF, []
    for _ in range(n * dims):
        state = (state * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        out.append((state >> 33) / 0xFFFFFFFF - 0.5)
    return np.array(out).reshape(n, dims)


def guttman(dist: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = gaps(x)
    ratio = np.where(d > 1e-15, dist / np.where(d > 1e-15, d, 1.0), 0.0)
    np.fill_diagonal(ratio, 0.0)
    return (ratio.sum(axis=1)[:, None] * x - ratio @ x) / len(x)


def smacof(dist: np.ndarray, dims: int, rounds: int = 300, tolerance: float = 1e-6, seed: int | None = None) -> np.ndarray:
    """Majorisation from the classical solution, or from the generator's points with a seed."""
    x = classical(dist, dims) if seed is None else lcg_start(len(dist), dims, seed)
    x = x - x.mean(axis=0)
    last = stress(dist, x)
    for _ in range(rounds):
        x = guttman(dist, x)
        now = stress(dist, x)
        if abs(last - now) < tolerance:
            break
        last = now
    return x - x.mean(axis=0)


def farthest_points(dist: np.ndarray, k: int) -> list[int]:
    """Points that each lie as far as can be from those before, from the first on; of equals the last."""
    chosen, nearest = [0], dist[0].copy()
    while len(chosen) < min(k, len(dist)):
        nearest[chosen] = -1
        best = int(len(nearest) - 1 - nearest[::-1].argmax())
        chosen.append(best)
        nearest = np.minimum(nearest, dist[best])
    return chosen


def pivot_count(n: int) -> int:
    return min(max(50, min(200, int(np.sqrt(n)))), n)


def pivot(dist: np.ndarray, dims: int, pivots: int | None = None) -> np.ndarray:
    """Scaling from the distances to a few pivots alone."""
    rows = dist[farthest_points(dist, pivots or pivot_count(len(dist)))]
    _, s, vt = np.linalg.svd(-0.5 * centered(rows**2), full_matrices=False)
    out = np.zeros((len(dist), dims))
    k = min(dims, len(s))
    vectors = vt[:k].T
    out[:, :k] = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] + 1e-300) * s[:k]
    return out - out.mean(axis=0)


def landmark_model(dist: np.ndarray, dims: int, landmarks: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Landmarks, their coordinates, the matrix that projects squared distances, and the mean squares it needs."""
    at = farthest_points(dist, min(max(landmarks, dims + 1), len(dist)))
    inner = dist[np.ix_(at, at)]
    own = classical(inner, dims)
    return at, own, np.linalg.pinv(own, rcond=1e-6), (inner**2).mean(axis=0)


def landmark(dist: np.ndarray, dims: int, landmarks: int = 10) -> np.ndarray:
    at, own, project, mean = landmark_model(dist, dims, landmarks)
    if np.linalg.matrix_rank(own, tol=1e-6 * max(1e-300, np.abs(own).max())) < dims:
        return classical(dist, dims)
    out = (-0.5 * (dist[:, at] ** 2 - mean)) @ project.T
    out[at] = own
    return out


def multilevel(dist: np.ndarray, dims: int, levels: int = 5, refine: int = 30) -> np.ndarray:
    """Solve a coarse choice of points, then place and refine twice as many again and again."""
    order, sizes, n = farthest_points(dist, len(dist)), [], len(dist)
    while n > COARSEST and len(sizes) < levels:
        sizes.append(n)
        n = -(-n // 2)
    placed = order[:n]
    x = classical(dist[np.ix_(placed, placed)], dims)
    for size in reversed(sizes):
        more = order[len(placed) : size]
        far = dist[np.ix_(more, placed)]
        close = np.argsort(far, axis=1, kind="stable")[:, :5]
        d = np.take_along_axis(far, close, axis=1)
        w = np.where(d < 1e-15, 1e15, 1.0 / np.maximum(d, 1e-15))
        x = np.vstack([x, (w[:, :, None] * x[close]).sum(axis=1) / w.sum(axis=1)[:, None]])
        placed = order[:size]
        part = dist[np.ix_(placed, placed)]
        last = stress(part, x)
        for _ in range(refine):
            x = guttman(part, x)
            now = stress(part, x)
            if abs(last - now) < 1e-6:
                break
            last = now
    out = np.zeros_like(x)
    out[placed] = x
    return out


def force_directed(dist: np.ndarray, dims: int, rounds: int = 500, heat: float = 100.0, cooling: float = 0.95, asymmetry: float = 0.5, directed: bool = False, seed: int = 42) -> np.ndarray:
    """Springs whose pull grows with the distance given, against repulsion between all."""
    n, k = len(dist), 10.0
    dims = min(max(dims, 2), 3)
    x = np.random.default_rng(seed).uniform(-k, k, (n, dims))
    pull = np.where(dist > 1e-12, dist, 0.0)
    if directed:
        pull = pull * (1 - asymmetry / 2) + pull.T * (1 + asymmetry / 2)
    for _ in range(rounds):
        delta = x[None, :, :] - x[:, None, :]
        d = np.maximum(np.sqrt((delta**2).sum(axis=2)), 1e-6)
        force = d**2 / k * pull - k * k / d
        np.fill_diagonal(force, 0.0)
        move = (delta / d[:, :, None] * force[:, :, None]).sum(axis=1)
        size = np.maximum(np.sqrt((move**2).sum(axis=1, keepdims=True)), 1e-6)
        x = x + move / size * np.minimum(size, heat)
        heat *= cooling
    return x


def affinities(dist: np.ndarray, perplexity: float = 30.0) -> np.ndarray:
    """Symmetric neighbour probabilities, each row's precision found by bisection on its entropy."""
    n = len(dist)
    target, out = np.log(min(perplexity, max(1.0, (n - 1) / 3))), np.zeros((n, n))
    for i in range(n):
        d2, low, high, beta = np.delete(dist[i], i) ** 2, 0.0, np.inf, 1.0
        for _ in range(50):
            p = np.exp(-beta * (d2 - d2.min()))
            p /= p.sum()
            error = -(p[p > 0] * np.log(p[p > 0])).sum() - target
            if abs(error) < 1e-5:
                break
            low, high = (beta, high) if error > 0 else (low, beta)
            beta = 2 * beta if np.isinf(high) else (low + high) / 2
        out[i, np.arange(n) != i] = p
    return np.maximum((out + out.T) / (2 * n), 1e-12)


def tsne(dist: np.ndarray, dims: int, perplexity: float = 30.0, rounds: int = 1000, rate: float = 200.0, seed: int = 42) -> np.ndarray:
    n, dims = len(dist), min(max(dims, 1), 3)
    p = affinities(dist, perplexity)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, dims))
    speed, gain = np.zeros_like(y), np.ones_like(y)
    for k in range(rounds):
        q = 1.0 / (1.0 + gaps(y) ** 2)
        np.fill_diagonal(q, 0.0)
        force = (p * (4.0 if k < 250 else 1.0) - np.maximum(q / max(q.sum(), 1e-300), 1e-12)) * q
        grad = 4 * (force.sum(axis=1)[:, None] * y - force @ y)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(speed), gain + 0.2, gain * 0.8), 0.01)
        speed = (0.5 if k < 250 else 0.8) * speed - rate * gain * grad
        y = y + speed
        y -= y.mean(axis=0)
    return y


def fuzzy_graph(dist: np.ndarray, neighbours: int = 15) -> np.ndarray:
    """Fuzzy union of each point's smoothed nearest neighbours."""
    n = len(dist)
    k = max(1, min(neighbours, n - 1))
    out = np.zeros((n, n))
    for i in range(n):
        near = np.lexsort((np.arange(n), np.where(np.arange(n) == i, np.inf, dist[i])))[:k]
        d = dist[i, near]
        low, high, sigma = 0.0, np.inf, 1.0
        for _ in range(64):
            total = np.exp(-np.maximum(d - d[0], 0) / sigma).sum()
            if abs(total - np.log2(k)) < 1e-5:
                break
            low, high = (low, sigma) if total > np.log2(k) else (sigma, high)
            sigma = 2 * sigma if np.isinf(high) else (low + high) / 2
        out[i, near] = np.exp(-np.maximum(d - d[0], 0) / max(sigma, 1e-10))
    return out + out.T - out * out.T


def umap(dist: np.ndarray, dims: int, neighbours: int = 15, epochs: int = 200, min_dist: float = 0.1, rate: float = 1.0, negatives: int = 5, compat: bool = False, seed: int = 42) -> np.ndarray:
    """Layout of the fuzzy graph. compat: neighbours are pushed apart, as a sign error in circulation has it."""
    n, dims = len(dist), min(max(dims, 1), 3)
    graph, rng = fuzzy_graph(dist, neighbours), np.random.default_rng(seed)
    y = rng.uniform(-5, 5, (n, dims))
    i, j = np.nonzero(np.triu(graph, 1) > 1e-6)
    a, b = 1.93 * min_dist**-0.34 if compat else 1.577, 0.79 if compat else 0.895
    way = -1.0 if compat else 1.0
    for epoch in range(epochs if len(i) else 0):
        alpha = rate * (1 - epoch / epochs)
        diff = y[i] - y[j]
        d2 = np.maximum((diff**2).sum(axis=1), 1e-12)
        pull = np.clip((graph[i, j] * -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))[:, None] * diff, -4, 4)
        np.add.at(y, i, way * alpha * pull)
        np.add.at(y, j, -way * alpha * pull)
        for _ in range(negatives):
            other = rng.integers(0, n, len(i))
            diff = y[i] - y[other]
            d2 = (diff**2).sum(axis=1)
            push = np.where(other == i, 0.0, 2 * b / ((0.001 + d2) * (1 + a * np.maximum(d2, 1e-12) ** b)))
            np.add.at(y, i, alpha * np.clip(push[:, None] * diff, -4, 4))
    return y


def auto(dist: np.ndarray, dims: int) -> np.ndarray:
    return classical(dist, dims) if len(dist) < AUTO_EXACT_NODES else pivot(dist, dims)


KERNELS: dict[str, Callable[..., np.ndarray]] = {"auto": auto, "classical": classical, "smacof": smacof, "pivot": pivot, "landmark": landmark, "multilevel": multilevel, "force_directed": force_directed, "tsne": tsne, "umap": umap}


def resolve_dims(mode: str | int, n: int) -> int:
    """visual: 2; maximum: n - 1; a number: at most n - 1."""
    return 2 if mode == "visual" else max(n - 1, 1) if mode == "maximum" else min(int(mode), max(n - 1, 1))


def embed(cells: DataFrame, algorithm: str = "auto", dims: str | int = 2, **options: object) -> DataFrame:
    """(step, i, coord, stress, algorithm) of the matrices (step, i, j, d), each embedded in a task of its own."""
    kinds = {x.name: x.dataType.simpleString() for x in cells.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(part["i"].to_numpy())
        if len(ids) < 2:
            raise ValueError("an embedding needs at least two nodes")
        dist = np.zeros((len(ids), len(ids)))
        dist[np.searchsorted(ids, part["i"].to_numpy()), np.searchsorted(ids, part["j"].to_numpy())] = part["d"].to_numpy()
        x = KERNELS[algorithm](dist, resolve_dims(dims, len(ids)), **options)
        return pd.DataFrame({"step": part["step"].iloc[0], "i": ids, "coord": list(x), "stress": stress(dist, x), "algorithm": algorithm})

    return cells.groupBy("step").applyInPandas(run, f"step {kinds['step']}, i {kinds['i']}, coord array<double>, stress double, algorithm string")


def _gap(similarity: np.ndarray, method: str) -> np.ndarray:
    """structure.similarity_to_distance off the diagonal."""
    if method == "info":
        found = np.where(similarity > 0, np.minimum(-np.log(np.where(similarity > 0, similarity, 1.0)), FAR), FAR)
    else:
        found = np.maximum(1 - similarity, 0.0) if method == "linear" else np.sqrt(np.maximum(1 - similarity * similarity, 0.0))
    return np.maximum(found, FLOOR)


def place_rows(i: np.ndarray, j: np.ndarray, similarity: np.ndarray, n: int, ahead: int, method: str, dims: int) -> np.ndarray | None:
    """What `auto` gives for n points of which most pairs have no similarity, from the rows of point 0 and of the last `ahead` points; None if it takes other rows.

    Beyond AUTO_EXACT_NODES a pivot's row is the only thing needed of it; singular vectors come from
    the pivots' products, which are summed over blocks of points.
    """
    order = np.lexsort((j, i))
    i, j, d = i[order], j[order], _gap(similarity[order], method)
    far = _gap(np.zeros(1), method)[0]
    of = lambda p: slice(*np.searchsorted(i, [p, p + 1]))

    def row(p: int) -> np.ndarray:
        out = np.full(n, far)
        out[j[of(p)]] = d[of(p)]
        out[p] = 0.0
        return out

    if n < AUTO_EXACT_NODES:
        return classical(np.stack([row(p) for p in range(n)]), dims) if n <= ahead else None
    chosen, nearest = [0], row(0)
    while len(chosen) < pivot_count(n):
        nearest[chosen] = -1
        best = int(n - 1 - nearest[::-1].argmax())
        if best < n - ahead:
            return None
        chosen.append(best)
        nearest = np.minimum(nearest, row(best))

    def squares() -> Iterator[np.ndarray]:
        for begin in range(0, n, POINTS_AT_ONCE):
            end = min(begin + POINTS_AT_ONCE, n)
            out = np.full((len(chosen), end - begin), far * far)
            for k, p in enumerate(chosen):
                own = of(p)
                own = slice(*(own.start + np.searchsorted(j[own], [begin, end])))
                out[k, j[own] - begin] = d[own] ** 2
                if begin <= p < end:
                    out[k, p - begin] = 0.0
            yield out

    mean = sum(m.sum(axis=1) for m in squares()) / n
    centred = lambda: (-0.5 * (m - m.mean(axis=0) - mean[:, None] + mean.mean()) for m in squares())
    _, vectors = np.linalg.eigh(sum(m @ m.T for m in centred()))
    found = np.concatenate([m.T @ vectors[:, ::-1][:, :dims] for m in centred()])
    out = np.zeros((n, dims))
    out[:, : found.shape[1]] = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])] + 1e-300)
    return out - out.mean(axis=0)


def embed_rows(rows: DataFrame, sizes: DataFrame, ahead: int, method: str, dims: str | int) -> DataFrame:
    """(step, i, coord) from similarities (step, i, j, s), as `place_rows` wants them, and sizes (step, n), a step to a task; a row without coord if a step takes more rows."""
    kind = next(x.dataType.simpleString() for x in sizes.schema if x.name == "step")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        n, own = int(part["n"].max()), part[part["i"] >= 0]
        if n < 2:
            raise ValueError("an embedding needs at least two nodes")
        x = place_rows(own["i"].to_numpy(), own["j"].to_numpy(), own["s"].to_numpy(), n, ahead, method, resolve_dims(dims, n))
        at = range(n) if x is not None else [0]
        return pd.DataFrame({"step": part["step"].iloc[0], "i": at, "coord": list(x) if x is not None else [None]})

    marks = sizes.select("step", F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0.0).alias("s"), "n")
    return rows.select("step", "i", "j", "s", F.lit(0).cast("long").alias("n")).union(marks).groupBy("step").applyInPandas(run, f"step {kind}, i int, coord array<double>")


def project_points(points: DataFrame, own: np.ndarray, mean: np.ndarray) -> DataFrame:
    """`points` (with `dists`, distances to the landmarks) and their coordinates; works on streams as well."""
    weights = np.linalg.pinv(own, rcond=1e-6)
    shift = F.zip_with("dists", F.array(*map(F.lit, map(float, mean))), lambda d, m: -0.5 * (d * d - m))
    dot = lambda row: F.aggregate(F.zip_with(shift, F.array(*map(F.lit, map(float, row))), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return points.withColumn("coord", F.array(*map(dot, weights)))


def svd_rank(n: int) -> int:
    """Dimensions kept of n: a fifth, at least 10 and at most 100, and fewer than n."""
    return n if n <= 1 else 1 if n == 2 else min(max(n // 5, 10), 100, n - 1)


def svd_similarity(ppmi: np.ndarray, rank: int | None = None) -> np.ndarray:
    """Cosines of the rows of the leading singular vectors, scaled by the roots of their values; where there are none, the matrix over its largest value."""
    rank = rank or svd_rank(len(ppmi))
    try:
        u, s, _ = np.linalg.svd(ppmi, full_matrices=False)
    except np.linalg.LinAlgError:
        most = ppmi.max(initial=0.0)
        return np.clip(ppmi / most, 0, 1) if most >= 1e-15 else np.zeros_like(ppmi)
    e = u[:, :rank] * np.sqrt(s[:rank])
    norm = np.sqrt((e * e).sum(axis=1))
    both = np.outer(norm, norm)
    out = np.clip(np.where(both > 1e-15, (e @ e.T) / np.where(both > 1e-15, both, 1.0), 0.0), 0, 1)
    np.fill_diagonal(out, 1.0)
    return out


def low_rank_similarity(scored: DataFrame) -> DataFrame:
    """(slice_id, a, b, similarity) of (slice_id, a, b, ppmi), similar pairs in both directions; a slice's dense matrix to a task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([part["a"], part["b"]]).astype(str))
        m = np.zeros((len(names), len(names)))
        m[np.searchsorted(names, part["a"].astype(str)), np.searchsorted(names, part["b"].astype(str))] = part["ppmi"]
        s = svd_similarity(m)
        np.fill_diagonal(s, 0.0)
        i, j = np.nonzero(s > 0)
        return pd.DataFrame({"slice_id": part["slice_id"].iloc[0], "a": names[i], "b": names[j], "similarity": s[i, j]})

    return scored.groupBy("slice_id").applyInPandas(run, "slice_id string, a string, b string, similarity double")


def cosines(vectors: DataFrame, key: str, vector: str, group: str, digits: int) -> DataFrame:
    """(i, j, cosine) of all pairs i < j of the vectors of a group: as many rows as pairs, in memory of two blocks.

    A pair of blocks goes to a task. The cosine is null where a vector is null or has a null in it, or lengths differ, and NaN with a zero vector.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(group).alias("g"), F.col(vector).alias("v")).where("id IS NOT NULL AND g IS NOT NULL")
    parts = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("parts"))
    tasks = parts.agg(F.sum(F.col("parts") * (F.col("parts") + 1) / 2)).first()[0] or 1
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = rows.join(parts, "g").withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("g", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "id", "v")
    kind = next(x.dataType.simpleString() for x in rows.schema if x.name == "id")

    def block(table: pa.Table, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, vectors as rows of a matrix over their lengths, and numbers of components, -1 where the vector has no cosine."""
        own = table.filter(pc.equal(table["b"], b)).combine_chunks()
        found = [v.values.to_numpy().astype(float) if v.is_valid and not v.values.null_count else None for v in own["v"]]
        sizes = np.array([-1 if v is None else len(v) for v in found])
        whole = np.zeros((len(found), max(sizes.max(initial=0), 0)))
        for k, v in enumerate(found):
            if v is not None:
                whole[k, : len(v)] = v
        with np.errstate(invalid="ignore", divide="ignore"):
            whole /= np.sqrt((whole * whole).sum(axis=1))[:, None]
        return own["id"].to_numpy(), whole, sizes

    def compared(table: pa.Table, p: int, q: int) -> Iterator[pa.RecordBatch]:
        a = block(table, p)
        b = a if p == q else block(table, q)
        width = max(a[1].shape[1], b[1].shape[1])
        x, y = (np.pad(m[1], ((0, 0), (0, width - m[1].shape[1]))) for m in (a, b))
        for k in range(0, len(x), VECTORS_AT_ONCE):
            ids, sizes = a[0][k : k + VECTORS_AT_ONCE, None], a[2][k : k + VECTORS_AT_ONCE, None]
            wanted = ids < b[0][None, :] if p == q else ids != b[0][None, :]
            value = np.clip(x[k : k + VECTORS_AT_ONCE] @ y.T, -1, 1)[wanted]
            none = ((sizes != b[2][None, :]) | (sizes < 0))[wanted]
            left, right = (np.broadcast_to(m, wanted.shape)[wanted] for m in (ids, b[0][None, :]))
            columns = [pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right)), pa.array(np.round(value, digits) + 0.0, mask=none)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("g", "p", "q")), strict=True))
            begin = 0
            for k in range(len(keys) + 1):
                if k == len(keys) or (k > begin or held) and keys[k] != (keys[k - 1] if k > begin else last):
                    if k > begin:
                        held.append(batch.slice(begin, k - begin))
                        last, begin = keys[k - 1], k
                    if k < len(keys):
                        yield from compared(pa.Table.from_batches(held), *last[1:])
                        held = []
        if held:
            yield from compared(pa.Table.from_batches(held), *last[1:])

    return dealt.repartition(int(min(tasks, 10_000)), "g", "p", "q").sortWithinPartitions("g", "p", "q").mapInArrow(run, f"i {kind}, j {kind}, cosine double")
