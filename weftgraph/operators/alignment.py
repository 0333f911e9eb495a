"""Procrustes alignment of series of embeddings.

An alignment of two configurations needs only their means and moments. A series is aligned from the
moments of all pairs of steps, which executors add up node by node; the driver turns these few
numbers into a rotation, scale and shift for each step, applied as column expressions. The numpy
functions do the same for configurations in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.tables import cut_lineage

CANDIDATES = 8


@dataclass
class Fit:
    aligned: np.ndarray
    rotation: np.ndarray
    scale: float
    translation: np.ndarray
    residual: float


def procrustes(source: np.ndarray, target: np.ndarray, shared: tuple[list[int], list[int]] | None = None, scaling: bool = False, weights: np.ndarray | None = None, compat: bool = False) -> Fit:
    """Rotate, shift and, with `scaling`, scale `source` onto `target` over the shared rows.

    compat applies the transpose of the best rotation, as some implementations do; quarter turns are
    then not undone. Weights below 0 count as 0; the residual is not weighted.
    """
    a, b = (source, target) if shared is None else (source[shared[0]], target[shared[1]])
    if len(a) < 2:
        raise ValueError("alignment needs at least two shared labels")
    w = np.ones(len(a)) if weights is None else np.maximum(weights, 0.0)
    total = max(w.sum(), 1e-15)
    ca, cb = (w @ a) / total, (w @ b) / total
    u, s, vt = np.linalg.svd(((a - ca) * w[:, None]).T @ (b - cb))
    flip = np.ones(len(s))
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        flip[-1] = -1
    rotation = (u * flip) @ vt
    rotation = rotation.T if compat else rotation
    spread = (w[:, None] * (a - ca) ** 2).sum()
    scale = float((s * flip).sum() / spread) if scaling and spread > 1e-15 else 1.0
    shift = cb - scale * ca @ rotation
    aligned = scale * source @ rotation + shift
    fitted = aligned if shared is None else aligned[shared[0]]
    return Fit(aligned, rotation, scale, shift, float(((fitted - b) ** 2).sum()))


def gpa(configs: list[np.ndarray], rounds: int = 50, tolerance: float = 1e-8, scaling: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Align all to their common mean again and again; the aligned configurations and the mean."""
    if not configs:
        return [], np.zeros((0, 0))
    mean, aligned = np.mean(configs, axis=0), list(configs)
    for _ in range(rounds if len(configs) > 1 else 0):
        aligned = [procrustes(x, mean, scaling=scaling).aligned for x in configs]
        after = np.mean(aligned, axis=0)
        moved, mean = np.abs(after - mean).max(), after
        if moved < tolerance:
            break
    return aligned, mean


def align_series(configs: list[np.ndarray], mode: str, scaling: bool = False) -> list[Fit]:
    """none; timeseries: each to the one before as aligned; anchored: each to the first; optimal: each to the candidate of least total residual; gpa."""
    still = lambda x: Fit(x, np.eye(x.shape[1]), 1.0, np.zeros(x.shape[1]), 0.0)
    if mode == "none" or len(configs) < 2:
        return [still(x) for x in configs]
    if mode == "gpa":
        _, mean = gpa(configs, scaling=scaling)
        return [procrustes(x, mean, scaling=scaling) for x in configs]
    if mode == "timeseries":
        out = [still(configs[0])]
        for x in configs[1:]:
            out.append(procrustes(x, out[-1].aligned, scaling=scaling))
        return out
    at = 0
    if mode == "optimal":
        k = min(CANDIDATES, len(configs))
        options = sorted({round(x) for x in np.linspace(0, len(configs) - 1, k)})
        at = min(options, key=lambda c: sum(procrustes(x, configs[c], scaling=scaling).residual for x in configs))
    elif mode != "anchored":
        raise ValueError(f"no alignment mode {mode}")
    return [still(x) if k == at else procrustes(x, configs[at], scaling=scaling) for k, x in enumerate(configs)]


@dataclass
class Turn:
    """A step's transform, row vectors from the left: scale * x @ rotation + shift."""

    rotation: np.ndarray
    scale: float
    shift: np.ndarray
    residual: float = 0.0


class Series:
    """Means and centred moments of all pairs of steps, and fits of steps to weighted sums of turned steps."""

    def __init__(self, sums: np.ndarray, products: np.ndarray, n: int):
        self.n, self.means = n, sums / n
        self.moments = products - np.einsum("ap,bq->abpq", sums, self.means)
        self.steps, self.dims = sums.shape

    def still(self) -> Turn:
        return Turn(np.eye(self.dims), 1.0, np.zeros(self.dims))

    def combined(self, turns: dict[int, Turn]) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """The mean of turned steps as a matrix for each centred step, and its centre."""
        k = len(turns)
        return {j: t.scale * t.rotation / k for j, t in turns.items()}, sum(t.scale * self.means[j] @ t.rotation + t.shift for j, t in turns.items()) / k

    def square(self, parts: dict[int, np.ndarray]) -> float:
        return float(sum(np.trace(p.T @ self.moments[i, j] @ q) for i, p in parts.items() for j, q in parts.items()))

    def fit(self, step: int, target: dict[int, Turn], scaling: bool) -> Turn:
        """`step` turned onto the mean of the turned steps of `target`."""
        parts, centre = self.combined(target)
        m = sum(self.moments[step, j] @ p for j, p in parts.items())
        u, s, vt = np.linalg.svd(m)
        flip = np.ones(len(s))
        if np.linalg.det(u) * np.linalg.det(vt) < 0:
            flip[-1] = -1
        rotation, spread = (u * flip) @ vt, float(np.trace(self.moments[step, step]))
        scale = float((s * flip).sum() / spread) if scaling and spread > 1e-15 else 1.0
        residual = scale * scale * spread - 2 * scale * float((s * flip).sum()) + self.square(parts)
        return Turn(rotation, scale, centre - scale * self.means[step] @ rotation, max(residual, 0.0))

    def consensus(self, scaling: bool, rounds: int = 50, tolerance: float = 1e-8) -> dict[int, Turn]:
        """Turns whose mean is the consensus, from the steps as they are."""
        turns = {k: self.still() for k in range(self.steps)}
        for _ in range(rounds):
            after = {k: self.fit(k, turns, scaling) for k in turns}
            (old, c0), (new, c1) = self.combined(turns), self.combined(after)
            moved = self.square({k: new[k] - old[k] for k in turns}) + self.n * float(((c1 - c0) ** 2).sum())
            turns = after
            if moved < tolerance**2:
                break
        return turns

    def turns(self, mode: str, scaling: bool) -> list[Turn]:
        """The modes of `align_series`."""
        every = range(self.steps)
        if mode == "none" or self.steps < 2:
            return [self.still() for _ in every]
        if mode == "gpa":
            mean = self.consensus(scaling)
            return [self.fit(k, mean, scaling) for k in every]
        if mode == "timeseries":
            out = [self.still()]
            for k in every[1:]:
                out.append(self.fit(k, {k - 1: out[-1]}, scaling))
            return out
        at = 0
        if mode == "optimal":
            options = sorted({round(x) for x in np.linspace(0, self.steps - 1, min(CANDIDATES, self.steps))})
            at = min(options, key=lambda c: sum(self.fit(k, {c: self.still()}, scaling).residual for k in every))
        elif mode != "anchored":
            raise ValueError(f"no alignment mode {mode}")
        return [self.still() if k == at else self.fit(k, {at: self.still()}, scaling) for k in every]


def pair_moments(coords: DataFrame) -> tuple[list, Series]:
    """The steps in order, and their Series. All steps hold the same nodes; executors add up, the driver sees (steps x dims) squared numbers."""
    steps = sorted(x.step for x in coords.select("step").distinct().collect())
    one = coords.select(F.size("coord").alias("d")).first()
    dims, place = (one.d if one else 0), {x: k for k, x in enumerate(steps)}
    width = len(steps) * dims
    together = coords.groupBy("i").agg(F.collect_list(F.struct("step", "coord")).alias("rows"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((width + 1, width + 1)), 0
        for batch in batches:
            x = np.ones((len(batch), width + 1))
            for k, rows in enumerate(batch["rows"]):
                if len(rows) != len(steps):
                    raise ValueError("all steps have to hold the same nodes")
                for r in rows:
                    at = place[r["step"]] * dims
                    x[k, at : at + dims] = r["coord"]
            total, count = total + x.T @ x, count + len(batch)
        if count:
            yield pd.DataFrame({"cell": np.arange(total.size), "v": total.ravel()})

    cells = together.mapInPandas(add, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((width + 1) ** 2)
    for x in cells:
        total[x.cell] = x.v
    total = total.reshape(width + 1, width + 1)
    products = total[:width, :width].reshape(len(steps), dims, len(steps), dims).transpose(0, 2, 1, 3)
    return steps, Series(total[width, :width].reshape(len(steps), dims), products, max(1, round(total[width, width])))


def align(coords: DataFrame, mode: str, scaling: bool = False) -> DataFrame:
    """(step, i, coord, residual): the series aligned in the order of its steps. All steps hold the same nodes."""
    coords = cut_lineage(coords.select("step", "i", "coord"))
    steps, series = pair_moments(coords)
    rows = [(s, [[float(v) for v in c] for c in t.rotation.T], t.scale, [float(v) for v in t.shift], t.residual) for s, t in zip(steps, series.turns(mode, scaling), strict=True)]
    turns = coords.sparkSession.createDataFrame(rows, f"step {coords.schema['step'].dataType.simpleString()}, _r array<array<double>>, _s double, _t array<double>, residual double")
    dot = lambda c: F.aggregate(F.zip_with("coord", c, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    moved = F.zip_with(F.transform("_r", dot), "_t", lambda x, t: F.col("_s") * x + t)
    return coords.select("step", "i", "coord").join(F.broadcast(turns), "step").select("step", "i", moved.alias("coord"), "residual")  # a row a step


def shared_labels(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of both sides with the same label; of equal labels in the target the last stands."""
    last = target.groupBy("label").agg(F.max("row_ord").alias("target_ord"))
    return source.select("label", F.col("row_ord").alias("source_ord")).join(last, "label")


def moments(coords: DataFrame, lag: int = 1) -> DataFrame:
    """(step, p, q, m): sums of products of the centred coordinates of each step and of the one `lag` before."""
    flat = coords.select("step", "i", F.posexplode("coord").alias("p", "v"))
    centred = flat.join(flat.groupBy("step", "p").agg(F.avg("v").alias("mean")), ["step", "p"]).select("step", "i", "p", (F.col("v") - F.col("mean")).alias("a"))
    before = centred.select((F.col("step") + lag).alias("step"), "i", F.col("p").alias("q"), F.col("a").alias("b"))
    return centred.join(before, ["step", "i"]).groupBy("step", "p", "q").agg(F.sum(F.col("a") * F.col("b")).alias("m"))


def consensus(coords: DataFrame) -> DataFrame:
    """(i, dim, x): mean coordinates over the steps."""
    return coords.select("i", F.posexplode("coord").alias("dim", "v")).groupBy("i", "dim").agg(F.avg("v").alias("x"))


def normalize(coords: DataFrame, reach: float, per_step: bool = True) -> DataFrame:
    """Scale so that the largest absolute coordinate of each step, or of all, is `reach`; all but zero stays as it is."""
    own = F.array_max(F.transform("coord", F.abs))
    scale = F.when(F.col("_most") < 1e-15, 1.0).otherwise(reach / F.when(F.col("_most") >= 1e-15, F.col("_most")))
    if not per_step:
        most_df = coords.agg(F.max(own).alias("_most"))
        ready = coords.crossJoin(F.broadcast(most_df))
    else:
        ready = coords.join(coords.groupBy("step").agg(F.max(own).alias("_most")), "step")
    return ready.withColumn("_s", scale).withColumn("coord", F.transform("coord", lambda x: x * F.col("_s"))).drop("_most", "_s")
