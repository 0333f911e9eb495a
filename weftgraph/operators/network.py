"""Relational networks over time: edges, degrees, shortest paths and centralities.

An adjacency is a sparse table (step, i, j, w) with a table of nodes (step, i). Work that searches
from each source is dealt by (step, block of sources): a group holds one step's edges and a block
of sources, so a step spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.tables import cut_lineage

SOURCES_A_TASK = 64
EXACT_BETWEENNESS_NODES, SAMPLED_SOURCES = 1000, 100
TIE = 1e-12
#: Rounds and tolerance of iterations, and nodes of a step up to which its matrix goes to one task.
ROUNDS, TOLERANCE, DENSE_NODES = 100, 1e-10, 4000


def undirected_edges(adjacency: DataFrame) -> DataFrame:
    """Positive weights above the diagonal."""
    return adjacency.where("i < j and w > 0")


def directed_edges(adjacency: DataFrame) -> DataFrame:
    """Positive weights off the diagonal."""
    return adjacency.where("i <> j and w > 0")


def adjacency_edges(adjacency: DataFrame) -> DataFrame:
    """All weights off the diagonal that are not zero, negative ones included."""
    return adjacency.where("i <> j and w <> 0")


def both_ways(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return edges.select("step", F.explode(ways).alias("p"), "w").select("step", "p.i", "p.j", "w")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbours along `edges` (given in every direction that counts) over n - 1."""
    sizes = nodes.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    counted = edges.groupBy("step", "i").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("strength"))
    share = F.when(F.col("n") > 1, F.coalesce("k", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0)
    return nodes.join(counted, ["step", "i"], "left").join(F.broadcast(sizes), "step").select("step", "i", share.alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


class Graph:
    """One step's edges with costs 1 / w, from a group's rows."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, nodes: np.ndarray):
        self.nodes = np.unique(nodes)
        a, b = np.searchsorted(self.nodes, src), np.searchsorted(self.nodes, dst)
        order = np.argsort(a, kind="stable")
        self.targets, self.costs = b[order], 1.0 / w[order]
        self.starts = np.searchsorted(a[order], np.arange(len(self.nodes) + 1))

    def out(self, u: int) -> Iterator[tuple[int, float]]:
        at = slice(self.starts[u], self.starts[u + 1])
        return zip(self.targets[at].tolist(), self.costs[at].tolist(), strict=True)

    def distances(self, s: int) -> np.ndarray:
        return self.search(s)[0]

    def search(self, s: int) -> tuple[np.ndarray, list[int], np.ndarray, list[list[int]]]:
        """Distances, nodes in the order they were settled, numbers of shortest paths, and predecessors."""
        n = len(self.nodes)
        dist, paths, before, order = np.full(n, np.inf), np.zeros(n), [[] for _ in range(n)], []
        dist[s], paths[s], heap, done = 0.0, 1.0, [(0.0, s)], np.zeros(n, bool)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            order.append(u)
            for v, cost in self.out(u):
                far = d + cost
                if far + TIE < dist[v]:
                    dist[v], paths[v], before[v] = far, paths[u], [u]
                    heapq.heappush(heap, (far, v))
                elif abs(far - dist[v]) <= TIE and not done[v]:
                    paths[v] += paths[u]
                    before[v].append(u)
        return dist, order, paths, before

    def dependencies(self, s: int) -> np.ndarray:
        """Brandes' dependency of the source on every node."""
        _, order, paths, before = self.search(s)
        delta = np.zeros(len(self.nodes))
        for v in reversed(order):
            for u in before[v]:
                delta[u] += paths[u] / paths[v] * (1 + delta[v])
        delta[s] = 0.0
        return delta


def per_source(edges: DataFrame, nodes: DataFrame, sources: DataFrame, one: Callable[[Graph, int], np.ndarray], out: str, summed: bool) -> DataFrame:
    """Rows (step, s, t, out) of one array for each source, or (step, t, out) with the arrays of a group added up."""
    sizes = sources.groupBy("step").agg(F.ceil(F.count(F.lit(1)) / SOURCES_A_TASK).alias("_parts"))
    dealt = sources.join(sizes, "step").withColumn("_part", F.pmod(F.xxhash64("s"), F.col("_parts")).cast("int"))
    parts = dealt.select("step", "_part").distinct()
    wanted = dealt.select("step", "_part", F.lit(1).alias("kind"), F.col("s").alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("w"))
    linked = edges.join(parts, "step").select("step", "_part", F.lit(0).alias("kind"), F.col("i").alias("a"), F.col("j").alias("b"), "w")
    known = nodes.join(parts, "step").select("step", "_part", F.lit(2).alias("kind"), F.col("i").alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("w"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kind = rows["kind"].to_numpy()
        e, step = rows[kind == 0], rows["step"].iloc[0]
        graph = Graph(e["a"].to_numpy(), e["b"].to_numpy(), e["w"].to_numpy(), rows.loc[kind == 2, "a"].to_numpy())
        starts = np.sort(rows.loc[kind == 1, "a"].to_numpy())
        found = [one(graph, int(np.searchsorted(graph.nodes, s))) for s in starts]
        if summed:
            return pd.DataFrame({"step": step, "t": graph.nodes, out: np.sum(found, axis=0)})
        return pd.DataFrame({"step": step, "s": np.repeat(starts, len(graph.nodes)), "t": np.tile(graph.nodes, len(starts)), out: np.concatenate(found)})

    kinds = {x.name: x.dataType.simpleString() for x in nodes.schema}
    schema = f"step {kinds['step']}, " + ("" if summed else f"s {kinds['i']}, ") + f"t {kinds['i']}, {out} double"
    # dealt anew, as parts that are joined by step alone need not lie with one another
    return wanted.union(linked).union(known).repartition("step", "_part").groupBy("step", "_part").applyInPandas(run, schema)


def shortest_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(step, s, t, d): least cost from s to t over edges of cost 1 / w; infinite where t is out of reach."""
    return per_source(edges, nodes, nodes.select("step", F.col("i").alias("s")), Graph.distances, "d", False)


def path_centralities(paths: DataFrame) -> DataFrame:
    """(step, i, distance, closeness, harmonic): mean distance to all in reach, its inverse, and the mean inverse distance.

    distance is NaN where nothing is in reach, and closeness 0 there.
    """
    others = F.col("s") != F.col("t")
    reach = others & (F.col("d") < float("inf"))
    near = reach & (F.col("d") > 0)
    summed = paths.groupBy("step", F.col("s").alias("i")).agg(
        F.avg(F.when(reach, F.col("d"))).alias("mean"), F.coalesce(F.sum(F.when(near, 1 / F.when(F.col("d") > 0, F.col("d")))), F.lit(0.0)).alias("inverse"), F.count(F.lit(1)).alias("n")
    )
    closeness = F.when(F.col("mean") > 1e-15, 1 / F.when(F.col("mean") > 1e-15, F.col("mean"))).otherwise(0.0)
    harmonic = F.when(F.col("n") > 1, F.col("inverse") / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(0.0)
    return summed.select("step", "i", F.coalesce("mean", F.lit(float("nan"))).alias("distance"), closeness.alias("closeness"), harmonic.alias("harmonic"))


def betweenness(edges: DataFrame, nodes: DataFrame, sampled: int | None = None, seed: int = 42, exact_nodes: int = 0) -> DataFrame:
    """(step, i, betweenness): Brandes' shares over (n - 1)(n - 2), from all sources or, in steps of more than `exact_nodes` nodes, from `sampled` of them, scaled up."""
    sources = nodes.select("step", F.col("i").alias("s"))
    sizes = nodes.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    scale = F.lit(1.0)
    if sampled:
        drawn = Window.partitionBy("step").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("s").cast("string"))), "s")
        ranked = sources.withColumn("_r", F.row_number().over(drawn)).join(F.broadcast(sizes), "step")
        sources = ranked.where((F.col("_r") <= sampled) | (F.col("n") <= exact_nodes)).select("step", "s")
        scale = F.when(F.col("n") <= exact_nodes, 1.0).otherwise(F.greatest(F.col("n") / sampled, F.lit(1.0)))
    parts = per_source(edges, nodes, sources, Graph.dependencies, "d", True).groupBy("step", F.col("t").alias("i")).agg(F.sum("d").alias("d"))
    norm = F.when(F.col("n") > 2, (F.col("n") - 1) * (F.col("n") - 2)).otherwise(1)
    return nodes.join(parts, ["step", "i"], "left").join(F.broadcast(sizes), "step").select("step", "i", (F.coalesce("d", F.lit(0.0)) * scale / norm).alias("betweenness"))


def per_step(adjacency: DataFrame, nodes: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], columns: str) -> DataFrame:
    """Run a dense kernel on each step's matrix in a task of its own: rows (step, i, columns)."""
    kinds = {x.name: x.dataType.simpleString() for x in nodes.schema}
    rows = adjacency.select("step", F.lit(0).alias("kind"), "i", "j", F.col("w").cast("double").alias("w"))
    rows = rows.union(nodes.select("step", F.lit(1), "i", F.col("i").alias("j"), F.lit(0.0)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(part.loc[part["kind"] == 1, "i"].to_numpy())
        cells = part[part["kind"] == 0]
        matrix = np.zeros((len(ids), len(ids)))
        matrix[np.searchsorted(ids, cells["i"].to_numpy()), np.searchsorted(ids, cells["j"].to_numpy())] = cells["w"].to_numpy()
        return pd.DataFrame({"step": part["step"].iloc[0], "i": ids, **kernel(matrix)})

    return rows.repartition("step").groupBy("step").applyInPandas(run, f"step {kinds['step']}, i {kinds['i']}, {columns}")


def pagerank_kernel(matrix: np.ndarray, damping: float = 0.85, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Rank flows from j to i along matrix[i, j], each column shared out by its sum; columns without a sum give to all alike."""
    n = len(matrix)
    if n <= 1:
        return np.ones(n)
    sums = matrix.sum(axis=0)
    flows = sums > 1e-15
    shares = np.where(flows, matrix / np.where(flows, sums, 1.0), 1.0 / n)
    rank = np.full(n, 1.0 / n)
    for _ in range(rounds):
        after = (1 - damping) / n + damping * (shares @ rank)
        moved, rank = np.abs(after - rank).sum(), after
        if moved < tolerance:
            break
    return rank


def eigenvector_kernel(matrix: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Leading eigenvector by power iteration from an even start, its largest entry 1."""
    n = len(matrix)
    if n <= 1:
        return np.ones(n)
    x = np.full(n, 1.0 / np.sqrt(n))
    for _ in range(rounds):
        y = matrix @ x
        norm = np.sqrt((y * y).sum())
        if norm < 1e-15:
            return np.zeros(n)
        y /= norm
        moved, x = np.abs(x - y).sum(), y
        if moved < tolerance:
            break
    return x / x.max() if x.max() > 1e-15 else x


def _largest(nodes: DataFrame) -> int:
    return nodes.groupBy("step").count().agg(F.max("count")).first()[0] or 0


def pagerank(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """Converged ranks: of matrices where they fit a task, else the same iteration by joins."""
    if _largest(nodes) > DENSE_NODES:
        return pagerank_rounds(adjacency, nodes, ROUNDS, tolerance=TOLERANCE)
    return per_step(adjacency, nodes, lambda m: {"pagerank": pagerank_kernel(m)}, "pagerank double")


def eigenvector(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leading eigenvectors: of matrices where they fit a task, else the same iteration by joins."""
    if _largest(nodes) > DENSE_NODES:
        return eigenvector_rounds(adjacency, nodes)
    return per_step(adjacency, nodes, lambda m: {"eigenvector": eigenvector_kernel(m)}, "eigenvector double")


def _settled(values: DataFrame, tolerance: float | None) -> bool:
    """Whether in every step the sum of changes from `before` to `r` is under the tolerance."""
    if tolerance is None:
        return False
    moved = values.groupBy("step").agg(F.sum(F.abs(F.col("r") - F.col("before"))).alias("m")).agg(F.max("m")).first()[0]
    return moved is None or moved < tolerance


def pagerank_rounds(adjacency: DataFrame, nodes: DataFrame, rounds: int, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """`rounds` steps of the same iteration as joins and sums, for graphs too large for a task, or fewer once it has settled. Each round is a table that the next one reads."""
    sizes = nodes.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    base = cut_lineage(nodes.join(sizes, "step"))
    adjacency = cut_lineage(adjacency)
    sums = adjacency.groupBy("step", "j").agg(F.sum("w").alias("out")).where(F.col("out") > 1e-15)
    shares = cut_lineage(adjacency.join(sums, ["step", "j"]).select("step", "i", "j", (F.col("w") / F.col("out")).alias("share")))
    rank = base.select("step", "i", "n", (1.0 / F.col("n")).alias("r"))
    giving = sums.select("step", F.col("j").alias("i"), F.lit(1).alias("gives"))
    for _ in range(rounds):
        lost = rank.join(giving, ["step", "i"], "left").groupBy("step").agg(F.coalesce(F.sum(F.when(F.col("gives").isNull(), F.col("r"))), F.lit(0.0)).alias("lost"))
        flow = shares.join(rank.select("step", F.col("i").alias("j"), "r"), ["step", "j"]).groupBy("step", "i").agg(F.sum(F.col("share") * F.col("r")).alias("in"))
        after = (1 - damping) / F.col("n") + damping * (F.coalesce("in", F.lit(0.0)) + F.col("lost") / F.col("n"))
        old = rank.select("step", "i", F.col("r").alias("before"))
        rank = cut_lineage(base.join(flow, ["step", "i"], "left").join(lost, "step").join(old, ["step", "i"]).select("step", "i", "n", after.alias("r"), "before"))
        if _settled(rank, tolerance):
            break
    return rank.select("step", "i", F.col("r").alias("pagerank"))


def eigenvector_rounds(adjacency: DataFrame, nodes: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Power iteration as joins and sums; the largest entry of each step becomes 1."""
    adjacency = cut_lineage(adjacency.select("step", "i", "j", "w"))
    sizes = nodes.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    x = cut_lineage(nodes.join(sizes, "step").select("step", "i", (1 / F.sqrt("n")).alias("r")))
    for _ in range(rounds):
        grown = adjacency.join(x.select("step", F.col("i").alias("j"), "r"), ["step", "j"]).groupBy("step", "i").agg(F.sum(F.col("w") * F.col("r")).alias("y"))
        every = cut_lineage(x.join(grown, ["step", "i"], "left").select("step", "i", F.col("r").alias("before"), F.coalesce("y", F.lit(0.0)).alias("y")))
        norms = every.groupBy("step").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        held = F.when(F.col("norm") >= 1e-15, F.col("y") / F.when(F.col("norm") >= 1e-15, F.col("norm"))).otherwise(0.0)
        x = cut_lineage(every.join(norms, "step").select("step", "i", "before", held.alias("r")))
        if _settled(x, tolerance):
            break
    most = x.groupBy("step").agg(F.max("r").alias("most"))
    scaled = F.when(F.col("most") > 1e-15, F.col("r") / F.when(F.col("most") > 1e-15, F.col("most"))).otherwise(F.col("r"))
    return x.join(most, "step").select("step", "i", scaled.alias("eigenvector"))


def centrality_report(adjacency: DataFrame, nodes: DataFrame, directed: bool = True, exact: bool = False) -> DataFrame:
    """All seven centralities, a row for each node. Betweenness is sampled in steps of more than EXACT_BETWEENNESS_NODES nodes unless it is to be `exact`."""
    edges = directed_edges(adjacency) if directed else both_ways(undirected_edges(adjacency))
    between = betweenness(edges, nodes, None if exact else SAMPLED_SOURCES, exact_nodes=EXACT_BETWEENNESS_NODES)
    found = degrees(edges, nodes).drop("strength")
    for part in (path_centralities(shortest_paths(edges, nodes)), between, eigenvector(adjacency, nodes), pagerank(adjacency, nodes)):
        found = found.join(part, ["step", "i"])
    return found
