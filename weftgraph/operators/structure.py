"""Distances between nodes and what is derived from distance matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.tables import cut_lineage

FAR, FLOOR = 1e6, 1e-12


def dense(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """All cells (step, i, j, w), 0 where the sparse table has none."""
    left, right = nodes.select("step", "i"), nodes.select("step", F.col("i").alias("j"))
    return left.join(right, "step").join(adjacency.select("step", "i", "j", "w"), ["step", "i", "j"], "left").fillna(0.0, ["w"])


def profiles(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """(step, i, row, col): a node's outgoing and incoming weights in the order of the nodes."""
    cells = dense(adjacency, nodes)
    ordered = lambda key, other, name: cells.groupBy("step", F.col(key).alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(other).alias("k"), "w"))), lambda x: x["w"]).alias(name))
    return ordered("i", "j", "row").join(ordered("j", "i", "col"), ["step", "i"])


def _pairs(packed: DataFrame) -> DataFrame:
    a, b = packed.alias("a"), packed.alias("b")
    return a.join(b, (F.col("a.step") == F.col("b.step")) & (F.col("a.i") < F.col("b.i")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def structural_equivalence(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """(step, i, j, d), i < j: Euclidean distance of the nodes' rows and columns. Differences are squared one by one, since expanding the square would lose the equality of equal nodes."""
    gap = lambda c: _sum(F.zip_with(f"a.{c}", f"b.{c}", lambda x, y: (x - y) * (x - y)))
    return _pairs(profiles(adjacency, nodes)).select("a.step", "a.i", F.col("b.i").alias("j"), F.sqrt(gap("row") + gap("col")).alias("d"))


def structural_correlation(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """(step, i, j, d), i < j: 1 - r of the profiles, in [0, 2]. Sums leave out the pair's own places, means divide by 2 (n - 1); without variance d is 1."""
    ranked = nodes.withColumn("_k", F.row_number().over(Window.partitionBy("step").orderBy("i")))
    packed = profiles(adjacency, nodes).join(ranked, ["step", "i"])
    outside = lambda side, c: F.filter(F.col(f"{side}.{c}"), lambda x, k: (k + 1 != F.col("a._k")) & (k + 1 != F.col("b._k")))
    both = lambda side: F.concat(outside(side, "row"), outside(side, "col"))
    pairs = _pairs(packed).select("a.step", "a.i", F.col("b.i").alias("j"), both("a").alias("x"), both("b").alias("y"), (2.0 * (F.size("a.row") - 1)).alias("m"))
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: p * q))
    moments = pairs.select("step", "i", "j", "m", (_sum(F.col("x")) / F.col("m")).alias("mx"), (_sum(F.col("y")) / F.col("m")).alias("my"), dot("x", "x").alias("xx"), dot("y", "y").alias("yy"), dot("x", "y").alias("xy"))
    spread = (F.col("xx") / F.col("m") - F.col("mx") * F.col("mx")) * (F.col("yy") / F.col("m") - F.col("my") * F.col("my"))
    norm = F.sqrt(spread)
    r = (F.col("xy") / F.col("m") - F.col("mx") * F.col("my")) / F.when(norm >= 1e-15, norm)
    return moments.select("step", "i", "j", F.when(norm < 1e-15, 1.0).otherwise(F.greatest(F.least(1 - r, F.lit(2.0)), F.lit(0.0))).alias("d"))


def full_matrix(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """All cells of a distance matrix from its upper triangle, written once for all that reads them."""
    both = pairs.select("step", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"), "d").select("step", "p.i", "p.j", "d")
    return cut_lineage(both.union(nodes.select("step", "i", F.col("i").alias("j"), F.lit(0.0))))


def validate_distances(cells: DataFrame) -> DataFrame:
    """(step, n, bad_values, negatives, bad_diagonal, asymmetric): how many cells break each rule of a distance matrix."""
    other = cells.select("step", F.col("j").alias("i"), F.col("i").alias("j"), F.col("d").alias("e"))
    joined = cells.join(other, ["step", "i", "j"], "left")
    strange = F.isnan("d") | (F.abs("d") == float("inf")) | F.col("d").isNull()
    lopsided = F.col("e").isNull() | (F.abs(F.col("d") - F.col("e")) > 1e-12)
    return joined.groupBy("step").agg(F.countDistinct("i").alias("n"), F.count_if(strange).alias("bad_values"), F.count_if(~strange & (F.col("d") < 0)).alias("negatives"), F.count_if((F.col("i") == F.col("j")) & (F.abs("d") > 1e-12)).alias("bad_diagonal"), F.count_if((F.col("i") < F.col("j")) & lopsided).alias("asymmetric"))


def similarity_to_distance(similarity: Column, method: str, same: Column) -> Column:
    """linear: 1 - s; cosine: the root of 1 - s squared; info: -ln s, at most 1e6. Off the diagonal at least 1e-12, on it 0."""
    positive = F.when(similarity > 0, similarity)
    ways = {
        "linear": F.greatest(1 - similarity, F.lit(0.0)),
        "cosine": F.sqrt(F.greatest(1 - similarity * similarity, F.lit(0.0))),
        "info": F.when(similarity <= 0, FAR).otherwise(F.least(-F.ln(positive), F.lit(FAR))),
    }
    return F.when(same, 0.0).otherwise(F.greatest(ways[method], F.lit(FLOOR)))


def double_center(cells: DataFrame) -> DataFrame:
    """(step, i, j, b): minus half the squared distances, less row and column means, plus the mean of all."""
    square = cells.select("step", "i", "j", (F.col("d") * F.col("d")).alias("q"))
    mean = lambda out, *k: square.groupBy("step", *k).agg(F.avg("q").alias(out))
    joined = square.join(mean("_r", "i"), ["step", "i"]).join(mean("_c", "j"), ["step", "j"]).join(mean("_a"), "step")
    return joined.select("step", "i", "j", (-0.5 * (F.col("q") - F.col("_r") - F.col("_c") + F.col("_a"))).alias("b"))


def embedded(pairs: DataFrame, coords: DataFrame) -> DataFrame:
    """`pairs` with e, the distance of the two nodes' coordinates."""
    a = coords.select("step", "i", F.col("coord").alias("_a"))
    b = coords.select("step", F.col("i").alias("j"), F.col("coord").alias("_b"))
    gap = _sum(F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y)))
    return pairs.join(a, ["step", "i"]).join(b, ["step", "j"]).withColumn("e", F.sqrt(gap))


def kruskal_stress(cells: DataFrame, coords: DataFrame) -> DataFrame:
    """(step, stress): root of the squared errors over the squared distances, over i < j."""
    found = embedded(cells.where("i < j"), coords)
    sums = found.groupBy("step").agg(F.sum((F.col("e") - F.col("d")) ** 2).alias("err"), F.sum(F.col("d") ** 2).alias("all"))
    return sums.select("step", F.when(F.col("all") < 1e-15, 0.0).otherwise(F.sqrt(F.col("err") / F.when(F.col("all") >= 1e-15, F.col("all")))).alias("stress"))


def guttman_step(cells: DataFrame, coords: DataFrame) -> DataFrame:
    """(step, i, dim, x): one Guttman transform of the coordinates, as joins and sums."""
    found = embedded(cells.where("i <> j"), coords).withColumn("ratio", F.when(F.col("e") > 1e-15, F.col("d") / F.when(F.col("e") > 1e-15, F.col("e"))).otherwise(0.0))
    flat = found.select("step", "i", F.posexplode(F.zip_with("_a", "_b", lambda x, y: F.col("ratio") * (x - y))).alias("dim", "part"))
    sizes = coords.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    return flat.groupBy("step", "i", "dim").agg(F.sum("part").alias("s")).join(F.broadcast(sizes), "step").select("step", "i", "dim", (F.col("s") / F.col("n")).alias("x"))


def nearest(cells: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(step, i, j, d, rank): the k nearest of each node, ties in the order of j; distances equal to so many `digits` are ties."""
    near = Window.partitionBy("step", "i").orderBy("d" if digits is None else F.round("d", digits), "j")
    return cells.where("i <> j").withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
