"""Queries over embeddings of the yearly trade distances and their alignment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.tables import table
from weftgraph.operators import alignment as A
from weftgraph.operators import embedding as E
from weftgraph.plans import corpus
from weftgraph.plans.trade import FULL, distances

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _embedded(spark: SparkSession, sf_dir: str, algorithm: str, dims: int = 2, **options: object) -> DataFrame:
    return E.embed(distances(spark, sf_dir)[0], algorithm, dims, **options)


def _register(name: str, algorithm: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _embedded(spark, sf_dir, algorithm)
        if name in ORACLE:
            return found.select("step", "i", F.round(F.col("coord")[0], 6).alias("x"), F.round(F.col("coord")[1], 6).alias("y"), F.round("stress", 6).alias("stress"))
        return found.withColumn("stress", F.round("stress", 6))

    run.__name__ = name
    QUERIES[name] = run


def _leading(matrix: str, tag: str, squarings: int = 10) -> str:
    """SQL tables v{tag}, the leading eigenvector with its largest entry positive, and l{tag}, its value: powers of the matrix by squaring."""
    sql = f"p{tag}_0 AS MATERIALIZED (SELECT step, i, j, b AS p FROM {matrix})"
    for k in range(1, squarings + 1):
        sql += f", p{tag}_{k} AS MATERIALIZED (SELECT step, i, j, p / max(abs(p)) OVER (PARTITION BY step) AS p FROM (SELECT x.step, x.i, y.j, sum(x.p * y.p) AS p FROM p{tag}_{k - 1} x JOIN p{tag}_{k - 1} y ON x.step = y.step AND x.j = y.i GROUP BY ALL))"
    sql += f", t{tag} AS (SELECT step, arg_max(i, p) AS j FROM p{tag}_{squarings} WHERE i = j GROUP BY step), w{tag} AS (SELECT step, i, p / sqrt(sum(p * p) OVER (PARTITION BY step)) AS v FROM p{tag}_{squarings} JOIN t{tag} USING (step, j))"
    sql += f", v{tag} AS MATERIALIZED (SELECT step, i, v * s AS v FROM w{tag} JOIN (SELECT step, sign(arg_max(v, abs(v))) AS s FROM w{tag} GROUP BY step) USING (step))"
    return sql + f", l{tag} AS MATERIALIZED (SELECT x.step, sum(x.v * b * y.v) AS l FROM v{tag} x JOIN {matrix} m ON m.step = x.step AND m.i = x.i JOIN v{tag} y ON y.step = x.step AND y.i = m.j GROUP BY x.step)"


def _scaled(power: str) -> str:
    """Classical scaling in two dimensions; coordinates are eigenvectors times a power of their values."""
    return f"""{FULL}, centred AS MATERIALIZED (SELECT step, i, j, -0.5 * (d * d - avg(d * d) OVER (PARTITION BY step, i) - avg(d * d) OVER (PARTITION BY step, j) + avg(d * d) OVER (PARTITION BY step)) AS b FROM dist), {_leading("centred", "a")},
rest AS MATERIALIZED (SELECT m.step, m.i, m.j, b - l * x.v * y.v AS b FROM centred m JOIN la USING (step) JOIN va x ON x.step = m.step AND x.i = m.i JOIN va y ON y.step = m.step AND y.i = m.j), {_leading("rest", "b")},
placed AS MATERIALIZED (SELECT va.step, va.i, va.v * pow(la.l, {power}) AS x, vb.v * pow(lb.l, {power}) AS y FROM va JOIN vb USING (step, i) JOIN la USING (step) JOIN lb USING (step)),
s AS (SELECT d.step, sqrt(sum(pow(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) - d, 2)) / sum(d * d)) AS stress FROM dist d JOIN placed p ON p.step = d.step AND p.i = d.i JOIN placed q ON q.step = d.step AND q.i = d.j WHERE d.i < d.j GROUP BY d.step)
SELECT step, i, round(x, 6) AS x, round(y, 6) AS y, round(stress, 6) AS stress FROM placed JOIN s USING (step)"""


ORACLE |= {"mds_auto": _scaled("0.5"), "mds_classical": _scaled("0.5"), "mds_pivot": _scaled("1")}  # with 25 nodes all are pivots
for _name, _algorithm in {"mds_auto": "auto", "mds_classical": "classical", "mds_smacof": "smacof", "mds_pivot": "pivot", "mds_landmark": "landmark", "mds_multilevel": "multilevel", "layout_fr": "force_directed", "layout_tsne": "tsne", "layout_umap": "umap"}.items():
    _register(_name, _algorithm)


def _by_step(spark: SparkSession, sf_dir: str, kernel: Callable[[np.ndarray], pd.DataFrame], columns: str) -> DataFrame:
    """Rows (step, columns) of a kernel over each year's matrix, a year to a task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        n = len(np.unique(part["i"]))
        dist = np.zeros((n, n))
        dist[part["i"], part["j"]] = part["d"]
        found = kernel(dist)
        found.insert(0, "step", part["step"].iloc[0])
        return found

    return distances(spark, sf_dir)[0].groupBy("step").applyInPandas(run, f"step int, {columns}")


def _cells(values: np.ndarray, name: str) -> pd.DataFrame:
    i, j = np.indices(values.shape).reshape(2, -1)
    return pd.DataFrame({"i": i, "j": j, name: np.round(values.ravel(), 9)})


def _pivots_sql(k: int) -> str:
    """The point farthest from all chosen, of equals the last, again and again."""
    sql = f"{FULL}, f0 AS MATERIALIZED (SELECT step, j AS i, d AS near, i AS chosen FROM dist WHERE i = 0)"
    for r in range(1, k):
        sql += f", c{r} AS MATERIALIZED (SELECT step, i AS c FROM (SELECT step, i, row_number() OVER (PARTITION BY step ORDER BY near DESC, i DESC) AS r FROM f{r - 1} WHERE near >= 0 AND i <> 0) WHERE r = 1)"
        sql += f", f{r} AS MATERIALIZED (SELECT f.step, f.i, CASE WHEN f.i = c OR f.near < 0 THEN -1 ELSE least(near, d) END AS near, c AS chosen FROM f{r - 1} f JOIN c{r} USING (step) JOIN dist d ON d.step = f.step AND d.i = c AND d.j = f.i)"
    return sql + " " + " UNION ALL ".join(f"SELECT DISTINCT step, {r}::INTEGER AS rank, chosen::INTEGER AS i FROM f{r}" for r in range(k))


@query(_pivots_sql(10))
def pivot_select(spark, sf_dir):
    return _by_step(spark, sf_dir, lambda m: pd.DataFrame({"rank": range(10), "i": E.farthest_points(m, 10)}), "rank int, i int")


@query()
def tsne_affinities(spark, sf_dir):
    return _by_step(spark, sf_dir, lambda m: _cells(E.affinities(m), "p"), "i int, j int, p double")


@query()
def umap_graph(spark, sf_dir):
    return _by_step(spark, sf_dir, lambda m: _cells(E.fuzzy_graph(m), "w"), "i int, j int, w double")


@query()
def landmark_project(spark, sf_dir):
    """All years' nations placed by the landmarks of the first year: their matrix alone comes to the driver."""
    cells = distances(spark, sf_dir)[0]
    own = cells.where("step = 1995").toPandas()
    first = np.zeros((25, 25))
    first[own["i"], own["j"]] = own["d"]
    at, own, _, mean = E.landmark_model(first, 2, 8)
    dists = cells.where(F.col("j").isin(at)).groupBy("step", "i").agg(F.array_sort(F.collect_list(F.struct("j", "d"))).alias("l"))
    order = np.argsort(at)
    ready = dists.select("step", "i", F.transform("l", lambda x: x["d"]).alias("dists"))
    return E.project_points(ready, own[order], mean[order]).drop("dists")


@query()
def ppmi_svd(spark, sf_dir):
    """Low-rank cosine of each language's vocabulary, a language to a task."""
    found = E.low_rank_similarity(corpus.scored(spark, sf_dir).select("slice_id", "a", "b", "ppmi"))
    return found.where("a < b").withColumn("similarity", F.round("similarity", 6))


def _coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of each nation's distances as its coordinates, the same in any engine."""
    cells = distances(spark, sf_dir)[0].where("j < 2")
    return cells.groupBy("step", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "d"))), lambda x: x["d"]).alias("coord"))


POINTS = f"{FULL}, pts AS MATERIALIZED (SELECT step, i, j AS dim, d AS v FROM dist WHERE j < 2)"


@query(f"{POINTS}, c AS (SELECT step, i, dim, v - avg(v) OVER (PARTITION BY step, dim) AS v FROM pts) SELECT a.step, a.dim AS p, b.dim AS q, round(sum(a.v * b.v), 6) AS m FROM c a JOIN c b ON a.i = b.i AND b.step = a.step - 1 GROUP BY ALL")
def procrustes_moments(spark, sf_dir):
    return A.moments(_coords(spark, sf_dir)).withColumn("m", F.round("m", 6))


@query(f"{POINTS} SELECT i, dim, round(avg(v), 6) AS x FROM pts GROUP BY i, dim")
def gpa_consensus(spark, sf_dir):
    return A.consensus(_coords(spark, sf_dir)).withColumn("x", F.round("x", 6))


@query(f"{POINTS}, m AS (SELECT step, max(abs(v)) AS most FROM pts GROUP BY step) SELECT step, i, round(max(CASE WHEN dim = 0 THEN v END) * 500 / most, 6) AS x, round(max(CASE WHEN dim = 1 THEN v END) * 500 / most, 6) AS y FROM pts JOIN m USING (step) GROUP BY step, i, most")
def normalize_coords(spark, sf_dir):
    return A.normalize(_coords(spark, sf_dir), 500.0).select("step", "i", F.round(F.col("coord")[0], 6).alias("x"), F.round(F.col("coord")[1], 6).alias("y"))


@query(f"{POINTS}, m AS (SELECT max(abs(v)) AS most FROM pts) SELECT step, i, round(max(CASE WHEN dim = 0 THEN v END) * 300 / most, 6) AS x, round(max(CASE WHEN dim = 1 THEN v END) * 300 / most, 6) AS y FROM pts, m GROUP BY step, i, most")
def normalize_global(spark, sf_dir):
    return A.normalize(_coords(spark, sf_dir), 300.0, per_step=False).select("step", "i", F.round(F.col("coord")[0], 6).alias("x"), F.round(F.col("coord")[1], 6).alias("y"))


PLANE = f"""{POINTS}, xy AS MATERIALIZED (SELECT step, i, max(CASE WHEN dim = 0 THEN v END) AS x, max(CASE WHEN dim = 1 THEN v END) AS y FROM pts GROUP BY step, i),
mid AS MATERIALIZED (SELECT step, avg(x) AS mx, avg(y) AS my, sum(pow(x, 2) + pow(y, 2)) - (pow(sum(x), 2) + pow(sum(y), 2)) / count(*) AS spread FROM xy GROUP BY step),
fit AS MATERIALIZED (SELECT a.step, b.step AS onto, sum((a.x - p.mx) * (b.x - q.mx) + (a.y - p.my) * (b.y - q.my)) AS c, sum((a.x - p.mx) * (b.y - q.my) - (a.y - p.my) * (b.x - q.mx)) AS s, any_value(p.spread) + any_value(q.spread) AS mass FROM xy a JOIN xy b USING (i) JOIN mid p ON p.step = a.step JOIN mid q ON q.step = b.step GROUP BY ALL)"""
TURNED = "SELECT step, i, round((x - mx) * cos(phi) - (y - my) * sin(phi) + ox, 6) AS x, round((x - mx) * sin(phi) + (y - my) * cos(phi) + oy, 6) AS y, round(residual, 6) AS residual FROM xy JOIN mid USING (step) JOIN turn USING (step)"
RESIDUAL = "greatest(mass - 2 * sqrt(c * c + s * s), 0)"
ONTO_ONE = "turn AS (SELECT f.step, CASE WHEN f.step = best THEN 0 ELSE atan2(s, c) END AS phi, CASE WHEN f.step = best THEN 0 ELSE " + RESIDUAL + " END AS residual, mx AS ox, my AS oy FROM fit f JOIN one ON onto = best JOIN mid ON mid.step = best)"
ALIGNED = {
    "none": "turn AS (SELECT step, 0.0::DOUBLE AS phi, 0.0::DOUBLE AS residual, mx AS ox, my AS oy FROM mid)",
    "timeseries": f"turn AS (SELECT f.step, sum(CASE WHEN f.step = 1995 AND onto = 1995 THEN 0 ELSE atan2(s, c) END) OVER (ORDER BY f.step) AS phi, CASE WHEN f.step = 1995 THEN 0 ELSE {RESIDUAL} END AS residual, mx AS ox, my AS oy FROM fit f JOIN mid ON mid.step = 1995 WHERE onto = greatest(f.step - 1, 1995))",
    "anchored": f"one AS (SELECT min(step) AS best FROM mid), {ONTO_ONE}",
    "optimal": f"one AS (SELECT arg_min(onto, total) AS best FROM (SELECT onto, sum({RESIDUAL}) AS total FROM fit GROUP BY onto)), {ONTO_ONE}",  # seven years: each is a candidate
}


def _consensus_tables(rounds: int) -> str:
    """Tables m0, m1, ...: the mean of all years, each turned onto the mean before."""
    sql = "m0 AS MATERIALIZED (SELECT i, avg(x) AS x, avg(y) AS y FROM xy GROUP BY i)"
    for k in range(1, rounds + 1):
        sql += f""", q{k} AS (SELECT avg(x) AS cx, avg(y) AS cy FROM m{k - 1}), g{k} AS (SELECT xy.step, sum((xy.x - mx) * (m.x - cx) + (xy.y - my) * (m.y - cy)) AS c, sum((xy.x - mx) * (m.y - cy) - (xy.y - my) * (m.x - cx)) AS s, any_value(cx) AS cx, any_value(cy) AS cy FROM xy JOIN mid USING (step) JOIN m{k - 1} m USING (i), q{k} GROUP BY xy.step),
m{k} AS MATERIALIZED (SELECT i, avg(((x - mx) * c - (y - my) * s) / sqrt(c * c + s * s) + cx) AS x, avg(((x - mx) * s + (y - my) * c) / sqrt(c * c + s * s) + cy) AS y FROM xy JOIN mid USING (step) JOIN g{k} USING (step) GROUP BY i)"""
    return sql


CONSENSUS_ROUNDS = 40
ALIGNED["gpa"] = f"""{_consensus_tables(CONSENSUS_ROUNDS)}, q AS (SELECT avg(x) AS cx, avg(y) AS cy, sum(x * x + y * y) - (pow(sum(x), 2) + pow(sum(y), 2)) / count(*) AS spread FROM m{CONSENSUS_ROUNDS}),
turn AS (SELECT xy.step, atan2(sum((xy.x - mx) * (m.y - cy) - (xy.y - my) * (m.x - cx)), sum((xy.x - mx) * (m.x - cx) + (xy.y - my) * (m.y - cy))) AS phi,
  greatest(any_value(mid.spread) + any_value(q.spread) - 2 * sqrt(pow(sum((xy.x - mx) * (m.y - cy) - (xy.y - my) * (m.x - cx)), 2) + pow(sum((xy.x - mx) * (m.x - cx) + (xy.y - my) * (m.y - cy)), 2)), 0) AS residual, any_value(cx) AS ox, any_value(cy) AS oy
  FROM xy JOIN mid USING (step) JOIN m{CONSENSUS_ROUNDS} m USING (i), q GROUP BY xy.step)"""


def _aligned(mode: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = A.align(_coords(spark, sf_dir), mode)
        return found.select("step", "i", F.round(F.col("coord")[0], 6).alias("x"), F.round(F.col("coord")[1], 6).alias("y"), F.round("residual", 6).alias("residual"))

    name = run.__name__ = f"align_{mode}"
    QUERIES[name] = run
    if mode in ALIGNED:
        ORACLE[name] = f"{PLANE}, {ALIGNED[mode]} {TURNED}"


for _mode in ("none", "timeseries", "anchored", "optimal", "gpa"):
    _aligned(_mode)


def _neighbouring(spark: SparkSession, sf_dir: str, weighted: bool) -> DataFrame:
    """Each year fitted onto the year before, a pair to a task."""
    coords = _coords(spark, sf_dir)
    before = coords.select((F.col("step") + 1).alias("step"), "i", F.col("coord").alias("target"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        a, b = np.stack(part["coord"].to_numpy()), np.stack(part["target"].to_numpy())
        fit = A.procrustes(a, b, scaling=not weighted, weights=part["i"].to_numpy(float) + 1 if weighted else None)
        return pd.DataFrame([(part["step"].iloc[0], *np.round([fit.rotation[0, 0], fit.rotation[0, 1], fit.scale, *fit.translation, fit.residual], 6))], columns=["step", "cosine", "sine", "scale", "shift_x", "shift_y", "residual"])

    return coords.join(before, ["step", "i"]).groupBy("step").applyInPandas(run, "step int, cosine double, sine double, scale double, shift_x double, shift_y double, residual double")


def _procrustes_sql(weight: str, scaling: bool) -> str:
    size = "sqrt(c * c + s * s) / spread" if scaling else "1.0::DOUBLE"
    return f"""{PLANE}, pair AS MATERIALIZED (SELECT a.step, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, {weight} AS w FROM xy a JOIN xy b ON b.step = a.step - 1 AND b.i = a.i),
o AS (SELECT step, sum(w * ax) / sum(w) AS p, sum(w * ay) / sum(w) AS q, sum(w * bx) / sum(w) AS u, sum(w * b_y) / sum(w) AS v FROM pair GROUP BY step),
m AS (SELECT step, sum(w * ((ax - p) * (bx - u) + (ay - q) * (b_y - v))) AS c, sum(w * ((ax - p) * (b_y - v) - (ay - q) * (bx - u))) AS s, sum(w * (pow(ax - p, 2) + pow(ay - q, 2))) AS spread FROM pair JOIN o USING (step) GROUP BY step),
t AS (SELECT step, c / sqrt(c * c + s * s) AS co, s / sqrt(c * c + s * s) AS si, {size} AS k, p, q, u, v FROM m JOIN o USING (step)),
f AS (SELECT step, co, si, k, u - k * (p * co - q * si) AS tx, v - k * (p * si + q * co) AS ty FROM t),
r AS (SELECT step, sum(pow(k * (ax * co - ay * si) + tx - bx, 2) + pow(k * (ax * si + ay * co) + ty - b_y, 2)) AS residual FROM pair JOIN f USING (step) GROUP BY step)
SELECT step, round(co, 6) AS cosine, round(si, 6) AS sine, round(k, 6) AS scale, round(tx, 6) AS shift_x, round(ty, 6) AS shift_y, round(residual, 6) AS residual FROM f JOIN r USING (step)"""


@query(_procrustes_sql("1", True))
def procrustes(spark, sf_dir):
    return _neighbouring(spark, sf_dir, False)


@query(_procrustes_sql("a.i + 1", False))
def procrustes_weighted(spark, sf_dir):
    return _neighbouring(spark, sf_dir, True)


@query(f"{PLANE}, {_consensus_tables(CONSENSUS_ROUNDS)} SELECT i, unnest([0, 1]) AS dim, round(unnest([x, y]), 6) AS x FROM m{CONSENSUS_ROUNDS}")
def gpa(spark, sf_dir):
    """The consensus of all years: the mean of their aligned places."""
    return A.consensus(A.align(_coords(spark, sf_dir), "gpa")).withColumn("x", F.round("x", 6))


@query("SELECT a.n_name AS label, (row_number() OVER (ORDER BY a.n_nationkey) - 1)::INTEGER AS source_ord, a.n_nationkey AS target_ord FROM nation a WHERE a.n_regionkey < 3")
def shared_labels(spark, sf_dir):
    from pyspark.sql import Window

    nation = table(spark, sf_dir, "nation")
    source = nation.where("n_regionkey < 3").select(F.col("n_name").alias("label"), (F.row_number().over(Window.orderBy("n_nationkey")) - 1).alias("row_ord"))
    return A.shared_labels(source, nation.select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("row_ord")))


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def embedding_cosine(spark, sf_dir):
    """Cosines of the vectors of a label, pairs of blocks of vectors to a task."""
    return E.cosines(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", digits=6)
