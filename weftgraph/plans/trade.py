"""The yearly trade network between nations, and queries over networks and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.tables import cut_lineage, table
from weftgraph.operators import network as N
from weftgraph.operators import structure as S

QUERIES, ORACLE = {}, {}
#: Suppliers up to which their nations are sent to every task.
BROADCAST_ROWS = 1_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


TRADE = """WITH flows AS (SELECT year(o_orderdate)::INTEGER AS step, s_nationkey AS i, c_nationkey AS j, sum(l_extendedprice * (1 - l_discount)) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
adj AS MATERIALIZED (SELECT step, i, j, v / (SELECT max(v) FROM flows) AS w FROM flows),
nodes AS MATERIALIZED (SELECT step, n_nationkey AS i FROM (SELECT DISTINCT step FROM adj), nation),
cells AS MATERIALIZED (SELECT a.step, a.i, b.i AS j, coalesce(w, 0) AS w FROM nodes a JOIN nodes b USING (step) LEFT JOIN adj ON adj.step = a.step AND adj.i = a.i AND adj.j = b.i)"""


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Adjacency and nodes: revenue from suppliers' nations to customers' nations by year of order, over the largest flow.

    Flows are a row for two nations and a year; they are written, so that lineitem is joined once however often they are used.
    """
    line, orders, supplier, customer, nation = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "supplier", "customer", "nation"))
    nations = supplier.select("s_suppkey", F.col("s_nationkey").alias("i"))
    if nations.count() <= BROADCAST_ROWS:
        nations = F.broadcast(nations)
    sold = line.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "i", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.year("o_orderdate").alias("step"), F.col("c_nationkey").alias("j"))
    flows = cut_lineage(sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("step", "i", "j").agg(F.sum("v").alias("v")))
    most = flows.agg(F.max("v").alias("most"))
    adjacency = flows.crossJoin(F.broadcast(most)).select("step", "i", "j", (F.col("v") / F.col("most")).alias("w"))
    nodes = adjacency.select("step").distinct().crossJoin(nation.select(F.col("n_nationkey").alias("i")))
    return adjacency, nodes


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"{TRADE} SELECT step, i, j, round(w, 6) AS w FROM adj WHERE i < j AND w > 0")
def und_edges(spark, sf_dir):
    return _rounded(N.undirected_edges(trade(spark, sf_dir)[0]), "w")


@query(f"{TRADE} SELECT step, i, j, round(w, 6) AS w FROM adj WHERE i <> j AND w > 0")
def dir_edges(spark, sf_dir):
    return _rounded(N.directed_edges(trade(spark, sf_dir)[0]), "w")


@query(f"{TRADE} SELECT step, a.n_name AS src, b.n_name AS dst, round(w, 6) AS w FROM adj JOIN nation a ON a.n_nationkey = i JOIN nation b ON b.n_nationkey = j WHERE i <> j AND w <> 0")
def adjacency_edges(spark, sf_dir):
    name = lambda key, out: table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(out))
    edges = N.adjacency_edges(trade(spark, sf_dir)[0]).join(name("i", "src"), "i").join(name("j", "dst"), "j")
    return edges.select("step", "src", "dst", F.round("w", 6).alias("w"))


@query(f"{TRADE}, e AS (SELECT step, i, j, w FROM adj WHERE i <> j AND w > 0) SELECT step, i, round(coalesce(count(e.j), 0) / 24, 9) AS degree, round(coalesce(sum(e.w), 0), 6) AS strength FROM nodes LEFT JOIN e USING (step, i) GROUP BY step, i")
def degree(spark, sf_dir):
    adjacency, nodes = trade(spark, sf_dir)
    return _rounded(_rounded(N.degrees(N.directed_edges(adjacency), nodes), "degree", digits=9), "strength")


HOPS = f"{TRADE}, p0 AS MATERIALIZED (SELECT step, i AS s, j AS t, CASE WHEN i = j THEN 0 WHEN w > 0 THEN 1 / w ELSE 'inf'::DOUBLE END AS d FROM cells)" + "".join(
    f", p{k} AS MATERIALIZED (SELECT a.step, a.s, b.t, min(a.d + b.d) AS d FROM p{k - 1} a JOIN p{k - 1} b ON a.step = b.step AND a.t = b.s GROUP BY ALL)" for k in range(1, 6)
)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjacency, nodes = trade(spark, sf_dir)
    return N.shortest_paths(N.directed_edges(adjacency), nodes)


@query(f"{HOPS} SELECT step, s, t, round(d, 6) AS d FROM p5")
def shortest_paths(spark, sf_dir):
    return _rounded(_paths(spark, sf_dir), "d")


REACH = f"{HOPS}, m AS (SELECT step, s AS i, avg(d) FILTER (s <> t AND d < 'inf'::DOUBLE) AS mean, coalesce(sum(1 / d) FILTER (s <> t AND d > 0 AND d < 'inf'::DOUBLE), 0) AS inv FROM p5 GROUP BY ALL)"


@query(f"{REACH} SELECT step, i, round(coalesce(mean, 'nan'::DOUBLE), 6) AS distance FROM m")
def centrality_distance(spark, sf_dir):
    return _rounded(N.path_centralities(_paths(spark, sf_dir)).select("step", "i", "distance"), "distance")


@query(f"{REACH} SELECT step, i, round(CASE WHEN mean > 1e-15 THEN 1 / mean ELSE 0 END, 6) AS closeness FROM m")
def closeness(spark, sf_dir):
    return _rounded(N.path_centralities(_paths(spark, sf_dir)).select("step", "i", "closeness"), "closeness")


@query(f"{REACH} SELECT step, i, round(inv / 24, 6) AS harmonic FROM m")
def harmonic(spark, sf_dir):
    return _rounded(N.path_centralities(_paths(spark, sf_dir)).select("step", "i", "harmonic"), "harmonic")


# with weights as uneven as revenue two nodes have one shortest path, so a node is on it or is not
BETWEEN = "on_path AS (SELECT x.step, x.s, x.t AS i, count(*) AS c FROM p5 x JOIN p5 y ON y.step = x.step AND y.s = x.t JOIN p5 z ON z.step = x.step AND z.s = x.s AND z.t = y.t WHERE x.s <> x.t AND y.t <> x.t AND x.s <> y.t AND z.d < 'inf'::DOUBLE AND x.d + y.d <= z.d + 1e-12 GROUP BY ALL)"


@query(f"{HOPS}, {BETWEEN}, b AS (SELECT step, i, sum(c) AS c FROM on_path GROUP BY ALL) SELECT step, i, round(coalesce(c, 0) / 552.0::DOUBLE, 6) AS betweenness FROM nodes LEFT JOIN b USING (step, i)")
def betweenness(spark, sf_dir):
    adjacency, nodes = trade(spark, sf_dir)
    return _rounded(N.betweenness(N.directed_edges(adjacency), nodes), "betweenness")


@query(f"""{HOPS}, {BETWEEN}, drawn AS (SELECT step, i AS s FROM (SELECT step, i, row_number() OVER (PARTITION BY step ORDER BY md5('42|' || i), i) AS r FROM nodes) WHERE r <= 10),
b AS (SELECT step, i, sum(c) AS c FROM on_path JOIN drawn USING (step, s) GROUP BY ALL) SELECT step, i, round(coalesce(c, 0) * 2.5::DOUBLE / 552, 6) AS betweenness FROM nodes LEFT JOIN b USING (step, i)""")
def betweenness_approx(spark, sf_dir):
    adjacency, nodes = trade(spark, sf_dir)
    return _rounded(N.betweenness(N.directed_edges(adjacency), nodes, sampled=10), "betweenness")


def _rank_tables(rounds: int) -> str:
    sql = "sums AS (SELECT step, j, sum(w) AS s FROM cells GROUP BY ALL), r0 AS (SELECT step, i, 1.0::DOUBLE / 25 AS r FROM nodes)"
    for k in range(1, rounds + 1):
        sql += f", r{k} AS MATERIALIZED (SELECT c.step, c.i, 0.15::DOUBLE / 25 + 0.85::DOUBLE * sum(CASE WHEN s > 1e-15 THEN w / s ELSE 1.0::DOUBLE / 25 END * r) AS r FROM cells c JOIN sums ON sums.step = c.step AND sums.j = c.j JOIN r{k - 1} p ON p.step = c.step AND p.i = c.j GROUP BY ALL)"
    return sql


def _eigen_tables(rounds: int) -> str:
    """Power iteration with the largest entry kept at 1."""
    sql = "e0 AS (SELECT step, i, 1.0::DOUBLE AS e FROM nodes)"
    for k in range(1, rounds + 1):
        sql += f", e{k} AS MATERIALIZED (SELECT step, i, v / max(v) OVER (PARTITION BY step) AS e FROM (SELECT c.step, c.i, sum(w * e) AS v FROM cells c JOIN e{k - 1} p ON p.step = c.step AND p.i = c.j GROUP BY ALL))"
    return sql


#: Rounds of an iteration in SQL, where the operator stops on its own.
ROUNDS = 100


@query(f"{TRADE}, {_rank_tables(ROUNDS)} SELECT step, i, round(r, 6) AS pagerank FROM r{ROUNDS}")
def pagerank(spark, sf_dir):
    return _rounded(N.pagerank(*trade(spark, sf_dir)), "pagerank")


@query(f"{TRADE}, {_rank_tables(5)} SELECT step, i, round(r, 9) AS pagerank FROM r5")
def pagerank_rounds(spark, sf_dir):
    return _rounded(N.pagerank_rounds(*trade(spark, sf_dir), rounds=5), "pagerank", digits=9)


@query(f"{TRADE}, {_eigen_tables(ROUNDS)} SELECT step, i, round(e, 6) AS eigenvector FROM e{ROUNDS}")
def eigenvector(spark, sf_dir):
    return _rounded(N.eigenvector(*trade(spark, sf_dir)), "eigenvector")


@query(f"""{REACH}, {BETWEEN}, {_rank_tables(ROUNDS)}, {_eigen_tables(ROUNDS)}, b AS (SELECT step, i, sum(c) AS c FROM on_path GROUP BY ALL), k AS (SELECT step, i, count(*) AS k FROM adj WHERE i <> j AND w > 0 GROUP BY ALL)
SELECT step, i, round(coalesce(k, 0) / 24, 6) AS degree, round(coalesce(mean, 'nan'::DOUBLE), 6) AS distance, round(CASE WHEN mean > 1e-15 THEN 1 / mean ELSE 0 END, 6) AS closeness, round(inv / 24, 6) AS harmonic, round(coalesce(c, 0) / 552.0::DOUBLE, 6) AS betweenness, round(e, 6) AS eigenvector, round(r, 6) AS pagerank
FROM nodes LEFT JOIN k USING (step, i) JOIN m USING (step, i) LEFT JOIN b USING (step, i) JOIN e{ROUNDS} USING (step, i) JOIN r{ROUNDS} USING (step, i)""")
def centrality_report(spark, sf_dir):
    return _rounded(N.centrality_report(*trade(spark, sf_dir)), "degree", "distance", "closeness", "harmonic", "betweenness", "eigenvector", "pagerank")


SE = f"{TRADE}, se AS MATERIALIZED (SELECT a.step, a.i, b.i AS j, sqrt(sum(pow(x.w - y.w, 2) + pow(p.w - q.w, 2))) AS d FROM nodes a JOIN nodes b ON a.step = b.step AND a.i < b.i JOIN cells x ON x.step = a.step AND x.i = a.i JOIN cells y ON y.step = b.step AND y.i = b.i AND y.j = x.j JOIN cells p ON p.step = a.step AND p.j = a.i AND p.i = x.j JOIN cells q ON q.step = b.step AND q.j = b.i AND q.i = x.j GROUP BY ALL)"
FULL = f"{SE}, dist AS MATERIALIZED (SELECT step, i, j, d FROM se UNION ALL SELECT step, j, i, d FROM se UNION ALL SELECT step, i, i, 0 FROM nodes)"


def distances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All cells of the yearly structural distances, and the nodes."""
    adjacency, nodes = trade(spark, sf_dir)
    return S.full_matrix(S.structural_equivalence(adjacency, nodes), nodes), nodes


@query(f"{SE} SELECT step, i, j, round(d, 6) AS d FROM se")
def structural_equivalence(spark, sf_dir):
    return _rounded(S.structural_equivalence(*trade(spark, sf_dir)), "d")


@query(f"""{TRADE}, v AS (SELECT a.step, a.i, b.i AS j, unnest([x.w, p.w]) AS x, unnest([y.w, q.w]) AS y FROM nodes a JOIN nodes b ON a.step = b.step AND a.i < b.i JOIN cells x ON x.step = a.step AND x.i = a.i AND x.j <> a.i AND x.j <> b.i JOIN cells y ON y.step = b.step AND y.i = b.i AND y.j = x.j JOIN cells p ON p.step = a.step AND p.j = a.i AND p.i = x.j JOIN cells q ON q.step = b.step AND q.j = b.i AND q.i = x.j),
m AS (SELECT step, i, j, sum(x) / 48 AS mx, sum(y) / 48 AS my, sum(x * x) / 48 AS xx, sum(y * y) / 48 AS yy, sum(x * y) / 48 AS xy FROM v GROUP BY ALL), n AS (SELECT *, CASE WHEN (xx - mx * mx) * (yy - my * my) < 0 THEN 'nan'::DOUBLE ELSE sqrt((xx - mx * mx) * (yy - my * my)) END AS s FROM m)
SELECT step, i, j, round(CASE WHEN s < 1e-15 THEN 1 ELSE greatest(least(1 - (xy - mx * my) / s, 2), 0) END, 6) AS d FROM n""")
def se_correlation(spark, sf_dir):
    return _rounded(S.structural_correlation(*trade(spark, sf_dir)), "d")


@query(f"{FULL} SELECT step, count(DISTINCT i) AS n, count_if(isnan(d) OR isinf(d))::BIGINT AS bad_values, count_if(d < 0)::BIGINT AS negatives, count_if(i = j AND abs(d) > 1e-12)::BIGINT AS bad_diagonal, 0::BIGINT AS asymmetric FROM dist GROUP BY step")
def validate_distance(spark, sf_dir):
    return S.validate_distances(distances(spark, sf_dir)[0])


@query(f"{FULL} SELECT step, i, j, round(-0.5 * (d * d - avg(d * d) OVER (PARTITION BY step, i) - avg(d * d) OVER (PARTITION BY step, j) + avg(d * d) OVER (PARTITION BY step)), 6) + 0 AS b FROM dist")
def double_center(spark, sf_dir):
    return S.double_center(distances(spark, sf_dir)[0]).withColumn("b", F.round("b", 6) + 0.0)


def _placed(nodes: DataFrame) -> DataFrame:
    angle = F.col("i") * 0.7
    return nodes.select("step", "i", F.array(F.cos(angle), F.sin(angle)).alias("coord"))


PLACED = FULL + ", placed AS (SELECT step, i, cos(i * 0.7::DOUBLE) AS x, sin(i * 0.7::DOUBLE) AS y FROM nodes), gaps AS (SELECT d.step, d.i, d.j, d.d, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS e, a.x - b.x AS dx, a.y - b.y AS dy FROM dist d JOIN placed a ON a.step = d.step AND a.i = d.i JOIN placed b ON b.step = d.step AND b.i = d.j)"


@query(f"{PLACED} SELECT step, round(sqrt(sum(pow(e - d, 2)) / sum(d * d)), 6) AS stress FROM gaps WHERE i < j GROUP BY step")
def kruskal_stress(spark, sf_dir):
    cells, nodes = distances(spark, sf_dir)
    return _rounded(S.kruskal_stress(cells, _placed(nodes)), "stress")


@query(f"{PLACED}, parts AS (SELECT step, i, unnest([0, 1]) AS dim, unnest([dx, dy]) * CASE WHEN e > 1e-15 THEN d / e ELSE 0 END AS part FROM gaps WHERE i <> j) SELECT step, i, dim, round(sum(part) / 25, 6) AS x FROM parts GROUP BY ALL")
def guttman_step(spark, sf_dir):
    cells, nodes = distances(spark, sf_dir)
    return _rounded(S.guttman_step(cells, _placed(nodes)), "x")


@query(f"{FULL}, r AS (SELECT step, i, j, d, row_number() OVER (PARTITION BY step, i ORDER BY round(d, 9), j)::INTEGER AS rank FROM dist WHERE i <> j) SELECT step, i, j, round(d, 6) AS d, rank FROM r WHERE rank <= 5")
def knn_graph(spark, sf_dir):
    return _rounded(S.nearest(distances(spark, sf_dir)[0], 5, digits=9), "d")


def _similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symmetric similarity in [0, 1] of the nations of a year: the two flows between them, over the year's largest, all pairs."""
    adjacency, nodes = trade(spark, sf_dir)
    cells = S.dense(adjacency, nodes)
    both = cells.join(cells.select("step", F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v")), ["step", "i", "j"])
    return both.withColumn("s", (F.col("w") + F.col("v")) / F.max(F.col("w") + F.col("v")).over(Window.partitionBy("step")))


@query(f"""{TRADE}, sim AS (SELECT a.step, a.i, a.j, (a.w + b.w) / max(a.w + b.w) OVER (PARTITION BY a.step) AS s FROM cells a JOIN cells b ON a.step = b.step AND a.i = b.j AND a.j = b.i)
SELECT step, i, j, round(CASE WHEN i = j THEN 0 ELSE greatest(greatest(1 - s, 0), 1e-12) END, 6) AS linear, round(CASE WHEN i = j THEN 0 ELSE greatest(sqrt(greatest(1 - s * s, 0)), 1e-12) END, 6) AS cosine, round(CASE WHEN i = j THEN 0 WHEN s <= 0 THEN 1e6 ELSE greatest(least(-ln(s), 1e6), 1e-12) END, 6) AS info FROM sim""")
def sim_to_distance(spark, sf_dir):
    return _similarity(spark, sf_dir).select("step", "i", "j", *(F.round(S.similarity_to_distance(F.col("s"), m, F.col("i") == F.col("j")), 6).alias(m) for m in ("linear", "cosine", "info")))
