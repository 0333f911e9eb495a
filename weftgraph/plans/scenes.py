"""Queries over the nations' dataset by year: validation, frames, ego views, sonification, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.tables import table
from weftgraph.operators import dataset as D
from weftgraph.operators import frames as R
from weftgraph.plans.trade import TRADE, trade

QUERIES, ORACLE = {}, {}
STEPS, EGO = 12, "NATION_3"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LV = TRADE + """, outs AS (SELECT step, i, sum(w) AS o FROM cells GROUP BY ALL), ins AS (SELECT step, j AS i, sum(w) AS n FROM cells GROUP BY ALL),
lv AS MATERIALIZED (SELECT step - 1995 AS sheet_index, i AS row_ord, n_name AS label, round(o, 4) AS x, round(n, 4) AS y, (n_regionkey + i / 10.0)::DOUBLE AS z, round(o / 10, 4) - (i = 7)::INTEGER * 5 AS size, 0.0::DOUBLE AS size_alpha,
  (i * 37 + step * 91) % 720 - 360.0::DOUBLE AS spin_x, 0.0::DOUBLE AS spin_y, 0.0::DOUBLE AS spin_z, ['sphere','torus','cube','cylinder','pyramid','point'][n_regionkey + 1] AS shape,
  i / 25.0::DOUBLE AS color_r, 1.0::DOUBLE AS color_g, 1.0::DOUBLE AS color_b, 60 + i % 12 * 6 AS note, i AS instrument, i AS channel, 60 + i AS velocity, n_regionkey / 4.0::DOUBLE AS cluster_value, i % 5 AS beats
  FROM outs JOIN ins USING (step, i) JOIN nation ON n_nationkey = i),
lve AS MATERIALIZED (SELECT step - 1995 AS sheet_index, i * 25 + j AS edge_ord, a.n_name AS "from", b.n_name AS "to", round(w, 6) AS strength FROM adj JOIN nation a ON a.n_nationkey = i JOIN nation b ON b.n_nationkey = j WHERE w > 0),
last AS (SELECT max(sheet_index) AS last FROM lv), labels AS (SELECT label, (row_number() OVER (ORDER BY min((sheet_index, row_ord))) - 1)::INTEGER AS label_ord FROM lv GROUP BY label)"""


def dataset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: a sheet for each year, all nations as objects."""
    adjacency, nodes = trade(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    outs, ins = adjacency.groupBy("step", "i").agg(F.sum("w").alias("o")), adjacency.groupBy("step", F.col("j").alias("i")).agg(F.sum("w").alias("n"))
    joined = nodes.join(outs, ["step", "i"], "left").join(ins, ["step", "i"], "left").fillna(0.0).join(nation, F.col("i") == F.col("n_nationkey"))
    i, region = F.col("i"), F.col("n_regionkey")
    rows = joined.select(
        (F.col("step") - 1995).alias("sheet_index"), i.alias("row_ord"), F.col("n_name").alias("label"), F.round("o", 4).alias("x"), F.round("n", 4).alias("y"), (region + i / 10).alias("z"), (F.round(F.col("o") / 10, 4) - F.when(i == 7, 5).otherwise(0)).alias("size"),
        ((i * 37 + F.col("step") * 91) % 720 - 360.0).alias("spin_x"), F.element_at(F.array(*map(F.lit, D.SHAPES)), region + 1).alias("shape"), (i / 25.0).alias("color_r"),
        (60 + i % 12 * 6).alias("note"), i.alias("instrument"), i.alias("channel"), (60 + i).alias("velocity"), (region / 4).alias("cluster_value"), (i % 5).alias("beats"),
    )
    name = lambda key, out: nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(out))
    edges = adjacency.where("w > 0").join(name("i", "from"), "i").join(name("j", "to"), "j")
    return D.with_defaults(rows), edges.select((F.col("step") - 1995).alias("sheet_index"), (i * 25 + F.col("j")).alias("edge_ord"), "from", "to", F.round("w", 6).alias("strength"))


@query(f"{LV} SELECT label_ord, label FROM labels")
def canonical_labels(spark, sf_dir):
    return D.canonical_labels(dataset(spark, sf_dir)[0])


@query(f"{LV} SELECT sheet_index, row_ord + 1 AS row, unnest(list_filter([CASE WHEN size <= 0 THEN 'size is not above 0' END, CASE WHEN note > 127 THEN 'note is above 127' END, CASE WHEN channel > 15 THEN 'channel is above 15' END], lambda m: m IS NOT NULL)) AS message FROM lv")
def validate_rows(spark, sf_dir):
    return D.validate_rows(dataset(spark, sf_dir)[0])


@query(f"""{LV}, m AS (SELECT sheet_index, edge_ord + 1 AS edge, unnest([CASE WHEN NOT EXISTS (FROM lv WHERE lv.sheet_index = e.sheet_index AND label = e."from") THEN 'from is not in the sheet' END, CASE WHEN NOT EXISTS (FROM lv WHERE lv.sheet_index = e.sheet_index AND label = e."to") THEN 'to is not in the sheet' END]) AS message FROM lve e) SELECT * FROM m WHERE message IS NOT NULL""")
def validate_edges(spark, sf_dir):
    nodes, edges = dataset(spark, sf_dir)
    return D.validate_edges(edges, nodes)


@query(f"{LV} SELECT sheet_index, label, cluster_value FROM lv WHERE cluster_value BETWEEN 0.2 AND 0.6")
def cluster_filter(spark, sf_dir):
    return D.cluster_filter(dataset(spark, sf_dir)[0], 0.2, 0.6).select("sheet_index", "label", "cluster_value")


@query(f"{LV} SELECT least(min(cluster_value), 0) AS low, greatest(max(cluster_value), 1) AS high FROM lv")
def cluster_range(spark, sf_dir):
    return D.cluster_range(dataset(spark, sf_dir)[0])


@query(f"{LV} SELECT sheet_index, label, CASE WHEN row_ord % 2 = 0 THEN 'cube' ELSE shape END AS shape, CASE WHEN row_ord % 2 = 0 THEN 3.5 ELSE size END AS size FROM lv")
def object_override(spark, sf_dir):
    nodes, _ = dataset(spark, sf_dir)
    given = nodes.where("row_ord % 2 = 0").select("label").distinct().selectExpr("label", "'cube' AS shape", "3.5D AS size", "CAST(NULL AS FLOAT) AS color_r", "CAST(NULL AS FLOAT) AS color_g", "CAST(NULL AS FLOAT) AS color_b")
    return D.object_override(nodes, given).select("sheet_index", "label", "shape", "size")


@query(f"""{LV} SELECT sheet_index AS step, a.label_ord AS i, b.label_ord AS j, strength AS w FROM lve JOIN labels a ON a.label = "from" JOIN labels b ON b.label = "to" """)
def dataset_adjacency(spark, sf_dir):
    nodes, edges = dataset(spark, sf_dir)
    return D.adjacency(edges, D.canonical_labels(nodes))


@query(f"""{LV} SELECT DISTINCT sheet_index, "from", "to" FROM lve WHERE "from" NOT IN (SELECT label FROM lv WHERE cluster_value < 0.5) OR "to" NOT IN (SELECT label FROM lv WHERE cluster_value < 0.5)""")
def dropped_edges(spark, sf_dir):
    nodes, edges = dataset(spark, sf_dir)
    return D.dropped_edges(edges, nodes.where("cluster_value < 0.5").select("label").distinct())


@query(f"{LV}, moved AS (SELECT step - 1995 AS sheet_index, n_name AS label, i * 1.0::DOUBLE AS x FROM nodes JOIN nation ON n_nationkey = i) SELECT m.sheet_index, m.label, m.x, coalesce(size, 1) AS size, coalesce(shape, 'sphere') AS shape, coalesce(note, 60) AS note FROM moved m LEFT JOIN lv USING (sheet_index, label)")
def preserve_metadata(spark, sf_dir):
    nodes, _ = dataset(spark, sf_dir)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("label"))
    moved = trade(spark, sf_dir)[1].join(names, "i").select((F.col("step") - 1995).alias("sheet_index"), "label", F.col("i").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return D.preserve_metadata(moved, nodes).select("sheet_index", "label", "x", "size", "shape", "note")


@query(f"{TRADE} SELECT step - 1995 AS sheet_index, i AS row_ord, n_name AS label, i * 2.0::DOUBLE AS x, step * 1.0::DOUBLE AS y, 0.0::DOUBLE AS z, 'sphere' AS shape, 64 AS velocity FROM nodes JOIN nation ON n_nationkey = i")
def lv_dataset(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("label"))
    coords = trade(spark, sf_dir)[1].select("step", "i", F.array(F.col("i") * 2.0, F.col("step") * 1.0).alias("coord"))
    return D.lv_dataset(coords, names).select("sheet_index", "row_ord", "label", "x", "y", "z", "shape", "velocity")


def _frames_sql(where: str = "TRUE", mode: str = "CASE WHEN t < 0.5 THEN 4 * t * t * t ELSE 1 - pow(-2 * t + 2, 3) / 2 END") -> str:
    return LV + f""", pairs AS (SELECT coalesce(a.sheet_index, b.sheet_index - 1) AS transition, coalesce(a.label, b.label) AS label, a, b FROM (SELECT lv.* FROM lv, last WHERE sheet_index < last) a FULL JOIN (SELECT * FROM lv WHERE sheet_index > 0) b ON a.sheet_index = b.sheet_index - 1 AND a.label = b.label),
sliced AS (SELECT *, transition * {STEPS} + k AS slice_index, k / {STEPS}.0::DOUBLE AS t FROM pairs, (SELECT unnest(range(0, {STEPS}))::INTEGER AS k)), eased AS (SELECT *, {mode} AS e FROM sliced WHERE {where}),
f AS (SELECT slice_index, label, label_ord, list_position(['sphere','torus','cube','cylinder','pyramid','point'], coalesce(a.shape, b.shape)) - 1 AS shape_id, CASE WHEN a.label IS NULL THEN b.x WHEN b.label IS NULL THEN a.x ELSE a.x + (b.x - a.x) * e END AS x,
  coalesce(a.size, 0) + (coalesce(b.size, 0) - coalesce(a.size, 0)) * e AS size, CASE WHEN a.label IS NULL THEN b.spin_x WHEN b.label IS NULL THEN a.spin_x ELSE a.spin_x + CASE WHEN fmod(b.spin_x - a.spin_x, 360) > 180 THEN fmod(b.spin_x - a.spin_x, 360) - 360 WHEN fmod(b.spin_x - a.spin_x, 360) < -180 THEN fmod(b.spin_x - a.spin_x, 360) + 360 ELSE fmod(b.spin_x - a.spin_x, 360) END * e END AS spin_x FROM eased JOIN labels USING (label))
SELECT slice_index, label, shape_id, (row_number() OVER (PARTITION BY slice_index ORDER BY shape_id, label_ord) - 1)::INTEGER AS ord, round(x::FLOAT::DOUBLE, 3) AS x, round(size::FLOAT::DOUBLE, 3) AS size, round(spin_x::FLOAT::DOUBLE, 3) AS spin_x FROM f"""


def _frame_columns(frames: DataFrame) -> DataFrame:
    return frames.select("slice_index", "label", "shape_id", "ord", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("x", "size", "spin_x")))


@query(_frames_sql())
def lis_frames(spark, sf_dir):
    return _frame_columns(R.frames(dataset(spark, sf_dir)[0], STEPS))


@query(_frames_sql("slice_index = 29"))
def lis_frame_at(spark, sf_dir):
    return _frame_columns(R.frames(dataset(spark, sf_dir)[0], STEPS, at=29))


@query(_frames_sql(mode="1 - exp(-6 * t) * cos(6 * pi() * t)"))
def lis_frames_spring(spark, sf_dir):
    return _frame_columns(R.frames(dataset(spark, sf_dir)[0], STEPS, "spring"))


@query(f"WITH f AS ({_frames_sql()}) SELECT slice_index, shape_id, count(*) AS n FROM f GROUP BY ALL")
def frames_by_shape(spark, sf_dir):
    return R.frames(dataset(spark, sf_dir)[0], STEPS).groupBy("slice_index", F.least("shape_id", F.lit(5)).alias("shape_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{LV} SELECT count(DISTINCT sheet_index) AS time_points, count(DISTINCT label) AS n_labels, 72::BIGINT AS n_frames, 72 * count(DISTINCT label) * 64 AS bytes FROM lv")
def lis_estimate(spark, sf_dir):
    return R.frame_estimate(dataset(spark, sf_dir)[0], STEPS)


EASED = {"linear": "t", "ease_in": "t * t", "ease_out": "1 - (1 - t) * (1 - t)", "ease_in_out": "CASE WHEN t < 0.5 THEN 4 * t * t * t ELSE 1 - pow(-2 * t + 2, 3) / 2 END", "spring": "1 - exp(-6 * t) * cos(6 * pi() * t)"}


@query("SELECT k, " + ", ".join(f"round({v}, 9) AS {k}" for k, v in EASED.items()) + " FROM (SELECT k, k / 100.0::DOUBLE AS t FROM range(0, 101) r(k))")
def easing(spark, sf_dir):
    t = F.col("id") / 100.0
    return spark.range(101).select(F.col("id").alias("k"), *(F.round(R.ease(t, m), 9).alias(m) for m in EASED))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN (event_id % 72 + 5) % 72 ELSE least(event_id % 72 + 5, 71) END WHEN 'view' THEN event_id % 72 ELSE 0 END AS slice FROM events")
def advance_slice(spark, sf_dir):
    state = F.when(F.col("event_type") == "click", "playing").when(F.col("event_type") == "view", "paused").otherwise("stopped")
    slice_ = R.advance_slice(F.col("event_id") % 72, F.lit(72).cast("long"), state, F.col("user_id") % 2 == 0, F.lit(5).cast("long"))
    return table(spark, sf_dir, "events").select("event_id", slice_.cast("long").alias("slice"))


HOOD = f"""{LV}, hood AS MATERIALIZED (SELECT DISTINCT e.sheet_index, p.label AS owner, CASE WHEN e."from" = p.label THEN e."to" ELSE e."from" END AS label FROM lve e JOIN lv p ON p.sheet_index = e.sheet_index AND p.label IN (e."from", e."to") WHERE e."from" <> e."to"),
egos AS (SELECT DISTINCT e.sheet_index, CASE WHEN e."from" = '{EGO}' THEN e."to" ELSE e."from" END AS label FROM lve e JOIN lv ON lv.sheet_index = e.sheet_index AND lv.label = CASE WHEN e."from" = '{EGO}' THEN e."to" ELSE e."from" END WHERE e."from" <> e."to" AND '{EGO}' IN (e."from", e."to"))"""


@query(f"{HOOD} SELECT sheet_index, label FROM egos")
def ego_neighbors(spark, sf_dir):
    nodes, edges = dataset(spark, sf_dir)
    own = nodes.select("sheet_index").distinct().select("sheet_index", F.lit(EGO).alias("label"))
    return R.neighbours(edges, own, "both", nodes.select("sheet_index", "label").distinct()).select("sheet_index", "label")


@query(f"""{HOOD}, far AS (SELECT h.sheet_index, h.label FROM hood h JOIN egos g ON g.sheet_index = h.sheet_index AND g.label = h.owner JOIN lv ON lv.sheet_index = h.sheet_index AND lv.label = h.label),
own AS (SELECT DISTINCT sheet_index, '{EGO}' AS label FROM lv), seen AS (SELECT * FROM own UNION SELECT * FROM egos UNION SELECT * FROM far),
shared AS (SELECT h.sheet_index, h.label FROM hood h JOIN lv ON lv.sheet_index = h.sheet_index AND lv.label = h.label WHERE owner <> h.label GROUP BY ALL HAVING count(DISTINCT owner) >= 2)
SELECT seen.* FROM seen JOIN shared USING (sheet_index, label) WHERE label <> '{EGO}' UNION ALL SELECT * FROM own""")
def ego_visible(spark, sf_dir):
    return R.ego_visible(*dataset(spark, sf_dir), EGO, secondary=True, shared=True)


EGOS = f"""{HOOD}, tiers AS (SELECT e.*, 'primary' AS tier FROM lve e WHERE '{EGO}' IN ("from", "to") AND sheet_index IN (SELECT sheet_index FROM lv) UNION ALL SELECT e.*, 'secondary' FROM lve e JOIN egos g ON g.sheet_index = e.sheet_index AND g.label IN (e."from", e."to") WHERE '{EGO}' NOT IN (e."from", e."to"))"""


@query(f"""{EGOS} SELECT sheet_index, edge_ord, "from", "to", tier FROM tiers""")
def ego_edges(spark, sf_dir):
    return R.ego_edges(*dataset(spark, sf_dir), EGO, secondary=True).select("sheet_index", "edge_ord", "from", "to", "tier")


@query(f"""{EGOS} SELECT t.sheet_index, "from", "to", round(a.x::FLOAT::DOUBLE, 3) AS from_x, round(b.x::FLOAT::DOUBLE, 3) AS to_x, CASE WHEN '{EGO}' IN ("from", "to") THEN 1.0 ELSE 0.7 END::DOUBLE AS shade FROM tiers t JOIN lv a ON a.sheet_index = t.sheet_index AND a.label = "from" JOIN lv b ON b.sheet_index = t.sheet_index AND b.label = "to" """)
def ego_gpu_edges(spark, sf_dir):
    nodes, edges = dataset(spark, sf_dir)
    found = R.placed_edges(R.ego_edges(nodes, edges, EGO, secondary=True), nodes, EGO, True)
    return found.select("sheet_index", "from", "to", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("from_x", "to_x")), "shade")


@query(f"{HOOD} SELECT lv.sheet_index, lv.label, round(CASE WHEN lv.label = '{EGO}' THEN size * 1.05 ELSE size END, 6) AS size, CASE WHEN lv.label = '{EGO}' OR g.label IS NOT NULL THEN 1.0 ELSE 0.15 END::DOUBLE AS alpha, lv.label = '{EGO}' AS white FROM lv LEFT JOIN egos g ON g.sheet_index = lv.sheet_index AND g.label = lv.label")
def ego_style(spark, sf_dir):
    nodes, edges = dataset(spark, sf_dir)
    return R.ego_style(nodes, R.ego_visible(nodes, edges, EGO), EGO).withColumn("size", F.round("size", 6))


@query(f"{LV}, p AS (SELECT sheet_index, label, sqrt(pow(x * 100 - 400, 2) + pow(y * 100 - 400, 2)) AS d FROM lv) SELECT sheet_index, label, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY sheet_index ORDER BY d, label) AS r FROM p WHERE d < 200) WHERE r = 1")
def pick_object(spark, sf_dir):
    projected = dataset(spark, sf_dir)[0].select("sheet_index", "label", (F.col("x") * 100).alias("px"), (F.col("y") * 100).alias("py"))
    return R.pick_object(projected, 400.0, 400.0, 200.0).select("sheet_index", "label", F.round("distance", 6).alias("distance"))


@query("SELECT b AS beats, s AS steps, CASE WHEN least(b, greatest(s // 2, 1)) > 0 THEN greatest(s // least(b, greatest(s // 2, 1)), 1) END AS every FROM range(0, 20) x(b), range(1, 60) y(s)")
def beat_interval(spark, sf_dir):
    grid = spark.range(20).select(F.col("id").alias("beats")).crossJoin(spark.range(1, 60).select(F.col("id").alias("steps")))
    return grid.select("beats", "steps", R.beat_interval(F.col("beats"), F.col("steps")).alias("every"))


def _midi_sql(channel: str, note: str, velocity: str) -> str:
    return f"""{LV}, hits AS (SELECT (sheet_index * {STEPS} + k)::INTEGER AS slice_index, label, ({channel})::INTEGER AS channel, ({note})::INTEGER AS note, ({velocity})::INTEGER AS velocity, instrument FROM lv, last, (SELECT unnest(range(0, {STEPS}, 4)) AS k) WHERE sheet_index < last)
SELECT slice_index, 'on' AS kind, label, channel, note, velocity, instrument FROM hits UNION ALL SELECT slice_index + 2, 'off', label, channel, note, 0, instrument FROM hits"""


PITCH = "least(greatest(note + floor(least(greatest(size, 0), 1) * 12 + 0.5), 0), 127)"


def _midi(mapping: str, channel: str, note: str, velocity: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.midi_events(dataset(spark, sf_dir)[0], STEPS, 3, mapping, velocity=80, hold=2)

    name = "midi_events" if mapping == "centrality_to_pitch" else f"midi_{mapping}"
    QUERIES[name], ORACLE[name] = run, _midi_sql(channel, note, velocity)


_midi("centrality_to_pitch", "channel", PITCH, "least(velocity, 80)")
_midi("degree_to_velocity", "channel", "note", "floor(least(greatest(size, 0), 1) * 127 + 0.5)")
_midi("betweenness_pitch_closeness_velocity", "channel", PITCH, "floor(least(greatest(cluster_value, 0), 1) * 127 + 0.5)")
_midi("cluster_to_channel", "floor(abs(cluster_value)) % 16", PITCH, "least(velocity, 80)")
